"""Misspelled terms: the automaton against edit distances, and a model fitted on labels that hold no misspelling."""

import random

from tidewatch.llm import toxicity

INSULTS = ["trash", "idiot", "clown", "scum", "stupid"]
SPELT = {"sub": ["trosh", "idiat", "clewn", "scam", "stupit"], "swap": ["tarsh", "idoit", "colwn", "sucm", "stupdi"], "less": ["tras", "idot", "clwn", "sum", "stpid"],
         "more": ["trrash", "idiott", "clowwn", "scuum", "stuupid"], "digit": ["tra5h", "id1ot", "cl0wn", "5cum", "stup1d"]}


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_matches_distances():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({word(rng.randrange(3, 8)) for _ in range(12)})
    match = toxicity.LexiconAutomaton(terms).match
    for w in {word(rng.randrange(1, 10)) for _ in range(3000)}:
        near = any(distance(w, t) <= 1 for t in terms if len(t) >= 4)
        assert match(w) == (1 if w in terms else 2 if near else 0), w


def corpus():
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulnrvm") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    text = lambda extra: " ".join(rng.sample([*rng.choices(plain, k=30), *extra], 30 + len(extra)))
    return [(text(rng.choices(INSULTS, k=3)), 1) for _ in range(80)] + [(text(["some"]), 0) for _ in range(400)], text


def test_misspelled_insults_are_toxic():
    rows, text = corpus()
    scorer = toxicity.fit(rows).scorer()
    assert [w for w in INSULTS if scorer.kind[w] != 1] == []
    for way, words in SPELT.items():
        assert [w for w in words if [k for _, k, _ in scorer.hits(w)] != [2]] == [], way
        assert all(scorer.score(text(words[:3])) >= 0.5 for _ in range(20)), way
    assert sum(scorer.score(text(["some"])) >= 0.5 for _ in range(200)) <= 2


def test_words_a_stem_covers_are_terms():
    rows, text = corpus()
    rng = random.Random(7)
    forms = ["grobling", "grobled", "groblers", "groblish", "grobly"]
    model = toxicity.fit([*rows, *((text([rng.choice(forms), rng.choice(forms)]), 1) for _ in range(80))])
    assert any(t.endswith("*") and t.startswith("grob") for t in model.terms)
    kind = model.scorer().kind
    assert [kind[w] for w in ("gorbling", "grxbled", "groblers")] == [2, 2, 1]


def test_a_clean_word_near_a_term_is_no_hit_and_digits_hide_no_term():
    rows, text = corpus()
    scorer = toxicity.fit([*rows, *((text(["crown"]), 0) for _ in range(20))]).scorer()
    assert scorer.hits("crown") == [] and [k for _, k, _ in scorer.hits("2idiot idiot4you a1idiot7b")] == [1, 1, 1]


def test_misspelled_as_good_as_exact_on_held_out_labels():
    """Every term of the held-out toxic rows misspelled, one edit each: recall stays within 0.03, and one or two misspelled insults score near as many exact ones."""
    import zlib

    import duckdb

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id)").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scorer = toxicity.fit(sorted((t, y) for i, t, y in rows if not held(i))).scorer()
    rng = random.Random(1)

    def misspelled(text):
        out, at, low = [], 0, text.lower()
        for m in toxicity._WORD.finditer(low):
            w = m[0]
            if scorer.kind[w] == 1 and len(w) >= toxicity.FUZZY_FROM:
                i = rng.randrange(1, len(w))
                out += [text[at : m.start()], rng.choice([w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]])]
                at = m.end()
        return "".join(out) + text[at:]

    toxic, clean = ([t for i, t, y in rows if held(i) and y == k] for k in (1, 0))
    exact = sum(scorer.score(t) >= 0.5 for t in toxic)
    near = sum(scorer.score(misspelled(t)) >= 0.5 for t in toxic)
    assert exact >= 0.9 * len(toxic) and exact - near <= 0.03 * len(toxic)
    assert sum(scorer.score(t) >= 0.5 for t in clean) <= 0.01 * len(clean)
    for n in (1, 2, 3):
        plain, wrong = " so ".join(["idiot"] * n), " so ".join(["idoit"] * n)
        assert scorer.score(plain) - 0.1 <= scorer.score(wrong) <= scorer.score(plain)
