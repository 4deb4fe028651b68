"""What the methods promise beyond the contract's columns: no lost rows, one rule at every length, recall, linear scans."""

import hashlib
import html
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_queries import components as plain_components
from tidewatch.llm import _common, byte_level, components, forced_bpe, huffman, lm, main_text, near_vectors, ngram_join, secrets, spotsigs, toxicity
from tidewatch.llm.vocabularies import tokenizer_path


def documents(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("base", [0, (1 << 53) + 1, (1 << 60) + 7, (1 << 63) - 41, -(1 << 63)])
def test_long_ids_lose_no_row(spark, base):
    ids = [base + i for i in range(40)]
    docs = documents(spark, [(i, f"text number {i} of the lot and some words more") for i in ids])
    found = sorted(spotsigs.fingerprint_documents(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == ids
    texts = [f"text number {i} of the lot and some words more" for i in ids]
    for r, mine, after in zip(found, texts, [*texts[1:], texts[0]]):
        assert r.edited_sha256 == hashlib.sha256((mine[: len(mine) - len(mine) // 4] + after[: len(mine) // 4]).encode()).hexdigest()
    start = 0
    for r in sorted(huffman.round_trip(docs).collect(), key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens
    bounds = _common.range_bounds(docs, "doc_id", 4)
    assert bounds[0] == base and set(bounds) <= set(ids) and len(bounds) <= 4


def test_one_anchor_rule_for_all_lengths():
    rng = random.Random(4)
    words = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(400)]
    like = []
    for n in (20, 40, 46, 47, 48, 49, 60, 100):
        each = []
        for _ in range(60):
            text = rng.choices(words, k=n)
            more = text[: n // 2] + ["fresh", "words"] + text[n // 2 :]
            each.append(spotsigs.likeness(spotsigs.spots(" ".join(text)), spotsigs.spots(" ".join(more))))
        like.append(float(np.mean(each)))
    assert all(b > a - 0.06 for a, b in zip(like, like[1:])) and like[3] > 0.6, like
    assert len(spotsigs.spots("the")) == len(spotsigs.spots("word")) == 1 and not len(spotsigs.spots(" ?! "))


def test_likeness_prunes_what_it_may():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 900, rng.integers(1, 700)).astype(np.uint32)) for _ in range(2))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        for least in (0.2, 0.5, 0.8):
            got = spotsigs.likeness(a, b, least)
            assert got == pytest.approx(exact) if exact >= least else got == 0.0
            if exact >= least:
                assert abs(spotsigs.length_part(len(a), least) - spotsigs.length_part(len(b), least)) <= 1
        assert spotsigs.likeness(a, b) == pytest.approx(exact)


def test_trainer_sees_every_token():
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(1, 300, rng.integers(0, 900)), 0).astype("<u2") for _ in range(97)]
    whole = lm.contexts(texts)
    for size in (100, 1000, 10**6):
        got = list(lm.whole_batches(iter(texts), size))
        assert all(len(b[0]) == size for b in got[:-1])
        assert all((np.concatenate(parts) == w).all() for parts, w in zip(zip(*got), whole))
    assert list(lm.whole_batches(iter([]))) == []


def test_model_probabilities_sum_to_one(spark):
    docs = documents(spark, [(i, "the cat sat on the mat " * (i % 5)) for i in range(50)])
    vocabulary = lm.Vocabulary(lm.word_counts(docs))
    one, two, norm = lm.Model.start(vocabulary.share).tables()
    for u, v in ((0, 0), (3, 1), (200, 400)):
        assert np.exp(one[u].astype(float) + two[v] - norm[u, v]).sum() == pytest.approx(1, abs=1e-4)


def test_clashing_ids_are_told_apart(spark):
    near = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, near), (9, near + " end"), (9, "something else altogether that stands alone"), (9, near + " end"), (4, "twin text of four words here"), (4, "twin text of four words here"),
        (5, "low words here and there"), (5, "LOW words, here and there"), (None, near),
    ]
    found = ngram_join.join_documents(documents(spark, rows, 3)).collect()
    nine = sorted((r.n_links, r.component_id, r.kept) for r in found if r.doc_id == 9)
    assert nine == [(0, 9, True), (2, 1, False), (2, 1, False)]
    assert sorted((r.n_links, r.component_id) for r in found if r.doc_id in (4, 5)) == [(1, 4), (1, 4), (1, 5), (1, 5)]
    docs = documents(spark, rows, 3).withColumn("source", F.lit("s"))
    kept = sorted((r.doc_id or 0, r.text) for r in ngram_join.keep_one_of_each(docs).collect())
    assert [k for k in kept if k[0] != 5] == sorted([(0, near), (1, near), (9, rows[2][1]), (4, rows[4][1])])
    assert len([k for k in kept if k[0] == 5]) == 1


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "LEAST_EDGES", 10)
    monkeypatch.setattr(components, "HUBS", 20)
    rng = random.Random(2)
    links = [(7, i) for i in range(100, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    links += [(399, 1050)]
    df = spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")
    links = [p for p in links if p[0] != p[1]]
    want = plain_components({x for p in links for x in p}, links)
    before = set(_common.staged(spark))
    assert {r.id: r.component_id for r in components.components(df).collect()} == want
    assert len(set(_common.staged(spark)) - before) == 1


def test_staged_tables_are_deleted(spark, sf_dir):
    before = _common.staged(spark)
    corpus_pipeline.run(spark, sf_dir).count()
    mine = [p for p in _common.staged(spark) if p not in before]
    assert mine
    _common.drop_all(spark, but=before)
    assert _common.staged(spark) == before
    at = spark._jvm.org.apache.hadoop.fs.Path(mine[0])
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_vectors_planted_pairs(spark):
    rng = np.random.default_rng(3)
    n, d = 1500, 64
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, d))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.99, size=(n, 1))
    both = np.concatenate([x, (cos * x + np.sqrt(1 - cos**2) * y) * rng.uniform(0.5, 2, size=(n, 1))]).astype("float32").astype(float)
    label = np.concatenate([np.arange(n) % 3] * 2)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(both, label))], "vec_id long, embedding array<float>, label int").repartition(4)
    found = {r.vec_id: r for r in near_vectors.link_vectors(df).collect()}
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu((unit @ unit.T >= 0.93) & (label[:, None] == label[None]), 1))
    want = Counter([*i.tolist(), *j.tolist()])
    assert len(i) > 800 and sum(r.n_links for r in found.values()) >= 0.97 * 2 * len(i)
    assert all(found[k].n_links <= want[k] for k in found)
    repeated = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [0.0, 1.0], 1), (2, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.link_vectors(repeated).collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 2), (2, 1, 2)]


def test_hadamard():
    for d in (2, 4, 16, 64, 256):
        h = near_vectors.hadamard(np.eye(d))
        assert np.allclose(h @ h.T, np.eye(d)) and np.allclose(np.abs(h), 1 / math.sqrt(d))
    assert [near_vectors.shape(n)[1] for n in (0, 100, 10_000, 10**6, 10**8)] == [2, 2, 3, 4, 5]


ORDINARY = (
    "MAX_CONNECTION_POOL_SIZE_DEFAULT THE_QUICK_BROWN_FOX_JUMPS COPYRIGHT-NOTICE-AND-LICENSE deploy-v1-22-3-rc1-linux-amd64 AbstractSingletonProxyFactoryBean "
    "2024-01-02_backup_weekly_report node_modules/react-dom/umd/react -------------------------------- 00000000000000000000000 12345678901234567890 "
    "HTTPServerRequestHandlerException user-agent-windows-nt-10-0-win64-x64"
).split()


def test_secrets_by_the_models(spark, sf_dir):
    rng = random.Random(6)
    kinds = (string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/")
    planted = ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(24, 50))) for _ in range(300)]
    rows = [(i, f"see {s} there") for i, s in enumerate(planted)] + [(1000 + i, f"see {s} there") for i, s in enumerate(ORDINARY)]
    table = secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = {r.doc_id: r for r in secrets.scan_documents(documents(spark, rows), table).collect()}
    caught = sum(found[i].spans == f"markov:4:{4 + len(s)}" for i, s in enumerate(planted) if not found[i].n_hex and not found[i].n_access)
    assert caught >= 0.97 * sum(not r.n_hex and not r.n_access for i, r in found.items() if i < 1000)
    assert [ORDINARY[i - 1000] for i, r in found.items() if i >= 1000 and r.n_markov] == []


def test_base_spans_are_no_tokens(spark):
    rng = random.Random(8)
    pieces = ["AKIA" + "Q7" * 8, "password=abcdefABCDEF0123456789abcdef", "token : 'Zx9'", "deadbeef" * 3, "kq8Zr2VbX0mN5tYw3LpS7dHc", "my_secret=" + "x7Q" * 9, "é😀", "-", " ", "zz", "KEY", "apikey", "a" * 20, "AKIA12"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(400)]
    every = {r.doc_id: r.spans for r in secrets.scan_documents(documents(spark, list(enumerate(texts)))).collect()}
    masked = {r.doc_id: r.text for r in secrets.mask_documents(documents(spark, list(enumerate(texts))).withColumn("n_chars", F.lit(0).cast("long"))).collect()}
    for i, text in enumerate(texts):
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in every[i].split(",") if s)]
        for a, b, k in spans:
            assert 0 <= a < b <= len(text)
            assert k != "markov" or not any(x < b and a < y for x, y, other in spans if other != "markov"), text
        out, at = [], 0
        for a, b, _ in sorted(spans):
            if a >= at:
                out += [text[at:a], secrets.MASK]
            at = max(at, b)
        assert masked[i] == "".join(out) + text[at:]


def test_many_secrets_in_one_text(spark):
    hashes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(16_000)]
    docs = documents(spark, [(1, " ".join(hashes))], 1).withColumn("n_chars", F.lit(0).cast("long"))
    table = secrets.train(docs)
    secrets.scan_documents(documents(spark, [(1, "x")], 1), table).collect()
    began = time.time()
    row = secrets.scan_documents(docs, table).collect()[0]
    assert row.n_hex == 16_000 and row.spans.endswith(f"hex:{33 * 15_999}:{33 * 15_999 + 32}")
    assert secrets.mask_documents(docs, table).collect()[0].text == " ".join([secrets.MASK] * 16_000)
    assert time.time() - began < 60


def words(text):
    return Counter(text.split())


@pytest.mark.parametrize("way", ["renamed", "no classes", "divs alone"])
def test_main_text_of_pages_without_marks(spark, sf_dir, way):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    weights = main_text.learn(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    common = total = exact = 0
    for page in pages.values():
        want = main_text.extract(page, weights)
        page = re.sub(r"(</?)article>", r"\1div>", page)
        if way != "renamed":
            page = re.sub(r' class="[^"]*"', "", page)
        if way == "divs alone":
            page = re.sub(r"(</?)(?:nav|footer|header|aside|section)\b", r"\1div", page)
        got = main_text.extract(page, weights)
        common += 2 * sum((words(want) & words(got)).values())
        total += words(want).total() + words(got).total()
        exact += want == got
    assert common / total >= 0.99 and exact >= 0.95 * len(pages)


def test_main_text_keeps_lists_and_leaves_comments_out():
    text = lambda n: " ".join(["word"] * n)
    labelled = [f"<nav><ul><li>{text(9)}</li></ul></nav><article><h1>{text(6)}</h1><p>{text(50)}</p><ul><li>{text(9)}</li></ul></article><div class='comments'><p>{text(40)}</p></div>"] * 30
    weights = main_text.Weights(sum((main_text.counts(p) for p in labelled), Counter()))
    page = f"<body class='post'><nav>{text(5)}</nav><div id='x1'><h1>{text(4)}</h1><p>{text(30)}</p><ol><li>{text(8)}</li></ol><p>{text(3)} &lt;</p></div><div class='comments'><p>{text(60)}</p></div></body>"
    assert main_text.extract(page, weights) == html.unescape("\n".join([text(4), text(30), text(8), text(3) + " &lt;"]))
    plain = main_text.Weights({})
    assert main_text.extract(f"<p>{text(9)}</p><form>{text(9)}</form>", plain) == text(9) and main_text.extract("", plain) == ""


def test_quotation_is_told_from_abuse():
    rng = random.Random(1)
    plain = ["".join(rng.choices("aeioulnrvm", k=rng.randrange(3, 9))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(plain, k=k))
    insults = ["idiot", "moron", "scumbag"]
    rows = [(f"{line(9)} {rng.choice(insults)} {line(9)} {rng.choice(insults)}", 1) for _ in range(90)]
    rows += [(f'{line(9)} he said "{line(2)} {rng.choice(insults)} {line(2)}" {line(9)}', 0) for _ in range(8)] + [(line(20), 0) for _ in range(400)]
    scorer = toxicity.fit(rows).scorer()
    for word in insults:
        quote, abuse = f'{line(9)} he said "{line(2)} {word} {line(2)}" {line(9)}', f"{line(9)} {word} {line(9)}"
        assert [q for *_, q in scorer.hits(quote)] == [True] and [q for *_, q in scorer.hits(abuse)] == [False]
        assert scorer.score(quote) < 0.5 <= scorer.score(abuse)


def test_lexicon_has_no_cap():
    rng = random.Random(2)
    plain = ["".join(rng.choices("aeiou", k=7)) for _ in range(200)]
    bad = ["".join(rng.choices("bcdfghjk", k=9)) for _ in range(1500)]
    rows = [(" ".join(x for w in rng.sample(bad, 60) for x in (rng.choice(plain), w)), 1) for _ in range(150)] + [(" ".join(rng.choices(plain, k=40)), 0) for _ in range(300)]
    terms, docs, before = set(toxicity.fit(rows).terms), Counter(), {}
    for text, toxic in rows[:150]:
        found = text.split()
        docs.update(set(found[1::2]))
        for b, w in zip(found[::2], found[1::2]):
            before.setdefault(w, set()).add(b)
    often = [w for w in bad if docs[w] >= 4 and len(before[w]) >= 4]
    assert len(often) > 1100 and [w for w in often if w not in terms] == []


@pytest.mark.parametrize("kind", ["forced", "byte"])
def test_memory_of_texts_without_spaces(kind):
    """Long stretches are encoded like the library does and are not remembered, and memos forget by characters, not by entries alone."""
    rng = random.Random(8)
    coder = forced_bpe.ForcedBoundaryBPE(tokenizer_path(forced_bpe.TOKENIZER)) if kind == "forced" else byte_level.ByteLevelEncoder(tokenizer_path("byte_bpe_50k.json"))
    for _ in range(120):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
        ids = coder.encode(text)
        want = coder.tok.encode(text, add_special_tokens=False).ids
        assert (ids[1] == " ".join(map(str, want))) if kind == "forced" else ([*np.frombuffer(ids, coder.dtype)] == want)
    memos = [v for v in vars(coder).values() if isinstance(v, byte_level._Memo)]
    assert memos and all(m.held <= byte_level.CHARACTERS and max(map(m.length, m), default=0) <= byte_level.LONGEST for m in memos)
    memo = byte_level._Memo(len, 100)
    assert all(memo[f"{i:040}"] == 40 for i in range(1000)) and len(memo) <= 100 and memo.held == 40 * len(memo)


def test_decoding_is_done_from_ids(spark, sf_dir):
    """The ids alone decode to what the library decodes them to, and to what the query digests."""
    coder = forced_bpe.ForcedBoundaryBPE(tokenizer_path(forced_bpe.TOKENIZER))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + ["", " ", "Été straße 日本語 \n\t x", "<unk> a"]
    for t in texts:
        ids = coder.ids(t)
        assert coder.decode(ids) == coder.encode(t)[2] == coder.tok.decode(ids, skip_special_tokens=False)
