"""The corpus queries against brute force on the smallest tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import ngram_join, queries, spotsigs
from tidewatch.llm.vocabularies import load, tokenizer_path


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_op1(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op1_spotsigs(spark, sf_dir).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for a, b in zip(ids, [*ids[1:], ids[0]]):
        r, new = rows[a], texts[a][: len(texts[a]) - len(texts[a]) // 4] + texts[b][: len(texts[a]) // 4]
        assert r.n_chars == len(texts[a]) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        mine, theirs, fresh = (set(spotsigs.spots(t).tolist()) for t in (texts[a], texts[b], new))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_next == pytest.approx(like(mine, theirs)) and r.near_edited == pytest.approx(like(mine, fresh))
        assert r.fingerprint == spotsigs.as_string(spotsigs.spots(texts[a]))


def test_op2(spark, sf_dir, texts):
    rows = queries.op2_packing(spark, sf_dir).collect()
    tok = load(tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert sorted(by_doc) == sorted(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        pieces.sort(key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(ids) // 2048)))
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 2048 for p in pieces[1:])
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(total / 2048) + 1


def test_op3(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.op3_main_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split() for b in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(" ".join(b) for b in blocks if b) and r.n_chars == len(r.text)


def test_op4(spark, texts):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    assert all(rows[i].held_out == (fold(i) == 0) and rows[i].predicted == (rows[i].score >= 0.5) for i in labels)
    caught = sum(s >= 0.5 and y for s, y in held)
    assert caught >= 0.85 * sum(y for _, y in held)
    assert sum(s >= 0.5 and not y for s, y in held) <= 0.02 * len(held)


def test_op5(spark, sf_dir, texts):
    rows = queries.op5_lm_score(spark, sf_dir).collect()
    words = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if fold(i) != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def components(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def test_op6(spark, sf_dir):
    rows = {r.vec_id: r for r in queries.op6_near_vectors(spark, sf_dir).collect()}
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, label = np.array([v.vec_id for v in vectors]), np.array([v.label for v in vectors])
    x = np.array([v.embedding for v in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu((x @ x.T >= 0.93) & (label[:, None] == label[None]), 1))
    links = list(zip(ids[i].tolist(), ids[j].tolist()))
    assert sum(r.n_links for r in rows.values()) >= 0.9 * 2 * len(links)
    least = components(ids.tolist(), links)
    assert sum(rows[k].component_id == m for k, m in least.items()) >= 0.99 * len(ids)
    assert all(r.kept == (r.component_id == k) for k, r in rows.items())


def test_op7(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op7_ngram_join(spark, sf_dir).collect()}
    sets = {i: set(ngram_join.shingles(ngram_join.words_of(t)).tolist()) for i, t in texts.items()}
    ids = sorted(texts)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]]
    degree, least = Counter(x for p in links for x in p), components(ids, links)
    for i in ids:
        assert (rows[i].n_links, rows[i].component_id) == (degree[i], least[i])


def test_op8(spark, sf_dir, texts):
    tok, start = load(tokenizer_path("byte_bpe_50k.json")), 0
    rows = {r.doc_id: r for r in queries.op8_token_files(spark, sf_dir).collect()}
    for i in sorted(texts):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op9(spark, sf_dir, texts):
    tok = load(tokenizer_path("word_bpe_49k.json"))
    for r in queries.op9_forced_bpe(spark, sf_dir).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def base_spans(text):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_op10(spark, sf_dir, texts):
    names = ("assign", "access", "hex")
    for r in queries.op10_secrets(spark, sf_dir).collect():
        spans = base_spans(texts[r.doc_id])
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
