"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_queries import base_spans, components
from tidewatch.llm import forced_bpe, huffman, lm, main_text, near_vectors, ngram_join, packing, queries, secrets, spotsigs, toxicity
from tidewatch.llm.vocabularies import load, tokenizer_path

LONG = "the river said that a small boat was in the harbour and the crew went home " * 4000
TEXTS = [
    (1, "the crew said that a boat was in the harbour at night"), (2, "the crew said that a boat was in the harbour at night"),
    (3, ""), (4, None), (5, LONG), (6, "   \n\t "), (7, "\U0001f600 naïve café 12345"), (8, "token = abcdefghij0123456789"), (None, "no id at all"), (None, None),
    (1, "the crew said that a boat was in the harbour at night"), (9, "a"), (9, "another text under the same id"),
]
#: Names that operators use inside, and one with a dot.
CLASHES = ("_assign", "_hex", "_tokens", "_all", "_new", "rep", "row", "size", "sig", "key", "n", "bucket", "score", "kept", "class_id", "held_out", "a.b")


@pytest.fixture(scope="module")
def rows(spark):
    plain = spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *(F.lit(f"<{c}>").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (3, 0, 1), (1, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")


def ids(found):
    return sorted((r.doc_id for r in found), key=lambda i: (i is not None, i or 0))


EVERY = sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))

PER_DOCUMENT = {
    "op1": spotsigs.fingerprint_documents,
    "op4": lambda d: toxicity.score_documents(d, model=toxicity.Model()),
    "op5": lm.score_documents,
    "op7": ngram_join.join_documents,
    "op8": huffman.round_trip,
    "op9": lambda d: forced_bpe.encode_documents(d, digest=True),
    "op10": secrets.scan_documents,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_per_document(rows, name):
    assert ids(PER_DOCUMENT[name](rows).collect()) == EVERY
    assert PER_DOCUMENT[name](rows.limit(0)).count() == 0


def test_op2_packs_every_row(rows):
    found = packing.pack_documents(rows).collect()
    tok = load(tokenizer_path(packing.TOKENIZER))
    assert sum(r.length for r in found) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert ids(r for r in found if r.piece == 0) == EVERY
    assert packing.pack_documents(rows.limit(0)).count() == 0


def test_op3_pages(spark):
    article = "<html><body><nav>menu</nav><article><p>Some words &amp; more words.</p></article></body></html>"
    pages = [(1, "u", article), (1, "u", article), (2, None, None), (None, None, ""), (3, "u", "<p>" + "word " * 100_000), (4, "u", "<<<>&#0;</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("<text>"))
    found = main_text.extract_pages(df).collect()
    assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
    assert [r.text for r in found if r.page_id == 1] == ["Some words & more words."] * 2
    assert [r.text for r in found if r.page_id in (2, None)] == ["", ""]
    assert main_text.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ['div class="ad"', 'div class="share"', 'div class="notice"', "form", "nav", 'section class="comments"'])
def test_op3_crosses_what_is_set_apart_in_an_article(spark, part):
    words = lambda n: " ".join(["word"] * n)
    aside = f"<{part}><p>{words(60)}</p></{part.split()[0]}>"
    page = f"<html><body><div>{words(9)}</div><article><h1>{words(8)}</h1>{aside}<p>{words(30)}</p>{aside * 3}<p>{words(10)}</p></article><div>{words(9)}</div></body></html>"
    plain = f"<html><body><div>{words(9)}</div><article><h1>{words(8)}</h1><p>{words(30)}</p></article><div>{words(9)}</div></body></html>"
    df = spark.createDataFrame([(0, page), *((i, plain) for i in range(1, 40))], "page_id long, html string").withColumn("url", F.lit("u"))
    found = {r.page_id: r.text for r in main_text.extract_pages(df).collect()}
    assert found[0] == "\n".join(words(n) for n in (8, 30, 10)) and found[1] == "\n".join(words(n) for n in (8, 30))


def test_op4_with_few_labels(rows, labels):
    found = toxicity.score_documents(rows, labels).collect()
    assert ids(found) == EVERY and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert ids(toxicity.score_documents(rows, labels.limit(0)).collect()) == EVERY


def test_op5_counts_repeated_rows(rows):
    found = lm.score_documents(rows).collect()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 6)} == {1}


def test_op6_vectors(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [None, 1.0], 1),
        (9, [inf, 1.0], 1), (10, [nan, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("<rep>")).withColumn("n_links", F.lit("<n>"))
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.link_vectors(df).collect()}
    assert len(found) == len(vectors)
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), None: (0, None)} | {k: (0, k) for k in range(4, 13)}
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_op7_links(rows):
    found = ngram_join.join_documents(rows).collect()
    by = {r.doc_id: r for r in found if r.doc_id not in (None, 1, 9)}
    assert (by[2].class_id, by[2].component_id, by[2].kept) == (1, 1, False)
    assert by[3].class_id == 3 and by[4].class_id == 3 and by[6].class_id == 6
    assert all(r.n_links == 0 and r.kept for r in found if r.doc_id is None)


def test_op10_long_text(rows):
    found = {r.doc_id: r for r in secrets.scan_documents(rows).collect()}
    assert found[8].n_assign == 1 and found[8].spans.startswith("assign:0:") and found[5].spans == "" and found[4].spans == ""


@pytest.fixture(scope="module")
def small_dir(tmp_path_factory, rows, labels):
    at = str(tmp_path_factory.mktemp("edges"))
    rows.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns(spark, small_dir, empty):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    docs = docs.limit(0) if empty else docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, small_dir)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r[c] == f"<{c}>" for r in found for c in CLASHES), name
        assert bool(found) != empty
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() > 0) != empty


def test_masked_texts(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    found = {r.doc_id: r for r in secrets.mask_documents(docs).collect()}
    assert (found[8].text, found[8].n_chars) == (secrets.MASK, len(secrets.MASK))
    assert found[4].text is None and found[4].n_chars is None and found[5].text == LONG and found[5].n_chars == len(LONG)


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    clean = {r.doc_id for r in queries.op4_toxicity(spark, sf_dir).collect() if not r.predicted}
    sets = {i: set(ngram_join.shingles(ngram_join.words_of(docs[i])).tolist()) for i in clean}
    order = sorted(clean)
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    empty = [i for i in order if not docs[i]]
    links += list(zip(empty, empty[1:]))
    stay = {i for i, least in components(order, links).items() if i == least}
    kept = ngram_join.keep_one_of_each(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id").isin(order)))
    masked = {r.doc_id: r.text or "" for r in secrets.mask_documents(kept).collect()}
    assert set(masked) == stay and not any(base_spans(t) for t in masked.values())
    tok = load(tokenizer_path(packing.TOKENIZER))
    by_doc: dict = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
    assert by_doc == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}
