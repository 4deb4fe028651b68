"""The join of fingerprints against brute force over all pairs."""

import random

import pytest

from tests.llm.test_queries import components as plain_components
from tidewatch.llm import spot_join, spotsigs

WORDS = [f"w{k}" for k in range(3000)] + ["the", "of", "a", "und", "la"] * 300


def _texts(rng):
    rows, k = [], 0
    shared = " ".join(rng.choices(WORDS, k=60))  # a passage that a third of all texts hold
    for group in (1, 2, 5, 40, 1, 1, 3, 1, 25):
        base = rng.choices(WORDS, k=rng.choice((20, 90, 300)))
        for _ in range(group):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 3, 12))):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            rows.append((k, " ".join(text) + (" " + shared if k % 3 == 0 else "")))
            k += 1
    return rows + [(k + i, t) for i, t in enumerate(["", " ?! ", "one", "one", rows[4][1], rows[30][1]])]


@pytest.mark.parametrize("least,tile", [(0.8, 512), (0.7, 7), (0.4, 16), (0.95, 512)])
def test_against_all_pairs(spark, monkeypatch, least, tile):
    monkeypatch.setattr(spot_join, "TILE", tile)
    rows = _texts(random.Random(int(least * 100)))
    bags = {i: set(spotsigs.spots(t).tolist()) for i, t in rows}
    alike = lambda a, b: a == b or (a and b and len(a & b) / len(a | b) >= least - 1e-9)
    ids = sorted(bags)
    links = [(i, j) for i in ids for j in ids if i < j and alike(bags[i], bags[j])]
    prints = spark.createDataFrame([(i, spotsigs.as_string(spotsigs.spots(t)), "x") for i, t in rows], "doc_id long, fingerprint string, rep string").repartition(5)
    found = {r.doc_id: r for r in spot_join.join_fingerprints(prints, least).collect()}
    assert sorted(found) == ids
    degree = dict.fromkeys(ids, 0)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    assert {i: found[i].n_links for i in ids} == degree and sum(degree.values()) > 100
    assert {i: found[i].class_id for i in ids} == {i: min(j for j in ids if bags[j] == bags[i]) for i in ids}
    least_of = plain_components(ids, links)
    assert {i: found[i].component_id for i in ids} == {i: least_of[i] for i in ids}


def test_edges(spark):
    schema = "doc_id long, fingerprint string"
    assert spot_join.join_fingerprints(spark.createDataFrame([], schema)).collect() == []
    one, other = (spotsigs.as_string(spotsigs.spots(t)) for t in ("the old harbour wall is wet", "quite another text of six"))
    rows = [(1, one), (1, other), (2, one), (2, one), (3, None), (4, ""), (None, one), (None, None)]
    found = spot_join.join_fingerprints(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(
        [(1, 1, 2, 0, 1), (1, 1, 0, 0, 1), (2, 1, 2, 0, 1), (2, 1, 2, 0, 1), (3, 3, 1, 0, 3), (4, 3, 1, 0, 3), (None, None, 0, 0, None), (None, None, 0, 0, None)], key=key
    )
    with pytest.raises(ValueError):
        spot_join.join_fingerprints(spark.createDataFrame(rows, schema), 1.0)


def test_bound_is_reached_exactly():
    bag = spotsigs.spots(" ".join(f"w{k}" for k in range(200)))[:10]
    assert spotsigs.likeness(bag[:7], bag, 0.7) == 0.7


def test_long_copies_meet_once(spark):
    """Spots that the same texts share are one cell: long copies do not go to a task for each spot."""
    rng = random.Random(8)
    base = rng.choices(WORDS, k=15_000)
    rows = []
    for k in range(4):
        text = list(base)
        for _ in range(40 * k):
            text[rng.randrange(len(text))] = f"new{rng.random()}"
        rows.append((k, spotsigs.as_string(spotsigs.spots(" ".join(text)))))
    classes = spark.createDataFrame(rows, "rep long, fingerprint string")
    cells = spot_join._cells(classes, 0.8)
    assert cells.count() > 4000
    assert 0 < spot_join._met(cells).select("spot", "cell").distinct().count() <= 2 * 2**4
    found = spot_join.join_fingerprints(classes.withColumnRenamed("rep", "doc_id")).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(3, 0)}


def test_query_equals_all_pairs(spark, tmp_path):
    """The registered join, from texts on, against a comparison of all fingerprints."""
    from tidewatch.llm import queries

    rows = _texts(random.Random(3)) + [(900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.queries()["spotsigs_join"](spark, str(tmp_path)).collect()}
    bags = {i: set(spotsigs.spots(t or "").tolist()) for i, t in rows}
    alike = lambda a, b: a == b or (a and b and len(a & b) / len(a | b) >= 0.8 - 1e-9)
    assert {i: r.n_links for i, r in found.items()} == {i: sum(j != i and bool(alike(bags[i], bags[j])) for j in bags) for i in bags}


def test_bits_bound_the_difference():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.randrange(1, 400)
        bags = [sorted({rng.randrange(1 << 32) for _ in range(size)}) for _ in range(2)]
        bags.append(sorted({*bags[0][: size // 2], *bags[1]}))
        arrays = [spot_join.np.array(b, dtype=spot_join.np.uint32) for b in bags]
        bits = spot_join.np.stack([spot_join.bits_of(a, 20, 0.8) for a in arrays])
        apart = spot_join.unshared(bits)
        assert all(apart[i, j] <= len(set(bags[i]) ^ set(bags[j])) for i in range(3) for j in range(3))
