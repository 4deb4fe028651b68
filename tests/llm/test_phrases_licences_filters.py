"""Phrase mining, licence scans and the filter audit against their SQL, on small tables with every edge case."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import collocations, filter_audit, licence_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _n long, w string, row long, part string"
LABELS = "doc_id long, quality int, toxic int, text string"


def made(seed: int = 7) -> tuple[list, list]:
    """Texts with copies, notices, nulls, empty and long ones, repeated rows and null ids."""
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "été", "straße", "x1", "the", "of", "İz", "naïve", "K", " ", "\x85q"]
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "all rights reserved", "GNU General  Public\nLicense, version 3", "Apache License 2 version 0", "cc by by cc", "CC\tBY"]
    texts = [None, "", " ", "\n\t ", "a", "the of " * 400, "the of the, of the of. " * 900, "alpha Beta gamma. " * 60 + "z" * 40000, "X" * 70, "$"]
    for _ in range(90):
        body = [rnd.choice(words) for _ in range(rnd.choice([3, 30, 260]))]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            body.insert(rnd.randrange(len(body)), rnd.choice(lines))
        texts.append("".join(w + rnd.choice([" ", " ", " ", ", ", "\t", "  ", "\x0b", "."]) for w in body))
    texts += rnd.choices(texts, k=40)
    rows = [(i if i % 17 else None, t, rnd.choice(["en", "de", None, ""]), "s", 0, 5, "w", 1, "p") for i, t in enumerate(texts)]
    rows += rows[5:9] + [(3, "other text of a repeated id", "en", "s", 0, 5, "w", 1, "p")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None]), "t") for i in range(0, 120, 2)] + [(4, 1, 0, "t"), (4, 1, 1, "t"), (None, 1, 1, "t")]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = made()
    return spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)


def sql(query: str, docs, labels=None) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toArrow())
    if labels is not None:
        con.register("labels", labels.toArrow())
    return con.execute(query).df()


def rows_of(df: pd.DataFrame) -> list[str]:
    return sorted("|".join("null" if pd.isna(v) else f"{v:.9f}" if isinstance(v, float) and v % 1 else str(int(v)) if isinstance(v, (float, int)) else str(v) for v in r) for r in df.sort_index(axis=1).itertuples(index=False))


@pytest.mark.parametrize(("held", "split"), [(300_000, 200_000), (300_000, 20), (0, 20)])
def test_phrases(tables, monkeypatch, held, split):
    """Held and joined dictionaries, whole and split pivots, give the counts of all phrases."""
    monkeypatch.setattr(collocations, "SPLIT", split)
    monkeypatch.setattr(collocations, "ROW", 3)
    monkeypatch.setattr(collocations, "GATHERED", 500)
    monkeypatch.setattr(collocations, "COMBINE", 10)
    monkeypatch.setattr(collocations, "COUNTED", 10)
    ours = collocations.mine_phrases(tables[0], least=4, top=300, held=held).toPandas()
    theirs = sql(collocations.mine_sql(4, 300), tables[0])
    assert len(ours) > 300 and set(ours.lang) >= {"en", "und", ""}
    assert rows_of(ours) == rows_of(theirs)


def test_fragments_hold_each_phrase_once():
    """Phrases counted from the fragments of random words equal a plain count, split or not."""
    rng = np.random.default_rng(3)
    x = rng.choice(9, 3000, p=[0.1, 0.3, 0.2, 0.1, 0.1, 0.08, 0.06, 0.04, 0.02]).astype("<u2")
    plain: dict = {}
    for i in range(len(x)):
        for k in range(2, 6):
            g = tuple(int(v) for v in x[i : i + k])
            if len(g) == k and all(g):
                plain[g] = plain.get(g, 0) + 1
    for many in (1, 3):
        keys, rows, counts = collocations.fragments(x, np.full(9, many))
        found: dict = {}
        for key in np.unique(keys).tolist():
            pivot, part = collocations.split_key(key)
            for phrases, n in collocations.mine(pivot, part, rows[keys == key], counts[keys == key], 5):
                for p, c in zip(phrases.tolist(), n, strict=True):
                    assert tuple(p) not in found and max(p) == pivot
                    found[tuple(p)] = int(c)
        assert found == {g: n for g, n in plain.items() if n >= 5}


def test_scores_beyond_64_bits(spark):
    """1000*a*n passes 64 bits without being rounded."""
    a, n, l, r = 3_000_000_000, 5_000_000_000_000, 3_000_000_007, 4_000_000_009
    wide = lambda c: f"cast({c} as decimal(19,0))"
    got = spark.range(1).selectExpr(f"cast(({wide(f'{a}L')} * {wide(f'{n}L')} * cast(1000 as decimal(4,0))) div ({wide(f'{l}L')} * {wide(f'{r}L')}) as long) as s").first().s
    assert got == 1000 * a * n // (l * r)


def test_licences(tables):
    ours = licence_scan.scan_documents(tables[0]).toPandas()
    assert rows_of(ours) == rows_of(sql(licence_scan.scan_sql(), tables[0]))
    assert {"mit", "cc-by,cc-by-nc", "reserved"} <= set(ours.labels) and len(ours) == tables[0].count()


def test_licence_texts(spark):
    """Whole notices, notices with a word more or less, and prose that only shares their words."""
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    cases = {
        mit: "mit",
        "A preface. " * 50 + mit + " and more." * 50: "mit",
        mit.replace("associated ", "the "): "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "Licensed under the Apache Software License, Version 2.0": "",
        "GNU Lesser General Public License": "gpl,lgpl",
        "You need a license to drive an apache under the version of the law": "",
        "Permission to enter was hereby granted without restriction, and copies of the software files are free": "",
        "copyright notice: source and binary": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licence_scan.scan_documents(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def colliding(text):
    """Hashes that tell nothing apart, so that texts alone must."""
    return [F.lit(1).cast("long") for _ in filter_audit.BLOCKS]


@pytest.mark.parametrize("hashes", [filter_audit.block_hashes, colliding])
def test_audit(tables, monkeypatch, hashes):
    docs, labels = tables
    monkeypatch.setattr(filter_audit, "HUBS", 9)
    ours = filter_audit.audit_filters(docs, labels, hashes).toPandas()
    assert rows_of(ours) == rows_of(sql(filter_audit.AUDIT_SQL, docs, labels))
    assert len(ours) == 600 * 3
    whole = ours.groupby(["part", "filter_order"]).removed.sum() + ours[ours.step == 5].set_index(["part", "filter_order"]).kept
    assert (whole.groupby("part").nunique() == 1).all() and whole.groupby("part").first().sum() == docs.count()


def test_empty_tables(spark, tables):
    docs, labels = tables[0].limit(0), tables[1].limit(0)
    assert collocations.mine_phrases(docs).count() == 0
    assert licence_scan.scan_documents(docs).count() == 0
    assert filter_audit.audit_filters(docs, labels).count() == 0
    assert filter_audit.audit_filters(tables[0], labels).where("good_lost + toxic_lost > 0").count() == 0
