"""Licence scans with DataFrame functions alone, by a positional index of rare words.

Templates are notices of licences. Of each template's words the ones with the highest inverse document
frequency over all documents are its rare words, and the index keeps where they stand in it. Every
rare word of a file is looked up; the template's postings are intersected by their relative position
(place in the file less place in the template); where enough of a template's rare words agree on one position,
the words around it must hold the template's key phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import text_of

# The words, and the phrases of the base with their labels.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public notices of licences in words, with the phrases that must stand in a file's place for the label to hold.
TEMPLATES = (
    ("agpl-3.0", "gnu affero general public license version 3", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("apache-2.0", "spdx license identifier apache 2 0", ("license identifier apache 2 0",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "conditions are met"),
    ),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd", "spdx license identifier bsd", ("license identifier bsd",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("epl-2.0", "eclipse public license version 2 0", ("eclipse public license",)),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    ("gpl-2.0", "spdx license identifier gpl 2 0", ("license identifier gpl 2 0",)),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3.0", "spdx license identifier gpl 3 0", ("license identifier gpl 3 0",)),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify and", "without fee is hereby granted"),
    ),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    ("mit", "spdx license identifier mit", ("license identifier mit",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Rare words of a template; words around a template's place in which its key phrases may stand.
RARE, AROUND = 4, 8
#: Bits of a place in a template, and of a relative position; templates have fewer words than ``1 << IN_TEMPLATE``.
IN_TEMPLATE, IN_FILE = 12, 34


@dataclass(frozen=True)
class Index:
    """Postings of the rare words and what each template needs."""

    labels: list[str]
    lengths: list[int]
    keys: list[list[str]]
    postings: dict[str, list[tuple[int, int]]]

    @property
    def sizes(self) -> list[int]:
        """Postings of each template."""
        held = [t for places in self.postings.values() for t, _ in places]
        return [held.count(t) for t in range(len(self.labels))]


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame, templates=TEMPLATES, rare: int = RARE) -> Index:
    """Postings of the ``rare`` words of every template that the fewest of all documents hold (ties: the smaller word).

    Document frequencies of the templates' words are counted over all documents; only these counts, one per
    word of the templates, come to the driver.
    """
    split = [t.split(" ") for _, t, _ in templates]
    known = sorted({w for words in split for w in words})
    if max(map(len, split), default=0) >= 1 << IN_TEMPLATE:
        raise ValueError(f"templates must be shorter than {1 << IN_TEMPLATE} words")
    held = F.array_distinct(F.filter(words_of(text_of()), lambda w: w.isin(known)))
    counts = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()} if known else {}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(split):
        for word in sorted(set(words), key=lambda w: (counts.get(w, 0), w))[:rare]:
            postings.setdefault(word, []).extend((t, i) for i, w in enumerate(words) if w == word)
    return Index([x for x, _, _ in templates], [len(w) for w in split], [list(k) for _, _, k in templates], postings)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _aligned(words: Column, marks: Column, index: Index) -> Column:
    """(t, at, n): templates and the relative positions on which at least half of their postings (two, if it has as many) agree, with how many do."""
    known, sizes = sorted(index.postings), index.sizes
    places = F.array(*(F.array(*(F.lit(t << IN_TEMPLATE | i).cast("long") for t, i in index.postings[w])) for w in known))
    needs = F.lit([max(min(2, n), (n + 1) // 2) for n in sizes])
    base, room = 1 << IN_TEMPLATE, IN_TEMPLATE + IN_FILE

    def looked_up(i: Column) -> Column:
        own = F.coalesce(F.get(places, F.array_position(F.lit(known), F.get(words, i)).cast("int") - 1), F.array().cast("array<long>"))
        return F.transform(own, lambda p: F.shiftright(p, IN_TEMPLATE) * (1 << room) + (i - F.pmod(p, F.lit(base)) + base) * base + F.pmod(p, F.lit(base)))

    def runs(found: Column) -> Column:
        group = lambda x: F.shiftright(x, IN_TEMPLATE)
        template = lambda x: F.shiftright(x, room).cast("int")

        def starts(x: Column, j: Column) -> Column:
            before = (j == 0) | (group(F.get(found, j - 1)) != group(x))
            return before & F.coalesce(group(F.get(found, j + F.get(needs, template(x)) - 1)) == group(x), F.lit(False))

        def run(x: Column, j: Column) -> Column:
            n = F.size(F.filter(F.slice(found, j + 1, F.get(F.lit(sizes), template(x))), lambda y: group(y) == group(x)))
            at = (F.pmod(group(x), F.lit(1 << IN_FILE)) - base).cast("int")
            return F.when(starts(x, j), F.struct(template(x).alias("t"), at.alias("at"), n.alias("n")))

        return F.filter(F.transform(found, run), lambda x: x.isNotNull())

    return _let(F.sort_array(F.flatten(F.transform(marks, looked_up))), runs)


def _found(words: Column, index: Index) -> Column:
    """A struct of all the results for a text's words."""
    phrases = [p.split(" ") for p, _ in BASE]
    marked = sorted({*index.postings, *(p[0] for p in phrases)})
    stands = lambda p, i: [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(p)]

    def place(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, (_, label) in zip(phrases, BASE, strict=True):
            all_of = stands(p, i)
            whole = all_of[0]
            for x in all_of[1:]:
                whole = whole & x
            out = F.when(whole, F.lit(label)).otherwise(out)
        return F.when(out.isNotNull(), F.struct(i.alias("at"), out.alias("label")))

    def verified(x: Column) -> Column:
        first = F.greatest(x["at"] - AROUND, F.lit(0))
        end = x["at"] + F.get(F.lit(index.lengths), x["t"]) + AROUND
        near = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, F.greatest(end - first, F.lit(0))), " "), F.lit(" "))
        keys = F.array(*(F.array(*(F.lit(f" {k} ") for k in ks)) for ks in index.keys))
        return _let(near, lambda text: F.forall(F.get(keys, x["t"]), lambda k: F.contains(text, k)))

    def result(base: Column, own: Column) -> Column:
        listed = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
        label = F.transform(base, lambda x: x["label"])
        more = F.transform(own, lambda x: F.get(F.lit(index.labels), x["t"]))
        share = F.array_max(F.transform(own, lambda x: x["n"] / F.get(F.lit(index.sizes), x["t"])))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, lambda x: x["at"])).cast("long").alias("first_word"),
            F.array_max(F.transform(base, lambda x: x["at"])).cast("long").alias("last_word"),
            listed(label).alias("base_labels"),
            listed(F.concat(label, more)).alias("labels"),
            F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
        )

    def judged(marks: Column) -> Column:
        base = F.filter(F.transform(marks, place), lambda x: x.isNotNull())
        own = F.filter(_aligned(words, marks, index), verified) if index.postings else F.array().cast("array<struct<t:int,at:int,n:int>>")
        return _let(base, lambda b: _let(own, lambda o: result(b, o)))

    return _let(F.filter(F.transform(words, lambda w, i: F.when(w.isin(marked), i)), lambda i: i.isNotNull()), judged)


def scan_documents(docs: DataFrame, templates=TEMPLATES, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); see the contract of ``op12_licences``.

    ``score`` is 1 where a base phrase stands, else the largest share of a found template's rare words that agree on its
    place, 0 where none is found. A null text is empty: no words, no labels (empty strings), no places (nulls), score 0. Rows are
    independent: repeated rows and null doc_ids pass through, an empty table gives no rows, other columns are ignored. Nothing is
    shuffled but the counts of the templates' words.
    """
    index = index or build_index(docs, templates)
    return docs.select("doc_id", F.inline(F.transform(F.array(words_of(text_of())), lambda w: _found(w, index))))


def scan_sql(templates=TEMPLATES, rare: int = RARE) -> str:
    """The scan in DuckDB's SQL."""
    quoted = ", ".join(f"({t}, '{label}', '{words}', [{', '.join(repr(f' {k} ') for k in keys)}])" for t, (label, words, keys) in enumerate(templates))
    phrases = ", ".join(f"('{label}', '{p}', {len(p.split(' '))})" for p, label in BASE)
    return rf"""
WITH templates(t, label, body, keys) AS (VALUES {quoted}),
places AS (SELECT t, label, keys, len(string_split(body, ' ')) AS n_body, unnest(string_split(body, ' ')) AS word, generate_subscripts(string_split(body, ' '), 1) - 1 AS place FROM templates),
phrases(label, phrase, n) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '{WORD}') AS w FROM documents),
at_word AS (SELECT row_id, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
df AS (SELECT word, count(DISTINCT row_id) AS n FROM at_word WHERE word IN (SELECT word FROM places) GROUP BY word),
ranked AS (
    SELECT t, word, row_number() OVER (PARTITION BY t ORDER BY coalesce(df.n, 0), word) AS rarity
    FROM (SELECT DISTINCT t, word FROM places) LEFT JOIN df USING (word)
),
postings AS (SELECT places.*, count(*) OVER (PARTITION BY t) AS held FROM places JOIN ranked USING (t, word) WHERE rarity <= {rare}),
aligned AS (
    SELECT row_id, t, i - place AS pos, any_value(w) AS w, any_value(label) AS label, any_value(keys) AS keys, any_value(n_body) AS n_body, any_value(held) AS held, count(*) AS n
    FROM at_word JOIN postings USING (word) GROUP BY row_id, t, i - place
),
near AS (SELECT *, ' ' || array_to_string(w[greatest(pos - {AROUND}, 0) + 1:pos + n_body + {AROUND}], ' ') || ' ' AS around FROM aligned WHERE n >= greatest(least(2, held), (held + 1) // 2)),
own AS (SELECT row_id, label, n / held AS share FROM near WHERE len(list_filter(keys, lambda k: NOT contains(around, k))) = 0),
base AS (SELECT row_id, label, i FROM at_word JOIN phrases ON word = string_split(phrase, ' ')[1] WHERE array_to_string(w[i + 1:i + n], ' ') = phrase),
counted AS (SELECT row_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY row_id),
named AS (SELECT row_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row_id, label FROM base UNION ALL SELECT row_id, label FROM own) GROUP BY row_id),
shares AS (SELECT row_id, max(share) AS share FROM own GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM docs LEFT JOIN counted USING (row_id) LEFT JOIN named USING (row_id) LEFT JOIN shares USING (row_id)
"""
