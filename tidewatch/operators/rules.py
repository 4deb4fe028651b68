"""Reports classified by rule tables: one automaton of all terms passes over each text once, and ordered rules read what it found."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marks a term that stands behind a guard word (its number is negative, less one).
GUARDED = -1


@dataclass(frozen=True)
class Tables:
    """Rules in the order they are tried; terms are parts of words in lower case.

    ``types`` are (type, terms, causes): a rule with causes that finds none of them gives no type, and ends the search. ``places`` are (place, region, terms).
    ``outside`` are (region, terms) of other regions, which hold unless a term of ``explicit`` is there. ``noise`` rejects a text. A place's
    term does not count where any of it follows a word of ``guards`` and white space, as in the name of a street.
    """

    types: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]
    places: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    outside: tuple[tuple[str, tuple[str, ...]], ...] = ()
    explicit: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    guards: tuple[str, ...] = ()

    def terms(self) -> list[str]:
        """The distinct terms of all tables; a term's number is its place."""
        every = [*self.noise, *self.explicit]
        for _, found, causes in self.types:
            every += [*found, *causes]
        for table in (*((t for _, _, t in self.places)), *((t for _, t in self.outside))):
            every += table
        if not all(every):
            raise ValueError("a term is empty")
        return list(dict.fromkeys(t.lower() for t in every))


def found_terms(terms: list[str], guards: tuple[str, ...] = ()):
    """A column function: the ascending numbers of the terms that a lower-case text holds, and ``GUARDED - number`` for those that follow a guard.

    Every occurrence counts, those inside others too. The work is linear in the text and its hits, whatever the number of terms. A null text holds none.
    """
    ends = tuple(g.lower() for g in guards)

    @F.pandas_udf("array<int>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            automaton.add_word(term, number)
        automaton.make_automaton()
        longest = max(map(len, ends), default=0)

        def guarded(text: str, start: int) -> bool:
            at = start
            while at and text[at - 1].isspace():
                at -= 1
            return at < start and text.endswith(ends, max(0, at - longest), at)

        def one(text) -> list[int]:
            out = set()
            if text and terms:
                for end, number in automaton.iter(text):
                    out.add(number)
                    if ends and GUARDED - number not in out and guarded(text, end + 1 - len(terms[number])):
                        out.add(GUARDED - number)
            return sorted(out)

        for batch in batches:
            yield batch.map(one, na_action=None)

    return look


def classified(reports: DataFrame, tables: Tables, home: str = "home", text: str = "text") -> DataFrame:
    """``reports`` with type, region, place and accepted.

    The first type whose terms are found decides; it is null if that type needs a cause that is missing, if none is found, or if the text is noise. The first place counts whose term
    is found without a guard. The region is the first outside one, unless a term of ``explicit`` is found; else the place's; else ``home`` for explicit terms; null otherwise.
    A report is accepted if it has a type and no outside region holds. A null or empty text has nulls and is not accepted.
    """
    number = {t: i for i, t in enumerate(tables.terms())}
    hits = F.col("_hits")
    any_of = lambda terms: F.arrays_overlap(hits, F.array(*(F.lit(number[t.lower()]) for t in terms))) if terms else F.lit(False)

    def first(rules, kind: str = "string") -> Column:
        out = None
        for test, value in rules:
            out = F.when(test, value) if out is None else out.when(test, value)
        return F.lit(None).cast(kind) if out is None else out

    def unguarded(terms) -> Column:
        out = F.lit(False)
        for i in (number[t.lower()] for t in terms):
            out = out | (F.array_contains(hits, i) & ~F.array_contains(hits, GUARDED - i))
        return out

    kind = first([(any_of(terms), F.when(any_of(causes), name) if causes else F.lit(name)) for name, terms, causes in tables.types])
    place = first([(unguarded(terms), F.struct(F.lit(name).alias("place"), F.lit(region).alias("region"))) for name, region, terms in tables.places], "struct<place:string,region:string>")
    explicit = any_of(tables.explicit)
    outside = F.when(~explicit, first([(any_of(terms), F.lit(region)) for region, terms in tables.outside]))
    found = reports.withColumn("_hits", found_terms(list(number), tables.guards)(F.lower(F.col(text))))
    found = found.withColumn("_type", F.when(~any_of(tables.noise), kind)).withColumn("_place", place).withColumn("_outside", outside)
    return found.select(
        *(F.col(f"`{c}`") for c in reports.columns if c not in ("type", "region", "place", "accepted")),
        F.col("_type").alias("type"), F.coalesce("_outside", "_place.region", F.when(explicit, home)).alias("region"), F.col("_place.place").alias("place"),
        (F.col("_type").isNotNull() & F.col("_outside").isNull()).alias("accepted"),
    )
