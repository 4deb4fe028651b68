"""Addresses in report texts as rows, by a table function that is joined laterally with the reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

ROW = "street string, building string, district string, city string, precision string, query string, raw string, start int, end int"

# Characters behind a street in which its building stands, and around a city in which a word of a street speaks against it.
TAIL, BEFORE, BEHIND = 25, 15, 20


@dataclass(frozen=True)
class Rules:
    """Words before a street's name and after it by the kind of street, cities (term, name) and districts (stem, name, city) in the order they are looked for,
    and words that end a name."""

    before: dict[str, tuple[str, ...]]
    after: dict[str, tuple[str, ...]] = field(default_factory=dict)
    cities: tuple[tuple[str, str], ...] = ()
    districts: tuple[tuple[str, str, str], ...] = ()
    ends: tuple[str, ...] = ("near", "at", "in", "by", "building", "house")
    city: str | None = None


def table_function(rules: Rules):
    """The table function of ``rules``: a row for each address in a text, streets with a word before them first, each kind in the order of the text.

    A name has up to four words and ends before a comma, a number, the text's end or a word of ``ends``; before a street's word only capitalised words are its name. The
    building is the first number in the characters behind. City and district are those of the whole text: the first city of the list that is not part of a street's name, then
    the first district that lies in it, or whose city becomes the text's. A null text has no rows.
    """

    class Addresses:
        def __init__(self):
            import regex

            words = lambda table: {k: "|".join(regex.escape(w) for w in sorted(v, key=len, reverse=True)) for k, v in table.items()}
            stop = "|".join(map(regex.escape, rules.ends)) or "(?!)"
            part = r"[\p{L}\p{N}'’-]+"
            end = rf"(?=\s*(?:[,.;:!?()\n]|$)|\s+\d|\s+(?:{stop})(?!\p{{L}}))"
            name = rf"((?!\d){part}(?:[ ]{part}){{0,3}}?)"
            self.before = [(k, regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{w})\s+{name}{end}", regex.I)) for k, w in words(rules.before).items()]
            self.after = [(k, regex.compile(rf"(?<![\p{{L}}\p{{N}}])((?:\p{{Lu}}[\p{{L}}'’-]*[ ]){{1,3}})(?i:{w})(?!\p{{L}})")) for k, w in words(rules.after).items()]
            self.building = regex.compile(r"(?<![\p{L}\p{N}])([1-9]\d{0,3}(?:[ ]?\p{L}(?!\p{L})|[/-]\d{1,3}\p{L}?)?)(?![\p{L}\p{N}])")
            of = lambda table: regex.compile(rf"(?<!\p{{L}})(?:{'|'.join(words(table).values()) or '(?!)'})(?!\p{{L}})", regex.I)
            self.ahead, self.behind = of(rules.before), of(rules.after)
            self.cities = [(regex.compile(rf"(?<!\p{{L}}){regex.escape(term)}(?!\p{{L}})", regex.I), city) for term, city in rules.cities]

        def place(self, text: str):
            city = district = None
            for pattern, name in self.cities:
                for m in pattern.finditer(text):
                    if not self.ahead.search(text[max(0, m.start() - BEFORE) : m.start()]) and not self.behind.search(text[m.end() : m.end() + BEHIND]):
                        city = name
                        break
                if city:
                    break
            low = text.lower()
            for stem, name, of in rules.districts:
                if stem in low and city in (None, of):
                    city, district = of, name
                    break
            return city or rules.city, district

        def eval(self, text: str):
            if not text:
                return
            city, district = self.place(text)
            for patterns, ahead in ((self.before, True), (self.after, False)):
                for kind, pattern in patterns:
                    for m in pattern.finditer(text):
                        name = " ".join(m[1].split())
                        found = self.building.search(text[m.end() : m.end() + TAIL])
                        building = found[1].replace(" ", "") if found else None
                        street = f"{kind} {name.title()}" if ahead else f"{name.title()} {kind}"
                        query = ", ".join(x for x in (street, building, city) if x)
                        yield street, building, district, city, "address" if building else "street", query, m[0].strip(), m.start(), m.end()

    # Arrow would build a frame for the rows of each text.
    return udtf(Addresses, returnType=ROW, useArrow=False)


def address_rows(reports: DataFrame, rules: Rules) -> DataFrame:
    """``reports`` (text and more) with the columns of ``ROW``, a row per address; reports without one have none. Offsets count code points."""
    return reports.lateralJoin(table_function(rules)(F.col("text").outer()))
