"""Secret scans with DataFrame functions alone.

Fixed patterns find assignments, access keys and hexadecimal strings. Two Markov models of
characters, one of random strings and one of ordinary identifiers, add further spans: long
tokens whose log-likelihood ratio under the two favours randomness. Both are trained
from labelled samples: strings made from digests are random ones, and words of sampled
documents, alone and joined as in code, are identifiers. No text leaves the scan: positions
come from running totals of the lengths of matches and of the gaps between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the base kinds, the least lengths, and the kinds in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_FROM = r"AKIA[A-Z0-9]{14,}", 18
HEX, HEX_FROM = r"[0-9a-f]{16,}", 16
ASSIGN_FROM = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models judge: whole runs of these characters that hold no start of a base match.
_RUN = "[A-Za-z0-9+/_-]"
_BASE = rf"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}})"""
TOKEN = rf"(?<!{_RUN})((?:(?!{_BASE}){_RUN}){{20,}}+(?!{_RUN})={{0,2}})"
#: One scan that takes base matches first, so that no token lies in one; group 3 is the token.
EITHER = rf"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}"
#: The mean log-likelihood ratio of a bigram from which a token is a secret; spans of a block when a text is cut.
RATIO, BLOCK = 0.9, 128
#: Documents whose words are the sample of identifiers at most; random strings of the other sample.
SAMPLE_DOCUMENTS, SAMPLE_STRINGS = 500, 4000

# Words that names in code are made of.
NAMES = (
    "access account active address admin agent alias amount archive array asset async audit author backup batch binary block bool branch bucket buffer build button cache call "
    "cell change channel check child class clean client clone close cluster code column command comment commit config connection const container content context control cookie copy core "
    "count create current custom data database date debug default delete deploy detail device dialog dir disk display document domain double download driver edge edit element email "
    "enable encode end entity entry env error event example exec export factory feature field file filter final flag float folder font form format frame from function gateway get global "
    "graph grid group handler hash header health height hidden home host html http icon image import index info init inner input insert instance int integer interface item job join json key "
    "label lang last layer layout left level library license limit line linux list load local lock log login loop main manager map mask master match matrix max memory menu merge message meta "
    "method min mode model module mount name network new next node notice null number object offset old open option order output override owner package page param parent parse patch path pattern "
    "payload pending pipeline pixel platform player plugin pointer policy pool port position post prefix preview private process product profile project property protocol provider proxy public pull push query "
    "queue quick random range rate read record redirect reference refresh region register release remote remove rename render replica report request reset resource response result retry return right "
    "role root route row rule runtime sample save scale schema scope script search section select sender sequence serial server service session set setting shard shared shell show signal single size "
    "socket sort source split stack stage standard start state static status step storage store stream string struct style submit success summary suffix support switch sync system table tag target task "
    "template temp test text theme thread time timeout title toggle tool total trace track transaction transform tree trigger type unit update upload url user utils valid value variable vector version view "
    "visible volume wait warning watch web width window worker wrapper write zone amd arm brown copyright fox jumps over"
)

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
MASK = "[SECRET]"

_SPANS = "array<struct<start:int,end:int>>"


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, step) -> Column:
    """Running totals of an array under ``step``, by doubling: every round adds the totals half a stretch before."""

    def totals(v: Column) -> Column:
        def double(acc, k):
            moved = F.concat(F.array_repeat(F.lit(None).cast("int"), k), F.slice(acc, F.lit(1), F.size(acc) - k))
            return F.zip_with(acc, moved, lambda x, y: F.when(y.isNull(), x).otherwise(step(x, y)))

        ahead = F.filter(F.array(*(F.lit(1 << i) for i in range(30))), lambda k: k < F.size(v))
        return F.aggregate(ahead, v, double)

    return _let(values, totals)


def _located(text: Column, pattern: str) -> Column:
    """Spans (code points, end exclusive) of a pattern's leftmost matches, none of which is empty.

    Their ends are running totals of the lengths of gaps and matches, so the work grows with the
    text and, but for a logarithm, with the number of matches.
    """
    found, gaps = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length), F.transform(F.split(text, pattern, -1), F.length)
    both = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct((g + m).alias("n"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def spans(x: Column) -> Column:
        ends = _running(F.transform(x, lambda y: y["n"]), lambda a, b: a + b)
        return F.zip_with(ends, x, lambda e, y: F.struct((e - y["m"]).alias("start"), e.alias("end")))

    return _let(both, spans)


def _codes(token: Column) -> Column:
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _identifiers(words: Column) -> Column:
    """Names as code has them, from runs of a document's words: snake, camel, constant, kebab and path cases, some with numbers."""
    part = lambda i: F.slice(words, i, F.lit(4))
    number = lambda i: F.pmod(F.xxhash64(F.concat_ws(" ", part(i))), F.lit(1000)).cast("string")

    def named(i: Column) -> Column:
        low, way = F.transform(part(i), F.lower), F.pmod(F.floor(i / 4), F.lit(8))
        camel = F.transform(low, lambda w, k: F.when(k > 0, F.initcap(w)).otherwise(w))
        return (
            F.when(way == 0, F.array_join(low, "_"))
            .when(way == 1, F.array_join(camel, ""))
            .when(way == 2, F.upper(F.array_join(low, "_")))
            .when(way == 3, F.array_join(low, "-"))
            .when(way == 4, F.upper(F.array_join(low, "-")))
            .when(way == 5, F.concat(F.array_join(low, "-"), F.lit("-v"), F.regexp_replace(number(i), "(.)", "$1-"), F.lit("rc"), F.pmod(i, F.lit(10)), F.lit("-x64")))
            .when(way == 6, F.concat(F.array_join(low, "_"), F.lit("_20"), F.substring(number(i), 1, 2), F.lit("-0"), F.pmod(i, F.lit(9)), F.lit("-1"), F.pmod(i, F.lit(10)), F.lit("_"), number(i)))
            .otherwise(F.array_join(low, "/"))
        )

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - 3, F.lit(1))), lambda i: i % 4 == 1)
    return F.transform(starts, named)


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of character bigrams (random over identifier), by code of the first and the second.

    The identifiers' sample is names made of the words of ``SAMPLE_DOCUMENTS`` documents at most, those whose doc_ids have
    the least hashes, and of the fixed words of ``NAMES``, besides long numbers and lines of one character; the random sample is the same for every table. An empty
    table trains on the fixed words alone.
    """
    spark = docs.sparkSession
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    words = docs.join(F.broadcast(ids), "doc_id").select(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    mixed = lambda x: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.element_at(x, (F.pmod(F.xxhash64(F.col("id"), i), F.size(x)) + 1).cast("int")))
    known = spark.range(200).select(_let(F.split(F.lit(NAMES), " "), mixed).alias("w"))
    ordinary = words.where(F.size("w") > 3).unionByName(known).select(F.explode(_let(F.col("w"), _identifiers)).alias("s"))
    number = F.abs(F.xxhash64("id")).cast("string")
    line = F.array(*(F.repeat(F.substring(F.lit(ALPHABET), F.pmod(F.col("id") * k, F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)), F.lit(25)) for k in (1, 3)))
    rule = F.concat(F.lit("+"), F.repeat(F.lit("-"), F.pmod("id", F.lit(30)).cast("int") + 3), F.lit("+-"), F.repeat(F.lit("-"), F.lit(9)), F.lit("+"))
    plain = spark.range(1000).select(F.explode(F.concat(line, F.array(rule, F.concat(number, number), F.concat(F.lit("12345678901234567890"), F.substring(number, 1, 4))))).alias("s"))
    ordinary = ordinary.unionByName(plain).withColumn("random", F.lit(0))
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    strings = spark.range(SAMPLE_STRINGS).select(
        F.explode(
            F.array(
                F.base64(digest("a")), F.translate(F.base64(digest("b")), "+/=", "-_"), F.lower(F.hex(digest("c"))),
                F.translate(F.upper(F.base64(digest("d"))), "+/=", ""),
            )
        ).alias("s")
    )
    labelled = ordinary.unionByName(strings.withColumn("random", F.lit(1)))
    codes = labelled.select("random", _codes(F.col("s")).alias("c"))
    pairs = F.zip_with(F.col("c"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * len(ALPHABET) + b)
    rows = codes.where(F.size("c") > 1).select("random", F.explode(pairs).alias("p")).where("p is not null").groupBy("random", "p").agg(F.count(F.lit(1)).alias("n"))
    k = len(ALPHABET)
    counts = [[1.0] * (k * k), [1.0] * (k * k)]
    for r in rows.collect():  # two rows per pair of the alphabet at most
        counts[r.random][r.p] += r.n
    logs = []
    for c in counts:
        totals = [sum(c[a * k : a * k + k]) for a in range(k)]
        logs.append([math.log(c[a * k + b] / totals[a]) for a in range(k) for b in range(k)])
    return [r - o for o, r in zip(*logs, strict=True)]


def ratio(token: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's bigrams."""
    values, codes = F.lit(table), _codes(token)
    pairs = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.when(b.isNotNull(), F.get(values, a * len(ALPHABET) + b)))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def with_spans(docs: DataFrame, table: list[float]) -> DataFrame:
    """``docs`` with arrays of spans: ``_assign``, ``_access``, ``_hex`` and ``_markov``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    value = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    long = lambda spans, lengths: F.transform(F.filter(F.arrays_zip(spans.alias("s"), lengths.alias("n")), lambda x: x["n"]), lambda x: x["s"])
    token = F.regexp_extract_all(t, F.lit(EITHER), F.lit(3))
    random = F.transform(token, lambda x: (x != "") & (ratio(x, table) >= RATIO))
    return docs.withColumns(
        {
            "_assign": F.when((t.contains("=") | t.contains(":")) & t.rlike(ASSIGN), long(_located(t, ASSIGN), F.transform(value, lambda v: F.length(v) >= ASSIGN_FROM))).otherwise(_none()),
            "_access": F.when(t.contains("AKIA") & t.rlike(ACCESS), _located(t, ACCESS)).otherwise(_none()),
            "_hex": F.when(t.rlike(HEX), _located(t, HEX)).otherwise(_none()),
            "_markov": F.when(t.rlike(TOKEN), long(_located(t, EITHER), random)).otherwise(_none()),
        }
    )


def _ordered(kinds: tuple[str, ...]) -> Column:
    """All spans of the given kinds by start and then kind, with the kind's place in ``KINDS``."""

    def of(kind: str) -> Column:
        place = F.lit(KINDS.index(kind))
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), place.alias("kind"), s["end"].alias("end")))

    return F.array_sort(F.concat(*map(of, kinds)))


def _listed(kinds: tuple[str, ...]) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(_ordered(kinds), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans); see the contract of ``op10_secrets``.

    A null text is empty; a text without secrets has zero counts and the digest of the empty string. Rows are
    independent: repeated rows and null doc_ids pass through, an empty table gives no rows, other columns are
    ignored. Nothing but training is shuffled.
    """
    table = table or train(docs)
    found = with_spans(docs.select("doc_id", "text"), table)
    count = lambda k: F.size(f"_{k}").cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_listed(KINDS[:3]).cast("binary"), 256).alias("base_sha256"), _listed(KINDS).alias("spans")
    )


def _apart(spans: Column) -> Column:
    """Spans sorted by start, merged where they overlap."""
    of = lambda x, k: F.transform(x, lambda s: s[k])
    seen = _let(spans, lambda x: F.zip_with(of(x, "start"), _running(of(x, "end"), F.greatest), lambda s, e: F.struct(s.alias("start"), e.alias("end"))))

    def merged(x: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), of(x, "end"))  # the furthest end before each span
        after = F.concat(F.transform(F.slice(x, F.lit(2), F.size(x)), lambda s: s["start"]), F.array(F.lit(None).cast("int")))
        starts = F.filter(F.zip_with(F.slice(before, F.lit(1), F.size(x)), of(x, "start"), lambda e, s: F.when(s >= e, s)), lambda s: s.isNotNull())
        ends = F.filter(F.zip_with(after, of(x, "end"), lambda s, e: F.when(s.isNull() | (s >= e), e)), lambda e: e.isNotNull())
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    return _let(seen, merged)


def _without(text: Column, spans: Column) -> Column:
    """``text`` with ``MASK`` for each of some disjoint ascending spans, cut by blocks of spans and within them."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))

    def block(b: Column) -> Column:
        start = F.when(b == 0, 0).otherwise(F.get(spans, b * BLOCK - 1)["end"])

        def cut(own: Column) -> Column:
            before = F.concat(F.array(start), F.transform(own, lambda s: s["end"]))
            places = F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda s, e: F.struct((e - start).alias("at"), (s["start"] - e).alias("n")))
            part = F.substring(text, start + 1, F.element_at(own, -1)["end"] - start)
            return F.array_join(_let(part, lambda p: F.transform(places, lambda x: F.concat(F.substring(p, x["at"] + 1, x["n"]), F.lit(MASK)))), "")

        return _let(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)), cut)

    return F.concat(F.array_join(F.transform(blocks, block), ""), F.substring(text, F.element_at(spans, -1)["end"] + 1, F.length(text)))


def mask_documents(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """``docs`` with every span found replaced by ``MASK`` and ``n_chars`` counted anew where it changed.

    Spans that overlap are masked as one. Rows without secrets stay as they are; a null text stays null; other columns are
    kept, whatever their names; repeated rows stay repeated and an empty table gives no rows.
    """
    table = table or train(docs)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    found = with_spans(whole, table).withColumn("_all", _ordered(KINDS))
    hit = F.size("_all") > 0
    out = found.withColumn("_new", F.when(hit, _let(_apart(F.col("_all")), lambda s: _without(F.col("text"), s))).otherwise(F.col("text")))
    new = {"text": F.col("_new"), "n_chars": F.when(hit, F.length("_new").cast("long")).otherwise(F.col("_row")["n_chars"])}
    return out.select(*((new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


def ratios(spark: SparkSession, tokens: list[str], table: list[float]) -> list[float]:
    """The models' judgement of single tokens, for inspection."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").select("i", ratio(F.col("t"), table).alias("r"))
    return [r.r for r in rows.orderBy("i").collect()]
