"""How document filters interact: what each one removes, in every order of application.

Five filters judge whole texts. Whether a text repeats one of a smaller id is found by partition
refinement: rows are split by length, then by the hash of one block after the other, and rows
that are alone in their class drop out after every split. The texts of the rows that survive are compared
in full. Every row then has a mask of the filters it fails, and all orders are counted from the masks' counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import join_hubs, stage, text_of

# The filters' names in their order, the words, and the bounds of the failure conditions.
FILTERS = "ABCDE"
WORD, CAPITAL_RUN, SIGNS = r"[^\x20\x09-\x0D]+", "[^A-Z]+", r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 3

#: Where blocks of a text begin (code points); each is hashed by itself, the last one to the text's end.
BLOCKS = (0, 64, 1024, 16384)
#: A class with more than one in so many of all rows is a hub; there are fewer hubs than that.
HUBS = 5000


def fails(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""

    def judged(words: Column) -> Column:
        few = F.size(words) < LEAST_WORDS
        repeated = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words)
        return few.cast("int") + 2 * repeated.cast("int")

    counted = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), judged), 0)
    capitals = 100 * F.length(F.regexp_replace(text, CAPITAL_RUN, "")).cast("long") > MOST_CAPITAL_PERCENT * F.length(text).cast("long")
    return counted + 4 * capitals.cast("int") + 8 * text.rlike(SIGNS).cast("int")


def block_hashes(text: Column) -> list[Column]:
    ends = (*BLOCKS[1:], (1 << 31) - 1)
    return [F.xxhash64(F.substring(text, a + 1, b - a)) for a, b in zip(BLOCKS, ends, strict=True)]


def _classes(hashed: list[Column]) -> list[Column]:
    """The class of a row after each split: its length, and then the hash of the class before with the next block's."""
    now = F.length(text_of()).cast("long")
    out = [now]
    for h in hashed:
        now = F.xxhash64(now, h)
        out.append(now)
    return out


def repeats(docs: DataFrame, rows: DataFrame, hashes=block_hashes) -> DataFrame:
    """(doc_id, _class) of the rows whose text is that of a smaller doc_id; ``rows`` holds doc_id and ``_c0``, ``_c1``, ...

    Null doc_ids are neither smaller nor larger than any. Rows that repeat a doc_id and its text repeat no smaller one.
    """
    last = len(BLOCKS)
    live = rows.where("doc_id is not null").select("doc_id", *(f"_c{r}" for r in range(last + 1)))
    hub = live.count() // HUBS
    for r in range(last + 1):
        key = f"_c{r}"
        shared = stage(live.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "classes")
        live = stage(join_hubs(live, shared, key, hub).select("doc_id", *(f"_c{i}" for i in range(r + 1 if r < last else last, last + 1))), "live")
    live = live.select("doc_id", F.col(f"_c{last}").alias("_class")).distinct()

    text = text_of()
    whole = docs.select("doc_id", text.alias("text"), _classes(hashes(text))[-1].alias("_class"))
    texts = whole.join(live, ["doc_id", "_class"], "left_semi")
    # Copies are combined before the shuffle; a class holds more than one text only where hashes collide.
    distinct = texts.groupBy("_class", "text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    kinds = stage(distinct.groupBy("_class").agg(F.count(F.lit(1)).alias("_kinds"), F.min("_least").alias("_least"), F.sum("_n").alias("_n")), "kinds")
    pure = join_hubs(live, kinds.where("_kinds = 1").drop("_kinds"), "_class", hub)
    mixed = kinds.where("_kinds > 1").select("_class")
    if not mixed.isEmpty():
        within = distinct.join(mixed, "_class", "left_semi").select("_class", "text", "_least")
        pure = pure.unionByName(texts.join(mixed, "_class", "left_semi").join(within, ["_class", "text"]).select(pure.columns))
    return pure.where("doc_id > _least").select("doc_id", "_class").distinct()


def failing(docs: DataFrame, hashes=block_hashes) -> DataFrame:
    """(doc_id, lang, fails): a row per row of ``docs``, with the bits of all five filters."""
    text, last = text_of(), len(BLOCKS)
    classes = [c.alias(f"_c{r}") for r, c in enumerate(_classes(hashes(text)))]
    rows = stage(docs.select("doc_id", "lang", fails(text).alias("fails"), *classes), "filtered")
    again = repeats(docs.select("doc_id", "text"), rows, hashes).withColumn("_again", F.lit(16))
    whole = rows.withColumnRenamed(f"_c{last}", "_class").join(again, ["doc_id", "_class"], "left")
    return whole.select("doc_id", "lang", (F.col("fails") + F.coalesce(F.col("_again"), F.lit(0))).alias("fails"))


def audit_filters(docs: DataFrame, labels: DataFrame, hashes=block_hashes) -> DataFrame:
    """Counts of every filter in every order, a row per part, order and step; see the contract of ``op13_filter_audit``.

    A null text is empty, a null lang belongs to the part of the empty string, rows with a null doc_id have no labels and repeat
    nothing. Repeated rows count as often as they stand. A document counts as good or toxic when any of its label rows says so.
    Other columns are ignored; an empty table gives no rows.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")
    )
    judged = failing(docs, hashes).join(known, "doc_id", "left").select(F.coalesce("lang", F.lit("")).alias("part"), "fails", "good", "bad")
    masks = judged.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))

    orders = " ".join(map("".join, permutations(FILTERS)))
    listed = masks.withColumn("filter_order", F.explode(F.split(F.lit(orders), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    bits = lambda letters: sum((F.when(letters.contains(x), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    own = bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    listed = listed.withColumns({"_before": bits(before), "_own": own})
    mask = F.col("fails")
    hit, earlier = mask.bitwiseAND(F.col("_own")) != 0, mask.bitwiseAND(F.col("_before")) != 0
    count = lambda rule, what, name: F.sum(F.when(rule, F.col(what)).otherwise(0)).cast("long").alias(name)
    # Among the filters that a document fails, each comes first in an equal share of the 120 orders.
    share = F.when(hit, F.col("n") * F.expr("120 div greatest(bit_count(fails), 1)")).otherwise(0)
    return listed.groupBy("part", "filter_order", "step").agg(
        count(~hit & ~earlier, "n", "kept"),
        count(hit & ~earlier, "n", "removed"),
        count(hit & earlier, "n", "redundant"),
        count(mask == F.col("_own"), "n", "unique_fails"),
        count(hit & ~earlier, "good", "good_lost"),
        count(hit & ~earlier, "bad", "toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


AUDIT_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS failed
    FROM words LEFT JOIN known ON words.doc_id = known.doc_id
),
masks AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS own, substr(filter_order, 1, step::INTEGER - 1) AS before FROM orders, range(1, 6) AS s(step)),
seen AS (
    SELECT part, filter_order, step, own, n, good, bad, contains(failed, own) AS hit, failed = own AS only_own,
        before <> '' AND regexp_matches(failed, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS earlier
    FROM masks, steps
),
counted AS (
    SELECT part, filter_order, step, any_value(own) AS own,
        sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN hit AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN only_own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN hit AND NOT earlier THEN bad ELSE 0 END)::BIGINT AS toxic_lost
    FROM seen GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""
