"""Filter interaction audit: how five filters overlap, in every order they may be applied.

A relational word pipeline: texts are exploded into words, counted by (document, word), and those counts by document,
for totals and distincts. The other flags (capitals, symbols) are outer-joined to them, and the labels. One
aggregation by part counts documents under each of the 32 combinations of failed filters, as conditional columns, and
everything about the 120 orders follows from those.

A document is known by id, digest of its text and part. Texts are shuffled once, by document, so neither word count
needs a further shuffle, and groups of copies are spread by their ids. Copies meet only as counts: by digest, part,
flags and labels, with the smallest id and how many rows have it. No row is joined on a digest.

Null texts are empty, null parts the empty string. Rows with a null id are audited as others, but their texts count as
identical to no smaller id's, nor the other way round. Rows that repeat an id and a text are counted each, and neither is
the other's smaller id. A document with several labels is good (toxic) if one of them says so; labels of other ids
count nowhere. An empty table gives an empty table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from cellgrove.llm.common import col

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 2
CAPITALS, SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
_DOC = ["id", "named", "digest", "part"]
_IDENTICAL = 1 << FILTERS.index("E")


def _documents(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    if not isinstance(docs.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{id_col} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(part_col), F.lit("")).alias("part"), text.alias("text"))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("named"), F.unhex(F.sha2("text", 256)).alias("digest"), "part", "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """words and distincts of every document that has words; words are counted in all rows that repeat it."""
    words = docs.repartition(*_DOC).select(*_DOC, F.explode(F.split("text", SPACES)).alias("word")).where("word <> ''")
    return words.groupBy(*_DOC, "word").agg(F.count("*").alias("k")).groupBy(*_DOC).agg(F.sum("k").alias("words"), F.count("*").alias("distincts"))


def _bit(condition: Column, name: str) -> Column:
    return F.when(condition, 1 << FILTERS.index(name)).otherwise(0)


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, good, toxic, mask (the filters A to D that fail, as bits), n documents, and those of them that fail E."""
    base = _documents(docs, id_col, text_col, part_col)
    text = F.col("text")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    plain = base.select(*_DOC, (_bit(100 * capitals > CAPITALS_PERCENT * F.length(text), "C") + _bit(text.rlike(SYMBOLS), "D")).alias("signs"))
    rows = plain.groupBy(*_DOC).agg(F.first("signs").alias("signs"), F.count("*").alias("n")).join(word_counts(base), _DOC, "left")
    words, distincts = F.coalesce(F.expr("words div n"), F.lit(0)), F.coalesce("distincts", F.lit(0))
    mask = F.col("signs") + _bit(words < LEAST_WORDS, "A") + _bit(100 * distincts < DISTINCT_PERCENT * words, "B")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"), F.lit(True).alias("named"))
    known = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.select(*_DOC, mask.alias("mask"), "n").join(known, ["id", "named"], "left")
    classes = rows.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("named"), F.min(F.when(F.col("named"), F.struct("id", "n"))).alias("first")
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    first = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0)
    return classes.select("part", "good", "toxic", "mask", "n", (F.col("named") - first).alias("identical"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: what is kept, removed, redundant and lost there."""
    sets = range(1 << len(FILTERS))

    def counted(m: int, which: Column | None) -> Column:
        here = F.col("mask") == m % _IDENTICAL
        n = F.col("identical") if m & _IDENTICAL else F.col("n") - F.col("identical")
        return F.sum(F.when(here if which is None else here & which, n).otherwise(0))

    kinds = {"all": None, "good": F.col("good"), "toxic": F.col("toxic")}
    parts = flagged(docs, labels, id_col, text_col, part_col).groupBy("part").agg(*[counted(m, c).alias(f"{k}{m}") for k, c in kinds.items() for m in sets])
    parts = parts.select("part", *[F.array(*[F.col(f"{k}{m}") for m in sets]).alias(k) for k in kinds])

    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))
    steps = parts.select("*", orders.alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))

    earlier = F.slice(F.split("filter_order", ""), 1, F.col("place"))
    bit = {x: 1 << i for i, x in enumerate(FILTERS)}
    bits = F.create_map(*[F.lit(v) for x in bit.items() for v in x])
    steps = steps.select("*", bits[F.col("letter")].alias("own"), F.aggregate(earlier, F.lit(0), lambda s, x: s + bits[x]).alias("before"))

    def total(kind: str, wanted, weight=None) -> Column:
        """Documents of a kind under the combinations that are wanted."""
        n = F.col(kind)

        def add(s: Column, m: Column) -> Column:
            one = n[m] if weight is None else n[m] * weight(m)
            return s + F.when(wanted(m), one).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(sets) - 1)), F.lit(0).cast("long"), add)

    own, before = F.col("own"), F.col("before")

    def here(m: Column) -> Column:  # fails this filter and none before
        return (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) == 0)

    # a document goes by one of the filters that it fails in as many of the orders as by any other
    share = len(list(permutations(FILTERS)))
    return steps.select(
        "part",
        "filter_order",
        (F.col("place") + 1).cast("int").alias("step"),
        total("all", lambda m: m.bitwiseAND(own + before) == 0).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("all", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("all", lambda m: m.bitwiseAND(own) != 0, lambda m: (share / F.bit_count(m)).cast("int")).alias("shapley"),
    )
