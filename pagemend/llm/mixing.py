"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words in proportion to its weight, at most
``max_repeat`` times its own size; what a full source can't take is reshared by
weight (solved at once by sorting sources by cap / weight). Within a source each
document expects target / source size copies. Documents are ranked by (size, id);
the prefix sum of expected copies plus one random offset a source crosses integers,
and a document is emitted once per integer crossed. As ranks follow sizes, words
taken miss the target by less than the largest document.

The prefix sum is two-level: a range partitioning on (source, size, id) splits a hot
source over many partitions, counts per (partition, source) are summed first, and a
row adds its rank within the partition. No task sees a whole source.

Defined cases: null or empty text has size 0; a null source is a source of its own,
last in order; repeated rows count each by itself; an empty table gives no rows; a
source of size 0 has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NONSPACE, cut, hashed_unit, reserved

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 17


def with_size(docs: DataFrame, text_col: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(NONSPACE)), F.lit(0)).cast("long")


def _first_numbers(rows: DataFrame, order: list, parts: int) -> DataFrame:
    """rows in order, with pid and place (from 1) in their range; a range is a task, and no task sees all rows."""
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()))
    return ranged.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(*order)))


def _before(ranged: DataFrame, **sums) -> DataFrame:
    """(pid, sums): what the ranges before each range add up to; one row a range, so one small task."""
    each = ranged.groupBy("pid").agg(*[total.alias(name) for name, total in sums.items()])
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("pid", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums])


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(src_null, src, n, source_size) -> adds weight and target. One row a source.

    Water level: with sources sorted by cap / weight, those before the first whose cap
    exceeds its share are full, the rest split what is left by weight. Positions and prefix
    sums are taken in ranges of sources, so that sources may be many (hosts, say).
    """
    parts = max(1, min(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 200))
    placed = _first_numbers(sizes, ["src_null", "src"], parts)
    placed = placed.join(_before(placed, n_rows=F.count("*")), "pid").withColumn("pos", F.col("n_rows_before") + F.col("place") - 1)
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % n + 1).cast("int"))
    capped = placed.select("src_null", "src", "n", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = ["ratio", "src_null", "src"]
    ranged = _first_numbers(capped, order, parts)
    total, weights_sum = ranged.agg(F.coalesce(F.sum("source_size").cast("double"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    own = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.join(_before(ranged, caps=F.sum("cap"), heavy=F.sum("weight")), "pid")
    cap_before = F.col("caps_before") + F.coalesce(F.sum("cap").over(own), F.lit(0.0))
    weight_left = F.lit(weights_sum) - F.col("heavy_before") - F.coalesce(F.sum("weight").over(own), F.lit(0.0))
    share = (F.lit(total) - F.col("cap_before")) / F.col("weight_left")
    level = sums.withColumn("cap_before", cap_before).withColumn("weight_left", weight_left).withColumn("share", share)
    # the level is the share at the first source that isn't full
    first_open = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("share"), F.struct(*order, "share")))
    water = level.agg(first_open["share"].alias("level")).first()[0]
    target = F.col("cap") if water is None else F.least("cap", F.col("weight") * F.lit(water))
    return capped.select("src_null", "src", "n", "source_size", "weight", target.alias("target"))


def systematic_copies(narrow: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED, partitions: int | None = None) -> DataFrame:
    """(doc_id, source, size) -> doc_id, source, size, source_size, target, copies; one row a row."""
    spark = narrow.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut(narrow.select("doc_id", "source", "size", F.col("source").isNull().alias("src_null"), F.coalesce("source", F.lit("")).alias("src")))
    ranged = cut(
        keyed.repartitionByRange(parts, "src_null", "src", "size", "doc_id")
        .withColumn("pid", F.spark_partition_id())
    )
    counts = ranged.groupBy("pid", "src_null", "src").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    totals = counts.groupBy("src_null", "src").agg(F.sum("n").alias("n"), F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, max_repeat)
    earlier = Window.partitionBy("src_null", "src").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counts.select("pid", "src_null", "src", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranks_before"))
        .join(targets, ["src_null", "src"])
        .withColumn("offset", hashed_unit(F.lit(str(seed)), F.col("src_null").cast("int").cast("string"), "src"))
        .withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )
    within = Window.partitionBy("pid", "src_null", "src").orderBy("size", "doc_id")
    ranked = ranged.withColumn("rn", F.row_number().over(within)).join(placed, ["pid", "src_null", "src"])
    rank = F.col("ranks_before") + F.col("rn")
    crossed = F.floor(F.col("expected") * rank + F.col("offset")) - F.floor(F.col("expected") * (rank - 1) + F.col("offset"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of docs once per copy, with the columns of docs.

    Rows with equal (doc_id, source, size) are told apart by their number in the order of
    their columns. ValueError if a column has one of the operator's own names.
    """
    names = docs.columns
    reserved(docs, "__size", "__k_size", "__no", "__copies", "__copy")
    sized = docs.withColumn("__size", with_size(docs))
    narrow = sized.select("doc_id", "source", F.col("__size").alias("size"))
    copies = cut(systematic_copies(narrow, weights, max_repeat, seed))
    key = ["doc_id", "source", "size"]
    repeated = copies.groupBy(*key).count().filter("count > 1").limit(1).count() > 0
    left, right = sized.withColumnsRenamed({"__size": "__k_size"}), copies
    on = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("l.source").eqNullSafe(F.col("r.source"))) & (F.col("l.__k_size") == F.col("r.size"))
    if repeated:
        # the row's own columns settle the order, so that reruns agree; rows that agree in all are the same
        number = lambda size, *order: F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(*order))
        content = [F.xxhash64(*names), *[F.col(f"`{n}`") for n in names if n in ("text", "lang", "n_chars")]]
        left, right = left.withColumn("__no", number("__k_size", *content)), right.withColumn("__no", number("size", "copies"))
        on = on & (F.col("l.__no") == F.col("r.__no"))
    taken = right.filter("copies > 0").alias("r")
    joined = left.alias("l").join(taken, on).select(*[F.col(f"l.`{n}`").alias(n) for n in names], F.col("r.copies").alias("__copies"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)
