"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Running expected copies start at
one random offset per source, and a document is emitted once for each integer they cross. Documents stand
in the order of their size, so neighbours are alike and the words taken stay within about one document of
the target; their order inside a size is a digest of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.seeded import seeded_int
from weftline.llm.common import SPACE, cut_lineage, place_in_order, salted_join

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def text_size(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Targets from one row (_source, source_size) per source.

    Sources in ``_source`` order get the weights in turn. Sharing the excess of capped sources until none
    is above its cap ends at one level per weight unit: ordered by cap / weight, the first sources are at
    their cap and the others share what is left. The windows run over one row per source.
    """
    turn = Window.orderBy("_source")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_turn", F.row_number().over(turn) - 1).withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_source")
    below, onward, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    s = s.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(below), F.lit(0))).withColumn("_ws", F.sum("_w").over(onward))
    s = s.withColumn("_free", F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_ws"))
    first = F.struct(F.col("_cap") / F.col("_w"), F.col("_source"), "_left", "_ws")
    s = s.withColumn("_at", F.min(F.when(F.col("_free"), first)).over(whole))
    level = (F.col("_w") * F.col("_at._left")).cast("double") / F.col("_at._ws")
    target = F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), level))
    # 16 random bits: sums with expected copies stay exact where these are whole
    start = F.floor(seeded_int(seed, "_source") / 65536).cast("double") / 65536
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.withColumn("target", target).select("_source", "source_size", "target", ratio.alias("_ratio"), start.alias("_u"))


def mix_counts(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies (long) for every row of ``docs``.

    A null source is a source of its own, after all others. Documents of size 0 are placed too and may be
    emitted; they add no words. A source without words has target 0 and no copies. Repeated rows count
    as documents of their own. The result is a function of ids, sizes and ``seed``.
    """
    named = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    sized = cut_lineage(docs.select("doc_id", named.alias("_source"), size.alias("size")))
    sizes = sized.groupBy("_source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, most, seed)
    placed = salted_join(place_in_order(sized, "_source", "size", ["doc_id"], "_place"), targets, ["_source"], "doc_id")
    crossed = lambda k: F.floor(k * F.col("_ratio") + F.col("_u"))
    copies = (crossed(F.col("_place") + 1) - crossed(F.col("_place"))).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed table: every row of ``docs`` as often as it was drawn, with the columns of ``docs``.

    Rows that share a doc_id (repeated rows) share their draws: each is emitted as often as their mean
    copies, rounded by one more integer crossing, so that no row passes ``most`` copies.
    """
    drawn = mix_counts(docs, text_size(F.col("text")), weights, most, seed)
    per_id = drawn.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_all"), F.count(F.lit(1)).alias("_rows"))
    offset = F.pmod(F.xxhash64("_id"), F.col("_rows"))
    times = F.floor((F.col("_all") + offset) / F.col("_rows")).cast("int")
    per_id = per_id.select("_id", times.alias("_times")).filter("_times > 0")
    joined = docs.join(per_id, docs["doc_id"].eqNullSafe(per_id["_id"]))
    copies = joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), per_id["_times"])).alias("_copy"))
    return copies.select(*[docs[c] for c in docs.columns])
