"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage

#: White space that separates words in most contracts: space and \t\n\v\f\r.
SPACE = "\\x20\\x09-\\x0D"

__all__ = ["SPACE", "cut_lineage", "place_in_order", "salted_join", "table", "word_list"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def word_list(text: Column) -> Column:
    """Words of a text, as maximal runs without the six ASCII white-space characters (null: none)."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1)), F.array().cast("array<string>"))


def place_in_order(df: DataFrame, by: str, value: str, ids: list[str], out: str = "place") -> DataFrame:
    """Add the 0-based place of each row inside its ``by`` group, ordered by the integer ``value``.

    ``by`` and ``value`` must not be null; rows of one value follow the MD5 digest of ``ids``. No group is
    sorted in one task: rows are numbered inside (group, value, digest prefix) cells, and the cells'
    starts come from two windows over counts, one over the distinct values of a group, one over the 256
    prefixes of a value. A third of all rows in one group, or on one value, is spread over its cells.
    """
    work = df.withColumn("_g", F.col(by)).withColumn("_h", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids]))).withColumn("_s", F.substring("_h", 1, 2))
    cells = work.groupBy("_g", value, "_s").agg(F.count(F.lit(1)).alias("_n"))
    sums = cells.groupBy("_g", value).agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy("_g").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", value, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_g", value).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(sums, ["_g", value]).select("_g", value, "_s", (F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_from"))
    local = Window.partitionBy("_g", value, "_s").orderBy("_h", *ids)
    placed = work.join(starts, ["_g", value, "_s"]).withColumn(out, (F.col("_from") + F.row_number().over(local) - 1).cast("long"))
    return placed.select(*df.columns, out)


def salted_join(rows: DataFrame, groups: DataFrame, keys: list[str], salt: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join ``rows`` with one row per group on ``keys`` (not null).

    Every group's row is repeated ``salts`` times and the rows are spread by a digest of their ``salt``
    column, so a group that holds a third of all rows is joined in as many tasks.
    """
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts).cast("long")))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
