"""Hot keys, lost determinism and plan shapes."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import words
from weftline.operators import filters as fl
from weftline.operators import order as od
from weftline.operators import shape as sh
from weftline.operators import split as sp
from weftline.operators.ordered import order_bucket, running, seeded_rank
from weftline.operators.quantiles import exact_quantiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """One value of ``v`` and one group hold more than a third of the rows."""
    return (
        spark.range(3000)
        .withColumn("v", F.when(F.col("id") % 5 < 2, 7).otherwise(F.col("id") % 50))
        .withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40))
        .withColumn("x", F.col("id") % 11)
    )


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_equals_window(skewed, by):
    sometimes = F.when(F.col("id") % 5 == 0, F.col("id"))
    got = running(
        skewed, ["v", "id"], by, row_no="n", sums={"s": F.col("x")}, max_before={"m": F.col("id")},
        lag={"a": F.col("id")}, lead={"b": F.col("id")}, last={"c": sometimes}, buckets=16,
    )
    w = W.partitionBy(*by).orderBy("v", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select(
        "*", F.row_number().over(w).cast("long").alias("n"), F.sum("x").over(upto).alias("s"),
        F.max("id").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("m"), F.lag("id").over(w).alias("a"),
        F.lead("id").over(w).alias("b"), F.last(sometimes, True).over(upto).alias("c"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_value_is_cut(skewed):
    sizes = skewed.groupBy(order_bucket(skewed, ["v", "id"], buckets=32).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 3000 / 8


def test_results_do_not_depend_on_partitions(spark, skewed):
    out = []
    for n in ("1", "8", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = seeded_rank(skewed.repartition(int(n)), 5, "id", by=["g"]).orderBy("id").collect()
        out.append([r["rank"] for r in rows])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert out[0] == out[1] == out[2]


def test_exact_quantiles(skewed):
    got = exact_quantiles(skewed, "v", {"p50": 0.5, "p99": 0.99}).first()
    want = skewed.agg(F.percentile("v", 0.5), F.percentile("v", 0.99)).first()
    assert tuple(got) == tuple(want)


def test_weighted_draws_follow_weights(spark):
    df = spark.range(10).withColumn("w", F.when(F.col("id") == 3, 100).otherwise(F.col("id") % 2))
    drawn = sp.weighted_draws(df, "id", "w", 2000, 9)
    counts = {r["id"]: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert sum(counts.values()) == 2000 and counts[3] > 1800 and 0 not in counts


def test_quota_prunes_before_the_shuffle(spark):
    df = spark.range(500).withColumn("labels", F.array(F.lit("hot"), (F.col("id") % 7).cast("string")))
    out = od.label_quota(df, "id", F.col("labels"), 3)
    assert "WindowGroupLimit" in plan_of(out)
    assert out.filter("kept").count() == 21


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = plan_of(fl.filter_duration(df, 5, 60, "value").select("event_id"))
    assert "GreaterThanOrEqual(value,5" in plan and "props" not in plan.split("ReadSchema")[1]


def test_text_filters_stay_on_the_jvm(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(fl.filter_language(fl.mark_length_ratio(df, "text", None), [("text", F.col("lang"))]))
    assert "Python" not in plan and "Exchange" not in plan


def test_packing_keeps_every_token(spark):
    docs = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), (F.col("id") * 37 % 23).cast("int")), lambda i: i.cast("string")).alias("t"))
    packs = sh.pack_contiguous(docs, "id", "t", 64, pad="")
    total = packs.select(F.explode("tokens").alias("x")).filter("x != ''").count()
    assert total == docs.agg(F.sum(F.size("t"))).first()[0]
    assert packs.filter(F.size("tokens") != 64).isEmpty() and packs.filter(F.size("position_ids") != 64).isEmpty()
    assert packs.filter(F.aggregate("seq_lens", F.lit(0).cast("long"), lambda a, n: a + n) != 64).isEmpty()


def test_words_split_like_unicode_whitespace(spark):
    df = spark.createDataFrame([("a b c  d\n",)], "s string")
    assert df.select(words("s").alias("w")).first()["w"] == ["a", "b", "c", "d"]
