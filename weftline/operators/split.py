"""Splits, samples and mixtures; every draw is a function of seed and id."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.seeded import seeded_int, seeded_uniform
from weftline.operators.ordered import number_rows, running, seeded_rank


#: copies of a row that one task writes
COPIES = 1000


def exact_split(df: DataFrame, id_col: str, p: float, seed: int = 42) -> DataFrame:
    """Flag exactly ``int(p * n)`` seeded rows as ``val``, the rest as ``train``."""
    n_val = int(p * df.count())
    ranked = seeded_rank(df, seed, id_col)
    return ranked.withColumn("split", F.when(F.col("rank") <= n_val, "val").otherwise("train")).drop("rank")


def ratio_split(df: DataFrame, id_col: str, test: float, val: float, seed: int = 42) -> DataFrame:
    """Two stages: ``int(test * n)`` test rows, then ``int(val / (1 - test) * rest)`` validation rows."""
    n = df.count()
    n_test = int(test * n)
    n_val = int(val / (1 - test) * (n - n_test))
    ranked = seeded_rank(df, seed, id_col)
    label = F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", label).drop("rank")


def split_ends(spec: str, size: int) -> tuple[int, int]:
    """Ends of the train and validation ranges for shares ``a,b,c`` or ``a/b/c``.

    Validation and test get their rounded shares at the end of the order; train takes what is left.
    """
    shares = [float(s) for s in re.split("[,/]", spec)]
    if len(shares) != 3 or min(shares) < 0 or not sum(shares):
        raise ValueError(f"a split needs three shares, got {spec!r}")
    val, test = (round(s / sum(shares) * size) for s in shares[1:])
    if val + test > size:
        raise ValueError(f"the shares of {spec!r} leave no room in {size} rows")
    return size - val - test, size - test


def string_split(df: DataFrame, order: str, spec: str) -> DataFrame:
    """Contiguous train, validation and test ranges of the row order."""
    train, val = split_ends(spec, df.count())
    label = F.when(F.col("row_no") <= train, "train").when(F.col("row_no") <= val, "val").otherwise("test")
    return number_rows(df, [order]).withColumn("split", label).drop("row_no")


def _with_sizes(ranked: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """Add the size ``_n`` of each row's group; null is a group."""
    sizes = df.groupBy(F.col(by).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, ranked[by].eqNullSafe(sizes["_of"])).drop("_of")


def stratified_split(df: DataFrame, id_col: str, stratum: str, p: float, seed: int) -> DataFrame:
    """``int(p * n)`` seeded rows of every stratum as ``val``."""
    ranked = seeded_rank(df, seed, id_col, by=[stratum])
    out = _with_sizes(ranked, df, stratum)
    return out.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("_n") * p), "val").otherwise("train")).drop("rank", "_n")


def tail_split(df: DataFrame, order: str, p: float) -> DataFrame:
    """The last ``int(p * n)`` rows are ``dev``."""
    n = df.count()
    cut = n - int(n * p)
    return number_rows(df, [order]).withColumn("split", F.when(F.col("row_no") > cut, "dev").otherwise("train")).drop("row_no")


def group_split(df: DataFrame, group: str, p: float, seed: int) -> DataFrame:
    """Whole groups go to one side: seeded by the group key, before any expansion."""
    return df.withColumn("split", F.when(seeded_uniform(seed, group) < p, "val").otherwise("train"))


def rebalance(df: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """Repeat rows until every class is as large as the largest: full copies plus a seeded remainder."""
    ranked = seeded_rank(df, seed, id_col, by=[label])
    top = df.groupBy(label).count().agg(F.max("count")).first()[0] or 0
    out = _with_sizes(ranked, df, label)
    copies = F.floor(F.lit(top) / F.col("_n")) + F.when(F.col("rank") <= F.lit(top) % F.col("_n"), 1).otherwise(0)
    # blocks of copies are dealt out before they are written, so a rare row's copies aren't made in one task
    zero = F.lit(0).cast("long")
    out = out.withColumn("_copies", copies.cast("long")).withColumn("_at", F.explode(F.sequence(zero, F.col("_copies") - 1, F.lit(COPIES).cast("long"))))
    out = out.repartition(F.col(id_col), F.col("_at"))
    upto = F.least(F.col("_at") + COPIES, F.col("_copies")) - 1
    return out.withColumn("copy", F.explode(F.sequence(F.col("_at"), upto))).drop("rank", "_n", "_copies", "_at")


def resample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows: without replacement if there are enough, else with."""
    have = df.count()
    ranked = seeded_rank(df, seed, id_col)
    if have >= n:
        return ranked.filter(F.col("rank") <= n).drop("rank").withColumn("draw", F.lit(0).cast("long"))
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (seeded_int(seed, F.lit("draw"), F.col("id")) % have + 1).alias("rank")
    )
    return draws.join(ranked, "rank").drop("rank")


def weighted_draws(df: DataFrame, id_col: str, weight: str, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement, probability proportional to an integer or float weight.

    A draw falls on the row whose cumulative weight range holds it: rows and draws are laid on one
    line and every draw takes the last row before it. A dominating row costs nothing extra.
    """
    items = df.filter(F.col(weight) > 0).select(id_col, F.col(weight).cast("double").alias("_w"))
    cum = running(items, [id_col], sums={"_hi": F.col("_w")})
    total = items.agg(F.sum("_w")).first()[0]
    none = F.lit(None).cast("long")
    rows = cum.select((F.col("_hi") - F.col("_w")).alias("_at"), F.lit(0).alias("_kind"), none.alias("draw"), F.col(id_col))
    draws = df.sparkSession.range(n).select(
        (seeded_uniform(seed, F.lit("w"), F.col("id")) * total).alias("_at"),
        F.lit(1).alias("_kind"),
        F.col("id").alias("draw"),
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
    )
    line = running(rows.unionByName(draws), ["_at", "_kind", "draw"], last={"_owner": F.col(id_col)})
    return line.filter(F.col("_kind") == 1).select("draw", F.col("_owner").alias(id_col))


def blend_stride(spark, weights: list[float], sizes: list[int], size: int, bins: int = 100) -> DataFrame:
    """Dataset and sample of every position of a blend, by arithmetic on the position alone.

    Positions repeat in a cycle of ``bins``, in which every dataset holds the whole part of its share. What
    rounding leaves at the end of the cycle goes to the last dataset, one sample behind, so one is repeated.
    """
    cycle = min(bins, size)
    held = [int(w / sum(weights) * cycle) for w in weights]
    if not all(held):
        raise ValueError("a dataset has no bin: raise the number of bins or its weight")
    ends = list(accumulate(held))
    per_cycle = [*held[:-1], held[-1] + cycle - ends[-1]]
    of = lambda values, k: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), k + 1)

    at = spark.range(size).select(F.col("id").alias("idx"), (F.col("id") % cycle).alias("_at"), F.floor(F.col("id") / cycle).alias("_turn"))
    owner = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]), lambda e: e <= F.col("_at"))) if len(held) > 1 else F.lit(0)
    placed = at.withColumn("dataset", owner)
    nth = F.col("_at") - of([e - h for e, h in zip(ends, held)], F.col("dataset")) - F.when(F.col("_at") >= ends[-1], 1).otherwise(0)
    sample = (nth + F.col("_turn") * of(per_cycle, F.col("dataset"))) % of(sizes, F.col("dataset"))
    return placed.select("idx", "dataset", sample.cast("long").alias("sample"))


#: positions of the longest period whose sequence is sent to the tasks; of a longer one they get the counts at every
#: ``WALK``-th position and walk on from there
MOST_PERIOD = 1_000_000
WALK = 100_000


def _greedy(shares: list[int], total: int, first: int, n: int, counts: list[int] | None = None, at: int = 0) -> list[int]:
    """Datasets at the ``n`` positions from ``first + at``, where zero deficits were at ``first``; integer arithmetic.

    ``counts`` are the samples of every dataset since ``first`` and are moved on.
    """
    counts, every = [0] * len(shares) if counts is None else counts, range(len(shares))
    out = []
    for j in range(at, at + n):
        at = max(first + j, 1) - first
        behind = [s * at - c * total for s, c in zip(shares, counts)]
        best = max(every, key=behind.__getitem__)  # of equal ones the first
        counts[best] += 1
        out.append(best)
    return out


def _whole_shares(weights: list[float]) -> list[int]:
    """Weights as the smallest whole numbers in their ratio, as written in decimals."""
    exact = [Fraction(str(w)) for w in weights]
    if min(exact) < 0 or not any(exact):
        raise ValueError("weights must not be negative, nor all zero")
    parts = math.lcm(*(x.denominator for x in exact))
    whole = [int(x * parts) for x in exact]
    return [x // math.gcd(*whole) for x in whole]


def blend_greedy(spark, weights: list[float], sizes: list[int], size: int) -> DataFrame:
    """Greedy blend: position ``i`` goes to the dataset furthest below ``weight * max(i, 1)``, samples wrap.

    Weights are taken as whole numbers. No dataset is ever more than one sample ahead, so after as many
    positions as they sum to every deficit is back at zero: the sequence is one opening period and then
    one period repeated. Two periods are walked; positions are arithmetic on them.
    """
    shares = _whole_shares(weights)
    total = sum(shares)
    period = min(total, size)
    if period > MOST_PERIOD:
        return _blend_by_walks(spark, shares, sizes, size)
    parts = []
    for part, seq in ((0, _greedy(shares, total, 0, period)), (1, _greedy(shares, total, total, period) if size > total else [])):
        owner = np.array(seq, np.int64)
        nth = np.zeros(len(owner), np.int64)
        for d in range(len(shares)):
            mine = np.flatnonzero(owner == d)
            nth[mine] = np.arange(len(mine))
        parts.append(pa.table({"part": np.full(len(owner), part, np.int32), "j": np.arange(len(owner)), "dataset": owner, "nth": nth, "share": np.array(shares, np.int64)[owner], "n": np.array(sizes, np.int64)[owner]}))
    table = spark.createDataFrame(pa.concat_tables(parts))
    idx = spark.range(size).select(
        F.col("id").alias("idx"), (F.col("id") % total).alias("j"), F.floor(F.col("id") / total).alias("period")
    ).withColumn("part", F.when(F.col("period") > 0, 1).otherwise(0))
    # two periods: at most 2 * MOST_PERIOD rows of six numbers
    return idx.join(F.broadcast(table), ["part", "j"]).select(
        "idx", "dataset", ((F.col("period") * F.col("share") + F.col("nth")) % F.col("n")).cast("long").alias("sample")
    )


def _blend_by_walks(spark, shares: list[int], sizes: list[int], size: int) -> DataFrame:
    """:func:`blend_greedy` of a long period: the driver keeps the counts at every ``WALK``-th position of a period, tasks walk the rest."""
    total = sum(shares)
    marks: list[list[tuple[int, list[int]]]] = []
    for first in (0, total) if size > total else (0,):
        counts, marks = [0] * len(shares), [*marks, []]
        length = min(total, size - first)
        for at in range(0, length, WALK):
            marks[-1].append((at, list(counts)))
            _greedy(shares, total, first, min(WALK, length - at), counts, at)
    rows = [
        (period, at, min(WALK, total - at, size - period * total - at), counts)
        for period in range(-(-size // total))
        for at, counts in marks[min(period, 1)]
        if period * total + at < size
    ]
    walks = spark.createDataFrame(rows, "period long, at long, n long, counts array<long>").repartition(len(rows))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            nth = row["period"] * np.array(shares) + np.array(row["counts"])
            owner = np.array(_greedy(shares, total, total if row["period"] else 0, row["n"], row["counts"], row["at"]), np.int64)
            sample = np.zeros(len(owner), np.int64)
            for d, n in enumerate(sizes):
                mine = np.flatnonzero(owner == d)
                sample[mine] = (nth[d] + np.arange(len(mine))) % max(n, 1)
            idx = row["period"] * total + row["at"] + np.arange(len(owner))
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(owner), pa.array(sample)], names=["idx", "dataset", "sample"])

    return walks.mapInArrow(walk, "idx long, dataset long, sample long")


def sample_counts(weights: DataFrame, n: int, weight: str = "weight", margin: float = 1.005) -> DataFrame:
    """Samples to draw per dataset: ``ceil(n * share * margin)``. One row per dataset."""
    total = weights.agg(F.sum(weight)).first()[0]
    return weights.withColumn("samples", F.ceil(F.lit(float(n)) * (F.col(weight) / F.lit(float(total))) * margin).cast("long"))


def mixed_samples(df: DataFrame, id_col: str, lang: str, duration: str, lo: float, hi: float, seed: int) -> DataFrame:
    """Compose samples of mixed languages with total duration in [lo, hi].

    The seeded order is cut where the running duration crosses a multiple of ``lo``; a sample whose
    pieces leave [lo, hi] goes. Pieces are used once, so the job ends without a retry loop.
    """
    keyed = df.filter(F.col(duration) <= hi).select(id_col, lang, duration)
    ranked = seeded_rank(keyed, seed, id_col, out="_r")
    cum = running(ranked.withColumn("_ms", F.round(F.col(duration) * 1000).cast("long")), ["_r"], sums={"_end": F.col("_ms")})
    unit = int(lo * 1000)
    pieces = cum.withColumn("sample", F.floor((F.col("_end") - F.col("_ms")) / unit).cast("long"))
    item = F.struct("_r", F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col("_ms").alias("ms"))
    out = pieces.groupBy("sample").agg(F.array_sort(F.collect_list(item)).alias("x"), F.sum("_ms").alias("total_ms"))
    out = out.filter(F.col("total_ms").between(unit, int(hi * 1000)))
    return out.select(
        "sample",
        F.transform("x", lambda r: r["id"]).alias("ids"),
        F.transform("x", lambda r: r["lang"]).alias("langs"),
        "total_ms",
    )


def grounding_questions(df: DataFrame, group: str, sentences: Column, prompts: list[str], ratio: float, seed: int) -> DataFrame:
    """Questions for the sentences of a seeded share of groups, with a seeded prompt per sentence."""
    n_keep = int(ratio * df.count())
    picked = seeded_rank(df, seed, group).filter(F.col("rank") <= n_keep).drop("rank")
    rows = picked.select(group, F.posexplode(sentences).alias("pos", "sentence"))
    choice = (seeded_int(seed, group, "pos") % len(prompts) + 1).cast("int")
    template = F.element_at(F.array(*[F.lit(p) for p in prompts]), choice)
    return rows.withColumn("question", F.replace(template, F.lit("{}"), F.col("sentence"))).withColumn("pos", F.col("pos").cast("long"))


