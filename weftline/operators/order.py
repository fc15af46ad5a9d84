"""Ordering, quotas, batches and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.seeded import seeded_int, seeded_key, seeded_uniform
from weftline.operators.ordered import number_rows, running
from weftline.session import cut_lineage

#: a length histogram is folded on the driver; its size is the number of distinct lengths


def keep_first(df: DataFrame, cols: list[str], order: str) -> DataFrame:
    """First row of every distinct value combination.

    The winner per combination comes from an aggregation (partial on the map side), so a value that
    fills the table is no hot spot. Strings are grouped by their SHA-256 digest.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    keys = [F.sha2(c, 256).alias(c) if c in text else F.col(c) for c in cols]
    first = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def label_quota(df: DataFrame, order: str | list[str], labels: Column, cap: int) -> DataFrame:
    """Flag rows that hold a label seen fewer than ``cap`` times before them.

    A label's counter rises with every occurrence until the cap whatever the other labels do, so a
    row is kept if any of its occurrences is among the first ``cap`` of its label. The rank limit is
    applied in every map task, so a hot label sends at most ``cap`` rows from each.
    """
    order = [order] if isinstance(order, str) else order
    flat = df.select(*order, F.posexplode(labels).alias("_i", "_label"))
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(*order, "_i"))
    kept = flat.withColumn("_n", rank).filter(F.col("_n") <= cap).select(*order).distinct().withColumn("_kept", F.lit(True))
    return df.join(kept, order, "left").withColumn("kept", F.coalesce("_kept", F.lit(False))).drop("_kept")


def pattern_quota(df: DataFrame, order: str | list[str], patterns: dict[str, tuple[Column, int]]) -> DataFrame:
    """Take sentences while one of their patterns is below its own target.

    ``patterns``: name -> (predicate, target count).
    """
    order = [order] if isinstance(order, str) else order
    names = F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, (hit, _) in patterns.items()]))
    flat = df.select(*order, F.explode(names).alias("_p"))
    target = None
    for k, (_, n) in patterns.items():
        target = F.when(F.col("_p") == k, n) if target is None else target.when(F.col("_p") == k, n)
    top = max(n for _, n in patterns.values())
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    # the constant limit prunes in the map tasks, the own target decides
    first = flat.withColumn("_n", rank).filter(F.col("_n") <= top)
    kept = first.filter(F.col("_n") <= target).select(*order).distinct()
    return df.join(kept, order, "left_semi")


def semi_sorted_batches(
    df: DataFrame, duration: str, id_col: str, batch: int, ranks: int, noise: float, seed: int
) -> DataFrame:
    """Batches of similar duration: order by duration plus bounded noise, pad the number of batches to
    the ranks with seeded repeats, deal positions to the ranks by stride and cut each rank's share.
    """
    span = df.agg(F.min(duration).alias("lo"), F.max(duration).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if span["lo"] is None:  # nothing to batch
        return df.limit(0).select(id_col, F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("batch"))
    bound, n = (span["hi"] - span["lo"]) * noise / 2, span["n"]
    jitter = (seeded_uniform(seed, id_col) * 2 - 1) * bound
    sorted_ = running(df.select(id_col, (F.col(duration) + jitter).alias("_key")), ["_key", id_col], row_no="_n")
    batches = -(-n // batch)
    missing = ((ranks - batches % ranks) % ranks) * batch
    rows = sorted_.select(id_col, (F.col("_n") - 1).alias("at"))
    if missing:
        drawn = df.sparkSession.range(missing).select(
            (F.col("id") + n).alias("at"), (seeded_int(seed, F.lit("pad"), F.col("id")) % n).alias("_src")
        )
        extra = drawn.join(rows.select(id_col, F.col("at").alias("_src")), "_src").select(id_col, "at")
        rows = rows.unionByName(extra)
    local = F.floor(F.col("at") / ranks)
    return rows.select(id_col, (F.col("at") % ranks).alias("rank"), F.floor(local / batch).cast("long").alias("batch"))


def _fold_lengths(hist: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """(length, rank in length from, batch of that row, rows already in the batch) per length."""
    out = []
    batch, filled = 0, 0
    for length, count in hist:
        if filled and length * (filled + 1) > budget:
            batch, filled = batch + 1, 0
        out.append((length, count, batch, filled))
        per = max(budget // length, 1) if length else filled + count
        total = filled + count
        batch += (total - 1) // per if total > per else 0
        filled = total - ((total - 1) // per) * per if total > per else total
    return out


def token_budget_batches(df: DataFrame, id_col: str, length: str, budget: int) -> DataFrame:
    """Batches over length-sorted rows; a batch closes when ``length * (rows + 1)`` exceeds the budget.

    Within one length every batch holds ``budget // length`` rows, so only the carry from one length
    to the next is sequential: it is folded over the length histogram, and rows find their batch
    from their rank within their length. ``df`` is written out once, so pass ids and lengths only.
    A row longer than the budget is an error.
    """
    df = cut_lineage(df)
    longest = df.agg(F.max(F.col(length).cast("long"))).first()[0]
    if longest is not None and longest > budget:
        raise ValueError(f"a row of {longest} tokens exceeds the budget of {budget} tokens")
    # at most one row per length up to the budget
    hist = df.groupBy(F.col(length).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()
    plan = _fold_lengths(sorted((r["n"], r["c"]) for r in hist), budget)
    table = df.sparkSession.createDataFrame([(n, b, f) for n, _, b, f in plan], "_len long, _batch long, _filled long")
    ranked = running(df.withColumn("_len", F.col(length).cast("long")), [id_col], ["_len"], row_no="_r")
    per = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("_len"), F.lit(1))), F.lit(1))
    at = F.col("_filled") + F.col("_r") - 1
    step = F.when(F.col("_len") == 0, F.lit(0)).otherwise(F.floor(at / per))
    return ranked.join(table, "_len").withColumn("batch", (F.col("_batch") + step).cast("long")).drop("_len", "_r", "_batch", "_filled")


def sample_length(duration: Column, seconds_per_token: float, text_tokens: Column | None = None, quadratic: float | None = None) -> Column:
    """Tokens an audio row is worth, with its text if given, and a quadratic penalty on long rows."""
    n = F.ceil(duration / seconds_per_token)
    n = n + text_tokens if text_tokens is not None else n
    return n if quadratic is None else n + n * n / quadratic


def rank_batches(df: DataFrame, order: str, micro: int, ranks: int, offset: int = 0, pad: bool = False) -> DataFrame:
    """Contiguous micro-batches per rank from row ``offset`` on.

    Without ``pad`` an incomplete last global batch is dropped, with it the last rows fill it up.
    """
    numbered = number_rows(df.select(order), [order])
    rows = numbered.filter(F.col("row_no") > offset).select(order, (F.col("row_no") - 1 - offset).alias("at"))
    n = df.count() - offset
    step = micro * ranks
    rest = n % step
    if rest and not pad:
        rows = rows.filter(F.col("at") < n - rest)
    elif rest:
        short = step - rest
        extra = rows.filter(F.col("at") >= n - short).select(order, (F.col("at") + short).alias("at"))
        rows = rows.unionByName(extra)
    inside = F.col("at") % step
    return rows.select(order, F.floor(F.col("at") / step).cast("long").alias("step"), F.floor(inside / micro).cast("long").alias("rank"), (inside % micro).cast("long").alias("place"))


def fused_score(parts: list[tuple[Column, float]], length: Column, alpha: float = 0.0, length_norm: bool = True) -> Column:
    """Weighted sum of scores, divided by the length and by the penalty ((5 + n) / 6) ** alpha."""
    total = sum((c * w for c, w in parts), F.lit(0.0))
    total = total / length if length_norm else total
    return total / F.pow((length + 5) / 6, F.lit(alpha))


def rerank(df: DataFrame, query: str, score: Column, best: list[str], tie: list[Column]) -> DataFrame:
    """Best candidate per query (ties: smallest ``tie``, column by column) in one aggregation."""
    return df.groupBy(query).agg(
        *[F.max_by(c, F.struct(score.alias("s"), *[-c for c in tie])).alias(c) for c in best], F.max(score).alias("score")
    )


def coefficient_search(
    df: DataFrame, query: str, first: Column, second: Column, errors: Column, tokens: Column, grid: list[float], tie: list[Column]
) -> DataFrame:
    """Error rate of the best candidate at every coefficient; the first minimum is flagged.

    Every coefficient is one ``max_by`` of the same aggregation, so candidates are shuffled once and
    never multiplied by the grid.
    """
    picks = [
        F.max_by(errors, F.struct((first + second * c).alias("s"), *[-k for k in tie])).alias(f"_e{i}") for i, c in enumerate(grid)
    ]
    per = df.groupBy(query).agg(*picks, F.max(tokens).alias("_n"))
    sums = per.agg(F.sum("_n").alias("_n"), *[F.sum(f"_e{i}").alias(f"_e{i}") for i in range(len(grid))])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("coefficient"), (F.col(f"_e{i}") / F.col("_n")).alias("rate")) for i, c in enumerate(grid)])
    best = F.array_min(F.transform("r", lambda x: F.struct(x["rate"].alias("rate"), x["i"].alias("i"))))["i"]
    flat = sums.select(rows.alias("r")).withColumn("b", best).select(F.explode("r").alias("x"), "b")
    return flat.select("x.coefficient", "x.rate", (F.col("x.i") == F.col("b")).alias("best"))


def even_subset(df: DataFrame, domain: str, order: str, key: str, n: int) -> DataFrame:
    """``n`` evenly spread rows per domain with distinct keys where possible.

    Anchors are evenly spaced positions; each takes the nearest row with an unseen key, or else the
    nearest unused row. The choice is greedy, but it can only need, per anchor, the nearest row of
    the ``n`` nearest keys and the ``n`` nearest rows: ``2 n * n`` rows of a domain reach the greedy
    step, whatever its size.
    """
    ranked = number_rows(df.select(domain, order, key), [order], by=[domain], out="_at")
    sizes = ranked.groupBy(domain).agg(F.max("_at").alias("_m"))
    anchors = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        domain, "_i", F.least(F.floor((F.col("_i") + 0.5) * F.col("_m") / n) + 1, F.col("_m")).alias("_a")
    )
    fan = ranked.join(anchors, domain).withColumn("_d", F.abs(F.col("_at") - F.col("_a")))
    nearest = Window.partitionBy(domain, "_i").orderBy("_d", "_at")
    per_key = fan.groupBy(domain, "_i", key).agg(F.min(F.struct("_d", "_at", F.col(order).alias("_o"))).alias("_x"))
    per_key = per_key.select(domain, "_i", key, "_x._d", "_x._at", F.col("_x._o").alias(order))
    top = lambda rows: rows.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= n).drop("_r")
    cand = top(per_key).unionByName(top(fan.drop("_a"))).distinct()
    schema = df.select(domain, order, key).schema

    def choose(pdf):
        import pandas as pd

        used, seen, out = set(), set(), []
        for i in range(n):
            part = pdf[(pdf["_i"] == i) & ~pdf["_at"].isin(used)].sort_values(["_d", "_at"])
            if part.empty:
                continue
            fresh = part[~part[key].isin(seen)]
            row = (fresh if len(fresh) else part).iloc[0]
            used.add(row["_at"])
            seen.add(row[key])
            out.append(row[[domain, order, key]].to_dict())
        return pd.DataFrame(out, columns=[domain, order, key])

    return cand.groupBy(domain).applyInPandas(choose, schema)


def take_negatives(col: str, n: int) -> Column:
    """First ``n`` elements, repeated from the start when there are fewer."""
    return F.when(F.size(col) >= n, F.slice(col, 1, n)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(col, F.pmod(i, F.size(col)) + 1))
    )


def random_subset(col: str, n: int, seed: int, id_col: str) -> Column:
    """Seeded ``n`` elements of an array (all if there are fewer), in draw order."""
    keyed = F.transform(F.col(col), lambda x, i: F.struct(seeded_key(seed, id_col, i).alias("k"), x.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["v"])


def first_positive(col: str) -> Column:
    return F.element_at(col, 1)


def rows_after(df: DataFrame, order: str, n: int) -> DataFrame:
    """Tail of a table: rows after the first ``n``."""
    return number_rows(df, [order]).filter(F.col("row_no") > n).drop("row_no")


