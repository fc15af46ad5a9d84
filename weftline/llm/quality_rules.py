"""Quality rules with adaptive thresholds: quantile sketches per language and source, then a join.

Every metric of a text is an integer rate. Its distribution inside a (language, source) group is a
log-linear bucket sketch: exact below 32, then 16 buckets per power of two (6 % relative error). Sketches
merge by adding counts, so the sketch of a language or of the whole corpus is the sum of those of its
sources, and the result does not depend on how rows were dealt out.

The quantiles of a group are drawn towards those of its language, and these towards those of the corpus, as
if ``prior`` more texts had come from there: a group of a few texts takes its language's, a large one its
own, without a step between. A metric is refused outside [q10 - w, q90 + v] with w = spread * (q50 - q10) and
v = spread * (q90 - q50). Quantiles are bucket edges and distances are rounded up to whole buckets; one
symbol or one repeated line alone never refuses a text.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scoped import let
from weftline.llm.common import SPACE, cut_lineage, salted_join, word_list

PPM = 1_000_000
#: metric -> (rate from feature columns, case that no upper limit refuses)
METRICS: dict[str, tuple[str, str]] = {
    "symbol_ppm": (f"n_symbols * {PPM} div greatest(word_chars, 1)", "n_symbols <= 1"),
    "line_ppm": (f"n_dup_lines * {PPM} div greatest(n_lines, 1)", "n_dup_lines <= 1"),
    "word_milli": ("word_chars * 1000 div greatest(n_words, 1)", "false"),
}
#: Fences stand so many distances between the median and the outer tenth beyond that tenth.
SPREAD = 3
#: Weight of the language in a group's quantiles, and of the corpus in a language's, in texts.
PRIOR = 50
WINDOW = 5


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more (compared by 64-bit digests)."""

    def covered(win: Column) -> Column:
        tagged = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        def reach(p: Column) -> Column:
            own = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(tagged, repeats), reach)

    def windows(h: Column) -> Column:
        inner = F.slice(h, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(0)))
        return F.transform(inner, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))

    digests = F.transform(words, lambda w: F.xxhash64(w))
    judged = lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win))
    return let(let(digests, windows), judged)


def text_features(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, ``by`` and the counts of every text; a null text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    read = docs.select(
        "doc_id",
        *by,
        word_list(text).alias("_words"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("_lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("_symbols"),
    )
    return read.select(
        "doc_id",
        *by,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_lines.again").cast("long").alias("n_dup_lines"),
        F.col("_lines.n").cast("long").alias("n_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def _bucket(v: str) -> Column:
    return F.expr(f"if({v} < 32, {v}, (length(bin({v})) - 5) * 16L + shiftright({v}, length(bin({v})) - 5))")


def _floor(b: str) -> Column:
    """Least value of a bucket."""
    return F.expr(f"if({b} < 32, {b}, shiftleft({b} % 16 + 16, cast({b} div 16 - 1 as int)))")


def thresholds(features: DataFrame, by: tuple[str, str] = ("_lang", "_source"), prior: int = PRIOR, spread: int = SPREAD) -> DataFrame:
    """(lang, source, and low_/high_ of every metric) for every (lang, source) pair.

    ``by`` columns must not be null. Sketches: one partial aggregation over (group, metric, bucket).
    """
    lang, source = by
    # a metric at a time would read the features three times
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(rate).cast("long").alias("v")) for m, (rate, _) in METRICS.items()]))
    sketch = features.select(*by, entries.alias("e")).select(*by, "e.metric", _bucket("e.v").alias("bucket"))
    sketch = cut_lineage(sketch.groupBy(*by, "metric", "bucket").agg(F.count(F.lit(1)).alias("n")))
    ends = ("q10", "q50", "q50_top", "q90")

    def quantiles(keys: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*keys, "metric").orderBy("bucket")
        merged = merged.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "metric")))
        at = lambda tenth: F.min(F.when(F.col("upto") * 10 >= F.col("all") * tenth, F.col("bucket")))
        q = merged.groupBy(*keys, "metric").agg(F.max("all").alias("all"), at(1).alias("b1"), at(5).alias("b5"), at(9).alias("b9"))
        q = q.withColumn("b6", F.col("b5") + 1).withColumn("b10", F.col("b9") + 1)
        edges = (_floor("b1").alias("q10"), _floor("b5").alias("q50"), (_floor("b6") - 1).alias("q50_top"), (_floor("b10") - 1).alias("q90"))
        return q.select(*keys, "metric", F.struct("all", *edges).alias(name))

    def drawn(own: Column, to: Column) -> Column:
        """Quantiles of ``own`` drawn towards ``to``."""
        value = lambda c: F.floor((own["all"] * own[c] + prior * to[c]) / (own["all"] + prior)).cast("long")
        return F.struct(own["all"].alias("all"), *[value(c).alias(c) for c in ends])

    corpus = F.broadcast(quantiles([], "corpus"))  # a row per metric
    langs = quantiles([lang], "per_lang").join(corpus, "metric").select(lang, "metric", drawn(F.col("per_lang"), F.col("corpus")).alias("to"))
    q = quantiles([lang, source], "own").join(langs, [lang, "metric"]).select(*by, "metric", drawn(F.col("own"), F.col("to")).alias("q")).select(*by, "metric", "q.*")
    low = F.col("q10") - (F.col("q50_top") - F.col("q10")) * spread
    high = F.col("q90") + (F.col("q90") - F.col("q50")) * spread
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return q.groupBy(*by).agg(*[of(m, c).alias(f"{e}_{m}") for m in METRICS for e, c in (("low", low), ("high", high))])


def judge(docs: DataFrame, prior: int = PRIOR, spread: int = SPREAD) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``.

    Null languages and sources are groups of their own. Rows that fail the fixed base rules stay out of
    the sketches. Without any passing row there are no thresholds and nothing is kept. Repeated rows get
    the same answer; an empty table gives an empty table.
    """
    named = lambda c: F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(c).cast("string")))
    features = text_features(docs).withColumn("_lang", named("lang")).withColumn("_source", named("source")).drop("lang", "source")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    features = cut_lineage(features.withColumn("base_failed", failed))
    limits = thresholds(features.filter(~F.col("base_failed")), prior=prior, spread=spread)
    inside = F.lit(True)
    for m, (rate, allowed) in METRICS.items():
        inside = inside & (F.expr(rate) >= F.col(f"low_{m}")) & (F.expr(allowed) | (F.expr(rate) <= F.col(f"high_{m}")))
    verdict = F.coalesce(inside, F.lit(False)) & ~F.col("base_failed")
    joined = salted_join(features, limits, ["_lang", "_source"], "doc_id", "left").withColumn("kept", verdict)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
