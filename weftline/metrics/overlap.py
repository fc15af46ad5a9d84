"""n-gram and token overlap scores: BLEU, ROUGE, exact match and token F1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.bags import bag_overlap, f1
from weftline.functions.edit import lcs_length
from weftline.functions.scoped import let
from weftline.functions.text import normalize_answer, words
from weftline.functions.tokens import word_ngrams

MAX_ORDER = 4


def tokenize_13a(c: Column) -> Column:
    """The mteval-13a word segmentation used for corpus BLEU."""
    # Ordered replacements.
    out = c
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, repl in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        out = F.regexp_replace(out, pattern, repl)
    return words(out)


@F.arrow_udf(T.ArrayType(T.LongType()))
def ngram_matches(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Clipped n-gram matches of orders 1 to 4, for a whole batch by sorted codes."""
    size = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (ref, hyp)]
    rows, n_ref = len(ref), int(size[0].sum())
    coded = pa.concat_arrays([x.flatten().cast(pa.string()) for x in (ref, hyp)]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.concatenate([np.repeat(np.arange(rows), s) for s in size])
    row[n_ref:] += rows  # rows of hypotheses follow those of references
    gram, counts = code, []
    for n in range(1, MAX_ORDER + 1):
        if n > 1:
            # an n-gram is the code of its first n - 1 words with its last word, if both lie in one text
            whole = row[: len(row) - n + 1] == row[n - 1 :]
            _, gram = np.unique(gram[: len(whole)] * (len(coded.dictionary) + 1) + code[n - 1 :], return_inverse=True)
        else:
            whole = np.ones(len(row), bool)
        owner, width = row[: len(whole)][whole], len(code) + 1
        key, held = np.unique(owner * width + gram[whole], return_counts=True)
        is_ref = key < rows * width
        _, a, b = np.intersect1d(key[is_ref], key[~is_ref] - rows * width, assume_unique=True, return_indices=True)
        shared = np.minimum(held[is_ref][a], held[~is_ref][b])
        counts.append(np.bincount(key[is_ref][a] // width, shared, rows).astype(np.int64))
    flat = np.stack(counts, 1).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * MAX_ORDER), pa.array(flat))


def bleu_counts(ref: Column, hyp: Column) -> dict[str, Column]:
    """Per-row sufficient statistics of corpus BLEU."""
    out = {"ref_len": F.size(ref).cast("long"), "hyp_len": F.size(hyp).cast("long")}
    matches = ngram_matches(ref, hyp)
    for n in range(1, MAX_ORDER + 1):
        out[f"match_{n}"] = matches[n - 1]
        out[f"total_{n}"] = F.greatest(F.size(hyp) - n + 1, F.lit(0)).cast("long")
    return out


def bleu_from_sums() -> Column:
    """BLEU of summed statistics: exponential smoothing of zero orders, 0 if an order has no n-gram."""
    zeros = F.lit(0)
    log_sum = F.lit(0.0)
    for n in range(1, MAX_ORDER + 1):
        m, t = F.col(f"match_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(m == 0, 1).otherwise(0)
        p = F.when(m == 0, 1.0 / (F.pow(F.lit(2.0), zeros) * t)).otherwise(m / t)
        log_sum = log_sum + F.log(p)
    some = F.lit(True)
    for n in range(1, MAX_ORDER + 1):
        some = some & (F.col(f"total_{n}") > 0)
    penalty = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    return F.when(some & (F.col("match_1") > 0), 100 * penalty * F.exp(log_sum / MAX_ORDER)).otherwise(F.lit(0.0))


def corpus_bleu(df: DataFrame, ref: Column, hyp: Column, name: str) -> DataFrame:
    """BLEU per dataset plus the unweighted mean; reference and hypothesis are token arrays."""
    stats = bleu_counts(F.col("_r"), F.col("_h"))
    sums = (
        df.select(F.col(name).alias("name"), ref.alias("_r"), hyp.alias("_h"))
        .select("name", *[c.alias(k) for k, c in stats.items()])
        .groupBy("name")
        .agg(*[F.sum(k).alias(k) for k in stats])
    )
    per = sums.select("name", bleu_from_sums().alias("bleu"))
    return per.unionByName(per.agg(F.lit("mean").alias("name"), F.coalesce(F.avg("bleu"), F.lit(0.0)).alias("bleu")))


def sentence_bleu(df: DataFrame, ref: Column, hyp: Column, out: str = "bleu") -> DataFrame:
    stats = bleu_counts(ref, hyp)
    scored = df.select("*", *[c.alias(k) for k, c in stats.items()])
    return scored.withColumn(out, bleu_from_sums()).drop(*stats)


def rouge_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def _ngram_f(ref: Column, hyp: Column, n: int) -> Column:
    a, b = word_ngrams(ref, n), word_ngrams(hyp, n)
    return let(a, lambda x: let(b, lambda y: f1(bag_overlap(x, y), F.size(y), F.size(x))))


def rouge(df: DataFrame, refs: Column, hyp: Column) -> DataFrame:
    """Add ROUGE-1, -2 and -L (F, times 100) against the reference with the best ROUGE-1.

    ``refs`` is an array of token arrays, ``hyp`` a token array.
    """
    best = F.array_max(
        F.transform(refs, lambda r, i: F.struct(_ngram_f(r, hyp, 1).alias("f"), (-i).alias("first")))
    )
    picked = df.withColumn("_best", best).withColumn("_ref", F.get(refs, -F.col("_best.first"))).withColumn("_hyp", hyp)
    n_ref, n_hyp = F.size("_ref"), F.size("_hyp")
    return picked.withColumns(
        {
            "rouge1": 100 * F.col("_best.f"),
            "rouge2": 100 * _ngram_f(F.col("_ref"), F.col("_hyp"), 2),
            "rougeL": 100 * f1(lcs_length("_ref", "_hyp"), n_hyp, n_ref),
        }
    ).drop("_best", "_ref", "_hyp")


def answer_scores(pred: Column, golds: Column, normalise=normalize_answer) -> tuple[Column, Column]:
    """Exact match and token F1 (0..1), best over the gold answers; no gold means the empty answer.

    F1 is 1 only if both sides are empty, 0 if one is.
    """
    golds = F.when(F.size(golds) > 0, golds).otherwise(F.array(F.lit("")))
    p = normalise(pred)

    def exact(g: Column) -> Column:
        return (normalise(g) == p).cast("double")

    def token_f1(g: Column) -> Column:
        return let(
            words(normalise(g)),
            lambda a: let(
                words(p),
                lambda b: F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
                    f1(bag_overlap(a, b), F.size(b), F.size(a))
                ),
            ),
        )

    return F.array_max(F.transform(golds, exact)), F.array_max(F.transform(golds, token_f1))


def qa_report(scored: DataFrame, has_answer: str) -> DataFrame:
    """Exact match and F1 (percent) overall, for answerable and for unanswerable questions."""
    flat = scored.select(F.explode(F.array(F.lit("all"), F.when(F.col(has_answer), "has_answer").otherwise("no_answer"))).alias("subset"), "exact", "f1")
    return flat.groupBy("subset").agg(
        F.count(F.lit(1)).alias("questions"), (100 * F.avg("exact")).alias("exact"), (100 * F.avg("f1")).alias("f1")
    )


def set_scores(ref: Column, hyp: Column) -> dict[str, Column]:
    """Precision, recall and F1 of deduplicated sets and whether they are equal."""
    both = F.size(F.array_intersect(ref, hyp)).cast("long")
    n_ref, n_hyp = F.size(F.array_distinct(ref)), F.size(F.array_distinct(hyp))
    return {
        "precision": F.when(n_hyp > 0, both / n_hyp).otherwise(F.lit(0.0)),
        "recall": F.when(n_ref > 0, both / n_ref).otherwise(F.lit(0.0)),
        "f1": f1(both, n_hyp, n_ref),
        "joint": ((both == n_ref) & (both == n_hyp)).cast("double"),
    }
