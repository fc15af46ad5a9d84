"""No caps: rows with null groups, long rows, large amounts, mixed widths, empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import edit, text as tx
from weftline.metrics import overlap as ov
from weftline.operators import buckets as bk
from weftline.operators import order as od
from weftline.operators import ordered
from weftline.operators import split as sp
from weftline.operators import stats as st
from weftline.operators import tokenise as op
from weftline.streaming import frames as fr


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(30)], "id long, label string")
    assert sp.stratified_split(df, "id", "label", 0.5, 1).groupBy("label", "split").count().count() == 4
    sizes = {r["label"]: r["count"] for r in sp.rebalance(df, "id", "label", 1).groupBy("label").count().collect()}
    assert sizes == {None: 20, "a": 20}


def test_rare_rows_are_copied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "COPIES", 7)
    df = spark.createDataFrame([(i, "many") for i in range(50)] + [(99, "one")], "id long, label string")
    rows = sp.rebalance(df, "id", "label", 1).filter("label = 'one'").collect()
    assert sorted(r["copy"] for r in rows) == list(range(50))


def test_strings_are_cut_into_buckets(spark):
    rng = random.Random(1)
    tokens = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(20_000)]
    df = spark.createDataFrame([(-1, t) for t in tokens], "n long, token string")
    sizes = df.groupBy(ordered.order_bucket(df, ["n", "token"])).count().agg(F.max("count")).first()[0]
    assert sizes < len(tokens) / 4
    got = [r["token"] for r in ordered.running(df.distinct(), ["n", "token"], row_no="r").orderBy("r").collect()]
    assert got == sorted(set(tokens))


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 2, 500, 101)], "n int")
    assert st.length_histogram(df, F.col("n")).agg(F.sum("rows"), F.max("length")).first() == (5, 499)
    capped = {r["length"]: r["rows"] for r in st.length_histogram(df, F.col("n"), 10).collect()}
    assert capped[11] == 2 and sum(capped.values()) == 5


@pytest.mark.parametrize("text, words", [("$5", "five dollars"), ("$1000000000000000", "one" + " zero" * 15 + " dollars")])
def test_large_amounts(spark, text, words):
    assert spark.range(1).select(tx.english_clean(F.lit(text))).first()[0].strip() == words


def test_pairs_with_many_distinct_words(spark):
    words = [f"w{i}" for i in range(61_100)]
    df = spark.createDataFrame([(words, ["w3", "other", "w60000"])], "r array<string>, h array<string>")
    assert df.select(edit.word_distance(F.col("r"), F.col("h"))).first()[0] == len(words) - 2


def test_vocabulary_over_the_limit(spark, monkeypatch):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token string, id long")
    df = spark.createDataFrame([(["a", "x", "b"],), ([],), (["b"],)], "w array<string>")
    for limit in (10, 1):
        monkeypatch.setattr(op, "MAX_BROADCAST_VOCAB", limit)
        for unk, want in ((0, [[], [1, 0, 2], [2]]), (None, [[], [1, 2], [2]])):
            coded = op.encode_tokens(df, F.col("w"), vocab, unk)
            assert sorted(r["ids"] for r in coded.collect()) == want
        assert sorted(r["text"] for r in op.decode_ids(coded, "ids", vocab, " ").collect()) == ["", "a b", "b"]


def test_rows_over_the_budget_are_refused(spark):
    df = spark.createDataFrame([(1, 5), (2, 101)], "id long, n int")
    with pytest.raises(ValueError):
        od.token_budget_batches(df, "id", "n", 100)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, d double, n long")
    assert od.semi_sorted_batches(df, "d", "id", 4, 2, 0.1, 1).count() == 0
    assert bk.buckets_2d(df, "d", "n", 3, 2).count() == 0
    assert bk.token_buckets_2d(df, "id", "n", 3, 2).count() == 0


def test_buffers_of_mixed_frames(spark):
    rng = random.Random(4)
    rows = [("a", i, s) for i, s in enumerate([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0]])]
    rows += [("b", i, [float(10 * i + k) for k in range(rng.randint(0, 4))]) for i in range(40)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in fr.rolling_buffer(spark.createDataFrame(rows, "s string, n long, x array<double>"), "s", "n", "x", 6).collect()}
    assert got["a", 3] == ([2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 0)
    seen = {"a": [], "b": []}
    for s, n, x in rows:
        seen[s] += x
        want = ([0.0] * 6 + seen[s])[-6:]
        assert got[s, n] == (want, max(0, 6 - len(seen[s])))


def test_ngram_matches_against_counters(spark):
    rng = random.Random(2)
    rows = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "r array<string>, h array<string>").coalesce(1).select(ov.ngram_matches("r", "h")).collect()
    for (r, h), (m,) in zip(rows, got):
        grams = lambda x, n: Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))
        assert m == [sum((grams(r, n) & grams(h, n)).values()) for n in range(1, 5)]


def test_small_datasets_get_samples(spark):
    rows = sp.blend_greedy(spark, [0.9996, 0.0004], [10_000, 10], 20_000).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in rows} == {0: 19_992, 1: 8}
    # weights whose period is as long as a billion positions; the walk is as long as the blend. Position 1 goes
    # to the light dataset: the other has had its sample, so its deficit is below zero
    rows = sp.blend_greedy(spark, [1.0, 1e-9], [10, 10], 100).groupBy("dataset").count().collect()
    assert {r["dataset"]: r["count"] for r in rows} == {0: 99, 1: 1}
    with pytest.raises(ValueError):
        sp.blend_greedy(spark, [1.0, -1.0], [10, 10], 100)


def test_greedy_blend_of_fine_weights(spark, monkeypatch):
    """A weight of a millionth of the others, against the walk; and a longer blend by a rounded period."""
    weights, n = [0.5, 0.499999, 0.000001], 3000
    whole, counts, want = [500_000, 499_999, 1], [0, 0, 0], []
    for i in range(n):
        d = max(range(3), key=lambda k: (whole[k] * max(i, 1) - counts[k] * 1_000_000, -k))
        want.append((i, d, counts[d] % 50))
        counts[d] += 1
    assert [tuple(r) for r in sp.blend_greedy(spark, weights, [50, 50, 50], n).orderBy("idx").collect()] == want
    monkeypatch.setattr(sp, "MOST_PERIOD", 1000)
    rows = sp.blend_greedy(spark, weights, [50, 50, 50], n).groupBy("dataset").count().collect()
    assert {r["dataset"] for r in rows} == {0, 1, 2}
    assert sum(r["count"] for r in rows) == n
