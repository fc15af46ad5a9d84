import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language, ordinal, queries


def test_cumulative_link_recovers_thresholds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2))
    s = x @ [1.5, -1.0] + rng.logistic(size=4000)
    grade = np.digitize(s, [-1.0, 1.5])
    row, at = np.divmod(np.arange(8000), 2)
    w, theta = ordinal.fit_cumulative(at, x.ravel(), row, grade, 3, steps=600, ridge=0.0)
    assert w == pytest.approx([1.5, -1.0], abs=0.15)
    assert theta == pytest.approx([-1.0, 1.5], abs=0.15)


def test_held_out_grades(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    ratings = ordinal.graded(labels)
    train = ratings.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 0)
    rated = ordinal.rate(docs, train).join(ratings.subtract(train), "doc_id").collect()
    right = [r["kept"] == (r["grade"] == 2) for r in rated]
    assert len(right) > 80 and np.mean(right) > 0.85


def test_classifier_on_odd_rows(spark, odd, empty):
    ratings = spark.createDataFrame([(3, 2), (8, 0), (8, 1), (None, 1), (1, None)], "doc_id long, grade int")
    out = ordinal.rate(odd, ratings)
    assert out.count() == 10
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail_probability"] <= 1 for r in out.collect())
    assert ordinal.select(odd, ratings).columns == odd.columns
    assert ordinal.rate(odd, ratings.limit(0)).filter("kept").count() == 10
    assert ordinal.rate(empty, ratings).count() == 0


def test_kneser_ney_against_plain_sums(docs_of):
    words = {"a": "abba abab baba abba", "b": "bbbb cab cab"}
    model = language.fit(docs_of([(i, t, lang) for i, (lang, t) in enumerate(words.items())]), order=3).read()
    assert model.langs == ("a", "b")
    for j, text in enumerate(words.values()):
        raw, grams = {}, {}
        for w in text.split():
            w = f"\x02{w}\x02"
            for e in range(2, len(w) + 1):
                g = w[max(0, e - 3) : e]
                raw[g] = raw.get(g, 0) + 1
        grams[3] = {g: n for g, n in raw.items() if len(g) == 3}
        for k in (2, 1):
            grams[k] = {g: n for g, n in raw.items() if len(g) == k}
            for g in grams[k + 1]:
                grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1

        def p(ctx, c):
            k = len(ctx) + 1
            lower = p(ctx[1:], c) if ctx else 1 / language.ALPHABET
            n1, n2 = (sum(n == x for n in grams[k].values()) for x in (1, 2))
            d = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))
            after = {g: n for g, n in grams[k].items() if g[:-1] == ctx}
            if not after:
                return lower
            total = sum(after.values())
            return max(after.get(ctx + c, 0) - d, 0) / total + d * len(after) / total * lower

        for word in ("abba", "cab", "zz"):
            w = f"\x02{word}\x02"
            want = -sum(np.log2(p(w[max(0, e - 3) : e - 1], w[e - 1])) for e in range(2, len(w) + 1))
            cost = model.word_cost(["other", word])[1]
            assert cost[-1] == len(word) + 1
            assert cost[j] == pytest.approx(want, rel=1e-4)


def test_held_out_languages(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    rows = queries.op3_language_id(spark, folder).filter("held_out").collect()
    known = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if truth[r["doc_id"]]]
    assert np.mean(known) > 0.95
    assert np.mean([r["rejected"] for r in rows]) < 0.1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    half = language.identify(docs, F.lit(True), keep=0.5).collect()
    assert 0.2 < np.mean([r["rejected"] for r in half]) < 0.8


def test_language_of_odd_rows(odd, empty):
    rows = language.identify(odd, F.lit(True)).collect()
    got = [(r["doc_id"], r["lang_pred"]) for r in rows]
    assert len(got) == 10 and {(5, "und"), (1, "und"), (2, "und"), (9, "de"), (3, "en")} <= set(got)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in language.identify(odd, F.lit(False)).collect()} == {"und"}
    assert language.identify(empty, F.lit(True)).count() == 0


def test_models_too_large_to_read_are_joined(spark, odd, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    answer = lambda df: {(r["doc_id"], r["lang_pred"], r["rejected"], round(r["score"], 5), r["cross_entropy"] and round(r["cross_entropy"], 4)) for r in df.collect()}
    want = [answer(language.identify(d, F.lit(True), keep=0.7)) for d in (docs, odd)]
    monkeypatch.setattr(language, "CELLS", 0)
    assert [answer(language.identify(d, F.lit(True), keep=0.7)) for d in (docs, odd)] == want


def test_ngrams_of_any_letters():
    grams = ["a", "ab", "\U00020000b", "\u0000b", "\x02ab\x02", "", "ba"]
    assert len(set(language.gram_hashes(grams).tolist())) == len(grams)
    marked, owner, place, at, hashes = language._grams(["ab", "\U00020000"], 3)
    want = language.gram_hashes([marked[e - 1 : e + 1] for e in at])
    assert hashes[2][at].tolist() == want.tolist()


def test_every_training_text_is_learned_from(docs_of):
    # languages of one text each, with letters of their own; some texts lie in the fold that calibrates
    rows = [(i, " ".join(chr(0x4E00 + 40 * i + (k * k + k // 7) % 40) * 2 for k in range(60)), f"l{i}") for i in range(40)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs_of(rows), F.lit(True)).collect()}
    assert got == {i: f"l{i}" for i in range(40)}
