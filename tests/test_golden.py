"""Golden rows and brute-force comparisons on small fixtures."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import edit, text as tx, tokens as tk
from weftline.metrics import dialogue as dg
from weftline.metrics import errors as er
from weftline.metrics import overlap as ov
from weftline.operators import buckets as bk
from weftline.operators import filters as fl
from weftline.operators import joins as jn
from weftline.operators import neighbours as nb
from weftline.operators import order as od
from weftline.operators import shape as sh
from weftline.operators import split as sp
from weftline.operators import tokenise as op
from weftline.sources import importers as im
from weftline.sources import manifest as mf
from weftline.streaming import state as ss


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()["x"]


# ------------------------------------------------------------------ text

@pytest.mark.parametrize(
    "raw, want",
    [
        ("The Cat, a dog!", "cat dog"),
        ("an  apple", "apple"),
        ("Théâtre", "théâtre"),
    ],
)
def test_normalize_answer(spark, raw, want):
    assert one(spark, raw, tx.normalize_answer) == want


@pytest.mark.parametrize("raw, want", [("10 20", "one zero two zero"), ("0 cats", "cats"), ("a007", "a007"), ("007", "seven")])
def test_digits_to_words(spark, raw, want):
    assert one(spark, raw, tx.digits_to_words) == want


@pytest.mark.parametrize(
    "n, want",
    [
        (0, "zero"), (13, "thirteen"), (21, "twenty one"), (100, "one hundred"), (105, "one hundred and five"),
        (1000, "one thousand"), (1005, "one thousand and five"), (1234, "one thousand two hundred and thirty four"),
        (1000000, "one million"), (999999999, "nine hundred and ninety nine million nine hundred and ninety nine thousand nine hundred and ninety nine"),
    ],
)
def test_number_words(spark, n, want):
    assert spark.range(1).select(tx.number_words(F.lit(n)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Mr. Smith paid $5.50", "mister smith paid five dollars and fifty cents"),
        ("at 10:30pm", "at ten thirty pm"),
        ("the 21st & 3rd", "the twenty first and third"),
        ("50% off", "fifty percent off"),
        ("1 000 cafés", "one thousand cafes"),
        ("3.14", "three point one four"),
    ],
)
def test_english_clean(spark, raw, want):
    assert one(spark, raw, tx.english_clean) == want


def test_sentences_keep_abbreviations(spark):
    got = one(spark, 'Dr. Who came. He left! "Why?" Nobody knows.', tx.split_sentences)
    assert got[0] == "Dr. Who came."
    assert "He left!" in got


def test_comma_pieces_merge(spark):
    got = one(spark, "well, yes, we went to the sea today, and it was cold there.", lambda c: tx.split_sentences(c, extra=[","]))
    assert all(len(s.split()) > 2 for s in got)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The answer is B.", "B"), ("c", "C"), ("d) because", "D"), ("I would choose option a", "A"), ("no idea", None),
        ("答案是c", "C"), ("<1> b", "B"), ("is it (A)?", "A"),
    ],
)
def test_extract_choice(spark, raw, want):
    assert one(spark, raw, tx.extract_choice) == want


def test_template_errors():
    with pytest.raises(ValueError):
        tx.render_template("{a} {b", ["a", "b"])
    with pytest.raises(ValueError):
        tx.render_template("{zzz}", ["a"])


def test_stamped_words(spark):
    got = one(spark, "<|0|> hi <|3|> <|4|> there <|9|>", lambda c: tx.stamped_words(c, 0.08))
    assert [(r["word"], r["start_offset"], r["end_offset"]) for r in got] == [("hi", 0, 3), ("there", 4, 9)]
    assert one(spark, " no marks ", tx.stamped_plain) == "no marks"


def test_byte_round_trip(spark):
    assert one(spark, "héß中", lambda c: tk.byte_text(tk.byte_ids(c))) == "héß中"


def test_label_and_slots(spark):
    got = one(spark, "intent: book slots: city(rome), day(monday)", tx.label_and_slots)
    assert got["label"] == "book" and got["slots"] == ["city(rome)", "day(monday)"]


# ------------------------------------------------------------------ edit distance

def brute(r, h):
    """(distance, most substitutions among the best alignments)."""
    best = {(0, 0): (0, 0)}
    for i in range(len(r) + 1):
        for j in range(len(h) + 1):
            if i == j == 0:
                continue
            options = []
            if i and j:
                c, s = best[i - 1, j - 1]
                options.append((c + (r[i - 1] != h[j - 1]), s - (r[i - 1] != h[j - 1])))
            if i:
                options.append((best[i - 1, j][0] + 1, best[i - 1, j][1]))
            if j:
                options.append((best[i, j - 1][0] + 1, best[i, j - 1][1]))
            best[i, j] = min(options)
    c, s = best[len(r), len(h)]
    return c, -s


def lcs(a, b):
    return max((n for n in range(min(len(a), len(b)) + 1) for c in itertools.combinations(range(len(a)), n) if subsequence([a[i] for i in c], b)), default=0)


def subsequence(x, y):
    it = iter(y)
    return all(c in it for c in x)


def test_edit_parts_against_brute_force(spark):
    rnd = random.Random(0)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 7))], [rnd.choice("abcde") for _ in range(rnd.randint(0, 7))]) for _ in range(150)]
    df = spark.createDataFrame(rows, "r array<string>, h array<string>")
    out = df.select("r", "h", edit.word_distance(F.col("r"), F.col("h")).alias("d"), edit.edit_parts("r", "h").alias("p"), edit.lcs_length("r", "h").alias("l"), edit.correct_marks("r", "h").alias("m")).collect()
    for row in out:
        d, subs = brute(row["r"], row["h"])
        p = row["p"]
        assert row["d"] == d == p["errors"] == p["insertions"] + p["deletions"] + p["substitutions"]
        assert p["substitutions"] == subs
        assert len(row["h"]) - len(row["r"]) == p["insertions"] - p["deletions"]
        assert row["l"] == lcs(row["r"], row["h"])
        assert sum(row["m"]) == len(row["h"]) - p["substitutions"] - p["insertions"]


def test_code_points_skip_the_surrogates(spark):
    """Word numbers around the surrogate block still give one code unit each."""
    vocab = [f"w{i}" for i in range(56000)]
    df = spark.createDataFrame([(vocab, vocab[54990:55050])], "v array<string>, t array<string>")
    n, d = df.select(F.length(edit._coded(F.col("t"), F.col("v"))), F.size(F.array_distinct(F.split(edit._coded(F.col("t"), F.col("v")), "")))).first()
    assert n == 60 and d == 60


def test_error_rates_edges(spark):
    df = spark.createDataFrame([([], ["a"]), ([], []), (["a"], [])], "r array<string>, h array<string>")
    got = [r["wer"] for r in er.row_error_rate(df).collect()]
    assert sorted(got) == [0.0, 1.0, math.inf]
    none = er.error_rate(er.score_words(df.limit(0)))
    assert none.first()["wer"] == math.inf


# ------------------------------------------------------------------ overlap

def test_bleu_golden(spark):
    rows = [("one", "a b c d", "a b c d"), ("two", "a b c", "a b d")]
    df = spark.createDataFrame(rows, "name string, r string, h string").select("name", F.split("r", " ").alias("r"), F.split("h", " ").alias("h"))
    got = {r["name"]: round(r["bleu"], 6) for r in ov.corpus_bleu(df, F.col("r"), F.col("h"), "name").collect()}
    assert got == {"one": 100.0, "two": 0.0, "mean": 50.0}


def test_rouge_picks_best_reference(spark):
    df = spark.createDataFrame([([["x", "y"], ["a", "b", "c"]], ["a", "c"])], "refs array<array<string>>, h array<string>")
    row = ov.rouge(df, F.col("refs"), F.col("h")).first()
    assert row["rouge1"] == pytest.approx(80.0) and row["rougeL"] == pytest.approx(80.0) and row["rouge2"] == 0.0


def test_answer_scores_empty(spark):
    df = spark.createDataFrame([("", []), ("x", []), ("the cat", ["cat", "dog"])], "p string, g array<string>")
    exact, f1 = ov.answer_scores(F.col("p"), F.col("g"))
    got = [(r["e"], r["f"]) for r in df.select(exact.alias("e"), f1.alias("f")).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0), (1.0, 1.0)]


def test_punctuation_golden(spark):
    df = spark.createDataFrame([("Hi, dear! Nice to see you. What's", "Hi dear! Nice to see you! What's?")], "r string, h string")
    ops = dg.punctuation_operations(df, "r", "h")
    got = {r["mark"]: tuple(r)[1:] for r in ops.collect()}
    assert got == {".": (0, 0, 0, 1), ",": (0, 1, 0, 0), "!": (1, 0, 0, 0), "?": (0, 0, 1, 0)}
    rates = dg.punctuation_error_rate(ops).first()
    assert tuple(rates) == (0.25, 0.25, 0.25, 0.25, 0.75)


# ------------------------------------------------------------------ buckets

# Buckets and maximum ratios of the truth table.
BUCKETS = [(5, 10), (5, 20), (10, 15), (10, 30)]


def naive_bucket(x, y, strict, ratio=None):
    if not strict:
        return next((i for i, (a, b) in enumerate(BUCKETS) if x <= a and y <= b), None)
    dim = next((a for a, _ in BUCKETS if x <= a), None)
    hit = next((i for i, (a, b) in enumerate(BUCKETS) if a == dim and y <= b), None)
    if hit is not None and ratio and y / x > ratio[hit]:
        return None
    return hit


@pytest.mark.parametrize("strict, ratio", [(True, None), (False, None), (True, [4, 4, 3, 3])])
def test_bucket_truth_table(spark, strict, ratio):
    rows = [(float(x), y) for x in (1, 3, 5, 5.5, 8, 10, 10.5, 11) for y in (1, 5, 10, 11, 15, 16, 20, 21, 29, 30, 31)]
    df = spark.createDataFrame(rows, "x double, y int")
    got = df.select("x", "y", bk.bucket_of(BUCKETS, F.col("x"), F.col("y"), strict, ratio).alias("b")).collect()
    for r in got:
        assert r["b"] == naive_bucket(r["x"], r["y"], strict, ratio), r


def naive_bounds(values, n):
    share, tot, out = sum(values) / n, 0, []
    for v in sorted(values):
        if tot > share:
            out.append(v)
            tot = 0
        tot += v
    return out


@pytest.mark.parametrize("n", [2, 3, 7])
def test_bounds_against_loop(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([1, 2, 2, 2, 9, 30, rnd.randint(1, 50)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert bk.equal_mass_bounds(df, "v", n) == naive_bounds(values, n)
    hist = [(v, values.count(v)) for v in set(values)]
    assert bk.fold_bounds(hist, n) == naive_bounds(values, n)


def test_merge_bounds():
    assert bk.merge_bounds([5, 20, 30, 30, 30], 40) == [(5, 1), (20, 1), (30, 3), (40, 1)]
    assert bk.merge_bounds([5, 40], 40) == [(5, 1), (40, 2)]


# ------------------------------------------------------------------ packing

def naive_first_fit(lengths, size):
    bins, out = [], []
    for n in lengths:
        at = next((i for i, used in enumerate(bins) if used + n <= size), None)
        if at is None:
            bins.append(0)
            at = len(bins) - 1
        bins[at] += n
        out.append(at)
    return out


def test_first_fit_tree_equals_scan():
    rnd = random.Random(1)
    for _ in range(30):
        lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 80))]
        assert sh._first_fit(np.array(lengths), 64).tolist() == naive_first_fit(lengths, 64)


@pytest.mark.parametrize("method", ["sequential", "first_fit_shuffle", "first_fit_decreasing"])
def test_pack_conservation(spark, method):
    df = spark.range(2000).withColumn("n", F.col("id") % 97 + 1)
    packed = sh.pack_chunks(df, "id", "n", 128, method, seed=3, chunk_rows=500)
    assert packed.count() == 2000 and packed.select("id").distinct().count() == 2000
    assert packed.groupBy("chunk", "bin").agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0] <= 128
    with pytest.raises(Exception, match="does not fit"):
        sh.pack_chunks(df, "id", "n", 50, method).count()


def test_token_batches_against_loop(spark):
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 40) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    got = {r["id"]: r["batch"] for r in od.token_budget_batches(df, "id", "n", 100).collect()}
    batch, filled = 0, 0
    for i, n in sorted(enumerate(lengths), key=lambda x: (x[1], x[0])):
        if filled and n * (filled + 1) > 100:
            batch, filled = batch + 1, 0
        filled += 1
        assert got[i] == batch


def test_chat_mask(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "bot", "yo")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = sh.chat_targets(df, "conv", "turn", tk.byte_ids, ["user"], [10]).first()
    text = bytes(got["input_ids"]).decode()
    learned = "".join(c for c, m in zip(text, got["mask"]) if m)
    assert learned == "yo\n"


def test_split_ends():
    assert sp.split_ends("949,50,1", 1000) == (949, 999)
    assert sp.split_ends("8/1/1", 11) == (9, 10)
    for spec in ("80/20", "1", "0,0,0"):
        with pytest.raises(ValueError):
            sp.split_ends(spec, 11)


def test_blend_stride_repeats_one_sample(spark):
    rows = [tuple(r) for r in sp.blend_stride(spark, [1, 1, 1], [1000] * 3, 200).orderBy("idx").collect()]
    assert len(rows) == 200
    last = [s for _, d, s in rows if d == 2]
    assert last == [*range(33), 32, *range(34, 67), 66]


def test_blend_greedy_matches_walk(spark):
    weights, sizes, n = [0.55, 0.25, 0.2], [7, 5, 3], 2500
    counts, want = [0, 0, 0], []
    for i in range(n):
        d = max(range(3), key=lambda k: (round(weights[k] * 1000) * max(i, 1) - counts[k] * 1000, -k))
        want.append((i, d, counts[d] % sizes[d]))
        counts[d] += 1
    got = [tuple(r) for r in sp.blend_greedy(spark, weights, sizes, n).orderBy("idx").collect()]
    assert got == want


# ------------------------------------------------------------------ sources

def test_manifest_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"audio_filepath": "x.wav", "duration": 1.5, "text": "hi"}\n\n{"audio_filepath": "/y.wav", "duration": 2}\n')
    (tmp_path / "b.json").write_text('{"context": "z.wav", "context_duration": 3.0, "normalized_text": "n"}\n')
    df = mf.read_manifest(spark, str(tmp_path))
    rows = sorted(mf.resolve_paths(mf.normalize_manifest(df), "/base/").collect(), key=lambda r: r["id"])
    assert [(r["id"], r["audio_file"], r["duration"], r["text"]) for r in rows] == [
        (0, "/base/x.wav", 1.5, "hi"), (2, "/y.wav", 2.0, ""), (3, "/base/z.wav", 3.0, "n"),
    ]
    (tmp_path / "c.json").write_text("{broken\n")
    with pytest.raises(mf.ManifestError, match="c.json: 1"):
        mf.read_manifest(spark, str(tmp_path))
    assert mf.read_manifest(spark, str(tmp_path), on_error="quarantine").filter("malformed").count() == 1


def test_missing_duration_raises(spark):
    df = spark.createDataFrame([("x",)], "audio_filepath string")
    with pytest.raises(Exception, match="without duration"):
        mf.normalize_manifest(df).collect()


@pytest.mark.parametrize("kind", ["jsonl", "csv", "tsv", "json"])
def test_load_any(spark, tmp_path, kind):
    path = str(tmp_path / f"f.{kind}")
    body = {"jsonl": '{"prompt": "a", "n": 1}\n{"prompt": null, "n": 2}\n', "json": '[{"prompt": "a", "n": 1}, {"prompt": null, "n": 2}]', "csv": "prompt,n\na,1\n,2\n", "tsv": "prompt\tn\na\t1\n\t2\n"}[kind]
    open(path, "w").write(body)
    assert sorted((r["prompt"], r["n"]) for r in mf.load_any(spark, path).collect()) == [("", "2"), ("a", "1")]


def test_shards_round_trip(spark, tmp_path):
    index = mf.write_shards(spark.range(25).withColumn("offset", F.lit(1.0)), str(tmp_path / "s"), ["id"], 10)
    assert {r["shard_id"]: r["rows"] for r in index.collect()} == {0: 10, 1: 10, 2: 5}
    back = mf.select_shards(spark.read.parquet(str(tmp_path / "s/data")), "1:3")
    assert back.count() == 15 and "offset" not in back.columns


def test_prepared_sink_never_overwrites(spark, tmp_path):
    df = spark.range(10)
    mf.write_prepared(df, str(tmp_path / "p"), train=F.col("id") < 8)
    assert spark.read.json(str(tmp_path / "p_val")).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        mf.write_prepared(df, str(tmp_path / "p"), train=F.col("id") < 8)


def test_write_predictions(spark, tmp_path):
    df = spark.createDataFrame([("d1", ["a", "b", "c"], 2)], "dataset string, tokens array<string>, n int")
    mf.write_predictions(mf.prediction_rows(df, "tokens", F.col("n")), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).first()["tokens"] == ["a", "b"]


def test_ctm_stretch(spark):
    df = spark.createDataFrame([("u", [("a b", 1.0, 1.01), ("<b>", 2.0, 3.0), ("c", -1.0, -1.0)])], "u string, s array<struct<text:string,start:double,end:double>>")
    rows = mf.ctm_rows(df, "s", "u", min_dur=0.1).collect()
    assert [r["line"] for r in rows] == ["u 1 0.96 0.10 a<space>b NA lex NA"] or [r["line"] for r in rows] == ["u 1 0.95 0.10 a<space>b NA lex NA"]


def test_iob_cut(spark):
    lines = [(i, w, l) for i, (w, l) in enumerate([("a", "B"), ("b", "O"), ("c", "B"), ("d", "I"), ("e", "O"), ("", "")])]
    df = spark.createDataFrame(lines, "n long, w string, l string")
    rows = im.iob_to_sentences(df, "n", "w", "l", max_length=3).orderBy("part").collect()
    assert [r["words"] for r in rows] == [["a", "b"], ["c", "d", "e"]]


def test_kaldi_offset_column(spark):
    seg = spark.createDataFrame([("s1", "w", 0.0, 1.23456)], "label string, wav_label string, offset double, end double")
    wav = spark.createDataFrame([("w", "p.wav")], "wav_label string, audio_filepath string")
    txt = spark.createDataFrame([("s1", "hi")], "label string, text string")
    out = im.kaldi_to_manifest(seg, wav, txt)
    assert out.columns == ["label", "audio_filepath", "duration", "text"] and out.first()["duration"] == 1.235


# ------------------------------------------------------------------ filters and joins

def test_unformatted_rows_raise(spark):
    df = spark.createDataFrame([(None, 4), (1.0, None)], "duration double, input_length int")
    assert fl.filter_tokens(df, 1, 5).count() == 2
    bad = spark.createDataFrame([(None, None)], "duration double, input_length int")
    with pytest.raises(Exception, match="without token counts"):
        fl.filter_tokens(bad, 1, 5).collect()


def test_positional_zip_checks_length(spark):
    a = spark.range(3).select("id", F.lit("x").alias("s"))
    b = spark.range(4).select("id", F.lit("y").alias("t"))
    with pytest.raises(Exception, match="differ in length"):
        jn.positional_zip(a, b, "id").collect()


def test_frame_mask_unknown_speaker(spark):
    df = spark.createDataFrame([(1, 9, 0.0, 1.0)], "w int, spk int, start double, end double")
    with pytest.raises(Exception, match="outside the mask"):
        jn.frame_mask(df, ["w"], "spk", 10.0, F.lit(5), 4).collect()
    assert jn.frame_mask(df, ["w"], "spk", 10.0, F.lit(5), 4, skip_unknown=True).count() == 0
    ok = spark.createDataFrame([(1, 0, 0.2, 9.0), (1, 0, 0.31, 0.32)], "w int, spk int, start double, end double")
    assert jn.frame_mask(ok, ["w"], "spk", 10.0, F.lit(5), 4).count() == 3


def test_overlap_join_has_no_duplicates(spark):
    rnd = random.Random(2)
    seg = [(i, "r", s, s + rnd.random() * 50) for i, s in enumerate(rnd.random() * 100 for _ in range(80))]
    win = [(j, "r", s, s + 30) for j, s in enumerate(rnd.random() * 100 for _ in range(20))]
    a = spark.createDataFrame(seg, "id int, rec string, start double, end double")
    b = spark.createDataFrame(win, "window_id int, rec string, start_after double, end_before double")
    got = sorted((r["id"], r["window_id"]) for r in jn.overlap_join(a, b, "rec", 7.0).collect())
    want = sorted((i, j) for i, _, s, e in seg for j, _, lo, hi in win if s < hi + 0.001 and e > lo + 0.001)
    assert got == want


def test_knn_paths_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=6).tolist(), int(i) % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [sorted(map(tuple, nb.knn(df, df, 4, exclude_same="label", block=17, max_broadcast=b).select("qid", "nid", "rank").collect())) for b in (0, 1 << 30)]
    assert got[0] == got[1]
    mat = np.array([r[1] for r in rows])
    for qid, nid, rank in got[0]:
        s = np.where(np.arange(120) % 3 == qid % 3, -np.inf, mat @ mat[qid])
        assert nid == np.argsort(-s, kind="stable")[rank - 1]


def test_approximate_knn_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 5
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8)).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    pairs = lambda d: {(r["qid"], r["nid"]) for r in d.collect()}
    exact = pairs(nb.knn(df, df, 5, metric="l2"))
    near = pairs(nb.approximate_knn(df, df, 5, 6, 2, seed=1, metric="l2", block=40))
    assert len(exact & near) / len(exact) > 0.9
    near = pairs(nb.approximate_knn(df, df, 5, 6, 4, seed=1, block=40, parts=4))
    exact = pairs(nb.knn(df, df, 5))
    assert len(exact & near) / len(exact) > 0.9


def test_synonym_pairs_are_distinct(spark):
    df = spark.range(7).select("id", F.lit("c").alias("concept"), F.col("id").cast("string").alias("name"))
    rows = jn.synonym_pairs(df, "id", "concept", "name", 1000, 1, 0.5).collect()
    assert len({frozenset((r["id_1"], r["id_2"])) for r in rows}) == len(rows) == 21


def test_even_subset_prefers_new_keys(spark):
    df = spark.range(1000).select(F.lit("d").alias("domain"), "id", F.when(F.col("id") < 900, "a").otherwise(F.col("id").cast("string")).alias("key"))
    rows = od.even_subset(df, "domain", "id", "key", 4).collect()
    assert len(rows) == 4 and len({r["key"] for r in rows}) == 4


def test_encode_paths_agree(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, []), (3, ["b"])], "id long, t array<string>")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    for unk in (0, None):
        fast = {r["id"]: r["ids"] for r in op.encode_tokens(df, F.col("t"), vocab, unk, key=["id"]).collect()}
        slow = {r["id"]: r["ids"] for r in op._encode_by_join(df, F.col("t"), vocab, unk, "ids", ["id"]).collect()}
        assert fast == slow
    coded = op.encode_tokens(df, F.col("t"), vocab, None)
    assert {r["id"]: r["text"] for r in op.decode_ids(coded, "ids", vocab, "-").collect()} == {1: "a-b", 2: "", 3: "b"}


def test_int_code_nearest_and_nan(spark):
    df = spark.createDataFrame([(3,), (7,), (13,), (None,)], "v int")
    code = op.IntCode("v", 2, 0, base=10, fill_all=False).fit(df)
    out = {r["v"]: r["c"] for r in df.select("v", code.encode().alias("c")).collect()}
    assert out[3] == [code.start_id + 2, 0] and out[None][0] == code.end_id - 1
    back = {r["v"]: r["d"] for r in df.filter("v is not null").select("v", code.decode(code.encode()).alias("d")).collect()}
    assert back == {3: 3, 7: 7, 13: 13}


# ------------------------------------------------------------------ stream state

def test_append_chunk_rules():
    state, new, at = ss.append_chunk(ss.EMPTY, [1, 2, 3], [0.0, 1.0, 2.0], False)
    assert new == [1, 2, 3]
    state, new, at = ss.append_chunk(state, [2, 3, 4], [1.5, 2.5, 3.5], False)
    assert new == [4] and at == [3.5]
    far, new, _ = ss.append_chunk(state, [4, 9], [30.0, 31.0], False)
    assert new == [4, 9]
    state, new, at = ss.append_chunk(state, [7], [1.0], True)
    assert at == [4.5]
    state, new, _ = ss.append_chunk(state, [7, 8], [5.0, 6.0], False)
    assert new == [8]
    state, new, _ = ss.append_chunk(state, [], [], False)
    assert new == [] and state[3] == -1


def test_merge_tail_strips_mark(spark):
    df = spark.createDataFrame([(("hello.", 0.0, 1.0, 0.5), ("ing", 1.0, 2.0, 0.7))], "h struct<text:string,start:double,end:double,conf:double>, t struct<text:string,start:double,end:double,conf:double>")
    got = df.select(ss.merge_tail(F.col("h"), F.col("t"), F.least).alias("m")).first()["m"]
    assert tuple(got) == ("helloing", 0.0, 2.0, 0.5)
