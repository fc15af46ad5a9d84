"""Rows that queries got wrong, or not at all, on larger tables."""

import random
import re
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_queries import compare
from pyspark.sql import functions as F

from weftline.functions import pairs
from weftline.functions import text as tx
from weftline.operators import buckets as bk
from weftline.operators import filters as fl
from weftline.operators import joins as jn
from weftline.operators import neighbours as nb
from weftline.operators import shape as sh
from weftline.operators import split as sp
from weftline.operators import tokenise as op
from weftline.plans.catalog import Tables, load_all
from weftline.sources import importers as im
from weftline.sources import views


def documents_match(spark, folder, name, texts):
    """Rows of the query over these texts, checked against its SQL."""
    import duckdb

    table = {"doc_id": [3 * i for i in range(len(texts))], "text": texts, "lang": ["en"] * len(texts), "source": ["web"] * len(texts)}
    pq.write_table(pa.table(table | {"n_chars": [len(t or "") for t in texts]}), f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    query = load_all()[name]
    message, ok = compare(query.build(Tables(spark, str(folder))), con, query.sql)
    assert ok, message
    return query.build(Tables(spark, str(folder))).collect()


def test_rows_without_duration_fit_no_bucket(spark):
    df = spark.createDataFrame([(1, 0.0, 5), (2, 0.0, 0), (3, 2.0, 5), (4, None, 5)], "id long, duration double, num_tokens long")
    args = ([(5, 10), (5, 20), (10, 30)], F.col("duration"), F.col("num_tokens"), True, [4, 4, 3])
    assert [r["id"] for r in bk.filter_bucketable(df, *args).collect()] == [3]


def test_rows_without_duration_have_no_rate(spark):
    df = spark.createDataFrame([(1, 0.0, 5), (2, 0.0, 0), (3, 2.0, 5), (4, None, 5)], "id long, duration double, num_tokens long")
    assert [r["id"] for r in fl.filter_tokens_per_second(df, 0.5, 8).collect()] == [3]
    df = spark.createDataFrame([(1, 0, 5), (2, 4, 5)], "id long, input_length long, output_length long")
    assert [r["id"] for r in fl.filter_tokens_per_token(df, 0.5, 3).collect()] == [2]


def test_initials_join_in_pairs(spark):
    got = spark.range(1).select(tx.split_sentences(F.lit("see a. a. a. a. a. It ended."))).first()[0]
    assert got == ["see a.a. a.a. a.", "It ended."]


def test_long_periods_are_walked_exactly(spark, monkeypatch):
    monkeypatch.setattr(sp, "MOST_PERIOD", 1000)
    monkeypatch.setattr(sp, "WALK", 300)
    weights, sizes, n = [4000, 3000, 2001, 1000], [7, 50, 33, 21], 25_000  # two and a half periods of 10,001
    counts, want = [0] * 4, []
    for i in range(n):
        d = max(range(4), key=lambda k: (weights[k] * max(i, 1) - counts[k] * 10_001, -k))
        want.append((i, d, counts[d] % sizes[d]))
        counts[d] += 1
    assert [tuple(r) for r in sp.blend_greedy(spark, weights, sizes, n).orderBy("idx").collect()] == want


def test_packs_go_on_over_blocks(spark):
    rng = random.Random(4)
    lengths = [rng.choice((0, 1, 2, 5, 9, 40, 64)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id long, n int")
    got = {r["id"]: (r["bin"], r["place"]) for r in sh.pack_in_order(df, "id", "n", 64, seed=6, block_rows=100).collect()}
    bin_, used = 0, 0
    for place, i in enumerate(sorted(range(3000), key=lambda i: md5(f"6|{i}".encode()).hexdigest())):
        if used + lengths[i] > 64:
            bin_, used = bin_ + 1, 0
        used += lengths[i]
        assert got[i] == (bin_, place)


def test_neighbours_tile_by_tile():
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, size=(900, 4)).astype(float)  # many equal scores
    ids, groups = rng.permutation(900), rng.integers(0, 5, size=900)
    for metric in ("ip", "l2"):
        s = x @ x.T if metric == "ip" else -((x[:, None] - x[None]) ** 2).sum(2)
        s[groups[:, None] == groups[None]] = -np.inf
        want = [(ids[i], ids[j]) for i in range(900) for j in np.lexsort((ids, -s[i]))[:7]]
        found = nb.block_top_k(ids, x, groups, ids, x, groups, 7, metric, True, rows=100, cols=64)
        assert list(zip(found["qid"].to_pylist(), found["nid"].to_pylist())) == want


def test_blocks_stay_few_and_small(spark):
    sizes = [100, 3000, 3300, 100_000, 600_000, 6_000_000]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(nb._block_count(F.col("n"), 200, 64)).collect()
    assert [r[0] for r in got] == [1, 15, 16, 16, 19, 184]


def test_approximate_recall_of_even_clouds(spark):
    """Vectors without clusters lie near the borders of lists."""
    x = np.random.default_rng(5).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nb.approximate_knn(df, df, 5, n_lists=8, n_probe=4, seed=3, parts=4, block=300).select("qid", "nid").collect()
    assert len(found) == len(set(found)) == 10_000
    want = {(i, j) for i, row in enumerate(x @ x.T) for j in np.lexsort((np.arange(2000), -row))[:5]}
    assert len({tuple(r) for r in found} & want) >= 9000


def test_texts_are_encoded_a_few_at_a_time():
    texts = ["a" * 10, "b" * 25, None, "", "c" * 4, "d" * 30, "e" * 3]
    parts = [p.column(0).to_pylist() for p in op._slices(pa.record_batch({"t": texts}), 0, 16)]
    assert sum(parts, []) == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 16 for p in parts) and len(parts) == 5
    assert list(op._slices(pa.record_batch({"t": pa.array([], pa.string())}), 0, 16)) == []


def test_distances_far_from_the_origin():
    """Squares of the lengths are so large that their difference has no digits left of the distance."""
    rng = np.random.default_rng(4)
    ids, x = np.arange(40), 1000 + 1e-5 * rng.normal(size=(40, 64))
    got = nb.block_top_k(ids, x, ids, ids, x, ids, 3, "l2", True).to_pydict()
    far = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * 40)
    assert [*zip(got["qid"], got["nid"])] == [(i, j) for i in range(40) for j in np.argsort(far[i])[:3].tolist()]


def test_first_of_many_copies_are_neighbours():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(8, 16)), 1500, 0)
    at = rng.permutation(len(x))
    x, ids = x[at], rng.permutation(len(x))
    score = np.round(x[:20] @ x.T, 9)
    for metric in ("ip", "l2"):
        score = score if metric == "ip" else np.round(2 * x[:20] @ x.T - (x * x).sum(1), 9)
        got = nb.block_top_k(ids[:20], x[:20], ids[:20], ids, x, ids, 5, metric, False).to_pydict()
        want = [sorted(ids[np.lexsort((ids, -s))[:5]].tolist()) for s in score]
        assert [sorted(got["nid"][5 * i : 5 * i + 5]) for i in range(20)] == want


def test_only_places_of_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_BROADCAST_VOCAB", 3)
    monkeypatch.setattr(op, "FREQUENT", 1)
    rows = [(i, ["a", f"w{i}", "a", "zz"]) for i in range(5)] + [(5, []), (5, [])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    vocab = spark.createDataFrame([("a", 100)] + [(f"w{i}", i) for i in range(5)], "token string, id long")
    assert [r["token"] for r in op._frequent(df, "t", vocab).collect()] == ["a"]
    for unk, last in ((-1, [-1]), (None, [])):
        got = op.encode_tokens(df, F.col("t"), vocab, unk, keep=["id"])
        assert got.columns == ["id", "ids"]
        assert sorted((r["id"], r["ids"]) for r in got.collect()) == [(i, [100, i, 100, *last]) for i in range(5)] + [(5, []), (5, [])]


def test_first_places_of_words_in_any_row_order(spark):
    rows = [(3, "x", ["c", "a"]), (1, "y", ["b", "a", "b"]), (None, "x", ["d", None]), (2, "x", None), (2, "y", ["a", "e"])]
    df = spark.createDataFrame(rows, "id long, lang string, t array<string>").coalesce(1)
    plain = op.vocabulary(df, F.filter("t", lambda w: w.isNotNull()), ["id"])
    assert {r["token"]: r["id"] for r in plain.collect()} == {"d": 0, "b": 1, "a": 2, "e": 3, "c": 4}
    by = op.vocabulary(df, F.filter("t", lambda w: w.isNotNull()), ["id"], by=["lang"])
    assert {(r["lang"], r["token"]): r["id"] for r in by.collect()} == {("x", "d"): 0, ("x", "c"): 1, ("x", "a"): 2, ("y", "b"): 0, ("y", "a"): 1, ("y", "e"): 2}


def test_text_at_hand_is_not_joined_again(spark):
    chunks = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "c long, t string")
    found = spark.createDataFrame([(0, 1, 3), (0, 2, 1), (2, 1, 2)], "c long, rank long, neighbour long")
    plain = jn.neighbour_text(chunks, found, "c", "t")
    held = jn.neighbour_text(chunks, found.withColumn("t", F.concat(F.lit("t"), F.col("c").cast("string"))), "c", "t")
    want = [(0, 1, 3, "t0", "t3", ""), (0, 2, 1, "t0", "t1", "t2"), (2, 1, 2, "t2", "t2", "t3")]
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, held.collect())) == want
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert (joins(plain), joins(held)) == (3, 2)


def test_places_of_typos_are_drawn_once(spark):
    df = spark.createDataFrame([(7, "one a three four"), (8, "")], "id long, t string")
    noisy = lambda *p: df.select(tx.typo_noise("t", "id", 1, *p).alias("n"))
    assert [r["n"] for r in noisy(0.0, 0.0).collect()] == ["one a three four", ""]
    assert [[len(w) for w in r["n"].split()] for r in noisy(1.0, 1.0).collect()] == [[2, 1, 4, 3], []]
    assert noisy(0.3, 0.2)._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 4


def test_words_of_a_pair_are_made_once(spark):
    docs = spark.createDataFrame([(1, "en", "web", "One two  three four five six seven eight. é \nNine")], "doc_id long, lang string, source string, text string")
    view = views.pairs_view(docs)
    assert [(r["pos"], r["r"], r["h"]) for r in view.orderBy("pos").collect()] == [
        (0, "one two three four five six seven eight".split(), "one two three four <unk> six eight".split()), (2, ["nine"], ["nine"])
    ]
    plan = view.select(F.size("r"), F.size("h"), F.array_join("r", " "), F.array_join("h", " "))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(utt") == 1


def test_characters_of_many_pairs_advance_together(monkeypatch):
    rng = random.Random(7)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = [last := i + 1] + [last := min(row[j + 1] + 1, last + 1, row[j] + (x != y)) for j, y in enumerate(b)]
        return row[-1]

    ref = ["".join(rng.choice("abé漢😀\0") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(400)]
    hyp = ["".join(c for c in t if rng.random() > 0.2) + "b" * rng.choice([0, 3, 70]) for t in ref]
    one, taken = pairs._distance_long, []
    monkeypatch.setattr(pairs, "_distance_long", lambda a, b: taken.append(1) or one(a, b))
    got = pairs.char_distances(pa.array([None, *ref]), pa.array(["abc", *hyp])).tolist()
    assert got == [3, *(distance(a, b) for a, b in zip(ref, hyp))] and len(taken) < 100
    monkeypatch.setattr(pairs, "RUN_CHARS", 100)  # runs of few texts: each pair alone
    assert pairs.char_distances(pa.array([None, *ref]), pa.array(["abc", *hyp])).tolist() == got


def test_matches_are_those_of_the_alignment():
    rng = random.Random(3)
    ref, hyp = ([[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(200)] for _ in range(2))
    words = pairs.Words.of(pa.array(ref, pa.list_(pa.string())), pa.array(hyp, pa.list_(pa.string())))
    want = np.zeros(sum(map(len, hyp)), bool)
    for k, path in pairs.alignments(words, True):
        for i, j in path.tolist():
            if i >= 0 and j >= 0 and ref[k][i] == hyp[k][j]:
                want[words.start[1][k] + j] = True
    assert (pairs.matches(words) == want).all()


def test_time_marks_are_read_once_for_words_and_text(spark):
    rows = ["<|0|> hi <|3|> <|4|> there <|9|>", " plain  text ", "<|1|>  <|2|>", "", None, "<|1|> a<b |> <|2|> x <|3|>y<|4|>", "\u2003\u00a0", "\t\n x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, t string")
    both = df.select("id", "t", tx.stamped_words("t", 0.08).alias("s")).select("id", tx.stamped_plain("t", "s").alias("p"))
    alone = df.select("id", tx.stamped_plain("t").alias("p"))
    want = ["hi there", "plain  text", "", "", None, "a<b |> y", "\u2003\u00a0", "\t\n x"]
    for d in (both, alone):
        assert [r["p"] for r in d.orderBy("id").collect()] == want
    assert both._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 3
    same = df.select(tx.has_word("t").alias("a"), (F.size(tx.words("t")) > 0).alias("b")).collect()
    assert [(r["a"] or False) for r in same] == [(r["b"] or False) for r in same]


def test_texts_without_sentences_are_no_documents(spark, tmp_path):
    rows = documents_match(spark, tmp_path, "tokenise_corpus", ["One. Two.", "", None, " ... !\n", "x"])
    assert {r["doc_id"]: r["sentences"] for r in rows} == {0: 2, 12: 1}


def test_texts_without_words_are_blocks(spark, tmp_path):
    rows = documents_match(spark, tmp_path, "tagged_blocks", ["One two", "", None, " \n ", "X\ty"])
    assert [r["written"] for r in sorted(rows, key=lambda r: r["sent_id"])] == ["One two", "", None, "", "X y"]


def test_blocks_go_on_from_file_to_file(spark):
    files = [(3, ["a", "<eos>", "<eos>", "b", "c"]), (1, ["A\tx\ty", "B\tz", "<eos>\t"]), (2, []), (0, None), (4, ["d", "<eos>"])]
    df = spark.createDataFrame(files, "n long, t array<string>")
    rows = im.tagged_blocks(df, "n", F.col("t")).orderBy("sent_id")
    assert [tuple(r) for r in rows.collect()] == [
        (0, ["A", "B"], ["x", "z"], ["y", None]), (1, ["a"], [None], [None]), (2, [], [], []), (3, ["b", "c"], [None] * 2, [None] * 2), (4, ["d"], [None], [None])
    ]
    with pytest.raises(Exception, match="another number of blocks"):
        im.tagged_blocks(df, "n", F.col("t"), blocks=F.lit(1)).collect()
    plan = load_all()["tagged_blocks"].build(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # words don't move one by one


def test_sentences_are_cut_at_the_last_plain_word(spark, tmp_path):
    rng = random.Random(9)
    labels = ["".join(rng.choice("OB" if i % 3 else "B") for _ in range(rng.randrange(30))) for i in range(60)]
    want = []
    for i, all_ in enumerate(labels):
        at = part = 0
        while at < len(all_):
            window = all_[at : at + 4]
            step = len(window) if len(all_) - at <= 4 else window.rfind("O") + 1 or 1
            want.append((i, part, [f"w{k}" for k in range(at, at + step)], list(all_[at : at + step])))
            at, part = at + step, part + 1
    files = [(i, [(f"w{k}", c) for k, c in enumerate(all_)] + [(" ", None)]) for i, all_ in enumerate(labels)]
    df = spark.createDataFrame(files, "n long, t array<struct<token:string,label:string>>")
    for blocks in (None, F.lit(1)):
        assert sorted(map(tuple, im.iob_files(df, "n", F.col("t"), 4, blocks).collect())) == want
    documents_match(spark, tmp_path, "iob_sentences", ["One two", "", None, " ", "A b " * 90, "A " * 120, "b " * 120])
    plan = load_all()["iob_sentences"].build(Tables(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # words don't move one by one


def test_sentences_of_pairs_move_once(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    documents_match(spark, tmp_path, "next_sentence_pairs", ["One two. Three\nfour " + "five " * 60, "", None, "\n\n", "x " * 30 + "! " + "y " * 30] * 9)
    query = load_all()["next_sentence_pairs"].build(Tables(spark, str(tmp_path)))
    query.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(query._jdf.queryExecution(), "formatted")
    final = re.findall(r"[ -]Exchange \((\d+)\)", plan.split("== Initial Plan ==")[0])
    moved = [re.search(rf"\n\({i}\) Exchange\nInput \[\d+\]: (.*)", plan)[1] for i in final]
    assert sum(bool(re.search(r"\b(utt|_t|_u|w|a|b)#", x)) for x in moved) == 2, moved  # to be looked up, and to look one up



def test_sentences_are_numbered_where_they_are_not(spark):
    rows = [(f"s{i}", i % 2, -i, " ".join(f"w{i}_{k}" for k in range(i))) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, half int, at long, t string")
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    given = [(r[0], r[3], i + 1, ordered[i + 1][3] if i < 11 and i % 3 else None) for i, r in enumerate(ordered)]
    given = spark.createDataFrame(given, "id string, t string, n long, u string")
    found = sh.next_sentence_pairs(df, "id", "t", 5, 6, ["half", "at"]).collect()
    assert len(found) == 12 and sorted(found) == sorted(sh.next_sentence_pairs(given, "id", "t", 5, 6, number="n", after="u", total=12).collect())
    after = {a[0]: b[3].split() for a, b in zip(ordered, ordered[1:])}
    for r in found:
        a, b = r["a"].split(), r["b"].split()
        assert len(a) + len(b) <= 6
        if r["is_next"]:
            assert set(b) <= set(after[r["id"]]) and bool(b) == bool(after[r["id"]])


def test_best_of_pieces_are_those_of_the_whole():
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, size=(700, 4)).astype(float)  # many equal scores
    x[300:500] = x[:200]
    ids, groups = np.sort(rng.choice(5000, 700, replace=False)), rng.integers(0, 5, size=700)
    q, qg = x[rng.permutation(700)[:90]], rng.integers(0, 5, size=90)
    hidden = (rng.random((90, 3)) < 0.5, rng.integers(-1, 3, size=700))
    for metric in ("ip", "l2"):
        want = nb.block_top_k(np.arange(90), q, qg, ids, x, groups, 9, metric, True, hidden=hidden).to_pydict()
        for piece in (7, 64, 10_000):
            of, nid, score = nb.pieces_top_k(q, qg, ids, groups, lambda at: x[at], 9, metric, True, piece, hidden)
            assert (of.tolist(), nid.tolist(), score.tolist()) == (want["qid"], want["nid"], want["score"])


def test_a_query_meets_a_list_once(spark, monkeypatch):
    """Each block of a list that a query meets gives its own best, so few blocks make few rows."""
    seen, blocked = [], nb._blocked
    monkeypatch.setattr(nb, "_blocked", lambda *a: seen.append(a) or blocked(*a))
    x = np.random.default_rng(5).normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert nb.approximate_knn(df, df, 5, n_lists=3, n_probe=2, seed=3, parts=4).count() == 4500
    rows = spark.createDataFrame([(n,) for n in (10, 200_000, 2_000_000)], "n long")
    assert [r[0] for r in rows.select(seen[0][-1][1](F.col("n"))).collect()] == [1, 1, 7]
