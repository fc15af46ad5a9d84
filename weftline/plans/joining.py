"""Join, neighbour and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import fragments, sample_key, words
from weftline.functions.tokens import char_ngrams
from weftline.metrics.classify import top_k_accuracy
from weftline.operators import joins as jn
from weftline.operators import neighbours as nb
from weftline.plans import ansi
from weftline.plans.catalog import query
from weftline.session import cut_lineage
from weftline.sources import views


@query(
    "order_assembly",
    "E1",
    """SELECT o_orderkey, c_name, n_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select("o_orderkey", "c_name", "n_name", F.round("o_totalprice", 2).alias("total"))
    )


@query(
    "keep_and_attach",
    "E2",
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE source END AS source, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def _(t):
    keep = t.labels.withColumn("source", F.when(F.col("toxic") == 1, "toxic"))
    return jn.keep_and_attach(t.documents.select("doc_id", "source"), keep, "doc_id", ["source"])


@query(
    "answer_lookup",
    "E3",
    """SELECT 'x/' || doc_id || '_dup0.wav' AS item, CASE WHEN lang = 'de' THEN 'A' ELSE CASE WHEN quality = 1 THEN 'B' WHEN quality = 0 THEN 'C' END END AS truth,
    NOT (lang = 'de') AND quality IS NULL AS skipped FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    items = t.documents.select(
        F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit("_dup0.wav")).alias("item"),
        F.when(F.col("lang") == "de", "A").otherwise(" ").alias("target"),
    ).withColumn("key", sample_key("item"))
    keys = t.labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, "B").otherwise("C").alias("answer"))
    return jn.answer_lookup(items, keys, "key", "target").select("item", "truth", "skipped")


WINDOWS = "win AS (SELECT speaker, id AS window_id, \"start\" - 600 AS a, \"start\" + 1800 AS b FROM spans WHERE cls = 'signup')"


@query(
    "segment_overlap",
    "E5",
    ansi.with_views(ansi.SPANS, WINDOWS)
    + """SELECT s.id, w.window_id, round(s."start" - a, 3) AS rel_start, round(s."end" - a, 3) AS rel_end FROM spans s JOIN win w ON s.speaker = w.speaker
    AND s."start" < b + 0.001 AND s."end" > a + 0.001""",
)
def _(t):
    spans = views.spans_view(t.events)
    windows = spans.filter(F.col("cls") == "signup").select(
        "speaker", F.col("id").alias("window_id"), (F.col("start") - 600).alias("start_after"), (F.col("start") + 1800).alias("end_before")
    )
    out = jn.overlap_join(spans.select("id", "speaker", "start", "end"), windows, "speaker", bin_width=3600)
    return out.select("id", "window_id", F.round("start", 3).alias("rel_start"), F.round("end", 3).alias("rel_end"))


@query(
    "frame_mask",
    "E6",
    """WITH s AS (SELECT user_id, event_id % 8 AS spk, floor((event_id % 300) * 2.0) AS lo, least(floor((event_id % 300 + value) * 2.0), 700) AS hi FROM events)
    SELECT user_id, spk, count(DISTINCT f) AS frames, CAST(min(f) AS BIGINT) AS first_frame FROM s, LATERAL (SELECT unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS f) WHERE spk < 6 AND hi > lo GROUP BY 1, 2""",
)
def _(t):
    seg = t.events.select(
        "user_id", (F.col("event_id") % 8).alias("spk"), (F.col("event_id") % 300).cast("double").alias("start"),
        (F.col("event_id") % 300 + F.col("value")).alias("end"),
    )
    cells = jn.frame_mask(seg, ["user_id"], "spk", 2.0, F.lit(700), 6, skip_unknown=True)
    return cells.groupBy("user_id", "spk").agg(F.count(F.lit(1)).alias("frames"), F.min("frame").alias("first_frame"))


EMB = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _knn_sql(k: int, exclude: bool = False, metric: str = "list_inner_product(a.v, b.v)") -> str:
    where = "AND a.label <> b.label" if exclude else ""
    return (
        f"nn AS (SELECT qid, nid, score, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS nid, {metric} AS score, "
        f"row_number() OVER (PARTITION BY a.vec_id ORDER BY {metric} DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id {where}) WHERE rank <= {k})"
    )


@query("knn_inner_product", "E7", f"WITH {EMB}, {_knn_sql(5)} SELECT qid, nid, round(score, 5) AS score, rank FROM nn")
def _(t):
    emb = t.embeddings.withColumn("self", F.col("vec_id"))
    found = nb.knn(emb, emb, 5, exclude_same="self")
    return found.select("qid", "nid", F.round("score", 5).alias("score"), "rank")


@query(
    "knn_l2_blocks",
    "E7",
    f"WITH {EMB}, {_knn_sql(4, metric='-pow(list_distance(a.v, b.v), 2)')} SELECT qid, nid, round(score, 5) AS score, rank FROM nn",
)
def _(t):
    emb = t.embeddings.withColumn("self", F.col("vec_id"))
    found = nb.knn(emb, emb, 4, metric="l2", exclude_same="self", block=200, max_broadcast=0)
    return found.select("qid", "nid", F.round("score", 5).alias("score"), "rank")


@query(
    "knn_other_documents",
    "E8",
    f"WITH {EMB}, {_knn_sql(6, True)} SELECT vec_id AS qid, coalesce(string_agg(CAST(nid AS VARCHAR), ' ' ORDER BY rank), '') AS neighbors FROM e LEFT JOIN nn ON qid = vec_id GROUP BY 1",
)
def _(t):
    found = nb.knn(t.embeddings, t.embeddings, 6, exclude_same="label")
    lists = nb.neighbour_lists(found, t.embeddings, "vec_id", 6)
    return lists.select("qid", F.array_join(F.filter("neighbors", lambda x: x >= 0).cast("array<string>"), " ").alias("neighbors"))


@query(
    "approximate_recall",
    "E9 V2",
    f"WITH {EMB}, nn AS (SELECT a.vec_id AS qid, b.vec_id AS nid FROM e a, e b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) DESC, b.vec_id) <= 5) "
    "SELECT count(*) AS neighbours, count(DISTINCT qid) AS queries, true AS recalled, true AS exact_scores FROM nn",
)
def _(t):
    """Recall of at least 0.9 against the exact search, and scores that are those of the whole vectors."""
    emb = t.embeddings
    near = nb.approximate_knn(emb, emb, 5, n_lists=8, n_probe=4, seed=3).select("qid", "nid", F.col("score").alias("near"))
    both = nb.knn(emb, emb, 5).join(near, ["qid", "nid"], "left")
    return both.agg(
        F.count(F.lit(1)).alias("neighbours"), F.countDistinct("qid").alias("queries"), (F.count("near") >= 0.9 * F.count(F.lit(1))).alias("recalled"),
        F.coalesce(F.bool_and(F.abs(F.col("near") - F.col("score")) < 1e-6), F.lit(False)).alias("exact_scores"),
    )


@query("approximate_knn", "E9 V2")
def _(t):
    found = nb.approximate_knn(t.embeddings, t.embeddings, 5, n_lists=8, n_probe=4, seed=3)
    return found.select("qid", "nid", F.round("score", 5).alias("score"), "rank")


@query(
    "distinct_concepts",
    "E10",
    f"""WITH {EMB}, {_knn_sql(20)}, f AS (SELECT qid, label AS concept, min(rank) AS rank, arg_min(score, rank) AS score FROM nn JOIN embeddings ON vec_id = nid GROUP BY 1, 2)
    SELECT qid, place, concept, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM f) WHERE place <= 3""",
)
def _(t):
    emb = t.embeddings.withColumn("self", F.col("vec_id"))
    found = nb.knn(emb, emb, 20, exclude_same="self")
    concepts = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("concept"))
    return nb.distinct_concepts(found, concepts, 3).withColumn("score", F.round("score", 5))


@query(
    "top_k_accuracy",
    "F15",
    f"""WITH {EMB}, {_knn_sql(5)}, l AS (SELECT qid, q.label AS y, list(n.label ORDER BY rank) AS ls FROM nn JOIN embeddings q ON q.vec_id = qid JOIN embeddings n ON n.vec_id = nid GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN list_position(ls, y) BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top_1, round(avg(CASE WHEN list_position(ls, y) BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top_5 FROM l""",
)
def _(t):
    emb = t.embeddings.withColumn("self", F.col("vec_id"))
    found = nb.knn(emb, emb, 5, exclude_same="self")
    label = t.embeddings.select(F.col("vec_id").alias("nid"), "label")
    own = t.embeddings.select(F.col("vec_id").alias("qid"), F.col("label").alias("truth"))
    rows = found.join(label, "nid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("n")).join(own, "qid")
    out = top_k_accuracy(rows, F.transform("n", lambda x: x["label"]), F.col("truth"), [1, 5])
    return out.select(F.round("top_1", 6).alias("top_1"), F.round("top_5", 6).alias("top_5"))


CHUNKS = (
    f"w AS (SELECT doc_id, {ansi.words('text')} AS w FROM documents), "
    "c AS (SELECT doc_id, i // 64 AS part, array_to_string(w[i + 1:i + 64], ' ') AS chunk_text FROM (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS i FROM w)), "
    "chunks AS (SELECT row_number() OVER (ORDER BY doc_id, part) - 1 AS chunk_id, doc_id, chunk_text FROM c)"
)


def chunk_table(t):
    from weftline.operators.shape import retrieval_chunks

    # joined first: a text is smaller than the list of its words
    texts = t.documents.select("doc_id", fragments(words("text"), 64, 64).alias("texts"))
    out = retrieval_chunks(texts, "doc_id", "texts", 1, 1)
    return out.select("chunk_id", "doc_id", F.element_at("chunk", 1).alias("chunk_text"))


@query(
    "neighbour_text",
    "E11",
    f"""WITH {CHUNKS}, nn AS (SELECT chunk_id, rank, {ansi.seeded_int(5, 'chunk_id', 'rank')} % (SELECT count(*) FROM chunks) AS neighbour FROM chunks, (SELECT unnest([1, 2]) AS rank) r)
    SELECT nn.chunk_id, CAST(nn.rank AS BIGINT) AS rank, nn.neighbour, h.chunk_text AS text, m.chunk_text AS match, coalesce(a.chunk_text, '') AS continuation
    FROM nn JOIN chunks h ON h.chunk_id = nn.chunk_id JOIN chunks m ON m.chunk_id = nn.neighbour LEFT JOIN chunks a ON a.chunk_id = nn.neighbour + 1""",
)
def _(t):
    chunks = cut_lineage(chunk_table(t))  # read by four steps
    n = chunks.count()
    ranks = chunks.select("chunk_id", "chunk_text", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("rank"))
    from weftline.functions.seeded import seeded_int

    found = ranks.withColumn("neighbour", seeded_int(5, "chunk_id", "rank") % n)
    return jn.neighbour_text(chunks, found, "chunk_id", "chunk_text")


@query(
    "phrase_candidates",
    "E12",
    ansi.with_views(
        ansi.LINES,
        "names AS (SELECT DISTINCT p_name AS phrase, replace(p_name, ' ', '_') AS s FROM part)",
        "g AS (SELECT DISTINCT phrase, s[i:i + 2] AS gram FROM (SELECT phrase, s, unnest(range(1, length(s) - 1)) AS i FROM names))",
        f"f AS (SELECT doc_id, pos, array_to_string({ansi.words('lower(utt)')}, '_') AS s FROM utterances)",
        "fg AS (SELECT DISTINCT doc_id, pos, s[i:i + 2] AS gram FROM (SELECT doc_id, pos, s, unnest(range(1, length(s) - 1)) AS i FROM f))",
        "ban AS (SELECT gram FROM fg GROUP BY 1 HAVING 100 * count(*) >= 8 * (SELECT count(*) FROM f))",
        "idx AS (SELECT phrase, gram FROM (SELECT phrase, gram, row_number() OVER (PARTITION BY gram ORDER BY phrase) AS r FROM g WHERE gram NOT IN (SELECT gram FROM ban)) WHERE r <= 20)",
        "hits AS (SELECT doc_id, pos, phrase, count(*) AS shared FROM fg JOIN idx USING (gram) GROUP BY 1, 2, 3)",
    )
    + "SELECT * FROM (SELECT doc_id, pos, phrase, shared, row_number() OVER (PARTITION BY doc_id, pos ORDER BY shared DESC, phrase) AS rank FROM hits) WHERE rank <= 10",
)
def _(t):
    frag = views.utterances(t.documents).select("doc_id", "pos", F.array_join(words(F.lower("utt")), "_").alias("s"))
    banned = jn.frequent_grams(frag, F.col("s"), 3, 8, among=jn.phrase_index(t.part, "p_name", 3))
    index = jn.phrase_index(t.part, "p_name", 3, max_phrases=20, banned=banned)
    return jn.phrase_candidates(frag, ["doc_id", "pos"], F.col("s"), index, 3)


@query(
    "match_results",
    "E13",
    """SELECT r.conv_id, r.turn, coalesce('tool_' || (length(c.text) % 5), '<unmatched>') AS name FROM conversations r
    LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1 AND c.role = 'user' WHERE r.role = 'assistant'""",
)
def _(t):
    calls = t.conversations.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("call_id"), F.concat(F.lit("tool_"), (F.length("text") % 5).cast("string")).alias("name"))
    results = t.conversations.filter(F.col("role") == "assistant").select("conv_id", "turn", (F.col("turn") - 1).alias("call_id"))
    return jn.match_results(results, calls, ["conv_id", "call_id"], "name").select("conv_id", "turn", "name")


@query(
    "class_pairs",
    "E14",
    f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY {ansi.key(9, 'doc_id')}, doc_id) AS k FROM documents),
    s AS (SELECT lang, count(*) AS m FROM documents GROUP BY 1),
    p AS (SELECT a.lang AS a, b.lang AS b, a.m AS ma, b.m AS mb, least(a.m * b.m, 40) AS take FROM s a JOIN s b ON a.lang < b.lang),
    d AS (SELECT a, b, mb, (i * ma * mb) // take AS j FROM (SELECT *, unnest(range(take)) AS i FROM p))
    SELECT x.doc_id AS id_a, y.doc_id AS id_b, x.source || ' ' || y.source AS text, a || '|' || b AS labels FROM d JOIN r x ON x.lang = a AND x.k = j // mb + 1 JOIN r y ON y.lang = b AND y.k = j % mb + 1""",
)
def _(t):
    out = jn.class_pairs(t.documents, "doc_id", "lang", "source", 40, 9)
    return out.withColumn("labels", F.array_join("labels", "|"))


@query(
    "positional_zip",
    "E15",
    "SELECT d.event_id, d.event_type, e.value FROM events d JOIN events e ON d.event_id = e.event_id",
)
def _(t):
    return jn.positional_zip(t.events.select("event_id", "event_type"), t.events.select("event_id", "value"), "event_id")


@query(
    "random_negatives",
    "E16",
    f"SELECT vec_id, CAST(i AS BIGINT) AS i, {ansi.seeded_int(4, 'vec_id', 'i')} % (SELECT count(*) FROM embeddings) AS negative FROM embeddings, (SELECT unnest(range(3)) AS i) r",
)
def _(t):
    out = jn.random_negatives(t.embeddings, "vec_id", 3, t.embeddings.count(), 4)
    return out.withColumn("i", F.col("i").cast("long"))


@query(
    "synonym_pairs",
    "E17",
    f"""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {ansi.key(2, 'vec_id')}, vec_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS m FROM embeddings),
    s AS (SELECT DISTINCT label, m FROM r WHERE m > 1), d AS (SELECT label, m, unnest(range(least(m * (m - 1) // 2, 50))) AS p FROM s)
    SELECT d.label, a.vec_id AS id_1, b.vec_id AS id_2, CASE WHEN {ansi.uniform(2, 'a.vec_id', 'b.vec_id')} < 0.8 THEN 'train' ELSE 'validation' END AS split
    FROM d JOIN r a ON a.label = d.label AND a.k = p % d.m JOIN r b ON b.label = d.label AND b.k = (p % d.m + p // d.m + 1) % d.m""",
)
def _(t):
    names = t.embeddings.select("vec_id", "label", F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"))
    return jn.synonym_pairs(names, "vec_id", "label", "name", 50, 2, 0.8).select("label", "id_1", "id_2", "split")


@query(
    "canonical_names",
    "E18",
    "SELECT source, arg_min(text, doc_id) AS name FROM documents WHERE NOT contains(text, ':') GROUP BY 1",
)
def _(t):
    return jn.canonical_names(t.documents, "source", "text", "doc_id")


@query("pca_vectors", "V1")
def _(t):
    out = nb.pca(t.embeddings, "embedding", 8)
    norm = F.aggregate("reduced", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", F.round(norm, 5).alias("energy"))


@query(
    "paired_cosine",
    "V3",
    f"WITH {EMB} SELECT a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 GROUP BY 1",
)
def _(t):
    a = t.embeddings
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").groupBy("label").agg(F.round(F.avg(nb.cosine(F.col("embedding"), F.col("other"))), 6).alias("similarity"))


@query(
    "gram_counts",
    "E12",
    "SELECT gram, count(*) AS n FROM (SELECT DISTINCT p_partkey, s[i:i + 2] AS gram FROM (SELECT p_partkey, p_name AS s, unnest(range(1, length(p_name) - 1)) AS i FROM part)) GROUP BY 1",
)
def _(t):
    grams = t.part.select(F.explode(F.array_distinct(char_ngrams(F.col("p_name"), 3))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
