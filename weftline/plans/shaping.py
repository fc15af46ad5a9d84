"""Sequence shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import words
from weftline.functions.tokens import byte_ids
from weftline.operators import filters as fl
from weftline.operators import order as od
from weftline.operators import shape as sh
from weftline.plans import ansi
from weftline.plans.catalog import query
from weftline.sources import views

W = f"w AS (SELECT doc_id, {ansi.words('text')} AS w FROM documents)"


def doc_tokens(t):
    return t.documents.select("doc_id", words("text").alias("tokens"))


TOKENS = (
    W + ", len_ AS (SELECT doc_id, w, len(w) AS n, CAST(sum(len(w)) OVER (ORDER BY doc_id) AS BIGINT) - len(w) AS s FROM w), "
    "tok AS (SELECT doc_id, unnest(w) AS token, unnest(range(n)) AS i, s FROM len_)"
)


@query(
    "pack_contiguous",
    "I4 M10",
    f"""WITH {TOKENS}, g AS (SELECT (s + i) // 512 AS pack, s + i AS at_, token, doc_id, (s + i) % 512 AS unused, i % 512 AS p FROM tok),
    l AS (SELECT pack, doc_id, count(*) AS n, min(at_) AS at_ FROM g GROUP BY 1, 2),
    ls AS (SELECT pack, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY at_) AS lens, sum(n) AS used FROM l GROUP BY 1),
    b AS (SELECT pack, string_agg(token, ' ' ORDER BY at_) AS body, CAST(sum(p) AS BIGINT) AS psum, arg_max(p, at_) AS lastp FROM g GROUP BY 1)
    SELECT b.pack, body, CAST(used AS BIGINT) AS used, lens || CASE WHEN used < 512 THEN ' ' || (512 - used) ELSE '' END AS seq_lens,
    psum + CASE WHEN used < 512 THEN list_sum(list_transform(range(1, CAST(512 - used + 1 AS BIGINT)), lambda j_: least(lastp + j_, 511)))::BIGINT ELSE 0 END AS position_sum FROM b JOIN ls USING (pack)""",
)
def _(t):
    out = sh.pack_contiguous(doc_tokens(t), "doc_id", "tokens", 512, pad="")
    used = F.filter("tokens", lambda x: x != "")
    return out.select(
        "pack",
        F.array_join(used, " ").alias("body"),
        F.size(used).cast("long").alias("used"),
        F.array_join(F.col("seq_lens").cast("array<string>"), " ").alias("seq_lens"),
        F.aggregate("position_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("position_sum"),
    )


@query(
    "block_segments",
    "I6",
    f"""WITH {TOKENS}, l AS (SELECT (s + i) // 512 AS pack, doc_id, count(*) AS n, min(s + i) AS at_ FROM tok GROUP BY 1, 2),
    k AS (SELECT pack, n, at_, row_number() OVER (PARTITION BY pack ORDER BY at_) - 1 AS seg, sum(n) OVER (PARTITION BY pack) AS used, count(*) OVER (PARTITION BY pack) AS segs FROM l)
    SELECT pack, CAST(sum(seg * n) + max(CASE WHEN used < 512 THEN (512 - used) * segs ELSE 0 END) AS BIGINT) AS segment_sum, CAST(max(segs) + max(CASE WHEN used < 512 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS boundaries FROM k GROUP BY 1""",
)
def _(t):
    out = sh.pack_contiguous(doc_tokens(t), "doc_id", "tokens", 512, pad="")
    segments, starts = sh.block_segments("seq_lens")
    return out.select(
        "pack",
        F.aggregate(segments, F.lit(0).cast("long"), lambda a, x: a + x).alias("segment_sum"),
        F.size(starts).cast("long").alias("boundaries"),
    )


@query(
    "pad_or_cut",
    "I5",
    ansi.with_views(ansi.TURNS, f"x AS (SELECT conv_id, turn, {ansi.words('src')} AS w FROM turns)", "y AS (SELECT *, CAST(least(ceil((len(w) - 1) / 16) * 16 + 1, 65) AS BIGINT) AS target FROM x)")
    + "SELECT conv_id, turn, target AS n, array_to_string(w[1:target], ' ') AS body FROM y",
)
def _(t):
    toks = views.turn_pairs(t.conversations).withColumn("w", words("src"))
    out = toks.withColumn("p", sh.pad_or_cut("w", 16, 65, F.lit("")))
    return out.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.array_join(F.filter("p", lambda x: x != ""), " ").alias("body"))


PACK = 512


def utterance_pieces(t):
    """Word counts of all utterances; those over a pack are cut into pieces of a pack."""
    n = F.size(words("utt")).cast("long")
    rows = views.utterances(t.documents).select("doc_id", "pos", n.alias("total")).filter("total > 0")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / PACK).cast("long") - 1))
    rows = rows.withColumn("piece", piece)
    return rows.select(
        F.concat_ws(":", "doc_id", "pos", "piece").alias("utt_id"), F.least(F.col("total") - F.col("piece") * PACK, F.lit(PACK)).cast("long").alias("n")
    )


def _pack_keys(seed: int) -> str:
    return (
        f"l AS (SELECT doc_id || ':' || pos AS id, len({ansi.words('utt')}) AS n FROM utterances), "
        f"u AS (SELECT id || ':' || p AS id, least(n - p * {PACK}, {PACK}) AS n FROM (SELECT id, n, unnest(range((n + {PACK - 1}) // {PACK})) AS p FROM l)), "
        f"k AS (SELECT id, n, {ansi.key(seed, 'id')} AS k, {ansi.seeded_int(seed, 'id')} % greatest(1, (count(*) OVER () + 19999) // 20000) AS chunk FROM u)"
    )


@query(
    "pack_sequential",
    "I1",
    ansi.with_views(
        ansi.LINES,
        _pack_keys(5),
        "o AS (SELECT chunk, n, row_number() OVER (PARTITION BY chunk ORDER BY k) AS r FROM k)",
        f"f AS (SELECT chunk, r, CAST(0 AS BIGINT) AS bin, n AS used FROM o WHERE r = 1 UNION ALL SELECT o.chunk, o.r, CASE WHEN f.used + o.n > {PACK} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + o.n > {PACK} THEN o.n ELSE f.used + o.n END FROM f JOIN o ON o.chunk = f.chunk AND o.r = f.r + 1)",
    )
    + "SELECT chunk, bin, count(*) AS samples, CAST(max(used) AS BIGINT) AS used FROM f GROUP BY 1, 2",
)
def _(t):
    packed = sh.pack_chunks(utterance_pieces(t), "utt_id", "n", PACK, "sequential", seed=5)
    return packed.groupBy("chunk", "bin").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").cast("long").alias("used"))


@query("pack_first_fit_decreasing", "I2 G20")
def _(t):
    return sh.pack_report(sh.pack_chunks(utterance_pieces(t), "utt_id", "n", PACK, "first_fit_decreasing", seed=5), PACK)


@query("pack_first_fit_shuffle", "I2 G20")
def _(t):
    return sh.pack_report(sh.pack_chunks(utterance_pieces(t), "utt_id", "n", PACK, "first_fit_shuffle", seed=5), PACK)


@query(
    "pack_metadata",
    "G20",
    ansi.with_views(
        ansi.LINES,
        _pack_keys(5),
        "o AS (SELECT chunk, n, row_number() OVER (PARTITION BY chunk ORDER BY k) AS r FROM k)",
        f"f AS (SELECT chunk, r, CAST(0 AS BIGINT) AS bin, n AS used FROM o WHERE r = 1 UNION ALL SELECT o.chunk, o.r, CASE WHEN f.used + o.n > {PACK} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + o.n > {PACK} THEN o.n ELSE f.used + o.n END FROM f JOIN o ON o.chunk = f.chunk AND o.r = f.r + 1)",
        "b AS (SELECT chunk, bin, count(*) AS samples, max(used) AS used FROM f GROUP BY 1, 2)",
    )
    + f"SELECT count(*) AS packs, round(sum(samples) / count(*), 6) AS packing_factor, round(sum(used) / count(*) / {PACK}, 6) AS efficiency, max(samples) AS max_samples, CAST(max(used) AS BIGINT) AS max_used FROM b",
)
def _(t):
    return sh.pack_report(sh.pack_chunks(utterance_pieces(t), "utt_id", "n", PACK, "sequential", seed=5), PACK)


@query(
    "fill_packs",
    "I3",
    ansi.with_views(
        ansi.TURNS,
        f"u AS (SELECT conv_id || ':' || turn AS id, {ansi.words('src')} AS a, {ansi.words('tgt')} AS b FROM turns)",
        f"k AS (SELECT id, len(a) + len(b) AS n, {ansi.key(6, 'id')} AS k, array_to_string(list_concat(a, b), ' ') AS t, len(b) AS nb FROM u)",
        "o AS (SELECT id, n, t, nb, row_number() OVER (ORDER BY k) AS r FROM k)",
        "f AS (SELECT r, CAST(0 AS BIGINT) AS bin, n AS used, CAST(0 AS BIGINT) AS st FROM o WHERE r = 1 UNION ALL SELECT o.r, CASE WHEN f.used + o.n > 4096 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + o.n > 4096 THEN o.n ELSE f.used + o.n END, CASE WHEN f.used + o.n > 4096 THEN 0 ELSE f.used END FROM f JOIN o ON o.r = f.r + 1)",
    )
    + """SELECT bin, string_agg(t, ' ' ORDER BY f.r) AS input_ids, CAST(sum(nb + 1) AS BIGINT) AS learned, string_agg(CAST(st AS VARCHAR), ' ' ORDER BY f.r) AS seq_start_id FROM f JOIN o USING (r) GROUP BY 1""",
)
def _(t):
    rows = views.turn_pairs(t.conversations).select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.concat(words("src"), words("tgt")).alias("t"), F.size(words("src")).alias("a")
    ).withColumn("n", F.size("t"))
    packed = sh.pack_in_order(rows, "id", "n", 4096, seed=6)
    out = sh.fill_packs(packed, rows, "id", "t", "a", "<pad>")
    return out.select(
        "bin",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.size(F.filter("loss_mask", lambda m: m)).cast("long").alias("learned"),
        F.array_join(F.col("seq_start_id").cast("array<string>"), " ").alias("seq_start_id"),
    )


@query(
    "sliding_windows",
    "I8 U7",
    f"""WITH {TOKENS}, g AS (SELECT s + i AS at_, token FROM tok), n AS (SELECT count(*) AS n FROM g),
    x AS (SELECT at_, token, unnest(range(greatest(CAST(ceil((at_ - 64) / 32) AS BIGINT), 0), least(at_ // 32, (n - 64) // 32 - 1) + 1)) AS win FROM g, n)
    SELECT win AS "window", string_agg(token, ' ' ORDER BY at_) FILTER (WHERE at_ < win * 32 + 64) AS input, string_agg(token, ' ' ORDER BY at_) FILTER (WHERE at_ > win * 32) AS label FROM x GROUP BY 1""",
)
def _(t):
    out = sh.sliding_windows(doc_tokens(t), "doc_id", "tokens", 64, 32)
    return out.select("window", F.array_join("input", " ").alias("input"), F.array_join("label", " ").alias("label"))


@query(
    "retrieval_chunks",
    "I9",
    f"""WITH {W}, c AS (SELECT doc_id, i // 48 AS part, array_to_string(w[i + 1:i + 64], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, len(w), 48)) AS i FROM w))
    SELECT row_number() OVER (ORDER BY doc_id, part) - 1 AS chunk_id, doc_id, part, chunk FROM c""",
)
def _(t):
    return sh.retrieval_chunks(doc_tokens(t), "doc_id", "tokens", 64, 48).withColumn("chunk", F.array_join("chunk", " "))


def _chat_sql(extra: str = "") -> str:
    b = lambda x: f"length(hex(encode({x}))) // 2"
    return (
        f"cm AS (SELECT conv_id, turn, {b('role')} AS h, {b('text')} + 1 AS b, turn = min(turn) OVER (PARTITION BY conv_id) OR role IN ('user', 'system') AS silent FROM conversations), "
        "ct AS (SELECT conv_id, sum(h + b) AS tokens, sum(CASE WHEN silent THEN 0 ELSE b END) AS learned FROM cm GROUP BY 1)"
    )


def chat_rows(t):
    return sh.chat_targets(t.conversations, "conv_id", "turn", byte_ids, ["user"], [257])


@query(
    "chat_targets",
    "I7",
    f"""WITH {_chat_sql()}, f AS (SELECT conv_id, sum(h + b) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + h AS at_, turn FROM cm WHERE NOT silent QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
    full_ AS (SELECT conv_id, turn, sum(h + b) OVER (PARTITION BY conv_id ORDER BY turn) - b AS head_end FROM cm)
    SELECT ct.conv_id, CAST(tokens AS BIGINT) AS tokens, CAST(learned AS BIGINT) AS learned, CAST(coalesce(max(head_end), -1) AS BIGINT) AS first_learned
    FROM ct LEFT JOIN f ON f.conv_id = ct.conv_id LEFT JOIN full_ ON full_.conv_id = f.conv_id AND full_.turn = f.turn GROUP BY 1, 2, 3""",
)
def _(t):
    return chat_rows(t).select(
        "conv_id",
        F.size("input_ids").cast("long").alias("tokens"),
        F.size(F.filter("mask", lambda m: m == 1)).cast("long").alias("learned"),
        (F.array_position("mask", F.lit(1)) - 1).alias("first_learned"),
    )


@query(
    "drop_unlearnable",
    "B16",
    f"""WITH {_chat_sql()}, full_ AS (SELECT conv_id, silent, sum(h + b) OVER (PARTITION BY conv_id ORDER BY turn) - b AS head_end FROM cm)
    SELECT conv_id FROM full_ WHERE NOT silent GROUP BY 1 HAVING min(head_end) < 300""",
)
def _(t):
    return fl.drop_unlearnable(chat_rows(t), "mask", 300).select("conv_id")


@query(
    "last_turn_split",
    "W12",
    """WITH l AS (SELECT conv_id, max(turn) AS last_, count(*) AS n FROM conversations GROUP BY 1)
    SELECT c.conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE turn < last_) AS context, max(text) FILTER (WHERE turn = last_) AS answer
    FROM conversations c JOIN l USING (conv_id) WHERE n > 1 GROUP BY 1""",
)
def _(t):
    return sh.last_turn_split(t.conversations, "conv_id", "turn")


@query(
    "seq2seq_rows",
    "I15",
    ansi.with_views(ansi.TURNS, f"x AS (SELECT conv_id, turn, {ansi.words('src')} AS a, {ansi.words('tgt')} AS b FROM turns)", "y AS (SELECT *, a[greatest(len(a) - 30, 1):len(a)] AS s, b[greatest(len(b) - 22, 1):len(b)] AS d FROM x)")
    + """SELECT conv_id, turn, array_to_string(list_concat(s, ['</s>']), ' ') AS source, array_to_string(list_concat(['<s>'], d), ' ') AS decoder_input, array_to_string(list_concat(d, ['</s>']), ' ') AS labels FROM y""",
)
def _(t):
    rows = views.turn_pairs(t.conversations)
    out = sh.seq2seq_rows(rows, words("src"), words("tgt"), F.lit("<s>"), F.lit("</s>"), 32, 24)
    return out.select("conv_id", "turn", *[F.array_join(c, " ").alias(c) for c in ("source", "decoder_input", "labels")])




def triples(t):
    """Query, positives and negatives per document, as words of the document itself."""
    sents = F.filter(F.split("text", r"[.!?]\s+|\n"), lambda s: F.trim(s) != "")
    return t.documents.select("doc_id", sents.alias("s")).filter(F.size("s") > 1).select(
        "doc_id", F.col("s")[0].alias("query"), F.slice("s", 2, 1).alias("positives"), F.slice("s", F.lit(3), F.size("s")).alias("negatives")
    )


TRIPLES = (
    "ss AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]\\s+|\\n'), lambda s_: trim(s_) <> '') AS s FROM documents), "
    "tr AS (SELECT doc_id, s[1] AS query, s[2:2] AS positives, s[3:] AS negatives FROM ss WHERE len(s) > 1)"
)


@query(
    "retrieval_negatives",
    "W11",
    f"""WITH {TRIPLES}, f AS (SELECT doc_id, len(negatives) AS n, negatives FROM tr WHERE len(negatives) > 0)
    SELECT doc_id, array_to_string(list_transform(range(3), lambda i_: negatives[CAST(i_ % n AS BIGINT) + 1]), '|') AS first_n FROM f""",
)
def _(t):
    rows = triples(t).filter(F.size("negatives") > 0)
    return rows.select("doc_id", F.array_join(od.take_negatives("negatives", 3), "|").alias("first_n"))


@query(
    "retrieval_negatives_random",
    "W11",
    f"""WITH {TRIPLES}, u AS (SELECT doc_id, unnest(negatives) AS x, unnest(range(len(negatives))) AS i, len(negatives) AS n FROM tr WHERE len(negatives) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {ansi.key(8, 'doc_id', 'i')}) AS r FROM u)
    SELECT doc_id, string_agg(x, '|' ORDER BY r) AS picked FROM r WHERE r <= 2 GROUP BY 1""",
)
def _(t):
    rows = triples(t).filter(F.size("negatives") > 0)
    return rows.select("doc_id", F.array_join(od.random_subset("negatives", 2, 8, "doc_id"), "|").alias("picked"))


@query(
    "retrieval_triples",
    "W13 I16",
    f"""WITH {TRIPLES}, x AS (SELECT doc_id, {ansi.words("'query: ' || query")} AS q, {ansi.words("'passage: ' || positives[1]")} AS p FROM tr)
    SELECT doc_id, array_to_string(list_concat(list_concat(['[B]'], q)[1:31], ['[E]']), ' ') AS query, array_to_string(list_concat(list_concat(['[B]'], p)[1:31], ['[E]']), ' ') AS positive FROM x""",
)
def _(t):
    rows = triples(t)
    out = sh.retrieval_rows(rows, F.col("query"), od.first_positive("positives"), F.col("negatives"), "[B]", "[E]", 32)
    return out.select("doc_id", F.array_join("query", " ").alias("query"), F.array_join("positive", " ").alias("positive"))


VOCAB = ["alpha", "beta", "gamma"]


def _mask_sql() -> str:
    d = lambda k: f"concat_ws('|', '{k}', CAST(doc_id AS VARCHAR), CAST(i_ - 1 AS VARCHAR))"
    u = lambda k: ansi.uniform(21, d(k))
    pick = f"['alpha', 'beta', 'gamma'][CAST({ansi.seeded_int(21, d('r'))} % 3 AS BIGINT) + 1]"
    return (
        f"SELECT doc_id, array_to_string(list_transform(w, lambda w_, i_: CASE WHEN {u('m')} >= 0.15 OR w_ IN ('the', 'de') THEN w_ WHEN {u('k')} < 0.8 THEN '[MASK]' WHEN {u('k')} < 0.9 THEN {pick} ELSE w_ END), ' ') AS input, "
        f"CAST(coalesce(list_sum(list_transform(w, lambda w_, i_: CASE WHEN {u('m')} >= 0.15 OR w_ IN ('the', 'de') THEN 0 ELSE 1 END)), 0) AS BIGINT) AS masked FROM w"
    )


@query("mask_words", "I10", f"WITH {W} {_mask_sql()}")
def _(t):
    out = sh.mask_words(doc_tokens(t), "tokens", "doc_id", 21, "[MASK]", VOCAB, special=["the", "de"])
    return out.select(
        "doc_id", F.array_join("input", " ").alias("input"), F.aggregate("targets", F.lit(0).cast("long"), lambda a, x: a + x).alias("masked")
    )


@query(
    "next_sentence_pairs",
    "I11",
    ansi.with_views(
        ansi.LINES,
        f"u AS (SELECT doc_id, pos, doc_id || ':' || pos AS id, {ansi.words('utt')} AS a FROM utterances)",
        "n AS (SELECT id, a, row_number() OVER (ORDER BY doc_id, pos) AS n, lead(a) OVER (ORDER BY doc_id, pos) AS succ, count(*) OVER () AS total FROM u)".replace("'t'", "'t'"),
        "r AS (SELECT *, "
        + ansi.uniform(31, "'t'", "id") + " < 0.5 AND succ IS NOT NULL AS is_next, "
        + ansi.seeded_int(31, "'p'", "id") + " % total + 1 AS pick, " + ansi.uniform(31, "'f'", "id") + " < 0.5 AS front FROM n)",
        "j AS (SELECT r.id, r.is_next, r.a, CASE WHEN r.is_next THEN r.succ ELSE o.a END AS b, front FROM r JOIN n o ON o.n = r.pick)",
        "k AS (SELECT *, CASE WHEN len(a) + len(b) <= 24 THEN len(a) WHEN len(b) <= 12 THEN 24 - len(b) WHEN len(a) <= 12 THEN len(a) ELSE 12 END AS ka FROM j)",
        "m AS (SELECT *, least(len(b), 24 - ka) AS kb FROM k)",
    )
    + "SELECT id, is_next, array_to_string(CASE WHEN front THEN a[len(a) - ka + 1:] ELSE a[1:ka] END, ' ') AS a, array_to_string(CASE WHEN front THEN b[len(b) - kb + 1:] ELSE b[1:kb] END, ' ') AS b FROM m",
)
def _(t):
    utt = views.numbered_utterances(t.documents).select(F.concat_ws(":", "doc_id", "pos").alias("id"), "utt", "n", "after")
    total = views.utterances(t.documents).count()
    return sh.next_sentence_pairs(utt, "id", "utt", 31, 24, number="n", after="after", total=total)


@query("corrupt_spans", "I12")
def _(t):
    out = sh.corrupt_variant(doc_tokens(t), "tokens", "doc_id", 41, "regular")
    return out.select("doc_id", F.array_join("encoder", " ").alias("encoder"), F.array_join("decoder", " ").alias("decoder"))


@query(
    "span_conservation",
    "I12",
    f"SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, true AS sentinels_match FROM ({W.replace('w AS (', '', 1)[:-1]}) WHERE len(w) > 0",
)
def _(t):
    out = sh.corrupt_variant(doc_tokens(t), "tokens", "doc_id", 41, "extreme").filter(F.size("tokens") > 0)
    is_mark = lambda x: x.startswith("<extra_id_")
    kept = F.size(F.filter("encoder", lambda x: ~is_mark(x))) + F.size(F.filter("decoder", lambda x: ~is_mark(x)))
    same = F.filter("encoder", is_mark) == F.filter("decoder", is_mark)
    return out.select("doc_id", kept.cast("long").alias("tokens"), same.alias("sentinels_match"))


@query(
    "prefix_split",
    "I14",
    f"""WITH {W}, x AS (SELECT doc_id, w, CASE WHEN len(w) > 1 THEN {ansi.seeded_int(43, 'doc_id')} % (len(w) - 1) + 1 ELSE len(w) END AS at_ FROM w)
    SELECT doc_id, array_to_string(w[1:at_], ' ') AS encoder, array_to_string(w[at_ + 1:], ' ') AS decoder FROM x""",
)
def _(t):
    out = sh.prefix_split(doc_tokens(t), "tokens", "doc_id", 43)
    return out.select("doc_id", F.array_join("encoder", " ").alias("encoder"), F.array_join("decoder", " ").alias("decoder"))


@query(
    "fill_in_middle",
    "I13",
    f"""WITH {W}, c AS (SELECT doc_id, w, len(w) AS n, {ansi.seeded_int(47, "'a'", 'doc_id')} % (len(w) + 1) AS a, {ansi.seeded_int(47, "'b'", 'doc_id')} % (len(w) + 1) AS b,
    {ansi.uniform(47, "'o'", 'doc_id')} < 0.5 AS spm, {ansi.uniform(47, "'u'", 'doc_id')} < 0.9 AS pick FROM w),
    p AS (SELECT doc_id, w, n, spm, pick, least(a, b) AS lo, greatest(a, b) AS hi FROM c),
    q AS (SELECT *, CASE WHEN lo > 0 THEN w[1:lo] ELSE [] END AS pre, w[lo + 1:hi] AS mid, w[hi + 1:hi + greatest(n - hi - 3, 0)] AS suf FROM p)
    SELECT doc_id, array_to_string(CASE WHEN NOT (pick AND n - hi >= 3) THEN w WHEN spm THEN list_concat(['<pre>', '<suf>'], suf, ['<mid>'], pre, mid) ELSE list_concat(['<pre>'], pre, ['<suf>'], suf, ['<mid>'], mid) END, ' ') AS fim FROM q""",
)
def _(t):
    out = sh.fill_in_middle(doc_tokens(t), "tokens", "doc_id", 47, 0.9, 0.5)
    return out.select("doc_id", F.array_join("fim", " ").alias("fim"))
