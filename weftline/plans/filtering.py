"""Filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import is_blank, word_count, words
from weftline.operators import filters as fl
from weftline.operators import language as la
from weftline.plans import ansi
from weftline.plans.catalog import Tables, query
from weftline.sources import views


def chat_lengths(t: Tables):
    n_in, n_out = word_count("src"), word_count("tgt")
    return views.turn_pairs(t.conversations).select(
        "conv_id", "turn", n_in.alias("input_length"), n_out.alias("output_length"), (n_in + n_out).alias("total_length")
    )


CHAT_LENGTHS = ansi.TURNS + (
    f", lens AS (SELECT conv_id, turn, CAST(len({ansi.words('src')}) AS BIGINT) AS input_length, "
    f"CAST(len({ansi.words('tgt')}) AS BIGINT) AS output_length, "
    f"CAST(len({ansi.words('src')}) + len({ansi.words('tgt')}) AS BIGINT) AS total_length FROM turns)"
)


@query("filter_duration", "B1", ansi.with_views(ansi.UTT) + "SELECT id, duration FROM utt WHERE duration BETWEEN 5 AND 60")
def _(t):
    return fl.filter_duration(views.manifest_view(t.events), 5, 60).select("id", "duration")


@query(
    "duration_report",
    "B2",
    ansi.with_views(ansi.UTT)
    + """SELECT count(*) AS total_rows, CAST(count(*) FILTER (WHERE duration >= 5) AS BIGINT) AS kept_rows,
    round(sum(duration) / 3600, 6) AS total_hours, round(sum(duration) FILTER (WHERE duration >= 5) / 3600, 6) AS kept_hours
    FROM utt""",
)
def _(t):
    return fl.duration_report(views.manifest_view(t.events), 5, None)


@query(
    "filter_tokens",
    "B3",
    ansi.with_views(CHAT_LENGTHS) + "SELECT conv_id, turn, total_length FROM lens WHERE total_length BETWEEN 20 AND 120",
)
def _(t):
    return fl.filter_tokens(chat_lengths(t), 20, 120, total=True).select("conv_id", "turn", "total_length")


@query(
    "filter_tokens_per_second",
    "B4",
    ansi.with_views(ansi.UTT) + "SELECT id, num_tokens FROM utt WHERE num_tokens / duration BETWEEN 0.5 AND 8",
)
def _(t):
    return fl.filter_tokens_per_second(views.manifest_view(t.events), 0.5, 8).select("id", "num_tokens")


@query(
    "filter_tokens_per_token",
    "B5",
    ansi.with_views(CHAT_LENGTHS)
    + "SELECT conv_id, turn FROM lens WHERE output_length / input_length BETWEEN 0.5 AND 3",
)
def _(t):
    return fl.filter_tokens_per_token(chat_lengths(t), 0.5, 3).select("conv_id", "turn")


@query(
    "filter_length_ratio",
    "B7 S4",
    ansi.with_views(CHAT_LENGTHS)
    + """SELECT conv_id, turn, input_length BETWEEN 1 AND 512 AND output_length BETWEEN 1 AND 512
    AND NOT (input_length / output_length > 1.3 OR output_length / input_length > 1.3) AS kept FROM lens""",
)
def _(t):
    return fl.mark_length_ratio(views.turn_pairs(t.conversations), "src", "tgt").select("conv_id", "turn", "kept")


@query(
    "filter_length_single",
    "B7",
    f"SELECT doc_id, len({ansi.words('text')}) BETWEEN 1 AND 512 AS kept FROM documents",
)
def _(t):
    return fl.mark_length_ratio(t.documents, "text", None).select("doc_id", "kept")


def _language_sql(text: str, keys: str = "doc_id, lang", table: str = "documents") -> str:
    tok = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+'), lambda w_: w_ <> '')"
    codes = sorted(fl.LANGUAGE_PROFILES)
    lists = {k: "[" + ", ".join(f"'{w}'" for w in fl.LANGUAGE_PROFILES[k]) + "]" for k in codes}
    counts = ", ".join(
        f"len(list_filter(toks, lambda w_: list_contains({lists[k]}, w_))) AS n_{k}" for k in codes
    )
    best = "greatest(" + ", ".join(f"n_{k}" for k in codes) + ")"
    case = " ".join(f"WHEN n_{k} = {best} THEN '{k}'" for k in codes)
    return f"""SELECT {keys}, CASE WHEN {best} = 0 THEN NULL {case} END AS detected FROM
    (SELECT {keys}, {counts} FROM (SELECT {keys}, {tok} AS toks FROM {table}))"""


@query("filter_language", "B8", f"SELECT doc_id FROM ({_language_sql('text')}) WHERE detected = lang")
def _(t):
    return fl.filter_language(t.documents, [("text", F.col("lang"))]).select("doc_id")


@query(
    "filter_language_pairs",
    "B8",
    ansi.with_views(ansi.TURNS, f"a AS ({_language_sql('src', 'conv_id, turn', 'turns')})", f"b AS ({_language_sql('tgt', 'conv_id, turn', 'turns')})")
    + """SELECT a.conv_id, a.turn, coalesce(a.detected = 'en' AND b.detected = 'en', false) AS kept FROM a JOIN b USING (conv_id, turn)""",
)
def _(t):
    pairs = views.turn_pairs(t.conversations)
    good = fl.filter_language(pairs, [("src", "en"), ("tgt", "en")]).select("conv_id", "turn", F.lit(True).alias("kept"))
    return pairs.select("conv_id", "turn").join(good, ["conv_id", "turn"], "left").fillna(False, ["kept"])


def _lined_sql(x: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower(coalesce({x}, '')), '\\p{{L}}+'), ' ') || ' '"


PROFILES = (
    f"lined AS (SELECT lang, {_lined_sql('text')} AS s FROM documents WHERE lang IS NOT NULL), "
    "triples AS (SELECT lang, substr(s, i, 3) AS triple FROM (SELECT lang, s, unnest(range(1, length(s) - 1)) AS i FROM lined) WHERE substr(s, i + 1, 1) <> ' '), "
    "counts AS (SELECT lang, triple, count(*) AS n FROM triples GROUP BY 1, 2), "
    "totals AS (SELECT lang, CAST(sum(n) + count(*) AS DOUBLE) AS total FROM counts GROUP BY 1), "
    "profiles AS (SELECT lang, triple, CAST(floor(1000 * ln((n + 1) / total)) AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, triple) AS r FROM counts) JOIN totals USING (lang) WHERE r <= 1000 "
    "UNION ALL SELECT lang, NULL, CAST(floor(1000 * ln(1 / total)) AS BIGINT) FROM totals)"
)


def _learned_sql(name: str, text: str, keys: str, source: str) -> str:
    """View ``name`` with the detected language of ``text`` for each value of ``keys``."""
    return (
        f"{name}_t AS (SELECT {keys}, substr(s, i, 3) AS triple FROM (SELECT {keys}, s, unnest(range(1, length(s) - 1)) AS i FROM (SELECT {keys}, {_lined_sql(text)} AS s FROM {source})) WHERE substr(s, i + 1, 1) <> ' '), "
        f"{name}_n AS (SELECT {keys}, triple, count(*) AS n FROM {name}_t GROUP BY ALL), "
        f"{name}_s AS (SELECT {keys}, o.lang, sum(n * coalesce(p.weight, o.weight)) AS score FROM {name}_n t JOIN profiles o ON o.triple IS NULL LEFT JOIN profiles p ON p.lang = o.lang AND p.triple = t.triple GROUP BY {keys}, o.lang), "
        f"{name} AS (SELECT {keys}, lang AS detected FROM {name}_s QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, lang) = 1)"
    )


@query("language_profiles", "B8", ansi.with_views(PROFILES) + "SELECT * FROM profiles")
def _(t):
    return la.language_profiles(t.documents, "text", "lang")


@query("filter_language_learned", "B8", ansi.with_views(PROFILES, _learned_sql("found", "text", "doc_id", "documents")) + "SELECT doc_id FROM documents JOIN found USING (doc_id) WHERE detected = lang")
def _(t):
    detect = la.learned_detector(la.language_profiles(t.documents, "text", "lang"))
    return fl.filter_language(t.documents, [("text", F.col("lang"))], detect).select("doc_id")


@query(
    "filter_pairs_learned",
    "B8",
    ansi.with_views(PROFILES, ansi.TURNS, _learned_sql("a", "src", "conv_id, turn", "turns"), _learned_sql("b", "tgt", "conv_id, turn", "turns"))
    + "SELECT t.conv_id, t.turn, a.detected AS src_lang, b.detected AS tgt_lang, coalesce(a.detected = 'en' AND b.detected = 'en', false) AS kept FROM turns t LEFT JOIN a USING (conv_id, turn) LEFT JOIN b USING (conv_id, turn)",
)
def _(t):
    """Both sides of a pair, accepted and refused ones."""
    detect = la.learned_detector(la.language_profiles(t.documents, "text", "lang"))
    pairs = views.turn_pairs(t.conversations).select("conv_id", "turn", detect("src").alias("src_lang"), detect("tgt").alias("tgt_lang"))
    return pairs.withColumn("kept", F.coalesce((F.col("src_lang") == "en") & (F.col("tgt_lang") == "en"), F.lit(False)))


@query(
    "filter_min_count",
    "B11",
    """SELECT user_id, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 67""",
)
def _(t):
    return fl.filter_min_count(t.events, "user_id", 67).select("user_id", "event_id")


@query(
    "drop_long_rows",
    "B10",
    ansi.with_views(ansi.TURNS) + "SELECT conv_id, turn FROM turns WHERE length(src) + length(tgt) <= 4 * 100",
)
def _(t):
    return fl.drop_long(views.turn_pairs(t.conversations), 100, ["src", "tgt"]).select("conv_id", "turn")


def tagged_words(t: Tables):
    """Every word as a (class, spoken, written) triple of its utterance."""
    return (
        views.utterances(t.documents)
        .select("doc_id", "pos", "lang", "source", F.explode(words("utt")).alias("written"))
        .select(
            "doc_id",
            "pos",
            F.col("lang").alias("cls"),
            F.lower(F.regexp_replace("written", "[^A-Za-z]", "")).alias("spoken"),
            "written",
            "source",
        )
    )


TAGGED = ansi.LINES + (
    ", tagged AS (SELECT doc_id, pos, lang AS cls, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS spoken, w AS written, source "
    f"FROM (SELECT doc_id, pos, lang, source, unnest({ansi.words('utt')}) AS w FROM utterances))"
)


@query(
    "drop_bad_sentences",
    "B12 E4",
    ansi.with_views(
        TAGGED,
        "banned AS (SELECT DISTINCT lower(cls) AS cls, lower(spoken) AS spoken, lower(written) AS written FROM tagged WHERE source = 'src3' AND length(written) >= 9)",
        "bad AS (SELECT DISTINCT t.doc_id, t.pos FROM tagged t JOIN banned b ON lower(t.cls) = b.cls AND lower(t.spoken) = b.spoken AND lower(t.written) = b.written)",
    )
    + "SELECT t.doc_id, t.pos, count(*) AS words FROM tagged t ANTI JOIN bad b ON t.doc_id = b.doc_id AND t.pos = b.pos GROUP BY 1, 2",
)
def _(t):
    toks = tagged_words(t)
    banned = toks.filter((F.col("source") == "src3") & (F.length("written") >= 9))
    kept = fl.drop_bad_sentences(toks, banned, ["doc_id", "pos"], ["cls", "spoken", "written"])
    return kept.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("words"))


@query(
    "filter_words_part",
    "B13",
    f"""SELECT doc_id FROM (SELECT doc_id, len({ansi.words('text')}) AS n, row_number() OVER (ORDER BY doc_id) AS rn,
    count(*) OVER () AS total FROM documents)
    WHERE n BETWEEN 50 AND 500 AND rn > total * 1 // 3 AND rn <= total * 2 // 3""",
)
def _(t):
    return fl.filter_words(t.documents, "text", 50, 500, "doc_id", part=1, parts=3).select("doc_id")


@query(
    "word_count_report",
    "B13",
    f"""SELECT CAST(count(*) FILTER (WHERE n BETWEEN 50 AND 500) AS BIGINT) AS kept_rows,
    CAST(coalesce(sum(n) FILTER (WHERE n BETWEEN 50 AND 500), 0) AS BIGINT) AS kept_words,
    CAST(coalesce(sum(n) FILTER (WHERE NOT n BETWEEN 50 AND 500), 0) AS BIGINT) AS skipped_words
    FROM (SELECT len({ansi.words('text')}) AS n FROM documents)""",
)
def _(t):
    return fl.word_report(t.documents, "text", 50, 500)


@query(
    "clean_sentences",
    "B14",
    ansi.with_views(
        ansi.LINES,
        f"ok AS (SELECT doc_id, pos, {ansi.words('utt')} AS w FROM utterances WHERE regexp_matches(trim(utt), '^[A-Z][A-Za-z.,''?\\s]+$'))",
        f"cut AS (SELECT CASE WHEN {ansi.uniform(7, 'doc_id', 'pos')} < 0.3 THEN array_to_string(w[1:len(w) // 2], ' ') ELSE array_to_string(w, ' ') END AS utt, row_number() OVER (ORDER BY doc_id, pos) AS n FROM ok)",
    )
    + "SELECT CAST((n - 1) // 3 AS BIGINT) AS row, string_agg(utt, ' ' ORDER BY n) AS utt FROM cut GROUP BY 1",
)
def _(t):
    utt = views.utterances(t.documents).select("doc_id", "pos", "utt")
    return fl.clean_sentences(utt, "utt", ["doc_id", "pos"], seed=7, p_cut=0.3, n_combine=3)


@query(
    "clean_lengths",
    "B15",
    ansi.with_views(ansi.LINES)
    + f"SELECT doc_id, pos FROM utterances WHERE len({ansi.words('utt')}) BETWEEN 3 AND 25",
)
def _(t):
    return fl.clean_lengths(views.utterances(t.documents), "utt", 3, 25).select("doc_id", "pos")


@query(
    "conversation_issues",
    "B17",
    """WITH calls AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN '<TOOLCALL>' || text
      WHEN role = 'user' AND turn > 0 THEN '<TOOL_RESPONSE>' || text ELSE '' END AS call FROM conversations),
    firsts AS (SELECT conv_id, arg_min(role, turn) AS first_role, min(turn) AS t0, count(*) AS turns FROM calls GROUP BY 1),
    rest AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS i FROM calls c JOIN firsts f
      ON c.conv_id = f.conv_id AND c.turn > f.t0 WHERE trim(call) <> ''),
    agg AS (SELECT conv_id, count(*) AS n, bool_or(i % 2 = 0 AND NOT contains(call, '<TOOLCALL>')) AS wc,
      bool_or(i % 2 = 1 AND NOT contains(call, 'TOOL_RESPONSE')) AS wr FROM rest GROUP BY 1),
    both_ AS (SELECT conv_id, bool_or(call <> '' AND trim(text) <> '') AS b FROM calls GROUP BY 1)
    SELECT f.conv_id, f.turns, concat_ws('; ',
      CASE WHEN first_role <> 'system' THEN 'first role is ' || first_role END,
      CASE WHEN coalesce(n, 0) = 0 THEN 'no calls' END,
      CASE WHEN coalesce(n, 0) % 2 <> 0 THEN n || ' calls is odd' END,
      CASE WHEN wc THEN 'call expected' END, CASE WHEN wr THEN 'response expected' END,
      CASE WHEN b THEN 'text and call in one turn' END) AS issues
    FROM firsts f LEFT JOIN agg a ON f.conv_id = a.conv_id LEFT JOIN both_ o ON f.conv_id = o.conv_id""",
)
def _(t):
    call = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("<TOOLCALL>"), "text"))
        .when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(F.lit("<TOOL_RESPONSE>"), "text"))
        .otherwise("")
    )
    out = fl.conversation_issues(t.conversations.withColumn("call", call))
    return out.withColumn("issues", F.array_join("issues", "; "))


@query(
    "repair_supervisions",
    "B18",
    """SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (WHERE role <> 'assistant') AS BIGINT) AS patched,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(length(text) AS VARCHAR) ELSE '' END, '|' ORDER BY turn) AS functions
    FROM conversations GROUP BY 1""",
)
def _(t):
    custom = F.when(F.col("role") == "assistant", F.create_map(F.lit("function"), F.length("text").cast("string"))).when(
        F.col("role") == "user", F.create_map(F.lit("lang"), F.lit("en"))
    )
    convs = (
        t.conversations.withColumn("custom", custom)
        .groupBy("conv_id")
        .agg(F.collect_list(F.struct("turn", "custom")).alias("sups"))
        .withColumn("sups", F.array_sort("sups", lambda a, b: (a["turn"] - b["turn"]).cast("int")))
    )
    fixed = fl.repair_map(convs, "sups", "function")
    lacking = F.filter("sups", lambda s: s["custom"].isNull() | ~F.map_contains_key(s["custom"], "function"))
    return convs.select("conv_id", F.size(lacking).cast("long").alias("patched")).join(
        fixed.select(
            "conv_id",
            F.size("sups").cast("long").alias("turns"),
            F.array_join(F.transform("sups", lambda s: s["custom"]["function"]), "|").alias("functions"),
        ),
        "conv_id",
    )


BUDGET = (
    f"sized AS (SELECT conv_id, turn, role, text, len({ansi.words('text')}) AS n FROM conversations), "
    "body AS (SELECT conv_id, sum(n) AS tokens, count(*) AS segments FROM sized WHERE NOT (turn = 0 AND role = 'system') AND trim(text) <> '' GROUP BY 1), "
    "sys AS (SELECT conv_id, sum(n + 2) AS system_tokens FROM sized WHERE turn = 0 AND role = 'system' GROUP BY 1), "
    "budget AS (SELECT coalesce(b.conv_id, s.conv_id) AS conv_id, CAST(coalesce(system_tokens, 0) AS BIGINT) AS system_tokens, "
    "CAST(coalesce(tokens, 0) + ceil(coalesce(segments, 0) / 2) * 2 + floor(coalesce(segments, 0) / 2) AS BIGINT) AS segment_tokens "
    "FROM body b FULL JOIN sys s ON b.conv_id = s.conv_id)"
)


@query(
    "token_budget",
    "B19",
    f"WITH {BUDGET} SELECT *, system_tokens + segment_tokens AS total_tokens, 150 - system_tokens - segment_tokens AS headroom, system_tokens + segment_tokens > 150 AS dropped FROM budget",
)
def _(t):
    return fl.token_budget(t.conversations, 150, "conv_id", "turn", word_count("text"))


@query(
    "token_budget_by_domain",
    "B19",
    f"""WITH {BUDGET} SELECT conv_id % 4 AS domain, count(*) AS conversations, max(system_tokens + segment_tokens) AS max_tokens,
    CAST(count(*) FILTER (WHERE system_tokens + segment_tokens > 150) AS BIGINT) AS dropped FROM budget GROUP BY 1""",
)
def _(t):
    out = fl.token_budget(t.conversations, 150, "conv_id", "turn", word_count("text"))
    return fl.budget_summary(out.withColumn("domain", F.col("conv_id") % 4), "domain")


@query(
    "blank_text",
    "B20",
    ansi.with_views(ansi.LINES) + "SELECT doc_id, pos, regexp_replace(utt, '\\s+', '', 'g') = '' AS blank FROM utterances",
)
def _(t):
    return views.utterances(t.documents).select("doc_id", "pos", is_blank("utt").alias("blank"))


@query(
    "result_coverage",
    "B21",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'present' ELSE 'silent' END AS status, count(*) AS rows
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def _(t):
    status = F.when(F.col("quality") == 1, "present").otherwise("silent")
    return fl.coverage(t.documents.select("doc_id"), t.labels, "doc_id", status)
