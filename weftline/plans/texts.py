"""Text function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.metrics.overlap import tokenize_13a
from weftline.plans import ansi
from weftline.plans.catalog import query
from weftline.sources import views


@query("normalize_answer", "C1", f"SELECT doc_id, {ansi.normal_answer('text')} AS answer FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.normalize_answer("text").alias("answer"))


@query(
    "normalize_answer_zh",
    "C2",
    "SELECT doc_id, array_to_string(string_split(regexp_replace(text, '[‘’“”…、。〈〉《》「」『』【】〔〕！（），．：；？]', '', 'g'), ''), ' ') AS answer FROM documents",
)
def _(t):
    return t.documents.select("doc_id", tx.normalize_answer_zh("text").alias("answer"))


@query(
    "remove_punctuation",
    "C3",
    "SELECT doc_id, regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_])\\s+([.,;!?])', '\\1\\2', 'g'), '[!-&(-/:-@\\[-`{-~]', '', 'g') AS plain FROM documents",
)
def _(t):
    return t.documents.select("doc_id", tx.remove_punctuation(tx.strip_space_before_punctuation("text")).alias("plain"))


@query("clean_label", "C4 C5", f"SELECT doc_id, {ansi.clean_label_sql('text')} AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.clean_label("text").alias("label"))


@query("english_clean", "C6")
def _(t):
    return t.documents.select("doc_id", tx.english_clean("text").alias("clean"))


def _fold_sql(x: str) -> str:
    source = "".join(tx.DIACRITICS.values())
    target = "".join(k * len(v) for k, v in tx.DIACRITICS.items())
    return f"replace(replace(translate({x}, '{source}', '{target}'), 'æ', 'ae'), 'œ', 'oe')"


@query("fold_diacritics", "C7", f"SELECT doc_id, {_fold_sql('text')} AS folded FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.fold_diacritics("text").alias("folded"))


@query(
    "conversation_clean",
    "C8",
    "SELECT conv_id, turn, regexp_replace(translate(replace(replace(replace(lower(text), '.period', 'period'), '.dot', 'dot'), '-hyphen', 'hyphen'), "
    "'()*;:\"!&{},.-?', ''), '''([a-z]+)''', '\\1', 'g') AS clean FROM conversations",
)
def _(t):
    return t.conversations.select("conv_id", "turn", tx.conversation_clean("text").alias("clean"))


@query(
    "render_template",
    "C9",
    "SELECT p_partkey, 'Item: ' || p_name || chr(10) || 'Brand: ' || p_brand || ' (' || p_type || ') size ' || p_size AS prompt FROM part",
)
def _(t):
    prompt = tx.render_template("Item: {p_name}\\nBrand: {p_brand} ({p_type}) size {p_size}", t.part.columns)
    return t.part.select("p_partkey", prompt.alias("prompt"))


@query(
    "conditional_normalize",
    "C10",
    f"SELECT doc_id, CASE WHEN lang = 'en' THEN {ansi.clean_label_sql('text')} ELSE lower(text) END AS normalized_text FROM documents",
)
def _(t):
    value = F.when(F.col("lang") == "en", tx.clean_label("text")).otherwise(F.lower("text"))
    return t.documents.select("doc_id", value.alias("normalized_text"))


SENTENCES = (
    "prep AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(text, chr(10), ' '), '--', ' -- '), '. . .', '...'), "
    "'([.?!])([\"''”])', '\\2\\1 ', 'g'), ' +', ' ', 'g') AS s FROM documents), "
    "merged AS (SELECT doc_id, regexp_replace(s, '([a-z]\\.)\\s([a-z]\\.)', '\\1\\2', 'g') AS s FROM prep), "
    "toks AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, list_filter(string_split(s, ' '), lambda w_: w_ <> '') AS w FROM merged)), "
    "ends AS (SELECT *, regexp_matches(w, '[.?!]$') AND NOT regexp_matches(w, '[\\p{L}\\p{N}_]\\.[\\p{L}\\p{N}_].$') AND NOT regexp_matches(w, '[A-Z][a-z]\\.$') "
    "AND NOT regexp_matches(w, '[A-Z]\\.$') AS e FROM toks), "
    "numbered AS (SELECT doc_id, w, i, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends), "
    "sents AS (SELECT doc_id, k, string_agg(w, ' ' ORDER BY i) AS sentence FROM numbered GROUP BY 1, 2)"
)


@query(
    "split_sentences",
    "C11 U7",
    ansi.with_views(SENTENCES)
    + "SELECT doc_id, sentence, count(*) AS n FROM sents WHERE regexp_matches(sentence, '[\\p{L}\\p{N}]') GROUP BY 1, 2",
)
def _(t):
    rows = t.documents.select("doc_id", F.explode(tx.split_sentences("text")).alias("sentence"))
    return rows.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("split_sentences_extra", "C11")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.split_sentences("text", extra=[","])).alias("pos", "sentence"))


@query(
    "time_tokens",
    "C12",
    "SELECT event_id, '<t' || CAST(least(greatest(round_even(value * 99 / 400.0, 0), 0), 99) AS INTEGER) || '>' AS token FROM events",
)
def _(t):
    return t.events.select("event_id", tx.quantized_time_token(F.col("value"), F.lit(400.0), 100).alias("token"))


@query(
    "stamped_words",
    "C13",
    ansi.with_views(ansi.LINES, f"w AS (SELECT doc_id, pos, {ansi.words('utt')} AS w FROM utterances)")
    + """SELECT doc_id, pos, CAST(len(w) AS BIGINT) AS words, array_to_string(w, ' ') AS plain, CAST(3 * len(w) AS BIGINT) AS last_end,
    round(3 * len(w) * 0.08::DOUBLE, 6) AS last_second FROM w WHERE len(w) > 0""",
)
def _(t):
    marked = F.array_join(
        F.transform(
            tx.words("utt"),
            lambda w, i: F.concat(F.lit("<|"), (i * 3 + 1).cast("string"), F.lit("|> "), w, F.lit(" <|"), (i * 3 + 3).cast("string"), F.lit("|>")),
        ),
        " ",
    )
    rows = views.utterances(t.documents).filter(tx.has_word("utt")).withColumn("marked", marked)
    return rows.select("doc_id", "pos", "marked", tx.stamped_words("marked", 0.08).alias("s")).select(
        "doc_id",
        "pos",
        F.size("s").cast("long").alias("words"),
        tx.stamped_plain("marked", "s").alias("plain"),
        F.element_at("s", -1)["end_offset"].alias("last_end"),
        F.round(F.element_at("s", -1)["end"], 6).alias("last_second"),
    )


#: answers: even conversations name a letter in one of three ways, odd ones are free text
def answer_text(conv="conv_id", turn="turn", text="text"):
    letter = F.substring(F.lit("abcd"), 1, 4)
    pick = F.element_at(F.split(letter, ""), ((F.col(conv) + F.col(turn)) % 4 + 1).cast("int"))
    style = F.col(turn) % 3
    named = (
        F.when(style == 0, F.concat(F.lit("The answer is "), pick, F.lit(". "), F.col(text)))
        .when(style == 1, F.concat(F.upper(pick), F.lit(") "), F.col(text)))
        .otherwise(F.concat(F.col(text), F.lit(" I would choose option "), pick))
    )
    return F.when(F.col(conv) % 2 == 0, named).otherwise(F.col(text))


ANSWER_SQL = (
    "CASE WHEN conv_id % 2 = 0 THEN CASE turn % 3 WHEN 0 THEN 'The answer is ' || 'abcd'[(conv_id + turn) % 4 + 1] || '. ' || text "
    "WHEN 1 THEN upper('abcd'[(conv_id + turn) % 4 + 1]) || ') ' || text ELSE text || ' I would choose option ' || 'abcd'[(conv_id + turn) % 4 + 1] END ELSE text END"
)


def choice_sql(x: str) -> str:
    parts = []
    for template in tx.CHOICE_TEMPLATES:
        for c in "abcd":
            needle = ansi.quote(template.replace("[CHOICE]", c)).replace("\n", "' || chr(10) || '")
            parts.append(f"WHEN contains({x}, {needle}) THEN '{c.upper()}'")
    for c in "abcd":
        parts.append(f"WHEN regexp_matches({x}, '^{c}([.,:)]|$)') THEN '{c.upper()}'")
    return "CASE " + " ".join(parts) + " END"


@query(
    "extract_choice",
    "C14",
    f"SELECT conv_id, turn, {choice_sql('a')} AS choice FROM (SELECT conv_id, turn, lower({ANSWER_SQL}) AS a FROM conversations)",
)
def _(t):
    return t.conversations.select("conv_id", "turn", tx.extract_choice(answer_text()).alias("choice"))


@query(
    "sample_key",
    "C15",
    "SELECT page_id, split_part(split_part(list_last(string_split(url, '/')), '.', 1), '_dup', 1) AS key FROM pages",
)
def _(t):
    return t.pages.select("page_id", tx.sample_key("url").alias("key"))


@query(
    "likert_label",
    "C16",
    "SELECT doc_id, 'quality:' || CAST(round_even(quality * 0.625 * 4, 0) AS INTEGER) || ',toxic:' || CAST(round_even((toxic + 1) * 0.375 * 4, 0) AS INTEGER) AS label FROM labels",
)
def _(t):
    label = tx.likert_label({"quality": F.col("quality") * 0.625, "toxic": (F.col("toxic") + 1) * 0.375}, 5)
    return t.labels.select("doc_id", label.alias("label"))


@query(
    "punctuation_labels",
    "C17",
    f"""SELECT doc_id, array_to_string(list_transform({ansi.words('text')}, lambda w_: (CASE WHEN right(w_, 1) IN (',', '.', '?') THEN right(w_, 1) ELSE 'O' END)
    || (CASE WHEN regexp_matches(w_, '^\\p{{Lu}}') THEN 'U' ELSE 'O' END)), ' ') AS labels,
    array_to_string(list_filter(list_transform({ansi.words('text')}, lambda w_: regexp_replace(lower(w_), '[^\\p{{L}}\\p{{N}}_]', '', 'g')), lambda w_: w_ <> ''), ' ') AS plain FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        F.array_join(tx.punctuation_labels("text"), " ").alias("labels"),
        tx.punctuation_free("text").alias("plain"),
    )


@query(
    "word_fragments",
    "C18",
    f"""SELECT doc_id, CAST(i // 8 AS BIGINT) AS part, array_to_string(w[i + 1:i + 10], ' ') AS fragment FROM
    (SELECT doc_id, w, unnest(range(0, len(w), 8)) AS i FROM (SELECT doc_id, {ansi.words('text')} AS w FROM documents))""",
)
def _(t):
    rows = t.documents.select("doc_id", F.posexplode(tx.fragments(tx.words("text"), 10, 8)).alias("part", "fragment"))
    return rows.withColumn("part", F.col("part").cast("long"))


@query(
    "joined_segments",
    "C19",
    "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.!?]\\s+|\\n'), lambda s_: "
    + ansi.squeeze("regexp_replace(lower(s_), '[!-&(-/:-@\\[-`{-~]', '', 'g')")
    + "), lambda s_: s_ <> ''), ' | ') AS joined FROM documents",
)
def _(t):
    segments = F.split("text", r"[.!?]\s+|\n")
    return t.documents.select("doc_id", tx.joined_segments(segments, " | ").alias("joined"))


@query(
    "apply_tags",
    "C20",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform({ansi.words('text')}, lambda w_, i_: CASE WHEN i_ % 5 = 0 THEN 'new word' WHEN i_ % 3 = 0 THEN '' ELSE w_ END),
    lambda w_: w_ <> ''), ' ') AS written FROM documents""",
)
def _(t):
    toks = tx.words("text")
    tags = F.transform(
        toks,
        lambda w, i: F.when((i + 1) % 5 == 0, F.lit("new_word")).when((i + 1) % 3 == 0, F.lit("<DELETE>")).otherwise(F.lit("<SELF>")),
    )
    return t.documents.select("doc_id", tx.apply_tags(toks, tags).alias("written"))


def _noise_sql() -> str:
    def draw(kind: str) -> str:
        return f"concat_ws('|', '{kind}', CAST(doc_id AS VARCHAR), CAST(i_ - 1 AS VARCHAR))"

    u = lambda k: ansi.uniform(11, draw(k))
    r = lambda k: ansi.seeded_int(11, draw(k))
    j = f"CAST({r('sp')} % greatest(length(w_) - 1, 1) AS INTEGER)"
    swap = f"CASE WHEN {u('s')} < 0.3 AND length(w_) > 1 THEN substr(w_, 1, {j}) || substr(w_, {j} + 2, 1) || substr(w_, {j} + 1, 1) || substr(w_, {j} + 3) ELSE w_ END"
    d = f"CAST({r('dp')} % greatest(length(w_), 1) AS INTEGER)"
    drop = f"CASE WHEN {u('d')} < 0.2 AND length(w_) > 1 THEN substr(w_, 1, {d}) || substr(w_, {d} + 2) ELSE w_ END"
    return (
        f"SELECT doc_id, array_to_string(list_transform(list_transform({ansi.words('text')}, lambda w_, i_: {swap}), lambda w_, i_: {drop}), ' ') AS noisy FROM documents"
    )


@query("typo_noise", "C21", _noise_sql())
def _(t):
    return t.documents.select("doc_id", tx.typo_noise("text", "doc_id", 11, 0.3, 0.2).alias("noisy"))


@query(
    "label_and_slots",
    "C22",
    "SELECT doc_id, lang AS label, 'source(' || source || ')|size(' || n_chars || ')' AS slots FROM documents",
)
def _(t):
    raw = F.concat(F.lit("intent: "), "lang", F.lit(" slots: source("), "source", F.lit("), size("), F.col("n_chars").cast("string"), F.lit(")"))
    parsed = t.documents.select("doc_id", tx.label_and_slots(raw).alias("p"))
    return parsed.select("doc_id", "p.label", F.array_join("p.slots", "|").alias("slots"))


@query(
    "prompt_blocks",
    "C23",
    "SELECT conv_id, turn, role || chr(10) || chr(10) || '<AVAILABLE_TOOLS>[' || turn || ']</AVAILABLE_TOOLS>' AS prompt, text AS response FROM conversations",
)
def _(t):
    old = F.concat("role", F.lit("\n\n<AVAILABLE_TOOLS>"), "text", F.lit("</AVAILABLE_TOOLS>"))
    body = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]"))
    wrapped = F.to_json(F.struct(F.col("text").alias("content")))
    return t.conversations.select(
        "conv_id",
        "turn",
        tx.swap_block(old, "AVAILABLE_TOOLS", body).alias("prompt"),
        tx.unnest_response(wrapped).alias("response"),
    )


@query(
    "bleu_tokens",
    "F9 U3",
    f"""WITH a AS (SELECT doc_id, ' ' || replace(replace(replace(replace(replace(replace(replace(text, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ' AS s FROM documents),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g'), '([^0-9])([.,])', '\\1 \\2 ', 'g'), '([.,])([^0-9])', ' \\1 \\2', 'g'), '([0-9])(-)', '\\1 \\2 ', 'g') AS s FROM a)
    SELECT doc_id, array_to_string({ansi.words('s')}, ' ') AS tokens FROM b""",
)
def _(t):
    return t.documents.select("doc_id", F.array_join(tokenize_13a(F.col("text")), " ").alias("tokens"))
