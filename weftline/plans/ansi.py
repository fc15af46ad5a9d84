"""Building blocks of the check SQL (DuckDB)."""

from __future__ import annotations

from weftline.functions import text as tx


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w_: w_ <> '')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def key(seed: int | str, *ids: str) -> str:
    return f"md5(concat_ws('|', '{seed}', " + ", ".join(f"CAST({i} AS VARCHAR)" for i in ids) + "))"


def seeded_int(seed: int | str, *ids: str) -> str:
    return f"CAST(('0x' || substr({key(seed, *ids)}, 1, 8)) AS BIGINT)"


def uniform(seed: int | str, *ids: str) -> str:
    return f"({seeded_int(seed, *ids)} / 4294967296.0::DOUBLE)"


UTT = (
    "utt AS (SELECT event_id AS id, user_id AS speaker, event_type AS cls, value AS duration, "
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS num_tokens, ts FROM events)"
)

LINES = (
    "utterances AS (SELECT doc_id, lang, source, CAST(unnest(range(len(parts))) AS BIGINT) AS pos, unnest(parts) AS utt "
    "FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '[.!?]\\s+|\\n') AS parts FROM documents))"
)

PAIRS = (
    LINES
    + ", refs AS (SELECT doc_id, pos, lang, source, "
    + words("lower(regexp_replace(utt, '[^ -~]', '', 'g'))")
    + " AS r FROM utterances), "
    "pairs AS (SELECT doc_id, pos, lang, source, r, flatten(list_transform(r, lambda w_, i_: CASE WHEN i_ % 7 = 0 "
    "THEN CASE WHEN pos % 2 = 1 THEN [w_, '<added>'] ELSE [] END WHEN i_ % 5 = 0 THEN ['<unk>'] ELSE [w_] END)) AS h FROM refs WHERE len(r) > 0)"
)

TURNS = (
    "turns AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a "
    "ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
)

PRED = (
    "pred AS (SELECT l.doc_id, lang, toxic, quality AS truth, CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS pred, "
    "least(1.0::DOUBLE, n_chars / 4000.0::DOUBLE) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
)

SPANS = (
    "spans AS (SELECT event_id AS id, user_id AS speaker, round(epoch_us(ts) / 1e6, 3) AS \"start\", "
    "round(epoch_us(ts) / 1e6 + value, 3) AS \"end\", event_type AS cls FROM events)"
)

#: Kinds of errors of a pair. Unknown and added words never match, so no alignment has more matches than there
#: are other words heard, nor fewer deletions or insertions than the lengths differ by.
UNKNOWN_WORDS = "len(list_filter(h, lambda w_: w_ = '<unk>'))"
MISSING, EXTRA = "greatest(len(r) - len(h), 0)", "greatest(len(h) - len(r), 0)"
HEARD = "len(list_filter(h, lambda w_: w_ NOT IN ('<unk>', '<added>')))"
PAIR_ERRORS = f"(abs(len(r) - len(h)) + {UNKNOWN_WORDS})"


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ", ".join(views) + " "


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lower_clean_sql(x: str) -> str:
    spaces = "".join(ch for ch in dict.fromkeys(tx.LABEL_TO_SPACE) if ch not in tx.LABEL_TO_BLANK)
    out = f"lower(trim({x}))"
    for ch in dict.fromkeys(tx.LABEL_TO_BLANK):
        out = f"replace({out}, {quote(ch)}, '')"
    return f"translate({out}, {quote(spaces)}, {quote(' ' * len(spaces))})"


def clean_label_sql(x: str) -> str:
    names = "[" + ", ".join(quote(w) for w in tx.DIGIT_WORDS) + "]"
    spell = (
        f"array_to_string(list_transform(list_filter(string_split(ltrim(w_, '0'), ''), lambda d_: d_ <> ''), "
        f"lambda d_: {names}[CAST(d_ AS INTEGER) + 1]), ' ')"
    )
    spelled = f"list_transform({words(lower_clean_sql(x))}, lambda w_: CASE WHEN regexp_full_match(w_, '[0-9]+') THEN {spell} ELSE w_ END)"
    return f"array_to_string(list_filter({spelled}, lambda w_: w_ <> ''), ' ')"


def normal_answer(x: str) -> str:
    """Answer normalisation in SQL."""
    plain = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter({words(plain)}, lambda w_: w_ NOT IN ('a', 'an', 'the')), ' ')"
