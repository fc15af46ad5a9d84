"""Row filters. Each is one predicate on native expressions, so it can reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scoped import let
from weftline.functions.seeded import seeded_uniform
from weftline.functions.text import is_blank, words
from weftline.operators.ordered import number_rows


def filter_duration(df: DataFrame, lo: float = 0.0, hi: float = float("inf"), col: str = "duration") -> DataFrame:
    """Keep ``lo <= duration <= hi``; rows without a duration (text) pass."""
    return df.filter(F.col(col).isNull() | F.col(col).between(lo, hi))


def duration_report(df: DataFrame, lo: float | None, hi: float | None, col: str = "duration") -> DataFrame:
    """Kept and total rows and hours; a bound of 0 or None is not applied."""
    keep = F.lit(True)
    keep = keep & (F.col(col) >= lo) if lo else keep
    keep = keep & (F.col(col) <= hi) if hi else keep
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.sum(keep.cast("long")).alias("kept_rows"),
        F.round(F.sum(col) / 3600, 6).alias("total_hours"),
        F.round(F.sum(F.when(keep, F.col(col))) / 3600, 6).alias("kept_hours"),
    )


def filter_tokens(df: DataFrame, lo: float, hi: float, total: bool = False, strict: bool = True) -> DataFrame:
    """Keep rows whose input (or total) token count lies in range.

    Rows with a ``duration`` and no counts are audio and pass; text rows without counts are
    unformatted and raise.
    """
    n = F.col("total_length") if total else F.col("input_length")
    audio = F.col("duration").isNotNull() if "duration" in df.columns else F.lit(False)
    missing = F.raise_error(F.lit("text row without token counts: tokenise before filtering")) if strict else F.lit(False)
    keep = F.when(audio, F.lit(True)).when(n.isNull(), missing.cast("boolean")).otherwise(n.between(lo, hi))
    return df.filter(keep)


def filter_ratio(df: DataFrame, num: Column, den: Column, lo: float, hi: float | list | None) -> DataFrame:
    """Keep ``lo <= num/den <= hi``; a list-valued or absent upper bound switches the filter off.

    A row whose denominator is zero has no ratio and goes.
    """
    if hi is None or isinstance(hi, (list, tuple)):
        return df
    return df.filter(F.try_divide(num, den).between(lo, hi))


def filter_tokens_per_second(df: DataFrame, lo: float, hi: float | list | None) -> DataFrame:
    return filter_ratio(df, F.col("num_tokens"), F.col("duration"), lo, hi)


def filter_tokens_per_token(df: DataFrame, lo: float, hi: float | list | None) -> DataFrame:
    return filter_ratio(df, F.col("output_length"), F.col("input_length"), lo, hi)


def mark_length_ratio(
    df: DataFrame, src: str, tgt: str | None, lo: int = 1, hi: int = 512, ratio: float = 1.3
) -> DataFrame:
    """Flag parallel (or, with ``tgt=None``, single) rows by word counts and length ratio.

    One pass with a flag, so the kept and the removed side are two views of the same scan.
    """
    a = F.size(words(src))
    keep = a.between(lo, hi)
    if tgt is not None:
        b = F.size(words(tgt))
        keep = keep & b.between(lo, hi) & ~((a / b > ratio) | (b / a > ratio))
    return df.withColumn("kept", F.coalesce(keep, F.lit(False)))


def split_by_flag(df: DataFrame, flag: str = "kept") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag)).drop(flag), df.filter(~F.col(flag)).drop(flag)


# Frequent function words per language.
LANGUAGE_PROFILES = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "by", "this", "are"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "auf", "den", "von", "zu", "sich", "für"],
    "fr": ["le", "la", "les", "et", "des", "est", "une", "dans", "que", "qui", "pour", "avec", "un", "du", "elle"],
    "es": ["el", "los", "las", "y", "que", "en", "por", "una", "con", "para", "es", "se", "del", "no", "como"],
}


def _among(values: list[str]):
    return lambda w: w.isin(values)


def detect_language(c: Column | str, profiles: dict[str, list[str]] | None = None) -> Column:
    """Language whose function words occur most often; null if none occurs (ties: first by code).

    One split and one set lookup per word leave only function words; the languages count on those.
    """
    profiles = profiles or LANGUAGE_PROFILES
    every = sorted({w for ws in profiles.values() for w in ws})
    known = F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}]+"), _among(every))

    def best(found: Column) -> Column:
        scores = [
            F.struct(F.size(F.filter(found, _among(profiles[k]))).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("lang"))
            for i, k in enumerate(sorted(profiles))
        ]
        return F.greatest(*scores)

    return let(let(known, best), lambda x: F.when(x["n"] > 0, x["lang"]))


def filter_language(df: DataFrame, checks: list[tuple[str, str | Column]], detector=detect_language) -> DataFrame:
    """Keep rows whose every text column is in its wanted language; undetectable rows go."""
    keep = F.lit(True)
    for col, wanted in checks:
        keep = keep & F.coalesce(detector(col) == (F.lit(wanted) if isinstance(wanted, str) else wanted), F.lit(False))
    return df.filter(keep)


def filter_segments(
    df: DataFrame,
    max_cer: float = 30,
    max_wer: float = 75,
    max_edge_cer: float = 60,
    max_len_diff: float = 0.3,
    min_dur: float = 1,
    max_dur: float = 20,
) -> DataFrame:
    """Keep well-aligned segments. The length difference is the one computed on words."""
    return df.filter(
        (F.col("cer") <= max_cer)
        & (F.col("wer") <= max_wer)
        & (F.col("start_cer") <= max_edge_cer)
        & (F.col("end_cer") <= max_edge_cer)
        & (F.col("len_diff_ratio") <= max_len_diff)
        & (F.col("duration") > min_dur)
        & (F.col("duration") < max_dur)
    )


def drop_long(df: DataFrame, max_tokens: int, cols: list[str], chars_per_token: int = 4) -> DataFrame:
    """Drop rows whose summed characters exceed ``chars_per_token * max_tokens``."""
    total = sum((F.length(c) for c in cols), F.lit(0))
    return df.filter(total <= chars_per_token * max_tokens)


def filter_min_count(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep classes with at least ``n`` rows: count per class, then a join on the class.

    The counts come from a partial aggregation; a hot class adds no load to any task.
    """
    enough = df.groupBy(col).count().filter(F.col("count") >= n).select(col)
    return df.join(enough, col, "left_semi")


def drop_bad_sentences(tokens: DataFrame, banned: DataFrame, sentence: list[str], triple: list[str]) -> DataFrame:
    """Drop whole sentences that contain any banned triple, case-folded."""
    fold = lambda d: d.select(*sentence, *[F.lower(c).alias(c) for c in triple]) if d is tokens else d.select(
        *[F.lower(c).alias(c) for c in triple]
    ).distinct()
    bad = fold(tokens).join(fold(banned), triple, "left_semi").select(*sentence).distinct()
    return tokens.join(bad, sentence, "left_anti")


def filter_words(df: DataFrame, col: str, lo: int, hi: int, id_col: str, part: int = 0, parts: int = 1) -> DataFrame:
    """Contiguous part ``part`` of ``parts`` (floor division of the row number), word count in range."""
    n = F.size(words(col))
    if parts == 1:
        return df.filter(n.between(lo, hi))
    total = df.count()
    first, last = total * part // parts, total * (part + 1) // parts
    # ids are numbered alone; texts stay where they are until few are left
    inside = number_rows(df.select(id_col), [id_col]).filter((F.col("row_no") > first) & (F.col("row_no") <= last))
    return df.filter(n.between(lo, hi)).join(inside.select(id_col), id_col, "left_semi")


def word_report(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Rows and words kept, and words skipped, by a word-count range."""
    n = F.size(words(col)).cast("long")
    keep = n.between(lo, hi)
    return df.agg(
        F.sum(keep.cast("long")).alias("kept_rows"),
        F.coalesce(F.sum(F.when(keep, n)), F.lit(0)).cast("long").alias("kept_words"),
        F.coalesce(F.sum(F.when(~keep, n)), F.lit(0)).cast("long").alias("skipped_words"),
    )


def clean_sentences(
    df: DataFrame,
    col: str,
    order: list[str],
    seed: int,
    p_cut: float = 0.0,
    n_combine: int = 1,
    n_rows: int | None = None,
) -> DataFrame:
    """Whitelisted sentences, some cut in half, ``n_combine`` neighbours joined per output row."""
    ok = df.filter(F.trim(col).rlike(r"^[A-Z][A-Za-z.,'?\s]+$")).withColumn(col, F.trim(col))
    toks = words(col)
    if p_cut > 0:
        half = F.array_join(F.slice(toks, 1, F.floor(F.size(toks) / 2).cast("int")), " ")
        ok = ok.withColumn(col, F.when(seeded_uniform(seed, *order) < p_cut, half).otherwise(F.array_join(toks, " ")))
    numbered = number_rows(ok, order, out="_n")
    if n_rows is not None:
        numbered = numbered.filter(F.col("_n") <= n_rows * n_combine)
    group = F.floor((F.col("_n") - 1) / n_combine).cast("long")
    return (
        numbered.groupBy(group.alias("row"))
        .agg(F.sort_array(F.collect_list(F.struct("_n", col))).alias("_s"))
        .select("row", F.array_join(F.transform("_s", lambda s: s[col]), " ").alias(col))
    )


def clean_lengths(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Keep rows with ``lo <= tokens <= hi``."""
    return df.filter(F.size(words(col)).between(lo, hi))


def drop_unlearnable(df: DataFrame, mask: str, seq_len: int) -> DataFrame:
    """Drop rows with nothing to learn inside the context window (or with no mask at all)."""
    seen = F.exists(F.slice(F.col(mask), 1, seq_len), lambda m: m == 1)
    return df.filter(F.coalesce(seen, F.lit(False)))


def conversation_issues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation with its list of structural problems.

    Expected: the first role is system, at least one call/response exists, calls and responses
    alternate and are even in number, no turn carries both text and a call.
    Columns used: ``role``, ``text``, ``call`` (null when the field is missing).
    """
    entry = F.struct(F.col(turn).alias("turn"), "role", "text", "call")
    conv_rows = turns.groupBy(conv).agg(F.sort_array(F.collect_list(entry)).alias("t"))
    rest = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    calls = F.filter(rest, lambda x: F.coalesce(F.trim(x["call"]), F.lit("")) != "")
    wrong_call = F.exists(
        F.filter(F.transform(calls, lambda x, i: F.struct(i.alias("i"), x["call"].alias("c"))), lambda y: y["i"] % 2 == 0),
        lambda y: ~F.contains(y["c"], F.lit("<TOOLCALL>")),
    )
    wrong_reply = F.exists(
        F.filter(F.transform(calls, lambda x, i: F.struct(i.alias("i"), x["call"].alias("c"))), lambda y: y["i"] % 2 == 1),
        lambda y: ~y["c"].rlike("TOOL_?RESPONSE"),
    )
    both = F.exists("t", lambda x: (F.coalesce(x["call"], F.lit("")) != "") & (F.coalesce(F.trim(x["text"]), F.lit("")) != ""))
    issues = F.array_compact(
        F.array(
            F.when(F.col("t")[0]["role"] != "system", F.concat(F.lit("first role is "), F.col("t")[0]["role"])),
            F.when(F.exists(rest, lambda x: x["call"].isNull()), F.lit("call field missing")),
            F.when(F.size(calls) == 0, F.lit("no calls")),
            F.when(F.size(calls) % 2 != 0, F.concat(F.size(calls).cast("string"), F.lit(" calls is odd"))),
            F.when(wrong_call, F.lit("call expected")),
            F.when(wrong_reply, F.lit("response expected")),
            F.when(both, F.lit("text and call in one turn")),
        )
    )
    return conv_rows.select(conv, F.size("t").cast("long").alias("turns"), issues.alias("issues"))


def repair_map(df: DataFrame, col: str, key: str, default: str = "") -> DataFrame:
    """Give every map of an array of supervisions (field ``custom``) a value for ``key``."""

    def fix(s: Column) -> Column:
        custom = F.coalesce(s["custom"], F.create_map().cast("map<string,string>"))
        patched = F.when(F.map_contains_key(custom, key), custom).otherwise(
            F.map_concat(custom, F.create_map(F.lit(key), F.lit(default)))
        )
        return s.withField("custom", patched)

    return df.withColumn(col, F.transform(col, fix))


def token_budget(turns: DataFrame, budget: int, conv: str, turn: str, n_tokens: Column) -> DataFrame:
    """Prompt cost per conversation: system tokens + 2, then +2 and +1 for alternating segments."""
    is_system = (F.col(turn) == 0) & (F.col("role") == "system")
    body = turns.filter(~is_system & ~is_blank("text"))
    sizes = body.groupBy(conv).agg(
        F.sum(n_tokens).cast("long").alias("tokens"), F.count(F.lit(1)).alias("segments")
    )
    system = turns.filter(is_system).groupBy(conv).agg(F.sum(n_tokens + 2).cast("long").alias("system_tokens"))
    out = sizes.join(system, conv, "full").fillna(0)
    seg = F.col("tokens") + F.ceil(F.col("segments") / 2) * 2 + F.floor(F.col("segments") / 2)
    total = F.col("system_tokens") + seg
    return out.select(
        conv,
        "system_tokens",
        seg.cast("long").alias("segment_tokens"),
        total.cast("long").alias("total_tokens"),
        (F.lit(budget) - total).cast("long").alias("headroom"),
        (total > budget).alias("dropped"),
    )


def budget_summary(budgets: DataFrame, domain: str) -> DataFrame:
    """Per domain: conversations, the dearest one, and how many are dropped."""
    return budgets.groupBy(domain).agg(
        F.count(F.lit(1)).alias("conversations"),
        F.max("total_tokens").alias("max_tokens"),
        F.sum(F.col("dropped").cast("long")).alias("dropped"),
    )


def coverage(expected: DataFrame, results: DataFrame, key: str, status: Column) -> DataFrame:
    """Expected rows left-joined with results, counted by status; absent results are ``missing``."""
    seen = results.select(key, status.alias("status"))
    return (
        expected.join(seen, key, "left")
        .groupBy(F.coalesce("status", F.lit("missing")).alias("status"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
