"""Join operators: assembly, lookups, ranges, inverted index, pair sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.seeded import seeded_int, seeded_uniform
from weftline.functions.tokens import char_ngrams
from weftline.operators.ordered import running, seeded_rank
from weftline.session import cut_lineage


#: an index with at most this many n-grams is compiled into the expression
MAX_GRAM_LITERALS = 2_000


def keep_and_attach(df: DataFrame, keep: DataFrame, key: str, override: list[str] = ()) -> DataFrame:
    """Rows named by the keep list, its columns attached; columns in ``override`` win over the row's own."""
    kept = df.join(keep.select(key), key, "left_semi")
    extra = [c for c in keep.columns if c != key]
    joined = kept.join(keep.select(key, *[F.col(c).alias(f"_new_{c}") for c in extra]), key)
    own = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in override else F.col(c) for c in df.columns]
    return joined.select(*own, *[F.col(f"_new_{c}").alias(c) for c in extra if c not in df.columns])


def answer_lookup(df: DataFrame, keys: DataFrame, key: str, inline: str, answer: str = "answer") -> DataFrame:
    """Ground truth per row: the inline answer if not blank, else the key table; rows with neither are skipped."""
    looked = df.join(keys.select(key, F.col(answer).alias("_key_answer")), key, "left")
    own = F.when(F.trim(inline) != "", F.trim(inline))
    return looked.withColumn("truth", F.coalesce(own, "_key_answer")).withColumn("skipped", F.col("truth").isNull()).drop("_key_answer")


def overlap_join(
    segments: DataFrame, windows: DataFrame, key: str, bin_width: float, tolerance: float = 0.001, rebase: bool = True
) -> DataFrame:
    """Segments (key, start, end) that overlap windows (key, window_id, start_after, end_before).

    Both sides are cut into time bins, so the join is an equi-join on (key, bin) and a busy key is
    spread over its bins. A pair meets in the later of its two first bins only.
    """
    first = lambda c: F.floor(F.col(c) / bin_width).cast("long")
    seg = segments.withColumn("_fs", first("start")).withColumn("_bin", F.explode(F.sequence(F.col("_fs"), first("end"))))
    win = windows.withColumn("_fw", F.floor((F.col("start_after") - tolerance) / bin_width).cast("long")).withColumn(
        "_bin", F.explode(F.sequence(F.col("_fw"), F.floor((F.col("end_before") + tolerance) / bin_width).cast("long")))
    )
    hit = seg.join(win, [key, "_bin"]).filter(
        (F.col("_bin") == F.greatest("_fs", "_fw"))
        & (F.col("start") < F.col("end_before") + tolerance)
        & (F.col("end") > F.col("start_after") + tolerance)
    )
    if rebase:
        hit = hit.withColumn("end", F.col("end") - F.col("start_after")).withColumn("start", F.col("start") - F.col("start_after"))
    return hit.drop("_bin", "_fs", "_fw")


def frame_mask(
    segments: DataFrame, keys: list[str], speaker: str, rate: float, num_frames: Column, num_speakers: int, skip_unknown: bool = False
) -> DataFrame:
    """Active (speaker, frame) cells of segments, clipped to the window.

    A speaker index outside the mask raises, or is skipped with ``skip_unknown``.
    """
    ok = F.col(speaker).between(0, num_speakers - 1)
    if skip_unknown:
        segments = segments.filter(ok)
    else:
        segments = segments.filter(
            F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("speaker index outside the mask")).cast("boolean"))
        )
    lo = F.greatest(F.floor(F.col("start") * rate), F.lit(0)).cast("long")
    hi = F.least(F.floor(F.col("end") * rate), num_frames).cast("long") - 1
    # sequence counts down for empty ranges, so those are filtered first
    cells = segments.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_hi") >= F.col("_lo"))
    return cells.select(*keys, speaker, F.explode(F.sequence("_lo", "_hi")).alias("frame")).distinct()


def positional_zip(left: DataFrame, right: DataFrame, line: str) -> DataFrame:
    """Join two aligned files on the line number; a line without partner raises."""
    both = left.join(right, line, "full").withColumn("_ok", left[left.columns[-1]].isNotNull() & right[right.columns[-1]].isNotNull())
    checked = F.when(F.col("_ok"), F.lit(True)).otherwise(F.raise_error(F.lit("files differ in length")).cast("boolean"))
    return both.filter(checked).drop("_ok")


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """Left join of ``rows`` to a table with one row per ``key``; a key that most rows hold is met in ``salts`` tasks."""
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts).cast("long")).cast("int"))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def phrase_index(phrases: DataFrame, phrase: str, n: int, max_phrases: int | None = None, banned: DataFrame | None = None) -> DataFrame:
    """n-gram -> phrase. Banned n-grams go; ``max_phrases`` keeps the first phrases of an n-gram."""
    index = phrases.select(F.col(phrase).alias("phrase")).distinct().select("phrase", F.explode(F.array_distinct(char_ngrams(F.regexp_replace("phrase", r"\s+", "_"), n))).alias("gram"))
    if banned is not None:
        index = index.join(banned.select("gram"), "gram", "left_anti")
    if max_phrases is not None:
        # a limit of the operator itself; the ranking keeps at most max_phrases rows per map task
        rank = F.row_number().over(Window.partitionBy("gram").orderBy("phrase"))
        index = index.withColumn("_r", rank).filter(F.col("_r") <= max_phrases).drop("_r")
    return index


def _own_grams(text: Column, n: int, among: DataFrame | None) -> Column:
    """Distinct n-grams of a text; when ``among`` is small, the others go inside the row, before
    anything is exploded."""
    own = char_ngrams(F.regexp_replace(text, r"\s+", "_"), n)
    if among is not None:
        known = [r["gram"] for r in among.select("gram").distinct().limit(MAX_GRAM_LITERALS + 1).collect()]
        if len(known) <= MAX_GRAM_LITERALS:
            return F.array_intersect(own, F.array(*[F.lit(g) for g in known]).cast("array<string>"))
    return F.array_distinct(own)


def frequent_grams(texts: DataFrame, text: Column, n: int, percent: int, among: DataFrame | None = None) -> DataFrame:
    """n-grams (of ``among``, if given) that occur in at least ``percent`` % of the texts, counted map-side
    before the shuffle and written out: the list is small and read several times."""
    grams = texts.select(F.explode(_own_grams(text, n, among)).alias("gram"))
    return cut_lineage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 100 >= percent * texts.count()))


def phrase_candidates(fragments: DataFrame, keys: list[str], text: Column, index: DataFrame, n: int, top: int = 10) -> DataFrame:
    """Best ``top`` phrases per fragment by number of shared n-grams (ties by phrase)."""
    grams = fragments.select(*keys, F.explode(_own_grams(text, n, index)).alias("gram"))
    hits = grams.join(index, "gram").groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("shared"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("shared"), "phrase"))
    return hits.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)


def match_results(results: DataFrame, calls: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Attach the call name to every result by id; results without a call are ``<unmatched>``."""
    return results.join(calls.select(*keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit("<unmatched>")))


def _sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("m"))


def class_pairs(df: DataFrame, id_col: str, label: str, text: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` cross pairs for every unordered pair of classes.

    Rows of a class are shuffled by seed; the chosen pairs are evenly spaced among all
    ``m_a * m_b``, and only those are built: there is no cross join of rows.
    """
    ranked = seeded_rank(df.select(id_col, label, text), seed, id_col, by=[label])
    sizes = _sizes(df, label)
    # one row per class: every class lists the places of the classes before it
    placed = sizes.withColumn("_p", F.row_number().over(Window.orderBy(label)))
    a = placed.select(F.col(label).alias("a"), F.col("m").alias("ma"), "_p")
    b = placed.filter(F.col("_p") > 1).select(
        F.col(label).alias("b"), F.col("m").alias("mb"), F.explode(F.sequence(F.lit(1), F.col("_p") - 1)).alias("_p")
    )
    pairs = a.join(b, "_p").drop("_p")
    total = F.col("ma") * F.col("mb")
    take = F.least(total, F.lit(n).cast("long"))
    drawn = pairs.withColumn("take", take).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)))
    j = F.floor(F.col("i") * total / F.col("take")).cast("long")
    drawn = drawn.withColumn("j", j).select(
        "a", "b", "i", (F.floor(F.col("j") / F.col("mb")) + 1).cast("long").alias("ra"), (F.col("j") % F.col("mb") + 1).alias("rb")
    )
    left = ranked.select(F.col(label).alias("a"), F.col("rank").alias("ra"), F.col(id_col).alias("id_a"), F.col(text).alias("ta"))
    right = ranked.select(F.col(label).alias("b"), F.col("rank").alias("rb"), F.col(id_col).alias("id_b"), F.col(text).alias("tb"))
    out = drawn.join(left, ["a", "ra"]).join(right, ["b", "rb"])
    return out.select(
        "id_a", "id_b", F.concat_ws(" ", "ta", "tb").alias("text"), F.array_sort(F.array_union(F.array("a"), F.array("b"))).alias("labels")
    )


def synonym_pairs(names: DataFrame, id_col: str, concept: str, name: str, n: int, seed: int, p_train: float) -> DataFrame:
    """At most ``n`` pairs of names per concept, each assigned to train or validation by seed.

    Names are shuffled on a ring; pair ``p`` joins position ``p % m`` with the one ``p // m + 1``
    steps on, which lists every unordered pair once. Only the wanted pairs are built.
    """
    ranked = seeded_rank(names.select(id_col, concept, name), seed, id_col, by=[concept])
    sizes = _sizes(names, concept).filter(F.col("m") > 1)
    total = F.floor(F.col("m") * (F.col("m") - 1) / 2).cast("long")
    drawn = sizes.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.least(total, F.lit(n).cast("long")) - 1)))
    i = F.col("p") % F.col("m")
    k = (i + F.floor(F.col("p") / F.col("m")).cast("long") + 1) % F.col("m")
    drawn = drawn.select(concept, "p", (i + 1).alias("ri"), (k + 1).alias("rk"))
    one = ranked.select(concept, F.col("rank").alias("ri"), F.col(id_col).alias("id_1"), F.col(name).alias("name_1"))
    two = ranked.select(concept, F.col("rank").alias("rk"), F.col(id_col).alias("id_2"), F.col(name).alias("name_2"))
    out = drawn.join(one, [concept, "ri"]).join(two, [concept, "rk"])
    split = F.when(seeded_uniform(seed, "id_1", "id_2") < p_train, "train").otherwise("validation")
    return out.select(concept, "id_1", "id_2", "name_1", "name_2", split.alias("split"))


def canonical_names(names: DataFrame, concept: str, name: str, order: str) -> DataFrame:
    """First name of every concept that has no colon."""
    return names.filter(~F.contains(F.col(name), F.lit(":"))).groupBy(concept).agg(F.min_by(name, order).alias("name"))


def random_negatives(queries: DataFrame, query: str, n: int, pool_size: int, seed: int) -> DataFrame:
    """``n`` pool positions per query, drawn with replacement."""
    rows = queries.select(query, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return rows.withColumn("negative", seeded_int(seed, query, "i") % pool_size)


def neighbour_text(chunks: DataFrame, neighbours: DataFrame, chunk: str, text: str) -> DataFrame:
    """Chunk text with, per neighbour, the matching chunk and the one that follows it.

    ``neighbours``: chunk id, rank, neighbour (one row each), and the chunk's own text if it is at hand; the text
    of a chunk is then sent only to where its neighbours are.
    """
    match = chunks.select(F.col(chunk).alias("neighbour"), F.col(text).alias("match"))
    after = chunks.select((F.col(chunk) - 1).alias("neighbour"), F.col(text).alias("continuation"))
    if text not in neighbours.columns:
        neighbours = neighbours.join(chunks.select(chunk, text), chunk)
    own = neighbours.select(chunk, "rank", "neighbour", F.col(text).alias("text"))
    out = own.join(match, "neighbour").join(after, "neighbour", "left")
    return out.select(chunk, "rank", "neighbour", "text", "match", F.coalesce("continuation", F.lit("")).alias("continuation"))


def following(df: DataFrame, order: list[str], cols: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Value of the next row."""
    return running(df, order, by, lead=cols)
