"""Language identification with interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language over the letters of words, each word between two boundary marks.
Counts come from all training texts in one pass. The highest order has raw counts, lower orders count distinct
left neighbours (n-grams that open a word keep raw counts, as nothing stands before them). Every n-gram and
every context keeps its own row, so the models grow with the texts.

The rows are written to the shared checkpoint folder and read there by the tasks, as arrays sorted by a 64-bit hash
of the n-gram with one column per language. Models of more than ``CELLS`` values, or in a folder that only
Spark can read, aren't read by tasks: the n-grams of the distinct words are joined to their rows instead.

A text goes to the language with the lowest cross-entropy per character. Texts whose cross-entropy lies
above what nearly all training texts of that language stay under are marked as rejected.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.seeded import seeded_mod
from weftline.llm.common import cut_lineage, salted_join
from weftline.session import ensure_checkpoint_dir, remove_folder

ORDER = 4
#: Share of a language's training texts that calibrated rejection lets pass.
PASS = 0.995
FOLDS, SEED = 10, 3
MARK = "\x02"
#: Spread of the uniform distribution under the lowest order: letters a model may meet.
ALPHABET = 2048
#: Words whose costs one worker remembers.
REMEMBERED = 300_000
#: Words that are taken apart at a time.
CHUNK = 20_000
#: Rows times languages of the models up to which every task reads them (4 bytes each).
CELLS = 32_000_000
#: Odd multipliers of the n-gram hash.
STEP, LETTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The models of ``identify``: of all training texts, and without the fold that calibrates rejection.
ALL, OTHERS = 0, 1

_LETTERS = re.compile(r"[^\W\d_]+").findall


def _words(text: str | None) -> list[str]:
    return _LETTERS((text or "").lower())


def _grams(words: list[str], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(marked words, (word, place in it, place in all) of every counted character, hashes of the 0, 1, ... characters that end there).

    Every character after the opening mark counts. At places nearer to the start of a word than n characters
    the hash of n is not meant.
    """
    marked = "".join(f"{MARK}{w}{MARK}" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    hashes = _chain(chars, order)
    inner = np.flatnonzero(place > 0)
    return marked, owner[inner], place[inner], inner, hashes


def _chain(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 0 .. ``order`` characters that end at each place: the hash of all but the last, a step on, plus the last."""
    one = (chars + np.uint64(1)) * LETTER
    one ^= one >> np.uint64(29)
    hashes = [np.zeros_like(chars)]
    for _ in range(order):
        before = np.zeros_like(chars)
        before[1:] = hashes[-1][:-1]
        hashes.append(before * STEP + one)
    return hashes


def gram_hashes(grams: list[str]) -> np.ndarray:
    """Hashes of whole n-grams, as in ``_chain``."""
    size = np.array([len(g) for g in grams], np.int64)
    if not size.sum():
        return np.zeros(len(grams), np.uint64)
    out, longest = np.zeros(len(grams), np.uint64), int(size.max())
    hashes = _chain(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), longest)
    for k in range(1, longest + 1):
        rows = np.flatnonzero(size == k)
        out[rows] = hashes[k][np.cumsum(size)[rows] - 1]
    return out


def gram_counts(docs: DataFrame, order: int = ORDER, aside: Column | None = None) -> DataFrame:
    """(lang, gram, n, m): raw counts of the longest n-gram that ends at each character, of all rows and of those not ``aside``.

    N-grams shorter than ``order`` open a word.
    """
    schema = "lang string, aside boolean, gram string, n long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple, Counter] = {}
            for lang, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                by.setdefault((lang, out), Counter()).update(_words(text.as_py()))
            for (lang, out), counts in by.items():
                words, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
                for lo in range(0, len(words), CHUNK):
                    marked, owner, place, at, hashes = _grams(words[lo : lo + CHUNK], order)
                    longest = np.minimum(place + 1, order)
                    code = np.choose(longest - 1, [h[at] for h in hashes[1:]])
                    _, first, which = np.unique(code, return_index=True, return_inverse=True)
                    n = np.bincount(which, times[lo : lo + CHUNK][owner]).astype(np.int64)
                    grams = [marked[e - k + 1 : e + 1] for e, k in zip(at[first].tolist(), longest[first].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([out] * len(grams), pa.bool_()), pa.array(grams, pa.string()), pa.array(n)], names=["lang", "aside", "gram", "n"])

    read = docs.filter("text is not null and lang is not null").select(F.col("lang").cast("string"), (F.lit(False) if aside is None else aside).alias("aside"), "text")
    total = F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("aside"), F.col("n"))), F.lit(0)).alias("m")
    return read.mapInArrow(cut, schema).groupBy("lang", "gram").agg(*total)


def model_rows(raw: DataFrame, order: int = ORDER) -> DataFrame:
    """(model, k, context, lang, gram, value): discounted probability of each n-gram, back-off weight of each context.

    ``raw`` has the rows of ``gram_counts``. Both models are made by the same joins and sums; each order is
    written before the next one is derived from it.
    """
    entries = F.explode(F.array(F.struct(F.lit(ALL).alias("model"), F.col("n")), F.struct(F.lit(OTHERS).alias("model"), F.col("m").alias("n"))))
    counts = cut_lineage(raw.select("lang", "gram", entries.alias("e")).select("e.model", "lang", "gram", "e.n").filter("n > 0"))
    level, out = None, None
    for k in range(order, 0, -1):
        raw_k = counts.filter(F.length("gram") == k)
        if level is not None:
            above = level.groupBy("model", "lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
            raw_k = above.unionByName(raw_k).groupBy("model", "lang", "gram").agg(F.sum("n").alias("n"))
        level = cut_lineage(raw_k)
        ones = level.groupBy("model", "lang").agg(F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        discount = F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))))
        ones = F.broadcast(ones.select("model", "lang", discount.alias("d")))  # a row per model and language
        placed = level.withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        ctx = placed.groupBy("model", "lang", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).join(ones, ["model", "lang"])
        alpha = placed.join(ctx, ["model", "lang", "ctx"]).select("model", F.lit(k).alias("k"), F.lit(False).alias("context"), "lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
        gamma = ctx.select("model", F.lit(k).alias("k"), F.lit(True).alias("context"), "lang", F.col("ctx").alias("gram"), (F.col("d") * F.col("kinds") / F.col("total")).alias("value"))
        part = alpha.unionByName(gamma)
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Per order: sorted hashes with a column of values per language, of n-grams and of contexts."""

    langs: tuple[str, ...]
    alphas: tuple[tuple[np.ndarray, np.ndarray], ...]
    gammas: tuple[tuple[np.ndarray, np.ndarray], ...]

    def word_cost(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, and in the last column its characters (with the closing mark)."""
        _, owner, place, at, hashes = _grams(words, len(self.alphas))
        p = np.full((len(owner), len(self.langs)), 1.0 / ALPHABET)
        for k in range(len(self.alphas)):
            alpha = _look(self.alphas[k], hashes[k + 1][at], 0.0)
            gamma = _look(self.gammas[k], hashes[k][at - 1], 1.0)
            p = np.where((place >= k)[:, None], alpha + gamma * p, p)
        bits = [np.bincount(owner, -np.log2(np.maximum(p[:, j], 1e-12)), len(words)) for j in range(len(self.langs))]
        return np.stack([*bits, np.bincount(owner, minlength=len(words))], 1)


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
    hashes, values = table
    if not len(hashes):
        return np.full((len(keys), values.shape[1]), default)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where((hashes[at] == keys)[:, None], values[at], default)


@dataclass(frozen=True)
class Models:
    """Rows of ``model_rows`` in a folder, with the languages of each model."""

    folder: str
    langs: tuple[tuple[str, ...], tuple[str, ...]]
    order: int
    cells: int

    def readable(self) -> bool:
        """Whether a task can hold the models, and open the folder without Spark."""
        if self.cells > CELLS:
            return False
        try:
            files, path = _open(self.folder)
            return bool(files.get_file_info(pyarrow.fs.FileSelector(path)))
        except (OSError, pa.ArrowException, ImportError):
            return False

    def read(self, model: int = ALL) -> LanguageModel | None:
        """The sorted arrays (None: no language)."""
        langs = self.langs[model]
        if not langs:
            return None
        files, path = _open(self.folder)
        rows = pyarrow.parquet.read_table(path, filesystem=files)
        rows = rows.filter(pc.equal(rows["model"], model))
        column = pc.index_in(rows["lang"], pa.array(langs)).to_numpy()
        keys, value = gram_hashes(rows["gram"].to_pylist()), rows["value"].to_numpy()
        k, context = rows["k"].to_numpy(), rows["context"].to_numpy()

        def table(level: int, contexts: bool, default: float) -> tuple[np.ndarray, np.ndarray]:
            picked = np.flatnonzero((k == level) & (context == contexts))
            hashes, at = np.unique(keys[picked], return_inverse=True)
            values = np.full((len(hashes), len(langs)), default, np.float32)
            values[at, column[picked]] = value[picked]
            return hashes, values

        levels = range(1, self.order + 1)
        return LanguageModel(langs, tuple(table(i, False, 0.0) for i in levels), tuple(table(i, True, 1.0) for i in levels))


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder))


@lru_cache(2)
def _scorers(models: Models) -> tuple[Scorer | None, Scorer | None]:
    """The scorers of this worker process; read once."""
    return tuple(m and Scorer(m) for m in (models.read(ALL), models.read(OTHERS)))


class Scorer:
    """Costs of whole texts, remembering those of words."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.known, self.table = model, {}, np.empty((0, len(model.langs) + 1))

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """Bits under each language and characters of each text, given as words (None: no words)."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        new = list(set().union(*texts).difference(self.known))
        costs = [self.model.word_cost(new[lo : lo + CHUNK]) for lo in range(0, len(new), CHUNK)]
        self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
        self.table = np.concatenate([self.table, *costs])
        known, table = self.known, self.table
        return [table[[known[w] for w in ws]].sum(0) if ws else None for ws in texts]


def fit(docs: DataFrame, order: int = ORDER, aside: Column | None = None) -> Models:
    """Models of all languages of ``docs``, in the shared folder."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/language-{uuid.uuid4().hex}"
    model_rows(gram_counts(docs, order, aside), order).write.parquet(folder)
    found = spark.read.parquet(folder).groupBy("model", "lang").count().collect()  # a row per model and language
    langs = tuple(tuple(sorted(r["lang"] for r in found if r["model"] == m)) for m in (ALL, OTHERS))
    return Models(folder, langs, order, sum(r["count"] for r in found) * max(map(len, langs)))


_COST = "struct<lang:string,entropy:double,score:double>"


def costs(docs: DataFrame, models: Models, columns: list[Column], aside: Column) -> DataFrame:
    """``columns`` with the answers of the model of all texts and, where ``aside`` holds, of the other model.

    An answer has lang, entropy (bits per character) and score (1 over the sum of the languages' likelihoods
    relative to the best). Texts without letters have none.
    """

    @F.arrow_udf(f"struct<main:{_COST},trial:{_COST}>")
    def of(texts: pa.Array, out: pa.Array) -> pa.Array:
        main, trial = _scorers(models)
        rows = []
        for lo in range(0, len(texts), 512):
            words = [_words(t.as_py()) for t in texts[lo : lo + 512]]
            held = [w if o else [] for w, o in zip(words, out[lo : lo + 512].to_pylist())]
            a, b = (s(ws) if s else [None] * len(ws) for s, ws in ((main, words), (trial, held)))
            rows += [{"main": _answer(main, x), "trial": _answer(trial, y)} for x, y in zip(a, b)]
        kind = pa.struct([("lang", pa.string()), ("entropy", pa.float64()), ("score", pa.float64())])
        return pa.array(rows, pa.struct([("main", kind), ("trial", kind)]))

    return docs.select(*columns, of("text", aside).alias("_c"))


def _answer(scorer: Scorer | None, total: np.ndarray | None) -> dict | None:
    if total is None:
        return None
    rate = total[:-1] / total[-1]
    best = int(np.argmin(rate))
    # evidence grows with the text, but its letters aren't independent: the square root of their number
    lift = np.exp2(np.maximum(-60, (rate[best] - rate) * np.sqrt(total[-1])))
    return {"lang": scorer.model.langs[best], "entropy": float(rate[best]), "score": float(1 / lift.sum())}


def costs_by_join(docs: DataFrame, models: Models, columns: list[Column], aside: Column) -> DataFrame:
    """As ``costs``, with the models' rows joined to the n-grams of distinct words; nothing of a model is held by a task."""
    order, rows = models.order, docs.sparkSession.read.parquet(models.folder)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, text in zip(b.column(0), b.column(1)):
                found = Counter(_words(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * len(found), pa.string()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["digest", "word", "times"])

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in b.column(0).to_pylist():
                marked = f"{MARK}{w}{MARK}"
                out += [(w, p, k, marked[p - k + 1 : p + 1], marked[p - k + 1 : p]) for p in range(1, len(marked)) for k in range(1, min(order, p + 1) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["word", "place", "k", "gram", "ctx"])

    keyed = docs.withColumn("_digest", F.md5("text"))
    worded = cut_lineage(keyed.filter("text is not null").select("_digest", "text").dropDuplicates(["_digest"]).mapInArrow(words_of, "digest string, word string, times long"))
    grams = worded.select("word").distinct().mapInArrow(grams_of, "word string, place int, k int, gram string, ctx string")
    both = None
    for model in (ALL, OTHERS):
        langs = models.langs[model]
        if not langs:
            continue
        values = rows.filter(F.col("model") == model).groupBy("k", "context", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "value"))).alias("v"))  # an entry per language
        alpha = values.filter("not context").select("k", "gram", F.col("v").alias("alpha"))
        gamma = values.filter("context").select("k", F.col("gram").alias("ctx"), F.col("v").alias("gamma"))
        met = salted_join(salted_join(grams, alpha, ["k", "gram"], "word", "left"), gamma, ["k", "ctx"], "word", "left")
        chars = met.groupBy("word", "place").agg(F.array_sort(F.collect_list(F.struct("k", "alpha", "gamma")), lambda a, b: a["k"] - b["k"]).alias("x"))  # at most ``order`` entries; maps have no order
        of = lambda m, lang, none: F.coalesce(F.element_at(m, F.lit(lang)), F.lit(none))
        step = lambda lang: lambda p, g: of(g["alpha"], lang, 0.0) + of(g["gamma"], lang, 1.0) * p
        p = [F.aggregate("x", F.lit(1.0 / ALPHABET), step(lang)) for lang in langs]
        bits = [(-F.log2(F.greatest(x, F.lit(1e-12)))).alias(f"b{i}") for i, x in enumerate(p)]
        word = chars.select("word", *bits).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"b{i}").alias(f"b{i}") for i in range(len(langs))])
        total = salted_join(worded, word, ["word"], "digest").groupBy("digest").agg(F.sum(F.col("n") * F.col("times")).alias("n"), *[F.sum(F.col(f"b{i}") * F.col("times")).alias(f"b{i}") for i in range(len(langs))])
        rate = F.array(*[F.struct((F.col(f"b{i}") / F.col("n")).alias("r"), F.lit(i).alias("i")) for i in range(len(langs))])
        best = total.select("digest", "n", rate.alias("rates"), F.array_min(rate).alias("best"))
        lift = F.aggregate("rates", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), F.greatest(F.lit(-60.0), (F.col("best.r") - x["r"]) * F.sqrt("n"))))
        name = F.element_at(F.array(*[F.lit(x) for x in langs]), F.col("best.i") + 1)
        answer = F.struct(name.alias("lang"), F.col("best.r").alias("entropy"), (1 / lift).alias("score"))
        part = best.select("digest", answer.alias("main" if model == ALL else "trial"))
        both = part if both is None else both.join(part, "digest", "left")
    if "trial" not in both.columns:
        both = both.withColumn("trial", F.lit(None).cast(_COST))
    joined = salted_join(keyed.filter("text is not null").withColumn("_row", F.xxhash64(*columns)), both.withColumnRenamed("digest", "_digest"), ["_digest"], "_row", "left")
    joined = joined.unionByName(keyed.filter("text is null"), allowMissingColumns=True)
    return joined.select(*columns, F.struct("main", F.when(aside, F.col("trial")).alias("trial")).alias("_c"))


def identify(docs: DataFrame, train: Column, order: int = ORDER, keep: float = PASS) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected for every row of ``docs``.

    Models are learned from the rows where ``train`` holds; lang is used for learning only. lang_pred is
    ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned. ``rejected``
    marks texts above the calibrated cross-entropy of their language: the ``keep`` quantile among the texts
    given that language in one of ``FOLDS`` folds of the training rows, by models of the other folds. The
    counts of that fold are added before anything is predicted. A language with too few of them for that
    quantile rejects none. Repeated rows get the same answer; an empty table an empty one. A task holds a text whole.
    """
    learned = F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull()
    aside = F.coalesce(seeded_mod(SEED, FOLDS, "doc_id") == 0, F.lit(False))
    models = fit(docs.filter(learned), order, aside)
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not models.langs[ALL]:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    judge = costs if models.readable() else costs_by_join
    rows = docs.select("doc_id", "text", has_letter.alias("_letter"), (learned & aside).alias("_aside"))
    judged = cut_lineage(judge(rows, models, [F.col("doc_id"), F.col("_letter")], F.col("_aside")))
    remove_folder(docs.sparkSession, models.folder)
    # milli-bits per character: exact ranks from counts of small integers
    tried = judged.filter("_letter and _c.trial is not null")
    marks = tried.groupBy(F.col("_c.trial.lang").alias("lang"), F.floor(F.col("_c.trial.entropy") * 1000).cast("long").alias("m")).count()
    found = sorted(tuple(r) for r in marks.collect())  # at most 40,000 values of each language
    limits: dict[str, float] = {}
    for lang in models.langs[ALL]:
        total, seen = sum(n for x, _, n in found if x == lang), 0
        for m in (f for f in found if f[0] == lang):
            seen += m[2]
            if seen >= keep * (total + 1):
                limits[lang] = (m[1] + 1) / 1000
                break
    pred = F.when(F.col("_letter"), F.col("_c.main.lang"))
    limit = F.lit(None).cast("double")
    for lang, v in limits.items():
        limit = F.when(pred == lang, v).otherwise(limit)
    rejected = pred.isNull() | F.coalesce(F.col("_c.main.entropy") > limit, F.lit(False))
    return judged.select("doc_id", F.coalesce(pred, F.lit("und")).alias("lang_pred"), F.when(pred.isNull(), 0.0).otherwise(F.col("_c.main.score")).alias("score"), F.col("_c.main.entropy").alias("cross_entropy"), rejected.alias("rejected"))
