"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

1. One pass over the texts writes a forward index: for each document its number of terms and the asked
   terms it holds with their frequencies. Aggregates of it give the corpus counts.
2. A task takes the documents of its partition in shards of bounded size and turns each into inverted
   lists. For each query, short lists are summed first (term at a time) into accumulators sorted by document.
   They then act as one iterator with a bound: its largest sum. Long lists and this iterator are merged by
   document, in ranges of ``RANGE`` documents: a range is skipped if the sum of its bounds cannot reach the
   score of the worst of the best so far; else lists are opened from the highest bound on, until the bounds of
   those that are left can't lift a new document that far, and the rest are only probed at the candidates.
3. Every partition hands on its best rows of each query; they are merged in two steps.

Queries are taken in blocks of bounded size, so what is sent to the executors has a bound whatever their
number. Nothing is approximate: a bound only skips documents that can't be among the best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import cut_lineage

TOP = 10
#: Terms with repeats of the queries that are answered together (a longer query is a block of its own).
BLOCK = 500_000
#: Postings and documents of a shard, and documents of a range.
POSTINGS, SHARD, RANGE = 1 << 21, 1 << 16, 4096
#: Lists of at most one in so many documents of a shard are short.
SHORT = 16
#: Slices of a query's rows before the last merge.
SLICES = 64

#: Separators become blanks and ASCII letters small; other bytes are parts of terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def forward_index(docs: DataFrame, asked: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, term and tf of every document; term (places in the sorted ``asked``) and tf are arrays of the same length in int32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(asked)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for b in batches:
            n, term, tf = [], [], []
            for t in b.column(1):
                words = terms(t.as_py())
                n.append(len(words))
                found = [(place[w], c) for w, c in Counter(words).items() if w in place]
                pairs = np.array(found, "<i4").reshape(-1, 2)
                term.append(pairs[:, 0].tobytes())
                tf.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "term", "tf"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("term", T.BinaryType()), T.StructField("tf", T.BinaryType())])
    return docs.select(doc_id, docs[text].cast("binary").alias("text")).mapInArrow(run, schema)


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df): documents that hold each asked term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            every = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4")
            total.update(dict(zip(*(x.tolist() for x in np.unique(every, return_counts=True)))))
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], names=["term", "df"])

    return index.select("term").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass(frozen=True)
class Query:
    """A query as places of its terms and what each adds to a score per impact: weight times repeats."""

    number: int
    terms: np.ndarray
    factor: np.ndarray


@dataclass(frozen=True)
class _List:
    """An inverted list: documents ascending, and what each adds to the score."""

    docs: np.ndarray
    adds: np.ndarray

    def probe(self, docs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[at] == docs, self.adds[at], 0)


class Shard:
    """Inverted lists of some documents."""

    def __init__(self, n: np.ndarray, term: list[bytes], tf: list[bytes], vocabulary: int, documents: int, words: int) -> None:
        owner = np.repeat(np.arange(len(n), dtype=np.int32), [len(t) // 4 for t in term])
        every, times = np.frombuffer(b"".join(term), "<i4"), np.frombuffer(b"".join(tf), "<i4").astype(np.int64)
        order = np.argsort(every, kind="stable")  # documents stay in order inside a term
        length = 100 - 75 + (75 * n.astype(np.int64) * documents) // max(words, 1)
        impact = (1_000_000_000 * times) // (1000 * times + 8 * length[owner])
        self.size, self.docs, self.impact = len(n), owner[order], impact[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(every, minlength=vocabulary))))

    def lists(self, query: Query) -> list[_List]:
        found = []
        for t, f in zip(query.terms.tolist(), query.factor.tolist()):
            lo, hi = self.start[t], self.start[t + 1]
            if hi > lo and f > 0:
                found.append(_List(self.docs[lo:hi], self.impact[lo:hi] * f))
        return found

    def best(self, query: Query, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best with at least ``floor`` and above 0; of equal scores the first documents."""
        short, long = [], []
        for x in self.lists(query):
            (short if len(x.docs) * SHORT <= self.size else long).append(x)
        iterators = long
        if short:
            docs, at = np.unique(np.concatenate([x.docs for x in short]), return_inverse=True)
            sums = np.zeros(len(docs), np.int64)
            np.add.at(sums, at, np.concatenate([x.adds for x in short]))
            iterators = [_List(docs, sums), *long]
        kept_docs, kept = np.empty(0, np.int64), np.empty(0, np.int64)
        floor = max(floor, 1)
        for lo in range(0, self.size if iterators else 0, RANGE):
            docs, scores = self._range(iterators, lo, lo + RANGE, floor)
            if not len(docs):
                continue
            kept_docs, kept = np.concatenate((kept_docs, docs)), np.concatenate((kept, scores))
            if len(kept) > top:
                order = np.lexsort((kept_docs, -kept))[:top]
                kept_docs, kept = kept_docs[order], kept[order]
            if len(kept) == top:
                floor = max(floor, int(kept.min()) + 1)  # later documents lose ties
        order = np.lexsort((kept_docs, -kept))
        return kept_docs[order], kept[order]

    @staticmethod
    def _range(iterators: list[_List], lo: int, hi: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents of a range with at least ``floor``, and their scores."""
        parts = []
        for x in iterators:
            a, b = np.searchsorted(x.docs, (lo, hi))
            if b > a:
                parts.append((int(x.adds[a:b].max()), _List(x.docs[a:b], x.adds[a:b])))
        parts.sort(key=lambda p: -p[0])
        left = sum(p[0] for p in parts)
        if left < floor:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # documents that are in none of the lists opened so far can't reach the floor once the others' bounds fall below it
        opened = 0
        while left >= floor:
            left -= parts[opened][0]
            opened += 1
        scores = np.zeros(hi - lo, np.int64)
        for _, x in parts[:opened]:
            scores[x.docs - lo] += x.adds
        docs = np.flatnonzero(scores)
        scores = scores[docs]
        for bound, x in parts[opened:]:
            may = scores + left >= floor
            docs, scores = docs[may], scores[may]
            scores = scores + x.probe(docs + lo)
            left -= bound
        may = scores >= floor
        return docs[may] + lo, scores[may]


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item with a score above 0.

    Equal scores stand by ascending doc_id, null ids last. Null and empty texts have no terms: such documents
    count for nothing, such items get no rows. Every row is a document or an item of its own, so a
    repeated document takes as many ranks and a repeated item is answered as often. Empty tables give an
    empty one. The counts of rows and terms must leave 75 * words * documents within 64 bits. A task holds
    a text and a shard at a time.
    """
    fields = [items.schema[item_id], T.StructField("item", T.LongType()), docs.schema[doc_id], T.StructField("score", T.LongType())]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(("item_id", "item", "doc_id", "score"), fields)])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))):
        out = out.unionByName(_search_block(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), block, schema, top))
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES).cast("long"))
    first = out.withColumn("_slice", part).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_slice").orderBy(*by))).filter(F.col("_r") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= top)
    return last.select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, object, Counter]]]:
    """(number, item_id, terms) of the items, in blocks of at most BLOCK terms; one partition of items is at the driver at a time."""
    held, weight = [], 0
    for number, row in enumerate(items.toLocalIterator()):
        found = Counter(terms((row["text"] or "").encode("utf-8", "replace")))
        if held and weight + found.total() > BLOCK:
            yield held
            held, weight = [], 0
        held.append((number, row["item_id"], found))
        weight += found.total()
    if held:
        yield held


def _search_block(docs: DataFrame, block: list[tuple[int, object, Counter]], schema: T.StructType, top: int) -> DataFrame:
    """Best rows of each partition for the items of one block: item_id, item, doc_id, score."""
    asked = sorted(set().union(*(c for _, _, c in block)))
    index = cut_lineage(forward_index(docs, asked))
    documents, words = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in document_counts(index).collect()}  # at most a block's terms
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(asked))]
    place = {t: i for i, t in enumerate(asked)}
    queries = []
    for number, _, found in block:
        at = np.array([place[t] for t in found], np.int64)
        queries.append(Query(number, at, np.array([weight[place[t]] * c for t, c in found.items()], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(queries)
    size, id_type = len(asked), to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for ids, n, term, tf in _shards(batches):
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]) if ids[i] is not None else (True, 0))
            shard = Shard(n[order], [term[i] for i in order], [tf[i] for i in order], size, documents, words)
            for q in shared.value:
                held = best.setdefault(q.number, [])
                floor = held[-1][0] if len(held) >= top else 1
                where, scores = shard.best(q, top, floor)
                if len(where):
                    held += [(s, ids[order[d]]) for d, s in zip(where.tolist(), scores.tolist())]
                    held.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del held[top:]
        rows = [(number, doc, score) for number, held in best.items() for score, doc in held]
        number, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    found = index.mapInArrow(run, T.StructType([schema["item"], schema["doc_id"], schema["score"]]))
    names = docs.sparkSession.createDataFrame([(name, number) for number, name, _ in block], T.StructType([schema["item_id"], schema["item"]]))
    return found.join(F.broadcast(names), "item").select(schema.names)  # a row for each item of the block


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[bytes], list[bytes]]]:
    """Documents with asked terms, in groups of bounded size."""
    ids, n, term, tf, postings = [], [], [], [], 0
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if not row[2]:
                continue
            if postings + len(row[2]) // 4 > POSTINGS or len(ids) >= SHARD:
                if ids:
                    yield ids, np.array(n, np.int64), term, tf
                ids, n, term, tf, postings = [], [], [], [], 0
            for values, v in zip((ids, n, term, tf), row):
                values.append(v)
            postings += len(row[2]) // 4
    if ids:
        yield ids, np.array(n, np.int64), term, tf
