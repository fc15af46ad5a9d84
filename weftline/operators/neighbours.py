"""Nearest neighbours: exact by blocks, approximate by lists of product-quantised codes.

Vectors meet in blocks: a task multiplies one block of queries by one block of the index and emits
its local top k, so neither all pairs nor a whole list is ever held together. A small index is
shipped to the executors instead, behind a check of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import spread


#: largest index (bytes of float64) that is broadcast: every Python worker keeps a copy
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
#: a side is cut into blocks of the size asked for up to this number; beyond it blocks grow, up to BLOCK_BYTES of
#: vectors, as every row is sent to as many tasks as the other side has blocks
FEW_BLOCKS = 16
BLOCK_BYTES = 16 * 1024 * 1024
#: vectors an approximate index is fitted on
FIT_SAMPLE = 65_536
#: vectors of these that the code words are fitted on; lists that hold a vector; times that what is left is coded again
WORD_SAMPLE = 16_384
HOMES = 2
ROUNDS = 3
OUT = "qid long, nid long, score double"
_NONE = pa.table({"qid": pa.array([], pa.int64()), "nid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy())


def block_top_k(qid, q, qgroup, nid, x, ngroup, k: int, metric: str, exclude: bool, rows: int = 512, cols: int = 4096, hidden=None, floors=None):
    """Top k of every query against one index block: highest score first, ties by smaller id.

    The score is the inner product, or the negative squared distance. Pairs are looked through in single precision,
    ``rows`` x ``cols`` at a time; those that may be among the best, by the bound of its rounding, are scored in double
    precision. ``hidden`` is a table of booleans by query and class, and a class for every index row (-1: none): rows of
    a class that is true for the query are left out. ``floors`` are scores that a pair must be over, one per query.
    """
    order = np.argsort(nid, kind="stable")
    nid, x, ngroup = nid[order], x[order], ngroup[order]
    norms, l2 = (x * x).sum(axis=1), metric == "l2"
    times = 2.0 if l2 else 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        rough_x, rough_norms, rough_q = x.astype(np.float32), norms.astype(np.float32), (times * q).astype(np.float32)
    longest = float(np.sqrt(norms.max(initial=0.0)))
    # sums of so many products in single precision; twice what rounding can make, and what is too small for it
    unit, least = (x.shape[1] + 8) * 2.0**-23, (x.shape[1] + 8) * 1e-37
    safe = len(nid) > 0 and all(np.abs(v).max(initial=0) < 1e15 for v in (q, x))
    # a narrow tile first, which sets the floors
    edges = [0, *range(min(cols, 512), len(nid), cols), len(nid)] if len(nid) else [0]
    out = []
    for at in range(0, len(qid), rows):
        part, groups = q[at : at + rows], qgroup[at : at + rows]
        own, every = (part * part).sum(axis=1), np.arange(len(part))
        if not l2:
            own[:] = 0
        far = np.sqrt((part * part).sum(axis=1)) * longest
        slip = unit * (times * far + (longest * longest if l2 else 0)) + least
        floor = np.full(len(part), -np.inf) if floors is None else floors[at : at + rows].copy()
        same = (slip - least) * 2.0**-29  # as much in double precision
        many = max(4 * k, 64) * len(part)
        r, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def out_of(hr, hc):
            """Which pairs are left out."""
            gone = groups[hr] == ngroup[hc] if exclude else np.zeros(np.broadcast(hr, hc).shape, bool)
            if hidden is not None:
                of = hidden[1][order[hc]]
                gone = gone | (hidden[0][at + hr, of] & (of >= 0))
            return gone

        def scored(hr, hc, lo):
            """Row by row, so that copies have equal scores."""
            hc = hc + lo
            a, b = part[hr], x[hc]
            if not l2:
                return hr, hc, np.einsum("ij,ij->i", a, b)
            a -= b
            return hr, hc, -np.einsum("ij,ij->i", a, a)

        for lo, hi in zip(edges, edges[1:]):
            here = np.arange(lo, hi)
            found = None
            if safe:
                s = rough_q[at : at + rows] @ rough_x[lo:hi].T
                if l2:
                    s -= rough_norms[lo:hi]
                hits = s > (floor + own - slip).astype(np.float32)[:, None]
                if len(here) > k and np.count_nonzero(hits) > 4 * k * len(part):
                    if exclude or hidden is not None:
                        np.copyto(s, -np.inf, where=out_of(every[:, None], here[None, :]))
                    best = np.partition(s, len(here) - k, axis=1)[:, len(here) - k]
                    hits &= s >= (best - 2 * slip).astype(np.float32)[:, None]
                if np.count_nonzero(hits) <= many:
                    hr, hc = np.divmod(np.flatnonzero(hits), hi - lo)  # faster than nonzero of two dimensions
                    if exclude or hidden is not None:
                        kept = ~out_of(hr, hc + lo)
                        hr, hc = hr[kept], hc[kept]
                    found = scored(hr, hc, lo)
            if found is None:  # too many are as good: copies, or numbers beyond single precision
                s = part @ x[lo:hi].T
                if l2:
                    s = 2 * s - norms[None, lo:hi] - own[:, None]
                if exclude or hidden is not None:
                    np.copyto(s, -np.inf, where=out_of(every[:, None], here[None, :]))
                hits = s > (floor + same)[:, None]
                if s.shape[1] > k and np.count_nonzero(hits) > 2 * k * len(part):
                    # the first k of those that are equal but for rounding
                    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    over, upto = s > (kth + same)[:, None], s >= (kth - same)[:, None]
                    equal = hits & upto & ~over
                    hits &= over | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= k))
                found = scored(*np.divmod(np.flatnonzero(hits), hi - lo), lo)
            hr, hc, value = found
            kept = value > floor[hr]  # ids ascend: an equal score comes too late
            if not kept.any():
                continue
            hr, hc, value = hr[kept], hc[kept], value[kept]
            r, ids, scores = np.concatenate([r, hr]), np.concatenate([ids, nid[hc]]), np.concatenate([scores, value])
            best = np.lexsort((ids, -scores, r))
            first, upto = np.searchsorted(r[best], every), np.searchsorted(r[best], every, side="right")
            best = best[np.arange(len(best)) - first[r[best]] < k]
            r, ids, scores = r[best], ids[best], scores[best]
            full = np.flatnonzero(upto - first >= k)
            floor[full] = scores[np.searchsorted(r, full) + k - 1]
        out.append(pa.table({"qid": np.asarray(qid[at : at + rows][r], np.int64), "nid": np.asarray(ids, np.int64), "score": scores}))
    return pa.concat_tables(out) if out else _NONE


def pieces_top_k(q, qgroup, nid, ngroup, vectors: Callable[[slice], np.ndarray], k: int, metric: str, exclude: bool, piece: int, hidden=None):
    """Top k as of ``block_top_k``, by place of the query, of an index whose vectors are made ``piece`` rows at a time; ``nid`` ascends."""
    floors = np.full(len(q), -np.inf)
    places = np.arange(len(q))
    r, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(nid), piece):
        at = slice(lo, lo + piece)
        part = None if hidden is None else (hidden[0], hidden[1][at])
        found = block_top_k(places, q, qgroup, nid[at], vectors(at), ngroup[at], k, metric, exclude, hidden=part, floors=floors)
        r, ids, scores = (np.concatenate([a, _numbers(found.column(c))]) for a, c in ((r, "qid"), (ids, "nid"), (scores, "score")))
        best = np.lexsort((ids, -scores, r))
        best = best[np.arange(len(best)) - np.searchsorted(r[best], places)[r[best]] < k]
        r, ids, scores = r[best], ids[best], scores[best]
        upto = np.searchsorted(r, places, side="right")
        full = np.flatnonzero(np.bincount(r, minlength=len(q)) >= k)
        floors[full] = scores[upto[full] - 1]
    return r, ids, scores


def _side(df: DataFrame, id_col: str, vec: str, group: str | None, prefix: str) -> DataFrame:
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    return df.select(F.col(id_col).cast("long").alias(f"{prefix}id"), F.col(vec).cast("array<double>").alias(f"{prefix}v"), g.alias(f"{prefix}g"))


def _final(parts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "nid"))
    return parts.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vec: str = "embedding",
    metric: str = "ip",
    exclude_same: str | None = None,
    block: int = 8192,
    max_broadcast: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest neighbours: (qid, nid, score, rank). ``exclude_same`` names a column whose equal
    values are never neighbours."""
    q, x = _side(queries, id_col, vec, exclude_same, "q"), _side(index, id_col, vec, exclude_same, "n")
    exclude = exclude_same is not None
    n, dim = x.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("nv")), F.lit(0))).first()
    if n * dim * 8 <= max_broadcast:
        table = x.toArrow()
        spark = queries.sparkSession
        shipped = spark.sparkContext.broadcast((_numbers(table.column("nid")), _matrix(table.column("nv")), _numbers(table.column("ng"))))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nid, mat, ng = shipped.value
            for b in batches:
                if b.num_rows:
                    found = block_top_k(_numbers(b.column(0)), _matrix(b.column(1)), _numbers(b.column(2)), nid, mat, ng, k, metric, exclude)
                    yield from found.to_batches()

        return _final(spread(q).mapInArrow(search, OUT), k)
    sizes = tuple(_block_count(F.lit(rows).cast("long"), block, dim) for rows in (q.count(), n))
    one = F.lit(0).cast("long")
    return _blocked(q.withColumn("list", one), x.withColumn("list", one), k, _whole_vectors(k, metric, exclude), sizes)


def _block_count(rows: Column, block: int, dim: int) -> Column:
    asked = F.ceil(rows / block).cast("long")
    largest = max(block, BLOCK_BYTES // (8 * max(dim, 1)))
    return F.when(asked <= FEW_BLOCKS, asked).otherwise(F.greatest(F.lit(FEW_BLOCKS), F.ceil(rows / largest)).cast("long"))


#: (list, query numbers, query vectors, query groups, index numbers, index values, index groups) -> local top k
Compare = Callable[..., pa.Table]


def _whole_vectors(k: int, metric: str, exclude: bool) -> Compare:
    return lambda _, qid, q, qg, nid, x, ng: block_top_k(qid, q, qg, nid, _matrix(x), ng, k, metric, exclude)


def _blocked(q: DataFrame, x: DataFrame, k: int, compare: Compare, sizes: tuple) -> DataFrame:
    """Top k within equal ``list`` values, list by list cut into blocks per side; ``sizes`` are how many, or functions that
    tell it from the rows of a list.

    Block counts are one row per list; a list that holds most of the data gets proportionally more
    blocks, so no task grows with it.
    """
    if not isinstance(sizes[0], Column):
        blocks = lambda d, count, name: d.groupBy("list").agg(count(F.count(F.lit(1))).alias(name))
        plan = blocks(q, sizes[0], "nq").join(blocks(x, sizes[1], "nx"), "list")
        sized = lambda d: d.join(plan, "list")
    else:
        sized = lambda d: d.withColumns({"nq": sizes[0], "nx": sizes[1]})
    hash_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sized(q).withColumn("qb", hash_of("qid", "nq")).withColumn("xb", upto("nx")).drop("nq", "nx")
    right = sized(x).withColumn("xb", hash_of("nid", "nx")).withColumn("qb", upto("nq")).drop("nq", "nx")

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return _NONE
        return compare(
            a.column("list")[0].as_py(), _numbers(a.column("qid")), _matrix(a.column("qv")), _numbers(a.column("qg")),
            _numbers(b.column("nid")), b.column("nv"), _numbers(b.column("ng")),
        )

    keys = ["list", "qb", "xb"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, OUT)
    return _final(parts, k)


def neighbour_lists(found: DataFrame, queries: DataFrame, id_col: str, k: int) -> DataFrame:
    """One row per query with exactly ``k`` neighbours, padded with -1."""
    lists = found.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "nid"))), lambda x: x["nid"]).alias("neighbors")
    )
    pad = F.array_repeat(F.lit(-1).cast("long"), k)
    out = queries.select(F.col(id_col).alias("qid")).join(lists, "qid", "left")
    return out.select("qid", F.slice(F.concat(F.coalesce("neighbors", F.array().cast("array<bigint>")), pad), 1, k).alias("neighbors"))


def _assign(side: DataFrame, centroids: np.ndarray, vec: str, n: int) -> DataFrame:
    """Add the ``n`` nearest centroids of every vector, one row each, as ``list``."""
    shipped = side.sparkSession.sparkContext.broadcast(centroids)
    schema = T.StructType([*side.schema.fields, T.StructField("list", T.LongType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        norms = (c * c).sum(axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(b.schema.get_field_index(vec)))
            best = np.argsort(norms[None, :] - 2 * (v @ c.T), axis=1, kind="stable")[:, :n]
            rows = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.reshape(-1).astype("int64"))], names=[*b.schema.names, "list"])

    return side.mapInArrow(nearest, schema)


def _clusters(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of a bounded sample; an empty one takes the point that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = (centres * centres).sum(1) - 2 * (x @ centres.T)
        own = far.argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        lonely = np.argsort(-far[np.arange(len(x)), own], kind="stable")[: (size == 0).sum()]
        total[size == 0], size[size == 0] = x[lonely], 1
        centres = total / size[:, None]
    return centres


@dataclass(frozen=True)
class ProductIndex:
    """Coarse centres, and for each slice of the residuals its code words (one byte names one), round by round."""

    centres: np.ndarray
    books: np.ndarray  # round, slice, word, dimension

    def nearest(self, v: np.ndarray, n: int) -> np.ndarray:
        c = self.centres
        return np.argsort((c * c).sum(1) - 2 * (v @ c.T), axis=1, kind="stable")[:, :n]

    def codes(self, v: np.ndarray, lists: np.ndarray, rows: int = 1024) -> np.ndarray:
        """A byte per round and slice: a round codes what the ones before leave."""
        parts = self.books.shape[1]
        out = np.zeros((len(v), len(self.books), parts), np.uint8)
        for at in range(0, len(v), rows):
            rest = (v[at : at + rows] - self.centres[lists[at : at + rows]]).reshape(-1, parts, v.shape[1] // parts)
            for i, book in enumerate(self.books):
                code = _words(rest, book)
                out[at : at + rows, i] = code
                rest = rest - book[np.arange(parts), code]
        return out.reshape(len(v), -1)

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for: centre plus code words."""
        parts = self.books.shape[1]
        rest = sum(book[np.arange(parts), c] for book, c in zip(self.books, codes.reshape(len(codes), -1, parts).transpose(1, 0, 2)))
        return self.centres[lists] + rest.reshape(len(codes), -1)


def _words(rest: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest code word of every slice."""
    return ((book**2).sum(2)[None] - 2 * np.einsum("npd,pwd->npw", rest, book, optimize=True)).argmin(2)


def fit_product_index(df: DataFrame, vec: str, n_lists: int, parts: int, seed: int, words: int = 256, sample: int = FIT_SAMPLE) -> ProductIndex:
    """Centres of at most ``sample`` vectors, those with the smallest digests, and code words of the first
    WORD_SAMPLE of these; every vector can then be coded."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(vec).cast("string")))
    x = _matrix(df.select(F.col(vec).cast("array<double>").alias("v"), key.alias("k")).orderBy("k").limit(sample).select("v").toArrow().column("v"))
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions don't divide into {parts} parts")
    centres = _clusters(x, n_lists, seed)
    x = x[:WORD_SAMPLE]
    own = ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)
    rest = (x - centres[own]).reshape(len(x), parts, -1)
    books = []
    for i in range(ROUNDS):
        books.append(np.stack([_clusters(rest[:, p], words, seed + 1 + i * parts + p) for p in range(parts)]))
        rest = np.concatenate([part - books[i][np.arange(parts), _words(part, books[i])] for part in np.array_split(rest, -(-len(rest) // 1024))])
    return ProductIndex(centres, np.stack(books))


def approximate_knn(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    n_lists: int,
    n_probe: int,
    seed: int,
    id_col: str = "vec_id",
    vec: str = "embedding",
    metric: str = "ip",
    exclude_same: str | None = None,
    block: int = 8192,
    parts: int = 8,
    widen: int = 10,
) -> DataFrame:
    """k nearest neighbours by product-quantised codes: (qid, nid, score, rank).

    Every vector is coded from its nearest centre, as ROUNDS times ``parts`` bytes, and lies in the lists of its HOMES
    nearest centres. A query is compared with what the codes in its ``n_probe`` nearest lists stand for, with each
    vector once; the ``widen`` * k best by code are scored on the whole vectors. Lists are cut into blocks as in the
    exact search, but a block of coded vectors holds BLOCK_BYTES of codes: it meets a query once, and is decoded piece by piece.
    """
    fitted = fit_product_index(index, vec, n_lists, parts, seed)
    exclude = exclude_same is not None
    q, x = _side(queries, id_col, vec, exclude_same, "q"), _side(index, id_col, vec, exclude_same, "n")
    shipped = q.sparkSession.sparkContext.broadcast(fitted)  # n_lists + ROUNDS * 256 vectors
    dim = fitted.centres.shape[1]
    piece = max(block, BLOCK_BYTES // (8 * dim))
    coded_rows = max(block, BLOCK_BYTES // (4 * HOMES + ROUNDS * parts + 32))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1))
                homes = shipped.value.nearest(v, HOMES)
                codes = shipped.value.codes(v, homes[:, 0])
                packed = pa.array([h.tobytes() + c.tobytes() for h, c in zip(homes.astype(np.int32), codes)], pa.binary())
                for i in range(homes.shape[1]):
                    lists = pa.array(np.ascontiguousarray(homes[:, i]), pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0), packed, b.column(2), lists], names=["nid", "nv", "ng", "list"])

    def near(list_: int, qid, qv, qg, nid, packed, ng) -> pa.Table:
        fitted = shipped.value
        order = np.argsort(nid, kind="stable")
        nid, ng = nid[order], ng[order]
        table = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(nid), -1)[order]
        n_homes = min(HOMES, len(fitted.centres))
        homes = table[:, : 4 * n_homes].copy().view(np.int32)
        # a vector counts in the nearest of its lists that the query looks into
        place = (homes == list_).argmax(1)
        probed = np.zeros((len(qid), len(fitted.centres)), bool)
        np.put_along_axis(probed, fitted.nearest(qv, n_probe), True, axis=1)
        hidden = (probed, np.where(place > 0, homes[:, 0], -1))
        vectors = lambda at: fitted.decoded(table[at, 4 * n_homes :], homes[at, 0])
        of, ids, scores = pieces_top_k(qv, qg, nid, ng, vectors, widen * k, metric, exclude, piece, hidden)
        return pa.table({"qid": np.asarray(qid[of], np.int64), "nid": np.asarray(ids, np.int64), "score": scores})

    centres = _assign(q, fitted.centres, "qv", n_probe)
    # a query's best pairs take room beside its vector: three numbers each
    sizes = (lambda n: _block_count(n, block, dim + 3 * widen * k), lambda n: F.ceil(n / coded_rows).cast("long"))
    rows = _blocked(centres, x.mapInArrow(coded, "nid long, nv binary, ng long, list long"), widen * k, near, sizes)
    pairs = rows.select("qid", "nid").join(q.select("qid", "qv"), "qid").join(x.select("nid", "nv"), "nid")
    dot = F.aggregate(F.zip_with("qv", "nv", lambda a, b: a * b if metric == "ip" else -(a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    return _final(pairs.select("qid", "nid", dot.alias("score")), k)


def distinct_concepts(found: DataFrame, concept_of: DataFrame, n: int) -> DataFrame:
    """First ``n`` distinct concepts among the neighbours of a query; score = 1 - distance.

    ``found`` must hold more than ``n`` neighbours per query; the first hit of a concept counts.
    """
    named = found.join(concept_of.select(F.col("id").alias("nid"), "concept"), "nid")
    first = named.groupBy("qid", "concept").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= n).select("qid", "place", "concept", "score")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pca(df: DataFrame, vec: str, k: int, out: str = "reduced") -> DataFrame:
    """Fit principal components on all vectors and project every one."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("_p")).drop("_f", "_p")
