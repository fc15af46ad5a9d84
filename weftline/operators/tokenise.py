"""Tokenisation at corpus scale: rule tokenisers, vocabularies, column codes, subword models."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scoped import let
from weftline.functions.text import split_sentences
from weftline.operators.joins import salted_lookup
from weftline.operators.ordered import running
from weftline.operators.quantiles import exact_quantiles
from weftline.session import cut_lineage

#: largest vocabulary that is sent to every executor; of a bigger one FREQUENT words are sent, the others are joined
MAX_BROADCAST_VOCAB = 2_000_000
#: these are the most frequent ones of about so many rows
FREQUENT = 500_000
FREQUENT_ROWS = 32_768


class Tokenizer:
    """Anything that maps a text column to an id array column."""

    def ids(self, col: Column) -> Column:
        raise NotImplementedError


class ByteTokenizer(Tokenizer):
    def __init__(self, offset: int = 0) -> None:
        self.offset = offset

    def ids(self, col: Column) -> Column:
        from weftline.functions.tokens import byte_ids

        return byte_ids(col, self.offset)


def tokenise_corpus(
    df: DataFrame, columns: list[str], ids: Callable[[Column], Column], sentences: bool = False, eod: int | None = None
) -> DataFrame:
    """Per text column: id arrays per sentence (empty ones dropped), ``eod`` after the last, and bytes read."""
    out = df
    for c in columns:
        parts = split_sentences(c) if sentences else F.array(F.col(c))
        arrays = F.filter(F.transform(parts, lambda s: ids(s)), lambda a: F.size(a) > 0)
        if eod is not None:
            end = F.array(F.lit(eod))
            arrays = let(
                arrays, lambda x: F.transform(x, lambda a, i: F.when(i == F.size(x) - 1, F.concat(a, end)).otherwise(a))
            )
        out = out.withColumn(f"{c}_ids", arrays).withColumn(f"{c}_bytes", F.octet_length(c).cast("long"))
    return out


def vocabulary(df: DataFrame, tokens: Column, order: list[str], by: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """token -> id by first appearance (row order, then position); ``known`` ids stay and are extended."""
    by = by or []
    seen = (
        _first_seen(df.select(*by, *order, tokens.alias("_tokens")), len(by), len(order))
        .groupBy(*by, "token")
        .agg(F.min(F.struct(*order, "_pos")).alias("_first"))
    )
    base = 0
    if known is not None:
        seen = seen.join(known.select("token"), "token", "left_anti")
        base = known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    flat = seen.select(*by, "token", *[F.col(f"_first.{o}").alias(f"_o_{o}") for o in order], F.col("_first._pos").alias("_pos"))
    # the vocabulary is read several times below, the corpus only once
    flat = cut_lineage(flat)
    ranked = running(flat, [*[f"_o_{o}" for o in order], "_pos"], by, row_no="id")
    fresh = ranked.select(*by, "token", (F.col("id") - 1 + base).alias("id"))
    return fresh if known is None else known.select("token", "id").unionByName(fresh)


def _first_seen(rows: DataFrame, n_by: int, n_order: int) -> DataFrame:
    """Columns of the first ``n_by`` and ``n_order``, _pos and token: a batch's first place of every token of a group.

    Most words go here, before anything is sorted or shuffled.
    """
    named = rows.schema.fields[: n_by + n_order]
    schema = T.StructType([*named, T.StructField("_pos", T.IntegerType()), T.StructField("token", T.StringType())])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(f"c{i}", "ascending") for i in range(n_by, n_by + n_order)]
            table = pa.table({f"c{i}": c for i, c in enumerate(batch.columns)})
            table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start")).combine_chunks()
            column = table.column(table.num_columns - 1)
            if not table.num_rows or not pc.sum(pc.list_value_length(column)).as_py():
                continue
            column = column.chunk(0)
            row = pc.list_parent_indices(column).to_numpy()
            words = column.flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(n_by):
                group = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
                part = group.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                _, code = np.unique(part[row] * (code.max() + 1) + code, return_inverse=True)
            _, at = np.unique(code, return_index=True)
            lengths = np.bincount(row, minlength=table.num_rows)
            pos = at - (np.cumsum(lengths) - lengths)[row[at]]
            held = table.select(range(n_by + n_order)).take(pa.array(row[at])).combine_chunks()
            columns = [c.chunk(0) for c in held.columns] + [pa.array(pos.astype(np.int32)), words.take(pa.array(at)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(firsts, schema)


def frequency_vocabulary(df: DataFrame, token: str, reserved: list[str]) -> DataFrame:
    """Reserved labels first, then labels by falling frequency, ties by label."""
    counts = df.filter(~F.col(token).isin(reserved)).groupBy(F.col(token).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(cut_lineage(counts.withColumn("_neg", -F.col("n"))), ["_neg", "token"], row_no="id")
    rest = ranked.select("token", (F.col("id") - 1 + len(reserved)).alias("id"))
    head = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(reserved)], "token string, id long")
    return head.unionByName(rest)


def language_offsets(vocab: DataFrame, lang: str) -> DataFrame:
    """Start of every language in the joint id space: cumulative vocabulary sizes (one row per language)."""
    sizes = vocab.groupBy(lang).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(lang).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(lang, "size", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))


def aggregate_vocabulary(vocab: DataFrame, lang: str) -> DataFrame:
    """Per-language ids moved to the joint id space."""
    return vocab.join(F.broadcast(language_offsets(vocab, lang)), lang).select(
        lang, "token", F.col("id").alias("local_id"), (F.col("id") + F.col("offset")).alias("id")
    )


def language_of_ids(df: DataFrame, ids: str, offsets: DataFrame, lang: str) -> DataFrame:
    """Majority language of an id array; ties go to the language seen first.

    The offsets are one number per language, so they are compiled into the expression.
    """
    bounds = [(r["offset"], r["offset"] + r["size"], r[lang]) for r in offsets.collect()]

    def language(i: Column) -> Column:
        out = None
        for lo, hi, code in bounds:
            hit = (i >= lo) & (i < hi)
            out = F.when(hit, code) if out is None else out.when(hit, code)
        return out

    def majority(langs: Column) -> Column:
        options = F.array(
            *[
                F.struct(F.size(F.filter(langs, _equals(code))).alias("n"), (-F.array_position(langs, code)).alias("first"), F.lit(code).alias("lang"))
                for _, _, code in bounds
            ]
        )
        return F.array_max(F.filter(options, lambda o: o["n"] > 0))["lang"]

    return df.withColumn("language", let(F.transform(F.col(ids), language), majority))


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def encode_tokens(
    df: DataFrame, tokens: Column, vocab: DataFrame, unk: int | None, out: str = "ids", key: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Replace tokens by vocabulary ids; unknown ones become ``unk`` or vanish if it is None.

    A vocabulary up to ``MAX_BROADCAST_VOCAB`` entries is shipped once per executor and looked up a
    whole Arrow batch at a time; nothing is shuffled. Of a larger one the frequent words are shipped, and only the
    places of the other words are joined. ``key`` names the row, ``keep`` the columns to return beside ``out``.
    """
    vocab = cut_lineage(vocab.select("token", "id"))
    source = df.withColumn(out, tokens).select(*[c for c in keep or df.columns if c != out], out)
    if vocab.limit(MAX_BROADCAST_VOCAB + 1).count() <= MAX_BROADCAST_VOCAB:
        return _filled(_looked_up(source, vocab, out), out, unk)
    return _encode_by_join(source, F.col(out), vocab, unk, out, key, _frequent(source, out, vocab))


def _frequent(source: DataFrame, tokens: str, vocab: DataFrame) -> DataFrame:
    """Entries of at most FREQUENT words, the most frequent ones of some rows; which ones they are changes no result."""
    some = source.count() // FREQUENT_ROWS + 1
    rows = source.filter(F.pmod(F.xxhash64(tokens), F.lit(some)) == 0) if some > 1 else source
    counts = cut_lineage(rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    least, held = None, 0
    for r in counts.filter("n > 1").groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["n"]
    return vocab.join(counts.filter(F.col("n") >= least) if least else counts.limit(0), "token", "left_semi")


def _looked_up(source: DataFrame, vocab: DataFrame, out: str) -> DataFrame:
    """Ids for the tokens ``out``, null for those not in ``vocab``, which stand in ``_rest``."""
    pairs = vocab.toArrow()
    table = source.sparkSession.sparkContext.broadcast((pairs.column("token").combine_chunks(), pairs.column("id").combine_chunks()))
    schema = T.StructType(
        [f if f.name != out else T.StructField(out, T.ArrayType(T.LongType())) for f in source.schema.fields] + [T.StructField("_rest", T.ArrayType(T.StringType()))]
    )

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(*(x.to_pylist() for x in table.value)))  # once per task
        for batch in batches:
            at = batch.schema.get_field_index(out)
            column = batch.column(at)
            coded = column.flatten().dictionary_encode()
            ids = pa.array([known.get(w) for w in coded.dictionary.to_pylist()], pa.int64())
            value = pc.take(ids, coded.indices)
            rest = pc.is_null(value)
            words = pc.filter(coded, rest).cast(pa.string())
            lists = [_lists(value, pc.fill_null(pc.list_value_length(column), 0)), _lists(words, _held(column, rest))]
            columns = [lists[0] if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, lists[1]], names=schema.names)

    return source.mapInArrow(lookup, schema)


def _held(lists: pa.Array, mask: pa.Array) -> np.ndarray:
    """Entries under ``mask`` (one for each entry) in each list."""
    rows = pc.filter(pc.list_parent_indices(lists), mask).to_numpy(zero_copy_only=False)
    return np.bincount(rows, minlength=len(lists)) if len(rows) else np.zeros(len(lists), np.int64)


def _lists(values: pa.Array, lengths) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.asarray(lengths))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _filled(looked: DataFrame, out: str, unk: int | None, codes: str | None = None) -> DataFrame:
    """The nulls in the lists ``out`` become the entries of the lists ``codes``, and ``unk`` where these are null too."""
    named = [f for f in looked.schema.fields if f.name not in ("_rest", codes)]
    rows = looked.select(*[f.name for f in named], *([codes] if codes else []))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(out)
            column = batch.column(at)
            value = column.flatten()
            lengths = pc.fill_null(pc.list_value_length(column), 0)
            if codes and value.null_count:
                value = pc.replace_with_mask(value, pc.is_null(value), batch.column(batch.num_columns - 1).flatten())
            if unk is None:
                some = pc.is_valid(value)
                lengths, value = _held(column, some), pc.filter(value, some)
            else:
                value = pc.fill_null(value, unk)
            columns = [_lists(value, lengths) if i == at else batch.column(i) for i in range(len(named))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in named])

    return rows.mapInArrow(fill, T.StructType(named))


def _encode_by_join(
    df: DataFrame, tokens: Column, vocab: DataFrame, unk: int | None, out: str, key: list[str] | None, frequent: DataFrame | None = None
) -> DataFrame:
    """Tokens that aren't ``frequent`` are joined, one row a place."""
    source = df.withColumn(out, tokens)
    looked = _looked_up(source, vocab.limit(0) if frequent is None else frequent, out)
    if not key:
        # numbers are written out, so a recomputed partition can't change them
        looked = looked.withColumn("_row", F.monotonically_increasing_id())
    looked, row = cut_lineage(looked), key or ["_row"]
    flat = looked.select(*row, F.posexplode("_rest").alias("_pos", "_token"))
    coded = flat.join(vocab.select(F.col("token").alias("_token"), F.col("id").alias("_code")), "_token", "left")
    lists = coded.groupBy(*row).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_code"))), lambda x: x["_code"]).alias("_codes"))
    joined = looked.drop("_rest").join(lists, row, "left")
    joined = joined.select(*[c for c in looked.columns if c not in ("_rest", "_row")], F.coalesce("_codes", F.array().cast("array<bigint>")).alias("_codes"))
    return _filled(joined, out, unk, "_codes")


def decode_ids(df: DataFrame, ids: str, vocab: DataFrame, sep: str, out: str = "text") -> DataFrame:
    """Inverse of :func:`encode_tokens`; ids that aren't in the vocabulary give empty words."""
    if vocab.limit(MAX_BROADCAST_VOCAB + 1).count() > MAX_BROADCAST_VOCAB:
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        flat = rows.select("_row", F.posexplode(ids).alias("_pos", "_id"))
        named = flat.join(vocab.select(F.col("id").alias("_id"), F.col("token").alias("_token")), "_id", "left")
        pair = F.struct("_pos", F.coalesce("_token", F.lit("")).alias("_token"))
        text = named.groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["_token"]), sep).alias(out))
        return rows.join(text, "_row", "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_row")
    pairs = vocab.select("id", "token").toArrow()
    table = df.sparkSession.sparkContext.broadcast((pairs.column("id").combine_chunks(), pairs.column("token").combine_chunks()))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = table.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            value = pc.take(names, pc.index_in(column.flatten().cast(known.type), value_set=known))
            ends = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).cumsum()
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pc.fill_null(value, ""))
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_join(lists, sep)], names=[*batch.schema.names, out])

    return df.mapInArrow(lookup, schema)


# ---------------------------------------------------------------- statistics

def token_length_stats(df: DataFrame, n: str, probs: dict[str, float]) -> DataFrame:
    """Count, mean, population deviation, min, max and exact quantiles of a length column."""
    moments = df.agg(
        F.count(n).alias("rows"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"),
        F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"),
    )
    quantiles = exact_quantiles(df, n, probs).first()
    return moments.select("*", *[F.lit(quantiles[k]).cast("double").alias(k) for k in probs])


# ---------------------------------------------------------------- column codes

@dataclass
class IntCode:
    """Base-``base`` digits of ``value - minimum``, highest first; one id range per digit place."""

    col: str
    code_len: int
    start_id: int
    base: int = 100
    has_nan: bool = True
    fill_all: bool = True
    minimum: float = 0
    digits: list[list[int]] = field(default_factory=list)

    def _value(self) -> Column:
        return F.col(self.col).cast("long") - F.lit(int(self.minimum))

    def _fit_bounds(self, df: DataFrame) -> None:
        self.minimum = df.agg(F.min(F.col(self.col).cast("long"))).first()[0]

    def fit(self, df: DataFrame) -> "IntCode":
        """At most ``base`` digits per place come to the driver."""
        self._fit_bounds(df)
        if self.fill_all:
            self.digits = [list(range(self.base)) for _ in range(self.code_len)]
        else:
            places = [F.sort_array(F.collect_set(self._digit(i))).alias(str(i)) for i in range(self.code_len)]
            row = df.agg(*places).first()
            self.digits = [list(row[i]) for i in range(self.code_len)]
        return self

    def _digit(self, place: int, value: Column | None = None) -> Column:
        value = self._value() if value is None else value
        return F.pmod(F.floor(value / self.base**place), F.lit(self.base)).cast("int")

    @property
    def end_id(self) -> int:
        return self.start_id + sum(len(d) for d in self.digits) + int(self.has_nan)

    def encode(self) -> Column:
        """Code array; out-of-domain digits take the nearest known one, nulls the N/A code."""
        firsts = [self.start_id + sum(len(d) for d in self.digits[:p]) for p in range(self.code_len)]
        places = list(reversed(range(self.code_len)))

        def code(value: Column, place: int) -> Column:
            digit = self._digit(place, value)
            if self.fill_all:
                return (digit + firsts[place]).cast("long")
            known = F.array(*[F.lit(d) for d in self.digits[place]])
            gap = F.transform(known, lambda k, i: F.struct(F.abs(k - digit).alias("gap"), i.alias("i")))
            return (F.array_min(gap)["i"] + firsts[place]).cast("long")

        def codes(value: Column) -> Column:
            longer = F.raise_error(F.lit(f"{self.col}: value needs a longer code")).cast("array<bigint>")
            fits = F.floor(value / self.base**self.code_len) == 0
            return F.when(fits, F.array(*[code(value, p) for p in places])).otherwise(longer)

        plain = let(self._value(), codes)
        if not self.has_nan:
            return plain
        nan = [F.lit(firsts[p] + len(self.digits[p]) - 1 + int(p == self.code_len - 1)).cast("long") for p in places]
        return F.when(F.col(self.col).isNull(), F.array(*nan)).otherwise(plain)

    def decode(self, codes: Column) -> Column:
        total = F.lit(0).cast("long")
        for place in range(self.code_len):
            first = self.start_id + sum(len(d) for d in self.digits[:place])
            known = F.array(*[F.lit(d) for d in self.digits[place]])
            total = total + F.get(known, (codes[self.code_len - 1 - place] - first).cast("int")).cast("long") * self.base**place
        return self._restore(total)

    def _restore(self, total: Column) -> Column:
        return total + int(self.minimum)


@dataclass
class FloatCode(IntCode):
    """Scaled value with as many fractional digits as the code length leaves.

    ``robust``: (v - median) / (p75 - p25). ``quantile``: position on a 100-point quantile grid.
    """

    transform: str = "robust"
    centre: float = 0.0
    scale: float = 1.0
    grid: list[float] = field(default_factory=list)
    extra: int = 0

    def _scaled(self) -> Column:
        v = F.col(self.col).cast("double")
        if self.transform == "robust":
            return (v - self.centre) / self.scale
        n = len(self.grid)
        g = F.array(*[F.lit(float(x)) for x in self.grid])
        k = F.least(F.greatest(F.size(F.filter(g, lambda x: x <= v)), F.lit(1)), F.lit(n - 1))
        lo, hi = F.element_at(g, k), F.element_at(g, k + 1)
        inside = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(F.lit(0.0))
        return F.least(F.greatest((k - 1 + inside) / (n - 1), F.lit(0.0)), F.lit(1.0))

    def _value(self) -> Column:
        return ((self._scaled() - self.minimum) * float(self.base**self.extra)).cast("long")

    def _fit_bounds(self, df: DataFrame) -> None:
        import math

        if self.transform == "robust":
            q = exact_quantiles(df, self.col, {"a": 0.25, "b": 0.5, "c": 0.75}).first()
            self.centre, self.scale = q["b"], (q["c"] - q["a"]) or 1.0
        elif self.transform == "quantile":
            q = exact_quantiles(df, self.col, {f"q{i}": i / 99 for i in range(100)}).first()
            self.grid = [q[f"q{i}"] for i in range(100)]
        else:
            raise ValueError("supported transforms: robust, quantile")
        row = df.agg(F.min(self._scaled()).alias("lo"), F.max(self._scaled()).alias("hi")).first()
        self.minimum = row["lo"]
        self.extra = self.code_len - (int(math.log(row["hi"] - row["lo"], self.base)) + 1)
        if self.extra < 0:
            raise ValueError(f"{self.col}: code too short for the value range")

    def _restore(self, total: Column) -> Column:
        scaled = total / float(self.base**self.extra) + self.minimum
        if self.transform == "robust":
            return scaled * self.scale + self.centre
        n = len(self.grid)
        g = F.array(*[F.lit(float(x)) for x in self.grid])
        at = scaled * (n - 1)
        k = F.least(F.floor(at), F.lit(n - 2)).cast("int")
        return F.element_at(g, k + 1) + (F.element_at(g, k + 2) - F.element_at(g, k + 1)) * (at - k)


@dataclass
class CategoryCode:
    """Ordinal of the sorted distinct values.

    Up to ``limit`` values are sent to the tasks as one sorted array and searched a batch at a time; more
    stay a table that rows are joined to, with a salt, as a value may be in most of them.
    """

    col: str
    start_id: int
    limit: int = 1_000_000
    size: int = 0
    values: pa.Array | None = None
    table: DataFrame | None = None

    def fit(self, df: DataFrame) -> "CategoryCode":
        found = cut_lineage(df.select(F.col(self.col).cast("string").alias("v")).filter("v is not null").distinct())
        self.size = found.count()
        if self.size <= self.limit:
            values = found.toArrow().column("v").combine_chunks()
            self.values = values.take(pc.array_sort_indices(values)) if len(values) else values
        else:
            self.table = cut_lineage(running(found, ["v"], row_no="_at").select(F.col("v").alias(f"_v_{self.col}"), (F.col("_at") - 1 + self.start_id).alias(f"_id_{self.col}")))
        return self

    @property
    def end_id(self) -> int:
        return self.start_id + self.size

    def joined(self, df: DataFrame) -> DataFrame:
        """``df`` with the ordinals of a large dictionary."""
        if self.table is None:
            return df
        return salted_lookup(df.withColumn(f"_v_{self.col}", F.col(self.col).cast("string")), self.table, f"_v_{self.col}").drop(f"_v_{self.col}")

    def decoded(self, df: DataFrame, codes: Column, out: str) -> DataFrame:
        """``df`` with the values of ``codes``; other numbers have none."""
        if self.table is None:
            return df.withColumn(out, _value_at(self.values, self.start_id)(codes[0]))
        named = self.table.select(F.col(f"_id_{self.col}").alias("_id"), F.col(f"_v_{self.col}").alias(out))
        return salted_lookup(df.withColumn("_id", codes[0].cast("long")), named, "_id").drop("_id")

    def encode(self) -> Column:
        if self.table is not None:
            return F.array(F.col(f"_id_{self.col}"))
        return F.array(_place_of(self.values, self.start_id)(F.col(self.col).cast("string")))


def _place_of(values: pa.Array, start: int):
    index: list[pd.Index] = []

    @F.arrow_udf(T.LongType())
    def place(batch: pa.Array) -> pa.Array:
        if not index:
            index.append(pd.Index(values.to_pylist(), dtype=object))
        at = index[0].get_indexer(batch.to_pylist())
        return pa.array(at + start, pa.int64(), mask=at < 0)

    return place


def _value_at(values: pa.Array, start: int):
    @F.arrow_udf(T.StringType())
    def value(batch: pa.Array) -> pa.Array:
        at = pc.subtract(batch.cast(pa.int64()), start)
        return values.take(pc.if_else(pc.and_(pc.greater_equal(at, 0), pc.less(at, len(values))), at, None))

    return value


def fit_columns(df: DataFrame, specs: list[dict]) -> list:
    """Fit column codes one after the other; ids of a column start where the last one ends."""
    codes, at = [], 0
    kinds = {"int": IntCode, "float": FloatCode, "category": CategoryCode}
    for spec in specs:
        spec = dict(spec)
        kind = kinds[spec.pop("kind")]
        code = kind(start_id=at, **spec).fit(df)
        codes.append(code)
        at = code.end_id
    return codes


def encode_rows(df: DataFrame, codes: list, out: str = "ids", start: int = 0) -> DataFrame:
    """All column codes of a row in one array, columns in cyclic order from ``start``."""
    order = [codes[(start + i) % len(codes)] for i in range(len(codes))]
    large = [c for c in order if getattr(c, "table", None) is not None]
    work = functools.reduce(lambda d, c: c.joined(d), large, df)
    return work.withColumn(out, F.flatten(F.array(*[c.encode() for c in order]))).drop(*[f"_id_{c.col}" for c in large])


def decode_rows(df: DataFrame, codes: list, ids: str = "ids") -> DataFrame:
    out, at = df, 1
    for c in codes:
        n = getattr(c, "code_len", 1)
        part = F.slice(ids, at, n)
        out = c.decoded(out, part, f"{c.col}_decoded") if isinstance(c, CategoryCode) else out.withColumn(f"{c.col}_decoded", c.decode(part))
        at += n
    return out


# ---------------------------------------------------------------- subwords

_L, _R = "\u0001", "\u0002"


def learn_merges(df: DataFrame, tokens: Column, n_merges: int, every: int = 25) -> list[tuple[str, str]]:
    """Byte-pair merges over a word-frequency table; ties go to the smaller pair.

    The corpus is read once to word counts. Each step is one aggregation whose single best row comes
    back; the words carry their symbols as delimited text, so a merge is one string replacement.
    """
    spell = F.concat_ws("", F.transform(F.filter(F.split("w", ""), lambda x: x != ""), lambda x: F.concat(F.lit(_L), x, F.lit(_R))))
    table = cut_lineage(df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("n", spell.alias("s")))
    merges: list[tuple[str, str]] = []
    for step in range(n_merges):
        symbols = F.split(F.regexp_replace("s", f"^{_L}|{_R}$", ""), f"{_R}{_L}")
        left, right = F.slice(symbols, 1, F.size(symbols) - 1), F.slice(symbols, 2, F.size(symbols) - 1)
        pairs = table.filter(F.size(symbols) > 1).select("n", F.explode(F.arrays_zip(left.alias("a"), right.alias("b"))).alias("p"))
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a", "b").first()
        if best is None:
            break
        merges.append((best["a"], best["b"]))
        table = table.withColumn(
            "s", F.replace("s", F.lit(f"{_L}{best['a']}{_R}{_L}{best['b']}{_R}"), F.lit(f"{_L}{best['a']}{best['b']}{_R}"))
        )
        if (step + 1) % every == 0:
            table = cut_lineage(table)
    return merges


def merges_model(alphabet: list[str], merges: list[tuple[str, str]], unk: str = "<unk>") -> str:
    """Serialised whitespace BPE model of learned merges, for :func:`apply_subwords`."""
    from tokenizers import Tokenizer as Model
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import WhitespaceSplit

    entries = [unk, *sorted(alphabet), *dict.fromkeys(a + b for a, b in merges)]
    model = Model(BPE(vocab={t: i for i, t in enumerate(dict.fromkeys(entries))}, merges=merges, unk_token=unk))
    model.pre_tokenizer = WhitespaceSplit()
    return model.to_str()


#: characters that are encoded at a time; every one may become a token of some hundred bytes until its id is taken
PIECE_CHARS = 256 * 1024


def _slices(batch: pa.RecordBatch, at: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``chars`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, before = 0, 0
    while first < batch.num_rows:
        upto = max(int(np.searchsorted(ends, before + chars, side="right")), first + 1)
        yield batch.slice(first, upto - first)
        first, before = upto, int(ends[upto - 1])


def apply_subwords(df: DataFrame, col: str, model: str, kind: str = "tokenizers", out: str = "ids") -> DataFrame:
    """Apply a pretrained subword model to whole texts, some of an Arrow batch at a time.

    ``model`` is a serialised ``tokenizers`` model or the path of a SentencePiece model added with
    ``SparkContext.addFile``. The model is loaded once per Python worker task.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if kind == "tokenizers":
            from tokenizers import Tokenizer as Model

            loaded = Model.from_str(shipped.value)
            encode = lambda texts: [e.ids for e in loaded.encode_batch(texts)]
        else:
            import sentencepiece
            from pyspark import SparkFiles

            loaded = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(shipped.value))
            encode = loaded.encode
        for batch in batches:
            at = batch.schema.get_field_index(col)
            for piece in _slices(batch, at, PIECE_CHARS):
                ids = pa.array(encode([x or "" for x in piece.column(at).to_pylist()]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*piece.columns, ids], names=[*piece.schema.names, out])

    return df.mapInArrow(run, schema)
