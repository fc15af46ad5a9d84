"""Manifests: JSON-lines scan, alias normalisation, path resolution, shards and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordered import number_rows

# Field aliases of a manifest item, first match wins.
PATH_FIELDS = ["audio_filename", "audio_filepath", "context"]
MANIFEST_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in PATH_FIELDS]
    + [
        T.StructField("duration", T.DoubleType()),
        T.StructField("context_duration", T.DoubleType()),
        T.StructField("offset", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("normalized_text", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("rttm_file", T.StringType()),
        T.StructField("feature_file", T.StringType()),
        T.StructField("orig_sr", T.LongType()),
        T.StructField("token_labels", T.ArrayType(T.LongType())),
        T.StructField("answer", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("task", T.StringType()),
    ]
)


class ManifestError(ValueError):
    """A manifest has malformed lines."""


def parse_lines(
    lines: DataFrame,
    schema: T.StructType,
    on_error: str = "fail",
    parse: Callable[[Column], Column] | None = None,
    keep_unknown: bool = False,
) -> DataFrame:
    """Parse JSON lines (columns ``file``, ``row_no``, ``value``); blank lines are skipped.

    ``fail`` counts malformed lines per file and raises if there are any; ``quarantine`` keeps them
    with ``malformed`` set and their fields null. ``parse`` replaces the JSON parser by any
    expression giving a struct (null for a bad line). ``keep_unknown`` collects undeclared keys as
    text in a ``custom`` map.
    """
    kept = lines.filter(F.trim("value") != "")
    if parse:
        item = parse(F.col("value"))
        bad = F.col("_item").isNull()
    else:
        with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
        item = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        bad = F.col("_item._bad").isNotNull()
    parsed = kept.withColumn("_item", item).withColumn("malformed", bad)
    if on_error == "fail":
        counts = parsed.filter("malformed").groupBy("file").count()
        total = counts.agg(F.count(F.lit(1)).alias("files"), F.sum("count").alias("lines")).first()
        if total["files"]:
            first = counts.orderBy("file").limit(20).collect()  # of the message; the totals are of all files
            raise ManifestError(f"{total['lines']} malformed lines in {total['files']} files: " + ", ".join(f"{r['file']}: {r['count']}" for r in first))
    out = ["file", "row_no", *[F.col(f"_item.{f.name}").alias(f.name) for f in schema.fields], "malformed"]
    if keep_unknown:
        known = [f.name for f in schema.fields]
        extra = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(known))
        out.append(extra.alias("custom"))
    return parsed.select(*out)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with a running number over all files, in file and line order.

    Lines are ordered by file, split offset and position in the split; the running number comes from
    the row count of every split, so no task sees more than one split.
    """
    raw = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_in"),
    )
    per_split = raw.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_split.select("file", "_at", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_in")) - 1
    return raw.join(starts, ["file", "_at"]).select("file", (F.col("_start") + local).alias("row_no"), "value")


def read_manifest(
    spark: SparkSession,
    paths: str | list[str],
    on_error: str = "fail",
    schema: T.StructType = MANIFEST_SCHEMA,
    parse: Callable[[Column], Column] | None = None,
    keep_unknown: bool = False,
) -> DataFrame:
    """JSON-lines manifests with ``id``, the running line number over all files."""
    return parse_lines(read_lines(spark, paths), schema, on_error, parse, keep_unknown).withColumnRenamed("row_no", "id")


def normalize_manifest(df: DataFrame) -> DataFrame:
    """Resolve field aliases: one path, one required duration, one text (possibly empty)."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    duration = pick("duration", "context_duration")
    required = F.when(duration.isNotNull(), duration).otherwise(
        F.raise_error(F.lit("manifest item without duration")).cast("double")
    )
    text = F.coalesce(pick("text", "normalized_text"), F.lit(""))
    drop = [c for c in (*PATH_FIELDS, "context_duration", "normalized_text") if c in have]
    return df.withColumns({"audio_file": pick(*PATH_FIELDS), "duration": required, "text": text}).drop(*drop)


def resolve_paths(df: DataFrame, base: str | Column, col: str = "audio_file", limit: int = 255) -> DataFrame:
    """Join relative names with the manifest folder.

    Absolute paths, object-store addresses and names of ``limit`` or more characters stay as they
    are. File existence is not probed: that would be one remote call per row.
    """
    root = F.lit(base) if isinstance(base, str) else base
    path = F.col(col)
    absolute = path.rlike(r"^(/|~|[a-z0-9]+://)") | (F.length(path) >= limit)
    return df.withColumn(col, F.when(absolute, path).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), path)))


def is_sharded(path: str) -> bool:
    """Sharded manifests name their files inside archives; their paths are not resolved."""
    return "_OP_" in path or "{" in path


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """jsonl, json, csv or tsv with every column as string and nulls as empty strings."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "jsonl":
        df = spark.read.json(path)
    elif kind == "json":
        df = spark.read.option("multiLine", True).json(path)
    elif kind in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").option("multiLine", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported file type: {kind}")
    return all_strings(df)


def all_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def clean_dataset_path(c: Column | str, root: str = "") -> Column:
    """Drop an ``extracted/<digest>/`` part and give the file a wav suffix."""
    path = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"extracted/[0-9a-f]+/", "")
    return F.concat(F.lit(root), F.regexp_replace(path, r"\.[A-Za-z0-9]+$", ""), F.lit(".wav"))


def to_manifest(df: DataFrame, path: str, text: Column, duration: Column, payload: list[str] = ()) -> DataFrame:
    """Dataset rows to flat manifest rows; payload columns are never read."""
    return df.drop(*payload).select(
        clean_dataset_path(path).alias("audio_filepath"), duration.alias("duration"), text.alias("text")
    )


def assign_shards(df: DataFrame, order: list[str], shard_size: int) -> DataFrame:
    """Add ``shard_id``: ``shard_size`` rows per shard in the given order."""
    return number_rows(df, order).withColumn("shard_id", F.floor((F.col("row_no") - 1) / shard_size).cast("long")).drop("row_no")


def shard_index(sharded: DataFrame) -> DataFrame:
    """Rows per shard: the manifest of the shards."""
    return sharded.groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"))


def write_shards(df: DataFrame, path: str, order: list[str], shard_size: int) -> DataFrame:
    """Write one folder per shard and an index; returns the index."""
    sharded = assign_shards(df, order, shard_size)
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(f"{path}/data")
    index = shard_index(df.sparkSession.read.parquet(f"{path}/data"))
    index.write.parquet(f"{path}/index")
    return index


def select_shards(df: DataFrame, spec: str, slice_with_offset: bool = False) -> DataFrame:
    """``all``, ``k`` or ``a:b`` (half-open) shards: a filter on the partition column.

    ``slice_with_offset`` keeps the offset of each item; otherwise it is dropped.
    """
    if spec != "all":
        lo, _, hi = spec.partition(":")
        first = int(lo)
        last = int(hi) if hi else first + 1
        df = df.filter((F.col("shard_id") >= first) & (F.col("shard_id") < last))
    if "offset" in df.columns and not slice_with_offset:
        df = df.drop("offset")
    return df


def write_prepared(df: DataFrame, path: str, train: Column | None = None) -> list[str]:
    """JSON-lines sink that never overwrites; with ``train`` a train and a validation folder."""
    parts = {f"{path}": df} if train is None else {f"{path}_train": df.filter(train), f"{path}_val": df.filter(~train)}
    for where, part in parts.items():
        part.write.mode("errorifexists").json(where)
    return list(parts)


def prediction_rows(df: DataFrame, tokens: str, length: Column, name: str = "dataset") -> DataFrame:
    """Token arrays cut to their length, ready to be written per dataset."""
    return df.withColumn(tokens, F.slice(tokens, 1, F.least(length.cast("int"), F.size(tokens)))).withColumnRenamed(name, "dataset")


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.partitionBy("dataset").mode("errorifexists").json(path)


def ctm_rows(df: DataFrame, segments: str, utt_id: str, min_dur: float = 0.0, keep_blank: bool = False, blank: str = "<b>") -> DataFrame:
    """CTM lines of an array of (text, start, end): unaligned ones dropped, short ones stretched.

    Segments shorter than ``min_dur`` grow about their midpoint, not before 0.
    """
    s = df.select(utt_id, F.posexplode(segments).alias("pos", "s")).select(
        utt_id, "pos", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end")
    )
    s = s.filter((F.col("start") >= 0) & (F.col("end") >= 0))
    if not keep_blank:
        s = s.filter(F.col("text") != blank)
    short = F.col("end") - F.col("start") < min_dur
    mid = (F.col("start") + F.col("end")) / 2
    start = F.when(short, F.greatest(mid - min_dur / 2, F.lit(0.0))).otherwise(F.col("start"))
    s = s.withColumn("start", start).withColumn("end", F.when(short, F.greatest(mid + min_dur / 2, F.col("start") + min_dur)).otherwise(F.col("end")))
    word = F.replace("text", F.lit(" "), F.lit("<space>"))
    line = F.format_string("%s 1 %.2f %.2f %s NA lex NA", F.col(utt_id).cast("string"), F.col("start"), F.col("end") - F.col("start"), word)
    return s.select(utt_id, F.col("pos").cast("long").alias("pos"), "start", "end", line.alias("line"))


def ordinal_map(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values to 0-based ordinals."""
    values = df.select(F.col(col).alias("value")).filter(F.col(col).isNotNull()).distinct()
    return number_rows(values, ["value"]).select("value", (F.col("row_no") - 1).alias("ordinal"))
