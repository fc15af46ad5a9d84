"""Imports of structured corpora into flat rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scoped import let, once
from weftline.functions.text import conversation_clean, words
from weftline.operators.ordered import running
from weftline.session import cut_lineage


def kaldi_to_manifest(segments: DataFrame, wav: DataFrame, text: DataFrame, aux: dict[str, DataFrame] | None = None) -> DataFrame:
    """Join segments with wav and text, then optional per-label tables.

    ``offset`` is kept only if any row has a non-zero one.
    """
    out = segments.withColumn("duration", F.bround(F.col("end") - F.col("offset"), 3)).join(wav, "wav_label").join(text, "label")
    for name, table in (aux or {}).items():
        out = out.join(table.select("label", name), "label", "left")
    cols = ["label", "audio_filepath", "duration", "text", *(aux or {})]
    if not segments.filter(F.col("offset") != 0).isEmpty():
        cols.insert(2, "offset")
    return out.select(*cols)


INTENT_SCHEMA = T.StructType(
    [
        T.StructField("intent", T.StringType()),
        T.StructField(
            "utterances",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "data",
                            T.ArrayType(
                                T.StructType([T.StructField("text", T.StringType()), T.StructField("entity", T.StringType())])
                            ),
                        )
                    ]
                )
            ),
        ),
    ]
)


def flatten_intents(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """Nested intent JSON to one row per utterance with aligned token and slot arrays."""
    item = df.select(*keep, F.from_json(json_col, INTENT_SCHEMA).alias("j"))
    rows = item.select(*keep, F.col("j.intent").alias("intent"), F.posexplode("j.utterances").alias("utt_no", "u"))
    tokens = F.flatten(F.transform("u.data", lambda d: words(d["text"])))
    slots = F.flatten(
        F.transform("u.data", lambda d: F.transform(words(d["text"]), lambda w: F.coalesce(d["entity"], F.lit("O"))))
    )
    return rows.select(*keep, "intent", F.col("utt_no").cast("long").alias("utt_no"), tokens.alias("tokens"), slots.alias("slots"))


def block_rows(lines: DataFrame, order: str, is_break: Column) -> DataFrame:
    """Number the blocks between break lines; the break lines themselves go.

    The block number is a running count of breaks, taken over value buckets of the line order.
    """
    marked = lines.withColumn("_brk", is_break)
    out = running(marked, [order], sums={"sent_id": F.col("_brk").cast("long")})
    return out.filter(~F.col("_brk")).drop("_brk").withColumn("sent_id", F.col("sent_id").cast("long"))


def file_blocks(files: DataFrame, order: str, lines: Column, is_break: Callable[[Column], Column], blocks: Column | None = None) -> DataFrame:
    """Blocks of whole files, one row each: (sent_id, lines), numbered on from file to file in ``order``.

    ``lines`` are those of a file, as an array. A break line ends its block, which may be empty, and goes; lines after the last
    break are a block too. ``blocks`` says how many a file has, where that is known, so that lines are made once; a file
    that has another number is an error. Files move once, to be numbered; their lines never do.
    """

    def ends(x: Column) -> Column:
        at = F.filter(F.transform(x, lambda l, i: F.when(is_break(l), i)), lambda i: i.isNotNull())
        rest = F.when(F.coalesce(is_break(F.try_element_at(x, F.lit(-1))), F.size(x) == 0), F.array().cast("array<int>"))
        return F.coalesce(F.concat(at, F.coalesce(rest, F.array(F.size(x)))), F.array().cast("array<int>"))

    told = F.size(let(lines, ends)) if blocks is None else blocks
    numbered = running(files.withColumn("_n", told.cast("long")), [order], sums={"_upto": F.col("_n")})
    made = numbered.select((F.col("_upto") - F.col("_n")).alias("_first"), "_n", once(lines).alias("lines"))
    right = F.when(F.size("_ends") == F.col("_n"), F.col("_ends")).otherwise(F.raise_error(F.lit("a file has another number of blocks than told")))
    cut = made.select("_first", "_n", "lines", once(ends(F.col("lines"))).alias("_ends"))
    rows = cut.select("_first", "lines", "_ends", F.posexplode(right).alias("_i", "_end"))
    start = F.when(F.col("_i") > 0, F.get("_ends", F.col("_i") - 1) + 1).otherwise(0)
    return rows.select((F.col("_first") + F.col("_i")).alias("sent_id"), F.slice("lines", start + 1, F.col("_end") - start).alias("lines"))


def cut_sentences(sents: DataFrame, max_length: int) -> DataFrame:
    """Sentences (sent_id, words, labels) in parts of at most ``max_length`` words.

    A longer one is cut after the last ``O`` among its first ``max_length`` labels (after its first token if there is
    none), again and again; empty ones go.
    """
    codes = F.array_join(F.transform("labels", lambda l: F.when(l == "O", "O").otherwise("B")), "")
    # the rest if it fits, else up to the last O, else one token
    cuts = F.regexp_extract_all(codes, F.lit(rf".{{1,{max_length}}}\z|.{{0,{max_length - 1}}}O|."), F.lit(0))
    ends = F.aggregate(cuts, F.array(F.lit(0)), lambda at, c: F.concat(at, F.array(F.element_at(at, -1) + F.length(c))))
    parts = sents.withColumn("_e", ends).select("*", F.posexplode(F.slice("_e", F.lit(2), F.size("_e") - 1)).alias("part", "_end"))
    at = F.get("_e", F.col("part"))
    piece = lambda c: F.slice(c, at + 1, F.col("_end") - at).alias(c)
    return parts.select("sent_id", F.col("part").cast("long").alias("part"), piece("words"), piece("labels"))


def iob_to_sentences(lines: DataFrame, order: str, token: str, label: str, max_length: int | None = None) -> DataFrame:
    """Blank-line separated ``token label`` lines, a row each, to sentences; see ``cut_sentences`` for ``max_length``."""
    blocks = block_rows(lines, order, F.coalesce(F.trim(token), F.lit("")) == "")
    sents = blocks.groupBy("sent_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(token).alias("w"), F.col(label).alias("l")))).alias("_t")
    )
    sents = sents.select("sent_id", F.transform("_t", lambda x: x["w"]).alias("words"), F.transform("_t", lambda x: x["l"]).alias("labels"))
    return sents.withColumn("part", F.lit(0).cast("long")) if max_length is None else cut_sentences(sents, max_length)


def iob_files(files: DataFrame, order: str, lines: Column, max_length: int, blocks: Column | None = None) -> DataFrame:
    """Whole files of (token, label) lines with blank lines between sentences, to sentences cut as in ``cut_sentences``."""
    rows = file_blocks(files, order, lines, lambda x: F.coalesce(F.trim(x["token"]), F.lit("")) == "", blocks)
    sents = rows.select("sent_id", F.col("lines.token").alias("words"), F.col("lines.label").alias("labels"))
    return cut_sentences(sents, max_length)


def tagged_blocks(files: DataFrame, order: str, lines: Column, blocks: Column | None = None) -> DataFrame:
    """Whole files of ``class TAB written TAB spoken`` lines, in blocks that end with an ``<eos>`` line: a row of arrays each.

    A line without a written or spoken form has null there.
    """
    rows = file_blocks(files, order, lines, lambda x: (x == "<eos>") | x.startswith("<eos>\t"), blocks)
    parts = F.transform("lines", lambda x: let(F.split(x, "\t"), lambda p: F.struct(p[0].alias("cls"), F.get(p, F.lit(1)).alias("written"), F.get(p, F.lit(2)).alias("spoken"))))
    return rows.select("sent_id", once(parts).alias("_x")).select("sent_id", "_x.cls", "_x.written", "_x.spoken")


def parse_transcript(
    lines: DataFrame,
    file_id: Column,
    value: str = "value",
    corrections: DataFrame | None = None,
    keep_low_conf: bool = False,
    noises: dict[str, str] | None = None,
) -> DataFrame:
    """Timed transcript lines ``start end channel: words``.

    Comments, blanks, low-confidence lines, impossible times and unknown channels go. The line id is
    the key of an optional correction table (null text drops the line). ``noises`` maps tags to
    replacements.
    """
    v = F.col(value)
    keep = ~v.startswith("#") & (F.trim(v) != "")
    if not keep_low_conf:
        keep = keep & ~v.contains("((")
    toks = words(value)
    rows = lines.filter(keep).withColumn("_t", toks)
    rows = rows.withColumns(
        {"start": F.get("_t", F.lit(0)).try_cast("double"), "end": F.get("_t", F.lit(1)).try_cast("double"), "channel": F.get("_t", F.lit(2))}
    ).filter((F.col("start") >= 0) & (F.col("end") >= F.col("start")) & F.col("channel").isin("A:", "B:"))
    line_id = F.concat_ws("-", file_id, F.substring("channel", 1, 1), (F.col("start") * 10).cast("string"), (F.col("end") * 10).cast("string"))
    content = F.array_join(F.slice("_t", 4, F.greatest(F.size("_t") - 3, F.lit(0))), " ")
    rows = rows.withColumn("line_id", line_id).withColumn("text", content)
    if corrections is not None:
        fix = corrections.select("line_id", F.struct(F.col("text").alias("v")).alias("_fix"))
        rows = rows.join(fix, "line_id", "left")
        rows = rows.withColumn("text", F.when(F.col("_fix").isNotNull(), F.col("_fix.v")).otherwise(F.col("text"))).drop("_fix")
        rows = rows.filter(F.col("text").isNotNull())
    rows = rows.withColumn("text", conversation_clean("text"))
    for tag, new in (noises or {}).items():
        rows = rows.withColumn("text", F.replace("text", F.lit(tag), F.lit(new)))
    side = F.when(F.col("channel") == "A:", 0).otherwise(1)
    return rows.withColumn("channel", side).drop("_t", value)


def tree_threads(nodes: DataFrame) -> DataFrame:
    """Every root-to-leaf path of a message forest as one conversation; single-turn paths go.

    ``nodes``: tree_id, node_id, parent_id (null at the root), role, text. Ancestors 1, 2, 4, ... steps up
    are joined from those half as far, so a depth of d takes log2 d joins. From the longest step down, every
    ancestor found so far adds the one that step above it: each is met once, with its distance, and the turns
    meet their paths in one join. Nodes whose ancestors end without a root, or never end, are in no path.
    """
    key = ["tree_id", "node_id"]
    child = nodes.filter(F.col("parent_id").isNotNull())
    leaves = nodes.join(child.select("tree_id", F.col("parent_id").alias("node_id")).distinct(), key, "left_anti")
    jumps = [cut_lineage(child.select(*key, F.col("parent_id").alias("up")))]
    most = jumps[0].count()
    while 1 << len(jumps) <= most:  # no chain is longer than that, but a circle is
        half = jumps[-1]
        step = cut_lineage(half.join(half.select("tree_id", F.col("node_id").alias("up"), F.col("up").alias("_up")), ["tree_id", "up"]).select(*key, F.col("_up").alias("up")))
        if step.isEmpty():
            break
        jumps.append(step)
    on = leaves.select("tree_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("above"))
    for j in range(len(jumps) - 1, -1, -1):
        more = on.join(jumps[j], key).select("tree_id", "leaf", F.col("up").alias("node_id"), (F.col("above") + (1 << j)).alias("above"))
        on = cut_lineage(on.unionByName(more))
    turns = on.join(nodes.select(*key, F.col("parent_id").isNull().alias("root"), F.struct("role", "text").alias("turn")), key)
    paths = turns.groupBy("tree_id", F.col("leaf").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("above", "turn")), asc=False).alias("_p"), F.max("root").alias("root"))
    return paths.filter(F.col("root") & (F.size("_p") > 1)).select(*key, F.transform("_p", lambda x: x["turn"]).alias("path"))


def extract_corpus(frames: list[DataFrame], col: str = "text") -> DataFrame:
    """The text column of many manifests as one corpus."""
    out = None
    for i, f in enumerate(frames):
        part = f.select(F.lit(i).alias("manifest"), F.col(col).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def flatten_instructions(df: DataFrame, keep: list[str]) -> DataFrame:
    """definition x instance x output, empty outputs dropped, definition and input joined by a blank line."""
    return (
        df.select(*keep, F.explode("definitions").alias("definition"), "instances")
        .select(*keep, "definition", F.explode("instances").alias("i"))
        .select(*keep, F.concat_ws("\n\n", "definition", "i.input").alias("input"), F.explode("i.outputs").alias("output"))
        .filter((F.trim("input") != "") & (F.trim("output") != ""))
    )


def merge_tasks(df: DataFrame, name: str, tasks: dict[str, str], src: str, tgt: str) -> DataFrame:
    """Route template files to tasks by name prefix (longest first); empty inputs or outputs go."""
    task = None
    for prefix in sorted(tasks, key=lambda p: (-len(p), p)):
        hit, value = F.col(name).startswith(prefix), F.lit(tasks[prefix])
        task = F.when(hit, value) if task is None else task.when(hit, value)
    return (
        df.withColumn("task", task)
        .filter(F.col("task").isNotNull() & (F.trim(src) != "") & (F.trim(tgt) != ""))
        .withColumnRenamed(name, "template")
    )


def qa_from_passages(
    df: DataFrame, keep: list[str], only_relevant: bool = False, exclude_negative: bool = False
) -> DataFrame:
    """Passage lists (``passages``: text, is_selected) to context questions.

    Well-formed answers win over plain ones; "No Answer Present." means unanswerable.
    """
    used = F.filter("passages", lambda p: p["is_selected"] == 1) if only_relevant else F.col("passages")
    context = F.array_join(F.transform(used, lambda p: p["text"]), "")
    answers = F.when(F.size("well_formed") > 0, F.col("well_formed")).otherwise(F.col("answers"))
    out = df.withColumn("context", context).withColumn("_a", answers)
    out = out.withColumn("impossible", F.array_contains("_a", "No Answer Present."))
    out = out.withColumn("final_answers", F.when(F.col("impossible"), F.array().cast("array<string>")).otherwise(F.col("_a")))
    if exclude_negative:
        out = out.filter(~F.col("impossible"))
    return out.filter(F.col("context") != "").select(*keep, "context", "impossible", F.col("final_answers").alias("answers"))
