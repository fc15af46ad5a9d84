"""Working views over the input tables: manifest, utterance pairs, chat turns, predictions, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scoped import once
from weftline.functions.text import words
from weftline.operators.ordered import running

UNKNOWN, ADDED = "<unk>", "<added>"
#: where an utterance of a text ends
UTTERANCE_END = r"[.!?]\s+|\n"


def manifest_view(events: DataFrame) -> DataFrame:
    """One manifest row per event: id, speaker, class, duration, token count, time."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("speaker"),
        F.col("event_type").alias("cls"),
        F.col("value").alias("duration"),
        F.get_json_object("props", "$.k").cast("long").alias("num_tokens"),
        "ts",
    )


def utterances(documents: DataFrame) -> DataFrame:
    """Whole documents cut into utterances: (doc_id, lang, source, pos, utt)."""
    return documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", UTTERANCE_END)).alias("pos", "utt")
    ).withColumn("pos", F.col("pos").cast("long"))


def numbered_utterances(documents: DataFrame) -> DataFrame:
    """Utterances by doc_id and pos with their number ``n`` (from 1) and the one after them, null at the end of a text:
    (doc_id, pos, n, utt, after). Whole texts move to be numbered."""
    parts = F.split("text", UTTERANCE_END)
    counted = documents.select("doc_id", "text", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("_n"))
    numbered = running(counted, ["doc_id"], sums={"_upto": F.col("_n")})
    made = numbered.select("doc_id", (F.col("_upto") - F.col("_n")).alias("_before"), once(parts).alias("_parts"))
    rows = made.select("doc_id", "_before", "_parts", F.posexplode("_parts").alias("pos", "utt"))
    number = F.col("_before") + F.col("pos") + 1
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), number.alias("n"), "utt", F.get("_parts", F.col("pos") + 1).alias("after"))


def pairs_view(documents: DataFrame, normalise=None) -> DataFrame:
    """Reference and hypothesis words of every utterance.

    The reference is the lower-cased ASCII text. In the hypothesis every 5th word is unknown, but every 7th
    is missing in the even utterances of a text and followed by an added one in the odd ones. ``normalise`` is applied
    to the text first.
    """
    text = F.lower(F.regexp_replace("utt", "[^ -~]", ""))
    # in plain ASCII without control characters only spaces part words
    ref = words(normalise(text)) if normalise else F.array_remove(F.split(text, " "), "")
    seventh = F.col("pos") % 2 == 1
    # a missing word is null, which the join leaves out
    heard = lambda w, i: (
        F.when((i + 1) % 7 == 0, F.when(seventh, F.concat(w, F.lit(" " + ADDED)))).when((i + 1) % 5 == 0, F.lit(UNKNOWN)).otherwise(w)
    )
    return (
        utterances(documents)
        .select("doc_id", "pos", "lang", "source", once(ref).alias("r"))
        .filter(F.size("r") > 0)
        .select("*", once(F.split(F.array_join(F.transform("r", heard), " "), " ")).alias("h"))
    )


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """A user turn followed directly by an assistant turn of the same conversation."""
    user = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("src")
    )
    reply = conversations.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return user.join(reply, ["conv_id", "turn"])


def prediction_view(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """Binary truth, prediction and score per labelled document."""
    return labels.join(documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id",
        "lang",
        "toxic",
        F.col("quality").alias("truth"),
        F.when(F.col("n_chars") >= 1000, 1).otherwise(0).alias("pred"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"),
    )


def spans_view(events: DataFrame) -> DataFrame:
    """Events as speech segments in seconds since the epoch, per user."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("speaker"),
        F.round(start, 3).alias("start"),
        F.round(start + F.col("value"), 3).alias("end"),
        F.col("event_type").alias("cls"),
    )
