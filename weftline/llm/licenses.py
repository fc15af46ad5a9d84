"""License scan by diagonal voting.

Every pair of neighbouring words of every text is hashed and joined to the positions where templates hold
that pair. A hit of text word i on template word j votes for the diagonal i - j. A short phrase stands
where its diagonal has all its votes. Longer notices may miss or gain a few words: neighbouring diagonals
of a template are merged into a span, and a span is verified:

* The hits are an alignment of its words with the template. Words of either side that no hit covers are
  edits; a notice has at most EDITS of its length of them.
* The words that tell licenses apart (version numbers, nc, sa, nd, lesser, ...) must be those of the
  template, in its order: none added, replaced or missing.
* Of overlapping notices the one with the smallest share of edits stays, then the longest, then the first.

Pairs are compared by 64-bit digests, distinguishing words as they stand. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.scoped import let
from weftline.llm.common import cut_lineage

#: Phrases whose every place counts, with their labels (fixed values).
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Notices that may be found with small changes, with their labels (fixed values; at most 63 pairs each).
NOTICES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words that tell licenses apart, besides those that begin with a digit (fixed values).
DISTINGUISHING = ("affero", "lesser", "nc", "nd", "noncommercial", "noderivs", "sa", "sharealike")
#: Diagonals at most so far apart belong to one span.
DRIFT = 2
#: Edits allowed in a notice, as a share of its length.
EDITS = 0.3
#: No verified span is longer than this many words.
REACH = int(max(len(p.split()) for _, p in NOTICES) * (1 + EDITS)) + 1


def license_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def template_positions(spark: SparkSession) -> DataFrame:
    """(h, template, j): one row per pair of neighbouring template words."""
    rows = []
    for t, (_, phrase) in enumerate(PHRASES + NOTICES):
        words = phrase.split()
        rows += [F.struct(F.xxhash64(F.lit(a), F.lit(b)).alias("h"), F.lit(t).alias("template"), F.lit(j).alias("j")) for j, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _tells(word: str) -> bool:
    return word in DISTINGUISHING or word[0].isdigit()


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 for a phrase, else one less the least share of edits of a notice found (0: none). A null
    text has no words. Rows that repeat an id and a text get the same answer; rows with one id and different
    texts are told apart by a digest of the text. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    entry = lambda i, h, mark: F.struct(i.cast("int").alias("i"), h.cast("long").alias("h"), mark.cast("string").alias("mark"))
    none = F.lit(None)

    def entries(w: Column) -> Column:
        """A row for the text, one for each pair of words and one for each distinguishing word."""
        pairs = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: entry(i, F.xxhash64(x, F.get(w, i + 1)), none))
        marked = F.filter(F.transform(w, lambda x, i: entry(i, none, x)), lambda e: e["mark"].between("0", ":") | e["mark"].isin(*DISTINGUISHING))
        return F.concat(F.array(entry(none, none, none)), pairs, marked)

    read = let(license_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), entries(w).alias("entries")))
    worded = docs.select("doc_id", F.xxhash64(text).alias("_d"), read.alias("_w"))
    places = F.broadcast(template_positions(docs.sparkSession))  # some two hundred rows, fixed above
    hits = worded.select("doc_id", "_d", F.col("_w.n").alias("n_words"), F.inline("_w.entries"))
    joined = hits.join(places, "h", "left").filter("template is not null or i is null or mark is not null")
    votes = joined.groupBy("doc_id", "_d", "n_words", "template", "mark", F.coalesce(F.col("i") - F.col("j"), F.col("i")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(3L, j)")).alias("words"),
        F.bit_or(F.expr("shiftleft(1L, j)")).alias("hit"),
        F.count(F.when(F.col("i").isNull(), 1)).alias("rows"),
        F.min(F.struct("i", "j")).alias("from"),
        F.max(F.struct("i", "j")).alias("to"),
    )
    votes = cut_lineage(votes)

    # a phrase is whole on its own diagonal; diagonals of a notice join their neighbours
    every = PHRASES + NOTICES
    of_template = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    is_phrase = F.col("template") < len(PHRASES)
    near = Window.partitionBy("doc_id", "_d", "template").orderBy("diagonal")
    apart = is_phrase | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near), F.lit(DRIFT + 1)) > DRIFT)
    runs = votes.filter("template is not null").withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(near))
    merged = runs.groupBy("doc_id", "_d", "template", "run").agg(
        F.bit_or("words").alias("words"), F.bit_or("hit").alias("hit"), F.min("from").alias("from"), F.max("to").alias("to")
    )
    size = of_template(len(p.split()) for _, p in every)
    label = of_template(n for n, _ in every)
    phrases = merged.filter(is_phrase & (F.bit_count("hit") == size - 1)).select("doc_id", "_d", F.lit(True).alias("base"), label.alias("label"), "from.i", F.lit(1.0).alias("share"))

    # the span a notice would fill; its ends are read as far as the template has distinguishing words there
    told = [[j for j, w in enumerate(p.split()) if _tells(w)] for _, p in every]
    start, end = F.col("from.i") - F.col("from.j"), F.col("to.i") + size - 1 - F.col("to.j")
    edits = F.greatest(size, end - start + 1) - F.bit_count("words")
    spans = merged.filter(~is_phrase & (edits <= size * EDITS)).select(
        "doc_id", "_d", "template", start.alias("start"), end.alias("end"), (1 - edits / size).alias("share"),
        F.when(of_template(min(t, default=99) for t in told) < F.col("from.j"), start).otherwise(F.col("from.i")).alias("at"),
        F.when(of_template(max(t, default=-1) for t in told) > F.col("to.j") + 1, end).otherwise(F.col("to.i") + 1).alias("until"),
    )
    marks = votes.filter("mark is not null").select("doc_id", "_d", F.col("diagonal").alias("at"), "mark")
    ahead = Window.partitionBy("doc_id", "_d").orderBy("at").rangeBetween(0, REACH)
    beside = spans.unionByName(marks, allowMissingColumns=True).withColumn("marks", F.collect_list(F.when(F.col("mark").isNotNull(), F.struct("at", "mark"))).over(ahead))
    inside = F.array_sort(F.array_distinct(F.filter("marks", lambda m: m["at"] <= F.col("until"))))
    wanted = of_template(" ".join(filter(_tells, p.split())) for _, p in every)
    notices = beside.filter(F.col("template").isNotNull() & (F.array_join(F.transform(inside, lambda m: m["mark"]), " ") == wanted))

    # of overlapping notices the best; a frame holds no more than the spans of some dozen words
    better = F.struct((-F.col("share")).alias("a"), (-size).alias("b"), "template")
    around = Window.partitionBy("doc_id", "_d").orderBy("start").rangeBetween(-REACH, REACH)
    ranked = notices.withColumn("key", better).withColumn("others", F.collect_list(F.struct("key", "start", "end")).over(around))
    beaten = F.exists("others", lambda o: (o["key"] < F.col("key")) & (o["start"] <= F.col("end")) & (o["end"] >= F.col("start")))
    notices = ranked.filter(~beaten).select("doc_id", "_d", F.lit(False).alias("base"), label.alias("label"), F.col("at").alias("i"), "share")

    # one row per text beside its spans; grouped together, as a join would lose null ids
    texts = votes.groupBy("doc_id", "_d", "n_words").agg(F.max("rows").alias("rows"))
    both = texts.unionByName(phrases.unionByName(notices), allowMissingColumns=True)
    at = F.when(F.col("base"), F.col("i").cast("long"))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")  # noqa: E731  no more than there are templates
    found = both.groupBy("doc_id", "_d").agg(
        F.max("n_words").alias("n_words"),
        F.max("rows").alias("rows"),
        F.count(at).alias("n_base"),
        F.min(at).alias("first_word"),
        F.max(at).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        names(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    again = found.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return again.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
