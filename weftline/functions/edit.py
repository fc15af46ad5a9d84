"""Edit distance, alignment and overlap of word arrays and texts.

Word lists and texts go to Arrow functions that number the words or characters of a whole batch and run the
kernels of ``functions/pairs``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import pairs
from weftline.functions.scoped import let


@F.arrow_udf(T.LongType())
def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Word-level edit distance of two word lists (null: empty)."""
    return pa.array(pairs.distances(pairs.Words.of(ref, hyp)), pa.int64())


def _coded(tokens: Column, vocabulary: Column) -> Column:
    """A text of one character a word: its first place in ``vocabulary``."""
    # from U+10000 on no number is a surrogate
    code = lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0xFFFF), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(tokens, code), "")), "UTF-32")


def filler_distance(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance of two short word lists, for use inside array functions, where no Arrow function can be.

    Words of the pair become letters by their first place in it, so the cost is quadratic in its words.
    """

    return let(F.array_distinct(F.concat(ref, hyp)), lambda v: F.levenshtein(_coded(ref, v), _coded(hyp, v)).cast("long"))


@F.arrow_udf(T.LongType())
def char_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Character-level edit distance of two texts (null: null)."""
    none = pc.or_(ref.is_null(), hyp.is_null())
    return pa.array(pairs.char_distances(ref, hyp), pa.int64(), mask=none.to_numpy(zero_copy_only=False))


_KINDS = ("errors", "insertions", "deletions", "substitutions")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in _KINDS]))
def edit_parts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Insertions, deletions and substitutions of the best alignment (ties: most substitutions)."""
    words = pairs.Words.of(ref, hyp)
    errors, moved = pairs.error_kinds(words)
    extra = words.size[1] - words.size[0]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (errors, (moved + extra) // 2, (moved - extra) // 2, errors - moved)], names=list(_KINDS))


@F.arrow_udf(T.LongType())
def lcs_length(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest common subsequence of two lists."""
    return pa.array(pairs.common_lengths(pairs.Words.of(a, b)), pa.int64())


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def correct_marks(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Per hypothesis word: is it matched in the alignment (from the end: match or sub, then del, then ins)?"""
    words = pairs.Words.of(ref, hyp)
    marks = pairs.matches(words)
    offsets = np.append(words.start[1], len(marks)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(marks))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))
def align_words(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Alignment of two word lists as index pairs; -1 marks a missing side."""
    paths: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(ref)
    for i, path in pairs.alignments(pairs.Words.of(ref, hyp), kinds=False):
        paths[i] = path
    flat = np.concatenate([*paths, np.empty((0, 2), np.int64)]).astype(np.int32)
    offsets = np.cumsum([0, *(len(p) for p in paths)]).astype(np.int32)
    ends = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["i", "j"])
    return pa.ListArray.from_arrays(pa.array(offsets), ends)
