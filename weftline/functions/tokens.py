"""Rule tokenisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.scoped import let
from weftline.functions.text import words


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_ids(c: Column | str, offset: int = 0) -> Column:
    """UTF-8 byte values of a text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(_col(c), "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int") + offset)


def byte_text(ids: Column, limit: int = 256) -> Column:
    """Text of byte ids; ids from ``limit`` up are specials and vanish."""
    kept = F.filter(ids, lambda i: (i < limit) & (i >= 0))
    return F.decode(F.unhex(F.array_join(F.transform(kept, lambda i: F.lpad(F.hex(i), 2, "0")), "")), "UTF-8")


def regex_tokens(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def char_tokens(c: Column | str, special: list[str] | None = None) -> Column:
    """Characters; words that are special stay whole; one blank token between words."""
    special = special or []

    def of_word(w: Column, i: Column) -> Column:
        letters = F.filter(F.split(w, ""), lambda x: x != "")
        body = F.when(w.isin(special), F.array(w)).otherwise(letters) if special else letters
        return F.when(i > 0, F.concat(F.array(F.lit(" ")), body)).otherwise(body)

    return F.flatten(F.transform(words(c), of_word))


def char_ngrams(c: Column, n: int) -> Column:
    """All character n-grams, empty for shorter texts; a look-ahead finds them in one linear pass."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def word_ngrams(tokens: Column, n: int) -> Column:
    """All word n-grams joined by a space, empty for shorter rows."""
    if n == 1:
        return tokens

    def cut(x: Column) -> Column:
        last = F.size(x) - n
        grams = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(x, i + 1, F.lit(n)), " ")
        )
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, cut)
