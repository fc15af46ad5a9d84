"""End-of-utterance rules on one buffer, as Column expressions.

A buffer is bounded by construction (a few seconds of frames), so arrays per buffer are safe; the
same expressions run on batches and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.scoped import let


def _answer(found: Column, at: Column) -> Column:
    return F.struct(found.alias("is_eou"), at.alias("at"))


def frames_of(ms: int, ms_per_step: int) -> int:
    """Steps that cover ``ms`` milliseconds; negative stays negative (rule off)."""
    return ms if ms <= 0 else -(-ms // ms_per_step)


def eou_from_times(times: Column, length: Column, stop: int, residue: int = 0) -> Column:
    """Silence after the last token, or else the last gap between tokens, longer than ``stop`` steps.

    The position is the step after the token plus half of ``stop``. Negative ``stop`` switches the
    rule off, zero always fires at the end of the buffer.
    """
    none = _answer(F.lit(False), F.lit(-1).cast("long"))
    if stop < 0:
        return none
    if stop == 0:
        return F.when(F.size(times) == 0, none).otherwise(_answer(F.lit(True), length.cast("long")))
    end = F.greatest(length - residue, F.lit(0)) if residue > 0 else length

    def rule(t: Column) -> Column:
        last = F.element_at(t, -1)
        trailing = F.greatest(end - last - 1, F.lit(0)) > stop
        before = F.slice(t, F.lit(1), F.size(t) - 1)
        gaps = F.filter(
            F.zip_with(before, F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.struct(a.alias("a"), (b - a - 1).alias("gap"))),
            lambda g: g["gap"] > stop,
        )
        at = lambda x: (x + 1 + stop // 2).cast("long")
        return F.when(trailing, _answer(F.lit(True), at(last))).when(
            F.size(gaps) > 0, _answer(F.lit(True), at(F.element_at(gaps, -1)["a"]))
        ).otherwise(none)

    return F.when(F.size(times) == 0, none).otherwise(let(times, rule))


def eou_from_emissions(emissions: Column, pivot: Column, stop: int, silent: int, starts_word, search_from: Column | None = None, residue: int = 0) -> Column:
    """Run of silent steps longer than ``stop`` that reaches back to the pivot.

    Walks from the end of the buffer to ``max(0, search_from, pivot - stop)``. A run counts while the
    token after it starts a word (or there is none); once it counts, the next token ends the walk.
    ``starts_word`` maps a token column to a boolean.
    """
    none = _answer(F.lit(False), F.lit(-1).cast("long"))
    if stop <= 0:
        return none
    low = F.greatest(F.lit(0), pivot - stop, search_from if search_from is not None else F.lit(0))

    def walk(e: Column) -> Column:
        end = F.greatest(F.size(e) - residue, F.lit(0)) if residue > 0 else F.size(e)
        first = F.greatest(end - 1, F.lit(0))
        steps = F.when(first >= low, F.sequence(first.cast("int"), low.cast("int"))).otherwise(F.array().cast("array<int>"))
        start = F.struct(
            F.lit(0).alias("n"), F.lit(False).alias("hit"), F.lit(-1).alias("at"), F.lit(None).cast("int").alias("tok"), F.lit(False).alias("done")
        )

        def step(s: Column, i: Column) -> Column:
            tok = F.get(e, i).cast("int")
            quiet = tok == silent
            n = s["n"] + 1
            hit = (n > stop) & F.coalesce(starts_word(s["tok"]), F.lit(True))
            on_silent = F.struct(n.alias("n"), hit.alias("hit"), F.when(hit, i).otherwise(s["at"]).alias("at"), s["tok"].alias("tok"), F.lit(False).alias("done"))
            closed = F.struct(s["n"].alias("n"), s["hit"].alias("hit"), s["at"].alias("at"), s["tok"].alias("tok"), F.lit(True).alias("done"))
            fresh = F.struct(F.lit(0).alias("n"), F.lit(False).alias("hit"), F.lit(-1).alias("at"), tok.alias("tok"), F.lit(False).alias("done"))
            return F.when(s["done"], s).when(quiet, on_silent).when(s["hit"], closed).otherwise(fresh)

        return F.aggregate(
            steps, start, step, lambda s: F.when(s["n"] > stop, _answer(F.lit(True), (s["at"] + stop // 2).cast("long"))).otherwise(none)
        )

    return let(emissions, walk)


def eou_from_segments(segments: Column, buffer_seconds: float, stop_ms: int, seconds_per_step: float, search_from: Column | int = 0) -> Column:
    """Silence after the last speech segment, or else the last gap between segments, over ``stop_ms``.

    ``segments``: array of (start, end) seconds, rounded to 4 digits; those that end before the
    search start go, the others are clipped to it.
    """
    none = _answer(F.lit(False), F.lit(-1).cast("long"))
    if stop_ms < 0:
        return none
    stop = stop_ms / 1000
    begin = (F.lit(search_from) if isinstance(search_from, int) else search_from) * seconds_per_step
    tidy = F.transform(
        F.filter(F.transform(segments, lambda s: F.struct(F.bround(s["start"], 4).alias("a"), F.bround(s["end"], 4).alias("b"))), lambda s: s["b"] > begin),
        lambda s: F.struct(F.greatest(s["a"], begin).alias("a"), s["b"].alias("b")),
    )
    at = lambda x: F.floor((x + stop / 2) / seconds_per_step).cast("long")

    def rule(s: Column) -> Column:
        last = F.element_at(s, -1)["b"]
        gaps = F.filter(
            F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda x, y: F.struct(x["b"].alias("b"), (y["a"] - x["b"]).alias("gap"))),
            lambda g: g["gap"] > stop,
        )
        return (
            F.when(F.size(s) == 0, none)
            .when(F.lit(buffer_seconds) - last > stop, _answer(F.lit(True), at(last)))
            .when(F.size(gaps) > 0, _answer(F.lit(True), at(F.element_at(gaps, -1)["b"])))
            .otherwise(none)
        )

    return let(tidy, rule)
