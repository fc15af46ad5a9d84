"""Distances and alignments of many pairs of word lists at once.

The words of an Arrow batch are numbered by one dictionary, so any number of distinct words will do. Pairs
are taken in groups of like size and all pairs of a group advance together, a word at a time:

* distance and common subsequence by bit vectors, one 64-bit word for short references, whole numbers of any
  length for long ones (cost: words of one side times 64-bit blocks of the other),
* error kinds by rows of the cost matrix; a long pair only in the band around the diagonal that its distance
  allows,
* alignments by the full matrices of a group of short pairs; a long pair keeps a few rows, and computes the
  rows between two of them again when the path gets there (cost matrix never held whole).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a group's rows, and of the matrices a group or a stretch of a long pair holds.
ROW_CELLS, CELLS = 1 << 19, 1 << 21
#: Rows a long pair keeps of each stretch.
KEPT = 16


@dataclass(frozen=True)
class Words:
    """Numbered words of a batch of pairs: flat codes and the start and size of each list."""

    codes: tuple[np.ndarray, np.ndarray]
    start: tuple[np.ndarray, np.ndarray]
    size: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(ref: pa.Array, hyp: pa.Array) -> Words:
        """Null lists count as empty; a null word is a word of its own."""
        flat = [x.flatten() for x in (ref, hyp)]
        names = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode")
        codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = [np.asarray(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64) for x in (ref, hyp)]
        return Words((codes[: len(flat[0])], codes[len(flat[0]) :]), tuple(np.cumsum(s) - s for s in size), tuple(size))

    def list(self, side: int, i: int) -> np.ndarray:
        at = self.start[side][i]
        return self.codes[side][at : at + self.size[side][i]]

    def padded(self, side: int, rows: np.ndarray) -> np.ndarray:
        """Lists of ``rows`` as a matrix; places behind a list hold a number that no word of the other side has."""
        size = self.size[side][rows]
        out = np.full((len(rows), int(size.max(initial=0))), -1 - side, np.int64)
        inside = np.arange(out.shape[1]) < size[:, None]
        out[inside] = self.codes[side][np.repeat(self.start[side][rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return out

    def groups(self, rows: np.ndarray, cells: Callable[[int, int], int], limit: int) -> Iterator[np.ndarray]:
        """``rows`` by size of both lists, cut where the cells of the largest pair times their number pass ``limit``."""
        n, m = self.size[0][rows], self.size[1][rows]
        rows = rows[np.lexsort((m, n))]
        lo, widest = 0, 0
        for k, i in enumerate(rows.tolist()):
            wide = max(widest, cells(int(self.size[0][i]), int(self.size[1][i])))
            if k > lo and wide * (k + 1 - lo) > limit:
                yield rows[lo:k]
                lo, wide = k, cells(int(self.size[0][i]), int(self.size[1][i]))
            widest = wide
        if lo < len(rows):
            yield rows[lo:]


def _masks(short: np.ndarray, word: np.ndarray) -> np.ndarray:
    """For each pair, bit i is set where its i-th short word equals ``word``."""
    bits = np.zeros((len(short), 64), bool)
    bits[:, : short.shape[1]] = short == word[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _by_bits(words: Words, narrow: Callable, wide: Callable) -> np.ndarray:
    """A number per pair: ``narrow`` for groups whose shorter list has at most 64 words, ``wide`` for the others."""
    out = np.zeros(len(words.size[0]), np.int64)
    small = np.minimum(*words.size) <= 64
    for side in (0, 1):  # the side of the shorter list
        mine = words.size[side] <= words.size[1 - side] if side == 0 else words.size[1] < words.size[0]
        for rows in words.groups(np.flatnonzero(small & mine), lambda n, m: max(n, m) + 64, ROW_CELLS):
            long = words.size[1 - side][rows]
            rows = rows[np.argsort(long, kind="stable")]
            out[rows] = narrow(words.padded(side, rows), words.padded(1 - side, rows), words.size[side][rows], words.size[1 - side][rows])
    for i in np.flatnonzero(~small).tolist():
        a, b = words.list(0, i), words.list(1, i)
        out[i] = wide(*((a, b) if len(a) <= len(b) else (b, a)))
    return out


def _distance_bits(short: np.ndarray, long: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down = np.full(len(n), full), np.zeros(len(n), np.uint64)
    last, out, one = np.maximum(n - 1, 0).astype(np.uint64), n.copy(), np.uint64(1)
    for j in range(long.shape[1]):
        on = slice(int(np.searchsorted(m, j, "right")), None)  # sorted by size: those with a word here
        p, q = up[on], down[on]
        eq = _masks(short[on], long[on, j])
        zero = (((eq & p) + p) ^ p) | eq | q
        plus, minus = q | ~(zero | p), zero & p
        out[on] += ((plus >> last[on]) & one).astype(np.int64) - ((minus >> last[on]) & one).astype(np.int64)
        plus, minus = plus << one | one, minus << one
        up[on], down[on] = minus | ~(zero | plus), plus & zero
    return np.where(n == 0, m, out)


def _distance_long(a: np.ndarray, b: np.ndarray) -> int:
    lo = int(np.argmax(np.append(a != b[: len(a)], True)))
    a, b = a[lo:], b[lo:]
    hi = int(np.argmax(np.append((a != b[len(b) - len(a) :])[::-1], True)))
    a, b = a[: len(a) - hi].tolist(), b[: len(b) - hi].tolist()
    if not a:
        return len(b)
    places = _Places(a)
    top, whole, out = len(a) - 1, (1 << len(a)) - 1, len(a)
    up, down = whole, 0
    for w in b:
        eq = places.of(w)
        zero = ((((eq & up) + up) ^ up) | eq | down) & whole
        plus, minus = down | whole ^ (zero | up), zero & up
        out += (plus >> top & 1) - (minus >> top & 1)
        plus = plus << 1 & whole | 1
        up, down = minus << 1 & whole | whole ^ (zero | plus), plus & zero
    return out


class _Places:
    """Bits of the places of each word of a list. Only those of common words are kept, so memory follows the list."""

    def __init__(self, words: list[int]) -> None:
        self.at: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            self.at.setdefault(w, []).append(i)
        self.size, self.known = len(words) // 8 + 1, {}
        self.common = len(words) // 256 if len(words) > 4096 else 0

    def of(self, w: int) -> int:
        found = self.known.get(w)
        if found is None:
            where = self.at.get(w, ())
            bits = bytearray(self.size)  # setting bits of a long number one by one would copy it
            for i in where:
                bits[i >> 3] |= 1 << (i & 7)
            found = int.from_bytes(bits, "little")
            if len(where) > self.common:
                self.known[w] = found
        return found


def long_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of one pair of any length."""
    return _distance_long(*((a, b) if len(a) <= len(b) else (b, a)))


#: Blocks of 64 characters of the shorter text that a group of pairs is held in; longer ones are taken pair by pair.
LADDER = np.array([1, 2, 3, 4, 6, 8, 12, 16])
#: Characters of a run of pairs, and 64-bit words of a group's table of places.
RUN_CHARS, TABLE = 1 << 21, 1 << 20


def char_distances(ref: pa.Array, hyp: pa.Array) -> np.ndarray:
    """Edit distance of the characters of every pair of texts (null: empty)."""
    size = np.zeros(len(ref), np.int64)
    for x in (ref, hyp):
        size += pc.binary_length(x).fill_null(0).to_numpy(zero_copy_only=False)
    out, lo, ends = [np.zeros(0, np.int64)], 0, np.cumsum(size)
    while lo < len(ref):
        hi = max(lo + 1, int(np.searchsorted(ends, RUN_CHARS + (ends[lo - 1] if lo else 0), "right")))
        out.append(_char_distances(ref[lo:hi].fill_null("").to_pylist(), hyp[lo:hi].fill_null("").to_pylist()))
        lo = hi
    return np.concatenate(out)


def _char_distances(ref: list[str], hyp: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join([*ref, *hyp]).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    codes, kinds = (np.cumsum(seen) - 1)[codes], max(1, int(np.count_nonzero(seen)))
    size = np.fromiter(map(len, [*ref, *hyp]), np.int64, 2 * len(ref))
    start = (np.cumsum(size) - size).reshape(2, -1)
    size = size.reshape(2, -1)
    side, every = (size[1] < size[0]).astype(np.int64), np.arange(len(ref))  # the side of the shorter text
    n, m, at, to = size[side, every], size[1 - side, every], start[side, every], start[1 - side, every]
    out = np.where(n == 0, m, 0)
    step = np.searchsorted(LADDER, -(-n // 64))
    for k in np.unique(step[n > 0]).tolist():
        rows = np.flatnonzero((step == k) & (n > 0))
        rows, lo = rows[np.argsort(m[rows], kind="stable")], 0
        blocks = int(LADDER[k]) if k < len(LADDER) else 0
        while lo < len(rows):
            fit = int(np.searchsorted(np.arange(1, len(rows) - lo + 1) * m[rows[lo:]], ROW_CELLS, "right"))
            part = rows[lo : lo + max(1, min(fit, TABLE // (kinds * max(1, blocks))))]
            lo += len(part)
            if blocks and len(part) >= 8 * blocks:
                out[part] = _char_bits(codes, kinds, blocks, at[part], n[part], to[part], m[part])
                continue
            for i in part.tolist():  # too few to advance together
                out[i] = _distance_long(codes[at[i] : at[i] + n[i]], codes[to[i] : to[i] + m[i]])
    return out


def _char_bits(codes: np.ndarray, kinds: int, blocks: int, at: np.ndarray, n: np.ndarray, to: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances of pairs sorted by ``m``, the size of the longer text; the shorter one fits ``blocks`` words of 64 bits."""
    full, one, top = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1), np.uint64(63)
    base = np.arange(len(n)) * kinds
    places = np.zeros((blocks, len(n) * kinds), np.uint64)
    by_size = np.argsort(n, kind="stable")
    sizes = n[by_size]
    for i in range(int(sizes[-1])):
        on = by_size[int(np.searchsorted(sizes, i, "right")) :]
        places[i >> 6, base[on] + codes[at[on] + i]] |= one << np.uint64(i & 63)
    up, down = np.full((blocks, len(n)), full), np.zeros((blocks, len(n)), np.uint64)
    first = np.searchsorted(m, np.arange(int(m[-1])), "right").tolist()
    for j, lo in enumerate(first):
        here = base[lo:] + codes[to[lo:] + j]
        plus_in, minus_in = one, np.uint64(0)
        for b in range(blocks):
            p, q, eq = up[b, lo:], down[b, lo:], places[b][here]
            free = eq | q
            eq |= minus_in
            zero = (((eq & p) + p) ^ p) | eq
            plus, minus = q | ~(zero | p), zero & p
            plus_out, minus_out = plus >> top, minus >> top
            plus, minus = plus << one | plus_in, minus << one | minus_in
            up[b, lo:], down[b, lo:] = minus | ~(free | plus), plus & free
            plus_in, minus_in = plus_out, minus_out
    # the last column of the costs: the size of the longer text, then up or down by one a character
    out = m.copy()
    for b in range(blocks):
        inside = np.clip(n - 64 * b, 0, 64)
        mask = np.where(inside == 64, full, (one << np.minimum(inside, 63).astype(np.uint64)) - one)
        out += np.bitwise_count(up[b] & mask).astype(np.int64) - np.bitwise_count(down[b] & mask).astype(np.int64)
    return out


def distances(words: Words) -> np.ndarray:
    """Edit distance of every pair."""
    return _by_bits(words, _distance_bits, _distance_long)


def _common_bits(short: np.ndarray, long: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    rest = np.full(len(n), np.uint64(0xFFFFFFFFFFFFFFFF))
    for j in range(long.shape[1]):
        on = slice(int(np.searchsorted(m, j, "right")), None)
        hit = rest[on] & _masks(short[on], long[on, j])
        rest[on] = (rest[on] + hit) | (rest[on] - hit)
    return np.bitwise_count(~rest).astype(np.int64)


def _common_long(a: np.ndarray, b: np.ndarray) -> int:
    places, whole = _Places(a.tolist()), (1 << len(a)) - 1
    rest = whole
    for w in b.tolist():
        hit = rest & places.of(w)
        rest = (rest + hit | rest - hit) & whole
    return len(a) - rest.bit_count()


def common_lengths(words: Words) -> np.ndarray:
    """Length of the longest common subsequence of every pair."""
    return _by_bits(words, _common_bits, _common_long)


# ---------------------------------------------------------------- costs and alignments
#
# A substitution costs ``unit``, an insertion or deletion ``unit + 1``. With unit above both lengths the
# least cost holds the distance and, among the best alignments, the fewest insertions and deletions, which is
# the most substitutions. With ``kinds`` false all three cost 1.


def _next_row(row: np.ndarray, same: np.ndarray, unit: np.ndarray, gap: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """Row of the cost matrix below ``row``; ``ramp`` is gap times the column."""
    best = row + gap
    np.minimum(best[..., 1:], row[..., :-1] + np.where(same, 0, unit), out=best[..., 1:])
    return np.minimum.accumulate(best - ramp, axis=-1) + ramp


def error_kinds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distance, insertions + deletions) of every pair's best alignment with the most substitutions."""
    every = np.arange(len(words.size[0]))
    large = (words.size[0] + 1) * (words.size[1] + 1) > ROW_CELLS
    errors, moved = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for rows in words.groups(every[~large], lambda n, m: m + 1, ROW_CELLS):
        ref, hyp = words.padded(0, rows), words.padded(1, rows)
        n, m = words.size[0][rows], words.size[1][rows]
        unit = (n + m + 1)[:, None]
        ramp = np.arange(hyp.shape[1] + 1) * (unit + 1)
        row, at = ramp.copy(), np.arange(len(rows))
        done = row[at, m]
        for i in range(ref.shape[1]):
            on = slice(int(np.searchsorted(n, i, "right")), None)  # groups are sorted by reference size
            row[on] = _next_row(row[on], hyp[on] == ref[on, i : i + 1], unit[on], unit[on] + 1, ramp[on])
            done[on] = row[at[on], m[on]]
        errors[rows], moved[rows] = done // unit[:, 0], done % unit[:, 0]
    for i in every[large].tolist():
        a, b = words.list(0, i), words.list(1, i)
        errors[i] = long_distance(a, b)
        moved[i] = _banded(a, b, int(errors[i])) - errors[i] * (len(a) + len(b) + 1)
    return errors, moved


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Least cost of a pair whose best paths leave the diagonal by at most ``band`` (its distance)."""
    n, m = len(a), len(b)
    unit = n + m + 1
    far = np.int64(1) << 62
    lo, row = 0, np.arange(min(m, band) + 1, dtype=np.int64) * (unit + 1)
    for i in range(1, n + 1):
        left, right = max(0, i - band), min(m, i + band)
        above = np.full(right - left + 2, far)  # columns left - 1 .. right of the row before
        shift = lo - (left - 1)
        above[shift : shift + len(row)] = row if shift >= 0 else row[-shift:]
        best = above[1:] + (unit + 1)
        cols = np.arange(left, right + 1)
        diagonal = above[:-1] + np.where(cols > 0, np.where(b[cols - 1] == a[i - 1], 0, unit), far >> 1)
        np.minimum(best, diagonal, out=best)
        ramp = (cols - left) * (unit + 1)
        row, lo = np.minimum(np.minimum.accumulate(best - ramp) + ramp, far), left
    return int(row[m - lo])


def _path(a: np.ndarray, b: np.ndarray, kinds: bool) -> Iterator[tuple[int, int]]:
    """Index pairs from the end of one pair's best alignment; -1 marks a missing side.

    At each place a substitution or match is taken before a deletion, and that before an insertion. Rows are
    held for one stretch at a time: KEPT rows of the whole, then of the stretch between two of them, down to
    stretches whose rows fit CELLS.
    """
    unit = len(a) + len(b) + 1 if kinds else 1
    gap = unit + 1 if kinds else 1
    kind = np.int32 if (unit + 1) * (len(a) + len(b) + 1) < 1 << 31 else np.int64
    unit, gap = kind(unit), kind(gap)
    j = len(b)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        return _next_row(row, b[: len(row) - 1] == a[i], unit, gap, np.arange(len(row), dtype=kind) * gap)

    def stretch(lo: int, hi: int, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Steps from row ``hi`` up to row ``lo``, whose costs are ``row``."""
        nonlocal j
        row = row[: j + 1]
        if (hi - lo) * len(row) <= CELLS or hi - lo <= KEPT:
            held = [row]
            for i in range(lo, hi):
                held.append(below(held[-1], i))
            i = hi
            while i > lo or lo == 0 and j:
                here = held[i - lo][j]
                same = i > lo and j and a[i - 1] == b[j - 1]
                if i > lo and j and here == held[i - lo - 1][j - 1] + (0 if same else unit):
                    i, j = i - 1, j - 1
                    yield i, j
                elif i > lo and here == held[i - lo - 1][j] + gap:
                    i -= 1
                    yield i, -1
                else:
                    j -= 1
                    yield -1, j
            return
        cuts = np.linspace(lo, hi, KEPT + 1).astype(int).tolist()
        held = [row]
        for lo_, hi_ in zip(cuts, cuts[1:-1]):
            row = held[-1]
            for i in range(lo_, hi_):
                row = below(row, i)
            held.append(row)
        for lo_, hi_ in zip(cuts[-2::-1], cuts[:0:-1]):
            yield from stretch(lo_, hi_, held.pop())

    yield from stretch(0, len(a), np.arange(len(b) + 1, dtype=kind) * gap)


def _short_and_long(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cost matrix is held whole, and the others."""
    large = (words.size[0] + 1) * (words.size[1] + 1) > CELLS // 8
    return np.flatnonzero(~large), np.flatnonzero(large)


def _steps(words: Words, rows: np.ndarray, kinds: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the end of the best alignments of a group of short pairs: which pairs have a step here, its place on either
    side (-1: none), and whether it is a match."""
    ref, hyp = words.padded(0, rows), words.padded(1, rows)
    i, j = words.size[0][rows].copy(), words.size[1][rows].copy()
    unit = (i + j + 1 if kinds else np.ones_like(i))[:, None]
    gap = unit + 1 if kinds else unit
    ramp = np.arange(hyp.shape[1] + 1) * gap
    cost = [ramp]
    for k in range(ref.shape[1]):
        cost.append(_next_row(cost[-1], hyp == ref[:, k : k + 1], unit, gap, ramp))
    matrix, at = np.stack(cost, 1), np.arange(len(rows))
    unit, gap = unit[:, 0], gap[:, 0]
    while (on := (i > 0) | (j > 0)).any():
        here, up, left = matrix[at, i, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        same = ref[at, up] == hyp[at, left] if ref.shape[1] and hyp.shape[1] else np.zeros(len(rows), bool)
        both = on & (i > 0) & (j > 0) & (here == matrix[at, up, left] + np.where(same, 0, unit))
        gone = on & ~both & (i > 0) & (here == matrix[at, up, j] + gap)
        new = on & ~both & ~gone
        yield on, np.where(both | gone, up, -1), np.where(both | new, left, -1), both & same
        i, j = np.where(both | gone, up, i), np.where(both | new, left, j)


def alignments(words: Words, kinds: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(pair, index pairs in order) of every pair's best alignment; -1 marks a missing side.

    Of several best alignments the one is taken that, from the end, prefers matches and substitutions, then
    deletions, then insertions; with ``kinds`` it has the most substitutions.
    """
    short, large = _short_and_long(words)
    for rows in words.groups(short, lambda n, m: (n + 1) * (m + 1), CELLS):
        steps = [np.stack((up, left, on), 1) for on, up, left, _ in _steps(words, rows, kinds)]
        path = np.stack(steps, 1) if steps else np.empty((len(rows), 0, 3), np.int64)
        for k, row in enumerate(rows.tolist()):
            yield row, path[k, path[k, :, 2] > 0, :2][::-1]
    for row in large.tolist():
        yield row, np.array(list(_path(words.list(0, row), words.list(1, row), kinds)), np.int64).reshape(-1, 2)[::-1]


def matches(words: Words) -> np.ndarray:
    """For the words of all hypotheses, one after the other: are they matched in the alignment with the most substitutions?"""
    marks = np.zeros(int(words.size[1].sum()), bool)
    short, large = _short_and_long(words)
    for rows in words.groups(short, lambda n, m: (n + 1) * (m + 1), CELLS):
        start = words.start[1][rows]
        for _, _, left, match in _steps(words, rows, True):
            marks[start[match] + left[match]] = True
    for i in large.tolist():
        a, b = words.list(0, i), words.list(1, i)
        for up, left in _path(a, b, True):
            if up >= 0 and left >= 0 and a[up] == b[left]:
                marks[words.start[1][i] + left] = True
    return marks
