"""Batch kernels for pairs of word lists against plain matrices."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftline.functions import pairs


def matrix(ref, hyp, kinds):
    unit = len(ref) + len(hyp) + 1 if kinds else 1
    gap = unit + 1 if kinds else 1
    rows = [[j * gap for j in range(len(hyp) + 1)]]
    for w in ref:
        row = [rows[-1][0] + gap]
        for j, v in enumerate(hyp):
            row.append(min(rows[-1][j + 1] + gap, row[-1] + gap, rows[-1][j] + (0 if w == v else unit)))
        rows.append(row)
    return rows, unit, gap


def path(ref, hyp, kinds):
    rows, unit, gap = matrix(ref, hyp, kinds)
    out, i, j = [], len(ref), len(hyp)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (0 if ref[i - 1] == hyp[j - 1] else unit):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and rows[i][j] == rows[i - 1][j] + gap:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def made(longest, n, seed):
    rng = random.Random(seed)
    refs, hyps = [], []
    for _ in range(n):
        a = [rng.choice("abcdefg"[: rng.randint(1, 7)]) for _ in range(rng.randint(0, longest))]
        b = list(a) if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, longest))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            if rng.random() < 0.4:
                b[at : at + 1] = []
            else:
                b[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")]
        refs.append(a)
        hyps.append(b)
    return refs, hyps


@pytest.mark.parametrize("longest, n, cells, kept, row_cells", [(12, 600, 1 << 21, 16, 1 << 19), (90, 150, 300, 3, 600), (140, 80, 2000, 4, 5000), (70, 100, 1 << 21, 16, 1 << 19)])
def test_kernels_against_matrices(monkeypatch, longest, n, cells, kept, row_cells):
    for name, value in (("CELLS", cells), ("KEPT", kept), ("ROW_CELLS", row_cells)):
        monkeypatch.setattr(pairs, name, value)
    refs, hyps = made(longest, n, longest)
    words = pairs.Words.of(pa.array(refs, pa.list_(pa.string())), pa.array(hyps, pa.list_(pa.string())))
    ends = [divmod(matrix(a, b, True)[0][-1][-1], len(a) + len(b) + 1) for a, b in zip(refs, hyps)]
    assert pairs.distances(words).tolist() == [e for e, _ in ends]
    assert list(zip(*(x.tolist() for x in pairs.error_kinds(words)))) == ends
    assert pairs.common_lengths(words).tolist() == [common(a, b) for a, b in zip(refs, hyps)]
    for kinds in (True, False):
        got = dict(pairs.alignments(words, kinds))
        assert [[tuple(x) for x in got[i].tolist()] for i in range(n)] == [path(a, b, kinds) for a, b in zip(refs, hyps)]


def test_nulls_and_slices():
    a = pa.array([["x"], None, ["x", None], [], ["y"]], pa.list_(pa.string()))
    b = pa.array([["y"], ["x"], [None, "x"], None, ["y"]], pa.list_(pa.string()))
    assert pairs.distances(pairs.Words.of(a, b)).tolist() == [1, 1, 2, 0, 0]
    assert pairs.distances(pairs.Words.of(a.slice(2), b.slice(2))).tolist() == [2, 0, 0]
    assert pairs.common_lengths(pairs.Words.of(a, b)).tolist() == [0, 0, 1, 0, 1]
    none = pa.array([], pa.list_(pa.string()))
    assert pairs.distances(pairs.Words.of(none, none)).tolist() == [] and list(pairs.alignments(pairs.Words.of(none, none), True)) == []


def test_a_long_pair_is_aligned_in_little_memory():
    rng = random.Random(3)
    a = np.array([rng.randrange(3000) for _ in range(6000)])
    b = np.delete(a, rng.sample(range(6000), 600))
    b = np.insert(b, [10, 500, 3000], [1, 2, 3])
    words = pairs.Words.of(pa.array([a.tolist()]), pa.array([b.tolist()]))
    tracemalloc.start()
    steps = dict(pairs.alignments(words, True))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # the matrix has 32 million cells
    both = steps[(steps >= 0).all(1)]
    errors, moved = pairs.error_kinds(words)
    assert (steps < 0).any(1).sum() == moved[0]
    assert (a[both[:, 0]] != b[both[:, 1]]).sum() == errors[0] - moved[0]


def test_many_distinct_words_take_little_memory():
    a = list(range(60_000))
    b = a[::2] + a[1::2]
    tracemalloc.start()
    got = pairs.long_distance(np.array(a[:20_000]), np.array(b[:20_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got > 0 and peak < 20e6
