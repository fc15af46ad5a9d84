import zlib
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm import mixing, packing, queries
from pyspark.sql import functions as F


def lay_out(counts, capacity):
    """Sequences of a plan as {sequence: [(offset, length)]}."""
    out = defaultdict(list)
    for length, a, b, first, offset, each in packing.plan_slots(counts, capacity):
        for i in range(b - a):
            out[first + i // each].append((offset + i % each * length, length))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_gapless_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(np.clip(rng.lognormal(5.5 + seed / 3, 1, 3000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(lengths.tolist(), n.tolist()))
    plan = lay_out(counts, 2048)
    seen = defaultdict(int)
    for pieces in plan.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
            seen[length] += 1
        assert at <= 2048
        assert sum(3 * x > 2048 for _, x in pieces) <= 2
    assert dict(seen) == counts
    pairs = sum(2 * x > 2048 for x, c in counts.items() for _ in range(c))
    bound = max(pairs, -(-sum(x * c for x, c in counts.items()) // 2048))
    assert len(plan) <= bound * 1.08 + 1


def test_plan_edges():
    assert packing.plan_slots({}, 10) == []
    assert len(lay_out({10: 3}, 10)) == 3
    assert len(lay_out({5: 3}, 10)) == 2
    assert len(lay_out({1: 25}, 10)) == 3
    assert len(lay_out({6: 1, 4: 2}, 10)) == 2


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> <|endoftext| >", "é<|endoftext|>'s", "x<|endoftext|><|endoftext|>"])
def test_added_tokens_are_read_as_the_tokenizer_reads_them(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordIds(queries.tokenizer_path()).encode(text), "<u4").tolist() == want


def test_pieces_are_those_of_the_tokenizer(spark, folder, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in queries.op1_best_fit_packing(spark, folder).collect())
    want = []
    for (i, _), e in zip(texts, tok.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert got == sorted(want)


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(packing.pieces(odd, queries.tokenizer_path(), keep_ids=True)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["doc_id"] == 3 for r in rows) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 5)) == 2
    assert packing.pack(packing.pieces(empty, queries.tokenizer_path())).count() == 0


def test_mixing_reaches_targets(spark, docs_of):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(n), "en", "abc"[int(s)]) for i, (n, s) in enumerate(zip(rng.integers(0, 50, 900), rng.choice(3, 900, p=[0.05, 0.15, 0.8])))]
    got = mixing.mix_counts(docs_of(rows), mixing.text_size(F.col("text"))).collect()
    total = sum(r["size"] for r in got)
    by = defaultdict(lambda: [0, 0, 0.0])
    for r, (_, _, _, s) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        by[s][0] += r["size"]
        by[s][1] += r["size"] * r["copies"]
        by[s][2] = r["target"]
        assert 0 <= r["copies"] <= 3
    left, weights, want = total, {"a": 5, "b": 2, "c": 1}, {}
    for s in "abc":  # the small source with the large weight is at its cap
        if left * weights[s] / sum(weights.values()) > 3 * by[s][0]:
            want[s] = 3 * by[s][0]
            left -= want[s]
            del weights[s]
    want |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
    for s in "abc":
        assert by[s][2] == pytest.approx(want[s])
        assert abs(by[s][1] - want[s]) <= 150


def test_mixing_of_odd_rows(odd, empty):
    counts = mixing.mix_counts(odd, mixing.text_size(F.col("text")))
    assert counts.count() == 10 and counts.collect() == counts.collect()
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert sorted(r["_id"] for r in out.collect()) == sorted(r["_id"] for r in mixing.mix(odd).collect())
    assert mixing.mix(empty).count() == 0
