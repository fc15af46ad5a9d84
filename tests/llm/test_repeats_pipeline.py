import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import queries, repeats


def plain(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each text, over all windows."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def answer(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (30, 33, 36, 50, 90)]
    out = []
    for i in range(40):
        parts = [text(rng.randint(0, 40)) for _ in range(4)]
        for k in range(3):
            if rng.random() < 0.6:
                s = rng.choice(shared)
                cut = rng.randint(0, len(s) // 3)
                parts.insert(k, s[cut : len(s) - rng.randint(0, len(s) // 3)])
        out.append(" ".join(parts))
    out += [out[0], out[1] + " tail", "ab" * 300, "q" * 450, "q" * 199, shared[4] * 2, "", None]
    near = text(120)
    for i in range(12):  # near copies with one changed word each
        w = near.split(" ")
        w[10 * i] = "CHANGED%d" % i
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,together", [(1, 2048), (2, 2048), (3, 1)])
def test_against_all_windows(docs_of, monkeypatch, seed, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)  # 1: every group is compared window by window
    texts = made_up(seed)
    got = answer(repeats.remove(docs_of(texts).repartition(5)))
    want = plain(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_blocks_overlap(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    texts = made_up(4)
    got = answer(repeats.remove(docs_of(texts)))
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_documents_against_all_windows(spark, folder, texts):
    got = answer(queries.op8_suffix_array_dedup(spark, folder))
    assert [got[i] for i, _ in texts] == plain([t for _, t in texts])


def test_index_matches_are_longest_common_prefixes():
    parts = [b"abracadabra", b"cadabrab", b"abra", b"", b"zz"]
    index = repeats.Stretches(parts)
    flat = [p[i:] for p in parts for i in range(len(p) + 1)]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max(common(a, b) for j, b in enumerate(flat) if j != i) for i, a in enumerate(flat)]
    assert index.matches().tolist() == want
    assert len(index.heads) == len(index.tails) < len(index.text)


def test_odd_rows(odd, empty):
    rows = repeats.remove(odd).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["n_removed"] == 5000 and by[7]["n_removed"] == 150_000 and by[5]["n_bytes"] == 0
    assert repeats.remove(empty).count() == 0


def test_repeated_rows_remove_each_other(docs_of):
    text = " ".join(f"word{i * i}" for i in range(60))
    rows = repeats.remove(docs_of([(1, text), (1, text), (2, "other " + text[:150])])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, len(text)), (1, len(text)), (2, 0)]


def test_pipeline(spark, folder, odd, texts):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, folder)
        assert out.columns == docs.columns, name
        at = spark.createDataFrame(out.collect(), out.schema)
    kept = {r["doc_id"] for r in P.quality(spark, docs, folder).collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [i in kept for i, v in labels.items() if v == (1, 0)]
    assert np.mean(clean) > 0.9
    rows = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} <= kept
    for _, stage in P.STAGES:
        assert stage(spark, odd, folder).count() >= 0
