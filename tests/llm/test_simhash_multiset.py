import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import multiset_hash, queries, shingles, simhash
from weftline.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, limit=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [ids[find(i)] for i in range(len(ids))]


def test_golay_code_covers():
    home, words = simhash._golay()
    assert (home >= 0).all()
    assert np.bitwise_count(words[1:]).min() == 7
    assert np.bitwise_count(words[home] ^ np.arange(1 << 23)).max() == 3


def test_documents_against_brute_force(spark, folder, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash_near_dedup(spark, folder).collect()}
    fps = [plain_fingerprint(t) for _, t in texts]
    classes = plain_components([i for i, _ in texts], fps)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(texts, fps, classes)}


@pytest.mark.parametrize("slice_size", [4096, 7])
def test_links_find_every_pair(spark, monkeypatch, slice_size):
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(12):  # chains of up to 4 flipped bits, and a cloud about one centre
        x = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(8):
            fps.add(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
    fps |= {1 << b for b in range(64)} | {0}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    roots = dict(components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect())
    want = plain_components(sorted(fps), sorted(fps))
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, set()).add(f)
    for g in groups.values():
        assert {roots.get(f, f) for f in g} == {min(g)}


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2000, 1999)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1200), 1000), 1999: 1999, 2000: 1999}


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 5)} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 3, 7, 8, 9, 10} <= set(ids) and not {2, 5} & set(ids)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Ids that stay when every two texts of Jaccard similarity 0.8 or more are linked."""
    rows = sorted(rows)
    sets, name = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    holders = {}
    for i, s in enumerate(sets):
        for j in {j for x in s or {None} for j in holders.get(x, ())}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if n == old else n for n in name]
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    return {rows[n][0] for n in name}


def test_stage_keeps_one_of_near_copies(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(plain_kept([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0
    ids = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, odd, "").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 7, 8, 9, 10] and ids.count(None) == 1


@pytest.mark.parametrize("few, slice_size", [(32, 1024), (2, 5)])
def test_near_copies_of_a_large_group(docs_of, monkeypatch, few, slice_size):
    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "SLICE", slice_size)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(6):  # chains of texts that differ in one or two of 60 words, with similarities about 0.8
        words = [f"w{k}.{i}" for i in range(60)]
        for _ in range(40):
            for at in rng.choice(60, rng.integers(1, 3), replace=False):
                words[at] = f"n{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    kept = {r["doc_id"] for r in shingles.keep_first(docs_of(rows)).collect()}
    want = plain_kept(rows)
    assert kept == want and 6 < len(want) < 200


def test_fingerprints_are_homomorphic():
    h = multiset_hash.Hasher()
    a, b, c = "first line here\nsecond", "third one", "and a fourth\n"
    whole = h(f"{a}\n{b}\n{c}")
    assert (h(a) + h(b) + h(c)).hex() == whole.hex() == h(f"{c}\n{b}\n{a}").hex()
    assert (whole - h(b)).hex() == h(f"{a}\n{c}").hex()
    assert multiset_hash.Fingerprint.parse(whole.hex()).hex() == whole.hex()
    assert multiset_hash.likeness(whole, whole) == 1.0


def test_likeness_follows_the_share(texts):
    h = multiset_hash.Hasher()
    long = [t for _, t in texts if t and len(t) > 3000]
    halves = [multiset_hash.likeness(h(a), h(multiset_hash.edit(a, b))) for a, b in zip(long, long[1:])]
    others = [multiset_hash.likeness(h(a), h(b)) for a, b in zip(long, long[1:])]
    assert 0.35 < np.mean(halves) < 0.65
    assert np.mean(others) < 0.15


def test_edits_against_brute_force(spark, folder, texts):
    got = {r["doc_id"]: r for r in queries.op5_document_fingerprints(spark, folder).collect()}
    h = multiset_hash.Hasher()
    assert len(got) == len(texts)
    for (i, t), (_, nxt) in zip(texts, [*texts[1:], texts[0]]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (h(t).hex(), h(edited).hex())
        assert r["near_edited"] == multiset_hash.likeness(h(t), h(edited)) and r["near_next"] == multiset_hash.likeness(h(t), h(nxt))


def test_fingerprints_of_odd_rows(odd, empty, docs_of):
    rows = multiset_hash.fingerprints(odd).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 2, 3, 3, 5, 7, 8, 9, 10]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1
    one = multiset_hash.fingerprints(docs_of(["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert multiset_hash.fingerprints(empty).count() == 0


def test_ranges_meet_at_their_edges(docs_of):
    rows = [(3 * i, f"text number {i}") for i in range(500)]
    got = {r["doc_id"]: r["edited_sha256"] for r in multiset_hash.fingerprints(docs_of(rows).repartition(7)).collect()}
    for (i, t), (_, nxt) in zip(rows, [*rows[1:], rows[0]]):
        assert got[i] == hashlib.sha256(multiset_hash.edit(t, nxt).encode()).hexdigest()
