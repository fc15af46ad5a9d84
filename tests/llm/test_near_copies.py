"""Near copies in large groups: pairs follow the number of sets, and components are those of brute force."""

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import components
from weftline.llm import near_copies as nc


def groups(n):
    """Texts that keep a random share of one base, so that similarities in the group lie on both sides of 0.8."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(150, rng.integers(0, 18), replace=False):
            words[at] = f"n{k}.{at}"
        rows.append((k, " ".join(words)))
    return rows


def components_of(sets):
    name = np.arange(len(sets))
    for i, s in enumerate(sets):
        for j in range(i):
            x = len(np.intersect1d(s, sets[j], assume_unique=True))
            if 9 * x >= 4 * (len(s) + len(sets[j])) and name[i] != name[j]:
                name[name == max(name[i], name[j])] = min(name[i], name[j])
    return name.tolist()


@pytest.mark.parametrize("tile", [1 << 20, 9000])
def test_pairs_of_a_large_group_follow_its_size(docs_of, monkeypatch, tile):
    monkeypatch.setattr(nc, "TILE", tile)
    rows = groups(400)
    docs, checked, plain = docs_of(rows), [], nc._checked
    monkeypatch.setattr(nc, "_checked", lambda d, s, pairs: checked.append(pairs.count()) or plain(d, s, pairs))
    got = [r["component_id"] for r in nc.near_copies(docs).orderBy("doc_id").collect()]
    assert got == components_of([nc.shingles(t) for _, t in rows]) and 1 < len(set(got)) < 350
    assert sum(checked) < 30 * len(rows)


def test_links_of_a_tile():
    sets = [nc.shingles(t) for _, t in groups(60)]
    root, node = np.arange(60) // 2, np.arange(60) + 100
    a, b = nc.tile_links(node, root, np.ones(60, bool), pa.array(sets, pa.list_(pa.int64())))
    name, want = root.copy(), root.copy()
    for i, j in zip(a - 100, b - 100):
        assert name[i] != name[j]  # a forest
        name[name == name[i]] = name[j]
    for i in range(60):
        for j in range(i):
            x = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 9 * x >= 4 * (len(sets[i]) + len(sets[j])):
                want[want == want[i]] = want[j]
    assert len(set(zip(name.tolist(), want.tolist()))) == len(set(name.tolist())) == len(set(want.tolist()))


def test_a_set_of_a_large_group_is_checked_once(docs_of, monkeypatch):
    """In place of each pair of each anchor's forest; the rest is compared whole."""
    monkeypatch.setattr(nc, "THIN", 0)  # every anchor is dense
    rows = groups(120)
    docs, checked, plain = docs_of(rows), [], nc._checked
    monkeypatch.setattr(nc, "_checked", lambda d, s, pairs: checked.append(pairs.count()) or plain(d, s, pairs))
    got = [r["component_id"] for r in nc.near_copies(docs).orderBy("doc_id").collect()]
    assert got == components_of([nc.shingles(t) for _, t in rows])
    assert sum(checked) < len(rows)


def test_components_of_a_small_table_take_few_tasks(spark, monkeypatch):
    links = spark.range(200).selectExpr("id AS a", "id + 1 + 50 * (id % 3) AS b")
    conf = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    parts, plain = [], components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda d: parts.append(plain(d)) or parts[-1])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["node"]: r["root"] for r in components.components(links).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    name = list(range(302))
    for i in range(200):
        a, b = name[i], name[i + 1 + 50 * (i % 3)]
        name = [min(a, b) if x in (a, b) else x for x in name]
    assert got == {i: name[i] for i in {*range(200), *(i + 1 + 50 * (i % 3) for i in range(200))}}
    assert all(d.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism for d in parts[1:])
