import hashlib
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from weftline.llm import bpe, conversations, lexical, queries
from weftline.llm.sql import CONVERSATIONS, LEXICAL

# ---------------------------------------------------------------- lexical search


@pytest.fixture
def items_of(spark):
    def make(rows):
        schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])
        return spark.createDataFrame([(i, t, "x") for i, t in rows], schema)

    return make


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, top=10):
    words = [plain_terms(t) for _, t in docs]
    n, total = sum(1 for w in words if w), sum(map(len, words))
    counts = [Counter(w) for w in words]
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), w, c in zip(docs, words, counts):
            score = 0
            for t in plain_terms(text):
                if c[t]:
                    m = 100 - 75 + (75 * len(w) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:top], 1)]
    return out


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def many_documents(n, seed=4):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(names, size=int(rng.integers(0, 30)), p=p / p.sum()))) for i in range(n)]
    return rows + [(n + i, "same words in w1 w2 every W2 copy") for i in range(60)] + [(3, "w50 w50"), (3, "w50 w50")]


def test_search_is_that_of_plain_sums(docs_of, items_of, monkeypatch):
    # small shards, ranges and blocks, so that every bound is crossed
    for name, value in (("POSTINGS", 700), ("SHARD", 90), ("RANGE", 16), ("BLOCK", 12)):
        monkeypatch.setattr(lexical, name, value)
    docs = many_documents(400)
    items = [(1, "w1 w2 w3"), (2, "w50, w59; w58 w1!"), (3, "W2 w2 copy every"), (4, "nothing here"), (5, ""), (6, None), (7, "w0 " * 9 + "w41"), (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w55"), (8, "w59")]
    got = found(lexical.search(docs_of(docs).repartition(3), items_of(items)))
    assert got == sorted(plain_search(docs, items), key=repr)


def test_search_of_odd_rows(spark, odd, empty, docs_of, items_of):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(None, "word three"), (1, "xyz ä 日本語のテキスト ÄÖÜ"), (2, "LONG enough one")]
    assert found(lexical.search(odd, items_of(items))) == sorted(plain_search(rows, items), key=repr)
    assert lexical.search(empty, items_of(items)).collect() == []
    assert lexical.search(odd, items_of([])).collect() == []
    assert lexical.search(docs_of([None, ""]), items_of(items)).collect() == []
    named = odd.withColumn("doc_id", odd["doc_id"].cast("string"))
    assert {r["doc_id"] for r in lexical.search(named, items_of([(1, "three")])).collect()} == {"3"}


def test_search_query_is_that_of_its_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.sql(LEXICAL).fetchall()
    assert found(queries.op11_lexical_search(spark, folder)) == sorted(want, key=repr)


def test_short_lists_are_summed_and_long_ones_probed():
    rng = np.random.default_rng(1)
    n, size = rng.integers(5, 50, 3000), 8
    term, tf = [], []
    for _ in range(3000):
        t = np.flatnonzero(rng.random(size) < [0.9, 0.8, 0.5, 0.2, 0.05, 0.03, 0.01, 0.0]).astype("<i4")
        term.append(t.tobytes())
        tf.append(rng.integers(1, 6, len(t)).astype("<i4").tobytes())
    shard = lexical.Shard(n, term, tf, size, 3000, int(n.sum()))
    query = lexical.Query(0, np.arange(size), np.array([50, 90, 700, 1600, 3000, 3500, 4600, 0]))
    scores = np.zeros(3000, np.int64)
    for x in shard.lists(query):
        scores[x.docs] += x.adds
    want = np.lexsort((np.arange(3000), -scores))[:10]
    docs, got = shard.best(query, 10, 1)
    assert docs.tolist() == want.tolist() and got.tolist() == scores[want].tolist()
    # a floor above every score opens nothing
    assert len(shard.best(query, 10, int(scores.max()) + 1)[0]) == 0


# ---------------------------------------------------------------- byte-pair encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


ODD_TEXTS = [
    "", "  ", "hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "<|endoftext", "</w> <w>", "aaaa" * 50, "ΑΣ ΣΑΣ. ΌΣΟΣ",
    "İstanbul ǅ ﬁ ß", "áé ẞ", "日本語 のテキスト 한국어 👩‍👩‍👧 x", "\x00\x01\x1c \x85 \xa0   z", "don't I'LL we'Ve 'S", "x" * 3000,
    "l'état Ⅳ ½ ²³ ٣", " a b　c",
]


def test_ids_and_texts_are_those_of_the_library(library):
    own, rng = bpe.encoder(queries.tokenizer_path()), random.Random(2)
    texts = [*ODD_TEXTS]
    texts += ["".join(rng.choice(["a", "e", "th", "in", "s", "'s", " ", "é", "1", "!!", "<|", "|>", "endoftext", "ß", "Ω", "\n", "zz"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FFF), rng.randint(0x20, 0x24F), rng.randint(0x1F000, 0x1FFFF), 0x41, 0x20])) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4")
        assert got.tolist() == want, text
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False), text


def test_merges_by_rank(tmp_path):
    """Backtracking against the merges applied one by one, on a small vocabulary full of overlaps."""
    import json

    letters = bpe.byte_letters()
    base = [t for c in letters for t in (c, c + "</w>")]
    merges = ["a a", "a b", "b a", "aa a</w>", "ab ab", "b b</w>", "ba ba", "aa b", "aab ab", "a a</w>", "abab a", "c ab"]
    vocab = {t: i for i, t in enumerate([*base, *(m.replace(" ", "") for m in merges)])}
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Sequence", "normalizers": []},
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [m.split() for m in merges]},
    }
    (tmp_path / "small.json").write_text(json.dumps(spec))
    own = bpe.Encoder(str(tmp_path / "small.json"))
    rank = {tuple(m.split()): i for i, m in enumerate(merges)}
    for n in range(1, 10):
        for word in map("".join, itertools.product("abc" if n < 7 else "ab", repeat=n)):
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            assert own.id_of[own.word(word + bpe.END)].tolist() == [vocab[p] for p in parts], word


def test_round_trip_of_odd_rows(spark, odd, empty, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH", 1000)
    path = queries.tokenizer_path()
    got = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {*odd.columns, "ids", "decoded"} - {"text"}
    texts = {r["n_chars"]: r["text"] for r in odd.collect()}
    for r in got:
        want = library.encode(texts[r["n_chars"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    both = bpe.encode(odd, path, decoded="decoded").select(list(got[0].asDict()))
    assert sorted(both.collect(), key=repr) == sorted(got, key=repr)
    assert bpe.decode(bpe.encode(empty, path), path).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [10**6, -1, 320])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(rows, path).orderBy("doc_id").collect()] == ["", "", library.decode([320])]


def test_digests_of_the_query(spark, folder, texts, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe_round_trip(spark, folder).collect()}
    for (doc, _), e in zip(texts, library.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))]
        assert got[doc] == (len(e.ids), *sha)


# ---------------------------------------------------------------- conversations

ROLES = ("system", "user", "assistant", "tool", "")
TEXTS = ("ok.", "ok.", "no end", "", " \n", "why?")


def cheapest(rows):
    """(cost, audit, repaired) over all edit sequences of at most two inserts in a row."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
    done = {(0, "", ""): []}  # (cost, audit, initials) -> repaired rows

    def inserted(part):
        out = dict(part)
        for _ in range(2):
            more = {}
            for (c, a, s), rep in out.items():
                for role in ("user", "assistant"):
                    more.setdefault((c + 5, a + "I", s + role[0]), [*rep, (role, "")])
            out = {**more, **out}
        return {k: v for k, v in out.items() if re.fullmatch("s?(ua)*u?", k[2])}

    for (role, text), fault in zip(rows, kinds):
        nxt = {}
        for (c, a, s), rep in inserted(done).items():
            nxt.setdefault((c + 2, a + "D", s), rep)
            if fault in ("blank", "duplicate"):
                continue
            late = 5 * (fault == "truncated")
            if role:
                nxt.setdefault((c + late, a + "K", s + role[0]), [*rep, (role, text)])
            for new in ("user", "assistant"):
                nxt.setdefault((c + 1 + late, a + "R", s + new[0]), [*rep, (new, text)])
        nxt = {k: v for k, v in nxt.items() if re.fullmatch("s?(ua)*u?", k[2])}
        best = {}
        for k, v in nxt.items():  # per end of the initials only the cheapest, then least, can win
            place = (k[2] in ("", "s") and k[2], k[2][-1:])
            if place not in best or k[:2] < best[place][0][:2]:
                best[place] = (k, v)
        done = dict(best.values())
    ends = {k: v for k, v in inserted(done).items() if re.fullmatch("(s?(ua)+)?", k[2])}
    key = min(ends)
    return key[0], key[1], ends[key], kinds


def conv_rows(n=250, seed=3):
    rng = random.Random(seed)
    return [(c, rng.choice([None, t, t, t + 3]), rng.choice(ROLES), rng.choice(TEXTS)) for c in range(n) for t in range(rng.randint(1, 7))]


@pytest.fixture
def talks_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, cost string")

    return make


def test_cheapest_repair(talks_of):
    rows = conv_rows()
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role, text))
    got = {r["conv_id"]: r for r in conversations.repair(conversations.as_rows(talks_of(rows)), texts=True).collect()}
    assert set(got) == set(by)
    for c, placed in by.items():
        placed.sort()
        cost, audit, repaired, kinds = cheapest([r[2:] for r in placed])
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, audit), placed
        assert [tuple(x) for x in r["repaired"]] == repaired
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repaired).encode()).hexdigest()
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        initials = [x[2][:1] for x in placed]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [x[1] for x in placed if x[0]]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def sql_rows(talks):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talks)
    rel = con.sql(CONVERSATIONS)
    return sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=repr)


def test_damage_and_repair_are_those_of_the_sql(talks_of):
    rows = [*conv_rows(300, 5), (None, 1, None, "a."), (None, None, "user", None), (None, 2, "assistant", "b"), (1000, -4, "user", "x."), (1000, -4, "user", "x.")]
    want = sql_rows(rows)
    got = conversations.repair(conversations.damaged(talks_of(rows)))
    assert sorted(({c: r[c] for c in want[0]} for r in got.collect()), key=repr) == want


def test_conversations_of_odd_rows(spark, talks_of):
    assert conversations.repair(conversations.damaged(talks_of([]))).collect() == []
    # dropped by the damage, so nothing is left of it
    gone = next(i for i in range(1000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    row = conversations.repair(conversations.damaged(talks_of([(gone, 0, "user", "hello.")]))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    named = spark.createDataFrame([("x", 0, "user", "a."), ("x", 1, "assistant", "b."), (None, 0, "user", "c.")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: r["audit"] for r in conversations.repair(conversations.as_rows(named)).collect()}
    assert got == {"x": "KK", None: "D"}
    line = "a "  # ends in a character that isn't one of the six blanks
    assert conversations.repair(conversations.as_rows(talks_of([(1, 0, "user", line)]))).first()["truncated"] == 1


def test_a_giant_conversation_is_spilled(talks_of, monkeypatch):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(ROLES[:4]), f"{t} " + rng.choice(TEXTS)) for t in range(20_000)]
    want = conversations.Conversation()
    whole = conversations.repair(conversations.as_rows(talks_of(rows))).first()
    monkeypatch.setattr(conversations, "HELD", 5000)
    for _, t, role, text in rows:
        fault = "" if text[-1] in ".?" else "truncated"
        want.add(t, role, text, fault)
    assert want.back.file is not None and want.lines.file is not None
    found = want.finish()
    assert all(whole[k] == v for k, v in found.items()) and whole["cost"] > 0
