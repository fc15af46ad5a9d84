import hashlib
import re

import pytest
from check_queries import compare, open_duckdb
from pyspark.sql import functions as F

from weftline.llm import licenses, pii, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, folder, name):
    message, ok = compare(queries.QUERIES[name](spark, folder), open_duckdb(folder), queries.SQL[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_license_scan", "op7_pii"])
def test_plans_are_native(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan.replace("Scan ExistingRDD[", ""))


def plain_repeats(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in wins if wins.count(w) > 1}
    return len({i + k for i, w in enumerate(wins) if w in twice for k in range(5)})


def test_repeated_words(docs_of):
    texts = ["a b c d e f a b c d e g", "x " * 9, "a b c d", "", "a b c d e a b c d e a b c d e z", "p q r s t u v w"]
    rows = docs_of(texts).select("doc_id", quality_rules.repeated_words(quality_rules.word_list(F.col("text"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i: plain_repeats(t.split()) for i, t in enumerate(texts)}


def test_thresholds_follow_their_group(docs_of):
    plain = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(40)), "en", "a") for i in range(300)]
    marked = [(1000 + i, " ".join(f"#{(i * 7 + j * j) % 97}" for j in range(40)), "en", "b") for i in range(300)]
    stray = [(5000, marked[0][1], "en", "a"), (5001, plain[0][1], "en", "b")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs_of(plain + marked + stray)).collect()}
    assert all(v for k, v in kept.items() if k < 5000)
    assert not kept[5000] and not kept[5001]


def test_limits_come_from_the_data_alone(docs_of, spark):
    """No fixed width decides: one value gives fences of its bucket, and small groups lean on their language."""
    words = lambda i, n: " ".join(f"w{(i * 7 + j * j) % 90 + 10}" for j in range(n))
    rows = [(i, words(i, 40), "en", "a") for i in range(200)] + [(900, words(3, 40), "en", "tiny"), (901, " ".join(f"longer{(j * j) % 90 + 10}" for j in range(40)), "en", "tiny")]
    rows += [(902, words(5, 38) + " w10#", "en", "a"), (903, words(5, 36) + " w10# #11 #12", "en", "a")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs_of(rows)).collect()}
    assert all(kept[i] for i in range(200)) and kept[900] and not kept[901]
    assert kept[902] and not kept[903]  # one symbol refuses no text, three do where none is usual


def test_quantiles_are_drawn_smoothly(spark):
    """A group's limits move without a step as it grows; brute force over one metric."""
    def limits(n):
        cols = ("_lang", "_source", "n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_words")
        rows = [("e", "big", 0, 500, 0, 1, 100)] * 400 + [("e", "own", 0, 900, 0, 1, 100)] * n
        got = quality_rules.thresholds(spark.createDataFrame(rows, cols)).filter("_source = 'own'").first()
        return got["low_word_milli"], got["high_word_milli"]

    found = [limits(n) for n in (1, 40, 200)]
    assert found[0][1] < found[1][1] < found[2][1]
    # 5000 lies in the bucket 4864..5119, 9000 in 8704..9215: edges of the language and the corpus, then of the group
    for n, (low, high) in zip((1, 40, 200), found):
        share = n / (400 + n)
        at = lambda q, a, b: b if share > 1 - q else a
        drawn = lambda own, rest: (n * own + 50 * rest) // (n + 50)
        low10, mid, top = drawn(8704, at(0.1, 4864, 8704)), drawn(8704, at(0.5, 4864, 8704)), drawn(9215, at(0.9, 5119, 9215))
        assert (low, high) == (low10 - 3 * (drawn(9215, at(0.5, 5119, 9215)) - low10), top + 3 * (top - mid))


def test_quality_of_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(odd).collect()}
    assert not rows[5, 0]["kept"] and rows[5, 0]["base_failed"] and rows[7, 30_000]["n_repeat_words"] == 30_000
    assert quality_rules.judge(odd).count() == 10 and quality_rules.judge(empty).count() == 0


def test_license_spans(docs_of):
    rows = [
        "cc by CC-BY cc, by the all rights reserved GENERAL public license",
        "Licensed under the fine Apache License, Version 2.0",  # one word too many
        "permission is granted",
        "cc",
        "", None, "All rights\nreserved and all rights withheld",
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows)).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (13, 5, 0, 10)
    assert got[0]["base_labels"] == got[0]["labels"] == "cc-by,gpl,reserved" and got[0]["score"] == 1.0
    assert got[1]["labels"] == "apache-2.0" and got[1]["base_labels"] == "" and 0.7 < got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[2]["first_word"] is None
    assert [got[i]["n_words"] for i in (3, 4, 5)] == [1, 0, 0]
    assert (got[6]["n_base"], got[6]["first_word"]) == (1, 0)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
        ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
        ("Licensed under CC BY-NC-SA 3.0", "cc-by"),
        ("Licensed under the Apache License, Version 1.1", ""),
        ("In 2024 it was licensed under the Apache License, Version 2.0 3 times", "apache-2.0"),
        ("2024 under the Apache License, Version 2.0", "apache-2.0"),
        ("licensed under the apache license version", ""),
        ("This work is licensed under the GNU Affero General Public License, version 3", "agpl-3.0,gpl"),
        ("This work is licensed under the GNU Lesser General Public License, version 3", "gpl"),
        ("This work is licensed under the GNU General Public License version 3; also licensed under CC BY-ND 4.0", "cc-by,cc-by-nd-4.0,gpl,gpl-3.0"),
        ("permission is hereby granted free of any charge to any person obtaining a copy of the software and associated documentation files", "mit"),
        ("7", ""),
    ],
)
def test_verified_labels(docs_of, text, labels):
    (row,) = licenses.scan(docs_of([text])).collect()
    assert row["labels"] == labels


def test_licenses_of_odd_rows(odd, empty):
    assert sorted(r["doc_id"] or 0 for r in licenses.scan(odd).collect()) == [0, 1, 2, 3, 3, 5, 7, 8, 9, 10]
    assert licenses.scan(empty).count() == 0


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    """The contract's patterns and checks, as they are written there."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m[0])]


TRICKY = [
    "a@b.com_x@d.e a@b.c@d.e x@y @z.w .%+-@a-b.c-d. q@w.e.r.t..",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.4 999.1.1.1.1 1.2.3. 255.255.255.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 4111111111111111 - 5 0-0-0",
    "+1 (743) 555-3824 +12 3 +123456789012345678 ++49 30 1234567 +1--2 +1 (2) ",
    "é" * 40 + " mail ü@x.de Ω+49 170 1234567 日本 10.0.0.1",
    "1" * 40_000 + " " + "1 " * 3_000 + "a" * 40_000 + "@" + "b." * 2_000 + "c",
    None, "",
]


def test_base_spans_against_the_contract(spark, docs_of, texts):
    rows = [*TRICKY, *[t for _, t in texts]]
    got = {r["doc_id"]: r for r in pii.find(docs_of(rows)).collect()}
    for i, t in enumerate(rows):
        want = plain_base(t)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(k == x[0] for x in want) for k in pii.BASE], i
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
        assert got[i]["spans"].startswith(joined)


def test_labelers_find_keys_and_leave_words(docs_of):
    rows = [f'id token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end' for i in range(30)]
    rows += ["an uncommonlylongwordwithoutdigits and section12345678901234a", "plain words only", "call 555-123-4567 or ssn 123-45-6789"] * 10
    got = [r["spans"] for r in sorted(pii.find(docs_of(rows)).collect(), key=lambda r: r["doc_id"])]
    assert got[:30] == ["secret:12:52"] * 30
    assert got[30] == got[31] == ""


def test_em_separates_reliable_labelers():
    counts = {(1, 1, 1, 1, 1): 90, (0, 0, 0, 0, 0): 100, (-1, 0, 0, 1, 0): 30, (1, 1, 1, 0, 1): 20}
    _, rates, posterior = pii.em(counts)
    assert posterior[1, 1, 1, 1, 1] > 0.95 and posterior[0, 0, 0, 0, 0] < 0.05
    assert all(t >= f for t, f in rates)


def test_redaction(docs_of, odd, empty):
    out = {r["doc_id"]: r for r in pii.redact(docs_of(["Mail a.b@c.de or +49 30 1234567!", None, "clean é text"])).collect()}
    assert out[0]["text"] == "Mail [EMAIL] or [PHONE]!" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] is None and out[2]["text"] == "clean é text"
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == 10
    assert pii.find(odd).count() == 10 and pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
