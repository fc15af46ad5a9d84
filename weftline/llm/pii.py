r"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are exact patterns with checks. Beyond them, candidates (long keys,
grouped numbers, account numbers) are voted on by labelers: the shape of the span (regular expression), the
word before it (gazetteer), the characters around it and the mix of its characters (context). Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each
pattern is a true span; a logistic classifier fitted to those probabilities, over votes and length, takes
the final decision. Patterns are counted on the cluster over all documents; the driver sees at most
3^5 * 4 counts. Only DataFrame functions are used.

The patterns are those of the contract with possessive repeats and a look-behind, which match the same
spans (a run of the first class either matches from its start or not at all) in time linear in the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scoped import let

#: Patterns of the base kinds, in the order of reports (fixed values).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap necessary conditions, so most texts are scanned once.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}
#: Candidates for further kinds: grouped numbers, and runs of 16 or more with a letter and a digit.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?:[0-9]{3}-[0-9]{2,3}-[0-9]{4}"
    r"|(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+)(?![A-Za-z0-9+/_-])"
)
GAZETTEER = ("account", "api", "apikey", "auth", "bearer", "iban", "id", "key", "passport", "password", "passwd", "pin", "pwd", "secret", "ssn", "tax", "tel", "token", "user")
_SPAN = "array<struct<kind:string,start:long,end:long>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, match, before, after); offsets in code points.

    The pieces between the matches give the offsets. Work is linear in the text and quadratic only in the
    number of matches of one text.
    """

    def place(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        step = F.transform(found, lambda m, k: F.struct(F.length(F.get(gaps, k)).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
        walk = F.aggregate(
            step, zero,
            lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["gap"])).alias("starts")),
            lambda a: a["starts"],
        )
        return let(
            walk,
            lambda starts: F.transform(
                found,
                lambda m, k: F.struct(
                    F.get(starts, k).alias("start"), (F.get(starts, k) + F.length(m)).alias("end"), m.alias("match"),
                    F.right(F.get(gaps, k), F.lit(24)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(8)).alias("after"),
                ),
            ),
        )

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found")), place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(ds: Column) -> Column:
        n = F.size(ds)
        value = F.transform(ds, lambda d, i: F.when((n - i) % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
        return F.aggregate(value, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0

    return let(F.regexp_extract_all(digits, F.lit("([0-9])"), F.lit(1)), total)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return ~m.rlike(r"(?:^|\.)0*+(?:[0-9]{4}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans (kind, start, end), by kind as listed, then start."""

    def of(kind: str) -> Column:
        kept = F.filter(spans_of(text, BASE[kind]), lambda s: _valid(kind, s["match"]))
        named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(text.rlike(NEEDS[kind]), named).otherwise(F.array().cast(_SPAN))

    return F.concat(*map(of, BASE))


def _votes(s: Column) -> list[Column]:
    """Votes of the labelers on a candidate: 1 for, 0 against, -1 silent."""
    m, word = s["match"], F.lower(F.regexp_extract(s["before"], r"([A-Za-z]+)[\s:='\"#_-]*$", 1))
    letters, digits = F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.length(_digits(m))
    return [
        # shape: hexadecimal or mixed keys, and numbers in groups
        F.when(m.rlike(r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$"), 1)
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), 1).otherwise(F.lit(-1)),
        # gazetteer: a word that names a secret or a number stands before
        F.when(word.isin(*GAZETTEER), 1).when(word != "", 0).otherwise(F.lit(-1)),
        # context: assigned or quoted
        F.when(s["before"].rlike(r"[:=]\s*['\"]?$") | s["before"].rlike(r"['\"]$") & s["after"].rlike(r"^['\"]"), 1).otherwise(F.lit(0)),
        # mix of characters
        F.when((digits * 5 >= F.length(m)) & (letters + digits >= F.length(m) * 0.8), 1).otherwise(F.lit(0)),
        # changes between letters and digits: rare in words with a number at the end
        F.when(F.regexp_count(m, F.lit("[A-Za-z][0-9]")) >= 3, 1).when(letters == 0, -1).otherwise(F.lit(0)),
    ]


LABELERS = 5


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans off the base spans: (start, end, kind, votes, size class 0..3)."""

    def judged(s: Column) -> Column:
        m = s["match"]
        size = F.when(F.length(m) >= 40, 3).when(F.length(m) >= 32, 2).when(F.length(m) >= 24, 1).otherwise(F.lit(0))
        kind = F.when(m.rlike("[A-Za-z]"), F.lit("secret")).otherwise(F.lit("number"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.array(*_votes(s)).alias("votes"), size.alias("size"))

    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = F.filter(spans_of(text, CANDIDATE), free)
    return F.transform(found, judged)


def em(counts: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """Share of true spans, (P(1 | true), P(1 | false)) of each labeler among its votes, P(true | pattern).

    Labelers are independent given the truth; silence says nothing. Starts from 0.7 and 0.2, so a true
    span is one that labelers tend to vote for. Sums go in the order of the patterns.
    """
    patterns = sorted(counts)
    share, rates = 0.5, [(0.7, 0.2)] * LABELERS
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share / (1 - share))
            for (t, f), v in zip(rates, p):
                odds += 0.0 if v < 0 else math.log(t / f) if v else math.log((1 - t) / (1 - f))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(counts.values())
        share = (sum(posterior[p] * counts[p] for p in patterns) + 1) / (total + 2)
        new = []
        for k in range(LABELERS):
            said = [p for p in patterns if p[k] >= 0]
            true = sum(posterior[p] * counts[p] for p in said)
            false = sum((1 - posterior[p]) * counts[p] for p in said)
            # prior counts keep the rates off 0 and 1 and each labeler better than chance
            t = (sum(posterior[p] * counts[p] for p in said if p[k]) + 7) / (true + 10)
            f = (sum((1 - posterior[p]) * counts[p] for p in said if p[k]) + 2) / (false + 10)
            new.append((max(t, f), min(t, f)))
        rates = new
    return share, rates, posterior


def logistic(rows: list[tuple[list[float], float, int]], steps: int = 200, ridge: float = 0.5) -> list[float]:
    """Weights of a logistic classifier on (features, probability, count), by gradient steps."""
    if not rows:
        return []
    n, total = len(rows[0][0]), sum(c for *_, c in rows)
    w = [0.0] * n
    for _ in range(steps):
        g = [ridge * x / total for x in w]
        for x, y, c in rows:
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - y
            for k in range(n):
                g[k] += e * x[k] * c / total
        w = [a - 1.5 * b for a, b in zip(w, g)]
    return w


def _design(votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *(float(v == 1) - float(v == 0) for v in votes), size / 3]


def fit(docs: DataFrame) -> list[float]:
    """Weights of the final classifier from the candidates of all texts (empty: none were found)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(text.alias("text")).filter(F.col("text").rlike(CANDIDATE))
    each = found.select(F.explode(let(base_spans(F.col("text")), lambda b: candidates(F.col("text"), b))).alias("c"))
    rows = each.groupBy("c.votes", "c.size").count().collect()  # at most 3^5 * 4 rows
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        counts[tuple(r["votes"])] = counts.get(tuple(r["votes"]), 0) + r["count"]
    _, _, posterior = em(counts) if counts else (0, [], {})
    ordered = sorted((tuple(r["votes"]), r["size"], r["count"]) for r in rows)
    return logistic([(_design(v, s), posterior[v], c) for v, s, c in ordered])


def all_spans(text: Column, weights: list[float]) -> Column:
    """Struct of base spans and of all spans (base first, then secret and number, each by start)."""

    def likely(c: Column) -> Column:
        score = F.lit(weights[0]) + c["size"] * F.lit(weights[-1] / 3)
        for k, w in enumerate(weights[1:-1]):
            v = F.get(c["votes"], F.lit(k))
            score = score + F.when(v == 1, F.lit(w)).when(v == 0, F.lit(-w)).otherwise(F.lit(0.0))
        return score > 0

    def add(base: Column) -> Column:
        if not weights:
            return F.struct(base.alias("base"), base.alias("spans"))
        bare = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        of = lambda found, kind: F.transform(F.filter(found, lambda c: c["kind"] == kind), bare)
        kept = let(F.filter(candidates(text, base), likely), lambda found: F.concat(of(found, "secret"), of(found, "number")))
        more = F.when(text.rlike(CANDIDATE), kept).otherwise(F.array().cast(_SPAN))
        return F.struct(base.alias("base"), F.concat(base, more).alias("spans"))

    return let(base_spans(text), add)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for every row of ``docs``.

    A null or empty text has no spans (digest of the empty string). Repeated rows get the same answer. An
    empty table gives an empty table.
    """
    weights = fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", all_spans(text, weights).alias("_s"))
    count = lambda kind: F.size(F.filter("_s.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(F.col("_s.base")), 256).alias("base_sha256"), _joined(F.col("_s.spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; all columns stay.

    Overlapping spans become one mark, that of the first. n_chars, if present, is set to the new length.
    A null text stays null.
    """
    weights = fit(docs)
    text = F.col("text")

    def rewrite(s: Column) -> Column:
        ordered = F.array_sort(F.transform(s["spans"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        part = lambda a, x: F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        walk = F.aggregate(
            ordered, zero,
            lambda a, x: F.struct(
                F.greatest(a["at"], x["end"]).alias("at"),
                F.when(x["start"] >= a["at"], F.concat(a["out"], part(a, x), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
            ),
            lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
        )
        return F.when(F.size(s["spans"]) == 0, text).otherwise(walk)

    out = docs.withColumn("text", let(all_spans(F.coalesce(text, F.lit("")), weights), rewrite))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
