"""Personal data by weak supervision (operator 6).

Patterns propose candidate spans in every whole text: the strict kinds (email, ip, card,
phone) and looser forms of them, and secrets. Four labelers vote on a candidate or abstain:
the strict pattern's check, a gazetteer (issuers, calling codes, domains), the words before
it, and its edges. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is, and its posteriors train a logistic span classifier over kind,
votes and length. Spans of the strict patterns always stay; the classifier adds others.

DataFrame functions only. A match's place comes from the text split at the pattern: starts
are running sums of lengths, taken in chunks so that they are linear in the matches. What
the driver sees of the corpus is a count by vote pattern, of which there are at most
5 * 3 ^ 4 * 4. Texts aren't shuffled; only spans are written in between.

Defined results: null and empty texts have no spans; spans of one kind never overlap, those
of different kinds may; ties of start stand in the order of the kinds; repeated rows are
alike; a null doc_id is kept; an empty table gives an empty result; other columns are not
read. Patterns are possessive, so long digit or letter runs neither recurse nor backtrack.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query
from .text import staged, table

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: One pattern finds the candidates of a kind; a strict span is one that passes its check.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9_+/-]{16,}+",
}
#: Issuer prefixes of cards and first digits of calling codes with their usual lengths.
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65)"
CUES = {
    "email": r"(mail|contact|write|e-mail|reply)\W*\w{0,3}\W*$",
    "ip": r"(ip|host|server|address|client|addr)\W*$",
    "card": r"(card|visa|credit|debit|pay|account|carte|karte|tarjeta)\W*\w{0,4}\W*$",
    "phone": r"(tel|phone|call|fax|mobile|cell|dial)\W*\w{0,3}\W*$",
    "secret": r"$",
}
AGAINST = r"(version|build|isbn|order|serial|v|no|nr|#)\W*$"
#: Characters before a span that the context labeler reads.
BEFORE = 24
#: Spans whose probability is at least this are added.
SURE = 0.9
CHUNK = 512


def _running(lens: Column) -> Column:
    """Sums of all earlier entries, chunk by chunk."""
    zero, none = F.lit(0), F.array().cast("array<int>")

    def run(xs: Column, first: Column) -> Column:
        start = F.struct(none.alias("a"), first.cast("int").alias("s"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).cast("int").alias("s")))["a"]

    at = F.sequence(zero, F.greatest(F.ceil(F.size(lens) / CHUNK).cast("int") - 1, zero))
    chunks = F.transform(at, lambda c: F.slice(lens, c * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda x: F.aggregate(x, zero, lambda s, y: s + y))
    parts = F.zip_with(chunks, run(sums, zero), run)
    return F.flatten(parts)


def _luhn(digits: Column) -> Column:
    def value(x: Column, i: Column) -> Column:
        v = x.cast("int")
        return F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    each = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda s, x: s + x) % 10 == 0


def _strict(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.when(F.length(x) <= 3, x).cast("int") <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(False)


def _votes(kind: str, match: Column, before: Column, after: Column) -> list[Column]:
    """Votes of the four labelers: 1 personal, 2 not, 0 abstains."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    none = F.lit(0)
    pattern = none if kind == "secret" else F.when(_strict(kind, match), 1).otherwise(2)
    known = {
        "email": F.when(match.rlike(r"(?i)\.(com|org|net|edu|gov|io|info|[a-z]{2})$"), 1).otherwise(none),
        "ip": F.when(match.rlike(r"^(0|22[4-9]|2[3-9][0-9]|[3-9][0-9][0-9])\."), 2).otherwise(none),
        "card": F.when((n >= 13) & (n <= 19) & digits.rlike(ISSUERS), 1).when(digits.rlike("^(0|1|[78]|9)"), 2).otherwise(none),
        "phone": F.when(digits.rlike("^(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), 1).otherwise(2),
        "secret": F.when(match.rlike("[0-9]") & match.rlike("(?i)[=:].*[a-z]"), 1).otherwise(2),
    }[kind]
    cue = F.lower(before)
    context = F.when(cue.rlike(CUES[kind]) if kind != "secret" else F.lit(True), 1).when(cue.rlike(AGAINST), 2).otherwise(none)
    edge = F.when(before.rlike(r"[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]"), 2).otherwise(1)
    return [pattern, known, context, edge]


def _found(kind: str, text: Column) -> Column:
    """Candidates of one kind: array of (kind, start, end, strict, votes)."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(matches)
    steps = F.zip_with(F.slice(gaps, 1, n), matches, lambda g, m: (F.length(g) + F.length(m)).cast("int"))
    rows = F.arrays_zip(
        matches.alias("match"), F.slice(gaps, 1, n).alias("gap"), F.transform(F.slice(gaps, 2, n), lambda g: F.substring(g, 1, 1)).alias("after"), _running(steps).alias("at")
    )

    def span(x: Column) -> Column:
        start = x["at"] + F.length(x["gap"])
        size = F.length(x["match"])
        votes = _votes(kind, x["match"], F.right(x["gap"], F.lit(BEFORE)), x["after"])
        long_ = F.when(size < 12, 0).when(size < 20, 1).when(size < 32, 2).otherwise(3)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            start.cast("long").alias("start"),
            (start + size).cast("long").alias("end"),
            _strict(kind, x["match"]).alias("strict"),
            F.concat(F.lit(str(KINDS.index(kind))), *[v.cast("string") for v in votes], long_.cast("string")).alias("votes"),
        )

    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,strict:boolean,votes:string>>")
    some = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit("+")) if kind == "phone" else text.rlike("[0-9]")
    return F.when(some, F.when(n > 0, F.transform(rows, span)).otherwise(empty)).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``found`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.concat(*[_found(k, text) for k in KINDS]).alias("found"))


#: Labelers' votes (abstain, personal, not) believed before any data, with a weight in candidates.
PRIOR = {"yes": (0.25, 0.70, 0.05), "no": (0.40, 0.10, 0.50)}
PRIOR_SPANS = 10.0
ROUNDS = 50


def expectation_maximisation(votes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability that candidates with each row of votes are personal data."""
    k = votes.shape[1]
    start = (votes == 1).sum(axis=1) - (votes == 2).sum(axis=1)
    p = 1 / (1 + np.exp(-2.0 * start))
    for _ in range(ROUNDS):
        logs = []
        for q, name in ((p, "yes"), (1 - p, "no")):
            seen = np.array([[(count * q)[votes[:, j] == v].sum() for v in range(3)] for j in range(k)]) + PRIOR_SPANS * np.array(PRIOR[name])
            logs.append(np.log(seen / seen.sum(axis=1, keepdims=True))[np.arange(k), votes].sum(axis=1) + math.log((count * q).sum() + PRIOR_SPANS))
        now = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return p


def _design(patterns: list[str]) -> np.ndarray:
    """Features of the span classifier: kind, votes for and against, length."""
    x = np.array([[int(c) for c in p] for p in patterns], int).reshape(-1, 6)
    cols = [x[:, 0] == k for k in range(len(KINDS))]
    cols += [x[:, j] == v for j in range(1, 5) for v in (1, 2)]
    cols += [x[:, 5] == v for v in (1, 2, 3)]
    return np.stack(cols, axis=1).astype(float)


def fit(found: DataFrame) -> dict[str, float]:
    """Probability by vote pattern: EM posteriors train a logistic classifier (ridge, Newton steps)."""
    rows = sorted(found.select(F.explode("found.votes").alias("v")).groupBy("v").count().collect())
    if not rows:
        return {}
    patterns, count = [r["v"] for r in rows], np.array([r["count"] for r in rows], float)
    x = _design(patterns)
    votes = np.array([[int(c) for c in p[1:5]] for p in patterns], int)
    y = expectation_maximisation(votes, count)
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (count * (y - p)) - beta
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(patterns, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist(), strict=True))


def personal_data(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end, strict) sorted by start, then kind."""
    found = staged(candidates(docs))
    chance = fit(found)
    add = [p for p, v in chance.items() if v >= sure]
    keep = lambda s: s["strict"] | s["votes"].isin(*add) if add else s["strict"]
    spans = F.transform(F.filter("found", keep), lambda s: F.struct(s["start"], s["kind"], s["end"], s["strict"]))
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op6_personal_data")
def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["strict"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["strict"] & (s["kind"] == k))).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
