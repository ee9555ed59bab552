"""Quality rules (operator 10): rules vote or abstain, EM weighs them, a posterior decides.

One pass of numpy over Arrow batches measures every whole text. Each rule then votes low
or good or abstains (SQL expressions over the measures). What the label model needs of the
corpus is how often each pattern of votes occurs: at most 3 ^ rules rows, whatever the
size of the corpus. Expectation-maximisation over these counts estimates each rule's votes
given a good document and given one with each rule's defect; a document is kept if the
base checks hold and the posterior probability that it is good is above one half.

Defined results: null and empty texts have no words and fail the base check; repeated rows
are measured alike; with an empty table the rules' prior reliabilities stand; all columns
of the input pass through (a column named ``_quality`` is dropped); long texts are one
numpy step each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query
from .text import SPACE, Words, mix, packed, pieces, powers, table, unpacked, windows, words

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the corpus' languages.
STOP = "the of and to in is that for it with as was on be by are this from or an de la le et les des en un une du que qui dans pour est el los las y del se por con su der die und den von zu mit ist das nicht ein eine auf".split()
INSULTS = "idiot moron stupid scum trash clown loser pathetic worthless disgusting".split()
#: Two insults and one in so many words vote low.
INSULT_EVERY = 1000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_stop", "n_insults", "n_marked", "n_stutter")


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _MARK = _lut(SYMBOLS), _lut(b"!?%#*$&")
_UPPER = _lut(bytes(range(65, 91)))
_LETTER = _lut(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 256)))


def _hashes(terms: list[str], ends: str = "") -> np.ndarray:
    forms = [f + e for t in terms for f in (t, t.capitalize(), t.upper()) for e in ("", *ends)]
    return np.unique(words(pa.array(forms), lower=False).hash)


_STOP_HASH, _INSULT_HASH = _hashes(STOP, ",."), _hashes(INSULTS, ",.;:!?")
_LINE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[at[1:]] - run[at[:-1]]


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per text, and those equal to an earlier line of the text."""
    n = len(w.at) - 1
    if len(w.hash) == 0:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(w.raw == 10) + 1
    start = np.union1d(breaks, w.offs[:-1])
    start = start[start < len(w.raw)]
    doc = np.searchsorted(w.offs, start, "right") - 1
    span = np.diff(np.append(start, len(w.raw)))
    place = np.arange(len(w.raw)) - np.repeat(start, span)
    values = _LINE_VALUES[w.raw] * powers(int(span.max()))[place]
    values[w.raw == 10] = 0
    h = mix(np.add.reduceat(values, start) ^ mix(doc.astype(np.uint64)))
    worded = np.diff(np.append(np.searchsorted(w.start, start), len(w.start))) > 0
    h, doc = h[worded], doc[worded]
    _, first = np.unique(h, return_index=True)
    total = np.bincount(doc, minlength=n)
    return total, total - np.bincount(doc[first], minlength=n)


def _repeated(w: Words) -> np.ndarray:
    """Words of each text that lie in a five-word window found twice or more in it."""
    g, at = windows(w, 5)
    if len(g) == 0:
        return np.zeros(len(w.at) - 1, np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = mix(g ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    first = w.at[doc[twice]] + (np.flatnonzero(twice) - at[doc[twice]])
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + 5, -1)
    return _per_text(np.cumsum(step[:-1]) > 0, w.at)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, by name."""
    w = words(texts, lower=False)
    space = SPACE[w.raw]
    n_lines, n_dup = _lines(w)
    size = w.end - w.start
    marked = (size >= 2) & _MARK[w.raw[w.end - 1]] & _MARK[w.raw[np.maximum(w.end - 2, 0)]] if len(w.hash) else np.zeros(0, bool)
    stutter = np.zeros(len(w.hash), bool)
    stutter[1:] = w.hash[1:] == w.hash[:-1]
    begins = w.at[:-1][w.count > 0]
    stutter[begins] = False
    return {
        "n_words": w.count,
        "word_chars": _per_text(((w.raw & 0xC0) != 0x80) & ~space, w.offs),
        "n_symbols": _per_text(_SYMBOL[w.raw], w.offs),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": _repeated(w),
        "n_upper": _per_text(_UPPER[w.raw], w.offs),
        "n_letters": _per_text(_LETTER[w.raw], w.offs),
        "n_stop": _per_text(_in(w.hash, _STOP_HASH), w.at),
        "n_insults": _per_text(_in(w.hash, _INSULT_HASH), w.at),
        "n_marked": _per_text(marked, w.at),
        "n_stutter": _per_text(stutter, w.at),
    }


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        m = measure(b.column("text"))
        struct = pa.StructArray.from_arrays([pa.array(m[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
        yield pa.RecordBatch.from_arrays([*b.columns, struct], [*b.schema.names, "_quality"])


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_quality`` of counts."""
    docs = docs.drop("_quality")
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(_measured, T.StructType([*docs.schema.fields, T.StructField("_quality", kind)]))


def _vote(low: Column, good: Column | None) -> Column:
    v = F.when(low, 1)
    return (v.when(good, 2) if good is not None else v).otherwise(0)


def _rules() -> dict[str, Column]:
    q = {c: F.col(f"_quality.{c}") for c in COUNTS}
    n, lines = q["n_words"], q["n_lines"]
    return {
        "length": _vote(n < 10, n >= 50),
        "symbols": _vote(q["n_symbols"] * 10 > n, q["n_symbols"] * 100 <= n),
        "word_size": _vote((q["word_chars"] * 2 < n * 5) | (q["word_chars"] > n * 12), (q["word_chars"] * 2 >= n * 7) & (q["word_chars"] * 2 <= n * 15)),
        "repeated_lines": _vote((q["n_dup_lines"] >= 3) & (q["n_dup_lines"] * 10 > lines * 3), q["n_dup_lines"] * 20 <= lines),
        "repeated_words": _vote(q["n_repeat_words"] * 100 > n * 20, q["n_repeat_words"] * 100 <= n * 5),
        "capitals": _vote(q["n_upper"] * 10 > q["n_letters"] * 4, q["n_upper"] * 100 <= q["n_letters"] * 12),
        "marked_words": _vote(q["n_marked"] * 10 > n, q["n_marked"] * 100 <= n),
        "stutter": _vote(q["n_stutter"] * 10 > n * 3, q["n_stutter"] * 20 <= n),
        "function_words": _vote(F.lit(False), q["n_stop"] * 20 >= n),
        "insults": _vote((q["n_insults"] >= 2) & (q["n_insults"] * INSULT_EVERY >= n), None),
    }


#: Votes (abstain, low, good) believed before any data: of a rule given a good document,
#: given a document with that rule's own defect, and given one with another defect. A
#: defect is what its rule sees, so "own" stays; the rates for good documents say how often
#: the rule is wrong.
PRIOR = {"good": (0.17, 0.01, 0.82), "own": (1e-6, 1 - 2e-6, 1e-6), "other": (0.20, 0.10, 0.70)}
PRIOR_DOCS = 2.0
#: Share of a rule's low votes that fall on good documents; believed as firmly as those votes
#: themselves. It is no rate in the corpus, so neither the rarity of a defect nor the number
#: of documents moves the verdict.
WRONG = 1e-3
GOOD_SHARE = 0.85
ROUNDS = 100


def expectation_maximisation(votes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares of the classes and their votes' log probabilities (class, rule, vote).

    Classes are "good" and one defect per rule, as a document rarely has all defects at
    once: what a rule that sees nothing says about another rule's defect is estimated too.
    Starts from "good unless a rule says low"; the priors keep unseen votes finite.
    """
    k = votes.shape[1]
    prior = np.empty((k + 1, k, 3))
    prior[0], prior[1:] = PRIOR["good"], PRIOR["other"]
    prior[np.arange(1, k + 1), np.arange(k)] = PRIOR["own"]
    shares0 = np.array([GOOD_SHARE, *[(1 - GOOD_SHARE) / k] * k])
    low = votes == 1
    p = np.hstack([~low.any(axis=1, keepdims=True), low / np.maximum(low.sum(axis=1, keepdims=True), 1)])
    share, vote = np.log(shares0), np.log(prior)
    for _ in range(ROUNDS if len(count) else 0):
        weight = p * count[:, None]
        seen = np.stack([weight.T @ (votes == v) for v in range(3)], axis=2)
        seen[0] += PRIOR_DOCS * prior[0]
        seen[0, :, 1] = (weight[:, 0] @ low + WRONG * (count @ low + PRIOR_DOCS)) / 2
        usual = seen[0] / seen[0].sum(axis=1, keepdims=True)
        # Of a rare defect too little is known to say that other rules vote unusually.
        seen[1:] += PRIOR_DOCS * usual
        seen[np.arange(1, k + 1), np.arange(k)] = PRIOR["own"]
        vote = np.log(seen / seen.sum(axis=2, keepdims=True))
        total = weight.sum(axis=0) + PRIOR_DOCS * shares0
        share = np.log(total / total.sum())
        now = posterior(votes, (share, vote))
        done = np.abs(now - p).max() < 1e-9
        p = now
        if done:
            break
    return share, vote


def posterior(votes: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability of each class given each row of votes."""
    share, vote = model
    logs = share + sum(vote[:, j][:, votes[:, j]].T for j in range(votes.shape[1]))
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pattern() -> Column:
    return F.concat(*[v.cast("string") for v in _rules().values()])


def fit(docs_measured: DataFrame) -> dict[str, float]:
    """Probability of a good document by pattern of votes, from EM over the counted patterns;
    at most 3 ^ rules rows reach the driver, whatever the number of documents."""
    rows = sorted(docs_measured.groupBy(_pattern().alias("p")).count().collect())
    votes = np.array([[int(x) for x in r["p"]] for r in rows], int).reshape(-1, len(_rules()))
    model = expectation_maximisation(votes, np.array([r["count"] for r in rows], float))
    return dict(zip([r["p"] for r in rows], posterior(votes, model)[:, 0].tolist())) if rows else {}


def judged(docs_measured: DataFrame, good: dict[str, float]) -> DataFrame:
    """Adds base_failed, quality (probability of a good document) and kept to ``_quality``.
    A pattern the model hasn't seen counts as good if no rule says low."""
    spark = docs_measured.sparkSession
    table_ = spark.createDataFrame(list(good.items()), "_pattern string, _good double")
    n = F.col("_quality.n_words")
    failed = (n < 10) | (F.col("_quality.n_repeat_words") * 100 > n * 20)
    out = docs_measured.withColumn("_pattern_of", _pattern()).join(F.broadcast(table_), F.col("_pattern_of") == F.col("_pattern"), "left")
    quality = F.coalesce("_good", F.when(F.col("_pattern_of").contains("1"), 0.0).otherwise(1.0))
    fields = [*[F.col(f"_quality.{c}").alias(c) for c in COUNTS], failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality > 0.5)).alias("kept")]
    return out.withColumn("_quality", F.struct(*fields)).drop("_pattern", "_good", "_pattern_of")


def assess(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct ``_quality``: counts, base_failed, quality, kept."""
    m = measured(packed(docs, "text"))
    out = judged(m, fit(measured(docs.select("text"))))
    return unpacked(out, [c for c in docs.columns if c != "_quality"], F.col("_quality"), text=F.col("text"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns as they were."""
    return assess(docs).filter("_quality.kept").drop("_quality")


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
    return q.select("doc_id", *[F.col(f"_quality.{c}").alias(c) for c in names])
