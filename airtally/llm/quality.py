"""Quality of a text, learned from heuristics that disagree.

Eleven heuristics each call a text good, bad, or abstain. How often every pattern of votes occurs is
counted over all rows (there are 2^7 * 3^4 patterns at most); from these counts expectation-maximisation
estimates how often each heuristic is right when it votes, and so the probability that a text with a
given pattern is good. These probabilities are the labels from which a linear
scorer over hashed character shapes is trained, on a sample of the texts. The scorer decides on every row.

A text is read once: `measure` finds its votes and its features, and what follows works on these.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtally.llm.tables import saved

BUCKETS = 1 << 12
SAMPLE_ROWS = 8000
KEEP_FROM = 0.5

# The first seven look for a defect and vote bad or abstain, the others vote either way.
HEURISTICS = ("symbols", "marks", "capitals", "repeats", "doubled_marks", "bare_marks", "line_copies",
              "plain_words", "variety", "spread", "function_words")
ABSTAIN, BAD, GOOD = 0, 1, 2

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this have from or by an "
    "der die das und zu den ein eine von mit ist des im dem nicht auf für sich als auch er "
    "le la les de et un une du en que est pour dans qui sur au pas ne il avec "
    "el los las del y se por con para su al lo como más o es no ".encode().split())

_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-?!()")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_BLANK = b" \t\n\r\x0b\x0c"
_PLAIN = re.compile(rb"(?<![^ \t-\r])[('\"]?[A-Z\x80-\xff]?[a-z\x80-\xff'-]*[.,;:!?)'\"]?(?![^ \t-\r])")
_DOUBLED = re.compile(rb"[^\sA-Za-z0-9\x80-\xff()'\"]{2,}(?=\s|\Z)")


def _vote(bad: bool, good: bool = False) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(text: str | None) -> str:
    """One digit per heuristic, in the order of `HEURISTICS`; a text without words gets abstentions."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return "0" * len(HEURISTICS)
    n, size = len(words), len(raw.translate(None, _BLANK))
    pairs = max(1, n - 1)
    symbols = (len(raw) - len(raw.translate(None, _SYMBOLS))) / size
    marks = (len(raw) - len(raw.translate(None, _MARKS))) / size
    upper = len(raw) - len(raw.translate(None, _UPPER))
    capitals = upper / max(1, len(raw) - len(raw.translate(None, _UPPER + _LOWER)))
    repeats = sum(map(eq, words, words[1:])) / pairs
    doubled = len(_DOUBLED.findall(raw)) / n
    bare = sum(1 for w in words if not w.strip(_MARKS)) / n
    lines = [line for line in raw.split(b"\n") if line.strip()]
    copies = 1 - len(set(lines)) / max(1, len(lines))
    # A word that only repeats the one before is no evidence of prose.
    fresh = words[:1] + [b for a, b in zip(words, words[1:]) if a != b]
    plain = sum(1 for m in _PLAIN.finditer(b" ".join(fresh)) if m.end() > m.start()) / n
    variety = len(set(zip(words, words[1:]))) / pairs
    spread = len(set(words)) / min(n, 200)
    function = sum(map(FUNCTION_WORDS.__contains__, fresh)) / n
    enough = n >= 20
    found = (
        _vote(symbols >= 0.04),
        _vote(marks >= 0.15),
        _vote(upper >= 10 and capitals >= 0.5),
        _vote(enough and repeats >= 0.2),
        _vote(doubled >= 0.1),
        _vote(bare >= 0.15),
        _vote(len(lines) >= 5 and copies >= 0.6),
        _vote(plain <= 0.6, plain >= 0.9),
        _vote(enough and variety <= 0.4, enough and variety >= 0.7),
        _vote(enough and spread <= 0.25, enough and spread >= 0.4),
        _vote(enough and function <= 0.03, function >= 0.08),
    )
    return "".join(map(str, found))


class LabelModel:
    """How often each heuristic is right when it votes, and the share of good texts."""

    def __init__(self, patterns: dict[str, int], rounds: int = 100):
        self.share = 0.8
        self.accuracy = np.full(len(HEURISTICS), 0.8)
        names = sorted(patterns)
        counts = np.array([patterns[p] for p in names], dtype=float)
        seen = np.array([[int(v) for v in p] for p in names]).reshape(len(names), len(HEURISTICS))
        for _ in range(rounds):
            good = self._posterior(seen)
            before = self.share
            self.share = float(((counts * good).sum() + 8) / (counts.sum() + 10))
            right = np.where(seen == GOOD, good[:, None], np.where(seen == BAD, 1 - good[:, None], 0))
            voted = counts @ (seen != ABSTAIN)
            # As if each had been right in 8 of 10 cases before: no heuristic ends beyond doubt.
            self.accuracy = np.clip((counts @ right + 8) / (voted + 10), 0.55, 0.99)
            if abs(before - self.share) < 1e-9:
                break

    def _posterior(self, seen: np.ndarray) -> np.ndarray:
        return _posterior(seen, self.share, self.accuracy)

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability that a text with these votes is good."""
        return posterior(patterns, self.share, self.accuracy)


def _posterior(seen: np.ndarray, share: float, accuracy: np.ndarray) -> np.ndarray:
    weight = np.log(accuracy / (1 - accuracy))
    odds = np.log(share / (1 - share)) + ((seen == GOOD) * 1.0 - (seen == BAD)) @ weight
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def posterior(patterns: list[str], share: float, accuracy: np.ndarray) -> np.ndarray:
    """Probability that a text with these votes is good, under a model's numbers."""
    if not patterns:
        return np.zeros(0)
    return _posterior(np.array([[int(v) for v in p] for p in patterns]), share, accuracy)


_SHAPE = np.zeros(256, dtype=np.uint32)
_SHAPE[[*_BLANK]] = 1
_SHAPE[97:123] = 2
_SHAPE[128:256] = 2
_SHAPE[65:91] = 3
_SHAPE[48:58] = 4
_other = [b for b in range(33, 127) if _SHAPE[b] == 0]
_SHAPE[_other] = np.arange(5, 5 + len(_other))
_SCALE = np.uint32(2654435761)


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed shape trigrams and of repeated words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    sums = np.zeros(BUCKETS, dtype=np.float32)
    if not words:
        return sums
    shape = _SHAPE[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)]
    codes = (shape[:-2] << 12 | shape[1:-1] << 6 | shape[2:]) * _SCALE >> np.uint32(20)
    sums += np.bincount(codes, minlength=BUCKETS)
    sums /= len(codes)
    n = len(words)
    same = sum(map(eq, words, words[1:])) / n
    few = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
    for value, name in ((same, 1), (few if n >= 20 else 0.0, 2), (1.0, 3)):
        sums[(name * 40503) % BUCKETS] += value
    return np.sqrt(sums)


def sparse(text: str | None) -> bytes:
    """The features that are not 0: their places as 16-bit, then their values as 32-bit numbers. Empty for
    a text without words, 24 KB at most for any other."""
    if not text or text.isspace():
        return b""
    full = features(text)
    at = np.flatnonzero(full)
    return at.astype("<u2").tobytes() + full[at].astype("<f4").tobytes()


def _parts(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vector) // 6
    return np.frombuffer(vector, "<u2", n), np.frombuffer(vector, "<f4", n, 2 * n)


def train(inputs: np.ndarray, good: np.ndarray, rounds: int = 300, penalty: float = 1e-5,
          stands_for: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic scorer on probable labels, by gradient steps with per-weight rates. The
    classes are not balanced: a score of 0.5 is where the labels say that both are as probable.
    `stands_for` says how many texts each row stands for, one if not given."""
    weights = np.zeros(inputs.shape[1], dtype=np.float32)
    if not len(inputs):
        return weights
    each = np.ones(len(inputs)) if stands_for is None else stands_for
    each = each / each.sum()
    speed = np.zeros_like(weights)
    drift = np.zeros_like(weights)
    for step in range(1, rounds + 1):
        guess = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ ((guess - good) * each).astype(np.float32) + penalty * weights
        drift = 0.9 * drift + 0.1 * slope
        speed = 0.99 * speed + 0.01 * slope * slope
        weights = weights - 0.3 * (drift / (1 - 0.9 ** step)) / (
            np.sqrt(speed / (1 - 0.99 ** step)) + 1e-7)
    return weights.astype(np.float32)


def _score(vectors: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Probability that a text with these features is good; 0 for a text without words."""
    out = np.zeros(len(vectors))
    for i, vector in enumerate(vectors):
        if vector:
            at, values = _parts(vector)
            odds = float(values.astype(np.float64) @ weights[at])
            out[i] = 1 / (1 + np.exp(-min(30.0, max(-30.0, odds))))
    return out


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Probability that a text is good; 0 for a text without words."""
    return _score([sparse(text) for text in texts], weights)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """doc_id, hash of the text, its votes and its features, one row per row of `docs`. Save it before
    it is used more than once."""
    text = F.col(text_col).cast("string")
    source = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(seed), text).alias("hash"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([votes(t) for t in texts], pa.string()),
                 pa.array([sparse(t) for t in texts], pa.binary())],
                ["doc_id", "hash", "votes", "vector"])

    return source.mapInArrow(run, f"doc_id {kind}, hash long, votes string, vector binary")


def _sampled(measured: DataFrame, texts: dict[str, int], wanted: int) -> DataFrame:
    """About `wanted` distinct texts, and no more than 1.5 times as many, the same ones at each run: hash,
    votes, vector, stands_for.

    `texts` has the number of distinct texts of each pattern of votes. A pattern gives its part of the
    sample, but at least an even part of a quarter of it, so that rare patterns teach too; a text
    stands for as many as its pattern has for each one drawn.
    """
    total = sum(texts.values())
    parts = {p: min(1.0, max(wanted / total, wanted / (4 * len(texts) * n))) for p, n in texts.items() if n}
    draws = measured.sparkSession.createDataFrame(
        [(p, int(part * (1 << 30)), 1 / part) for p, part in sorted(parts.items())],
        "votes string, bound long, stands_for double")
    # There are 10,368 patterns at most.
    drawn = measured.filter(F.length("vector") > 0).join(F.broadcast(draws), "votes").filter(
        F.pmod("hash", F.lit(1 << 30)) < F.col("bound"))
    return drawn.groupBy("hash").agg(
        *(F.min(c).alias(c) for c in ("votes", "vector", "stands_for"))).orderBy("hash").limit(
            wanted + wanted // 2)


def fit_measured(measured: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all rows of `measure`, and the scorer's weights.

    The scorer is trained in one task on the features of at most 1.5 * `sample_rows` of the distinct
    texts, drawn by a hash of the text: 300 MB at most, however long the texts are.
    """
    # The sketch of the number of texts does not depend on the order of rows.
    found = measured.groupBy("votes").agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_count_distinct(F.when(F.length("vector") > 0, F.col("hash")), 0.02).alias("texts")).collect()
    model = LabelModel({r["votes"]: r["n"] for r in found if r["votes"].strip("0")})
    share, accuracy = model.share, model.accuracy

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("hash")
        inputs = np.zeros((len(group), BUCKETS), np.float32)
        for i, vector in enumerate(group["vector"]):
            at, values = _parts(vector)
            inputs[i, at] = values
        good = posterior(group["votes"].tolist(), share, accuracy)
        return pd.DataFrame({
            "weights": [train(inputs, good, stands_for=group["stands_for"].to_numpy()).tobytes()]})

    sample = _sampled(measured, {r["votes"]: r["texts"] for r in found if r["texts"]}, sample_rows)
    row = sample.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "weights binary").first()
    weights = np.frombuffer(row["weights"], dtype=np.float32) if row else np.zeros(BUCKETS, np.float32)
    return model, weights


def fit(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
        seed: int = 11) -> tuple[LabelModel, np.ndarray]:
    """The label model over all rows, and the scorer's weights; see `fit_measured`."""
    measured = measure(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), seed=seed)
    return fit_measured(saved(measured, "quality"), sample_rows)


def judge(measured: DataFrame, model: LabelModel, weights: np.ndarray, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, votes, posterior, score, kept, one row per row of `measure`."""
    shared = measured.sparkSession.sparkContext.broadcast((model.share, model.accuracy, weights))
    kind = measured.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, accuracy, scorer = shared.value
        for batch in batches:
            good = posterior(batch.column(1).to_pylist(), share, accuracy)
            found = _score(batch.column(2).to_pylist(), scorer)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(good), pa.array(found), pa.array(found >= keep_from)],
                ["doc_id", "votes", "posterior", "score", "kept"])

    return measured.select("doc_id", "votes", "vector").mapInArrow(
        run, f"doc_id {kind}, votes string, posterior double, score double, kept boolean")


def assess(docs: DataFrame, model: LabelModel, weights: np.ndarray, id_col: str = "doc_id",
           text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, votes, posterior, score, kept, one row per row of `docs`.

    Missing, empty and blank texts have only abstentions, score 0, and are not kept. Repeated rows get
    equal results, an empty table gives none; only the id and the text are looked at.
    """
    return judge(measure(docs, id_col, text_col), model, weights, keep_from)


def accepted(docs: DataFrame, weights: np.ndarray, text_col: str = "text",
             keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of `docs` that the scorer keeps, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array(found >= keep_from))

    return docs.mapInArrow(run, docs.schema)
