"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its score comes from binned measures of the line itself and
of the lines before and after it, and from the label of its neighbour in the chain.
Forward-backward gives each line's probability of being good; the mean of these, weighted
by the lines' lengths, is the quality of the document.
"""

from __future__ import annotations

import math
import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, whole

#: Bounds of the training sample: labelled documents, and lines of each of them.
SAMPLE_DOCS, SAMPLE_LINES = 4_000, 40
KEEP_FROM = 0.7

#: Upper ends of the bins of each measure.
EDGES = {
    "length": (0.5, 20, 80, 300, 1200),
    "upper": (0.01, 0.05, 0.15, 0.4, 0.8),
    "digit": (0.001, 0.02, 0.1, 0.3, 0.6),
    "symbol": (0.001, 0.01, 0.05, 0.15, 0.4),
    "bang": (0.001, 0.05, 0.2, 0.5, 0.9),
    "punctuation": (0.01, 0.1, 0.3, 0.6, 1.2),
    "variety": (0.4, 0.7, 0.8, 0.9, 0.97),
    "repeat": (0.001, 0.02, 0.1, 0.3, 0.7),
    "word_length": (2, 3.5, 5, 7, 12),
    "short": (0.02, 0.1, 0.25, 0.4, 0.7),
    "again": (0.5, 1.5, 3.5, 7.5, 15.5),
}
BINS = 7  # six bins and one for no such line
WIDTH = len(EDGES) * BINS * 3 + 1
_OFFSETS = np.arange(len(EDGES)) * BINS

_OTHER, _LOW, _UP, _DIGIT, _SPACE, _PUNCT, _BANG, _SYMBOL = range(8)


def _classes() -> np.ndarray:
    out = np.full(129, _SYMBOL, dtype=np.int64)
    for i in range(128):
        c = chr(i)
        out[i] = (
            _LOW if c.islower() else _UP if c.isupper() else _DIGIT if c.isdigit()
            else _SPACE if c.isspace() or i < 32 else _BANG if c == "!" else _PUNCT if c in ".,;:?'\"()-" else _SYMBOL
        )
    out[128] = _OTHER
    return out


_CLASS = _classes()


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Binned measures per line (lines x measures) and the lines' lengths.

    A null or empty text is one empty line.
    """
    text = whole(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.cumsum(codes == 10)
    n = int(row[-1]) + 1 if len(row) else 1
    counts = np.bincount(row * 8 + _CLASS[np.minimum(codes, 128)], minlength=8 * n).reshape(n, 8)
    lengths = counts.sum(1)
    lengths[1:] -= 1  # the line break that counts as the first character of its line
    letters = np.maximum(counts[:, _OTHER] + counts[:, _LOW] + counts[:, _UP], 1)
    size = np.maximum(lengths, 1)
    own = np.zeros((n, 6))
    seen: dict[str, int] = {}
    for i, line in enumerate(text.split("\n")):
        words = line.split()
        if k := len(words):
            distinct = len(set(words))
            own[i, 0] = k
            own[i, 1] = np.log(distinct + 1) / np.log(k + 1)
            own[i, 2] = sum(map(operator.eq, words, words[1:])) / k
            own[i, 3] = sum(map(len, words)) / k
            own[i, 4] = sum(len(w) == 1 for w in words) / k
            own[i, 5] = seen[line] = seen.get(line, -1) + 1
    words = np.maximum(own[:, 0], 1)
    values = (
        lengths, counts[:, _UP] / letters, counts[:, _DIGIT] / size, counts[:, _SYMBOL] / size,
        counts[:, _BANG] / words, counts[:, _PUNCT] / words, own[:, 1], own[:, 2], own[:, 3], own[:, 4], own[:, 5],
    )
    binned = np.stack([np.searchsorted(e, v) for e, v in zip(EDGES.values(), values, strict=True)], axis=1)
    return binned.astype(np.int16), lengths.astype(np.int64)


def features(binned: np.ndarray) -> np.ndarray:
    """Indices of the active features of each line: its own bins, those of the line before
    and of the line after, and a constant."""
    none = np.full((1, binned.shape[1]), BINS - 1, dtype=binned.dtype)
    before, after = np.vstack([none, binned[:-1]]), np.vstack([binned[1:], none])
    block = len(EDGES) * BINS
    parts = [x + _OFFSETS + k * block for k, x in enumerate((binned, before, after))]
    return np.hstack([*parts, np.full((len(binned), 1), WIDTH - 1)])


@dataclass(frozen=True)
class Crf:
    """Weights: a line's score of being good is the sum over its features; ``pairs[a, b]``
    is added for label b after label a."""

    weights: np.ndarray
    pairs: np.ndarray


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(scores: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Probability of good for each line of one document."""
    n = len(scores)
    t = pairs.tolist()
    # Two states: plain floats are faster than arrays of two.
    s = scores.tolist()
    a0, a1 = 0.0, s[0]
    ahead = [a1 - a0]
    for i in range(1, n):
        a0, a1 = _add(a0 + t[0][0], a1 + t[1][0]), _add(a0 + t[0][1], a1 + t[1][1]) + s[i]
        ahead.append(a1 - a0)
    b0, b1 = 0.0, 0.0
    back = [0.0]
    for i in range(n - 1, 0, -1):
        b1 += s[i]
        b0, b1 = _add(t[0][0] + b0, t[0][1] + b1), _add(t[1][0] + b0, t[1][1] + b1)
        back.append(b1 - b0)
    odds = np.array(ahead) + np.array(back[::-1])
    return 1 / (1 + np.exp(np.clip(-odds, -700, 700)))


def document_score(text: str | None, model: Crf) -> float:
    """Length-weighted mean of the lines' marginals, from 0 to 1."""
    binned, lengths = measures(text)
    good = marginals(model.weights[features(binned)].sum(1), model.pairs)
    weight = np.maximum(lengths, 0) if lengths.sum() > 0 else np.ones(len(good))
    return float(min(1.0, max(0.0, np.dot(good, weight) / weight.sum())))


def fit(documents: list[tuple[list[list[int]], int]], steps: int = 250, rate: float = 0.15, penalty: float = 1e-4) -> Crf:
    """Fits by gradient ascent on the likelihood of the line labels, every line having its
    document's label. ``documents``: binned measures and label of each.

    Without documents all weights are zero and every score is 0.5.
    """
    weights, pairs = np.zeros(WIDTH), np.zeros((2, 2))
    chains = sorted((x for x in documents if len(x[0])), key=lambda x: -len(x[0]))
    if not chains:
        return Crf(weights, pairs)
    size = np.array([len(x[0]) for x in chains])
    label = np.array([x[1] for x in chains])
    steps_of = int(size[0])
    grid = np.zeros((len(chains), steps_of, len(EDGES) * 3 + 1), dtype=np.int32)
    mask = np.arange(steps_of)[None, :] < size[:, None]
    for i, (binned, _) in enumerate(chains):
        grid[i, : size[i]] = features(np.array(binned, dtype=np.int16))
    flat = grid[mask]
    gold = np.repeat(label, size)
    gold_pairs = np.zeros((2, 2))
    for y in (0, 1):
        gold_pairs[y, y] = (size[label == y] - 1).sum()
    lines = len(flat)
    moment = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    for step in range(1, steps + 1):
        scores = np.zeros(mask.shape)
        scores[mask] = weights[flat].sum(1)
        active = [int(mask[:, t].sum()) for t in range(steps_of)]
        ahead, back = np.zeros((*mask.shape, 2)), np.zeros((*mask.shape, 2))
        ahead[:, 0, 1] = scores[:, 0]
        for t in range(1, steps_of):
            k = active[t]
            for y in (0, 1):
                ahead[:k, t, y] = np.logaddexp(ahead[:k, t - 1, 0] + pairs[0, y], ahead[:k, t - 1, 1] + pairs[1, y]) + y * scores[:k, t]
        expected = np.zeros((2, 2))
        for t in range(steps_of - 2, -1, -1):
            k = active[t + 1]
            for y in (0, 1):
                back[:k, t, y] = np.logaddexp(pairs[y, 0] + back[:k, t + 1, 0], pairs[y, 1] + back[:k, t + 1, 1] + scores[:k, t + 1])
        total = np.logaddexp(ahead[:, 0, 0] + back[:, 0, 0], ahead[:, 0, 1] + back[:, 0, 1])
        for t in range(1, steps_of):
            k = active[t]
            for a in (0, 1):
                for b in (0, 1):
                    joint = ahead[:k, t - 1, a] + pairs[a, b] + b * scores[:k, t] + back[:k, t, b] - total[:k]
                    expected[a, b] += np.exp(joint).sum()
        good = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])[mask]
        slope = np.zeros(WIDTH)
        np.add.at(slope, flat.ravel(), np.repeat(gold - good, flat.shape[1]))
        slope = np.concatenate([slope / lines - penalty * weights, ((gold_pairs - expected) / lines - penalty * pairs).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope**2
        move = rate * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        weights, pairs = weights + move[:WIDTH], pairs + move[WIDTH:].reshape(2, 2)
    return Crf(weights, pairs)


def stretch(text: str | None) -> list[list[int]]:
    """Binned measures of at most ``SAMPLE_LINES`` lines in a row, from a place in the whole text
    that its checksum gives."""
    binned = measures(text)[0]
    start = zlib.crc32(whole(text).encode("utf-8", "surrogatepass")) % max(1, len(binned) - SAMPLE_LINES + 1)
    return binned[start : start + SAMPLE_LINES].tolist()


def _sample_lines(text: str) -> Column:
    @F.pandas_udf("array<array<smallint>>")
    def lines(texts: pd.Series) -> pd.Series:
        return pd.Series([stretch(t) for t in texts], dtype=object)

    return lines(text)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Crf:
    """Fits on at most ``sample_docs`` labelled documents that are not held out, those
    whose hashed ids are smallest, with a stretch of at most ``SAMPLE_LINES`` lines of each.

    Labels other than 0 and 1, null ids and labels without a document are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("label_of"), F.col("quality").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_of").isNotNull() & ~held_out(F.col("label_of")))
        .groupBy("label_of").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_of"), "label_of").limit(sample_docs)
    )
    # sample_docs bounds what is broadcast.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_of"))
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
        .select(F.col("doc_id"), F.col("label"), _sample_lines("text").alias("lines"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return fit([(r["lines"], int(r["label"])) for r in rows])


def score(text: Column, model: Crf) -> Column:
    """Quality of a text column from 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([document_score(t, model) for t in texts], dtype=float)

    return scored(text)


def score_documents(docs: DataFrame, model: Crf, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in column ``into`` (replaced if there).

    Null and empty texts score as one empty line; repeated rows stay repeated.
    """
    return docs.withColumn(into, score(F.col(text), model))
