"""Toxicity as severity grades by cumulative-link ordinal regression.

``P(grade > k) = sigmoid(x . w - threshold[k])``: all thresholds share the weights ``w`` of
sparse text features, here words and word beginnings a document contains.

Labels say toxic or not. How severe a toxic document is, is judged by documents that it is not one of:
labelled documents are in two folds, each gives its tokens their log odds, and a toxic document gets the sum
of the odds that the *other* fold gives its tokens. Thirds of these sums are the grades 1 to 3.

Tokens are counted by label in Spark; the driver sees the telling ones and which of them
each document of the sample has.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, staged, whole

#: Bounds of the fit, arguments of ``train``: labelled documents read, features kept.
SAMPLE_DOCS, MAX_FEATURES = 4_000, 2_000
#: Least likelihood ratio of a feature: chance gives it to one token in a hundred thousand.
LEAST_RATIO = 20.0
GRADES = 4
PREFIXES = (4, 5, 6)
FOLDS = 2

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Letter runs in lower case."""
    return _WORDS.findall(whole(text).lower())


def tokens(found: Iterable[str]) -> set[str]:
    """Words and their beginnings (marked by a star)."""
    out = set(found)
    return out | {word[:k] + "*" for k in PREFIXES for word in out if len(word) > k}


@dataclass(frozen=True)
class Ordinal:
    """Weights by token and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def above(self, text: str | None) -> np.ndarray:
        """Probability of a grade above 0, above 1, ..."""
        weights = self.weights
        total = sum(sorted(weights[t] for t in tokens(words(text)) if t in weights))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - total, -500, 500)))

    def severity(self, text: str | None) -> float:
        """Expected grade."""
        return float(self.above(text).sum())


def slope(weights: np.ndarray, gaps: np.ndarray, where: np.ndarray, what: np.ndarray, grade: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the penalty, and its gradient by weights, then gaps. Row
    ``where[i]`` has feature ``what[i]``. The first gap is the first threshold, each further
    one the logarithm of the step to the next, so thresholds stay in order."""
    n = len(grade)
    rise = np.exp(gaps[1:])
    cuts = np.concatenate([gaps[:1], gaps[0] + np.cumsum(rise)])
    total = np.bincount(where, weights[what], minlength=n)
    above = 1 / (1 + np.exp(np.clip(cuts[None, :] - total[:, None], -500, 500)))
    upper = np.hstack([np.ones((n, 1)), above])
    lower = np.hstack([above, np.zeros((n, 1))])
    k = np.arange(n)
    p = np.maximum(upper[k, grade] - lower[k, grade], 1e-12)
    dense = above * (1 - above)
    edge = np.hstack([np.zeros((n, 1)), dense, np.zeros((n, 1))])
    at_total = (edge[k, grade] - edge[k, grade + 1]) / p
    at_cut = np.stack([((grade == j).astype(float) - (grade == j + 1)) * dense[:, j] / p for j in range(len(cuts))], axis=1).sum(0)
    by_gap = [at_cut.sum(), *(rise[j] * at_cut[j + 1 :].sum() for j in range(len(rise)))]
    value = np.log(p).mean() - penalty / 2 * (weights**2).sum()
    return float(value), np.concatenate([np.bincount(what, at_total[where], minlength=len(weights)) / n - penalty * weights, np.array(by_gap) / n])


def fit(rows: list[tuple[set[str], int]], vocabulary: list[str], steps: int = 600, rate: float = 0.1, penalty: float = 1e-5) -> Ordinal:
    """Fits on the tokens of documents with their grades 0 to 3. Without a feature, or without clean
    documents, nothing is toxic."""
    if not vocabulary or all(grade for _, grade in rows):
        return Ordinal({}, (20.0,) * (GRADES - 1))
    index = {t: i for i, t in enumerate(vocabulary)}
    pairs = [(i, index[t]) for i, (own, _) in enumerate(rows) for t in sorted(own) if t in index]
    where, what = (np.array([p[j] for p in pairs], dtype=int) for j in range(2))
    grade = np.array([g for _, g in rows], dtype=int)
    weights, gaps = np.zeros(len(vocabulary)), np.array([1.0] + [0.0] * (GRADES - 2))
    moment = [np.zeros(len(vocabulary) + len(gaps)), np.zeros(len(vocabulary) + len(gaps))]
    for step in range(1, steps + 1):
        _, uphill = slope(weights, gaps, where, what, grade, penalty)
        moment[0] = 0.9 * moment[0] + 0.1 * uphill
        moment[1] = 0.99 * moment[1] + 0.01 * uphill**2
        move = rate * moment[0] / (1 - 0.9**step) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        weights, gaps = weights + move[: len(weights)], gaps + move[len(weights) :]
    cuts = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
    return Ordinal({t: float(w) for t, w in zip(vocabulary, weights, strict=True) if abs(w) > 1e-4}, tuple(map(float, cuts)))


def grades_of(scores: list[float]) -> list[int]:
    """Grades 1 to 3 of toxic documents: the third of the scores that theirs is in, equal ones in
    the lower."""
    cuts = np.quantile(scores, [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if scores else []
    return [1 + int(g) for g in np.searchsorted(cuts, scores, side="left")]


def telling(counts: DataFrame, toxic: int, clean: int, most: int) -> DataFrame:
    """(token, odds) of the ``most`` tokens that toxic documents have more often, by a likelihood
    ratio that chance does not reach; ties by the token. ``counts`` has the documents of either
    kind with a token, ``inside`` and ``outside``; ``toxic`` and ``clean`` are all of them."""
    n, m, rows = F.col("inside"), F.col("outside"), toxic + clean
    ratio = n * F.log(n * rows / ((n + m) * F.lit(max(toxic, 1)))) + F.when(m > 0, m * F.log(m * rows / ((n + m) * F.lit(max(clean, 1))))).otherwise(0.0)
    odds = F.log((n + 0.5) / (toxic + 1.0)) - F.log((m + 0.5) / (clean + 1.0))
    kept = counts.where((n > 0) & (n * clean > m * toxic)).select("token", odds.alias("odds"), ratio.alias("ratio")).where(F.col("ratio") * 2 >= LEAST_RATIO)
    return kept.orderBy(F.desc("ratio"), "token").limit(most).select("token", "odds")


def _tokens_of(text: str) -> Column:
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(tokens(words(t))) for t in texts], dtype=object)

    return found(text)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, max_features: int = MAX_FEATURES) -> Ordinal:
    """Fits on at most ``sample_docs`` labelled documents that are not held out, those with
    the smallest hashed ids, and the ``max_features`` most telling tokens of their whole texts.
    Null or other labels and labels without text are left out; of repeated ids the higher label and the smaller
    text count. Empty tables give a model by which nothing is toxic."""
    chosen = (
        labels.select(F.col("doc_id").alias("label_of"), F.col("toxic").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("label_of").isNotNull() & ~held_out(F.col("label_of")))
        .groupBy("label_of").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_of"), "label_of").limit(sample_docs)
    )
    sampled = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_of"))
        .groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    sampled = staged(sampled.select("doc_id", (F.col("label") == 1).alias("toxic"), fold.alias("fold"), _tokens_of("text").alias("tokens")), "sample")
    listed = sampled.select("doc_id", "toxic", "fold", F.explode("tokens").alias("token"))
    inside, outside = F.col("toxic"), ~F.col("toxic")
    counts = staged(
        listed.groupBy("token").agg(
            *[F.count_if(side & (F.col("fold") == f)).alias(f"{name}{f}") for f in range(FOLDS) for name, side in (("in", inside), ("out", outside))]
        ),
        "counts",
    )
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in sampled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def told_by(folds: list[int]) -> dict[str, float]:
        parts = counts.select(
            "token", *[sum((F.col(f"{side}{f}") for f in folds), F.lit(0)).alias(name) for side, name in (("in", "inside"), ("out", "outside"))]
        )
        size = {t: sum(sizes.get((f, t), 0) for f in folds) for t in (True, False)}
        return {r["token"]: r["odds"] for r in telling(parts, size[True], size[False], max_features).collect()}

    vocabulary = told_by(list(range(FOLDS)))
    others = [told_by([f for f in range(FOLDS) if f != own]) for own in range(FOLDS)]
    wanted = sorted({*vocabulary, *(t for o in others for t in o)})
    if not wanted:
        return fit([], [])
    known = F.array(*map(F.lit, wanted))
    rows = sampled.select("doc_id", "toxic", "fold", F.array_intersect("tokens", known).alias("found")).orderBy("doc_id").collect()
    scores = [sum(others[r["fold"]].get(t, 0.0) for t in sorted(r["found"])) for r in rows if r["toxic"]]
    grades = iter(grades_of(scores))
    return fit([(set(r["found"]), next(grades) if r["toxic"] else 0) for r in rows], list(vocabulary))


def severity(text: Column, model: Ordinal) -> Column:
    """Struct of expected severity and the probability of any toxicity."""

    @F.pandas_udf("severity double, toxic_probability double")
    def graded(texts: pd.Series) -> pd.DataFrame:
        above = [model.above(t) for t in texts]
        return pd.DataFrame({"severity": [float(a.sum()) for a in above], "toxic_probability": [float(a[0]) for a in above]})

    return graded(text)


def grade_documents(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity (0 to 3), toxic_probability, grade (most telling whole number) and
    toxic (probability of at least 0.5) of every row; null and empty texts have no words, a
    null key stays null, repeated rows are graded each, an empty table gives an empty one."""
    graded = docs.select(F.col(key).alias("doc_id"), severity(F.col(text), model).alias("graded"))
    return graded.select(
        "doc_id", "graded.severity", "graded.toxic_probability",
        F.round("graded.severity").cast("int").alias("grade"), (F.col("graded.toxic_probability") >= 0.5).alias("toxic"),
    )
