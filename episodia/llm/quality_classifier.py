"""Operator 4, quality classifier as a sparse rule ensemble.

Small boosted trees are grown on statistics of labelled texts; every path from
a root is a conjunctive rule. A lasso-penalised logistic regression over the
rules' truth values keeps a few of them, and the result is compiled into one
Spark column expression over the statistics (which Arrow workers count).

The trees and weights are fitted on a bounded sample of labelled rows
(about `MAX_ROWS` at most, by id hash); statistics cover whole texts of
all documents.

Defined results: a null or empty text has zero statistics and is scored like
any other; without labels of both kinds, or with too few for a rule, the score is
the labels' share (0.5 without any); a document with several labels counts with the lowest; a null id
trains nothing; repeated rows are scored alike; equal gains take the first
feature and cut; a score equal to the threshold predicts 1; a very long text is
counted as a whole, in a slice of its own; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_sample, held_out, table, written
from .textstats import classifier_counts

MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
LASSO, LASSO_ROUNDS = 1e-3, 400
THRESHOLD = 0.7

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_distinct_words", "n_chars", "n_upper", "n_lower", "n_digit", "n_punct"]
#: name -> numerator and denominator (or None)
FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "upper_share": ("n_upper", "n_chars"),
    "lower_share": ("n_lower", "n_chars"),
    "digit_share": ("n_digit", "n_chars"),
    "punct_per_word": ("n_punct", "n_words"),
}
#: A rule: conditions (feature, above, threshold), all of which must hold.
Rule = tuple[tuple[str, bool, float], ...]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole):
                got = classifier_counts(*tk.buffers(batch.column(1)))
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature_columns() -> list[Column]:
    return [(F.col(a) / F.greatest(F.col(b), F.lit(1)) if b else F.col(a)).cast("double").alias(name) for name, (a, b) in FEATURES.items()]


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, edges: list[np.ndarray], binned: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on the gradient: the rules of all its nodes but the root, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))
    names = list(FEATURES)

    def split(rows: np.ndarray, path: Rule, depth: int) -> None:
        if path:
            rules.append(path)
        best = None
        if depth < DEPTH and len(rows) >= 20:
            total_g, total_h = gradient[rows].sum(), weight[rows].sum()
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                g = np.cumsum(np.bincount(binned[rows, f], gradient[rows], len(cuts) + 1))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], weight[rows], len(cuts) + 1))[:-1]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                k = int(np.argmax(gain))
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k)
        if best is None:
            step[rows] = gradient[rows].sum() / (weight[rows].sum() + 1)
            return
        _, f, k = best
        low = binned[rows, f] <= k
        for side, above in ((rows[low], False), (rows[~low], True)):
            split(side, (*path, (names[f], above, float(edges[f][k]))), depth + 1)

    split(np.arange(len(x)), (), 0)
    return rules, step


def candidate_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct rules of TREES boosted trees."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, step = grow(x, y - p, p * (1 - p), edges, binned)
        rules |= {_shortest(r): None for r in found}
        margin += RATE * step
    return list(rules)


def _shortest(rule: Rule) -> Rule:
    """The rule without conditions that another one implies, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, cut in rule:
        key = (name, above)
        best[key] = cut if key not in best else (max if above else min)(best[key], cut)
    return tuple(sorted((n, a, c) for (n, a), c in best.items()))


def truth(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, above, cut in rule:
        column = x[:, list(FEATURES).index(name)]
        out &= column > cut if above else column <= cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights, by accelerated proximal gradient."""
    a = np.hstack([np.ones((len(z), 1)), z])
    step = 4 * len(a) / max(np.linalg.norm(a.T @ a, 2), 1e-9)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(LASSO_ROUNDS):
        u = v - step * (a.T @ (1 / (1 + np.exp(-(a @ v))) - y)) / len(a)
        new = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0)
        new[0] = u[0]
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return float(w[0]), w[1:]


class RuleEnsemble:
    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def column(self) -> Column:
        """The score as one expression over the feature columns."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in rule:
                holds = holds & (F.col(name) > cut if above else F.col(name) <= cut)
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit(stats: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """stats: statistics(); labels: (doc_id, quality) rows that may be learned from."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = bounded_sample(some, MAX_ROWS, "doc_id")
    rows = stats.join(some, "doc_id").select("doc_id", "quality", *feature_columns()).toPandas().sort_values(["doc_id", *FEATURES])
    x, y = rows[list(FEATURES)].to_numpy(dtype=np.float64), (rows["quality"].to_numpy() == 1).astype(np.float64)
    rules = candidate_rules(x, y) if len(y) and y.min() < y.max() else []
    if not rules:
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return RuleEnsemble(float(np.log(share / (1 - share))), [])
    intercept, weights = lasso_logistic(np.stack([truth(r, x) for r in rules], axis=1).astype(np.float64), y)
    return RuleEnsemble(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the features and the score of every document."""
    stats = written(statistics(docs), "text-statistics")
    model = fit(stats, labels)
    return stats.select("doc_id", *feature_columns()).withColumn("score", model.column())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    out = scored(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
