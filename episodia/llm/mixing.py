"""Operator 2, mixing sources to target weights by soft membership.

A multinomial classifier learned from the labels table gives every document a
posterior over domains (the label combinations). Document rates r >= 0 are then
fitted by projected-gradient least squares: with n_d the tokens of document d and
p_dk its posterior, the expected domain totals sum_d n_d r_d p_dk shall match the
target totals T_k, with a small pull of every rate towards 1 that makes the
answer unique. In units of the corpus's tokens, with g the error of the totals,
a document's gradient is p.g + RIDGE (r - 1), so at the answer
r = max(0, 1 - p.g / RIDGE): g, as many numbers as there are domains, says all.

Projected-gradient steps run on a histogram of the posteriors (at most MAX_CELLS
cells, each with its tokens and mean posterior, however large the corpus). From
the g that they reach, exact passes over all documents add up the totals and the
Gram matrix of the documents with a positive rate in Spark columns, and correct g
by that Gram matrix until the error of the projected gradient's fixed point is
below TOLERANCE; otherwise the fit raises. A rate needs the document's own
posterior and g alone, so the last pass over the texts computes it in place and
no text is shuffled; the posteriors are, to be few files.

Defined results: a null or empty text has no tokens and the prior as posterior;
without usable labels there is one domain and every rate is 1; repeated rows
and null ids have equal rates for equal texts; a very long text is classified as
a whole, in a slice of its own; a doc_id with several labels has the first by
name; an empty table gives none; other columns are ignored by `rates` and kept
by `mixed`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded_sample, discard_tables, few_files, table, written

N_BUCKETS = 1 << 14
#: The classifier learns from about so many labelled rows at most (by id hash).
MAX_LABELLED = 20_000
#: Wanted shares of domains in the corpus's tokens. The others keep what they have, or less where that is more than these leave.
TARGETS = {"quality1-toxic0": 0.93, "quality1-toxic1": 0.06}
RIDGE, TOLERANCE = 1e-5, 1e-9
MAX_CELLS = 50_000
#: Projected-gradient steps on the histogram, and exact passes after which the fit raises.
STEPS, PASSES = 2_000, 60


def word_buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each word, and the word offsets of the texts."""
    data = tk.LOWER[data]
    starts, ends, first = tk.words(data, at, tk.SPACE_WORDS)
    return (tk.byte_hash(tk.byte_sums(data), starts, ends) >> np.uint64(50)).astype(np.int64), first


class Classifier:
    """Domain posteriors from mean log-likelihood ratios of words, sharpened by a fitted factor."""

    def __init__(self, names: list[str], prior: np.ndarray, weights: np.ndarray, sharpness: float = 8.0):
        self.names, self.prior, self.weights, self.sharpness = names, prior, weights, sharpness

    def means(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets, first = word_buckets(data, at)
        n = np.diff(first)
        return np.stack([tk.per_text(w[buckets], first) for w in self.weights], axis=1) / np.maximum(n, 1)[:, None], n

    def posteriors(self, means: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        logits = np.log(self.prior) + means * (self.sharpness if sharpness is None else sharpness)
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Word counts by domain over a bounded set of labelled rows, then the sharpness that fits their labels best."""
    named = F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("-toxic"), F.coalesce("toxic", F.lit(0)).cast("string"))
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(named).alias("domain"))
    rows = bounded_sample(some, MAX_LABELLED, "doc_id").collect()
    names = sorted({r["domain"] for r in rows})
    if not names:
        return Classifier(["all"], np.ones(1), np.zeros((1, N_BUCKETS)))
    rows.sort(key=lambda r: r["doc_id"])
    ids, domains = np.array([r["doc_id"] for r in rows]), np.array([names.index(r["domain"]) for r in rows])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            keys = whole.column(0).cast(pa.int64()).fill_null(-1).to_numpy()
            slot = np.minimum(np.searchsorted(ids, keys), len(ids) - 1)
            mine = (ids[slot] == keys) & np.asarray(whole.column(0).is_valid())
            for batch in tk.slices(whole.filter(pa.array(mine)).append_column("domain", pa.array(domains[slot[mine]]))):
                yield *tk.buffers(batch.column(1)), batch.column(2).to_numpy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(names) * N_BUCKETS, dtype=np.int64)
        for data, at, domain in labelled(batches):
            buckets, first = word_buckets(data, at)
            seen += np.bincount(buckets + np.repeat(domain, np.diff(first)) * N_BUCKETS, minlength=len(seen))
        cells = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(seen[cells])], names=["cell", "n"])

    texts = docs.select("doc_id", "text")
    sums = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(names) * N_BUCKETS)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(names), N_BUCKETS)
    shares = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    model = Classifier(names, (np.bincount(domains, minlength=len(names)) + 1.0) / (len(ids) + len(names)), np.log(shares / shares.mean(axis=0)))
    tried = np.array([1.0, 2, 4, 8, 16, 32, 64, 128])

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tried))
        for data, at, domain in labelled(batches):
            means, _ = model.means(data, at)
            total += [-np.log(np.maximum(model.posteriors(means, s)[np.arange(len(domain)), domain], 1e-12)).sum() for s in tried]
        yield pa.record_batch([pa.array(np.arange(len(tried)), pa.int32()), pa.array(total)], names=["cell", "n"])

    got = texts.mapInArrow(loss, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().set_index("cell")["n"]
    model.sharpness = float(tried[int(np.argmin(got.reindex(range(len(tried))).fillna(0).to_numpy()))])
    return model


def rates_at(posteriors: np.ndarray, g: np.ndarray, ridge: float) -> np.ndarray:
    """The rates that belong to the error g of the totals."""
    return np.maximum(1 - posteriors @ g / ridge, 0)


def target_totals(names: list[str], totals: np.ndarray, targets: dict[str, float] | None = None) -> np.ndarray:
    """Wanted tokens by domain; their sum is the corpus's."""
    wanted = {k: v for k, v in (TARGETS if targets is None else targets).items() if k in names}
    rest = [k for k, n in enumerate(names) if n not in wanted]
    share = np.array([wanted.get(n, 0.0) for n in names])
    have = totals[rest].sum()
    if rest and have > 0:
        share[rest] = min(max(0.0, 1 - share.sum()), have / totals.sum()) * totals[rest] / have
    return (share / share.sum() if share.sum() else np.ones(len(names)) / len(names)) * totals.sum()


def histogram(posteriors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and mean posterior of each cell of a grid over the simplex with at most MAX_CELLS cells."""
    grid = 64
    while grid > 1 and (k + 1) * comb(grid + 2 * k - 1, k - 1) > MAX_CELLS:  # rounded parts add up to one of k + 1 sums
        grid -= 1
    parts = [F.col("posterior")[i] for i in range(k)]
    cell = F.array(*(F.round(x * grid).cast("int") for x in parts))
    rows = posteriors.groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * x).alias(f"s{i}") for i, x in enumerate(parts))).where("n > 0").collect()
    n = np.array([r["n"] for r in rows], dtype=float)
    return n, np.array([[r[f"s{i}"] for i in range(k)] for r in rows], dtype=float).reshape(-1, k) / n[:, None]


def projected_gradient(n: np.ndarray, p: np.ndarray, wanted: np.ndarray, ridge: float) -> np.ndarray:
    """The error g of the totals after STEPS accelerated projected-gradient steps from rates of 1 (with restarts)."""
    size = n.sum()
    step = 1 / (np.linalg.eigvalsh(p.T @ (p * n[:, None]) / size).max() + ridge)
    r = y = np.ones(len(n))
    t = 1.0
    for _ in range(STEPS):
        gradient = p @ (((n * y) @ p - wanted) / size) + ridge * (y - 1)
        new = np.maximum(y - step * gradient, 0)
        if (n * gradient) @ (new - r) > 0:  # the momentum points uphill
            y, t = r, 1.0
            continue
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if np.abs(new - r).max() < 1e-12:
            r = new
            break
        r, y, t = new, new + (t - 1) / after * (new - r), after
    return ((n * r) @ p - wanted) / size


def fit_rates(posteriors: DataFrame, names: list[str], targets: dict[str, float] | None = None, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """g, and the expected and the wanted totals. posteriors: (n_tokens, posterior)."""
    k = len(names)
    n, p = histogram(posteriors, k)
    if not len(n):
        return np.zeros(k), np.zeros(k), np.zeros(k)
    size, wanted = n.sum(), target_totals(names, n @ p, targets)
    g = projected_gradient(n, p, wanted, ridge)
    parts = [F.col("posterior")[i] for i in range(k)]

    def moments(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rate = 1 - sum((x * float(v) for x, v in zip(parts, g, strict=True)), F.lit(0.0)) / ridge
        tokens = F.when(rate > 0, F.col("n_tokens")).otherwise(F.lit(0))
        total: list[Column] = [F.sum(tokens * rate * x) for x in parts]
        gram = [F.sum(tokens * parts[i] * parts[j]) for i in range(k) for j in range(i, k)]
        got = np.array(posteriors.agg(*(x.alias(f"v{i}") for i, x in enumerate([*total, *gram]))).first(), dtype=float)
        square = np.zeros((k, k))
        square[np.triu_indices(k)] = got[k:]
        return got[:k], square + np.triu(square, 1).T

    last, best = np.inf, g
    for _ in range(PASSES):
        totals, gram = moments(g)
        error = (totals - wanted) / size - g
        if (now := float(np.abs(error).max())) < TOLERANCE:
            return g, totals, wanted
        if now < last:
            last, best, move = now, g, np.linalg.solve(np.eye(k) + gram / (ridge * size), error)
        else:  # too far: the set of positive rates has changed too much
            move = move / 2
        g = best + move
    raise RuntimeError(f"the rates have not converged: error {last:.2e} after {PASSES} passes")


def _scored(docs: DataFrame, model: Classifier) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.slices(whole):
                means, n = model.means(*tk.buffers(batch.column(1)))
                p = model.posteriors(means)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, ridge: float = RIDGE) -> DataFrame:
    """doc_id, n_tokens, posterior (in the order of the sorted domain names) and rate of every document, and, the same in
    all rows, the domains and their wanted and reached shares of the tokens."""
    model = fit_classifier(docs, labels)
    scored = written(few_files(_scored(docs, model), docs), "posteriors")
    g, totals, wanted = fit_rates(scored.select("n_tokens", "posterior"), model.names, targets, ridge)
    rate = F.greatest(F.lit(0.0), 1 - sum((F.col("posterior")[i] * float(v) for i, v in enumerate(g)), F.lit(0.0)) / ridge)
    shares = [F.array(*(F.lit(float(v)) for v in x / max(x.sum(), 1.0))) for x in (wanted, totals)]
    return scored.select("*", rate.alias("rate"), F.array(*map(F.lit, model.names)).alias("domains"), shares[0].alias("wanted_shares"), shares[1].alias("reached_shares"))


def repeated(batch: pa.RecordBatch, copies: np.ndarray, at_text: int) -> Iterator[pa.RecordBatch]:
    """Row k copies[k] times, in pieces of about SLICE_BYTES text bytes however large the rates are."""
    sizes = np.diff(tk.buffers(batch.column(at_text))[1])
    index = np.repeat(np.arange(batch.num_rows), copies)
    piece = (np.cumsum(sizes[index]) - sizes[index]) // tk.SLICE_BYTES
    for part in np.split(index, np.flatnonzero(np.diff(piece)) + 1):
        yield batch.take(pa.array(part))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, each repeated floor(rate + u) times with u from a hash of its id and text; all columns."""
    model = fit_classifier(docs, labels)
    scored = written(few_files(_scored(docs, model).select("n_tokens", "posterior"), docs), "posteriors")
    g, _, _ = fit_rates(scored, model.names, targets)
    discard_tables(scored)
    ridge = RIDGE
    at_text, width = docs.columns.index("text"), len(docs.columns)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            plain = pa.record_batch(whole.columns, names=[f"c{i}" for i in range(width + 1)])
            for batch in tk.slices(plain, f"c{at_text}"):
                means, _ = model.means(*tk.buffers(batch.column(at_text)))
                r = rates_at(model.posteriors(means), g, ridge)
                copies = np.floor(r + batch.column(width).to_numpy()).astype(np.int64)
                for out in repeated(batch, copies, at_text):
                    yield pa.record_batch(out.columns[:width], names=names)

    unit = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / float(1 << 32)).alias("__unit")
    return docs.select("*", unit).mapInArrow(run, docs.schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
