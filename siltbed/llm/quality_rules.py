"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. One pass computes statistics of every whole text (``STATISTICS``); nothing but the text goes in.
2. Small decision trees on random halves of a bounded sample (``SAMPLE`` labelled rows) give rules: every path from the root
   to a node is a conjunction of comparisons.
3. Lasso logistic regression weighs the rules, so that most weights are zero.
4. The rest compile to one Spark column expression over the statistics; scoring runs inside the JVM.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out of learning. Null texts are empty; texts without words have statistics
of 0; null doc_ids are scored, but never learnt from and not held out; rows with several labels are learnt with each; null labels
are ignored; without labels of both kinds the score is the share of good labels, or 0.5 where there are none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltbed.llm import common as C

SAMPLE = 20_000  # labelled rows that the model is fitted on, by the order of a hash of doc_id
TREES, DEPTH, BINS, LEAST_LEAF, PENALTY, ROUNDS, CUT = 24, 3, 24, 20, 0.002, 400, 0.7

STATISTICS = (
    "log_bytes", "letter_share", "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "point_share", "newline_share",
    "word_length", "distinct_words", "top_word", "repeat_pairs", "distinct_lines", "symbol_words", "line_length", "brace_share",
)


def classes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
CLASSES = [
    LETTERS, classes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), classes_of("0123456789"), classes_of("#$%&*@^~=+\\/<>_"),
    classes_of("!?"), classes_of("|"), classes_of(".,;:"), classes_of("\n"), classes_of("{}[]()"),
]
NEWLINE = classes_of("\n\r")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(size)
    shares = []
    for c in CLASSES:
        sums = np.concatenate([[0], np.cumsum(c[data])])
        shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1))
    out[:, 1:9] = np.stack(shares[:8], axis=1)
    out[:, 16] = shares[8]
    starts, ends, bounds = C.word_spans(data, offsets, C.ASCII_SPACE)
    words = C.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    line_starts, line_ends, line_bounds = C.word_spans(data, offsets, NEWLINE)
    lines = C.word_hashes(data, line_starts, line_ends) if len(line_starts) else np.zeros(0, np.uint64)
    odd = np.concatenate([[0], np.cumsum(CLASSES[3][data] | CLASSES[4][data])])
    for i in range(n):
        w, at = words[bounds[i]:bounds[i + 1]], slice(bounds[i], bounds[i + 1])
        if len(w):
            _, counts = np.unique(w, return_counts=True)
            out[i, 9] = float((ends[at] - starts[at]).mean())
            out[i, 10] = len(counts) / len(w)
            out[i, 11] = counts.max() / len(w)
            out[i, 12] = float((w[1:] == w[:-1]).mean()) if len(w) > 1 else 0.0
            out[i, 14] = float((odd[ends[at]] > odd[starts[at]]).mean())
            x = lines[line_bounds[i]:line_bounds[i + 1]]
            out[i, 13] = len(np.unique(x)) / len(x) if len(x) else 0.0
            out[i, 15] = np.log1p(size[i] / max(1, len(x)))
    return out


def statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in C.slices(batch):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["doc_id", *STATISTICS])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold) of each condition


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """Paths of one tree: greedy Gini splits on quantile thresholds of a random half of the statistics."""
    cols = rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False)
    rules: list[Rule] = []

    def grow(at: np.ndarray, path: Rule) -> None:
        if path:
            rules.append(path)
        good = y[at].sum()
        if len(path) == DEPTH or len(at) < 2 * LEAST_LEAF or not 0 < good < len(at):
            return
        best = (1e-9, None)
        whole = 2 * good * (len(at) - good) / len(at)
        for c in cols:
            v = x[at, c]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1]))
            order = np.sort(v)
            for t in cuts:
                n = int(np.searchsorted(order, t, side="right"))
                if LEAST_LEAF <= n <= len(at) - LEAST_LEAF:
                    g = y[at[v <= t]].sum()
                    gain = whole - 2 * g * (n - g) / n - 2 * (good - g) * (len(at) - n - good + g) / (len(at) - n)
                    if gain > best[0]:
                        best = (gain, (c, float(t)))
        if best[1]:
            c, t = best[1]
            above = x[at, c] > t
            grow(at[~above], (*path, (int(c), False, t)))
            grow(at[above], (*path, (int(c), True, t)))

    grow(rng.permutation(len(y))[:max(1, len(y) // 2)], ())
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c, above, t in rule:
        out &= (x[:, c] > t) if above else (x[:, c] <= t)
    return out


def lasso(r: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weights) of penalised logistic regression by accelerated proximal gradient steps."""
    n, m = r.shape
    r1 = np.concatenate([np.ones((n, 1)), r], axis=1)
    step = 4.0 * n / max(1e-9, float(np.linalg.norm(r1, 2) ** 2))
    w = np.zeros(m + 1)
    w[0] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        grad = r1.T @ (1 / (1 + np.exp(-(r1 @ z))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * PENALTY, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class RuleModel:
    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The compiled score: a logistic sum of rule weights."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            hit = F.lit(True)
            for c, above, t in rule:
                hit = hit & ((F.col(STATISTICS[c]) > t) if above else (F.col(STATISTICS[c]) <= t))
            total = total + F.when(hit, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    if len(y) == 0:
        return RuleModel(0.0, [])
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(r for _ in range(TREES) for r in tree_rules(x, y, rng)))
    columns, kept, seen = [], [], set()
    for r in rules:
        hit = holds(r, x)
        key = np.packbits(hit).tobytes()
        if 0 < hit.sum() < len(y) and key not in seen:
            seen.add(key)
            columns.append(hit)
            kept.append(r)
    if not kept:
        p = y.mean()
        return RuleModel(math.log(p / (1 - p)), [])
    intercept, w = lasso(np.stack(columns, axis=1).astype(float), y.astype(float))
    return RuleModel(intercept, [(r, float(v)) for r, v in zip(kept, w) if v])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    C.prepared(docs)
    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = C.materialize(plain.mapInArrow(statistic_rows, schema), "quality-statistics")
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "quality").limit(SAMPLE)
    rows = stats.join(chosen, "doc_id").orderBy("doc_id", "quality", *STATISTICS).limit(2 * SAMPLE).toPandas()
    model = fit(rows[list(STATISTICS)].to_numpy(float), (rows["quality"].to_numpy(float) > 0).astype(int))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
