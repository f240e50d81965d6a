"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features come from the whole text alone. Trees are grown on binned features (Newton steps on the logistic loss) from at
most `max_rows` labelled documents, chosen by the hash of their id, and kept as complete binary trees in flat arrays, so
a batch is scored by `depth` gathers over all trees at once.

Edge cases: null and empty texts have all statistics zero and get a score like any other; a document with contradicting
labels takes the lowest; labels other than 0 and 1 and null ids aren't learned from; with no labels or one class only the
score is the smoothed share of label 1; repeated rows each get a row; other columns are never read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_blocks, flat_text, table

MAX_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, MIN_HESSIAN = 80, 4, 64, 0.15, 1.0, 1.0
BLOCK = 1 << 20

FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "stop_mark", "symbol", "non_ascii", "bar",
    "log_words", "mean_word", "long_words", "short_words", "distinct_words", "distinct_triples", "top_word",
    "words_in_capitals", "words_ending_in_symbols", "bare_symbols",
    "log_lines", "mean_line", "distinct_lines", "lines_ending_in_stops",
)


def _classes() -> np.ndarray:
    """Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 line end, 6 . and ,, 7 other ASCII mark, 8 non-ASCII, 9 |."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = 7
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[32, 9]], kind[[10, 13]] = 4, 5
    kind[[44, 46]], kind[128:], kind[124] = 6, 8, 9
    return kind


CLASS = _classes()


def class_counts(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(rows, 10) counts of byte classes."""
    out = np.zeros((len(ends) - 1, 10), np.int64)
    for a, b in byte_blocks(flat, ends, BLOCK):
        for at in range(ends[a], ends[b], 8 * BLOCK):  # one long text in parts
            to = min(ends[b], at + 8 * BLOCK)
            row = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(np.clip(ends[a : b + 1], at, to)))
            out[a:b] += np.bincount(row * 10 + CLASS[flat[at:to]], minlength=(b - a) * 10).reshape(-1, 10)
    return out


def distinct_triples(code: np.ndarray, distinct: int) -> int:
    """Different runs of three among the words numbered 0 to distinct - 1."""
    a, b, c = code[:-2], code[1:-1], code[2:]
    if distinct < 1 << 21:
        return len(np.unique((a * distinct + b) * distinct + c))
    order = np.lexsort((c, b, a))  # three numbers don't fit in one
    a, b, c = a[order], b[order], c[order]
    return 1 + int(np.count_nonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))


def word_statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * 14
    sizes = np.fromiter(map(len, words), np.int64, n)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    distinct = len(number)
    code = np.fromiter(map(number.__getitem__, words), np.int64, n)
    triples = distinct_triples(code, distinct) / (n - 2) if n > 2 else 1.0
    top = np.bincount(code).max() / n
    last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    first = np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    second = np.frombuffer(b"".join([w[1:2] or b" " for w in words]), np.uint8)
    capitals = np.count_nonzero((CLASS[first] == 2) & (CLASS[second] == 2)) / n
    symbols = np.count_nonzero(np.isin(CLASS[last], (7, 9))) / n
    bare = np.count_nonzero((sizes == 1) & np.isin(CLASS[last], (7, 9))) / n
    lines = [x for x in text.split(b"\n") if x]
    stops = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    return (
        np.log1p(n), sizes.mean(), np.count_nonzero(sizes > 10) / n, np.count_nonzero(sizes <= 3) / n, distinct / n, triples, top,
        capitals, symbols, bare,
        np.log1p(len(lines)), len(text) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), stops / max(1, len(lines)),
    )


def features_of(texts: pa.Array) -> np.ndarray:
    flat, ends = flat_text(texts)
    n = np.diff(ends)
    counts = class_counts(flat, ends)
    share = counts / np.maximum(n, 1)[:, None]
    out = np.empty((len(n), len(FEATURES)), np.float32)
    out[:, 0] = np.log1p(n)
    out[:, 1:9] = np.c_[share[:, 1:4], share[:, 4] + share[:, 5], share[:, 6], share[:, 7] + share[:, 9], share[:, 8:]]
    data = flat.tobytes()
    for k in range(len(n)):
        out[k, 9:] = word_statistics(data[ends[k] : ends[k + 1]])
    return out


class Trees(NamedTuple):
    """Complete trees of one depth: node k has children 2k + 1 and 2k + 2; a row goes right if its feature is over the cut."""

    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        if not len(self.feature):
            return out
        tree = np.arange(len(self.feature))
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            at = np.zeros((len(part), len(tree)), np.int64)
            row = np.arange(len(part))[:, None]
            while at[0, 0] < inner:
                at = 2 * at + 1 + (part[row, self.feature[tree, at]] > self.cut[tree, at])
            out[a : a + 2048] += self.leaf[tree, at - inner].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Gradient boosting on feature histograms."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # code <= k: x <= edges[k]
    flat = code + np.arange(m) * bins
    margin = np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            key = ((at - first)[:, None] * (m * bins) + flat).ravel()
            size = many * m * bins
            hist = [np.bincount(key, np.repeat(w, m), size).reshape(many, m, bins).cumsum(2) for w in (g, h)]
            total = [x[:, :1, -1:] for x in hist]
            gain = sum(a * a / (b + L2) for a, b in ((hist[0], hist[1]), (total[0] - hist[0], total[1] - hist[1]))) - total[0] ** 2 / (total[1] + L2)
            gain[(hist[1] < MIN_HESSIAN) | (total[1] - hist[1] < MIN_HESSIAN)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        sums = [np.bincount(at - inner, w, inner + 1) for w in (g, h)]
        leaf[t] = -RATE * sums[0] / (sums[1] + L2)
        margin += leaf[t, at - inner]
    return Trees(base, feature, cut, leaf)


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS, folds: int = FOLDS) -> Trees:
    """Learn from at most `max_rows` labelled documents outside fold 0; `docs` has doc_id and text."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & (fold_of(F.col("id"), folds) != 0))
    chosen = known.groupBy("id").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    features = F.arrow_udf(features_of_list, "array<float>")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # of at most max_rows rows
    got = rows.select("id", "y", features("text").alias("x")).toArrow()
    order = np.lexsort((got["y"].to_numpy(), got["id"].to_numpy()))
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))[order]
    order_x = np.lexsort(x.T[::-1]) if len(x) else []
    return grow(x[order_x], got["y"].to_numpy()[order][order_x].astype(float))


def features_of_list(texts: pa.Array) -> pa.Array:
    x = features_of(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel()))


def score_column(text: Column, model: Trees) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features_of(texts)))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`."""
    docs = docs.select("doc_id", "text")
    model = trained(docs, labels, label_col, max_rows)
    out = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The rows of `docs` that score at least the threshold, all columns."""
    model = trained(docs.select("doc_id", "text"), labels, label_col)
    return docs.where(score_column(F.col("text"), model) >= THRESHOLD)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
