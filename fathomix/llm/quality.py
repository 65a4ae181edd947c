"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once in Spark and stored. The trees learn from a
bounded sample of the labelled rows (``SAMPLE_ROWS``, the only bound here) on binned
statistics, and are flattened into arrays: scoring walks all trees of a batch of rows at the
same time, level by level.

Rows: a null or empty text has statistics of nothing and is scored like any other; repeated
rows get equal scores; a null id is scored and never learned from; a document with several
labels learns their mean, rounded up. Without labels, or with one class only, every score is
the smoothed share of label 1 (0.5 without labels). Extra columns are ignored by ``scores``
and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fathomix.llm.common import ROW_KEYS, as_given, small_batches, text_bytes, with_row_keys, without_rows
from fathomix.session import materialize

# Labelled rows that the trees learn from at most.
SAMPLE_ROWS = 20_000
# Classes of bytes whose shares are statistics of their own.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "space": b" \t", "newline": b"\n\r\x0b\x0c", "stop": b".?", "comma": b",;:", "bang": b"!", "bar": b"|",
    "quote": b"\"'`", "bracket": b"()[]{}<>", "mark": b"#$%&*+=@^~\\/_", "dash": b"-",
    "control": bytes([*range(9), *range(14, 32), 127]), "beyond": bytes(range(128, 256)),
}
NAMES = (
    *BYTE_CLASSES, "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "entropy", "compressed",
    "distinct_words", "same_as_before", "top_word", "distinct_pairs", "lines", "line_length", "distinct_lines",
    "short_lines", "ended_lines", "capital_words", "marked_words",
)


def statistics(text: bytes) -> list[float]:
    """The statistics ``NAMES`` of a whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(len(text), 1)
    shares = [float(counts[np.frombuffer(members, np.uint8)].sum()) / size for members in BYTE_CLASSES.values()]
    seen = counts[counts > 0] / size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    folded = [w.lower() for w in words]
    distinct = set(folded)
    repeats = sum(map(bytes.__eq__, folded[1:], folded)) if len(folded) > 1 else 0
    codes = np.fromiter(map(hash, folded), np.int64, len(folded))
    top = np.unique(codes, return_counts=True)[1].max() if words else 0
    pairs = len(np.unique(codes[:-1] * 31 + codes[1:])) if len(words) > 1 else 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    m = max(len(lines), 1)
    return [
        *shares,
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()),
        float(np.log1p(lengths.max())), float(-(seen * np.log2(seen)).sum()), len(zlib.compress(text, 1)) / size,
        len(distinct) / n, repeats / n, float(top) / n, pairs / n, float(np.log1p(len(lines))),
        float(np.log1p(len(text) / m)), len(set(lines)) / m, sum(len(x.split()) < 4 for x in lines) / m,
        sum(x.rstrip()[-1:] in b".?!" for x in lines) / m, sum(w[:1].isupper() for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?" for w in words) / n,
    ]


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``statistics`` of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    small_batches(docs)
    read = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    return read.mapInArrow(run, f"{schema}, statistics array<double>")


@dataclass
class Forest:
    """Trees as arrays of one row each; ``feature`` is -1 at a leaf, ``value`` its log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[trees, node]
            below = x[rows, np.maximum(feature, 0)] <= self.threshold[trees, node]
            step = np.where(below, self.left[trees, node], self.right[trees, node])
            node = np.where(feature < 0, node, step)
        odds = self.base + self.value[trees, node].sum(axis=1)
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15,
        smooth: float = 1.0, least: float = 4.0) -> Forest:
    """Boost ``trees`` trees of ``depth`` levels on statistics cut into quantile ``bins``.

    ``smooth`` is added to each leaf's curvature; a side of a split has at least ``least`` of it
    after scaling by four, that is, about as many rows.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    nodes = 2 ** (depth + 1) - 1
    forest = Forest(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes), np.int64),
                    np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), base, depth)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T] if trees else []
    binned = [np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)]
    odds = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth + 1):
            first, count = 2**level - 1, 2**level
            inside = (node >= first) & (node < first + count)
            local = node[inside] - first
            g = np.bincount(local, slope[inside], count)
            h = np.bincount(local, curve[inside], count)
            forest.value[t, first:first + count] = rate * g / (h + smooth)
            if level == depth or not inside.any():
                continue
            best = np.full(count, 1e-6)
            for f, (cut, column) in enumerate(zip(cuts, binned)):
                if not len(cut):
                    continue
                width = len(cut) + 1
                slot = local * width + column[inside]
                gl = np.bincount(slot, slope[inside], count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
                hl = np.bincount(slot, curve[inside], count * width).reshape(count, width).cumsum(axis=1)[:, :-1]
                gr, hr = g[:, None] - gl, h[:, None] - hl
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - (g**2 / (h + smooth))[:, None]
                gain[np.minimum(hl, hr) * 4 < least] = 0
                at = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(count), at] > best)
                best[better] = gain[better, at[better]]
                here = first + better
                forest.feature[t, here], forest.threshold[t, here] = f, cut[at[better]]
                forest.left[t, here], forest.right[t, here] = 2 * here + 1, 2 * here + 2
            split = inside & (forest.feature[t, np.minimum(node, nodes - 1)] >= 0)
            at = node[split]
            below = x[np.flatnonzero(split), forest.feature[t, at]] <= forest.threshold[t, at]
            node[split] = np.where(below, forest.left[t, at], forest.right[t, at])
        odds += forest.value[t, node]
    return forest


def learn(measured: DataFrame, labels: DataFrame, learns: Column, label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled documents for which ``learns`` holds.

    ``measured`` has ``doc_id`` and ``statistics``. The sample is chosen by a hash of the id.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(learns).groupBy(
        "doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    count = known.count()
    share = min(1.0, 1.1 * sample_rows / max(count, 1))
    near = known.filter(draw.bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)))
    # Bounded by sample_rows, so it may be sent to every task and, with the statistics, to the driver.
    chosen = near.orderBy(draw, "doc_id").limit(sample_rows)
    rows = measured.select("doc_id", "statistics").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(
        F.min("statistics").alias("statistics")).orderBy("doc_id").toPandas()
    x = np.array(rows["statistics"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit(x, rows["y"].to_numpy(float))


def apply(measured: DataFrame, forest: Forest) -> DataFrame:
    """``measured`` with ``score`` instead of ``statistics``."""
    names = [c for c in measured.columns if c != "statistics"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(forest.score(x), pa.float64())], names=[*names, "score"])

    read = measured.select(*names, "statistics")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    return read.mapInArrow(run, f"{schema}, score double")


def fold(column: str = "doc_id", folds: int = 3) -> Column:
    """Fold of a document by the checksum of its id's text; a null id has fold 0."""
    return F.coalesce(F.crc32(F.col(f"`{column}`").cast("string")) % folds, F.lit(0))


def scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; fold 1 of 3 is never learned from."""
    measured = materialize(with_statistics(docs, ("doc_id",)))
    forest = learn(measured, labels, fold() != 1, sample_rows=sample_rows)
    return apply(measured, forest).select(
        "doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more."""
    keyed = with_row_keys(docs)
    measured = materialize(with_statistics(keyed, ("doc_id", *ROW_KEYS)))
    forest = learn(measured, labels, fold() != 1, sample_rows=sample_rows)
    rejected = materialize(apply(measured, forest).filter("score < 0.5").select(*ROW_KEYS))
    return as_given(without_rows(keyed, rejected), docs)
