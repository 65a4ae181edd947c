"""Benchmark passages in documents, by SimHash windows and exact similarity.

A copy counts when the five-word shingles of an item and of the item-sized stretch of the
document, each weighted by how often it occurs, overlap by 0.8 or more (sum of smaller over
sum of larger counts). Documents are fingerprinted in windows sized to the items: each size
class is the longest that, with its stride, still fits inside the shortest stretch that can
reach the similarity. An item is indexed by the windows at all of its word offsets, so a
contiguous copy always has a window whose fingerprint equals one of the item's; edits inside
a copy are met by the Hamming radius. The fingerprint is cut into blocks, and each block is
looked up with all values within ``radius // blocks`` bits, which finds every indexed
fingerprint within ``radius``. Every candidate is verified on the words themselves.

Items go to the tasks in blocks of bounded size; a benchmark of any size is read in as many
passes as it has blocks. Documents never move.

Rows: a null or empty text, and an item without words, match nothing; an item with fewer than
five words is one shingle. Items with equal words are one item, named by the smallest id.
Repeated documents are reported as often as they appear; null ids are kept. Extra columns are
ignored by ``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomix.llm.common import ROW_KEYS, as_given, hashes_of, small_batches, text_bytes, with_row_keys, without_rows, words
from fathomix.operators.sampling import dense_row_index
from fathomix.session import materialize

# A block of items sent to the tasks has at most so many items and bytes of text.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
BLOCKS = 4
# Words fingerprinted at once.
CHUNK = 1 << 16
SEED = 7


def prefix_counts(hashes: np.ndarray, size: int = 255) -> np.ndarray:
    """How often each of the 64 bits is set before each word, for windows of up to ``size`` words.

    Counters stand side by side in 64-bit numbers, as wide as a window's counts need. Sums may
    carry from one counter into the next, but the difference of two sums no more than a window
    apart is the window's counts again, as none of those overflows.
    """
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    lanes = bits.astype(_lane(size)).view(np.uint64)
    counts = np.zeros((len(hashes) + 1, lanes.shape[1]), np.uint64)
    np.cumsum(lanes, axis=0, out=counts[1:])
    return counts


def _lane(size: int) -> type:
    """The narrowest counter for windows of ``size`` words."""
    return np.uint8 if size < 1 << 8 else np.uint16 if size < 1 << 16 else np.uint32


def window_prints(counts: np.ndarray, size: int, stride: int, starts: int) -> np.ndarray:
    """Fingerprints, as ``BLOCKS`` 16-bit blocks, of the windows at each ``stride`` words."""
    sums = counts[size:size + starts:stride] - counts[:starts:stride]
    lane = {8: np.uint8, 16: np.uint16, 32: np.uint32}[counts.shape[1]]
    ones = sums.view(lane).reshape(-1, 64)
    return np.packbits(ones > size // 2, axis=1).view("<u2")


def shingles(parts: list[bytes], length: int) -> Counter:
    if len(parts) < length:
        return Counter([tuple(parts)]) if parts else Counter()
    return Counter(zip(*(parts[i:] for i in range(length))))


def similarity(a: Counter, b: Counter) -> float:
    shared = (a & b).total()
    total = a.total() + b.total() - shared
    return shared / total if total else 0.0


@dataclass
class SizeClass:
    """The windows of all items that share a window size, indexed by block value."""

    size: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    starts: list[np.ndarray]
    members: list[np.ndarray]

    def candidates(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Window and indexed fingerprint of each pair within ``radius`` bits."""
        whole, own = prints.view("<u8").ravel(), self.prints.view("<u8").ravel()
        found = []
        for block in range(BLOCKS):
            values = prints[:, block]
            first, held = self.starts[block], self.members[block]
            hit = np.flatnonzero((first[1:] > first[:-1])[values])
            if not len(hit):
                continue
            low, high = first[values[hit]], first[values[hit].astype(np.int64) + 1]
            count = high - low
            window = np.repeat(hit, count)
            at = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + np.repeat(low, count)
            member = held[at]
            near = np.bitwise_count(whole[window] ^ own[member]) <= radius
            found.append(np.stack([window[near], member[near]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]


@dataclass
class Index:
    """Items prepared for scanning documents."""

    ids: list
    lengths: list[int]
    shingles: list[Counter]
    classes: list[SizeClass]
    shingle: int
    least: float
    radius: int


def window_size(length: int, shingle: int, least: float) -> tuple[int, int]:
    """Window size and stride for items of ``length`` words, from a fixed ladder of sizes.

    The window and its stride fit into the shortest stretch with a similarity of ``least``.
    """
    if length <= shingle:
        return length, 1
    shortest = int(np.ceil(least * (length - shingle + 1) - 1e-9)) + shingle - 1
    size, best = 2, (1, 1)
    while size <= shortest:
        stride = max(1, size // 6)
        if size + stride - 1 <= shortest:
            best = (size, stride)
        size = max(size + 1, size * 6 // 5)
    return best


def _neighbours(values: np.ndarray, distance: int) -> np.ndarray:
    """All 16-bit values within ``distance`` bits of each value, one row each."""
    masks, layer = [0], [0]
    for _ in range(distance):
        layer = sorted({m ^ (1 << bit) for m in layer for bit in range(16)} - set(masks))
        masks += layer
    return values[:, None] ^ np.array(masks, np.uint16)[None, :]


def build_index(items: list[tuple], shingle: int = 5, least: float = 0.8, radius: int = 7) -> Index:
    """Index ``(item_id, text)`` pairs with non-empty word lists."""
    parts = [words(text.encode()) for _, text in items]
    sizes: dict[tuple[int, int], list] = {}
    for number, own in enumerate(parts):
        size, stride = window_size(len(own), shingle, least)
        prints = window_prints(prefix_counts(hashes_of(own, SEED), size), size, 1, len(own) - size + 1)
        sizes.setdefault((size, stride), []).append((number, prints))
    classes = []
    for (size, stride), entries in sorted(sizes.items()):
        prints = np.ascontiguousarray(np.concatenate([p for _, p in entries]))
        item = np.concatenate([np.full(len(p), n) for n, p in entries])
        offset = np.concatenate([np.arange(len(p)) for _, p in entries])
        starts, members = [], []
        for block in range(BLOCKS):
            near = _neighbours(prints[:, block], radius // BLOCKS)
            owner = np.repeat(np.arange(len(prints)), near.shape[1])
            order = np.argsort(near.ravel(), kind="stable")
            members.append(owner[order])
            starts.append(np.searchsorted(near.ravel()[order], np.arange(65537)))
        classes.append(SizeClass(size, stride, prints, item, offset, starts, members))
    return Index([i for i, _ in items], [len(p) for p in parts], [shingles(p, shingle) for p in parts],
                 classes, shingle, least, radius)


def scan(index: Index, texts: list[bytes]) -> list[tuple[int, int, float, int]]:
    """``text number, item number, similarity, first word`` of the best copy of each item in each text."""
    parts, ends = [], []
    for text in texts:
        parts += words(text)
        ends.append(len(parts))
    ends = np.array(ends, np.int64)
    widest = max((c.size for c in index.classes), default=0)
    lanes = {_lane(c.size): c.size for c in index.classes}
    hashes = hashes_of(parts, SEED)
    tried: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for at in range(0, len(parts), CHUNK):
        own = hashes[at:at + CHUNK + widest - 1]
        counts = {lane: prefix_counts(own, size) for lane, size in lanes.items()}
        for one in index.classes:
            starts = min(CHUNK, len(own) - one.size + 1)
            if starts <= 0:
                continue
            prints = np.ascontiguousarray(window_prints(counts[_lane(one.size)], one.size, one.stride, starts))
            window, member = one.candidates(prints, index.radius)
            for w, m in zip(window.tolist(), member.tolist()):
                place = at + w * one.stride
                text = int(np.searchsorted(ends, place, side="right"))
                item = int(one.item[m])
                low, high = int(ends[text - 1]) if text else 0, int(ends[text])
                first = place - int(one.offset[m])
                if (text, item, first) in tried:
                    continue
                tried.add((text, item, first))
                start, stop = max(first, low), min(first + index.lengths[item], high)
                like = similarity(shingles(parts[start:stop], index.shingle), index.shingles[item])
                if like >= index.least and (like, low - start) > best.get((text, item), (0.0, 0)):
                    best[text, item] = (like, low - start)
    return [(text, item, like, -place) for (text, item), (like, place) in sorted(best.items())]


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct items with words, in lists of bounded size."""
    text = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                   "[\\x09-\\x0D\\x20]+", " "))
    distinct = items.filter(F.col("text").isNotNull()).groupBy(text.alias("text")).agg(
        F.min("item_id").alias("item_id")).filter("text <> ''")
    sized = materialize(dense_row_index(distinct.withColumn("size", F.octet_length("text")), ["text"], [], "number"))
    seen = sized.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    # No block has more bytes than this many items of the longest kind.
    per_block = int(max(1, min(BLOCK_ITEMS, BLOCK_BYTES // max(1, seen[2] or 1))))
    for first in range(0, seen[0], per_block):
        rows = sized.filter((F.col("number") >= first) & (F.col("number") < first + per_block))
        yield [(r["item_id"], r["text"]) for r in rows.orderBy("number").collect()]


def matches(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",), shingle: int = 5,
            least: float = 0.8, radius: int = 7) -> DataFrame:
    """``keep`` columns, ``item_id``, ``similarity`` and ``first_word`` of each item in each row.

    One row per document row and item with a copy of similarity ``least`` or more: the most
    similar copy, the first of equals. Lists the items when called.
    """
    small_batches(docs)
    read = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    id_kind = items.schema["item_id"].dataType.simpleString()
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"{kinds}, item_id {id_kind}, similarity double, first_word long"
    names = [*keep, "item_id", "similarity", "first_word"]
    found = []
    for block in _item_blocks(items):
        # Sent to the tasks with the function; bounded by BLOCK_ITEMS and BLOCK_BYTES.
        prepared = build_index(block, shingle, least, radius)

        def run(batches: Iterator[pa.RecordBatch], index: Index = prepared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                rows, hits, pending, size = [], [], [], 0
                for row in range(batch.num_rows + 1):
                    if row == batch.num_rows or size > 6 * CHUNK:
                        for text, item, like, first in scan(index, pending):
                            rows.append(row - len(pending) + text)
                            hits.append((index.ids[item], like, first))
                        pending, size = [], 0
                    if row < batch.num_rows:
                        pending.append(texts[row].as_py())
                        size += len(pending[-1])
                if rows:
                    picked = batch.take(pa.array(rows, pa.int64()))
                    columns = zip(*hits)
                    yield pa.RecordBatch.from_arrays([
                        *picked.columns[:-1], pa.array(next(columns), id_type), pa.array(next(columns), pa.float64()),
                        pa.array(next(columns), pa.int64())], names=names)

        found.append(read.mapInArrow(run, schema))
    if not found:
        return read.drop("_text").limit(0).select(
            "*", F.lit(None).cast(id_kind).alias("item_id"), F.lit(None).cast("double").alias("similarity"),
            F.lit(None).cast("long").alias("first_word"))
    return reduce(DataFrame.unionByName, found)


def clean(docs: DataFrame, items: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = 7) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item."""
    keyed = with_row_keys(docs)
    gone = materialize(matches(keyed, items, ROW_KEYS, shingle, least, radius).select(*ROW_KEYS))
    return as_given(without_rows(keyed, gone), docs)
