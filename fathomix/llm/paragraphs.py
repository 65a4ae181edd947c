"""Repeated paragraphs and passages across documents, by MinHash banding and components.

Two kinds of units are compared. Paragraphs are lines of ``MIN_WORDS`` or more words: the
minima of their hashed five-word shingles are banded, paragraphs that share a band value are
joined, and the exact Jaccard similarity of their shingles decides (0.8 or more). With bands
of two minima and five bands, 99.4 % of pairs at 0.8 collide. Pieces follow the words
themselves instead of the lines: a piece starts where the hash of two neighbouring words is
the least among nine places. So a passage that sits inside another line falls into the same
pieces wherever it stands, and equal pieces (edit distance 0) mark it.

Copies of a unit are folded before any comparison. In a band value's bucket (one of over
``BUCKET_ROWS`` rows is cut by the next band first) the rows are sorted by their next band, and each is compared with the ``NEIGHBOURS`` before it and with the
first of its run, so the work grows with the bucket and not with its square; buckets of up to
``NEIGHBOURS + 1`` are compared in full. For larger ones this only forms first clusters: their
paragraphs then meet through their rarest shingles (two at the least similarity always share
one of the first few), and every pair of different clusters that can be similar, by its sizes, the
place of the shared shingle and sketches of all shingles, is verified.
Where more than ``BUCKET_ROWS`` share a shingle, they are cut into parts and each two parts meet.

A component counts when it appears in two or more rows. It keeps its first unit (smallest
document, then place) and the others, also those in the same row, are marked for removal. Marked words of a document are merged into spans, and spans of fewer than
``MIN_WORDS`` words are left alone, as short stock phrases repeat everywhere.

Rows: a null or empty text has no units; a unit repeated within one row only is left alone; a
stretch that repeats one word over and over is one piece, however long; a null id comes after all ids and stays null; repeated rows repeat all their units;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomix.llm.common import components, hashes_of, small_batches, text_bytes
from fathomix.operators.skew import HOT_KEYS, lookup_join
from fathomix.session import materialize, release

MIN_WORDS = 15
SHINGLE = 5
BANDS, ROWS = 5, 2
NEIGHBOURS = 4
# A band value with more rows than this is cut by the rows' next band.
BUCKET_ROWS = 100_000
# Places on each side that a piece's start is compared with.
REACH = 4
SEED = 9
# Odd multipliers of the minima's hash functions and of the words in a unit.
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, 2 * BANDS * ROWS, np.int64).astype(np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Counters of shingles by hash; they order shingles from rare to common, and any order is exact.
SLOTS = 1 << 18
# Columns of a paragraph's sketch, 64 bits each.
SKETCH = ("s0", "s1", "s2", "s3")
# Postings up to this many rows are compared together, longer ones one by one.
SHORT = 16
# Units looked up by a broadcast of their hashes alone, some 50 bytes each; beyond, by a join.
MEMBER_ROWS = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _unit_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each run of words; depends on the words and their order alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int((ends - starts).max())
    powers = np.cumprod(np.full(longest, _STEP), dtype=np.uint64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.arange(len(owner)) - np.repeat((ends - starts).cumsum() - (ends - starts), ends - starts)
    terms = _mix(codes[starts[owner] + inside] + powers[inside]) * powers[inside]
    sums = np.add.reduceat(terms, (ends - starts).cumsum() - (ends - starts))
    return _mix(sums + np.uint64(salt) + (ends - starts).astype(np.uint64))


def _windows(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = len(codes) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    for i in range(length if n > 0 else 0):
        total = _mix(total * _STEP + codes[i:i + n])
    return total


def _distinct_in(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many different values each span holds."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    inside = values[np.arange(len(owner)) + np.repeat(starts - (sizes.cumsum() - sizes), sizes)]
    order = np.lexsort((inside, owner))
    owner, inside = owner[order], inside[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    return np.bincount(owner[new], minlength=len(starts))


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where the words' own hashes start pieces; the first word always does."""
    n = len(codes)
    if n < 2:
        return np.arange(n)
    keys = _mix(codes[:-1] * _STEP + codes[1:])
    lowest = np.ones(n - 1, bool)
    for step in range(1, REACH + 1):
        lowest[step:] &= keys[step:] < keys[:-step]
        lowest[:-step] &= keys[:-step] < keys[step:]
    return np.unique(np.concatenate([[0], np.flatnonzero(lowest) + 1]))


def units_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``start, words, hash, is paragraph, distinct shingles`` of a text's units, and the paragraphs' bands.

    Pieces have no shingles.
    """
    lines = [line.split() for line in text.lower().split(b"\n")]
    parts = [w for line in lines for w in line]
    codes = hashes_of(parts, SEED)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    line_starts = sizes.cumsum() - sizes
    long = sizes >= MIN_WORDS
    first, last = line_starts[long], (line_starts + sizes)[long]
    starts = piece_starts(codes)
    ends = np.append(starts[1:], len(codes)) if len(starts) else starts
    whole = ends - starts >= SHINGLE
    starts, ends = starts[whole], ends[whole]
    bands = np.zeros((len(first), BANDS), np.uint64)
    distinct = np.zeros(len(starts) + len(first), np.int64)
    if len(first):
        shingles = _windows(codes, SHINGLE)
        spans = np.stack([first, last - SHINGLE + 1], axis=1).ravel()
        closed = spans[-1] == len(shingles)
        minima = [
            np.minimum.reduceat(_mix(shingles * _FACTORS[2 * k] + _FACTORS[2 * k + 1]), spans[:-1] if closed else spans)[::2]
            for k in range(BANDS * ROWS)]
        for b in range(BANDS):
            value = np.full(len(first), b, np.uint64)
            for r in range(ROWS):
                value = _mix(value * _STEP + minima[b * ROWS + r])
            bands[:, b] = value
        distinct[len(starts):] = _distinct_in(shingles, first, last - SHINGLE + 1)
    hashes = np.concatenate([_unit_hashes(codes, starts, ends, 1), _unit_hashes(codes, first, last, 2)])
    kind = np.concatenate([np.zeros(len(starts), bool), np.ones(len(first), bool)])
    begin, size = np.concatenate([starts, first]), np.concatenate([ends - starts, last - first])
    return begin, size, hashes, kind, distinct, bands


def units(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text, start, words, hash, shingles, bands``: the units of all rows; bands of paragraphs only.

    ``text`` is the hash of the whole text.
    """
    small_batches(docs)
    read = docs.select("doc_id", text_bytes().alias("text"), _text_hash().alias("hashed"))
    kind = read.schema["doc_id"].dataType
    schema = pa.schema([("row", pa.int64()), ("doc_id", to_arrow_type(kind)), ("text", pa.int64()), ("start", pa.int32()),
                        ("words", pa.int32()), ("hash", pa.int64()), ("shingles", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                found = [units_of(t.as_py()) for t in some.column(1)]
                counts = np.array([len(f[0]) for f in found])
                owner = np.repeat(np.arange(len(found)), counts)
                begin, size, hashes, para, distinct = (np.concatenate([f[i] for f in found]) for i in range(5))
                bands = np.concatenate([f[5] for f in found]).astype(np.int64).ravel()
                offsets = np.concatenate([[0], (para * BANDS).cumsum()]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands, pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + owner, pa.int64()), some.column(0).take(pa.array(owner)), some.column(2).take(pa.array(owner)),
                    pa.array(begin, pa.int32()), pa.array(size, pa.int32()), pa.array(hashes.astype(np.int64)),
                    pa.array(distinct, pa.int32()), listed,
                ], schema=schema)
                row += len(found)

    return read.mapInArrow(run, f"row long, doc_id {kind.simpleString()}, text long, start int, words int, hash long, shingles int, bands array<long>")


def _text_hash() -> Column:
    return F.xxhash64(text_bytes())


def colliding(paragraphs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct paragraphs (``hash, words, bands``) that a band brings together.

    ``words`` is the number of distinct shingles, which bounds the similarity of two paragraphs.
    """
    banded = paragraphs.select("hash", "words", F.posexplode("bands").alias("at", "band"), "bands").select(
        "band", F.element_at("bands", (F.col("at") + 1) % BANDS + 1).alias("next"), "hash", "words")
    counts = banded.groupBy("band").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most HOT_KEYS bands can hold that fraction of the rows each.
    hot = materialize(counts.filter(F.col("n") > max(BUCKET_ROWS, total // HOT_KEYS)))
    part = F.lit(0).cast("long")
    if not hot.isEmpty():
        banded = banded.join(F.broadcast(hot), "band", "left")
        part = F.coalesce(F.pmod("next", F.ceil(F.col("n") / BUCKET_ROWS)), part)
    # Whole parts of buckets go to one task, so no neighbours are torn apart.
    sorted_rows = banded.select(F.xxhash64("band", part).alias("band"), "next", "hash", "words").repartitionByRange(
        "band").sortWithinPartitions("band", "next", "hash")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        leader = None
        for batch in batches:
            band, code, words = (
                np.concatenate([k, batch.column(i).to_numpy()]) for k, i in zip(kept, (0, 2, 3)))
            old = len(kept[0])
            here = np.arange(old, len(band))
            found = []
            for back in range(1, NEIGHBOURS + 1):
                one = here[here >= back]
                found.append((one - back, one))
            run_start = np.concatenate([[True], band[1:] != band[:-1]])
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(band)), 0))
            found.append((first[here], here))
            a, b = (np.concatenate(x) for x in zip(*found))
            lead = (code[a], words[a], band[a])
            pairs = [(lead[0], code[b], lead[1], words[b], lead[2] == band[b])]
            if leader is not None and leader[0] == band[0]:
                # The run began in an earlier batch: its first row stands in for this batch's first.
                same = here[band[here] == leader[0]]
                pairs.append((np.full(len(same), leader[1]), code[same], np.full(len(same), leader[2]), words[same],
                              np.ones(len(same), bool)))
            x, y, m, n, together = (np.concatenate(z) for z in zip(*pairs))
            near = together & (x != y) & (5 * np.minimum(m, n) >= 4 * np.maximum(m, n) - 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(x, y)[near]), pa.array(np.maximum(x, y)[near])], schema=schema)
            if len(band):
                start = int(first[-1])
                if leader is None or leader[0] != band[-1]:
                    leader = (band[-1], code[start], words[start])
                kept = [z[-NEIGHBOURS:] for z in (band, code, words)]

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def shingle_set(line: bytes) -> set[tuple[bytes, ...]]:
    parts = line.lower().split()
    return set(zip(*(parts[i:] for i in range(SHINGLE)))) if len(parts) >= SHINGLE else {tuple(parts)}


def crowded(paragraphs: DataFrame) -> DataFrame:
    """``hash`` of the paragraphs with a band value that more rows have than are compared in full."""
    banded = paragraphs.select("hash", F.explode("bands").alias("band"))
    large = banded.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > NEIGHBOURS + 1).select("band")
    return lookup_join(banded, materialize(large), ["band"], "left_semi", salt_by=["hash"]).select("hash").distinct()


def _line_shingles(line: bytes) -> np.ndarray:
    """The distinct hashes of a line's shingles."""
    codes = hashes_of(line.lower().split(), SEED)
    return np.unique(_windows(codes, SHINGLE)).astype(np.int64)


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """``key, hash, size, at`` and ``SKETCH``: of each paragraph's ``size`` shingles, rarest first, those that count.

    Two paragraphs with a similarity of ``least`` share one of these, whatever the order. The
    sketch has a bit for each class of shingles of which the paragraph holds an odd number, so
    two sketches differ in no more bits than the paragraphs differ in shingles.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for line in batch.column(0):
                np.add.at(held, _line_shingles(line.as_py()) & (SLOTS - 1), 1)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for r in texts.select("line").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r.slot] = r.n
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("at", pa.int32()),
                        *[(n, pa.int64()) for n in SKETCH]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches = [], [], [np.zeros((0, len(SKETCH)), np.int64)]
            for line in batch.column(1):
                found = _line_shingles(line.as_py())
                sketches.append(sketch(found)[None])
                found = found[np.lexsort((found, shared.value[found & (SLOTS - 1)]))]
                sizes.append(len(found))
                keys.append(found[:len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1])
            taken = np.fromiter(map(len, keys), np.int64, len(keys))
            at = np.arange(taken.sum()) - np.repeat(taken.cumsum() - taken, taken)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.zeros(0, np.int64), *keys])),
                pa.array(np.repeat(batch.column(0).to_numpy(), taken)),
                pa.array(np.repeat(np.array(sizes, np.int32), taken)), pa.array(at.astype(np.int32)),
                *[pa.array(np.repeat(c, taken)) for c in np.concatenate(sketches).T],
            ], schema=schema)

    return texts.select("hash", "line").mapInArrow(
        run, "key long, hash long, size int, at int, " + ", ".join(f"{n} long" for n in SKETCH))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each class, as one bit."""
    odd = np.bincount((shingles >> 18) & (64 * len(SKETCH) - 1), minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def crossing(postings: DataFrame, roots: DataFrame, least: float, leaders: bool) -> DataFrame:
    """Pairs ``a, b`` of paragraphs of different clusters that can have a similarity of ``least``.

    ``postings`` are ``rare_shingles`` and ``roots`` (``node, root``) the clusters so far. With
    ``leaders``, a long posting's rows meet only the first row of each cluster in it.
    """
    named = lookup_join(postings, roots.select(F.col("node").alias("hash"), "root"), ["hash"], "left", salt_by=["key"])
    columns = ["root", "hash", "size", "at", *SKETCH]
    rows = named.select("key", F.coalesce("root", "hash").alias("root"), *columns[1:])
    counts = materialize(rows.groupBy("key").agg(
        F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("mixed")).filter(F.col("n") > BUCKET_ROWS))
    if not counts.isEmpty():
        # Each part of a long posting meets each part in a task of its own; one cluster alone needs none.
        parts = F.coalesce(F.ceil(F.col("n") / BUCKET_ROWS), F.lit(1)).cast("long")
        part = F.pmod(F.xxhash64("hash", F.lit("part")), parts)
        rows = rows.join(F.broadcast(counts), "key", "left").filter(F.coalesce("mixed", F.lit(True))).withColumns(
            {"part": part, "parts": parts}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        split = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        rows = rows.select(F.when(F.col("parts") > 1, split).otherwise(F.col("key")).alias("key"), *columns)
    rows = rows.repartition("key").sortWithinPartitions("key", "root", "hash")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def needed(sizes: np.ndarray) -> np.ndarray:
        """Shared shingles that two sizes with this sum need."""
        return np.ceil(least / (1 + least) * sizes - 1e-9)

    def near(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, root, code, size, at, *sketches = rows
        # No earlier shingle is shared where this is the first, so all shared ones are from here on.
        rest = np.minimum(size[a] - at[a], size[b] - at[b])
        good = (root[a] != root[b]) & (rest >= needed(size[a] + size[b]))
        good &= np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[good], b[good]
        # Two sketches differ in no more bits than the paragraphs in shingles.
        apart = sum(np.bitwise_count((s[a] ^ s[b]).view(np.uint64)).astype(np.int64) for s in sketches)
        close = apart <= size[a] + size[b] - 2 * needed(size[a] + size[b])
        x, y = code[a[close]], code[b[close]]
        return np.minimum(x, y), np.maximum(x, y)

    def pairs_of(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, root, _, size, at = rows[:5]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        mixed = root[starts] != root[ends - 1]
        for low, high in zip(starts[mixed & (ends - starts > SHORT)], ends[mixed & (ends - starts > SHORT)]):
            here = np.arange(low, high)
            if leaders:
                chosen = here[np.concatenate([[True], root[low + 1:high] != root[low:high - 1]])]
            else:
                # The smaller of two similar paragraphs has the shared shingle this early.
                chosen = here[size[here] - at[here] >= needed(2 * size[here])]
            step = max(1, (1 << 20) // len(here))
            for i in range(0, len(chosen), step):
                some = chosen[i:i + step]
                yield near(rows, np.repeat(some, len(here)), np.tile(here, len(some)))
        few = np.repeat(mixed & (ends - starts <= SHORT), ends - starts)
        for back in range(1, SHORT if few.any() else 1):
            later = np.flatnonzero(few[back:] & (key[back:] == key[:-back])) + back
            if not len(later):
                break
            yield near(rows, later - back, later)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flushed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in pairs_of(rows) if len(rows[0]) else ():
                found = np.unique(np.stack([a, b]), axis=1)
                if found.size:
                    yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=schema)

        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            change = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
            if not len(rows[0]):
                continue
            if held and held[-1][0][-1] != rows[0][0]:
                cut = 0
            elif len(change):
                cut = int(change[-1])
            else:
                held.append(rows)
                continue
            if len(change):
                cut = int(change[-1])
            held.append([c[:cut] for c in rows])
            yield from flushed([np.concatenate(c) for c in zip(*held)])
            held = [[c[cut:] for c in rows]]
        if held:
            yield from flushed([np.concatenate(c) for c in zip(*held)])

    return rows.mapInArrow(run, "a long, b long").distinct()


def linked_paragraphs(paragraphs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """``node, root``: the components of paragraphs (``hash, words, bands``) that are similar."""
    pairs = materialize(colliding(paragraphs))
    dense = materialize(crowded(paragraphs))
    members = materialize(pairs.select(F.explode(F.array("a", "b")).alias("hash")).unionByName(dense).distinct())
    # One text that holds each member is read again, and no other.
    holders = materialize(lookup_join(paragraphs, members, ["hash"], "left_semi", broadcast_rows=MEMBER_ROWS).select("text").distinct())
    texts = materialize(lines_of(docs, members, holders))
    roots = materialize(components(verified(pairs, texts, least)))
    postings = materialize(rare_shingles(
        lookup_join(texts, dense, ["hash"], "left_semi", broadcast_rows=MEMBER_ROWS), least))
    asked = pairs
    for leaders in (True, False):
        # The first round joins what belongs to large clusters, so the second one asks for few pairs.
        found = materialize(crossing(postings, roots, least, leaders).join(asked, ["a", "b"], "left_anti"))
        more = materialize(verified(found, texts, least))
        if not more.isEmpty():
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = materialize(components(known.unionByName(more)))
        asked = asked.unionByName(found)
    return roots


def lines_of(docs: DataFrame, members: DataFrame, holders: DataFrame) -> DataFrame:
    """``hash, line`` of the paragraphs in ``members`` (``hash``), each once.

    ``holders`` (``text``) are hashes of texts that hold them all.
    """
    keyed = docs.select(text_bytes().alias("line"), _text_hash().alias("text"))
    read = lookup_join(keyed, holders, ["text"], "left_semi", broadcast_rows=MEMBER_ROWS).select("line")
    line_schema = pa.schema([("hash", pa.int64()), ("line", pa.binary())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                held, sizes, codes = [], [], []
                for text in batch.column(0).slice(low, 64):
                    for line in text.as_py().lower().split(b"\n"):
                        parts = line.split()
                        if len(parts) >= MIN_WORDS:
                            held.append(line)
                            sizes.append(len(parts))
                            codes.append(hashes_of(parts, SEED))
                if held:
                    ends = np.cumsum(sizes)
                    hashes = _unit_hashes(np.concatenate(codes), ends - np.array(sizes), ends, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes.astype(np.int64)), pa.array(held, pa.binary())], schema=line_schema)

    every = read.mapInArrow(lines, "hash long, line binary")
    return lookup_join(every, members, ["hash"], "left_semi", broadcast_rows=MEMBER_ROWS).groupBy(
        "hash").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose paragraphs' shingles have a Jaccard similarity of ``least`` or more."""
    asked = pairs.join(texts.select(F.col("hash").alias("a"), F.col("line").alias("left")), "a").join(
        texts.select(F.col("hash").alias("b"), F.col("line").alias("right")), "b").select("a", "b", "left", "right")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                one, other = shingle_set(left.as_py()), shingle_set(right.as_py())
                good.append(len(one & other) >= least * len(one | other) - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], schema=schema)

    return asked.mapInArrow(check, "a long, b long")


def merge_spans(marks: list[dict], least: int) -> list[tuple[int, int, object, bool]]:
    """``start, words, class, removed`` of the runs of marked words; removal outweighs keeping."""
    size = max(m["start"] + m["words"] for m in marks)
    state = np.zeros(size, np.int8)
    for m in sorted(marks, key=lambda m: m["removed"]):
        state[m["start"]:m["start"] + m["words"]] = 2 if m["removed"] else 1
    edges = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1], [True]]))
    spans = []
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if state[a] and b - a >= least:
            named = [m["class_id"] for m in marks
                     if m["start"] < b and m["start"] + m["words"] > a and m["removed"] == (state[a] == 2)]
            spans.append((a, b - a, min((x for x in named if x is not None), default=None), bool(state[a] == 2)))
    return spans


def repeated_spans(docs: DataFrame, least: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, first_word, n_words, class_id, removed``: repeated stretches of all documents.

    ``class_id`` is the smallest id of a document that holds the stretch's component, and
    ``removed`` says whether this occurrence goes; where it does not, it is the one kept.
    """
    stored = materialize(units(docs))
    repeated = materialize(stored.groupBy("hash").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter(
        "low < high").select("hash"))
    paragraphs = materialize(stored.filter(F.size("bands") > 0).groupBy("hash").agg(
        F.min("shingles").alias("words"), F.min("bands").alias("bands"), F.min("text").alias("text")))
    linked = linked_paragraphs(paragraphs, docs, least).withColumnRenamed("node", "hash")
    alone = repeated.join(linked, "hash", "left_anti").select("hash", F.col("hash").alias("root"))
    classed = materialize(linked.select("hash", "root").unionByName(alone))
    # Classes grow with the table, so both joins move rows by key at every size.
    held = materialize(lookup_join(stored.select("row", "doc_id", "start", "words", "hash"), classed, ["hash"],
                                   broadcast_rows=0, salt_by=["row", "start"]).drop("hash"))
    release(repeated, paragraphs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start")
    firsts = materialize(held.groupBy("root").agg(
        F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high")
    ).filter("low < high").select("root", "first"))
    marked = lookup_join(held, firsts, ["root"], broadcast_rows=0, salt_by=["row", "start"]).select(
        "row", "doc_id", F.struct(
            "start", "words", F.col("first.doc_id").alias("class_id"),
            ((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).alias("removed"),
        ).alias("mark"))
    per_doc = marked.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list("mark").alias("marks"))
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("first_word", pa.int64()), ("n_words", pa.int64()),
                        ("class_id", to_arrow_type(kind)), ("removed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(batch.column(0)[i].as_py(), *span) for i in range(batch.num_rows)
                   for span in merge_spans(batch.column(1)[i].as_py(), min_words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    return per_doc.select("doc_id", "marks").mapInArrow(
        run, f"doc_id {kind.simpleString()}, first_word long, n_words long, class_id {kind.simpleString()}, removed boolean")
