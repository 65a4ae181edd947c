"""Phrases whose words stand together more often than their parts do, by counting quotient filters.

Documents are stored in blocks as numbers of their distinct words; hash shards add up the
words of a language, give each frequent one an id and answer the blocks (``blocks``). A block
then packs every run of two to four frequent words of a piece into one number of up to 128
bits, permutes it by a Feistel network, which can be undone, and keeps it in a counting
quotient filter: the leading bits are the quotient, whose run of slots two bit vectors find,
and each slot holds the full remainder and a counter. Nothing is lost, so the filter counts
exactly. The permutation spreads whatever repeats, so ranges of it are even shards; a shard
merges its blocks' filters, which are sorted alike, and undoes the permutation for what is
frequent. A phrase is no more frequent than its words and its pairs of neighbours, so words,
pairs and longer phrases are counted in this order, and the blocks are told what is frequent
before they pack the next.

Scoring is a join of the frequent phrases with themselves. A phrase cut after k words scores
``floor(scale * a / (l + r))`` with the counts of itself, its first part and its rest; its
lowest cut counts.

Rows: a null or empty text has no words, a null language is ``und``; repeated rows count as
often as they appear; texts of any length are read whole; an empty table, or one without
frequent phrases, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fathomix.llm.blocks import (
    Numbers, by_frequency, grouped, owners_of_texts, pack, pack_texts, per_row, placed, rows_of, stored_by,
    unpack, unpack_texts, with_replies,
)
from fathomix.llm.common import shuffle_partitions, text_bytes
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize

BLOCK_WORDS = 1 << 21
# Requests that a shard of words answers, and slots that a shard of phrases merges, about.
SHARD_WORDS = 1 << 20
SHARD_SLOTS = 1 << 20

# Piece ends become line feeds, tabs spaces.
_MARKS = bytes.maketrans(b"\t.,;:!?\n\x0b\x0c\r", b" " + b"\n" * 10)
_NOTHING, _BREAK = 0, 1
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def split(text: bytes) -> list[bytes]:
    """Lower-cased words, a line feed at each piece end, and empty strings that mean nothing."""
    return text.lower().translate(_MARKS).replace(b"\n", b" \n ").split(b" ")


class _Words(dict):
    """Numbers one language's words, together with those of other languages, from two on."""

    def __init__(self, lang: bytes, entries: list[bytes]):
        super().__init__({b"": _NOTHING, b"\n": _BREAK})
        self.lang, self.entries = lang, entries

    def __missing__(self, word: bytes) -> int:
        self.entries.append(word + b" " + self.lang)
        self[word] = number = len(self.entries) + 1
        return number


def store_blocks(docs: DataFrame, text: str, lang: str, block_words: int) -> DataFrame:
    """``block, vocab, counts, numbers, size, words``: distinct words with languages, and the text as numbers.

    Number 0 ends a piece; word i of ``vocab`` is number i + 1.
    """
    read = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("text"))
    out = pa.schema([("block", pa.int64()), ("vocab", pa.binary()), ("counts", pa.binary()), ("numbers", pa.binary()),
                     ("size", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        entries: list[bytes] = []
        langs: dict[bytes, _Words] = {}
        held, count = [], 0

        def flushed() -> pa.RecordBatch:
            numbers = np.concatenate(held)
            at = numbers > _BREAK
            renumbered, order, counts = by_frequency(numbers[at] - 2, len(entries))
            numbers[:] = 0
            numbers[at] = renumbered + 1
            return pa.RecordBatch.from_pylist([{
                "block": block, "vocab": pack_texts([entries[i] for i in order.tolist()]), "counts": pack(counts),
                "numbers": pack(numbers), "size": len(entries), "words": int(at.sum()),
            }], out)

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().encode()
                found = split(batch.column(1)[i].as_py())
                words = langs.get(name) or langs.setdefault(name, _Words(name, entries))
                numbers = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
                numbers = np.append(numbers[numbers != _NOTHING], _BREAK).astype(np.uint32)
                held.append(numbers)
                count += len(numbers)
                if count >= block_words:
                    yield flushed()
                    entries, langs, held, count = [], {}, [], 0
                    block += 1
        if held:
            yield flushed()

    return stored_by(read.mapInArrow(
        run, "block long, vocab binary, counts binary, numbers binary, size long, words long"), "block")


def word_requests(stored: DataFrame, shards: int) -> DataFrame:
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("vocab", pa.binary()), ("counts", pa.binary())])

    def ask(row: dict) -> Iterator[dict]:
        vocab, counts = unpack_texts(row["vocab"]), unpack(row["counts"])
        for shard, places in grouped(owners_of_texts(vocab, shards)):
            yield {"shard": shard, "block": row["block"], "vocab": pack_texts([vocab[i] for i in places.tolist()]),
                   "counts": pack(counts[places])}

    return per_row(stored.select("block", "vocab", "counts"), ask, "shard int, block long, vocab binary, counts binary", arrow)


_TOTAL = pa.struct([("lang", pa.string()), ("n", pa.int64())])
_WORD = pa.struct([("rank", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])


def count_words(requests: DataFrame, min_count: int) -> DataFrame:
    """Replies (``block`` given): the rank of each word in its shard, from 1, or 0 if it is rare.

    Rows without a block: the shard's ``frequent`` words and the ``totals`` of the languages.
    """
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("reply", pa.binary()),
                        ("frequent", pa.list_(_WORD)), ("totals", pa.list_(_TOTAL))])

    def merge(table: pa.Table) -> pa.Table:
        distinct = Numbers()
        asked = [np.fromiter(map(distinct.__getitem__, texts), np.int64, len(texts))
                 for texts in (unpack_texts(x.as_py()) for x in table.column("vocab"))]
        f = np.zeros(len(distinct), np.int64)
        for numbers, counts in zip(asked, table.column("counts")):
            f[numbers] += unpack(counts.as_py())
        entries = list(distinct)
        totals: dict[bytes, int] = {}
        for entry, n in zip(entries, f.tolist()):
            name = entry[entry.index(b" ") + 1:]
            totals[name] = totals.get(name, 0) + n
        ranks = np.zeros(len(entries), np.int64)
        frequent = sorted(np.flatnonzero(f >= min_count).tolist(), key=entries.__getitem__)
        ranks[frequent] = np.arange(1, len(frequent) + 1)
        words = []
        for rank, i in enumerate(frequent, 1):
            word, name = entries[i].split(b" ", 1)
            words.append({"rank": rank, "lang": name.decode(), "word": word.decode(), "f": int(f[i])})
        shard = table.column("shard")[0].as_py()
        out = [{"shard": shard, "frequent": words, "totals": [{"lang": k.decode(), "n": n} for k, n in totals.items()]}]
        out += [{"shard": shard, "block": block, "reply": pack(ranks[numbers])}
                for block, numbers in zip(table.column("block").to_pylist(), asked)]
        return pa.Table.from_pylist(out, schema)

    return requests.groupBy("shard").applyInArrow(
        merge, "shard int, block long, reply binary, frequent array<struct<rank long, lang string, word string, f long>>, "
               "totals array<struct<lang string, n long>>")


def words_with_ids(of_shards: DataFrame, offsets: np.ndarray) -> DataFrame:
    """``id, lang, word, f`` of the frequent words; ids run from 1 without gaps."""
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            words = pa.array(row["frequent"], _WORD)
            ids = np.arange(1, len(words) + 1) + offsets[row["shard"]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *words.flatten()[1:]], schema=schema)

    return of_shards.select("shard", "frequent").mapInArrow(run, "id long, lang string, word string, f long")


# --- packed phrases ---------------------------------------------------------------------------


def half_bits(length: int, id_bits: int) -> int:
    """Bits of either half of a packed phrase."""
    return (length * id_bits + 1) // 2


def packed(ids: Sequence[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two halves that hold the words' ids of each phrase side by side; ids have up to 32 bits."""
    width = half_bits(len(ids), id_bits)
    mask, step, rest = _mask(width), np.uint64(id_bits), np.uint64(width - id_bits)
    high = np.zeros(len(ids[0]), np.uint64)
    low = high.copy()
    for one in ids:
        high = ((high << step) | (low >> rest)) & mask
        low = ((low << step) & mask) | one.astype(np.uint64)
    return high, low


def unpacked(high: np.ndarray, low: np.ndarray, length: int, id_bits: int) -> list[np.ndarray]:
    width = half_bits(length, id_bits)
    mask, step, rest = _mask(id_bits), np.uint64(id_bits), np.uint64(width - id_bits)
    out = []
    for _ in range(length):
        out.append((low & mask).astype(np.int64))
        low = (low >> step) | ((high & mask) << rest)
        high = high >> step
    return out[::-1]


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _mixed(half: np.ndarray, factor: int, width: int) -> np.ndarray:
    x = (half + np.uint64(factor >> 7)) * np.uint64(factor)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_FACTORS[0])
    return (x ^ (x >> np.uint64(32))) & _mask(width)


def permuted(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over two halves of ``width`` bits."""
    for factor in _FACTORS:
        high, low = low, high ^ _mixed(low, factor, width)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``permuted`` was given."""
    for factor in reversed(_FACTORS):
        high, low = low ^ _mixed(high, factor, width), high
    return high, low


# --- counting quotient filters ----------------------------------------------------------------


def in_order(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of fingerprints, and where each distinct one starts in it."""
    if 2 * width <= 64:
        order = np.argsort((high << np.uint64(width)) | low, kind="stable")
    else:
        order = np.lexsort((low, high))
    first = np.ones(len(order), bool)
    first[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    return order, np.flatnonzero(first)


def on_each(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value of each distinct fingerprint at every place that holds it."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(starts, len(order))))
    return out


@dataclass
class QuotientFilter:
    """Distinct fingerprints of ``2 * width`` bits in ascending order, with a counter each.

    ``shard_bits`` leading bits are the same for all and not stored.
    """

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray
    width: int
    shard_bits: int = 0

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray | None, width: int, shard_bits: int = 0) -> QuotientFilter:
        """Counts equal fingerprints, or adds up their ``counts``."""
        order, starts = in_order(high, low, width)
        if counts is None:
            sums = np.diff(np.append(starts, len(high)))
        else:
            sums = np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]
        return cls(high[order[starts]], low[order[starts]], sums, width, shard_bits)

    @classmethod
    def merged(cls, filters: Sequence[QuotientFilter]) -> QuotientFilter:
        one = filters[0]
        return cls.of(*(np.concatenate([getattr(f, name) for f in filters]) for name in ("high", "low", "counts")),
                      one.width, one.shard_bits)

    def shards(self, shard_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The part of each range of leading bits that holds anything."""
        owner = self.high >> np.uint64(self.width - shard_bits)
        edges = np.searchsorted(owner, np.arange((1 << shard_bits) + 1, dtype=np.uint64))
        for shard, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if a < b:
                yield shard, QuotientFilter(self.high[a:b], self.low[a:b], self.counts[a:b], self.width, shard_bits)

    @property
    def quotient_bits(self) -> int:
        """As many quotients as slots, about."""
        return min(max(len(self.high).bit_length() - 1, 0), self.width - self.shard_bits)

    def to_bytes(self) -> bytes:
        """Occupied quotients and run ends, one bit each; the remainders' bits; counters above one."""
        size, q = len(self.high), self.quotient_bits
        rest = self.width - self.shard_bits - q
        quotients = ((self.high >> np.uint64(rest)) & _mask(q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True)
        more = self.counts > 1
        parts = [np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), _bits(self.high, rest),
                 _bits(self.low, self.width), np.packbits(more).tobytes(), pack(self.counts[more] - 2)]
        head = np.array([size, q, self.width, self.shard_bits, *map(len, parts)], "<u4")
        return head.tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes, shard: int) -> QuotientFilter:
        size, q, width, shard_bits, *lengths = np.frombuffer(data, "<u4", 10).tolist()
        parts, at = [], 40
        for length in lengths:
            parts.append(data[at:at + length])
            at += length
        occupied = np.flatnonzero(np.unpackbits(np.frombuffer(parts[0], np.uint8), count=1 << q))
        ends = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=size).astype(np.int64)
        quotients = occupied[ends.cumsum() - ends].astype(np.uint64)
        rest = width - shard_bits - q
        high = _from_bits(parts[2], rest, size) | (quotients << np.uint64(rest))
        if shard_bits:
            high |= np.uint64(shard << (width - shard_bits))
        counts = np.ones(size, np.int64)
        more = np.unpackbits(np.frombuffer(parts[4], np.uint8), count=size).astype(bool)
        counts[more] = unpack(parts[5]) + 2
        return cls(high, _from_bits(parts[3], width, size), counts, width, shard_bits)


def _bits(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other."""
    planes = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(planes[:, 64 - width:]).tobytes()


def _from_bits(data: bytes, width: int, size: int) -> np.ndarray:
    planes = np.zeros((size, 64), np.uint8)
    if width:
        planes[:, 64 - width:] = np.unpackbits(np.frombuffer(data, np.uint8), count=size * width).reshape(size, width)
    return np.packbits(planes, axis=1).view(">u8").ravel().astype(np.uint64)


# --- counting phrases -------------------------------------------------------------------------


@dataclass
class Layout:
    """How words and phrases are spread over shards."""

    offsets: np.ndarray
    word_shards: int
    id_bits: int
    shard_bits: int

    def ids(self, row: dict) -> np.ndarray:
        """The ids of a block's words in turn; 0 for rare words and piece ends."""
        owner = owners_of_texts(unpack_texts(row["vocab"]), self.word_shards)
        ranks = placed(owner, row["replies"], unpack)
        return np.concatenate([[0], np.where(ranks > 0, ranks + self.offsets[owner], 0)])[unpack(row["numbers"], np.uint32)]

    def fingerprints(self, ids: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The permuted phrases of ``length`` words that start at ``at``, and the width of their halves."""
        width = half_bits(length, self.id_bits)
        return *permuted(*packed([ids[at + j] for j in range(length)], self.id_bits), width), width

    def shards(self, counted: QuotientFilter) -> Iterator[tuple[int, QuotientFilter]]:
        return counted.shards(min(self.shard_bits, counted.width))


def pairs_at(ids: np.ndarray) -> np.ndarray:
    """Where two frequent words stand together."""
    return np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))


def pair_filters(blocks: DataFrame, layout: Layout) -> DataFrame:
    """``block, shard, filter``: each block's pairs of frequent words, as one filter per shard."""
    arrow = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("filter", pa.binary())])

    def count(row: dict) -> Iterator[dict]:
        ids = layout.ids(row)
        high, low, width = layout.fingerprints(ids, pairs_at(ids), 2)
        for shard, part in layout.shards(QuotientFilter.of(high, low, None, width)):
            yield {"block": row["block"], "shard": shard, "filter": part.to_bytes()}

    return per_row(blocks.select("block", "vocab", "numbers", "replies"), count, "block long, shard int, filter binary", arrow)


def frequent_pairs(filters: DataFrame, id_bits: int, min_count: int) -> DataFrame:
    """``ids, f`` of every pair seen at least ``min_count`` times, and replies.

    A reply (``block`` given) has one bit for each of the block's fingerprints: is it frequent?
    """
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("reply", pa.binary()), ("ids", pa.list_(pa.int64())),
                        ("f", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        held = [QuotientFilter.from_bytes(x.as_py(), shard) for x in table.column("filter")]
        high, low, counts = (np.concatenate([getattr(h, n) for h in held]) for n in ("high", "low", "counts"))
        order, starts = in_order(high, low, held[0].width)
        sums = np.add.reduceat(counts[order], starts)
        kept = sums >= min_count
        bits = np.split(on_each(kept, order, starts), np.cumsum([len(h.high) for h in held])[:-1])
        blocks = table.column("block")
        replies = pa.Table.from_pydict({
            "shard": [shard] * len(held), "block": blocks, "reply": [np.packbits(x).tobytes() for x in bits],
            "ids": pa.nulls(len(held), schema.field("ids").type), "f": pa.nulls(len(held), pa.int64())}, schema=schema)
        first = order[starts[kept]]
        found = _phrases(high[first], low[first], sums[kept], 2, id_bits)
        rows = pa.Table.from_pydict({
            "shard": [shard] * len(first), "block": pa.nulls(len(first), pa.int64()), "reply": pa.nulls(len(first), pa.binary()),
            "ids": found[0], "f": found[1]}, schema=schema)
        return pa.concat_tables([replies, rows])

    return filters.groupBy("shard").applyInArrow(merge, "shard int, block long, reply binary, ids array<long>, f long")


def longer_filters(blocks: DataFrame, layout: Layout, longest: int) -> DataFrame:
    """``length, shard, filter``: each block's longer runs whose pairs are all frequent."""
    arrow = pa.schema([("length", pa.int32()), ("shard", pa.int32()), ("filter", pa.binary())])

    def count(row: dict) -> Iterator[dict]:
        ids = layout.ids(row)
        at = pairs_at(ids)
        high, low, width = layout.fingerprints(ids, at, 2)
        order, starts = in_order(high, low, width)
        answers = {r["shard"]: r["reply"] for r in row["pairs"] or []}
        distinct = QuotientFilter(high[order[starts]], low[order[starts]], starts, width)
        bits = [np.unpackbits(np.frombuffer(answers[shard], np.uint8), count=len(part.high))
                for shard, part in layout.shards(distinct)]
        usable = np.zeros(max(len(ids) - 1, 0), bool)
        if bits:
            usable[at] = on_each(np.concatenate(bits).astype(bool), order, starts)
        pairs = usable
        for length in range(3, longest + 1):
            usable = usable[:-1] & pairs[length - 2:]
            high, low, width = layout.fingerprints(ids, np.flatnonzero(usable), length)
            for shard, part in layout.shards(QuotientFilter.of(high, low, None, width)):
                yield {"length": length, "shard": shard, "filter": part.to_bytes()}

    return per_row(blocks.select("vocab", "numbers", "replies", "pairs"), count, "length int, shard int, filter binary", arrow)


def _phrases(high: np.ndarray, low: np.ndarray, counts: np.ndarray, length: int, id_bits: int) -> list[pa.Array]:
    """``ids, f`` of fingerprints."""
    ids = np.stack(unpacked(*restored(high, low, half_bits(length, id_bits)), length, id_bits), axis=1)
    offsets = np.arange(0, ids.size + 1, length, dtype=np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.ravel())), pa.array(counts.astype(np.int64))]


def frequent_phrases(filters: DataFrame, id_bits: int, min_count: int) -> DataFrame:
    """``ids, f`` of every phrase seen at least ``min_count`` times."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        length, shard = table.column("length")[0].as_py(), table.column("shard")[0].as_py()
        every = QuotientFilter.merged([QuotientFilter.from_bytes(x.as_py(), shard) for x in table.column("filter")])
        kept = every.counts >= min_count
        return pa.Table.from_arrays(_phrases(every.high[kept], every.low[kept], every.counts[kept], length, id_bits), schema=schema)

    return filters.groupBy("length", "shard").applyInArrow(merge, "ids array<long>, f long")


def best_cuts(phrases: DataFrame, grams: DataFrame, scale: int) -> DataFrame:
    """``ids, f, score, l, r`` of each phrase's lowest cut, the first of equal ones."""
    ks = F.sequence(F.lit(1), F.size("ids") - 1)
    cuts = phrases.select("ids", "f", F.explode(ks).alias("k")).select(
        "*", F.slice("ids", F.lit(1), F.col("k")).alias("first"),
        F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    # Stored, as the next join reads its rows twice.
    cuts = materialize(lookup_join(cuts, grams.select(F.col("ids").alias("first"), F.col("f").alias("l")), ["first"], salt_by=["ids"]))
    cuts = lookup_join(cuts, grams.select(F.col("ids").alias("rest"), F.col("f").alias("r")), ["rest"], salt_by=["ids"])
    score = F.expr(f"cast({scale} as decimal(18,0)) * cast(f as decimal(19,0)) div (cast(l as decimal(20,0)) + r)")
    return cuts.groupBy("ids", "f").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")).select(
        "ids", "f", "cut.score", "cut.l", "cut.r")


def not_within_longer(phrases: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """``phrases`` but those that a longer one with ``percent`` of their count or more contains."""
    spans = F.expr("""flatten(transform(sequence(2, size(ids) - 1), n ->
        transform(sequence(1, size(ids) - n + 1), at -> slice(ids, at, n))))""")
    longer = counted.filter("size(ids) > 2").select("f", F.explode(spans).alias("ids"))
    most = longer.groupBy("ids").agg(F.max("f").alias("_most"))
    joined = phrases.join(most, "ids", "left")
    kept = f"_most IS NULL OR cast(100 as decimal(18,0)) * _most < cast({percent} as decimal(18,0)) * f"
    return joined.filter(kept).drop("_most")


def mined(
    docs: DataFrame, min_count: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, percent: int = 80,
    text: str = "text", lang: str = "lang", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of every language.

    Phrases of two to ``longest`` words (up to four) with a count ``a`` of at least
    ``min_count``; ``n`` counts all words of the language. Phrases inside a longer one with
    ``percent`` of their count go. Counting runs when this is called.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    stored = store_blocks(docs, text, lang, block_words)
    size, words = (x or 0 for x in stored.agg(F.sum("size"), F.sum("words")).first())
    shards = max(shuffle_partitions(docs), -(-size // SHARD_WORDS))
    counted = materialize(count_words(word_requests(stored, shards), min_count))
    of_shards = counted.filter("block IS NULL")
    # One number per shard: the ids that its words start after.
    sizes = np.zeros(shards + 1, np.int64)
    for row in of_shards.select("shard", F.size("frequent").alias("n")).toLocalIterator():
        sizes[row["shard"] + 1] = row["n"]
    offsets = sizes.cumsum()
    id_bits = max(1, int(offsets[-1]).bit_length())
    if id_bits > 32:
        raise ValueError("more than 2**32 frequent words")
    layout = Layout(offsets, shards, id_bits, max(shuffle_partitions(docs) - 1, words // SHARD_SLOTS).bit_length())
    dictionary = materialize(words_with_ids(of_shards, offsets))
    blocks = with_replies(stored, counted.select("shard", "block", "reply"), "replies")
    pairs = materialize(frequent_pairs(pair_filters(blocks, layout), id_bits, min_count))
    phrases = pairs.filter("block IS NULL").select("ids", "f")
    if longest > 2:
        known = with_replies(blocks, pairs.select("shard", "block", "reply"), "pairs")
        phrases = phrases.unionByName(frequent_phrases(longer_filters(known, layout, longest), id_bits, min_count))
    phrases = materialize(phrases)
    grams = materialize(dictionary.select(F.array("id").alias("ids"), "f").unionByName(phrases))
    # First what needs no cut, so that only what stays is cut.
    kept = materialize(best_cuts(materialize(not_within_longer(phrases, phrases, percent)), grams, scale))
    named = lookup_join(kept.select("*", F.posexplode("ids").alias("at", "id")), dictionary.select("id", "lang", "word"), ["id"],
                        salt_by=["ids"])
    spelt = named.groupBy("ids", F.col("f").alias("a"), "l", "r", "score").agg(
        F.first("lang").alias("lang"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelt.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    totals = of_shards.select(F.explode("totals").alias("t")).groupBy(F.col("t.lang").alias("lang")).agg(F.sum("t.n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
