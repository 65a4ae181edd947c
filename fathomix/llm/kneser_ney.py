"""An interpolated modified Kneser-Ney bigram model, counted in Spark and scored in Spark.

Documents are cut into blocks of about a million tokens, each stored as sorted word codes
(64-bit hashes) and token positions in them. A block sends every distinct bigram once, with
its count in training texts, to the shard that owns the bigram's range of hashes. A shard
merges its blocks' arrays into the model's sorted hash array, stores it, memory-maps it and
looks up each block's bigrams in it; the counts return to the blocks. From one block per
bigram the context and continuation counts of words follow the same way. No table is ever
whole in one place: hashes spread evenly over the shards however often a word occurs, and
what moves is distinct bigrams per block, not tokens.

With discounts D1, D2, D3+ from the counts of counts of each level,
p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) p1(w), where g(h) is the mass the discounts free and
p1(w) = max(n(.w) - D', 0) / n(..) + g' / (V + 1) the discounted share of w's left
neighbours, V + 1 being the known words and one unknown. After a context never seen, p1 alone
counts. Each text starts after a begin mark, which is no token, and closes with an end token.

Rows: a null or empty text is its end token; repeated rows count and score as often as they
appear; a null id is training data; an empty table gives no rows, and without training texts
every probability is 1/(V + 1) = 1. Extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomix.llm.blocks import stored_by
from fathomix.llm.common import shuffle_partitions, small_batches, text_bytes, words
from fathomix.session import materialize

BLOCK_TOKENS = 1 << 20
# Distinct bigrams that a shard merges, about.
SHARD_BIGRAMS = 1 << 21
# Codes of the marks; words have larger ones.
BEGIN, END = 0, 1
SEED = 42
# Per word: training count, contexts' bigrams seen once, twice, more often, left neighbours.
FIELDS = 5


def word_codes(parts: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(w, SEED) for w in parts] + [END], np.uint64)
    return np.maximum(codes, np.uint64(END))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as compressed byte planes of their steps."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel().cumsum(dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed byte planes."""
    planes = values.astype("<u4").ravel().view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_numbers(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pair_hashes(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + codes
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(32))


def shard_bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's part of ascending hashes starts, and the end."""
    owner = ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))


class Block:
    """One stored block, unpacked."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.lengths = np.array(row["lengths"], np.int64)
        self.trained = np.repeat(np.array(row["trained"], bool), self.lengths)
        self.words = np.concatenate([np.array([BEGIN], np.uint64), unpack_sorted(row["vocab"])])
        self.tokens = (unpack_numbers(row["tokens"]) + 1).astype(np.int32)
        self.starts = self.lengths.cumsum() - self.lengths
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = 0

    def _pairs(self) -> np.ndarray:
        return pair_hashes(self.words[self.before], self.words[self.tokens])

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes ascending, and each position's place in them."""
        return np.unique(self._pairs(), return_inverse=True)

    def first_positions(self) -> np.ndarray:
        """A position of each distinct bigram, in the order of ``bigrams``."""
        return np.unique(self._pairs(), return_index=True)[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def store_blocks(docs: DataFrame, train: Column) -> DataFrame:
    """``block, ids, trained, lengths, vocab, tokens``, bucketed by block in the shared folder.

    ``train`` says which rows the model may count. Joins by block then move the other side only.
    """
    small_batches(docs)
    read = docs.select("doc_id", F.coalesce(train, F.lit(True)).alias("trained"), text_bytes().alias("text"))
    kind = read.schema["doc_id"].dataType
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("trained", pa.list_(pa.bool_())),
                        ("lengths", pa.list_(pa.int32())), ("vocab", pa.binary()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, trained, codes, held = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            vocab, tokens = np.unique(np.concatenate(codes), return_inverse=True)
            return _batch([{"block": number, "ids": ids, "trained": trained, "lengths": list(map(len, codes)),
                            "vocab": pack_sorted(vocab), "tokens": pack_numbers(tokens)}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                trained.append(batch.column(1)[i].as_py())
                codes.append(word_codes(words(batch.column(2)[i].as_py())))
                held += len(codes[-1])
                if held >= BLOCK_TOKENS:
                    yield flushed()
                    ids, trained, codes, held = [], [], [], 0
                    number += 1
        if codes:
            yield flushed()

    name = kind.simpleString()
    blocks = read.mapInArrow(run, f"block long, ids array<{name}>, trained array<boolean>, lengths array<int>, "
                                  "vocab binary, tokens binary")
    return stored_by(blocks, "block")


# What a shard returns: its part of the model, and its answer to each block.
_SHARD_SCHEMA = ("shard int, block long, reply binary, owned binary, model_hashes binary, model_values binary, "
                 "seen array<long>")


def _merge_shard(width: int, model_of):
    """A function that merges the sorted arrays of one shard and answers every block.

    Requests carry ``width`` numbers per hash, which are summed. ``model_of(hashes, sums)``
    gives the mask of what enters the model, and figures for the model as a whole.
    """
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("reply", pa.binary()), ("owned", pa.binary()),
                        ("model_hashes", pa.binary()), ("model_values", pa.binary()), ("seen", pa.list_(pa.int64()))])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        asked = [unpack_sorted(x.as_py()) for x in table.column("hashes")]
        counts = [unpack_numbers(x.as_py()).reshape(width, -1) for x in table.column("values")]
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(every) else order
        sums = np.add.reduceat(np.concatenate(counts, axis=1)[:, order], first, axis=1)
        chosen, seen = model_of(ordered[first], sums)
        with tempfile.TemporaryFile() as file:
            ordered[first][chosen].astype("<u8").tofile(file)
            file.flush()
            size = int(chosen.sum())
            model = np.memmap(file, "<u8", "r", shape=(size,)) if size else np.zeros(0, "<u8")
            values = sums[:, chosen]
            owner = np.zeros(len(every), bool)
            owner[order[first]] = chosen
            out = [{"shard": shard, "block": None, "model_hashes": pack_sorted(np.asarray(model, np.uint64)),
                    "model_values": pack_numbers(values), "seen": seen}]
            at = 0
            for block, hashes in zip(blocks, asked):
                place = np.searchsorted(model, hashes)
                known = place < size
                known[known] = model[place[known]] == hashes[known]
                found = np.zeros((width, len(hashes)), np.int64)
                found[:, known] = values[:, place[known]]
                out.append({"shard": shard, "block": block, "reply": pack_numbers(found),
                            "owned": np.packbits(owner[at:at + len(hashes)]).tobytes()})
                at += len(hashes)
            del model
        return pa.Table.from_pylist(out, schema)

    return merge


_REQUEST_SCHEMA = "shard int, block long, hashes binary, values binary"
_REQUEST = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("values", pa.binary())])


def _requests(block: int, hashes: np.ndarray, values: np.ndarray, shards: int) -> pa.RecordBatch:
    bounds = shard_bounds(hashes, shards)
    return _batch([
        {"shard": s, "block": block, "hashes": pack_sorted(hashes[a:b]), "values": pack_numbers(values[:, a:b])}
        for s, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if a < b
    ], _REQUEST)


def _with_replies(blocks: DataFrame, **replies: DataFrame) -> DataFrame:
    """Each block with the answers to it, in shard order, as ``name`` columns."""
    for name, table in replies.items():
        answers = table.filter("block IS NOT NULL").groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("shard", "reply", "owned"))).alias(name))
        blocks = blocks.join(answers.hint("shuffle_hash"), "block")
    return blocks


def _answer(replies: list[dict], width: int) -> np.ndarray:
    return np.concatenate([unpack_numbers(r["reply"]).reshape(width, -1) for r in replies], axis=1)


def count_bigrams(blocks: DataFrame, shards: int) -> DataFrame:
    """The bigram level: per shard sorted hashes and counts, and the counts of each block's bigrams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            hashes, places = block.bigrams()
            counts = np.bincount(places, block.trained, len(hashes)).astype(np.int64)
            yield _requests(block.block, hashes, counts[None, :], shards)

    def model_of(hashes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
        return sums[0] > 0, [int((sums[0] == n).sum()) for n in (1, 2, 3, 4)]

    asked = blocks.mapInArrow(ask, _REQUEST_SCHEMA)
    return materialize(asked.groupBy("shard").applyInArrow(_merge_shard(1, model_of), _SHARD_SCHEMA))


def count_words(blocks: DataFrame, bigrams: DataFrame, shards: int) -> DataFrame:
    """The word level: per shard sorted codes and ``FIELDS`` counts, and those of each block's words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            first = block.first_positions()
            counts = _answer(row["bigrams"], 1)[0]
            owned = np.concatenate([
                np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=unpack_numbers(r["reply"]).size)
                for r in row["bigrams"]]).astype(bool)
            context, word, counts = block.before[first][owned], block.tokens[first][owned], counts[owned]
            size = len(block.words)
            values = np.zeros((FIELDS, size), np.int64)
            values[0] = np.bincount(block.tokens[block.trained], minlength=size)
            values[0, 0] = block.trained[block.starts].sum()
            for n in (1, 2, 3):
                values[n] = np.bincount(context[np.minimum(counts, 3) == n], minlength=size)
            values[4] = np.bincount(word, minlength=size)
            yield _requests(block.block, block.words, values, shards)

    def model_of(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
        real = codes != BEGIN
        kinds = [int((sums[4][real] == n).sum()) for n in (1, 2, 3, 4)]
        return sums.any(axis=0), [*kinds, int(sums[0][real].sum()), int((sums[0][real] > 0).sum()), int(sums[4].sum())]

    asked = _with_replies(blocks, bigrams=bigrams.select("shard", "block", "reply", "owned")).mapInArrow(
        ask, _REQUEST_SCHEMA)
    return materialize(asked.groupBy("shard").applyInArrow(_merge_shard(FIELDS, model_of), _SHARD_SCHEMA))


def discounts(counts: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many entries were seen once, twice, three and four times.

    Where a count is missing, 0.5, 1 and 1.5.
    """
    if not all(counts[:4]):
        return [0.5, 1.0, 1.5]
    y = counts[0] / (counts[0] + 2 * counts[1])
    return [max(0.0, min(n, n - (n + 1) * y * counts[n] / counts[n - 1])) for n in (1, 2, 3)]


@dataclass
class Figures:
    """What the whole model needs beside its arrays."""

    bigram: list[float]
    word: list[float]
    tokens: int
    vocabulary: int
    bigrams: int

    def word_share(self, left: np.ndarray) -> np.ndarray:
        """p1 of words with so many left neighbours."""
        if not self.bigrams:
            return np.full(len(left), 1 / (self.vocabulary + 1))
        off = np.array([0.0, *self.word])[np.minimum(left, 3)]
        return np.maximum(left - off, 0) / self.bigrams + self.freed / (self.vocabulary + 1)

    freed: float = 1.0


def _figures(bigrams: DataFrame, of_words: DataFrame) -> Figures:
    def totals(table: DataFrame, width: int) -> list[int]:
        row = table.filter("seen IS NOT NULL").agg(*[F.sum(F.col("seen")[i]) for i in range(width)]).first()
        return [int(x or 0) for x in row]

    pairs, kinds = totals(bigrams, 4), totals(of_words, 7)
    figures = Figures(discounts(pairs), discounts(kinds), kinds[4], kinds[5], kinds[6])
    if figures.bigrams:
        # Words with three or more left neighbours: all known words but those with one or two.
        many = figures.vocabulary - kinds[0] - kinds[1]
        figures.freed = sum(d * n for d, n in zip(figures.word, (kinds[0], kinds[1], many))) / figures.bigrams
    return figures


def score_blocks(blocks: DataFrame, bigrams: DataFrame, of_words: DataFrame, figures: Figures) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, base_score, score`` of every document."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("trained", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            answers = _answer(row["bigrams"], 1)[0]
            d1, d2, d3 = figures.bigram
            # Per distinct bigram and word first, so that few arrays are as long as the block.
            rest = np.maximum(answers - np.array([0.0, d1, d2, d3])[np.minimum(answers, 3)], 0)
            p = rest[block.bigrams()[1]]
            count, once, twice, more, left = _answer(row["words"], FIELDS)
            total = np.maximum(count, 1)
            freed = np.where(count > 0, (d1 * once + d2 * twice + d3 * more) / total, 1.0)
            p /= total[block.before]
            p += freed[block.before] * figures.word_share(left)[block.tokens]
            np.log10(p, out=p)
            known = (count > 0)[block.tokens]
            base = np.log10((count + 0.5) / (figures.tokens + 0.5 * (figures.vocabulary + 1)))[block.tokens]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], schema.field(0).type), pa.array(row["trained"]), pa.array(block.lengths),
                pa.array(np.add.reduceat(known, block.starts, dtype=np.int64)),
                pa.array(np.add.reduceat(base, block.starts)),
                pa.array(np.add.reduceat(p, block.starts)),
            ], schema=schema)

    joined = _with_replies(blocks, bigrams=bigrams.select("shard", "block", "reply", "owned"),
                           words=of_words.select("shard", "block", "reply", "owned"))
    return joined.mapInArrow(run, f"doc_id {kind.simpleString()}, trained boolean, n_tokens long, n_known long, "
                                  "base_score double, score double")


def scores(docs: DataFrame, train: Column) -> DataFrame:
    """``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from rows where ``train`` holds. Counting runs when this is called;
    ``base_score`` is the text under single words' add-half shares.
    """
    blocks = store_blocks(docs, train)
    tokens = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    shards = max(shuffle_partitions(docs), -(-tokens // SHARD_BIGRAMS))
    bigrams = count_bigrams(blocks, shards)
    of_words = count_words(blocks, bigrams, shards)
    figures = _figures(bigrams, of_words)
    return score_blocks(blocks, bigrams, of_words, figures).withColumn("train_tokens", F.lit(figures.tokens).cast("long"))
