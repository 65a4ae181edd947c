"""Alignment of two tokenizers' tokens over the bytes they share, by sparse products.

A document's tokens are rows of two incidence matrices over its bytes, in compressed rows. The
product of one with the other's transpose, row by row after Gustavson, links the tokens whose
bytes overlap, and its values are the bytes they share. Offsets where tokens of both end cut
the tokens into groups; the product of the two incidence matrices of tokens and groups links
the tokens that share one.

How often a pair of ids is linked in the whole corpus is counted in hash shards, to which each
block of documents sends every distinct pair once (``blocks``); the counts return to the
blocks. The highest count of an id of the second tokenizer is one number per id of its
vocabulary. Blocks hold the tokens, so no text is encoded twice; links are made again from
them.

Rows: a null or empty text has no tokens, nor has one whose tokens' joined bytes differ from a
space and the text, for instance one that holds the second tokenizer's marker; all their
figures are zero and their groups empty. Texts of any length are encoded whole, special tokens'
strings are ordinary text. Repeated rows count as often as they appear, null ids and all
``keep`` columns stay, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fathomix.llm.blocks import (
    grouped, owners, pack, pack_ascending, per_row, placed, rows_of, squeeze, stored_by, table_bytes, table_of, unpack,
    unpack_ascending, unsqueeze, with_replies,
)
from fathomix.llm.common import per_worker, shuffle_partitions, text_bytes
from fathomix.llm.tokens import ranked
from fathomix.session import materialize

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text in a block, and in one product, whose arrays then stay in a processor's cache.
BLOCK_BYTES = 1 << 22
PART_BYTES = 1 << 17
# Distinct pairs that a shard adds up, and links of shared groups made together, about.
SHARD_PAIRS = 1 << 22
PART_LINKS = 1 << 21
MARKER = "▁"


# --- sparse matrices --------------------------------------------------------------------------


@dataclass
class Csr:
    """A matrix in compressed rows: row i holds ``values`` in ``columns`` from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of_spans(cls, sizes: np.ndarray) -> Csr:
        """Rows that take the next ``sizes`` columns each: tokens and the bytes they cover."""
        starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=starts[1:])
        total = int(starts[-1])
        return cls(starts, np.arange(total, dtype=np.int32), np.ones(total, np.int32), total)

    @classmethod
    def of_members(cls, owner: np.ndarray, width: int) -> Csr:
        """Rows with a single column each: tokens and the group they are in."""
        return cls(np.arange(len(owner) + 1), owner.astype(np.int32), np.ones(len(owner), np.int32), width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.height, dtype=np.int32), np.diff(self.starts))

    def transposed(self) -> Csr:
        if np.all(self.columns[1:] >= self.columns[:-1]):
            order = slice(None)
        else:
            order = np.argsort(self.columns, kind="stable")
        starts = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=starts[1:])
        return Csr(starts, self.row_of()[order], self.values[order], self.height)

    def rows(self, low: int, high: int) -> Csr:
        a, b = self.starts[low], self.starts[high]
        return Csr(self.starts[low:high + 1] - a, self.columns[a:b], self.values[a:b], self.width)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each row adds up the rows of ``other`` that its columns name."""
        sizes = np.diff(other.starts)[self.columns]
        row, at, value = self.row_of(), other.starts[self.columns], self.values
        if np.any(sizes != 1):
            row, value = np.repeat(row, sizes), np.repeat(value, sizes)
            at = np.repeat(at - (sizes.cumsum() - sizes), sizes) + np.arange(len(row))
        column, value = other.columns[at], value * other.values[at]
        later = row[1:] == row[:-1]
        if np.any(later & (column[1:] < column[:-1])):
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], value[order]
        first = np.ones(len(row), bool)
        first[1:] = ~later | (column[1:] != column[:-1])
        entries = np.flatnonzero(first)
        starts = np.zeros(self.height + 1, np.int64)
        np.cumsum(np.bincount(row[entries], minlength=self.height), out=starts[1:])
        return Csr(starts, column[entries], np.add.reduceat(value, entries) if len(entries) else value, other.width)


def overlaps(first: np.ndarray, second: np.ndarray) -> Csr:
    """Bytes shared by each token of the first kind and each of the second; ``first``, ``second`` are their sizes."""
    return Csr.of_spans(first).times(Csr.of_spans(second).transposed())


def groups_of(first: np.ndarray, second: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many groups the tokens of both kinds form, and the group of each token of either kind."""
    ends, other = first.cumsum(), second.cumsum()
    at = np.zeros((2, int(ends[-1]) + 1 if len(ends) else 1), bool)
    at[0, ends] = True
    at[1, other] = True
    common = at[0] & at[1]
    # A group begins after a common end.
    left, right = common[ends], common[other]
    return int(left.sum()), left.cumsum() - left, right.cumsum() - right


def shared_groups(first: np.ndarray, second: np.ndarray, count: int) -> Iterator[tuple[int, Csr]]:
    """The links of tokens in the same group, some rows of the first kind at a time with the first one's place."""
    left, right = Csr.of_members(first, count), Csr.of_members(second, count).transposed()
    reach = np.diff(right.starts)[first].cumsum()
    low = 0
    while low < len(first):
        done = reach[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(reach, done + PART_LINKS, "right")))
        yield low, left.rows(low, high).times(right)
        low = high


# --- tokens -----------------------------------------------------------------------------------


class Tokens(NamedTuple):
    """How one tokenizer encodes and joins its ids' bytes, and the length of each id's bytes."""

    encode: Callable[[str], list[int]]
    joined: Callable[[list[int]], bytes]
    sizes: np.ndarray


def first_tokens(name: str) -> Tokens:
    """A byte-level BPE; it encodes a space and the text."""
    encoding = ranked(name)
    sizes = np.zeros(encoding.max_token_value + 1, np.int64)
    for token in encoding.token_byte_values():
        sizes[encoding.encode_single_token(token)] = len(token)
    return Tokens(lambda text: encoding.encode_ordinary(" " + text), encoding.decode_bytes, sizes)


def second_tokens(name: str) -> Tokens:
    """A SentencePiece model; it puts the space itself."""
    import public_tokenizers
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))
    pieces = [
        bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i)
        else processor.id_to_piece(i).replace(MARKER, " ").encode() for i in range(processor.get_piece_size())]
    return Tokens(processor.encode_as_ids, lambda ids: b"".join(map(pieces.__getitem__, ids)),
                  np.fromiter(map(len, pieces), np.int64, len(pieces)))


def both(first: str, second: str) -> tuple[Tokens, Tokens]:
    return (per_worker(f"first {first}", lambda: first_tokens(first)),
            per_worker(f"second {second}", lambda: second_tokens(second)))


def encoded(text: str, kinds: tuple[Tokens, Tokens]) -> tuple[np.ndarray, np.ndarray] | None:
    """The text's ids of both kinds, or None unless both hold exactly its bytes."""
    if not text:
        return None
    whole = b" " + text.encode()
    out = []
    for kind in kinds:
        ids = kind.encode(text)
        if kind.joined(ids) != whole:
            return None
        out.append(np.array(ids, np.uint32))
    return out[0], out[1]


def store_blocks(docs: DataFrame, first: str, second: str, keep: tuple[str, ...], block_bytes: int) -> DataFrame:
    """``block, kept, n_a, n_b, ids_a, ids_b, bytes`` by block: rows, their counts of tokens and all tokens."""
    read = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    kept_schema = to_arrow_schema(read.select(*[F.col(f"`{c}`") for c in keep]).schema)
    out = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("kept", "n_a", "n_b", "ids_a", "ids_b")],
                     ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = both(first, second)
        block = TaskContext.get().partitionId() << 32
        kept, held, size = [], [], 0
        none = np.zeros(0, np.uint32)

        def flushed() -> pa.RecordBatch:
            row = {"block": block, "kept": squeeze(table_bytes(kept, kept_schema)), "bytes": size}
            for side, name in enumerate("ab"):
                ids = [pair[side] for pair in held]
                row[f"n_{name}"] = pack(np.array([len(x) for x in ids]))
                row[f"ids_{name}"] = pack(np.concatenate(ids))
            return pa.RecordBatch.from_pylist([row], out)

        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                text = str(value.as_buffer(), "utf-8")
                held.append(encoded(text, kinds) or (none, none))
                size += len(text) + 1
                if size >= block_bytes:
                    kept.append(batch.slice(start, i + 1 - start).select(range(len(keep))))
                    start = i + 1
                    yield flushed()
                    kept, held, size = [], [], 0
                    block += 1
            if start < batch.num_rows:
                kept.append(batch.slice(start).select(range(len(keep))))
        if held:
            yield flushed()

    return stored_by(read.mapInArrow(
        run, "block long, kept binary, n_a binary, n_b binary, ids_a binary, ids_b binary, bytes long"), "block")


class Block:
    """The tokens of one stored block, and their links part by part."""

    def __init__(self, row: dict, kinds: tuple[Tokens, Tokens]):
        self.n_a, self.n_b = unpack(row["n_a"]), unpack(row["n_b"])
        self.ids_a, self.ids_b = unpack(row["ids_a"], np.uint32), unpack(row["ids_b"], np.uint32)
        self.sizes_a, self.sizes_b = kinds[0].sizes, kinds[1].sizes
        self.vocabulary = np.uint64(len(kinds[1].sizes))

    def parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of documents of about ``PART_BYTES``, and their tokens of both kinds."""
        ends_a, ends_b = self.n_a.cumsum(), self.n_b.cumsum()
        size = np.concatenate([[0], self.sizes_a[self.ids_a].cumsum()])[ends_a]
        cuts = np.flatnonzero(np.diff(size // PART_BYTES, append=-1)) + 1
        low = 0
        for high in cuts.tolist():
            a, b = ends_a[low] - self.n_a[low], ends_b[low] - self.n_b[low]
            yield slice(low, high), self.ids_a[a:ends_a[high - 1]], self.ids_b[b:ends_b[high - 1]]
            low = high

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each link's pair of ids, and how many links each token of the first kind has."""
        linked = overlaps(self.sizes_a[a], self.sizes_b[b])
        keys = a[linked.row_of()].astype(np.uint64) * self.vocabulary + b[linked.columns].astype(np.uint64)
        return keys, np.diff(linked.starts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys ascending, and the links of each."""
        parts = [np.unique(self.links(a, b)[0], return_counts=True) for _, a, b in self.parts()]
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def spread(keys: np.ndarray) -> np.ndarray:
    """Evenly spread hashes of keys."""
    mixed = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def pair_requests(stored: DataFrame, first: str, second: str, shards: int) -> DataFrame:
    """``shard, block, keys, counts``: each block's distinct pairs, by the shard that owns them."""
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def ask(row: dict) -> Iterator[dict]:
        keys, counts = Block(row, both(first, second)).pairs()
        for shard, places in grouped(owners(spread(keys), shards)):
            yield {"shard": shard, "block": row["block"], "keys": pack_ascending(keys[places]), "counts": pack(counts[places])}

    return per_row(stored.select("block", "n_a", "n_b", "ids_a", "ids_b"), ask,
                   "shard int, block long, keys binary, counts binary", arrow)


def count_pairs(requests: DataFrame, vocabulary: int) -> DataFrame:
    """Replies (``block`` given): the corpus count of each pair asked for.

    Rows without a block: the ``highest`` count in this shard of each second id.
    """
    best = pa.struct([("id", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("reply", pa.binary()), ("highest", pa.list_(best))])

    def merge(table: pa.Table) -> pa.Table:
        asked = [unpack_ascending(x.as_py()) for x in table.column("keys")]
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
        distinct, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.bincount(at, counts, len(distinct)).astype(np.int64)
        highest = np.zeros(vocabulary, np.int64)
        np.maximum.at(highest, (distinct % np.uint64(vocabulary)).astype(np.int64), sums)
        shard, place = table.column("shard")[0].as_py(), 0
        out = [{"shard": shard, "highest": [{"id": i, "n": int(highest[i])} for i in np.flatnonzero(highest).tolist()]}]
        for block, keys in zip(table.column("block").to_pylist(), asked):
            out.append({"shard": shard, "block": block, "reply": pack(sums[at[place:place + len(keys)]])})
            place += len(keys)
        return pa.Table.from_pylist(out, schema)

    return requests.groupBy("shard").applyInArrow(
        merge, "shard int, block long, reply binary, highest array<struct<id long, n long>>")


_GROUP = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links")


class Spelling:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, sizes: tuple[int, int]):
        self.first = sizes[0]
        numbers = [*range(sizes[0]), *range(sizes[1])]
        width = len(str(max(numbers, default=0))) + 1
        # Each id followed by a comma, or by what closes its side of a group.
        self.cells = np.zeros((2, len(numbers), width), np.uint8)
        self.sizes = np.fromiter((len(str(n)) + 1 for n in numbers), np.int64, len(numbers))
        for closed in range(2):
            for i, number in enumerate(numbers):
                text = f"{number}," if not closed else f"{number}|" if i < sizes[0] else f"{number};"
                self.cells[closed, i, :len(text)] = np.frombuffer(text.encode(), np.uint8)

    def of(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, count: int, ends: np.ndarray) -> pa.Array:
        """The text of each document; ``ends`` are the ends of their groups."""
        in_a, in_b = np.bincount(group_a, minlength=count), np.bincount(group_b, minlength=count)
        before_a, before_b = np.append(0, in_a.cumsum()), np.append(0, in_b.cumsum())
        token = np.empty(len(a) + len(b), np.int64)
        closed = np.zeros(len(token), np.int64)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
        token[at_a], token[at_b] = a, b.astype(np.int64) + self.first
        closed[at_a[before_a[1:] - 1]] = 1
        closed[at_b[before_b[1:] - 1]] = 1
        text = self.cells[closed, token].ravel()
        text = text[text != 0]
        # Where each document's text ends; the last separator is cut off.
        whole = np.append(0, self.sizes[token].cumsum())[(before_a + before_b)[ends]]
        kept = np.ones(len(text), bool)
        closing = whole[np.diff(whole, prepend=0) > 0] - 1
        kept[closing] = False
        sizes = np.diff(whole, prepend=0)
        offsets = np.append(0, (sizes - (sizes > 0)).cumsum()).astype(np.int32)
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(text[kept]))


def aligned(
    docs: DataFrame, first: str = FIRST, second: str = SECOND, keep: tuple[str, ...] = ("doc_id",),
    spelt: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns, figures and ``groups array<struct<a array<int>, b array<int>>>`` of every row's ``text``.

    ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links`` (overlaps), ``n_best`` (links whose pair is
    counted as often as any of its second id), ``count_sum`` (over links) and ``n_group_links``
    (pairs that share a group). With ``spelt`` the groups are text, ``a1,a2|b1;a3|b2,b3``.
    Counting runs when this is called. ``first`` and ``second`` are paths, or names in the
    installed package.
    """
    stored = store_blocks(docs, first, second, keep, block_bytes)
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    vocabulary = len(second_tokens(second).sizes)
    # A block of text has about a twentieth of its bytes in distinct pairs.
    shards = max(shuffle_partitions(docs), -(-total // (20 * SHARD_PAIRS)))
    counted = materialize(count_pairs(pair_requests(stored, first, second, shards), vocabulary))
    # One number per id of the vocabulary.
    highest = np.zeros(vocabulary, np.int64)
    for row in counted.select(F.explode("highest").alias("h")).groupBy("h.id").agg(F.max("h.n").alias("n")).collect():
        highest[row["id"]] = row["n"]
    replies = with_replies(stored, counted.select("shard", "block", "reply"), "replies")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = both(first, second)
        spelling = per_worker(f"spelling {first} {second}", lambda: Spelling(tuple(len(t.sizes) for t in tokens))) if spelt else None
        for row in rows_of(batches):
            yield from _figures(row, tokens, shards, highest, spelling, [*keep, *_FIGURES, "groups"])

    groups = "string" if spelt else "array<struct<a array<int>, b array<int>>>"
    return replies.mapInArrow(run, ", ".join([kinds, *[f"{n} long" for n in _FIGURES], f"groups {groups}"]))


def _figures(
    row: dict, kinds: tuple[Tokens, Tokens], shards: int, highest: np.ndarray, spelling: Spelling | None, names: list[str],
) -> Iterator[pa.RecordBatch]:
    block, kept = Block(row, kinds), table_of(unsqueeze(row["kept"]))
    parts = [(docs, a, b, *block.links(a, b)) for docs, a, b in block.parts()]
    distinct, pair = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
    pair = pair.astype(np.int32)
    counts = placed(owners(spread(distinct), shards), row["replies"], unpack)
    best = (counts == highest[(distinct % block.vocabulary).astype(np.int64)]).astype(np.int64)
    done = 0
    for docs, a, b, keys, per_token in parts:
        at = pair[done:done + len(keys)]
        done += len(keys)
        n_a, n_b = block.n_a[docs], block.n_b[docs]
        ends_a = n_a.cumsum()
        link_ends = np.append(0, per_token.cumsum())[ends_a]
        count, group_a, group_b = groups_of(block.sizes_a[a], block.sizes_b[b])
        group_ends = np.append(0, group_a + 1)[ends_a]
        shared = np.zeros(len(a) + 1, np.int64)
        for low, some in shared_groups(group_a, group_b, count):
            shared[low + 1:low + 1 + some.height] = np.diff(some.starts)
        figures = [n_a, n_b, _steps(group_ends), _steps(link_ends),
                   *(_steps(np.append(0, x[at].cumsum())[link_ends]) for x in (best, counts)), _steps(shared.cumsum()[ends_a])]
        if spelling:
            groups = spelling.of(a, b, group_a, group_b, count, group_ends)
        else:
            sides = [pa.ListArray.from_arrays(pa.array(_offsets(np.bincount(g, minlength=count))), pa.array(ids.astype(np.int32)))
                     for g, ids in ((group_a, a), (group_b, b))]
            groups = pa.ListArray.from_arrays(pa.array(np.append(0, group_ends).astype(np.int32)),
                                              pa.StructArray.from_arrays(sides, fields=list(_GROUP)))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                   for c in kept.slice(docs.start, docs.stop - docs.start).columns]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, figures), groups], names=names)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, sizes.cumsum()).astype(np.int32)


def _steps(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0).astype(np.int64)
