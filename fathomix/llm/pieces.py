"""SentencePiece ids by a table of distinct chunks.

The library turns a text into a marker, then the text with each space as a marker. Where no
piece holds a marker after another character, no merge crosses from such a character to a
marker, so a text's ids are those of its chunks in turn, a chunk being a run of markers and
what follows up to the next one. Documents are stored in blocks as numbers of their distinct
chunks (``blocks``); every distinct chunk of the table is segmented once, by the library, in
the shard that owns it, and the ids return to the blocks and are joined by position.

Decoding joins the library's decoding of each chunk: a chunk starts with a marker, so no run
of byte pieces goes across its edges, and the marker that decoding drops at the front of a
text is a space everywhere else.

Rows: a null or empty text has the end id alone; texts of any length are encoded whole; a
chunk may be as long as the text. Repeated rows return as often as they appear, null ids and
all ``keep`` columns are kept as they are, an empty table gives no rows, other columns are
ignored. A marker in the text itself is a space to the library and so here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fathomix.llm.blocks import (
    Numbers, by_frequency, grouped, owners_of_texts, pack, pack_texts, per_row, rows_of, squeeze, stored_by,
    table_bytes, table_of, unpack, unpack_texts, unsqueeze, with_replies,
)
from fathomix.llm.common import per_worker, shuffle_partitions, text_bytes

DEFAULT = "piece_bpe_32k.model"
MARKER = "▁"
BLOCK_CHUNKS = 1 << 22
# Requests that a shard answers, about.
SHARD_CHUNKS = 1 << 20
# Ids in one batch of results, about.
BATCH_IDS = 1 << 20

CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")


def load(model: str):
    """The processor of a model file, given by path or by its name in the installed package."""
    import public_tokenizers
    import sentencepiece

    path = model if "/" in model else public_tokenizers.path(model)
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    require_separate_chunks(processor)
    return processor


def require_separate_chunks(processor) -> None:
    """Raise unless chunks of this model can be segmented on their own."""
    for i in range(processor.get_piece_size()):
        if re.search(f"[^{MARKER}]{MARKER}", processor.id_to_piece(i)):
            raise ValueError(f"piece {i} crosses a whitespace marker; chunks are not independent")
    probe = "a  Åﬁ b\tc\n d "
    if processor.normalize(probe) != MARKER + probe.replace(" ", MARKER):
        raise ValueError("the model changes texts before segmenting them; chunks are not independent")


def chunks(text: str) -> list[str]:
    """The chunks of a text as the model sees it; their concatenation is the marked text."""
    return CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else []


def segment(processor, marked: list[str]) -> list[list[int]]:
    """The ids of each chunk."""
    # The library puts the first marker itself, but none before an empty text.
    ids = processor.encode([c[1:] for c in marked], num_threads=1)
    if MARKER in marked:
        front = processor.encode("a")
        ids[marked.index(MARKER)] = processor.encode("a ")[len(front):]
    return ids


def store_blocks(docs: DataFrame, keep: tuple[str, ...], block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """``block, kept, lengths, vocab, numbers, size`` by block: rows, chunk counts, distinct chunks, their numbers."""
    read = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("_text"))
    kept_schema = to_arrow_schema(read.select(*[F.col(f"`{c}`") for c in keep]).schema)
    out = pa.schema([("block", pa.int64()), ("kept", pa.binary()), ("lengths", pa.binary()), ("vocab", pa.binary()),
                     ("numbers", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        vocab, held, lengths, kept = Numbers(), [], [], []
        count = 0

        def flushed() -> pa.RecordBatch:
            numbers, order, _ = by_frequency(np.concatenate(held), len(vocab))
            values = list(vocab)
            return pa.RecordBatch.from_pylist([{
                "block": number, "kept": squeeze(table_bytes(kept, kept_schema)), "lengths": pack(np.array(lengths)),
                "vocab": pack_texts([values[i].encode() for i in order.tolist()]), "numbers": pack(numbers),
                "size": len(vocab),
            }], out)

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                found = chunks(str(text.as_buffer(), "utf-8"))
                held.append(np.fromiter(map(vocab.__getitem__, found), np.uint32, len(found)))
                lengths.append(len(found))
                count += len(found)
                if count >= block_chunks:
                    kept.append(batch.slice(start, i + 1 - start).select(range(len(keep))))
                    start = i + 1
                    yield flushed()
                    vocab, held, lengths, kept, count = Numbers(), [], [], [], 0
                    number += 1
            if start < batch.num_rows:
                kept.append(batch.slice(start).select(range(len(keep))))
        if lengths:
            yield flushed()

    return stored_by(read.mapInArrow(
        run, "block long, kept binary, lengths binary, vocab binary, numbers binary, size long"), "block")


def segmented(requests: DataFrame, model: str) -> DataFrame:
    """``shard, block, reply``: the ids of each request's chunks, each distinct chunk segmented once."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("reply", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        processor = per_worker(f"pieces {model}", lambda: load(model))
        distinct = Numbers()
        asked = [
            np.fromiter(map(distinct.__getitem__, texts), np.int64, len(texts))
            for texts in (unpack_texts(x.as_py()) for x in table.column("chunks"))
        ]
        ids = segment(processor, [t.decode() for t in distinct])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for one in ids for x in one), np.int64, int(sizes.sum()))
        starts = sizes.cumsum() - sizes
        replies = []
        for numbers in asked:
            lengths = sizes[numbers]
            first = np.repeat(starts[numbers] - (lengths.cumsum() - lengths), lengths)
            replies.append(_reply(lengths, flat[first + np.arange(len(first))]))
        return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array(replies, pa.binary())],
                                    schema=schema)

    return requests.groupBy("shard").applyInArrow(answer, "shard int, block long, reply binary")


def _reply(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    head = pack(lengths)
    return len(head).to_bytes(4, "little") + head + pack(ids)


def _ids(reply: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(reply[:4], "little")
    return unpack(reply[4:4 + size]), unpack(reply[4 + size:], np.uint32)


def chunk_requests(stored: DataFrame, shards: int) -> DataFrame:
    """``shard, block, chunks``: each block's distinct chunks, by the shard that owns them."""
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("chunks", pa.binary())])

    def ask(row: dict) -> Iterator[dict]:
        vocab = unpack_texts(row["vocab"])
        for shard, places in grouped(owners_of_texts(vocab, shards)):
            yield {"shard": shard, "block": row["block"], "chunks": pack_texts([vocab[i] for i in places.tolist()])}

    return per_row(stored.select("block", "vocab"), ask, "shard int, block long, chunks binary", arrow)


def encoded(
    docs: DataFrame, model: str = DEFAULT, keep: tuple[str, ...] = ("doc_id",), end: bool = True,
    block_chunks: int = BLOCK_CHUNKS,
) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` (with the end id, if ``end``) and ``decoded`` of every row's ``text``.

    Blocks are stored when this is called. ``model`` is a path, or a name in the installed
    package; it must keep pieces within chunks, else ValueError is raised.
    """
    stored = store_blocks(docs, keep, block_chunks)
    total = stored.agg(F.sum("size")).first()[0] or 0
    shards = max(shuffle_partitions(docs), -(-total // SHARD_CHUNKS))
    replies = segmented(chunk_requests(stored, shards), model)
    fields = [docs.schema[c] for c in keep]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = per_worker(f"pieces {model}", lambda: load(model))
        last = [processor.eos_id()] if end else []
        for row in rows_of(batches):
            yield from _joined(row, processor, shards, last, [*keep, "ids", "decoded"])

    return with_replies(stored, replies, "replies").mapInArrow(run, f"{kinds}, ids array<int>, decoded string")


def _joined(row: dict, processor, shards: int, last: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A block's rows with the ids and decoded texts of their chunks joined by position."""
    kept, lengths = table_of(unsqueeze(row["kept"])), unpack(row["lengths"])
    numbers, vocab = unpack(row["numbers"], np.uint32), unpack_texts(row["vocab"])
    sizes, ids = _by_chunk(owners_of_texts(vocab, shards), row["replies"])
    del vocab
    at = sizes.cumsum() - sizes
    flat = ids.tolist()
    decoded = [" " + t for t in _decoded(processor, flat, at, sizes)]
    del flat
    ends = lengths.cumsum()
    totals = np.add.reduceat(np.append(sizes[numbers], 0), np.minimum(ends - lengths, len(numbers))) * (lengths > 0)
    cuts = np.flatnonzero(np.diff(totals.cumsum() // BATCH_IDS, append=-1)) + 1
    first = 0
    for stop in cuts.tolist():
        start = int(ends[first] - lengths[first])
        part = numbers[start:int(ends[stop - 1])]
        width = sizes[part]
        shift = np.repeat(at[part] - (width.cumsum() - width), width)
        values = ids[shift + np.arange(len(shift))]
        counts = totals[first:stop]
        if last:
            values = np.insert(values, counts.cumsum(), last[0])
            counts = counts + 1
        texts, place = [], 0
        for n in lengths[first:stop].tolist():
            texts.append("".join([decoded[i] for i in part[place:place + n].tolist()])[1:])
            place += n
        offsets = np.concatenate([[0], counts.cumsum()]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [*[_whole(c) for c in kept.slice(first, stop - first).columns], listed, pa.array(texts, pa.string())],
            names=names)
        first = stop


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _by_chunk(owner: np.ndarray, replies: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each chunk of a block has, and the ids of all chunks in turn."""
    answers = {r["shard"]: _ids(r["reply"]) for r in replies or []}
    sizes = np.zeros(len(owner), np.int64)
    for shard, places in grouped(owner):
        sizes[places] = answers[shard][0]
    starts = sizes.cumsum() - sizes
    ids = np.empty(int(sizes.sum()), np.int32)
    for shard, places in grouped(owner):
        width, values = answers[shard]
        ids[np.repeat(starts[places] - (width.cumsum() - width), width) + np.arange(len(values))] = values
    return sizes, ids


def _decoded(processor, ids: list[int], starts: np.ndarray, sizes: np.ndarray) -> Iterator[str]:
    """The library's decoding of each chunk, without the marker that it drops."""
    places = list(zip(starts.tolist(), (starts + sizes).tolist()))
    for first in range(0, len(places), 10_000):
        yield from processor.decode([ids[s:e] for s, e in places[first:first + 10_000]], num_threads=1)
