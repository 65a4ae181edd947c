"""Mixture-controlled packing of token sequences.

Every source is a queue, its documents one after the other. A window is a fixed number of
sequences; in each window the queues are served round robin, and a turn draws the queue's
quantum: the window's tokens times its target share, plus the deficit that earlier windows
left. Documents are cut where a quantum ends, so a deficit is always a fraction of a token
and each window holds its target proportions to within one token per source. A queue that
runs dry leaves its share to the others.

What a queue has drawn up to a window is therefore a function of the window alone, so the
partitions need no turn-by-turn exchange: they learn how many tokens of each queue lie before
them, which carries the deficits across windows and partitions, and place their documents by
themselves. Only token counts move; token ids stay in the partition that made them.

Rows: a null or empty text is its end token alone, a null source is a queue of its own,
repeated rows are packed as often as they appear, a null id stays null, and extra columns are
ignored. With more than ``MAX_QUEUES`` sources, hash groups of sources share the queues.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fathomix.llm.common import small_batches
from fathomix.llm.tokens import encoder
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize

MAX_QUEUES = 1024
# Pieces returned to Spark at once.
BATCH_IDS = 1 << 21


@dataclass
class Mixture:
    """Where each token of each queue goes; the same on every worker.

    ``totals`` are the queues' tokens, ``targets`` their shares (any positive scale).
    """

    totals: np.ndarray
    targets: np.ndarray
    window: int
    _bounds: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.targets = self.targets / self.targets.sum() if len(self.targets) else self.targets
        # Rounds after which queues run dry, and the tokens served until then.
        self.dry = np.unique(np.concatenate([[0.0], self.totals / self.targets]))
        self.served = np.array([np.minimum(self.targets * r, self.totals).sum() for r in self.dry])
        self.windows = -(-int(self.totals.sum()) // self.window)

    def drawn(self, window: int) -> np.ndarray:
        """Tokens that each queue has given before ``window``."""
        known = self._bounds.get(window)
        if known is None:
            if window >= self.windows:
                known = self.totals
            else:
                rounds = np.interp(float(window * self.window), self.served, self.dry)
                known = np.minimum(np.floor(self.targets * rounds + 1e-9).astype(np.int64), self.totals)
            if len(self._bounds) > 4096:
                self._bounds.clear()
            self._bounds[window] = known
        return known

    def window_of(self, queue: int, at: int) -> int:
        """The window that draws the queue's token ``at``."""
        rounds = at / self.targets[queue]
        window = min(int(np.interp(rounds, self.dry, self.served)) // self.window, self.windows - 1)
        while self.drawn(window)[queue] > at:
            window -= 1
        while self.drawn(window + 1)[queue] <= at:
            window += 1
        return window

    def pieces(self, queue: int, first: int, count: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``start, length, sequence, offset`` of ``count`` tokens from the queue's ``first`` on."""
        at, end = first, first + count
        window = self.window_of(queue, at)
        while at < end:
            now, after = self.drawn(window), self.drawn(window + 1)
            stop = min(end, int(after[queue]))
            place = int(now.sum()) + int((after - now)[:queue].sum()) + at - int(now[queue])
            while at < stop:
                take = min(stop - at, length - place % length)
                yield at - first, take, place // length, place % length
                at, place = at + take, place + take
            window += 1


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, merged: bool = False) -> DataFrame:
    """``part, row, doc_id, queue, n, before, ids``: each document's ids, and where it queues.

    ``before`` counts the queue's tokens earlier in the same partition. ``ids`` are compressed
    little-endian 16 or 32-bit numbers. Write the result once before using it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=1).compress
        part, row, queued = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            out = []
            for doc, queue, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.append(encode(text), end_id).astype(width)
                before = queued.get(queue, 0)
                queued[queue] = before + len(ids)
                out.append((part, row, doc, queue, len(ids), before, pack(ids.tobytes())))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=names
            )

    small_batches(docs)
    source = F.col("source").cast("string")
    queue = F.concat(F.lit("#"), F.pmod(F.xxhash64(source), F.lit(MAX_QUEUES))) if merged else F.coalesce(
        F.concat(F.lit("="), source), F.lit("null"))
    read = docs.select("doc_id", queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["part", "row", "doc_id", "queue", "n", "before", "ids"]
    kind = read.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), pa.int64(), to_arrow_type(read.schema["doc_id"].dataType), pa.string(), pa.int64(),
             pa.int64(), pa.binary()]
    return read.mapInArrow(
        run, f"part long, row long, doc_id {kind}, queue string, n long, before long, ids binary"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2048,
    window_sequences: int = 32,
    mixture: Mapping[str | None, float] | None = None,
    end_id: int = 1,
) -> DataFrame:
    """``doc_id, source_queue, doc_tokens, start, length, sequence_id, offset, ids`` per piece.

    ``ids`` are the piece's ids as little-endian 32-bit numbers. ``mixture`` gives each
    source's target share (the sources' own shares, if unset); every document is packed, so a
    mixture that differs from the corpus holds until its scarcest source runs dry.
    """
    sources = docs.select("source").distinct().limit(MAX_QUEUES + 1).count()
    if mixture is not None and sources > MAX_QUEUES:
        raise ValueError(f"a mixture needs at most {MAX_QUEUES} sources")
    stored = materialize(tokenize(docs, tokenizer, end_id, merged=sources > MAX_QUEUES))
    parts = materialize(stored.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    # At most MAX_QUEUES rows.
    totals = sorted((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    queues = {queue: i for i, (queue, _) in enumerate(totals)}
    counts = np.array([n for _, n in totals], np.int64)
    shares = counts.astype(float)
    if mixture is not None:
        wanted = {"null" if s is None else f"={s}": w for s, w in mixture.items()}
        if set(queues) - set(wanted) or any(not w > 0 for w in wanted.values()):
            raise ValueError("the mixture needs a positive share for every source")
        shares = np.array([wanted[queue] for queue in queues], float)
    plan = Mixture(counts, shares, length * window_sequences)

    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead")))
    placed = lookup_join(stored, offsets, ["part", "queue"], salt_by=["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        out, held = [], 0
        for batch in batches:
            for doc, queue, n, first, packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                raw = unpack(packed)
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for start, take, sequence, offset in plan.pieces(queues[queue], first, n, length):
                    out.append((doc, queue, n, start, take, sequence, offset, ids[start:start + take].tobytes()))
                    held += take
                    if held >= BATCH_IDS:
                        yield _batch(out, kinds)
                        out, held = [], 0
        if out:
            yield _batch(out, kinds)

    kind = stored.schema["doc_id"].dataType.simpleString()
    kinds = [to_arrow_type(stored.schema["doc_id"].dataType), pa.string(), *[pa.int64()] * 5, pa.binary()]
    cut = placed.select("doc_id", "queue", "n", (F.col("before") + F.col("ahead")).alias("first"), "ids")
    return cut.mapInArrow(run, f"doc_id {kind}, source_queue string, doc_tokens long, start long, length long, "
                               "sequence_id long, offset long, ids binary")


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    names = ["doc_id", "source_queue", "doc_tokens", "start", "length", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
