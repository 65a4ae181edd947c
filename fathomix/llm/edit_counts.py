"""Token counts that follow edits without encoding the whole text again.

A text is cut into leaves of some hundred characters at places where a letter meets a space.
No pre-token spans such a place and none looks back across it, so a leaf's tokens depend on
the leaf alone. A segment tree over the leaves sums characters and tokens. An edit finds its
leaves by descending the character sums; the leaves it touches, and neighbours as long as an
edge is no such place any more, are joined, edited and encoded again, and the sums above them
updated. Everything else keeps its count.

Rows: a null or empty text has a tree without leaves and no tokens; texts of any length are
counted whole; repeated rows are counted each; null ids and extra columns are kept. Edits are
applied together, each to the original text; they must not overlap (touching is fine) and may
insert, delete or replace, also in an empty text. A null edit list has no edits, null edits in it
are skipped, and a row whose edits cannot be applied keeps its text and names the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.common import small_batches
from fathomix.llm.tokens import encoder

LEAF_CHARS = 400
# A leaf that grows beyond so many times that is cut anew, with the whole tree.
GROWN = 8

Edit = tuple[int, int, str]


def is_edge(left: str, right: str) -> bool:
    """Whether no pre-token spans the place between two characters."""
    return right == " " and left.isalpha()


def cut(text: str) -> list[str]:
    """Leaves of a text."""
    leaves, start, size = [], 0, len(text)
    while start < size:
        at = start + LEAF_CHARS
        while at < size and not is_edge(text[at - 1], text[at]):
            at = text.find(" ", at + 1)
            if at < 0:
                at = size
        at = min(at, size)
        leaves.append(text[start:at])
        start = at
    return leaves


@dataclass
class Tree:
    """Characters and tokens of each leaf and of all spans above, root first."""

    chars: np.ndarray
    tokens: np.ndarray

    @classmethod
    def over(cls, chars: Sequence[int], tokens: Sequence[int]) -> Tree:
        slots = 1
        while slots < len(chars):
            slots *= 2
        tree = cls(np.zeros(2 * slots, np.int64), np.zeros(2 * slots, np.int64))
        for sums, leaves in ((tree.chars, chars), (tree.tokens, tokens)):
            sums[slots:slots + len(leaves)] = leaves
            level = slots
            while level > 1:
                sums[level // 2:level] = sums[level:2 * level:2] + sums[level + 1:2 * level:2]
                level //= 2
        return tree

    @property
    def slots(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where the leaf starts."""
        node, start = 1, 0
        while node < self.slots:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.slots, start

    def set_leaf(self, leaf: int, chars: int, tokens: int) -> None:
        """Give a leaf new figures and carry the change to the root."""
        node = leaf + self.slots
        more_chars, more_tokens = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2


def build(text: str, count: Callable[[str], int]) -> Tree:
    leaves = cut(text)
    return Tree.over([len(x) for x in leaves], [count(x) for x in leaves])


def edit(tree: Tree, text: str, edits: Sequence[Edit], count: Callable[[str], int]) -> tuple[Tree, str, int]:
    """The tree and text after all ``edits`` of ``text``, and how many characters were encoded again."""
    edits = sorted(edits)
    if any(b[0] < a[1] for a, b in zip(edits, edits[1:])) or any(not 0 <= s <= e <= len(text) for s, e, _ in edits):
        raise ValueError("edits must lie inside the text and not overlap")
    if not edits:
        return tree, text, 0
    regions = _regions(tree, text, edits)
    parts, at, again = [], 0, 0
    grown = False
    for low, high, leaves, inside in regions:
        parts.append(text[at:low])
        region, place = [], low
        for start, end, new in inside:
            region += [text[place:start], new]
            place = end
        region = "".join([*region, text[place:high]])
        parts.append(region)
        at = high
        again += len(region)
        grown |= len(region) > GROWN * LEAF_CHARS
        tree.set_leaf(leaves[0], len(region), count(region))
        for leaf in leaves[1:]:
            tree.set_leaf(leaf, 0, 0)
    parts.append(text[at:])
    after = "".join(parts)
    if grown:
        return build(after, count), after, len(after)
    return tree, after, again


def _regions(tree: Tree, text: str, edits: Sequence[Edit]) -> list[tuple[int, int, list[int], list[Edit]]]:
    """Runs of whole leaves whose edges stay edges, with the edits inside each."""
    regions: list[tuple[int, int, list[int], list[Edit]]] = []
    for one in edits:
        start, end, new = one
        leaf, low = tree.leaf_at(max(start - 1, 0) if start == len(text) else start)
        leaves, inside = [leaf], [one]
        high = low + int(tree.chars[leaf + tree.slots])

        def widened_left() -> None:
            nonlocal low
            before, begin = tree.leaf_at(low - 1)
            leaves.insert(0, before)
            low = begin

        while high < end:
            after, _ = tree.leaf_at(high)
            leaves.append(after)
            high += int(tree.chars[after + tree.slots])
        # An edge stays one unless an edit reaches it; then the neighbour is joined.
        while low > 0 and start <= low:
            widened_left()
        while high < len(text) and end >= high:
            after, _ = tree.leaf_at(high)
            leaves.append(after)
            high += int(tree.chars[after + tree.slots])
        while regions and regions[-1][1] >= low and (regions[-1][1] > low or _reaches(regions[-1][3], low)):
            first, last, earlier, held = regions.pop()
            leaves = earlier + [x for x in leaves if x not in earlier]
            low, high, inside = min(first, low), max(last, high), held + inside
        regions.append((low, high, leaves, inside))
    return regions


def _reaches(edits: Sequence[Edit], place: int) -> bool:
    return any(e >= place for _, e, _ in edits)


def with_trees(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` and ``leaf_chars, leaf_tokens, n_tokens``: the tree's leaves and its root."""
    small_batches(docs)
    kept = [c for c in docs.columns if c not in ("leaf_chars", "leaf_tokens", "n_tokens")]
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_counted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(tokenizer)
        for batch in batches:
            chars, tokens = [], []
            for value in batch.column(batch.num_columns - 1):
                leaves = cut(value.as_py())
                chars.append([len(x) for x in leaves])
                tokens.append([len(encode(x)) for x in leaves])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())),
                 pa.array([sum(t) for t in tokens], pa.int64())], names=[*kept, "leaf_chars", "leaf_tokens", "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    return read.mapInArrow(run, f"{kinds}, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long")


def apply_edits(
    rows: DataFrame,
    tokenizer: str,
    edits: Callable[[str], Sequence[Edit]] | str = "edits",
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    trees: bool = False,
) -> DataFrame:
    """``keep`` columns and ``n_tokens, n_edits, n_tokens_after, chars_after, chars_encoded, error`` of ``with_trees`` rows.

    ``edits`` names a column ``array<struct<start int, end int, replacement string>>`` of
    character positions, or is a function that lists a text's edits. A row whose edits overlap,
    lie outside its text or lack a position keeps its text and counts, and ``error`` says so.
    With ``trees`` the edited text, under its own name, and its ``leaf_chars, leaf_tokens``
    follow, so that the next edits can be applied to the result; ``n_tokens`` is then the
    edited text's, and ``n_tokens_before`` the earlier one.
    """
    listed = F.col(f"`{edits}`") if isinstance(edits, str) else F.lit(None).cast("string")
    read = rows.select(*[F.col(f"`{c}`") for c in keep], "n_tokens", "leaf_chars", "leaf_tokens",
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_counted"), listed.alias("_edits"))
    width = len(keep) + 1
    figures = ["n_edits", "n_tokens" if trees else "n_tokens_after", "chars_after", "chars_encoded"]
    names = [*keep, "n_tokens_before" if trees else "n_tokens", *figures, "error"]
    if trees:
        names += [text, "leaf_chars", "leaf_tokens"]
    leaves = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = encoder(tokenizer)

        def count(part: str) -> int:
            return len(encode(part))

        for batch in batches:
            out, after_edits = [], []
            for i in range(batch.num_rows):
                chars, tokens, value, given = (batch.column(width + j)[i].as_py() for j in range(4))
                error = None
                try:
                    found = edits(value) if callable(edits) else [
                        (e["start"], e["end"], e["replacement"] or "") for e in given or [] if e is not None]
                    if any(x is None for e in found for x in e):
                        raise ValueError("an edit lacks a position")
                    tree, after, again = edit(Tree.over(chars, tokens), value, found, count)
                except ValueError as wrong:
                    found, tree, after, again, error = [], Tree.over(chars, tokens), value, 0, str(wrong)
                out.append((len(found), int(tree.tokens[1]), len(after), again, error))
                if trees:
                    own = slice(tree.slots, 2 * tree.slots)
                    some = tree.chars[own] > 0
                    after_edits.append((after, tree.chars[own][some], tree.tokens[own][some]))
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
            if trees:
                columns += [pa.array(c, t) for c, t in zip(zip(*after_edits) if out else [[]] * 3, (pa.string(), leaves, leaves))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=names)

    kinds = [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, read.schema[:width])]
    kinds += [f"{n} long" for n in figures] + ["error string"]
    if trees:
        kinds += [f"`{text}` string", "leaf_chars array<int>", "leaf_tokens array<int>"]
    return read.mapInArrow(run, ", ".join(kinds))
