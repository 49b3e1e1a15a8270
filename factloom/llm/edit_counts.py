"""Token counts that follow edits.

A document keeps a segment tree: its leaves are runs of pre-tokens (their length
in code points and their number of tokens), its inner nodes the sums below. Trees
are kept in a table beside their texts. An edit goes down the kept tree to the last
leaf that it cannot reach, splits and encodes again from there to the first old leaf
border that the new split meets behind the edit, and brings up to date the sums
above the changed leaves alone; the result is kept in turn for the next edit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, bounds
from factloom.llm.pretokens import encoding, pieces_of

#: Pre-tokens in a leaf as first built.
LEAF = 64
#: Characters behind a pre-token's end that can decide where it ends.
REACH = 2

#: Node k has the children 2k and 2k + 1, leaf i is node (half the length) + i; leaves beyond n_leaves are empty.
TREE = "n_leaves int, chars array<int>, tokens array<int>"
EDITS = "array<struct<start:int,end:int,text:string>>"


def heap(leaves) -> np.ndarray:
    """The sums over leaves, from the root at 1 to the leaves in the second half."""
    n = len(leaves)
    size = 1 << max(0, (n - 1).bit_length())
    out = np.zeros(2 * size, dtype=np.int64)
    out[size : size + n] = leaves
    while size > 1:
        out[size // 2 : size] = out[size : 2 * size : 2] + out[size + 1 : 2 * size : 2]
        size //= 2
    return out


class Tree:
    """Sums of characters and tokens, as kept; nothing is added up again when it is read."""

    def __init__(self, n: int, chars: list[int], tokens: list[int]):
        self.n, self.size, self.chars, self.tokens = n, len(chars) // 2, chars, tokens

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> Tree:
        return cls(len(leaves), heap([c for c, _ in leaves]).tolist(), heap([t for _, t in leaves]).tolist())

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaf(self, i: int) -> tuple[int, int]:
        return self.chars[self.size + i], self.tokens[self.size + i]

    def at(self, place: int) -> tuple[int, int]:
        """The last leaf that starts at or before a place, and where it starts; behind the text its number of leaves and its length."""
        if place >= self.chars[1]:
            return self.n, self.chars[1]
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if place >= start + self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def set(self, i: int, chars: int, tokens: int) -> None:
        """Replaces a leaf; log n sums change."""
        k = self.size + i
        chars, tokens = chars - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k >>= 1


def _leaves(lengths: list[int], tokens: list[int], into: int = 0) -> list[tuple[int, int]]:
    """Pre-tokens as (characters, tokens) of leaves: as many leaves as asked, or of LEAF pre-tokens each."""
    n = len(lengths)
    cuts = [n * k // into for k in range(into + 1)] if into else [*range(0, n, LEAF), n]
    return [(sum(lengths[a:b]), sum(tokens[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def edited(text: str, tree: Tree, edits: list[tuple[int, int, str]], matches, count) -> tuple[str, Tree, int]:
    """New text, the tree brought up to date, and how many pre-tokens were encoded again. Edits are (start, end, new text) of the old text, in order, apart from each other.

    matches(text, from) gives the ends of pre-tokens; count(pre-token) its tokens. Leaves
    keep their number where new pre-tokens fit into those that went; only otherwise is the
    tree built anew.
    """
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    changed = "".join([*parts, text[at:]])
    again, moved, k = 0, 0, 0  # moved: new place less old place before edit k
    regions: list[tuple[int, int, list[tuple[int, int]]]] = []
    while k < len(edits):
        first, begin = tree.at(max(0, edits[k][0] - REACH))
        if first == tree.n and first:  # the edit lies behind the text, where its last leaf can still be reached
            first -= 1
            begin -= tree.leaf(first)[0]
        begin += moved
        lengths, tokens, last, stop = [], [], begin, None
        # edits up to `behind` lie before the place that the new split has reached
        behind, shift = k, moved
        for to in matches(changed, begin):
            lengths.append(to - last)
            tokens.append(count(changed[last:to]))
            last = to
            while behind < len(edits) and edits[behind][0] + shift - REACH < to:
                shift += len(edits[behind][2]) - (edits[behind][1] - edits[behind][0])
                behind += 1
            old = to - shift
            if behind > k and old >= edits[behind - 1][1]:
                i, start = tree.at(old)
                if start == old and i > first and (behind == len(edits) or edits[behind][0] - REACH >= old):
                    stop = i
                    break
        if stop is None:
            behind, stop = len(edits), tree.n
            shift = len(changed) - len(text)
        again += len(lengths)
        gone = stop - first
        keep = gone if gone and len(lengths) <= 4 * LEAF * gone and len(lengths) >= gone else 0
        regions.append((first, stop, _leaves(lengths, tokens, keep) if lengths else []))
        k, moved = behind, shift
    if all(len(fresh) == stop - first for first, stop, fresh in regions):
        for first, _, fresh in regions:
            for j, (chars, n) in enumerate(fresh):
                tree.set(first + j, chars, n)
        return changed, tree, again
    out, at = [], 0
    for first, stop, fresh in regions:
        out += [*map(tree.leaf, range(at, first)), *fresh]
        at = stop
    return changed, Tree.over([*out, *map(tree.leaf, range(at, tree.n))]), again


def ends(pattern: str):
    """(text, from) -> the ends of the pre-tokens from there."""
    found = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).finditer
    return lambda text, begin: (m.end() for m in found(text, begin))


#: Bytes of text that a task holds at once.
TEXT_BYTES = 4 << 20


class Trees:
    """The trees of a block of texts: tokens and pre-tokens of each text, and the sums of each tree."""

    def __init__(self, rows: pa.Table, encode, pattern: str):
        words, flat, counts = pieces_of(rows, pattern)
        own = np.fromiter((len(encode(w)) for w in words), dtype=np.int64, count=len(words))
        tokens, chars = own[flat], np.fromiter(map(len, words), dtype=np.int64, count=len(words))[flat]
        at = bounds(counts)
        self.counts, self.leaves = counts, (counts + LEAF - 1) // LEAF
        number = np.arange(int(self.leaves.sum())) - np.repeat(bounds(self.leaves)[:-1], self.leaves)
        cuts = np.append(np.repeat(at[:-1], self.leaves) + number * LEAF, at[-1])
        flat_chars, flat_tokens = (np.diff(bounds(x)[cuts]) for x in (chars, tokens))
        self.totals = np.diff(bounds(tokens)[at])
        ends = bounds(self.leaves).tolist()
        self.chars, self.tokens = ([heap(x[a:b]) for a, b in zip(ends, ends[1:], strict=False)] for x in (flat_chars, flat_tokens))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds(np.fromiter(map(len, rows), np.int64, len(rows))), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64), pa.int32()))


KEPT = ("n_tokens", "n_pieces", "n_leaves", "chars", "tokens")


def counted(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents' columns, n_tokens, n_pieces (pre-tokens) and their trees: the rows to keep for later edits.

    Null texts count as empty (no leaves, no tokens). All other columns stay, unless
    they are named like those that are added: those are replaced. Repeated rows
    each get a tree; an empty table gives an empty result; texts of any length are counted whole.
    """
    kept = [c for c in documents.columns if c not in KEPT]
    inner = documents.select(*kept).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema) + f", n_tokens long, n_pieces long, {TREE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for rows in blocks(batches, TEXT_BYTES):
            own = Trees(rows, encode, pattern)
            added = [pa.array(own.totals, pa.int64()), pa.array(own.counts, pa.int64()), pa.array(own.leaves, pa.int32()), _lists(own.chars), _lists(own.tokens)]
            yield from pa.table([*(rows.column(c) for c in rows.column_names), *added], names=[*rows.column_names, *KEPT]).to_batches()

    return inner.mapInArrow(run, schema)


class Counter:
    """Tokens of a piece; those met before are remembered, up to a bound."""

    def __init__(self, encode):
        self.encode, self.known = encode, {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) > 200_000:
                self.known.clear()
            n = self.known[piece] = len(self.encode(piece))
        return n


_EDITED = f"doc_id long, text string, tokens_before long, n_tokens long, n_edits int, n_encoded_again long, n_pieces long, {TREE}"
_EDITED_TYPES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int32()), ("n_encoded_again", pa.int64()), ("n_pieces", pa.int64()), ("n_leaves", pa.int32()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def _edited_row(row: dict, edits: list[tuple[int, int, str]], split, count) -> dict:
    text, tree = row["text"], Tree(row["n_leaves"], row["chars"], row["tokens"])
    if tree.chars[1] != len(text):
        raise ValueError(f"the tree of document {row['doc_id']} is of another text")
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)) or any(not 0 <= s <= e <= len(text) for s, e, _ in edits):
        raise ValueError(f"edits of document {row['doc_id']} overlap or lie outside its text")
    before = tree.total
    new, tree, again = edited(text, tree, edits, split, count) if edits else (text, tree, 0)
    return {"doc_id": row["doc_id"], "text": new, "tokens_before": before, "n_tokens": tree.total, "n_edits": len(edits), "n_encoded_again": again, "n_pieces": row["n_pieces"], "n_leaves": tree.n, "chars": tree.chars, "tokens": tree.tokens}


def apply_edits(kept: DataFrame, edits: str | Callable[[str], list[tuple[int, int, str]]], path: str, pattern: str) -> DataFrame:
    """Of rows as counted() or this function gives them: doc_id, the new text, n_tokens before and after, the number of pre-tokens encoded again (of n_pieces as first counted), and the tree.

    edits: a column of (start, end, new text) in code points of the old text (null is
    none), or a function that finds them in a text. They are taken by start; one that
    reaches back before the end of the one before it, or beyond the text, is an error, and
    so is a tree that doesn't fit its text. Documents without edits are passed on unread.
    """
    column = F.coalesce(F.col(edits).cast(EDITS), F.array().cast(EDITS)) if isinstance(edits, str) else F.array().cast(EDITS)
    inner = kept.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_pieces", "n_leaves", "chars", "tokens", column.alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = Counter(encoding(path, pattern).encode_ordinary), ends(pattern)
        for rows in blocks(batches, TEXT_BYTES):
            out = []
            for row in rows.to_pylist():
                todo = sorted((e["start"], e["end"], e["text"] or "") for e in row["edits"]) if isinstance(edits, str) else edits(row["text"])
                out.append(_edited_row(row, todo, split, count))
            yield pa.RecordBatch.from_pylist(out, _EDITED_TYPES)

    return inner.mapInArrow(run, _EDITED)
