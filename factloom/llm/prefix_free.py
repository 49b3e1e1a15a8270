"""Removal of long repeated strings by prefix-free parsing.

A rolling hash over a few bytes triggers phrase borders: a place is a trigger if its hash
is the least of a string of `length` bytes. So equal passages are parsed alike wherever
they stand, and each string has one trigger that is its own: it is the end of the phrase
before, the trigger, and the beginning of what follows in the parse. Neighbouring strings
with one trigger share a context, a few hundred bytes that are read once for all of them.

Corpus order is needed only where it isn't plain already: a context that the corpus has
twice repeats whole, and a trigger with one context repeats no further. Other contexts of
one trigger are put in the order of the phrases' ends before it (the dictionary's
suffixes, sorted) and of what follows it (the parse's suffixes, sorted), with common
lengths between neighbours. Both orders together are the corpus order of all strings of
the trigger: strings are equal if neither order parts them at their depth. A trigger with
very many contexts is divided by depth: strings that begin far before it share bytes
before it, others share more bytes after it, so each quarter of the depths falls into
smaller groups by these bytes, and so on until groups are small or depths single. What
contexts have in a part of the depths is cut to what its strings hold: pieces that are
equal repeat whole, and one of them goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, blocks, bounds, discard, held_bits, scratch, shared_dir, texts, written

#: Bytes of a string that must not repeat, and bytes that a trigger is made of (at most half of them).
LENGTH, WINDOW = 400, 32
#: Least and most bits of the filters over hashes, eight for each hash within: they only spare work, joins and orders decide.
FILTERS = (1 << 20, 1 << 29)
#: Bytes of text that are parsed at once (longer texts go piece by piece), and bytes of contexts that are ordered at once; parts that depths are divided into.
PARSED, ORDERED, WAYS = 1 << 18, 2 << 20, 4
#: Contexts that are ordered together at most; occurrences of a context from which on they are dealt out, and parts that they are dealt out to.
CROWD, HOT, DEALT = 200, 1024, 64
#: Bytes of a document whose spans are merged as one row.
CHUNK = 1 << 16
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # any odd numbers


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """A hash of the `window` bytes from each place on, by which places are compared."""
    n, power, have, rolled, own, at = len(data) - window + 1, int(_BASE), 1, None, data.astype(np.uint64), 0
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    for bit in range(window.bit_length()):  # windows of 1, 2, 4, ... bytes, joined to one of `window`; numbers wrap at 64 bits
        if window >> bit & 1:
            part = own[at : at + n]
            rolled = part if rolled is None else rolled * np.uint64(power) + part
            at += have
        own = own[:-have] * np.uint64(power) + own[have:] if len(own) > have else own[:0]
        power, have = power * power % 2**64, 2 * have
    return (rolled ^ (rolled >> np.uint64(29))) * _MIX


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` values in a row, the first of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ranked = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    ranked[: len(values)] = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    rows = ranked.reshape(-1, width)
    from_here = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    to_here = np.minimum.accumulate(rows, axis=1).ravel()
    return (np.minimum(from_here[:n], to_here[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """first, last (starts of neighbouring strings with one trigger), trigger (places), hash (of the trigger); data holds texts end to end."""
    window = min(WINDOW, length // 2)
    sizes = np.maximum(offsets[1:] - offsets[:-1] - length + 1, 0)
    starts = np.arange(int(sizes.sum())) + np.repeat(offsets[:-1] - bounds(sizes)[:-1], sizes)
    hashes = rolling(data, window)
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 3 + (hashes[:0],)
    own = least(hashes, length - window + 1)[starts]
    new = np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))
    at = np.flatnonzero(new)
    return starts[at], starts[np.append(at[1:], len(starts)) - 1], own[at], hashes[own[at]]


def _digests(view: memoryview, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """XXH3 of 128 bits of each slice, as two longs."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]), "<i8").reshape(-1, 2)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """uid, place in the text, data, offsets of texts end to end; a long text comes in pieces that overlap by what a string needs."""
    for rows in blocks(batches, PARSED):
        uid, whole = np.asarray(rows.column("uid")), rows.column("text").chunk(0)
        ends = np.frombuffer(whole.buffers()[1], "<i4", len(whole) + 1, 4 * whole.offset).astype(np.int64)
        data = np.frombuffer(whole.buffers()[2] or b"", "u1")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if len(data) <= 2 * PARSED:
            yield uid, np.zeros(len(uid), dtype=np.int64), data, ends
            continue
        for k in range(len(uid)):
            text = data[ends[k] : ends[k + 1]]
            for at in range(0, len(text), PARSED):
                own = text[at : at + PARSED + length - 1]
                yield uid[k : k + 1], np.array([at]), own, np.array([0, len(own)])


_PLACES = "run long, c1 long, c2 int, uid long, at int, width int"
_BYTES = "run long, c1 long, c2 int, before binary, trigger binary, after binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _parse(rows: DataFrame, length: int, kept=None) -> DataFrame:
    """Every context: run (hash of its trigger), c1 and c2 (96 bits of its XXH3), and its place; or its bytes, of triggers in a filter.

    96 bits tell some 10^12 contexts apart with a chance of 10^-5 that any two are mixed up.
    """
    schema, window = _BYTES if kept else _PLACES, min(WINDOW, length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, base, data, offsets in _pieces(batches, length):
            first, last, at, hashes = contexts(data, offsets, length)
            if kept:
                pick = np.flatnonzero(held_bits(kept, hashes))
                first, last, at, hashes = first[pick], last[pick], at[pick], hashes[pick]
            if not len(first):
                continue
            view = memoryview(np.ascontiguousarray(data))
            whole = _digests(view, first, last + length)
            cols = {"run": hashes.view("<i8"), "c1": whole[:, 0], "c2": whole[:, 1].astype("i4")}
            if kept:
                cut = lambda x, y: pa.array([bytes(view[i:j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary())
                cols |= {"before": cut(first, at), "trigger": cut(at, at + window), "after": cut(at + window, last + length)}
            else:
                text = np.searchsorted(offsets, first, side="right") - 1
                cols |= {"uid": uid[text], "at": (first - offsets[text] + base[text]).astype("i4"), "width": (last - first).astype("i4")}
            yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in _names(schema)], names=_names(schema))

    return rows.select("uid", "text").mapInArrow(run, schema)


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])).bit_length() + 7) // 8


def _sorted(keys: list[bytes], run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in sorted order within runs, and what each has in common with the one before it; -1 where a run begins."""
    order = np.array(sorted(range(len(keys)), key=lambda i: (run[i], keys[i])), dtype=np.int64)
    common = np.array([-1, *(_common(keys[i], keys[j]) if run[i] == run[j] else -1 for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))], dtype=np.int64)
    return order, common


def corpus_order(run: np.ndarray, size: int, before: list[bytes], after: list[bytes], length: int, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth t (bytes before the trigger): the contexts that have a string there, and a number that equal strings share.

    `before` is ordered from the trigger backwards, `after` from the trigger on. A string of
    depth t takes t bytes before and length - size - t after its trigger of `size` bytes.
    low, high: the depths that are asked for of each context.
    """
    deepest = np.minimum(high, [len(x) for x in before])
    least = np.maximum(low, length - size - np.array([len(x) for x in after]))
    ends, ends_common = _sorted([x[::-1] for x in before], run)
    begins, begins_common = _sorted(after, run)
    left, right = np.empty(len(run), dtype=np.int64), np.empty(len(run), dtype=np.int64)
    for t in range(int(least.min()), int(deepest.max()) + 1):
        active = np.flatnonzero((least <= t) & (t <= deepest))
        if len(active):
            left[ends] = np.cumsum(ends_common < t)
            right[begins] = np.cumsum(begins_common < length - t - size)
            yield t, active, left[active] * (len(run) + 1) + right[active]


_ASKED = f"{_BYTES}, n long, deep int, low int, high int, k1 long, k2 long"
_DIVIDED = f"{_ASKED}, s1 long, s2 long"
_FOUND = "c1 long, c2 int, low int, high int"


def _ordered(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts with the depths asked for, sorted by group (k1, k2), to the first and last offset of their strings that repeat in the group."""
    size = min(WINDOW, length // 2)

    def block(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: np.asarray(rows.column(c).combine_chunks())
        n, k1, k2, deepest = get("n"), get("k1"), get("k2"), get("deep")
        before, trigger, after = (rows.column(c).to_pylist() for c in ("before", "trigger", "after"))
        other = [x != y for x, y in zip(trigger[1:], trigger[:-1], strict=True)]
        own = np.cumsum(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | np.array(other, dtype=bool)))
        low, high = np.full(len(own), length), np.full(len(own), -1)
        for t, active, number in corpus_order(own, size, before, after, length, get("low"), get("high")):
            _, back = np.unique(number, return_inverse=True)
            more = active[(np.bincount(back)[back] > 1) & (n[active] == 1)]
            offset = deepest[more] - t
            low[more], high[more] = np.minimum(low[more], offset), np.maximum(high[more], offset)
        pick = np.flatnonzero(high >= 0)
        return pa.RecordBatch.from_arrays([pa.array(get("c1")[pick]), pa.array(get("c2")[pick]), pa.array(low[pick], pa.int32()), pa.array(high[pick], pa.int32())], names=_names(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("k1"))
            ends = np.flatnonzero(np.append(last is not None and last != key[0], key[1:] != key[:-1]))  # a block ends where a group ends
            sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("before"))) + np.asarray(pc.binary_length(batch.column("after"))) + 64)
            at = 0
            for c in ends.tolist():
                if bytes_held + (sizes[c - 1] if c else 0) - (sizes[at - 1] if at else 0) >= ORDERED:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    yield block(pa.Table.from_batches(held).combine_chunks())
                    held, bytes_held, at = [], 0, c
            held.append(batch.slice(at))
            bytes_held += int(sizes[-1] - (sizes[at - 1] if at else 0))
            last = key[-1]
        if held:
            yield block(pa.Table.from_batches(held).combine_chunks())

    return run


def _divided(rows: DataFrame, length: int) -> DataFrame:
    """Each context once for each part of its depths that it has strings of, cut to what these strings hold.

    k1, k2: the group, by the bytes that all strings of the part hold; only within it can
    strings be equal. s1, s2: the piece, by all bytes that are left.
    """
    size = min(WINDOW, length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, new = [], {c: [] for c in ("before", "after", "low", "high")}
            keys, pieces = [], []
            parts = (batch.column(c).to_pylist() for c in ("before", "trigger", "after", "low", "high"))
            for k, (before, trigger, after, a, b) in enumerate(zip(*parts, strict=True)):
                cuts = [a + (b - a + 1) * j // WAYS for j in range(WAYS + 1)]
                for x, y in zip(cuts, [c - 1 for c in cuts[1:]]):
                    low, high = max(x, length - size - len(after)), min(y, len(before))
                    if x > y or low > high:
                        continue
                    left, right = before[len(before) - high :], after[: length - size - low]
                    at.append(k)
                    for c, value in zip(new, (left, right, x, y), strict=True):
                        new[c].append(value)
                    keys.append(xxhash.xxh3_128_digest(b"%d %d " % (x, y) + left[len(left) - x :] + trigger + right[: length - size - y]))
                    pieces.append(xxhash.xxh3_128_digest(b"%d %d %d %d " % (x, y, low, high) + left + trigger + right))
            taken = batch.take(pa.array(at, pa.int64()))
            (k1, k2), (s1, s2) = (np.frombuffer(b"".join(d), "<i8").reshape(-1, 2).T for d in (keys, pieces))
            own = {**{c: pa.array(new[c], pa.binary()) for c in ("before", "after")}, **{c: pa.array(new[c], pa.int32()) for c in ("low", "high")}}
            own |= {c: pa.array(v.copy()) for c, v in zip(("k1", "k2", "s1", "s2"), (k1, k2, s1, s2), strict=True)}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else taken.column(c) for c in _names(_DIVIDED)], names=_names(_DIVIDED))

    return rows.mapInArrow(run, _DIVIDED)


def _passed(rows: DataFrame, column: str, kept, inside: bool = True) -> DataFrame:
    """Rows whose column is in a broadcast filter, or isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held_bits(kept, np.asarray(batch.column(column)).view("<u8")) == inside))

    return rows.mapInArrow(run, rows.schema)


def _parted(df: DataFrame, kept, key: str, by: str | None = None) -> DataFrame:
    """With `deal`: 0, but for hot keys (in a filter) a part by another column, or every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = held_bits(kept, np.asarray(batch.column(key)).view("<u8"))
            if by is None:
                times = np.where(hot, DEALT, 1)
                rows = np.repeat(np.arange(batch.num_rows), times)
                deal = np.arange(len(rows)) - np.repeat(bounds(times)[:-1], times)
                batch = batch.take(pa.array(rows))
            else:
                deal = np.where(hot, np.asarray(batch.column(by)) % DEALT, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(deal, pa.int64())], names=[*batch.schema.names, "deal"])

    return df.mapInArrow(run, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, deal long")


def _merged(rows: DataFrame, names: str) -> DataFrame:
    """A column `spans` (starts and ends in turn, any order) to spans that don't touch, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merge(x) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "spans" else pa.array(out, pa.list_(pa.int32())) for c in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, names)


def merge(spans: list[int]) -> list[int]:
    """Starts and ends in turn, to the maximal runs that they cover."""
    a, b = np.array(spans[::2], dtype=np.int64), np.array(spans[1::2], dtype=np.int64)
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > reach[:-1])
    return np.stack([a[new], reach[np.append(new[1:], True)]], axis=1).ravel().tolist()


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """uid and spans (starts and ends in turn) of the bytes to remove, from a written table of uid and text (binary); texts without any have no row."""
    spark = rows.sparkSession

    def send(hashes: DataFrame):
        size = 1 << max(0, 8 * hashes.count() - 1).bit_length()
        return spark.sparkContext.broadcast(bit_filter(hashes, min(max(size, FILTERS[0]), FILTERS[1])))

    places = written(_parse(rows, length), shared_dir(spark, "contexts"), compression="zstd")
    counts = written(places.groupBy("c1", "c2").agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("n")), shared_dir(spark, "context-counts"), compression="zstd")
    shared = written(counts.groupBy("run").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), shared_dir(spark, "shared-triggers"))
    about = _parse(rows, length, send(shared.select(F.col("run").alias("hash"))))
    about = about.groupBy(*_names(_BYTES)).agg(F.count(F.lit(1)).alias("n"))
    every = {"deep": F.octet_length("before").cast("int"), "low": F.lit(0), "high": F.lit(length - min(WINDOW, length // 2)), "k1": F.col("run"), "k2": F.lit(0).cast("long")}
    held = shared_dir(spark, "context-bytes")
    rows_of = written(about.withColumns(every).select(*_names(_ASKED)), held, compression="zstd")
    sizes = shared.select(F.col("run").alias("k1"), F.col("contexts"))
    parts, depths = spark.createDataFrame([], _FOUND), length - min(WINDOW, length // 2) + 1
    while True:
        crowds = written(sizes.where(F.col("contexts") > crowd).select(F.col("k1").alias("hash")), shared_dir(spark, "crowds"))
        many = send(crowds)
        small = _passed(rows_of, "k1", many, inside=False)
        found = small.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "trigger").mapInArrow(_ordered(length), _FOUND)
        parts = parts.unionByName(written(found, shared_dir(spark, "repeated-strings"), compression="zstd"))
        if crowds.isEmpty():
            break
        divided = written(_divided(_passed(rows_of, "k1", many), length), next_held := shared_dir(spark, "divided"), compression="zstd")
        discard(spark, held)  # of the level before
        held = next_held
        own = ["run", "trigger", "before", "after", "low", "high", "k1", "k2", "s1", "s2"]
        pieces = divided.groupBy(*own).agg(F.min("c1").alias("c1"), F.min("c2").alias("c2"), F.min("deep").alias("deep"), F.sum("n").alias("n"))
        pieces = written(pieces, shared_dir(spark, "pieces"), compression="zstd")
        # what a context has in common with others in this part of the depths repeats whole
        big = send(pieces.where(F.col("n") > hot).select(F.col("s1").alias("hash")))
        least, most = F.greatest("low", F.lit(length - min(WINDOW, length // 2)) - F.octet_length("after")), F.least("high", F.octet_length("before"))
        single = divided.where("n = 1").select("c1", "c2", (F.col("deep") - most).cast("int").alias("low"), (F.col("deep") - least).cast("int").alias("high"), "s1", "s2")
        equal = _parted(single, big, "s1", "c1").join(_parted(pieces.where("n > 1").select("s1", "s2"), big, "s1"), ["s1", "s2", "deal"])
        parts = parts.unionByName(written(equal.select("c1", "c2", "low", "high"), shared_dir(spark, "equal-pieces"), compression="zstd"))
        depths = -(-depths // WAYS)
        if depths == 1:  # a piece is one string
            break
        sizes = written(pieces.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), shared_dir(spark, "group-sizes"))
        rows_of = _passed(pieces.select(*_names(_ASKED)), "k1", send(sizes.select(F.col("k1").alias("hash"))))
    parts = parts.groupBy("c1", "c2").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = counts.where("n > 1").select("c1", "c2", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"))

    popular = send(counts.where(F.col("n") >= hot).select(F.col("c1").alias("hash")))
    left, right = _parted(places.select("c1", "c2", "uid", "at", "width"), popular, "c1", "uid"), _parted(whole.unionByName(parts), popular, "c1")
    spans = left.join(right, ["c1", "c2", "deal"]).select("uid", (F.col("at") + F.col("low")).alias("a"), (F.col("at") + F.coalesce("high", "width") + F.lit(length)).alias("b"))
    near = spans.groupBy("uid", F.floor(F.col("a") / CHUNK).alias("chunk")).agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("spans"))
    merged = _merged(near.select("uid", "spans"), "uid long, spans array<int>")
    return merged.groupBy("uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def deduplicated(documents: DataFrame, length: int = LENGTH, keep_texts: bool = False, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_texts also kept (binary) and spans (starts and ends in turn).

    A byte is removed if a string of `length` bytes that holds it begins in a second place
    too, in the same text or another; null texts are empty, equal rows are texts each, texts
    shorter than `length` stay whole, and an empty table gives an empty result. Cuts are
    between bytes, so what is kept need not be UTF-8. Other columns aren't read.
    """
    spark = documents.sparkSession
    out = shared_dir(spark, "kept-bytes")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<int>" * keep_texts
    names = _names(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, PARSED):
            own = []
            for doc_id, text, spans in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                spans = merge(spans or [])
                kept = b"".join(text[a:b] for a, b in zip([0, *spans[1::2]], [*spans[::2], len(text)], strict=True))
                own.append({"doc_id": doc_id, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": spans})
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in own], schema=_arrow(names))

    with scratch(spark):
        rows = texts(documents).select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("text"))
        rows = written(rows, shared_dir(spark, "numbered-texts"), compression="zstd")
        joined = rows.join(repeated_spans(rows, length, **limits), "uid", "left")
        return written(joined.select("doc_id", "text", "spans").mapInArrow(cut, schema), out)


def _arrow(names: list[str]) -> pa.Schema:
    kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.int32())}
    return pa.schema([(c, kinds.get(c, pa.int64())) for c in names])
