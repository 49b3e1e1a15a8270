"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a vector of radius + 1 bits, not zero; for every such
vector v a mask holds the positions whose vector has an odd product with v. For
any set of at most `radius` positions some v is orthogonal to all of their
vectors, so two fingerprints that differ there only agree under v's mask: each
pair within the radius meets in some table, none is left to chance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, blocks, bounds, column, held_bits, ragged_take, shared_dir, texts, written

BITS = 64
RADIUS = 2
WORDS = 3
SEED = 42
#: Distinct fingerprints that one task compares as one bucket; larger buckets are dealt out by further bits, and nothing is left out.
BUCKET = 4096


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of each shingle, repeats included; the whole sequence if it is shorter; none without words."""
    found = text.encode().lower().split()  # bytes: A-Z alone are lowered, and \x20, \x09-\x0D alone divide
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends[:-words])], ends[words - 1 :], strict=True)]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of runs of hashes: the bits set in over half of each; zero for a run of none. Columns of hashes are taken each for itself."""
    wide = (hashes if hashes.ndim == 2 else hashes[:, None]).astype("<u8", copy=False)
    out = np.zeros((len(counts), wide.shape[1]), dtype="<u8")
    ends = bounds(counts)
    for i, n in enumerate(counts.tolist()):
        if n:
            total = np.zeros(64 * wide.shape[1], dtype=np.int64)
            for k in range(int(ends[i]), int(ends[i + 1]), 4096):
                own = np.ascontiguousarray(wide[k : min(k + 4096, int(ends[i + 1]))])
                total += np.unpackbits(own.view("u1").reshape(len(own), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * total > n, bitorder="little").view("<u8")
    return out.reshape(-1) if hashes.ndim == 1 else out


def fingerprints(documents: DataFrame, hashes: Callable[[str], list[int]] = shingle_hashes) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row, from the hashes of its features; null and blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 21):
            own = [hashes(t.as_py()) for t in column(rows, "text")]
            counts = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            flat = np.fromiter((h for hs in own for h in hs), dtype="<u8", count=int(counts.sum()))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(majorities(flat, counts).view("<i8"), pa.int64())], names=["doc_id", "fp"])

    return texts(documents).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=256)
def _covering(n: int, radius: int) -> tuple[int, ...]:
    """Masks over n positions. Vectors are dealt out in turn, or, where there are fewer positions than vectors, with the top bit set: of these two, those whose smallest mask is larger."""
    most = (1 << radius + 1) - 1
    top = 1 << radius
    dealt = ([1 + i % most for i in range(n)], [top | i % top for i in range(n)])
    found = [[sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, most + 1)] for vectors in dealt]
    return tuple(max(found, key=lambda ms: min(m.bit_count() for m in ms)))


def covering(bits: list[int], radius: int) -> list[int]:
    """2^(radius + 1) - 1 masks of these bit positions: any `radius` of them are all left out by one of the masks."""
    return [sum(1 << b for i, b in enumerate(bits) if m >> i & 1) for m in _covering(len(bits), radius)]


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks of all bit positions."""
    return covering(list(range(BITS)), radius)


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that hold about half of the free bits more, such that two fingerprints that agree under this one, and differ in `radius` bits at most, agree under one of them."""
    return sorted({mask | m for m in covering([i for i in range(BITS) if not mask >> i & 1], radius)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, smallest member) for what links of at most two differing bits connect among these distinct fingerprints, as signed longs; the smallest itself is left out.

    Few are compared with each other; of many, those are joined that agree after any two varying bits are cleared: as many sorts as there are such pairs of bits.
    """
    x = np.sort(fps.view("<u8"))
    n = len(x)
    if n <= 256 or radius != 2:
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
        a, b = np.nonzero(np.triu(near, 1))
        edges = np.stack([a, b], axis=1)
    else:
        varying = np.bitwise_or.reduce(x ^ x[0])
        bits = [np.uint64(1 << i) for i in range(BITS) if int(varying) >> i & 1]
        found = []
        for i, p in enumerate(bits):
            for q in bits[i:]:
                key = x & ~(p | q)
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                found.append(np.stack([order[:-1][same], order[1:][same]], axis=1))
        edges = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in edges.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    signed, tops = x.view("<i8").tolist(), [find(k) for k in range(n)]
    lowest: dict[int, int] = {}
    for k, t in enumerate(tops):
        lowest[t] = min(lowest.get(t, signed[k]), signed[k])
    return [(signed[k], lowest[t]) for k, t in enumerate(tops) if lowest[t] != signed[k]]


def _buckets(keyed: DataFrame, cap: int | None, radius: int) -> DataFrame:
    """tab, key, fp -> edges (a, b) of each bucket; members of buckets beyond the cap come out with a alone and their table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, key, over = 0, None, False

        def close() -> pa.RecordBatch | None:
            nonlocal held, size
            members, held, size = held, [], 0
            if not members or (not over and sum(map(len, members)) < 2):
                return None
            fps = np.concatenate(members)
            if over:
                return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(fps), pa.int32()), pa.array(fps, pa.int64()), pa.nulls(len(fps), pa.int64())], names=["tab", "a", "b"])
            pairs = linked(np.unique(fps), radius)
            return pa.RecordBatch.from_arrays([pa.array([None] * len(pairs), pa.int32()), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["tab", "a", "b"]) if pairs else None

        for batch in batches:
            tab, keys, fps = (np.asarray(batch.column(c)) for c in ("tab", "key", "fp"))
            cuts = [0, *(np.nonzero((tab[1:] != tab[:-1]) | (keys[1:] != keys[:-1]))[0] + 1).tolist(), len(tab)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = (int(tab[a]), int(keys[a]))
                if now != key:
                    if (out := close()) is not None:
                        yield out
                    key, over = now, False
                held.append(fps[a:b])
                size += b - a
                if cap and size > cap:
                    over = True
                    yield close()
        if (out := close()) is not None:
            yield out

    return keyed.repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(run, "tab int, a long, b long")


def _keyed(fps: DataFrame, tables: list[tuple[int, int]], *also: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(_signed(m)).alias("mask")) for t, m in tables]))
    return fps.select("fp", *also, each.alias("x")).select("x.tab", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp", *also)


def links(fps: DataFrame, radius: int = RADIUS, cap: int | None = BUCKET) -> DataFrame:
    """Distinct fp -> edges (a, b) that connect just what links of at most `radius` differing bits connect.

    Buckets of more than cap members are keyed anew by masks that hold about half of the
    bits that were free: so a bucket of these has 2^16 members (a quarter of the bits are free) at
    most, whatever the input.
    """
    spark = fps.sparkSession
    whole = (1 << BITS) - 1  # under it only equal fingerprints meet
    first = written(_buckets(_keyed(fps, [(t, m) for t, m in enumerate(masks(radius)) if m != whole]), cap, radius), shared_dir(spark, "simhash-edges"))
    edges = first.where("b is not null").select("a", "b")
    large = first.where("b is null").select("tab", F.col("a").alias("fp"))
    crowded = sorted(r.tab for r in large.select("tab").distinct().collect())  # at most a row a table
    for t in crowded:
        inner = large.where(F.col("tab") == t).select("fp").distinct()
        more = _keyed(inner, [(1000 * (t + 1) + k, m) for k, m in enumerate(finer(masks(radius)[t], radius))])
        edges = edges.unionByName(_buckets(more, None, radius).select("a", "b"))
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> node, root: every node that has an edge, with the smallest node that it is connected to, itself included.

    Large-star and small-star rounds, each written to the shared folder; the driver sees two numbers a round.
    """
    spark = edges.sparkSession

    def star(now: DataFrame, large: bool) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), shared_dir(spark, "stars"))
    before = None
    while before != (before := size(now)):
        now = written(star(star(now, True), False), shared_dir(spark, "stars"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = WORDS, cap: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, its own included.

    documents: doc_id, text; other columns are ignored. Null and blank texts have the
    fingerprint zero, which links like any other. Repeated rows and equal texts share a
    fingerprint and enter the search once. Null doc_ids are never a component's id unless
    it has no other. An empty table gives an empty result; texts are hashed whole.
    """
    spark = documents.sparkSession
    own = written(fingerprints(documents, partial(shingle_hashes, words=words)), shared_dir(spark, "fingerprints"))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(classes.select("fp"), radius, cap))
    return _placed(own, classes, found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(own: DataFrame, classes: DataFrame, found: DataFrame, by: str = "fp") -> DataFrame:
    """Every row and the smallest doc_id of what its fingerprint, or its column `by`, is connected to."""
    rooted = classes.join(found.withColumnRenamed("node", by), by, "left").withColumn("root", F.coalesce("root", by))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = rooted.select(by, "root").join(ids, "root").select(by, "component_id")
    return own.join(placed, by)


#: For near copies: words of a shingle, the least share of common shingles, the fingerprints of a text, and the radius within which two of one number make a candidate.
COPY_WORDS, COPY_SHARE, COPY_PRINTS, COPY_RADIUS = 5, 0.8, 8, 3
#: Bytes of text in a block of a family; a task compares the texts of two blocks.
TILE_BYTES = 2 << 20
#: Odd multipliers that make several hashes of one: the first multiples of 2^64 over the golden ratio, made odd.
_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(64)], dtype="<u8")


def several(hashes: np.ndarray, prints: int) -> np.ndarray:
    """Columns of hashes that differ from each other as those of other seeds would."""
    out = hashes[:, None] * _MULTIPLIERS[None, :prints]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def text_hashes(text: pa.Array) -> pa.Array:
    """XXH3 of each text's sequence of words: equal for texts that differ in case and white space alone."""
    found = (xxhash.xxh3_64_intdigest(b" ".join(t.as_py().encode().lower().split()), SEED) for t in text)
    return pa.array(np.fromiter(found, dtype="<u8", count=len(text)).view("<i8"), pa.int64())


def word_prints(text: pa.Array, prints: int = COPY_PRINTS) -> np.ndarray:
    """Fingerprints of each text's set of words: such a one moves little when single words change, where one of shingles moves with every shingle that holds the word."""
    number: dict[bytes, int] = {}
    own = [[number.setdefault(w, len(number)) for w in set(t.as_py().encode().lower().split())] for t in text]
    hashes = several(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), dtype="<u8", count=len(number)), prints)
    fps = np.zeros((len(text), prints), dtype="<u8")
    for i, words in enumerate(own):
        fps[i] = majorities(hashes[words], np.array([len(words)]))[0] if words else 0
    return fps


def shared(a: str, b: str, words: int = COPY_WORDS) -> float:
    """The share of the shingles of either text that both have; 1 for two texts without words."""
    one, two = (set(shingle_hashes(t, words)) for t in (a, b))
    return len(one & two) / len(one | two) if one or two else 1.0


def families(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(a, b): places of fingerprints; what these edges connect is what pairs within the radius connect."""
    x, left, out = fps.view("<u8"), np.arange(len(fps)), []
    while len(left):
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(x[left] ^ x[front.pop()]) <= radius
            found, left = left[near].tolist(), left[~near]
            out += [(root, k) for k in found]
            front += found
    return out


def within(fps: np.ndarray, one: np.ndarray, radius: int) -> np.ndarray:
    """Which of these texts have a fingerprint within the radius of that of the same number. fps: a row for each text."""
    return (np.bitwise_count(fps ^ one[None, :]) <= radius).any(axis=1)


def joined(nodes: list[int], fps: np.ndarray, sets: list[np.ndarray], radius: int, share: float) -> list[tuple[int, int]]:
    """(a, b): a forest that connects what candidates whose sorted sets share `share` connect. A pair is left out only where earlier links join it; those with most candidates come first, since they join most."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = bounds(np.bincount(ids, minlength=len(values)))
    owners = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    starts = bounds(sizes)
    degree = np.array([int(within(fps, fps[a], radius).sum()) for a in range(n)])
    group, out = np.arange(n), []
    for a in np.argsort(-degree, kind="stable").tolist():
        others = np.nonzero(group != group[a])[0]
        others = others[within(fps[others], fps[a], radius)] if len(others) else others
        if not len(others):
            continue
        if len(others) <= 8:
            common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in others])
        else:
            common = np.bincount(ragged_take(offsets, owners, ids[starts[a] : starts[a + 1]])[0], minlength=n)[others]
        union = sizes[a] + sizes[others] - common
        for b in others[common / np.maximum(union, 1) >= share].tolist():
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
                out.append((nodes[a], nodes[b]))
    return out


def _families(keyed: DataFrame, radius: int) -> DataFrame:
    """key, fp, node -> edges (a, b) between nodes that connect what pairs within the radius in one bucket connect.

    A bucket of over BUCKET members is dealt into parts, and each two of them meet in a
    task: so each pair does, and no task holds more than about BUCKET of them.
    """
    spark, cap = keyed.sparkSession, BUCKET

    def run(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False

        def close() -> pa.RecordBatch:
            fps, nodes = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, "<i8") for k in (0, 1))
            if over:
                columns = [np.full(len(fps), key), nodes, fps]
            else:
                order = np.argsort(nodes)  # the smallest node is a tree's root in every bucket, so that buckets tell the same edges
                fps, nodes = fps[order], nodes[order]
                found = np.array(families(fps, radius), dtype=np.int64).reshape(-1, 2)
                columns = [pa.nulls(len(found), pa.int64()), nodes[found[:, 0]], nodes[found[:, 1]]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "a", "b"])

        for batch in batches:
            keys, fps, nodes = (np.asarray(batch.column(c)) for c in ("key", "fp", "node"))
            cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and (now := int(keys[a])) != key:
                    if over or sum(len(h[0]) for h in held) > 1:
                        yield close()
                    key, held, over = now, [], False
                held.append((fps[a:b], nodes[a:b]))
                over = over or bool(most) and sum(len(h[0]) for h in held) > most
                if over:
                    yield close()
                    held = []
        yield close()

    def met(rows: DataFrame, most: int | None) -> DataFrame:
        return rows.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(partial(run, most=most), "key long, a long, b long")

    first = written(met(keyed, cap), shared_dir(spark, "copy-buckets"))
    found, crowded = first.where("key is null").select("a", "b"), first.where("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("fp"))
    if crowded.isEmpty():
        return found
    parts = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / cap).alias("parts"))
    pairs = crowded.join(parts, "key").withColumns({"one": F.expr("pmod(xxhash64(node), parts)"), "two": F.explode(F.expr("sequence(0L, parts - 1)"))})
    pairs = pairs.select(F.xxhash64("key", F.least("one", "two"), F.greatest("one", "two")).alias("key"), "fp", "node")
    return found.unionByName(met(pairs, None).select("a", "b"))


def near_copies(documents: DataFrame, words: int = COPY_WORDS, share: float = COPY_SHARE, prints: int = COPY_PRINTS, radius: int = COPY_RADIUS) -> DataFrame:
    """doc_id and component_id, by links between texts that share `share` of their shingles.

    A text has several fingerprints of its set of words. Two texts are candidates if those
    of any one number differ in `radius` bits at most; covering masks bring all of these
    together. What candidates connect is a family. Its texts are dealt into blocks of
    about TILE_BYTES, each two blocks meet in a tile, and there every pair of candidates
    is compared by its whole texts, unless compared texts join it already. Only texts of
    equal words in equal order count as copies unseen. Rows, nulls and repeats are treated
    as by near_duplicates(); texts without words are copies of each other.
    """
    spark = documents.sparkSession
    own = written(_copy_keys(documents, prints), shared_dir(spark, "word-fingerprints"))
    classes = written(own.groupBy("node").agg(F.min("fps").alias("fps"), F.min("doc_id").alias("first"), F.max("bytes").alias("bytes")), shared_dir(spark, "copy-classes"))
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask")) for k in range(prints) for t, m in enumerate(masks(radius))])
    each = classes.select("node", "fps", F.explode(tables).alias("x")).select("node", F.get("fps", F.col("x.k")).alias("fp"), "x")
    keyed = each.select(F.xxhash64("x.k", "x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("key"), "fp", "node")
    # a node's roots, of which there is one a table at most, are joined to the smallest of them: about as many edges as nodes are left
    roots = _families(keyed, radius).groupBy("b").agg(F.collect_set("a").alias("roots"))
    found = components(roots.select(F.explode(F.concat(F.array("b"), "roots")).alias("a"), F.array_min("roots").alias("b")).distinct())
    family = written(classes.join(found.hint("merge"), "node").select("root", "node", "fps", "bytes"), shared_dir(spark, "copy-families"))
    # written, so that the join has exchanges of its own and a large family's rows can be split
    parts = written(family.groupBy("root").agg(F.greatest(F.ceil(F.sum("bytes") / TILE_BYTES), F.lit(1)).alias("parts")), shared_dir(spark, "copy-parts"))
    dealt = family.join(parts.hint("merge"), "root").withColumns({"one": F.expr("pmod(xxhash64(node), parts)"), "two": F.explode(F.expr("sequence(0L, parts - 1)"))})
    dealt = dealt.select(F.xxhash64("root", F.least("one", "two"), F.greatest("one", "two")).alias("tile"), "node", "fps")
    return _placed(own.select("doc_id", "node"), classes.select("node", "first"), components(_compared(documents, family, dealt, words, share, prints, radius)), "node").select("doc_id", "component_id")


def _copy_keys(documents: DataFrame, prints: int) -> DataFrame:
    """doc_id, the hash of its word sequence (node), fingerprints and bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 20):
            text = column(rows, "text")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * prints, pa.int32()), pa.array(word_prints(text, prints).reshape(-1).view("<i8"), pa.int64()))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), text_hashes(text), lists, pc.cast(pc.binary_length(text), pa.int64())], names=["doc_id", "node", "fps", "bytes"])

    return texts(documents).mapInArrow(run, "doc_id long, node long, fps array<long>, bytes long")


def _node_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the texts whose node the wanted ones name (and few others): read again, behind a filter of fixed size, so that no other text is shuffled."""
    spark = documents.sparkSession
    kept = spark.sparkContext.broadcast(bit_filter(wanted.select(F.col("node").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 20):
            text = column(rows, "text")
            nodes = text_hashes(text)
            some = pa.array(held_bits(kept, np.asarray(nodes).view("<u8")))
            yield pa.RecordBatch.from_arrays([nodes.filter(some), text.filter(some).cast(pa.string())], names=["node", "text"])

    return texts(documents).select("text").mapInArrow(run, "node long, text string").dropDuplicates(["node"])


def _compared(documents: DataFrame, family: DataFrame, dealt: DataFrame, words: int, share: float, prints: int, radius: int) -> DataFrame:
    """tile, node, fps -> edges (a, b): the links within each tile, by the texts themselves."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def close() -> pa.RecordBatch:
            found = joined([h[0] for h in held], np.array([h[1] for h in held], "<i8").view("<u8"), [h[2] for h in held], radius, share) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for rows in blocks(batches, 1 << 20):
            for now, node, fps, text in zip(*(rows.column(c).to_pylist() for c in ("tile", "node", "fps", "text")), strict=True):
                if now != tile:
                    if len(held) > 1:
                        yield close()
                    tile, held = now, []
                held.append((node, fps, np.unique(np.array(shingle_hashes(text, words), dtype="<u8"))))
        yield close()

    both = dealt.join(_node_texts(documents, family).hint("merge"), "node").select("tile", "node", "fps", "text")
    return both.repartition("tile").sortWithinPartitions("tile").mapInArrow(check, "a long, b long")
