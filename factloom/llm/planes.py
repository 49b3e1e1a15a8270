"""Token ids in files of byte planes.

Ids of all documents stand end to end in ascending doc_id order and are cut into
blocks of a fixed number of ids. A block is transposed into its byte planes (all
lowest bytes, then all next ones ...), and each plane is compressed by zstandard
on its own: neighbouring ids differ mostly in their low plane, so the high planes
shrink to almost nothing. Under a path there are three Parquet tables, written by
Spark's committers, so a lost executor leaves no half file behind:

* chunks: part, chunk, the planes of a block, and the documents that lie in it;
* chunk_index: where each chunk's ids begin among all, their number, the sizes of
  its planes and its checksum;
* documents: doc_id, where its ids begin among all, and their number.

A range of ids, or a document, is read through the indexes: only chunks that hold
it are opened.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from factloom.llm.common import blocks, bounds, column, ragged_take, texts
from factloom.llm.pretokens import latin

#: Ids in a block.
BLOCK_IDS = 1 << 16
#: Bytes of text that a task encodes at once.
TEXT_BYTES = 8 << 20
#: Pieces of words whose ids a Python worker remembers beside those of its last block, for all blocks and tasks that it runs; others are encoded again, which changes no result.
REMEMBERED = 200_000

#: piece_docs: of each document the place in the part and in the chunk, how many ids lie here, how many there are, and whether it begins here.
_CHUNK = "part int, chunk int, first long, n_ids int, planes array<binary>, sizes array<int>, crc32 long, piece_docs array<struct<doc_id:long,ordinal:long,offset:int,n:int,of:long,begins:boolean>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("offset", pa.int32()), ("n", pa.int32()), ("of", pa.int64()), ("begins", pa.bool_())])
_CHUNK_TYPES = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("crc32", pa.int64()), ("piece_docs", pa.list_(_PIECE))])

_COMPRESSOR = zstandard.ZstdCompressor(level=3)


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls, made in one call rather than a scalar each."""
    return values.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Word (no white space inside) -> its ids, as little-endian 32-bit integers.

    Words are lowered and cut by the file's own pattern, and the library's model looks
    at each distinct piece, written by the library's byte level; that gives the ids of a
    whole text only if the file asks for just these steps, so any other file, or any
    other than a Latin letter, goes whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path) as file:
            told = json.load(file)
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (told["normalizer"] or {}).get("normalizers", ())]
        cut, *rest = (told["pre_tokenizer"] or {}).get("pretokenizers", ({},))
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.by_word = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] and (cut.get("type"), cut.get("behavior"), cut.get("invert"), rest, told["post_processor"]) == ("Split", "Removed", True, [level], None)
        if self.by_word:
            self.split = re.compile(latin(cut["pattern"]["Regex"]) + r"|\n").findall
            self.tokenize = self.whole.model.tokenize
            self.level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            self.end = self.level("\n")[0][0]
        # pieces met so far, the bounds of each one's ids, and these end to end; a line end is a piece without ids
        self.known, self.at, self.ids = pa.array(["\n"], pa.large_string()), np.zeros(2, dtype=np.int64), np.zeros(0, dtype="<u4")

    def of(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def by_bytes(self, pieces: pa.Array) -> list[str]:
        """Pieces as the byte level writes them: visible ASCII stays as it is, all others are written in one call."""
        out = strings(pieces)
        others = np.nonzero(np.asarray(pc.match_substring_regex(pieces, "[^!-~]")))[0].tolist()
        if others:
            for k, piece in zip(others, self.level("\n".join([out[k] for k in others]))[0][0].split(self.end), strict=True):
                out[k] = piece
        return out

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, end to end, and the bounds of each word's. Words hold no white space, so a line end can stand between them."""
        coded = pa.array(self.split("\n".join([*strings(words), ""]).lower()), pa.large_string()).dictionary_encode()
        pieces, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        place = pc.index_in(pieces, value_set=self.known)
        unknown = np.asarray(place.is_null())
        own, fresh = np.asarray(place.fill_null(0)).astype(np.int64), pieces.filter(pa.array(unknown))
        if len(words) and len(self.known) + len(fresh) > REMEMBERED:
            met = own[~unknown]
            self.ids, lengths = ragged_take(self.at, self.ids, met)
            self.known, self.at = self.known.take(pa.array(met)), bounds(lengths)
            own[~unknown] = np.arange(len(met))
        own[unknown] = len(self.known) + np.arange(len(fresh))
        new, lengths = array("I"), []
        for piece in self.by_bytes(fresh):
            ids = [token.id for token in self.tokenize(piece)]
            new.fromlist(ids)
            lengths.append(len(ids))
        self.known = pa.concat_arrays([self.known, fresh])
        self.at = np.append(self.at, self.at[-1] + np.cumsum(lengths, dtype=np.int64))
        self.ids = np.append(self.ids, np.frombuffer(new, dtype="<u4"))
        flat, each = ragged_take(self.at, self.ids, own[codes])
        end = pc.index(pieces, "\n").as_py()
        return flat, np.append(0, np.cumsum(each)[codes == end])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker: reading the file takes as long as a MB of text, and half of a block's pieces are those of other blocks."""
    return WordIds(path)


def encoded(text: pa.Array, words: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts end to end, and how many each has.

    The tokenizer drops white space and lets no piece cross it, so each distinct word
    of the block is looked at once. Texts with other than Latin letters are encoded as
    a whole: their normal form may reach across words, and beyond U+017F small letters
    leave the classes by which words are cut (U+0181 becomes U+0253).
    """
    odd = np.asarray(pc.match_substring_regex(text, r"[^\x00-\x{17f}]")) if words.by_word else np.ones(len(text), dtype=bool)
    parts = pc.ascii_split_whitespace(text.filter(pa.array(~odd)) if odd.any() else text)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    inner = parts.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(parts) else pa.array([], pa.large_string())
    coded = inner.dictionary_encode()
    offsets -= offsets[0]
    values, at = words.learn(coded.dictionary) if len(coded.dictionary) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
    flat, each = ragged_take(at, values, np.asarray(coded.indices).astype(np.int64))
    counts = np.diff(bounds(each)[offsets])
    if not odd.any():
        return flat, counts
    out, n, at, k = [], np.zeros(len(odd), dtype=np.int64), bounds(counts), 0
    n[~odd] = counts
    for i, is_odd in enumerate(odd.tolist()):
        if is_odd:
            out.append(words.of(text[i].as_py()))
            n[i] = len(out[-1])
        else:
            out.append(flat[at[k] : at[k + 1]])
            k += 1
    return np.concatenate(out), n


def to_planes(ids: np.ndarray) -> list[bytes]:
    return [_COMPRESSOR.compress(plane) for plane in np.ascontiguousarray(ids.astype("<u4").view("u1").reshape(-1, 4).T)]


def from_planes(planes: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.stack([np.frombuffer(zstandard.decompress(p), "u1") for p in planes], axis=1)).view("<u4").ravel()


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes documents' ids, each document's followed by end_id, under path: chunks/, chunk_index/ and documents/.

    documents: doc_id, text (null: empty; null doc_ids come first; of equal doc_ids the
    order is that of the texts' hashes, then of the texts; other columns are ignored). tokenizer: a
    file of the tokenizers library. parts: ranges of (doc_id, hash of the text), sampled
    by Spark, so rows of one doc_id, or without any, are split like others; only rows
    that agree in both stay together.
    """
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_ids(tokenizer), TaskContext.get().partitionId()
        chunk, done, ordinal, held, size, docs = 0, 0, 0, [], 0, []

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, size, docs, chunk, done
            ids = np.concatenate(held) if len(held) != 1 else held[0]
            block, rest = ids[:n], ids[n:]
            own = [{**d, "n": min(d["n"], n - d["offset"])} for d in docs]  # all of them begin before the cut
            last = docs[-1]
            over = last["offset"] + last["n"] - n
            planes = to_planes(block)
            row = {"part": part, "chunk": chunk, "first": done, "n_ids": n, "planes": planes, "sizes": list(map(len, planes)), "crc32": zlib.crc32(block.astype("<u4").tobytes()), "piece_docs": own}
            held, size, docs, chunk, done = [rest], size - n, [{**last, "offset": 0, "n": over, "begins": False}] if over else [], chunk + 1, done + n
            return pa.RecordBatch.from_pylist([row], _CHUNK_TYPES)

        for rows in blocks(batches, TEXT_BYTES):
            flat, counts = encoded(column(rows, "text"), words)
            at = bounds(counts)
            for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                n = int(counts[i]) + 1
                docs.append({"doc_id": doc_id, "ordinal": ordinal, "offset": size, "n": n, "of": n, "begins": True})
                held += [flat[at[i] : at[i + 1]], np.asarray([end_id], dtype="<u4")]
                size += n
                ordinal += 1
                while size >= block_ids:
                    yield cut(block_ids)
        if size:
            yield cut(size)

    keyed = texts(documents).withColumn("mix", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mix").asc()]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    dealt.mapInArrow(run, _CHUNK).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").drop("planes")
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # a row for each part, so at most `parts` rows in the one window, and in the broadcast
    starts = F.broadcast(sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    placed = chunks.join(starts, "part").withColumn("start", F.col("before") + F.col("first"))
    placed.select("part", "chunk", "start", "n_ids", "sizes", "crc32").write.parquet(f"{path}/chunk_index")
    each = placed.select("part", "start", F.explode("piece_docs").alias("d")).where("d.begins")
    each.select("d.doc_id", (F.col("start") + F.col("d.offset")).alias("start"), F.col("d.of").alias("n_tokens"), "part", "d.ordinal").write.parquet(f"{path}/documents")


def read_range(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """start, ids: the runs of ids from place `first` on, `count` in all; only chunks that the index names are opened."""
    asked = spark.read.parquet(f"{path}/chunk_index").where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first))
    inside = {(r.part, r.chunk): r.start for r in asked.select("part", "chunk", "start").collect()}  # as many as `count` ids fill
    if not inside:
        return spark.createDataFrame([], "start long, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"start": [], "ids": []}
            for part, chunk, planes, crc in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "planes", "crc32")), strict=True):
                start, ids = inside[part, chunk], checked(planes, crc, part, chunk)
                a, b = max(0, first - start), min(len(ids), first + count - start)
                out["start"].append(start + a)
                out["ids"].append(ids[a:b].tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    rows = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").select("part", "chunk", "planes", "crc32")
    wanted = F.lit(False)
    for part in sorted({p for p, _ in inside}):
        own = [c for p, c in inside if p == part]
        wanted = wanted | ((F.col("part") == part) & F.col("chunk").between(min(own), max(own)))
    return rows.where(wanted).mapInArrow(run, "start long, ids array<long>")


def checked(planes: list[bytes], crc: int, part: int, chunk: int) -> np.ndarray:
    ids = from_planes(planes)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError(f"chunk {chunk} of part {part} is damaged")
    return ids


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, part, ordinal within the part, start, n_tokens and ids_crc32.

    A document within one chunk is finished in the task that reads the chunk; only
    those cut by a chunk's end send the bytes of their pieces on, which meet in order.
    """
    done = "part int, ordinal long, doc_id long, first long, n long, crc32 long"
    longs = [(k, pa.int64()) for k in ("ordinal", "doc_id", "first", "n")]

    def pieces(batches: Iterator[pa.RecordBatch], is_cut: bool) -> Iterator[pa.RecordBatch]:
        last = ("of", pa.int64()), ("bytes", pa.binary())
        schema = pa.schema([("part", pa.int32()), *longs, *(last if is_cut else [("crc32", pa.int64())])])
        for batch in batches:
            docs = batch.column("piece_docs")
            d = dict(zip((f.name for f in docs.type.value_type), docs.flatten().flatten(), strict=True))
            each = np.diff(np.asarray(docs.offsets))
            offset, n = (np.asarray(d[k]).astype(np.int64) for k in ("offset", "n"))
            mine, own, at = (n != np.asarray(d["of"])) == is_cut, [], 0
            for part, chunk, planes, crc, k in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "planes", "crc32")), each.tolist(), strict=True):
                raw = memoryview(checked(planes, crc, part, chunk)).cast("B")
                here = slice(at, at + k)
                runs = [raw[4 * a : 4 * b] for a, b in zip(offset[here][mine[here]].tolist(), (offset + n)[here][mine[here]].tolist(), strict=True)]
                own += map(bytes, runs) if is_cut else map(zlib.crc32, runs)
                at += k
            first = np.repeat(np.asarray(batch.column("first")), each) + offset
            values = [pa.array(np.repeat(np.asarray(batch.column("part")), each)), d["ordinal"], d["doc_id"], pa.array(first), pa.array(n), *([d["of"]] if is_cut else [])]
            yield pa.RecordBatch.from_arrays([*(v.filter(pa.array(mine)) for v in values), pa.array(own, schema.types[-1])], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, have, crc, key, begin = pa.schema([("part", pa.int32()), *longs, ("crc32", pa.int64())]), 0, 0, None, 0
        for batch in batches:
            out = []
            for part, ordinal, doc_id, first, n, of, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not have:
                    key, begin, crc = (part, ordinal), first, 0
                if key != (part, ordinal) or first != begin + have:
                    raise ValueError(f"document {key[1]} of part {key[0]} lacks a piece")
                have, crc = have + n, zlib.crc32(own, crc)
                if have == of:
                    out.append((part, ordinal, doc_id, begin, of, crc))
                    have = 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)
        if have:
            raise ValueError(f"document {key[1]} of part {key[0]} lacks a piece")

    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").select("part", "chunk", "first", "planes", "crc32", "piece_docs")
    whole = chunks.mapInArrow(lambda batches: pieces(batches, False), done)
    cut = chunks.mapInArrow(lambda batches: pieces(batches, True), done.replace("crc32 long", "of long, bytes binary"))
    both = whole.unionByName(cut.repartition("part", "ordinal").sortWithinPartitions("part", "ordinal", "first").mapInArrow(joined, done))
    # the first chunk of each part says where the part begins: a row for each part
    begins = spark.read.parquet(f"{path}/chunk_index").where("chunk = 0").select("part", F.col("start").alias("before"))
    return both.join(F.broadcast(begins), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc32").alias("ids_crc32"), "part", "ordinal")
