"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens.

1. Each block of texts is exploded into pre-tokens with positions: a list of the
   block's distinct pre-tokens and, for every text, the sequence of their numbers.
   A word that is frequent anywhere is thus one entry a block before any shuffle.
2. The distinct pre-tokens of all blocks are dealt out by their hash, a packed
   message for each block and bucket, so that each pre-token reaches one task and
   is encoded there once.
3. The ids go back to the blocks that asked, and the texts are reassembled by position.
4. Decoding joins the token-byte table by id. It is as large as the vocabulary, so it is
   broadcast, and no token becomes a row of its own: where ids are at hand as arrays,
   the join takes the table's bytes for a whole document at once.

A block's number is a hash of its content and place. If a lost executor makes a task
run again on rows in another order, numbers no longer agree, and the join of ids
refuses rather than mixes answers of two attempts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, bounds, column, ragged_take, texts
from factloom.llm.pretokens import encoding, pieces_of, token_bytes

#: Bytes of text of a block: the larger, the fewer times a frequent word is sent.
TEXT_BYTES = 4 << 20
_BLOCK = "block long, doc_ids binary, known binary, counts binary, sequence binary, words binary"
_MESSAGE = "bucket int, block long, words binary"
_ANSWER = "block long, bucket int, ids binary"
#: Distinct pre-tokens whose ids a task remembers; those that come back beyond that are encoded again, which changes no result.
REMEMBERED = 1_000_000


def _pack(pieces: list[bytes]) -> bytes:
    """Byte strings as their lengths and contents, compressed."""
    lengths = np.fromiter(map(len, pieces), dtype="<u4", count=len(pieces))
    return zstandard.compress(np.uint32(len(pieces)).tobytes() + lengths.tobytes() + b"".join(pieces), 3)


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = bounds(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def exploded(documents: DataFrame, pattern: str) -> DataFrame:
    """One row a block: its documents' ids, lengths and sequences of pre-token numbers, and its distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, rows in enumerate(blocks(batches, TEXT_BYTES)):
            words, flat, counts = pieces_of(rows, pattern)
            ids = column(rows, "doc_id")
            held = {
                "doc_ids": np.asarray(ids.fill_null(0)).astype("<i8").tobytes(),
                "known": np.asarray(ids.is_valid()).astype("u1").tobytes(),
                "counts": counts.astype("<u4").tobytes(),
                "sequence": zstandard.compress(flat.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 3),
                "words": _pack([w.encode() for w in words]),
            }
            number = xxhash.xxh3_64(str((task, k)))
            for part in held.values():
                number.update(part)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number.intdigest() >> 1], pa.int64()), **{name: pa.array([part], pa.binary()) for name, part in held.items()}})

    return texts(documents).mapInArrow(run, _BLOCK)


def encoded_words(messages: DataFrame, path: str, pattern: str) -> DataFrame:
    """Answers messages that were dealt out by bucket: the ids of their pre-tokens, each distinct one encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for bucket, block, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words")), strict=True):
                answer = []
                for word in _unpack(words):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        ids = known[word] = np.asarray(encode(word.decode()), dtype="<u4").tobytes()
                    answer.append(ids)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()), "ids": [_pack(answer)]})

    return messages.mapInArrow(run, _ANSWER)


def joined_bytes(offsets: np.ndarray, values: np.ndarray, ids: np.ndarray) -> bytes:
    """Ids joined to the token-byte table (bounds and bytes of all tokens end to end), gathered in order."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(offsets) - 1):
        raise ValueError("unknown token id")
    return ragged_take(offsets, values, ids)[0].tobytes()


def encoded(documents: DataFrame, path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row.

    documents: doc_id, text. A null text counts as empty and has no ids; a null doc_id
    stays null; repeated rows are encoded each for itself; an empty table gives an empty
    result; other columns are ignored. A text of any length is encoded whole. path: a
    rank file; pattern: the splitting pattern; buckets: how many hash buckets, each a
    task, the distinct pre-tokens are dealt to (spark.sql.shuffle.partitions).
    """

    def rows(doc_ids: pa.Array, flat: np.ndarray, ends: np.ndarray) -> pa.Table:
        return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))})

    return _reassembled(documents, path, pattern, buckets, rows, "doc_id long, ids array<int>")


def _reassembled(documents: DataFrame, path: str, pattern: str, buckets: int | None, rows: Callable[[pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What `rows` makes of each block's documents: their doc_ids, all ids end to end, and the bounds of each document's."""
    buckets = buckets or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = exploded(documents, pattern).repartition("block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                dealt: dict[int, list[bytes]] = {}
                for word in _unpack(words):
                    dealt.setdefault(_bucket(word, buckets), []).append(word)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(dealt), pa.int32()), "block": pa.array([block] * len(dealt), pa.int64()), "words": pa.array(map(_pack, dealt.values()), pa.binary())})

    answers = encoded_words(held.mapInArrow(ask, _MESSAGE).repartitionById(buckets, F.col("bucket")), path, pattern)

    def join(key: tuple, asked: pa.Table, answered: pa.Table) -> pa.Table:
        if asked.num_rows != 1:
            raise ValueError("a block and its answers are of two attempts; run again on a written table")
        row = asked.to_pylist()[0]
        given = {b: iter(_unpack(ids)) for b, ids in zip(answered.column("bucket").to_pylist(), answered.column("ids").to_pylist(), strict=True)}
        words = _unpack(row["words"])
        per_word = [next(given.get(_bucket(w, buckets), iter(())), None) for w in words]
        if None in per_word:
            raise ValueError("a block and its answers are of two attempts; run again on a written table")
        offsets = bounds(np.fromiter(map(len, per_word), dtype=np.int64, count=len(per_word)) // 4)
        raw = np.frombuffer(zstandard.decompress(row["sequence"]), "u1").reshape(4, -1).T
        flat, each = ragged_take(offsets, np.frombuffer(b"".join(per_word), "<i4"), np.ascontiguousarray(raw).view("<u4").ravel())
        ends = bounds(each)[bounds(np.frombuffer(row["counts"], "<u4").astype(np.int64))]
        known, doc_ids = np.frombuffer(row["known"], "u1"), np.frombuffer(row["doc_ids"], "<i8")
        return rows(pa.array(doc_ids, pa.int64(), mask=known == 0), flat, ends)

    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with bytes (binary), what their ids decode to; null lists decode to no bytes.

    The token-byte table is one row of as many strings as the vocabulary has tokens,
    joined by broadcast; an id is its place there. One outside of the table is an error.
    """
    # a byte is a character of Latin-1, so that tokens can be joined as strings
    tokens = rows.sparkSession.createDataFrame([([b.decode("latin-1") for b in token_bytes(path)],)], "_table array<string>")
    one = lambda i: F.coalesce(F.get(F.col("_table"), i), F.raise_error(F.lit("unknown token id")).cast("string"))
    joined = rows.join(F.broadcast(tokens), F.lit(True))
    return joined.withColumn("bytes", F.encode(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), one), ""), "ISO-8859-1")).drop("_table")


def encode_and_decode(documents: DataFrame, path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """Per document: n_tokens, the hash of its ids and the hash of the bytes that they decode to. Rows are treated as by encoded()."""
    table = token_bytes(path)
    kept = documents.sparkSession.sparkContext.broadcast((bounds(np.fromiter(map(len, table), np.int64, len(table))), np.frombuffer(b"".join(table), "u1")))  # a row for each token of the vocabulary

    def rows(doc_ids: pa.Array, flat: np.ndarray, ends: np.ndarray) -> pa.Table:
        shown = [str(i).encode() for i in range(len(kept.value[0]))]
        cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        ids_hash = [hashlib.sha256(b" ".join(map(shown.__getitem__, flat[a:b].tolist()))).hexdigest() for a, b in cuts]
        bytes_hash = [hashlib.sha256(joined_bytes(*kept.value, flat[a:b])).hexdigest() for a, b in cuts]
        return pa.table({"doc_id": doc_ids, "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_sha256": ids_hash, "decoded_sha256": bytes_hash})

    return _reassembled(documents, path, pattern, buckets, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
