"""Secret scans with a ledger of scanned contents.

Every version of every path is addressed by the SHA-256 of its content (its
blob). The ledger is a table of (blob, rule version, spans), and the rule version is a
hash of the rules themselves; a scan reads only pairs that the ledger lacks, adds
them, and joins findings back to all paths.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, held_bits, shared_dir, written

#: Base patterns and known forms (fixed values).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
PRIVATE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"
TOKEN = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"


@dataclass(frozen=True)
class Rule:
    """A kind, the pattern of its leftmost matches apart from each other, and the least length of a group of these (0: the whole match). A text without the cue holds no match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    cue: str | None = None
    any_case: bool = False


#: In the order in which spans at one start are listed: the base kinds, then those that this scan adds.
RULES = (
    Rule("assign", ASSIGN, 6, 2, "passw|secret|token|api_?key", True),
    Rule("access", ACCESS, 20, 0, "AKIA"),
    Rule("hex", HEX),
    Rule("private", PRIVATE, 0, 0, "PRIVATE KEY"),
    Rule("token", TOKEN, 0, 0, "_|xox|AIza|eyJ"),
)
KINDS = tuple(r.kind for r in RULES)
BASE = KINDS[:3]


def version(rules: tuple[Rule, ...] = RULES) -> str:
    """Rules that differ in anything have another version."""
    return hashlib.sha256(repr(tuple(map(astuple, rules))).encode()).hexdigest()[:16]


@functools.lru_cache(maxsize=16)
def _compiled(rules: tuple[Rule, ...]) -> list[tuple]:
    flags = lambda r: re.ASCII | (re.IGNORECASE if r.any_case else 0)
    return [(k, re.compile(r.pattern, flags(r)).finditer, r.group, r.least, re.compile(r.cue, flags(r)).search if r.cue else None) for k, r in enumerate(rules)]


SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = f"blob string, rules string, spans {SPAN}"
_span_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each finding by start and kind; code points, end exclusive.

    Of each kind the leftmost matches that don't overlap are taken first; those that are too short are then dropped.
    """
    found = []
    for k, matches, group, least, cue in _compiled(rules):
        if cue is None or cue(text):
            found += [(m.start(), k, m.end()) for m in matches(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def contents(versions: DataFrame, content: str = "text", only=None) -> DataFrame:
    """blob (hex SHA-256) and content, compressed, of each content that a task meets for the first time; null contents count as empty. only: a broadcast filter that a blob has to pass."""
    inner = versions.select(F.coalesce(F.col(content), F.lit("")).alias("_content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            blobs, packed = [], []
            for text in batch.column("_content"):
                raw = text.as_buffer()
                digest = hashlib.sha256(raw)
                key = digest.digest()
                if key in met or (only is not None and not held_bits(only, int.from_bytes(key[:8], "big"))):
                    continue
                blobs.append(digest.hexdigest())
                packed.append(pack(raw))
                if len(met) < 1 << 20:  # beyond that a content may be sent again, which changes no result
                    met.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(packed, pa.binary())], names=["blob", "content"])

    return inner.mapInArrow(run, "blob string, content binary")


def findings(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, content (compressed), all rows of a blob in one partition -> blob, rules, spans; each blob is scanned once."""
    name = version(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[tuple[str, list]] = []
            for blob, content in zip(batch.column("blob").to_pylist(), batch.column("content"), strict=True):
                key = bytes.fromhex(blob)
                if key not in done:
                    done.add(key)
                    out.append((blob, [{"start": s, "kind": k, "end": e} for s, k, e in spans(unpack(content.as_buffer()).decode(), rules)]))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.string()), pa.array([name] * len(out), pa.string()), pa.array([s for _, s in out], _span_type)], names=["blob", "rules", "spans"])

    return blobs.select("blob", "content").mapInArrow(run, _FOUND)


def scan(versions: DataFrame, keys: list[str], ledger: str, content: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob and spans of every version; new findings are added to the ledger, a table at that path.

    Every row is a version and is returned, repeated rows and null keys too; null or
    empty contents have no findings; a content of any length is scanned whole; other
    columns are ignored. Blobs that the ledger has under the version of these rules are
    neither sent nor scanned again; of runs at once that add one blob, one counts. An empty
    table gives an empty result.
    """
    spark = versions.sparkSession
    paths, name, unseen = addressed_keys(versions, keys, content), version(rules), contents(versions, content)
    if exists(spark, ledger):
        seen = spark.read.schema(_FOUND).parquet(ledger).where(F.col("rules") == name).select("blob")
        new = written(paths.select("blob").distinct().join(seen, "blob", "left_anti"), shared_dir(spark, "unseen-blobs"))
        bits = spark.sparkContext.broadcast(bit_filter(new.select(F.conv(F.substring("blob", 1, 16), 16, -10).cast("long").alias("hash"))))
        unseen = None if new.isEmpty() else contents(versions, content, bits).join(new, "blob", "left_semi")
    if unseen is not None:
        # only blobs with findings and the fact that a blob was scanned are kept, never contents
        findings(unseen.repartition("blob"), rules).write.mode("append").parquet(ledger)
    found = spark.read.schema(_FOUND).parquet(ledger).where((F.col("rules") == name) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")))


def addressed_keys(versions: DataFrame, keys: list[str], content: str = "text") -> DataFrame:
    """The key columns and blob alone, by built-in functions."""
    return versions.select(*[F.col(k) for k in keys], F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("blob"))


def exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listed(found: F.Column, kinds: tuple[str, ...] = KINDS) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and lists of the spans; all other columns stay."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("*", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("listed"))


MARK = "<SECRET>"


def redacted(text: str, found: list[tuple[int, int, int]], mark: str = MARK) -> str:
    """The text with every span, or run of spans that overlap, replaced by the mark."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(rows: DataFrame) -> DataFrame:
    """Rows with spans: text with its spans replaced, and n_chars of the new text; rows whose spans are null or none stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spotted = batch.column("spans").to_pylist()
            if any(spotted):
                new = [redacted(t.as_py(), [(s["start"], s["kind"], s["end"]) for s in own]) if own else t.as_py() for t, own in zip(batch.column("text"), spotted, strict=True)]
                sizes = [len(t) if own else n for t, own, n in zip(new, spotted, batch.column("n_chars").to_pylist(), strict=True)]
                batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
                batch = batch.set_column(batch.schema.get_field_index("n_chars"), batch.schema.field("n_chars"), pa.array(sizes, batch.schema.field("n_chars").type))
            yield batch

    return rows.mapInArrow(run, rows.schema)
