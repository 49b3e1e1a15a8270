"""Quality rules as a ledger of bit masks.

Every rule is evaluated once for each document; the ledger keeps the measurements
and a mask with a bit for each rule that failed. A policy is a named, versioned
set of rules: applying it, or asking what each of its rules rejects alone, reads
the ledger only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, column, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """failed: a condition over measurements, true where a document breaks the rule."""

    bit: int
    name: str
    failed: Column | str


#: Version of the rules that a ledger was made by.
VERSION = 1
#: A rule's bit and meaning never change; a new meaning takes a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "2 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "long_words", "word_chars > 25 * n_words"),
    Rule(5, "short_words", "2 * word_chars < 3 * n_words"),
)
BASE = 0b11
#: Versioned policies: the bits that each applies.
POLICIES = {"base/1": BASE, "standard/1": BASE | 0b111100}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of that many words found twice or more, its first place included."""
    windows = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = until = 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + window - max(i, until)
            until = i + window
    return covered


def measure(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # bytes are split at \x20 and \x09-\x0D only
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def ledger(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, the measurements and failed, the mask of the rules that it breaks.

    Null texts count as empty and so have no words; repeated rows and null doc_ids stay;
    other columns are ignored; an empty table gives an empty ledger; texts are measured whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches):
            found = [measure(t.as_py()) for t in column(rows, "text")]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES])

    measured = texts(documents).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    mask = F.lit(0).cast("long")
    for rule in RULES:
        failed = F.expr(rule.failed) if isinstance(rule.failed, str) else rule.failed
        mask = mask.bitwiseOR(F.when(failed, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed", mask)


def passes(mask: int) -> Column:
    """Whether a ledger row breaks none of these rules."""
    return F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0


def alone(mask: int) -> Column:
    """The only rule of these that a ledger row breaks, as its bit; 0 if it breaks none or several: what would be kept without that rule."""
    own = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    return F.when(F.bit_count(own) == 1, own).otherwise(F.lit(0).cast("long"))


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """A row for each rule of the policy: documents that break it, that break it alone, and that the policy keeps without it."""
    mask = POLICIES[policy]
    kept = F.sum(passes(mask).cast("long"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    counts = ledger_rows.agg(
        F.coalesce(kept, F.lit(0)).alias("kept"),
        *[F.coalesce(F.sum((~passes(1 << r.bit)).cast("long")), F.lit(0)).alias(f"broken_{r.bit}") for r in rules],
        *[F.coalesce(F.sum((F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == (1 << r.bit)).cast("long")), F.lit(0)).alias(f"alone_{r.bit}") for r in rules],
    )
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"broken_{r.bit}").alias("broken"), F.col(f"alone_{r.bit}").alias("alone"), (F.col("kept") + F.col(f"alone_{r.bit}")).alias("kept_without")) for r in rules]))
    return counts.select(each.alias("x")).select(F.lit(policy).alias("policy"), "x.*")
