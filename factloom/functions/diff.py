"""Side-by-side line differences, and the lines that changed on each side."""

from __future__ import annotations

import difflib
import itertools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXT = 3
#: Product of the sides' lines from which very frequent lines no longer start a match, as the standard library has it.
EXACT = 2_000_000

_ROW = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("before_line", T.IntegerType()), ("before", T.StringType()), ("after_line", T.IntegerType()), ("after", T.StringType()))])


def lines(text: str) -> list[str]:
    """Lines with their line ends; only \\n ends a line."""
    return [line + "\n" for line in text.split("\n")[:-1]] + [line for line in text.split("\n")[-1:] if line]


def _aligned(old: list[tuple[int, str]], new: list[tuple[int, str]]) -> Iterator[tuple]:
    """Rows of numbered lines: what is equal side by side, what differs paired in order as far as both sides go."""
    texts = [[t for _, t in side] for side in (old, new)]
    frequent = len(old) * len(new) > EXACT
    for kind, a, b, c, d in difflib.SequenceMatcher(None, *texts, autojunk=frequent).get_opcodes():
        for x, y in itertools.zip_longest(old[a:b], new[c:d]):
            name = "SAME" if kind == "equal" else "ADDED" if x is None else "REMOVED" if y is None else "CHANGED"
            yield (name, *(x or (None, None)), *(y or (None, None)))


def rows(before: str, after: str) -> list[tuple]:
    """(kind, line, text, line, text): SAME, CHANGED, REMOVED, ADDED or GAP, with CONTEXT equal lines around changes. Line ends belong to lines, so a change of these is a change."""
    old, new = (list(enumerate(lines(t), 1)) for t in (before, after))
    bare = [[t for _, t in side] for side in (old, new)]
    head = len(os.path.commonprefix(bare))
    tail = len(os.path.commonprefix([side[head:][::-1] for side in bare]))
    ends = [len(side) - tail for side in bare]
    every = [("SAME", *x, *y) for x, y in zip(old[:head], new[:head], strict=True)]
    every += _aligned(old[head : ends[0]], new[head : ends[1]])
    every += [("SAME", *x, *y) for x, y in zip(old[ends[0] :], new[ends[1] :], strict=True)]
    changed = [k for k, r in enumerate(every) if r[0] != "SAME"]
    near = {k + d for k in changed for d in range(-CONTEXT, CONTEXT + 1)}
    out: list[tuple] = []
    for shown, part in itertools.groupby(range(len(every)), near.__contains__):
        out += [every[k] for k in part] if shown else [("GAP", None, None, None, None)] * bool(changed)
    return out


@F.pandas_udf(T.ArrayType(_ROW))
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Null sides count as empty texts."""
    return pd.Series([[dict(zip(_ROW.names, r, strict=True)) for r in rows(a or "", b or "")] for a, b in zip(before, after, strict=True)])


def changed_lines(diffs, key: str, column: str = "diff"):
    """key, side, line of every line that differs."""
    each = diffs.select(key, F.explode(column).alias("r")).where("r.kind not in ('SAME', 'GAP')")
    before = each.where("r.before_line is not null").select(key, F.lit("before").alias("side"), F.col("r.before_line").alias("line"))
    return before.unionByName(each.where("r.after_line is not null").select(key, F.lit("after").alias("side"), F.col("r.after_line").alias("line")))
