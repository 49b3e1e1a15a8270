"""Chat formatting by typed content parts, with built-in functions only.

A visitor turns each part of a turn into text: a text part into itself, escaped,
an image, audio or document part into a numbered placeholder whose reference and
expanded token count are recorded. `#`, `<`, `:` (in roles) and backslashes of
the content are escaped, so no content can form a mark of the template.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens that one unit of an attachment stands for: a tile, a second, a page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(text: Column) -> Column:
    """Backslash, `<` and `#` as a backslash and a letter."""
    for old, new in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    for old, new in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _tokens(part: Column) -> Column:
    out = F.lit(0)
    for kind, each in EXPANSION.items():
        out = F.when(part["kind"] == kind, F.coalesce(part["units"], F.lit(1)) * each).otherwise(out)
    return out


def visitor(turn: Column) -> Callable[[Column, Column], Column]:
    def visit(part: Column, i: Column) -> Column:
        place = F.concat(F.lit("<|"), part["kind"], F.lit(":"), turn.cast("string"), F.lit("."), i.cast("string"), F.lit("|>"))
        return F.when(part["kind"].isin(*EXPANSION), place).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return visit


def format_chats(turns: DataFrame, parts: str | None = None, trained: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (spans of the trained role's text) and attachments.

    turns: conv_id, turn, role, text, or a column of typed parts named by `parts`
    (array of kind, text, ref, units; an unknown kind counts as text). Null texts,
    roles and parts count as empty; every row without a conv_id is a conversation of its
    own; turns stand by turn, nulls first, ties by role, then by the texts of their parts
    end to end, then by the parts; repeated rows stay; other columns
    are ignored; an empty table gives an empty result. A conversation becomes one
    string, so it has to fit a task; conversations of equal content share nothing.
    loss: of each trained turn its number, the start in formatted (code points, from 0),
    the start in its own turn and the length. attachments: turn, number in the turn,
    kind, ref and tokens.
    """
    own = F.col(parts).cast(PART) if parts else F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = turns.select("conv_id", alone, "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(own, F.array().cast(PART)).alias("parts"))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.to_json("parts"))
    rows = rows.withColumn("n", F.row_number().over(order) - 1)
    shown = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(AFTER_ROLE))
    rows = rows.select("conv_id", "alone", "n", "role", shown.alias("head"), F.array_join(F.transform("parts", visitor(F.col("n"))), "").alias("body"), F.col("parts"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(Window.partitionBy("conv_id", "alone").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    found = F.filter(F.transform("parts", lambda p, i: F.struct(F.col("n").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["kind"].isin(*EXPANSION))
    span = F.struct(F.col("n").alias("turn"), (F.col("start") + F.length("head")).alias("start"), F.length("head").alias("inside"), F.length("body").alias("length"))
    rows = rows.select("conv_id", "alone", F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("shown"), F.when(F.col("role") == trained, span).alias("span"), found.alias("found")).alias("x"))
    out = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return out.select(
        "conv_id",
        F.array_join(F.transform("xs", lambda x: x["shown"]), "").alias("formatted"),
        F.filter(F.transform("xs", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("xs", lambda x: x["found"])).alias("attachments"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """The same rows with turns (array of role and text, unescaped, without placeholders) read back from formatted, and loss_text, what lies under the mask."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    plain = lambda body: unescape(F.regexp_replace(body, r"<\|[^|]*\|>", ""))
    head = lambda p: F.substring_index(p, AFTER_ROLE, 1)
    turn = lambda p: F.struct(unescape(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"), plain(F.substr(p, F.length(head(p)) + len(AFTER_ROLE) + 1)).alias("text"))
    masked = F.transform("loss", lambda s: plain(F.substr(F.get(F.col("pieces"), s["turn"]), s["inside"] + 1, s["length"])))
    out = formatted.withColumn("pieces", pieces).withColumn("turns", F.transform("pieces", turn)).withColumn("loss_text", F.array_join(masked, ""))
    return out.drop("pieces")
