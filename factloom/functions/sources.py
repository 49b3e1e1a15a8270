"""Reading source text without a parser: comments, imports, and the names that a question mentions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.names import plain

_comment = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?(?:\*/|\Z)', re.DOTALL)
_import = re.compile(r"^\s*import\s+(static\s+)?([\w.]+(?:\.\*)?)\s*;")
#: Words of a question about people (fixed values).
AUTHOR_WORDS = ("auteur", "auteurs", "author", "authors", "ecrit", "wrote", "written", "committed", "qui", "who")


def blanked(text: str) -> str:
    """Comments as spaces, so that offsets and lines stay; strings are left alone."""
    return _comment.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)


def imports(text: str) -> list[str]:
    """Imported names, in order; those within comments don't count."""
    return [m[2] for line in blanked(text).split("\n") if (m := _import.match(line))]


def java_sources(files: DataFrame, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Files (path, content as bytes) that can be read as Java, with their text; and the others that are named so, each with a reason: TOO_LARGE or NOT_UTF8."""
    named = files.where(F.endswith("path", F.lit(".java"))).withColumn("reason", F.when(F.octet_length("content") > most_bytes, "TOO_LARGE").when(~F.is_valid_utf8(F.col("content").cast("string")), "NOT_UTF8"))
    return named.where("reason is null").select("path", F.col("content").cast("string").alias("text")), named.where("reason is not null").select("path", "reason")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


@F.pandas_udf(T.StringType())
def without_comments(texts: pd.Series) -> pd.Series:
    return texts.map(blanked, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def imported(texts: pd.Series) -> pd.Series:
    return texts.map(imports, na_action="ignore")


def anchors(question: Column) -> Column:
    """Names in backticks, routes, and names with a capital inside, each once."""
    found = F.array_union(F.array_union(F.regexp_extract_all(question, F.lit(r"`([^`]+)`"), F.lit(1)), F.regexp_extract_all(question, F.lit(r"(?:^|\s)(/[\w{}./-]+)"), F.lit(1))), F.regexp_extract_all(question, F.lit(r"\b([A-Z][a-z0-9]+[A-Z]\w*(?:[.#]\w+)*)"), F.lit(1)))
    return F.array_distinct(found)


def asks_for_author(question: str) -> bool:
    words = set(re.findall(r"\w+", plain(question)))
    return bool(words & set(AUTHOR_WORDS[:7])) or {"qui", "fait"} <= words or {"who", "made"} <= words


def resolved(asked, named):
    """asked (anchor, name_key) against a name index: the reference of a unique match, or AMBIGUOUS or NOT_FOUND; never a guess."""
    found = asked.join(named.select("name_key", "reference").distinct(), "name_key", "left").groupBy("anchor").agg(F.count("reference").alias("n"), F.min("reference").alias("reference"))
    return found.select("anchor", F.when(F.col("n") == 1, F.col("reference")).alias("reference"), F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") == 0, "NOT_FOUND").otherwise("AMBIGUOUS").alias("status"))
