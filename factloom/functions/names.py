"""References and their names: folding, search keys, name endings, kinds."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a search key.
KEY_LENGTH = 256
#: What divides a key's segments, each compared as the first (fixed values).
SEPARATORS = "./#:$"
_same = str.maketrans(dict.fromkeys(SEPARATORS, "."))


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())[:KEY_LENGTH]


def prefix(text: str) -> str:
    """The key to search a prefix by; one that would be cut is refused."""
    out = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    if len(out) > KEY_LENGTH:
        raise ValueError("the prefix is longer than a key")
    return out


def successor(text: str) -> str | None:
    """The smallest string behind all that begin with the text, by code points without surrogates; None if there is none."""
    for k in range(len(text) - 1, -1, -1):
        if text[k] != chr(0x10FFFF):
            after = ord(text[k]) + 1
            return text[:k] + chr(0xE000 if 0xD800 <= after < 0xE000 else after)
    return None


#: A callable's key: up to the member's name, and the list of its parameters.
_callable = re.compile(r"(.*#[^./#:$(]*)(\([^#]*\))", re.DOTALL).fullmatch


def endings(reference: str) -> list[str]:
    """All names of a reference: its key from each segment on; those of a callable with and without the list of parameters.

    The key is put together again from its last segment backwards; each step is a name.
    """
    kind, _, key = unicodedata.normalize("NFC", reference).partition(":")
    own = _callable(key) if kind == "symbol" else None
    head, listed = ((own[1], own[2]) if own else (key, ""))
    alike = lambda t: t.casefold().translate(_same)
    found = itertools.accumulate(reversed(alike(head).split(".")), lambda tail, segment: f"{segment}.{tail}")
    shown = {name for tail in found if tail for name in (tail, tail + alike(listed))}
    return sorted(n for n in shown if len(n) <= KEY_LENGTH)


def name(text: str) -> str:
    """The key that a searched name is compared by; separators in front don't count."""
    out = unicodedata.normalize("NFC", text).casefold().translate(_same).lstrip(".")
    if not out or len(out) > KEY_LENGTH:
        raise ValueError("not a name" if not out else "the name is longer than a key")
    return out


def plain(text: str) -> str:
    """Lower case without accents, one kind of apostrophe."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("’", "'")) if not unicodedata.combining(c))



def with_folded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with a search key of a column: normal form C, case folded, cut to KEY_LENGTH. ASCII never leaves the JVM: Spark would send each row of one expression to Python."""
    ascii_ = F.length(column) == F.octet_length(column)
    plain = rows.where(F.coalesce(ascii_, F.lit(True))).withColumn(name, F.substring(F.lower(column), 1, KEY_LENGTH))
    return plain.unionByName(rows.where(~ascii_).withColumn(name, _fold(column)))


def fold(text: Column) -> Column:
    """The search key of each value, by Python."""
    return _fold(text)


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(folded, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    """Normal form C."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    return texts.map(plain, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_keys(references: pd.Series) -> pd.Series:
    return references.map(endings, na_action="ignore")


def kind_of(reference: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(reference, ":", 1)


def key_of(reference: Column) -> Column:
    return F.substr(reference, F.length(kind_of(reference)) + 2)


def nature(reference: Column) -> Column:
    """TYPE, METHOD or MEMBER of a symbol by its spelling; any other kind in capitals."""
    key = key_of(reference)
    symbol = F.when(~F.contains(key, F.lit("#")), "TYPE").when(F.endswith(key, F.lit(")")), "METHOD").otherwise("MEMBER")
    return F.when(kind_of(reference) == "symbol", symbol).otherwise(F.upper(kind_of(reference)))


def joined_route(base: Column, path: Column) -> Column:
    """Two paths with single slashes between segments; a slash at the end stays."""
    return F.regexp_replace(F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")


def token(text: Column) -> Column:
    """Base64 for URLs, without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def untoken(text: Column) -> Column:
    return F.decode(F.unbase64(F.translate(text, "-_", "+/")), "UTF-8")


def directory_join(base: str, path: str) -> str | None:
    """A path below base with . and .. resolved; None if it leads outside."""
    out: list[str] = []
    for part in f"{base}/{path}".split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)
