"""Canonical JSON, identities and fingerprints of facts.

An identity says what a fact claims; status, evidence, derivation and the like are
not part of it. Equal identities have equal canonical bytes, so their hash is a join key.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of an identity by kind (fixed values).
IDENTITY_FIELDS = {
    "ASSERTION": ("kind", "subject", "relation", "object", "qualifiers"),
    "ABSENCE": ("kind", "pattern", "scope", "method"),
    "COVERAGE": ("kind", "subject", "coverage_type", "scope", "producer_id"),
}
SAFE = 2**53 - 1
#: What is hashed in front of an identity; stores that share hashes share it.
TAG = b"fact-identity/1\n"


class NotCanonical(ValueError):
    """A value that has no canonical form."""


def number(value: int | float) -> str:
    """A number as RFC 8785 writes it, by the rules of ECMAScript."""
    if isinstance(value, int):
        if abs(value) > SAFE:
            raise NotCanonical("integer beyond the safe range")
        return str(value)
    if not math.isfinite(value):
        raise NotCanonical("number that isn't finite")
    if value == 0:
        return "0"
    mantissa, _, exponent = repr(abs(value)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" and not exponent else part.rstrip("0")
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        sign = "+" if point > 0 else "-"
        out = digits[0] + (f".{digits[1:]}" if n > 1 else "") + f"e{sign}{abs(point - 1)}"
    return "-" + out if value < 0 else out


def utf16(text: str) -> bytes:
    """The order of UTF-16 code units, as bytes."""
    return text.encode("utf-16-be")


def jcs(value: object) -> str:
    """RFC 8785: keys by UTF-16 code units, no white space, ECMAScript numbers."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, int | float):
        return number(value)
    if isinstance(value, str):
        try:
            value.encode()
        except UnicodeEncodeError:
            raise NotCanonical("lone surrogate") from None
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(jcs, value)) + "]"
    return "{" + ",".join(f"{jcs(k)}:{jcs(value[k])}" for k in sorted(value, key=utf16)) + "}"


def nfc(value: object) -> object:
    """Every string and key in normal form C; two keys that become one are an error."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, list | tuple):
        return [nfc(v) for v in value]
    if isinstance(value, dict):
        out = {nfc(k): nfc(v) for k, v in value.items()}
        if len(out) != len(value):
            raise NotCanonical("two keys with one normal form")
        return out
    return value


def identity_of(fact: dict) -> dict:
    """The identity's fields in canonical form; scopes are sets, so they are sorted by UTF-16 without repeats."""
    try:
        fields = IDENTITY_FIELDS[fact["kind"]]
    except KeyError:
        raise NotCanonical("unknown kind of fact") from None
    given = {**fact, "producer_id": (fact.get("produced_by") or {}).get("producer_id", fact.get("producer_id"))}
    out = nfc({k: given[k] for k in fields if given.get(k) is not None})
    if isinstance(out.get("scope"), dict):
        out["scope"] = {k: sorted(set(v), key=utf16) if isinstance(v, list) else v for k, v in out["scope"].items() if k != "exclude" or v}
    return out


def identity_hash(fact: dict) -> str:
    return hashlib.sha256(TAG + jcs(identity_of(fact)).encode()).hexdigest()


def split(fact: dict) -> tuple[dict, dict, dict | None]:
    """(identity, details, raw): raw has the identity's fields as submitted where that differs from the canonical form."""
    own = identity_of(fact)
    raw = {k: fact[k] for k in IDENTITY_FIELDS[fact["kind"]] if k in fact}
    details = {k: v for k, v in fact.items() if k not in raw}
    shown = {k: v for k, v in own.items() if k in raw}
    return own, details, None if same_json(raw, shown) else raw


def rebuild(own: dict, details: dict, raw: dict | None) -> dict:
    fields = IDENTITY_FIELDS[own["kind"]]
    return {**(raw if raw is not None else {k: v for k, v in own.items() if k in fields and (k != "producer_id" or k in details)}), **details}


def same_json(a: object, b: object) -> bool:
    """Strict equality: 1, 1.0 and true are three values."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return a == b


def no_repeats(pairs: list[tuple[str, object]]) -> dict:
    """object_pairs_hook that refuses a key given twice."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise NotCanonical("repeated key")
    return out


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text -> canonical text; null for what has none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else jcs(json.loads(text, object_pairs_hook=no_repeats))
        except ValueError:
            return None

    return texts.map(one)


@F.pandas_udf(T.StringType())
def fact_identity(texts: pd.Series) -> pd.Series:
    """A fact's JSON text -> its identity hash; null for what isn't a fact."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else identity_hash(json.loads(text, object_pairs_hook=no_repeats))
        except (ValueError, TypeError, AttributeError):
            return None

    return texts.map(one)


#: Characters that JSON writes as they are and that no normal form changes: printable ASCII but for quotes and backslashes.
PLAIN = r"^[ !#-\[\]-~]*$"


def is_flat(*parts: Column) -> Column:
    """Whether flat_identity() holds for parts: each is there and plain."""
    out = F.lit(True)
    for part in parts:
        out = out & F.coalesce(F.rlike(part, F.lit(PLAIN)), F.lit(False))
    return out


def flat_identity(kind: Column, subject: Column, relation: Column, obj: Column) -> Column:
    """identity_hash() of an assertion without qualifiers whose parts are plain, by built-in functions: its canonical JSON, keys in order."""
    text = F.concat(F.lit(TAG.decode() + '{"kind":"'), kind, F.lit('","object":"'), obj, F.lit('","relation":"'), relation, F.lit('","subject":"'), subject, F.lit('"}'))
    return F.sha2(text, 256)


#: Columns that identities of stored facts are made of; qualifiers and scope are JSON.
STORED_FIELDS = ("kind", "subject", "relation", "object", "qualifiers", "coverage_type", "scope", "producer_id", "pattern", "method")


def with_identity(rows: DataFrame) -> DataFrame:
    """The rows with identity_hash; of STORED_FIELDS those that they have.

    Plain assertions are hashed in the JVM; all others are put together as JSON and hashed
    by their canonical form in Python. A fact that has none (unknown kind, repeated keys,
    numbers beyond the safe range) gets null.
    """
    have = [c for c in STORED_FIELDS if c in rows.columns]
    plain = (F.col("kind") == "ASSERTION") & is_flat(*map(F.col, ("subject", "relation", "object")))
    if "qualifiers" in have:
        plain = plain & F.col("qualifiers").isNull()
    quick = rows.where(F.coalesce(plain, F.lit(False))).withColumn("identity_hash", flat_identity(*map(F.col, ("kind", "subject", "relation", "object"))))
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}":'), F.col(c) if c in ("qualifiers", "scope") else F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))) for c in have]
    other = rows.where(~F.coalesce(plain, F.lit(False))).withColumn("identity_hash", fact_identity(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))))
    return quick.unionByName(other)


def utf16_key(text: Column) -> Column:
    """A sort key in the order of UTF-16 code units."""
    return F.encode(text, "UTF-16BE")


def reference_hash(reference: Column) -> Column:
    return F.sha2(reference, 256)


def content_hash(text: Column, first: Column | int | None = None, last: Column | int | None = None) -> Column:
    """SHA-256 of a text's lines first to last (from 1; all without them): no carriage returns, line feeds between lines and none behind the last."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    lines = F.when((F.size(lines) > 1) & (F.element_at(lines, -1) == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    if first is not None:
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
        lines = F.slice(lines, a, F.greatest(b - a + 1, F.lit(0)))
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(lines, "\n"), 256))
