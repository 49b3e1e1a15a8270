"""Masking secrets and people in texts before they leave, and restoring what may be restored.

Known forms, credentials in URLs, people, leaks and restoring are built-in
functions; assigned secrets need a reader of values (quotes that stay open, blocks
that hang below an entry), which is a small helper in an Arrow batch.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "***"

#: Forms of known secrets (fixed values).
KNOWN = (
    r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END[A-Z ]*PRIVATE KEY-----|$)",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}\b",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)
#: What a text holds that has a known form: one of these, each form's in the order of KNOWN (fixed values).
MARKS = (("-----BEGIN",), ("AKIA", "ASIA"), tuple(f"gh{c}_" for c in "pousr"), ("github_pat_",), tuple(f"xox{c}-" for c in "abposr"), ("sk-",), ("AIza",), ("eyJ",))
#: A scheme, then a user and a password up to the at sign; both end where a path, a query or white space begins.
URL = r"((?i:\b[a-z](?:[a-z\d]|[+.-])*)://)(?!@)[^@:/?#\s]+:[^@/?#\s]+@"
#: Letters, digits and marks of any script around an at sign, the host in labels with single dots between.
#: It begins where such letters do, or behind the address before, so no run is read from each of its letters.
EMAIL = r"(?U)(?:(?<![\w.!#$%&+?^`{|}~-])|\G)(?:\w|[-.!#$%&+?^`{|}~])++@(?:[\w-]+\.)*[\w-]+"
#: Words that make a name one of a secret, written with or without marks between their parts (fixed values).
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "credential", "apikey", "accesskey", "privatekey")
#: Keys of trailers, besides those that end in -by (fixed values).
TRAILERS = ("co-authored", "cc", "change-id")
#: Values that are no secrets (fixed values).
NO_SECRETS = ("", "null", "none", "true", "false")

_named = re.compile(r"(?<![\w.-])([\w.-]++)[\"']?[ \t]*+(:=|=>|[:=(])[ \t]*+")
_joints = str.maketrans("", "", "_-.")
_word = re.compile(r"[^\s\"',;(){}\[\]]++")
_quoted = {'"': re.compile(r"\\.|\"", re.DOTALL), "'": re.compile(r"\\.|''|'", re.DOTALL)}


def _holds(text: Column, *marks: str) -> Column:
    """Whether any of the marks is in the text: much cheaper than a pattern, which only texts with a mark are held against."""
    out = F.contains(text, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(text, F.lit(m))
    return out


def known_secrets(text: Column) -> Column:
    """Known forms and credentials in URLs masked."""
    marked = F.lit(False)
    out = text
    for form, marks in zip(KNOWN, MARKS, strict=True):
        out, marked = F.regexp_replace(out, form, MASK), marked | _holds(text, *marks)
    out = F.when(marked, out).otherwise(text)  # masking makes no mark
    return F.when(_holds(text, "://"), F.regexp_replace(out, URL, f"$1{MASK}:{MASK}@")).otherwise(out)


def known_count(text: Column) -> Column:
    """How many known forms and credentials in URLs a text holds; forms are counted one after the other, each in what those before left."""
    total, left, marked = F.lit(0), text, _holds(text, "://")
    for form, marks in zip((*KNOWN, URL), (*MARKS, None), strict=True):
        total = total + F.regexp_count(left, F.lit(form))
        left = F.regexp_replace(left, form, MASK)
        marked = marked if marks is None else marked | _holds(text, *marks)
    return F.when(marked, total).otherwise(F.when(text.isNotNull(), 0))


def emails(text: Column) -> Column:
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(_holds(text, "@"), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).otherwise(none)


def is_secret_name(name: str) -> bool:
    plain = name.lower().replace("_", "").replace("-", "").replace(".", "")
    return any(w in plain for w in SECRET_WORDS)


def is_no_secret(value: str) -> bool:
    """Empty, a literal of the language, a variable, or masked before."""
    bare = value.strip("\"' \t")
    return bare.lower() in NO_SECRETS or bare.startswith("${") and bare.endswith("}") or not bare.strip("*")


def _quote_end(text: str, at: int) -> int | None:
    """Behind the quote that closes the one at `at`; a backslash or a doubled single quote doesn't close. None if it stays open."""
    return next((m.end() for m in _quoted[text[at]].finditer(text, at + 1) if m[0] == text[at]), None)


def _line_end(text: str, at: int) -> int:
    """Of the line around `at`, in front of its line end, CR LF included."""
    end = text.find("\n", at)
    return len(text) if end < 0 else end - (end > at and text[end - 1] == "\r")


def _hanging(text: str, end: int, depth: int) -> int:
    """The end of the lines behind `end` that stand deeper than `depth`, blank ones between them included; `end` itself without any."""
    last = end
    while (start := text.find("\n", end)) >= 0:
        end = _line_end(text, start + 1)
        line = text[start + 1 : end]
        if line.strip():
            if len(line) - len(line.lstrip(" \t")) <= depth:
                break
            last = end
    return last


def _without_note(value: str) -> tuple[str, str]:
    """A value and the comment behind it."""
    place = re.search(r"[ \t]+#", f" {value}")
    return (value, "") if place is None else (value[: max(0, place.start() - 1)].rstrip(), value[max(0, place.start() - 1) :])


def _read(text: str, name: re.Match) -> tuple[int, int, str] | None:
    """Start, end and replacement of the value that belongs to a secret's name; None if it is no secret."""
    at, mark = name.end(), name[2]
    before = text[text.rfind("\n", 0, name.start()) + 1 : name.start()]
    first = not before.strip(" \t\"'-")
    entry = first and mark == ":" and (text[at - 1] != ":" or at >= len(text) or text[at] in "\r\n")
    depth = len(before.rstrip("\"'"))
    if text[at : at + 1] in ("'", '"'):
        quote, end = text[at], _quote_end(text, at)
        if end is not None and is_no_secret(text[at:end]):
            return None
        return (at, end, f"{quote}{MASK}{quote}") if end is not None else (at, len(text), f"{quote}{MASK}{quote}" if entry else MASK)
    if mark == "(":
        return None
    stop = _line_end(text, at)
    value, note = _without_note(text[at:stop])
    if entry:
        end = _hanging(text, stop, depth)
        if end > stop:
            return name.end(2), end, f" {MASK}"
        return None if is_no_secret(value) else (at, stop, f"{MASK}{note}")
    if mark == ":" and before.rstrip().endswith(("{", ",")):
        end = min((k for k in (text.find(c, at, stop) for c in ",}") if k >= 0), default=-1)
        if end >= 0 and text[at] not in "{[$":
            return None if is_no_secret(text[at:end]) else (at, at + len(text[at:end].rstrip()), MASK)
    if first and mark == "=" and " " in value.strip() and not (value.endswith((";", "{", ",")) or "(" in value):
        return None if is_no_secret(value) else (at, stop, f"{MASK}{note}")
    word = _word.match(text, at)
    if word is None or text[word.end() : word.end() + 1] in ("(", "{") or is_no_secret(word[0]):
        return None
    return at, word.end(), MASK


def without_assigned(text: str) -> tuple[str, int]:
    """The text with the values of secrets' names masked, and how many there were; names, quotes, comments and line ends stay."""
    plain = text.lower().translate(_joints)
    if not any(w in plain for w in SECRET_WORDS):  # so no name in it is one of a secret
        return text, 0
    out, done, n, at = [], 0, 0, 0
    while name := _named.search(text, at):
        found = _read(text, name) if is_secret_name(name[1]) else None
        at = name.end(2)
        if found:
            start, end, shown = found
            out += [text[done:start], shown]
            done = at = end
            n += 1
    return ("".join([*out, text[done:]]), n) if n else (text, 0)


def masked(text: str) -> tuple[str, int]:
    """Secrets of all kinds masked in one text, without Spark; what protect() does to a column."""
    text, n = without_assigned(text)
    for form in KNOWN:
        text, k = re.subn(form, MASK, text)
        n += k
    text, k = re.subn(URL, rf"\g<1>{MASK}:{MASK}@", text)
    return text, n + k


def is_trailer(line: str) -> bool:
    """Whether a line is a key of people or of a change, and a value: keys that end in -by, and the listed ones."""
    key, mark, _ = line.partition(":")
    key = key.strip(" \t").lower()
    return bool(mark) and not re.search(r"\s", key) and (key in TRAILERS or key.endswith("-by") and len(key) > 3)


def without_trailers(text: str) -> tuple[str, int]:
    """The text less its last paragraph, if every line of that is a trailer; and how many lines went."""
    lines = text.rstrip().split("\n")
    last = len(lines)
    while last and lines[last - 1].strip():
        last -= 1
    if not any(lines[last:]) or not all(map(is_trailer, lines[last:])):
        return text, 0
    return "\n".join(lines[:last]).rstrip("\r\n"), len(lines) - last


_OWN = T.StructType([T.StructField("text", T.StringType()), T.StructField("secrets", T.IntegerType()), T.StructField("trailers", T.IntegerType())])


@F.pandas_udf(_OWN)
def own_secrets(texts: pd.Series) -> pd.DataFrame:
    """Each text without trailers and with its assigned secrets masked, and how many of both there were; null stays null."""

    def one(text: str | None) -> tuple:
        if text is None:
            return None, 0, 0
        kept, trailers = without_trailers(text)
        return *without_assigned(kept), trailers

    return pd.DataFrame([one(t) for t in texts], columns=["text", "secrets", "trailers"])


def pseudonyms(people: DataFrame) -> DataFrame:
    """request, form, pseudonym, shown: what each way to name a person becomes within one request.

    people: request, seq, name, mail. People are one if they share a mail, never for a
    name alone; they are numbered by first appearance. A name that several people of a
    request bear is that of the first; names of one word aren't forms, as they look like
    words of the text.
    """
    rows = people.select("request", "seq", F.trim("name").alias("name"), F.lower(F.trim("mail")).alias("mail"))
    one = rows.withColumn("who", F.coalesce("mail", F.lower("name"))).where("who is not null")
    # a request's people, so a small window group
    first = one.groupBy("request", "who").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("shown"))
    numbered = first.select("request", "who", F.coalesce("shown", "who").alias("shown"), "seq", F.concat(F.lit("person-"), F.row_number().over(Window.partitionBy("request").orderBy("seq", "who")).cast("string")).alias("pseudonym"))
    forms = one.select("request", "who", F.explode(F.array("mail", F.when(F.contains("name", F.lit(" ")), F.lower("name")))).alias("form")).where("form is not null").distinct()
    return forms.join(numbered, ["request", "who"]).groupBy("request", "form").agg(F.min_by("pseudonym", "seq").alias("pseudonym"), F.min_by("shown", "seq").alias("shown"))


def _replaced(text: Column, pairs: Column, old: str, new: str, head: str, tail: str) -> Column:
    """The text with pairs replaced one after the other, longest first."""
    ordered = F.array_sort(pairs, lambda a, b: F.when(F.length(a[old]) != F.length(b[old]), F.length(b[old]) - F.length(a[old])).when(a[old] < b[old], -1).when(a[old] > b[old], 1).otherwise(0))
    literal = lambda s, marks: F.regexp_replace(s, marks, r"\\$0")
    return F.aggregate(ordered, text, lambda t, p: F.regexp_replace(t, F.concat(F.lit(head), literal(p[old], r"[^\w\s-]"), F.lit(tail)), literal(p[new], r"[\\$]")))


def hidden(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """Texts (request, text) with every known form replaced by its pseudonym, whole forms only, in any case."""
    own = forms.groupBy("request").agg(F.collect_list(F.struct("form", "pseudonym")).alias("_forms"))
    shown = _replaced(F.col("text"), F.col("_forms"), "form", "pseudonym", r"(?iuU)(?:(?<=^)|(?<=[^\w.@-]))", r"(?=$|[^\w@-])")
    return texts.join(own, "request", "left").withColumn("text", F.when(F.col("_forms").isNull(), F.col("text")).otherwise(shown)).drop("_forms")


def restored(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """The inverse: pseudonyms of a request become what is shown for them; numbers that it never gave out stay."""
    own = forms.groupBy("request").agg(F.collect_set(F.struct("pseudonym", "shown")).alias("_forms"))
    shown = _replaced(F.col("text"), F.col("_forms"), "pseudonym", "shown", r"\b", r"\b(?!-?\w)")
    return texts.join(own, "request", "left").withColumn("text", F.when(F.col("_forms").isNull(), F.col("text")).otherwise(shown)).drop("_forms")


def leaks(text: Column) -> Column:
    """Whether an e-mail, a known form of a secret or credentials still stand in what would be sent."""
    known = _holds(text, *(m for marks in MARKS for m in marks)) & F.rlike(text, F.lit("|".join(KNOWN)))
    return (_holds(text, "@") & F.rlike(text, F.lit(EMAIL))) | known | _holds(text, "://") & F.rlike(F.replace(text, F.lit(f"{MASK}:{MASK}@"), F.lit("")), F.lit(URL))


def protect(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each text as one request: protected, secrets, identities, trailers, refused.

    protected is null where something still leaks (refused); the counts tell what was
    withheld, without any value. Mails are numbered by first appearance in their text.
    Null texts give null and zeros; all other columns stay.
    """
    known = rows.withColumn("_own", own_secrets(F.col(text))).withColumn("_known", known_secrets(F.col("_own.text"))).withColumn("_mails", F.transform(emails(F.col("_known")), F.lower))
    # what stands between mails, each followed by the pseudonym of the mail behind it
    between = F.when(F.size("_mails") > 0, F.split("_known", EMAIL, -1))
    number = lambda i: F.array_position(F.array_distinct("_mails"), F.get(F.col("_mails"), i)).cast("string")
    shown = F.array_join(F.transform(between, lambda t, i: F.when(i < F.size("_mails"), F.concat(t, F.lit("person-"), number(i))).otherwise(t)), "")
    out = known.withColumn("_shown", F.when(F.size("_mails") > 0, shown).otherwise(F.col("_known")))
    refused = F.coalesce(leaks(F.col("_shown")), F.lit(False))
    return out.select(
        *[F.col(c) for c in rows.columns],
        F.when(~refused, F.col("_shown")).alias("protected"),
        (F.coalesce("_own.secrets", F.lit(0)) + F.coalesce(known_count(F.col("_own.text")), F.lit(0))).alias("secrets"),
        F.when(F.col("_mails").isNull(), 0).otherwise(F.size(F.array_distinct("_mails"))).alias("identities"),
        F.coalesce("_own.trailers", F.lit(0)).alias("trailers"),
        refused.alias("refused"),
    )
