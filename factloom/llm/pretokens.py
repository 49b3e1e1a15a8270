"""Splitting texts into the pieces that a byte-level BPE encodes one by one, a block of texts at a time.

Texts are cut before single spaces first: no piece crosses such a place, and the
cut parts repeat so often that the splitting pattern runs over distinct parts
only. Texts in which white space precedes a space are matched as a whole.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

from factloom.llm.common import WHITE_SPACE, bounds, column, ragged_take

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN = "[^\x00-\u024f]"
#: White space before a space: such a text isn't cut there.
_IRREGULAR = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def latin(pattern: str) -> str:
    """The pattern with classes spelled out for Latin letters, for the faster standard module."""
    out = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    out = out.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE_SPACE}{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
    return out.replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")


@functools.lru_cache(maxsize=8)
def splitter(pattern: str):
    """text -> pieces. Parts of Latin letters go through the faster standard module, by the same rules."""
    exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
    if r"[^\s\p{L}\p{N}]" not in pattern:
        return exact
    quick, beyond = re.compile(latin(pattern)).findall, re.compile(_LATIN).search
    return lambda text: exact(text) if beyond(text) else quick(text)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: a base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """Token-byte table by id; ids that the file leaves out are empty."""
    own = ranks(path)
    out = [b""] * (max(own.values()) + 1)
    for token, rank in own.items():
        out[rank] = token
    return out


def pieces_of(rows: pa.Table, pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of a block of texts, the numbers of the pieces of all texts end to end, and how many each text has."""
    split = splitter(pattern)
    text = column(rows, "text")
    number: dict[str, int] = {}
    odd = np.asarray(pc.match_substring_regex(text, _IRREGULAR))
    plain = text.filter(pa.array(~odd)) if odd.any() else text
    parts = pc.split_pattern(plain, " ")
    offsets = np.asarray(parts.offsets).astype(np.int64)
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode() if len(parts) else pa.array([], pa.large_string()).dictionary_encode()
    offsets = offsets - offsets[0]
    unit = np.asarray(coded.indices).astype(np.int64) * 2 + 1
    unit[offsets[:-1]] -= 1
    used = np.unique(unit)
    words = coded.dictionary.to_pylist()
    values: list[int] = []
    lengths = np.empty(len(used), dtype=np.int64)
    for k, u in enumerate(used.tolist()):
        found = split(f" {words[u >> 1]}" if u & 1 else words[u >> 1])
        lengths[k] = len(found)
        values += [number.setdefault(p, len(number)) for p in found]
    place = np.zeros(2 * max(1, len(words)), dtype=np.int64)
    place[used] = np.arange(len(used))
    flat, each = ragged_take(bounds(lengths), np.asarray(values, dtype=np.int64), place[unit])
    ends = bounds(each)
    per_text = ends[offsets[1:]] - ends[offsets[:-1]]
    if not odd.any():
        return list(number), flat, per_text
    whole, counts, at = [], np.zeros(len(odd), dtype=np.int64), bounds(per_text)
    counts[~odd] = per_text
    k = 0
    for i, is_odd in enumerate(odd.tolist()):
        if is_odd:
            found = np.asarray([number.setdefault(p, len(number)) for p in split(text[i].as_py())], dtype=np.int64)
            counts[i] = len(found)
        else:
            found = flat[at[k] : at[k + 1]]
            k += 1
        whole.append(found)
    return list(number), np.concatenate(whole), counts
