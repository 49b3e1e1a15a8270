"""Benchmark decontamination by templates.

Texts become sequences of template tokens: words in lower case, and the
placeholders <num>, <name> and <unit> for numbers, for names and for units behind a
number; what a placeholder replaced is its slot. Names are words that the benchmark
has in capitalised form only, or not at all, and capitalised words within a
sentence; capitalised names side by side are one. Windows of template tokens are
joined by hash between documents and benchmark items, and slots are checked along a
match: each value of the item has to stand for one value of the document, though two may
become one. So a question with other numbers, names or units is still the same question;
one whose people change on the way is another, unless it is as written but for that place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bit_filter, blocks, bounds, column, held_bits, ragged_take, shared_dir, written

#: Template tokens in a window, and how many of them must be words.
WINDOW = 5
LITERALS = 3
#: A document holds an item if it has this share of the item's windows, slots agreeing.
SHARE = 0.5
#: So many of an item's windows have to match in any case, or all if it has fewer.
LEAST = 4
#: Tokens that an item without any window needs to be sought as a whole, as it is written; shorter ones say too little.
LEAST_TOKENS = 4
#: Bytes of text that a task holds at once.
TEXT_BYTES = 1 << 20
#: Words of a name at most; longer runs of capitalised words are read word by word.
NAME_WORDS = 4
#: Bits of the filter of words: its size is fixed, whatever the benchmark's.
WORD_BITS = 1 << 22
#: Windows of the benchmark up to which they are broadcast to the join; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 200_000

#: Fixed values.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes pound pounds lb lbs ounce ounces oz "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin meter meters metre metres kmh mph hz khz mhz ghz "
    "w kw mw volt volts watt watts joule joules kb mb gb tb byte bytes"
).split()
#: Words that open English sentences and are no names, whether the benchmark has them in lower case or not.
OPENERS = (
    "a an the if when how what who whose where why which while there this that these those it he she they we you i in on at by for from to of with as and but or so "
    "then after before during each every all some any no one suppose given find let consider calculate determine write is are was were do does did can could will would has have had"
).split()

_word = re.compile(r"[^\W_]+(?:[.,][0-9]+)*").findall
_number = re.compile(r"[0-9]+(?:[.,][0-9]+)*").fullmatch
_stop = re.compile(r"[.!?:;\"”)\]]$").search
_NUM, _NAME, _UNIT, _LIT = range(4)
_PLACE = {_NUM: "<num>", _NAME: "<name>", _UNIT: "<unit>"}
_units, _numbers = frozenset(UNITS), frozenset(NUMBER_WORDS)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_CODES = np.array([_hash(_PLACE[k]) for k in (_NUM, _NAME, _UNIT)], dtype="<u8")


def _capitalised(token: str) -> bool:
    return len(token) > 1 and token[0].isupper() and token[1:].islower()


class Templates:
    """The template tokens of a block of texts end to end: hash, kind, first and last word; `ends` bounds texts.

    known: a broadcast filter of the benchmark's words; without one every word counts as known.
    """

    def __init__(self, text: pa.Array, known=None):
        parts = pc.ascii_split_whitespace(text)
        offsets = np.asarray(parts.offsets).astype(np.int64)
        inner = parts.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(parts) else pa.array([], pa.large_string())
        coded = inner.dictionary_encode()
        offsets -= offsets[0]
        number: dict[str, int] = {}
        flat, lengths, stops, marks = [], [], [], []
        for w in coded.dictionary.to_pylist():
            own = _word(w)
            lengths.append(len(own))
            stops.append(bool(_stop(w)))
            marks.append(not w[-1:].isalnum())
            flat += [number.setdefault(t, len(number)) for t in own]
        self.tokens = list(number)
        codes = np.asarray(coded.indices).astype(np.int64)
        self.ids, each = ragged_take(bounds(np.asarray(lengths, dtype=np.int64)), np.asarray(flat, dtype=np.int64), codes)
        places = bounds(each)
        words = places[offsets]
        n = len(self.ids)
        self.lower = [t.lower() for t in self.tokens]
        self.plain = np.array([_hash(t) for t in self.lower], dtype="<u8") if n else np.zeros(0, "<u8")
        self.whole = self.plain[self.ids] if n else np.zeros(0, "<u8")
        self.words = words
        capital = np.array([_capitalised(t) for t in self.tokens], dtype=bool)
        self.common = sorted({*OPENERS, *(t for t, c in zip(self.lower, capital.tolist(), strict=True) if not c)})
        if not n:
            self.kinds, self.hashes, self.first, self.ends = np.zeros(0, np.int8), np.zeros(0, "<u8"), np.zeros(1, np.int64), words
            return
        is_num = np.array([bool(_number(t)) or t in _numbers for t in self.lower], dtype=bool)
        is_unit = np.array([t in _units for t in self.lower], dtype=bool)
        heard = held_bits(known, self.plain) if known is not None else np.ones(len(self.plain), bool)
        begins = np.zeros(n + 1, dtype=bool)
        begins[words[:-1]] = True
        behind_mark = begins.copy()
        initial = begins.copy()
        initial[places[1:][np.asarray(stops, dtype=bool)[codes]]] = True
        behind_mark[places[1:][np.asarray(marks, dtype=bool)[codes]]] = True
        initial, behind_mark = initial[:n], behind_mark[:n]
        num = is_num[self.ids]
        behind = np.append(False, num[:-1]) & ~begins[:n]
        name = (capital[self.ids] & ~initial) | ~heard[self.ids]
        kinds = np.full(n, _LIT, dtype=np.int8)
        kinds[name] = _NAME
        kinds[is_unit[self.ids] & behind] = _UNIT
        kinds[num] = _NUM
        # capitalised names side by side are one, if they aren't too many
        upper = (kinds == _NAME) & capital[self.ids]
        joins = upper & np.append(False, upper[:-1]) & ~behind_mark
        run = np.cumsum(~joins) - 1
        joins &= np.bincount(run)[run] <= NAME_WORDS
        self.first = np.append(np.nonzero(~joins)[0], n)
        self.kinds = kinds[self.first[:-1]]
        self.hashes = np.where(self.kinds == _LIT, self.whole[self.first[:-1]], _CODES[np.minimum(self.kinds, _UNIT)])
        self.ends = np.searchsorted(self.first, words)

    def windows(self, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, text number and hash of each window that has enough words and lies in one text."""
        n = len(self.kinds) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u8")
        hashes, words = np.zeros(n, dtype="<u8"), np.zeros(n, dtype=np.int16)
        for k in range(width):
            hashes = hashes * np.uint64(_BASE) + self.hashes[k : k + n]
            words += self.kinds[k : k + n] == _LIT
        hashes ^= hashes >> np.uint64(29)
        whose = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))[:n]
        good = (words >= literals) & (np.arange(n) + width <= self.ends[1:][whose])
        at = np.nonzero(good)[0]
        return at, whose[at], hashes[at]

    def verbatim(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of all runs of so many words as they are written: differences of one running sum, whatever the width."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u8")
        power = np.ones(len(self.ids) + 1, dtype="<u8")
        power[1:] = _BASE
        back = np.ones(n, dtype="<u8")
        back[1:] = pow(_BASE, -1, 1 << 64)
        power, back = np.cumprod(power, dtype="<u8"), np.cumprod(back, dtype="<u8")
        sums = np.zeros(len(self.ids) + 1, dtype="<u8")
        np.cumsum(self.whole * power[:-1], out=sums[1:])
        hashes = (sums[width:] - sums[:n]) * back + np.uint64(width)
        hashes ^= hashes >> np.uint64(29)
        whose = np.repeat(np.arange(len(self.words) - 1), np.diff(self.words))[:n]
        at = np.nonzero(np.arange(n) + width <= self.words[1:][whose])[0]
        return at, whose[at], hashes[at]

    def rendered(self, at: int, width: int) -> tuple[str, list[str]]:
        """A window's template and its slots."""
        own = [(int(self.kinds[k]), " ".join(self.lower[i] for i in self.ids[self.first[k] : self.first[k + 1]].tolist())) for k in range(at, at + width)]
        return " ".join(_PLACE.get(k, t) for k, t in own), [t for k, t in own if k != _LIT]

    def written(self, at: int, width: int) -> str:
        return "= " + " ".join(self.lower[i] for i in self.ids[at : at + width].tolist())


_WINDOW = "key long, pos int, width int, hash long, template string, slots array<string>"


def template_windows(rows: DataFrame, key: str, known, width: int = WINDOW, literals: int = LITERALS, only=None, widths: tuple[int, ...] = ()) -> DataFrame:
    """key, pos, width, hash, template and slots of each window.

    known: a broadcast filter of the benchmark's words. only: a broadcast filter that a
    window's hash has to pass. widths: of the runs of words to take as they are written;
    without a filter, texts without any window give one such run, the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, TEXT_BYTES):
            found = Templates(column(block, "text"), known)
            keys = column(block, "key")
            sets = [(width, found.windows(width, literals), found.ends, False)]
            if only is None:
                sizes, have = np.diff(found.words), np.bincount(sets[0][1][1], minlength=block.num_rows)
                for i in np.nonzero((have == 0) & (sizes >= LEAST_TOKENS))[0].tolist():
                    w = int(sizes[i])
                    at, whose, hashes = found.verbatim(w)
                    sets.append((w, (at[whose == i], whose[whose == i], hashes[whose == i]), found.words, True))
            sets += [(w, found.verbatim(w), found.words, True) for w in widths]
            for w, (at, whose, hashes), ends, plain in sets:
                if only is not None:
                    passed = held_bits(only, hashes)
                    at, whose, hashes = at[passed], whose[passed], hashes[passed]
                taken = keys.take(pa.array(whose))
                for a in range(0, len(at), 50_000):
                    b = min(len(at), a + 50_000)
                    shown = [(found.written(int(p), w), []) if plain else found.rendered(int(p), w) for p in at[a:b]]
                    yield pa.RecordBatch.from_arrays([taken.slice(a, b - a), pa.array((at[a:b] - ends[whose[a:b]]).astype(np.int32)), pa.array(np.full(b - a, w, np.int32)), pa.array(hashes[a:b].view("<i8")), pa.array([t for t, _ in shown], pa.string()), pa.array([s for _, s in shown], pa.list_(pa.string()))], names=["key", "pos", "width", "hash", "template", "slots"])

    inner = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return inner.mapInArrow(run, _WINDOW)


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """hash of every word that the benchmark has otherwise than capitalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            found = Templates(column(block, "text")).common
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(_hash, found), dtype="<u8", count=len(found)).view("<i8"))], names=["hash"])

    return benchmark.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "hash long")


def contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """One row for each document and the benchmark item that it holds: doc_id, item_id, n_windows (of the item), n_matched, n_slots, same_slots (false: other values in the slots).

    A document holds an item if it has `share` of the item's windows, and LEAST of them or
    all. Windows at one distance count if an item's value always stands for one value of
    the document (two values may become one). If all values stand for themselves but for
    one place, the windows without that place count. An item without a window
    (fewer than `width` tokens, or hardly a word among numbers) is sought as it is written,
    from LEAST_TOKENS tokens on; shorter ones match nothing.

    documents: doc_id, text; benchmark: item_id, text; other columns are ignored. Null
    texts count as empty. Rows that share a doc_id, or an item_id, count as one text.
    Items with null ids are left out, as nothing could name them. Empty tables give an
    empty result; texts are read whole.
    """
    spark = documents.sparkSession
    told = benchmark.where("item_id is not null")
    known = spark.sparkContext.broadcast(bit_filter(benchmark_words(told), WORD_BITS))
    items = written(template_windows(told, "item_id", known, width, literals), shared_dir(spark, "benchmark-windows"))
    sizes = items.groupBy(F.col("key").alias("item_id")).agg(F.countDistinct("pos").alias("n_windows"))
    widths = tuple(sorted(r.width for r in items.where(F.startswith("template", F.lit("= "))).select("width").distinct().collect()))  # lengths of items without windows
    kept = spark.sparkContext.broadcast(bit_filter(items))
    own = template_windows(documents, "doc_id", known, width, literals, kept, widths).select(F.col("key").alias("doc_id"), F.col("pos").alias("at"), "hash", "template", F.col("slots").alias("doc_slots"))
    asked = items.select(F.col("key").alias("item_id"), "pos", "hash", "template", F.col("slots").alias("item_slots"))
    if items.count() <= BROADCAST_WINDOWS:
        asked = F.broadcast(asked)
    pairs = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda x: F.struct(x["item_slots"].alias("i"), x["doc_slots"].alias("d")))
    matches = own.join(asked, ["hash", "template"]).select("doc_id", "item_id", "pos", (F.col("at") - F.col("pos")).alias("shift"), pairs.alias("pairs"))
    # an item's windows and slots bound each set
    runs = matches.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.struct("pos", "pairs")).alias("windows")).withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
    strays = lambda pairs: F.size(F.filter(pairs, lambda p: ~p["i"].eqNullSafe(p["d"])))
    others = F.size("pairs") - F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    runs = runs.withColumn("others", others).withColumn("strays", strays(F.col("pairs"))).where("others = 0 or (others = 1 and strays = 1)")
    counted = F.when(F.col("others") == 0, F.col("windows")).otherwise(F.filter("windows", lambda w: strays(w["pairs"]) == 0))
    slots, same = F.size("pairs") - F.col("others"), F.col("strays") == F.col("others")
    each = runs.select("doc_id", "item_id", slots.alias("slots"), same.alias("same"), F.explode(counted).alias("w")).withColumn("pos", F.col("w.pos"))
    places = each.groupBy("doc_id", "item_id", "pos").agg(F.max("slots").alias("slots"), F.max("same").alias("same"))
    found = places.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_matched"), F.max("slots").cast("long").alias("n_slots"), F.min("same").alias("same_slots"))
    enough = F.greatest(F.lit(share) * F.col("n_windows"), F.least(F.col("n_windows"), F.lit(LEAST)))
    return found.join(sizes, "item_id").where(F.col("n_matched") >= enough).select("doc_id", "item_id", "n_windows", "n_matched", "n_slots", "same_slots")
