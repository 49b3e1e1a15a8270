"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

The kernel compares words, with marks at their ends. Two words are as similar as they
share subsequences of three characters, each weighted by decay ** (its span - 3), gaps
included up to a span of six; so inserted, dropped and spaced-out characters leave
most of a word's subsequences in place.

Labels say which texts are toxic, not which words, so the machine is fitted to labelled
texts as bags of words: a text counts by the word of it that the machine likes most.
First candidates are words with a gram that toxic texts have in far more surroundings
than others do; the machine is fitted, picks each labelled text's word anew, and is
fitted to these picks, positive from toxic texts and negative from the others, for a few
rounds. The border is then laid where it divides labelled texts best.

Training takes a bounded, documented sample; counts are made by Spark, and what the
driver gets of them is bounded by parameters. Scoring takes every word of every text.
As the kernel's features are explicit, the machine's sum over landmarks folds into
one weight for each subsequence, and a word is scored by looking those up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, bounds, column, shared_dir, texts, written

#: Labelled documents of each class that training reads at most.
SAMPLE = 2500
#: Words of each class that one fit takes at most, those that most texts were picked by first, and landmarks of each class.
WORDS, LANDMARKS = 4_000, 112
#: Fits to the words that labelled texts were picked by.
ROUNDS = 3
#: How many times more often toxic texts have to have a gram for its words to be first candidates. Labels may be wrong in one text of about as many.
RATIO = 20
#: The kernel: longest span and decay for each character of a gap.
SPAN, DECAY = 6, 0.5
#: Characters with a number of their own, the commonest of the words fitted to; and numbers that others share, by their code points.
ALPHABET, SHARED = 40, 7
#: Longest piece of a word that is scored at once; longer words are scored by overlapping pieces.
PIECE = 32
#: A document is predicted toxic from this score.
CUT = 0.3

_drop = re.compile(r"[\W_]+").sub
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def normal(word: str) -> str:
    """Lower case, letters and digits only, with marks at both ends; empty if nothing is left."""
    inner = _drop("", word.lower())
    return f"^{inner}$" if inner else ""


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[k : k + PIECE] for k in range(0, len(word) - PIECE // 2, PIECE // 2)]


@dataclass
class Table:
    """A row for each subsequence that occurs in some words, by its number; row 0 is for all others."""

    index: np.ndarray
    rows: np.ndarray


class Subsequences:
    """The kernel's explicit features: numbers of three-character subsequences."""

    def __init__(self, letters: str):
        self.letters = letters
        self.number = (len(letters) + np.arange(1 << 16) % SHARED).astype(np.int32)
        for k, c in enumerate(letters):
            self.number[ord(c)] = k
        self.base = len(letters) + SHARED + 1  # the last number stands for "no character"

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.full((len(words), int(lengths.max(initial=0)) if len(words) else 0), self.base - 1, dtype=np.int32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(flat < 1 << 16, self.number[flat & 0xFFFF], len(self.letters) + flat % SHARED)
        return out, lengths

    def norms(self, lengths: np.ndarray) -> np.ndarray:
        total = sum(DECAY ** (2 * (b - 2)) * np.maximum(0, lengths - b) for _, b in _OFFSETS)
        return np.sqrt(np.maximum(total, 1e-12))

    def _numbers(self, codes: np.ndarray, a: int, b: int) -> np.ndarray:
        wide = codes.shape[1] - b
        return (codes[:, :wide] * self.base + codes[:, a : wide + a]) * self.base + codes[:, b:]

    def sums(self, words: list[str], table: Table) -> np.ndarray:
        """For each word the weighted sum of table rows over its subsequences, over the word's norm."""
        out = np.zeros((len(words), *table.rows.shape[1:]), dtype=np.float32)
        for k in range(0, len(words), 2048):
            codes, lengths = self.coded(words[k : k + 2048])
            for a, b in _OFFSETS:
                if codes.shape[1] > b:
                    out[k : k + 2048] += DECAY ** (b - 2) * table.rows[table.index[self._numbers(codes, a, b)]].sum(axis=1)
            out[k : k + 2048] /= self.norms(lengths).astype(np.float32).reshape(-1, *[1] * (table.rows.ndim - 1))
        return out

    def table(self, words: list[str]) -> Table:
        """Column k: the features of word k over its norm; subsequences with no character at their end weigh nothing."""
        each = [(k, self.coded([w])) for k, w in enumerate(words)]
        found = [(k, b, self._numbers(codes, a, b)[0]) for k, (codes, _) in each for a, b in _OFFSETS if codes.shape[1] > b]
        used = np.unique(np.concatenate([n for *_, n in found])) if found else np.zeros(0, np.int64)
        index = np.zeros(self.base**3, dtype=np.int32)
        index[used] = np.arange(1, len(used) + 1)
        rows = np.zeros((len(used) + 1, len(words)), dtype=np.float32)
        for k, b, numbers in found:
            np.add.at(rows[:, k], index[numbers], DECAY ** (b - 2))
        return Table(index, rows / self.norms(np.array([len(w) for w in words], dtype=np.int64)).astype(np.float32))


@dataclass
class Model:
    letters: str
    weights: Table  # one number for each subsequence
    shift: float
    steep: float

    def words(self, words: list[str]) -> np.ndarray:
        """Decision for normal words: over 0 for insults."""
        flat = [p for w in words for p in pieces(w)]
        each = np.fromiter((len(pieces(w)) for w in words), dtype=np.int64, count=len(words))
        values = Subsequences(self.letters).sums(flat, self.weights) + self.shift
        return np.maximum.reduceat(values, bounds(each)[:-1]) if len(words) else np.zeros(0, np.float32)

    def score(self, decision: np.ndarray) -> np.ndarray:
        """0 to 1; a decision of 0 is the cut."""
        z = np.clip(self.steep * decision + math.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def _machine(features: np.ndarray, sign: np.ndarray, cost: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss in the primal: Newton steps, each a least-squares fit to the words inside the margin."""
    x = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), dtype=bool)
    flat = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    loss = lambda v: float((cost * np.maximum(0, 1 - sign * (x @ v)) ** 2).sum() + (flat * v * v).sum())
    for _ in range(25):
        own = x[inside]
        step = np.linalg.solve((own * cost[inside, None]).T @ own + np.diag(flat), own.T @ (cost * sign)[inside]) - w
        size = 1.0
        while size > 1e-3 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        now = sign * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], w[-1]


def fit(positive: dict[str, float], negative: dict[str, float]) -> Model:
    """The machine for words and how much each counts; long words count by their pieces."""
    spread = lambda xs: [xs[k * len(xs) // LANDMARKS] for k in range(LANDMARKS)] if len(xs) > LANDMARKS else xs
    by_weight = lambda words: sorted(words, key=lambda w: (-words[w], w))[:WORDS]
    sides = [[(p, side[w] / len(pieces(w))) for w in by_weight(side) for p in pieces(w)] for side in (positive, negative)]
    letters = Counter(c for side in sides for w, _ in side for c in w if ord(c) < 1 << 16)
    kernel = Subsequences("".join(sorted(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])))
    landmarks = list(dict.fromkeys(w for side in sides for w in spread([w for w, _ in side])))
    table = kernel.table(landmarks)
    values, vectors = np.linalg.eigh(kernel.sums(landmarks, table).astype(np.float64))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6 * values.max()))) @ vectors.T
    words = [w for side in sides for w, _ in side]
    sign = np.repeat([1.0, -1.0], [len(side) for side in sides])
    cost = np.concatenate([np.array([c for _, c in side]) / sum(c for _, c in side) for side in sides]) * np.where(sign > 0, 1, 2)
    weights, shift = _machine(kernel.sums(words, table) @ root, sign, cost)
    return Model(kernel.letters, Table(table.index, (table.rows @ (root @ weights).astype(np.float32)).astype(np.float32)), float(shift), 1.0)


def border(decision: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Where texts' decisions divide toxic ones from others with the least balanced error, in the middle of the widest such gap, and half that gap."""
    order = np.argsort(decision, kind="stable")
    value, sign = decision[order], toxic[order]
    missed = np.append(0, np.cumsum(sign)) / max(1, sign.sum())
    false = (len(sign) - sign.sum() - np.append(0, np.cumsum(1 - sign))) / max(1, (1 - sign).sum())
    low, high = np.append(value[0] - 1, value), np.append(value, value[-1] + 1)
    open_ = high > low
    error = np.where(open_, missed + false, np.inf)
    best = np.nonzero(error <= error.min() + 1e-12)[0]
    k = best[np.argmax((high - low)[best])]
    return float((low[k] + high[k]) / 2), float((high[k] - low[k]) / 2)


def trainable(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learned from: crc32 of the id as text, modulo 4, isn't 2. Rows with nulls are left out, and ids that are labelled both ways."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    each = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    return each.where("toxic = _most").drop("_most")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return [n for w in text.split() if (n := normal(w))]


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the texts of at most `sample` labelled documents of each class, those first by a hash of the id.

    Where labelled texts are too few for a gram to be proven, words that are commoner in
    toxic texts than in others are the first candidates; if there is no such word, or no
    text of one class, there is no model (None), and all texts score 0.
    """
    spark, chosen = documents.sparkSession, None
    for kind in (1, 0):
        some = trainable(labels).where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * sample ids: broadcast
    read = written(texts(documents).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), shared_dir(spark, "toxicity-sample"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 20):
            found, toxic, near = [], [], []
            for text, kind in zip(column(rows, "text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
                own = ["", *words_of(text), ""]
                seen = {(w, before, after) for before, w, after in zip(own, own[1:], own[2:], strict=False)}
                found += [w for w, _, _ in seen]
                near += [f"{before} {after}" for _, before, after in seen]
                toxic += [kind] * len(seen)
            for k in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000], kind) for x, kind in ((found, pa.string()), (toxic, pa.int32()), (near, pa.string()))], names=["word", "toxic", "around"])

    each = read.mapInArrow(around, "word string, toxic int, around string").select("word", "toxic", F.xxhash64("around").alias("around")).distinct()
    words = written(each.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")), shared_dir(spark, "toxicity-words"))
    total = words.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0)).alias("o")).first()
    if not total.t or not total.o:
        return None
    grams = words.select("word", "t", "o", F.explode(F.expr("array_distinct(concat(array(word), transform(sequence(1, greatest(1, length(word) - 4)), k -> substring(word, k, 5))))")).alias("gram"))
    counts = written(grams.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), shared_dir(spark, "toxicity-grams"))
    # so often by chance with less than 1 in 1000 for any gram at all
    least = (math.log(counts.count()) + math.log(1000)) / -math.log(total.t / (total.t + total.o))
    apart = lambda: (F.col("t") > 0) & (F.col("o") * total.t * RATIO <= F.col("t") * total.o)
    marked = counts.where(apart() & (F.col("t") >= least)).select("gram")
    first = grams.where(apart()).join(marked, "gram", "left_semi").select("word", "t").distinct().orderBy(F.desc("t"), "word").limit(WORDS)
    positive = {r.word: float(min(r.t, least)) for r in first.toLocalIterator()}
    if not positive:
        commoner = words.where(F.col("o") * total.t < F.col("t") * total.o).orderBy(F.desc("t"), "o", "word").limit(WORDS)
        positive = {r.word: float(r.t) for r in commoner.select("word", "t").toLocalIterator()}
    if not positive:
        return None
    often = words.where("o > 0").orderBy(F.desc("o"), "word").limit(WORDS // 2)
    mixed = words.where("o > 0").orderBy(F.xxhash64("word"), "word").limit(WORDS // 2)
    plain = {r.word: 1.0 for r in often.unionByName(mixed).select("word").toLocalIterator() if r.word not in positive}
    if not plain:
        return None
    model = fit(positive, plain)
    for _ in range(ROUNDS):
        picked = _picked(read, model)
        rows = picked.groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").toArrow().to_pylist()  # a text gives a word, so at most 2 * sample
        toxic_texts, other_texts = ({r["word"]: float(r["n"]) for r in rows if r["toxic"] == k} for k in (1, 0))
        # words that toxic texts were picked by as seldom as others are no insults
        share = sum(other_texts.values()) / max(1.0, sum(toxic_texts.values()))
        positive = {w: n for w, n in toxic_texts.items() if n * share >= RATIO / 4 * other_texts.get(w, 0.0)} or positive
        hard = {w: n for w, n in other_texts.items() if w not in positive}
        model = fit(positive, {**plain, **{w: n + 1.0 for w, n in hard.items()}})
    rows = _picked(read, model).select("decision", "toxic").toArrow()
    place, gap = border(np.asarray(rows.column("decision")).astype(np.float64), np.asarray(rows.column("toxic")).astype(np.int64))
    model.shift -= place
    model.steep = 4 / max(0.05, gap)
    return model


def _picked(read: DataFrame, model: Model) -> DataFrame:
    """Of each text that has words: the word with the highest decision, the decision, and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 20):
            values, words = decisions(column(rows, "text"), model)
            some = pa.array(~np.isneginf(values))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).filter(some), pa.array(values, pa.float64()).filter(some), column(rows, "toxic").filter(some)], names=["word", "decision", "toxic"])

    return read.mapInArrow(run, "word string, decision double, toxic int")


def decisions(text: pa.Array, model: Model) -> tuple[np.ndarray, list[str]]:
    """The highest decision over each text's words, and over runs of four or more single letters read as one word, and that word; -inf without words."""
    parts = pc.ascii_split_whitespace(text)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    out, best = np.full(len(text), -np.inf), [""] * len(text)
    if offsets[-1] == offsets[0]:
        return out, best
    inner = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    listed = [normal(w) for w in inner.dictionary.to_pylist()]
    known = {w: k for k, w in enumerate(dict.fromkeys(w for w in listed if w))}
    values = np.append(model.words(list(known)), -np.inf)
    place = np.fromiter((known.get(w, -1) for w in listed), dtype=np.int64, count=len(listed))
    codes = np.asarray(inner.indices).astype(np.int64)
    per_word = values[place[codes]]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            k = a + int(per_word[a:b].argmax())
            out[i], best[i] = per_word[k], listed[codes[k]]
    single = np.fromiter((len(w) == 3 for w in listed), dtype=bool, count=len(listed))[codes]
    runs = np.nonzero(single[:-3] & single[1:-2] & single[2:-1] & single[3:])[0]
    whose = np.searchsorted(offsets, runs, side="right") - 1
    letters = [w[1:-1] for w in listed]
    for i in np.unique(whose[runs + 3 < offsets[whose + 1]]).tolist():
        own = codes[offsets[i] : offsets[i + 1]].tolist()
        spelled = [f"^{''.join(s.split())}$" for s in re.findall(r"(?:(?<=\s)|^)(?:\S\s){3,}\S(?=\s|$)", " ".join(letters[c] or "--" for c in own))]
        for value, word in zip(model.words(spelled).tolist(), spelled, strict=True):
            if value > out[i]:
                out[i], best[i] = value, word
    return out, best


def scored(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    documents: doc_id, text; other columns are ignored and never enter a score. Null
    and empty texts score 0, as do all texts if there is no model (no usable labels);
    repeated rows and null ids stay; an empty table gives an empty result; every word
    of a text is scored, however long text or word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1 << 20):
            own = decisions(column(rows, "text"), model)[0] if model else np.full(rows.num_rows, -np.inf)
            values = np.where(np.isneginf(own), 0.0, model.score(np.where(np.isneginf(own), 0.0, own)) if model else 0.0)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = texts(documents).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
