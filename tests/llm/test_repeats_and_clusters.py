"""Removal of repeated strings, the audit of sources and the clustering, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import divergence, prefix_free, yinyang


def removed_by_hand(texts, length):
    """Per text: n_bytes, n_removed, n_spans, kept_sha256, by a count of every string."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def table_of(spark, texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, uid int, spans string").repartition(3)


def removed(spark, texts, length, **limits):
    rows = prefix_free.deduplicated(table_of(spark, texts), length, **limits).collect()
    assert len(rows) == len(texts)
    return [tuple(r)[1:] for r in sorted(rows)]


def passages(seed):
    """Texts that share passages of many lengths, with changed letters, runs of one letter, copies, and texts within texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(rng.randint(10, 60)) for _ in range(6)]
    texts = ["", None, "short", "a" * 700, "b" * 90 + "a" * 650, "ab" * 300, shared[0], shared[0], shared[0] + "!" + shared[0]]
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else fresh(rng.randint(1, 30)) for _ in range(rng.randint(1, 4))]
        text = "".join(parts)
        if rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz日") + text[at + rng.randint(0, 2) :]
        a = rng.randrange(len(text))
        texts.append(text[a:] if rng.random() < 0.3 else text)
    return texts


@pytest.mark.parametrize("length", [60, 150, 400])
def test_removed_as_by_hand(spark, length):
    texts = passages(length)
    assert removed(spark, texts, length) == removed_by_hand(texts, length)


def test_crowded_runs_and_hot_contexts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "ORDERED", 600)
    rng = random.Random(3)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(220))
    side = lambda: "".join(rng.choice("xy") for _ in range(rng.randint(0, 40)))
    texts = [side() + middle + side() for _ in range(150)] + [middle] * 20
    assert removed(spark, texts, 230, crowd=3, hot=4) == removed_by_hand(texts, 230)
    assert removed(spark, texts, 100, crowd=3, hot=4) == removed_by_hand(texts, 100)


def test_long_texts_go_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "PARSED", 500)
    texts = [" ".join(x for x in passages(9) if x), *passages(9)[:12], "c" * 3000]
    assert removed(spark, texts, 120) == removed_by_hand(texts, 120)


def test_strings_within_one_text_overlap(spark):
    texts = ["q" * 41, "q" * 40, "zz" + "abcd" * 20 + "yy"]
    assert removed(spark, texts, 40) == removed_by_hand(texts, 40)
    kept = prefix_free.deduplicated(table_of(spark, texts), 40, keep_texts=True).orderBy("doc_id").collect()
    assert [bytes(r.kept) for r in kept] == [b"", b"", b"zzyy"] and kept[2].spans == [2, 82]


def test_passages_of_over_50_words_go_from_the_length_on(spark):
    rng = random.Random(5)
    fresh = lambda n, size: " ".join("".join(rng.choices("abcdefghijklm", k=size)) for _ in range(n))
    shared = [fresh(51, 4), fresh(51, 5), fresh(60, 6)[:399], fresh(60, 6)[:400], fresh(90, 6)]
    assert all(len(x.split()) > 50 for x in shared)
    texts = [fresh(20, 5) + mark + x + mark + fresh(20, 5) for x in shared for mark in "<>"] + [fresh(90, 5) for _ in range(4)]
    for length in (prefix_free.LENGTH, len(shared[0])):
        rows = removed(spark, texts, length)
        assert [r[1] for r in rows] == [len(x) * (len(x) >= length) for x in shared for _ in "<>"] + [0] * 4
        assert rows == removed_by_hand(texts, length)


def test_no_texts(spark):
    assert removed(spark, [], 40) == []


def test_strings_have_one_trigger_wherever_they_stand():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 3000).astype("u1")
    moved = np.concatenate([rng.integers(97, 101, 77).astype("u1"), data])
    ends = lambda x: np.array([0, len(x)])
    of = lambda x: {s: (t - s) for a, b, t in zip(*(y.tolist() for y in prefix_free.contexts(x, ends(x), 200)[:3]), strict=True) for s in range(a, b + 1)}
    own, other = of(data), of(moved)
    assert len(own) == 2801 and all(other[s + 77] == t for s, t in own.items())
    assert len(prefix_free.contexts(data, ends(data), 200)[0]) < 100
    assert not len(prefix_free.contexts(data[:10], np.array([0, 4, 10]), 200)[0])


def test_least_is_the_first_of_the_least():
    rng = np.random.default_rng(2)
    for n, width in ((50, 7), (21, 21), (20, 21), (0, 3), (64, 1)):
        values = rng.integers(0, 5, n).astype(np.uint64) << np.uint64(32)
        assert prefix_free.least(values, width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(n - width + 1)]


def test_merge():
    assert prefix_free.merge([5, 9, 0, 3, 3, 4, 8, 12, 20, 21]) == [0, 4, 5, 12, 20, 21] and prefix_free.merge([]) == []


def audited_by_hand(rows, least, top):
    count, docs, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        docs.update((lang, t) for t in set(found))
        count.update((lang, source, t) for t in found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (own, t), n in docs.items() if own == lang and n >= least)
        sources = sorted(s for own, s in groups if own == lang)
        number = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        number[None] = {t: sum(number[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(of.values()) + 5 * len(kept)) for t, n in of.items()} for s, of in number.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - p[None][t], t) for t in kept if number[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(out)


def test_audit_as_by_hand(spark):
    rng = random.Random(5)
    words = ["Zeta", "zeta", "ÀB", "àb", "naïve", "don't", "x1y", "日本", "rare", "É", "\x00nul", "q_r"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", None, "Ä", "z"]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("xx", "only", "nothing kept"), ("yy", "a", None), ("yy", "b", ""), *[("en", "a", "same row Zeta")] * 7, ("en", "long", "Zeta " * 5000)]
    df = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "lang string, source string, text string, n int, term string, rank int")
    for least, top in ((3, 4), (30, 50), (1, 1)):
        assert sorted(tuple(r) for r in divergence.audit(df, least, top).collect()) == audited_by_hand(rows, least, top)
    assert divergence.audit(df.limit(0)).collect() == []


def clustered_by_hand(rows, size, clusters, rounds):
    kept = [(i, tuple(int(np.floor(64 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, v) for i, v in kept)[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((apart(v, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [tuple(sum(x) // len(own[k]) for x in zip(*own[k], strict=True)) if k in own else c for k, c in enumerate(centres)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    of = Counter()
    for _, k, d in found:
        of[k] += d
    return sorted((i, k, d, of[k], sum(of.values()), hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest()) for i, k, d in found)


def vectors(seed, n, size, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, size))
    rows = [(i, [float(x) for x in middle[i % 5] + rng.normal(0, spread, size)]) for i in range(n)]
    odd = [[0.0] * (size - 1), [0.0] * (size + 1), [None, *[0.0] * (size - 1)], [float("nan")] * size, [float("inf"), *[0.0] * (size - 1)], None, []]
    return rows + [(1000 + k, v) for k, v in enumerate(odd)] + rows[:4] + [(2000 + k, [0.5] * size) for k in range(9)]


@pytest.mark.parametrize(("size", "clusters", "rounds", "groups", "scale"), [(4, 6, 3, 3, 1.0), (8, 16, 3, 4, 0.1), (2, 5, 6, 2, 3.0), (3, 4, 2, 9, 30_000.0), (4, 1, 3, 4, 1.0)])
def test_clusters_as_by_hand(spark, size, clusters, rounds, groups, scale):
    rows = [(i, v and [x if x is None else x * scale for x in v]) for i, v in vectors(size, 160, size, 0.4)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = yinyang.cluster(df, size=size, clusters=clusters, rounds=rounds, groups=groups).drop("measured")
    assert sorted(tuple(r) for r in got.collect()) == clustered_by_hand(rows, size, clusters, rounds)


def test_bounds_spare_measuring(spark):
    rows = vectors(2, 400, 16, 0.05)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    measured = yinyang.cluster(df, size=16, clusters=16, rounds=4).agg(F.avg("measured")).first()[0]
    assert measured < 6


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 4.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = yinyang.cluster(df, size=2)
    assert sorted((r.vec_id or 0, r.distance) for r in got.collect()) == [(0, 0), (1, 0), (1, 0)]
    assert yinyang.cluster(df, size=3).collect() == []
    assert got.drop("measured").columns == yinyang.cluster(df, size=3).drop("measured").columns
