"""An audit of how far the sources of a language differ in their words.

All of it is relational: terms are exploded and counted by group, the vocabulary that
a language keeps is crossed with its groups so that absent terms count zero, groups meet
term by term, and windows rank what comes out. Arithmetic is in whole numbers.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import shared_dir, written

#: What stands between terms, which are runs of ASCII letters and of characters beyond ASCII (fixed value).
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in, what is added to each count, and how many terms of a group are listed.
LEAST, ADDED, TOP = 30, 5, 50
#: Parts that a language's vocabulary is dealt out to when it meets the language's groups: there are few languages, and one may hold most.
DEALT = 64
_UNIT = 1_000_000_000


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term); nulls count as ''.

    A row's terms are sorted and each is put beside the one before it, so that the first of
    equal ones is known where it stands: one explode and one count, partial before the
    shuffle, give both numbers.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = documents.select(*own).select("lang", "source", F.sort_array(F.split(lower, BETWEEN)).alias("found"))
    beside = F.arrays_zip(F.col("found").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "found").alias("former"))
    terms = found.select("lang", "source", F.inline(beside)).where("term <> ''")
    return terms.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("former"))).alias("docs"))


def share(count: Column, total: Column, kept: Column, added: int = ADDED) -> Column:
    """1 + floor(10^9 (count + added) / (total + added * kept)), exactly: decimals of 38 digits hold the product."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    over, under = wide(F.lit(_UNIT), 10) * wide(count + F.lit(added), 20), wide(total + F.lit(added) * kept, 20)
    return F.call_function("div", over, under) + F.lit(1)


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that a source has more of than its language.

    Every (lang, source) that occurs has a `pair` row for each other source of its lang,
    also where the lang keeps no term (value 0); without other sources it has none. Equal
    values rank by item. Repeated rows count each; an empty table gives an empty result;
    other columns aren't read.
    """
    spark = documents.sparkSession
    own = Window.partitionBy("lang", "term")  # a row for each source
    sums = {"lang_n": F.sum("n").over(own), "lang_docs": F.sum("docs").over(own)}
    present = term_counts(documents).withColumns(sums).where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")
    present = written(present, shared_dir(spark, "kept-counts"))
    kept = present.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    groups = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang", "left")
    sized = written(sized, shared_dir(spark, "group-totals"))

    own = present.join(sized, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = own.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    dealt = kept.select("lang", "term", F.pmod(F.xxhash64("term"), F.lit(DEALT)).alias("deal"))
    everywhere = sized.where("kept > 0").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    dense = dealt.join(everywhere, ["lang", "deal"]).join(present.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left")
    dense = dense.select("lang", "source", "term", share(F.coalesce("n", F.lit(0)), F.col("total"), F.col("kept")).alias("p"))
    other = dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"))
    # each two groups once: the distance is the same from both sides
    apart = dense.join(other, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(F.abs(F.col("p") - F.col("other_p"))).alias("value"))
    both = groups.join(groups.withColumnRenamed("source", "other"), "lang").where("source < other").join(apart, ["lang", "source", "other"], "left").fillna(0, ["value"])
    sides = F.inline(F.array(F.struct(F.col("source").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = both.select("lang", "value", sides).withColumn("rank", F.row_number().over(order))

    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
