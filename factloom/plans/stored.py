"""Registered queries over what is stored: the reference index, ranked edges, the fact store, runs of producers, tiles of many roots."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import canonical
from factloom.operators import facts, graph, producers, tiles
from factloom.plans.catalogue import _references, query
from factloom.session import shared_base
from factloom.sources import derived
from factloom.sources.adjacency import RankedEdges
from factloom.sources.derived import ref, table
from factloom.sources.reference_index import ReferenceIndex
from factloom.sources.store import FactStore


def kept(spark: SparkSession, name: str, sf_dir: str, build: Callable[[str], object]) -> str:
    """The folder of something that is built once for a session and these tables, and then read by every query that needs it."""
    setting = f"spark.factloom.kept.{name}.{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    path = spark.conf.get(setting, None)
    if path is None:
        path = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build(path)
        spark.conf.set(setting, path)
    return path


def reference_index(spark: SparkSession, sf_dir: str) -> ReferenceIndex:
    """Customers, suppliers and parts by their names, in two batches: the second one finds an index."""

    def build(path: str) -> None:
        index = ReferenceIndex(spark, path, 5_000)
        index.update(_references(spark, sf_dir, ("customer", "customer", "c_name"), ("supplier", "supplier", "s_name")).distinct())
        index.update(_references(spark, sf_dir, ("customer", "customer", "c_name"), ("part", "part", "p_name")).distinct())

    return ReferenceIndex(spark, kept(spark, "reference-index", sf_dir, build), 5_000)


def ranked_edges(spark: SparkSession, sf_dir: str) -> RankedEdges:
    """Suppliers of parts, nations and regions as stored edges."""

    def build(path: str) -> None:
        RankedEdges(spark, path, 50_000).add(edges(spark, sf_dir))

    return RankedEdges(spark, kept(spark, "ranked-edges", sf_dir, build), 50_000)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.supplied_by(spark, sf_dir).unionByName(derived.located(spark, sf_dir)).select("subject", "relation", "object").distinct()
    return rows.withColumn("occ_id", F.xxhash64("subject", "relation", "object"))


_NAMED = "(SELECT 'customer' AS type, c_name AS name FROM customer UNION SELECT 'supplier', s_name FROM supplier UNION SELECT 'part', p_name FROM part)"


@query(f"SELECT type, type || ':' || name AS reference, lower(name) AS search_key FROM {_NAMED}")
def stored_references(spark, sf_dir):
    """S21, 2.18 (008): every row of the stored index, made in two batches that overlap."""
    return reference_index(spark, sf_dir).keyed.all().select("type", "reference", "search_key")


@query("SELECT 'customer:' || c_name AS reference FROM customer WHERE starts_with(lower(c_name), 'customer#00000001') ORDER BY lower(c_name) LIMIT 51")
def reference_prefix_search(spark, sf_dir):
    """Prefix search in the stored index, one row more than a page."""
    return reference_index(spark, sf_dir).by_prefix("Customer#00000001", "customer").select("reference")


@query(f"SELECT type || ':' || name AS reference FROM {_NAMED} WHERE starts_with(lower(name), 's') AND type = 'supplier' ORDER BY lower(name) LIMIT 51")
def stored_prefix_page(spark, sf_dir):
    """A page of a prefix and a kind from the files of its range."""
    return reference_index(spark, sf_dir).by_prefix("S", "supplier").select("reference")


@query(f"SELECT type || ':' || name AS reference FROM {_NAMED} WHERE starts_with(lower(name), 'customer#00000') AND lower(name) > 'customer#000000050' ORDER BY lower(name) LIMIT 21")
def stored_prefix_next_page(spark, sf_dir):
    """L3: the page behind a key."""
    return reference_index(spark, sf_dir).by_prefix("Customer#00000", after=("customer#000000050", "g"), limit=20).select("reference")


@query(f"SELECT type || ':' || name AS reference FROM {_NAMED} WHERE lower(name) = 'customer#000000007' OR list_contains(string_split(lower(name), '#'), '000000007')")
def stored_name_search(spark, sf_dir):
    """References by the end of their key, from the files of the name."""
    index = reference_index(spark, sf_dir)
    return index.by_name("000000007").select("reference")


@query(f"""
WITH k AS (SELECT type || ':' || name AS reference, lower(name) AS key, row_number() OVER (ORDER BY lower(name), sha256(type || ':' || name)) AS n FROM {_NAMED} WHERE lower(name) > 'm')
SELECT reference FROM k WHERE n <= 200 AND contains(key, 'r') ORDER BY n LIMIT 11""")
def stored_contains_page(spark, sf_dir):
    """Matches within the next 200 keys, from the files that hold them."""
    return reference_index(spark, sf_dir).containing("r", after=("m", "~"), limit=10, scan=200)[0].select("reference")


@query("""
WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS s, 'SUPPLIED_BY' AS r, 'supplier:' || l_suppkey AS o FROM lineitem
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'IN_REGION', 'region:' || n_regionkey FROM nation)
SELECT direction, anchor, relation, far, CAST(row_number() OVER (PARTITION BY direction, anchor, relation ORDER BY far) AS INT) AS rank
FROM (SELECT 'OUT' AS direction, s AS anchor, r AS relation, o AS far FROM e UNION ALL SELECT 'IN', o, r, s FROM e)""")
def stored_ranks(spark, sf_dir):
    """W1, 2.18 (009): stored edges of both directions with their ranks."""
    return ranked_edges(spark, sf_dir).edges().select("direction", "anchor", "relation", "far", "rank")


@query("SELECT far, CAST(rank AS INT) AS rank FROM (SELECT 'part:' || p AS far, row_number() OVER (ORDER BY 'part:' || p) AS rank FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_suppkey = 7)) WHERE rank > 20 AND rank <= 40")
def stored_neighbors_page(spark, sf_dir):
    """A page against the arrows, from the files of its ranks."""
    return ranked_edges(spark, sf_dir).page("supplier:7", "SUPPLIED_BY", "IN", 20, 20).select("far", "rank")


@query("""
SELECT 'supplier:' || l_suppkey AS anchor, 'part:' || p AS far, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY 'part:' || p) AS INT) AS rank
FROM (SELECT DISTINCT l_suppkey, l_partkey AS p FROM lineitem)""")
def stored_rank_merge(spark, sf_dir):
    """Edges of even lines are stored, all edges are a batch behind: adjacencies that it touches are ranked anew, occurrences that were there aren't added again."""
    path = f"{shared_base(spark).rstrip('/')}/merged-edges-{uuid.uuid4().hex}"
    stored = RankedEdges(spark, path, 50_000)
    rows = table(spark, sf_dir, "lineitem").select(ref("part", "l_partkey").alias("subject"), F.lit("SUPPLIED_BY").alias("relation"), ref("supplier", "l_suppkey").alias("object"), "l_linenumber")
    numbered = rows.withColumn("occ_id", F.xxhash64("subject", "object"))
    for some in (numbered.where("l_linenumber % 2 = 0"), numbered):
        stored.add(some.select("occ_id", "subject", "relation", "object").distinct())
    return stored.edges().where("direction = 'IN'").select("anchor", "far", "rank")


def qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as children of the one before, with the position as a qualifier, and coverage of each conversation."""
    turns = table(spark, sf_dir, "conversations").where("turn > 0")
    place = lambda n: F.concat(F.lit("turn:"), "conv_id", F.lit("/"), n)
    own = turns.select(F.lit("ASSERTION").alias("kind"), place(F.col("turn")).alias("subject"), F.lit("CHILD_OF").alias("relation"), place(F.col("turn") - 1).alias("object"), F.concat(F.lit('{"position": '), (F.col("turn") % 2).cast("string"), F.lit("}")).alias("qualifiers"), F.lit(None).cast("string").alias("coverage_type"))
    seen = turns.select("conv_id").distinct().select(F.lit("COVERAGE").alias("kind"), ref("conversation", "conv_id").alias("subject"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("object"), F.lit(None).cast("string").alias("qualifiers"), F.explode(F.array(F.lit("ANALYSED"), F.lit("READ_ERROR"))).alias("coverage_type"))
    return own.unionByName(seen).withColumns({"producer_id": F.lit("turns"), "execution_id": F.lit("x")})


@query("""
WITH t AS (SELECT conv_id, turn FROM conversations WHERE turn > 0)
SELECT 'ASSERTION' AS kind, 'turn:' || conv_id || '/' || turn AS subject, '{"position": ' || turn % 2 || '}' AS qualifiers, NULL AS coverage_type,
  sha256('fact-identity/1' || chr(10) || '{"kind":"ASSERTION","object":"turn:' || conv_id || '/' || (turn - 1) || '","qualifiers":{"position":' || turn % 2 || '},"relation":"CHILD_OF","subject":"turn:' || conv_id || '/' || turn || '"}') AS identity_hash FROM t
UNION ALL SELECT 'COVERAGE', 'conversation:' || conv_id, NULL, c, sha256('fact-identity/1' || chr(10) || '{"coverage_type":"' || c || '","kind":"COVERAGE","producer_id":"turns","subject":"conversation:' || conv_id || '"}')
FROM (SELECT DISTINCT conv_id FROM t), (SELECT unnest(['ANALYSED', 'READ_ERROR']) AS c)""")
def stored_facts(spark, sf_dir):
    """Facts with qualifiers, and coverage, written to a store and read back with their identities."""
    store = FactStore(spark, f"{shared_base(spark).rstrip('/')}/facts-{uuid.uuid4().hex}")
    store.add("turns", "c1", dt.datetime(2024, 1, 1), qualified(spark, sf_dir))
    return store.facts("turns").select("kind", "subject", "qualifiers", "coverage_type", "identity_hash")


@query("""
WITH t AS (SELECT conv_id, turn, turn % 2 AS p FROM conversations WHERE turn > 0)
SELECT 'ASSERTION' AS kind, count(DISTINCT (conv_id, turn, p)) AS identities, 2 AS analyses FROM t UNION ALL SELECT 'COVERAGE', 2 * count(DISTINCT conv_id), 2 FROM t""")
def stored_identities(spark, sf_dir):
    """Identities of two analyses of the same facts are stored once."""
    store = FactStore(spark, f"{shared_base(spark).rstrip('/')}/facts-{uuid.uuid4().hex}")
    for k in range(2):
        store.add(f"a{k}", "c1", dt.datetime(2024, 1, 1 + k), qualified(spark, sf_dir))
    n = store.analyses().count()
    return store.identities().groupBy("kind").agg(F.count(F.lit(1)).alias("identities")).withColumn("analyses", F.lit(n))


def _registry() -> producers.Registry:
    def inventory(inputs, progress):
        spark, sf_dir = inputs
        progress("documents")
        done = spark.createDataFrame([("COVERAGE", "repository:tables", "ANALYSED")], "kind string, subject string, coverage_type string")
        return derived.written_in(spark, sf_dir).unionByName(done, allowMissingColumns=True)

    def supply(inputs, progress):
        spark, sf_dir = inputs
        rows = derived.supplied_by(spark, sf_dir).select("kind", "subject", "relation", "object").distinct()
        seen = rows.select("subject").distinct().select(F.lit("COVERAGE").alias("kind"), "subject", F.lit("ANALYSED").alias("coverage_type"))
        return rows.unionByName(seen, allowMissingColumns=True)

    def broken(inputs, progress):
        spark, sf_dir = inputs
        return derived.placed_by(spark, sf_dir).withColumn("subject", F.assert_true(F.col("object").isNull()).cast("string"))  # fails in its tasks

    def never(inputs, progress):
        raise AssertionError("it isn't called")

    return producers.Registry([
        producers.Producer("inventory", inventory, None, frozenset({"WRITTEN_IN", "ANALYSED"}), "inventory/1"),
        producers.Producer("supply", supply, frozenset({"en", "fr"}), frozenset({"SUPPLIED_BY", "ANALYSED"}), "supply/1"),
        producers.Producer("orders", broken, None, frozenset({"PLACED_BY", "ANALYSED"}), "orders/1"),
        producers.Producer("cobol", never, frozenset({"cobol"}), frozenset({"CALLS"}), "cobol/1"),
    ])


@query("""
SELECT 'inventory' AS producer_id, 'SUCCESS' AS outcome, 'WRITTEN_IN' AS code, count(*) AS n FROM documents WHERE lang IS NOT NULL OR lang IS NULL
UNION ALL SELECT 'inventory', 'SUCCESS', 'ANALYSED', 1
UNION ALL SELECT 'supply', 'SUCCESS', 'SUPPLIED_BY', count(DISTINCT (l_partkey, l_suppkey)) FROM lineitem
UNION ALL SELECT 'supply', 'SUCCESS', 'ANALYSED', count(DISTINCT l_partkey) FROM lineitem
UNION ALL SELECT 'orders', 'FAILED', 'NOT_INTERPRETED', 1 UNION ALL SELECT 'cobol', 'UNSUPPORTED', 'OUT_OF_SCOPE', 1""")
def produced_facts(spark, sf_dir):
    """2.17, F13, P23, C9: a run of four producers, of which one fails and one has nothing to read."""
    own = producers.run(_registry(), (spark, sf_dir), spark, "tables", "a1", "inventory")
    counts = own.facts.groupBy("producer_id", F.coalesce("relation", "coverage_type").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(own.executions.select("producer_id", F.col("status").alias("outcome")), "producer_id").select("producer_id", "outcome", "code", "n")


_STEPS = [graph.Step("SUPPLIED_BY", "IN"), graph.Step("IN_NATION"), graph.Step("IN_REGION")]


@query("""
WITH e AS (SELECT DISTINCT 'part:' || l_partkey AS s, 'supplier:' || l_suppkey AS o FROM lineitem),
first AS (
  SELECT o AS root, 0 AS step, s AS far, row_number() OVER (PARTITION BY o ORDER BY s) AS r FROM e WHERE o IN (SELECT 'supplier:' || s_suppkey FROM supplier)
), shown AS (
  SELECT root, step, far, r AS k FROM first WHERE r <= 5
  UNION ALL SELECT 'supplier:' || s_suppkey, 1, 'nation:' || s_nationkey, 1 + coalesce((SELECT max(r) FROM first WHERE root = 'supplier:' || s_suppkey AND r <= 5), 0) FROM supplier WHERE coalesce((SELECT max(r) FROM first WHERE root = 'supplier:' || s_suppkey), 0) < 5
), second AS (
  SELECT root, 'region:' || n_regionkey AS far FROM shown JOIN nation ON shown.far = 'nation:' || n_nationkey WHERE step = 1
), cuts AS (
  SELECT root, max(r) AS n FROM first GROUP BY root HAVING max(r) >= 5
)
SELECT root, far AS node, 1 AS level, NULL AS reason FROM shown UNION ALL SELECT root, far, 2, NULL FROM second
UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey, 0, CASE WHEN n IS NULL THEN NULL ELSE 'FANOUT' END FROM supplier LEFT JOIN cuts ON root = 'supplier:' || s_suppkey""")
def many_tiles(spark, sf_dir):
    """Tiles of depth two of all suppliers at once, over stored ranks: their nodes and the first cut at the root."""
    roots = table(spark, sf_dir, "supplier").select(ref("supplier", "s_suppkey").alias("root"))
    found = tiles.tiles(ranked_edges(spark, sf_dir).edges(), roots, _STEPS, 2, graph.Limits(nodes=60, edges=60), fanout=5)
    cuts = found.cuts.where("root = node").select("root", "node", "reason")
    return found.nodes.join(cuts, ["root", "node"], "left").select("root", "node", "level", "reason")
