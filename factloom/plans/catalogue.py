"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import canonical, dates, names, protect, scores
from factloom.operators import budget, calls, compare, facts, graph, knowledge, project, references, rules, summaries
from factloom.session import parts_of
from factloom.sources import derived
from factloom.sources.derived import ref, table
from factloom.streaming import journal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Where lineitem is cut into two analyses, before and after.
CUT = "1998-05-24"


def query(sql: str | None = None):
    """Registers a function by its name, with the SQL that gives its rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def _references(spark: SparkSession, sf_dir: str, *kinds: tuple[str, str, str]) -> DataFrame:
    """A reference index over key columns of tables: (table, type, column)."""
    out = None
    for name, kind, column in kinds:
        keyed = names.with_folded(table(spark, sf_dir, name).select(F.col(column).cast("string").alias("key")), "key", "search_key")
        one = keyed.select(F.lit(kind).alias("type"), ref(kind, "key").alias("reference"), "search_key", canonical.reference_hash(ref(kind, "key")).alias("reference_hash"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
SELECT 'part:' || l_partkey AS subject, 'SUPPLIED_BY' AS relation, 'supplier:' || l_suppkey AS object, count(*) AS occurrences
FROM lineitem WHERE l_suppkey = 7 GROUP BY ALL""")
def find_facts_by_subject(spark, sf_dir):
    """Facts of a relation and object."""
    found = facts.find_facts(derived.supplied_by(spark, sf_dir), relation="SUPPLIED_BY", object="supplier:7")
    return found.groupBy("subject", "relation", "object").agg(F.count(F.lit(1)).alias("occurrences"))


@query("""SELECT sha256('fact-identity/1' || chr(10) || '{"kind":"ASSERTION","object":"supplier:' || l_suppkey || '","relation":"SUPPLIED_BY","subject":"part:' || l_partkey || '"}') AS identity_hash, count(*) AS occurrences FROM lineitem GROUP BY l_partkey, l_suppkey""")
def identity_split(spark, sf_dir):
    """Identities and their occurrences (1.3, C8, X22)."""
    return facts.identities(derived.supplied_by(spark, sf_dir)).select("identity_hash", "occurrences")


@query("SELECT 'supplier:' || l_suppkey AS anchor, 'part:' || l_partkey AS neighbour, row_number() OVER (PARTITION BY l_suppkey ORDER BY 'part:' || l_partkey) AS rank FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)")
def adjacency_rank(spark, sf_dir):
    """Dense ranks of adjacencies."""
    edges = derived.supplied_by(spark, sf_dir).select(F.col("object").alias("anchor"), F.col("subject").alias("neighbour")).distinct()
    return facts.ranks_of_large(edges, "anchor", "neighbour").select("anchor", "neighbour", F.col("rank").cast("long").alias("rank"))


def assertion_edges(rows: DataFrame) -> DataFrame:
    """Suppliers' parts as edges, each once."""
    return rows.select(ref("supplier", "l_suppkey").alias("anchor"), ref("part", "l_partkey").alias("neighbour")).distinct()


@query("""
SELECT 'supplier:' || s AS anchor, 'part:' || p AS neighbour, row_number() OVER (PARTITION BY s ORDER BY 'part:' || p) AS rank FROM (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem)""")
def incremental_rerank(spark, sf_dir):
    """The later half's new edges join the earlier half's ranks; adjacencies that they touch alone are ranked anew."""
    before, after = (assertion_edges(df) for df in _halves(spark, sf_dir))
    out = facts.rerank(facts.ranks_of_large(before, "anchor", "neighbour"), after.join(before, ["anchor", "neighbour"], "left_anti"), "anchor", "neighbour")
    return out.select("anchor", "neighbour", F.col("rank").cast("long").alias("rank"))


@query("SELECT neighbour, rank FROM (SELECT 'part:' || l_partkey AS neighbour, row_number() OVER (ORDER BY 'part:' || l_partkey) AS rank FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 7)) WHERE rank > 20 ORDER BY rank LIMIT 20")
def neighbors_page(spark, sf_dir):
    """A page of an adjacency behind a rank."""
    edges = facts.find_facts(derived.supplied_by(spark, sf_dir), object="supplier:7").select(F.col("object").alias("anchor"), F.col("subject").alias("neighbour")).distinct()
    return facts.neighbours(facts.adjacency_rank(edges, "anchor", "neighbour"), "anchor", "supplier:7", 20, 20).select("neighbour", F.col("rank").cast("long").alias("rank"))


@query("SELECT type, count(*) AS references FROM (SELECT 'part' AS type FROM part UNION ALL SELECT 'supplier' FROM supplier UNION ALL SELECT 'customer' FROM customer UNION ALL SELECT 'order' FROM orders) GROUP BY type")
def reference_families(spark, sf_dir):
    """A1: references by type."""
    return references.families(_references(spark, sf_dir, ("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey"), ("customer", "customer", "c_custkey"), ("orders", "order", "o_orderkey")))


@query("SELECT DISTINCT 'part:' || replace(p_name, ' ', '.') AS reference FROM part WHERE string_split(lower(p_name), ' ')[-1] = 'ring'")
def reference_name_search(spark, sf_dir):
    """References by the last segments of their names."""
    named = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.replace("p_name", F.lit(" "), F.lit("."))).alias("reference")).distinct()
    index = named.select("reference", canonical.reference_hash(F.col("reference")).alias("reference_hash"), F.lit("part").alias("type"))
    return references.by_name(references.name_index(index), "Ring", limit=None).select("reference")


@query("SELECT DISTINCT 'part:' || p_name AS reference FROM part WHERE contains(lower(p_name), 'anv')")
def reference_contains(spark, sf_dir):
    """Text within keys, all pages of it."""
    return references.all_containing(_references(spark, sf_dir, ("part", "part", "p_name")).distinct(), "anv").select("reference")


@query("""
WITH k AS (SELECT *, row_number() OVER (ORDER BY key, h) AS n FROM (SELECT DISTINCT lower(p_name) AS key, sha256('part:' || p_name) AS h, 'part:' || p_name AS reference FROM part) WHERE key > 'm' OR (key = 'm' AND h > ''))
SELECT reference, (SELECT max(n) FROM k WHERE n <= 30) AS scanned, (SELECT max(key) FILTER (n = 30) FROM k WHERE (SELECT max(n) FROM k) > 30) AS bound FROM k WHERE n <= 30 AND contains(key, 'r') ORDER BY n LIMIT 11""")
def reference_contains_page(spark, sf_dir):
    """A bounded scan behind a key, with how far it came and where to go on."""
    rows, bound = references.containing(_references(spark, sf_dir, ("part", "part", "p_name")).distinct(), "r", after=("m", ""), limit=10, scan=30)
    return rows.select("reference").join(F.broadcast(bound.select(F.col("scanned").cast("long").alias("scanned"), F.col("search_key").alias("bound"))), F.lit(True))  # one row


@query("""
WITH RECURSIVE edges AS (SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders),
r AS (SELECT 'region:1' AS node, 0 AS level UNION SELECT e.s, r.level + 1 FROM r JOIN edges e ON e.o = r.node WHERE r.level < 3)
SELECT node, min(level) AS level FROM r GROUP BY node""")
def bounded_reach(spark, sf_dir):
    """G2 (what is reached): nodes within three steps and their level."""
    edges = derived.located(spark, sf_dir).unionByName(derived.placed_by(spark, sf_dir)).select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    return graph.reach(edges, spark.createDataFrame([("region:1",)], "reference string"), 3).select(F.col("reference").alias("node"), "level")


@query()
def bounded_tile(spark, sf_dir):
    """A tile of depth 3 with fan-out and budgets; order and cuts have no SQL twin, tests hold it against an independent walk."""
    rows = derived.located(spark, sf_dir).unionByName(derived.placed_by(spark, sf_dir)).select(F.xxhash64("subject", "relation", "object").alias("occ_id"), "subject", "relation", "object")
    steps = [graph.Step("IN_REGION", "IN"), graph.Step("IN_NATION", "IN"), graph.Step("PLACED_BY", "IN")]
    return graph.elements_frame(spark, graph.tile(graph.both_directions(rows), "region:1", steps, 3, graph.Limits(nodes=150, edges=150, bytes=200_000), fanout=20))


@query("""
WITH e AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem WHERE l_suppkey = 7)
SELECT seq::INT AS seq, far FROM (SELECT row_number() OVER (ORDER BY 'part:' || p) - 1 AS seq, 'part:' || p AS far FROM e) WHERE seq < 200""")
def one_hop_tile(spark, sf_dir):
    """The tile of one step is the adjacency's first occurrences."""
    rows = facts.find_facts(derived.supplied_by(spark, sf_dir), object="supplier:7").select("subject", "relation", "object").distinct().withColumn("occ_id", F.xxhash64("subject"))
    return graph.elements_frame(spark, graph.tile(graph.both_directions(rows), "supplier:7", [graph.Step("SUPPLIED_BY", "IN")], 1, graph.Limits(nodes=1000, edges=200, bytes=1_000_000))).select("seq", "far")


def _halves(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where(F.col("l_shipdate") < CUT), rows.where(F.col("l_shipdate") >= CUT)


@query("""
WITH a AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-05-24'), b AS (SELECT DISTINCT l_partkey p, l_suppkey s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-05-24')
SELECT 'ADDED' AS category, count(*) AS n FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'REMOVED', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'COMMON', count(*) FROM (FROM a INTERSECT FROM b)""")
def compare_added_removed(spark, sf_dir):
    """Identities by side."""
    before, after = _halves(spark, sf_dir)
    return compare.counts(compare.added_removed(before, after, ["l_partkey", "l_suppkey"]))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey o, l_linenumber n, l_partkey p FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-05-24'), b AS (SELECT DISTINCT l_orderkey o, l_linenumber n, l_partkey p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-05-24'), rem AS (FROM a EXCEPT FROM b), ad AS (FROM b EXCEPT FROM a)
SELECT r.o AS orderkey, r.n AS linenumber, r.p AS before, d.p AS after FROM (SELECT o, n, min(p) p FROM rem GROUP BY o, n HAVING count(*) = 1) r JOIN (SELECT o, n, min(p) p FROM ad GROUP BY o, n HAVING count(*) = 1) d USING (o, n)""")
def compare_modified_slots(spark, sf_dir):
    """One value of a slot on each side is a modification."""
    before, after = _halves(spark, sf_dir)
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    gone, new = compare.only(before, after, keys), compare.only(after, before, keys)
    pairs = compare.pair_modified(gone, new, keys[:2], "l_partkey")
    return pairs.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), "before", "after")


@query("""
WITH x AS (SELECT l_partkey p, l_suppkey s, count(*) FILTER (l_shipdate < TIMESTAMP '1998-05-24') na, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-05-24') nb FROM lineitem GROUP BY ALL)
SELECT p AS part, s AS supplier, na AS before, nb AS after FROM x WHERE na > 0 AND nb > 0 AND na <> nb""")
def compare_occurrence_signals(spark, sf_dir):
    """Identities on both sides whose numbers of occurrences differ."""
    sides = [df.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.lit("OBSERVED").alias("status"), F.lit("VALID").alias("validity"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("content")) for df in _halves(spark, sf_dir)]
    found = compare.signals(*sides, keys=["part", "supplier"])
    return found.where(F.array_contains("signals", "OCCURRENCE_COUNT_CHANGED")).select("part", "supplier", "before", "after")


@query("""
WITH x AS (SELECT l_partkey p, l_suppkey s, list_sort(list(l_returnflag || '|' || l_linestatus) FILTER (l_shipdate < TIMESTAMP '1998-05-24')) a, list_sort(list(l_returnflag || '|' || l_linestatus) FILTER (l_shipdate >= TIMESTAMP '1998-05-24')) b FROM lineitem GROUP BY ALL),
y AS (SELECT CASE WHEN len(a) <> len(b) THEN 'OCCURRENCE_COUNT_CHANGED' WHEN a = b THEN 'UNCHANGED' WHEN len(a) = 1 THEN 'STATUS_CHANGED' ELSE 'OCCURRENCES_CHANGED' END AS signal FROM x WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT signal, count(*) AS n FROM y GROUP BY signal""")
def compare_signal_counts(spark, sf_dir):
    """Signals of status changes; several occurrences are compared as multisets."""
    sides = [df.select("l_partkey", "l_suppkey", F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("validity"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("string").alias("content")) for df in _halves(spark, sf_dir)]
    found = compare.signals(*sides, keys=["l_partkey", "l_suppkey"])
    return found.select(F.coalesce(F.get("signals", F.lit(0)), F.lit("UNCHANGED")).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH x AS (SELECT *, ts < TIMESTAMP '2024-01-15' AS early FROM events), b AS (SELECT user_id u, list_sort(list(DISTINCT event_type)) c, bool_or(value < 1) f FROM x WHERE early GROUP BY 1), a AS (SELECT user_id u, list_sort(list(DISTINCT event_type)) c, bool_or(value < 1) f FROM x WHERE NOT early GROUP BY 1)
SELECT coalesce(b.u, a.u) AS producer_id, CASE WHEN b.u IS NULL THEN 'ABSENT_BEFORE' WHEN a.u IS NULL THEN 'ABSENT_AFTER' WHEN b.f THEN 'FAILED_BEFORE' WHEN a.f THEN 'FAILED_AFTER' WHEN a.c <> b.c THEN 'CATALOG_CHANGED' END AS reason FROM b FULL JOIN a ON a.u = b.u""")
def comparability(spark, sf_dir):
    """Producers of both sides and the first reason not to compare them."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("producer_id"), F.col("event_type").alias("catalog"), F.when(F.col("value") < 1, "FAILED").otherwise("SUCCESS").alias("status"), F.lit(True).alias("known"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("early"))
    return compare.comparability(compare.producers(rows.where("early"), rows.where("not early"))).select("producer_id", "reason")


@query("""
WITH claims AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS c FROM orders UNION ALL SELECT -1, 5)
SELECT 'order:' || claims.k AS subject, CASE WHEN o.o_orderkey IS NULL THEN 'NOT_PROVEN' WHEN o.o_custkey = claims.c THEN 'CONFIRMED' ELSE 'REFUTED' END AS verdict, CASE WHEN o.o_orderkey IS NULL THEN 'NOT_FOUND_IN_ANALYSED_SCOPE' END AS reason FROM claims LEFT JOIN orders o ON o.o_orderkey = claims.k""")
def verdict(spark, sf_dir):
    """K1-K4: verdicts on claims of an exclusive relation: a right or a wrong one for every order, and one on an order that isn't there."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("c"))
    orders = orders.unionByName(spark.createDataFrame([(-1, 5)], "o_orderkey long, c long"))
    claims = orders.select(ref("order", "o_orderkey").alias("subject"), F.lit("AUTHORED_BY").alias("relation"), ref("customer", "c").alias("object"), F.lit(None).cast("array<string>").alias("needed")).withColumn("claim_id", F.col("subject"))
    known = derived.placed_by(spark, sf_dir).withColumn("relation", F.lit("AUTHORED_BY"))
    analyzer = [("orders", ["AUTHORED_BY"], False, False, "ANY", [], [("ANALYSED", "repository:all", ["repository:all"], [])])]
    schema = "analyzer_id string, relations array<string>, failed boolean, unsupported boolean, reads string, languages array<string>, coverage array<struct<coverage_type:string,subject:string,include:array<string>,exclude:array<string>>>"
    return knowledge.verdicts(claims, known, spark.createDataFrame(analyzer, schema), [], True).select(F.col("claim_id").alias("subject"), "verdict", "reason")


@query("""
SELECT 'document:' || d.doc_id AS subject, CASE WHEN l.doc_id IS NULL THEN 'NOT_INTERPRETED' WHEN d.lang = 'es' THEN 'NOT_ANALYSED' ELSE 'NOT_FOUND_IN_ANALYSED_SCOPE' END AS reason
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def not_proven_reasons(spark, sf_dir):
    """Why claims aren't proven: unread, in a language that nobody read, or really not found."""
    none = F.array().cast("array<string>")
    cover = derived.coverage(spark, sf_dir)
    claims = cover.select("subject", F.lit("CALLS").alias("relation"), F.lit(None).cast("string").alias("object"), F.array("language").alias("needed"), F.col("subject").alias("claim_id"))
    analyzer = spark.createDataFrame([("reader", ["CALLS"], False, False, "LANGUAGES", ["en", "de", "fr"])], "analyzer_id string, relations array<string>, failed boolean, unsupported boolean, reads string, languages array<string>")
    unread = cover.where(facts.unread()).select(F.lit("reader").alias("analyzer_id"), "coverage_type", "subject", none.alias("include"), none.alias("exclude"))
    whole = spark.range(1).select(F.lit("reader").alias("analyzer_id"), F.lit("ANALYSED").alias("coverage_type"), F.lit("repository:all").alias("subject"), F.array(F.lit("repository:all")).alias("include"), none.alias("exclude"))
    out = knowledge.verdicts(claims, derived.written_in(spark, sf_dir).limit(0), analyzer, ["de", "en", "es", "fr"], True, unread.unionByName(whole))
    return out.select(F.col("claim_id").alias("subject"), "reason")


@query("SELECT d.lang AS language, count(*) FILTER (l.doc_id IS NULL) AS not_interpreted, count(l.doc_id) AS analysed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang")
def unread_coverage(spark, sf_dir):
    """Subjects read and unread by language."""
    return knowledge.coverage_report(derived.coverage(spark, sf_dir), "language")


@query("SELECT DISTINCT 'language:' || lang AS object FROM documents ORDER BY object")
def present_languages(spark, sf_dir):
    """A2, A11."""
    return knowledge.present_languages(derived.written_in(spark, sf_dir))


@query("SELECT DISTINCT lang AS language FROM documents WHERE lang NOT IN ('en', 'fr')")
def unread_languages(spark, sf_dir):
    """Present languages that no reader reads."""
    readers = spark.createDataFrame([("LANGUAGES", ["en"]), ("LANGUAGES", ["fr", "en"])], "reads string, languages array<string>")
    return knowledge.unread_languages(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")), readers)


@query("SELECT source || '/' || lang || '/' || (doc_id // 100) AS producer_id, CASE WHEN count(DISTINCT n_chars > 300) = 1 THEN 'LANGUAGES' ELSE 'UNKNOWN' END AS reads FROM documents GROUP BY 1")
def combined_contract(spark, sf_dir):
    """The common contract of a producer's executions."""
    producer = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"))
    rows = table(spark, sf_dir, "documents").select(producer.alias("producer_id"), F.lit("LANGUAGES").alias("reads"), F.array("lang", F.when(F.col("n_chars") > 300, "long").otherwise("short")).alias("languages"))
    return knowledge.combined_reads(rows).select("producer_id", "reads")


@query("""
WITH h AS (SELECT 'endpoint:GET /' || n_name AS e, 'symbol:R' || n_regionkey || '#n' || n_nationkey AS m, n_nationkey AS k, n_regionkey AS r FROM nation),
a AS (SELECT s_nationkey AS k, list_sort(list(DISTINCT 'application:' || s_suppkey)) AS apps FROM supplier GROUP BY 1)
SELECT e AS endpoint, m AS handler, coalesce(array_to_string(apps, ','), '') AS applications, CASE WHEN k % 2 = 0 THEN 'route-pattern:/' || r || '|f' || r || '|' || coalesce(CASE WHEN r < 4 THEN 'role:' || r END, '') ELSE '' END AS rules,
  CASE WHEN k % 3 = 0 THEN 'role:M' || k WHEN r = 1 THEN 'role:T' ELSE '' END AS guards, 'GET' AS verb, '/' || split_part(e, ' /', 2) AS path FROM h LEFT JOIN a USING (k)""")
def route_projection(spark, sf_dir):
    """Endpoints with their handlers, applications, rules and guards (a method's own, or else its type's)."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("endpoint:GET /"), "n_name").alias("endpoint"), F.concat(F.lit("symbol:R"), "n_regionkey", F.lit("#n"), "n_nationkey").alias("handler"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    served = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("k")).select("endpoint", ref("application", "s_suppkey").alias("application"))
    matched = nation.where("k % 2 = 0").select("endpoint", F.concat(F.lit("route-pattern:/"), "r").alias("pattern"), F.concat(F.lit("f"), "r").alias("filter_chain"))
    told = matched.where("pattern <> 'route-pattern:/4'").select("pattern", "filter_chain", F.concat(F.lit("role:"), F.substring("filter_chain", 2, 9)).alias("authority")).distinct()
    guards = nation.where("k % 3 = 0").select(F.col("handler").alias("symbol"), F.concat(F.lit("role:M"), "k").alias("authority")).unionByName(spark.createDataFrame([("symbol:R1", "role:T")], "symbol string, authority string"))
    out = project.routes(nation.select("endpoint", "handler"), served, matched, told, guards)
    flat = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    shown = F.transform("rules", lambda x: F.concat_ws("|", x["pattern"], x["filter_chain"], F.coalesce(x["authority"], F.lit(""))))
    return out.select("endpoint", "handler", flat("applications").alias("applications"), flat(shown).alias("rules"), flat("guards").alias("guards"), "verb", "path")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1998-01-01' AND '1998-01-31' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def latest_in_period(spark, sf_dir):
    """A phrase's period and count over orders as commits."""
    asked = dates.request("10 derniers commits 1998-01")
    rows = table(spark, sf_dir, "orders").where(dates.in_period(F.col("o_orderdate"), asked.since, asked.until))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(asked.count).select("o_orderkey", "o_orderdate")


@query("SELECT CASE count(*) WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'SELECTED' ELSE 'AMBIGUOUS' END AS status, count(*) AS n FROM (SELECT sha256(CAST(o_orderkey AS VARCHAR)) h FROM orders) WHERE starts_with(h, 'abc')")
def commit_prefix(spark, sf_dir):
    """F11."""
    return project.by_prefix(table(spark, sf_dir, "orders").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha")), "abc")


@query("""
SELECT 'commit:' || conv_id || '.' || turn AS subject, 'CHILD_OF' AS relation, 'commit:' || conv_id || '.' || (turn - 1) AS object, '{"position":0}' AS qualifiers FROM conversations WHERE turn > 0
UNION ALL SELECT 'commit:' || conv_id || '.' || turn, 'AUTHORED_BY', 'person:' || lower(role), '{"name":"' || role || '"}' FROM conversations
UNION ALL SELECT 'repository:all', 'HAS_COMMIT', 'commit:' || conv_id || '.' || turn, NULL FROM conversations""")
def conversation_child_of(spark, sf_dir):
    """Turns as commits: children of the ones before them, with authors."""
    sha = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("."), t.cast("string"))
    change = "array<struct<change:string,path:string,old_path:string>>"
    log = table(spark, sf_dir, "conversations").select(sha(F.col("turn")).alias("sha"), F.col("role").alias("author_name"), F.col("role").alias("author_email"), F.when(F.col("turn") > 0, F.array(sha(F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"), F.array().cast(change).alias("changes"))
    return project.history_facts(log, "all").select("subject", "relation", "object", "qualifiers")


@query("SELECT 'conv:' || conv_id AS repository, 'commit:' || turn AS sha, (max(turn) OVER (PARTITION BY conv_id) - turn)::BIGINT AS place FROM conversations")
def log_order(spark, sf_dir):
    """L1: each conversation's turns as a chain of commits, children before parents."""
    rows = table(spark, sf_dir, "conversations").select(ref("conv", "conv_id").alias("repository"), ref("commit", "turn").alias("sha"), F.lit(0.0).alias("moment"), F.when(F.col("turn") > 0, F.array(ref("commit", F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    return project.log_order(rows)


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(token|password|passwd|pwd|secret)[ ]*[:=][ ]*"[^"\\]+"')) AS secrets, md5(regexp_replace(text, '(?i)(\b(?:token|password|passwd|pwd|secret)[ ]*[:=][ ]*)"[^"\\]+"', '\1"***"', 'g')) AS masked FROM documents""")
def mask_assigned_secrets(spark, sf_dir):
    """Assigned secrets masked, and how many there were."""
    own = table(spark, sf_dir, "documents").select("doc_id", protect.own_secrets("text").alias("p"))
    return own.select("doc_id", F.col("p.secrets").cast("long").alias("secrets"), F.md5(F.col("p.text").cast("binary")).alias("masked"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\b(AKIA|ASIA)[0-9A-Z]{16}\b', '***', 'g'), '(\b[a-zA-Z][a-zA-Z0-9+.-]*://)[^\s/:@]+:[^\s/@]+@', '\1***:***@', 'g')) AS masked FROM documents")
def mask_known_secrets(spark, sf_dir):
    """Known forms of secrets masked by built-in functions."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(protect.known_secrets(F.col("text")).cast("binary")).alias("masked"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_.!#$%&+?^`{|}~-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)*')) AS emails FROM documents")
def email_counts(spark, sf_dir):
    """X38."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(protect.emails(F.col("text"))).cast("long").alias("emails"))


@query()
def protected_texts(spark, sf_dir):
    """Texts with secrets and people withheld, the counts, and whether something still leaked; tests hold it against hand-written cases."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a file may be one row group, which is one task of patterns otherwise
    return protect.protect(rows.repartition(parts_of(rows.count(), spark, 5_000))).drop("text")


@query("SELECT event_id, event_type FROM events WHERE event_id > 9900 ORDER BY event_id")
def event_resume(spark, sf_dir):
    """T2, T3."""
    return journal.follow(table(spark, sf_dir, "events"), 9900).select("event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn <= 5")
def retention_latest(spark, sf_dir):
    """T4."""
    return journal.latest_per(table(spark, sf_dir, "events"), "user_id", "event_id", 5).select("user_id", "event_id")


@query("""
WITH s AS (SELECT user_id, max(event_id) e, bool_or(event_type = 'purchase') f FROM events GROUP BY 1), r AS (SELECT count(*) n FROM s WHERE NOT f)
SELECT user_id AS job_id FROM s WHERE NOT f UNION ALL SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY e DESC) k FROM s WHERE f), r WHERE k <= greatest(50 - n, 0)""")
def retained_jobs(spark, sf_dir):
    """T4: running jobs and the latest finished ones, fifty in all."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("progress").alias("type"), "ts")
    return journal.retained(journal.job_states(rows)).select("job_id")


@query("SELECT event_type AS relation, count(*) AS facts, count(DISTINCT user_id) AS subjects FROM events GROUP BY event_type")
def execution_summary(spark, sf_dir):
    """A3, A10."""
    return summaries.execution_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("relation"), F.col("user_id").alias("subject")))


@query("""
WITH c AS (SELECT 'document:' || d.doc_id AS s, CASE WHEN l.doc_id IS NULL THEN 'NOT_INTERPRETED' ELSE 'ANALYSED' END AS t FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
SELECT t AS coverage_type, count(*) AS n, array_to_string(list_slice(list_sort(list(s)), 1, 5), ',') AS samples FROM c GROUP BY t""")
def coverage_summary(spark, sf_dir):
    """A3: coverage by type with the first five subjects."""
    return summaries.coverage_summary(derived.coverage(spark, sf_dir)).withColumn("samples", F.array_join("samples", ","))


@query("""
SELECT source AS producer_id, lang AS relation, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())""")
def totals(spark, sf_dir):
    """Counts by producer and relation with totals."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("producer_id"), F.col("lang").alias("relation"), F.lit(1).alias("n"))
    return summaries.totals(rows, "producer_id", "relation", "n")


@query("SELECT count(*) AS sent, (SELECT count(*) FROM documents) - count(*) AS not_sent FROM (SELECT sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) used FROM documents) WHERE used <= 64000")
def budget_prefix(spark, sf_dir):
    """B1, X27."""
    return budget.counted_prefix(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], F.col("n_chars"), 64_000)


@query("SELECT 'person:' || role AS person, 'F' || row_number() OVER (ORDER BY min(conv_id * 10 + turn), role) AS short FROM conversations GROUP BY role")
def short_references(spark, sf_dir):
    """Short references by first appearance."""
    rows = table(spark, sf_dir, "conversations").select(ref("person", "role").alias("person"), (F.col("conv_id") * 10 + F.col("turn")).alias("seq"))
    return budget.short_references(rows, "person")


@query("""
WITH b AS (SELECT l_orderkey o, min(l_linenumber) a, max(l_linenumber) z FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT DISTINCT l_orderkey o, l_linenumber n FROM lineitem WHERE l_linestatus = 'F')
SELECT 'order:' || b.o AS fact_id, count(*) AS changed_lines FROM b JOIN c ON b.o = c.o AND c.n BETWEEN b.a AND b.z GROUP BY b.o""")
def linked_lines(spark, sf_dir):
    """Spans of lines that hold changed lines."""
    rows = table(spark, sf_dir, "lineitem")
    spans = rows.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("line_start"), F.max("l_linenumber").alias("line_end"))
    spans = spans.select(ref("order", "l_orderkey").alias("fact_id"), F.col("l_orderkey").cast("string").alias("path"), "line_start", "line_end")
    lines = rows.where("l_linestatus = 'F'").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"))
    return project.linked_lines(spans, lines).select("fact_id", "changed_lines")


@query("""
WITH m AS (SELECT p_partkey AS e, k, CASE k WHEN 1 THEN (CASE WHEN p_size < 5 THEN 2 WHEN p_size < 10 THEN 1 ELSE 0 END) WHEN 2 THEN (CASE WHEN p_type LIKE '%BRASS' THEN 2 ELSE 0 END) ELSE (CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END) END AS o FROM part, (SELECT unnest([1, 2, 3]) AS k))
, f AS (SELECT e, min(k) FILTER (o > 0) AS k FROM m GROUP BY e)
SELECT 'endpoint:GET /' || f.e AS endpoint, CASE WHEN m.o = 2 THEN f.k END AS place, CASE WHEN f.k IS NULL THEN 'NOT_MATCHED' WHEN m.o = 1 THEN 'NOT_INTERPRETED' END AS reason FROM f LEFT JOIN m ON m.e = f.e AND m.k = f.k""")
def first_match_rules(spark, sf_dir):
    """The first rule that decides; one that meets some requests before it leaves it open."""
    parts = table(spark, sf_dir, "part")
    small = F.when(F.col("p_size") < 5, 2).when(F.col("p_size") < 10, 1).otherwise(0)
    brass, even = F.when(F.col("p_type").like("%BRASS"), 2).otherwise(0), F.when(F.col("p_size") % 2 == 0, 2).otherwise(0)
    met = parts.select(ref("endpoint:GET /", "p_partkey").alias("e"), F.posexplode(F.array(small, brass, even)).alias("p", "outcome"))
    return rules.first_match(met.select(F.replace("e", F.lit("/:"), F.lit("/")).alias("endpoint"), (F.col("p") + 1).alias("place"), "outcome"))


@query("""
SELECT 'endpoint:GET /' || p_partkey AS endpoint, CASE WHEN (p_size < 10)::INT + (p_size % 2 = 0)::INT + (p_retailprice > 1500)::INT = 1 THEN CASE WHEN p_size < 10 THEN 'size' WHEN p_size % 2 = 0 THEN 'even' ELSE 'price' END END AS chain FROM part""")
def chosen_chain(spark, sf_dir):
    """P20: the only chain that covers a route."""
    parts = table(spark, sf_dir, "part")
    all_if = lambda c: F.when(c, rules.ALL).otherwise(rules.NONE)
    applies = parts.select(F.concat(F.lit("endpoint:GET /"), F.col("p_partkey").cast("string")).alias("endpoint"), F.explode(F.array(*[F.struct(F.lit(n).alias("chain"), all_if(c).alias("outcome")) for n, c in (("size", F.col("p_size") < 10), ("even", F.col("p_size") % 2 == 0), ("price", F.col("p_retailprice") > 1500))])).alias("x"))
    return rules.chosen_chain(applies.select("endpoint", "x.*")).select("endpoint", "chain")


@query(r"""
WITH r AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS route FROM pages), p AS (SELECT unnest([{'p': '/**', 'x': '.*'}, {'p': '/*', 'x': '/[^/]+/*'}, {'p': '/*/*', 'x': '/[^/]+/+[^/]+/*'}, {'p': '/{a}/**', 'x': '/+[^/]+.*'}, {'p': '/*/page-?', 'x': '/[^/]+/+page-[^/]/*'}, {'p': '/a*/**', 'x': '/+a.*'}]) AS v)
SELECT route, v.p AS pattern, 2 AS outcome FROM r, p WHERE regexp_full_match(route, v.x)""")
def path_patterns(spark, sf_dir):
    """Path patterns met with the paths of pages."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("route"))
    patterns = spark.createDataFrame([(p,) for p in ("/**", "/*", "/*/*", "/{a}/**", "/*/page-?", "/a*/**")], "pattern string")
    return rules.met_patterns(pages, patterns)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS commit, arg_max('analysis:' || o_orderkey, (o_orderdate, 'analysis:' || o_orderkey)) AS analysis_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_complete(spark, sf_dir):
    """The latest complete analysis of each commit."""
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("commit"), ref("analysis", "o_orderkey").alias("analysis_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("INCOMPLETE").alias("state"))
    return compare.latest_complete(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS copy FROM lineitem")
def site_ranks(spark, sf_dir):
    """Copies at one position."""
    ranked = facts.site_ranks(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", F.col("copy").cast("long").alias("copy"))


@query("""
WITH l AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS x FROM documents), t AS (SELECT doc_id, CASE WHEN len(x) > 1 AND x[-1] = '' THEN x[:-2] ELSE x END AS x FROM l)
SELECT doc_id, 'sha256:' || sha256(array_to_string(x[2:3], chr(10))) AS content_hash FROM t""")
def content_hashes(spark, sf_dir):
    """The hash of lines two and three of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", canonical.content_hash(F.col("text"), 2, 3).alias("content_hash"))


@query("""
WITH s AS (SELECT conv_id, turn, exp(length(text) / 100.0) e, sum(exp(length(text) / 100.0)) OVER (PARTITION BY conv_id) z FROM conversations)
SELECT conv_id, CASE WHEN max(e / z) >= 0.5 THEN arg_max('turn-' || turn, e / z) ELSE 'ABSTAIN' END AS label FROM s GROUP BY conv_id""")
def decided_labels(spark, sf_dir):
    """Softmax over turns' weights, and the label that reaches the threshold."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") / 100.0).alias("w")))).alias("xs"))
    shares = rows.withColumn("shares", scores.softmax(F.transform("xs", lambda x: x["w"])))
    labels = F.transform("xs", lambda x: F.concat(F.lit("turn-"), x["turn"].cast("string")))
    return shares.select("conv_id", scores.decide(labels, F.col("shares"), 0.5).alias("label"))


@query("SELECT c_custkey, sha256('customer:' || c_name) AS reference_hash, c_mktsegment AS family FROM customer")
def reference_hashes(spark, sf_dir):
    """X24, X7."""
    return table(spark, sf_dir, "customer").select("c_custkey", canonical.reference_hash(ref("customer", "c_name")).alias("reference_hash"), F.col("c_mktsegment").alias("family"))


@query("""
WITH s AS (SELECT 'supplier:' || s_suppkey AS x, s_nationkey AS n FROM supplier UNION ALL SELECT 'customer:' || c_custkey, c_nationkey FROM customer)
SELECT x AS reference, x || '>nation:' || n || '>region:' || n_regionkey AS path FROM s JOIN nation ON n = n_nationkey
UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || n_nationkey || '>region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region""")
def closure_paths(spark, sf_dir):
    """Everything that regions hold, with the path that led there."""
    edges = derived.located(spark, sf_dir).select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    found = graph.closure_with_paths(edges, table(spark, sf_dir, "region").select(ref("region", "r_regionkey").alias("reference")))
    return found.select("reference", F.array_join(F.reverse("path"), ">").alias("path"))


@query("SELECT l_orderkey AS caller, 'supplier:' || l_suppkey AS receiver, l_shipmode AS method, count(DISTINCT l_linenumber) AS sites FROM (SELECT l_orderkey, l_suppkey, l_returnflag AS l_shipmode, l_linenumber FROM lineitem) GROUP BY ALL")
def written_calls(spark, sf_dir):
    """Equal calls of a caller are one fact with several places."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), ref("supplier", "l_suppkey").alias("receiver"), F.col("l_returnflag").alias("method"), F.lit(0).alias("arity"), F.lit("lineitem").alias("path"), F.col("l_linenumber").alias("line"))
    return calls.written_calls(rows).select("caller", "receiver", "method", F.size("evidence").cast("long").alias("sites"))


@query("""
SELECT 'customer:' || c_custkey AS reference, 'region:' || n_regionkey AS holder FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def exclusive_objects(spark, sf_dir):
    """Up the unique holder until one of a kind."""
    holders = derived.located(spark, sf_dir).select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    return graph.climb(holders, table(spark, sf_dir, "customer").select(ref("customer", "c_custkey").alias("reference")), kind="region")


@query("SELECT user_id AS job_id, max(event_id) AS last_event, bool_or(event_type = 'purchase') AS finished, count(*) AS events FROM events GROUP BY user_id")
def job_states(spark, sf_dir):
    """Jobs folded from their events, the same aggregation that the stream runs."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("progress").alias("type"), "ts")
    return journal.job_states(rows)


@query("""
WITH e AS (SELECT user_id, event_id, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS z FROM events) SELECT user_id AS job_id, event_id FROM e WHERE z IS NULL OR event_id <= z""")
def closed_journals(spark, sf_dir):
    """Nothing follows a terminal event."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("progress").alias("type"))
    return journal.closed(rows).select("job_id", "event_id")


@query("SELECT o_orderkey, (epoch_us(o_orderdate) / 1000000.0)::DOUBLE AS moment FROM orders")
def moments(spark, sf_dir):
    """ISO text to seconds."""
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.epoch(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("moment"))


@query(r"""
WITH f AS (SELECT o_orderkey, round(o_totalprice, 2) AS p, '{"kind":"ASSERTION","object":"customer:' || o_custkey || '","qualifiers":{"price":' || CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END || ',"priority":"' || o_orderpriority || '"},"relation":"PLACED_BY","subject":"order:' || o_orderkey || '"}' AS j FROM orders)
SELECT o_orderkey, j AS canonical FROM f""")
def canonical_identities(spark, sf_dir):
    """The canonical form of facts with qualifiers; its hash behind the tag is the identity, which tests hold against known documents."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.lit("ASSERTION").alias("kind"), ref("order", "o_orderkey").alias("subject"), F.lit("PLACED_BY").alias("relation"), ref("customer", "o_custkey").alias("object"), F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")).alias("qualifiers"))).alias("fact"))
    return rows.select("o_orderkey", canonical.canonical_json(F.col("fact")).alias("canonical"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical, json_extract_string(props, '$.k') AS k FROM events""")
def qualifiers(spark, sf_dir):
    """1.2, X28: JSON qualifiers in canonical form, and a value of them."""
    return table(spark, sf_dir, "events").select("event_id", canonical.canonical_json("props").alias("canonical"), F.get_json_object("props", "$.k").alias("k"))



@query("SELECT user_id AS producer_id, count(DISTINCT event_type) AS unknown_zones FROM events WHERE value < 5 GROUP BY user_id")
def unknown_zones(spark, sf_dir):
    """Distinct unread subjects by producer."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("producer_id"), F.col("event_type").alias("subject"), F.when(F.col("value") < 5, "READ_ERROR").otherwise("ANALYSED").alias("coverage_type"))
    return summaries.unknown_zones(rows)


@query("SELECT lang AS analysis_id, sum(n_chars)::BIGINT AS fact_count, array_to_string(list_sort(list(DISTINCT source) FILTER (doc_id % 50 = 0)), ',') AS failed FROM documents GROUP BY lang")
def analysis_choices(spark, sf_dir):
    """Facts and failed producers of each analysis."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("analysis_id"), F.col("n_chars").alias("facts"), F.col("source").alias("producer_id"), F.when(F.col("doc_id") % 50 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return summaries.analysis_choices(rows).withColumn("failed", F.when(F.size("failed") > 0, F.array_join("failed", ",")))


@query("SELECT event_type AS model, sum(user_id)::BIGINT AS input_tokens, sum(event_id)::BIGINT AS output_tokens, count(*) AS calls FROM events GROUP BY event_type")
def usage(spark, sf_dir):
    """Totals by model."""
    return summaries.usage(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.col("event_id").alias("output_tokens")))


@query("""
WITH s AS (SELECT CASE event_type WHEN 'click' THEN 'UNKNOWN' WHEN 'view' THEN 'AMBIGUOUS' END AS c FROM events)
SELECT c AS category, 'AT_LEAST' AS precision, (SELECT count(*) FROM s WHERE s.c = d.c) AS n FROM (SELECT unnest(['UNKNOWN', 'AMBIGUOUS', 'UNSUPPORTED', 'OUT_OF_SCOPE']) AS c) d""")
def diagnostic_counts(spark, sf_dir):
    """A5: counts by category where sites were cut off: all four, zeros too."""
    kind = F.when(F.col("event_type") == "click", "UNKNOWN").when(F.col("event_type") == "view", "AMBIGUOUS")
    return summaries.diagnostic_counts(table(spark, sf_dir, "events").select(kind.alias("category")), True)


@query("""
WITH k AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem), r AS (SELECT s, 'part:' || p AS o, row_number() OVER (PARTITION BY s ORDER BY 'part:' || p) AS n, count(*) OVER (PARTITION BY s) AS c FROM k)
SELECT 'supplier:' || s AS claim_id, string_agg(o, ',' ORDER BY n) FILTER (n <= 10) AS objects, greatest(max(c) - 10, 0)::INT AS more FROM r WHERE s IN (SELECT s_suppkey FROM supplier) GROUP BY s""")
def known_objects(spark, sf_dir):
    """The first ten established objects of a claim, and how many more there are."""
    edges = derived.supplied_by(spark, sf_dir).select(F.col("object").alias("subject"), F.lit("SUPPLIES").alias("relation"), F.col("subject").alias("object"))
    claims = table(spark, sf_dir, "supplier").select(ref("supplier", "s_suppkey").alias("claim_id"), ref("supplier", "s_suppkey").alias("subject"), F.lit("SUPPLIES").alias("relation"), F.lit("none").alias("object"))
    return knowledge.known_objects(claims, edges, parts=parts_of(edges.count(), spark)).withColumn("objects", F.array_join("objects", ","))


@query("SELECT 'document:' || d.doc_id AS subject, CASE WHEN l.doc_id IS NULL THEN 'NOT_ANALYSED' ELSE 'ANALYSED' END AS coverage_type FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def envelope_coverage(spark, sf_dir):
    """Coverage of subjects, never empty."""
    known = derived.coverage(spark, sf_dir).where("coverage_type = 'ANALYSED'")
    return knowledge.envelope_coverage(known, table(spark, sf_dir, "documents").select(ref("document", "doc_id").alias("subject")))


@query("""
WITH d AS (SELECT p_brand AS t, p_size AS a, min(p_partkey) AS s, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1, 2)
SELECT o_orderkey AS site_id, CASE WHEN d.n = 1 THEN d.s END AS target, CASE WHEN d.n IS NULL THEN 'NO_MATCHING_DECLARATION' WHEN d.n > 1 THEN 'OVERLOAD_AMBIGUOUS' END AS reason
FROM orders LEFT JOIN d ON d.t = 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) AND d.a = 1 + o_orderkey % 60""")
def resolved_calls(spark, sf_dir):
    """The only declaration of a name and number of arguments, or why there is none."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("type"), F.lit("m").alias("method"), F.col("p_size").alias("arity"), F.col("p_partkey").alias("symbol"))
    brand = F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string"))
    sites = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site_id"), brand.alias("receiver_type"), F.lit("m").alias("method"), (1 + F.col("o_orderkey") % 60).cast("int").alias("arity"))
    supers = sites.select(F.col("receiver_type").alias("type")).distinct().select("type", F.col("type").alias("reference"), F.lit(0).alias("level"))
    return calls.resolve(sites, supers, parts, spark.createDataFrame([], "type string"))


@query("SELECT DISTINCT 'part:' || l_partkey AS symbol, 'size:' || p_size AS declares FROM lineitem JOIN part ON p_partkey = l_partkey")
def implementations(spark, sf_dir):
    """Class methods with the interface methods of their signature."""
    parts = table(spark, sf_dir, "part")
    methods = parts.select(F.col("p_brand").alias("type"), F.concat_ws("|", "p_partkey", "p_size").alias("signature"), ref("part", "p_partkey").alias("symbol"))
    wanted = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("I"), F.col("p_brand")).alias("type"), F.concat_ws("|", "p_partkey", "p_size").alias("signature"), ref("size", "p_size").alias("symbol"))
    implements = parts.select(F.col("p_brand").alias("type"), F.concat(F.lit("I"), F.col("p_brand")).alias("interface")).distinct()
    return calls.implementations(methods, wanted, implements)


@query("SELECT 'nation:' || n_nationkey AS reference, 1 AS level FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 'region:' || r, 0 FROM (SELECT unnest([1, 2]) AS r)")
def merged_tiles(spark, sf_dir):
    """Nodes of several tiles once each, at their smallest level."""
    edges = derived.located(spark, sf_dir).where("relation = 'IN_REGION'").select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    one, two = (graph.reach(edges, spark.createDataFrame([(r,)], "reference string"), 1) for r in ("region:1", "region:2"))
    return compare.merge_tiles(one.unionByName(two).unionByName(one.withColumn("level", F.lit(3))))


@query("""
SELECT 'symbol:' || p_partkey AS symbol, CASE WHEN p_size < 10 THEN 'M' || p_size ELSE 'T' || p_brand END AS expression FROM part WHERE p_size < 10 OR p_brand LIKE '%1'""")
def guards(spark, sf_dir):
    """The guard of a method, its own or else that of its type."""
    parts = table(spark, sf_dir, "part")
    methods = parts.select(ref("symbol", "p_partkey").alias("symbol"), F.col("p_brand").alias("type"))
    own = parts.where("p_size < 10").select(ref("symbol", "p_partkey").alias("target"), F.concat(F.lit("M"), F.col("p_size").cast("string")).alias("expression"))
    of_type = parts.where(F.col("p_brand").like("%1")).select(F.col("p_brand").alias("target"), F.concat(F.lit("T"), F.col("p_brand")).alias("expression")).distinct()
    return rules.guards(methods, own.unionByName(of_type))


@query("""
SELECT DISTINCT 'document:' || doc_id AS node, 'file:' || source AS subject, 'lang ' || lang AS reason FROM documents JOIN (SELECT DISTINCT source AS s, lang AS l FROM documents JOIN labels USING (doc_id) WHERE quality = 0) g ON g.s = source AND g.l = lang""")
def evidence_gaps(spark, sf_dir):
    """Nodes whose proof lies in a file with a coverage gap."""
    rows = table(spark, sf_dir, "documents")
    gaps = rows.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi").select(ref("file", "source").alias("subject"), F.concat(F.lit("lang "), "lang").alias("reason")).distinct()
    proofs = rows.select(ref("document", "doc_id").alias("node"), F.col("source").alias("path"))
    languages = rows.select(ref("document", "doc_id").alias("node"), F.concat(F.lit("lang "), "lang").alias("reason"))
    return project.evidence_gaps(proofs, gaps).join(languages, ["node", "reason"], "left_semi").select("node", "subject", "reason")


from factloom.plans import parts  # noqa: E402,F401  registers its queries, by the decorator above
from factloom.plans import stored  # noqa: E402,F401
