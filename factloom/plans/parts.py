"""Registered queries for single operators that no larger query shows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates, diff, names, protect, sources
from factloom.operators import budget, calls, compare, facts, graph, knowledge, project, rules, summaries, validate
from factloom.plans.catalogue import query
from factloom.session import parts_of
from factloom.sources import derived
from factloom.sources.derived import ref, table
from factloom.streaming import journal


@query("SELECT 'document:' || d.doc_id AS subject, CASE WHEN l.doc_id IS NULL THEN 'NOT_INTERPRETED' ELSE 'ANALYSED' END AS coverage_type, d.lang AS language FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.lang IN ('de', 'es')")
def coverage_of_references(spark, sf_dir):
    """Coverage of the asked references, unread first."""
    asked = table(spark, sf_dir, "documents").where("lang in ('de', 'es')").select(ref("document", "doc_id").alias("reference"))
    return facts.coverage_of(derived.coverage(spark, sf_dir), asked).select("subject", "coverage_type", "language")


@query("SELECT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = 7) AS found")
def named_reference(spark, sf_dir):
    """F6."""
    return facts.named(derived.supplied_by(spark, sf_dir), "supplier:7")


@query("SELECT event_id, event_type FROM events WHERE event_id = 77")
def occurrence_by_key(spark, sf_dir):
    """F7, G9."""
    return facts.occurrence(table(spark, sf_dir, "events").withColumn("occ_id", F.col("event_id")), "77").select("event_id", "event_type")


@query("SELECT max(event_id) AS revision FROM events")
def revision(spark, sf_dir):
    """A14."""
    return facts.revision(table(spark, sf_dir, "events").select(F.col("event_id").alias("occ_id")))


@query("""
SELECT doc_id, source = 'src1' AND lang <> 'de' OR lang = 'fr' OR lang = 'es' AND doc_id % 2 = 0 AS covered FROM documents""")
def covered_scopes(spark, sf_dir):
    """Included scopes less excluded ones, over files in directories of sources and languages; some paths hold colons."""
    path = F.concat(F.lit("file:"), "source", F.lit("/"), "lang", F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "a:").otherwise(""), F.col("doc_id").cast("string"))
    even = F.concat(F.lit("directory:"), "source", F.lit("/es/"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("none"))
    include = F.array(F.lit("directory:src1"), even, F.when(F.col("lang") == "fr", path).otherwise("file:none"))
    return table(spark, sf_dir, "documents").select("doc_id", facts.covers(include, F.array(F.lit("directory:src1/de/")), path).alias("covered"))


@query("SELECT doc_id, CAST((doc_id % 3) AS INT) AS evidence_count FROM documents")
def evidence_counts(spark, sf_dir):
    """the number of pieces of evidence in their place."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_repeat(F.struct(F.lit("p").alias("path")), (F.col("doc_id") % 3).cast("int")).alias("evidence"))
    return facts.without_evidence(rows)


@query("SELECT CAST(sum(event_id % 3) AS BIGINT) AS proven, CAST(sum(greatest(event_id % 5 - event_id % 3, 0)) AS BIGINT) AS listed, CAST(sum(greatest(event_id % 7 - event_id % 5, 0)) AS BIGINT) AS unseen, count(DISTINCT user_id) FILTER (event_type = 'error') AS unread FROM events")
def restitution(spark, sf_dir):
    """A4."""
    k = lambda n: (F.col("event_id") % n)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.when(F.col("event_type") == "error", "READ_ERROR").otherwise("ANALYSED").alias("coverage_type"), k(7).alias("sites_seen"), k(5).alias("sites_listed"), k(3).alias("sites_proven"))
    return summaries.restitution(rows)


@query("SELECT user_id AS subject, array_to_string(list_sort(list(DISTINCT CASE WHEN value < 5 THEN 'low' ELSE 'high' END)), ',') AS reasons FROM events WHERE event_type = 'error' GROUP BY user_id")
def unread_reasons(spark, sf_dir):
    """A6."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.when(F.col("event_type") == "error", "NOT_INTERPRETED").otherwise("ANALYSED").alias("coverage_type"), F.array(F.when(F.col("value") < 5, "low").otherwise("high")).alias("reasons"))
    return summaries.unread_reasons(rows).withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT count(DISTINCT user_id) AS commits, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS producers FROM events")
def tile_metadata(spark, sf_dir):
    """A16."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("commit"), F.col("event_type").alias("producer_id"))
    return summaries.tile_metadata(rows).withColumn("producers", F.array_join("producers", ","))


@query("SELECT count(*) = count(*) FILTER (event_type <> 'none') AND NOT bool_or(value < -1) AS complete FROM events")
def languages_complete(spark, sf_dir):
    """K7: whether an inventory read everything."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "none", "FAILED").otherwise("SUCCESS").alias("status"), F.when(F.col("value") < -1, "READ_ERROR").otherwise("ANALYSED").alias("coverage_type"))
    return knowledge.languages_complete(rows)


@query("""
WITH ok AS (SELECT DISTINCT user_id AS u FROM events WHERE value >= 1), able AS (SELECT DISTINCT user_id AS u, event_type AS r FROM events WHERE (value >= 1 OR event_type = 'view') AND user_id IN (SELECT u FROM ok))
SELECT r AS relation, 'CONTEXT' AS kind, NULL::VARCHAR AS language FROM (SELECT unnest(['view', 'nothing']) AS r) WHERE r NOT IN (SELECT r FROM able)
UNION ALL SELECT DISTINCT r, 'KNOWLEDGE', lang FROM able JOIN documents ON doc_id = u WHERE r = 'view'""")
def analysis_frontier(spark, sf_dir):
    """Relations that nobody states, and languages that who states them doesn't read."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "producer_id")
    runs = events.select("producer_id", F.when(F.col("value") >= 1, "SUCCESS").otherwise("FAILED").alias("status"))
    unread = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("producer_id"), F.col("lang").alias("language"))
    steps = [graph.Step("view"), graph.Step("nothing", "IN")]
    # able producers of the first relation alone succeed somewhere
    stated = events.where("value >= 1 or event_type = 'view'").select("producer_id", F.col("event_type").alias("relation")).distinct()
    return graph.analysis_frontier(steps, stated, runs, unread)


@query("SELECT DISTINCT 'document:' || doc_id AS subject, 'unread' AS reason FROM documents WHERE lang = 'de' UNION ALL SELECT DISTINCT 'file:' || source, 'gap' FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2')")
def local_frontier(spark, sf_dir):
    """Gaps of a tile's nodes and of the files that prove its edges."""
    rows = table(spark, sf_dir, "documents")
    mine = rows.where("lang = 'de'")
    gaps = rows.select(ref("document", "doc_id").alias("subject"), F.lit("unread").alias("reason")).distinct().unionByName(rows.where("source in ('src1', 'src2')").select(ref("file", "source").alias("subject"), F.lit("gap").alias("reason")).distinct())
    return graph.local_frontier(mine.select(ref("document", "doc_id").alias("reference")), mine.select(F.col("source").alias("path")), gaps, most=10_000_000)


@query("SELECT DISTINCT 'endpoint:' || l_orderkey AS endpoint, 'p' || l_partkey AS pattern, 'c' || l_suppkey AS filter_chain, 'role:' || (l_suppkey % 3) AS authority FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0")
def chain_rules(spark, sf_dir):
    """Rules of matched patterns, for validated chains alone."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    endpoint, pattern, chain = F.concat(F.lit("endpoint:"), "l_orderkey").alias("endpoint"), F.concat(F.lit("p"), "l_partkey").alias("pattern"), F.concat(F.lit("c"), "l_suppkey").alias("filter_chain")
    told = rows.where("l_partkey % 2 = 0").select(pattern, chain, F.concat(F.lit("role:"), F.col("l_suppkey") % 3).alias("authority")).distinct()
    return graph.rules_of_chains(rows.select(endpoint, pattern, chain).distinct(), rows.select(endpoint, chain).distinct(), told)


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS level, min(l_partkey) AS c, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT k, min(level) AS level FROM l GROUP BY 1)
SELECT k AS orderkey, CASE WHEN n = 1 THEN c END AS candidate, CASE WHEN n > 1 THEN 'AMBIGUOUS' END AS reason FROM l JOIN f USING (k, level)""")
def nearest_candidates(spark, sf_dir):
    """The candidate of the nearest level, if that has just one."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("level"), F.col("l_partkey").alias("candidate"))
    return graph.nearest_single(rows, ["orderkey"], parts_of(rows.count(), spark))


@query("""
SELECT 'h' || p_partkey AS handler, v AS verb, '/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/' || p_size ELSE '' END AS route FROM part, (SELECT unnest(['GET', 'PUT']) AS v) WHERE p_size % 3 = 0
UNION ALL SELECT 'h' || p_partkey, 'ANY', '/' || p_brand || CASE WHEN p_size % 2 = 0 THEN '/' || p_size ELSE '' END FROM part WHERE p_size % 3 <> 0""")
def mapped_endpoints(spark, sf_dir):
    """P5, X11: endpoints of handlers: prefixes with paths and verbs."""
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("h"), "p_partkey").alias("handler"), F.array(F.concat(F.lit("/"), "p_brand")).alias("prefixes"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("/"), "p_size"))).otherwise(none).alias("paths"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("GET"), F.lit("PUT"))).otherwise(none).alias("verbs"))
    return rules.endpoints(rows).select("handler", "verb", F.rtrim("route", F.lit("/")).alias("route"))


@query("""
WITH e AS (SELECT p_partkey AS k, 'c' || (p_size % 2) AS chain, CASE WHEN p_size % 5 = 0 THEN 'ANY' ELSE 'GET' END AS verb, '/' || replace(p_name, ' ', '/') AS route FROM part),
r AS (SELECT * FROM (VALUES ('c0', 1, 'GET', '^/small/.*$|^/small$'), ('c0', 2, NULL, '^.*$'), ('c1', 1, 'PUT', '^.*$'), ('c1', 2, NULL, '^/[^/]+/ring$')) AS r(chain, place, rule_verb, x))
SELECT k, place, CASE WHEN NOT regexp_full_match(route, x) THEN 0 WHEN rule_verb IS NULL OR rule_verb = verb THEN 2 WHEN verb = 'ANY' THEN 1 ELSE 0 END AS outcome FROM e JOIN r USING (chain)""")
def rule_outcomes(spark, sf_dir):
    """Endpoints with every rule of their chain and how it meets them."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("endpoint"), F.concat(F.lit("c"), F.col("p_size") % 2).alias("chain"), F.when(F.col("p_size") % 5 == 0, "ANY").otherwise("GET").alias("verb"), F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("route"))
    told = spark.createDataFrame([("c0", 1, "GET", "/small/**", True, False), ("c0", 2, None, "/**", True, False), ("c1", 1, "PUT", "/**", True, False), ("c1", 2, None, "/*/ring", True, False)], "chain string, place int, verb string, pattern string, readable boolean, never boolean")
    return rules.outcomes(rows, told).select(F.col("endpoint").alias("k"), "place", "outcome")


@query("SELECT p_partkey AS endpoint FROM part WHERE p_name LIKE 'small %' OR p_name LIKE '% ring'")
def excluded_endpoints(spark, sf_dir):
    """Endpoints that an ignored pattern may meet."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("endpoint"), F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("route"))
    return rules.excluded(rows, spark.createDataFrame([("/small/*",), ("/*/ring",)], "pattern string")).select("endpoint")


@query("SELECT 'symbol:' || p_partkey AS subject, 'NOT_INTERPRETED' AS coverage_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def home_made_mechanisms(spark, sf_dir):
    """P22."""
    return rules.home_made(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("type"), F.array("p_brand").alias("supers")), ["Brand#1", "Brand#2"])


@query("""
SELECT expression, expression IN ('hasRole(''A'') and denyAll', 'hasAnyRole(''A'',''B'')', 'isAuthenticated()') AS only_restricts FROM (SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN 'hasRole(''A'') and denyAll' WHEN 1 THEN 'hasAnyRole(''A'',''B'')' WHEN 2 THEN 'isAuthenticated()' WHEN 3 THEN 'hasRole(''A'') or denyAll' ELSE 'permitAll' END AS expression FROM documents)""")
def restrictive_expressions(spark, sf_dir):
    """F20."""
    told = ["hasRole('A') and denyAll", "hasAnyRole('A','B')", "isAuthenticated()", "hasRole('A') or denyAll", "permitAll"]
    rows = table(spark, sf_dir, "documents").select(F.get(F.array(*map(F.lit, told)), (F.col("doc_id") % 5).cast("int")).alias("expression")).distinct()
    return rows.select("expression", rules.restrictive(F.col("expression")).alias("only_restricts"))


@query("""
SELECT 'customer:' || c_custkey AS type, r AS reference, level FROM (
  SELECT c_custkey, 'customer:' || c_custkey AS r, 0 AS level FROM customer UNION ALL SELECT c_custkey, 'nation:' || c_nationkey, 1 FROM customer
  UNION ALL SELECT c_custkey, 'region:' || n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey)""")
def type_hierarchy(spark, sf_dir):
    """Every supertype and its distance."""
    edges = derived.located(spark, sf_dir).select(F.col("subject").alias("type"), F.col("object").alias("super"))
    return calls.hierarchy(edges, table(spark, sf_dir, "customer").select(ref("customer", "c_custkey").alias("type")))


@query("""
WITH m AS (SELECT n_nationkey AS n, n_regionkey AS r, n_nationkey % 4 = 0 AS maybe FROM nation)
SELECT 'region:' || r_regionkey AS type, 'LOADED' AS state FROM region UNION ALL SELECT 'nation:' || n, CASE WHEN maybe THEN 'MAYBE' ELSE 'LOADED' END FROM m
UNION ALL SELECT 'supplier:' || s_suppkey, CASE WHEN maybe THEN 'MAYBE' ELSE 'LOADED' END FROM supplier JOIN m ON n = s_nationkey UNION ALL SELECT 'customer:' || c_custkey, CASE WHEN maybe THEN 'MAYBE' ELSE 'LOADED' END FROM customer JOIN m ON n = c_nationkey""")
def loaded_types(spark, sf_dir):
    """What imports load from roots, for certain or only under conditions."""
    imports = derived.located(spark, sf_dir).select(F.col("object").alias("src"), F.col("subject").alias("dst"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 = 0").select(ref("nation", "n_nationkey").alias("type"))
    return calls.loading(imports, nations, table(spark, sf_dir, "region").select(ref("region", "r_regionkey").alias("reference")))


@query("SELECT DISTINCT 'n' || doc_id AS name, 'v' || (doc_id % 10) AS value FROM documents")
def constant_values(spark, sf_dir):
    """Names that stand for other names, followed to their value."""
    rows = table(spark, sf_dir, "documents").select("doc_id").distinct()
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    literal = rows.where("doc_id < 10").select(name(F.col("doc_id")).alias("name"), F.concat(F.lit("v"), "doc_id").alias("value"))
    step = F.when(F.col("doc_id") % 100 < 10, F.col("doc_id") % 10).otherwise(F.col("doc_id") - F.col("doc_id") % 100 + F.col("doc_id") % 10)
    others = rows.where("doc_id >= 10").select(name(F.col("doc_id")).alias("name"), name(step).alias("other"))
    return calls.constants(literal, others)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'AMBIGUOUS' WHEN 'view' THEN 'UNSUPPORTED' WHEN 'error' THEN 'UNKNOWN' END AS category FROM events")
def frontier_categories(spark, sf_dir):
    """P18."""
    reason = F.when(F.col("event_type") == "click", "OVERLOAD_AMBIGUOUS").when(F.col("event_type") == "view", "UNSUPPORTED_CALL_FORM").when(F.col("event_type") == "error", "PARSE_ERROR")
    return calls.categories(table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))).select("event_id", "category")


@query("SELECT c_custkey, lower(c_name) AS search_key, 'MEMBER' AS nature, '/api/' || lower(c_mktsegment) AS route, 'symbol:' || c_name AS back FROM customer")
def name_functions(spark, sf_dir):
    """Search keys, natures, routes, tokens and back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", ref("symbol", "c_name").alias("r"))
    keyed = names.with_folded(rows.withColumn("key", names.key_of(F.col("r"))), "key", "search_key")
    return keyed.select("c_custkey", names.normal_form("search_key").alias("search_key"), names.nature(F.col("r")).alias("nature"), names.joined_route(F.lit("/api/"), F.lower("c_mktsegment")).alias("route"), names.untoken(names.token(F.col("r"))).alias("back"))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS plain FROM documents WHERE lang IN ('fr', 'es')")
def plain_texts(spark, sf_dir):
    """Texts of two languages without accents, in lower case."""
    return table(spark, sf_dir, "documents").where("lang in ('fr', 'es')").select("doc_id", F.md5(names.without_accents("text").cast("binary")).alias("plain"))


@query("SELECT doc_id, len(string_split(text[1 : (length(text) // 2)], chr(10))) AS line FROM documents")
def lines_of_offsets(spark, sf_dir):
    """The line of an offset."""
    return table(spark, sf_dir, "documents").select("doc_id", sources.line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a.' || replace(p_name, ' ', '.') ELSE '' END AS imports FROM part")
def imported_names(spark, sf_dir):
    """Import lines, those in comments left out."""
    name = F.concat(F.lit("import a."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(";"))
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/* import x.Y;\n*/\n"), name)).otherwise(F.concat(F.lit("// "), name, F.lit("\n/*\n"), name, F.lit("*/")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sources.imported(text), ",").alias("imports"))


@query("SELECT p_partkey, array_to_string(['x.' || p_partkey, '/api/' || split_part(p_name, ' ', 1), 'BigThing'], ',') AS anchors FROM part")
def question_anchors(spark, sf_dir):
    """Names in backticks, routes and names with a capital inside."""
    question = F.concat(F.lit("who calls `x."), "p_partkey", F.lit("` via /api/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" in BigThing?"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sources.anchors(question), ",").alias("anchors"))


@query("""
WITH n AS (SELECT DISTINCT lower(p_name) AS k, 'part:' || p_partkey AS r FROM part), a AS (SELECT DISTINCT lower(p_name) AS k FROM part UNION ALL SELECT 'no such name')
SELECT a.k AS anchor, CASE count(n.r) WHEN 1 THEN min(n.r) END AS reference, CASE count(n.r) WHEN 0 THEN 'NOT_FOUND' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM a LEFT JOIN n USING (k) GROUP BY a.k""")
def resolved_anchors(spark, sf_dir):
    """M5: anchors to references: unique, ambiguous or not found, never guessed."""
    parts = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name_key"), ref("part", "p_partkey").alias("reference"))
    asked = parts.select("name_key").distinct().unionByName(spark.createDataFrame([("no such name",)], "name_key string")).withColumn("anchor", F.col("name_key"))
    return sources.resolved(asked, parts)


@query("SELECT event_id, event_type, user_id FROM events")
def compact_round_trip(spark, sf_dir):
    """Common fields in a table of their own, and back."""
    short, common = budget.compact(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"])
    return budget.expand(short, common)


@query("SELECT doc_id, md5(CASE WHEN len(l) > 3 THEN rtrim(array_to_string(l[2:3], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE array_to_string(l[2:3], chr(10)) END) AS piece FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def source_pieces(spark, sf_dir):
    """Two whole lines of a text from the second on; a piece that is cut doesn't end in blank lines."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(budget.source_piece(F.split("text", "\n"), 2, 2, 10_000_000).cast("binary")).alias("piece"))


@query("SELECT event_id FROM (SELECT event_id, sum(user_id + 1) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT * FROM events ORDER BY event_id LIMIT 200)) WHERE used <= 3000")
def briefing(spark, sf_dir):
    """M4: the longest prefix of at most 200 facts that fits."""
    return budget.briefing(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], F.col("user_id") + 1, 3000).select("event_id")


@query("""
WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT doc_id, 'after' AS side, greatest(n, 2) + 1 AS line FROM l UNION ALL SELECT doc_id, 'before', 1 FROM l UNION ALL SELECT doc_id, 'after', 1 FROM l""")
def changed_lines(spark, sf_dir):
    """Every text with another first line and one more at its end."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\x01old\n"), F.regexp_replace("text", r"^[^\n]*\n?", ""), F.lit("\n")).alias("before"), F.col("text"))
    text = F.regexp_replace("text", r"^[^\n]*\n?", "")
    rows = rows.select("doc_id", "before", F.concat(F.lit("\x02new\n"), text, F.lit("\n\x03end\n")).alias("after"))
    return diff.changed_lines(rows.withColumn("diff", diff.line_diff("before", "after")), "doc_id").select("doc_id", "side", F.col("line").cast("long").alias("line"))


@query("""
WITH f AS (SELECT 'commit:' || o_custkey AS s, o_orderstatus AS r, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT c_custkey AS sha, coalesce((SELECT string_agg(r || '=' || n, ',' ORDER BY r) FROM f WHERE s = 'commit:' || c_custkey), '') AS facts FROM customer""")
def attached_facts(spark, sf_dir):
    """Commits with the numbers of facts attached to them."""
    told = table(spark, sf_dir, "orders").select(ref("commit", "o_custkey").alias("subject"), F.col("o_orderstatus").alias("relation"))
    out = project.attached(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha")), told)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(F.col("sha").cast("long").alias("sha"), F.coalesce(shown, F.lit("")).alias("facts"))


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-01-01' ORDER BY o_orderkey LIMIT 3")
def selected_commits(spark, sf_dir):
    """The latest commits of a phrase, in log order."""
    placed = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), F.col("o_orderkey").alias("place"), F.col("o_orderdate").alias("authored_at"))
    return project.select_commits(placed, dates.request("les trois derniers commits a partir du 1998-01-01")).select("o_orderkey")


@query("SELECT DISTINCT l_orderkey AS subject, CASE l_returnflag WHEN 'R' THEN 'MODIFIED' WHEN 'A' THEN 'INTRODUCED' ELSE 'REMOVED' END AS category FROM lineitem")
def impact(spark, sf_dir):
    """Changes in the order of their category."""
    kind = F.when(F.col("l_returnflag") == "R", "MODIFIED").when(F.col("l_returnflag") == "A", "INTRODUCED").otherwise("REMOVED")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), kind.alias("category"), F.lit("CALLS").alias("relation"), F.lit("x").alias("object")).distinct()
    return compare.impact_order(rows).select("subject", "category")


@query("""
WITH x AS (SELECT user_id AS u, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 0)) AS a, list_sort(list(DISTINCT event_type) FILTER (event_id % 2 = 1)) AS b FROM events GROUP BY 1)
SELECT u, coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 OR a = b AS same FROM x""")
def same_schemas(spark, sf_dir):
    """Catalogs of both sides are equal, or one is empty."""
    side = lambda k: F.collect_set(F.when(F.col("event_id") % 2 == k, F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(side(0).alias("a"), side(1).alias("b")).select("u", compare.same_schema(F.col("a"), F.col("b")).alias("same"))


@query("SELECT 'COVERAGE' AS kind, 'NOT_INTERPRETED' AS coverage_type, count(*) - 100 AS left_out FROM orders HAVING count(*) > 100")
def history_budget(spark, sf_dir):
    """Commits beyond the budget are told."""
    return project.within_budget(table(spark, sf_dir, "orders").select("o_orderkey"), 100)


@query("""
SELECT 'd' || doc_id AS subject, relation, "limit" FROM (SELECT doc_id, 'CALLS' AS relation, 'own ' || lang AS "limit" FROM documents UNION ALL SELECT doc_id, 'CALLS', 'whole' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'AUTHORED_BY', 'decisive' FROM documents WHERE doc_id % 3 = 0)""")
def claim_limits(spark, sf_dir):
    """K9: limits of claims; a relation that decides by itself drops those of the subject."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("subject"), "doc_id", "lang").distinct()
    asked = rows.select("subject", F.explode(F.array(F.lit("CALLS"), F.lit("AUTHORED_BY"))).alias("relation"))
    one = lambda df, relation, text: df.select("subject", F.lit(relation).cast("string").alias("relation"), text.alias("limit"))
    limits = one(rows, "CALLS", F.concat(F.lit("own "), "lang")).unionByName(one(rows.where("doc_id % 2 = 0"), None, F.lit("whole"))).unionByName(one(rows.where("doc_id % 3 = 0"), "AUTHORED_BY", F.lit("decisive")))
    return knowledge.limited_claims(asked, limits)


@query("SELECT 'repository:' || source AS subject, 'OUT_OF_SCOPE' AS coverage_type FROM documents WHERE source <> 'src1'")
def foreign_repositories(spark, sf_dir):
    """references to other repositories."""
    return knowledge.outside(table(spark, sf_dir, "documents").select(ref("repository", "source").alias("subject")), "src1")


@query("SELECT user_id AS producer_id, CASE min(CASE WHEN value < 2 THEN 0 WHEN value < 90 THEN 1 ELSE 2 END) WHEN 0 THEN 'NOT_INTERPRETED' ELSE 'OUT_OF_SCOPE' END AS coverage_type FROM events GROUP BY user_id HAVING min(value) < 90")
def engine_coverage(spark, sf_dir):
    """Coverage that the engine writes for producers that failed or aren't supported."""
    worst = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("producer_id")).agg(F.min("value").alias("v"))
    runs = worst.select("producer_id", F.when(F.col("v") < 2, "FAILED").when(F.col("v") < 90, "UNSUPPORTED").otherwise("SUCCESS").alias("status"))
    return validate.engine_coverage(runs, "r").select("producer_id", "coverage_type")


@query("""
SELECT 'u' || user_id AS producer_id, 'NO_COVERAGE' AS issue FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'view') UNION ALL SELECT DISTINCT 'u' || user_id, 'UNDECLARED' FROM events WHERE event_type = 'error'""")
def output_issues(spark, sf_dir):
    """V4: producers without coverage, and codes that they don't declare."""
    events = table(spark, sf_dir, "events")
    producer = F.concat(F.lit("u"), "user_id").alias("producer_id")
    is_view = F.col("event_type") == "view"
    told = events.select(producer, F.when(is_view, "COVERAGE").otherwise("ASSERTION").alias("kind"), F.when(~is_view, F.col("event_type")).alias("relation"), F.when(is_view, "ANALYSED").alias("coverage_type"))
    catalog = events.where("event_type <> 'error'").select(producer, F.when(is_view, "ANALYSED").otherwise(F.col("event_type")).alias("code")).distinct()
    return validate.output_issues(told, catalog).select("producer_id", "issue").distinct()


@query("""
SELECT user_id AS request, 'm' || event_type || '@x.y' AS form, 'person-' || dense_rank() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS pseudonym FROM events GROUP BY user_id, event_type""")
def numbered_people(spark, sf_dir):
    """Pseudonyms by first appearance within a request, linked by mail."""
    people = table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.lit("Ada").alias("name"), F.concat(F.lit("M"), "event_type", F.lit("@x.y")).alias("mail"))
    return protect.pseudonyms(people).select("request", "form", "pseudonym")


@query("SELECT doc_id, regexp_matches(text, '[\\p{L}\\p{N}_.!#$%&+?^`{|}~-]+@[\\p{L}\\p{N}_-]') OR regexp_matches(text, '\\b(AKIA|ASIA)[0-9A-Z]{16}\\b') AS leaks FROM documents")
def leaking_texts(spark, sf_dir):
    """What still leaks in texts as they are."""
    return table(spark, sf_dir, "documents").select("doc_id", protect.leaks(F.col("text")).alias("leaks"))


@query("SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || user_id || chr(10) || chr(10) AS frame FROM events")
def event_frames(spark, sf_dir):
    """Events as frames of a stream."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("data"))
    return journal.frames(rows).select("event_id", "frame")
