"""Dependencies and modules that build files declare, by file name, from (path, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.where(F.rlike("path", F.lit(rf"(^|/){name}$"))).withColumn("module", F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def requirements(files: DataFrame) -> DataFrame:
    """module, name of requirements.txt; comments and options don't count."""
    rows = _named(files, r"requirements\.txt").select("module", F.explode(F.split("text", "\n")).alias("line"))
    return rows.select("module", F.lower(F.regexp_extract("line", r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("name")).where("name <> ''")


def packages(files: DataFrame) -> DataFrame:
    """module, package, workspaces, name, version of package.json, a row for each dependency (one with nulls without any)."""
    schema = "name string, workspaces array<string>, dependencies map<string,string>, devDependencies map<string,string>"
    rows = _named(files, r"package\.json").select("module", F.from_json("text", schema).alias("j"))
    empty = F.create_map().cast("map<string,string>")
    both = F.map_concat(F.coalesce("j.dependencies", empty), F.map_filter(F.coalesce("j.devDependencies", empty), lambda k, _: ~F.map_contains_key(F.coalesce("j.dependencies", empty), k)))
    return rows.select("module", F.col("j.name").alias("package"), F.col("j.workspaces").alias("workspaces"), F.explode_outer(both).alias("name", "version"))


def maven(files: DataFrame) -> DataFrame:
    """module, group, artifact, scope of pom.xml dependencies."""
    rows = _named(files, r"pom\.xml").select("module", F.explode(F.expr("regexp_extract_all(text, '(?s)<dependency>(.*?)</dependency>', 1)")).alias("d"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("d", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    return rows.select("module", tag("groupId").alias("group"), tag("artifactId").alias("artifact"), F.coalesce(tag("scope"), F.lit("compile")).alias("scope"))


def maven_modules(files: DataFrame) -> DataFrame:
    """module, child and the module's own coordinates."""
    rows = _named(files, r"pom\.xml")
    outer = F.regexp_replace("text", r"(?s)<(dependencies|build|parent|dependencyManagement|profiles)>.*?</\1>", "")
    own = lambda t: F.nullif(F.trim(F.regexp_extract(outer, rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    group = F.coalesce(own("groupId"), F.nullif(F.regexp_extract("text", r"(?s)<parent>.*?<groupId>([^<]*)</groupId>", 1), F.lit("")))
    return rows.select("module", group.alias("group"), own("artifactId").alias("artifact"), F.explode_outer(F.expr("regexp_extract_all(text, '<module>([^<]*)</module>', 1)")).alias("child"))


def gradle(files: DataFrame) -> DataFrame:
    """module, configuration, target of project dependencies in build.gradle(.kts)."""
    rows = _named(files, r"build\.gradle(\.kts)?").withColumn("text", F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)//[^\n]*$", ""))
    found = rows.select("module", _all(F.col("text"), r"((?:\w+)\s*\(?\s*project\s*\(\s*(?:path\s*[:=]\s*)?[\"'][^\"']+)").alias("d"))
    return found.select("module", F.regexp_extract("d", r"^(\w+)", 1).alias("configuration"), F.translate(F.regexp_extract("d", r"[\"']:?([^\"']+)$", 1), ":", "/").alias("target"))


def gradle_includes(files: DataFrame) -> DataFrame:
    """Modules that settings.gradle(.kts) includes."""
    rows = _named(files, r"settings\.gradle(\.kts)?").withColumn("text", F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)//[^\n]*$", ""))
    lines = rows.select("module", _all(F.col("text"), r"\binclude\s*\(?((?:\s*,?\s*[\"'][^\"']+[\"'])+)").alias("l"))
    return lines.select("module", _all(F.col("l"), r"[\"']:?([^\"']+)[\"']").alias("p")).select("module", F.translate("p", ":", "/").alias("child"))


def compose(files: DataFrame) -> DataFrame:
    """service, context of compose files' services that are built; context is a path below the file's folder."""
    rows = _named(files, r"(docker-)?compose\.ya?ml")
    body = rows.select("module", F.regexp_extract("text", r"(?s)(?:^|\n)services:\s*\n(.*?)(?=\n\S|$)", 1).alias("s"))
    each = body.select("module", F.explode(F.expr(r"regexp_extract_all(concat('\n', s), '(?s)\n  ([A-Za-z0-9_.-]+:.*?)(?=\n  [A-Za-z0-9_.-]+:|$)', 1)")).alias("b"))
    short, long = F.regexp_extract("b", r"\n\s+build:[ \t]*([^\s#]+)", 1), F.regexp_extract("b", r"\n\s+context:[ \t]*([^\s#]+)", 1)
    context = F.coalesce(F.nullif(long, F.lit("")), F.nullif(short, F.lit("")))
    return each.select("module", F.regexp_extract("b", r"^([A-Za-z0-9_.-]+):", 1).alias("service"), F.regexp_replace(context, r"^[\"']|[\"']$|^\./", "").alias("context")).where("context is not null")


def python_modules(files: DataFrame) -> DataFrame:
    """A module for each folder with a Python project file, and whether it names dependencies by path, which aren't followed."""
    rows = files.where(F.rlike("path", F.lit(r"(^|/)(pyproject\.toml|setup\.py|setup\.cfg)$")))
    module = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    return rows.groupBy(module.alias("module")).agg(F.bool_or(F.rlike("text", F.lit(r"path\s*=\s*[\"']|file:"))).alias("path_dependencies"))


def structure(modules: DataFrame, dependencies: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """Facts repository CONTAINS module and module DEPENDS_ON module; and the gaps: targets that are no module. modules (module), dependencies (module, target)."""
    named = modules.select("module").distinct()
    contains = named.select(F.lit("ASSERTION").alias("kind"), F.lit(f"repository:{repository}").alias("subject"), F.lit("CONTAINS").alias("relation"), F.concat(F.lit("module:"), "module").alias("object"))
    target = named.select(F.col("module").alias("target"))
    deps = dependencies.select("module", "target").distinct()
    known = deps.join(target, "target").select(F.lit("ASSERTION").alias("kind"), F.concat(F.lit("module:"), "module").alias("subject"), F.lit("DEPENDS_ON").alias("relation"), F.concat(F.lit("module:"), "target").alias("object"))
    return contains.unionByName(known), deps.join(target, "target", "left_anti")
