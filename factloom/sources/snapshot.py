"""Files of a snapshot: a working tree read by Spark, a Git history read from Git's own output."""

from __future__ import annotations

import operator
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from factloom.functions.names import normal_form

#: Suffix -> language (fixed values).
LANGUAGES = {".java": "Java", ".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".sql": "SQL"}
#: Folders that an inventory leaves out (fixed values).
IGNORED = (".git", "node_modules", ".venv", "venv", "dist", "build", "target", "__pycache__", ".python-packages")
#: Files that are never shown, and files that tools make (fixed values).
CONFIDENTIAL = r"(^|/)\.env(\.[^/]*)?$"
#: Names and endings of generated files (fixed values).
GENERATED_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "pipfile.lock", "uv.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "gradle.lockfile")
GENERATED_ENDS = (".min.js", ".min.css", ".map", ".snap")


def working_tree(spark: SparkSession, path: str) -> DataFrame:
    """path (below the root), size, content; confidential files are skipped. Spark lists and splits the files."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    below = F.substr(inner, F.length(F.lit(root[root.index("/") :] if "://" in root else root)) + 2)
    return files.select(below.alias("path"), F.col("length").alias("size"), "content").where(~F.rlike("path", F.lit(CONFIDENTIAL)) & ~F.startswith("path", F.lit(".git/")))


#: Files of a tree whose fingerprint is made at most: one short line of each meets the others.
MOST_FILES = 1_000_000


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over the digests of all files by path, line ends normalized: digests are made by file, and only these (one short line a file) meet. A tree of over MOST_FILES files is refused."""
    if files.select("path").limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"a tree of more than {MOST_FILES} files")
    text = F.replace(F.decode("content", "ISO-8859-1"), F.lit("\r\n"), F.lit("\n"))
    each = files.select(normal_form(F.col("path")).alias("path"), F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("digest"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(" ", x["path"], x["digest"])), "\n"), 256).alias("content_fingerprint"))


def confidential(path) -> F.Column:
    return F.rlike(path, F.lit(CONFIDENTIAL))


def generated(path) -> F.Column:
    name = F.lower(F.substring_index(path, "/", -1))
    out = name.isin(*GENERATED_NAMES)
    for end in GENERATED_ENDS:
        out = out | F.endswith(name, F.lit(end))
    return out


def diff_refusal(mode, size, binary, most: int = 1 << 20) -> F.Column:
    """Why a file's differences aren't shown, or null."""
    return F.when(mode == "120000", "SYMLINK").when(mode == "160000", "SUBMODULE").when(size > most, "TOO_LARGE").when(binary, "BINARY")


def inventory(files: DataFrame, repository: str) -> DataFrame:
    """Facts of a tree: the repository CONTAINS its directories and files, files are WRITTEN_IN languages, the repository USES_TECHNOLOGY."""
    files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))
    name, suffix = F.substring_index("path", "/", -1), F.concat(F.lit("."), F.substring_index("path", ".", -1))
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), key)
    root, file = F.lit(f"repository:{repository}"), F.concat(F.lit("file:"), F.col("path"))
    fact = lambda df, s, r, o: df.select(F.lit("ASSERTION").alias("kind"), s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    parts = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("d")).where("d <> ''").distinct() if files.columns else files
    rows = fact(files, root, "CONTAINS", file).unionByName(fact(folders, root, "CONTAINS", F.concat(F.lit("directory:"), F.col("d"))))
    language = pick(LANGUAGES, suffix)
    workflow = F.startswith("path", F.lit(".github/workflows/")) & suffix.isin(".yml", ".yaml")
    technology = F.coalesce(language, F.when((name == "Dockerfile") | F.startswith(name, F.lit("Dockerfile.")), "Docker").when(workflow, "GitHub Actions"))
    rows = rows.unionByName(fact(files.withColumn("_l", language).where("_l is not null"), file, "WRITTEN_IN", F.concat(F.lit("language:"), F.col("_l"))))
    rows = rows.unionByName(fact(files.withColumn("_t", technology).where("_t is not null"), root, "USES_TECHNOLOGY", F.concat(F.lit("technology:"), F.col("_t"))))
    return rows.dropDuplicates(["subject", "relation", "object"])


class _Log(InputPartition):
    """A part of a log: `revisions` as git reads them, all of them or `count` behind the first `skip`."""

    def __init__(self, revisions: list[str], skip: int = 0, count: int | None = None):
        self.revisions, self.skip, self.count = revisions, skip, count


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, check=True).stdout.decode(errors="replace")


def _log_parts(path: str, revisions: list[str], parts: int) -> list[_Log]:
    n = int(_git(path, "rev-list", "--count", *revisions, "--"))
    each = max(1, -(-n // parts))
    return [_Log(revisions, k, each) for k in range(0, n, each)]


def _read_log(path: str, part: _Log) -> Iterator[tuple]:
    """The rows of a part, from git's output as it comes: one commit at a time."""
    form = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%cI%x1f%s%x1f"
    some = ["--no-walk=unsorted"] if part.count is None else [f"--skip={part.skip}", f"-n{part.count}"]
    with subprocess.Popen(["git", "-C", path, "log", *some, "-M", "--name-status", f"--format={form}", *part.revisions, "--"], stdout=subprocess.PIPE, text=True, errors="replace") as child:
        held = ""
        while more := child.stdout.read(1 << 16):
            whole, mark, begun = (held + more).rpartition("\x1e")  # what stands before the last mark is whole
            yield from parse_log(whole)
            held = mark + begun
        yield from parse_log(held)
    if child.returncode:
        raise OSError(f"git log ended with {child.returncode}")


def _values(f: Filter, column: str) -> list | None:
    """The values that a filter asks of a column, if it asks for some of a list."""
    if isinstance(f, EqualTo) and f.attribute == (column,):
        return [f.value]
    return list(f.value) if isinstance(f, In) and f.attribute == (column,) else None


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts, self.shas = options["path"], int(options.get("partitions", 4)), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Commits by id are looked up, without a walk over the log."""
        for f in filters:
            found = _values(f, "sha")
            if found is None or self.shas is not None or not all(re.fullmatch("[0-9a-f]{40}|[0-9a-f]{64}", v or "") for v in found):
                yield f
            else:
                self.shas = found

    def partitions(self) -> list[InputPartition]:
        if self.shas is None:
            return _log_parts(self.path, ["HEAD"], self.parts)
        reached = [s for s in dict.fromkeys(self.shas) if not subprocess.run(["git", "-C", self.path, "merge-base", "--is-ancestor", s, "HEAD"], capture_output=True).returncode]
        return [_Log(reached)] if reached else []

    def read(self, part: _Log | None) -> Iterator[tuple]:
        yield from _read_log(self.path, part) if part else ()  # None stands for no parts at all


class GitLogStream(DataSourceStreamReader):
    """New commits of HEAD: an offset is the commit that HEAD was at."""

    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 4))

    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        found = subprocess.run(["git", "-C", self.path, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True, text=True)
        return {"commit": found.stdout.strip()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not end["commit"] or start == end:
            return []
        return _log_parts(self.path, [end["commit"], *([f"^{start['commit']}"] if start["commit"] else [])], self.parts)

    def read(self, part: _Log | None) -> Iterator[tuple]:
        yield from _read_log(self.path, part) if part else ()  # None stands for no parts at all


def parse_log(text: str) -> Iterator[tuple]:
    """Rows of a log whose commits begin with \\x1e and whose fields end with \\x1f, name-status lines behind them."""
    for commit in text.split("\x1e")[1:]:
        sha, parents, name, email, authored, committed, subject, files = commit.split("\x1f", 7)
        changes = []
        for line in files.strip().splitlines():
            kind, *paths = line.split("\t")
            if paths:
                changes.append((kind[0], paths[-1], paths[0] if len(paths) == 2 else None))
        yield sha, parents.split(), name, email, authored, committed, subject, changes


class GitLogSource(DataSource):
    """spark.read (or readStream) .format("git-log").option("path", ...): commits with parents, people, times and changes; a child process a partition. A stream gives each commit once, as HEAD moves on."""

    @classmethod
    def name(cls) -> str:
        return "git-log"

    def schema(self) -> str:
        return "sha string, parents array<string>, author_name string, author_email string, authored_at string, committed_at string, subject string, changes array<struct<change:string,path:string,old_path:string>>"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GitLogStream(self.options)


class _Blobs(InputPartition):
    def __init__(self, rows: list[tuple[str, str, int]]):
        self.rows = rows


#: Files and bytes of a partition of a tree.
FILES_PER_TASK, BYTES_PER_TASK = 2_000, 32 << 20


class GitTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.commit, self.most = options["path"], options.get("commit", "HEAD"), int(options.get("mostBytes", 1 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters of path, oid and size decide before any blob is read."""
        bounds = {LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("path", "oid", "size") and (found := _values(f, column)) is not None:
                self.tests.append((column, "in", found))
            elif column in ("path", "oid") and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column == "size" and type(f) in bounds:
                self.tests.append((column, bounds[type(f)], f.value))
            else:
                yield f

    def _listed(self) -> list[tuple[str, str, int]]:
        """path, oid and size of the files that filters let through; a tree is listed once, paths that are asked for alone where they are."""
        asked = next((v for c, test, v in self.tests if c == "path" and test == "in"), None)
        rows = []
        for entry in filter(None, _git(self.path, "ls-tree", "-r", "-z", "-l", self.commit, *(["--", *filter(None, asked)] if asked and any(asked) else [])).split("\0")):
            meta, path = entry.split("\t", 1)
            mode, kind, oid, size = meta.split()
            if kind == "blob" and mode != "120000" and not re.search(CONFIDENTIAL, path) and self._passes({"path": path, "oid": oid, "size": int(size)}):
                rows.append((path, oid, int(size)))
        return rows

    def _passes(self, row: dict) -> bool:
        own = {"in": lambda x, v: x in v, "starts": lambda x, v: x.startswith(v), "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
        return all(own[test](row[c], value) for c, test, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        out: list[list] = []
        held = 0
        for row in self._listed():
            size = row[2] if row[2] <= self.most else 0
            if not out or len(out[-1]) >= FILES_PER_TASK or held + size > BYTES_PER_TASK:
                out.append([])
                held = 0
            out[-1].append(row)
            held += size
        return [_Blobs(rows) for rows in out]

    def read(self, part: _Blobs | None) -> Iterator[tuple]:
        """One blob after the other is asked of one child process."""
        if part is None:  # no parts at all
            return
        with subprocess.Popen(["git", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as child:
            for path, oid, size in part.rows:
                content = None
                if size <= self.most:
                    child.stdin.write(f"{oid}\n".encode())
                    child.stdin.flush()
                    content = child.stdout.read(int(child.stdout.readline().split()[2]) + 1)[:-1]
                yield path, oid, size, content
            child.stdin.close()


class GitTreeSource(DataSource):
    """spark.read.format("git-tree"): path, oid, size and content (null beyond mostBytes) of a commit's files; one batch process a partition, which reads what filters of path, oid and size leave."""

    @classmethod
    def name(cls) -> str:
        return "git-tree"

    def schema(self) -> str:
        return "path string, oid string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return GitTreeReader(self.options)


def register(spark: SparkSession) -> None:
    """The sources of this module, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GitLogSource, GitTreeSource):
        spark.dataSource.register(source)


def recent(log: DataFrame, n: int) -> DataFrame:
    """The newest n commits, n from 1 to 100."""
    if not 1 <= n <= 100:
        raise ValueError("from 1 to 100 commits")
    return log.orderBy(F.desc("committed_at"), "sha").limit(n)


def commit_files(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each changed file with added and removed lines: sizes (sha, path, added, removed)."""
    return log.select("sha", F.explode("changes").alias("c")).select("sha", "c.*").join(sizes, ["sha", "path"], "left")


def authors(log: DataFrame) -> DataFrame:
    return log.select("author_name", "author_email").distinct().orderBy("author_name", "author_email")
