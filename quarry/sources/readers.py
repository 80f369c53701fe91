"""Readers: file trees, exported API pages, scanner output, settings."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha, content) of all files under a folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    root = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(root) + 1, 1 << 20)
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.sha1("content").alias("sha"), "content")


def text_content(df: DataFrame, content: str = "content") -> DataFrame:
    """Bytes decoded as UTF-8, bytes that aren't become replacement marks."""
    return df.withColumn(content, F.decode(F.col(content), "UTF-8"))


def from_base64(df: DataFrame, col: str) -> DataFrame:
    """Base64 content, with line breaks, as text."""
    return df.withColumn(col, F.decode(F.unbase64(F.regexp_replace(col, "\\s", "")), "UTF-8"))


COMMITS = "sha string, commit struct<message:string, author:struct<name:string, email:string, date:string>>, files array<struct<filename:string, status:string, additions:int, deletions:int, patch:string>>"
PULLS = "number int, title string, body string, state string, draft boolean, user struct<login:string>, head struct<ref:string, sha:string>, base struct<ref:string, sha:string>, created_at string, updated_at string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported commits, one row each."""
    raw = spark.read.schema(COMMITS).json(path, multiLine=True)
    return raw.select("sha", "commit.message", F.col("commit.author.name").alias("author"), F.to_timestamp("commit.author.date").alias("committed_at"), "files")


def commit_patches(commits_: DataFrame) -> DataFrame:
    """(sha, path, status, patch) of what commits change (S3)."""
    return commits_.select("sha", F.explode("files").alias("f")).select("sha", F.col("f.filename").alias("path"), "f.status", "f.patch")


def pulls(spark: SparkSession, path: str) -> DataFrame:
    """Exported pull requests."""
    raw = spark.read.schema(PULLS).json(path, multiLine=True)
    return raw.select("number", "title", "state", "draft", F.col("user.login").alias("author"), F.col("head.ref").alias("head_ref"), F.col("base.ref").alias("base_ref"), F.to_timestamp("created_at").alias("created_at"))


class _Page(InputPartition):
    def __init__(self, number: int, items: list) -> None:
        super().__init__(number)
        self.items = items


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self):
        most, out = int(self.options.get("most", "1000000")), []
        for i, page in enumerate(json.loads(self.options["pages"])):
            out.append(_Page(i, page[: max(0, most)]))
            most -= len(page)
        return out or [_Page(0, [])]

    def read(self, partition):
        for item in partition.items:
            yield (json.dumps(item, sort_keys=True),)


class PagedSource(DataSource):
    """Pages of a listing up to a cap, one partition a page (S4).  Pages come as an option; a subclass may fetch them."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType | str:
        return "item string"

    def reader(self, schema):
        return _PagesReader(dict(self.options))


SCAN = "results array<struct<check_id:string, path:string, start:struct<line:int>, `end`:struct<line:int>, extra:struct<message:string, severity:string, lines:string, is_ignored:boolean, metadata:struct<confidence:string, impact:string, cwe:array<string>>, dataflow_trace:struct<taint_source:string>>>>"


def scanner_results(df: DataFrame, col: str) -> DataFrame:
    """Rows of an external scanner's JSON output; ignored ones and unreadable outputs give none."""
    r = df.select(F.explode(F.from_json(col, SCAN)["results"]).alias("r")).where(~F.coalesce("r.extra.is_ignored", F.lit(False)))
    return r.select(
        "r.check_id", "r.path", F.col("r.start.line").alias("start"), F.col("r.end.line").alias("end"), "r.extra.severity", "r.extra.message",
        "r.extra.metadata.confidence", "r.extra.metadata.impact", F.col("r.extra.dataflow_trace.taint_source").isNotNull().alias("taint"),
    )


ADVISORY = (
    "id string, summary string, withdrawn string, aliases array<string>, severity array<struct<type:string, score:string>>, "
    "affected array<struct<package:struct<ecosystem:string, name:string>, versions:array<string>, ranges:array<struct<type:string, events:array<struct<introduced:string, fixed:string, last_affected:string>>>>>>"
)


def advisories(df: DataFrame, col: str) -> DataFrame:
    """Advisories of a dump, a JSON record a row; unreadable records and such without an id are left out."""
    return df.select(F.from_json(col, ADVISORY).alias("a")).select("a.*").where("id is not null")


def advisory_ids(packages: DataFrame, known: DataFrame) -> DataFrame:
    """``packages`` (ecosystem, name, version) with the ids of advisories that affect the version (S8, first phase).

    A version is affected where it is listed, or where an event introduces the fault at or before it and none after that
    ends it up to there.  A join on the package, whichever side is large.
    """
    from quarry.operators.sorts import version_key

    rows = known.select("id", F.explode("affected").alias("a")).select("id", "a.package.ecosystem", "a.package.name", "a.versions", "a.ranges")
    own = version_key(F.col("version"))

    def within(events):
        start = lambda i: F.when(i == "0", own).otherwise(version_key(i))
        ends = lambda e, i: ((version_key(e["fixed"]) > start(i)) | (i == "0")) & (version_key(e["fixed"]) <= own) | (version_key(e["last_affected"]) >= start(i)) & (version_key(e["last_affected"]) < own)
        begun = F.filter(events, lambda e: e["introduced"].isNotNull() & (start(e["introduced"]) <= own))
        return F.exists(begun, lambda b: ~F.exists(events, lambda e: F.coalesce(ends(e, b["introduced"]), F.lit(False))))

    hit = F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)) | F.coalesce(F.exists("ranges", lambda r: within(r["events"])), F.lit(False))
    return packages.join(rows, ["ecosystem", "name"]).where(hit).select("ecosystem", "name", "version", "id").distinct()


def advisory_details(ids: DataFrame, known: DataFrame) -> DataFrame:
    """The records of the ids, without such as were withdrawn (S8, second phase)."""
    return known.where("withdrawn is null").join(ids.select("id").distinct(), "id", "left_semi")


def webhook_signature(body, secret: str):
    """``sha256=`` and the keyed hash (HMAC) of a binary column, by built-in functions."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256))


def webhook_events(deliveries: DataFrame, secret: str | None) -> DataFrame:
    """``deliveries`` (body binary, signature, event) with status, action and installation_id.

    Status 503: no secret is set; 400: no JSON; 401: the signature is absent or wrong; else 200, and only then the rest.
    """
    parsed = F.from_json(F.decode("body", "UTF-8"), "action string, installation struct<id:string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = F.coalesce(F.col("signature") == webhook_signature(F.col("body"), secret), F.lit(False)) if secret else F.lit(False)
    status = F.lit(503) if not secret else F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull(), 400).when(~good, 401).otherwise(200)
    out = deliveries.withColumn("_p", parsed).withColumn("status", status)
    ok = F.col("status") == 200
    return out.withColumns({"action": F.when(ok, F.col("_p.action")), "installation_id": F.when(ok, F.col("_p.installation.id"))}).drop("_p")


def still_installed(installations: DataFrame, events: DataFrame, col: str = "installation_id") -> DataFrame:
    """Installations without those that a genuine event deleted."""
    gone = events.where("status = 200 and event = 'installation' and action = 'deleted' and installation_id <> ''")
    return installations.join(gone.select(F.col("installation_id").alias(col)), col, "left_anti")


def env_lines(df: DataFrame, col: str) -> DataFrame:
    """(name, value) of .env lines: blanks and comments skipped, matching quotes dropped, the first of a name wins."""
    lines = df.select(F.posexplode(F.split(col, "\n", -1)).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "\r$", "")))
    pairs = lines.where("line <> '' and line not like '#%' and instr(line, '=') > 1")
    name, raw = F.trim(F.regexp_replace(F.substring_index("line", "=", 1), "^export\\s+", "")), F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    value = F.regexp_replace(raw, "^(?:\"(.*)\"|'(.*)')$", "$1$2")
    w = Window.partitionBy("name").orderBy("at")
    return pairs.select("at", name.alias("name"), value.alias("value")).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "value")


#: Paths of the policy file, the first that exists wins.
POLICY_PATHS = [".quarry.json", ".quarry.yml", ".quarry.yaml", ".github/quarry.json", ".github/quarry.yml", ".github/quarry.yaml"]


def _yaml(content: str) -> dict:
    """A YAML document; ValueError where it can't be read or no reader of YAML is installed."""
    try:
        import yaml
    except ImportError as e:
        raise ValueError("no reader of YAML is installed") from e
    try:
        return yaml.safe_load(content)
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from e


def policy_rules(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rules of the first policy file (JSON or YAML) there is, with its problems as rows of kind error.

    The file is bounded by the file limit, so it is read on the driver.
    """
    from quarry.operators.filters import glob_pattern

    found = {r["path"]: r["content"] for r in files.where(F.col("path").isin(POLICY_PATHS)).select("path", "content").collect()}
    path = next((p for p in POLICY_PATHS if p in found), None)
    rows = []
    if path:
        try:
            doc = json.loads(found[path]) if path.endswith(".json") else _yaml(found[path])
            for p in doc.get("policies", [])[:100]:
                globs = lambda v: "|".join(f"(?:{glob_pattern(g)})" for g in ([v] if isinstance(v, str) else v or []))
                rows.append((str(p["id"]), p.get("severity", "medium"), globs(p.get("files", "**")) or ".*", globs(p.get("exclude")) or None, p.get("forbidPattern"), p.get("requirePattern"), None))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            rows.append((path, "low", None, None, None, None, f"policy file can't be read: {e}"))
    return spark.createDataFrame(rows, "policy string, severity string, files string, exclude string, forbid string, require string, error string")


def within_root(path: str) -> bool:
    """Whether a relative path stays under its root."""
    depth = 0
    for p in PurePosixPath(path).parts:
        if p in ("/", "\\") or "\\" in p or "\x00" in p:
            return False
        depth += -1 if p == ".." else 1
        if depth < 0:
            return False
    return True
