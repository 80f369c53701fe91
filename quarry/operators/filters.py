"""Filters over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import explode_lines


def line_search(docs: DataFrame, needle: str, limit: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Case-insensitive literal search: the first ``limit`` hits by document and line, trimmed, 300 characters each."""
    if len(needle) < 2:
        return docs.sparkSession.createDataFrame([], f"{id_col} {docs.schema[id_col].dataType.simpleString()}, line_no int, line string")
    has = F.contains(F.lower(F.col(text_col)), F.lit(needle.lower()))
    lines = explode_lines(docs.where(has), id_col, text_col)
    return (
        lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
        .select(id_col, "line_no", F.substring(F.trim("line"), 1, 300).alias("line"))
        .orderBy(id_col, "line_no").limit(limit)
    )


# -- discovery ---------------------------------------------------------------------------------------------------------


def skip_reasons(files: DataFrame, ignored: Column, most_bytes: int, language: str = "language", size: str = "size", kind: Column | None = None, unknown_most: int = 50_000) -> DataFrame:
    """Files with the first reason to skip them, null for those to take (F1)."""
    k = F.lit("blob") if kind is None else kind
    reason = (
        F.when(k != "blob", "not a file").when(ignored, "ignored").when(F.col(size) > most_bytes, "too large")
        .when(F.col(language).isNull() & (F.col(size) > unknown_most), "unknown and large")
    )
    return files.withColumn("reason", reason)


def check_limits(files: DataFrame, size: str, most_files: int, most_bytes: int) -> tuple[int, int]:
    """Number and bytes of the files; an error beyond the limits (F2)."""
    r = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if r["n"] > most_files or r["b"] > most_bytes:
        raise ValueError(f"{r['n']} files of {r['b']} bytes are beyond the limits of {most_files} files and {most_bytes} bytes")
    return r["n"], r["b"]


def glob_pattern(glob: str) -> str:
    """An ignore-file pattern as a regular expression over slash-separated paths."""
    g = glob.rstrip()
    directory, g = g.endswith("/"), g.rstrip("/")
    rooted, g = "/" in g, g.lstrip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "{" and "}" in g[i:]:
            end = g.index("}", i)
            out, i = out + "(?:" + "|".join(_escape(x) for x in g[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + _escape(g[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if directory else "(?:/|$)")


def _escape(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_-/ " or ord(c) > 127 else "\\" + c for c in s)


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches a path ignores it; a leading ! takes back."""
    out = F.lit(False)
    for p in patterns:
        back = p.startswith("!")
        out = F.when(path.rlike(glob_pattern(p.lstrip("!"))), F.lit(not back)).otherwise(out)
    return out


def incremental(old: DataFrame, new: DataFrame, path: str = "path", sha: str = "sha", same_model: bool = True) -> DataFrame:
    """(path, state): changed, unchanged or removed; with another model all that is left is changed."""
    o, n = old.select(F.col(path).alias("_o"), F.col(sha).alias("_os")), new.select(F.col(path).alias("_n"), F.col(sha).alias("_ns"))
    same = F.col("_os").eqNullSafe(F.col("_ns")) & F.col("_o").isNotNull() & F.lit(same_model)
    state = F.when(F.col("_n").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return o.join(n, F.col("_o") == F.col("_n"), "full_outer").select(F.coalesce("_n", "_o").alias("path"), state.alias("state"))


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8000 bytes, or over 30 % control bytes there."""
    head = F.hex(F.substring(content, 1, 8000))
    n = F.length(head) / 2
    pairs = F.regexp_extract_all(head, F.lit("(..)"), F.lit(1))
    control = F.size(F.filter(pairs, lambda p: p.rlike("^(?:0[0-6]|0F|1[0-9A-F])$")))
    return F.exists(pairs, lambda p: p == "00") | (F.when(n > 0, control / n).otherwise(0.0) > 0.3)


def language(path: Column) -> Column:
    """Language by file name, else by extension; null if unknown."""
    from quarry.functions.paths import basename, extension
    from quarry.rules.names import LANGUAGE_BY_EXTENSION, LANGUAGE_BY_NAME

    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(LANGUAGE_BY_NAME), F.lower(basename(path))), F.try_element_at(table(LANGUAGE_BY_EXTENSION), extension(path)))


def is_test(path: Column) -> Column:
    """Whether a path is that of a test."""
    from quarry.rules.names import ROLE_BY_PATH

    return path.rlike(dict(ROLE_BY_PATH)["test"])


def is_config(path: Column) -> Column:
    """Whether a path is that of settings (F8)."""
    from quarry.functions.paths import basename
    from quarry.rules.names import CONFIG_NAMES

    return F.lower(basename(path)).isin(CONFIG_NAMES) | path.rlike("(?i)\\.(?:csproj|sln)$|(?:^|/)(?:config|configs|settings|\\.github)/.*\\.(?:json|ya?ml|toml|ini|[jt]s|py)$|\\.config\\.[a-z]+$")


def looks_generated(content: Column) -> Column:
    """Whether the first 800 characters say that a tool wrote the file."""
    from quarry.rules.names import GENERATED_MARKERS

    head, out = F.lower(F.substring(content, 1, 800)), F.lit(False)
    for m in GENERATED_MARKERS:
        out = out | F.contains(head, F.lit(m))
    return out


def role(path: Column, content: Column) -> Column:
    """A file's role: the first rule that applies, by path and then by content."""
    from quarry.rules.names import ROLE_BY_CONTENT, ROLE_BY_PATH, ROLE_ENTRY

    out = F.when(path.rlike(ROLE_BY_PATH[0][1]), ROLE_BY_PATH[0][0])
    for name, pattern in ROLE_BY_PATH[1:]:
        out = out.when(path.rlike(pattern), name)
    for name, pattern in ROLE_BY_CONTENT:
        out = out.when(content.rlike(pattern), name)
    out = out.when(path.rlike(ROLE_ENTRY[0]) & content.rlike(ROLE_ENTRY[1]), "entry")
    barrel = path.rlike("(?:^|/)index\\.[jt]s$") & ~content.rlike("(?m)^(?!\\s*(?:export\\b.*\\bfrom\\b|//|$)).+$")
    return out.when(barrel, "barrel").otherwise("unknown")


def is_embeddable(path: Column, lang: Column) -> Column:
    """Whether a file is worth embedding."""
    return lang.isNotNull() & ~lang.isin("json", "css", "scss", "toml") & ~path.rlike("(?i)\\.(?:lock|min\\.[a-z]+|map|snap)$") & ~path.rlike("(?i)(?:^|/)(?:package-lock|pnpm-lock|yarn|composer)[^/]*$")


def is_vendored(path: Column) -> Column:
    """Whether a path is inside copied dependencies."""
    from quarry.rules.names import VENDORED

    low, out = F.lower(path), F.lit(False)
    for v in VENDORED:
        out = out | F.startswith(low, F.lit(v)) | F.contains(low, F.lit("/" + v))
    return out


# -- lists -------------------------------------------------------------------------------------------------------------


def any_of(df: DataFrame, **values: list | None) -> DataFrame:
    """Rows whose columns are among the given values; None doesn't filter."""
    for c, v in values.items():
        if v is not None:
            df = df.where(F.col(c).isin(list(v)))
    return df


def search_columns(df: DataFrame, needle: str, *cols: str) -> DataFrame:
    """Rows any of whose columns contain the needle, whatever the case."""
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return df.where(out)


def category_views(findings: DataFrame, categories: list[str]) -> dict[str, DataFrame]:
    """A view for each category, also by name for SQL."""
    out = {}
    for c in categories:
        out[c] = findings.where(F.col("category") == c)
        out[c].createOrReplaceTempView(f"{c}_findings")
    return out


def of_branch(findings: DataFrame, files: DataFrame, runs: DataFrame, branch) -> DataFrame:
    """Findings whose file is on the branch, or that have no file but whose run is (F16)."""
    f = files.select(F.col("id").alias("file_id"), F.col("branch_id").alias("_fb"))
    r = runs.select(F.col("id").alias("run_id"), F.col("branch_id").alias("_rb"))
    hit = (F.col("_fb") == branch) | (F.col("file_id").isNull() & (F.col("_rb") == branch))
    return findings.join(f, "file_id", "left").join(r, "run_id", "left").where(hit).drop("_fb", "_rb")


def resolve_branch(branches: DataFrame, name: str | None = None) -> DataFrame:
    """The named branch; else the latest indexed, default first; else the default or oldest."""
    if name is not None:
        return branches.where(F.col("name") == name).limit(1)
    indexed = F.col("indexed_at").isNotNull()
    return branches.orderBy(indexed.desc(), F.when(indexed, F.col("is_default")).desc(), F.when(indexed, F.col("indexed_at")).desc(), F.col("is_default").desc(), "created_at", "name").limit(1)


def with_prefix(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Files under a prefix, by path."""
    return files.where(F.startswith(F.col(path), F.lit(prefix))).orderBy(path)


def model_drift(chunks: DataFrame, current: str, vector: str = "embedding", model: str = "embedding_model") -> DataFrame:
    """One row: whether any stored vector is of another model."""
    return chunks.where(F.col(vector).isNotNull()).agg(F.coalesce(F.bool_or(~F.col(model).eqNullSafe(F.lit(current))), F.lit(False)).alias("drift"))


def policy_findings(files: DataFrame, rules: DataFrame, cap: int = 50, cut: int = 2000) -> DataFrame:
    """(policy, path, line, text, missing) by policy rules.

    A rule (policy, files, exclude: patterns of paths; forbid, require: patterns of lines) finds each line, cut to 2000
    characters, that matches forbid, and each file no line of which matches require.  At most ``cap`` a rule.
    """
    from pyspark.sql import Window

    r = F.broadcast(rules)  # a settings file's rules: at most some hundred
    hit = files.where(~F.col("is_generated")).join(r, F.expr("path rlike files and not coalesce(path rlike exclude, false)"))
    lines = hit.where("forbid is not null").select("policy", "path", "forbid", F.posexplode(F.split("content", "\n", -1)).alias("at", "raw"))
    forbidden = lines.withColumn("raw", F.substring("raw", 1, cut)).where(F.expr("raw rlike forbid")).select("policy", "path", (F.col("at") + 1).alias("line"), F.col("raw").alias("text"), F.lit(False).alias("missing"))
    missing = hit.where(F.expr("require is not null and not (content rlike concat('(?m)', require))")).select("policy", "path", F.lit(1).alias("line"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("missing"))
    every = forbidden.unionByName(missing)
    n = F.row_number().over(Window.partitionBy("policy").orderBy("path", "line"))
    return every.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def unmatched_policies(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose patterns select no file."""
    return rules.join(files.select("path").alias("f"), F.expr("path rlike files and not coalesce(path rlike exclude, false)"), "left_anti")
