"""Schemas of all tables, as DDL, and validation against them.  Column names and types are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_T = "createdAt timestamp, updatedAt timestamp"
TABLES: dict[str, str] = {
    "users": f"id string, email string, name string, passwordHash string, avatarUrl string, githubLogin string, githubUserId string, githubTokenEnc string, githubTokenScope string, githubLinkedAt timestamp, {_T}",
    "sessions": "id string, userId string, tokenHash string, userAgent string, expiresAt timestamp, createdAt timestamp",
    "oauth_states": "id string, state string, userId string, redirect string, expiresAt timestamp, createdAt timestamp",
    "repositories": f"id string, userId string, provider string, githubId string, installationId string, owner string, name string, fullName string, description string, htmlUrl string, isPrivate boolean, defaultBranch string, sizeKb int, primaryLanguage string, languageStats string, ignorePatterns array<string>, lastAnalyzedAt timestamp, {_T}",
    "github_installations": f"id string, userId string, installationId string, accountLogin string, accountType string, accountAvatar string, repositorySelection string, {_T}",
    "repository_branches": f"id string, repositoryId string, name string, commitSha string, isDefault boolean, indexedSha string, indexedAt timestamp, {_T}",
    "repository_commits": "id string, repositoryId string, sha string, branchName string, message string, authorName string, authorEmail string, committedAt timestamp, createdAt timestamp",
    "repository_files": f"id string, repositoryId string, branchId string, path string, name string, extension string, language string, role string, sizeBytes int, lineCount int, blobSha string, contentHash string, content string, truncated boolean, isTest boolean, isConfig boolean, isGenerated boolean, hasSecrets boolean, complexity int, summary string, {_T}",
    "code_chunks": "id string, repositoryId string, fileId string, symbolName string, symbolType string, startLine int, endLine int, content string, tokenCount int, embedding array<float>, embeddingModel string, contentHash string, createdAt timestamp",
    "code_symbols": "id string, repositoryId string, fileId string, name string, kind string, signature string, parentName string, startLine int, endLine int, exported boolean, isAsync boolean, complexity int, createdAt timestamp",
    "dependencies": "id string, repositoryId string, fromFileId string, toFileId string, specifier string, isExternal boolean, kind string, createdAt timestamp",
    "analysis_runs": f"id string, repositoryId string, branchId string, commitSha string, kind string, status string, steps string, progress int, stats string, error string, aiProvider string, aiModel string, startedAt timestamp, finishedAt timestamp, {_T}",
    "analysis_findings": f"id string, repositoryId string, runId string, fileId string, reviewId string, category string, ruleId string, type string, severity string, title string, description string, evidence string, recommendation string, filePath string, startLine int, endLine int, snippet string, relatedFilePath string, relatedStartLine int, relatedEndLine int, similarity double, confidence double, confidenceLabel string, status string, source string, cwe string, falsePositive boolean, resolved boolean, metadata string, fingerprint string, {_T}",
    "repository_insights": f"id string, repositoryId string, kind string, data string, {_T}",
    "pull_requests": f"id string, repositoryId string, number int, title string, body string, state string, authorLogin string, headRef string, headSha string, baseRef string, baseSha string, url string, additions int, deletions int, changedFiles int, draft boolean, ghCreatedAt timestamp, ghUpdatedAt timestamp, {_T}",
    "pull_request_reviews": "id string, pullRequestId string, status string, summary string, verdict string, counts string, model string, provider string, postedToGithub boolean, githubCommentUrl string, postedAt timestamp, createdAt timestamp",
    "documentation": f"id string, repositoryId string, runId string, section string, title string, contentMd string, position int, sources string, {_T}",
    "test_suggestions": "id string, repositoryId string, fileId string, target string, targetKind string, framework string, cases string, code string, rationale string, filePath string, startLine int, endLine int, createdAt timestamp",
    "chat_sessions": f"id string, repositoryId string, userId string, title string, {_T}",
    "chat_messages": "id string, sessionId string, role string, content string, citations string, contextChunkIds string, groundingScore double, provider string, model string, tokensIn int, tokensOut int, latencyMs int, createdAt timestamp",
}

#: Natural keys, by which rows are replaced.
KEYS = {
    "repositories": ["userId", "fullName"], "repository_branches": ["repositoryId", "name"], "repository_commits": ["repositoryId", "sha"], "repository_files": ["branchId", "path"],
    "repository_insights": ["repositoryId", "kind"], "pull_requests": ["repositoryId", "number"], "documentation": ["repositoryId", "section"],
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def validate(df: DataFrame, table: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows cast to the table's schema, rows that a cast or a missing value spoils, with the reason)."""
    want = schema(table)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{table} needs {missing}")
    cast = {f.name: F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType) for f in want.fields}
    bad = F.concat_ws(
        ", ",
        *[F.when(F.col(f"`{c}`").isNotNull() & cast[c].isNull(), F.lit(f"{c}: not a {want[c].dataType.simpleString()}")) for c in df.columns if c in cast],
        *[F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: missing")) for c in required],
    )
    checked = df.withColumn("_problem", bad)
    good = checked.where("_problem = ''").select(*[x.alias(c) for c, x in cast.items()])
    return good, checked.where("_problem <> ''").withColumnRenamed("_problem", "problem")
