"""The corpus operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exponion, hmm, kneser, linedup, mixing, pii, quality, repair, spm, tjoin, topk
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the isolation forests' verdict on every document."""
    out = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *quality.ANOMALIES)


@query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under Jaccard links of three-word shingles."""
    return tjoin.classes(table(spark, sf_dir, "documents"))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact log10 probability of every document under the hidden Markov model, beside the smoothed counts' score."""
    return hmm.score(table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the public 32k model: their number and digest, and whether decoding gives the text back."""
    return spm.encode(table(spark, sf_dir, "documents"), spm.read_model(), ids=False)


@query
def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in every document, and its text without them."""
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: their number, what stays, and the digest of the new text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linedup.dedup_lines(docs)
    return out.select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_kept").cast("long").alias("n_kept"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"),
    )


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(every))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, and whether its language's threshold lets it pass."""
    return kneser.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 16 centroids for every vector after three rounds."""
    return exponion.cluster(table(spark, sf_dir, "embeddings"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired by the cheapest edits."""
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


@query
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    return decontam.report(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


_CONTROLS = list(chat.CONTROLS)
_IN_TEXT = "[" + ", ".join("'" + c + "'" for c in _CONTROLS) + "]"


def _sql_escaped(text: str) -> str:
    """SQL for the length of a text or role after escaping; the control strings can't overlap one another."""
    gain = " + ".join(
        f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)} * {len(f'{chat.ESCAPE}{i};') - len(c)}" for i, c in enumerate(_CONTROLS)
    )
    return f"(length({text}) + {gain})"


ORACLES["op8_chat_formatting"] = f"""
WITH every AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_sql_escaped("role")} + {_sql_escaped("text")} + {len(chat.OPEN + chat.TEXT + chat.CLOSE) + 1}) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""

ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# Each assignment compares all vectors with all centroids; the rounds are unrolled.
_ASSIGN = """
  d{i} AS (SELECT v.row, c.j, list_sum(list_transform(generate_series(1, 64), lambda p: (v.v[p] - c.c[p]) * (v.v[p] - c.c[p]))) AS d FROM v CROSS JOIN c{i} c),
  a{i} AS (SELECT row, min(d) AS d, arg_min(j, (d, j)) AS j FROM d{i} GROUP BY row)"""
_MOVE = """
  m{i} AS (SELECT a.j, p.p, sum(v.v[p.p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} a JOIN v USING (row) CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS p) p GROUP BY ALL),
  c{n} AS (SELECT c.j, coalesce(l.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM m{i} GROUP BY j) l USING (j))"""

ORACLES["op11_centroid_clustering"] = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v)
  QUALIFY j < 16
), {",".join(_ASSIGN.format(i=i) + "," + _MOVE.format(i=i, n=i + 1) for i in range(3))}, {_ASSIGN.format(i=3)}
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(list_transform(c.c, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a3 a JOIN v USING (row) JOIN c3 c USING (j)
"""

# The states of op12: what stands before a row (n: nothing, s, u, a).  Each holds the least struct (cost, audit, repaired),
# null where it can't be reached; one row of every conversation is taken at a time.
_INSERTED = lambda x, role: f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + 5, 'a': {x}.a || 'I', 'r': {x}.r || chr(10) || '{role}:'}} END"


def _edited(x: str, cost: str, letter: str, said: str = "", when: str = "true") -> str:
    return f"CASE WHEN {x} IS NULL OR NOT ({when}) THEN NULL ELSE {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'r': {x}.r{f' || chr(10) || {said}' if said else ''}}} END"


_KEPT = "p.role || ':' || p.text"
_MORE = "CASE WHEN p.fault = 3 THEN 5 ELSE 0 END"


def _may(role: str) -> str:
    return f"p.fault NOT IN (1, 2) AND left(p.role, 1) = '{role}'"


def _rerole(x: str, role: str) -> str:
    return _edited(x, f"1 + {_MORE}", "R", f"'{role}:' || p.text", "p.fault NOT IN (1, 2)")


_BEFORE = "n0 AS (SELECT d.conv_id, d.i, d.n, d.s, least(d.u, {nu}, {su}, {au}) AS u, d.a FROM {src} d), n1 AS (SELECT conv_id, i, n, s, u, least(a, {ua}) AS a FROM n0 d), n2 AS (SELECT conv_id, i, n, s, least(u, {au}) AS u, a FROM n1 d)"


def _with_inserts(src: str) -> str:
    return _BEFORE.format(src=src, nu=_INSERTED("d.n", "user"), su=_INSERTED("d.s", "user"), au=_INSERTED("d.a", "user"), ua=_INSERTED("d.u", "assistant"))


ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (
  SELECT id, 0 AS i, length(key) * 8 AS n, key, 4294967295::BIGINT AS crc FROM keyed
  UNION ALL
  SELECT id, i + 1, n, key,
    CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(key, i // 8 + 1, 1))::BIGINT) ELSE crc END AS x FROM bits WHERE i < n)
), hashed AS (SELECT k.*, xor(b.crc, 4294967295::BIGINT) % 20 AS k FROM keyed k JOIN bits b ON b.id = k.id AND b.i = b.n),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, LATERAL (SELECT unnest(generate_series(1, CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed FROM damaged
), p AS (
  SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM p GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS a FROM facts
  UNION ALL
  SELECT * FROM (
    WITH {_with_inserts("steps")}
    SELECT d.conv_id, p.i, {_edited("d.n", "2", "D")} AS n,
      least({_edited("d.s", "2", "D")}, {_edited("d.n", _MORE, "K", _KEPT, _may("s"))}) AS s,
      least({_edited("d.u", "2", "D")}, {", ".join(_edited(f"d.{x}", _MORE, "K", _KEPT, _may("u")) for x in "nsa")}, {", ".join(_rerole(f"d.{x}", "user") for x in "nsa")}) AS u,
      least({_edited("d.a", "2", "D")}, {_edited("d.u", _MORE, "K", _KEPT, _may("a"))}, {_rerole("d.u", "assistant")}) AS a
    FROM n2 d JOIN p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i + 1
  )
), final AS (
  SELECT e.conv_id, least(e.n, e.a) AS best FROM (WITH {_with_inserts("steps")} SELECT * FROM n2) e JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.rows = e.i
)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  coalesce(b.best.c, 0) AS cost, coalesce(b.best.a, '') AS audit, sha256(coalesce(substr(b.best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_NORMAL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op13_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_NORMAL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_NORMAL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
  FROM (SELECT row, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT p.row, p.i, p.size, w.item_id FROM places p JOIN windows w USING (size, win)),
words AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(generate_series(i, i + size - 1)) AS pos FROM (SELECT DISTINCT row, i, size FROM hits)) GROUP BY row),
items AS (SELECT row, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY row),
spans AS (
  SELECT row, count(*) AS n FROM (
    SELECT row, pos, lag(pos) OVER (PARTITION BY row ORDER BY pos) AS before
    FROM (SELECT DISTINCT row, unnest(generate_series(i, i + size - 1)) AS pos FROM hits)
  ) WHERE before IS NULL OR before < pos - 1 GROUP BY row
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.l, '')) AS items_sha256, words.n IS NOT NULL AS contaminated, CAST(coalesce(spans.n, 0) AS BIGINT) AS n_spans
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row) LEFT JOIN spans USING (row)
"""
