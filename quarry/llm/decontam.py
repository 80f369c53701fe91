"""Benchmark decontamination: windows of benchmark words found in documents by an Aho-Corasick automaton over words.

Texts are normalised to words (A-Z lower-cased; a word is a run of letters, digits and all that is beyond ASCII).  Every
``width`` consecutive words of an item are a window, a shorter item is one window as a whole.  All windows go into one
automaton whose letters are word numbers, and each text runs through it once; word offsets lead back to code points of
the original text.

The automaton of a shard holds at most about ``PAIRS`` (window, item) pairs.  A benchmark beyond that is dealt to several
shards by hash, which pass over the documents one after another; what they find is united by the digest of the text.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, id_text

WIDTH = 10
#: (window, item) pairs of one automaton: about 150 MB of a Python worker.
PAIRS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_JAVA = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same words in lower-cased UTF-8

HIT = "array<struct<first:int,last:int,start:int,end:int>>"
SCANNED = f"key string, n_words long, hits {HIT}, items array<string>"


def word_list(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD_JAVA), F.lit(0))


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(window, item): the distinct windows of each item, words joined by spaces.  Wordless and null texts have none."""
    words = benchmark.select(column(benchmark, item_col).cast("string").alias("item"), word_list(column(benchmark, text_col).cast("string")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    each = F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))
    return words.where(F.size("w") > 0).select(F.explode(each).alias("window"), "item").distinct()


class Scanner:
    """The automaton of some windows; built in each worker from the windows, which are what is sent."""

    def __init__(self, found: dict[str, list[str]]):
        self.number: dict[bytes, int] = {}
        self.items = list(found.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, window in enumerate(found):
            # a word's number starts at 1; 0 is every word that no window has
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window.encode().split(b" "))
            self.automaton.add_word(ids, (len(ids), k))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        """Number of words; hit stretches as first and last word and code points from, to; items whose windows occur."""
        low = text.lower()  # of bytes: A-Z only, lengths stay
        words = _WORD.findall(low)
        if not words or not self.items:
            return len(words), [], []
        get = self.number.get
        stretches: list[list[int]] = []
        seen = set()
        for end, (size, k) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            first = end - size + 1
            seen.add(k)
            while stretches and first <= stretches[-1][1] + 1:
                first = min(first, stretches.pop()[0])
            stretches.append([first, end])
        if not stretches:
            return len(words), [], []
        edges = {i for s in stretches for i in s}
        place = {i: m.span() for i, m in enumerate(_WORD.finditer(low)) if i in edges}
        hits, at, points = [], 0, 0
        for first, last in stretches:
            start, end = place[first][0], place[last][1]
            points += len(text[at:start].decode("utf-8", "replace"))
            long = len(text[start:end].decode("utf-8", "replace"))
            hits.append((first, last, points, points + long))
            at, points = end, points + long
        return len(words), hits, sorted({i for k in seen for i in self.items[k]})


#: The scanner of a worker process, by the name of what was sent; the next one replaces it.
_built: dict[str, Scanner] = {}


def _scan(rows: DataFrame, found: dict[str, list[str]], every: bool) -> DataFrame:
    """SCANNED for each row (key, text), or for those with hits only."""
    sent, name = rows.sparkSession.sparkContext.broadcast(found), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = Scanner(sent.value)
        scanner = _built[name]
        kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")])), pa.list_(pa.string()))
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, hits, items = scanner.scan(bytes(text.as_buffer()) if text.is_valid else b"")
                if every or hits:
                    out.append((key, n, [dict(zip(("first", "last", "start", "end"), h, strict=True)) for h in hits], items))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "n_words", "hits", "items"])

    return rows.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCANNED)


def _united(parts: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of the shards as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits in batch.column(2).to_pylist():
                joined: list[dict] = []
                for h in sorted(hits, key=lambda h: (h["first"], h["last"])):
                    if joined and h["first"] <= joined[-1]["last"] + 1:
                        if h["last"] > joined[-1]["last"]:
                            joined[-1] |= {"last": h["last"], "end": h["end"]}
                    else:
                        joined.append(dict(h))
                out.append(joined)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, batch.schema.field(2).type), batch.column(3)], names=["key", "n_words", "hits", "items"])

    return parts.mapInArrow(run, SCANNED)


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, pairs_a_shard: int = PAIRS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items, contaminated) for each row of ``docs``.

    ``spans`` are the hit stretches as code points of the original text (end exclusive), ``items`` the ids of the items
    with an occurring window, distinct and sorted as strings.  Null and wordless texts have no words and no hits; null and
    wordless items no windows.  An item without an id hits words but is not listed.  Repeated rows and ids are rows of
    their own; windows that several items share count for each.  An empty benchmark hits nothing, an empty table of
    documents gives an empty result.  Extra columns are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    pairs = cut(windows(benchmark, item_col, item_text_col, width))
    shards = max(1, -(-pairs.count() // pairs_a_shard))
    pairs = pairs.withColumn("shard", F.pmod(F.xxhash64("window", "item"), F.lit(shards)))

    def windows_of(shard: int) -> dict[str, list[str]]:
        found = defaultdict(list)
        for r in pairs.where(F.col("shard") == shard).collect():  # about pairs_a_shard rows, whatever the benchmark's size
            found[r["window"]] += [r["item"]] if r["item"] is not None else []
        return dict(found)

    kind = dict(rows.dtypes)["doc_id"]
    if shards == 1:
        out = _scan(rows.select(F.col("doc_id").cast("string").alias("key"), "text"), windows_of(0), True).withColumn("doc_id", F.col("key").cast(kind))
    else:
        keyed = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "text")
        parts = None
        for shard in range(shards):
            part = cut(_scan(keyed, windows_of(shard), shard == 0))
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        out = keyed.select("doc_id", "key").join(_united(merged), "key", "left")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("spans"), "items", (F.size("hits") > 0).alias("contaminated"),
    )


def report(found: DataFrame) -> DataFrame:
    """What ``find`` gives, with items as their number and digest."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("spans").cast("long").alias("n_spans"),
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with the hit stretches cut out of their texts, in the order and kind of its columns.

    Rows without hits stay as they are, null texts null.  The stretches are found row by row, so repeated ids do no harm.
    """
    names = docs.columns
    packed = docs.select(*[column(docs, c).alias(f"__{i}") for i, c in enumerate(names)])
    text, at = f"__{names.index(text_col)}", f"__{names.index(id_col)}"
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    texts = packed.select(digest.alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    hit = find(texts, benchmark, "digest", "text", **more).where("contaminated").select(F.col("doc_id").alias("digest"), "spans")
    joined = packed.withColumn("digest", digest).join(hit, "digest", "left")
    ends = F.concat(F.array(F.lit(0)), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col(text), a + 1, b - a)), "")
    out = joined.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(kept))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])
