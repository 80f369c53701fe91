"""Personal data: spans of four kinds by rule, and an information-theoretic search for terms that give them away.

Rules find e-mail addresses, network addresses, card and phone numbers.  The protected entities are these kinds.  Over
all texts, term by term, it is counted how often a term stands within WINDOW words of an entity of a kind, and how often
at all.  A term discloses a kind as far as its pointwise mutual information with it comes to the kind's whole
information content: ``PMI(kind; term) / IC(kind) = 1 + log P(kind | term) / IC(kind)``.  Terms at THRESHOLD or more
are spans too, if chance does not explain that they stand near the kind so often: near an entity they are removed with it,
elsewhere they are generalised to their kind.

Chance is that of a word anywhere to stand near the kind; the bound (Chernoff's) on seeing so many of a term's texts near it
must be ALPHA or less for all pairs of term and kind together.  So a rare term that always stands there counts from 2 texts
on where that is unlikely enough.

Terms are counted as hashes in the partitions first.  How often candidates occur at all is counted only for words that a bit map
of the candidates (of fixed size) lets through; joins on the hash make it exact.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import cut, id_text

KINDS = ("email", "ip", "card", "phone")
WINDOW = 3
THRESHOLD = 0.9
ALPHA = 0.05
BITS = 22
SLICES = 8

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]++$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_DIGITS = str.maketrans("", "", " -().+")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of the e-mail rule, found from each at sign outwards, so that long runs cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no local part reaches over an at sign
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    if not text:
        return []
    out = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        at = 0
        while m := _PHONE.search(text, at):
            end = m.end()
            while end > m.start() + 1 and not text[end - 1].isdecimal():
                end -= 1
            # a plus, a digit, one character or more, a digit
            if end - m.start() < 4:
                at = m.start() + 1
                continue
            if 9 <= len(text[m.start() : end].translate(_DIGITS)) <= 15:
                out.append(("phone", m.start(), end))
            at = end
    return out


def _words_near(text_points: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: list[Span]) -> tuple[np.ndarray, dict[str, set[int]]]:
    """Indices of a text's words that overlap a span, and by kind those within WINDOW words of one (without them)."""
    inside = np.zeros(len(starts), bool)
    near: dict[str, set[int]] = {}
    at = [(k, int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))) for k, a, b in spans]
    for _, a, b in at:
        inside[a:b] = True
    for k, a, b in at:
        near.setdefault(k, set()).update(i for i in (*range(max(0, a - WINDOW), a), *range(b, min(len(starts), b + WINDOW))) if not inside[i])
    return inside, near


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the base spans and, for the texts that have any, the hashes of the words near them by kind."""
    for batch in w.per_batch(batches):
        texts = batch.column(1).to_pylist()
        spans = [base_spans(t or "") for t in texts]
        hit = [i for i, s in enumerate(spans) if s]
        near: list[list[dict]] = [[] for _ in texts]
        if hit:
            data, offsets = w.buffers(pa.array([texts[i] for i in hit], pa.string()))
            starts, ends, hashes = w.words(data, offsets, lower=True)
            first, points = w.word_offsets(starts, offsets), w.code_points(data)
            for j, i in enumerate(hit):
                a, b = first[j], first[j + 1]
                zero = points[offsets[j]]
                _, by_kind = _words_near(points, points[starts[a:b]] - zero, points[ends[a:b]] - zero, spans[i])
                h = hashes[a:b].view(np.int64)
                near[i] = [{"kind": k, "h": x} for k, at in by_kind.items() for x in sorted({int(h[q]) for q in at})]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind),
                pa.array(near, pa.list_(pa.struct([("kind", pa.string()), ("h", pa.int64())]))),
            ],
            names=["doc_id", "row", "base", "near"],
        )


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes in column h, merged on executors; its size is fixed."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BITS - 3), np.uint8)
        for batch in batches:
            at = (np.asarray(batch.column(0), np.int64).view(w.U64) >> w.U64(64 - BITS)).astype(np.int64)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        parts = np.split(table, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts])], names=["slice", "marks"])

    def merge(pdf):
        total = np.zeros((1 << (BITS - 3)) // SLICES, np.uint8)
        for x in pdf["marks"]:
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pdf.head(1).assign(marks=[total.tobytes()])

    out = np.zeros((SLICES, (1 << (BITS - 3)) // SLICES), np.uint8)
    for r in hashes.select("h").mapInArrow(marks, "slice int, marks binary").groupBy("slice").applyInPandas(merge, "slice int, marks binary").collect():
        out[r["slice"]] = np.frombuffer(r["marks"], np.uint8)
    return out.ravel()


def _passing(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = (hashes >> w.U64(64 - BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def disclosing_terms(own: DataFrame, scanned: DataFrame, threshold: float = THRESHOLD, alpha: float = ALPHA) -> DataFrame:
    """(h, kind): terms whose co-occurrence with a kind discloses it, each with the kind it discloses most."""
    near = cut(scanned.select(F.explode("near").alias("n")).groupBy("n.kind", "n.h").agg(F.count("*").alias("joint")))
    # one text alone shows nothing to recur
    candidates = near.where("joint >= 2").select("h", "kind", "joint")
    if candidates.isEmpty():
        return candidates.select("h", "kind")
    table = own.sparkSession.sparkContext.broadcast(_bit_map(candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For passing words, the number of the partition's texts that hold them; as h null the number of texts, and of all words."""
        total, every, found = 0, 0, []
        for batch in w.per_batch(batches):
            data, offsets = w.buffers(batch.column(1))
            starts, _, hashes = w.words(data, offsets, lower=True)
            owner = np.searchsorted(offsets, starts, "right") - 1
            ok = _passing(hashes, table.value)
            pair = np.unique(np.stack([owner[ok].astype(w.U64), hashes[ok]]), axis=1)
            total, every = total + len(batch), every + len(starts)
            h, n = np.unique(pair[1], return_counts=True)
            found.append((h.view(np.int64), n))
        if found:
            h, n = (np.concatenate(x) for x in zip(*found, strict=True))
            h, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, n, minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([None, *h.tolist()], pa.int64()), pa.array([total, *n.tolist()], pa.int64()), pa.array([every, *[0] * len(h)], pa.int64())], names=["h", "n", "every"])

    counts = cut(own.mapInArrow(count, "h long, n long, every long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("every").alias("every")))
    texts, every = counts.where("h is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0))).first()
    per_kind = scanned.select(F.explode(F.array_distinct(F.transform("base", lambda b: b["kind"]))).alias("kind")).groupBy("kind").count()
    content = {r["kind"]: -np.log2(r["count"] / texts) for r in per_kind.collect() if r["count"] < texts}
    if not content:
        return candidates.select("h", "kind").limit(0)
    ic = F.create_map(*[x for k, v in content.items() for x in (F.lit(k), F.lit(float(v)))])
    pairs = {r["kind"]: (r["tests"], r["joint"]) for r in near.groupBy("kind").agg(F.count("*").alias("tests"), F.sum("joint").alias("joint")).collect()}
    tests = sum(n for n, _ in pairs.values())
    chance = F.create_map(*[x for k, (_, n) in pairs.items() for x in (F.lit(k), F.lit(min(1.0, n / every)))])
    scored = candidates.join(counts.where("h is not null").select("h", "n"), "h").withColumn("ic", ic[F.col("kind")]).withColumn("chance", chance[F.col("kind")])
    scored = scored.withColumn("disclosure", 1 + F.log2(F.least(F.lit(1.0), F.col("joint") / F.col("n"))) / F.col("ic"))
    share = F.least(F.lit(1.0), F.col("joint") / F.col("n"))
    more = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - F.col("chance")))).otherwise(0.0)
    surprise = F.when(share > F.col("chance"), F.col("n") * (share * F.log(share / F.col("chance")) + more)).otherwise(0.0)
    best = F.max_by("kind", F.struct("disclosure", "joint", "kind"))
    return scored.where((F.col("disclosure") >= threshold) & (surprise >= float(np.log(tests / alpha)))).groupBy("h").agg(best.alias("kind"))


def _term_spans(own: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end) of the words that disclose; row tells rows of one id apart by their text."""
    table = own.sparkSession.sparkContext.broadcast(_bit_map(terms))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in w.per_batch(batches):
            data, offsets = w.buffers(batch.column(1))
            starts, ends, hashes = w.words(data, offsets, lower=True)
            at = np.flatnonzero(_passing(hashes, table.value))
            if not len(at):
                continue
            points = w.code_points(data)
            owner = np.searchsorted(offsets, starts[at], "right") - 1
            zero = points[offsets[owner]]
            rows = batch.column(2).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), rows, pa.array(hashes[at].view(np.int64)), pa.array(points[starts[at]] - zero), pa.array(points[ends[at]] - zero)],
                names=["doc_id", "row", "h", "start", "end"],
            )

    return own.mapInArrow(find, "doc_id long, row long, h long, start long, end long").distinct().join(terms, "h").select("doc_id", "row", "kind", "start", "end")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, base, terms, text) for each row: the spans by rule, those of disclosing terms outside them, and the text without both.

    Null texts count as empty and have none; they stay null.  Rows equal in id and text have equal spans, each row its
    own.  An empty table gives an empty result.  Extra columns are ignored.
    """
    own = id_text(docs, id_col, text_col)
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    scanned = cut(own.mapInArrow(_scan, f"doc_id long, row long, base {SPANS}, near array<struct<kind:string,h:long>>"))
    terms = cut(disclosing_terms(own, scanned))
    if terms.isEmpty():
        rows = own.withColumn("terms", F.expr(f"cast(array() as {SPANS})"))
    else:
        spans = F.sort_array(F.collect_list(F.struct("start", "end", "kind")))
        found = _term_spans(own, terms).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(spans.alias("terms"))
        rows = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "text", "row", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda of: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in of], span)
        for batch in w.per_batch(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t or "") for t in texts]
            more = [
                sorted(((f"term_{t['kind']}", t["start"], t["end"]) for t in ts or () if not any(t["start"] < b and a < t["end"] for _, a, b in own_)), key=_listed)
                for ts, own_ in zip(batch.column(3).to_pylist(), base, strict=True)
            ]
            clean = [t and sanitise_text(t, [*b, *m]) for t, b, m in zip(texts, base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), as_rows(base), as_rows(more), pa.array(clean, pa.string())], names=["doc_id", "row", "base", "terms", "text"])

    return rows.mapInArrow(run, f"doc_id long, row long, base {SPANS}, terms {SPANS}, text string")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, base, terms) of ``sanitise``."""
    return sanitise(docs, id_col, text_col).drop("text")


def _listed(span: Span) -> tuple[int, int, int]:
    """By kind as listed, then by place."""
    return KINDS.index(span[0].removeprefix("term_")), span[1], span[2]


def sanitise_text(text: str, spans: list[Span]) -> str:
    """``text`` with base spans replaced by their kind in brackets and term spans generalised or removed.

    A term next to an entity (only white space between) goes with it; elsewhere it becomes its kind in angle brackets.
    """
    out, at, previous = [], 0, None
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:  # nothing of a span stays that another one overlaps
            at = max(at, b)
            continue
        between = text[at:a]
        out.append(between)
        if kind.startswith("term_"):
            out.append("" if previous is not None and not between.strip() else f"<{kind[5:]}>")
        else:
            out.append(f"[{kind}]")
        at, previous = b, kind
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text and the sanitised text, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, base, terms, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                joined = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
                more = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in terms)
                n = [sum(s["kind"] == k for s in base) for k in KINDS]
                rows.append((doc, *n, hashlib.sha256(joined.encode()).hexdigest(), ",".join(x for x in (joined, more) if x), text))
            if rows:
                kinds = (*[pa.int64()] * 5, *[pa.string()] * 3)
                names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "sanitised"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return sanitise(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, sanitised string")
