"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

The lines of all documents are compared.  Of equal lines the first occurrence counts, by document id and then by place.
A line goes if an earlier line (by first occurrences) is within as many edits of it as the shorter of the two allows:
TAU, one below LONG code points, none below LEAST, which are told apart by any edit.  So does every later occurrence of
a line.  Lines without a word stay.  Lines are known by a 64-bit hash and their length.

The join: each distinct line is split into one more even segment than the edits it allows.  Of a line within so many
edits at least one segment stands unchanged in the other line, near its own place; the places are those of the multi-match-aware bounds, by length
and segment.  Segments of all lines are the index, by hashes of length, number and text; substrings are probed against
it, after a filter of the index (of fixed size) has let them through.  Lines that share a key are paired if their counts of
characters, in eight classes, differ by no more than TAU edits can make.  Pairs are freed of the ends that they
share, and the rest is verified by a banded bit-parallel automaton: a bit for each of the 2 TAU + 1 diagonals, a group
of bits for each number of edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, release

TAU = 2
LONG = 24
LEAST = 8
#: Words of the filter of the index, of 64 bits each, and bits for a key: a table of so many rows at most, 16 MB, goes to
#: every task.
FILTER_WORDS = 1 << 20
KEY_BITS = 5
#: Fixed classes of characters, by code points modulo 8.
CLASSES = 8
_WORD = "[^\\x20\\x09-\\x0D]"
_PLACES = 1 << 31


def _segments(length: str, tau: int) -> list[tuple[str, str]]:
    """SQL for (start from 1, length) of the even segments of a line of the given length; the last ones are longer."""
    n, out = tau + 1, []
    for i in range(n):
        start = f"({length} div {n} * {i} + greatest(0, {i} - {n} + {length} % {n}) + 1)"
        out.append((start, f"({length} div {n} + if({i} >= {n} - {length} % {n}, 1, 0))"))
    return out


def _keys(tau: int) -> tuple[list[str], list[str]]:
    """SQL for the keys of a line's own segments, and for those of the substrings that are probed besides them.

    The partner, as long or shorter by up to ``tau``, is split by the edits that its own length allows; a key is null
    where a partner of that length allows none.
    """

    def of(edits: int) -> tuple[dict, dict]:
        own, probes = {}, {}
        for shift in range(edits + 1):
            length = f"(n - {shift})"
            for i, (start, size) in enumerate(_segments(length, edits), 1):
                left, right = i - 1, edits + 1 - i
                for move in range(max(-left, shift - right), min(left, shift + right) + 1):
                    key = f"xxhash64({i}, {length}, substring(code, cast(4 * ({start} + {move}) - 3 as int), cast(4 * {size} as int)))"
                    (own if shift == 0 and move == 0 else probes).setdefault(shift, []).append(key)
        return own, probes

    (own, probes), (own1, probes1) = of(tau), of(min(1, tau))

    def either(long: dict, short: dict) -> list[str]:
        out = []
        for shift in range(tau + 1):
            a, b = long.get(shift, []), short.get(shift, [])
            for k in range(max(len(a), len(b))):
                x, y = (v[k] if k < len(v) else "cast(null as bigint)" for v in (a, b))
                out.append(f"case when n - {shift} >= {LONG} then {x} when n - {shift} >= {LEAST} then {y} end")
        return out

    return either(own, own1), either(probes, probes1)


def _let(value: str, name: str, body: str) -> str:
    """SQL with ``value`` computed once and named in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _shared_end(x: str, y: str, most: str, tail: bool) -> str:
    """SQL for the number of code points, ``most`` or fewer, that x and y both begin (or end) with, by halving steps."""
    if tail:
        same = f"substring({x}, length({x}) - n - k + 1, k) = substring({y}, length({y}) - n - k + 1, k)"
    else:
        same = f"substring({x}, n + 1, k) = substring({y}, n + 1, k)"
    steps = f"transform(sequence(0, 30), b -> shiftleft(1, 30 - b))"
    return f"aggregate({steps}, 0, (n, k) -> if(k <= {most} - n and {same}, n + k, n))"


def within_edits(x: str, y: str, tau: int = TAU, allowed: str | None = None) -> Column:
    """True where the strings in columns ``x`` and ``y``, whose lengths differ by ``tau`` at most, are within ``tau`` edits.

    ``allowed`` is SQL for a number of edits of each pair, ``tau`` or fewer.

    What both begin and end with is cut off.  Over the rest of y runs an automaton: bit d of group e says that some
    alignment that ends on diagonal d - tau has cost e edits or fewer.  A character lets bits on matching diagonals
    live; an edit takes a bit of the group below to its own diagonal (substitution), to the one before (a character of
    y too many) or to the one after (one of x too many, within the same step).
    """
    width = 2 * tau + 2  # a spare bit parts the groups
    band = (1 << (2 * tau + 1)) - 1
    every = sum(band << (e * width) for e in range(tau + 1))
    first = sum(sum(1 << (tau + d) for d in range(e + 1)) << (e * width) for e in range(tau + 1))
    ones = sum(1 << (e * width) for e in range(tau + 1))
    match = " | ".join(f"if(get(v.a, i + {d - tau}) <=> c, {1 << d}L, 0L)" for d in range(2 * tau + 1))
    step = f"((s & (({match}) * {ones}L)) | shiftleft((s | shiftright(s, 1)) & {every}L, {width})) & {every}L"
    for e in range(tau):
        step = _let(step, f"n{e}", f"(n{e} | shiftleft(n{e} & {band << (e * width)}L, {width + 1})) & {every}L")
    run = f"aggregate(v.b, named_struct('s', {first}L, 'i', 0), (z, c) -> {_let('z', 'q', 'named_struct(' + repr('s') + ', ' + step.replace('(s ', '(q.s ').replace('(s,', '(q.s,').replace(' i +', ' q.i +') + ', ' + repr('i') + ', q.i + 1)')}, z -> z.s)"
    accept = f"(shiftright({run}, {allowed or tau} * {width} + size(v.a) - size(v.b) + {tau}) & 1) = 1"
    chars = "regexp_extract_all({}, '(?s).', 0)"
    core = f"named_struct('a', {chars.format('t.x')}, 'b', {chars.format('t.y')})"
    inner = _let(core, "v", accept)
    cut_tail = _let(
        _shared_end("p.x", "p.y", "least(length(p.x), length(p.y))", True), "m",
        "named_struct('x', substring(p.x, 1, length(p.x) - m), 'y', substring(p.y, 1, length(p.y) - m))",
    )
    cut_head = _let(
        _shared_end(x, y, f"least(length({x}), length({y}))", False), "m0",
        f"named_struct('x', substring({x}, m0 + 1), 'y', substring({y}, m0 + 1))",
    )
    return F.expr(_let(cut_head, "p", _let(cut_tail, "t", inner)))


def _passing(df: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the only column of ``of``, by a blocked Bloom filter of fixed size."""
    at = lambda c: f"pmod({c}, {FILTER_WORDS})"
    bit = lambda c, k: f"shiftleft(1L, cast(shiftrightunsigned({c}, {20 + 6 * k}) & 63 as int))"
    mask = lambda c: " | ".join(bit(c, k) for k in range(KEY_BITS))
    name = of.columns[0]
    words = of.selectExpr(f"{at(name)} as __at", f"{mask(name)} as __bit").groupBy("__at").agg(F.bit_or("__bit").alias("__bits"))
    # the condition is part of the join, so that rows that fail it are never made
    found = df.withColumn("__key_at", F.expr(at(key))).withColumn("__mask", F.expr(mask(key)))
    return found.join(F.broadcast(words), F.expr("__key_at = __at and (__bits & __mask) = __mask")).drop("__at", "__bits", "__key_at", "__mask")


def _char_counts(line: str) -> str:
    """SQL for the counts of a line's characters by class, 8 bits each, no more than 127; edits make no greater difference."""
    return (
        f"aggregate(transform(regexp_extract_all({line}, '(?s).', 0), c -> pmod(ascii(c), {CLASSES}) * 8), 0L, "
        f"(s, k) -> if((shiftrightunsigned(s, k) & 255) = 127, s, s + shiftleft(1L, k)))"
    )


def _class_difference(a: str, b: str) -> str:
    """SQL for the sum of the differences of two packed counts."""
    lane = lambda c, k: f"(shiftrightunsigned({c}, {8 * k}) & 255)"
    return " + ".join(f"abs({lane(a, k)} - {lane(b, k)})" for k in range(CLASSES))


def _lines(docs: DataFrame, id_col: str, text_col: str, narrow: bool) -> DataFrame:
    """(occ, line, h, n): each line that has a word; occ orders by document and place, as a decimal where ids need it."""
    ident = F.coalesce(column(docs, id_col).cast("long"), F.lit(-(1 << 63)))
    if narrow:
        occ = F.col("doc") * F.lit(_PLACES) + F.col("pos")
    else:
        occ = (F.col("doc").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)")).cast("decimal(32,0)")
    return (
        docs.select(ident.alias("doc"), F.posexplode(F.split(column(docs, text_col), "\n", -1)).alias("pos", "line"))
        .where(F.col("line").rlike(_WORD))
        .select(occ.alias("occ"), "line", F.xxhash64("line").alias("h"), F.length("line").alias("n"))
    )


def _narrow(docs: DataFrame, id_col: str) -> bool:
    """Whether all ids are within 0 and 2**32, so that a document and a place in it fit into one 64-bit number."""
    ident = column(docs, id_col).cast("long")
    low, high, nulls = docs.agg(F.min(ident), F.max(ident), F.count_if(ident.isNull())).first()
    return not nulls and (low is None or (low >= 0 and high < 1 << 32))


def surviving_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(h, occ): the distinct lines that stay, with their first occurrence."""
    lines = _lines(docs, id_col, text_col, _narrow(docs, id_col))
    own, probes = _keys(tau)
    # code points of four bytes each, so that a substring is found without a walk along the line
    coded = lines.withColumn("code", F.when(F.col("n") >= LEAST, F.encode("line", "UTF-32")))
    keyed = coded.select("h", "n", "occ", *[F.when(F.col("code").isNotNull(), F.expr(k)).alias(f"k{i}") for i, k in enumerate(own + probes)])
    names = [f"k{i}" for i in range(len(own + probes))]
    distinct = cut(keyed.groupBy("h", "n").agg(F.min("occ").alias("occ"), *[F.max(c).alias(c) for c in names]))
    del coded, keyed
    release(docs.sparkSession)  # the keys' shuffle files, before those of the next steps are made
    long = distinct.where(F.col("n") >= LEAST)
    index = long.select("h", F.explode(F.array(*names[: len(own)])).alias("key"), F.lit(True).alias("own"))
    probe = long.select("h", F.explode(F.array(*names[len(own) :])).alias("key"), F.lit(False).alias("own"))
    rows = index.unionByName(_passing(probe, "key", index.select("key"))).where("key is not null")
    shared = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.bool_or("own").alias("any")).where("a <> b and any").select("key")
    # few keys are shared; a filter of them keeps the other rows from being moved once more
    shared = cut(shared)
    release(docs.sparkSession)
    matched = cut(_passing(rows, "key", shared).join(shared, "key", "left_semi"))
    del rows, index, probe, shared
    release(docs.sparkSession)
    ids = matched.select("h").distinct()
    firsts = ids.join(distinct.select("h", "occ"), "h")
    texts = _passing(lines.select("h", "occ", "line"), "h", ids).join(firsts, ["h", "occ"]).dropDuplicates(["h"])
    texts = cut(texts.select("h", "occ", "line", F.length("line").alias("n"), F.expr(_char_counts("line")).alias("sig")))
    sized = matched.join(texts.select("h", "n", "sig"), "h")
    left, right = (sized.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("h", "n", "sig", "own")]) for s in "ab")
    allowed = f"if(least(n_a, n_b) < {LONG}, {min(1, tau)}, {tau})"
    near = f"own_a and h_a <> h_b and (h_a < h_b or not own_b) and abs(n_a - n_b) <= {allowed} and {_class_difference('sig_a', 'sig_b')} <= 2 * {allowed}"
    pairs = left.where("own_a").join(right, "key").where(near).select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b")).distinct()
    side = lambda s: texts.select(F.col("h").alias(s), F.col("occ").alias(f"occ_{s}"), F.col("line").alias(f"line_{s}"), F.col("n").alias(f"n_{s}"))
    close = within_edits("line_a", "line_b", tau, allowed)
    gone = (
        pairs.join(side("a"), "a").join(side("b"), "b").where(close)
        .select(F.when(F.col("occ_a") < F.col("occ_b"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct()
    )
    return distinct.select("h", "occ").join(gone, "h", "left_anti")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """``docs`` with the text freed of repeated lines and n_chars, if there, set anew; also __n_lines and __n_kept.

    Null texts stay null, with no lines; a text of no words stays as it is.  Rows that share an id are one document: a
    line that stands at the same place in several of them is one occurrence.  An empty table gives an empty result.
    Other columns are left as they are.
    """
    kept = (
        surviving_lines(docs, id_col, text_col, tau)
        .withColumn("__pos", F.expr(f"pmod(occ, {_PLACES}L)"))
        .select(F.expr(f"(occ - __pos) div {_PLACES}L").cast("long").alias("__doc"), F.struct(F.col("__pos").cast("int").alias("pos"), "h").alias("k"))
        .groupBy("__doc").agg(F.collect_list("k").alias("__kept"))
    )
    ident = F.coalesce(column(docs, id_col).cast("long"), F.lit(-(1 << 63)))
    # the document goes along as one value, so that none of its columns' names can clash
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("d"), ident.alias("i"))
    rows = rows.join(kept, F.col("i") == F.col("__doc"), "left")
    lines = F.split(F.col(f"d.`{text_col}`"), "\n", -1).alias("lines")  # only now, so that the text is moved once
    rows = rows.select("d", F.struct(lines, F.coalesce("__kept", F.expr("cast(array() as array<struct<pos:int,h:bigint>>)")).alias("kept")).alias("v"))
    blank = f"filter(transform(v.lines, (x, i) -> if(x rlike '{_WORD.replace(chr(92), chr(92) * 2)}', null, i)), i -> i is not null)"
    own = "transform(filter(v.kept, k -> xxhash64(get(v.lines, k.pos)) = k.h), k -> k.pos)"
    stay = _let("v", "v", f"named_struct('lines', v.lines, 'at', array_sort(concat({own}, {blank})))")
    rows = rows.select("d", F.when(F.col("v.lines").isNotNull(), F.expr(stay)).alias("s"))
    text = F.expr(_let("s", "s", "array_join(transform(s.at, i -> get(s.lines, i)), '\\n')"))
    rows = rows.select("d", F.when(F.col("s").isNotNull(), text).alias("t"), F.coalesce(F.size("s.lines"), F.lit(0)).alias("n"), F.coalesce(F.size("s.at"), F.lit(0)).alias("m"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("t").alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length("t").cast(docs.schema[c].dataType), F.col("d.`n_chars`")).alias(c))
        else:
            out.append(F.col(f"d.`{c}`").alias(c))
    return rows.select(*out, F.col("n").alias("__n_lines"), F.col("m").alias("__n_kept"))
