"""Centroid clustering, conversation repair and benchmark decontamination against plain versions and on odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontam, exponion, queries, repair

from .. import oracle

SF = oracle.SF


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_conversation_repair", "op13_benchmark_decontamination"])
def test_query_equals_its_sql(spark, name):
    oracle.same(spark, oracle.connect(), queries.QUERIES[name], queries.ORACLES[name])


# -- clustering --------------------------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, size, scale):
    """(id, cluster, distance, its inertia, inertia, digest) with Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    by_hash = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()), r[1]))
    cs = [v for _, v in by_hash[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [near(v) for _, v in kept]
    inertia = [sum(d for d, j in found if j == c) for c in range(len(cs))]
    cap = lambda x: min(x, (1 << 63) - 1)
    return [(i, j, cap(d), cap(inertia[j]), cap(sum(inertia)), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found, strict=True)]


def clusters(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(7).alias(n) for n in ("v", "cluster", "upper", "distance", "x")])
    return [tuple(r) for r in exponion.cluster(df, **more).collect()]


@pytest.mark.parametrize("size, step, big", [(2, 1.0, 1.0), (3, 0.5, 1.0), (8, 0.01, 1.0), (2, 1.0, 2.0**40), (2, 1.0, 1e300)])
def test_clusters_equal_the_plain_version_with_ties_copies_and_odd_rows(spark, size, step, big):
    rng = random.Random(size)
    rows = [(i, [round(rng.randrange(-4, 5) * step, 3) * (big if rng.random() < 0.3 else 1.0) for _ in range(size)]) for i in range(300)]
    rows += rows[:9] + [(None, [step] * size), (None, [2 * step] * size), (901, None), (902, [1.0]), (903, [None] * size), (904, [math.nan] * size), (905, [math.inf] * size), (906, [])]
    got = clusters(spark, rows, size=size, k=7)
    if big < 1e300:
        assert sorted(got, key=repr) == sorted(plain_clusters(rows, 7, 3, size, 64), key=repr)
    else:  # held within 2**62
        assert len(got) == 311


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(5, [1.0, 2.0]), (6, [1.0, 2.0]), (7, [9.0, 9.0])]
    assert sorted(clusters(spark, rows, size=2)) == sorted(plain_clusters(rows, 16, 3, 2, 64))
    assert clusters(spark, rows[:1], size=2)[0][:3] == (5, 0, 0)
    assert clusters(spark, rows, size=3) == []


def test_the_search_compares_fewer_pairs_than_there_are():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-500, 500, (40, 8))
    x = centroids[rng.integers(0, 40, 2000)] + rng.integers(-30, 30, (2000, 8))
    search = exponion.Search(centroids.astype(object), np.zeros(40))
    at, upper, lower = search.assign(x, np.zeros(2000, np.int32), np.full(2000, np.inf), np.zeros(2000))
    search.compared = 0
    again, _, _ = search.assign(x, at, upper, lower)
    assert (again == at).all() and search.compared < 2000 * 40 / 4
    assert (at == ((x[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1)).all()


# -- repair ------------------------------------------------------------------------------------------------------------


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text), ("user" if k == 4 else role)
        yield from [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest of one conversation's rows, trying every edit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    wrong = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    best = {"": (0, "", ())}  # by the last legal initial: the least (cost, audit, lines)

    def better(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found

    def inserted(states):
        for _ in range(2):
            for state, (cost, audit, lines) in list(states.items()):
                role = "assistant" if state == "u" else "user"
                better(states, role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return states

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, lines) in inserted(best).items():
            better(after, state, (cost + 2, audit + "D", lines))
            if fault in ("b", "d"):
                continue
            more = 5 * (fault == "t")
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in legal:
                better(after, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            new = "assistant" if state == "u" else "user"
            better(after, new[0], (cost + 1 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    cost, audit, lines = min(v for k, v in inserted(best).items() if k in ("", "a"))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def conversation_rows(seed, n, length):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, length)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Über", "ad"])
            text = rng.choice(["Yes.", "No!", "what", "", " \n", None, "Why? ", "a.b", "ok.　", "done.\n\t", f"t{turn}."])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3, turn + 2]), role, text))
    return rows + rows[:5]


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).select("*", *[F.lit(1).alias(n) for n in ("c", "at", "block", "kind", "salt", "times", "col")])
    return sorted((tuple(r) for r in repair.damage_and_repair(df).collect()), key=repr)


def plain(rows):
    damaged = list(plain_damage(rows))
    return sorted(((c, *plain_repair([r for r in damaged if r[0] == c])) for c in {r[0] for r in rows}), key=repr)


@pytest.mark.parametrize("bits", [0, 1, 3, 12])
def test_repair_equals_the_plain_version_in_blocks_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = conversation_rows(bits, 120, 12)
    assert repaired(spark, rows) == plain(rows)


def test_a_long_conversation_lies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 5)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"{t}.", f"{t}!", "no"])) for t in range(3000)] + [(2, 0, "user", "x." * 200_000), (2, 1, "assistant", "y.")]
    assert repaired(spark, rows) == plain(rows)


def test_one_row_that_comes_thousands_of_times(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BITS", 6)
    rows = [(4, 2, "user", "Hello.")] * 2000 + [(4, 3, "assistant", "Hi.")]
    assert repaired(spark, rows) == plain(rows)


def test_repair_of_no_rows_and_of_extreme_turns(spark):
    assert repaired(spark, [(0, -(1 << 63), "user", "a."), (0, (1 << 63) - 1, "assistant", "b.")])[0][1] == (1 << 63) - 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damage_and_repair(empty).collect() == []
    dropped = next((c, t) for c in range(999) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert repaired(spark, [(*dropped, "user", "a.")]) == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_distances_agree_with_every_order_of_relaxing():
    rng = random.Random(3)
    for _ in range(200):
        codes = [4 * rng.randrange(4) + rng.randrange(4) for _ in range(rng.randrange(1, 7))]
        out = [rng.choice([0, 3, 9, repair.INFINITE]) for _ in range(3)] + [1]
        n, dist = len(codes), repair.distances(codes, out)
        slow = [repair.INFINITE] * (4 * n) + out
        for _ in range(6 * n + 6):
            for node in reversed(range(4 * n)):
                pos, s = divmod(node, 4)
                fault, role = divmod(codes[pos], 4)
                ways = [5 + slow[4 * pos + repair.NEXT[s]], 2 + slow[node + 4]]
                if fault in (0, 3):
                    ways.append(1 + 5 * (fault == 3) + slow[4 * pos + 4 + repair.NEXT[s]])
                    if role and s in repair.FOLLOWS[role]:
                        ways.append(5 * (fault == 3) + slow[4 * pos + 4 + role])
                slow[node] = min(slow[node], *ways)
        assert [min(x, repair.INFINITE) for x in dist] == [min(x, repair.INFINITE) for x in slow]


# -- decontamination ---------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_found(docs, bench, width=10):
    wins = {}
    for item, text in bench:
        ws = WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            wins.setdefault(tuple(ws[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        low = (text or "").translate(LOW)
        places = [m.span() for m in WORD.finditer(low)]
        ws, hit, items = [low[a:b] for a, b in places], set(), set()
        for size in range(1, width + 1):
            for i in range(len(ws) - size + 1):
                if (own := wins.get(tuple(ws[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    items |= own
        spans = []
        for i in sorted(hit):
            if i - 1 in hit:
                spans[-1] = (spans[-1][0], places[i][1])
            else:
                spans.append(places[i])
        out.append((doc, len(ws), len(hit), spans, sorted(str(i) for i in items if i is not None), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [*"abcdefgh", "Über", "naïve", "😀x", "x1", "İ", "ABC"]
    said = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    bench = [(i, said(rng.choice([1, 3, 9, 10, 11, 14, 40]) + (5 if i % 7 == 0 else 0))) for i in range(25)]
    bench += [(90, None), (91, ""), (92, "..."), (None, said(12)), (3, said(11)), (93, bench[3][1]), (94, bench[3][1].upper() + " tail")]
    docs = []
    for i in range(80):
        b = rng.choice(bench)[1] or ""
        docs.append((i, "é" * (i % 3) + " " + said(rng.randrange(0, 30)) + b[: rng.randrange(0, len(b) + 1)] + " " + said(4)))
    bench = [b for b in bench if len(WORD.findall((b[1] or ""))) != 1 or b[0] % 2]
    docs += [(100, None), (101, ""), (102, " .\n"), (None, docs[4][1]), docs[5], docs[5], (103, said(3000) + bench[1][1] * 50)]
    return docs, bench


def found(spark, docs, bench, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("key", "hits", "items", "n_words", "window")])
    b = spark.createDataFrame(bench, "item_id long, text string").select("*", *[F.lit(1).alias(n) for n in ("item", "window", "w", "shard")])
    out = decontam.find(d, b, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], [tuple(s) for s in r["spans"]], list(r["items"]), r["contaminated"]) for r in out), key=repr)


@pytest.mark.parametrize("more", [{}, {"pairs_a_shard": 60}, {"width": 3}])
def test_windows_equal_the_plain_version_in_one_shard_and_in_many(spark, more):
    docs, bench = corpus()
    if more.get("pairs_a_shard"):
        assert decontam.windows(spark.createDataFrame(bench, "item_id long, text string")).count() > 200
    assert found(spark, docs, bench, **more) == plain_found(docs, bench, more.get("width", 10))


def test_empty_tables_and_items_without_words(spark):
    docs, bench = corpus()
    assert found(spark, docs, [(1, None), (2, "--")]) == plain_found(docs, [])
    assert found(spark, docs, []) == plain_found(docs, [])
    assert found(spark, [], bench) == []


def test_stretches_are_cut_out_and_other_columns_stay(spark):
    docs, bench = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").select("text", F.lit("x").alias("a.b"), "doc_id", F.lit(1).alias("digest"), F.lit(2).alias("spans"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.without_spans(d, b)
    assert got.columns == d.columns and got.dtypes == d.dtypes
    want = []
    for doc, text in docs:
        for a, z in reversed(plain_found([(doc, text)], bench)[0][3]):
            text = text[:a] + text[z:]
        want.append((doc, text))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
