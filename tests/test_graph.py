"""Components and cycles against plain search."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph

pytestmark = pytest.mark.usefixtures("few_partitions")


def reach(pairs):
    after, out = {}, {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for m in after.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def plain(pairs):
    r = reach(pairs)
    comp = {n: min(m for m in r[n] if n in r[m]) for n in r if n in r[n]}
    on = sorted({(a, b) for a, b in pairs if a in r[b]})
    cycles = []
    for c in set(comp.values()):
        own = {n for n in comp if comp[n] == c}
        inside = {(a, b) for a, b in pairs if a in own and b in own}
        far = {c: 0}
        while True:
            more = {b: far[a] + 1 for a, b in inside if a in far and b not in far}
            if not more:
                break
            far |= {b: min(far[a] + 1 for a, x in inside if x == b and a in far) for b in more}
        last = min((far[a], a) for a, b in inside if b == c)[1]
        path = [last]
        while path[0] != c:
            path.insert(0, min(a for a, b in inside if b == path[0] and far[a] == far[path[0]] - 1))
        cycles.append((c, len(own), path))
    return on, sorted(cycles), sorted((n, c) for n, c in comp.items() if sum(x == c for x in comp.values()) > 1)


BRIDGES = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (5, 5), (6, 7), (0, 1)]
CHAIN = [(i, i + 1) for i in range(9)] + [(9, 0), (3, 1), (8, 6)]


@pytest.mark.parametrize("pairs", [BRIDGES, CHAIN])
def test_components_cycles_and_their_edges(spark, pairs):
    e = spark.createDataFrame(pairs * 2, "s int, t int")
    on, cycles, comps = plain(set(pairs))
    assert sorted(map(tuple, graph.in_cycles(e, "s", "t").collect())) == on
    assert sorted((r["component"], r["size"], r["cycle"]) for r in graph.component_cycles(e, "s", "t").collect()) == cycles
    assert sorted(map(tuple, graph.components(e, "s", "t").collect())) == comps


def test_a_bridge_between_cycles_lies_on_none(spark):
    assert (2, 3) not in [tuple(r) for r in graph.in_cycles(spark.createDataFrame(BRIDGES, "s int, t int"), "s", "t").collect()]


def test_cycles_of_several_repositories(spark):
    rows = [("x", "b", "c"), ("x", "c", "b"), ("y", "b", "c"), ("y", "c", "a"), ("y", "a", "b"), (None, "q", "q"), ("z", "n", None)]
    got = graph.cycles(spark.createDataFrame(rows, "repo string, s string, t string"), "repo", "s", "t").orderBy("repo").collect()
    assert [(r["repo"], r["component"], r["size"], r["cycle"]) for r in got] == [("x", "b", 2, ["b", "c"]), ("y", "a", 3, ["a", "b", "c"])]
    assert graph.cycles(spark.createDataFrame([], "repo string, s string, t string"), "repo", "s", "t").select(F.count("*")).first()[0] == 0
