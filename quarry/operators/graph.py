"""Dependency graphs: resolution of imports, degrees, cycles, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths

#: Suffixes tried in this order, the path as it is first.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".py", ".go", ".java", ".rb", ".php", ".rs", ".kt", ".cs", ".json"]


_FILES, _INDEX = [s for s in SUFFIXES if s], [*[f"index{s}" for s in SUFFIXES if s], "__init__.py"]


def import_bases(folder: Column, spec: Column) -> Column:
    """What an import from a file in ``folder`` may mean, without suffixes, in order."""
    relative = F.startswith(spec, F.lit("."))
    rooted = spec.rlike("^(?:/|src/|@/)")
    bare = F.regexp_replace(F.regexp_replace(spec, "^@", ""), "^/+", "")
    dotted = F.replace(spec, F.lit("."), F.lit("/"))
    return F.when(relative, F.array(paths.join(folder, spec))).when(rooted, F.array(bare, F.concat(F.lit("src/"), bare))).otherwise(F.array(dotted))


def import_candidates(importer: Column, spec: Column) -> Column:
    """Paths that an import may mean, in order."""
    tails = F.array(*[F.lit(s) for s in ["", *_FILES, *[f"/{s}" for s in _INDEX]]])
    return F.flatten(F.transform(import_bases(paths.dirname(importer), spec), lambda b: F.transform(tails, lambda t: paths.normalise(F.concat(b, t)))))


def _stems(base: Column) -> Column:
    """(kind, stem) of a base: with nothing behind it, before a suffix (in place of which stands a mark) and before a file of the folder."""
    return F.array(*[F.struct(F.lit(kind).alias("kind"), paths.normalise(F.concat(base, F.lit(mark))).alias("stem")) for kind, mark in enumerate(["", "\u0001", "/\u0001"])])


def _file_stems(path: Column) -> Column:
    """(kind, stem, at) of a path: the stems to which it is a candidate, and its place among a base's candidates."""
    cut_off = lambda tail: F.concat(path.substr(F.lit(1), F.length(path) - len(tail)), F.lit("\u0001"))
    of = lambda kind, stem, at: F.struct(F.lit(kind).alias("kind"), stem.alias("stem"), F.lit(at).alias("at"))
    files = [F.when(F.endswith(path, F.lit(s)), of(1, cut_off(s), i)) for i, s in enumerate(_FILES, 1)]
    index = [F.when((path == s) | F.endswith(path, F.lit(f"/{s}")), of(2, cut_off(s), i)) for i, s in enumerate(_INDEX, 1 + len(_FILES))]
    return F.filter(F.array(of(0, path, 0), *files, *index), lambda x: x.isNotNull())


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (path, specifier) with to_path, the first candidate that is a file, and whether they are external.

    What an import means depends on its folder only, so each folder's specifiers are looked up once.  They meet files by
    stems, three for a base instead of a row for each suffix.
    """
    from quarry.sources.checkpoints import cut

    own = cut(imports.select("path", "specifier").distinct().withColumn("folder", paths.dirname(F.col("path"))))
    asked = own.select("folder", "specifier").distinct().select("folder", "specifier", F.posexplode(import_bases(F.col("folder"), F.col("specifier"))).alias("base", "b"))
    asked = asked.select("folder", "specifier", "base", F.inline(_stems(F.col("b"))))
    there = files.select(F.col("path").alias("p")).distinct().select("p", F.inline(_file_stems(F.col("p"))))
    hit = asked.hint("merge").join(there.hint("merge"), ["kind", "stem"]).groupBy("folder", "specifier").agg(F.min_by("p", F.struct("base", "at")).alias("to_path"))
    done = own.hint("merge").join(hit.hint("merge"), ["folder", "specifier"], "left")
    return done.select("path", "specifier", "to_path", F.col("to_path").isNull().alias("is_external"))


def external_packages(edges: DataFrame, most: int = 60) -> DataFrame:
    """(package, n) of external imports."""
    out = edges.where("is_external and not startswith(specifier, '.')")
    return out.groupBy(paths.package_root(F.col("specifier")).alias("package")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "package").limit(most)


def reachable(edges: DataFrame, src: str, dst: str, roots: DataFrame, root: str) -> DataFrame:
    """(node): what can be reached from the roots; breadth first, each round a join, lineage cut by checkpoints."""
    from quarry.sources.checkpoints import cut

    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    seen = cut(roots.select(F.col(root).alias("node")).distinct())
    new = seen
    while True:
        new = cut(e.join(new, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            return seen
        seen = cut(seen.unionByName(new))


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) of the nodes on cycles of two or more: strongly connected components, named by their least node.

    Forward and backward colouring.  Nodes without a way in or out are trimmed off; then every node takes the least node
    that reaches it as its colour, and of a colour's nodes those that reach the colour itself are a component.  What is
    left goes on within its colours.  Each round is a join and a grouping of the edges, of those nodes only whose colour
    changed, with lineage cut by a checkpoint; no component, however large, comes together in a task.
    """
    from quarry.sources.checkpoints import cut

    e = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct())
    found = None
    while True:
        n = e.count()
        while n:  # trim
            ins, outs = e.select(F.col("b").alias("a")).distinct(), e.select(F.col("a").alias("b")).distinct()
            e = cut(e.join(ins, "a", "left_semi").join(outs, "b", "left_semi").select("a", "b"))
            before, n = n, e.count()
            if n == before:
                break
        if not n:
            break
        # what leaves a node is trimmed to what enters one, so every node is at an edge's start
        colours = cut(e.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        changed = colours
        while True:
            told = e.join(changed, F.col("a") == F.col("node")).groupBy("b").agg(F.min("colour").alias("told"))
            both = cut(colours.join(told, F.col("node") == F.col("b"), "left").select("node", "colour", "told"))
            lower = F.col("told") < F.col("colour")
            changed = both.where(lower).select("node", F.col("told").alias("colour"))
            if changed.isEmpty():
                break
            colours = both.select("node", F.when(lower, F.col("told")).otherwise(F.col("colour")).alias("colour"))
        a, b = colours.select(F.col("node").alias("a"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("b"), F.col("colour").alias("cb"))
        e = cut(e.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")))
        reached = cut(colours.where("node = colour"))
        new = reached
        while True:
            step = e.join(new.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node"), "colour").distinct()
            new = cut(step.join(reached.select("node"), "node", "left_anti"))
            if new.isEmpty():
                break
            reached = cut(reached.unionByName(new))
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        e = cut(e.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
    if found is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    several = found.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("colour")
    return cut(found.join(several, "colour").select("node", F.col("colour").alias("component")))


def in_cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b): the edges that lie on a cycle, which are those within a component, and loops."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    c = components(e, "a", "b")
    inside = e.join(c.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("ca = cb").select("a", "b")
    return inside.where("a <> b").unionByName(e.where("a = b"))


def component_cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(component, size, cycle) for each component: the shortest cycle through its least node, beginning with it.

    Of equally short ones, that whose nodes, from the last back, are each the least.  A loop is a cycle of its node, which
    is a component of size 1 if it lies on no other.  Breadth first from all components at once.
    """
    from quarry.sources.checkpoints import cut

    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct()
    c = components(e, "a", "b")
    loops = e.where("a = b").select(F.col("a").alias("node"))
    single = loops.join(c, "node", "left_anti").withColumn("component", F.col("node"))
    c = cut(c.unionByName(single))
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = cut(e.join(c.select(F.col("node").alias("a"), "component"), "a").join(c.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").where("component = cb").select("component", "a", "b"))
    # known: how far a node is from its component's least one, and from where
    known = cut(sizes.select("component", F.col("component").alias("node"), F.lit(0).alias("far"), F.lit(None).cast(c.schema["node"].dataType).alias("back")))
    new, far, closed = known, 0, None
    while True:
        step = inside.join(new.select("component", F.col("node").alias("a")), ["component", "a"])
        ends = step.where("b = component").groupBy("component").agg(F.min("a").alias("node")).withColumn("far", F.lit(far))
        closed = cut(ends if closed is None else closed.unionByName(ends.join(closed, "component", "left_anti")))
        far += 1
        open_ = step.join(closed, "component", "left_anti")  # a component whose cycle is found is done
        new = cut(open_.join(known.select("component", F.col("node").alias("b")), ["component", "b"], "left_anti").groupBy("component", F.col("b").alias("node")).agg(F.min("a").alias("back")))
        if new.isEmpty():
            break
        new = new.select("component", "node", F.lit(far).alias("far"), "back")
        known = cut(known.unionByName(new))
    parts = at = closed.select("component", "far", "node")
    for _ in range(far):  # back from each cycle's last node
        at = cut(at.join(known.select("component", "node", "back"), ["component", "node"]).where("back is not null").select("component", (F.col("far") - 1).alias("far"), F.col("back").alias("node")))
        if at.isEmpty():
            break
        parts = parts.unionByName(at)
    paths_ = parts.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "node"))), lambda x: x["node"]).alias("cycle"))
    return paths_.join(sizes, "component").select("component", "size", "cycle")


def cycles(edges: DataFrame, group: str, src: str, dst: str) -> DataFrame:
    """(group, component, size, cycle) for each component of each group's (repository's) graph."""
    key = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("n"))
    found = component_cycles(edges.where(F.col(group).isNotNull()).select(key(src).alias("a"), key(dst).alias("b")), "a", "b")
    return found.select(F.col("component.g").alias(group), F.col("component.n").alias("component"), "size", F.col("cycle.n").alias("cycle"))
