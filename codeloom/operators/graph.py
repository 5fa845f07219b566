"""The graph of file dependencies: edges, components, cycles, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, symbols
from .lineage import cut
from .model import Facts

MAX_FILES = 8
MAX_DEPTH = 5


def file_edges(facts: Facts) -> DataFrame:
    """from_file, to_file, with ids and test marks: a file mentions a runtime symbol that another defines."""
    users = facts.use.where("n_other > 0").join(facts.docs.select("doc_id", F.col("path").alias("from_file"), F.col("is_test").alias("from_test")), "doc_id").withColumnRenamed("doc_id", "from_id")
    homes = facts.defs.where(symbols.is_runtime_edge(F.col("symbol")))
    rows = users.join(homes, "symbol_id").where("from_id <> doc_id")
    return rows.select("from_id", F.col("doc_id").alias("to_id"), "from_file", F.col("path").alias("to_file"), "from_test", F.col("is_test").alias("to_test")).distinct()


def two_way_cycles(facts: Facts) -> DataFrame:
    """file1 < file2 that depend on each other."""
    edges = file_edges(facts)
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    rows = edges.where("from_file < to_file").join(back, ["from_id", "to_id"], "left_semi")
    rows = rows if facts.include_tests else rows.where("not from_test and not to_test")
    rows = rows.where(paths.in_scope(F.col("from_file"), facts.scope) | paths.in_scope(F.col("to_file"), facts.scope))
    return rows.select(F.col("from_file").alias("file1"), F.col("to_file").alias("file2"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The (from_id, to_id) edges left after files that no edge enters, or none leaves, are removed again and again.

    All edges of cycles stay. A round is a pair of semi joins that peels one
    layer off the graph; there are as many rounds as layers outside of cycles.
    """
    edges = cut(edges.select("from_id", "to_id").distinct())
    count = edges.count()
    while count:
        entered = edges.select(F.col("to_id").alias("from_id")).distinct()
        left = edges.select(F.col("from_id").alias("to_id")).distinct()
        edges = cut(edges.join(entered, "from_id", "left_semi").join(left, "to_id", "left_semi"))
        now = edges.count()
        if now == count:
            break
        count = now
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component: strongly connected components of (from_id, to_id) edges, named by their least node.

    Nodes that no edge enters, or none leaves, are components of their own and
    are peeled off first. Then colouring: each node takes the least id that
    reaches it; the nodes of a colour that reach back to its id are one
    component and leave the graph. This goes on until no node is left: every
    round takes at least one node of each colour.
    """
    edges = cut(edges.select("from_id", "to_id").distinct())
    nodes = cut(edges.select(F.col("from_id").alias("node")).unionByName(edges.select(F.col("to_id").alias("node"))).distinct())
    done, left = nodes.limit(0).select("node", F.col("node").alias("component")), edges
    while not nodes.isEmpty():
        # What isn't in a cycle any more is alone.
        left = cyclic_edges(left)
        inner = left.select(F.col("from_id").alias("node")).distinct()
        alone = nodes.join(inner, "node", "left_anti")
        done = cut(done.unionByName(alone.select("node", F.col("node").alias("component"))))
        nodes = cut(inner)
        if nodes.isEmpty():
            break
        colour = _spread(nodes.withColumn("colour", F.col("node")), left)
        same = left.join(colour.select(F.col("node").alias("from_id"), F.col("colour").alias("c1")), "from_id").join(colour.select(F.col("node").alias("to_id"), F.col("colour").alias("c2")), "to_id").where("c1 = c2")
        back = same.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
        seeds = colour.withColumn("mark", F.when(F.col("node") == F.col("colour"), F.col("node")).otherwise(F.lit(2**62)))
        reached = _spread(seeds.select("node", F.col("mark").alias("colour")), cut(back))
        found = cut(reached.where(F.col("colour") < 2**62).select("node", F.col("colour").alias("component")))
        done = cut(done.unionByName(found))
        nodes = cut(nodes.join(found, "node", "left_anti"))
        gone = found.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("node", "to_id"), "to_id", "left_anti"))
    return done


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's least colour over all nodes that reach it."""
    colours = cut(colours)
    total = colours.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]
    while True:
        sent = edges.join(colours.withColumnRenamed("node", "from_id"), "from_id").select(F.col("to_id").alias("node"), "colour")
        colours = cut(colours.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        now = colours.agg(F.sum(F.col("colour").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return colours
        total = now


def longer_cycles(facts: Facts, most: int = MAX_FILES) -> DataFrame:
    """Cycles of 3 to ``most`` files, at most ``MAX_FILES``, as arrays of paths that begin with the least path.

    Each cycle is met in the middle: a path from its least id takes half of the
    edges, rounded up, and one that leads back there the others. Paths grow by
    ids, within edges of cycles. The number of halves can be exponential in half
    of ``most``, that of cycles in ``most``.
    """
    most = min(most, MAX_FILES)
    every = file_edges(facts)
    every = every if facts.include_tests else every.where("not from_test and not to_test")
    steps = cyclic_edges(every)
    ahead = _half_paths(steps, (max(most, 2) + 1) // 2).withColumnRenamed("between", "ahead")
    back = _half_paths(steps.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")), max(most, 2) // 2).withColumnRenamed("between", "back")
    more = F.size("ahead") - F.size("back")
    met = ahead.where(F.size("ahead") > 0).join(back, ["home", "last"]).where((more == 0) | (more == 1)).where(~F.arrays_overlap("ahead", "back"))
    met = met.where(F.size("ahead") + F.size("back") + 2 <= most)
    ring = cut(met.select(F.concat(F.array("home"), "ahead", F.array("last"), F.reverse("back")).alias("ring")))
    named = ring.select("ring", F.posexplode("ring").alias("place", "doc_id")).join(facts.docs.select("doc_id", "path"), "doc_id")
    files = F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])
    found = named.groupBy("ring").agg(files.alias("files"))
    first = F.array_position("files", F.array_min("files")).cast("int")
    found = found.select(F.concat(F.slice("files", first, F.size("files")), F.slice("files", F.lit(1), first - 1)).alias("files"))
    return found.where(F.exists("files", lambda p: paths.in_scope(p, facts.scope)))


def _half_paths(steps: DataFrame, most: int) -> DataFrame:
    """home, last, between: paths of 1 to ``most`` steps whose least id is where they begin.

    All but the longest are kept; those are grown where they are read.
    """
    now = steps.where("to_id > from_id").select(F.col("from_id").alias("home"), F.col("to_id").alias("last"), F.array().cast("array<long>").alias("between"))
    found = now
    for edges in range(2, most + 1):
        grown = now.withColumnRenamed("last", "from_id").join(steps, "from_id").where((F.col("to_id") > F.col("home")) & ~F.array_contains("between", F.col("to_id")))
        now = grown.select("home", F.col("to_id").alias("last"), F.array_append("between", F.col("from_id")).alias("between"))
        now = cut(now) if edges < most else now
        found = found.unionByName(now)
    return found


def affected(facts: Facts, start: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """symbol_id, depth: symbols of files that mention a symbol reached one step before, from ``start`` (symbol_id).

    A symbol is listed at each depth it is reached at. A step never leads from a
    symbol to itself alone, so a file keeps the least and the largest symbol it
    was reached by, and drops one that equals both.
    """
    users = facts.use.where("n_other > 0").select("symbol_id", "doc_id")
    homes = facts.defs.select("symbol_id", "doc_id")
    front, found = cut(start.select("symbol_id").distinct()), None
    for level in range(1, depth + 1):
        reached = front.join(users, "symbol_id").groupBy("doc_id").agg(F.min("symbol_id").alias("low"), F.max("symbol_id").alias("high"))
        front = cut(homes.join(reached, "doc_id").where("not (symbol_id = low and symbol_id = high)").select("symbol_id").distinct())
        rows = front.select("symbol_id", F.lit(level).alias("depth"))
        found = rows if found is None else found.unionByName(rows)
    return found
