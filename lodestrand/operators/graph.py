"""Graphs as edge tables: neighbourhoods, reachability, levels, components; each step joins the frontier, not all paths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut


def neighbourhood(edges: DataFrame, start: list, hops: int, directed: bool = False) -> DataFrame:
    """(node, hops): every node within so many edges (u, v) of the start nodes, at its shortest distance."""
    links = edges.select("u", "v")
    if not directed:
        links = links.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = cut(links.distinct())
    kind = dict(links.dtypes)["u"]
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], f"node {kind}, hops int")
    frontier = seen
    for hop in range(1, hops + 1):
        frontier = cut(frontier.join(links, frontier["node"] == links["u"]).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): every node that stands on a cycle of edges (u, v).

    Nodes without a predecessor or without a successor are peeled off until none is left, so a graph without
    cycles costs what its levels do. The rest, cycles and what lies between them, is coloured: each round
    passes the greatest node on along edges, and who gets its own name back along the colour's edges is
    of its component, which goes; a component of one node is a cycle only with an edge to itself.
    """
    links, out = cut(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL").distinct()), None
    while not links.isEmpty():
        links, peeled = _peeled(links)
        if links.isEmpty():
            break
        if peeled:
            continue
        colour = cut(links.select(F.col("u").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:  # forward: the greatest node from which each can be reached
            offered = links.join(colour.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max("colour").alias("offer"))
            new = cut(colour.join(offered, "node", "left").select("node", F.greatest("colour", "offer").alias("colour")))
            if new.exceptAll(colour).isEmpty():
                break
            colour = new
        own = links.join(colour.withColumnRenamed("node", "u").withColumnRenamed("colour", "a"), "u").join(colour.withColumnRenamed("node", "v").withColumnRenamed("colour", "b"), "v")
        own = cut(own.where("a = b").select("u", "v", "a"))
        reached = cut(colour.where("node = colour").select("node"))
        frontier = reached
        while not frontier.isEmpty():  # back: who reaches the colour's root within the colour
            frontier = cut(own.join(frontier, F.col("v") == F.col("node")).select(F.col("u").alias("node")).distinct().join(reached, "node", "left_anti"))
            reached = cut(reached.unionByName(frontier))
        one = own.join(reached.withColumnRenamed("node", "u"), "u", "left_semi").join(reached.withColumnRenamed("node", "v"), "v", "left_semi")
        found = cut(one.select(F.col("u").alias("node")).distinct())
        out = found if out is None else cut(out.unionByName(found).distinct())
        gone = reached.withColumnRenamed("node", "g")
        links = cut(links.join(gone, F.col("u") == F.col("g"), "left_anti").join(gone, F.col("v") == F.col("g"), "left_anti"))
    return out if out is not None else edges.select(F.col("u").alias("node")).limit(0)


def _peeled(links: DataFrame) -> tuple[DataFrame, bool]:
    """links without those from a node that none leads to, or to one that leads nowhere; and whether there were any."""
    rest = cut(links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
    return rest, rest.count() < links.count()


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, level) of a graph without cycles, edges (u before v): a node's level is one above its highest predecessor's.

    Nodes on cycles, and what follows them, have no level and are left out. Goes on until no node is free; fails
    if that takes more than ``most`` levels, where it is given.
    """
    left, links, done = cut(nodes.select("node").distinct()), cut(edges.select("u", "v").distinct()), None
    for level in count():
        free = cut(left.join(links.select(F.col("v").alias("node")), "node", "left_anti").withColumn("level", F.lit(level).cast("bigint")))
        if free.isEmpty():
            break
        if level == most:
            raise RuntimeError(f"more than {most} levels")
        done = free if done is None else done.unionByName(free)
        done = cut(done) if level % 100 == 99 else done
        left = cut(left.join(free.select("node"), "node", "left_anti"))
        links = cut(links.join(free.select(F.col("node").alias("u")), "u", "left_anti"))
    return done if done is not None else left.withColumn("level", F.lit(None).cast("bigint"))


def walk(parents: DataFrame) -> DataFrame:
    """(node, root, depth) from links (node, parent; null for a root): each walked to its end by pointers that double.

    A parent that is no node counts as none. Nodes on cycles, and below them, have neither root nor depth. n levels take log2 n joins.
    """
    nodes = cut(parents.select("node", "parent").dropDuplicates(["node"]))
    known = nodes.select(F.col("node").alias("k"))
    at = F.coalesce("k", "node")
    now = cut(nodes.join(known, F.col("parent") == F.col("k"), "left").select("node", at.alias("at"), F.when(F.col("k").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("k").isNull().alias("ended")))
    size, reach = now.count(), 1
    while reach <= size and not now.where("NOT ended").isEmpty():
        ahead = now.select(F.col("node").alias("n"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("ended").alias("there"))
        now = cut(now.join(ahead, F.col("at") == F.col("n")).select("node", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("ended") | F.col("there")).alias("ended")))
        reach *= 2
    ended = F.col("ended")
    return now.select("node", F.when(ended, F.col("at")).alias("root"), F.when(ended, F.col("depth")).alias("depth"))


def statistics(triples: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """Tables of a graph's statistics: totals, most mentioned entities, relations."""
    mentions = triples.select(F.col("subject").alias("entity")).unionByName(triples.select(F.col("object").alias("entity")))
    entities = mentions.groupBy("entity").agg(F.count("*").alias("mentions"))
    return {
        "totals": triples.agg(F.count("*").alias("triples"), F.count_distinct("predicate").alias("relations"), F.round(F.avg("confidence"), 6).alias("mean_confidence")),
        "entities": entities,
        "top_entities": entities.orderBy(F.desc("mentions"), "entity").limit(n),
        "relations": triples.groupBy("predicate").agg(F.count("*").alias("n")),
    }


def min_label_components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, by passing least labels along edges and jumping to labels' labels.

    Goes on until the labels settle; fails if that takes more than ``most`` rounds, where it is given.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    for done in count():
        if done == most:
            raise RuntimeError(f"labels haven't settled after {most} rounds")
        offered = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("offer"))
        nearer = labels.join(offered, "node", "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("component"))
        jumped = nearer.alias("a").join(nearer.select(F.col("node").alias("k"), F.col("component").alias("c2")).alias("b"), F.col("a.component") == F.col("b.k"), "left")
        new = cut(jumped.select("node", F.least("component", F.coalesce("c2", "component")).alias("component")))
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new
