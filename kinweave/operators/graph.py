"""Reads of the graph: what a viewer sees, strongest connections, warm paths, introducers, ego graphs."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from kinweave.operators.edges import strength
from kinweave.settings import Settings, visible_layers

#: How strong a link is drawn that only hints at a private layer.
HINT = 0.25


def _signals(sets: Column) -> Column:
    """One map of counts from many, adding counts of a kind."""
    entries = F.flatten(F.transform(sets, F.map_entries))
    kinds = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e.key)))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e.key == k), F.lit(0).cast("long"), lambda n, e: n + e.value)
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, total(k))))


def visible_graph(edges: DataFrame, viewer: str | None, s: Settings = Settings()) -> DataFrame:
    """(a, b, weight, strength, last_seen, signals if edges have them): weights add over the visible layers, then saturate once."""
    seen = edges.where(F.col("owner").isin(visible_layers(viewer)))
    more = [_signals(F.collect_list("signals")).alias("signals")] if "signals" in edges.columns else []
    g = seen.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("last_seen").alias("last_seen"), *more)
    return g.withColumn("strength", strength(F.col("weight"), s)).where(F.col("strength") > s.least_strength)


def adjacency(graph: DataFrame) -> DataFrame:
    """Each edge both ways, as (src, dst, strength, ...), in one pass over the graph."""
    rest = [c for c in graph.columns if c not in ("a", "b")]
    ends = F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return graph.select(ends, *rest)


def _touching(edges: DataFrame, *who) -> DataFrame:
    """The edges of some entities, before anything is added up."""
    return edges.where(F.col("a").isin(list(who)) | F.col("b").isin(list(who)))


def foreign_edges(edges: DataFrame, viewer: str | None) -> DataFrame:
    """(a, b, owners) of pairs in layers the viewer can't read; no weight is told."""
    foreign = edges.where((F.col("owner") != "") & ~F.col("owner").isin(visible_layers(viewer)))
    return foreign.groupBy("a", "b").agg(F.sort_array(F.collect_set("owner")).alias("owners"))


def hidden_edges(edges: DataFrame, viewer: str | None) -> DataFrame:
    """The foreign edges of pairs that the viewer has no edge of."""
    seen = edges.where(F.col("owner").isin(visible_layers(viewer))).select("a", "b").distinct()
    return foreign_edges(edges, viewer).join(seen, ["a", "b"], "left_anti")


def strongest_connections(edges: DataFrame, who, viewer: str | None, limit: int = 25, s: Settings = Settings()) -> DataFrame:
    """The strongest neighbours of one entity: (other, weight, strength, last_seen, signals if edges have them)."""
    near = adjacency(visible_graph(_touching(edges, who), viewer, s.changed(least_strength=-1.0))).where(F.col("src") == who)
    kept = ["weight", "strength", "last_seen", *(["signals"] if "signals" in edges.columns else [])]
    return near.orderBy(F.desc("weight"), "dst").limit(min(max(limit, 1), 200)).select(F.col("dst").alias("other"), *kept)


def warm_paths(graph: DataFrame, src, dst, max_hops: int = 4, s: Settings = Settings()) -> DataFrame:
    """(hops, cost, path): the cheapest path to ``dst`` for each number of hops.

    One join a hop: the best cost of a node at h hops comes from its neighbours' at h - 1. A
    frontier holds one row a node, so a plan of max_hops joins does, whatever the graph. The
    graph and the frontiers are cached while they are needed, each frontier before the next is
    planned, so that Spark knows its size and deals the links anew only for a large one; of the
    last hop only links to ``dst`` are followed. What comes to the driver is a row a hop.
    """
    kind = graph.schema["a"].dataType
    links = graph.select("a", "b", (-F.log(F.greatest(F.col("strength"), F.lit(max(s.least_strength, 0.01))))).alias("step"))
    cached = [links.persist(StorageLevel.MEMORY_AND_DISK)]  # read once a hop
    steps = adjacency(links)
    front = graph.sparkSession.range(1).select(F.lit(src).cast(kind).alias("node"), F.lit(0.0).alias("cost"))
    front = front.withColumn("path", F.array("node"))
    found = [front.withColumn("hops", F.lit(0))]
    try:
        for h in range(1, max_hops + 1):
            on = steps.join(front.withColumnRenamed("node", "src"), "src").where(~F.array_contains("path", F.col("dst")))
            on = on.select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
            front = on.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("m")).select("node", "m.cost", "m.path")
            if h < max_hops:
                cached.append(front.persist(StorageLevel.MEMORY_AND_DISK))
            found.append(front.withColumn("hops", F.lit(h)))
            if h < max_hops and not front.count():
                break
        paths = reduce(DataFrame.unionByName, found).where(F.col("node") == F.lit(dst)).select("hops", "cost", "path")
        return graph.sparkSession.createDataFrame(paths.collect(), paths.schema)  # max_hops + 1 rows at most
    finally:
        for df in cached:
            df.unpersist()


def best_path(paths: DataFrame, fewest_hops: bool = False) -> DataFrame:
    """One row: the cheapest path, or the cheapest of the shortest."""
    order = ["hops", "cost", "path"] if fewest_hops else ["cost", "hops", "path"]
    return paths.orderBy(*order).limit(1).withColumn("strength", F.exp(-F.col("cost")))


def private_path(edges: DataFrame, src, dst, viewer: str | None, max_hops: int = 4, s: Settings = Settings()) -> DataFrame:
    """(place, entity, private, owners): the steps of a path through layers the viewer can't read, if it is shorter than any visible one.

    A private hop says who to ask, and nothing of how strong it is: all weigh ``private_hop_strength``.
    """
    mine = F.col("owner").isin(visible_layers(viewer))
    pairs = edges.groupBy("a", "b").agg(F.sum(F.when(mine, F.col("weight"))).alias("weight"), F.sort_array(F.collect_set(F.when(~mine, F.col("owner")))).alias("owners"))
    value = strength(F.col("weight"), s)
    pairs = pairs.select("a", "b", F.when(value > s.least_strength, value).alias("seen"), "owners")
    # of a pair with both, the visible edge unless the private prior is stronger
    use = (F.size("owners") > 0) & (F.col("seen").isNull() | (F.col("seen") < s.private_hop_strength))
    both = pairs.select("a", "b", "seen", F.when(use, F.col("owners")).alias("owners")).where("seen is not null or owners is not null")
    both.persist(StorageLevel.MEMORY_AND_DISK)  # the edges are added up once
    try:
        hidden = F.col("owners").isNotNull()
        every = both.select("a", "b", F.when(hidden, s.private_hop_strength).otherwise(F.col("seen")).alias("strength"))
        path = [n for r in best_path(warm_paths(every, src, dst, max_hops, s), fewest_hops=True).collect() for n in r.path]  # max_hops + 1 at most
        near = [tuple(sorted(p)) for p in zip(path, path[1:])]
        told = both.where(hidden & F.col("a").isin(path) & F.col("b").isin(path)).select("a", "b", "owners") if near else None
        owners = {(r.a, r.b): r.owners for r in told.collect()} if near else {}  # a row for each two of the path at most
        if any(p in owners for p in near):  # then a visible path matters if it has no more hops
            seen = both.where("seen is not null").select("a", "b", F.col("seen").alias("strength"))
            path = [] if warm_paths(seen, src, dst, len(near), s).count() else path
        else:
            path = []
    finally:
        both.unpersist()
    steps = [(i, n, i > 0 and near[i - 1] in owners, owners.get(near[i - 1]) if i else None) for i, n in enumerate(path)]
    rows = edges.sparkSession.createDataFrame(steps, StructType([StructField("place", IntegerType()), edges.schema["a"], StructField("private", BooleanType(), False), StructField("owners", ArrayType(edges.schema["owner"].dataType, False))]))
    return rows.withColumnRenamed("a", "entity")


def introducers(graph: DataFrame, a, b, limit: int = 5) -> DataFrame:
    """People who know both, by their weaker link: (mutual, to_a, to_b, score). One pass over the edges of the two."""
    near = adjacency(graph).where(F.col("src").isin([a, b]) & ~F.col("dst").isin([a, b]))
    to = lambda x: F.max(F.when(F.col("src") == x, F.col("strength")))
    both = near.groupBy(F.col("dst").alias("mutual")).agg(to(a).alias("to_a"), to(b).alias("to_b")).where("to_a is not null and to_b is not null")
    return both.withColumn("score", F.least("to_a", "to_b")).orderBy(F.desc("score"), "mutual").limit(limit)


def introducers_of(edges: DataFrame, a, b, viewer: str | None, limit: int = 5, s: Settings = Settings()) -> DataFrame:
    """The introducers, from the edges of the two alone."""
    return introducers(visible_graph(_touching(edges, a, b), viewer, s), a, b, limit)


def private_introducers(edges: DataFrame, a, b, viewer: str | None, s: Settings = Settings()) -> DataFrame:
    """(owner, contacts): owners of layers that reach ``b`` through people the viewer has no visible link from ``b`` to, ``a`` aside."""
    mine = _touching(edges, b)
    seen = adjacency(visible_graph(mine, viewer, s)).where(F.col("src") == b).select("dst")
    hidden = adjacency(foreign_edges(mine, viewer)).where((F.col("src") == b) & (F.col("dst") != a)).join(seen, "dst", "left_anti")
    return hidden.select("dst", F.explode("owners").alias("owner")).groupBy("owner").agg(F.count(F.lit(1)).alias("contacts")).orderBy("owner")


def ego(graph: DataFrame, focus, radius: int = 2) -> DataFrame:
    """(node, distance) within a radius of at most 4; one join a step, each node once."""
    near = adjacency(graph).select("src", "dst")
    seen = graph.sparkSession.range(1).select(F.lit(focus).cast(graph.schema["a"].dataType).alias("node"), F.lit(0).alias("distance"))
    for k in range(1, min(max(radius, 1), 4) + 1):
        on = near.join(seen.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(k).alias("distance"))
        seen = seen.unionByName(on).groupBy("node").agg(F.min("distance").alias("distance"))
    return seen


def top_nodes(graph: DataFrame, limit: int) -> DataFrame:
    """The nodes with the largest sum of incident strengths: (node, total, degree)."""
    t = adjacency(graph).groupBy(F.col("src").alias("node")).agg(F.sum("strength").alias("total"), F.count(F.lit(1)).alias("degree"))
    return t.orderBy(F.desc("total"), "node").limit(limit)


def drawn_links(edges: DataFrame, people: DataFrame, viewer: str | None, s: Settings = Settings()) -> DataFrame:
    """(a, b, strength, private): visible edges, and hints of hidden ones between people the viewer can see."""
    seen = visible_graph(edges, viewer, s).select("a", "b", "strength", F.lit(False).alias("private"))
    hints = hidden_edges(edges, viewer)
    for c in "ab":
        hints = hints.join(people.select(F.col("entity_id").alias(c)), c, "left_semi")
    return seen.unionByName(hints.select("a", "b", F.lit(HINT).alias("strength"), F.lit(True).alias("private")))


def graph_view(links: DataFrame, people: DataFrame, limit: int = 300, focus=None, radius: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) to draw: the strongest people, or those around one, who comes first; links with both ends among them.

    Nodes are (entity_id, name, total, degree, place); degrees count links to those left out as well.
    """
    t = adjacency(links).groupBy(F.col("src").alias("entity_id")).agg(F.sum("strength").alias("total"), F.count(F.lit(1)).alias("degree"))
    nodes = people.select("entity_id", "name").join(t, "entity_id", "left").fillna({"total": 0.0, "degree": 0})
    if focus is not None:
        nodes = nodes.join(ego(links, focus, radius).select(F.col("node").alias("entity_id")), "entity_id", "left_semi")
    pinned = [] if focus is None else [(F.col("entity_id") == F.lit(focus)).desc()]
    nodes = nodes.orderBy(*pinned, F.desc("total"), "name", "entity_id").limit(limit).select("entity_id", "name", "total", "degree")
    kept = nodes.select("entity_id")
    for c in "ab":
        links = links.join(kept.withColumnRenamed("entity_id", c), c, "left_semi")
    return nodes, links


def view_totals(links: DataFrame, people: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: how many people and links a viewer could see in all, and whether a picture (its ``nodes``) shows fewer people."""
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    each = count(people, "people").unionByName(count(links, "links")).unionByName(count(nodes, "shown"))
    n = lambda what: F.max(F.when(F.col("what") == what, F.col("n")))
    return each.agg(n("people").alias("total_nodes"), n("links").alias("total_links"), (n("shown") < n("people")).alias("truncated"))


def redact(steps: DataFrame, names: DataFrame, visible: DataFrame) -> DataFrame:
    """Steps (place, entity, private, ...) with names; a private step's contact that the viewer can't see loses name and id."""
    known = names.select(F.col("entity_id").alias("entity"), "name")
    may = visible.select(F.col("entity_id").alias("entity"), F.lit(True).alias("may")).distinct()
    rows = steps.join(known, "entity", "left").join(may, "entity", "left")
    hide = F.col("private") & F.col("may").isNull()
    rest = [c for c in steps.columns if c not in ("place", "entity")]
    return rows.select(
        "place", F.when(~hide, F.col("entity")).alias("entity"), F.when(hide, "(private contact)").otherwise(F.coalesce("name", F.col("entity").cast("string"))).alias("name"), hide.alias("redacted"), *rest
    ).orderBy("place")
