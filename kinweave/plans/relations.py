"""Edges, graph reads and paths."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import edges as E
from kinweave.operators import graph as G
from kinweave.settings import Settings

from .star import NEAR, NOW, VISIBLE, documents, edges_sql, mentions, pairs_sql, query, table

S = Settings()
ROUNDED = "round(weight, 6) AS weight, round(1 - exp(-weight / 6.0::double), 6) AS strength"


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _edges(spark, sf, s: Settings = S) -> DataFrame:
    return E.rebuild_edges(documents(spark, sf), mentions(spark, sf), NOW, s)


@query(f"WITH {edges_sql()} SELECT owner, a, b, {ROUNDED}, last_seen, n FROM edges")
def edges_full(spark, sf):
    return _r(_edges(spark, sf), "weight", "strength").select("owner", "a", "b", "weight", "strength", "last_seen", "n")


@query(f"WITH {edges_sql(4)} SELECT owner, a, b, {ROUNDED}, n FROM edges")
def edges_capped(spark, sf):
    return _r(_edges(spark, sf, S.changed(max_participants=4)), "weight", "strength").select("owner", "a", "b", "weight", "strength", "n")


@query(f"WITH {edges_sql()} SELECT owner, count(*) AS edges, round(sum(weight), 4) AS weight, max(last_seen) AS last_seen FROM edges GROUP BY owner")
def edges_by_layer(spark, sf):
    e = _edges(spark, sf)
    return e.groupBy("owner").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 4).alias("weight"), F.max("last_seen").alias("last_seen"))


@query(f"WITH {pairs_sql()} SELECT owner, a, b, kind, count(*) AS signals FROM pairs GROUP BY owner, a, b, kind")
def edges_signals(spark, sf):
    return E.edge_signals(documents(spark, sf), mentions(spark, sf))


@query(f"WITH {edges_sql()} SELECT owner, a, b, {ROUNDED}, n FROM edges")
def edges_incremental(spark, sf):
    """Edges that lack what suppliers divisible by 10 did, then brought up to date for those."""
    d, m = documents(spark, sf), mentions(spark, sf)
    dirty = m.where(F.col("entity_id") % 10 == 0).select("entity_id").distinct()
    stale = E.rebuild_edges(d.where(F.col("id") % 7 != 0), m, NOW).where((F.col("a") % 10 == 0) | (F.col("b") % 10 == 0))
    clean = E.rebuild_edges(d, m, NOW).where((F.col("a") % 10 != 0) & (F.col("b") % 10 != 0))
    e = E.rebuild_edges_for(stale.unionByName(clean), d, m, dirty, NOW)
    return _r(e, "weight", "strength").select("owner", "a", "b", "weight", "strength", "n")


#: Orders up to a day, every eleventh undated.
THEN = "2000-06-01 00:00:00"
AGED = (
    edges_sql().replace("o_orderdate AS occurred_at", "CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS occurred_at")
    .replace("AS owner FROM orders)", f"AS owner FROM orders WHERE o_orderkey % 11 = 0 OR o_orderdate <= TIMESTAMP '{THEN}')").replace("* pow(", "* CASE WHEN d.occurred_at IS NULL THEN 0.7::double ELSE pow(").replace("/ 180.0::double) AS w", "/ 180.0::double) END AS w")
)


@query(f"WITH {AGED} SELECT owner, a, b, {ROUNDED}, n FROM edges")
def edges_aged(spark, sf):
    """Edges made for a day, and then as they are 14 months later, without a document being read again."""
    d = documents(spark, sf).withColumn("occurred_at", F.when(F.col("id") % 11 > 0, F.col("occurred_at")))
    then = E.rebuild_edges(d.where(F.col("occurred_at").isNull() | (F.col("occurred_at") <= F.lit(THEN).cast("timestamp_ntz"))), mentions(spark, sf), THEN)
    return _r(E.edges_at(then, THEN, NOW), "weight", "strength").select("owner", "a", "b", "weight", "strength", "n")


@query(f"WITH {edges_sql()}, {VISIBLE} SELECT a, b, round(weight, 6) AS weight, round(strength, 6) AS strength, last_seen FROM visible")
def visible_strength(spark, sf):
    return _r(G.visible_graph(_edges(spark, sf), "O"), "weight", "strength").select("a", "b", "weight", "strength", "last_seen")


#: Parts are a wide graph with few links each; suppliers, few and all linked.
PARTS = edges_sql(entity="l_partkey")
HIDDEN = """foreign_ AS (SELECT a, b, count(DISTINCT owner) AS owners FROM edges WHERE owner NOT IN ('', 'O') GROUP BY a, b),
  hidden AS (SELECT * FROM foreign_ f WHERE NOT EXISTS (SELECT 1 FROM edges v WHERE v.owner IN ('', 'O') AND v.a = f.a AND v.b = f.b))"""


def _parts(spark, sf, **how) -> DataFrame:
    return E.rebuild_edges(documents(spark, sf), mentions(spark, sf, "l_partkey"), NOW, S, **how)


@query(f"WITH {PARTS}, {HIDDEN} SELECT a, b, owners FROM hidden")
def foreign_hint_edges(spark, sf):
    """Pairs that only layers the viewer can't read know of."""
    return G.hidden_edges(_parts(spark, sf), "O").select("a", "b", F.size("owners").cast("long").alias("owners"))


@query(f"""WITH {edges_sql()}, seen AS (SELECT a, b, sum(weight) AS weight, max(last_seen) AS last_seen FROM edges WHERE owner IN ('', 'O') GROUP BY a, b),
  near AS (SELECT a AS src, b AS dst, weight, last_seen FROM seen UNION ALL SELECT b, a, weight, last_seen FROM seen),
  kinds AS (SELECT a, b, kind, count(*) AS n FROM pairs WHERE owner IN ('', 'O') GROUP BY a, b, kind), told AS (SELECT a, b, string_agg(kind || ':' || n, ',' ORDER BY kind) AS signals FROM kinds GROUP BY a, b)
  SELECT dst AS other, round(weight, 6) AS weight, round(1 - exp(-weight / 6.0::double), 6) AS strength, last_seen, signals FROM near JOIN told ON a = least(7, dst) AND b = greatest(7, dst)
  WHERE src = 7 ORDER BY near.weight DESC, dst LIMIT 25""")
def strongest_connections(spark, sf):
    """The strongest neighbours of supplier 7, and what they share; only its own edges are added up."""
    m = mentions(spark, sf)
    edges = E.rebuild_edges(documents(spark, sf), m, NOW, S, signals=True)
    near = _r(G.strongest_connections(edges, 7, "O"), "weight", "strength")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat(e.key, F.lit(":"), e["value"].cast("string"))), ",")
    return near.withColumn("signals", told)


@query(f"""WITH {edges_sql()}, {VISIBLE}, {NEAR} SELECT src AS node, round(sum(strength), 6) AS total, count(*) AS degree
  FROM near GROUP BY src ORDER BY sum(strength) DESC, src LIMIT 20""")
def graph_top_nodes(spark, sf):
    return _r(G.top_nodes(G.visible_graph(_edges(spark, sf), "O"), 20), "total")


#: All simple walks of at most three hops from part 3 through strong links; the twin tries them all.
STRONG = "visible AS (SELECT a, b, 1 - exp(-sum(weight) / 6.0::double) AS strength FROM edges WHERE owner IN ('', 'O') GROUP BY a, b HAVING 1 - exp(-sum(weight) / 6.0::double) > 0.1::double)"
SNEAR = "near AS (SELECT a AS src, b AS dst, strength FROM visible UNION ALL SELECT b, a, strength FROM visible)"
WALK = """{0}(node, cost, hops, path, private) AS (SELECT 3::bigint, 0.0::double, 0, '3', 0 UNION ALL
  SELECT n.dst, w.cost - ln(greatest(n.strength, 0.01::double)), w.hops + 1, w.path || '>' || n.dst::varchar, w.private + n.private
  FROM {0} w JOIN {1} n ON n.src = w.node WHERE w.hops < 3 AND position('>' || n.dst::varchar || '>' IN '>' || w.path || '>') = 0)"""
SEEN = "seen AS (SELECT src, dst, strength, 0 AS private FROM near)"
WALKS = f"WITH RECURSIVE {PARTS}, {STRONG}, {SNEAR}, {SEEN}, {WALK.format('walks', 'seen')}"
FRIEND, TARGET = 171, 1700


def _path(df: DataFrame) -> DataFrame:
    return df.select("hops", F.round("cost", 6).alias("cost"), F.round("strength", 6).alias("strength"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


STRICT = S.changed(least_strength=0.1)


def _paths(spark, sf, target: int = FRIEND) -> DataFrame:
    return G.warm_paths(G.visible_graph(_parts(spark, sf), "O", STRICT), 3, target, 3, STRICT)


@query(f"{WALKS} SELECT hops, round(cost, 6) AS cost, round(exp(-cost), 6) AS strength, path FROM walks WHERE node = {FRIEND} ORDER BY walks.cost, hops, path LIMIT 1")
def warm_path_best(spark, sf):
    return _path(G.best_path(_paths(spark, sf)))


@query(f"{WALKS} SELECT hops, round(cost, 6) AS cost, round(exp(-cost), 6) AS strength, path FROM walks WHERE node = {FRIEND} ORDER BY hops, walks.cost, path LIMIT 1")
def warm_path_fewest_hops(spark, sf):
    return _path(G.best_path(_paths(spark, sf), fewest_hops=True))


@query(f"""WITH RECURSIVE {PARTS}, {HIDDEN}, {STRONG}, {SNEAR}, {SEEN}, {WALK.format('walks', 'seen')},
  mixed AS (SELECT a, b, CASE WHEN f.a IS NOT NULL AND (strength IS NULL OR strength < 0.5::double) THEN 0.5::double ELSE strength END AS strength, (f.a IS NOT NULL AND (strength IS NULL OR strength < 0.5::double))::int AS private
    FROM visible v FULL OUTER JOIN foreign_ f USING (a, b)),
  every AS (SELECT a AS src, b AS dst, strength, private FROM mixed UNION ALL SELECT b, a, strength, private FROM mixed), {WALK.format('all_', 'every')},
  c AS (SELECT * FROM all_ WHERE node = {TARGET} ORDER BY hops, all_.cost, path LIMIT 1), steps AS (SELECT unnest(string_split(path, '>'))::bigint AS entity, generate_subscripts(string_split(path, '>'), 1) AS place FROM c
    WHERE private > 0 AND hops < coalesce((SELECT min(hops) FROM walks WHERE node = {TARGET}), 99))
  SELECT (s.place - 1)::int AS place, s.entity, coalesce(m.private, 0) = 1 AS private FROM steps s LEFT JOIN steps p ON p.place = s.place - 1 LEFT JOIN mixed m ON m.a = least(p.entity, s.entity) AND m.b = greatest(p.entity, s.entity)""")
def private_path(spark, sf):
    """A shorter way through layers the viewer can't read: who is asked, hop by hop."""
    return G.private_path(_parts(spark, sf), 3, TARGET, "O", 3, STRICT).select("place", "entity", "private")


@query(f"""WITH {edges_sql()}, {VISIBLE}, {NEAR} SELECT x.dst AS mutual, round(x.strength, 6) AS to_a, round(y.strength, 6) AS to_b,
  round(least(x.strength, y.strength), 6) AS score FROM near x JOIN near y ON x.dst = y.dst WHERE x.src = 7 AND y.src = 33
  ORDER BY least(x.strength, y.strength) DESC, x.dst LIMIT 5""")
def introducers(spark, sf):
    return _r(G.introducers_of(_edges(spark, sf), 7, 33, "O"), "to_a", "to_b", "score")


@query(f"""WITH {PARTS}, {HIDDEN}, {VISIBLE}, {NEAR}, of33 AS (SELECT CASE WHEN a = 33 THEN b ELSE a END AS dst FROM foreign_ WHERE a = 33 OR b = 33)
  SELECT 'F' AS owner, count(*) AS contacts FROM of33 WHERE dst <> 7 AND dst NOT IN (SELECT dst FROM near WHERE src = 33) HAVING count(*) > 0""")
def introducers_via_private(spark, sf):
    """Whose layers reach part 33 through people the viewer has no link from."""
    return G.private_introducers(_parts(spark, sf), 7, 33, "O")


@query(f"""WITH {PARTS}, {STRONG}, {SNEAR}, one AS (SELECT DISTINCT dst AS node FROM near WHERE src = 3), two AS (SELECT DISTINCT n.dst AS node FROM one JOIN near n ON n.src = one.node)
  SELECT node, min(distance) AS distance FROM (SELECT 3::bigint AS node, 0 AS distance UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) t GROUP BY node""")
def ego_radius2(spark, sf):
    return G.ego(G.visible_graph(_parts(spark, sf), "O", STRICT), 3, 2)


DRAWN = f"""{PARTS}, {HIDDEN}, {VISIBLE}, links AS (SELECT a, b, strength FROM visible UNION ALL SELECT a, b, 0.25::double FROM hidden WHERE a % 10 < 8 AND b % 10 < 8),
  ends AS (SELECT a AS id, strength FROM links UNION ALL SELECT b, strength FROM links), score AS (SELECT id, sum(strength) AS total, count(*) AS degree FROM ends GROUP BY id),
  nodes AS (SELECT p_partkey AS entity_id, p_name AS name, coalesce(total, 0) AS total, coalesce(degree, 0) AS degree FROM part LEFT JOIN score ON id = p_partkey WHERE p_partkey % 10 < 8)"""


def _drawn(spark, sf) -> tuple[DataFrame, DataFrame]:
    people = table(spark, sf, "part").where("p_partkey % 10 < 8").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return G.drawn_links(_parts(spark, sf), people, "O"), people


def _view(spark, sf) -> tuple[DataFrame, DataFrame]:
    return G.graph_view(*_drawn(spark, sf), 40)


@query(f"WITH {DRAWN} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM links) AS total_links, (SELECT count(*) FROM nodes) > 40 AS truncated")
def graph_view_totals(spark, sf):
    """What the picture was cut from."""
    links, people = _drawn(spark, sf)
    return G.view_totals(links, people, G.graph_view(links, people, 40)[0])


@query(f"WITH {DRAWN} SELECT entity_id, name, round(total, 6) AS total, degree FROM nodes ORDER BY nodes.total DESC, name, entity_id LIMIT 40")
def graph_view_nodes(spark, sf):
    """The people a picture of the graph shows: the strongest, hints of private links counted; some are hidden from the viewer."""
    return _r(_view(spark, sf)[0], "total")


@query(f"""WITH {DRAWN}, kept AS (SELECT entity_id FROM nodes ORDER BY nodes.total DESC, name, entity_id LIMIT 40)
  SELECT a, b, round(strength, 6) AS strength FROM links WHERE a IN (SELECT * FROM kept) AND b IN (SELECT * FROM kept)""")
def graph_view_links(spark, sf):
    return _r(_view(spark, sf)[1], "strength").select("a", "b", "strength")


@query("""WITH t AS (SELECT conv_id, role, turn FROM conversations), p AS (SELECT DISTINCT x.conv_id AS conv, least(x.role, y.role) AS a, greatest(x.role, y.role) AS b FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.role < y.role)
  SELECT a || (conv % 20)::VARCHAR || '@' || a || '.example' AS a, b || (conv % 20)::VARCHAR || '@' || b || '.example' AS b, count(*) AS n, round(count(*) * 1.75::double, 6) AS weight FROM p GROUP BY ALL""")
def sync_incremental(spark, sf):
    """Edges after a sync of most conversations as undated mails, and another of the rest that brings all up to date."""
    from kinweave.api import Engine

    c = table(spark, sf, "conversations")
    email = F.concat("role", (F.col("conv_id") % 20).cast("string"), F.lit("@"), F.col("role"), F.lit(".example"))
    none = F.lit(None).cast("string")
    who = F.struct(none.alias("name"), email.alias("email"), none.alias("org"), F.lit("to").alias("role"))
    r = c.groupBy("conv_id").agg(F.collect_set(who).alias("people"))
    r = r.select(F.lit("local").alias("source"), F.lit("email").alias("kind"), F.col("conv_id").cast("string").alias("external_id"), none.alias("title"), none.alias("occurred_at"), "people", F.array().cast("array<string>").alias("orgs"), none.alias("body"), none.alias("raw"), none.alias("owner"), "conv_id")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    e = Engine(spark, f"{root or 'file://' + tempfile.mkdtemp(prefix='kinweave-')}/kinweave-sync-{uuid.uuid4().hex}")
    e.sync(r.where("conv_id % 50 > 0").drop("conv_id"), NOW)
    e.sync(r.where("conv_id % 50 = 0").drop("conv_id"), NOW)
    of = e.entities.select("entity_id", F.col("emails")[0].alias("email"))
    named = e.edges.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    return _r(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", "weight"), "weight")
