"""Queries over the market graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.functions.graphs import dense_components
from tidebook.functions.storage import materialize
from tidebook.operators import graph
from tidebook.plans.base_sql import sql
from tidebook.plans.registry import query, rounded
from tidebook.sources import tables

AS_OF = 1706659200000000
def _both(table: str) -> str:
    return f"SELECT market_a AS src, market_b AS dst, edge_type, weight FROM {table} UNION ALL SELECT market_b, market_a, edge_type, weight FROM {table}"


_DIR = _both("edges")
_FROM = "m0000100"
#: The loaded graph: edges above this weight.
LOADED = 0.1
#: The longest arbitrage paths, in links.
PATH_LINKS = 5


def _edges(spark, d):
    return graph.edge_weights(tables.edge_signals(spark, d, placed=True), AS_OF, order="place")


def _loaded(spark, d):
    """The graph that traversals run on, written once as they read it repeatedly."""
    return materialize(_edges(spark, d).where(F.col("weight") > LOADED), "graph")


@query(sql("SELECT market_a, market_b, edge_type, round(weight, 6) AS weight, user_count, signal_count, last_us FROM edges", "edges"))
def edge_weights(spark, d):
    return rounded(_edges(spark, d))


@query("""WITH l AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'user_trigger' ELSE 'trigger_fire' END AS signal_source, list_sort(list_distinct(list('c' || (o_orderkey % 40)))) AS m FROM orders GROUP BY 1)
SELECT k, signal_source, a AS market_a, b AS market_b, CASE signal_source WHEN 'user_trigger' THEN 1.5e0 ELSE 1e0 END AS strength FROM (SELECT k, signal_source, unnest(m) AS a, m FROM l) x, LATERAL (SELECT unnest(x.m) AS b) y WHERE a < b""")
def pair_signals(spark, d):
    lists = tables.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list(F.concat(F.lit("c"), F.col("o_orderkey") % 40)).alias("markets"))
    return graph.pair_signals(lists.withColumn("signal_source", F.when(F.col("k") % 2 == 0, "user_trigger").otherwise("trigger_fire")))


@query("""SELECT p_partkey, CASE WHEN contains(t, 'hedge') OR contains(t, 'inverse') THEN 'hedge' WHEN contains(t, 'caus') OR contains(t, 'depend') OR contains(t, 'trigger') THEN 'causal' ELSE 'correlation' END AS from_text,
 CASE WHEN p_size % 4 = 0 THEN 'hedge' WHEN p_size % 4 = 1 THEN 'causal' ELSE 'correlation' END AS from_rules FROM (SELECT *, lower(CASE p_size % 3 WHEN 0 THEN 'Hedge ' WHEN 1 THEN 'Depends ' ELSE '' END || p_name) AS t FROM part)""")
def infer_edge_type(spark, d):
    rows = tables.read(spark, d, "part").selectExpr("p_partkey", "concat(CASE p_size % 3 WHEN 0 THEN 'Hedge ' WHEN 1 THEN 'Depends ' ELSE '' END, p_name) AS t", "CASE p_size % 4 WHEN 0 THEN array('PRICE_ABOVE','PRICE_BELOW') WHEN 1 THEN array('PRICE_ABOVE','SIZE_SPIKE') ELSE array('PRICE_ABOVE') END AS kinds")
    return rows.select("p_partkey", graph.infer_edge_type_from_text(F.col("t")).alias("from_text"), graph.infer_edge_type(F.col("kinds")).alias("from_rules"))


_CORR = """y AS (SELECT condition_id, source_us // 1000000 AS bucket, avg((best_bid + best_ask) / 2) AS m FROM bbo WHERE asset_id::INT % 2 = 0 AND source_us > 1704067200000000 + 86400000000 - 7 * 86400000000 GROUP BY 1, 2 HAVING avg((best_bid + best_ask) / 2) IS NOT NULL),
c AS (SELECT a.condition_id AS market_a, b.condition_id AS market_b, corr(a.m, b.m) AS r, count(*) AS n FROM y a JOIN y b ON a.bucket = b.bucket AND a.condition_id < b.condition_id GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query(sql(f"WITH {_CORR} SELECT market_a, market_b, round(r, 5) AS r, n FROM c WHERE abs(r) > 0.6 AND NOT isnan(r)", "bbo"))
def correlation_seed(spark, d):
    return rounded(graph.market_correlations(tables.quotes(spark, d), tables.START_US + graph.DAY_US).where((F.abs("r") > 0.6) & ~F.isnan("r")), 5)


@query(sql(f"WITH {_CORR} SELECT market_a, market_b, round(r, 5) AS r, n FROM c WHERE r < -0.5", "bbo"))
def hedge_seed(spark, d):
    return rounded(graph.market_correlations(tables.quotes(spark, d), tables.START_US + graph.DAY_US).where("r < -0.5"), 5)


@query(sql(f"WITH {_CORR} SELECT market_a, market_b, round(r, 5) AS r, n FROM c WHERE NOT isnan(r) ORDER BY round(abs(r), 5) DESC, market_a, market_b LIMIT 20", "bbo"))
def correlation_preview(spark, d):
    rows = graph.market_correlations(tables.quotes(spark, d), tables.START_US + graph.DAY_US).where(~F.isnan("r"))
    return rounded(rows.orderBy(F.desc(F.round(F.abs("r"), 5)), "market_a", "market_b").limit(20), 5)


@query(sql("SELECT market_a, market_b, edge_type, signal_count, last_us AS updated_us FROM edges", "edges"))
def latest_edges(spark, d):
    now = _edges(spark, d).select("market_a", "market_b", "edge_type", "signal_count", F.col("last_us").alias("updated_us"))
    # an older version of each, from one pass over the edges
    old = F.struct("market_a", "market_b", "edge_type", (F.col("signal_count") - 1).alias("signal_count"), (F.col("updated_us") - 1).alias("updated_us"))
    versions = now.select(F.inline(F.array(F.struct(*now.columns), old)))
    return graph.latest_edges(versions, 2 * tables.read(spark, d, "lineitem").count())


@query(sql("SELECT market_b AS market_a, market_a AS market_b, edge_type, round(weight, 6) AS weight, user_count, signal_count, last_us FROM edges", "edges"))
def reverse_edges(spark, d):
    return rounded(graph.reverse_edges(_edges(spark, d)))


@query(sql(f"WITH k AS (SELECT * FROM edges WHERE weight > 0.1 ORDER BY weight DESC, market_a, market_b, edge_type LIMIT 100000), d AS ({_both('k')}) SELECT src, string_agg(dst || ':' || edge_type, ',' ORDER BY dst, edge_type) AS neighbors, count(*) AS degree FROM d GROUP BY 1", "edges"))
def adjacency(spark, d):
    rows = graph.adjacency(_edges(spark, d))
    return rows.select("src", F.array_join(F.transform("neighbors", lambda x: F.concat_ws(":", x["dst"], x["edge_type"])), ",").alias("neighbors"), "degree")


@query(sql(f"WITH d AS ({_DIR}) SELECT src, dst, edge_type, round(weight, 6) AS weight, row_number() OVER (PARTITION BY src ORDER BY abs(weight) DESC, dst, edge_type) AS rank FROM d WHERE abs(weight) >= 0.3 AND edge_type IN ('hedge', 'correlation') QUALIFY rank <= 10", "edges"))
def neighbors(spark, d):
    return rounded(graph.neighbors(_edges(spark, d), None, 0.3, 10, ["hedge", "correlation"]))


@query(sql("""WITH n AS (SELECT *, market_a AS src, market_b AS dst FROM edges UNION ALL SELECT *, market_b, market_a FROM edges), k AS (SELECT src, row_number() OVER (PARTITION BY src ORDER BY user_count DESC, abs(weight) DESC, dst, edge_type) AS rank, dst, edge_type, weight, user_count FROM n WHERE abs(weight) >= 0.3 AND user_count >= 1 QUALIFY rank <= 5)
SELECT src, rank, dst, edge_type, round(weight, 6) AS weight, user_count, (sum(user_count) OVER (PARTITION BY src))::BIGINT AS users_total, user_count || ' users linked these markets (' || edge_type || ')' AS reason, question, end_us FROM k LEFT JOIN (SELECT 'm' || lpad(id, 7, '0') AS market, question, end_us FROM meta) m ON dst = market""", "edges", "meta"))
def suggestions(spark, d):
    known = tables.metadata(spark, d).select(F.concat(F.lit("m"), F.lpad("id", 7, "0")).alias("market"), "question", "end_us")
    return rounded(graph.suggestions(_edges(spark, d), known, 5, 1))


@query(sql("SELECT market_a, market_b, edge_type, round(weight, 6) AS weight FROM edges WHERE weight > 0.1 AND edge_type = 'hedge' ORDER BY round(weight, 6) DESC, market_a, market_b LIMIT 100", "edges"))
def top_edges(spark, d):
    rows = _edges(spark, d).where("weight > 0.1 and edge_type = 'hedge'").orderBy(F.desc(F.round("weight", 6)), "market_a", "market_b").limit(100)
    return rounded(rows.select("market_a", "market_b", "edge_type", "weight"))


@query(sql("SELECT signal_source, edge_type, count(*) AS n, min(created_us) AS oldest_us, max(created_us) AS newest_us FROM signals GROUP BY 1, 2", "signals"))
def signal_counts(spark, d):
    return graph.signal_counts(tables.edge_signals(spark, d))


_HOPS = ", ".join(f"h{i} AS (SELECT dst AS market, min(list_append(path, dst)) AS path FROM k JOIN h{i - 1} ON src = market WHERE dst NOT IN ({' UNION ALL '.join(f'SELECT market FROM h{j}' for j in range(i))}) GROUP BY 1)" for i in range(1, 4))


@query(sql(f"WITH d AS ({_DIR}), k AS (SELECT DISTINCT src, dst FROM d WHERE weight > 0.1), h0 AS (SELECT '{_FROM}' AS market, ['{_FROM}'] AS path), {_HOPS} " + " UNION ALL ".join(f"SELECT market, {i} AS dist, array_to_string(path, '->') AS path FROM h{i}" for i in range(4)), "edges"))
def n_hop(spark, d):
    return graph.n_hop(_loaded(spark, d), _FROM, 3, 0.0).select("market", "dist", F.array_join("path", "->").alias("path"))


@query(sql(f"""WITH RECURSIVE d AS ({_DIR}), k AS (SELECT src, dst, 1 / (1 + max(weight)) AS cost, arg_max(edge_type, (weight, edge_type)) AS kind FROM d WHERE weight > 0.1 AND edge_type IN ('correlation', 'hedge', 'causal') GROUP BY 1, 2),
w(market, dist, path, types, hops) AS (SELECT '{_FROM}', 0e0, ['{_FROM}'], []::VARCHAR[], 0 UNION ALL SELECT dst, b.dist, b.path, b.types, hops FROM (SELECT dst, hops + 1 AS hops, min({{d: round(dist + cost, 12), path: list_append(path, dst), types: list_append(types, kind), dist: dist + cost}}) AS b FROM w JOIN k ON src = market WHERE hops < 8 GROUP BY dst, hops))
SELECT market, round(b.dist, 6) AS dist, array_to_string(b.path, '->') AS path, array_to_string(b.types, ',') AS types FROM (SELECT market, min({{d: round(dist, 12), path: path, types: types, dist: dist}}) AS b FROM w GROUP BY 1)""", "edges"))
def shortest_path(spark, d):
    """From one market to every other over edges of three types."""
    found = graph.shortest_distances(_loaded(spark, d), _FROM, 0.0, ["correlation", "hedge", "causal"])
    return rounded(found.select("market", "dist", F.array_join("path", "->").alias("path"), F.array_join("types", ",").alias("types")))


@query(sql(f"""WITH RECURSIVE d AS ({_DIR}), l AS (SELECT src, dst, edge_type, CASE WHEN edge_type = 'arbitrage' THEN greatest(0, exp(weight) - 1) * 10000 ELSE greatest(0, exp(weight) - 1.8) * 1000 END AS gain FROM d WHERE edge_type IN ('arbitrage', 'correlation') AND weight >= 0.5),
p AS (SELECT '{_FROM}' AS cur, ['{_FROM}'] AS path, []::VARCHAR[] AS types, 0e0 AS bps UNION ALL SELECT dst, list_append(path, dst), list_append(types, edge_type), bps + gain FROM p JOIN l ON src = cur WHERE NOT list_contains(path, dst) AND len(path) <= {PATH_LINKS})
SELECT array_to_string(path, '->') AS path, array_to_string(types, ',') AS types, round(bps) AS bps FROM p WHERE len(path) >= 3 AND round(bps) > 0 ORDER BY round(bps) DESC, array_to_string(path, '->'), array_to_string(types, ',') LIMIT 100""", "edges"))
def arbitrage_paths(spark, d):
    return graph.arbitrage_paths(_loaded(spark, d), _FROM, PATH_LINKS, 0.5, 100)


_LINKS = f"""d AS ({_DIR}), l AS MATERIALIZED (SELECT src, dst, (arg_min(edge_type, (w, edge_type)) = 'hedge')::INT AS h, min(w) AS w FROM (SELECT *, CASE WHEN edge_type = 'hedge' THEN -abs(weight) ELSE weight END AS w FROM d WHERE weight > 0.1) GROUP BY 1, 2)"""
# two links from a cycle's smallest market on
_CYC = f"""{_LINKS}, h2 AS (SELECT x.src AS s, x.dst AS m, y.dst AS t, x.w + y.w AS w, x.h + y.h AS h FROM l x JOIN l y ON x.dst = y.src WHERE x.dst > x.src AND y.dst > x.src),
c AS (SELECT concat_ws('->', s, m, t) AS cycle, 3 AS n, a.w + l.w AS total, a.h + l.h AS h FROM h2 a JOIN l ON t = src AND s = dst WHERE m < t
UNION ALL SELECT concat_ws('->', s, a.m, t, b.m), 4, a.w + b.w, a.h + b.h FROM h2 a JOIN h2 b USING (s, t) WHERE a.m < b.m)"""
_KIND = "CASE WHEN h * 2 > n THEN 'hedge_loop' ELSE 'inverse_correlation' END AS kind"
#: The longest cycles of the exhaustive queries; longer ones, up to the other length, only from this bad on.
ALL_CYCLES, DEEP_CYCLES, DEEP_BELOW = 4, 6, -5.0


def _cycles(spark, d, longest: int, *bar):
    """Cycles of the edges above the weight, whose markets go by number where names are
    digits: numbers have the names' order and aggregate without a sort."""
    keys = tables.read(spark, d, "lineitem").agg(F.least(F.min("l_partkey"), F.min("l_suppkey"), F.min("l_linenumber")).alias("least")).first()
    plain = keys.least is not None and keys.least >= 0
    signals = tables.edge_signals(spark, d, placed=True, numbered=plain)
    edges = graph.edge_weights(signals, AS_OF, order="place", by=["market_a", "market_b"])
    return graph.negative_cycles(edges.select("market_a", "market_b", "edge_type", "weight"), longest, LOADED, *bar, name=tables.market_name if plain else None)


@query(sql(f"WITH {_CYC} SELECT cycle, n, round(total, 6) AS total, {_KIND} FROM c WHERE total < 0", "edges"))
def negative_cycles(spark, d):
    return rounded(_cycles(spark, d, ALL_CYCLES))


# the least sum of one to three links from a market bounds what a half path can still gain
_DEEP = f"""{_LINKS}, b1 AS (SELECT src AS v, min(w) AS b FROM l GROUP BY 1), b2 AS (SELECT src AS v, min(w + b) AS b FROM l JOIN b1 ON dst = v GROUP BY 1), b3 AS (SELECT src AS v, min(w + b) AS b FROM l JOIN b2 ON dst = v GROUP BY 1),
h2 AS MATERIALIZED (SELECT x.src AS s, x.dst AS m, y.dst AS t, x.w + y.w AS w, x.h + y.h AS h FROM l x JOIN l y ON x.dst = y.src WHERE x.dst > x.src AND y.dst > x.src),
bs AS MATERIALIZED (SELECT v, b2.b AS two, b3.b AS three FROM b2 JOIN b3 USING (v)),
h3 AS MATERIALIZED (SELECT s, m, t AS k, dst AS t, h2.w + l.w AS w, h2.h + l.h AS h FROM h2 JOIN l ON t = src JOIN bs e ON e.v = dst JOIN bs f ON f.v = s WHERE dst > s AND dst <> m AND h2.w + l.w + least(greatest(e.two, f.two), greatest(e.three, f.three)) < {DEEP_BELOW}),
c AS (SELECT concat_ws('->', s, a.m, a.k, t, b.m) AS cycle, 5 AS n, a.w + b.w AS total, a.h + b.h AS h FROM h3 a JOIN h2 b USING (s, t) WHERE a.m < b.m AND a.k <> b.m
UNION ALL SELECT concat_ws('->', s, a.m, a.k, t, b.k, b.m), 6, a.w + b.w, a.h + b.h FROM h3 a JOIN h3 b USING (s, t) WHERE a.m < b.m AND a.k <> b.m AND a.k <> b.k AND a.m <> b.k)"""


@query(sql(f"WITH {_DEEP} SELECT cycle, n, round(total, 6) AS total, {_KIND} FROM c WHERE total < {DEEP_BELOW}", "edges"))
def deep_negative_cycles(spark, d):
    """Cycles of five and six markets, of which there are too many to list all."""
    return rounded(_cycles(spark, d, DEEP_CYCLES, DEEP_BELOW, ALL_CYCLES + 1))


@query(sql(f"WITH {_LINKS} SELECT count_if(w < 0) > 0 AS found, count_if(w < 0) // 2 AS pairs FROM l", "edges"))
def has_negative_cycle(spark, d):
    return graph.has_negative_cycle(_loaded(spark, d), LOADED)


@query(sql(f"WITH {_CYC} SELECT md5(cycle) AS cycle_id, cycle, {_KIND}, CASE WHEN total < -2 THEN 'high' ELSE 'normal' END AS severity, {AS_OF} AS detected_us FROM c WHERE total < 0", "edges"))
def cycle_alerts(spark, d):
    return graph.cycle_alerts(_cycles(spark, d, ALL_CYCLES), AS_OF)


@query(sql(f"WITH d AS ({_DIR}), g AS (SELECT src, count(*) AS d FROM d GROUP BY 1) SELECT count(*) AS vertices, sum(d)::BIGINT AS directed_edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, (SELECT count_if(edge_type = 'correlation') FROM edges) AS correlation, (SELECT count_if(edge_type = 'hedge') FROM edges) AS hedge, (SELECT count_if(edge_type = 'causal') FROM edges) AS causal, (SELECT count_if(edge_type = 'arbitrage') FROM edges) AS arbitrage FROM g", "edges"))
def graph_stats(spark, d):
    return rounded(graph.graph_stats(_edges(spark, d)))


def _labels(rounds: int = 12) -> str:
    """Smallest labels passed to neighbours a number of times; random graphs of
    the given sizes settle in fewer."""
    steps = [f"r{i} AS MATERIALIZED (SELECT v AS id, min(least(r.m, o.m)) AS m FROM (SELECT r.id AS v, r.m, k.b FROM r{i - 1} r JOIN k ON k.a = r.id) r JOIN r{i - 1} o ON o.id = r.b GROUP BY v)" for i in range(1, rounds + 1)]
    return "k AS MATERIALIZED (SELECT market_a AS a, market_b AS b FROM edges WHERE weight > 0.1 UNION SELECT market_b, market_a FROM edges WHERE weight > 0.1), r0 AS (SELECT DISTINCT a AS id, a AS m FROM k), " + ", ".join(steps)


@query(sql(f"WITH {_labels()} SELECT id, m AS component, (SELECT count(DISTINCT m) FROM r12) AS components FROM r12", "edges"))
def connected_components(spark, d):
    lines = tables.read(spark, d, "lineitem")
    known = lines.agg(F.count(F.lit(1)).alias("rows"), (F.least(F.min("l_partkey"), F.min("l_suppkey"), F.min("l_linenumber")) >= 0).alias("plain")).first()
    # by number where names are digits: numbers have the names' order and aggregate without a sort
    signals = tables.edge_signals(spark, d, placed=True, numbered=bool(known.plain))
    kept = graph.edges_above(signals, AS_OF, LOADED, order="place", rows=known.rows)
    found = dense_components(kept.select(F.col("market_a").alias("a"), F.col("market_b").alias("b")))
    total = found.agg(F.countDistinct("component").alias("components"))
    named = found.selectExpr(*[f"{tables.market_name(c)} AS {c}" for c in found.columns]) if known.plain else found
    return named.join(F.broadcast(total))
