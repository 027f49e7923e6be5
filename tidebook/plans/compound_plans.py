"""Queries over rules of several markets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import compound
from tidebook.plans.base_sql import sql
from tidebook.plans.registry import feed_end, query
from tidebook.sources import tables


def _rules(spark, d):
    """A rule for each market of the feed: both outcomes, in three modes."""
    m = tables.quotes(spark, d).select("condition_id").distinct().selectExpr("condition_id", "cast(substring(condition_id, 6) AS bigint) AS m")
    return m.selectExpr(
        "condition_id AS trigger_id", "element_at(array('ALL_OF', 'ANY_OF', 'N_OF_M'), cast(m % 3 + 1 AS int)) AS mode", "2 AS needed",
        "array(named_struct('asset_id', cast(2*m AS string), 'type', 'PRICE_ABOVE', 'threshold', 0.4D, 'side', 'BID'), named_struct('asset_id', cast(2*m+1 AS string), 'type', 'SPREAD_WIDE', 'threshold', 500D, 'side', cast(null AS string)), named_struct('asset_id', cast(2*m+1 AS string), 'type', 'IMBALANCE_BID', 'threshold', 0.1D, 'side', cast(null AS string))) AS conditions",
    )


def _states(spark, d):
    return compound.condition_states(tables.quotes(spark, d), _rules(spark, d))


_STATES = """s AS (SELECT condition_id AS trigger_id, (['ALL_OF','ANY_OF','N_OF_M'])[(substring(condition_id, 6)::BIGINT % 3 + 1)::INT] AS mode, 0 AS pos, source_us, event_id, coalesce(best_bid > 0.4, false) AS met FROM bbo WHERE asset_id::INT % 2 = 0
 UNION ALL SELECT condition_id, (['ALL_OF','ANY_OF','N_OF_M'])[(substring(condition_id, 6)::BIGINT % 3 + 1)::INT], 1, source_us, event_id, coalesce(spread_bps > 500, false) FROM bbo WHERE asset_id::INT % 2 = 1
 UNION ALL SELECT condition_id, (['ALL_OF','ANY_OF','N_OF_M'])[(substring(condition_id, 6)::BIGINT % 3 + 1)::INT], 2, source_us, event_id, coalesce(CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) END > 0.1, false) FROM bbo WHERE asset_id::INT % 2 = 1)"""


#: The fold as a recursion: a step for each state row of a rule, all rules at once.
_FOLD = f"""{_STATES}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY source_us, event_id, pos) AS rn FROM s),
w(trigger_id, rn, source_us, event_id, held, fires, m0, m1, m2) AS (SELECT trigger_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0, false, false, false, false FROM o WHERE rn = 1
 UNION ALL SELECT trigger_id, rn, source_us, event_id, held, held >= CASE mode WHEN 'ALL_OF' THEN 3 WHEN 'ANY_OF' THEN 1 ELSE 2 END AS fires, m0, m1, m2 FROM (
  SELECT *, m0::INT + m1::INT + m2::INT AS held FROM (SELECT o.trigger_id, o.rn, o.source_us, o.event_id, o.mode,
   CASE WHEN o.pos = 0 THEN o.met ELSE w.m0 AND NOT old END AS m0, CASE WHEN o.pos = 1 THEN o.met ELSE w.m1 AND NOT old END AS m1, CASE WHEN o.pos = 2 THEN o.met ELSE w.m2 AND NOT old END AS m2
   FROM (SELECT *, fires AS cleared FROM w) w JOIN (SELECT * FROM o) o ON o.trigger_id = w.trigger_id AND o.rn = w.rn + 1, LATERAL (SELECT w.cleared OR coalesce(o.source_us - w.source_us > 60000000, false) AS old) q)))"""


@query(sql(f"WITH RECURSIVE {_FOLD} SELECT trigger_id, source_us, event_id, held FROM w WHERE fires", "bbo"))
def compound_eval(spark, d):
    return compound.compound_eval(_states(spark, d))


@query(sql(f"WITH {_STATES}, l AS (SELECT trigger_id, mode, pos, max_by(met, (source_us, event_id)) AS met FROM s WHERE source_us <= (SELECT max(source_us) FROM bbo) - 60000000 GROUP BY 1, 2, 3) SELECT trigger_id, count_if(met) AS held, count_if(met) >= CASE mode WHEN 'ALL_OF' THEN 3 WHEN 'ANY_OF' THEN 1 ELSE 2 END AS fires FROM l GROUP BY trigger_id, mode", "bbo"))
def compound_eval_stateless(spark, d):
    return compound.compound_eval_stateless(_states(spark, d), feed_end(tables.quotes(spark, d)) - 60_000_000)


def _linked_rules(spark, d):
    """A rule for each market and the next, on both markets' first outcomes, that seldom fires."""
    m = tables.quotes(spark, d).select(F.expr("cast(substring(condition_id, 6) AS bigint)").alias("m")).distinct()
    return m.selectExpr(
        "concat('link_', m) AS trigger_id", "'ANY_OF' AS mode", "1 AS needed", "concat('u', m % 7) AS user_id", "'hedge' AS edge_type", "array(concat('cond_', m), concat('cond_', (m + 1) % 100)) AS markets",
        "transform(array(2 * m, 2 * m + 1, 2 * (m + 1) % 200, (2 * (m + 1) + 1) % 200), a -> named_struct('asset_id', cast(a AS string), 'type', 'PRICE_ABOVE', 'threshold', 0.79D, 'side', 'BID')) AS conditions",
    )


@query(sql("""WITH t AS (SELECT DISTINCT substring(condition_id, 6)::BIGINT AS m FROM bbo), a AS (SELECT m, unnest([2 * m, 2 * m + 1, 2 * (m + 1) % 200, (2 * (m + 1) + 1) % 200]) AS a FROM t),
e AS (SELECT m, source_us, event_id, coalesce(best_bid > 0.79, false)::INT AS hit FROM a JOIN bbo ON asset_id = a::VARCHAR), i AS (SELECT *, sum(hit) OVER (PARTITION BY m ORDER BY source_us, event_id) AS island FROM e),
r AS (SELECT *, sum(1 - hit) OVER (PARTITION BY m, island ORDER BY source_us, event_id) AS misses FROM i)
SELECT 'link_' || m AS trigger_id, source_us, misses::BIGINT AS misses, 'u' || (m % 7) AS user_id, 'hedge' AS edge_type, 'trigger_miss' AS signal_source, least('cond_' || m, 'cond_' || (m + 1) % 100) AS market_a, greatest('cond_' || m, 'cond_' || (m + 1) % 100) AS market_b, -0.1e0 AS strength FROM r WHERE hit = 0 AND misses % 100 = 0""", "bbo"))
def trigger_miss_decay(spark, d):
    rules = _linked_rules(spark, d)
    states = compound.condition_states(tables.quotes(spark, d), rules)
    return compound.trigger_miss_decay(states, compound.compound_eval(states), rules)
