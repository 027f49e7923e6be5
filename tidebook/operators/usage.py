"""API usage by billing cycle and calls over the limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Calls a minute by tier and kind of endpoint (fixed values).
LIMITS = {"free": {"data": 60, "admin": 15}, "pro": {"data": 120, "admin": 30}, "enterprise": {"data": 600, "admin": 120}}


def usage_by_cycle(usage: DataFrame) -> DataFrame:
    cycle = F.date_format(F.timestamp_micros("us"), "yyyy-MM").alias("billing_cycle")
    return usage.groupBy("api_key_hash", "tier", "endpoint", cycle).agg(F.count(F.lit(1)).alias("requests"), F.sum("rows_returned").alias("rows"))


def with_endpoint_type(usage: DataFrame) -> DataFrame:
    path = F.col("endpoint")
    admin = F.col("method").isin("POST", "PUT", "DELETE") | (path.contains("/triggers") & ~path.contains("/events")) | path.contains("/lifecycle") | path.contains("/admin")
    return usage.withColumn("kind", F.when(admin, "admin").otherwise("data"))


def rate_limit_breaches(usage: DataFrame) -> DataFrame:
    """Calls of each key, kind and minute against the tier's limit."""
    limit = F.coalesce(*[F.when((F.col("tier") == t) & (F.col("kind") == k), n) for t, by in LIMITS.items() for k, n in by.items()])
    minute = (F.floor(F.col("us") / 60_000_000) * 60_000_000).alias("minute_us")
    calls = with_endpoint_type(usage).groupBy("api_key_hash", "tier", "kind", minute).agg(F.count(F.lit(1)).alias("calls"))
    return calls.withColumn("max_calls", limit).withColumn("remaining", F.greatest(F.lit(0), F.col("max_calls") - F.col("calls"))).withColumn("over", F.greatest(F.lit(0), F.col("calls") - F.col("max_calls")))


def rejected_calls(usage: DataFrame) -> DataFrame:
    """The calls themselves that come after a minute's limit is used up."""
    minute = F.floor(F.col("us") / 60_000_000)
    w = Window.partitionBy("api_key_hash", "kind", minute).orderBy("us", "request_id")
    limit = F.coalesce(*[F.when((F.col("tier") == t) & (F.col("kind") == k), n) for t, by in LIMITS.items() for k, n in by.items()])
    return with_endpoint_type(usage).withColumn("nth", F.row_number().over(w)).where(F.col("nth") > limit)
