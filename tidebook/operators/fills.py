"""On-chain fills to trades and minute rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1_000_000
MINUTE_US = 60_000_000


def fills_to_trades(fills: DataFrame) -> DataFrame:
    """Typed trades; the side with asset id 0 is the stable coin."""
    coin = F.col("maker_asset_id") == "0"
    amount = lambda a, b: F.when(coin, F.col(a)).otherwise(F.col(b)).cast("long") / SCALE
    rows = fills.where("is_deleted = 0").select(
        "id", "maker", "taker", F.when(coin, F.col("taker_asset_id")).otherwise(F.col("maker_asset_id")).alias("asset_id"),
        amount("taker_amount_filled", "maker_amount_filled").alias("shares"), amount("maker_amount_filled", "taker_amount_filled").alias("usdc"),
        F.when(coin, "SELL").otherwise("BUY").alias("side"), (F.col("fee").cast("long") / SCALE).alias("fee"), (F.col("timestamp").cast("long") * 1_000_000).alias("us"),
    )
    return rows.withColumn("price", F.when(F.col("shares") > 0, F.col("usdc") / F.col("shares")))


def _minute():
    return (F.floor(F.col("us") / MINUTE_US) * MINUTE_US).alias("minute_us")


def user_minute_rollup(trades: DataFrame, user: str) -> DataFrame:
    return trades.groupBy(user, "asset_id", _minute()).agg(F.count(F.lit(1)).alias("trades"), F.sum("usdc").alias("usdc"))


def market_minute_rollup(trades: DataFrame) -> DataFrame:
    return trades.groupBy("asset_id", _minute()).agg(F.count(F.lit(1)).alias("trades"), F.count_if(F.col("side") == "BUY").alias("buys"), F.count_if(F.col("side") == "SELL").alias("sells"), F.sum("usdc").alias("usdc"), F.sum("shares").alias("shares"), F.sum("fee").alias("fees"))


def rollup_merge(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial rollups summed by key."""
    sums = [c for c in partials.columns if c not in keys]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
