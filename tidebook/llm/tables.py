"""Reading the corpus tables and patterns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The most bytes of values that are sent to every executor.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(key: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value, at least."""
    value = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return 8 * F.coalesce(F.size(value), F.lit(0)) + 16
    return F.lit(8 * len(kind) if isinstance(kind, T.StructType) else 8)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its values take at most ``most`` bytes.

    ``df`` must be cheap to read (a scan of a written table of plain values and
    of arrays of numbers). Past the limit Spark joins by shuffle, which has no
    bound on either side.
    """
    held = sum((_width(f"`{f.name}`", f.dataType) for f in df.schema), F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(held)).first()[0] or 0) <= most else df


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns as c0, c1, ..., and which is which, so that columns
    which an operator adds can't meet the caller's. No operator has such names."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), names


def together(df: DataFrame, names: dict[str, str], *added: str, **new: Column) -> DataFrame:
    """The caller's columns again, some replaced by ``new``, then the ``added`` ones."""
    return df.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()], *added)
