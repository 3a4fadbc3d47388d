"""Tables, scratch space and bounded samples that the operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs in this
    one process (as in tests) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; it goes when the driver ends."""
    at = f"{shared_dir(spark)}/kinweave-{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    at = new_path(spark, name)
    schema = df.schema
    df.write.parquet(at)
    return spark.read.schema(schema).parquet(at)


@atexit.register
def _sweep() -> None:
    for spark, at in _written:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone
            return


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ident(df: DataFrame, id_col: str) -> Column:
    """A row's id as a 64-bit number if ids are whole numbers, as text if they are anything else."""
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    return F.col(id_col).cast("long" if whole else "string")


def chance(id_col: str, salt: int = 11) -> Column:
    """A number from 0 to 1 that is fixed for each id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def bounded_sample(rows: DataFrame, label: str, id_col: str, per_label: int, most: int | None = None) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id, so always the same.

    Each label's rate is ``per_label`` over its number of rows (1 at most). With ``most``, labels
    share that many rows: so many labels that it isn't enough get fewer each. The row of each label
    whose hash is least is taken at any rate, so every label has one. The rates are one row a label;
    they are broadcast while there are 100,000 labels at most.
    """
    counts = settle(rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__kw_of")).agg(F.count(F.lit(1)).alias("count"), F.min(chance(id_col)).alias("__kw_least")), "labels")
    labels = counts.count()
    each = per_label if most is None else max(1, min(per_label, most // max(labels, 1)))
    rates = counts.select("__kw_of", "__kw_least", (F.lit(float(each)) / F.col("count")).alias("__kw_rate"))
    rates = F.broadcast(rates) if labels <= 100_000 else rates
    return rows.join(rates, F.col(label) == F.col("__kw_of")).where((chance(id_col) < F.col("__kw_rate")) | (chance(id_col) == F.col("__kw_least"))).drop("__kw_of", "__kw_least", "__kw_rate")


def within(rows: DataFrame, id_col: str, size: Column, most: int, label: str | None = None) -> DataFrame:
    """Rows whose sizes are about ``most`` in sum at most: all of them, or a part chosen by a hash of the id; of each ``label`` the row with the least hash stays at any rate."""
    total = rows.agg(F.sum(size)).collect()[0][0] or 0
    if total <= most:
        return rows
    part = chance(id_col, 29) < most / total
    if label is None:
        return rows.where(part)
    least = rows.groupBy(F.col(label).alias("__kw_of")).agg(F.min(chance(id_col, 29)).alias("__kw_least"))
    return rows.join(least, F.col(label).eqNullSafe(F.col("__kw_of"))).where(part | (chance(id_col, 29) == F.col("__kw_least"))).drop("__kw_of", "__kw_least")
