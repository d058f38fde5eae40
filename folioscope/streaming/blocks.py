"""Streams of blocks (an extension of this library): scoring without state, expiry of repeated keys, upserts into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scoring as S
from folioscope.operators.lookups import upserted


def block_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the pre-score columns; stateless, so any output mode works."""
    f = S.pre_flags(F.col(text_col))
    d = stream.select("*", *[v.alias(k) for k, v in f.items()])
    return d.withColumn("complexity_score", S.complexity({k: F.col(k) for k in f}))


def first_within(stream: DataFrame, key: str, time: str, ttl: str) -> DataFrame:
    """Drop rows whose key came less than ``ttl`` before; state expires with the watermark."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, label: str, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, label, n) by event time; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), label).agg(F.count("*").alias("n"))


#: Buckets that the keys of a state are hashed to.
BUCKETS = 64


def _bucket(keys: list[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> batch that wrote it last (before a batch, where it is given); empty for a state that doesn't exist."""
    try:
        m = spark.read.schema("bucket int, written int, epoch int").parquet(f"{path}/manifest")
        m = m if before is None else m.filter(F.col("epoch") < before)
        last = m.agg(F.max("epoch")).first()[0]
    except AnalysisException:
        return {}
    return {} if last is None else {r.bucket: r.written for r in m.filter(F.col("epoch") == last).collect()}  # at most BUCKETS rows


def read_state(spark: SparkSession, path: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows of a state, or of some of its buckets; None where there are none."""
    at = {b: e for b, e in _manifest(spark, path, before).items() if buckets is None or b in buckets}
    return spark.read.parquet(*[f"{path}/rows/epoch={e}/bucket={b}" for b, e in sorted(at.items())]) if at else None


def upsert_into(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one row for each key, the last in ``order``, under ``path``; :func:`read_state` reads them.

    Keys are hashed to BUCKETS buckets, and a batch rewrites those that it touches only. A manifest names the batch that wrote
    each bucket last; it is written at the end, so that a batch that fails and runs again, or any gap in the batches' numbers,
    changes nothing else. A batch run twice gives the same rows.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("__b", _bucket(keys))
        touched = sorted(r[0] for r in new.select("__b").distinct().collect())  # at most BUCKETS rows
        if not touched:
            return
        old = read_state(spark, path, touched, epoch)
        both = upserted(batch.limit(0) if old is None else old.select(*batch.columns), batch, keys, order)
        both.withColumn("bucket", _bucket(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/epoch={epoch}")
        at = _manifest(spark, path, epoch) | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(at.items()), "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/epoch={epoch}")

    return put
