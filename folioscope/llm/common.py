"""Helpers of the text operators: Arrow batches in and out, registers of languages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources import read_table, ship_package

__all__ = ["LATIN_LANGS", "bounded_sample", "code_lookup", "map_arrow", "newest", "read_table", "ship_package"]

#: Languages of Latin script that word statistics must tell apart.
LATIN_LANGS = ("en", "fr", "de", "es", "pt", "it", "nl")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; a batch that gives None gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, size: int) -> list:
    """At most ``size`` rows of a table with an id, one for each id, those first in the order of a hash of the id; about twice as many move at most."""
    n = df.select("id").distinct().count()
    if n > 2 * size:
        df = df.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.3 * size / n)))
    return df.dropDuplicates(["id"]).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id").limit(size).collect()


def newest(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: rows delivered again count once (they repeat the first delivery's values)."""
    return df.dropDuplicates([key])


def code_lookup(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Lower-case notation of a language -> code, from the fixed table lang_codes (13 rows)."""
    out = {}
    for r in read_table(spark, sf_dir, "lang_codes").collect():
        for x in (r.code, r.code3, r.english_name, r.native_name):
            if x:
                out[x.strip().lower()] = r.code
    return out


def language_code(col, lookup: dict[str, str]):
    """Column: the code that a loosely written language value denotes (name, ISO code, code with region), else null."""
    m = F.create_map(*[F.lit(x) for kv in sorted(lookup.items()) for x in kv])
    v = F.lower(F.trim(col))
    return F.coalesce(
        F.element_at(m, v), F.when(v.rlike("^[a-z]{2,3}[-_][a-z0-9]{2,4}$"), F.element_at(m, F.substring_index(F.translate(v, "_", "-"), "-", 1)))
    )
