"""Roll-ups: documents, pages, backends, batches, benchmarks, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_exact(c: Column, scale: int = 12) -> Column:
    """Average that doesn't depend on the order of the rows: summed as decimals, divided once."""
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double") / F.count(c)


def score_summary(post: DataFrame, pre: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: averages of the score dimensions, counts of decisions, totals of issues, source complexity.

    Both sides are aggregated before they are joined. Keys without post scores have no row; without pre scores complexity 0.
    """
    dims = {
        "document_quality": "overall_score", "document_confidence": "confidence", "avg_placeholder_preservation": "placeholder_score",
        "avg_numeric_accuracy": "numeric_score", "avg_format_preservation": "format_score", "avg_fluency": "fluency_score", "avg_fidelity": "fidelity_score"
    }
    g = post.groupBy(*keys).agg(
        *[mean_exact(F.col(c)).alias(k) for k, c in dims.items()],
        F.count("*").alias("blocks_total"), F.count_if("acceptable").alias("blocks_acceptable"), F.count_if("needs_review").alias("blocks_need_review"),
        F.count_if("needs_retry").alias("blocks_need_retry"),
        F.sum(F.size("issues")).alias("total_issues"), F.sum(F.size("warnings")).alias("total_warnings"),
    )
    p = pre.groupBy(*keys).agg(
        mean_exact(F.col("complexity_score")).alias("avg_source_complexity"), F.count_if(F.col("complexity_score") > 0.6).alias("complex_blocks")
    )
    return g.join(p, keys, "left").withColumn(
        "acceptance_rate", F.col("blocks_acceptable") / F.col("blocks_total")
    ).fillna({"avg_source_complexity": 0.0, "complex_blocks": 0})


def health_summary(health: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status, mean score and share of healthy blocks of each key."""
    return health.groupBy(*keys).agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_blocks") for s in ("ok", "warning", "failed")], F.count("*").alias("total_blocks"),
        mean_exact(F.col("score")).alias("mean_score"), (F.count_if(F.col("status") == "ok") / F.count("*")).alias("health_ratio")
    )


def label_histogram(df: DataFrame, labels: str, name: str) -> DataFrame:
    """(label, n) of an array column of labels; what follows a colon is left out."""
    return df.select(F.explode(labels).alias("__l")).groupBy(F.substring_index("__l", ":", 1).alias(name)).agg(F.count("*").alias("n"))


def dominant(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, value, n): the most frequent value of each key; of equally frequent ones the first in ``order``. Nulls don't count."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "__first")
    return g.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__first")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, upper_median): the element at half the length of the sorted values, counted from 0. By a rank, not a collected list."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.filter(F.col(value).isNotNull())
    n = d.groupBy(*keys).agg(F.count("*").alias("__n"))
    return d.select(
        *keys, value, F.row_number().over(w).alias("__r")
    ).join(n, keys).filter("__r = floor(__n / 2) + 1").select(*keys, F.col(value).alias("upper_median"))


def batch_numbers(position: Column, total: Column) -> Column:
    """Number from 1 of the progressive batch of a block at a position from 1: batches of 32, from block 225 of 64, from 545 of 96; under 32 blocks one batch."""
    i = position - 1
    b = F.when(i < 224, F.floor(i / 32)).when(i < 544, 7 + F.floor((i - 224) / 64)).otherwise(12 + F.floor((i - 544) / 96))
    return F.when(total < 32, F.lit(1)).otherwise((b + 1).cast("int"))


def improvement(base: Column, value: Column) -> Column:
    """Improvement in per cent; null for a base of 0."""
    return F.when(base != 0, F.try_divide(value - base, base) * 100)


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_difference, t) of paired values; t null for fewer than two pairs or equal differences. Sums are decimals, so that the order of the rows doesn't matter."""
    d = F.col(a) - F.col(b)
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    g = df.select(d.alias("d")).filter("d is not null").agg(F.count("*").alias("n"), exact(F.col("d")).alias("s1"), exact(F.col("d") * F.col("d")).alias("s2"))
    n = F.col("n").cast("double")
    mean, var = F.try_divide(F.col("s1"), n), F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), n), n - 1)
    return g.select("n", mean.alias("mean_difference"), var.alias("var")).select(
        "n", "mean_difference",
        F.when(F.col("var") > 0, F.try_divide(F.col("mean_difference"), F.sqrt(F.col("var")) / F.sqrt(F.col("n").cast("double")))).alias("t")
    )


def described(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, deviation, lowest, highest) of the values that aren't null; the sample deviation is null for one value. Sums are decimals."""
    v = F.col(value)
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    g = df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), exact(v).alias("s1"), exact(v * v).alias("s2"), F.min(v).alias("lowest"), F.max(v).alias("highest")
    )
    n = F.col("n").cast("double")
    spread = F.try_divide(F.col("s2") - F.try_divide(F.col("s1") * F.col("s1"), n), n - 1)
    return g.select(
        *keys, "n", F.try_divide(F.col("s1"), n).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), spread))).alias("deviation"), "lowest",
        "highest"
    )


def base_style(spans: DataFrame) -> DataFrame:
    """(doc_id, block_id, font, color, size) from spans with ``h``, whether their block is a header.

    Headers take font and size of their largest span (the first of them), other blocks the dominant font and the mean size;
    all take the dominant colour. Spans without a font, colour or size don't count for it.
    """
    block, order = ["doc_id", "block_id"], ["line_no", "span_no", "span_id"]
    size = F.col("size")
    g = spans.groupBy(*block).agg(
        F.bool_or("h").alias("h"), F.max(size).alias("hi"), (F.sum(size.cast("decimal(20,6)")).cast("double") / F.count(size)).alias("mean")
    )
    largest = Window.partitionBy(*block).orderBy(F.desc("size"), *order)
    top = spans.filter(size.isNotNull()).select(*block, F.col("font").alias("top"), F.row_number().over(largest).alias("r")).filter("r = 1").drop("r")
    j = g.join(dominant(spans, block, "font", order).drop("n"), block, "left").join(
        dominant(spans, block, "color", order).drop("n"), block, "left"
    ).join(top, block, "left")
    return j.select(
        *block, F.when(F.col("h"), F.col("top")).otherwise(F.col("font")).alias("font"), "color",
        F.when(F.col("h"), F.col("hi")).otherwise(F.col("mean")).alias("size")
    )
