"""Schemas, readers and writers of stage artifacts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = f"struct<text:string,bbox:{BOX},style:struct<font:string,size:double,flags:int,color:int>>"
#: A page block as one row.
BLOCKS = (
    f"doc_id string, page_no int, page_width double, page_height double, block_no int, block_id string, type string, bbox {BOX}, lines "
    f"array<struct<spans:array<{SPAN}>,bbox:{BOX}>>, is_header boolean, block_type string, region string"
)
STAGES = ("parsed", "masked", "pre_scores", "translations", "post_scores", "health", "overlap", "report")


def read_blocks(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Layout records (JSON, one block a line) with a fixed schema; ``pattern`` filters the file names of a folder."""
    r = spark.read.schema(BLOCKS)
    return (r.option("pathGlobFilter", pattern) if pattern else r).json(path)


def write_stage(df: DataFrame, folder: str, stage: str) -> None:
    """Write one stage's table, replacing that of an earlier run."""
    if stage not in STAGES:
        raise ValueError(f"{stage} is no stage")
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")


def read_stage(spark: SparkSession, folder: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{stage}")


def read_glossary(spark: SparkSession, path: str, domain: str = "general") -> DataFrame:
    """(source, target, domain, case_sensitive, load_seq) of JSON files, each a map or an object with the map under ``terms``."""
    raw = spark.read.text(path, wholetext=True)
    m = "map<string,string>"
    terms = F.coalesce(F.from_json(F.get_json_object("value", "$.terms"), m), F.from_json("value", m))
    return raw.select(F.explode(terms).alias("source", "target")).select(
        "source", "target", F.lit(domain).alias("domain"), F.lit(False).alias("case_sensitive"), F.lit(0).alias("load_seq")
    )


def write_glossary(df: DataFrame, path: str, domain: str | None = None) -> None:
    """The terms of a merged glossary (of one domain, where it is given) as one JSON object with the map under ``terms``, in order; read_glossary reads it."""
    g = df if domain is None else df.filter(F.col("domain") == domain)
    pairs = F.sort_array(F.collect_list(F.struct("source", "target")))
    one = g.filter(F.col("source").isNotNull()).dropDuplicates(["source"]).agg(F.to_json(F.struct(F.map_from_entries(pairs).alias("terms"))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


MEMORY = "pair string, text string, translation string, quality double, uses bigint, created_at timestamp"


def write_memory(df: DataFrame, path: str) -> None:
    """A translation memory, one file set for each language pair, replacing an earlier one."""
    names = [f.split()[0] for f in MEMORY.split(", ")]
    df.select(*names).repartition("pair").write.mode("overwrite").partitionBy("pair").parquet(path)


def read_memory(spark: SparkSession, path: str, pair: str | None = None) -> DataFrame:
    """A translation memory, or that of one language pair, of which only the files are read."""
    m = spark.read.schema(MEMORY).parquet(path)
    return m if pair is None else m.filter(F.col("pair") == pair)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, n_bytes, modified_at) of the files below a folder whose name fits the pattern, without their contents."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return f.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at")
    )


def read_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The runs' report.json below a folder, with the run (the name of its folder)."""
    r = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/report.json")
    return r.select("*", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("run"))


def block_type(raw_type: Column) -> Column:
    """Kind of a block of the scanner: 1 is an image, everything else (null too) text."""
    return F.when(raw_type == 1, "image").otherwise("text")


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of lines such as ``export NAME="value"``; remarks and other lines left out."""
    p = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#\s]*))"
    v = F.col("value")
    got = F.concat(*[F.regexp_extract(v, p, g) for g in (2, 3, 4)])
    return spark.read.text(path).filter(v.rlike(p)).select(F.regexp_extract(v, p, 1).alias("name"), got.alias("value"))


def translations_json(df: DataFrame, keys: list[str], metadata: Column | None = None) -> DataFrame:
    """(keys, json): the translated blocks of each document in order as one JSON text; ``df`` has block_no, block_id, source_text, translated_text."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_no", "block_id", "source_text", "translated_text"))).alias("translations"))
    return g.select(*keys, F.to_json(F.struct(*([metadata.alias("metadata")] if metadata is not None else []), "translations")).alias("json"))


def latex_lines(df: DataFrame, text_col: str = "translated_text") -> DataFrame:
    """(value): a paragraph of escaped text for each row, to be written with ``write.text``."""
    return df.select(F.concat(T.latex_escaped(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\n")).alias("value"))


def write_summary(df: DataFrame, folder: str) -> None:
    """A summary as JSON and as CSV with a header."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_table(df: DataFrame, folder: str, caption: str = "") -> None:
    """A small result table as CSV with a header and as a LaTeX table, rows in the order of the first column."""
    rows = df.orderBy(df.columns[0])
    rows.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    cell = lambda c: T.latex_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    n = len(df.columns)
    lines = rows.select(F.concat(F.concat_ws(" & ", *[cell(c) for c in df.columns]), F.lit(r" \\")).alias("value"))
    head = [r"\begin{table}", r"\begin{tabular}{" + "l" * n + "}", " & ".join(c.replace("_", r"\_") for c in df.columns) + r" \\ \hline"]
    foot = [r"\end{tabular}", rf"\caption{{{caption}}}", r"\end{table}"]
    wrap = lambda k, ls: df.sparkSession.createDataFrame([(k, i, x) for i, x in enumerate(ls)], "part int, i bigint, value string")
    body = lines.select(F.lit(1).alias("part"), F.monotonically_increasing_id().alias("i"), "value")
    wrap(0, head).union(body).union(wrap(2, foot)).orderBy("part", "i").select("value").coalesce(1).write.mode("overwrite").text(f"{folder}/latex")


def write_json_export(df: DataFrame, path: str) -> None:
    translations_json(df, ["doc_id"]).select("json").write.mode("overwrite").text(path)


def write_latex_export(df: DataFrame, path: str) -> None:
    latex_lines(df.orderBy("doc_id", "block_no")).write.mode("overwrite").text(path)


#: Writers of translations by format; ``df`` has doc_id, block_no, block_id, source_text, translated_text.
EXPORTS = {"json": write_json_export, "latex": write_latex_export}


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Write translations in a format of EXPORTS; others are refused."""
    if fmt not in EXPORTS:
        raise ValueError(f"{fmt} is none of {', '.join(EXPORTS)}")
    EXPORTS[fmt](df, path)
