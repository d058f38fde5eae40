"""Joins of texts with glossaries, caches and translation memories, and the anti-joins of coverage and repair."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from folioscope.operators.nearest import lcs_length, nearest, positions
from folioscope.sources import ship_package

#: Glossaries up to this many terms are broadcast and tested term by term; in larger ones texts and terms meet by a term's first
#: characters, of which every text that contains the term holds all. Both ways find the same.
BROADCAST_TERMS, GRAM = 1_000, 3
#: Parts that a group of memory texts of one language and length band is spread over.
SPREAD = 4


def merged_glossary(*glossaries: DataFrame) -> DataFrame:
    """One entry for each source in lower case; a later load_seq wins, then the smaller spelling."""
    g = glossaries[0]
    for other in glossaries[1:]:
        g = g.unionByName(other)
    key = F.lower(F.col("source"))
    w = Window.partitionBy(key).orderBy(F.desc("load_seq"), "source", "target")
    return g.filter(
        F.col("source").isNotNull() & (F.col("source") != "")
    ).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank").withColumn("term_key", key)


def _candidates(texts: DataFrame, text_col: str, glossary: DataFrame) -> DataFrame:
    """Every text with every term that it contains anywhere, letter case aside; null texts contain none."""
    low = F.lower(F.col(text_col))
    if glossary.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        return texts.join(F.broadcast(glossary), low.contains(F.col("term_key")))

    def grams(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array().cast("array<string>"))

    t = texts.withColumn("__g", F.explode(F.array_distinct(F.concat(*[grams(n) for n in range(1, GRAM + 1)]))))
    g = glossary.withColumn("__g", F.substring("term_key", 1, GRAM))
    return t.join(g, "__g").drop("__g").filter(low.contains(F.col("term_key")))


def terms_contained(texts: DataFrame, text_col: str, glossary: DataFrame) -> DataFrame:
    """Every text with every term that it contains anywhere, letter case aside."""
    return _candidates(texts, text_col, glossary)


def terms_as_words(texts: DataFrame, text_col: str, glossary: DataFrame) -> DataFrame:
    """Every text with every term that it holds between word boundaries; case counts for terms marked so."""
    c = _candidates(texts, text_col, glossary)
    quoted = F.concat(F.lit(r"\b\Q"), F.col("source"), F.lit(r"\E\b"))
    return c.filter(
        F.when(F.col("case_sensitive"), F.regexp_like(F.col(text_col), quoted)).otherwise(F.regexp_like(F.col(text_col), F.concat(F.lit("(?iu)"), quoted)))
    )


def top_terms(found: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The k longest terms of each text."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.length("source")), "term_key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def adherence(pairs: DataFrame, keys: list[str], source_col: str, target_col: str, glossary: DataFrame, anywhere: bool = False) -> DataFrame:
    """(keys, terms_found, terms_enforced, terms_violated, adherence_rate) of every pair; rate 1 where no term is found.

    Terms count as words; with ``anywhere`` wherever the source contains them, letter case aside.
    """
    f = (terms_contained if anywhere else terms_as_words)(pairs.select(*keys, source_col, target_col), source_col, glossary)
    ok = F.lower(F.coalesce(F.col(target_col), F.lit(""))).contains(F.lower("target"))
    g = f.groupBy(*keys).agg(F.count("*").alias("terms_found"), F.count_if(ok).alias("terms_enforced"))
    j = pairs.select(*keys).distinct().join(g, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *keys, zero("terms_found").alias("terms_found"), zero("terms_enforced").alias("terms_enforced"),
        (zero("terms_found") - zero("terms_enforced")).alias("terms_violated"),
        F.coalesce(F.col("terms_enforced") / F.col("terms_found"), F.lit(1.0)).alias("adherence_rate")
    )


def enforced(df: DataFrame, target_col: str, terms_col: str) -> DataFrame:
    """Add enforced_text: untranslated terms replaced by their targets, one after another.

    ``terms_col``: array of structs source, target, case_sensitive. A term whose target is there already changes nothing; the
    target takes the case of a source in capitals or in title case.
    """

    def step(t: Column, x: Column) -> Column:
        upper = (F.upper(x["source"]) == x["source"]) & (F.lower(x["source"]) != x["source"])
        title = F.initcap(x["source"]) == x["source"]
        new = F.when(upper, F.upper(x["target"])).when(title, F.initcap(x["target"])).otherwise(x["target"])
        pattern = F.concat(F.when(x["case_sensitive"], F.lit("")).otherwise(F.lit("(?iu)")), F.lit(r"\b\Q"), x["source"], F.lit(r"\E\b"))
        return F.when(F.lower(t).contains(F.lower(x["target"])), t).otherwise(F.regexp_replace(t, pattern, F.regexp_replace(new, r"([\\$])", r"\\$1")))

    return df.withColumn(
        "enforced_text",
        F.aggregate(
            F.coalesce(F.col(terms_col), F.array().cast("array<struct<source:string,target:string,case_sensitive:boolean>>")),
            F.coalesce(F.col(target_col), F.lit("")), step
        )
    )


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, version: str) -> DataFrame:
    """Add cache_status and cached candidates by cache_key: hit, miss_not_found, miss_version, miss_no_timestamp, miss_expired.

    ``cache`` has cache_key, candidates, version, created_at; of several entries of a key the newest counts.
    """
    w = Window.partitionBy("cache_key").orderBy(F.desc_nulls_last("created_at"), "version")
    c = cache.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(
        "cache_key", "candidates", F.col("version").alias("__v"), F.col("created_at").alias("__at"), F.lit(True).alias("__there")
    )
    age = F.unix_timestamp(now) - F.unix_timestamp("__at")
    status = F.when(F.col("__there").isNull(), "miss_not_found").when(
        ~F.col("__v").eqNullSafe(F.lit(version)), "miss_version"
    ).when(F.col("__at").isNull(), "miss_no_timestamp").when(age > ttl_seconds, "miss_expired").otherwise("hit")
    return requests.join(c, "cache_key", "left").withColumn("cache_status", status).withColumn(
        "cached_candidates", F.when(F.col("cache_status") == "hit", F.col("candidates"))
    ).drop("candidates", "__v", "__at", "__there")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables with one row for each key: the one that comes last in ``order``; a new row wins a tie."""
    u = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("__new"))
    return u.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / sum of the lengths; 1 for two empty texts. Bit-parallel over whole numbers."""
    return 2 * lcs_length(positions(a), len(a), b) / (len(a) + len(b)) if a or b else 1.0


def similarity(kind: str = "indel"):
    """Arrow-batched similarity of two text columns: ``indel`` (longest common subsequence) or ``sequence`` (matching blocks)."""
    from difflib import SequenceMatcher

    one = indel_ratio if kind == "indel" else lambda a, b: SequenceMatcher(None, a, b).ratio()

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return run


def comparison(context_lines: int = 3):
    """Arrow-batched comparison of a source and a translation: similarity of their lower-case forms by matching blocks, lines of the
    unified diff, and how many of these add or remove a line. Null texts are empty ones."""
    from difflib import SequenceMatcher, unified_diff

    @F.pandas_udf("similarity double, diff array<string>, added int, removed int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = x or "", y or ""
            diff = list(unified_diff(x.splitlines(), y.splitlines(), lineterm="", n=context_lines))
            changed = [d[0] for d in diff[2:]]  # behind the two lines of its head
            rows.append((SequenceMatcher(None, x.lower(), y.lower()).ratio(), diff, changed.count("+"), changed.count("-")))
        return pd.DataFrame(rows, columns=["similarity", "diff", "added", "removed"])

    return run


def fuzzy_matches(queries: DataFrame, memory: DataFrame, min_similarity: float = 0.85, k: int = 1, others: bool = False) -> DataFrame:
    """(query_id, rank, memory_id, similarity): the k most similar memory texts of each query with a similarity of at least the threshold.

    ``queries`` has query_id, pair, text; ``memory`` memory_id, pair, text, quality. No match is lost: with ratio t the lengths
    a and b satisfy min >= t / (2 - t) * max, so that partners lie in the same or the next length band, and bounds of the common
    subsequence decide before the exact ratio (see nearest.py). Ties go to the better quality, then the smaller id. Null and
    empty texts match nothing; equal texts are compared once and stand for their best row.
    With ``others`` the queries are rows of the memory (whose ids are unique), and none matches itself: of its own text the
    best other row stands.
    """
    spark = queries.sparkSession
    ship_package(spark)
    t = min_similarity
    least = t / (2 - t)
    q, m = (d.filter(F.col("text").isNotNull() & (F.col("text") != "")) for d in (queries, memory))
    band = F.floor(F.log(F.length("text").cast("double")) / F.log(F.lit(1 / least))).cast("int")
    first = Window.partitionBy("pair", "text").orderBy(F.desc_nulls_last("quality"), "memory_id")
    best = m.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= (2 if others else 1)).groupBy("pair", "text").agg(
        F.array_sort(F.collect_list(F.struct("r", "memory_id", "quality"))).alias("rows")
    )
    one, two = F.get("rows", F.lit(0)), F.get("rows", F.lit(1))
    b = best.select(  # both sides may come from one frame: a cogroup needs columns of their own
        F.col("pair").alias("in_pair"), F.col("text").alias("stored"), one["memory_id"].alias("memory_id"), one["quality"].alias("quality"), two["memory_id"].alias("next_id"),
        two["quality"].alias("next_quality"), band.alias("in_band"), F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("int").alias("in_part")
    )
    a = q.select("pair", "text").distinct().withColumn("band", F.explode(F.array(*(band + i for i in (-1, 0, 1)))))
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))  # the queries are the small side
    fields = [(c, a.schema[c]) for c in ("pair", "text")] + [(c, b.schema[c]) for c in ("memory_id", "quality", "next_id")]
    schema = StructType([StructField(c, f.dataType) for c, f in fields]).add("similarity", "double")
    none = to_arrow_schema(schema)

    def matches(x: pa.Table, y: pa.Table) -> pa.Table:
        """Matches of the texts x among y; the second row of x's own text has the first one's id in next_id, all others null."""
        if not len(x) or not len(y):
            return none.empty_table()
        texts, stored = x["text"].to_pylist(), y["stored"].to_pylist()
        ids, quality = y["memory_id"].to_pylist(), y["quality"].to_pylist()

        def tie(j: int) -> tuple:
            v = quality[j]
            return (2, 0, ids[j], j) if v is None else (0, 0, ids[j], j) if v != v else (1, -v, ids[j], j)  # Spark's order: NaN, values, null

        found = [(i, key[-1], -s) for i, some in enumerate(nearest(texts, stored, t, k, tie)) for s, key in some]
        at = {b: j for j, b in enumerate(stored)}
        found += [(i, at[a], 1.0) for i, a in enumerate(texts) if a in at]
        i, j, s = zip(*found) if found else ((), (), ())
        i, j, s = pa.array(i, "int64"), pa.array(j, "int64"), pa.array(s, "float64")
        first = [x["pair"].take(i), x["text"].take(i), y["memory_id"].take(j), y["quality"].take(j), pa.nulls(len(s), none.field("next_id").type), s]
        own = pc.and_(pc.equal(s, 1.0), pc.is_valid(y["next_id"].take(j)))
        i, j, s = i.filter(own), j.filter(own), s.filter(own)
        second = [x["pair"].take(i), x["text"].take(i), y["next_id"].take(j), y["next_quality"].take(j), y["memory_id"].take(j), s]
        return pa.concat_tables([pa.table(some, names=none.names) for some in (first, second)])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["pair", "band", "part"], ["in_pair", "in_band", "in_part"]
    a, b = (d.repartition(n, *names).groupBy(*names) for d, names in zip((a, b), keys))
    near = a.cogroup(b).applyInArrow(matches, schema)
    j = q.select("query_id", "pair", "text").join(near, ["pair", "text"])
    if others:
        j = j.filter((F.col("memory_id") != F.col("query_id")) & (F.col("next_id").isNull() | (F.col("next_id") == F.col("query_id"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("quality"), "memory_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "memory_id", "similarity")


def best_match(queries: DataFrame, memory: DataFrame, now: Column, max_age: int, token_pattern: str, min_similarity: float = 0.92) -> DataFrame:
    """(query_id, memory_id, similarity): the most similar other memory text not older than ``max_age`` seconds, where it holds all tokens of the query.

    As :func:`fuzzy_matches` with ``others``; ``memory`` has requested_at besides, and rows without it are too old. A best match
    that lacks a token isn't replaced by the next one.
    """
    young = memory.filter((F.unix_timestamp(now) - F.unix_timestamp("requested_at")).between(0, max_age))
    best = fuzzy_matches(queries, young, min_similarity, 1, others=True)
    j = best.join(queries.select("query_id", F.col("text").alias("__q")), "query_id").join(memory.select("memory_id", F.col("text").alias("__m")), "memory_id")
    tokens = F.regexp_extract_all("__q", F.lit(token_pattern), F.lit(0))
    return j.filter(F.forall(tokens, lambda p: F.col("__m").contains(p))).select("query_id", "memory_id", "similarity")


def glossary_search(glossary: DataFrame, needle: str) -> DataFrame:
    """Entries whose source or target holds the needle, letter case aside, ordered by source and load_seq."""
    low = needle.lower()
    return glossary.filter(F.lower("source").contains(low) | F.lower("target").contains(low)).orderBy("source", "load_seq")


def missing_rows(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows without a result."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def repaired(old: DataFrame, new: DataFrame, keys: list[str], text_col: str = "translated_text", ok_col: str = "ok") -> DataFrame:
    """Old rows with the text of a repair where it succeeded; ``repaired`` tells which."""
    n = new.select(*keys, F.col(text_col).alias("__t"), F.col(ok_col).alias("__ok")).dropDuplicates(keys)
    fixed = F.coalesce(F.col("__ok"), F.lit(False))
    return old.join(n, keys, "left").withColumn(
        text_col, F.when(fixed, F.col("__t")).otherwise(F.col(text_col))
    ).withColumn(ok_col, fixed | F.col(ok_col)).withColumn("repaired", fixed).drop("__t", "__ok")
