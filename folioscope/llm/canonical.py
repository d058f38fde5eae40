"""Problem 5: map freely written names to the entries of a reference list.

Values are deduplicated and normalised, candidates come from an inverted index of character n-grams of the list, the score is
the cosine of inverse-document-frequency weights, and the best entry is accepted above a threshold and a margin to the next.
An edit-distance check follows where the cosine alone is weak. Everything runs on built-in expressions; the index of the
reference list is broadcast where the list is counted and short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accepted cosine, lead over the second entry, and the cosine from which no edit-distance check is made.
THRESHOLD, MARGIN, SURE = 0.5, 0.015, 0.6
#: Edits allowed between a weak match and its entry.
MAX_EDITS = 3
#: Lengths of the n-grams; shorter keys than KEY letters match by equality only.
NGRAMS, KEY = (2, 3), 4
#: Entries of a list up to which its index is broadcast (some tens of n-grams each); a longer one is joined by shuffles.
BROADCAST_ENTRIES = 20_000

# Style words that follow a family name behind a hyphen, comma or blank.
STYLES = "BoldItalic|BoldOblique|SemiBold|DemiBold|ExtraBold|Bold|Italic|Oblique|Regular|Roman|Medium|Light|Black|Book|Bd|It"
ACCENTED = "àáâãäåāçćčèéêëēìíîïīñńòóôõöøōùúûüūýÿžšÀÁÂÃÄÅĀÇĆČÈÉÊËĒÌÍÎÏĪÑŃÒÓÔÕÖØŌÙÚÛÜŪÝŸŽŠ"
PLAIN = "aaaaaaaccceeeeeiiiiinnooooooouuuuuyyzsAAAAAAACCCEEEEEIIIIINNOOOOOOOUUUUUYYZS"


def plain_key(name: Column) -> Column:
    """Lower-case letters and digits of a name without subset tag, escapes, remarks in parentheses and style words."""
    x = F.regexp_replace(F.trim(name), r"^[A-Z]{6}\+", "")
    x = F.regexp_replace(x, "#20", " ")
    x = F.regexp_replace(x, r"\s*\([^)]*\)\s*$", "")
    x = F.regexp_replace(x, rf"[-, ]\s*({STYLES})$", "")
    return F.regexp_replace(F.lower(F.translate(x, ACCENTED, PLAIN)), "[^a-z0-9]", "")


def letter_key(key: Column) -> Column:
    """The key with digits that stand for letters inside words read as letters."""
    x = F.regexp_replace(key, "(?<=[a-z])1|1(?=[a-z])", "l")
    return F.regexp_replace(x, "(?<=[a-z])0(?=[a-z])|0(?=[a-z]{3})", "o")


def _grams(key: Column) -> Column:
    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(key) - (n - 1)), lambda i: F.substring(key, i, F.lit(n)))
        return F.when(F.length(key) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in NGRAMS]))


def reference_index(reference: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(gram, entry, entry_key, weight, norm) of the canonical names; (alias_key, entry) of the aliases and of names of few letters, by equality only; whether they may be broadcast."""
    names = reference.select(F.col("family_id").alias("entry"), plain_key(F.col("canonical_name")).alias("entry_key")).filter("entry_key <> ''")
    n = names.count()
    grams = names.select("entry", "entry_key", F.explode(_grams(F.col("entry_key"))).alias("gram"))
    idf = grams.groupBy("gram").agg(F.log1p(F.lit(float(n)) / F.count("*")).alias("idf"))
    weighed = grams.join(idf, "gram").select("gram", "entry", "entry_key", (F.col("idf") * F.col("idf")).alias("weight"))
    norms = weighed.groupBy("entry").agg(F.sqrt(F.sum("weight")).alias("norm"))
    aliases = reference.select(
        F.explode("aliases").alias("a"), F.col("family_id").alias("entry")
    ).select(plain_key(F.col("a")).alias("alias_key"), "entry").filter("alias_key <> ''")
    short = names.filter(F.length("entry_key") < KEY).select(F.col("entry_key").alias("alias_key"), "entry")
    return weighed.join(norms, "entry"), aliases.union(short).groupBy("alias_key").agg(F.min("entry").alias("entry")), n <= BROADCAST_ENTRIES


def match_keys(keys: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, entry, score) of the distinct plain keys that denote an entry; other keys have no row.

    ``keys`` has a column key. Ties of the score fail the margin and are no match, so the result doesn't depend on order.
    """
    index, aliases, short = reference_index(reference)
    near = F.broadcast if short else lambda d: d
    by_alias = keys.join(near(aliases), F.col("key") == F.col("alias_key")).select("key", "entry", F.lit(1.0).alias("score"))
    q = keys.select("key", letter_key(F.col("key")).alias("letters")).filter(f"length(letters) >= {KEY}")
    q = q.select("key", "letters", F.explode(_grams(F.col("letters"))).alias("gram"))
    hits = q.join(near(index), "gram")
    weights = index.groupBy("gram").agg(F.min("weight").alias("w"))
    norms = q.join(near(weights), "gram").groupBy("key").agg(F.sqrt(F.sum("w")).alias("key_norm"))
    dots = hits.groupBy("key", "letters", "entry", "entry_key", "norm").agg(F.sum("weight").alias("dot"))
    scored = dots.join(norms, "key").select("key", "letters", "entry", "entry_key", (F.col("dot") / (F.col("norm") * F.col("key_norm"))).alias("score"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "entry")
    best = scored.select("*", F.row_number().over(w).alias("rank"), F.lead("score").over(w).alias("next"))
    sure = (F.col("score") >= SURE) | (F.levenshtein("letters", "entry_key") <= MAX_EDITS)
    by_grams = best.filter(
        (F.col("rank") == 1) & (F.col("score") >= THRESHOLD) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= MARGIN) & sure
    ).select("key", "entry", "score")
    return by_alias.unionByName(by_grams.join(by_alias.select("key"), "key", "left_anti"))


def map_records(
    records: DataFrame, reference: DataFrame, names: tuple[str, ...] = ("family", "normalized_name", "raw_name"), id_col: str = "font_id"
) -> DataFrame:
    """(id, entry, score, source_name): the entry that a record's names taken together denote; entry 0 and null score if none.

    The best score over the names counts; of equal scores the name that comes first in ``names``. Null, empty and unreadable
    names denote nothing; a record delivered again counts once; an empty table gives an empty table; a null id has no row.
    """
    one = records.select(id_col, *names).dropDuplicates([id_col]).filter(F.col(id_col).isNotNull())
    keyed = one.select(id_col, *[plain_key(F.col(n)).alias(f"k{i}") for i, n in enumerate(names)])
    # whole triples are few compared with the records: match them once
    triples = keyed.groupBy(*[f"k{i}" for i in range(len(names))]).agg(F.count("*").alias("n"))
    keys = triples.select(F.explode(F.array_compact(F.array(*[F.col(f"k{i}") for i in range(len(names))]))).alias("key")).filter("key <> ''").distinct()
    matched = match_keys(keys, reference)
    long = triples.select(
        *[f"k{i}" for i in range(len(names))],
        F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"k{i}").alias("key")) for i in range(len(names))])).alias("x")
    ).select("*", "x.key", "x.rank").drop("x")
    best = (
        long.join(matched, "key")
        .groupBy(*[f"k{i}" for i in range(len(names))])
        .agg(F.max_by(F.struct("entry", "score", "rank"), F.struct("score", -F.col("rank"))).alias("b"))
    )
    cond = [F.col(f"t.k{i}").eqNullSafe(F.col(f"b.k{i}")) for i in range(len(names))]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return keyed.alias("t").join(best.alias("b"), on, "left").select(
        F.col(f"t.{id_col}").alias(id_col), F.coalesce(F.col("b.b.entry"), F.lit(0)).cast("int").alias("entry"), F.col("b.b.score").alias("score"),
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("b.b.rank") + 1).alias("source_name")
    )


def found(fonts: DataFrame, reference: DataFrame) -> DataFrame:
    """(font_id, family_id) of every record whose family isn't literally a canonical name; family_id 0 where no entry is denoted."""
    literal = reference.select(F.col("canonical_name").alias("family")).distinct()  # small enough for a broadcast or not, as the planner sees it
    open_ = fonts.select("font_id", "raw_name", "normalized_name", "family").join(literal, "family", "left_anti")
    return map_records(open_, reference).select("font_id", F.col("entry").alias("family_id"))


def report(fonts: DataFrame, reference: DataFrame) -> DataFrame:
    """(key, n_records): normalised names of the records without an entry, with their number of records."""
    m = map_records(fonts, reference).filter("entry = 0").select("font_id")
    names = fonts.select("font_id", "raw_name", "normalized_name", "family").dropDuplicates(["font_id"])
    return names.join(m, "font_id", "left_semi").groupBy(
        F.coalesce(plain_key(F.coalesce("family", "normalized_name", "raw_name")), F.lit("")).alias("key")
    ).agg(F.count("*").alias("n_records"))
