"""Queries of the training-data problems: name -> callable(spark, sf_dir), each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import canonical, language, lookalike, mixing, pairs, sentences, tokens
from .common import code_lookup, language_code, newest, read_table


def _t(spark, d, *names):
    return [read_table(spark, d, n) for n in names]


def _documents(spark, d):
    """Documents as they are (their ids are unique), with the code of their language."""
    return read_table(spark, d, "documents").select("doc_id", "text", language_code(F.col("lang"), code_lookup(spark, d)).alias("lang"))


def p1_found(spark, d):
    return language.found(read_table(spark, d, "requests"), code_lookup(spark, d))


def p1_segments(spark, d):
    """Every segment of every request with its confidence."""
    q, codes = read_table(spark, d, "requests"), code_lookup(spark, d)
    r, model = language.labelled_requests(q, codes), language.fit_model(language.labels(q, codes))
    return language.segments(r, model)


def p2_found(spark, d):
    return pairs.truncated(*_t(spark, d, "requests", "results"))


def p2_rates(spark, d):
    return pairs.truncation_rates(*_t(spark, d, "requests", "results"))


def p3_found(spark, d):
    return pairs.defects(*_t(spark, d, "requests", "results"), code_lookup(spark, d))


def p4_found(spark, d):
    return lookalike.alike_pairs(read_table(spark, d, "spans"))


def p4_repaired(spark, d):
    """Every span's text in the one form, blank texts left out."""
    s = newest(read_table(spark, d, "spans").select("span_id", "doc_id", "text"), "span_id")
    return lookalike.repaired_texts(s, keep=("doc_id",), document="doc_id").select("span_id", "repaired")


def p5_found(spark, d):
    return canonical.found(*_t(spark, d, "fonts", "font_families"))


def p5_unmatched(spark, d):
    return canonical.report(*_t(spark, d, "fonts", "font_families"))


def p6_ids(spark, d):
    return tokens.token_ids(read_table(spark, d, "documents"), tokens.default_tokenizer_path())


def p6_decoded(spark, d):
    """Every document's text back from its ids, with the number of its tokens' bytes: a whole round trip."""
    path = tokens.default_tokenizer_path()
    t = tokens.decoded(tokens.token_ids(read_table(spark, d, "documents"), path, offsets=True), path)
    return t.select(
        "doc_id", F.col("decoded").alias("text"), (F.size("ids") == F.size("offsets")).alias("offsets_match"),
        F.octet_length("decoded").cast("bigint").alias("n_bytes")
    )


def p7_mix(spark, d):
    return mixing.mix(*_t(spark, d, "documents", "source_targets"), tokens.default_tokenizer_path())


def p7_shares(spark, d):
    docs, targets = _t(spark, d, "documents", "source_targets")
    return mixing.shares(mixing.mix(docs, targets, tokens.default_tokenizer_path()), targets)


def p8_found(spark, d):
    return sentences.sentences(_documents(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_segments, p2_found, p2_rates, p3_found, p4_found, p4_repaired, p5_found, p5_unmatched, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found
    )
}

#: Only the round trip can be expressed in SQL; tests hold the other operators against brute force and planted cases.
ORACLE_SQL: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text, true AS offsets_match, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents",
}
