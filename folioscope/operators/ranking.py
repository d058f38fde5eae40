"""Candidate ranking and generation of candidates by callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scoring as S
from folioscope.functions import text as T
from folioscope.sources import ship_package

from .lookups import similarity


def ranked(candidates: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Add the components, total, valid and rank of each candidate of a text.

    ``candidates`` has the keys, idx, source_text, candidate, registry, is_header, glossary_score. A candidate that lacks a
    token of the registry is invalid and ranks behind all valid ones; equal totals keep their order.
    """
    ship_package(candidates.sparkSession)
    w = S.RERANK_WEIGHTS | (weights or {})
    parts = S.rerank_parts(F.col("source_text"), F.col("candidate"), F.col("registry"), F.col("is_header"))
    d = candidates.select("*", *[v.alias(f"{k}_part") for k, v in parts.items()])
    sim = similarity("sequence")(T.normalised(F.coalesce("source_text", F.lit(""))), T.normalised(F.coalesce("candidate", F.lit(""))))
    d = d.withColumn("similarity", sim).withColumn(
        "identity_part",
        F.when(
            (F.coalesce("source_text", F.lit("")) == "") | (F.coalesce("candidate", F.lit("")) == ""), F.lit(1.0)
        ).otherwise(S.identity_penalty(F.col("similarity")))
    )
    d = d.withColumn("glossary_part", F.coalesce("glossary_score", F.lit(1.0)))
    n = F.count("*").over(Window.partitionBy(*keys))
    total = F.lit(0.0)
    for k in ("placeholder", "glossary", "numeric", "format", "semantic", "identity", "length", "spillover", "hallucinated"):
        total = total + F.col(f"{k}_part") * F.lit(w[k])
    d = d.withColumn(
        "total", total + F.when(n > 1, (n - F.col("idx")) * F.lit(0.5)).otherwise(F.lit(0.0))
    ).withColumn("valid", F.col("placeholder_part") >= 1.0)
    order = Window.partitionBy(*keys).orderBy(F.desc("valid"), F.desc("total"), "idx")
    return d.withColumn("rank", F.row_number().over(order))


#: Backends of the cascade: name, priority (smaller first), and whether it is too slow for short texts. A fixed list.
BACKENDS = (
    ("cloud_pro", 1, False), ("relay_v2", 2, False), ("local_small", 3, True), ("hub_api", 4, False), ("studio_ai", 5, False),
    ("north_free", 6, False), ("cascade_free", 7, False), ("dummy", 8, False),
)
#: What a backend adds to the total of its candidates.
BACKEND_BONUS = {"local_small": 0.8, "north_free": -0.4}
#: Texts up to this length don't go to slow backends.
SHORT_TEXT = 8


def routed(requests: DataFrame, text_col: str = "text", backends: tuple[tuple[str, int, bool], ...] = BACKENDS) -> DataFrame:
    """Every request with every backend that is asked for it, and its priority: the fixed list unfolded in place, without a join. Null texts are short."""
    one = F.array(*[F.struct(F.lit(n).alias("backend"), F.lit(p).alias("priority"), F.lit(slow).alias("slow")) for n, p, slow in backends])
    short = F.length(F.coalesce(F.col(text_col), F.lit(""))) <= SHORT_TEXT
    fit = F.filter(one, lambda b: ~(b["slow"] & short))
    return requests.select("*", F.inline(fit)).drop("slow")


def cascaded(candidates: DataFrame, keys: list[str], order: list[str], bonus: dict[str, float] | None = None) -> DataFrame:
    """Add the backend's bonus to ``total``, its priority, and the rank: valid ones first, then total, priority and ``order``. Unknown backends come last and have no bonus."""
    pairs = lambda kv: F.create_map(*[F.lit(x) for p in kv for x in p])
    extra = F.coalesce(F.element_at(pairs((BACKEND_BONUS if bonus is None else bonus).items()), F.col("backend")), F.lit(0.0))
    priority = F.coalesce(F.element_at(pairs((n, p) for n, p, _ in BACKENDS), F.col("backend")), F.lit(len(BACKENDS) + 1))
    d = candidates.withColumn("total", F.col("total") + extra).withColumn("priority", priority)
    w = Window.partitionBy(*keys).orderBy(F.desc("valid"), F.desc("total"), "priority", *order)
    return d.withColumn("rank", F.row_number().over(w))


#: Backends that need no network: each gives the candidates of a request's row.
OFFLINE: dict[str, Callable[[dict], list[str]]] = {
    "identity": lambda r: [r["text"] or ""] * max(1, r.get("n_candidates") or 1),
    "prefix": lambda r: [f"{(r.get('target_lang') or '').upper()}: {r['text'] or ''}"],
    "empty": lambda r: [""],
}


def generated(requests: DataFrame, backend: str | Callable[[dict], list[str]], retries: int = 0) -> DataFrame:
    """(request_id, idx, candidate, error): candidates of each request by a callable, in Arrow batches; an exception after the retries gives an empty candidate with its text."""
    ship_package(requests.sparkSession)
    call = OFFLINE[backend] if isinstance(backend, str) else backend
    kind = dict(requests.dtypes)["request_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                for left in range(retries, -1, -1):
                    try:
                        rows += [(r["request_id"], i, c, None) for i, c in enumerate(call(r))]
                        break
                    except Exception as e:  # a backend may fail in any way
                        if not left:
                            rows.append((r["request_id"], 0, "", str(e)))
            yield pd.DataFrame(rows, columns=["request_id", "idx", "candidate", "error"])

    return requests.mapInPandas(run, f"request_id {kind}, idx int, candidate string, error string")
