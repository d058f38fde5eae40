"""Page geometry: columns, reading order, regions, overlaps, neighbours, safe boxes, paragraph merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import ship_package

PAGE = ["doc_id", "page_no"]


def box(prefix: str = "bbox") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}.{k}") for k in ("x0", "y0", "x1", "y1"))


def area(x0, y0, x1, y1) -> Column:
    """Area of a box; 0 for an empty or inverted one."""
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def iou(a, b) -> Column:
    """Intersection over union of two boxes (each x0, y0, x1, y1); 0 where the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))


def column_numbers(blocks: DataFrame, gap: float = 30.0) -> DataFrame:
    """Add column_no: blocks of a page in the order of their centres; a gap beyond ``gap`` starts a new column. Blocks without a box are left out."""
    x0, _, x1, _ = box()
    b = blocks.filter(F.col("bbox").isNotNull()).withColumn("center_x", (x0 + x1) / 2)
    w = Window.partitionBy(*PAGE).orderBy("center_x", "block_no", "block_id")
    b = b.withColumn("new_column", F.when(F.col("center_x") - F.lag("center_x").over(w) > gap, 1).otherwise(0))
    return b.withColumn("column_no", F.sum("new_column").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new_column")


def columns(blocks: DataFrame, gap: float = 30.0) -> DataFrame:
    """(doc_id, page_no, column_no, x_min, x_max, n_blocks) of each column of each page."""
    return column_numbers(blocks, gap).groupBy(*PAGE, "column_no").agg(
        F.min("bbox.x0").alias("x_min"), F.max("bbox.x1").alias("x_max"), F.count("*").alias("n_blocks")
    )


def reading_order(blocks: DataFrame, gap: float = 30.0) -> DataFrame:
    """Add position: column, then rows rounded to tenths, then the left edge."""
    w = Window.partitionBy(*PAGE).orderBy("column_no", F.round(F.col("bbox.y0"), 1), F.round(F.col("bbox.x0"), 1), "block_no", "block_id")
    return column_numbers(blocks, gap).withColumn("position", F.row_number().over(w))


def page_order(blocks: DataFrame, region: Column) -> DataFrame:
    """Add region and position: headers, body, captions, tables, footers, each in reading order."""
    rank = F.when(region == "header", 0).when(region == "caption", 2).when(region == "table", 3).when(region == "footer", 4).otherwise(1)
    w = Window.partitionBy(*PAGE).orderBy("region_rank", F.round(F.col("bbox.y0"), 2), F.round(F.col("bbox.x0"), 2), "block_no", "block_id")
    return blocks.filter(F.col("bbox").isNotNull()).withColumn("region_rank", rank).withColumn("position", F.row_number().over(w))


def text_pairs(blocks: DataFrame, min_area: float = 4.0, band: float = 200.0) -> DataFrame:
    """(doc_id, page_no, a, b, iou) of all pairs of text blocks of a page that touch the same horizontal band and overlap.

    Blocks are spread over bands of height ``band``, so that a page of very many blocks is no single group; a pair counts in
    the first band that both touch.
    """
    x0, y0, x1, y1 = box()
    b = blocks.filter((F.col("type") == "text") & F.col("bbox").isNotNull()).filter((x1 - x0) * (y1 - y0) >= min_area)
    b = b.select(*PAGE, "block_no", "block_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    first, last = F.floor(F.col("y0") / band), F.floor(F.col("y1") / band)
    e = b.select("*", first.alias("first"), F.explode(F.sequence(first, F.greatest(first, last))).alias("band"))
    l, r = e.alias("l"), e.alias("r")
    on = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_no") == F.col("r.page_no")) & (F.col("l.band") == F.col("r.band"))
    order = (F.col("l.block_no") < F.col("r.block_no")) & (F.col("l.band") == F.greatest("l.first", "r.first"))
    value = iou([F.col(f"l.{k}") for k in ("x0", "y0", "x1", "y1")], [F.col(f"r.{k}") for k in ("x0", "y0", "x1", "y1")])
    return l.join(r, on & order).select(
        F.col("l.doc_id").alias("doc_id"), F.col("l.page_no").alias("page_no"), F.col("l.block_no").alias("a"), F.col("r.block_no").alias("b"),
        value.alias("iou")
    )


def page_overlap(blocks: DataFrame, min_iou: float = 0.0, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, overlap_pairs, mean_iou, max_iou) of every page, or of the distinct ``pages``; zeros for a page without overlaps or blocks."""
    p = text_pairs(blocks).filter(F.col("iou") > min_iou).groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.sum(F.col("iou").cast("decimal(38,18)")).alias("s"), F.max("iou").alias("m")
    )
    zero = lambda c, kind: F.coalesce(c.cast(kind), F.lit(0).cast(kind))
    asked = blocks.select(*PAGE).distinct() if pages is None else pages
    return asked.join(p, PAGE, "left").select(
        *PAGE, zero(F.col("n"), "bigint").alias("overlap_pairs"), F.coalesce(F.col("s").cast("double") / F.col("n"), F.lit(0.0)).alias("mean_iou"),
        zero(F.col("m"), "double").alias("max_iou")
    )


def neighbours(blocks: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, page_no, block_no, rank, other, distance): the k nearest other text blocks of the page by the distance of the upper left corners (sum of both axes)."""
    b = blocks.filter((F.col("type") == "text") & F.col("bbox").isNotNull()).select(*PAGE, "block_no", "bbox")
    l, r = b.alias("l"), b.alias("r")
    on = (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page_no") == F.col("r.page_no")) & (F.col("l.block_no") != F.col("r.block_no"))
    d = F.abs(F.col("r.bbox.y0") - F.col("l.bbox.y0")) + F.abs(F.col("r.bbox.x0") - F.col("l.bbox.x0"))
    j = l.join(r, on).select(
        F.col("l.doc_id").alias("doc_id"), F.col("l.page_no").alias("page_no"), F.col("l.block_no").alias("block_no"), F.col("r.block_no").alias("other"),
        d.alias("distance"), F.col("l.bbox").alias("box"), F.col("r.bbox").alias("other_box")
    )
    w = Window.partitionBy(*PAGE, "block_no").orderBy("distance", "other")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def legacy_decision(source: Column, target: Column, region: Column, translate_tables: bool = False) -> Column:
    """Whether a translation replaces its block's text: tables, blank translations and the source's own text don't."""
    table = (F.coalesce(region, F.lit("")) == "table") & F.lit(not translate_tables)
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    return ~table & (T.strip(t) != "") & (T.normalised(t) != T.normalised(s))


def repaired_box(b: Column, min_width: float = 50.0, min_height: float = 10.0) -> Column:
    """The box with least dimensions where it is empty or inverted."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    bad = (w <= 0) | (h <= 0)
    return F.struct(
        b["x0"].alias("x0"), b["y0"].alias("y0"), F.when(bad, b["x0"] + F.greatest(w, F.lit(min_width))).otherwise(b["x1"]).alias("x1"),
        F.when(bad, b["y0"] + F.greatest(h, F.lit(min_height))).otherwise(b["y1"]).alias("y1")
    )


def safe_boxes(blocks: DataFrame, k: int = 10, margin: float = 1.0) -> DataFrame:
    """(doc_id, page_no, block_no, x0, y0, x1, y1): boxes shrunk away from the k nearest; the box itself where nothing would be left.

    Limits are taken against the neighbours' own boxes, so they don't depend on the order of the neighbours.
    """
    n = neighbours(blocks, k).withColumn("box", repaired_box(F.col("box")))
    a, o = F.col("box"), F.col("other_box")
    xo, yo = F.least(a.x1, o.x1) - F.greatest(a.x0, o.x0), F.least(a.y1, o.y1) - F.greatest(a.y0, o.y0)
    overlap = (xo > 0) & (yo > 0)
    size = (a.x1 - a.x0) * (a.y1 - a.y0)
    strong = overlap & F.when(size > 0, F.try_divide(xo * yo, size) > 0.01).otherwise(False)
    close = ~overlap & (F.greatest(F.lit(0.0), -xo) < margin) & (F.greatest(F.lit(0.0), -yo) < margin)
    side, up = (strong & (xo > yo)) | close, (strong & (xo <= yo)) | close
    cut = lambda cond, v: F.when(cond, v)
    g = n.groupBy(*PAGE, "block_no").agg(
        F.first("box").alias("box"),
        F.min(cut(side & (a.x0 < o.x0), o.x0 - margin)).alias("max_x1"), F.max(cut(side & (a.x0 >= o.x0), o.x1 + margin)).alias("min_x0"),
        F.min(cut(up & (a.y0 < o.y0), o.y0 - margin)).alias("max_y1"), F.max(cut(up & (a.y0 >= o.y0), o.y1 + margin)).alias("min_y0"),
    )
    own = blocks.filter((F.col("type") == "text") & F.col("bbox").isNotNull()).select(*PAGE, "block_no", repaired_box(F.col("bbox")).alias("own"))
    j = own.join(g.drop("box"), [*PAGE, "block_no"], "left")
    x0, y0, x1, y1 = F.greatest("own.x0", "min_x0"), F.greatest("own.y0", "min_y0"), F.least("own.x1", "max_x1"), F.least("own.y1", "max_y1")
    good = (x1 > x0) & (y1 > y0)
    return j.select(*PAGE, "block_no", *[F.when(good, v).otherwise(F.col(f"own.{k_}")).alias(k_) for v, k_ in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def cell_grid(cells: Column, b: Column) -> Column:
    """Array of boxes of equal width for the cells of one table row; no cells: an empty array."""
    n = F.size(cells)
    w = F.try_divide(b["x1"] - b["x0"], n)
    return F.transform(
        cells, lambda c,
        i: F.struct(c.alias("text"), (b["x0"] + w * i).alias("x0"), b["y0"].alias("y0"), (b["x0"] + w * (i + 1)).alias("x1"), b["y1"].alias("y1"))
    )


def render_decision(source: Column, target: Column, ok: Column) -> Column:
    """Struct replace, text: the translation where it succeeded and isn't blank, else the source."""
    good = F.coalesce(ok, F.lit(False)) & (F.trim(F.coalesce(target, F.lit(""))) != "")
    return F.struct(good.alias("replace"), F.when(good, target).otherwise(source).alias("text"))


def capacity(b: Column) -> Column:
    """Characters that fit into a box at the smallest size."""
    w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
    return F.floor(F.floor(w / 3.6) * F.floor(h / 7.2) * F.lit(1.2))


def alignment(b: Column, width: Column) -> Column:
    """left, right or center by the margins a box leaves on its page."""
    left, right = b["x0"], width - b["x1"]
    return F.when(F.abs(left - right) < 0.1 * width, "center").when(left > 2 * right, "right").otherwise("left")


def merge_paragraphs(blocks: DataFrame, max_gap: float = 15.0) -> DataFrame:
    """(doc_id, page_no, paragraph, first_block, n_blocks, x0, y0, x1, y1, text): consecutive text blocks of a column joined to paragraphs.

    ``blocks`` has doc_id, page_no, position, type, bbox, text, size (of the first span; null: unknown). The running block
    keeps the first size (an unknown one fits any) and grows its box, which no window expresses: it is a fold over the blocks of one page, of which
    there are few. A block without a width or box never joins.
    """
    ship_package(blocks.sparkSession)
    names = ["doc_id", "page_no", "block_no", "position", "type", "x0", "y0", "x1", "y1", "text", "size"]
    out_names = ["doc_id", "page_no", "paragraph", "first_block", "n_blocks", "x0", "y0", "x1", "y1", "text"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, number, last = None, 0, None  # a page may go on in the next batch

        def row() -> tuple:
            return (*page, number, last["first"], last["n"], last["x0"], last["y0"], last["x1"], last["y1"], "\n".join(last["texts"]))

        for pdf in batches:
            rows = []
            for doc, no, block, _, kind, x0, y0, x1, y1, text, size in pdf[names].itertuples(index=False, name=None):
                size, text = (None if pd.isna(size) else size), text or ""
                joins = False
                if last is not None and page == (doc, no) and last["kind"] == "text" and kind == "text":
                    mean = ((last["x1"] - last["x0"]) + (x1 - x0)) / 2
                    overlap = min(last["x1"], x1) - max(last["x0"], x0)
                    if 0 <= y0 - last["y1"] <= max_gap and mean > 0 and overlap / mean >= 0.7:
                        joins = last["texts"][-1].rstrip().endswith("-") or size is None or last["size"] is None or abs(last["size"] - size) <= 1.0
                if joins:
                    last["x0"], last["x1"], last["y1"], last["n"] = min(last["x0"], x0), max(last["x1"], x1), y1, last["n"] + 1
                    last["texts"].append(text)
                    continue
                if last is not None:
                    rows.append(row())
                number = number + 1 if page == (doc, no) else 1
                page, last = (doc, no), {"kind": kind, "first": block, "n": 1, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": size, "texts": [text]}
            yield pd.DataFrame(rows, columns=out_names)
        if last is not None:
            yield pd.DataFrame([row()], columns=out_names)

    x0, y0, x1, y1 = box()
    flat = blocks.filter(F.col("bbox").isNotNull()).select(
        *PAGE, "block_no", "position", "type", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), "text",
        F.col("size").cast("double").alias("size")
    )
    kinds = dict(flat.dtypes)
    schema = (
        f"doc_id {kinds['doc_id']}, page_no {kinds['page_no']}, paragraph int, first_block {kinds['block_no']}, n_blocks int, x0 double, y0 double, x1 double, "
        f"y1 double, text string"
    )
    return flat.repartition(*PAGE).sortWithinPartitions(*PAGE, "position").mapInPandas(fold, schema)
