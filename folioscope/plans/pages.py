"""Queries over pages and spans: columns, order, regions, overlaps, neighbours, fonts, equations, titles, paragraphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import classify as C
from folioscope.functions import text as T
from folioscope.operators import layout as G
from folioscope.operators import rollups as R
from folioscope.sources import read_table

from . import frames as X
from .catalog import query

_COLS = f"""{X.BLOCKS}, c0 AS (SELECT *, (bbox.x0 + bbox.x1) / 2 AS center_x FROM blocks0 WHERE bbox IS NOT NULL),
c1 AS (SELECT *, CASE WHEN center_x - lag(center_x) OVER w > 30 THEN 1 ELSE 0 END AS nc FROM c0 WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY center_x, block_no, block_id)),
c2 AS (SELECT *, sum(nc) OVER (PARTITION BY doc_id, page_no ORDER BY center_x, block_no, block_id ROWS UNBOUNDED PRECEDING)::INT AS column_no FROM c1)"""


@query(
    f"WITH {_COLS} SELECT doc_id, page_no, column_no, min(bbox.x0) AS x_min, max(bbox.x1) AS x_max, count(*) AS n_blocks FROM c2 GROUP BY doc_id, page_no, "
    f"column_no"
)
def column_islands(spark, d):
    """Columns of every page (W-01)."""
    return G.columns(X.blocks(spark, d))


@query(
    f"WITH {_COLS} SELECT doc_id, page_no, block_id, column_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY column_no, round(bbox.y0, 1), "
    f"round(bbox.x0, 1), block_no, block_id)::INT AS position FROM c2"
)
def reading_order(spark, d):
    """Reading order of every page (W-02)."""
    return G.reading_order(X.blocks(spark, d)).select("doc_id", "page_no", "block_id", "column_no", "position")


_REGION = "CASE WHEN bbox.y0 < 72 THEN 'header' WHEN bbox.y1 > page_height - 72 THEN 'footer' ELSE 'body' END"


@query(
    f"WITH {X.BLOCKS}, r AS (SELECT *, {_REGION} AS place, CASE WHEN region IN ('table', 'caption') THEN region ELSE {_REGION} END AS part FROM blocks0 WHERE "
    f"bbox IS NOT NULL) SELECT doc_id, page_no, block_id, place, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE part WHEN 'header' THEN 0 WHEN "
    f"'caption' THEN 2 WHEN 'table' THEN 3 WHEN 'footer' THEN 4 ELSE 1 END, round(bbox.y0, 2), round(bbox.x0, 2), block_no, block_id)::INT AS position FROM r"
)
def page_order(spark, d):
    """Regions by margin and the order headers, body, captions, tables, footers (P-11, W-03, W-05)."""
    b = X.blocks(spark, d)
    place = C.region(F.col("bbox.y0"), F.col("bbox.y1"), F.col("page_height"))
    part = F.when(F.col("region").isin("table", "caption"), F.col("region")).otherwise(place)
    return G.page_order(b, part).select("doc_id", "page_no", "block_id", place.alias("place"), "position")


_BOXES = (
    f"{X.BLOCKS}, b0 AS (SELECT doc_id, page_no, block_no, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1 FROM blocks0 WHERE type = 'text' AND "
    f"bbox IS NOT NULL)"
)
_IOU = f"""{_BOXES}, b1 AS (SELECT * FROM b0 WHERE (x1 - x0) * (y1 - y0) >= 4),
pr AS (SELECT l.doc_id, l.page_no, l.block_no AS a, r.block_no AS b, greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) -
  greatest(l.y0, r.y0)) AS inter, (l.x1 - l.x0) * (l.y1 - l.y0) AS al, (r.x1 - r.x0) * (r.y1 - r.y0) AS ar FROM b1 l JOIN b1 r ON l.doc_id = r.doc_id AND
  l.page_no = r.page_no AND l.block_no < r.block_no),
io AS (SELECT *, CASE WHEN al + ar - inter > 0 THEN inter / (al + ar - inter) ELSE 0 END AS iou FROM pr)"""


@query(
    f"WITH {_IOU}, g AS (SELECT doc_id, page_no, count(*) AS n, sum(iou::DECIMAL(38,18))::DOUBLE AS s, max(iou) AS m FROM io WHERE iou > 0 GROUP BY doc_id, "
    f"page_no), pg AS (SELECT DISTINCT doc_id, page_no FROM blocks0) SELECT doc_id, page_no, coalesce(n, 0) AS overlap_pairs, coalesce(s / n, 0::DOUBLE) AS "
    f"mean_iou, coalesce(m, 0::DOUBLE) AS max_iou FROM pg LEFT JOIN g USING (doc_id, page_no)"
)
def page_overlap(spark, d):
    """Overlaps of text blocks by page (J-15, G-01, A-03)."""
    return G.page_overlap(X.blocks(spark, d))


@query(
    f"WITH {_BOXES}, n AS (SELECT l.doc_id, l.page_no, l.block_no, r.block_no AS other, abs(r.y0 - l.y0) + abs(r.x0 - l.x0) AS distance FROM b0 l JOIN b0 r "
    f"ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND l.block_no <> r.block_no), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, "
    f"block_no ORDER BY distance, other)::INT AS rank FROM n) SELECT * FROM k WHERE rank <= 10"
)
def nearest_neighbours(spark, d):
    """The ten nearest blocks of every block (J-17, T-06)."""
    return G.neighbours(X.blocks(spark, d)).select("doc_id", "page_no", "block_no", "other", "distance", "rank")


@query(
    f"WITH {X.BLOCKS} SELECT doc_id, block_id, bbox.x1 - bbox.x0 AS width, bbox.y1 - bbox.y0 AS height, floor(floor((bbox.x1 - bbox.x0) / 3.6::DOUBLE) * "
    f"floor((bbox.y1 - bbox.y0) / 7.2::DOUBLE) * 1.2::DOUBLE)::BIGINT AS capacity, CASE WHEN abs(bbox.x0 - (page_width - bbox.x1)) < 0.1::DOUBLE * page_width "
    f"THEN 'center' WHEN bbox.x0 > 2 * (page_width - bbox.x1) THEN 'right' ELSE 'left' END AS alignment FROM blocks0 WHERE bbox IS NOT NULL"
)
def box_metrics(spark, d):
    """Width, height, capacity and alignment of every block (G-02, G-05, G-09)."""
    b = X.blocks(spark, d).filter("bbox is not null")
    return b.select(
        "doc_id", "block_id", (F.col("bbox.x1") - F.col("bbox.x0")).alias("width"), (F.col("bbox.y1") - F.col("bbox.y0")).alias("height"),
        G.capacity(F.col("bbox")).cast("bigint").alias("capacity"), G.alignment(F.col("bbox"), F.col("page_width")).alias("alignment")
    )


@query(
    f"WITH {X.BLOCKS} SELECT doc_id, count(DISTINCT page_no) AS pages, count(*) AS n_blocks, count(*) FILTER (type = 'text') AS text_blocks, count(*) FILTER "
    f"(type = 'image') AS image_blocks, count(*) FILTER (region = 'table') AS table_blocks, count(*) FILTER (is_header) AS headers FROM blocks0 GROUP BY "
    f"doc_id"
)
def document_info(spark, d):
    """Counts of every document (A-17, S-02)."""
    return X.blocks(spark, d).groupBy("doc_id").agg(
        F.count_distinct("page_no").alias("pages"), F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "text").alias("text_blocks"),
        F.count_if(F.col("type") == "image").alias("image_blocks"), F.count_if(F.col("region") == "table").alias("table_blocks"),
        F.count_if("is_header").alias("headers")
    )


@query(
    f"WITH {X.SPANS}, g AS (SELECT doc_id, block_id, font, count(*) AS n, min((line_no, span_no, span_id)) AS f FROM spans0 WHERE font IS NOT NULL GROUP BY "
    f"doc_id, block_id, font), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id ORDER BY n DESC, f) AS k FROM g) SELECT doc_id, block_id, "
    f"font, n FROM r WHERE k = 1"
)
def dominant_value(spark, d):
    """Dominant font of every block (A-08)."""
    return R.dominant(X.spans(spark, d), ["doc_id", "block_id"], "font", ["line_no", "span_no", "span_id"])


@query(
    f"WITH {X.SPANS} SELECT doc_id, block_id, min(size) AS min_size, max(size) AS max_size, quantile_cont(size, 0.5) AS median_size, "
    f"sum(size::DECIMAL(20,6))::DOUBLE / count(size) AS mean_size, count(DISTINCT font) AS n_fonts, (count(*) FILTER (flags & 16 > 0)) > count(*) * "
    f"0.5::DOUBLE AS bold FROM spans0 GROUP BY doc_id, block_id"
)
def font_metrics(spark, d):
    """Font sizes and weight of every block (A-09, A-11, P-14)."""
    s = F.col("size")
    return X.spans(spark, d).groupBy("doc_id", "block_id").agg(
        F.min(s).alias("min_size"), F.max(s).alias("max_size"), F.percentile(s, F.lit(0.5)).alias("median_size"),
        (F.sum(s.cast("decimal(20,6)")).cast("double") / F.count(s)).alias("mean_size"), F.count_distinct("font").alias("n_fonts"),
        (F.count_if(F.col("flags").bitwiseAND(16) > 0) > F.count("*") * 0.5).alias("bold")
    )


@query(
    f"WITH {X.SPANS}, {X.BLOCKS}, j AS (SELECT s.doc_id, b.block_type, s.size FROM spans0 s JOIN blocks0 b ON s.doc_id = b.doc_id AND s.block_id = b.block_id "
    f"WHERE s.size IS NOT NULL AND b.block_type IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_type ORDER BY size) AS k, "
    f"count(*) OVER (PARTITION BY doc_id, block_type) AS n FROM j) SELECT doc_id, block_type, size AS upper_median FROM r WHERE k = n // 2 + 1"
)
def upper_median(spark, d):
    """Upper median font size by document and kind of block (A-10)."""
    j = X.spans(spark, d).select("doc_id", "block_id", "size").join(
        X.blocks(spark, d).select("doc_id", "block_id", "block_type"), ["doc_id", "block_id"]
    ).filter("block_type is not null")
    return R.upper_median(j, ["doc_id", "block_type"], "size")


@query(
    r"WITH f AS (SELECT DISTINCT font_id, raw_name, flags, color FROM fonts WHERE raw_name IS NOT NULL), g AS (SELECT *, regexp_replace(raw_name, "
    r"'^[A-Z]{6}\+', '') AS normalized FROM f) SELECT font_id, normalized, split_part(normalized, '-', 1) AS family, CASE WHEN contains(lower(normalized), "
    r"'bold') OR coalesce(flags, 0) & 16 > 0 THEN 'bold' ELSE 'normal' END AS weight, CASE WHEN contains(lower(normalized), 'italic') OR "
    r"contains(lower(normalized), 'oblique') OR coalesce(flags, 0) & 2 > 0 THEN 'italic' ELSE 'normal' END AS style, ((color >> 16) & 255) / 255::DOUBLE AS "
    r"red, ((color >> 8) & 255) / 255::DOUBLE AS green, (color & 255) / 255::DOUBLE AS blue FROM g"
)
def font_names(spark, d):
    """Normalised font names, families, weights, styles and colours (X-21..X-23)."""
    f = read_table(spark, d, "fonts").filter("raw_name is not null").dropDuplicates(["font_id"])
    x, (r, g, b) = T.font_struct(F.col("raw_name"), F.col("flags")), T.rgb(F.col("color"))
    return f.select(
        "font_id", x["normalized"].alias("normalized"), x["family"].alias("family"), x["weight"].alias("weight"), x["style"].alias("style"), r.alias("red"),
        g.alias("green"), b.alias("blue")
    )


_MATH = C.MATH_CHARS


@query(
    rf"WITH {X.SPANS} SELECT span_id, regexp_matches(coalesce(text, ''), '{_MATH}') AS math_unicode, len(regexp_extract_all(coalesce(text, ''), "
    rf"'{C.OPERATORS}'))::INT AS operators, regexp_matches(coalesce(text, ''), '(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]') AS latex, "
    rf"{' OR '.join(f'contains(lower(coalesce(font, {chr(39)}{chr(39)})), {chr(39)}{x}{chr(39)})' for x in C.MATH_FONTS)} AS math_font FROM spans0"
)
def math_signals(spark, d):
    """Signals of mathematics in every span (E-01)."""
    f = C.math_flags(F.col("text"))
    return X.spans(spark, d).select(
        "span_id", f["math_unicode"].alias("math_unicode"), f["operators"].alias("operators"), f["latex"].alias("latex"),
        C.math_font(F.col("font")).alias("math_font")
    )


def _equations(spark, d):
    s = X.spans(spark, d)
    w = Window.partitionBy("doc_id", "block_id", "line_no").orderBy("span_no", "span_id").rowsBetween(-2, 2)
    own = F.coalesce(C.math_flags(F.col("text"))["math_unicode"], F.lit(False)).cast("int")
    s = s.withColumn("own", own).withColumn("neighbours", F.sum("own").over(w) - F.col("own"))
    return s.withColumn("is_equation", F.coalesce(C.is_equation(F.col("text"), F.col("font"), F.col("neighbours")), F.lit(False)))


@query(
    rf"WITH {X.SPANS}, o AS (SELECT *, regexp_matches(coalesce(text, ''), '{_MATH}')::INT AS own FROM spans0) SELECT span_id, (sum(own) OVER (PARTITION BY "
    rf"doc_id, block_id, line_no ORDER BY span_no, span_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - own)::BIGINT AS neighbours FROM o"
)
def math_neighbours(spark, d):
    """Mathematical spans among the two before and behind every span (W-06)."""
    return _equations(spark, d).select("span_id", "neighbours")


#: Word characters as Spark's Unicode class has them.
_W = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
_EQ = rf"""{X.SPANS}, e0 AS (SELECT *, coalesce(text, '') AS t, {X.strip_sql("coalesce(text, '')")} AS st, regexp_matches(coalesce(text, ''), '{_MATH}')::INT AS own FROM spans0),
e1 AS (SELECT *, sum(own) OVER (PARTITION BY doc_id, block_id, line_no ORDER BY span_no, span_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - own AS nb,
  len(regexp_extract_all(t, '{C.OPERATORS}')) AS ops, len(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{M}}\p{{Nd}}_]+'), lambda x: regexp_full_match(x,
  '[a-zA-Z]'))) AS lat,
  len(list_filter(regexp_extract_all(t, '[{_W}]+'), lambda x: regexp_full_match(x, '[α-ωΑ-Ω]'))) AS gr, regexp_matches(t, '[0-9]') AS dig,
    len(regexp_extract_all(t, '[{_W}]+')) AS nw, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]')) AS an, length(t) AS n FROM e0),
e2 AS (SELECT *, lat + gr >= 2 OR (lat + gr > 0 AND dig AND ops >= 1) AS var, regexp_matches(t, '[(\[][^)\]]*[+\-*/=<>≠≤≥∈∉][^)\]]*[)\]]') OR regexp_matches(t,
  '(^|[^{_W}])[{_W}][{_W})\]]*{X.WS}*/{X.WS}*[(\[]*[{_W}]')
  OR regexp_matches(t, '(^|[^\p{{L}}\p{{Nd}}_])\d+\s*(≤|>=|<=|≥|<|>)\s*[a-zA-Zα-ωΑ-Ω0-9]+($|[^\p{{L}}\p{{Nd}}_])') OR regexp_matches(t,
    '(^|[^\p{{L}}\p{{Nd}}_])[a-zA-Zα-ωΑ-Ω]\s*∈\s*\[[^\]]+\]') AS ctx FROM e1),
e3 AS (SELECT *, CASE WHEN own = 1 THEN 0.6::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ops > 0 AND (dig OR lat > 0 OR regexp_matches(t, '[α-ωΑ-Ω]')) THEN
  0.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN regexp_matches(t, '[\x{{2070}}-\x{{209F}}]') THEN 0.5::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN var THEN 0.6::DOUBLE ELSE 0::DOUBLE END + CASE WHEN var AND nw <= 4 THEN 0.2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ctx THEN 0.5::DOUBLE ELSE
    0::DOUBLE END + CASE WHEN n > 3 AND ops::DOUBLE / nullif(n, 0) > 0.2::DOUBLE AND an::DOUBLE / nullif(n, 0) < 0.7::DOUBLE THEN 0.4::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN nw >= 6 AND ops = 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END - CASE WHEN regexp_matches(st, '[.;:]$') AND ops = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN nb >= 2 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS score FROM e2),
eq AS (SELECT *, CASE WHEN st = '' THEN false WHEN {" OR ".join(f"contains(lower(coalesce(font, '')), '{x}')" for x in C.MATH_FONTS)} OR regexp_matches(t,
  '(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]') THEN true WHEN regexp_full_match(st, '\d{{1,4}}') THEN false ELSE score >= 0.7::DOUBLE END AS is_equation FROM e3)"""


@query(f"WITH {_EQ} SELECT span_id, text FROM eq WHERE is_equation")
def equation_spans(spark, d):
    """Equations among the spans (E-02)."""
    return _equations(spark, d).filter("is_equation").select("span_id", "text")


@query(
    f"WITH {_EQ} SELECT doc_id, block_id, (count(*) FILTER (is_equation))::DOUBLE / count(*) > 0.7::DOUBLE AS is_equation_block, count(*) FILTER "
    f"(is_equation) AS equations, count(*) FILTER (NOT is_equation) AS texts, string_agg(CASE WHEN is_equation THEN '[EQUATION:' || text || ']' ELSE t END, ' "
    f"' ORDER BY line_no, span_no, span_id) AS text FROM eq GROUP BY doc_id, block_id"
)
def equation_blocks(spark, d):
    """Equation blocks, and the text of every block with its equations in brackets (E-03..E-05)."""
    e = _equations(spark, d)
    shown = F.when(F.col("is_equation"), F.concat(F.lit("[EQUATION:"), "text", F.lit("]"))).otherwise(F.coalesce("text", F.lit("")))
    g = e.groupBy("doc_id", "block_id").agg(
        F.avg(F.col("is_equation").cast("int")).alias("share"),
        F.sort_array(F.collect_list(F.struct("line_no", "span_no", "span_id", shown.alias("t")))).alias("x"), F.count_if("is_equation").alias("equations"),
        F.count_if(~F.col("is_equation")).alias("texts")
    )
    return g.select(
        "doc_id", "block_id", (F.col("share") > 0.7).alias("is_equation_block"), "equations", "texts",
        F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("text")
    )


_KINDS = rf"""{X.BLOCK_TEXTS}, t AS (SELECT *, {X.strip_sql('text')} AS c FROM block_texts WHERE text IS NOT NULL AND max_size IS NOT NULL),
u AS (SELECT *, length(c) AS n, regexp_matches(c, '[一-鿿぀-ヿ가-힯]') AS cjk, regexp_matches(c, '^\d+[.)]\s+') AS numbered, regexp_matches(c,
  '(?i)^(Section|Chapter|Part)\s+\d+:?\s*') AS section, coalesce(bold, false) AS heavy,
  length(c) < 50 AND upper(c) = c AND lower(c) <> c AND len({X.words_sql('c')}) <= 5 AS capitals FROM t),
v AS (SELECT *, CASE WHEN avg_size >= 16 AND n < 120 THEN 'title' WHEN avg_size >= 14 OR regexp_matches(lower(c),
  '^(section|chapter|part|chapitre|partie|\d+\.)\s+') THEN 'header' WHEN avg_size >= 12 AND n < CASE WHEN cjk THEN 120 ELSE 150 END THEN 'subheader' WHEN
  regexp_matches(c, '^[•\-*·]|^\d+[.)]\s+') THEN 'list_item' ELSE 'paragraph' END AS plain_kind FROM u)"""


@query(
    rf"WITH {_KINDS} SELECT doc_id, block_id, CASE WHEN (max_size >= 16 AND n < 120) OR (max_size >= 14 AND heavy AND n < 120) OR (page_no = 1 AND max_size "
    rf">= 14 AND n < 100) OR (cjk AND max_size >= 12 AND n < 40) THEN 'title' WHEN max_size >= 14 OR (max_size >= 12 AND heavy AND (numbered OR section)) "
    rf"THEN 'header' WHEN max_size >= 12 AND heavy THEN 'subheader' "
    rf"WHEN numbered OR section OR regexp_matches(c, '^\d+\.\s+[A-Z]') OR regexp_matches(c, '(?i)^[IVX]+\.\s+') OR capitals OR (cjk AND max_size >= 10) THEN "
    rf"'header' ELSE plain_kind END AS kind, plain_kind, CASE WHEN avg_size >= 14 THEN 'large' WHEN avg_size >= 11 THEN 'medium' ELSE 'small' END AS "
    rf"size_class FROM v"
)
def block_kinds(spark, d):
    """Titles, headers, subheaders, list items and paragraphs (C-04..C-06, P-14, W-15)."""
    b = X.block_texts(spark, d).filter("text is not null and max_size is not null")
    kind = C.heading_kind(F.col("text"), F.col("max_size"), F.col("avg_size"), F.coalesce("bold", F.lit(False)), F.col("page_no") == 1)
    return b.select(
        "doc_id", "block_id", kind.alias("kind"), C.block_kind(F.col("text"), F.col("avg_size")).alias("plain_kind"),
        C.size_class(F.col("avg_size")).alias("size_class")
    )


_FOLD = rf"""{X.BLOCK_TEXTS}, {_COLS.removeprefix(X.BLOCKS + ', ')},
pb AS (SELECT c2.doc_id, c2.page_no, c2.block_no, row_number() OVER (PARTITION BY c2.doc_id, c2.page_no ORDER BY column_no, round(c2.bbox.y0, 1),
  round(c2.bbox.x0, 1), c2.block_no, c2.block_id) AS position,
  coalesce(c2.type, '') AS kind, c2.bbox.x0 AS x0, c2.bbox.y0 AS y0, c2.bbox.x1 AS x1, c2.bbox.y1 AS y1, coalesce(t.text, '') AS text, t.first_size::DOUBLE AS size
  FROM c2 JOIN block_texts t ON t.doc_id = c2.doc_id AND t.block_id = c2.block_id),
fo AS (SELECT *, 1 AS paragraph, x0 AS rx0, x1 AS rx1, size AS rsize FROM pb WHERE position = 1
  UNION ALL SELECT doc_id, page_no, block_no, position, kind, x0, y0, x1, y1, text, size, CASE WHEN joins THEN paragraph ELSE paragraph + 1 END, CASE WHEN
    joins THEN least(rx0, x0) ELSE x0 END, CASE WHEN joins THEN greatest(rx1, x1) ELSE x1 END,
  CASE WHEN joins THEN rsize ELSE size END FROM (SELECT b.*, f.paragraph, f.rx0, f.rx1, f.rsize, f.kind = 'text' AND b.kind = 'text' AND b.y0 - f.y1 >= 0 AND
    b.y0 - f.y1 <= 15 AND (f.rx1 - f.rx0) + (b.x1 - b.x0) > 0
    AND (least(f.rx1, b.x1) - greatest(f.rx0, b.x0)) / nullif(((f.rx1 - f.rx0) + (b.x1 - b.x0)) / 2, 0) >= 0.7::DOUBLE AND (regexp_matches(f.text, '-{X.WS}*$')
      OR b.size IS NULL OR f.rsize IS NULL OR abs(f.rsize - b.size) <= 1) AS joins
    FROM fo f JOIN pb b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.position = f.position + 1))"""


@query(
    f"WITH RECURSIVE {_FOLD} SELECT doc_id, page_no, paragraph::INT AS paragraph, arg_min(block_no, position) AS first_block, count(*)::INT AS n_blocks, "
    f"min(x0) AS x0, arg_min(y0, position) AS y0, max(x1) AS x1, arg_max(y1, position) AS y1, "
    "string_agg(text, chr(10) ORDER BY position) AS text FROM fo GROUP BY doc_id, page_no, paragraph"
)
def paragraph_merge(spark, d):
    """Paragraphs merged from consecutive blocks of every page (W-04, G-03)."""
    b = X.block_texts(spark, d)
    return G.merge_paragraphs(G.reading_order(b).withColumn("size", F.col("first_size")))


@query(
    rf"WITH {X.BLOCK_TEXTS} SELECT doc_id, block_id, coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10)) OVER (PARTITION BY doc_id ORDER BY page_no, "
    rf"block_no, block_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM block_texts"
)
def context_window(spark, d):
    """Texts of the two blocks before every block (W-07)."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no", "block_id").rowsBetween(-2, -1)
    return X.block_texts(spark, d).select("doc_id", "block_id", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n\n").alias("context"))


@query(
    f"WITH {X.BLOCKS}, p AS (SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, block_no, block_id) AS i, count(*) OVER "
    f"(PARTITION BY doc_id) AS n FROM blocks0) SELECT doc_id, block_id, i::INT AS position, (CASE WHEN n < 32 THEN 1 WHEN i <= 224 THEN (i - 1) // 32 + 1 "
    f"WHEN i <= 544 THEN 7 + (i - 225) // 64 + 1 ELSE 12 + (i - 545) // 96 + 1 END)::INT AS batch, 0.3::DOUBLE + i::DOUBLE / n * 0.5::DOUBLE AS progress FROM "
    f"p"
)
def progressive_batches(spark, d):
    """Batches and progress of the blocks of every document (W-08, W-14)."""
    w = Window.partitionBy("doc_id")
    i, n = F.row_number().over(w.orderBy("page_no", "block_no", "block_id")), F.count("*").over(w)
    b = X.blocks(spark, d).select("doc_id", "block_id", i.alias("position"), n.alias("n"))
    return b.select(
        "doc_id", "block_id", "position", R.batch_numbers(F.col("position"), F.col("n")).cast("int").alias("batch"),
        (F.lit(0.3) + F.col("position").cast("double") / F.col("n") * 0.5).alias("progress")
    )


@query(
    rf"WITH {X.BLOCK_TEXTS}, b AS (SELECT doc_id, block_id AS given, page_no, concat_ws('_', page_no::VARCHAR, round(bbox.x0, 2)::VARCHAR, round(bbox.y0, "
    rf"2)::VARCHAR, round(bbox.x1, 2)::VARCHAR, round(bbox.y1, 2)::VARCHAR, substring(md5(coalesce(text, '')), 1, 8)) AS raw FROM block_texts WHERE bbox IS "
    rf"NOT NULL) SELECT doc_id, given, 'b_' || page_no || '_' || substring(sha256(raw), 1, 12) AS made FROM b"
)
def block_ids(spark, d):
    """Ids made from page, box and text (R-12)."""
    b = X.block_texts(spark, d).filter("bbox is not null")
    x = [F.col(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")]
    return b.select("doc_id", F.col("block_id").alias("given"), T.block_id(F.col("page_no"), *x, F.coalesce("text", F.lit(""))).alias("made"))


_SAFE = f"""{_BOXES}, o AS (SELECT doc_id, page_no, block_no, x0, y0, CASE WHEN x1 <= x0 OR y1 <= y0 THEN x0 + greatest(x1 - x0, 50) ELSE x1 END AS x1, CASE WHEN x1 <= x0 OR y1 <= y0 THEN y0 + greatest(y1 - y0, 10) ELSE y1 END AS y1 FROM b0),
n AS (SELECT l.doc_id, l.page_no, l.block_no, r.block_no AS other, abs(r.y0 - l.y0) + abs(r.x0 - l.x0) AS distance, r.x0 AS ox0, r.y0 AS oy0, r.x1 AS ox1, r.y1
  AS oy1 FROM b0 l JOIN b0 r ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND l.block_no <> r.block_no),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY distance, other) AS rank FROM n) WHERE rank <= 10),
g AS (SELECT k.*, o.x0, o.y0, o.x1, o.y1, least(o.x1, ox1) - greatest(o.x0, ox0) AS xo, least(o.y1, oy1) - greatest(o.y0, oy0) AS yo FROM k JOIN o ON k.doc_id
  = o.doc_id AND k.page_no = o.page_no AND k.block_no = o.block_no),
h AS (SELECT *, xo > 0 AND yo > 0 AND CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN xo * yo / ((x1 - x0) * (y1 - y0)) > 0.01::DOUBLE ELSE false END AS strong, NOT
  (xo > 0 AND yo > 0) AND greatest(0, -xo) < 1 AND greatest(0, -yo) < 1 AS close FROM g),
m AS (SELECT doc_id, page_no, block_no, min(CASE WHEN ((strong AND xo > yo) OR close) AND x0 < ox0 THEN ox0 - 1 END) AS max_x1, max(CASE WHEN ((strong AND xo >
  yo) OR close) AND x0 >= ox0 THEN ox1 + 1 END) AS min_x0,
  min(CASE WHEN ((strong AND xo <= yo) OR close) AND y0 < oy0 THEN oy0 - 1 END) AS max_y1, max(CASE WHEN ((strong AND xo <= yo) OR close) AND y0 >= oy0 THEN
    oy1 + 1 END) AS min_y0 FROM h GROUP BY doc_id, page_no, block_no),
s AS (SELECT o.*, greatest(o.x0, coalesce(min_x0, o.x0)) AS sx0, greatest(o.y0, coalesce(min_y0, o.y0)) AS sy0, least(o.x1, coalesce(max_x1, o.x1)) AS sx1,
  least(o.y1, coalesce(max_y1, o.y1)) AS sy1 FROM o LEFT JOIN m ON o.doc_id = m.doc_id AND o.page_no = m.page_no AND o.block_no = m.block_no)"""


@query(
    f"WITH {_SAFE} SELECT doc_id, page_no, block_no, CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sx0 ELSE x0 END AS x0, CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sy0 "
    f"ELSE y0 END AS y0, CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sx1 ELSE x1 END AS x1, CASE WHEN sx1 > sx0 AND sy1 > sy0 THEN sy1 ELSE y1 END AS y1 FROM s"
)
def safe_boxes(spark, d):
    """Boxes shrunk away from their neighbours (G-07, G-08)."""
    return G.safe_boxes(X.blocks(spark, d))


@query(
    rf"WITH t AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no, string_split(text, chr(10)) AS ls FROM documents WHERE text "
    rf"IS NOT NULL), r AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(ls[line_no + 1], '|'), lambda c: {X.strip_sql('c')}), lambda c: c "
    rf"<> '') AS cells FROM t WHERE contains(ls[line_no + 1], '|')), e AS (SELECT doc_id, line_no, unnest(range(len(cells)))::INT AS cell, cells FROM r) "
    rf"SELECT doc_id, line_no, cell, cells[cell + 1] AS text, 50::DOUBLE + 500::DOUBLE / len(cells) * cell AS x0, 50::DOUBLE + 500::DOUBLE / len(cells) * "
    rf"(cell + 1) AS x1 FROM e"
)
def table_cells(spark, d):
    """Cells of the table rows of all documents with boxes of equal width on a line of 500 points (G-06, X-12)."""
    ln = read_table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").contains("|"))
    b = F.struct(F.lit(50.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(550.0).alias("x1"), F.lit(12.0).alias("y1"))
    return ln.select(
        "doc_id", "line_no", F.posexplode(G.cell_grid(T.columns_of(F.col("line")), b)).alias("cell", "c")
    ).select("doc_id", "line_no", "cell", "c.text", "c.x0", "c.x1")
