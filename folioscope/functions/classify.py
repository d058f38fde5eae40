"""Classification of blocks, spans and texts: language, tables, captions, headings, titles, equations, identity, content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# ---- fixed values ---------------------------------------------------------------------------------------------------

#: Frequent words and articles of the four languages told apart by words, in the order that decides ties.
LANGUAGE_WORDS = {
    "en": (["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"], ["the", "a", "an"]),
    "fr": (["le", "de", "et", "à", "un", "il", "être", "en", "avoir", "que", "pour"], ["le", "la", "les", "un", "une", "des"]),
    "es": (["el", "la", "de", "que", "y", "a", "en", "un", "ser", "se", "no", "haber"], ["el", "la", "los", "las", "un", "una", "unos", "unas"]),
    "de": (["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"], ["der", "die", "das", "ein", "eine"]),
}
WORD_CLASS = "^[a-zàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]+$"
HEADING_WORDS = [
    "section", "chapter", "introduction", "methodology", "methods", "results", "conclusion", "abstract", "summary", "discussion", "background", "related work",
    "future work"
]
ACADEMIC_WORDS = [
    "abstract", "summary", "introduction", "conclusion", "results", "methodology", "discussion", "references", "appendix", "section", "chapter", "subsection",
    "paragraph", "document", "report", "background", "overview", "preface", "acknowledgments", "index"
]
COMMON_PHRASES = ["ok", "yes", "no", "hello", "hi", "bye", "thanks", "thank you"]
UNITS = ["mm", "cm", "km", "kg", "mg", "g", "ml", "l", "s", "ms", "hz", "khz", "mhz", "ghz", "nm", "um", "db"]
TECHNICAL_TERMS = [
    "GPT", "GPT-2", "GPT-3", "GPT-4", "DALL-E", "DALL-E 2", "CLIP", "InstructGPT", "ChatGPT", "BERT", "ViT", "ResNet", "LSTM", "RNN",
    "Transformer", "RLHF", "VAE", "GAN", "CNN", "YOLO", "AlexNet",
    "Python", "PyTorch", "TensorFlow", "NumPy", "API", "HTTP", "JSON", "GPU", "CPU", "RAM", "URL", "HTML", "CSS", "SQL", "REST", "XML",
    "JavaScript", "TypeScript", "Docker", "Kubernetes", "Git",
    "DNA", "RNA", "pH", "MHz", "GHz", "kHz", "nm", "μm", "mL", "kg", "CRISPR", "PCR", "ATP", "RNA-seq",
    "AI", "ML", "NLP", "CV", "RL", "DL", "IoT", "5G", "4G", "LTE", "VR", "AR", "MR", "SaaS", "PaaS", "IaaS",
]
CONTENT_KEYWORDS = [
    "gpt", "rlhf", "instructgpt", "neural", "algorithm", "model", "transformer", "attention", "embedding", "layer", "training", "fine-tuning",
    "reinforcement", "dataset", "benchmark", "evaluation", "learning", "optimization",
    "hypothesis", "methodology", "experiment", "results", "conclusion", "abstract", "introduction", "discussion", "validation", "analysis",
    "equation", "theorem", "proof", "coefficient", "variable", "parameter", "distribution", "statistical", "probability", "correlation",
    "research", "study", "investigation", "observation", "measurement", "procedure", "protocol", "sample", "control", "significant",
]
CONTENT_HEADERS = [
    "abstract", "introduction", "related work", "methodology", "methods", "experiments", "results", "discussion", "conclusion", "references", "acknowledgments",
    "appendix", "background"
]
MATH_FONTS = ["cmr", "cmsy", "cmmi", "cmex", "symbol", "zapfdingbats", "math", "stix", "cambria", "euclid", "latinmodern"]
MATH_CHARS = (
    r"[\x{2200}-\x{22FF}\x{2190}-\x{21FF}\x{0391}-\x{03C9}\x{2070}-\x{209F}\x{2100}-\x{214F}\x{1D400}-\x{1D7FF}\x{25A0}-\x{25FF}\x{2600}-\x{26FF}\x{B2}\x{B3}\x{B9}]"
)
OPERATORS = r"[=+\-*/^<>×÷±∓≠≤≥≈≡∈∉∝∞∑∏∫∂∇]"
LATEX = r"(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{(equation\*?|align\*?|eqnarray\*?|gather\*?|multline\*?|split)\}.*?\\end\{\1\}"


# ---- language -------------------------------------------------------------------------------------------------------


def language(c: Column, sample: int = 500) -> Column:
    """Struct lang, confidence of the first ``sample`` characters: share of East Asian characters, else frequent words.

    Null and blank texts are English with confidence 0, texts without Latin words English with 0.1.
    """
    pair = lambda a, p: F.struct(a.alias("lang"), p.alias("confidence"))

    def east(s: Column, k: Column) -> Column:
        share = F.try_divide(k["zh"] + k["ja"] + k["ko"] + k["marks"] * F.lit(0.5), F.length(s))
        lang = F.when((k["zh"] > k["ja"]) & (k["zh"] > k["ko"]), "zh").when(k["ja"] > k["ko"], "ja").when(k["ko"] > 0, "ko").otherwise("zh")
        return F.when(share > 0.3, pair(lang, F.least(share * 1.5, F.lit(0.9))))

    def west(w: Column) -> Column:
        has = lambda words: F.size(F.filter(w, lambda x: x.isin(words)))
        scores = F.array(*[F.try_divide(has(common) * F.lit(0.5) + has(articles) * F.lit(2.0), F.size(w)) for common, articles in LANGUAGE_WORDS.values()])
        names = F.array(*[F.lit(k) for k in LANGUAGE_WORDS])
        best = lambda v: pair(F.get(names, (F.array_position(v, F.array_max(v)) - 1).cast("int")), F.least(F.array_max(v) * 1.5, F.lit(0.8)))
        return F.when(F.size(w) == 0, pair(F.lit("en"), F.lit(0.1))).otherwise(T.let(scores, best))

    def whole(s: Column) -> Column:
        n = lambda r: F.size(T.matches(s, r))
        counts = F.struct(
            n("[一-鿿]").alias("zh"), n("[\\x{3040}-\\x{30FF}]").alias("ja"), n("[\\x{AC00}-\\x{D7AF}]").alias("ko"), n("[\\x{3000}-\\x{303F}]").alias("marks")
        )
        words = F.filter(T.matches(F.lower(s), r"[\p{L}\p{N}_]+"), lambda x: x.rlike(WORD_CLASS))
        eastern = F.when(s.rlike(r"[\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"), T.let(counts, lambda k: east(s, k)))
        return F.when(T.strip(s) == "", pair(F.lit("en"), F.lit(0.0))).otherwise(F.coalesce(eastern, T.let(words, west)))

    return T.let(F.substring(F.coalesce(c, F.lit("")), 1, sample), whole)


# ---- layout ---------------------------------------------------------------------------------------------------------


def heading_like(c: Column) -> Column:
    """Whether a line of text reads like a heading."""
    s = T.strip(c)
    return s.rlike("[A-Za-z]") & (s.rlike(r"(?U)^\d+(?:\.\d+)*\s*[.:]?\s+\w+") | T.any_of(F.lower(s), HEADING_WORDS))


def table_candidate(c: Column, is_text: Column, is_heading: Column) -> Column:
    """Whether the text of a block is a table; never for headings and for blocks that aren't text."""
    c = F.coalesce(c, F.lit(""))
    lines = F.split(c, "\n")
    n = F.size(lines)
    stripped = T.strip(c)
    separators = c.contains("|") | c.contains("\t")
    cells = F.size(T.columns_of(c))
    gaps = F.transform(T.matches(c, "  +"), F.length)
    numeric_words = F.size(F.filter(T.words(c), lambda w: w.rlike(r"\d")))
    aligned = c.contains("  ") & ((cells >= 3) | (numeric_words >= 4)) & (F.size(gaps) >= 2) & (F.array_max(gaps) <= F.array_min(gaps) * 3)
    title = (F.length(c) < 100) & (heading_like(c) | (stripped.endswith(":") & (F.length(stripped) < 50)))
    one = ~title & ((separators & (cells >= 2)) | aligned)
    digits = F.size(T.matches(c, r"\d"))
    short = F.size(F.filter(lines, lambda x: (T.strip(x) != "") & (F.length(T.strip(x)) <= 20)))
    numeric = F.size(F.filter(lines, lambda x: x.rlike(r"\d")))
    double = F.size(F.filter(lines, lambda x: x.contains("  ")))
    signal = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    signals = signal(separators) + signal(T.consistent_columns(lines)) + signal(
        digits / F.greatest(F.length(c), F.lit(1)) > 0.22
    ) + signal(c.contains("  ") & (double >= n * 0.5))
    many = ((n >= 6) & (short / n >= 0.7) & (numeric / n >= 0.3)) | (signals >= 2)
    return F.coalesce(is_text & ~is_heading & (stripped != "") & F.when(n == 1, one).otherwise(many), F.lit(False))


def caption_candidate(c: Column) -> Column:
    """Whether a block's text begins like a caption of a figure or table."""
    return F.lower(T.strip(F.coalesce(c, F.lit("")))).rlike(r"^(figure|fig\.|table)")


def region(y0: Column, y1: Column, height: Column, margin: float = 72.0) -> Column:
    """header, footer or body by the distance to the page's edges."""
    return F.when(y0 < margin, "header").when(y1 > height - margin, "footer").otherwise("body")


def block_kind(c: Column, size: Column) -> Column:
    """title, header, subheader, list_item or paragraph from a block's text and mean font size."""
    c = T.strip(F.coalesce(c, F.lit("")))
    n = F.length(c)
    limit = F.when(T.script_category(c) == "cjk", 120).otherwise(150)
    return (
        F.when((size >= 16) & (n < 120), "title")
        .when((size >= 14) | F.lower(c).rlike(r"^(section|chapter|part|chapitre|partie|\d+\.)\s+"), "header")
        .when((size >= 12) & (n < limit), "subheader")
        .when(c.rlike(r"^[•\-*·]|^\d+[.)]\s+"), "list_item")
        .otherwise("paragraph")
    )


def heading_kind(c: Column, largest: Column, mean: Column, bold: Column, first_page: Column) -> Column:
    """title, header or subheader by size, weight and pattern; what :func:`block_kind` says for the rest."""
    c = T.strip(F.coalesce(c, F.lit("")))
    n = F.length(c)
    cjk = T.script_category(c) == "cjk"
    numbered, section = c.rlike(r"^\d+[.)]\s+"), c.rlike(r"(?i)^(Section|Chapter|Part)\s+\d+:?\s*")
    upper = (n < 50) & (F.upper(c) == c) & (F.lower(c) != c) & (F.size(T.words(c)) <= 5)
    pattern = numbered | section | c.rlike(r"^\d+\.\s+[A-Z]") | c.rlike(r"(?i)^[IVX]+\.\s+") | upper
    title = ((largest >= 16) & (n < 120)) | ((largest >= 14) & bold & (n < 120)) | (
        first_page & (largest >= 14) & (n < 100)
    ) | (cjk & (largest >= 12) & (n < 40))
    return (
        F.when(title, "title")
        .when((largest >= 14) | ((largest >= 12) & bold & (numbered | section)), "header")
        .when((largest >= 12) & bold, "subheader")
        .when(pattern | (cjk & (largest >= 10)), "header")
        .otherwise(block_kind(c, mean))
    )


def size_class(mean: Column) -> Column:
    return F.when(mean >= 14, "large").when(mean >= 11, "medium").otherwise("small")


# ---- equations ------------------------------------------------------------------------------------------------------


def math_flags(c: Column) -> dict[str, Column]:
    """Signals of a span's text that it is an equation."""
    c = F.coalesce(c, F.lit(""))
    ops = F.size(T.matches(c, OPERATORS))
    latin, greek = F.size(T.matches(c, r"\b[a-zA-Z]\b")), F.size(T.matches(c, r"(?U)\b[α-ωΑ-Ω]\b"))
    digit = c.rlike("[0-9]")
    return {
        "math_unicode": c.rlike(MATH_CHARS),
        "latex": c.rlike(LATEX),
        "raised": c.rlike(r"[\x{2070}-\x{209F}]"),
        "operators": ops,
        "operator_pattern": (ops > 0) & (digit | (latin > 0) | c.rlike("[α-ωΑ-Ω]")),
        "variables": (latin + greek >= 2) | ((latin + greek > 0) & digit & (ops >= 1)),
        "math_context": c.rlike(
            r"[(\[][^)\]]*[+\-*/=<>≠≤≥∈∉][^)\]]*[)\]]"
        ) | c.rlike(r"(?U)\b[\w)\]]+\s*/\s*[\w(\[]+\b") | c.rlike(r"\b\d+\s*(≤|>=|<=|≥|<|>)\s*[a-zA-Zα-ωΑ-Ω0-9]+\b") | c.rlike(r"\b[a-zA-Zα-ωΑ-Ω]\s*∈\s*\[[^\]]+\]"),
    }


def math_font(font: Column) -> Column:
    return T.any_of(F.lower(F.coalesce(font, F.lit(""))), MATH_FONTS)


def equation_score(c: Column, neighbours: Column) -> Column:
    """Additive score of a span that neither its font nor LaTeX marks decide; ``neighbours``: spans nearby with mathematical characters."""
    c = F.coalesce(c, F.lit(""))
    f = math_flags(c)
    add = lambda cond, x: F.when(cond, F.lit(float(x))).otherwise(F.lit(0.0))
    n_words = F.size(T.matches(c, r"(?U)\w+"))
    n = F.length(c)
    alnum = F.size(T.matches(c, r"[\p{L}\p{N}]"))
    score = add(f["math_unicode"], 0.6) + add(f["operator_pattern"], 0.5) + add(f["raised"], 0.5) + add(f["variables"], 0.6) + add(
        f["variables"] & (n_words <= 4), 0.2
    ) + add(f["math_context"], 0.5)
    score = score + add((n > 3) & (F.try_divide(f["operators"], n) > 0.2) & (F.try_divide(alnum, n) < 0.7), 0.4)
    score = score - add((n_words >= 6) & (f["operators"] == 0), 0.3) - add(T.strip(c).rlike("[.;:]$") & (f["operators"] == 0), 0.2)
    return score + add(neighbours >= 2, 0.1)


def is_equation(c: Column, font: Column, neighbours: Column, sensitivity: float = 0.7) -> Column:
    """Whether a span is an equation; blank texts and plain numbers of up to four digits aren't."""
    s = T.strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", False).when(math_font(font) | c.rlike(LATEX), True).when(s.rlike(r"^\d{1,4}$"), False).otherwise(
        equation_score(c, neighbours) >= sensitivity
    )


# ---- identity and content -------------------------------------------------------------------------------------------


def identity(source: Column, target: Column, is_header: Column) -> Column:
    """Struct is_identity, should_retry, reason: whether a translation that equals its source is a fault."""
    s, t = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    ns, nt, raw = T.normalised(s), T.normalised(t), T.strip(s)
    words = T.words(s)
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    short = ~raw.contains(" ") & (raw != "") & (
        ((F.length(raw) <= 4) & upper(raw)) | ((F.length(raw) <= 8) & raw.rlike(r"^[A-Z0-9][A-Z0-9\-/.]+$"))
        | ((F.length(raw) <= 6) & raw.rlike(r"^[A-Za-z]{1,4}\d{1,3}[A-Za-z]{0,2}$")) | raw.rlike("^[A-Za-z]{1,3}/[A-Za-z]{1,3}$") | F.lower(raw).isin(UNITS)
    )
    proper = F.size(words).between(2, 3) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    up = F.upper(s)
    r = lambda a, b, why: F.struct(F.lit(a).alias("is_identity"), (b if isinstance(b, Column) else F.lit(b)).alias("should_retry"), F.lit(why).alias("reason"))
    return (
        F.when(T.strip(t) == "", r(True, True, "empty"))
        .when((ns == "") | (ns != nt), r(False, False, "different"))
        .when(ns.isin(ACADEMIC_WORDS), r(True, True, "academic_heading"))
        .when(s.rlike(r"(?U)^[\W\d\s]+$"), r(False, False, "no_letters"))
        .when(T.any_of(up, sorted({x.upper() for x in TECHNICAL_TERMS})), r(False, False, "technical_term"))
        .when(short, r(False, False, "short_token"))
        .when(proper, r(False, False, "proper_noun"))
        .when(ns.isin(COMMON_PHRASES), r(False, False, "common_phrase"))
        .otherwise(r(True, F.coalesce(is_header, F.lit(False)), "identical"))
    )


#: Content score of an academic document; thresholds of identity for its headings and texts, and for those of others.
ACADEMIC_SCORE, ACADEMIC_THRESHOLDS, GENERAL_THRESHOLDS = 60, (0.98, 0.95), (0.95, 0.90)


def identity_threshold(academic: Column, is_header: Column) -> Column:
    """Similarity from which an answer counts as its source again."""
    pick = lambda t: F.when(is_header, F.lit(t[0])).otherwise(F.lit(t[1]))
    return F.when(academic, pick(ACADEMIC_THRESHOLDS)).otherwise(pick(GENERAL_THRESHOLDS))


def skip_reason(c: Column, is_table: Column, source_lang: Column, target_lang: Column, translate_tables: bool = False) -> Column:
    """Why a block isn't translated: table, empty, preserve_lang_xx; null: it is translated."""
    c = F.coalesce(c, F.lit(""))
    low = F.lower(c)
    listed = (low.contains("contents") & (F.length(c) < 100)) | (T.any_of(low, ["figure", "fig.", "table", "tab."]) & (F.length(c) < 200))
    found = language(c)
    foreign = (found["lang"] != F.coalesce(source_lang, F.lit(""))) & (found["lang"] != F.coalesce(target_lang, F.lit(""))) & (found["confidence"] > 0.5)
    return F.when(
        is_table & ~listed & F.lit(not translate_tables), "table"
    ).when(T.strip(c) == "", "empty").when(foreign, F.concat(F.lit("preserve_lang_"), found["lang"]))
