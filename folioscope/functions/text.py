"""Text expressions: joining, normalising, prefixes, numbering, bullets, columns, cleaning, keys, fonts. All are Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------------------------------

#: A protected token: two at signs around a name, a four-digit number and eight hexadecimal digits.
PLACEHOLDER = r"@@[A-Z]+(?:_[A-Z]+)+_\d{4}_[A-F0-9]{8}@@"
PLACEHOLDER_FORMS = (r"@@[A-Z0-9]+_[A-Z0-9_]+_\d{4}_[A-F0-9]{8}@@", r"<<[^<>]+>>", r"⟦[^⟦⟧]+⟧")
NUMBER = r"\b\d+\.?\d*\b"
NUMBER_EXP = r"\b\d+\.?\d*(?:[eE][+-]?\d+)?\b"
NUMBER_COMMA = r"\b\d+(?:[.,]\d+)?\b"
BULLET_LINE = r"(?m)^[\s]*[-•*]\s"
SECTION_PREFIX = r"(?i)^(section|chapter|part|chapitre|partie)\s+(\d+[.\)]?)\s*:?\s*"
SECTION_WORDS = {
    "fr": {"section": "Section", "chapter": "Chapitre", "part": "Partie"},
    "es": {"section": "Sección", "chapter": "Capítulo", "part": "Parte", "chapitre": "Capítulo", "partie": "Parte"},
    "de": {"section": "Abschnitt", "chapter": "Kapitel", "part": "Teil", "chapitre": "Kapitel", "partie": "Teil"},
    "en": {"chapitre": "Chapter", "partie": "Part"},
}
#: Kind, pattern, group of the number (0: none) and of the separator, in the order in which they are tried.
NUMBERINGS = (
    ("decimal", r"^\s*(\d+(?:\.\d+)*)\s*([.)])\s+", 1, 2),
    ("roman", r"(?i)^\s*([IVXLCDM]+)\s*([.)])\s+", 1, 2),
    ("alpha", r"^\s*([A-Z])\s*([.)])\s+", 1, 2),
    ("section", r"(?i)^\s*(?:section|chapter|fig(?:ure)?|table)\s+(\d+(?:\.\d+)*)\s*([:.\-])\s*", 1, 2),
    ("bullet", r"^\s*([•\-*·])\s+", 0, 1),
)
BULLETS = "•-*·▪▫"
BULLET_SPILLOVER = ["rules", "conserver", "ne pas traduire", "critique", "do not translate", "je suis ravi", "pouvez-vous", "comment puis-je"]
SPILLOVER_WORDS = [
    "placeholder", "conserver", "mémorisez", "rappelez-vous", "critique", "critical", "do not", "ne pas", "forbidden", "interdit", "must", "should", "required",
    "mandatory", "obligatoire", "conserve", "remember", "retain", "preserve exactly"
]
SPILLOVER_PREFIXES = [
    r"here\s+is\s+the\s+translation", r"here's\s+the\s+translation", r"the\s+translation\s+is", r"translated\s+text", "translation", "output", "result",
    r"voici\s+la\s+traduction", r"la\s+traduction\s+est", r"texte\s+traduit", "traduction", "sortie", "résultat",
]
SPILLOVER_LINES = [
    r"n'oubliez pas\s*[:：].*", r".*n'oubliez pas\s*[:：].*", r"rappel\s*[:：].*", r"remarque\s*[:：].*", r"attention\s*[:：].*", r"note\s*[:：].*",
    "sortez uniquement.*", "afficher uniquement.*", "ne incluez.*",
    "vous devez.*", "il faut.*", "veuillez.*", "les éléments suivants.*", "le nom.*doit être.*", ".*code erreur.*", r".*\(obligatoire\).*",
    r".*\(facultative?\).*",
    "output only.*", "do not include.*", "you must.*", "please.*", r"remember\s*[:：].*", r"critical\s*[:：].*", r"important\s*[:：].*", r"instructions?\s*[:：].*",
    r"traduction\s*[:：]\s*", r"translation\s*[:：]\s*",
]
SPILLOVER_ONLY = [
    "n'oubliez pas", "rappel", "remarque", "attention", "note", "important", "critical", "remember", "souviens-toi", "instructions", "instruction"
]
SPILLOVER_SHORT = ["rappel", "remarque", "n'oubliez", "attention", "note", "sortez"]
SPILLOVER_MARKERS = [
    "code erreur", "error code", "obligatoire", "required", "facultative", "optional", "formulaire", "form", "saisie", "input", "administrateur",
    "administrator"
]
#: Version of the prompts, a part of cache keys.
PROMPT_VERSION = "v3.1"
GENERIC_RESPONSES = ["je suis ravi", "pouvez-vous", "i'm happy to help", "can you"]
LATEX_ESCAPES = (
    ("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"),
    ("^", r"\textasciicircum{}")
)


# ---- building blocks ------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """The text without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between white space; an empty or blank text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def normalised(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs in the text."""
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def line_count(c: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"(?U)\S")))


def block_text(lines: Column, span_sep: str = "", strip_all: bool = False) -> Column:
    """Text of an array of lines of spans: spans joined by ``span_sep``, lines by line breaks, line breaks (or all white space) stripped."""
    t = F.array_join(F.transform(lines, lambda ln: F.array_join(F.transform(ln.spans, lambda s: F.coalesce(s.text, F.lit(""))), span_sep)), "\n")
    return strip(t) if strip_all else F.regexp_replace(t, r"^\n+|\n+$", "")


# ---- prefixes, numbering, bullets -----------------------------------------------------------------------------------


def section_prefix(c: Column) -> tuple[Column, Column]:
    """(prefix, content) of a heading such as ``Section 1: Title``; without one an empty prefix and the text itself."""
    prefix = F.regexp_extract(c, SECTION_PREFIX, 0)
    return prefix, F.when(prefix == "", c).otherwise(strip(F.substring(c, F.length(prefix) + 1, F.length(c))))


def translated_section_prefix(prefix: Column, lang: str) -> Column:
    """The prefix with its keyword in the target language, its number, and the colon that the language sets."""
    word, number = F.regexp_extract(prefix, SECTION_PREFIX, 1), F.regexp_extract(prefix, SECTION_PREFIX, 2)
    table = SECTION_WORDS.get(lang, {})
    if table:
        word = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(word)), word)
    return F.when(prefix == "", "").otherwise(F.concat(word, F.lit(" "), number, F.lit(" : " if lang == "fr" else ": ")))


def with_section_prefix(translation: Column, prefix: Column, lang: str) -> Column:
    """The translation, with the translated prefix put before it where it has none in any language."""
    return F.when((prefix == "") | translation.rlike(SECTION_PREFIX), translation).otherwise(F.concat(translated_section_prefix(prefix, lang), translation))


def numbering(c: Column) -> Column:
    """Struct kind, number, separator, prefix, rest of the first kind of numbering that a text begins with; empty kind: none."""
    c = F.coalesce(c, F.lit(""))

    def pick(value) -> Column:
        out = F.lit("")
        for n in reversed(NUMBERINGS):
            out = F.when(c.rlike(n[1]), value(n)).otherwise(out)
        return out

    prefix = pick(lambda n: F.regexp_extract(c, n[1], 0))
    number = pick(lambda n: F.regexp_extract(c, n[1], n[2]) if n[2] else F.lit(""))
    return F.struct(
        pick(lambda n: F.lit(n[0])).alias("kind"), number.alias("number"), pick(lambda n: F.regexp_extract(c, n[1], n[3])).alias("separator"),
        prefix.alias("prefix"), F.substring(c, F.length(prefix) + 1, F.length(c)).alias("rest")
    )


def keep_numbering(source: Column, target: Column) -> Column:
    """The target, with the source's numbering put before it where it has none at all."""
    s, t = numbering(source), numbering(target)
    section = F.regexp_extract(source, r"(?i)^(section\s+\d+\s*[:.\-]\s*)", 1)
    head = F.when((section != "") & ~F.lower(target).startswith(F.lower(section)), section).otherwise(s["prefix"])
    return F.when((s["prefix"] == "") | (t["prefix"] != ""), target).otherwise(F.concat(head, target))


def bullet_of(line: Column) -> Column:
    """The bullet that a line begins with, if a blank or a digit follows it; else empty."""
    return F.regexp_extract(line, rf"^\s*([{BULLETS.replace('-', chr(92) + '-')}])[ \d]", 1)


def keep_bullets(source: Column, target: Column) -> Column:
    """Target lines with the bullet of the source line at the same place; texts of one line and sources without bullets change nothing.

    Blank lines and lines of instructions are left out. A target line behind the source's last gets the first bullet of the
    source if more than half of its lines have one.
    """
    def full(c):
        return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    s, t = full(source), full(target)
    marks = F.transform(s, bullet_of)
    used = F.filter(marks, lambda b: b != "")
    extra = F.when(F.size(used) > F.size(s) * 0.5, F.get(used, F.lit(0))).otherwise("")
    kept = F.filter(t, lambda x: ~any_of(F.lower(x), BULLET_SPILLOVER))

    def one(line: Column, i: Column) -> Column:
        want = F.when(i < F.size(s), F.get(marks, i)).otherwise(extra)
        has = bullet_of(line)
        content = F.when(has == "", line).otherwise(strip(F.substring(line, F.lit(2), F.length(line))))
        return F.when((want == "") | (has == want), line).otherwise(F.concat(want, F.lit(" "), content))

    unchanged = ((F.size(s) <= 1) & (F.size(t) <= 1)) | (F.size(used) == 0) | (F.size(kept) == 0)
    return F.when(unchanged, target).otherwise(F.array_join(F.transform(kept, one), "\n"))


def truncated(c: Column, limit: int) -> Column:
    """At most ``limit`` characters and an ellipsis, cut at the last blank if it lies in the last fifth, without final punctuation."""
    head = F.substring(c, 1, limit)
    last = F.when(F.instr(head, " ") > 0, limit - F.instr(F.reverse(head), " ")).otherwise(-1)
    cut = F.when(last > 0.8 * limit, F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(cut, "[.,;:!?]+$", ""), F.lit("...")))


def columns_of(line: Column) -> Column:
    """Cells of a line: by bars, else by tabs, else by two blanks or more; empty cells left out."""
    parts = F.when(line.contains("|"), F.split(line, r"\|")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\s{2,}"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def consistent_columns(lines: Column) -> Column:
    """Whether at least two lines have two cells or more and their numbers of cells differ by one at most."""
    n = F.filter(F.transform(lines, lambda x: F.size(columns_of(x))), lambda k: k >= 2)
    return (F.size(n) >= 2) & (F.array_max(n) - F.array_min(n) <= 1)


# ---- cleaning -------------------------------------------------------------------------------------------------------


def has_spillover(c: Column) -> Column:
    """Whether the text holds a word of instructions that no translation should hold."""
    return any_of(F.lower(c), SPILLOVER_WORDS)


def clean_spillover(c: Column) -> Column:
    """The text without code fences, surrounding quotes, announcing prefixes, instruction lines and paragraphs of forms; blank texts unchanged."""
    t = strip(c)
    t = F.regexp_replace(t, r"(?s)```.*?```", "")
    t = F.regexp_replace(t, r"^[\"'](.+)[\"']$", "$1")
    for p in SPILLOVER_PREFIXES:
        t = strip(F.regexp_replace(t, rf"(?i)^{p}:?\s*", ""))
    bad = "^(?:" + "|".join(f"(?:{p})" for p in SPILLOVER_LINES) + ")$"
    lines = F.filter(F.split(t, "\n"), lambda x: ~(F.lower(strip(x)).rlike(bad) | F.lower(strip(x)).isin(SPILLOVER_ONLY)))
    paragraphs = F.filter(
        F.transform(F.split(F.array_join(lines, "\n"), "\n\n"), strip),
        lambda p: (p != "") & ~((F.length(p) < 50) & any_of(F.lower(p), SPILLOVER_SHORT)) & ~any_of(F.lower(p), SPILLOVER_MARKERS)
    )
    out = F.regexp_replace(F.array_join(paragraphs, "\n\n"), r"\n{3,}", "\n\n")
    out = strip(F.regexp_replace(out, r"(?m)[ \t]+$", ""))
    return F.when(strip(c) == "", c).otherwise(out)


def latex_escaped(c: Column) -> Column:
    """The text with LaTeX's special characters escaped, one after another in the fixed order (later steps see earlier ones' braces)."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), LATEX_ESCAPES, c)


# ---- keys, fonts, colours -------------------------------------------------------------------------------------------


def block_id(page: Column, x0: Column, y0: Column, x1: Column, y1: Column, text: Column) -> Column:
    """Stable id of a block from its page, its box rounded to hundredths and its text."""
    r = [F.round(v, 2).cast("string") for v in (x0, y0, x1, y1)]
    raw = F.concat_ws("_", page.cast("string"), *r, F.substring(F.md5(text), 1, 8))
    return F.concat(F.lit("b_"), page.cast("string"), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 12))


def cache_key(backend: Column, model: Column, text: Column, src: Column, tgt: Column, version: Column) -> Column:
    """Key of a cached translation: changes with everything that could change its result."""
    parts = [F.coalesce(x, F.lit("")) for x in (backend, model, text, src, tgt, version)]
    return F.concat(F.lit("cache_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def memory_key(src: Column, tgt: Column, text: Column) -> Column:
    """Key of a translation-memory entry: the text itself up to 100 characters, its hash beyond."""
    return F.concat(src, F.lit("-"), tgt, F.lit(":"), F.when(F.length(text) <= 100, text).otherwise(F.md5(text)))


def script_category(c: Column) -> Column:
    """cjk, cyrillic or latin, in this order of priority."""
    return F.when(c.rlike("[一-鿿぀-ヿ가-힯]"), "cjk").when(c.rlike("[Ѐ-ӿ]"), "cyrillic").otherwise("latin")


def font_struct(raw: Column, flags: Column) -> Column:
    """Struct normalized, family, weight, style of a raw font name: subset tag cut off, style words and flag bits read."""
    name = F.regexp_replace(raw, r"^[A-Z]{6}\+", "")
    low = F.lower(name)
    bold = low.contains("bold") | (F.coalesce(flags, F.lit(0)).bitwiseAND(16) > 0)
    italic = low.contains("italic") | low.contains("oblique") | (F.coalesce(flags, F.lit(0)).bitwiseAND(2) > 0)
    return F.struct(
        name.alias("normalized"), F.substring_index(name, "-", 1).alias("family"), F.when(bold, "bold").otherwise("normal").alias("weight"),
        F.when(italic, "italic").otherwise("normal").alias("style")
    )


def font_key(raw: Column, flags: Column) -> Column:
    """The font name with the weight and style of its flags put behind it where it doesn't name them; a null name is empty."""
    name, bits = F.coalesce(raw, F.lit("")), F.coalesce(flags, F.lit(0))
    low = F.lower(name)
    bold = F.when((bits.bitwiseAND(16) > 0) & ~low.contains("bold"), " Bold").otherwise("")
    italic = F.when((bits.bitwiseAND(2) > 0) & ~low.contains("italic") & ~low.contains("oblique"), " Italic").otherwise("")
    return F.concat(name, bold, italic)


def font_for(text: Column, raw: Column) -> Column:
    """The font without its subset tag where all of a text's characters are Latin-1 or white space, else the variant of the wide font that its name asks for."""
    name = F.trim(F.coalesce(raw, F.lit("")))
    own = F.when(name.contains("+"), F.regexp_replace(name, r"^[^+]*\+", "")).otherwise(name)
    own = F.when(own == "", "Times-Roman").otherwise(own)
    low = F.lower(own)
    bold, italic = low.contains("bold"), low.contains("italic") | low.contains("oblique")
    wide = F.when(bold & italic, "DejaVuSans-BoldOblique").when(bold, "DejaVuSans-Bold").when(italic, "DejaVuSans-Oblique").otherwise("DejaVuSans")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)[^\x{00}-\x{FF}\s]"), wide).otherwise(own)


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed colour as numbers from 0 to 1."""
    part = lambda k: F.shiftright(color, k).bitwiseAND(255) / F.lit(255.0)
    return part(16), part(8), part(0)
