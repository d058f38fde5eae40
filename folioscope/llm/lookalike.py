"""Problem 4: bring texts that print alike to one form.

``canonical`` removes what can't be seen (marks that don't print, kinds of space, character width, composition, ligatures);
the repair then works token by token. The script of a token is that of its letters which look like no letter of another
script; a token without such letters goes by the script that dominates its document (or its text, where no document is named).
Look-alike letters of the other scripts are replaced where the result is a word of the corpus vocabulary: a token of one
script that stands somewhere in the corpus. What no word backs stays as it is in the repaired text; for comparing it takes the
reading of its script, so that two altered copies of a word that nowhere stands unaltered still meet.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package

# Letters of Cyrillic and Greek that print as a Latin letter, each above its twin.
CYRILLIC = "аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅԌ"
CYRILLIC_TWINS = "aeopcyxijsdhqwABEKMHOPCTXYIJSG"
GREEK = "ονρυϲιαΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ"
GREEK_TWINS = "ovpuciaABEZHIKMNOPTYXCj"
TO_LATIN = dict(zip(CYRILLIC + GREEK, CYRILLIC_TWINS + GREEK_TWINS))
_LATIN_CYRILLIC, _LATIN_GREEK = dict(zip(CYRILLIC_TWINS, CYRILLIC)), dict(zip(GREEK_TWINS, GREEK))
TO_CYRILLIC = _LATIN_CYRILLIC | {g: _LATIN_CYRILLIC[t] for g, t in zip(GREEK, GREEK_TWINS) if t in _LATIN_CYRILLIC}
TO_GREEK = _LATIN_GREEK | {c: _LATIN_GREEK[t] for c, t in zip(CYRILLIC, CYRILLIC_TWINS) if t in _LATIN_GREEK}
#: Typographic ligatures, the two unbreaking hyphens, and the micro sign: no visible difference to what they stand for.
SAME_LOOK = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "‐": "-", "‑": "-", "µ": "μ"}


@lru_cache(1)
def _table() -> dict[int, str | None]:
    """Code point -> replacement, for everything that changes no picture."""
    table: dict[int, str | None] = {}
    for cp in [*range(0xFF01, 0xFFEF), 0x3000]:
        d = unicodedata.decomposition(chr(cp))
        if d.startswith(("<wide>", "<narrow>")):
            table[cp] = unicodedata.normalize("NFKC", chr(cp))
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c == "Zs":
            table[cp] = " "
        elif c == "Cf" and not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2)):
            table[cp] = None
        elif c == "Cc" and cp not in (9, 10, 11, 12, 13):
            table[cp] = None
    for cp in (9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029):
        table[cp] = " "
    for cp in [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]:
        table[cp] = None
    return table | {ord(k): v for k, v in SAME_LOOK.items()}


def canonical(text: str) -> str:
    """One form of all texts that differ in width, kind of space, marks that don't print, composition or ligature only."""
    if text.isascii() and text.isprintable():
        return text.strip()
    t = unicodedata.normalize("NFD", text).translate(_table())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(_table())).strip()


_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
#: What parts the words of a form, as Java has it.
_GAP = r"[^\p{L}\p{No}\p{Nl}\x{0300}-\x{036F}]+"
_FOREIGN = re.compile("[Ͱ-ԯ]")
_SKELETON = str.maketrans(TO_LATIN)
_MAPS = {"l": _SKELETON, "c": str.maketrans(TO_CYRILLIC), "g": str.maketrans(TO_GREEK)}
_ALIKE = {*TO_LATIN, *TO_CYRILLIC, *TO_GREEK}
_FIRM = {k: re.compile(f"[{r}]") for k, r in (("l", "A-Za-zÀ-ɏ"), ("c", "Ѐ-ԯ"), ("g", "Ͱ-Ͽ"))}
SCRIPTS = "lcg"


@lru_cache(1 << 12)
def _script(c: str) -> str:
    """The script of a letter among the three with look-alikes, else nothing."""
    return next((k for k, p in _FIRM.items() if p.match(c)), "")


def firm_letters(text: str) -> tuple[int, int, int]:
    """Numbers of Latin, Cyrillic and Greek letters that look like no letter of another script."""
    n = {"l": 0, "c": 0, "g": 0, "": 0}
    for c in text:
        if c not in _ALIKE:
            n[_script(c)] += 1
    return n["l"], n["c"], n["g"]


def readings(word: str, order: str) -> list[str]:
    """The forms of one script that a token can stand for, the likeliest first; ``order``: scripts by their weight in the document."""
    firm = {_script(c) for c in word if c not in _ALIKE} - {""}
    if len(firm) > 1:
        return []
    out = []
    for k in firm or order:
        new = word.translate(_MAPS[k])
        if {_script(c) for c in new} <= {k, ""}:
            out.append(new)
    return out


def proposals(form: str, order: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, readings) of the tokens of a canonical text whose likeliest reading isn't what stands there."""
    out = []
    for m in _WORD.finditer(form):
        w = m.group()
        if any(c in _ALIKE for c in w) and (r := readings(w, order)) and r[0] != w:
            out.append((*m.span(), r))
    return out


def skeleton(text: str) -> str:
    """The text with each look-alike letter as its Latin twin."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SKELETON)) if _FOREIGN.search(text) else text


def canonical_texts(df: DataFrame, id_col: str = "span_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, form (canonical text), l, c, g (its letters that look like no other script's), foreign; null and blank texts give no row."""
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    cols = [id_col, *keep]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        forms, take = [], []
        for i, t in enumerate(b.column(0).to_pylist()):
            f = canonical(t) if t else ""
            if f:
                take.append(i)
                forms.append(f)
        foreign = [not f.isascii() and bool(_FOREIGN.search(f)) for f in forms]
        letters = [firm_letters(f) for f in forms]
        kept = b.take(pa.array(take, pa.int64())).columns[1:]
        counts = [pa.array([n[k] for n in letters], pa.int32()) for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(forms, pa.string()), *counts, pa.array(foreign, pa.bool_())], [*b.schema.names[1:], "form", *SCRIPTS, "foreign"]
        )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "form string, l int, c int, g int, foreign boolean"])
    return map_arrow(df.select(df[text_col].alias("__text"), *cols), run, schema)


_FIXES = "array<struct<start:int,end:int,readings:array<string>>>"


def _order():
    """Column: the scripts by their letters l, c, g, the Latin one first among equals."""
    ranked = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(SCRIPTS)]))
    return F.array_join(F.transform(ranked, lambda x: x["k"]), "")


def _with_fixes(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Rows (cols, form, order) that have proposals, with them."""
    kinds = dict(rows.dtypes)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("readings", pa.list_(pa.string()))]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fixes, take = [], []
        for i, (form, order) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if p := proposals(form, order):
                take.append(i)
                fixes.append([{"start": s, "end": e, "readings": r} for s, e, r in p])
        kept = b.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([kept.column(0), *kept.columns[2:], pa.array(fixes, kind)], ["form", *cols, "fixes"])

    schema = ", ".join(["form string", *(f"`{c}` {kinds[c]}" for c in cols), f"fixes {_FIXES}"])
    return map_arrow(rows.select("form", "order", *cols), run, schema)


def repaired_texts(df: DataFrame, id_col: str = "span_id", text_col: str = "text", keep: tuple[str, ...] = (), document: str | None = None) -> DataFrame:
    """id, kept columns, repaired (script-aware repair backed by the corpus vocabulary), key (what texts that print alike share).

    ``document``: a kept column; its rows decide together which script tokens of look-alikes only are read in. Vocabulary: the
    tokens of one script in all canonical texts; only proposed readings are looked up in it, so that the shuffle carries those
    words and not texts. ``key`` is the repaired text with the tokens that no word backs in their likeliest reading. Null and
    blank texts have no row; rows of a null document keep their canonical form; repeated rows give repeated rows; an empty
    table gives an empty table.
    """
    cols = [id_col, *keep]
    forms = canonical_texts(df, id_col, text_col, keep).persist(StorageLevel.DISK_ONLY)
    forms.count()  # else the stages that read it at the same time would each work it out
    if document is None:
        scripts = forms.filter("foreign").withColumn("order", _order())
    else:  # documents of one script need no look at their texts
        of = forms.groupBy(document).agg(
            *[F.sum(k).alias(k) for k in SCRIPTS], F.max("foreign").alias("foreign")
        ).filter("foreign").select(document, _order().alias("order"))
        scripts = forms.select(*cols, "form").join(of, document)
    dirty = _with_fixes(scripts.select("form", "order", *cols), cols).persist(StorageLevel.DISK_ONLY)
    dirty.count()
    wanted = dirty.select(F.explode(F.flatten("fixes.readings")).alias("word")).distinct()
    # any text's tokens count; those of several scripts can't be among the wanted ones
    words = forms.select(F.explode(F.split("form", _GAP)).alias("word")).join(wanted, "word", "left_semi").distinct()
    asked = dirty.select("form", F.explode(F.array_distinct(F.flatten("fixes.readings"))).alias("word")).distinct()
    known = asked.join(words, "word", "left_semi").groupBy("form").agg(F.collect_set("word").alias("known"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ([document] if document else [])]
    todo = dirty.select(
        "form", "fixes", *([document] if document else [])
    ).dropDuplicates(["form", *([document] if document else [])]).join(known, "form", "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        at = {n: i for i, n in enumerate(b.schema.names)}
        texts, keys = [], []
        for form, fixes, known in zip(*(b.column(at[c]).to_pylist() for c in ("form", "fixes", "known"))):
            known = set(known or ())
            repaired, key, done = [], [], 0
            for x in fixes:
                word = next((r for r in x["readings"] if r in known), None)
                repaired += [form[done : x["start"]], form[x["start"] : x["end"]] if word is None else word]
                key += [form[done : x["start"]], x["readings"][0] if word is None else word]
                done = x["end"]
            texts.append("".join([*repaired, form[done:]]))
            keys.append("".join([*key, form[done:]]))
        kept = [b.column(at[c]) for c in ("form", *([document] if document else []))]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(texts, pa.string()), pa.array(keys, pa.string())], ["form", *([document] if document else []), "repaired", "key"]
        )

    kinds = dict(df.dtypes)
    fixed = map_arrow(todo, run, ", ".join(["form string", *([f"`{document}` {kinds[document]}"] if document else []), "repaired string, key string"]))
    on = F.col("a.form") == F.col("b.form")
    for c in same:
        on = on & c
    return forms.alias("a").join(fixed.alias("b"), on, "left").select(
        *[F.col(f"a.{c}") for c in cols], F.coalesce("b.repaired", "a.form").alias("repaired"), F.coalesce("b.key", "a.form").alias("key")
    )


def alike_pairs(spans: DataFrame) -> DataFrame:
    """(span_id_a, span_id_b): spans of one document that print alike without being the same characters.

    Spans delivered again count once; null and blank texts are in no pair; a document with a null id has none. Texts and keys
    are told apart by 128-bit digests. Groups whose texts are all the same characters are dropped; in the others the few
    different texts are paired first and their spans after that, so that copies are never compared with each other.
    """
    one = spans.select("span_id", "doc_id", "text").dropDuplicates(["span_id"]).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    r = repaired_texts(one.withColumn("drawn", F.unhex(F.md5("text"))), keep=("doc_id", "drawn"), document="doc_id")
    r = r.select("span_id", "doc_id", "drawn", F.unhex(F.md5("key")).alias("look")).persist(StorageLevel.DISK_ONLY)
    r.count()
    mixed = r.groupBy("doc_id", "look").agg(F.min("drawn").alias("lo"), F.max("drawn").alias("hi")).filter("lo <> hi").select("doc_id", "look")
    m = r.join(mixed, ["doc_id", "look"], "left_semi")
    v = m.select("doc_id", "look", "drawn").distinct()
    two = v.withColumnRenamed("drawn", "one").join(v.withColumnRenamed("drawn", "other"), ["doc_id", "look"]).filter("one < other")
    p = two.join(
        m.select("doc_id", F.col("drawn").alias("one"), F.col("span_id").alias("x")), ["doc_id", "one"]
    ).join(m.select("doc_id", F.col("drawn").alias("other"), F.col("span_id").alias("y")), ["doc_id", "other"])
    return p.select(F.least("x", "y").alias("span_id_a"), F.greatest("x", "y").alias("span_id_b"))
