"""Problem 8: sentence boundaries across languages, scripts and line layouts.

Three kinds of statistics are learned from the whole corpus without labels, per language and by log-likelihood ratios:
sentence starters (tokens over-represented behind certain boundaries), abbreviations (words whose period is followed by a
starter far less often than the periods of the language are) and collocations (such a word with a number behind it). For
scripts without periods, the beginnings and endings of lines and the short chunks that only open sentences are learned
instead. Each period is then decided with these statistics; brackets, quotations and the layout of lines come first.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package

#: Log-likelihood ratio from which a word counts as starter, abbreviation or collocation (chi-squared, p = 0.005).
RATIO = 7.88
#: Learned starters up to which they are broadcast; more are joined by a shuffle.
BROADCAST_STARTERS = 500_000
#: A word of a language with fewer periods than this is decided by the statistics of all languages.
FEW = 5
#: Longest chunk that can be an opening phrase; length of Thai line edges.
OPENING, EDGE = 18, 5
#: Letters up to which a word never learned, with a small letter behind its period, is taken for an abbreviation.
SHORT = 4
#: Longest line that can be a heading or formula by its look.
LINE = 80
ALL = "*"

TERMINALS = ".!?。！？।؟…"
_CLOSERS = "\"»”’」』“)]）"
_LINE = re.compile(r"[^\n]+")
_TABLE = re.compile(r"\s*\|")
_CONTENTS = re.compile(r".*(?:\.{4,}|…{2,}|(?:\. ){4,})\s*\d+\s*$")
_LIST = re.compile(r"\s*(?:[•‣◦▪·*–-]|\d{1,3}[.)]|\([a-zA-Z0-9]{1,3}\)|[a-z]\))\s+\S")
_FORMULA = re.compile(r"(?=.*[=≤≥<>+∑∫√±→])(?!.*(?<![\\A-Za-z])[^\W\d_]{3,})", re.S)
_CANDIDATE = re.compile(r"[.!?。！？।؟…]+(?=[\s\"»”’」』“„«‘「『)\]）]|$|[^\W\d_ªº])")
_QUOTE = re.compile(r"\"[^\"]*\"|«[^«»]*»|„[^„“”]*[“”]|“[^“”]*”|‘[^‘’]*’|「[^「」]*」|『[^『』]*』")
_BRACKETS = re.compile("[()（）]")
_OPENS_WORD = frozenset("(（[“\"«„‘")
_NAME_START = re.compile(r"[a-z]-[a-z]{3}")
_THAI = re.compile("[฀-๿]")
_THAI_SPACE = re.compile(r"(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
_START = re.compile(r"(?:\A|\n[ \t\r]*\n|[!?]\s|[!?]\s?\n)\s*([^\s(\"«„“‘]+)")
_PERIOD = re.compile(r"(?<![^\s(\"«„“‘])([^\s(\"«„“‘]*[^\s(\"«„“‘.])\.\s+(?=([^\s(\"«„“‘]+))")


@dataclass
class Statistics:
    """Learned sets, by language code; ALL holds what holds over all languages."""

    abbreviations: dict[str, frozenset] = field(default_factory=dict)
    ordinary: dict[str, frozenset] = field(default_factory=dict)
    numbered: dict[str, frozenset] = field(default_factory=dict)
    starters: dict[str, frozenset] = field(default_factory=dict)
    openings: frozenset = frozenset()
    heads: frozenset = frozenset()
    tails: frozenset = frozenset()

    def abbreviation(self, lang: str, word: str) -> bool | None:
        """Whether the word is an abbreviation; None: unknown."""
        if word in self.abbreviations.get(lang, ()):
            return True
        if word in self.ordinary.get(lang, ()):
            return False
        if word in self.abbreviations.get(ALL, ()):
            return True
        return False if word in self.ordinary.get(ALL, ()) else None


def _is_code(token: str) -> bool:
    return any(c.isdigit() for c in token) or "-" in token


def count_batch(texts: list[str], langs: list[str]) -> Counter:
    """(language, kind, word, next) -> occurrences. Kinds: S starts, T all tokens, P periods, H, E and C Thai line edges and chunks."""
    out: Counter = Counter()
    by: dict[str, list[str]] = {}
    for t, lang in zip(texts, langs):
        if t:
            by.setdefault(lang, []).append(t)
    for lang, group in by.items():
        starts, tokens, periods = Counter(), Counter(), Counter()
        for t in group:
            starts.update(_START.findall(t))
            tokens.update(t.split())
            periods.update(_PERIOD.findall(t))
            if _THAI.search(t):
                for line in _LINE.findall(t):
                    line = line.strip()
                    if _THAI.match(line) and len(line) > 2 * OPENING and not _CONTENTS.match(line):
                        out[lang, "H", line[:EDGE], ""] += 1
                        chunks = line.split()
                        if len(chunks) > 1 and len(chunks[0]) <= OPENING and _THAI.match(chunks[1]):
                            out[lang, "C", chunks[0], ""] += 1
                    if _THAI.match(line[-1:]) and len(line) > 2 * OPENING:
                        out[lang, "E", line[-EDGE:], ""] += 1
        for w, n in starts.items():
            if not _is_code(w):
                out[lang, "S", w, ""] += n
        total = 0
        for w, n in tokens.items():
            total += n
            if not _is_code(w):
                out[lang, "T", w, ""] += n
        out[lang, "T", "", ""] += total
        out[lang, "S", "", ""] += sum(starts.values())
        for (w, x), n in periods.items():
            if not any(c.isdigit() for c in w):
                # which words start sentences only the whole corpus tells; code names are no evidence of a boundary: one key for them
                out[lang, "P", w, "#" if x[0].isdigit() else "~" if _is_code(x) or x == "#" else x] += n
    return out


def learn(docs: DataFrame) -> Statistics:
    """Statistics of a table (text, lang); lang may be null. Counts cover all rows; only what passes the ratio is collected."""
    ship_package(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = count_batch(b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()])
        keys = list(c)
        return pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array(list(c.values()), pa.int64())], ["lang", "kind", "w", "x", "n"]
        )

    spark = docs.sparkSession
    counts = map_arrow(
        docs.select("text", "lang"), run, "lang string, kind string, w string, x string, n bigint"
    ).groupBy("lang", "kind", "w", "x").agg(F.sum("n").alias("n"))
    both = counts.unionByName(counts.withColumn("lang", F.lit(ALL))).groupBy("lang", "kind", "w", "x").agg(F.sum("n").alias("n")).persist()

    def ratio(k, n, p):
        q = F.least(F.greatest(k / n, F.lit(1e-9)), F.lit(1 - 1e-9))
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return 2 * (k * F.log(q / p) + (n - k) * F.log((1 - q) / (1 - p)))

    try:
        s, t = (both.filter(F.col("kind") == k).select("lang", "w", F.col("n").alias(k)) for k in "ST")
        sums = both.filter("w = '' and kind in ('S', 'T')").groupBy("lang").agg(
            F.sum(F.when(F.col("kind") == "S", F.col("n"))).alias("starts"), F.sum(F.when(F.col("kind") == "T", F.col("n"))).alias("tokens")
        )
        st = s.filter("w <> ''").join(t, ["lang", "w"]).join(F.broadcast(sums), "lang")
        st = st.filter((F.col("S") / F.col("starts") > 2 * F.col("T") / F.col("tokens")) & (F.col("S") >= 3))
        starters = st.filter(
            ratio(F.col("S").cast("double"), F.col("starts").cast("double"), F.col("T") / F.col("tokens")) > RATIO
        ).select("lang", F.col("w").alias("x"), F.lit(1).alias("is_start"))
        # three small jobs: one plan over all of it would keep the driver busy with planning
        begins = [(r.lang, r.x) for r in starters.select("lang", "x").collect()]
        near = F.broadcast if len(begins) <= BROADCAST_STARTERS else lambda d: d
        known = spark.createDataFrame(begins, "lang string, x string").withColumn("is_start", F.lit(1))
        anywhere = known.filter(F.col("lang") == ALL).select("x", F.lit(1).alias("is_start_all"))
        p = both.filter("kind = 'P'").join(near(known), ["lang", "x"], "left").join(near(anywhere), "x", "left")
        start = F.coalesce("is_start", "is_start_all") == 1
        w = p.groupBy("lang", "w").agg(
            F.sum("n").cast("double").alias("n"), F.sum(F.when(start, F.col("n")).otherwise(0)).cast("double").alias("k"),
            F.sum(F.when(F.col("x") == "#", F.col("n")).otherwise(0)).cast("double").alias("numbers")
        ).persist()
        rates = {
            r.lang: (r.k / r.n, r.numbers / r.n)
            for r in w.groupBy("lang").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("numbers").alias("numbers")).collect()
        }
        # where nearly all periods of a language stand behind abbreviations, its own rate says nothing: the general one counts
        base = [(k, max(a, rates[ALL][0]), b) for k, (a, b) in rates.items()]
        w2 = w.filter(F.col("n") >= 2).join(F.broadcast(spark.createDataFrame(base, "lang string, p0 double, p1 double")), "lang")
        abbr = (F.col("k") / F.col("n") < F.col("p0") / 2) & (ratio(F.col("k"), F.col("n"), F.col("p0")) > RATIO)
        coll = (F.col("numbers") / F.col("n") > F.col("p1")) & (F.col("numbers") / F.col("n") > 0.5) & (
            ratio(F.col("numbers"), F.col("n"), F.col("p1")) > RATIO
        )
        kind = F.when(coll & abbr, "number").when(abbr, "abbreviation").when((F.col("n") >= FEW) & (F.col("k") / F.col("n") >= F.col("p0") / 2), "ordinary")
        judged = w2.select("lang", "w", kind.alias("what")).filter("what is not null").persist()
        special = judged.filter("what <> 'ordinary'")
        # of the ordinary words only those are ever asked for that are short, are an abbreviation in general, or end a word with periods
        asked = special.filter(F.col("lang") == ALL).select("w").union(w.filter(F.col("w").contains(".")).select(F.substring_index("w", ".", -1))).distinct()
        ordinary = judged.filter("what = 'ordinary'")
        rows = special.collect() + ordinary.filter(F.length("w") <= SHORT).collect() + ordinary.filter(F.length("w") > SHORT).join(
            asked, "w", "left_semi"
        ).select("lang", "w", "what").collect()
        judged.unpersist()
        w.unpersist()
        edge = both.filter((F.col("lang") == ALL) & F.col("kind").isin("H", "E", "C"))
        totals = {r.kind: r.n for r in edge.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        for k, n in totals.items():
            rows += edge.filter((F.col("kind") == k) & (F.col("n") >= 3) & (F.col("n") > 0.0005 * n)).select("lang", "w", F.lit(k).alias("what")).collect()
    finally:
        both.unpersist()
    sets: dict[str, dict[str, set]] = {}
    for r in rows:
        sets.setdefault(r.what, {}).setdefault(r.lang, set()).add(r.w)
    for lang, x in begins:
        sets.setdefault("starter", {}).setdefault(lang, set()).add(x)
    freeze = lambda what: {k: frozenset(v) for k, v in sets.get(what, {}).items()}
    numbered, abbreviations = freeze("number"), freeze("abbreviation")
    for k, v in numbered.items():
        abbreviations[k] = abbreviations.get(k, frozenset()) | v
    one = lambda what: freeze(what).get(ALL, frozenset())
    return Statistics(abbreviations, freeze("ordinary"), numbered, freeze("starter"), one("C"), one("H"), one("E"))


def _ended(text: str, s: int, e: int) -> bool:
    """Whether text[s:e] ends like a sentence, closing marks and white space behind it aside, or with a square bracket."""
    e -= 1
    while e >= s and text[e].isspace():
        e -= 1
    if e >= s and text[e] == "]":
        return True
    while e >= s and (text[e] in _CLOSERS or text[e].isspace()):
        e -= 1
    return e >= s and text[e] in TERMINALS


def _brackets(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """The outermost pairs of round brackets of text[s:e], of any length and depth; brackets without a partner are none."""
    open_: dict[str, list[int]] = {")": [], "）": []}
    pairs = []
    for m in _BRACKETS.finditer(text, s, e):
        c = m.group()
        if c in "(（":
            open_[")" if c == "(" else "）"].append(m.start())
        elif open_[c]:
            pairs.append((open_[c].pop(), m.end()))
    out: list[tuple[int, int]] = []
    for p in sorted(pairs):
        if not out or p[0] >= out[-1][1]:
            out.append(p)
    return out


def split(text: str, stats: Statistics, lang: str = "") -> list[tuple[int, int]]:
    """Sentences of a text as (start, end), in order, white space at both ends left out."""
    out: list[tuple[int, int]] = []
    start = end = -1  # of the prose collected so far
    counted, round_, wide = 0, 0, 0  # its brackets: how far they are counted, and how many stand open
    item = False  # it began with a list marker
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text)]
    bodies = [text[a:b].strip() for a, b in lines]
    last = len(lines) - 1

    def closed() -> bool:
        """Whether the prose could be complete: it ends a sentence and no bracket is open."""
        nonlocal counted, round_, wide
        if counted < start:
            counted, round_, wide = start, 0, 0
        if counted < end:
            round_ += text.count("(", counted, end) - text.count(")", counted, end)
            wide += text.count("（", counted, end) - text.count("）", counted, end)
            counted = end
        return _ended(text, start, end) and round_ <= 0 and wide <= 0

    def flush() -> None:
        nonlocal start
        if start >= 0:
            if item:
                out.append((start, end))
            else:
                _prose(text, start, end, stats, lang, out)
            start = -1

    previous_end = 0
    for i, (a, b) in enumerate(lines):
        body = bodies[i]
        if start >= 0 and (not body or text.count("\n", previous_end, a) > 1):
            flush()
        previous_end = b
        if not body:
            continue
        a += len(text[a:b]) - len(text[a:b].lstrip())
        b = a + len(body)
        if body[0] == "|" or (body[-1].isdigit() and _CONTENTS.match(body)):
            flush()
            out.append((a, b))
            continue
        free = start < 0 or item or closed()
        thai = start >= 0 and not free and "฀" <= text[end - 1] <= "๿"
        if free and _LIST.match(body):
            flush()
            start, end, item = a, b, True
            continue
        alone = i == last or not bodies[i + 1] or text.count("\n", lines[i][1], lines[i + 1][0]) > 1
        if (free or thai) and len(body) < LINE and _FORMULA.match(body):
            flush()
            out.append((a, b))
            continue
        if item and start >= 0:
            if body[0].islower() and not _ended(text, start, end):
                end = b  # the item goes on
                continue
            flush()
        if start >= 0 and free and alone and len(body) < LINE and not _ended(body, 0, len(body)) and not _THAI.search(body) and body[0].upper() == body[0]:
            flush()  # a heading right under a paragraph
            out.append((a, b))
            continue
        if start < 0:
            start, item = a, False
        end = b
    flush()
    return out


def _spans(pattern: re.Pattern, text: str, s: int, e: int) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text, s, e)]


def _inside(spans: list[tuple[int, int]], pos: int) -> tuple[int, int] | None:
    k = bisect_right(spans, (pos, 1 << 60)) - 1
    return spans[k] if k >= 0 and spans[k][0] < pos < spans[k][1] else None


def _prose(text: str, s: int, e: int, stats: Statistics, lang: str, out: list[tuple[int, int]]) -> None:
    """Append the sentences of the running text text[s:e]."""
    has = text[s:e]
    parens = _brackets(text, s, e) if "(" in has or "（" in has else []
    quotes = _spans(_QUOTE, text, s, e) if any(c in has for c in "\"«„“‘「『") else []
    if quotes and parens:
        quotes = [q for q in quotes if not _inside(parens, q[0])]
    cuts = []
    for m in _CANDIDATE.finditer(text, s, e):
        at, stop = m.span()
        if parens and _inside(parens, at):
            continue
        q = _inside(quotes, at) if quotes else None
        if q:
            if text[stop : q[1] - 1].strip():
                continue
            stop = q[1]
            if stop >= e:
                break
            rest = text[stop : stop + 40].lstrip()
            if rest[:1] in ".,;:!?。，；、":
                continue
            if text[max(s, q[0] - 3) : q[0]].rstrip()[-1:] in (":", "："):
                cuts.append(stop)
            elif rest[:1].isupper() and not rest[:1].islower():
                cuts.append(stop)
            continue
        while stop < e and text[stop] in _CLOSERS and not (text[stop] in "\"“’" and _opens(quotes, stop)):
            stop += 1
        if stop >= e:
            break
        if _boundary(text, s, at, stop, e, m.group(), stats, lang):
            cuts.append(stop)
    if _THAI.search(has):
        cuts = sorted({*cuts, *_thai_cuts(text, s, e, parens, quotes, cuts, stats)})
    at = s
    for c in [*cuts, e]:
        part = text[at:c]
        a = at + len(part) - len(part.lstrip())
        b = at + len(part.rstrip())
        if a < b:
            out.append((a, b))
        at = c


def _opens(quotes: list[tuple[int, int]], pos: int) -> bool:
    k = bisect_right(quotes, (pos, 1 << 60)) - 1
    return k >= 0 and quotes[k][0] == pos


def _boundary(text: str, s: int, at: int, stop: int, e: int, mark: str, stats: Statistics, lang: str) -> bool:
    """Whether the sentence ends at ``stop``, behind the mark that begins at ``at``."""
    nxt = text[stop]
    glued = not nxt.isspace()
    head = text[stop : stop + 60].lstrip()
    first = head[:1]
    if glued:
        if nxt in ",;:，；、)" or nxt.isdigit():
            return False
        if nxt.isalpha() and nxt.islower() and not _NAME_START.match(head):
            return False
    if mark[0] == "…" or (len(mark) > 1 and set(mark) == {"."}):
        return first.isupper()
    if mark[0] != ".":
        return True
    if len(mark) > 1 and not set(mark) <= {"."}:
        return True
    if text[stop - 1] in ")]）" and text[at - 1 : at] in ")]":
        return True
    k = at
    while k > s and not text[k - 1].isspace() and text[k - 1] not in _OPENS_WORD:
        k -= 1
    word = text[k:at]
    if not word:
        return not glued
    if len(word) == 1 and word.isalpha() and word.isupper():
        return False
    if any(c.isdigit() for c in word) or unicodedata.category(word[-1])[0] not in "LM":
        return not (glued and "/" in word)
    if glued and ("/" in word or "@" in word):
        return False
    known = stats.abbreviation(lang, word)
    if known is None and "." in word:
        known = stats.abbreviation(lang, word.rpartition(".")[2]) if glued or word.rpartition(".")[2] in stats.ordinary.get(lang, ()) else True
    if known:
        # an abbreviation can end a sentence too: a starter that is no name behind it says so, unless it wants a number
        token = head.split(None, 1)[0] if head else ""
        return (
            token in stats.starters.get(lang, ()) or token in stats.starters.get(ALL, ())
        ) and not _is_code(token) and word not in stats.numbered.get(lang, ())
    if known is None and len(word) <= SHORT and first.islower() and not _NAME_START.match(head):
        return False
    return True


def _thai_cuts(text: str, s: int, e: int, parens: list, quotes: list, cuts: list[int], stats: Statistics) -> list[int]:
    """Boundaries at white space in text without periods."""
    out = []
    begin = s  # of the chunk on the left
    marks = sorted(cuts)
    for m in _THAI_SPACE.finditer(text, s, e):
        a, b = m.span()
        if (parens and _inside(parens, a)) or (quotes and _inside(quotes, a)):
            continue
        k = bisect_right(marks, a) - 1
        if k >= 0:
            begin = max(begin, marks[k])
        left, right = text[a - 1], text[b]
        left_thai, right_thai = "฀" <= left <= "๿", "฀" <= right <= "๿"
        chunk = text[begin:a].strip()
        head, tail = text[b : b + EDGE], text[a - EDGE : a]
        cut = False
        if left_thai and right_thai:
            cut = chunk not in stats.openings
        elif left_thai:
            if right.isalpha():
                words = re.match(r"[^฀-๿\n]*", text[b:e]).group().split()
                name = words and _is_code(words[0])
                cut = right > "\u02af" or len([w for w in words if w.isalpha() and len(w) > 1]) >= 4 or bool(
                    name and tail in stats.tails and chunk not in stats.openings
                )
            elif right in "“\"«":
                cut = False
        elif right_thai:
            if left in ")]@$" or left in "”\"»" or left.isalnum():
                introduced = False
                if left in "”\"»" and quotes:
                    q = next((q for q in quotes if q[1] == a), None)
                    introduced = bool(q) and text[max(s, q[0] - 3) : q[0]].rstrip()[-1:] in (":", "：")
                cut = introduced or (head in stats.heads and not (left.isdigit() and "." not in chunk and len(chunk) < 3))
                if any(text[b:].startswith(o) for o in stats.openings):
                    cut = True
        if cut:
            out.append(a)
            begin = b
        elif not (left_thai and right_thai):
            continue
    return out


def sentences(docs: DataFrame, stats: Statistics | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of each sentence of each document; positions count code points.

    ``docs`` has doc_id, text, lang (null: unknown). Null, empty and blank texts have no rows; repeated rows give repeated
    rows; an empty table gives an empty table; other columns are ignored. Texts are split whole, whatever their length.
    """
    stats = stats or learn(docs)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, ends = [], [], []
        for i, (t, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            if t:
                for s, e in split(t, stats, lang or ""):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start_pos", "end_pos"]
        )

    return map_arrow(docs.select("doc_id", "text", "lang"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, start_pos int, end_pos int")
