"""How texts end: marks left by a break, likelihood of an ending, completeness against the text that was asked for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package

#: Distinct n-grams that a task counts before it hands them on.
HELD = 200_000
#: Distinct endings up to which they and their counts are broadcast (some tens of megabytes); beyond, counts are joined.
BROADCAST_ENDINGS = 400_000
#: Share of an n-gram's occurrences that end a sentence below which an ending is unlikely; occurrences needed to judge a long n-gram.
UNLIKELY, SUPPORT = 0.12, 4
#: A text without a full stop that has this share of its request's length or less is incomplete.
SHORT = 0.35
#: Longest heading; a heading seen this often in the corpus is complete however its last words are used elsewhere.
HEADING, OFTEN = 60, 3

TERMINALS = ".!?。！？।؟"
# What a broken transfer leaves behind the break: a mark of omission, half a character, placeholder, tag, entity or escape, closing JSON.
_JUNK = re.compile(
    r"(?:\s*\[\s*(?:\.{3}|…)\s*\]|\s*\(\s*(?:\.{3}|…)\s*\)|\s*(?:\.{3,}|…+)|\s*�+|\s*@@[A-Z_0-9]*@?|\s*<[/a-z]{0,12}|\s*&(?:#\d{0,5}|[a-z]{0,6})|\s*\\(?:u[0-9a-fA-F]{0,3}|n)?|\"\s*\}+|\s*\[(?:truncated|cut|continued|more)\]|\s*\((?:truncated|cut "
    r"off|continued)\))\s*$"
)
#: Last characters behind which no such thing can stand.
_SETTLED = ".!?。！？।؟»”$%,;:"
_WHOLE_PLACEHOLDER = re.compile(r"@@[A-Z]+(?:_[A-Z]+)*_\d{4}_[0-9A-F]{8}@@$")
_BLANK = " \t\r\n\u00a0\u200b\u2009\u3000\ufeff\u2060\u200e\u200f"
_OPENED = {"\"": "\"", "«": "»", "“": "”", "„": "“", "‘": "’", "「": "」", "『": "』", "'": "'", "(": ")"}
_NOTE = re.compile(r"(?<=[.!?。！？।؟฀-๿])\s+\[\d{1,3}\]$|(?<=[.!?。！？।؟])\[\d{1,3}\]$")
_INVARIANT = re.compile(r"@@[A-Z_]+_\d{4}_[0-9A-F]{8}@@|https?://[^\s)）]+|(?<![A-Za-z0-9.-])(?:\d{1,3}(?:[    ]\d{3})+(?!\d)|\d+(?:[.,]\d+)*)")
_TOKEN = re.compile(r"[A-Za-z]*\d[0-9A-Za-z.,-]*[0-9A-Za-z]|\d|[^\W\d_]+(?:[-'’][^\W\d_]+)*(?:-\d+)?|[\])}$@%»”\"]|[(\[{«“]")
_NOSPACE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
#: Scripts whose endings are counted by characters: without blanks, or with vowel signs that aren't letters.
_BY_CHARACTER = re.compile("[\u0900-\u0963\u0966-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_SIGNED = re.compile("[\u0900-\u0e7f]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_MARK = re.compile(r"[.!?]+(?=\s|$)|[。！？।؟]+")
#: What makes a text's sentences end otherwise than behind a mark and white space, or its endings count by characters.
_SPECIAL = re.compile("[。！？।؟\u0900-\u0963\u0966-\u097f\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_THAI_END = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")


def strip_break(text: str) -> tuple[str, bool]:
    """The text without what a break leaves behind it, and whether there was such a thing."""
    core, hit = text.rstrip(_BLANK), False
    while core:
        end = core[-1]
        if end in _SETTLED and core[-2:-1] != ".":
            break
        if end.isalnum() and not any(c in core[-48:] for c in "@<&\\"):
            break
        near = max(0, len(core) - 48)
        m = _JUNK.search(core, near)
        if not m or _WHOLE_PLACEHOLDER.search(core, near):
            break
        core, hit = core[: m.start()].rstrip(_BLANK), True
    if core[-1:] == '"' and core.count('"') % 2 == 1:
        core = core[:-1].rstrip(_BLANK)  # closes nothing
    return core, hit


def unwrap(text: str) -> str:
    """The text without white space and one pair of quotation marks around all of it."""
    t = text.strip(_BLANK)
    if len(t) > 1 and t[0] in _OPENED and t[0] != "(" and t[-1] == _OPENED[t[0]] and t.count(t[0]) == (2 if t[0] == t[-1] else 1):
        t = t[1:-1].strip(_BLANK)
    return t


def without_note(text: str) -> str:
    """The text without a reference in brackets behind its last full stop."""
    if text[-1:] != "]":
        return text
    m = _NOTE.search(text)
    return text[: m.start()] if m else text


@lru_cache(1 << 16)
def _class(tok: str) -> str:
    if tok[-1].isdigit():
        return "#n" if tok[0].isdigit() else "#c"
    if any(c.isdigit() for c in tok):
        return "#c" if not tok[0].isdigit() else "#n"
    return tok.lower()


class _Chunks(dict):
    """Classes of the tokens of each run of characters without white space: no token holds white space, and most runs come again."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) >= HELD:
            self.clear()
        got = self[chunk] = tuple(map(_class, _TOKEN.findall(chunk)))
        return got


_chunks = _Chunks()


def _words(text: str) -> Iterator[str]:
    """Classes of the tokens of a text."""
    return chain.from_iterable(map(_chunks.__getitem__, text.split()))


def tail(core: str) -> tuple[str, str]:
    """Long and short key of how a text (without its last full stop) ends: words, or characters in scripts without blanks."""
    if core and _BY_CHARACTER.match(core[-1]):
        n = 8 if core[-1] < "\u0e80" else 4
        return core[-n:], core[-n // 2 :]
    return _word_tail(core[-80:])


def _word_tail(end: str) -> tuple[str, str]:
    words: tuple[str, ...] = ()
    for run in reversed(end.split()):
        words = _chunks[run] + words
        if len(words) > 1:
            return f"{words[-2]} {words[-1]}", words[-1]
    return (words[0], words[0]) if words else ("", "")


def invariants(text: str) -> Counter:
    """Numbers (digits only, those of code names left out), placeholders and addresses: what a translation keeps."""
    return Counter(x if x[0] in "@h" else "".join(c for c in x if c.isdigit()) for x in _INVARIANT.findall(text))


def open_brackets(text: str) -> bool:
    return text.count(
        "("
    ) > text.count(")") or text.count("（") > text.count("）") or text.count("$") % 2 == 1 or text.count("“") > text.count("”") + text.count("„") + text.count("»")


class Endings:
    """Counts of n-grams of words (characters in scripts without blanks) anywhere and at the end of a sentence."""

    def __init__(self) -> None:
        self.any: Counter = Counter()
        self.end: Counter = Counter()
        self.whole: Counter = Counter()
        self.begins: set[str] | None = None  # what begins a longer word

    def add(self, text: str, times: int = 1, asked: tuple[frozenset, frozenset, frozenset] | None = None) -> None:
        """Count a text that occurs so many times; with ``asked`` (see ``asked_for``) only these n-grams besides single words."""
        core, broken = strip_break(unwrap(text))
        if not core:
            return
        stops = core[-1] in TERMINALS
        if not broken and not stops and len(core) <= HEADING:
            self.whole[core.casefold()] += times
        n = 0
        if core.isascii() or not _SPECIAL.search(core):
            # sentences end where a run of characters without white space ends with a mark
            runs = core.split()
            parts = list(map(_chunks.__getitem__, runs))
            words = list(chain.from_iterable(parts))
            behind = list(accumulate(map(len, parts)))
            ends = [k for k, run in zip(behind, runs) if run[-1] in ".!?"]
            if not broken and not stops:
                ends.append(len(words))
            for k in ends:
                if k:
                    self._end(f"{words[k - 2]} {words[k - 1]}" if k > 1 else words[0], words[k - 1], times)
        else:
            words = self._special_ends(core, broken or stops, times)
            n = 0 if not _BY_CHARACTER.search(core) else 8 if _SIGNED.search(core) else 4
        size, half = len(core), n // 2
        if asked is None:
            grams = list(map(" ".join, zip(words, words[1:])))
            if n:
                grams += [core[i : i + n] for i in range(size - n + 1)] + [core[i : i + half] for i in range(size - half + 1)]
        else:
            wanted, ends_of, two = asked
            grams = list(map(" ".join, filter(two.__contains__, zip(words, words[1:]))))
            if n:
                near = [i for i in range(half, size + 1) if core[i - half : i] in ends_of]
                grams += [g for i in near if (g := core[i - half : i]) in wanted] + [g for i in near if i >= n and (g := core[i - n : i]) in wanted]
        if times == 1:
            self.any.update(words)
            self.any.update(grams)
        else:
            for k, n in Counter(words + grams).items():
                self.any[k] += n * times

    def _end(self, long: str, short: str, times: int) -> None:
        if short and not (len(short) == 1 and short.isalpha() and short < "ʰ"):
            self.end[long] += times
            self.end[short] += times

    def _special_ends(self, core: str, closed: bool, times: int) -> list[str]:
        """Count the ends of a text with wide marks or with endings by characters; its words."""
        ends = {m.start() for m in _MARK.finditer(core)}
        if _THAI.search(core):
            ends |= {m.start() for m in _THAI_END.finditer(core)}
        if not closed:
            ends.add(len(core))
        words: list[str] = []
        at = 0
        for e in sorted(ends):  # no token reaches over the end of a sentence
            words += _words(core[at:e])
            at = e
            if e and _BY_CHARACTER.match(core[e - 1]):
                self._end(*tail(core[max(0, e - 80) : e]), times)
            elif words:
                self._end(f"{words[-2]} {words[-1]}" if len(words) > 1 else words[0], words[-1], times)
        words += _words(core[at:])
        return words

    def likelihood(self, core: str) -> float:
        """Share of the occurrences of the text's last n-gram that end a sentence; 0 for an n-gram never seen at an end."""
        long, short = tail(core.rstrip(TERMINALS + " "))
        if not short:
            return 1.0
        if len(short) == 1 and short.isalpha() and short < "ʰ":
            return 0.0
        n = self.any.get(long, 0)
        if n >= SUPPORT:
            return self.end.get(long, 0) / n
        m = self.any.get(short, 0)
        p = self.end.get(short, 0) / m if m >= SUPPORT else 0.0 if not short.startswith("#") else 0.5
        # a word never seen behind a frequent one is hardly the whole word
        return p * 0.1 if n == 0 and " " in long and not short.startswith("#") and self.any.get(long.split(" ")[0], 0) >= 5 * SUPPORT else p

    def broken_word(self, core: str) -> bool:
        """Whether the last word is unknown and begins a known one."""
        short = tail(core)[1]
        if _NOSPACE.search(core):
            return False
        if not short or self.any.get(short, 0) >= SUPPORT:
            return False
        if self.begins is None:
            self.begins = {k[:i] for k in self.any if " " not in k for i in range(1, len(k))}
        return short in self.begins

    def known(self, core: str) -> bool:
        """Whether the last n-gram is frequent enough to be judged."""
        long, short = tail(core.rstrip(TERMINALS + " "))
        return self.any.get(long, 0) >= 5 * SUPPORT


def evidence(candidate: str | None) -> set[tuple[str, str]]:
    """(kind, key) of the counts that ``incomplete`` asks for: n n-grams, w the whole heading, b the last word as the beginning of another."""
    core, junk = strip_break(candidate or "")
    core = unwrap(core) if junk else unwrap(without_note(unwrap(core)))
    if not core:
        return set()
    stop = core[-1] in TERMINALS or (core[-1] in "»”\"’」』)" and core[-2:-1] in TERMINALS)
    long, short = tail((core.rstrip("»”\"’」』") if stop and not junk else core).rstrip(TERMINALS + " "))
    out = {("n", k) for k in (long, short, long.split(" ")[0]) if k}
    if not junk and not stop and len(core) <= HEADING:
        out.add(("w", core.casefold()))
        if short and not _NOSPACE.search(core):
            out.add(("b", short))
    return out


def asked_for(grams: list[str]) -> tuple[frozenset, frozenset, frozenset]:
    """The n-grams; they and their second halves, which a text is searched for first; those of two words as pairs."""
    return frozenset(grams), frozenset(x for k in grams for x in (k, k[len(k) // 2 :])), frozenset(tuple(k.split(" ")) for k in grams if k.count(" ") == 1)


def _asked(results: DataFrame) -> DataFrame:
    """(result_id, kind, key) of all counts that the candidates' endings need."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        asked = [(i, *x) for i, cs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in set().union(*map(evidence, cs or ()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in asked], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["result_id", "kind", "key"]
        )

    return map_arrow(results.select("result_id", "candidates"), run, "result_id bigint, kind string, key string")


def _endings_asked(results: DataFrame) -> DataFrame:
    """(kind, key), each once: the counts that any candidate's ending needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            for cs in b.column(0).to_pylist():
                for c in cs or ():
                    seen |= evidence(c)
            if len(seen) > HELD:
                yield rows(seen)
                seen = set()
        yield rows(seen)

    def rows(seen: set[tuple[str, str]]) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)], ["kind", "key"])

    return results.select("candidates").mapInArrow(run, "kind string, key string").distinct()


def count_endings(texts: DataFrame, asked: Broadcast | None = None) -> DataFrame:
    """(kind, key, n, at_end) over all rows (text): n-grams (n) that are frequent or end a sentence, frequent headings (w), beginnings of such n-grams without a blank (b).

    ``asked``: what ``asked_for`` gives of the n-grams to count besides single words; the others are left out.
    """
    ship_package(texts.sparkSession)

    def rows(e: Endings, wanted: tuple | None) -> pa.RecordBatch:
        keys = [*e.any, *(k for k in e.end if k not in e.any)]
        if wanted is not None:
            keys = [k for k in keys if k in wanted[0] or " " not in k]
        kinds, n, at_end = ["n"] * len(keys) + ["w"] * len(e.whole), [
            *(e.any.get(k, 0) for k in keys), *e.whole.values()
        ], [*(e.end.get(k, 0) for k in keys), *[0] * len(e.whole)]
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array([*keys, *e.whole], pa.string()), pa.array(n, pa.int64()), pa.array(at_end, pa.int64())],
            ["kind", "key", "n", "at_end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Endings()
        wanted = asked.value if asked is not None else None
        for b in batches:
            for t, times in Counter(b.column(0).to_pylist()).items():
                e.add(t, times, wanted)
                if len(e.any) > HELD:
                    yield rows(e, wanted)
                    e = Endings()
        yield rows(e, wanted)

    c = texts.filter(F.col("text").isNotNull()).select("text").mapInArrow(run, "kind string, key string, n bigint, at_end bigint")
    c = c.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("at_end").alias("at_end"))
    c = c.filter(
        ((F.col("kind") == "n") & ((F.col("n") >= SUPPORT) | (F.col("at_end") > 0))) | ((F.col("kind") == "w") & (F.col("n") >= OFTEN))
    ).persist(StorageLevel.DISK_ONLY)
    c.count()  # else the two stages that read it would each count the corpus
    words = c.filter((F.col("kind") == "n") & (F.col("n") > 0) & ~F.col("key").contains(" ") & (F.length("key") > 1))
    begins = words.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key")
    ).distinct()
    return c.unionByName(begins.select(F.lit("b").alias("kind"), "key", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at_end")))


def ending_counts(texts: DataFrame, results: DataFrame) -> DataFrame:
    """(result_id, counts): what all texts say about the endings of each result's candidates, an array of kind, key, n, at_end."""
    return _asked(results).join(count_endings(texts), ["kind", "key"]).groupBy("result_id").agg(
        F.collect_list(F.struct("kind", "key", "n", "at_end")).alias("counts")
    )


def learned_endings(texts: DataFrame, results: DataFrame) -> DataFrame | Broadcast:
    """What all texts say about the endings of the candidates: up to BROADCAST_ENDINGS different endings as a broadcast table, else as ``ending_counts``; both hold the same counts."""
    ship_package(texts.sparkSession)
    sc = texts.sparkSession.sparkContext
    asked = _endings_asked(results).persist(StorageLevel.DISK_ONLY)
    try:
        if asked.count() > BROADCAST_ENDINGS:
            return ending_counts(texts, results)
        grams = asked.filter("kind = 'n'").select("key").toArrow()["key"].to_pylist()
        counts = count_endings(texts, sc.broadcast(asked_for(grams))).join(asked, ["kind", "key"], "left_semi").toArrow()
        return sc.broadcast((uuid4().hex, [counts[c].to_pylist() for c in ("kind", "key", "n", "at_end")]))
    finally:
        asked.unpersist()


_held: dict[str, Endings] = {}


def shared(counts: Broadcast) -> Endings:
    """The statistics of a broadcast table, made once a process."""
    name, columns = counts.value
    if name not in _held:
        _held.clear()
        _held[name] = _filled(zip(*columns))
    return _held[name]


def _filled(rows) -> Endings:
    e = Endings()
    e.begins = set()
    for kind, key, n, at_end in rows:
        if kind == "b":
            e.begins.add(key)
        elif kind == "w":
            e.whole[key] = n
        else:
            e.any[key], e.end[key] = n, at_end
    return e


def counted(columns: pa.ListArray) -> Endings:
    """Statistics that hold the counts of some rows of ``ending_counts``."""
    return _filled(zip(*(c.to_pylist() for c in columns.flatten().flatten())))


def incomplete(request: str, candidate: str, e: Endings) -> tuple[int, int]:
    """(strength, length up to the break): 2 the candidate surely breaks off, 1 perhaps, 0 it doesn't.

    A candidate that ends like a sentence and holds all numbers and placeholders of its request is complete, even without a
    full stop.
    """
    core, junk = strip_break(candidate)
    size = len(core)
    if not core:
        return 0, 0
    if junk:
        bare = unwrap(core)
        return (0 if bare and bare[-1:] in TERMINALS and not open_brackets(bare) and e.likelihood(bare) >= UNLIKELY else 2), size
    core = unwrap(without_note(unwrap(core)))
    if not core:
        return 0, size
    stop = core[-1] in TERMINALS or (core[-1] in "»”\"’」』)" and core[-2:-1] in TERMINALS)
    p = e.likelihood(core.rstrip("»”\"’」』") if stop else core)
    asked = unwrap(without_note(unwrap(request)))
    if open_brackets(core) and not open_brackets(asked):
        return 2, size
    if stop:
        return (2 if p == 0 and core[-1] == "." and (e.known(core) or invariants(asked) - invariants(core)) else 0), size
    if len(core) <= HEADING and (e.whole.get(core.casefold(), 0) >= OFTEN or not re.search(r"[^\W\d_]{3}", core)):
        return 0, size
    if p < UNLIKELY and len(asked) <= HEADING and len(core) <= HEADING and asked[-1:] not in TERMINALS:
        return (2 if e.broken_word(core) or e.known(core) and p == 0 else 0), size  # a heading too rare to be known
    if p < UNLIKELY:
        return 2, size
    if invariants(asked) - invariants(core) or (len(core) < SHORT * len(asked) and not _NOSPACE.search(core)):
        return 2, size
    if asked[-1:] in TERMINALS and not _NOSPACE.match(core[-1]):
        # it ends where a sentence can end, though its request goes on to a full stop: the number of sentences decides
        return (2 if candidate[-1] == " " or len(_MARK.findall(core)) + 1 < len(_MARK.findall(asked)) else 1), size
    # Chinese and Japanese sentences end in a full stop too, though their words end anywhere
    return (1 if asked[-1:] in TERMINALS and core[-1] > "\u3040" else 0), size
