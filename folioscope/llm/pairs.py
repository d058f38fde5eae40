"""Problems 2 and 3: truncated texts and defective request-answer pairs.

Problem 2. For each backend the lengths up to the break give a discrete hazard of incomplete endings (of the candidates at
least as long, the share that ends there without a proper ending), each is tested against the hazards of the neighbouring
lengths, and false-discovery control picks the lengths where a limit cuts: every incomplete ending there is a truncation. A
broken transfer leaves its ending at any length, where no hazard can stand out; elsewhere only an ending that can't be one counts.

Problem 3. Empty answers, refusals, copies, truncations and answers in another language, told by normalised text, cues of
declining, n-gram likelihood of the ending and character n-gram posteriors of the languages of both sides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, ship_package
from .endings import counted, incomplete, invariants, learned_endings, shared, unwrap
from .language import _AT, NAMES, LanguageModel, fit_model, labels, tokens

#: Neighbouring lengths on each side that a hazard is tested against; false-discovery rate; fewest candidates of a tested length.
NEIGHBOURS, FALSE_DISCOVERIES, LEAST = 8, 0.01, 4
#: Texts the language model is fitted on at most.
LANGUAGE_SAMPLE = 8_000
#: Nats by which another language must beat the target.
WRONG = 3.0

# Words that stand for no value.
NO_VALUE = {
    "none", "null", "nil", "nan", "n/a", "na", "nul", "undefined", "empty", "[]", "{}", "()", "tbd", "unknown", "no translation", "error", "#n/a", "<null>",
    "<none>", "(null)", "(none)", "(empty)", "[none]", "[null]", "[empty]", "missing", "void", "-"
}

#: Characters of the longest of them with quotation marks and blanks around it.
_LONGEST = max(map(len, NO_VALUE)) + 48

# How a model declines, by language. A cue of regret or of being a model, or the first person with a refusal.
_CUES = {
    "en": (
        r"^(i'm|i am|we're|we are)? ?(so |very )?(sorry|afraid)\b|\bi (must|have to|need to)? ?(decline|refuse)"
        r"|\bi (can't|cannot|can not|won't|will not|am unable|am not able|would rather not|would prefer not)\b|\bi'm (unable|not able)\b"
        r"|something i would rather not|language model|my guidelines|^unfortunately,? (i|no|we)\b|cannot be translated because"
        r"|can't be translated because|^my apologies"
        r"|\bi apologi[sz]e"
    ),
    "fr": r"je suis (désolée?|navrée?)|je (ne|n') ?(peux|suis|puis) pas|je (dois|suis contrainte?) (décliner|refuser)|je refuse|modèle de lang|^(désolée?|malheureusement)\b|il m'est impossible",
    "de": r"tut mir leid|ich (kann|darf|werde) .{0,40}nicht|(muss|möchte) ich (leider )?(ablehnen|.{0,30}ablehnen)|muss ich leider|sprachmodell|^(leider|entschuldigung)\b",
    "es": r"lo siento|no (puedo|me es posible)|modelo de lenguaje|debo (rechazar|declinar)|^(lamentablemente|disculpe|perdón)\b|lamento",
    "pt": r"^(lamento|desculpe|infelizmente)\b|não (posso|me é possível)|modelo de linguagem|devo recusar|sinto muito",
    "it": r"mi (dispiace|rincresce)|non (posso|sono in grado)|modello linguistico|devo (rifiutare|declinare)|^(purtroppo|spiacente)\b",
    "nl": r"het spijt me|ik (kan|mag|zal|moet) .{0,40}(niet|weigeren|afwijzen)|taalmodel|^(helaas|sorry)\b",
    "ru": r"извините|простите|к сожалению|я не (могу|имею)|вынужден[а]? отклонить|языковая модель|как языковой",
    "zh": r"抱歉|对不起|很遗憾|我(无法|不能|不可以)|语言模型|拒绝(翻译|回答|这)",
    "ja": r"申し訳|すみません|残念ながら|お断り|言語モデル|お応えできません|お答えできません|翻訳することはできません|翻訳できかねます",
    "ar": r"عذرا|آسف|أعتذر|للأسف|لا (أستطيع|يمكنني|أقدر)|نموذج لغو",
    "hi": r"क्षमा कर|माफ़? कर|खेद है|मैं .{0,40}(नहीं (कर )?सकत|असमर्थ)|भाषा मॉडल|अस्वीकार",
    "th": r"ขออภัย|ขอโทษ|เสียใจ|(ฉัน|ผม|ดิฉัน)ไม่(สามารถ|อาจ)|โมเดลภาษา|แบบจำลองภาษา|ปฏิเสธ",
}
_REFUSAL = re.compile("|".join(f"(?:{c})" for c in _CUES.values()))
_CUE = {k: re.compile(c) for k, c in _CUES.items()}
#: Parts of words of which every cue holds one.
_STEMS = [
    "sorry", "afraid", "declin", "refus", "can't", "cannot", "can not", "won't", "will not", "unable", "not able", "rather not", "prefer not",
    "i'm", "language model", "guidelines", "unfortunately", "apolog", "désol", "navré", "je ne", "je n'", "je dois", "modèle", "malheureus",
    "impossible", "tut mir", "ich kann", "ich darf", "ich werde", "ablehnen", "sprachmodell", "leider", "entschuldig", "lo siento", "no puedo",
    "no me", "modelo", "debo", "lamentablemente", "disculpe", "perdón", "lament", "desculpe", "infelizmente", "não posso", "não me", "devo",
    "sinto", "mi dispiace", "mi rincresce", "non posso", "non sono", "modello", "purtroppo", "spiacente", "spijt", "ik kan", "ik mag", "ik zal",
    "ik moet", "taalmodel", "helaas", "извините", "простите", "сожалению", "я не", "вынужден", "языков", "抱歉", "对不起", "很遗憾", "我无法", "我不能",
    "我不可以", "语言模型", "拒绝", "申し訳", "すみません", "残念ながら", "お断り", "言語モデル", "お応え", "お答え", "翻訳することはできません", "翻訳できかねます", "عذرا", "آسف", "أعتذر", "للأسف",
    "لا أستطيع", "لا يمكنني", "لا أقدر", "نموذج", "क्षमा", "माफ", "खेद", "मैं", "भाषा", "अस्वीकार", "ขออภัย", "ขอโทษ", "เสียใจ", "ไม่สามารถ",
    "ไม่อาจ", "โมเดลภาษา", "แบบจำลองภาษา", "ปฏิเสธ",
]


@lru_cache(1)
def _stems():
    """Automaton of the stems, each with the languages whose cues spell it out (all of them, where none does)."""
    try:
        import ahocorasick
    except ImportError:
        return None
    a = ahocorasick.Automaton()
    for s in _STEMS:
        a.add_word(s, [k for k, c in _CUES.items() if s in c] or list(_CUES))
    a.make_automaton()
    return a


def _holds_cue(text: str) -> bool:
    """Whether a cue of declining occurs; only those languages are looked at of which a stem does, all without the automaton."""
    a = _stems()
    if a is None:
        return bool(_REFUSAL.search(text))
    return any(_CUE[k].search(text) for k in {k for _, ks in a.iter(text) for k in ks})


_LABEL = re.compile(r"^[^\W\d_][\w ]{2,18}[:：]\s*")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[。！？।؟]+")
_PLACEHOLDER = re.compile(r"@@[A-Z_0-9]+@@")


def readable(text: str | None) -> bool:
    """Whether a text holds a letter, digit or symbol and isn't a word that stands for no value."""
    if not text:
        return False
    t = text.strip()
    if len(t) <= _LONGEST and (t.casefold() in NO_VALUE or unwrap(t).casefold() in NO_VALUE):
        return False
    return any(c.isalnum() for c in t) or any(unicodedata.category(c) in ("Sm", "So", "Sc") for c in t)


_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Letters beside a copied request that make no other text of the answer: up to so many, or as many as the request has.
BESIDE = 24


def squeeze(text: str) -> str:
    """Letters and digits of a text in one case and width."""
    if text.isascii():
        return text.encode().translate(None, _NO_LETTERS).decode().lower()
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text)).casefold()


def _lacks(text: str, letters: str) -> bool:
    """Whether a text surely lacks some of the first letters, as far as that shows without squeezing it."""
    if text.isascii():
        return not letters.isascii()
    if not unicodedata.is_normalized("NFKC", text):
        return False
    low = text.casefold()
    return any(c not in low for c in letters[:8])


def is_copy(request: str, candidate: str, squeezed: str | None = None) -> bool:
    """Whether the candidate is the request's text, presented alike or otherwise; ``squeezed``: the request's letters."""
    if candidate == request:
        return True
    p = squeeze(request) if squeezed is None else squeezed
    if p and _lacks(candidate, p):
        return False
    q = squeeze(candidate)
    if p == q:
        return True
    if not p or len(q) < len(p):
        return False
    if len(q) % len(p) == 0 and q == p * (len(q) // len(p)):  # again and again
        return True
    if len(p) >= 12 and len(q) - len(p) <= max(BESIDE, len(p)) and p in q:  # behind a preamble, before a closing
        return True
    m = _LABEL.match(candidate)
    return bool(m) and squeeze(candidate[m.end() :]) == p


#: Sentences of a refusal that a translation may hold too; longer texts must lack what the request's translation keeps.
REFUSAL_SENTENCES = 3


def is_refusal(request: str, candidate: str) -> bool:
    """Whether the candidate declines instead of translating: it holds a cue that the request itself doesn't.

    In texts of many sentences it must also lack all numbers, placeholders and addresses of the request, which a translation
    would keep; where the request has none, it must have more sentences.
    """
    c = candidate.strip(" \t\n\"'«»“”").replace("’", "'").casefold()
    if not _holds_cue(c) or _REFUSAL.search(request.replace("’", "'").casefold()):
        return False
    if len(_SENTENCE.findall(c)) <= REFUSAL_SENTENCES:
        return True
    asked = invariants(request)
    return not asked & invariants(candidate) if asked else len(_SENTENCE.findall(request)) < len(_SENTENCE.findall(c))


def examine(requests: DataFrame, results: DataFrame, model: LanguageModel | None, counts: DataFrame | Broadcast) -> DataFrame:
    """(result_id, idx, backend, kind, strength, size) of each candidate of each result with a known request.

    kind: empty, refusal, copy, wrong_language or fine; strength and size as ``endings.incomplete`` gives them for what is
    neither empty nor a refusal nor a copy, by the counts of ``endings.learned_endings``. A null or empty candidates array is one empty candidate with idx 0. Without a
    model the language isn't looked at. Results or requests delivered again count once; a null request text is an empty one.
    """
    ship_package(requests.sparkSession)
    q = requests.select("request_id", "text", "target_lang").dropDuplicates(["request_id"])
    # a result delivered again repeats its request, so that one exchange serves both its removal and the join
    r = results.select("result_id", "request_id", "backend", "candidates").repartition("request_id").dropDuplicates(["request_id", "result_id"])
    joined = isinstance(counts, DataFrame)
    table = None if joined else counts
    r = r.join(counts, "result_id", "left") if joined else r
    j = r.join(q, "request_id").select("result_id", "backend", "candidates", "text", "target_lang", *(["counts"] if joined else []))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, backends, cands, texts, targets = (c.to_pylist() for c in b.columns[:5])
        endings = counted(b.column(5)) if joined else shared(table)
        out: list[tuple] = []
        todo: list[tuple[int, int]] = []  # position in out, row
        said: list[str] = []
        for i, (rid, be, cs, t) in enumerate(zip(ids, backends, cands, texts)):
            t = t or ""
            letters = squeeze(t)
            for k, c in enumerate(cs or [None]):
                # a request without words may be given back, whatever it looks like
                if c is not None and c.strip() and c.strip() == t.strip() and not readable(c):
                    out.append((rid, k, be, "fine", 0, len(c)))
                elif not readable(c):
                    out.append((rid, k, be, "empty", 0, 0))
                elif is_refusal(t, c):
                    out.append((rid, k, be, "refusal", 0, 0))
                elif is_copy(t, c, letters):
                    out.append((rid, k, be, "copy", 0, 0))
                    todo.append((len(out) - 1, i))
                    said.append("")
                else:
                    s, n = incomplete(t, c, endings)
                    out.append((rid, k, be, "fine", s, n))
                    if s < 2:
                        todo.append((len(out) - 1, i))
                        said.append(c)
        if model is not None and todo:
            # the request's languages are only needed where the answer isn't in the target language, or is a copy
            suspects = [(at, i, None) for at, i in todo if out[at][3] == "copy"]
            which, sums = model.totals(said)
            if len(which):
                asked = np.array([_AT.get(targets[todo[k][1]] or "", -1) for k in which.tolist()])
                best, line = sums.argmax(1), np.arange(len(which))
                odd = (asked >= 0) & (best != asked) & (sums[line, asked] < sums[line, best] - WRONG)
                suspects += [(*todo[which[k]], NAMES[best[k]]) for k in np.flatnonzero(odd).tolist()]
            rows = sorted({i for _, i, _ in suspects})
            of_row = dict(zip(rows, model.posteriors([tokens(_PLACEHOLDER.sub(" ", texts[i] or "")) for i in rows])))
            for at, i, lang in suspects:
                rid, k, be, kind, strength, size = out[at]
                if lang is None:
                    if not of_row[i]:
                        out[at] = (rid, k, be, "fine", 0, size)
                elif lang not in {NAMES[int(x.argmax())] for x in of_row[i]}:
                    out[at] = (rid, k, be, "wrong_language", strength, size)
        elif todo:
            for at, i in todo:
                rid, k, be, kind, strength, size = out[at]
                if kind == "copy" and not re.search(r"[^\W\d_]{3}", _PLACEHOLDER.sub(" ", texts[i] or "")):
                    out[at] = (rid, k, be, "fine", 0, size)
        cols = list(zip(*out))
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["result_id", "idx", "backend", "kind", "strength", "size"])

    seen = map_arrow(j, run, "result_id bigint, idx int, backend string, kind string, strength int, size int")
    return seen.withColumn("backend", F.coalesce(F.regexp_replace(F.lower(F.trim("backend")), "[-\\s]+", "_"), F.lit("")))


def cut_lengths(examined: DataFrame) -> DataFrame:
    """(backend, size, n, at_risk, hazard, neighbours, p_value): lengths at which a limit of the backend cuts.

    Hazard of a length: incomplete endings there (all endings, where ``examined`` has no strength) over candidates at least as
    long. Its test against the pooled hazard of the neighbouring lengths takes Chernoff's bound of the Poisson tail, which holds
    for few cases too; Benjamini and Hochberg's rule keeps the false discoveries of each backend below the rate.
    """
    open_ = F.count_if(F.col("strength") >= 1) if "strength" in examined.columns else F.count("*")
    sized = examined.filter("kind in ('fine', 'wrong_language') and size > 0").groupBy("backend", "size").agg(F.count("*").alias("ends"), open_.alias("n"))
    up = Window.partitionBy("backend").orderBy(F.desc("size"))
    risk = sized.select("*", F.sum("ends").over(up).alias("at_risk"))
    near = Window.partitionBy("backend").orderBy("size").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    h = risk.select(
        "*", (F.col("n") / F.col("at_risk")).alias("hazard"), (F.sum("n").over(near) - F.col("n")).alias("n_near"),
        F.max("at_risk").over(near).alias("risk_near")
    )
    # the pooled hazard of the neighbours: their cases over the candidates at risk at all of their lengths (at most that of the nearest below)
    h = h.withColumn("neighbours", (F.col("n_near") + 1) / (F.col("risk_near") * (2 * NEIGHBOURS) + 1))
    want = F.col("at_risk") * F.col("neighbours")
    tests = Window.partitionBy("backend")
    h = h.withColumn("tests", F.count("*").over(tests)).filter((F.col("n") >= LEAST) & (F.col("n") > want))
    h = h.withColumn("p_value", F.exp(-(F.col("n") * F.log(F.col("n") / want) - F.col("n") + want)))
    rank = Window.partitionBy("backend").orderBy("p_value", "size")
    h = h.withColumn("rank", F.row_number().over(rank))
    h = h.withColumn("passes", F.col("p_value") <= FALSE_DISCOVERIES * F.col("rank") / F.col("tests"))
    h = h.withColumn("last", F.max(F.when(F.col("passes"), F.col("rank"))).over(tests))
    return h.filter("rank <= last").select("backend", "size", "n", "at_risk", "hazard", "neighbours", "p_value")


def _prepared(requests: DataFrame, results: DataFrame, lookup: dict[str, str] | None) -> DataFrame:
    """Examined candidates with their truncation decided, by a ``limit`` of lengths or in ``transfer``; lookup None: languages aren't looked at."""
    counts = learned_endings(requests.select("text").unionByName(results.select(F.explode("candidates").alias("text"))), results)
    model = None
    if lookup is not None:
        model = fit_model(labels(requests, lookup), LANGUAGE_SAMPLE)
    seen = examine(requests, results, model, counts).persist(StorageLevel.DISK_ONLY)
    seen.count()  # else the stages that read it at the same time would each work it out
    cuts = cut_lengths(seen).select("backend", "size", F.lit(True).alias("at_limit"))
    path = F.when(
        F.col("kind").isin("fine", "wrong_language"), F.when((F.col("strength") >= 1) & F.col("at_limit"), "limit").when(F.col("strength") == 2, "transfer")
    )
    return seen.join(cuts, ["backend", "size"], "left").withColumn("path", path).withColumn("truncated", F.col("path").isNotNull())


def truncated(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(result_id, idx) of each candidate that breaks off inside a word or a sentence.

    Complete candidates without a full stop, empty ones, refusals and copies are no cases. Results without a request have
    no rows, since completeness can't be told. Null elements and null or empty arrays are no cases.
    """
    return _prepared(requests, results, None).filter("truncated").select("result_id", "idx")


def truncation_rates(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(backend, n_candidates, n_truncated, rate, n_at_limits, limits): how often each backend's candidates break off.

    n_at_limits of them do so at the backend's significant lengths, which ``limits`` has in order; spellings of a backend count as one.
    """
    p = _prepared(requests, results, None)
    g = p.filter("kind <> 'empty'").groupBy("backend").agg(
        F.count("*").alias("n_candidates"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("path") == "limit").alias("n_at_limits"),
        F.array_sort(F.collect_set(F.when(F.col("at_limit"), F.col("size")))).alias("limits")
    )
    return g.select("backend", "n_candidates", "n_truncated", (F.col("n_truncated") / F.col("n_candidates")).alias("rate"), "n_at_limits", "limits")


def defects(requests: DataFrame, results: DataFrame, lookup: dict[str, str]) -> DataFrame:
    """(result_id, idx, defect) of each defective pair: empty, truncated, refusal, copy or wrong_language, one each.

    Order of decision: empty, refusal, copy, truncated, wrong_language. Null and empty arrays are one empty pair with idx 0.
    Results without a request make no pair and have no rows.
    """
    p = _prepared(requests, results, lookup)
    d = F.when(F.col("truncated"), "truncated").when(F.col("kind") != "fine", F.col("kind"))
    return p.select("result_id", "idx", d.alias("defect")).filter("defect is not null")
