"""Problem 1: the language of each text and of each segment of a mixed text, with a confidence.

The script of a token narrows its candidates; every word then gets a score for each of them, from word counts with character
n-grams for words never seen; a Viterbi pass over the words, with a small price for changing the language where a sentence
ends and a prohibitive one inside, labels the spans. The model is fitted on a bounded sample of the labelled texts and
refitted on its own labels, which removes the wrong ones among them.

A script with one known language doesn't prove it: words with letters that this language doesn't have, and words of scripts
without a known language, speak for ``und`` (some other language), and every other word of such a script leaves some doubt.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LATIN_LANGS, bounded_sample, language_code, map_arrow, ship_package

#: Texts the model is fitted on at most, taken in the order of a hash of their id; rounds of refitting.
SAMPLE_TEXTS, ROUNDS = 20_000, 2
#: Price of another language at the end of a sentence and inside one, lowest score of a word, in nats.
AT_END, INSIDE, FLOOR = 4.0, 60.0, -8.0
#: Nats by which another language must beat a declared one.
DOUBT = 3.0
#: Longest heading whose labels are remembered whole.
PHRASE = 40
#: Known words (or characters of scripts without blanks) a segment needs to count.
EVIDENCE = 2
CODES = (*LATIN_LANGS, "ru", "zh", "ja", "ar", "hi", "th")
#: Stands for every language beyond these.
UNKNOWN = "und"
NAMES = (*CODES, UNKNOWN)
K = len(NAMES)
#: Score of another language in a word of a script that many languages write, and of one that hardly another does.
SHARED, OWN = -1.0, -3.0
#: Rows of words that a process keeps; all are dropped beyond.
ROWS = 500_000
_AT = {c: i for i, c in enumerate(CODES)}
_END = "\0"

# Living scripts without a known language; Greek letters stand in formulas too, so that only words of them count.
_OTHER = (
    r"[\u0370-\u03ff\u1f00-\u1fff]{3,}|[\u0530-\u05ff\u07c0-\u07ff\u0980-\u0dff\u0e80-\u0fff\u1000-\u10ff\u1200-\u139f\u1780-\u18af\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]+"
)
#: Letters of a script that its known language doesn't have (for Latin: none of the seven).
_FOREIGN = {"ru": re.compile("[^А-Яа-яЁё]"), "ar": re.compile("[ٱ-ۓݐ-ݿ]"), "hi": re.compile("[ऄऎऒळऴॲ-ॿ]"), "latin": re.compile("[Ā-ıĴ-őŔ-ŷŹ-ɏẠ-ỿ]")}

# A token is a word of one script, a piece of text of a script without blanks, or the end of a sentence.
_TOKEN = re.compile(
    r"@@[A-Z_0-9]+(?:@@)?|https?://[^\s)）]+|\$[^$\n]{1,60}\$|[A-Z][a-z]+ "
    r"v\d+(?:\.\d+)*|[A-Za-zÀ-ɏẠ-ỿ]+(?:-?\d[0-9A-Za-z.]*)?(?:[̀-ͯ]+[A-Za-zÀ-ɏ]*)*|[Ѐ-ԯ]+|[؀-ۿݐ-ݿ]+|[ऀ-ॣ०-ॿ]+|[฀-๿]{1,3}|[ぁ-ヿㇰ-ㇿー]+|[一-鿿㐀-䶿]|[.!?…]+[\"”’»)\]]*(?=\s|$)|[。！？।؟]|[.!?](?=[^\W\d_])|\n+|[(（]|[)）]|\s(?=[฀-๿])|(?<=[฀-๿])\s(?=[^\s\d(\[“\"«$@])|"
    + _OTHER
)


_PLAIN = re.compile(
    r"@@[A-Z_0-9]+(?:@@)?|https?://\S+|[A-Z][a-z]+ "
    r"v\d+(?:\.\d+)*|[A-Za-zÀ-ɏẠ-ỿ]+(?:-?\d[0-9A-Za-z.]*)?(?:[\u0300-\u036f]+[A-Za-zÀ-ɏ]*)*|[Ѐ-ԯ]+|[؀-ۿݐ-ݿ]+|[ऀ-ॣ०-ॿ]+|[฀-๿]+|[ぁ-ヿㇰ-ㇿー]+|[一-鿿㐀-䶿]|"
    + _OTHER
)


_VERSION = re.compile(r"[A-Z][a-z]+ v\d")


def _script(c: str) -> str:
    if c < "ʰ" or "Ḁ" <= c <= "ỿ":
        return "latin"
    if c < "Ѐ" or "԰" <= c < "؀" or "߀" <= c < "ऀ":
        return "other"
    if c < "԰":
        return "ru"
    if c < "ࠀ":
        return "ar"
    if c < "ঀ":
        return "hi"
    if "฀" <= c <= "๿":
        return "th"
    if "ぁ" <= c <= "ヿ" or "ㇰ" <= c <= "ㇿ":
        return "ja"
    return "han" if "㐀" <= c <= "鿿" else "other"


def tokens(text: str) -> list[str]:
    """Words of the text, Han characters one by one, and a mark where a sentence may end outside of brackets."""
    out = []
    depth = 0
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in "(（":
            depth += 1
        elif c in ")）":
            depth = max(0, depth - 1)
        elif c in ".!?…。！？।؟\n" or c.isspace():
            if not depth and out and out[-1] != _END:
                out.append(_END)
            if c == "\n" and len(t) > 1:
                depth = 0
        elif c not in "@$h" or not (t.startswith(("@@", "http", "$"))):
            out.append(t)
    return out


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class _Runs(dict):
    """Rows of the words of each run of characters without white space: most runs come again and again."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def __missing__(self, run: str) -> tuple[int, ...]:
        got = self[run] = self.model.gram_rows(run)
        return got


class LanguageModel:
    """Scores of words and of character n-grams for each language, relative to the best one (0) and not below FLOOR."""

    def __init__(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.grams: dict[str, np.ndarray] = {}
        self.han: dict[str, np.ndarray] = {}
        self.phrases: dict[str, str] = {}
        self._reset()

    def _reset(self) -> None:
        self.rows: list[np.ndarray] = [np.zeros(K, np.float32)]
        self.index: dict[str, int] = {}
        self.gram_index: dict[str, int] = {}
        self.runs = _Runs(self)
        self._buffer, self._filled = np.zeros((1024, K), np.float32), 0

    def _matrix(self) -> np.ndarray:
        """All rows as one array, which only grows by what is new."""
        n = len(self.rows)
        if n > len(self._buffer):
            wider = np.zeros((2 * n, K), np.float32)
            wider[: self._filled] = self._buffer[: self._filled]
            self._buffer = wider
        if n > self._filled:
            self._buffer[self._filled : n] = self.rows[self._filled :]
            self._filled = n
        return self._buffer

    def _trim(self) -> None:
        """Drop all rows where there are too many; to be called between texts."""
        if len(self.rows) > ROWS or len(self.runs) > ROWS:
            self._reset()

    def __getstate__(self) -> dict:
        return {"words": self.words, "grams": self.grams, "han": self.han, "phrases": self.phrases}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def fit(self, texts: list[list[str]], labels: list[str]) -> None:
        """Count tokens by label (texts as token lists); labels outside of CODES are left out."""
        words: dict[str, Counter] = defaultdict(Counter)
        han: dict[str, Counter] = defaultdict(Counter)
        lower: dict[str, bool] = defaultdict(bool)
        for toks, lab in zip(texts, labels):
            if lab not in _AT:
                continue
            for t in toks:
                if t == _END:
                    continue
                s = _script(t[0])
                if s == "latin":
                    if len(t) > 1 and not any(c.isdigit() for c in t):
                        words[lab][t.lower()] += 1
                        lower[t.lower()] |= t.islower()
                elif s == "han":
                    han[lab][t] += 1
        # a word that never stands in lower case may be a name: it must be frequent to count
        rare = max(3, len(texts) // 2000)
        total = sum(words.values(), Counter())
        for c in words.values():
            for w in [w for w in c if not lower[w] and total[w] < rare]:
                del c[w]
        self._reset()
        self.words, self.grams = self._latin(words)
        self.han = self._table(han, ("zh", "ja"), 1)

    @staticmethod
    def _table(counts: dict[str, Counter], codes: tuple[str, ...], least: int) -> dict[str, np.ndarray]:
        vocab = sorted(
            {w for c in codes for w, n in counts[c].items()} if least <= 1 else {w for w, n in sum((counts[c] for c in codes), Counter()).items() if n >= least}
        )
        out = {}
        at = [_AT[c] for c in codes]
        sums = np.array([sum(counts[c].values()) for c in codes], float) + 0.1 * len(vocab)
        for w in vocab:
            p = np.log((np.array([counts[c][w] for c in codes], float) + 0.1) / sums)
            row = np.full(K, FLOOR, np.float32)
            row[at] = np.maximum(p - p.max(), FLOOR)
            if codes != LATIN_LANGS:
                row[-1] = OWN
            out[w] = row
        return out

    def _latin(self, counts: dict[str, Counter]) -> tuple[dict, dict]:
        words = self._table(counts, LATIN_LANGS, 3)
        grams: dict[str, Counter] = defaultdict(Counter)
        for c in LATIN_LANGS:
            for w, n in counts[c].items():
                for g in _grams(w):
                    grams[c][g] += n
        return words, self._table(grams, LATIN_LANGS, 3)

    def _fixed(self, s: str, t: str) -> np.ndarray:
        row = np.full(K, FLOOR, np.float32)
        if s == "other" or (s in _FOREIGN and _FOREIGN[s].search(t)):
            row[-1] = 0
            return row
        row[-1] = SHARED if s in _FOREIGN else OWN
        if s == "han":
            got = self.han.get(t)
            if got is not None:
                return got
            row[[_AT["zh"], _AT["ja"]]] = 0
        else:
            row[_AT[s]] = 0
        return row

    def word_row(self, t: str) -> int:
        """Row of a token: its word scores; n-gram scores, damped, for an unseen word; nothing for names and codes."""
        i = self.index.get(t)
        if i is None:
            s = _script(t[0])
            if s != "latin":
                row = self._fixed(s, t)
            elif len(t) == 1 or any(c.isdigit() for c in t):
                row = None
            else:
                row = self.words.get(t.lower())
                if row is None and t.islower() and _FOREIGN["latin"].search(t):
                    row = self._fixed(s, t)
                elif row is None and t.islower() and len(t) >= 4:
                    row = np.maximum(0.15 * self._gram_sum(t), FLOOR / 4)
            i = self._keep(self.index, t, row)
        return i

    def gram_row(self, t: str) -> int:
        """Row of a token by character n-grams alone; nothing for codes and for capitalised words never seen."""
        i = self.gram_index.get(t)
        if i is None:
            s = _script(t[0])
            if t.startswith(("@@", "http")):
                row = None
            elif s != "latin":
                row = self._fixed(s, t)
            elif len(t) == 1 or any(c.isdigit() for c in t) or (not t.islower() and t.lower() not in self.words):
                row = None
            elif t.lower() not in self.words and _FOREIGN["latin"].search(t):
                row = self._fixed(s, t)
            else:
                row = self._gram_sum(t.lower())
            i = self._keep(self.gram_index, t, row)
        return i

    def gram_rows(self, text: str) -> tuple[int, ...]:
        """Rows of the words of a text that have a score."""
        index = self.gram_index
        return tuple(k for w in _PLAIN.findall(text) if (k := index[w] if w in index else self.gram_row(w)))

    def _gram_sum(self, word: str) -> np.ndarray:
        rows = [self.grams[g] for g in _grams(word) if g in self.grams]
        row = np.full(K, FLOOR, np.float32)
        n = len(LATIN_LANGS)
        row[:n] = 0
        for r in rows:
            row[:n] += r[:n]
        row[:n] -= row[:n].max()
        return np.maximum(row, FLOOR)

    def _keep(self, index: dict, t: str, row: np.ndarray | None) -> int:
        if row is None:
            i = 0
        else:
            i = len(self.rows)
            self.rows.append(row)
        index[t] = i
        return i

    # ---- decoding -------------------------------------------------------------------------------------------------

    def label(self, texts: list[str]) -> list[list[tuple[str, float, np.ndarray]]]:
        """For each text its segments (code, confidence, score of each language); none for a text without words of a language."""
        toks = [tokens(t) for t in texts]
        return self.label_tokens(toks)

    def label_tokens(self, toks: list[list[str]]) -> list[list[tuple[str, float, np.ndarray]]]:
        order = sorted(range(len(toks)), key=lambda i: len(toks[i]))
        out: list[list[tuple[str, float, np.ndarray]]] = [[] for _ in toks]
        for k in range(0, len(order), 2048):
            part = order[k : k + 2048]
            for i, segs in zip(part, self._viterbi([toks[i] for i in part])):
                out[i] = segs
        return out

    def _viterbi(self, toks: list[list[str]]) -> list[list[tuple[str, float, np.ndarray]]]:
        self._trim()
        ids, ends = [], []
        get, row = self.index.get, self.word_row
        for ts in toks:
            a, b, at_end = [], [], False
            for t in ts:
                if t == _END:
                    at_end = True
                    continue
                i = get(t)
                if i is None:
                    i = row(t)
                if i:
                    a.append(i)
                    b.append(at_end)
                    at_end = False
            ids.append(a)
            ends.append(b)
        n, m = len(toks), max(map(len, ids), default=0)
        if not m:
            return [[] for _ in toks]
        table = self._matrix()
        lens = np.array([len(a) for a in ids])
        idx = np.zeros((n, m), np.int32)
        price = np.full((n, m), INSIDE, np.float32)
        for i, (a, b) in enumerate(zip(ids, ends)):
            idx[i, : len(a)] = a
            price[i, : len(a)][b] = AT_END
        score = np.zeros((n, K), np.float32)
        back = np.zeros((m, n, K), np.int8)
        stay = np.arange(K, dtype=np.int8)
        for j in range(m):
            live = np.flatnonzero(lens > j)
            s = score[live]
            if j:
                best = s.argmax(1)
                other = s[np.arange(len(live)), best] - price[live, j]
                move = other[:, None] > s
                back[j, live] = np.where(move, best[:, None], stay)
                s = np.where(move, other[:, None], s)
            score[live] = s + table[idx[live, j]]
        out = []
        final = score.argmax(1)
        for i in range(n):
            size = int(lens[i])
            if not size:
                out.append([])
                continue
            path = [0] * size
            k = int(final[i])
            for j in range(size - 1, -1, -1):
                path[j] = k
                if j:
                    k = int(back[j, i, k])
            out.append(self._segments(path, table[idx[i, :size]]))
        return out

    @staticmethod
    def _segments(path: list[int], scores: np.ndarray) -> list[tuple[str, float, np.ndarray]]:
        """Runs of one label with the posterior of their words; runs of too little evidence join the run before."""
        runs: list[list[int]] = []
        for j, k in enumerate(path):
            if runs and runs[-1][0] == k:
                runs[-1][2] = j + 1
            else:
                runs.append([k, j, j + 1])
        strong = [r for r in runs if r[2] - r[1] >= EVIDENCE] or runs[:1]
        out: list[tuple[str, float, np.ndarray]] = []
        for k, a, b in strong:
            s = scores[a:b].sum(0)
            if out and out[-1][0] == NAMES[k]:
                s = s + out.pop()[2]
            out.append((NAMES[k], float(1 / np.exp(s - s[k]).sum()), s))
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts that hold words, and the summed n-gram scores of each (relative to the best of each word, 0)."""
        self._trim()
        flat: list[int] = []
        cuts, owner = [], []
        rows_of = self.runs.__getitem__
        for i, t in enumerate(texts):
            begin = len(flat)
            if " v" in t and _VERSION.search(t):  # the one token that holds a blank
                flat += self.gram_rows(t)
            else:
                flat += chain.from_iterable(map(rows_of, t.split()))
            if len(flat) > begin:
                cuts.append(begin)
                owner.append(i)
        if not flat:
            return np.zeros(0, np.int64), np.zeros((0, K), np.float32)
        return np.array(owner), np.add.reduceat(self._matrix()[np.array(flat)], np.array(cuts), axis=0)

    def posteriors(self, toks: list[list[str]]) -> list[list[np.ndarray]]:
        """For each text the summed n-gram scores (relative to the best, 0) of its sentences that hold words."""
        self._trim()
        flat, cuts, owner = [], [], []
        get, row = self.gram_index.get, self.gram_row
        for i, ts in enumerate(toks):
            begin = len(flat)
            for t in ts:
                if t == _END:
                    if len(flat) > begin:
                        cuts.append(begin)
                        owner.append(i)
                        begin = len(flat)
                    continue
                r = get(t)
                if r is None:
                    r = row(t)
                if r:
                    flat.append(r)
            if len(flat) > begin:
                cuts.append(begin)
                owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in toks]
        if flat:
            sums = np.add.reduceat(self._matrix()[np.array(flat)], np.array(cuts), axis=0)
            for i, s in zip(owner, sums):
                out[i].append(s)
        return out


def fit_model(labelled: DataFrame, sample: int = SAMPLE_TEXTS) -> LanguageModel:
    """Model from rows (id, text, lang), of which each id counts once; at most ``sample`` texts, chosen by a hash of the id, reach the driver."""
    rows = bounded_sample(labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "text", "lang"), sample)
    toks = [tokens(r.text) for r in rows]
    model = LanguageModel()
    model.fit(toks, [r.lang for r in rows])
    for _ in range(ROUNDS):
        pieces, labels = [], []
        for ts, segs in zip(toks, model.label_tokens(toks)):
            if len(segs) == 1 and segs[0][1] > 0.9:
                pieces.append(ts)
                labels.append(segs[0][0])
        model.fit(pieces, labels)
    by: dict[str, Counter] = defaultdict(Counter)
    for r in rows:
        if len(r.text) <= PHRASE and r.lang in _AT:
            by[r.text.strip().casefold()][r.lang] += 1
    for text, n in by.items():
        (lang, k), total = n.most_common(1)[0], n.total()
        if total >= 3 and k >= 0.6 * total:
            model.phrases[text] = lang
    return model


def segments(
    requests: DataFrame, model: LanguageModel, id_col: str = "request_id", text_col: str = "text", keep: tuple[str, ...] = (), prior: str | None = None
) -> DataFrame:
    """(id, kept columns, seg_no, lang, confidence) of each language segment, ``und`` for languages beyond CODES; texts without words of a language have no row.

    ``prior``: a kept column with a language that stands where the text's words don't tell it from their best one.

    Null and empty texts have no row; rows delivered again give rows again; an empty table gives an empty table.
    """
    ship_package(requests.sparkSession)
    kinds = dict(requests.dtypes)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, nos, langs, conf, count = [], [], [], [], []
        given = b.column(b.schema.get_field_index(prior)).to_pylist() if prior else [None] * b.num_rows
        for i, segs in enumerate(model.label([t or "" for t in b.column(0).to_pylist()])):
            if len(segs) == 1 and segs[0][0] != UNKNOWN and np.sort(segs[0][2][:-1])[-2] > segs[0][2].max() - DOUBT and (
                known := model.phrases.get((b.column(0)[i].as_py() or "").strip().casefold())
            ):
                s = segs[0][2]  # words of two languages, but a heading that mostly stands under one label
                segs = [(known, float(1 / np.exp(s - s[_AT[known]]).sum()), s)]
            if len(segs) == 1 and segs[0][0] != UNKNOWN and given[i] in _AT and segs[0][2][_AT[given[i]]] > segs[0][2].max() - DOUBT:
                s = segs[0][2]  # the text can't tell: the label may be right
                segs = [(given[i], float(1 / np.exp(s - s[_AT[given[i]]]).sum()), s)]
            for k, (lang, p, _) in enumerate(segs, 1):
                rows.append(i)
                nos.append(k)
                langs.append(lang)
                conf.append(p)
                count.append(len(segs))
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *(c.take(take) for c in b.columns[1:]), pa.array(nos, pa.int32()), pa.array(langs, pa.string()), pa.array(conf, pa.float64()),
                pa.array(count, pa.int32())
            ],
            [*b.schema.names[1:], "seg_no", "lang", "confidence", "n_segments"]
        )

    cols = [id_col, *keep]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), "seg_no int, lang string, confidence double, n_segments int"])
    return map_arrow(requests.select(requests[text_col].alias("__text"), *cols), run, schema)


def labelled_requests(requests: DataFrame, lookup: dict[str, str]) -> DataFrame:
    """Distinct requests with ``declared``, the code that source_lang denotes (null: none)."""
    return requests.select("request_id", "text", "source_lang").dropDuplicates(["request_id"]).withColumn("declared", language_code(F.col("source_lang"), lookup))


def labels(requests: DataFrame, lookup: dict[str, str]) -> DataFrame:
    """(id, text, lang) of all requests as ``fit_model`` takes them; rows delivered again are still there."""
    return requests.select(F.col("request_id").alias("id"), "text", language_code(F.col("source_lang"), lookup).alias("lang"))


def found(requests: DataFrame, lookup: dict[str, str], sample: int = SAMPLE_TEXTS) -> DataFrame:
    """(request_id, seg_no, lang): the segments of each request whose source_lang names no or another language than its text, or whose text mixes languages.

    A request delivered again counts once; null source_lang names no language; a null, blank or wordless text is no case.
    """
    r = labelled_requests(requests, lookup)
    model = fit_model(labels(requests, lookup), sample)
    s = segments(r, model, keep=("declared",), prior="declared")
    return s.filter((F.col("n_segments") > 1) | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))).select("request_id", "seg_no", "lang")
