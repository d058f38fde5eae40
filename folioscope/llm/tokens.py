"""Problem 6: encode a corpus with a public byte-level BPE tokenizer.

Pre-tokens are located without regular expressions: every code point gets a class (letter, number, white space, other). The
automaton of the pattern forgets all but its last few characters, so that its transition functions compose to constants after
them and the scan over them reduces to comparing neighbours in whole arrays. Slices are grouped by a 64-bit hash from prefix
scans (running sums and products) and then compared with their group's first slice code point by code point, so that only the
distinct ones of a batch reach Python and no collision can give wrong ids; merges come from a cache. Byte offsets of the tokens
are kept on request, for decoding.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, ship_package

LETTER, NUMBER, SPACE, OTHER, EDGE = 0, 1, 2, 3, 4
#: Stands between two texts of a batch; no code point has this value.
SENTINEL = 0x110000
#: Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe in a contraction (fixed values of the tokenizer's pattern).
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
#: Distinct slices kept with their ids; the cache is emptied when it is full.
CACHE_SLICES = 500_000
#: Largest rank file (bytes) that is broadcast; public vocabularies have a few megabytes.
RANK_FILE = 64 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point, the sentinel's last."""
    table = np.full(SENTINEL + 1, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c in "LN":
            table[cp] = LETTER if c == "L" else NUMBER
    table[WHITE] = SPACE
    table[SENTINEL] = EDGE
    return table


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a sentinel before each and one at the end; positions of the sentinels."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    cps = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    cps[at] = SENTINEL
    return cps, at


def starts_of_pretokens(cps: np.ndarray) -> np.ndarray:
    """Positions where a pre-token or a sentinel starts, in order."""
    cls = _classes()[cps]
    n = len(cls)
    new = np.empty(n, bool)  # a run of one class starts
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    edge = cls == EDGE
    new |= edge
    # white space: the last character of a run is cut off from the others; if it is U+0020 it joins what follows
    space = cls == SPACE
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:]
    new |= last
    joins = last & (cps == 0x20)
    new[1:] &= ~joins[:-1]
    # contractions: an apostrophe that is a run of its own, isn't joined to a blank, and has letters of the list behind it
    apostrophes = np.flatnonzero((cps[:-1] == 0x27) & (cls[1:] == LETTER) & new[:-1])
    if len(apostrophes):
        where = [p for p in apostrophes.tolist()]
        size = []
        for p in where:
            a, b = int(cps[p + 1]), int(cps[p + 2]) if p + 2 < n else SENTINEL
            one = chr(a)
            size.append(2 if one in ONE_LETTER else 3 if b < 0x110000 and one + chr(b) in TWO_LETTERS else 0)
        hit = [(p, k) for p, k in zip(where, size) if k]
        if hit:
            p, k = np.array([x[0] for x in hit]), np.array([x[1] for x in hit])
            new[p + 1] = False
            behind = p + k
            new[behind[cls[behind] == LETTER]] = True
    return np.flatnonzero(new)


def _hashes(cps: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, from prefix sums of mixed code points weighted with powers of an odd number."""
    inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
    n = len(cps)
    with np.errstate(over="ignore"):
        mixed = cps.astype(np.uint64) + np.uint64(1)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        powers = np.full(n, _MULTIPLIER, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        mixed *= powers
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        back = np.full(n, np.uint64(inverse), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        h = (sums[starts + lens] - sums[starts]) * back[starts]
        return h ^ (lens.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _unlike(cps: np.ndarray, starts: np.ndarray, lens: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Which slices aren't the same characters as the slice whose number ``like`` gives, by comparing all of them at once."""
    wrong = lens != lens[like]
    same = np.flatnonzero(~wrong)
    n = lens[same]
    begin = np.cumsum(n) - n
    at = np.repeat(starts[same] - begin, n) + np.arange(int(n.sum()))
    differs = cps[at] != cps[at + np.repeat(starts[like[same]] - starts[same], n)]
    if differs.any():
        wrong[same[np.logical_or.reduceat(differs, begin)]] = True
    return wrong


class ByteBPE:
    """Ids of texts by a rank file of byte sequences (one ``base64 rank`` a line)."""

    def __init__(self, ranks: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._merge = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self._cache: dict[str, list[int]] = {}
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for raw, i in self.ranks.items():
            self.pieces[i] = raw
        self.sizes = np.fromiter(map(len, self.pieces), np.int32, len(self.pieces))

    def slice_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token by pair merging."""
        got = self._cache.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "surrogatepass")
            got = [self.ranks[raw]] if raw in self.ranks else self._merge(raw)
            if len(self._cache) >= CACHE_SLICES:
                self._cache.clear()
            self._cache[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more number than texts)."""
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        cps, edges = codepoints(texts)
        starts = starts_of_pretokens(cps)
        lens = np.diff(starts, append=len(cps))
        text_of = np.searchsorted(edges, starts, "right") - 1
        keep = cps[starts] != SENTINEL
        starts, lens, text_of = starts[keep], lens[keep], text_of[keep]
        _, first, inverse = np.unique(_hashes(cps, starts, lens), return_index=True, return_inverse=True)
        odd = np.flatnonzero(_unlike(cps, starts, lens, first[inverse]))
        if len(odd):  # another slice has the same hash: these stand for themselves
            inverse[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        whole = cps.astype("<u4")
        whole[edges] = 0
        joined = whole.tobytes().decode("utf-32-le", "surrogatepass")
        ids = [self.slice_ids(joined[s:e]) for s, e in zip(starts[first].tolist(), (starts[first] + lens[first]).tolist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        total = np.cumsum(n)
        out = flat[np.repeat(begin[inverse] - (total - n), n) + np.arange(total[-1])]
        per_text = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(per_text, out=offsets[1:])
        return out, offsets


    def byte_offsets(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte of each token in its own text's UTF-8 form."""
        ends = np.cumsum(self.sizes[flat], dtype=np.int64)
        begin = ends - self.sizes[flat]
        base = np.zeros(len(offsets) - 1, np.int64)
        some = np.diff(offsets) > 0
        base[some] = begin[offsets[:-1][some]]
        return (begin - np.repeat(base, np.diff(offsets))).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[str, ByteBPE] = {}
_sent: dict[tuple[str, str], Broadcast] = {}


def tokenizer(path: str, ranks: Broadcast | None = None) -> ByteBPE:
    """The tokenizer of a rank file, made once a process; executors take its bytes from the broadcast."""
    if path not in _made:
        if ranks is not None:
            _made[path] = ByteBPE(ranks.value)
        else:
            with open(path, "rb") as f:
                _made[path] = ByteBPE(f.read())
    return _made[path]


def rank_file(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a rank file for the executors, which needn't see the driver's files; larger ones than RANK_FILE are refused."""
    key = spark.sparkContext.applicationId, path
    if key not in _sent:
        with open(path, "rb") as f:
            raw = f.read(RANK_FILE + 1)
        if len(raw) > RANK_FILE:
            raise ValueError(f"{path} has more than {RANK_FILE} bytes")
        _sent[key] = spark.sparkContext.broadcast(raw)
    return _sent[key]


def default_tokenizer_path() -> str:
    """The rank file of byte_bpe_50k among the installed public tokenizers."""
    import os

    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"


def token_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids): each row's text as token ids, without special tokens; with ``offsets`` also each token's first byte.

    A null text and an empty text both get an empty list; repeated rows stay repeated (callers drop them); an empty table
    gives an empty table; other columns are ignored, whatever their names. Texts of any length are encoded whole.
    """
    spark = df.sparkSession
    ship_package(spark)
    ranks = rank_file(spark, path)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path, ranks)
        flat, at = t.encode([x or "" for x in b.column(1).to_pylist()])
        lists = [flat, t.byte_offsets(flat, at)] if offsets else [flat]
        cut = pa.array(at.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.ListArray.from_arrays(cut, pa.array(x)) for x in lists)], ["id", "ids", "offsets"][: 1 + len(lists)]
        )

    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return map_arrow(df.select(df[id_col].alias("id"), df[text_col].alias("text")), run, schema).withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and n_tokens of each row's text (0 for null and empty texts)."""
    spark = df.sparkSession
    ship_package(spark)
    ranks = rank_file(spark, path)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        _, at = tokenizer(path, ranks).encode([t or "" for t in b.column(0).to_pylist()])
        return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.diff(at))], [*b.schema.names[1:], "n_tokens"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens bigint"])
    return map_arrow(df.select(df[text_col].alias("__text"), *keep), run, schema)


def decoded(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of each row's list of ids; a null list gives an empty text."""
    spark = df.sparkSession
    ship_package(spark)
    ranks = rank_file(spark, path)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        t = tokenizer(path, ranks)
        return ids.map(lambda x: "" if x is None else t.decode(x))

    return df.withColumn("decoded", run(F.col(ids_col)))


def decode(ids: list[int], path: str) -> str:
    """The text of a list of ids."""
    return tokenizer(path).decode(ids)
