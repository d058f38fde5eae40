"""Most similar texts by longest common subsequence, worked out for blocks of queries against tiles of memory texts without losing a match.

The similarity of texts of n and o characters is 2 * lcs / (n + o). Two bounds of the lcs come before the exact figure. Of each
character a common subsequence holds no more than the smaller count, here of buckets of characters. And over any split of the
characters into groups, the lcs is at most the sum of the lcs of what each group leaves of both texts; these short rests are
compared in single machine words, many pairs at once, and each group can only lower the first bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Buckets of characters; the most frequent characters of a tile have one of their own.
BUCKETS, OWN = 64, 48
#: Memory texts and characters of a tile, and queries of a block.
TILE, TILE_CHARS, BLOCK = 8_192, 4_000_000, 32
#: Characters that a group of characters leaves of a text on average, and the bits of a word.
REST, WORD = 57, 64
#: Pairs compared at once.
PAIRS = 4_096


def lcs_length(where: dict[str, int], n: int, b: str) -> int:
    """Longest common subsequence with a text of n characters, of each of which ``where`` has the positions as bits."""
    full = (1 << n) - 1
    s = full
    for ch in b:
        m = where.get(ch)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return n - s.bit_count()


def positions(a: str) -> dict[str, int]:
    """The positions of each character as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each text; text number and code point of each character."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return n, np.repeat(np.arange(len(texts)), n), np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _by_group(group: np.ndarray, row: np.ndarray, texts: int, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each group its characters in order, how many of them each text has, and how many of its own text come before each."""
    order = np.argsort(group, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(group, minlength=groups)))
    for g in range(groups):
        pick = order[ends[g] : ends[g + 1]]
        n = np.bincount(row[pick], minlength=texts)
        yield pick, n, np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n)


class _Tile:
    """Memory texts in order of length, none of them empty."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n, row, codes = _code_points(texts)
        count = np.bincount(codes)
        chars = np.nonzero(count)[0]
        self.none = len(chars)  # stands for any character that the tile hasn't
        self.number = np.full(len(count) + 1, self.none)
        self.number[chars] = np.arange(self.none)
        rank = np.empty(self.none, np.int64)
        rank[np.argsort(-count[chars], kind="stable")] = np.arange(self.none)
        self.bucket = np.append(np.where(rank < OWN, rank, OWN + rank % (BUCKETS - OWN)), BUCKETS)
        at = self.number[codes]
        self.counts = self.histogram(row, at, len(texts))
        self.columns: dict[type, np.ndarray] = {}
        groups = min(max(1, round(self.n.mean() / REST)), BUCKETS // 2)
        self.group = np.append(np.arange(BUCKETS) % groups, groups).astype(np.uint8)  # the last: of none
        self.group[0] = groups - 1  # the most frequent character (blank) says little: last
        self.rests, self.rest_n = [], []
        for pick, n, place in _by_group(self.group[self.bucket][at], row, len(texts), groups):
            rest = np.full((int(n.max()), len(texts)), self.none, np.uint16 if self.none < 1 << 16 else np.uint32)
            rest[place, row[pick]] = at[pick]
            self.rests.append(rest)
            self.rest_n.append(n)

    def histogram(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        h = np.bincount(row * (BUCKETS + 1) + self.bucket[at], minlength=n * (BUCKETS + 1))
        return h.reshape(n, BUCKETS + 1)[:, :BUCKETS].astype(np.int32)

    def by_bucket(self, kind: type) -> np.ndarray:
        """Counts of each bucket, up to what the type holds."""
        if kind not in self.columns:
            self.columns[kind] = np.ascontiguousarray(np.minimum(self.counts, np.iinfo(kind).max).astype(kind).T)
        return self.columns[kind]


def _in_reach(lengths: np.ndarray, shortest: int, longest: int, t: float) -> list[int]:
    """Range of the lengths, which are in order, whose texts may reach the similarity t with texts of the lengths given."""
    least = t / (2 - t)
    return np.searchsorted(lengths, [int(least * shortest), int(longest / least) + 2]).tolist()


def _enough(sums: np.ndarray, t: float) -> np.ndarray:
    """The smallest lcs that makes the similarity t, for each sum of two lengths."""
    need = np.ceil(t * sums / 2).astype(np.int64)
    need -= 2 * (need - 1) / sums >= t
    return need + (2 * need / sums < t)


def _block(tile: _Tile, queries: list[str], t: float, k: int, best: list[list], tie: Callable[[int], object]) -> None:
    """Put matches of the queries, which are in order of length, into their lists."""
    n, row, codes = _code_points(queries)
    x, y = _in_reach(tile.n, n[0], n[-1], t)
    if x >= y:
        return
    o = tile.n[x:y]
    at = tile.number[np.minimum(codes, len(tile.number) - 1)]
    h = tile.histogram(row, at, len(queries))
    most = min(int(n[-1]), int(o[-1]))
    kind = np.uint8 if most < 255 else np.uint16 if most < 65_535 else np.uint32
    own, theirs = np.minimum(h, np.iinfo(kind).max).astype(kind), tile.by_bucket(kind)
    common = np.zeros((len(queries), y - x), kind)
    less = np.empty_like(common)
    for b in np.nonzero(h.any(0))[0]:
        less[:] = own[:, b, None]  # both whole: several times faster than a minimum with single values
        np.minimum(theirs[b, x:y], less, out=less)
        common += less
    low = int(n[0] + o[0])
    need = _enough(np.arange(low, n[-1] + o[-1] + 1), t)
    required = np.minimum(need, np.iinfo(kind).max).astype(kind)[(n[:, None] + o) - low]
    i, j = np.nonzero(common >= required)
    spare = common[i, j].astype(np.int64) - required[i, j]
    j += x
    if not len(i):
        return
    for g, (pick, share, bit) in enumerate(_by_group(tile.group[tile.bucket][at], row, len(queries), len(tile.rests))):
        if not len(i):
            return
        rest, pick, bit = tile.rests[g], pick[bit < WORD], bit[bit < WORD].astype(np.uint64)
        masks = np.zeros((len(queries), tile.none + 1), np.uint64)
        np.bitwise_or.at(masks, (row[pick], at[pick]), np.uint64(1) << bit)
        over = np.maximum(share - WORD, 0)  # characters beyond a word count as common
        inside = tile.group[:BUCKETS] == g
        own, theirs, left = h[:, inside], tile.counts[:, inside], []
        for z in range(0, len(i), PAIRS):
            p, q = i[z : z + PAIRS], j[z : z + PAIRS]
            s, base = np.full(len(p), ~np.uint64(0)), p * (tile.none + 1)
            for c in rest[: tile.rest_n[g][q].max()]:
                u = s & masks.take(base + c.take(q))
                s = (s + u) | (s - u)
            before = np.minimum(own[p], theirs[q]).sum(1, dtype=np.int64)
            left.append(spare[z : z + PAIRS] - before + np.minimum(before, np.bitwise_count(~s) + over[p]))
        spare = np.concatenate(left)
        keep = spare >= 0
        i, j, spare = i[keep], j[keep], spare[keep]
    sums = n[i] + tile.n[j]
    bound = 2 * (spare + need[sums - low]) / sums
    last, where = -1, {}
    for z in np.lexsort((-bound, i)).tolist():
        p, b = int(i[z]), tile.texts[j[z]]
        a, found = queries[p], best[p]
        if a == b or len(found) == k and -found[-1][0] > bound[z]:
            continue
        if p != last:
            last, where = p, positions(a)
        similarity = 2 * lcs_length(where, len(a), b) / (len(a) + len(b))
        if similarity >= t:
            found.append((-similarity, tie(int(j[z]))))
            found.sort()
            del found[k:]


def nearest(queries: list[str], memory: list[str], t: float, k: int, tie: Callable[[int], object]) -> list[list]:
    """For each query the k most similar other memory texts of at least t as (-similarity, tie), in order; ``tie`` gives each
    memory number something that no other has and by which equally similar ones are ordered. No text is empty."""
    order, turn = (sorted(range(len(x)), key=lambda i: len(x[i])) for x in (memory, queries))  # noqa: B023
    lengths = np.array([len(queries[i]) for i in turn], np.int64)
    best: list[list] = [[] for _ in queries]
    lo = 0
    while lo < len(order) and queries:
        rows = order[lo : lo + TILE]
        rows = rows[: max(1, int(np.searchsorted(np.cumsum([len(memory[j]) for j in rows]), TILE_CHARS, "right")))]
        lo += len(rows)
        x, y = _in_reach(lengths, len(memory[rows[0]]), len(memory[rows[-1]]), t)
        if x >= y:
            continue
        tile = _Tile([memory[j] for j in rows])
        for z in range(x, y, BLOCK):
            some = turn[z : min(z + BLOCK, y)]
            _block(tile, [queries[i] for i in some], t, k, [best[i] for i in some], lambda j: tie(rows[j]))  # noqa: B023
    return best
