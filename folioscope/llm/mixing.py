"""Problem 7: combine sources to target shares of the tokens.

Texts are deduplicated; one that occurs in several sources may serve any of them. Distinct texts are aggregated by membership
pattern (the set of sources they occur in), so that a minimum-cost flow over a graph with one node a pattern and one a source
routes token capacity to the sources' quotas. Using texts once more costs more (convex), so repetitions are spent only where a
quota needs them. The flow is then realised by choosing texts in the order of a seeded hash. Only the patterns that occur and a
histogram of BUCKETS sums each reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import token_counts

#: Rows up to which a table made on the driver is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Steps of the hash range in which token mass is summed for each pattern.
BUCKETS = 1024
_BIG = 1 << 60


class Flow:
    """Minimum-cost flow by successive shortest paths with potentials; capacities are whole numbers of tokens."""

    def __init__(self, n: int):
        self.g: list[list[list]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, capacity: int, cost: int) -> tuple[int, int]:
        self.g[a].append([b, capacity, cost, len(self.g[b])])
        self.g[b].append([a, 0, -cost, len(self.g[a]) - 1])
        return a, len(self.g[a]) - 1

    def run(self, s: int, t: int) -> int:
        total, n = 0, len(self.g)
        potential = [0] * n
        while True:
            dist, back = [_BIG] * n, [None] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for i, (v, cap, cost, _) in enumerate(self.g[u]):
                    if cap > 0 and (nd := d + cost + potential[u] - potential[v]) < dist[v]:
                        dist[v], back[v] = nd, (u, i)
                        heapq.heappush(heap, (nd, v))
            if dist[t] >= _BIG:
                return total
            for v in range(n):
                if dist[v] < _BIG:
                    potential[v] += dist[v]
            push, v = _BIG, t
            while v != s:
                u, i = back[v]
                push = min(push, self.g[u][i][1])
                v = u
            v = t
            while v != s:
                u, i = back[v]
                self.g[u][i][1] -= push
                self.g[v][self.g[u][i][3]][1] += push
                v = u
            total += push


def _search(solve, high: int) -> int:
    """The largest size whose quotas are all filled."""
    low = 0
    if solve(high)[1]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if solve(mid)[1] else (low, mid - 1)
    return low


def _routed(mass: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None) -> tuple[dict, int, dict]:
    """Flow and total as ``route`` gives them, and the length of each repetition's part of a pattern's order: {(pattern, repetition): tokens}."""
    sources = sorted(s for s, (share, uses) in targets.items() if share > 0 and uses > 0)
    limit = {s: targets[s][1] for s in sources}
    # a pattern's reach: the uses that any of its sources may make of it
    patterns = {p: max(limit[s] for s in p if s in limit) for p in sorted(mass) if mass[p] > 0 and any(s in limit for s in p)}
    if not patterns:
        return {}, 0, {}

    def solve(size: int, length: dict | None) -> tuple[dict, bool, int]:
        quota = {s: int(size * targets[s][0]) for s in sources}
        f = Flow(0)
        node = lambda: (f.g.append([]), len(f.g) - 1)[1]
        origin, sink = node(), node()
        at = {s: node() for s in sources}
        edges = {}
        for p, most in patterns.items():
            able = [s for s in p if s in limit]
            shared = len(able) > 1
            for r in range(most):
                n = mass[p] if length is None else length[p, r]
                here = node()
                f.edge(origin, here, n, 0)
                cost = 2 * r * (r + 1) + (shared and r > 0)  # of equal repetitions the texts of one source come first
                for top in range(most, r, -1):
                    if top < most and length is not None:  # uses of a source with this limit must keep clear of the repetitions beyond it
                        after = node()
                        f.edge(here, after, n - length[p, top], 0)
                        here = after
                    for s in able:
                        if limit[s] == top:
                            edges[p, s, r] = f.edge(here, at[s], n, cost)
        for s in sources:
            f.edge(at[s], sink, quota[s], 0)
        got = f.run(origin, sink)
        used = {}
        for key, (a, i) in edges.items():
            b, _, _, rev = f.g[a][i]
            if f.g[b][rev][1]:
                used[key] = f.g[b][rev][1]
        return used, got == sum(quota.values()), got

    most = max(patterns.values())
    size = _search(lambda n: solve(n, None), sum(mass.values()) * most) if total is None else total
    free, _, _ = solve(size, None)
    # lengths of the repetitions as the free flow has them, and those at which shared texts keep to their smallest limit
    wanted, strict = {}, {}
    for p, k in patterns.items():
        least = min(limit[s] for s in p if s in limit)
        for r in range(k):
            wanted[p, r] = mass[p] if r == 0 else min(wanted[p, r - 1], sum(n for (q, _, x), n in free.items() if q == p and x == r))
            strict[p, r] = mass[p] if r < least else 0
    best = None
    for length in (wanted, strict):
        one = _search(lambda n: solve(n, length), size) if total is None else total
        flow, _, got = solve(one, length)
        if best is None or got > best[1]:
            best = flow, got, length
    return best


def route(mass: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[dict, int]:
    """({(pattern, source, repetition): tokens}, total): flow of each pattern's tokens to the sources' quotas, and its sum.

    ``mass``: tokens of the distinct texts of each pattern; ``targets``: share and greatest number of uses of each source.
    Every use of a pattern's texts beyond the first costs more than the one before. A text's uses over all of its sources
    together stay within the smallest limit of the sources that use it: each repetition has a part of the pattern's order,
    and a source with a small limit takes what lies outside of the repetitions beyond it (how long those are, the flow without
    that rule tells). Without ``total`` the largest total is taken at which every quota can be filled.
    """
    flow, got, _ = _routed(mass, targets, total)
    return flow, got


def pieces(flow: dict, length: dict, targets: dict[str, tuple[float, int]]) -> list[tuple]:
    """(pattern, source, repetition, lo, hi): the part of the pattern's order that each flow takes; small limits lie last in a repetition."""
    end = dict(length)
    out = []
    for (p, s, r), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][2], targets[x[0][1]][1], x[0][1])):
        out.append((list(p), s, r, end[p, r] - n, end[p, r]))
        end[p, r] -= n
    return out


def _texts(documents: DataFrame, targets: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, pattern, n_tokens, u): each distinct text of the wanted sources once (its smallest doc_id), with its pattern and place in the hash order."""
    wanted = targets.select("source").filter(F.col("source").isNotNull()).distinct()
    d = documents.select("doc_id", "source", "text").filter(F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)).join(wanted, "source")
    # copies first: the text itself is shuffled once, its 128-bit key tells copies apart
    keyed = d.withColumn("key", F.md5("text"))
    one = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_set("source")).alias("pattern"))
    counted = token_counts(keyed, tokenizer_path, keep=("doc_id",)).dropDuplicates(["doc_id"])
    return one.join(counted, "doc_id").filter("n_tokens > 0").select("doc_id", "pattern", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, tokenizer_path: str, total: int | None = None, seed: int = 7) -> DataFrame:
    """(source, doc_id, n_uses, n_tokens): the texts chosen for each source, how often each is used, and its tokens.

    ``targets`` has source, target_share, max_repeats. Texts of other sources, of a null source, and null and blank texts
    aren't used; copies count as one text, under the smallest doc_id. A source without texts gets none, and then the largest
    total is 0 unless ``total`` is given. Shares deviate by less than one text for each pattern and repetition.
    """
    spark = documents.sparkSession
    texts = _texts(documents, targets, tokenizer_path).withColumn(
        "u", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    ).persist(StorageLevel.DISK_ONLY)
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.collect() if r.source is not None}
    bucket = (F.col("u") / F.lit((1 << 40) // BUCKETS)).cast("int")
    bins = texts.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("mass")).collect()
    hist: dict[tuple[str, ...], dict[int, int]] = {}
    for r in bins:
        hist.setdefault(tuple(r.pattern), {})[r.bucket] = r.mass
    present = {s for p in hist for s in p}
    known = {s: t for s, t in want.items() if s in present} if total is None else want
    flow, _, length = _routed({p: sum(h.values()) for p, h in hist.items()}, known, total)
    schema = "pattern array<string>, source string, repetition int, lo bigint, hi bigint"
    parts = pieces(flow, length, known)
    plan = spark.createDataFrame(parts, schema)
    starts = []
    for p, h in hist.items():
        before = 0
        for b in sorted(h):
            starts.append((list(p), b, before))
            before += h[b]
    near = F.broadcast if max(len(parts), len(starts)) <= BROADCAST_ROWS else lambda d: d
    base = spark.createDataFrame(starts, "pattern array<string>, bucket int, before bigint")
    # position of each text in its pattern's order: mass of the buckets before, and a running sum inside its own bucket only
    inside = Window.partitionBy("pattern", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.withColumn("bucket", bucket).join(near(base), ["pattern", "bucket"]).withColumn(
        "pos", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    )
    chosen = placed.join(near(plan), "pattern").filter((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
    return chosen.groupBy("source", "doc_id").agg(F.count("*").cast("int").alias("n_uses"), F.max("n_tokens").alias("n_tokens"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_texts, max_uses, tokens, share): reached share of each wanted source; 0 for one without texts."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.max("n_uses").alias("max_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens")
    )
    j = targets.select("source", "target_share").join(got, "source", "left").select(
        "source", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_texts", "max_uses", "tokens")]
    )
    return j.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))
