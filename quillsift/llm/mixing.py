"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their membership pattern).  The driver
sees one number per pattern, solves a min-cost flow (pattern capacity -> source quotas, the r-th copy
of a token costing r - 1), and sends back how many tokens each pattern gives.  Documents are then
selected in a seeded hash order: a distributed prefix sum over (pattern, size class, hash bucket), so
no source is ever gathered into one task.

Edge cases: null text has size 0 and is never taken; null source is a source of its own, last in
order; repeated rows are separate rows; an empty table gives an empty result; extra columns, whatever
their names, stay out of the computation.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: Hash buckets for each pattern and size class: the prefix sum is first over buckets, then inside one.
BUCKETS = 1024
#: Patterns the driver solves for; beyond this the sources should be grouped first.
MAX_PATTERNS = 200_000


def target_shares(sizes: list[float], weights: list[float], share: float, max_repeats: float) -> list[float]:
    """Split ``share`` times all sizes by weight; a target stops at ``max_repeats`` times its size and
    the excess is shared again by weight among the others."""
    targets, active = [0.0] * len(sizes), set(range(len(sizes)))
    left = share * sum(sizes)
    while active:
        total = sum(weights[i] for i in active)
        give = {i: left * weights[i] / total for i in active}
        full = [i for i in active if give[i] > max_repeats * sizes[i]]
        if not full:
            for i in active:
                targets[i] = give[i]
            break
        for i in full:
            targets[i] = float(max_repeats * sizes[i])
            left -= targets[i]
            active.discard(i)
    return targets


class MinCostFlow:
    """Successive shortest augmenting paths; real capacities, small graphs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[float] = []
        self.cost: list[float] = []

    def arc(self, u: int, v: int, cap: float, cost: float) -> int:
        for a, b, c, k in ((u, v, cap, cost), (v, u, 0.0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
            self.cost.append(k)
        return len(self.to) - 2

    def solve(self, s: int, t: int, eps: float = 1e-7) -> None:
        n = len(self.out)
        while True:
            dist, by, queued = [math.inf] * n, [-1] * n, [False] * n
            dist[s], queue = 0.0, deque([s])
            while queue:
                u = queue.popleft()
                queued[u] = False
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] > eps and dist[u] + self.cost[e] < dist[v] - 1e-12:
                        dist[v], by[v] = dist[u] + self.cost[e], e
                        if not queued[v]:
                            queued[v] = True
                            queue.append(v)
            if dist[t] == math.inf:
                return
            path, v = [], t
            while v != s:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def route(patterns: list[tuple[frozenset, float]], quotas: dict, max_repeats: int) -> list[float]:
    """Tokens each pattern gives: copies cost 0, 1, 2, ... a token, quotas are met as far as they can be."""
    sources = {s: i for i, s in enumerate(quotas)}
    first = 1 + len(patterns)
    net = MinCostFlow(first + len(sources) + 1)
    sink, copies = first + len(sources), []
    for p, (members, size) in enumerate(patterns):
        copies.append([net.arc(0, 1 + p, size, r) for r in range(max_repeats)])
        for s in members:
            net.arc(1 + p, first + sources[s], math.inf, 0.0)
    for s, i in sources.items():
        net.arc(first + i, sink, quotas[s], 0.0)
    net.solve(0, sink)
    return [sum(net.cap[e ^ 1] for e in arcs) for arcs in copies]


def code_point_order(names) -> list:
    """By code point, None last."""
    return sorted(names, key=lambda s: (s is None, s or ""))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeats: int = 2, seed: int = 17, members=None) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, size, source_size, target, taken.

    ``members``: column with an array of the sources a document belongs to (default: its one source).
    A document's source_size and target are those of its sources together.  ``weights`` repeat over
    the sources in code point order.  Same input, same seed: same result.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    members = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    text_hash = F.xxhash64("text")
    rows = staged(
        docs.select("doc_id", text_hash.alias("text_hash"), members.alias("members"), size.alias("size"))
        .withColumn("cls", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int"))
        .withColumn("k", F.xxhash64("doc_id", "text_hash", F.lit(seed))),
        "sizes",
    )
    strata = rows.groupBy("members", "cls").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(strata) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: group the sources first")
    sizes: dict = {}
    for r in strata:
        sizes[tuple(r.members)] = sizes.get(tuple(r.members), 0) + r["size"]
    order = code_point_order({s for m in sizes for s in m})
    source_size = {s: sum(v for m, v in sizes.items() if s in m) for s in order}
    targets = dict(zip(order, target_shares([source_size[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], share, max_repeats)))
    patterns = [(frozenset(m), float(v)) for m, v in sizes.items()]
    gives = dict(zip(sizes, route(patterns, targets, max_repeats)))

    plan, schema = [], "members array<string>, cls int, source_size long, target double, copies int, quota double"
    for r in strata:
        m = tuple(r.members)
        copies = min(max_repeats, int(gives[m] / sizes[m] + 1e-9)) if sizes[m] else 0
        rest = max(0.0, gives[m] - copies * sizes[m]) if copies < max_repeats else 0.0
        plan.append((list(m), r.cls, sum(source_size[s] for s in m), float(sum(targets[s] for s in m)), copies, rest * r["size"] / sizes[m] if sizes[m] else 0.0))
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_PATTERNS rows

    rows = rows.withColumn("b", F.pmod("k", F.lit(BUCKETS)).cast("int"))
    # A source that holds a third of all rows is spread over BUCKETS x size classes here.
    inner = Window.partitionBy("members", "cls", "b").orderBy("k")
    ranked = rows.withColumn("inside", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(inner))
    buckets = rows.groupBy("members", "cls", "b").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("members", "cls").orderBy("b")) - F.col("in_bucket")).drop("in_bucket")
    x, y = ranked.alias("x"), buckets.alias("y")
    placed = x.join(y, F.col("x.members").eqNullSafe(F.col("y.members")) & (F.col("x.cls") == F.col("y.cls")) & (F.col("x.b") == F.col("y.b"))).select("x.*", (F.col("y.before") + F.col("x.inside")).alias("upto"))
    placed = placed.join(plan_df.alias("p"), F.col("x.members").eqNullSafe(F.col("p.members")) & (F.col("x.cls") == F.col("p.cls"))).select("x.doc_id", "x.text_hash", "x.members", "x.cls", "x.size", "x.b", "x.rn", "upto", "p.source_size", "p.target", "p.copies", "p.quota")
    placed = staged(placed.withColumn("extra", (F.col("size") > 0) & (F.col("upto") <= F.col("quota"))), "placed")

    # What the prefixes left of each pattern's share goes to the documents next in order, large ones first.
    left = {tuple(r.members): -float(r.got or 0) for r in placed.groupBy("members").agg(F.sum(F.when(F.col("extra"), F.col("size"))).alias("got")).collect()}
    for p in plan:
        left[tuple(p[0])] = left.get(tuple(p[0]), 0.0) + p[5]
    step = F.pow(F.lit(2.0), F.col("cls") + 1)
    near = placed.filter(~F.col("extra") & (F.col("size") > 0) & (F.col("copies") < max_repeats) & (F.col("quota") > 0) & (F.col("upto") - F.col("size") < F.col("quota") + 8 * step))
    picks = []  # some 16 documents for each pattern and size class
    for r in near.select("members", "cls", "b", "rn", "size").orderBy(F.desc("cls"), "b", "rn").collect():
        m = tuple(r.members)
        if r["size"] <= left[m]:
            left[m] -= r["size"]
            picks.append((list(m), r.cls, r.b, r.rn, True))
    picked = spark.createDataFrame(picks, "members array<string>, cls int, b int, rn int, also boolean").alias("q")
    out = placed.alias("x").join(F.broadcast(picked), F.col("x.members").eqNullSafe(F.col("q.members")) & (F.col("x.cls") == F.col("q.cls")) & (F.col("x.b") == F.col("q.b")) & (F.col("x.rn") == F.col("q.rn")), "left")
    extra = F.col("x.extra") | F.coalesce(F.col("q.also"), F.lit(False))
    return out.select("x.doc_id", "x.text_hash", "x.size", "x.source_size", "x.target", (F.col("x.size") * (F.col("x.copies") + extra.cast("int"))).cast("long").alias("taken"))


def sample_mixture(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it (not at all, once, or repeated)."""
    plan = mix(docs, **how).filter(F.col("taken") > 0).select("doc_id", "text_hash", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    plan = plan.groupBy("doc_id", "text_hash").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    x, p = docs.withColumn("__h", F.xxhash64("text")).alias("x"), plan.alias("p")
    joined = x.join(p, F.col("x.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("x.__h") == F.col("p.text_hash")))
    # rows that are equal in id and text share their repeats: rn deals them out
    w = Window.partitionBy("x.doc_id", "x.__h").orderBy("x.__h")
    n = F.expr("CAST(p.times DIV p.rows AS INT)") + (F.col("__rn") <= F.expr("p.times % p.rows")).cast("int")
    once = joined.withColumn("__rn", F.row_number().over(w)).withColumn("__n", n).filter(F.col("__n") > 0)
    return once.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*[F.col(f"x.`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
