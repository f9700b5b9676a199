"""N-gram Jaccard join with a prefix tree over globally ordered shingle sets.

Order: shingles that many documents have come last (by a count sketch of bounded size over all
documents), the rest by hash.  Two sets with the least similarity share one of their first
``n - ceil(t n) + 1`` shingles, so the tree is split over the cluster by these first shingles.  Sets that
are equal are one node from the start.  For each first shingle the sets under it are held against the
others by length and position; where very many stand under one, first against the smallest of them and their
neighbours, then, as far as their components still differ, against each other.  What passes is verified in a trie: the sets to be held against one set arrive in
lexicographic order, which is the depth-first order of their trie; overlaps of the shared path are
kept, and a branch ends where the rest of the lengths can't reach the overlap that is needed.
Components come from alternating large and small stars, or, of a small fixed number of links, from following them on
the driver: stars over a few rows are hundreds of tasks a round.

So copies and near copies by the thousand cost a link each, no group is ever emitted as all its pairs, and
no link between different components is lost: only pairs within a component already found are skipped.

Edge cases: null and empty texts have an empty set and no links; with fewer words than ``size`` the
whole sequence is one shingle; repeated rows are copies of each other; an empty table gives no rows;
extra columns are not carried by ``jaccard_groups`` and stay as they are in ``one_of_each``, whatever their names; texts of any length are
whole; of equal documents and of a group the smallest doc_id stays, of rows that share it the one whose text has the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cleaned, staged
from .words import Hashed, roll, slices

#: Slots of the count sketch; 24 bits of a shingle's hash.
SLOTS = 1 << 24
SHIFT = np.uint64(40)
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
#: Sets under a first shingle up to this number are held against each other at once.
RUN = 4
#: So many links, 16 bytes each, are followed on the driver; more of them by stars on the cluster.
FEW = 50_000


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Distinct shingles of each whole text as 64-bit hashes, ascending."""
    words = Hashed(column)
    every, starts = words.rolled(size), words.starts.tolist()
    for lo, hi in zip(starts, starts[1:]):
        if hi - lo >= size:
            yield np.unique(every[lo : hi - size + 1])
        else:
            yield roll(words.hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, dtype=np.uint64)


def needed(n: np.ndarray | int, percent: int):
    """The least overlap that a set of n can have with any that is similar enough."""
    return (percent * n + 99) // 100


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: 64 that do nearly always, and 64 more."""
    if not len(tokens):
        return 0, 0
    key = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed=len(tokens))
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def set_key(tokens: np.ndarray, twins: frozenset) -> int:
    """The first 64 bits, or for the few sets that share them with a different set, ``twins``, the others."""
    key, more = set_keys(tokens)
    return more if key in twins else key


def sketch(tokens: np.ndarray) -> bytes:
    """Of 64 to 4096 parts of the hash space, some two for each token, whether an odd number of tokens falls in them."""
    bits = min(12, max(6, len(tokens).bit_length() + 1))
    places = (tokens >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=1 << bits) & 1).tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch that has ``size`` words of 64 bits, of longer ones."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def differ(n, m, percent: int):
    """What two sets of n and m that are similar enough differ by at most; the bits of their sketches differ by no more."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def sketches_pass(percent: int):
    """a, b, n, m, u, v (sizes and sketches) -> pairs that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            keep = []
            for u, v, most in zip(batch.column(4), batch.column(5), differ(n, m, percent).tolist()):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (u, v))
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def describe(size: int):
    """doc_id, text_hash, text -> kind 0: doc_id, text_hash, set keys, set size, sketch; kind 1: slot and count of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, slots, total = set(), np.zeros(SLOTS, dtype=np.uint32), 0
        names = ["kind", "a", "b", "c", "more", "d", "sketch"]
        for batch in batches:
            for part in slices(batch, 2):
                keys, others, sizes, new, sketches = [], [], [], [], []
                for tokens in shingle_sets(part.column(2), size):
                    key, more = set_keys(tokens)
                    keys.append(key)
                    others.append(more)
                    sizes.append(len(tokens))
                    sketches.append(sketch(tokens))
                    if key not in seen:
                        seen.add(key)
                        new.append(tokens)
                if new:
                    slot, n = np.unique(np.concatenate(new) >> SHIFT, return_counts=True)
                    slots[slot.astype(np.int64)] += n.astype(np.uint32)
                    total += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keys), dtype=np.int32)), part.column(0), part.column(1), pa.array(keys, pa.int64()), pa.array(others, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=names)
        mean = total / SLOTS  # what stands out from chance
        hot = np.flatnonzero(slots >= 3 + mean + 4 * mean**0.5)
        zero = np.zeros(len(hot), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(hot), pa.array(slots[hot].astype(np.int64)), pa.array(zero), pa.array(zero), pa.array(zero), pa.nulls(len(hot), pa.binary())], names=names)

    return run


def ordered(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens in the global order: 6 bits of frequency, then 58 of the digest."""
    level = levels[(tokens >> SHIFT).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(58)) | (tokens & np.uint64((1 << 58) - 1)))


def prefixes(size: int, percent: int, levels: np.ndarray, twins: frozenset):
    """doc_id, text_hash, text -> token, set, n, pos for the first tokens of each set that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch, 2):
                cols: list[list] = [[], [], [], []]
                for tokens in shingle_sets(part.column(2), size):
                    key, n = set_key(tokens, twins), len(tokens)
                    if n and key not in seen:
                        seen.add(key)
                        first = ordered(tokens, levels)[: n - int(needed(n, percent)) + 1].view(np.int64)
                        for col, x in zip(cols, (first, np.full(len(first), key), np.full(len(first), n, dtype=np.int32), np.arange(len(first), dtype=np.int32))):
                            col.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["token", "set", "n", "pos"])

    return run


def runs(batches: Iterator[pa.RecordBatch], columns: list[str], block: int | None = None):
    """Batches of whole runs of equal keys (the first column), from rows sorted by it; runs longer than ``block`` come in
    blocks of that size or more."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield [c[:last] for c in cols]
        rest = [c[last:] for c in cols]
        if block and len(rest[0]) >= block:
            yield rest
            rest = None
    if rest is not None and len(rest[0]):
        yield rest


def possible(n1, p1, n2, p2, percent: int) -> np.ndarray:
    """Length and position filter for two sets that share the tokens at these places, n1 <= n2."""
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 * n1 >= percent * n2) & ((100 + percent) * most >= percent * (n1 + n2))


def candidates(percent: int):
    """Rows by token -> kind 0: pairs (a, b) of sets under a token; kind 1: token, set, n, pos of tokens with very many sets,
    of which only the pairs with the smallest set and of neighbours are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, before = ["kind", "a", "b", "n", "pos"], None
        for token, key, n, pos in runs(batches, ["token", "set", "n", "pos"], 1 << 20):
            order = np.lexsort((key, n, token))
            same = np.append(False, (token[order][1:] == token[order][:-1]) & (key[order][1:] == key[order][:-1]))
            order = order[~same]  # copies from several tasks
            t, k, m, p = token[order], key[order], n[order].astype(np.int64), pos[order].astype(np.int64)
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            sizes = np.diff(np.append(starts, len(t)))
            size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
            large = (size > RUN) | (t == before)  # or the rest of a run that came before
            before = t[-1]
            left, right = [], []
            first = np.flatnonzero(large & (start != np.arange(len(t))))
            left.append(start[first])
            right.append(first)
            at = np.arange(len(t))
            for step in range(1, RUN):
                at = at[(at + step < len(t))]
                at = at[(t[np.minimum(at + step, len(t) - 1)] == t[at]) & (~large[at] | (step == 1))]
                if not len(at):
                    break
                left.append(at)
                right.append(at + step)
            a, b = np.concatenate(left), np.concatenate(right)
            hit = possible(m[a], p[a], m[b], p[b], percent)
            a, b = k[a[hit]], k[b[hit]]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=np.int64)
            i = np.flatnonzero(large)
            zero = np.zeros(len(pairs), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((zero, np.ones(len(i), dtype=np.int32)), (pairs[:, 0], t[i]), (pairs[:, 1], k[i]), (zero, m[i].astype(np.int32)), (zero, p[i].astype(np.int32)))], names=names)

    return run


class Sketches:
    """Sketches of sets, to hold one against many."""

    def __init__(self, sketches):
        words = [np.frombuffer(x, dtype=np.uint64) for x in sketches]
        self.size = np.array([len(x) for x in words])
        self.own, self.half, self.at = {}, {}, np.zeros(len(words), dtype=np.int64)
        for size in np.unique(self.size).tolist():
            i = np.flatnonzero(self.size == size)
            self.at[i] = np.arange(len(i))
            self.own[size] = np.stack([words[j] for j in i])
            if size > 1:
                self.half[size // 2] = fold(self.own[size], size // 2)

    def differ(self, i: int, others: np.ndarray) -> np.ndarray:
        """What set i and the others differ by at least; these have as many bits or twice as many."""
        size = int(self.size[i])
        x, out = self.own[size][self.at[i]], np.zeros(len(others), dtype=np.int64)
        for table, same in ((self.own, self.size[others] == size), (self.half, self.size[others] == 2 * size)):
            if same.any():
                out[same] = np.bitwise_count(table[size][self.at[others[same]]] ^ x).sum(axis=1)
        return out


def across(percent: int, nearest: bool):
    """Rows by token, with the component and the sketch of each set -> pairs across components that nothing rules out;
    with ``nearest`` one for each row, that whose sketches differ the least.

    A token whose sets are one component has nothing to add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, key, n, pos, comp, drawn in runs(batches, ["token", "set", "n", "pos", "comp", "sketch"]):
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            ends = np.append(starts[1:], len(token))
            for s, e in zip(starts, ends):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                order = s + np.lexsort((key[s:e], n[s:e]))
                order = order[np.append(True, key[order][1:] != key[order][:-1])]
                k, m, p, c = key[order], n[order].astype(np.int64), pos[order].astype(np.int64), comp[order]
                sketches = Sketches(drawn[order])
                for i in range(len(k) - 1):
                    end = int(np.searchsorted(m, m[i] * 100 // percent, side="right"))  # length filter
                    js = i + 1 + np.flatnonzero((c[i + 1 : end] != c[i]) & possible(m[i], p[i], m[i + 1 : end], p[i + 1 : end], percent))
                    if len(js):
                        least = sketches.differ(i, js)
                        fits = least <= differ(m[i], m[js], percent)
                        js, least = js[fits], least[fits]
                    if len(js):
                        js = js[[int(np.argmin(least))]] if nearest else js
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[js], k[i])), pa.array(np.maximum(k[js], k[i]))], names=["a", "b"])

    return run


def members(size: int, levels: np.ndarray):
    """doc_id, set, text -> set, its tokens in the global order as big-endian bytes (which sort as a trie is walked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data = [ordered(tokens, levels).astype(">u8").tobytes() for tokens in shingle_sets(part.column(1), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["set", "tokens"])

    return run


class Walk:
    """Depth-first walk over the trie of the sets that are held against one root set."""

    STEP = 64

    def __init__(self, root: np.ndarray, percent: int):
        self.root, self.percent = root, percent
        self.path = np.zeros(0, dtype=np.uint64)
        self.overlap = np.zeros(1, dtype=np.int64)  # of the path's first 0, 1, ... tokens; as far as it was walked

    def similar(self, x: np.ndarray) -> bool:
        shared = min(len(x), len(self.path), len(self.overlap) - 1)
        differ = np.flatnonzero(x[:shared] != self.path[:shared])
        depth = int(differ[0]) if len(differ) else shared
        need = -(-self.percent * (len(x) + len(self.root)) // (100 + self.percent))
        known = [self.overlap[: depth + 1]]
        self.path = x
        got = int(self.overlap[depth])
        while got + len(x) - depth >= need and depth < len(x):  # else the branch is pruned
            part = x[depth : depth + self.STEP]
            i = np.minimum(np.searchsorted(self.root, part), len(self.root) - 1)
            known.append(got + np.cumsum(self.root[i] == part))
            got, depth = int(known[-1][-1]), depth + len(part)
        self.overlap = np.concatenate(known)
        return depth == len(x) and 100 * got >= self.percent * (len(x) + len(self.root) - got)


def verify(percent: int):
    """a, salt, b, tokens in order of a, salt, b (null first: the root itself), tokens -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                tokens = np.frombuffer(data.as_buffer(), dtype=">u8").astype(np.uint64)
                if b is None:
                    walk = Walk(tokens, percent)
                elif walk.similar(tokens):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def followed(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the smallest node reachable from each, without those that are it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:  # a node points at a smaller one; its links join what both point at, then paths are halved until they end
        x, y = least[i], least[j]
        if (x == y).all():
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (up := least[least])).any():
            least = up
    own = least != np.arange(len(nodes))
    return nodes[own], nodes[least[own]]


def components(links: DataFrame, tries: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) of the links a, b: alternating large and small stars."""
    edges, was = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"), None
    if edges.count() <= FEW:
        few = edges.toPandas()
        found = followed(few["u"].to_numpy(dtype=np.int64), few["v"].to_numpy(dtype=np.int64))
        table = pa.table([pa.array(x, pa.int64()) for x in found], names=["node", "comp"])
        return staged(links.sparkSession.createDataFrame(table), "comps")
    for _ in range(tries):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u > v").distinct(), "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        was = now
    raise RuntimeError("components did not settle")


def jaccard_groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, set, n_shingles, component_id (the smallest doc_id reachable)."""
    with cleaned(docs.sparkSession):
        out = grouped(docs, size, percent)
    return out.select("*")  # whose own shuffle files stay as long as it


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = staged(docs.mapInArrow(describe(size), "kind int, a long, b long, c long, more long, d long, sketch binary"), "sets")
    keyed = found.filter("kind = 0")
    # different sets with the same 64 bits: a few in 10**11 documents
    twins = frozenset(r.c for r in keyed.groupBy("c").agg(F.min("more").alias("lo"), F.max("more").alias("hi")).filter("lo != hi").select("c").collect())
    key = F.when(F.col("c").isin(*twins), F.col("more")).otherwise(F.col("c")) if twins else F.col("c")
    rows = keyed.select(F.col("a").alias("doc_id"), F.col("b").alias("text_hash"), key.alias("set"), F.col("d").alias("n_shingles"), "sketch")
    hot = found.filter("kind = 1").groupBy("a").agg(F.sum("b").cast("int").alias("b")).select(F.col("a").cast("int").alias("a"), "b").toPandas()  # SLOTS rows at most
    levels = np.zeros(SLOTS, dtype=np.uint8)
    if len(hot):
        levels[hot["a"].to_numpy()] = np.minimum(63, 1 + np.floor(np.log2(hot["b"].to_numpy()))).astype(np.uint8)
    first = docs.mapInArrow(prefixes(size, percent, levels, twins), "token long, set long, n int, pos int")
    both = staged(first.repartition("token").sortWithinPartitions("token").mapInArrow(candidates(percent), "kind int, a long, b long, n int, pos int"), "candidates")
    nodes = rows.filter("n_shingles > 0").groupBy("set").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = staged(nodes.select("set", "r.*", "n", "sketch"), "nodes")
    pairs = staged(sketched(both.filter("kind = 0").select("a", "b").distinct(), nodes, percent), "pairs")
    # one partner for each set first: most of the others are then in its component anyway
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = staged(check(docs, nodes, one, size, percent, levels), "links")
    comps = components(links)
    comp = F.coalesce("comp", "set").alias("comp")
    sides = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "ab"]
    rest = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(one, ["a", "b"], "left_anti")
    rest = staged(rest, "pairs")
    if not rest.isEmpty():
        links = staged(links.union(check(docs, nodes, rest, size, percent, levels)), "links")
        comps = components(links)
    large = both.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("set"), "n", "pos")
    done, drawn = pairs.select("a", "b"), nodes.select("set", "sketch")
    # as trees grow: the nearest set of another component first, which joins most components of a group; then all that are left
    for nearest in (True, True, False):
        if large.isEmpty():
            break
        with_comp = staged(large.join(comps.withColumnRenamed("node", "set"), "set", "left").select("token", "set", "n", "pos", comp), "large")
        mixed = with_comp.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("token")
        more = with_comp.join(mixed, "token").join(drawn, "set").select("token", "set", "n", "pos", "comp", "sketch").repartition("token").sortWithinPartitions("token").mapInArrow(across(percent, nearest), "a long, b long")
        more = staged(more.distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            links = staged(links.union(check(docs, nodes, more, size, percent, levels)), "links")
            comps = components(links)
            done = done.union(more)
    of = nodes.select("set", "doc_id").join(comps.withColumnRenamed("node", "set"), "set", "left").select("set", "doc_id", comp)
    least = of.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = of.join(least, "comp").select("set", "component_id")
    own = lambda c: F.when(c != NO_ID, c)
    return rows.join(named, "set", "left").select(own(F.col("doc_id")).alias("doc_id"), "text_hash", "set", "n_shingles", own(F.coalesce("component_id", "doc_id")).alias("component_id"))


def sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches don't rule out."""
    x = nodes.select(F.col("set").alias("a"), "n", F.col("sketch").alias("u"))
    y = nodes.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("v"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "u", "v").mapInArrow(sketches_pass(percent), "a long, b long")


def check(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """The pairs of sets that are similar enough.  A set with very many partners is walked in several tasks."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    chosen = nodes.select("set", "doc_id", "text_hash").join(wanted, "set")
    texts = docs.join(chosen, ["doc_id", "text_hash"]).dropDuplicates(["set"]).select("set", "text")
    sets = staged(texts.mapInArrow(members(size, levels), "set long, tokens binary"), "tokens")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 500).alias("salts"))
    others = pairs.join(salts, "a").withColumn("salt", F.pmod("b", "salts")).join(sets.withColumnRenamed("set", "b"), "b").select("a", "salt", "b", "tokens")
    roots = salts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).join(sets.withColumnRenamed("set", "a"), "a")
    roots = roots.select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens")
    order = [F.col("a"), F.col("salt"), F.col("b").isNotNull(), F.col("tokens")]
    return roots.union(others).repartition("a", "salt").sortWithinPartitions(*order).mapInArrow(verify(percent), "a long, b long")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays; documents without words stay."""
    groups = jaccard_groups(docs, size, percent)
    keep = groups.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash", F.lit(True).alias("one"))
    keep = keep.union(groups.filter("n_shingles = 0").select("doc_id", "text_hash", F.lit(False).alias("one")).distinct())
    x = docs.select("doc_id", F.xxhash64("text").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("x")
    k = keep.alias("k")
    joined = x.join(k, F.col("x.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("x.h") == F.col("k.text_hash")))
    nth = F.row_number().over(Window.partitionBy("x.doc_id", "x.h").orderBy("x.h"))
    return joined.select("row", "one", nth.alias("nth")).filter(~F.col("one") | (F.col("nth") == 1)).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")
