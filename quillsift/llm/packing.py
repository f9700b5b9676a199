"""Best-fit packing by bin completion with branch and bound.

What is packed is a histogram: how many pieces there are of each length, at most ``capacity`` numbers
however large the corpus is.  The driver completes bins around the largest length left: it searches
the undominated fillings of the rest, pruned by the waste a bin may have if the lower bound is still to
be met, with best fit as the first incumbent; a filling is then used as many times as its lengths
last.  The end game, a few dozen bins, is searched with branch and bound.  The executors number the pieces
of each length (a prefix sum over hash buckets, so a length that a third of all pieces have is spread
out) and look up their place in the resulting intervals, a bounded table.

Edge cases: null and empty texts are the end token alone; texts longer than ``capacity`` are cut, the last piece may be
shorter; repeated rows are packed as often as they occur; an empty table gives no rows; extra columns
are not carried.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 512
#: Search limits: nodes for a bin, for all bins together, of the end game; lengths in the end game.
NODES, ALL_NODES, END_NODES, END_ITEMS = 4000, 2_000_000, 20_000, 120


# ---------------------------------------------------------------- bin completion


def completion(rest: int, sizes: list[int], left: dict[int, int], allowed: int, nodes: int = NODES, spent: list[int] | None = None) -> tuple[int, ...]:
    """The undominated filling of ``rest`` with the least waste that the search meets.

    ``sizes``: ascending lengths there are; ``left``: how many of each.  A single length that fills the
    rest dominates every other filling.  Among fillings of equal waste that with the larger lengths is
    met first and kept: it dominates those that split a length in smaller ones.  The search ends at a
    filling that wastes nothing, or is out of nodes; waste within ``allowed`` ends it after a tenth.
    """
    best: list = [rest, ()]  # waste, filling; best fit comes first in the search: the incumbent
    budget = [nodes]

    def go(room: int, top: int, chosen: list[int], used: dict[int, int]) -> bool:
        if room < best[0]:
            best[0], best[1] = room, tuple(chosen)
            if room == 0:
                return True
        i = bisect.bisect_right(sizes, room, 0, top + 1) - 1
        while i >= 0:
            s = sizes[i]
            budget[0] -= 1
            if budget[0] <= 0 or (best[0] <= allowed and budget[0] < nodes * 0.9):
                return True
            if used.get(s, 0) < left[s]:
                # no bin can end better than with lengths of s and less, all there are of them
                used[s] = used.get(s, 0) + 1
                chosen.append(s)
                if go(room - s, i, chosen, used):
                    return True
                chosen.pop()
                used[s] -= 1
            i -= 1
        return False

    if rest:
        go(rest, len(sizes) - 1, [], {})
    if spent:
        spent[0] += nodes - budget[0]
    return best[1]


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Bins needed at least: by total length, and with lengths over a half each in its own bin (Martello and Toth's L2)."""
    best = -(-sum(s * n for s, n in left.items()) // capacity)
    for k in sorted({s for s in left if s <= capacity // 2} | {0}):
        large = sum(n for s, n in left.items() if s > capacity - k)
        middle = [(s, n) for s, n in left.items() if capacity // 2 < s <= capacity - k]
        room = sum((capacity - s) * n for s, n in middle)
        small = sum(s * n for s, n in left.items() if k <= s <= capacity // 2)
        best = max(best, large + sum(n for _, n in middle) + max(0, -(-(small - room) // capacity)))
    return best


def complete_bins(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the bins."""
    left, out, spent = dict(left), [], [1]
    sizes = sorted(left)
    allowed = max(0, lower_bound(left, capacity) * capacity - sum(s * n for s, n in left.items()))
    while sizes:
        top = sizes[-1]
        left[top] -= 1
        rest_sizes = sizes if left[top] else sizes[:-1]
        filling = completion(capacity - top, rest_sizes, left, min(allowed, 1), NODES if spent[0] < ALL_NODES else 60, spent)
        left[top] += 1
        one: dict[int, int] = {}
        for s in (top, *filling):
            one[s] = one.get(s, 0) + 1
        times = min(left[s] // n for s, n in one.items())
        out.append((times, (top, *filling)))
        for s, n in one.items():
            left[s] -= n * times
            if not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
    return out


def branch(items: list[int], capacity: int, bound: int, limit: int) -> list[tuple[int, ...]] | None:
    """Bins for ``items`` in at most ``bound`` bins, by depth-first search over completions; None if it finds none in ``limit`` nodes."""
    nodes, total = [limit], sum(items)

    def fillings(room: int, pool: list[int]) -> list[tuple[int, ...]]:
        """Undominated fillings, least waste first: no item left fits in what stays free."""
        found: dict[tuple[int, ...], int] = {}

        def go(at: int, free: int, chosen: tuple[int, ...]) -> None:
            if len(found) >= 64 or nodes[0] <= 0:
                return
            nodes[0] -= 1
            fits, seen = False, set()
            for j in range(at, len(pool)):
                if pool[j] <= free and pool[j] not in seen:
                    fits = True
                    seen.add(pool[j])
                    go(j + 1, free - pool[j], (*chosen, pool[j]))
            if not fits and not any(x <= free for x in pool[:at] if pool[:at].count(x) > chosen.count(x)):
                found[chosen] = free

        go(0, room, ())
        return sorted(found, key=lambda c: (found[c], len(c), [-x for x in c]))

    def solve(pool: list[int], bins: int, waste: int) -> list[tuple[int, ...]] | None:
        if not pool:
            return []
        if bins <= 0 or nodes[0] <= 0:
            return None
        top, rest = pool[0], pool[1:]
        for filling in fillings(capacity - top, rest):
            lost = capacity - top - sum(filling)
            if lost > waste:  # more waste than the bound leaves
                break
            after = list(rest)
            for s in filling:
                after.remove(s)
            if (found := solve(after, bins - 1, waste - lost)) is not None:
                return [(top, *filling), *found]
        return None

    return solve(sorted(items, reverse=True), bound, bound * capacity - total)


def pack_histogram(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of bins that hold every length as often as ``left`` says."""
    left = {s: n for s, n in left.items() if n > 0}
    if not left:
        return []
    bound = lower_bound(left, capacity)
    best = complete_bins(left, capacity)
    if sum(t for t, _ in best) > bound:  # the end game: the last bins, whose lengths branch and bound packs anew
        keep, items, bins = list(best), [], 0
        while keep and len(items) < END_ITEMS:
            times, filling = keep.pop()
            n = min(times, max(1, (END_ITEMS - len(items)) // len(filling)))
            if n < times:
                keep.append((times - n, filling))
            items += list(filling) * n
            bins += n
        need = max(-(-sum(items) // capacity), bins - (sum(t for t, _ in best) - bound))
        if need < bins and (found := branch(items, capacity, need, END_NODES)):
            best = keep + [(1, f) for f in found]
    return best


def intervals(bins: list[tuple[int, tuple[int, ...]]], first_bin: int = 0):
    """Where the r-th piece of a length goes: rows (length, first rank, bin, per bin, offset), by length and rank."""
    rows, taken, at = [], {}, first_bin
    for times, filling in bins:
        offset, i = 0, 0
        while i < len(filling):
            s = filling[i]
            n = filling[i:].count(s) if i == 0 or filling[i - 1] != s else 1
            rows.append((s, taken.get(s, 0), at, n, offset))
            taken[s] = taken.get(s, 0) + n * times
            offset += n * s
            i += n
        at += times
    return sorted(rows)


# ---------------------------------------------------------------- tokens


def places(found: list) -> list[int]:
    """Where None stands."""
    out, at, left = [], -1, found.count(None)
    for _ in range(left):
        at = found.index(None, at + 1)
        out.append(at)
    return out


class Tokens:
    """Token ids of a text as little-endian bytes.

    The vocabulary's pattern splits a lower-cased text in runs of letters, single digits and runs of
    other characters, and never spans white space.  So a text is the sum of its words, a plain word (printable
    ASCII and Latin-1 without apostrophes, which may start contractions) the sum of such parts, and each
    is tokenized once for a worker's caches of bounded size.  Parts go to the tokenizer many at a time, one space apart;
    a part's last token is the only one that ends in </w>.  Other words go to the tokenizer as they are.
    """

    LIMIT = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool, self.cache, self.old, self.parts = Tokenizer.from_file(path), {}, {}, {}
        self.words = re.compile(r"[^ \t\n\v\f\r]+").findall
        self.plain = re.compile(r"(?:(?!<\|)[!-&(-~¡-ÿ])+").fullmatch
        letters, digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
        self.split = re.compile(f"[{letters}]+|[{digits}]|[^{letters}{digits}]+").findall
        vocabulary = self.tool.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def each(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tool.encode_batch_fast(items, add_special_tokens=False)]

    def learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 6400):
            groups = [parts[i : i + 64] for i in range(at, min(at + 6400, len(parts)), 64)]
            for group, e in zip(groups, self.tool.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
                if len(ends) != len(group) or ends[-1] != len(ids):
                    self.parts.update(zip(group, self.each(group)))
                    continue
                data, start = ids.tobytes(), 0
                for part, end in zip(group, ends):
                    self.parts[part] = data[4 * start : 4 * end]
                    start = end

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The cache with these words in it.  Full caches become old ones, from which words that come again are taken over."""
        if len(self.cache) > self.LIMIT:
            self.old, self.cache = self.cache, {}
        if len(self.parts) > self.LIMIT:
            self.parts = {}
        whole, plain, other = [], {}, []
        for w in words:
            if (ids := self.old.get(w)) is not None:
                self.cache[w] = ids
            elif w.isascii() and w.isalpha():
                whole.append(w)
            elif w[-1] in ".,;:!?" and w.isascii() and w[:-1].isalpha():
                plain[w] = (w[:-1].lower(), w[-1])
            elif self.plain(w):
                plain[w] = self.split(w.lower())
            else:
                other.append(w)
        lower = [w.lower() for w in whole]
        self.cache.update(zip(other, self.each(other)))
        self.learn_parts(list(set(lower).union(*plain.values()).difference(self.parts)))
        get = self.parts.__getitem__
        self.cache.update(zip(whole, map(get, lower)))
        for w, ps in plain.items():
            self.cache[w] = b"".join(map(get, ps))
        return self.cache

    def lower(self, text: str) -> str:
        """Words of Latin-1 have one form the less in lower case; the tokenizer lower-cases as well."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        # str.split also splits at four control characters that the vocabulary's pattern takes as signs
        texts = [t.lower() if t.isascii() else self.lower(t) for t in texts]
        words = [self.words(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        get = self.cache.get
        found = [list(map(get, ws)) for ws in words]
        gaps = [places(f) for f in found]
        new = {ws[j] for ws, js in zip(words, gaps) for j in js}
        if new:
            get = self.learn(new).__getitem__
            for ws, f, js in zip(words, found, gaps):
                for j in js:
                    f[j] = get(ws[j])
        return [b"".join(f) for f in found]


#: One for a worker and vocabulary; what it has learned serves its next tasks as well.
_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cutter(path: str, capacity: int, with_ids: bool):
    """mapInArrow function: doc_id, text to pieces of at most ``capacity`` ids, each document ending in id 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], [], []] + [[]] * with_ids
                for doc_id, ids in zip(part.column(0).to_pylist(), tool.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += b"\0\0\0\0"
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        for col, v in zip(out, (doc_id, n, start // 4, len(piece) // 4, zlib.crc32(piece), piece)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return cut


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian bytes)."""
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cutter(tokenizer, capacity, with_ids), PIECES + ", ids binary" * with_ids)
    pieces = staged(pieces.withColumn("k", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")), "pieces")
    counts = staged(pieces.groupBy("length", "k").agg(F.count(F.lit(1)).alias("n")), "counts")  # BUCKETS x capacity rows at most
    left = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(pack_histogram(left, capacity))
    if not table:
        table = [(1, 0, 0, 1, 0)]
    places = np.array(table, dtype="int64")  # some rows for each length, however many pieces there are
    # One sorted key for both: no length has 2**48 pieces.
    keys = places[:, 0] * (1 << 48) + places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype("int64") for i in (3, batch.num_columns - 1))
            row = places[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            cols = batch.columns[:-1]
            cols[3] = pa.array(length)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("k")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "k").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("nth", nth).join(before, ["length", "k"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*columns, (F.col("before") + F.col("nth") - 1).cast("long").alias("rank"))
    schema = PIECES.replace("length int", "length long") + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizer("word_bpe_49k.json"))
