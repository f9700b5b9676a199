"""Language model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and an end after each text.  The root of the tree is the smoothed
unigram distribution over all training tokens.  A state is a context of up to ``DEPTH`` preceding
words, of any words.  Candidates are contexts with the next symbols that follow them LEAST times at least, a
fixed count: what a symbol seen once could gain, log(q / p), is less than what naming it costs, -log(p).  So the tree grows
with the corpus.  A context stays if what it changes in the distribution of its
parent, the context without its first word, is worth more than its parameters cost: the log-likelihood
gain over its own occurrences against half a logarithm of the corpus for each symbol.  The next-symbol
distribution of a state is mixed with that of its parent, so every symbol keeps a probability and each
distribution sums to 1.  A text is scored from the longest suffix that is a state, at every token.

How the work is spread: texts are tokenized once and staged as blocks of whole texts, numbers of words that each block
has for itself.  In rounds, a depth at a time, blocks ask for what the corpus knows of their sequences: the
distinct ones of a block go, as sorted 64-bit hashes in columns of bytes, to buckets by range of the hash, where counts are
summed, and the bucket's answer, in the order of the question, goes to a file of the block.  A question is a row a block and bucket, so neither vocabulary
nor tree meets in one place, and a sequence has one row a block at most, however frequent it is.  A sequence is asked for
only where the one without its first word and the one without its last are frequent enough, as those are as frequent at least.
Each sequence has one owner among the blocks that learn it, which sends its part of the gain of its context, as a whole number: sums don't depend on
how texts are dealt out.

Edge cases: null text is empty; an empty text is its end token; repeated rows count and are scored as
often as they occur; with no training rows every token is unknown (V = N = 0); an empty table gives
no rows; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTES_LOWER, cleaned, shared_root

DEPTH = 3
#: Next-symbol entries have this count at least.
LEAST = 2
#: And this relative frequency among all tokens: none, the tree is that of the whole corpus.
JOINT = 0.0
#: Weight of the parent's distribution, in occurrences.
KAPPA = 2.0
#: Tokens of a block, or one text.
BLOCK = 1_500_000
#: Tokens a bucket; a round asks for fewer distinct sequences than there are tokens.
BUCKET = 2_500_000
#: Of a nat: unit of gains.
UNIT = 1 << 20

END = b" "  # no word has a space


class Ids(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def digests(words) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


def numbered(ids: Ids, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts as numbers, and the length of each text."""
    get, flat, lengths = ids.__getitem__, [], np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "replace").translate(BYTES_LOWER).split() if text else []  # at space and the controls 9 to 13, as bytes are
        words.append(END)
        lengths[i] = len(words)
        flat.append(np.fromiter(map(get, words), dtype=np.int64, count=len(words)))
    return np.concatenate(flat), lengths


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as columns of bytes, compressed."""
    planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    cols = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return len(x).to_bytes(7, "little") + bytes([planes]) + (pa.Codec("zstd", compression_level=1).compress(cols, asbytes=True) if planes else b"")


def unpack(b: bytes) -> np.ndarray:
    n, planes = int.from_bytes(b[:7], "little"), b[7]
    out = np.zeros((n, 8), dtype=np.uint8)
    if planes:
        cols = pa.Codec("zstd").decompress(b[8:], decompressed_size=n * planes)
        out[:, :planes] = np.frombuffer(cols, dtype=np.uint8).reshape(planes, n).T
    return out.view("<u8").ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of a sequence from those of the one before its last word and of that word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the rank of each row's, and a row that has each."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    x = np.sort(h & ~low | np.arange(len(h), dtype=np.uint64))  # places fill the low bits: faster than an argsort
    order = (x & low).view(np.int64)
    y = h[order]
    new = np.append(True, y[1:] != y[:-1])[: len(y)]
    if (new[1:] & ((x[1:] ^ x[:-1]) <= low)).any():  # hashes that differ in their low bits alone
        order = np.argsort(h)
        y = h[order]
        new = np.append(True, y[1:] != y[:-1])
    nth = np.empty(len(h), dtype=np.int64)
    nth[order] = np.cumsum(new) - 1
    return y[new], nth, order[new]


TEXTS = "block long, doc_ids array<long>, learn array<boolean>, lengths binary, ids binary, words binary, tokens long, training long"


def numbered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, learn, text -> TEXTS: blocks of whole texts, their words numbered in order of appearance."""

    def row():
        flat, lengths = np.concatenate(parts), np.concatenate(sizes)
        training = int(lengths[np.array(learns, dtype=bool)].sum())
        words = digests(list(ids)).view(np.uint64)
        one = [[block], [doc_ids], [learns], [pack(lengths)], [pack(flat)], [pack(words)], [len(flat)], [training]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds)], names=[c.split()[0] for c in TEXTS.split(", ")])

    block, tokens = TaskContext.get().partitionId() << 32, 0
    ids, parts, sizes, doc_ids, learns = Ids(), [], [], [], []
    for batch in batches:
        for lo in range(0, len(batch), 64):
            some = batch.slice(lo, 64)
            flat, lengths = numbered(ids, some.column(2).to_pylist())
            parts.append(flat.astype(np.uint32))
            sizes.append(lengths)
            doc_ids += some.column(0).to_pylist()
            learns += some.column(1).to_pylist()
            tokens += len(flat)
            if tokens >= BLOCK:
                yield row()
                block, tokens = block + 1, 0
                ids, parts, sizes, doc_ids, learns = Ids(), [], [], [], []
    if tokens:
        yield row()


def kept_gain(gain: np.ndarray, c: np.ndarray, given: np.ndarray, sizes: np.ndarray, tokens: int) -> np.ndarray:
    """Whether contexts are states.  ``gain``: n * log(n / (c * p)), p by the parent, over the ``sizes`` entries of a context that
    occurs c times, ``given`` times with one of them; the other symbols together lose by it."""
    left = np.maximum(c - given, 0).astype(float)
    gain = gain + left * np.log(np.where(left > 0, left / np.maximum(c, 1), 1.0))
    return gain > 0.5 * np.log(max(tokens, 2)) * sizes


def replayed(row: dict, answers: list, tokens: int, vocabulary: int, need: float):
    """What a block asks next, after the ``answers`` of the rounds before: {kind: (hashes in order, columns of whole numbers)};
    after the last round, the texts' (lengths, n_known, base_score, score).

    Round r asks for counts of sequences of r + 1 words (kind 2 r) and for the states among contexts of r - 1 words (kind 2 r - 1)."""
    w, lengths, hashes = unpack(row["ids"]).astype(np.int64), unpack(row["lengths"]).astype(np.int64), [unpack(row["words"])]
    first = np.cumsum(lengths) - lengths
    train = np.repeat(np.array(row["learn"], dtype=bool), lengths)
    begins = np.zeros(len(w) + 1, dtype=bool)
    begins[first] = begins[-1] = True
    at, nth, whole = None, w, w  # places of the sequences of r + 1 words and their numbers there; by place, -1 where there is none
    of, contexts, total, owner = None, None, [], []
    p = alive = base = None
    for r in range(DEPTH + 2):
        asks, last = {}, r == len(answers)
        asked, contexts, whole_was, of_was, at_was, nth_was = contexts, None, whole, of, at, nth
        if 0 < r <= DEPTH + 1:  # the sequences of r words that are frequent enough; they are contexts of the words after them
            often = total[r - 1][nth] >= need
            pos, same = (np.flatnonzero(often), nth[often]) if at is None else (at[often], nth[often])
            ok = ~begins[pos + 1]
            contexts = pos[ok] + 1, same[ok]
        if 0 < r <= DEPTH:  # number the sequences of r + 1 words
            j = np.flatnonzero((pos[1:] == pos[:-1] + 1) & ~begins[pos[1:]])
            at = pos[j + 1]
            here, nth, one = ranked(mixed(hashes[r - 1][same[j]], hashes[0][w[at]]))
            hashes.append(here)
            of = same[j[one]]
            whole = np.full(len(w), -1, dtype=np.int64)
            whole[at] = nth
        if r <= DEPTH:
            order = slice(None) if r else np.argsort(hashes[0])
            if last:
                asks[2 * r] = hashes[r][order], [np.bincount(nth[train if at is None else train[at]], minlength=len(hashes[r]))[order]]
        if r > 1:  # contexts of d words
            d = r - 1
            place, c = asked
            if alive is not None:
                some = alive[place]
                place, c = place[some], c[some]
            used = np.zeros(len(hashes[d - 1]), dtype=bool)
            used[c] = True
            used = np.flatnonzero(used)
            used = used if d > 1 else used[np.argsort(hashes[0][used])]
            if last:
                given, sizes, gain = (np.zeros(len(hashes[d - 1]), dtype=np.int64) for _ in range(3))
                alive = np.zeros(len(w), dtype=bool)
                alive[place] = True
                some = alive[at_was]
                p_of, mine = np.ones(len(of_was)), np.zeros(len(of_was), dtype=bool)
                p_of[nth_was[some]] = p[at_was[some]]
                mine[nth_was[some]] = True
                e = np.flatnonzero(mine & owner[d])
                if len(e):
                    e = e[np.argsort(of_was[e])]
                    n, k = total[d][e], of_was[e]  # k in order
                    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                    worth = np.rint(n * np.log(n / (total[d - 1][k] * p_of[e])) * UNIT).astype(np.int64)
                    k = k[head]
                    given[k], sizes[k], gain[k] = np.add.reduceat(n, head), np.diff(np.append(head, len(e))), np.add.reduceat(worth, head)
                count = np.where(sizes > 0, total[d - 1], 0)
                asks[2 * r - 1] = hashes[d - 1][used], [x[used] for x in (given, sizes, gain << 1 ^ gain >> 63, count)]
        if last:
            return asks
        got = answers[r]
        if r <= DEPTH:
            back = np.zeros(len(hashes[r]), dtype=np.int64)
            back[order] = got.get(2 * r, np.zeros(0, dtype=np.uint64)).view(np.int64)
            total.append(back >> 1)
            owner.append((back & 1) == 1)
        if r == 0:
            base = (total[0] + 0.5) / (tokens + 0.5 * (vocabulary + 1))  # by word
            p = base[w]
        if r > 1:
            given = np.zeros(len(hashes[d - 1]), dtype=np.int64)
            given[used] = got.get(2 * r - 1, np.zeros(0, dtype=np.uint64)).view(np.int64)
            some = given[c] > 0
            place, k = place[some], c[some]
            alive = np.zeros(len(w), dtype=bool)
            alive[place] = True
            n = np.append(np.where(total[d] < need, 0, total[d]), 0)[whole_was[place]]
            p[place] = (n + (KAPPA + total[d - 1][k] - given[k]) * p[place]) / (total[d - 1][k] + KAPPA)
    return lengths, *(np.add.reduceat(x, first) for x in ((total[0] > 0).astype(np.int64)[w], np.log10(base)[w], np.log10(p)))


def blocks_with(folder: str, rounds: int):
    """Batches of TEXTS -> (a block's row, its answers of so many rounds)."""
    fs, path = pafs.FileSystem.from_uri(folder)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                answers = []
                for r in range(rounds):
                    kinds: dict = {}
                    own = f"{path}/answers{r}/block={row['block']}"
                    if fs.get_file_info(own).type != pafs.FileType.NotFound:  # a round may have no questions for a block
                        for x in sorted(pads.dataset(own, filesystem=fs, format="parquet").to_table(["kind", "bucket", "answer"]).to_pylist(), key=lambda x: (x["kind"], x["bucket"])):
                            kinds.setdefault(x["kind"], []).append(unpack(x["answer"]))
                    answers.append({k: np.concatenate(v) for k, v in kinds.items()})
                yield row, answers

    return rows


QUESTIONS = "kind int, bucket int, block long, hashes binary, numbers array<binary>"
ANSWERS = "kind int, bucket int, block long, answer binary, found long"


def questions(folder: str, rounds: int, buckets: int, tokens: int, vocabulary: int, need: float):
    """TEXTS -> QUESTIONS of the next round."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in blocks_with(folder, rounds)(batches):
            for kind, (hashes, columns) in replayed(row, answers, tokens, vocabulary, need).items():
                cuts = [0, *np.searchsorted(hashes, edges), len(hashes)]
                some = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
                out = [
                    pa.array([kind] * len(some), pa.int32()), pa.array([b for b, _, _ in some], pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                    pa.array([pack(np.diff(hashes[lo:hi], prepend=np.uint64(0))) for _, lo, hi in some], pa.binary()), pa.array([[pack(c[lo:hi]) for c in columns] for _, lo, hi in some], pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(out, names=["kind", "bucket", "block", "hashes", "numbers"])

    return ask


def answered(tokens: int, need: float):
    """The QUESTIONS of one kind and bucket -> ANSWERS.  A count's answer is twice the count, and 1 for its owner, 0 below ``need`` (words: 1);
    that of a context is how often one of its entries follows it, 0 for those that are no states."""

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        table = table.sort_by("block")
        parts = [np.cumsum(unpack(h), dtype=np.uint64) for h in table["hashes"].to_pylist()]
        columns = [np.concatenate([unpack(x) for x in c]).view(np.int64) for c in zip(*table["numbers"].to_pylist())]
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")  # runs in order are merged
        h = h[order]
        new = np.append(True, h[1:] != h[:-1])
        starts, nth = np.flatnonzero(new), np.cumsum(new) - 1
        columns = [c[order] for c in columns]
        if kind % 2 == 0:
            n = np.add.reduceat(columns[0], starts)
            found = int((n > 0).sum())
            known = np.flatnonzero(columns[0] > 0)
            first = known[np.append(True, nth[known][1:] != nth[known][:-1])[: len(known)]]
            out = n[nth] << 1
            out[first] |= 1
            out[(n < (need if kind else 1))[nth]] = 0
        else:
            found = 0
            given, sizes, gain = (np.add.reduceat(x, starts) for x in (columns[0], columns[1], columns[2] >> 1 ^ -(columns[2] & 1)))
            out = np.where(kept_gain(gain / UNIT, np.maximum.reduceat(columns[3], starts), given, sizes, tokens), given, 0)[nth]
        back = np.empty(len(out), dtype=np.int64)
        back[order] = out
        ends = np.cumsum([len(x) for x in parts])
        rows = [pack(back[hi - len(x) : hi]) for x, hi in zip(parts, ends)]
        same = [pa.array([x] * len(rows), pa.int32()) for x in (kind, bucket)]
        return pa.Table.from_arrays([*same, table["block"], pa.array(rows, pa.binary()), pa.array([found] + [0] * (len(rows) - 1), pa.int64())], names=["kind", "bucket", "block", "answer", "found"])

    return answer


def scored(folder: str, tokens: int, vocabulary: int, need: float):
    """TEXTS -> the result's rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, answers in blocks_with(folder, DEPTH + 2)(batches):
            lengths, known, base, full = replayed(row, answers, tokens, vocabulary, need)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([not x for x in row["learn"]]), pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), tokens, dtype=np.int64)), pa.array(base), pa.array(full)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return score


class Tree:
    """The same tree in one place, for tables of fewer than 2**16 words: what blocks and buckets are held against.

    States by depth: sorted context keys, their totals, the weight of the parent; entries (context, symbol) with counts."""

    def __init__(self, rows: np.ndarray, unigram: np.ndarray, tokens: int, base):
        """``rows``: depth, context, symbol, n; ``unigram``: counts of words by number, from 1; ``base``: probability of counts."""
        self.levels = []
        total = {1: unigram}
        parents = None
        for d in range(1, DEPTH + 1):
            own = rows[rows["depth"] == d]
            ctx, sym, n = own["context"].view(np.uint64), own["symbol"].astype(np.int64), own["n"].astype(float)
            order = np.lexsort((sym, ctx))
            ctx, sym, n = ctx[order], sym[order], n[order]
            state, first = np.unique(ctx, return_index=True) if len(ctx) else (ctx, np.zeros(0, dtype=int))
            sizes = np.diff(np.append(first, len(ctx)))
            entry = np.repeat(np.arange(len(state)), sizes)
            given = np.add.reduceat(n, first) if len(ctx) else np.zeros(0)
            if d == 1:
                c = unigram[state.astype(np.int64)].astype(float)
                p = base(unigram[sym])
            else:
                # occurrences of the context: the entry of its words in the level above
                c = self.find_entry(d - 1, (state >> np.uint64(16)), (state & np.uint64(0xFFFF)).astype(np.int64))
                p = self.probability(d - 1, ctx & np.uint64((1 << 16 * (d - 1)) - 1), sym, base(unigram[sym]))
            c = np.maximum(c, given)
            weight = KAPPA + c - given
            gain = np.add.reduceat(n * np.log(n / (c[entry] * p)), first) if len(ctx) else np.zeros(0)
            keep = kept_gain(gain, c, given, sizes, tokens)
            if parents is not None:  # a state's parent is a state
                keep &= np.isin(state & np.uint64((1 << 16 * (d - 1)) - 1), parents)
            parents = state[keep]
            kept = keep[entry] if len(entry) else np.zeros(0, dtype=bool)
            self.levels.append((state[keep], weight[keep], c[keep] + KAPPA, (ctx[kept], sym[kept].astype(np.uint16), n[kept])))
            self.all_entries = getattr(self, "all_entries", {}) | {d: (ctx, sym, n)}
        del self.all_entries

    def find_entry(self, d: int, ctx: np.ndarray, sym: np.ndarray) -> np.ndarray:
        return lookup(*self.all_entries[d], ctx, sym)

    def probability(self, depth: int, key: np.ndarray, sym: np.ndarray, p: np.ndarray, ok=None) -> np.ndarray:
        """Of symbols after contexts, from the states of depth 1 to ``depth``; ``p``: at the root; ``ok``: by depth, where there is a context."""
        alive = np.ones(len(key), dtype=bool)
        for d, (state, weight, total, entries) in enumerate(self.levels[:depth], 1):
            own = key & np.uint64((1 << 16 * d) - 1) if d < 4 else key
            alive = alive & (ok[d - 1] if ok is not None else True)
            at = np.flatnonzero(alive)
            if not len(state) or not len(at):
                return p
            i = np.minimum(np.searchsorted(state, own[at]), len(state) - 1)
            hit = state[i] == own[at]
            alive[at[~hit]] = False
            at, i = at[hit], i[hit]
            n = lookup(*entries, own[at], sym[at])
            p = p.copy()
            p[at] = (n + weight[i] * p[at]) / total[i]
        return p


def lookup(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Counts of (c, s) among entries in order; 0 where there is none.  Context keys have 48 bits."""
    if not len(ctx):
        return np.zeros(len(c))
    keys = ctx << np.uint64(16) | sym.astype(np.uint64)
    want = c << np.uint64(16) | s.astype(np.uint64)
    i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where((keys[i] == want) & (s > 0), n[i], 0.0)


def score_texts(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text, learn (boolean).  A row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    root = shared_root(spark)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("learn", F.lit(False)).alias("learn"), "text"]
    docs.select(*columns).mapInArrow(numbered_blocks, TEXTS).write.option("parquet.block.size", 16 << 20).parquet(f"{root}/texts")
    texts = spark.read.schema(TEXTS).parquet(f"{root}/texts")
    every, tokens = texts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("training"), F.lit(0))).first()
    buckets, need, vocabulary = -(-every // BUCKET) or 1, max(LEAST, JOINT * tokens), 0
    for r in range(DEPTH + 2):
        asked = texts.mapInArrow(questions(root, r, buckets, tokens, vocabulary, need), QUESTIONS)
        answers = asked.groupBy("kind", "bucket").applyInArrow(answered(tokens, need), ANSWERS)
        with cleaned(spark):
            answers.repartition("block").write.partitionBy("block").parquet(f"{root}/answers{r}")
        if r == 0:
            vocabulary = spark.read.schema(ANSWERS).parquet(f"{root}/answers0").agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    return texts.mapInArrow(scored(root, tokens, vocabulary, need), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 != 1).alias("learn")))
