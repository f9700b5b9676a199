"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.llm import html_text, line_dedup, media, mixing, ngram_join, packing, quality, substring_dedup, suffix_tree, syncmers, words
from quillsift.llm.common import staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string"


def long_text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 500, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, clashing extra column names."""
    base = long_text(1, 120)
    near = base.replace(" w", " W", 3) + " tail"
    texts = {
        1: base, 2: None, 3: "", 4: "   \n\t ", 5: base, 6: near, 7: "one", 8: "two words", 9: "ÉTÉ été Straße 😀 x", 10: long_text(2, 30_000), 11: long_text(3, 60) + "\n" + base, 12: "a\nb\n" + long_text(4, 40) + "\n" + long_text(4, 40),
        13: "the cat sat on the mat today\nThe cat sat on the mat today", 14: "x " * 200, 15: long_text(5, 25),
    }
    out = [(i, t, "en", None if i == 8 else f"s{i % 3}", len(t or ""), "extra") for i, t in texts.items()]
    return [*out, out[0], out[6], (None, long_text(6, 50), None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return staged(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \n\t\x00", max_size=20)), max_size=6))
def test_hashed_words(texts):
    h = words.Hashed(pa.array(texts, pa.string()), wide=True)
    seen = {}
    for i, t in enumerate(texts):
        own = WORD.findall((t or "").translate(LOWER))
        assert h.starts[i + 1] - h.starts[i] == len(own)
        for w, x in zip(own, h.hashes[h.starts[i] :]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_driver_heap_is_given_back(spark, monkeypatch):
    """After each staged write garbage is collected, on a cluster, where the driver's heap is more than half of what it may be."""
    from types import SimpleNamespace as Some

    from quillsift.llm import common

    done, collected = [], common.collected
    for local, total, want in ((False, 600, 1), (False, 300, 0), (True, 600, 0)):
        heap = Some(totalMemory=lambda n=total: n, maxMemory=lambda: 750)
        java = Some(lang=Some(Runtime=Some(getRuntime=lambda h=heap: h), System=Some(gc=lambda: done.append(1))))
        collected(Some(_jvm=Some(java=java), _jsc=Some(sc=lambda x=local: Some(isLocal=lambda: x))))
        assert len(done) == want
        done.clear()
    collected(spark)
    monkeypatch.setattr(common, "collected", done.append)
    assert common.staged(spark.range(3)).count() == 3 and len(done) == 1


# ---------------------------------------------------------------- 1: suffix tree


def test_suffix_tree(spark, docs, none, rows):
    learn = docs.withColumn("learn", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False)))
    got = suffix_tree.score_texts(learn).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), " "]
    own = [(r[0], tokens(r[1])) for r in rows]
    counts = Counter(w for i, ts in own if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in ts)
    n, v = sum(counts.values()), len(counts)
    expect = Counter((i, len(ts), sum(w in counts for w in ts), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 6)) for i, ts in own)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expect
    assert {r.train_tokens for r in got} == {n}
    assert suffix_tree.score_texts(none.withColumn("learn", F.lit(True))).count() == 0


def test_suffix_tree_layout(spark, monkeypatch):
    """Scores are the same however the documents are dealt out, where lossy counts are not."""
    monkeypatch.setattr(suffix_tree, "JOINT", 4e-3)
    g = np.random.default_rng(7)
    d = spark.createDataFrame([(i, " ".join(f"w{j if i < 120 else 39 - j}" for j in g.zipf(1.6, 60) % 40), i % 4 > 0) for i in range(240)], "doc_id long, text string, learn boolean")
    one, many = ({r.doc_id: r.score for r in suffix_tree.score_texts(x).collect()} for x in (d.coalesce(1), d.repartitionByRange(4, "doc_id")))
    assert len(one) == 240 and all(abs(one[i] - many[i]) < 1e-9 for i in one)


def test_suffix_tree_whole(spark, monkeypatch):
    """Scores are those of the tree in one place, over all that occurs twice; a text that was learned twice among many others is told from one learned once."""
    monkeypatch.setattr(suffix_tree, "BLOCK", 3_000, raising=False)
    monkeypatch.setattr(suffix_tree, "BUCKET", 5_000, raising=False)
    g = np.random.default_rng(8)
    texts = [" ".join(f"w{j}" for j in g.zipf(1.3, 50) % 3000) for _ in range(400)]
    for k in range(200, 400):  # words that follow from three before
        ws = list(g.integers(0, 6, 3))
        while len(ws) < 60:
            ws.append((ws[-1] * 3 + ws[-2] * 5 + ws[-3] * ws[-1]) % 6 if g.random() < 0.9 else g.integers(0, 6))
        texts[k] = " ".join(f"v{j}" for j in ws)
    rare = [" ".join(f"r{i}x{j}" for j in range(30)) for i in range(20)]
    rows = [(i, t, i % 4 > 0) for i, t in enumerate(texts)] + [(1000 + i, t, True) for i, t in enumerate(rare)] + [(2000 + i, t, True) for i, t in enumerate(rare[:10])]
    got = {r.doc_id: r for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)).collect()}
    own = [([*t.split(" "), " "], learn) for _, t, learn in rows]
    counts = Counter(w for ws, learn in own if learn for w in ws)
    number = {w: i for i, w in enumerate(counts, 1)}
    unigram = np.array([0, *counts.values()])
    tokens, base = sum(counts.values()), lambda c: (c + 0.5) / (sum(counts.values()) + 0.5 * (len(counts) + 1))
    found = Counter((d, sum(number[ws[i - 1 - j]] << (16 * j) for j in range(d)), number[ws[i]]) for ws, learn in own if learn for d in range(1, 4) for i in range(d, len(ws)))
    table = np.array([(*k, n) for k, n in found.items() if n >= 2], dtype=[("depth", "i4"), ("context", "i8"), ("symbol", "i4"), ("n", "i8")])
    tree = suffix_tree.Tree(table, unigram, tokens, base)
    assert all(len(level[0]) for level in tree.levels)
    for (i, _, _), (ws, _) in zip(rows, own):
        sym = np.array([number.get(w, 0) for w in ws])
        keys, ok = np.zeros(len(ws), dtype=np.uint64), []
        for d in range(1, 4):
            back = np.append(np.zeros(min(d, len(ws)), dtype=np.int64), sym[:-d])
            ok.append((back > 0) & (ok[-1] if ok else True))
            keys |= back.astype(np.uint64) << np.uint64(16 * (d - 1))
        assert got[i].score == pytest.approx(np.log10(tree.probability(3, keys, sym, base(unigram[sym]), ok)).sum(), abs=1e-6)
    apart = [got[1000 + i].score - got[1000 + i].base_score for i in range(20)]
    assert min(apart[:10]) > max(apart[10:]) + 20


def test_suffix_tree_ranks():
    """Ranks of hashes by a sort with the places in their low bits; hashes that differ there alone are still told apart."""
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 5000):
        for most, shift in ((1 << 63, 0), (5, 0), (3, 61)):
            h = rng.integers(0, most, n, dtype=np.uint64) << np.uint64(shift)
            got, nth, one = suffix_tree.ranked(h)
            want, at = np.unique(h, return_inverse=True)
            assert got.tolist() == want.tolist() and nth.tolist() == at.tolist() and h[one].tolist() == want.tolist()


def test_suffix_tree_predicts(spark, real):
    got = suffix_tree.score_texts(real.withColumn("learn", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_distributions_sum_to_one():
    rng = np.random.default_rng(0)
    seq = rng.choice(5, 4000, p=[0.4, 0.3, 0.2, 0.05, 0.05]) + 1
    seq[1::2] = (seq[::2] % 5) + 1  # every second symbol follows from the first
    unigram = np.bincount(seq, minlength=6)
    found = Counter()
    for d in range(1, suffix_tree.DEPTH + 1):
        for i in range(d, len(seq)):
            key = sum(int(seq[i - 1 - j]) << (16 * j) for j in range(d))
            found[d, key, int(seq[i])] += 1
    table = np.array([(*k, n) for k, n in found.items()], dtype=[("depth", "i4"), ("context", "i8"), ("symbol", "i4"), ("n", "i8")])
    base = lambda c: (c + 0.5) / (len(seq) + 0.5 * 6)
    tree = suffix_tree.Tree(table, unigram, len(seq), base)
    assert len(tree.levels[0][0])
    for context in (1, 3 | 2 << 16, 1 | 2 << 16 | 4 << 32):
        every = np.append(np.arange(1, 6), 0)  # the unknown symbol too
        p = tree.probability(suffix_tree.DEPTH, np.full(6, context, dtype=np.uint64), every, base(np.append(unigram[1:], 0)))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


# ---------------------------------------------------------------- 2: packing


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = packing.public_tokenizer("word_bpe_49k.json")
    got = packing.pack(docs, path, 64).collect()
    check_packed(got, 64)
    tool, expect = Tokenizer.from_file(path), Counter()
    for r in rows:
        ids = [*tool.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 64)):
            piece = np.array(ids[start : start + 64], dtype="<u4").tobytes()
            expect[r[0], n, start, len(piece) // 4, zlib.crc32(piece)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
    assert packing.pack(none, path).count() == 0


def test_packing_keeps_ids(docs):
    r = packing.pack(docs.filter("doc_id = 8"), packing.public_tokenizer("word_bpe_49k.json"), with_ids=True).first()
    assert np.frombuffer(bytes(r.ids), dtype="<u4")[-1] == 0 and len(r.ids) == 4 * r.length


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
def test_histogram_packing(left):
    bins = packing.pack_histogram(left, 40)
    held = Counter()
    for times, filling in bins:
        assert sum(filling) <= 40
        for s in filling:
            held[s] += times
    assert held == Counter({s: n for s, n in left.items()})
    assert sum(t for t, _ in bins) >= packing.lower_bound(left, 40)


def test_branch_and_bound_beats_best_fit():
    assert len(packing.branch([6, 5, 5, 4, 4, 4, 2], 10, 3, 20_000)) == 3
    assert packing.branch([6, 6, 6], 10, 2, 20_000) is None


def test_tokens_are_the_tokenizers():
    tool = packing.Tokens(packing.public_tokenizer("word_bpe_49k.json"))
    texts = ["it's we're İstanbul ΣΑΣ naïve é x\u0085z <|endoftext|>a 12²½ × ª ", "", "\n", "A" * 3000, "!?!...hello-World_1", "don­t"]
    for t, ids in zip(texts, tool.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tool.tool.encode(t, add_special_tokens=False).ids


# ---------------------------------------------------------------- 3: pages


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("plain words", "plain words"),
        ("<html><body><nav><ul><li>Home</ul></nav><article><h1>Head</h1><p>One &amp;\n two<br>three<p>Next</article><footer>&copy; x</footer>", "Head\nOne & two three\nNext"),
        ("<body><div class='cookie-notice'>We use cookies on this site and much more of that</div><main><p>The text itself is here.</p><aside>side</aside><form>f</form><section class='comments'><p>reader says something long</p></section></main>", "The text itself is here."),
        ("<article><header><h1>Kept</h1></header><p>Body</p><script>var t = '</p>';</script></article>", "Kept\nBody"),
        ("<div id=header>top of the page</div><div><p>" + "long text " * 30 + "</p><p>short</p><p>" + "more text " * 30 + "</p></div><div class=sidebar>links links</div>", ("long text " * 30).strip() + "\nshort\n" + ("more text " * 30).strip()),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for r in pages.collect():
        blocks = re.split(r"</?(?:p|h1)>", r.html[r.html.index("<article>") + 9 :].split("</article>")[0])
        clean = (" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in clean if b)
    assert html_text.main_texts(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- 4: n-gram join


def brute_groups(pairs, size, percent):
    sets = []
    for i, t in pairs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets))


def test_ngram_join(docs, none, rows):
    for size, percent in ((4, 85), (5, 80)):
        got = bag(ngram_join.jaccard_groups(docs, size, percent), "doc_id", "n_shingles", "component_id")
        assert got == brute_groups([(r[0], r[1]) for r in rows], size, percent)
    assert ngram_join.jaccard_groups(none).count() == 0


def test_components_of_few_links(spark, monkeypatch):
    """The same as by stars, and without their hundreds of tasks a round."""
    links = spark.createDataFrame(np.random.default_rng(3).integers(-90, 90, (80, 2)).tolist() + [(i, i + 1) for i in range(1000, 1200)], "a long, b long")
    shuffles = spark.sparkContext._jsc.sc().newShuffleId
    before = shuffles()
    few = bag(ngram_join.components(links), "node", "comp")
    assert shuffles() - before < 8
    monkeypatch.setattr(ngram_join, "FEW", 0)
    assert few == bag(ngram_join.components(links), "node", "comp")
    monkeypatch.setattr(ngram_join, "FEW", 50)
    assert ngram_join.components(links.limit(0)).count() == 0


def test_ngram_join_large_group(spark, monkeypatch):
    """More near copies under a first shingle than are held against each other at once."""
    monkeypatch.setattr(ngram_join, "RUN", 4)
    base = long_text(9, 60).split()
    texts = []
    for i in range(40):
        w = list(base)
        w[(7 * i) % 55] = f"changed{i}"
        texts.append((i, " ".join(w)))
    d = spark.createDataFrame([*texts, (99, long_text(10, 60))], "doc_id long, text string")
    got = bag(ngram_join.jaccard_groups(d, 4, 85), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups([*texts, (99, long_text(10, 60))], 4, 85)


def test_one_of_each(docs, rows):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[7] == 1 and not ids[5] and not ids[6] and ids[2] == ids[3] == ids[4] == 1 and ids[10] == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8), st.sets(st.integers(0, 30), min_size=1))
def test_trie_walk(sets, root):
    walk = ngram_join.Walk(np.array(sorted(root), dtype=np.uint64), 60)
    for s in sorted(sorted(x) for x in sets):
        both = len(root & set(s))
        assert walk.similar(np.array(s, dtype=np.uint64)) == (100 * both >= 60 * (len(root) + len(s) - both))


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_sketch_is_a_bound(a, b):
    x, y = (np.frombuffer(ngram_join.sketch(np.array(sorted(s), dtype=np.uint64)), dtype=np.uint64) for s in (a, b))
    size = min(len(x), len(y))
    assert np.bitwise_count(ngram_join.fold(x, size) ^ ngram_join.fold(y, size)).sum() <= len(a ^ b)


def twin_words():
    """Two words that any polynomial hash modulo 2**64 takes for the same: the Thue-Morse sequence and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_only_look_alike(spark):
    x, y = twin_words()
    tail = " ".join(f"t{i}" for i in range(19))
    d = spark.createDataFrame([(1, x), (2, y), (3, f"{x} {tail}"), (4, f"{y} {tail}"), (5, f"{x[:300]} {tail}"), (6, f"{y[:300]} {tail}")], "doc_id long, text string")
    assert bag(ngram_join.jaccard_groups(d.filter("doc_id < 3")), "doc_id", "component_id") == Counter([(1, 1), (2, 2)])
    assert not any(r.n_removed for r in substring_dedup.remove_repeats(d).collect())
    assert {r.text for r in line_dedup.dedup_lines(d.filter("doc_id < 3"), min_words=1).collect()} == {x, y}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=20), min_size=1, max_size=30), st.integers(1, 21))
def test_rolled(ws, size):
    h = words.Hashed(pa.array([" ".join(ws)]), wide=True)
    for which in (0, 1):
        got = h.rolled(size, which)
        assert len(got) == max(0, len(ws) - size + 1)
        same = {}
        for i, x in enumerate(got.tolist()):
            assert same.setdefault(tuple(ws[i : i + size]), x) == x
        assert len(set(same.values())) == len(same)
        if len(ws) >= size:
            assert words.roll((h.more if which else h.hashes)[:size], size, which)[0] == got[0]


def test_sets_with_the_same_key(docs, rows, monkeypatch):
    """The other 64 bits tell sets apart that share the first ones."""
    keys = ngram_join.set_keys
    monkeypatch.setattr(ngram_join, "set_keys", lambda t: (keys(t)[0] % 3, keys(t)[1]) if len(t) else (0, 0))
    assert len({ngram_join.set_key(np.array([i], dtype=np.uint64), frozenset(range(3))) for i in range(50)}) == 50


# ---------------------------------------------------------------- 5: substrings


def brute_repeats(pairs):
    seen, out = set(), []
    for i, t in pairs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substrings(docs, none, rows, batches):
    order = sorted({(r[0] if r[0] is not None else -1, r[1]) for r in rows}, key=lambda x: x[0])
    expect = {(None if i == -1 else i): x for (i, _), x in zip(order, brute_repeats(order))}
    got = substring_dedup.remove_repeats(docs, batches).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == expect[r.doc_id][1:]
    assert substring_dedup.remove_repeats(none).count() == 0


def test_index_opens_again(spark, real):
    """A later batch meets the runs that an index left behind, compacted or not."""
    expect = {x[0]: x[2] for x in brute_repeats(sorted((r.doc_id, r.text) for r in real.collect()))}
    docs = real.select("doc_id", F.lit(0).cast("long").alias("h"), "text")
    cuts = [-1, *(int(c) for c in docs.approxQuantile("doc_id", [0.2, 0.4, 0.6, 0.8], 0)), 10**9]
    root, gone = substring_dedup.shared_root(spark), set()
    for lo, hi in zip(cuts, cuts[1:]):
        index = substring_dedup.FingerprintIndex(spark, root)
        where = (F.col("doc_id") > lo) & (F.col("doc_id") <= hi)
        out = substring_dedup.repeated_windows(docs.filter(F.col("doc_id") <= hi), index, docs.filter(where), where)
        gone |= {r.doc_id for r in out.collect()}
        index.close()
        assert all(len(names) <= substring_dedup.MAX_RUNS + 1 for names in index.names.values())
    assert gone == {i for i, n in expect.items() if n}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_many_batches(spark, real, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 2)
    expect = {x[0]: x[1:] for x in brute_repeats(sorted((r.doc_id, r.text) for r in real.collect()))}
    got = substring_dedup.remove_repeats(real, 5, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expect
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_index_compacts(spark, real, monkeypatch):
    compacted = []
    write = substring_dedup.FingerprintIndex.write
    monkeypatch.setattr(substring_dedup.FingerprintIndex, "write", lambda self, kind, rows: compacted.append((kind, len(self.names[kind]))) or write(self, kind, rows))
    substring_dedup.remove_repeats(real).count()
    assert ("runs", 3) in compacted
    monkeypatch.undo()
    expect = {x[0]: x[1:] for x in brute_repeats(sorted((r.doc_id, r.text) for r in real.collect()))}
    got = substring_dedup.remove_repeats(real, 5, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == expect
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


# ---------------------------------------------------------------- 6: fingerprints


def test_syncmers(spark, docs, none, rows):
    got = syncmers.edited_pairs(docs).collect()
    order = sorted(((r[0] if r[0] is not None else syncmers.NO_ID, r[1] or "") for r in rows), key=lambda r: -r[0])
    expect = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        expect[i, len(t), t[: len(t) - half] + nxt[:half]] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited) for r in got) == expect
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.fp) == r.fp and len(r.fp) <= syncmers.WIDTH
    assert syncmers.edited_pairs(none).count() == 0


def test_likeness(spark, real):
    rows = syncmers.op6_syncmers(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    same = real.limit(3).withColumn("fp", syncmers.fingerprint(F.col("text"))).select(syncmers.likeness(F.col("fp"), F.col("fp")).alias("x"))
    assert {r.x for r in same.collect()} == {1.0}


def test_anchors_are_context_free(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, "z z z a b c d e f g h y")], "doc_id long, text string")
    found = {i: {r.anchor: r.position for r in syncmers.anchors(d).filter(f"doc_id = {i}").collect()} for i in (1, 2)}
    shared = set(found[1]) & set(found[2])
    assert shared and {found[2][a] - found[1][a] for a in shared} == {3}


# ---------------------------------------------------------------- 7: lines


def brute_lines(pairs, percent=80, least=5):
    seen, out = [], []
    for i, t in pairs:
        lines, gone = (t or "").split("\n"), set()
        for k, line in enumerate(lines):
            w = set(WORD.findall(line.translate(LOWER)))
            if len(w) >= least:
                if any(100 * len(w & s) >= percent * len(w | s) for s in seen):
                    gone.add(k)
                seen.append(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if t is not None else None, 0 if t is None else len(lines), len(gone)))
    return out


def test_lines(docs, none, rows):
    order = sorted(((r[0] if r[0] is not None else -1, r[1]) for r in rows), key=lambda r: r[0])
    expect = Counter((None if i == -1 else i, *x) for i, *x in brute_lines(order))
    got = line_dedup.dedup_lines(docs, details=True)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert bag(got, "doc_id", "text", "n_lines", "n_removed") == expect
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_documents(spark, real):
    expect = Counter((i, t) for i, t, *_ in brute_lines(sorted((r.doc_id, r.text) for r in real.collect())))
    assert bag(line_dedup.dedup_lines(real), "doc_id", "text") == expect


def test_lines_in_any_order(spark):
    """One task reads the later copies first."""
    words = long_text(7, 30).split()
    x, y = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(100, x), (50, y), (5, x + "\n" + long_text(8, 12)), (3, long_text(9, 20)), (None, long_text(9, 20) + " tail")]
    rng = np.random.default_rng(10)
    rows += [(i, "\n".join(" ".join(f"v{w}" for w in rng.choice(9, rng.integers(5, 9), replace=False)) for _ in range(3))) for i in range(1000, 900, -1)]
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    expect = Counter((i, t) for i, t, *_ in brute_lines(order))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert bag(got, "doc_id", "text") == expect


def test_short_lines(spark, tmp_path):
    """Lines of few distinct words are lines as well, in the query and in the pipeline."""
    import corpus_pipeline

    rows = [
        (1, "All rights reserved.\n\nx x x x x\nfour words of one\nkeep"), (2, "reserved. ALL rights\n\nx\nfour words of one more\nAll rights"),
        (3, "one\ntwo two\n \none"), (4, "All rights reserved.\nfive more words of one four"), (4, "All rights reserved.\nfive more words of one four"), (None, "keep"),
    ]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    expect = brute_lines(order, least=1)
    got = line_dedup.op7_line_dedup(spark, str(tmp_path))
    assert bag(got, "doc_id", "n_lines", "n_removed", "kept_sha256") == Counter((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in expect)
    left = corpus_pipeline.without_repeated_lines(spark, spark.read.parquet(path), str(tmp_path))
    assert bag(left, "doc_id", "text") == Counter((i, t) for i, t, _, gone in expect if not gone or t.strip())


def test_short_lines_of_documents(real):
    expect = Counter((i, t) for i, t, *_ in brute_lines(sorted((r.doc_id, r.text) for r in real.collect()), least=1))
    assert bag(line_dedup.dedup_lines(real, min_words=1), "doc_id", "text") == expect


# ---------------------------------------------------------------- 8: media


def test_media(spark, docs, none, rows):
    index, folder = media.write_shards(docs)
    found = {r.digest: r for r in media.payloads(index, folder).collect()}
    heads = {r.digest: (r.width, r.height, r.bits) for r in media.headers(index, folder).collect()}
    got = Counter()
    for r in index.collect():
        m = found[r.digest]
        assert heads[r.digest] == (64, m.payload_bytes // 64, 8)
        got[r.doc_id, r.n_bytes, m.payload_bytes, m.payload_sha256, m.tail_crc32] += 1
    expect = Counter()
    for r in rows:
        data = (r[1] or "").encode()
        p = data + bytes(-len(data) % 64 or (0 if data else 64))
        expect[r[0], len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == expect
    assert media.write_shards(none)[0].count() == 0


def test_shards_are_tar_files(spark, docs, tmp_path):
    import tarfile

    index, folder = media.write_shards(docs)
    for r in index.select("digest", "shard", "offset", "length").distinct().collect():
        with tarfile.open(f"{folder.removeprefix('file://')}/{r.shard}") as tar:
            member = tar.getmember(f"{r.digest}.png")
            assert (member.offset_data, member.size) == (r.offset, r.length)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=500))
def test_png_round_trip(data):
    assert media.from_png(media.to_png(media.padded(data))) == media.padded(data)


# ---------------------------------------------------------------- 9: quality


def test_quality(spark, real, docs, none, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(real, labels)
    got = real.join(labels, "doc_id").select("quality", quality.scorer(model)(F.col("text")).alias("score")).collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.9 and (not bad or sum(bad) / len(bad) < 0.5)
    edge = {r.doc_id: r.s for r in docs.select("doc_id", quality.scorer(model)(F.col("text")).alias("s")).collect()}
    assert all(0 <= s <= 1 for s in edge.values()) and edge[2] == edge[3]
    assert none.select(quality.scorer(model)(F.col("text"))).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, empty)
    assert model.score("anything") == 0.5
    one = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit(docs, one).score("anything") == pytest.approx(2 / 3)


def test_quality_held_out(spark):
    got = quality.op9_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


# ---------------------------------------------------------------- 10: mixing


def test_mixing(spark, docs, none, rows):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none).count() == 0
    mixed = mixing.sample_mixture(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)


def test_mixture_meets_targets(spark):
    got = mixing.op10_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect():
        assert abs(r.t - r.target) < 0.005 * r.target


def test_target_shares():
    assert mixing.target_shares([10, 10, 10], [5, 2, 1], 1.5, 2) == pytest.approx([20, 16.6666667, 8.3333333])
    assert mixing.target_shares([0, 0], [5, 2], 1.5, 2) == [0, 0]


def test_flow_with_overlapping_sources():
    """Single copies are used up before any is repeated."""
    patterns = [(frozenset("a"), 10.0), (frozenset("ab"), 10.0), (frozenset("b"), 10.0)]
    assert mixing.route(patterns, {"a": 15.0, "b": 15.0}, 2) == pytest.approx([10, 10, 10])
    assert sum(mixing.route(patterns, {"a": 30.0, "b": 5.0}, 2)) == pytest.approx(35)


def test_overlapping_members(spark):
    d = spark.createDataFrame([(i, "w " * 10, "x", ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"]) for i in range(30)], "doc_id long, text string, source string, m array<string>")
    got = mixing.mix(d, weights=(1, 1), share=1.0, members=F.col("m")).collect()
    assert sum(r.taken for r in got) == 300 + 100  # the shared documents count for both sources


def test_lines_long_and_near(spark):
    """Lines about the size where the sketch changes, near the least similarity, and other white space and cases."""
    rng, rows = np.random.default_rng(11), []
    for i in range(120):
        n = int(rng.integers(55, 75))
        base = [f"q{i % 12}x{j}É" if j % 9 == 0 else f"q{i % 12}X{j}" for j in range(n)]
        for _ in range(int(rng.integers(0, n // 4))):
            base[int(rng.integers(0, n))] = f"r{int(rng.integers(0, 10**6))}"
        rows.append((i, "\t".join(base[:20]) + "  " + " ".join(w.lower() if i % 2 and w.isascii() else w for w in base[20:])))
    expect = Counter((i, t) for i, t, *_ in brute_lines(rows))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert bag(got, "doc_id", "text") == expect
    assert 0 < sum(t == "" for _, t in expect) < 120


def test_lines_clashing_names(spark):
    names = ["row", "kept", "lines", "gone", "every", "nth", "h", "id", "n", "a.b", "__kept", "__h"]
    rows = [(1, "one two three four five\nx", *names), (2, "five four three two one", *names)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, ["doc_id", "text", *names]), details=True, drop_emptied=True).collect()
    assert [tuple(r) for r in got] == [(1, rows[0][1], *names, 2, 0)]


def test_lines_lowered_without_patterns(spark):
    """Words of lines with other letters than ASCII: equal where A-Z alone differ, without a regular expression or a table of letters for a line."""
    chars = ["A", "a", "Z", "z", "É", "é", "ß", "×", "÷", "Þ", "þ", "Ж", "ж", "İ", "i", "I", "Σ", "σ", "ς", "\u00c9\u3240", "\u3249", "\u3240", "\u0249", "日", "😀", "\u07ff", "\u0340\u0300", "K"]
    words = sorted({x + y for x in chars for y in ["", *chars]})
    d = spark.createDataFrame([(i, w + " é") for i, w in enumerate(words)], "i long, line string")
    out = d.select("i", line_dedup.lowered(F.col("line")).alias("x"))
    found = {r.i: r.x for r in out.collect()}
    groups = lambda key: sorted(sorted(g) for g in _grouped(range(len(words)), key).values())
    assert groups(found.get) == groups(lambda i: words[i].translate(LOWER))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and "translate" not in plan


def test_first_lines_work_once(spark):
    """Lines that differ by case alone are one class, words are made distinct outside of interpreted functions, and a pair has to
    pass under its first shared word: under a later one alone, with too few words from there on, it does not."""
    d = spark.createDataFrame([(1, 0, "A b\tC\nx"), (2, 0, "a B c"), (3, 0, "a b c É"), (4, 0, "A b C É")], "doc_id long, h long, text string")
    first = line_dedup.first_lines(d, 80, 1)
    assert {(r.doc_id, r.line, r.n) for r in first.collect()} == {(1, 0, 3), (1, 1, 1), (3, 0, 4)}
    assert "transform(array_" not in first._jdf.queryExecution().optimizedPlan().toString().lower()
    row = "1L AS word, 20 AS n, 0L AS s, 0L AS z"
    passes = lambda a, b: spark.sql(f"SELECT * FROM (SELECT {row}, {a} AS pos) a JOIN (SELECT {row}, {b} AS pos) b ON {line_dedup.PASSES.format(p=80)}").count()
    assert [passes(0, 0), passes(2, 2), passes(0, 2), passes(3, 3)] == [1, 1, 1, 0]  # 18 words of 20 shared are enough, 17 are not


def test_levels_in_place(spark):
    """A word's level stands above the hash already, in a primitive array."""
    d = spark.createDataFrame([("a a a\na a b",), ("b a",), ("b",), ("b",)], "text string")
    slots = spark.sql("SELECT int(xxhash64('a') & 65535) AS a, int(xxhash64('b') & 65535) AS b").first()
    found = d.limit(1).select(line_dedup.levels(d).alias("x")).first().x
    assert (found[slots.a], found[slots.b]) == (6 << 56, 5 << 56) and sum(x > 0 for x in found) == 2


def _grouped(items, key) -> dict:
    out = {}
    for x in items:
        out.setdefault(key(x), []).append(x)
    return out
