"""Order MinHash, ranked search and fill-in-middle, each against a brute-force version."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, frame, prose
from tidewire.llm import fill_middle as fim
from tidewire.llm import order_minhash as omh
from tidewire.llm import search

MORE = [(900, "a <P> b", "s"), (901, "ends in <", "s"), (902, "<S", "s"), (903, "x<M>", "s"), (904, "word " * 40_000 + "é" * 70_000 + "z" * 120_000, "s"), (905, "𝒳y\x00\r\n   zé", "s")]
ROWS = documents() + MORE


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(a, b):
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


# 13 fill-in-middle


def brute_middle(id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(tokens), sha(f"1:{'' if id is None else id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle(docs):
    out = fim.fill_middle(docs)
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    same([(r["doc_id"], *r[1:6], r["back"]) for r in got], [(i, *brute_middle(i, t), t or "") for i, t, _ in ROWS])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_middle(docs.limit(0)).count() == 0


def test_offsets_of_pieces_in_stretches(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  é.\n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", " ", "  ", "a" * 40, "é" * 40, "a.b " * 10]
    for at_once, kept in ((1, 0), (3, 2), (1000, 64)):
        monkeypatch.setattr(fim, "AT_ONCE", at_once)
        monkeypatch.setattr(fim, "KEPT", kept)
        monkeypatch.setattr(fim, "REMEMBERED", 3)
        o = fim.Offsets()
        for t in texts:
            starts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t)] + [len(t)]
            assert o.cuts(t, lambda n: range(n + 1)) == (len(starts) - 1, starts)


def test_fill_middle_rates(spark):
    rows = [(i, "some words to cut", "s") for i in range(400)]
    assert {r["form"] for r in fim.fill_middle(frame(spark, rows), rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_middle(frame(spark, rows), rate=100, suffix_first=100).collect()} == {"spm"}
    one, two = ([r["output"] for r in fim.fill_middle(frame(spark, rows), seed=s).orderBy("doc_id").collect()] for s in (1, 2))
    assert one != two


# 12 ranked search


ITEMS = [(1, "The quick brown fox"), (2, "the of and THE"), (3, None), (4, ""), (5, "no-such-term-here qqqq"), (None, "and of"), (1, "more terms of one"), (6, "é café naïve 42 x1"), (7, "same line here again")]


def brute_terms(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute_search(rows, items, k=10):
    counts = [(i, Counter(w), len(w)) for i, t, _ in rows if (w := brute_terms(t))]
    n_docs, total = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(brute_terms(t))
    out = []
    for item, found in asked.items():
        scores = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in found if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("held, k", [(32_000_000, 10), (0, 10), (32_000_000, 3)])
def test_ranked_search(spark, docs, monkeypatch, held, k):
    monkeypatch.setattr(search, "BROADCAST_BYTES", held)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = search.ranked(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same([tuple(r) for r in got.collect()], brute_search(ROWS, ITEMS, k))


def test_ranked_search_of_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(docs.where("text IS NULL OR text = ''"), items).count() == 0


def test_an_index_serves_other_items(spark, docs):
    index = search.postings(docs)
    for some in (ITEMS[:2], ITEMS[7:]):
        asked = search.item_terms(spark.createDataFrame(some, "item_id long, text string"))
        same([tuple(r) for r in search.search(index, asked).collect()], brute_search(ROWS, some))


# 11 order MinHash


LOW = (1 << 64) - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & LOW
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & LOW
    return x ^ (x >> 31)


def brute_sketch(text):
    """By its definition, with plain numbers: each slot sorts all elements by turn and value."""
    r, k, n = int(omh._R), omh.K, len(text)
    if not n:
        return [0] * omh.SLOTS
    h = [(sum(ord(c) * pow(r, i + 1, 1 << 64) for i, c in enumerate(text)) + n) & LOW] if n < k else [sum(ord(c) * pow(r, k - 1 - j, 1 << 64) for j, c in enumerate(text[i : i + k])) & LOW for i in range(n - k + 1)]
    seen, elements = Counter(), []
    for x in h:
        elements.append(mixed((x + seen[x] * int(omh._AGAIN)) & LOW))
        seen[x] += 1
    lists = [[] for _ in range(omh.SLOTS)]
    for turn in range(2 * omh.SLOTS):
        for i, x in enumerate(elements):
            p = mixed((x + turn * int(omh._TURN)) & LOW) if turn else x
            lists[p >> 58 if turn < omh.SLOTS else turn - omh.SLOTS].append((turn, p & ((1 << 51) - 1), i))
    out = []
    for offered in lists:
        got = []
        for _, _, i in sorted(offered):
            if i not in got:
                got.append(i)
            if len(got) == omh.EACH:
                break
        t = 0
        for i in sorted(got):
            t = mixed((t * r + h[i] + 1) & LOW)
        out.append(max(t >> 32, 1))
    return out


@pytest.mark.parametrize("letters", ["ab é𝒳", "x", "abcdefghijklmnopqrst"])
def test_sketch_is_as_defined(letters):
    rng = random.Random(8)
    for n in (0, 1, 2, 7, 8, 9, 10, 20, 60, 300, 706, 707, 720, 1500):
        t = "".join(rng.choice(letters) for _ in range(n))
        assert omh.sketch(t).tolist() == brute_sketch(t), n


def test_fingerprints_tell_order_and_edits():
    rng = random.Random(6)
    like = lambda a, b: float(np.mean(omh.sketch(a) == omh.sketch(b)))
    moved, edits, apart = [], [], []
    for _ in range(30):
        words = prose(rng, 200).split(" ")
        t = " ".join(words)
        turned = " ".join(words[100:] + words[:100])
        blocks = [words[i : i + 5] for i in range(0, 200, 5)]
        rng.shuffle(blocks)
        moved.append(like(t, " ".join(w for b in blocks for w in b)))
        edits.append([like(t, t[:n] + "?" + t[n + 1 :]) for n in (10, 500)] + [like(t, turned)])
        apart.append(like(t, prose(rng, 200)))
    near, half = np.mean([e[:2] for e in edits]), np.mean([e[2] for e in edits])
    # Few k-mers are lost by any of these; shuffled blocks keep half of the pairs in order.
    assert near > 0.9 and 0.3 < half < 0.8 and np.mean(moved) < 0.6 and np.mean(apart) < 0.02


def brute_edits(rows):
    signed = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0)
    rows = sorted(((i is not None, i or 0, signed(t or ""), i, t or "") for i, t, _ in rows), key=lambda r: r[:3], reverse=True)
    out = []
    for k, (*_, i, t) in enumerate(rows):
        then = rows[(k + 1) % len(rows)][4]
        new = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
        a, b, c = omh.sketch(t), omh.sketch(new), omh.sketch(then)
        out.append((i, len(t), sha(new), omh.written(a), omh.written(b), float(np.mean(a == b)), float(np.mean(a == c))))
    return out


@pytest.mark.parametrize("blocks", [1, 40])
def test_order_minhash(docs, monkeypatch, blocks):
    monkeypatch.setattr(omh, "BLOCKS", blocks)
    out = omh.with_edits(docs)
    rows = [tuple(r) for r in out.collect()]
    same(rows, brute_edits(ROWS))
    got = out.select(omh.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("a"), "near_edited").collect()
    assert all(r["a"] == r["near_edited"] for r in got)


def test_order_minhash_of_few_rows(spark, docs):
    assert omh.with_edits(docs.limit(0)).count() == 0
    one = [(1, "abcdefghij", "s")]
    same([tuple(r) for r in omh.with_edits(frame(spark, one)).collect()], brute_edits(one))
    assert brute_edits(one)[0][2] == sha("abcdeabcde")
    two = [(1, "", "s"), (2, None, "s"), (3, "short", "s")]
    same([tuple(r) for r in omh.with_edits(frame(spark, two)).collect()], brute_edits(two))
    prints = {(r["doc_id"], r["fingerprint"]) for r in omh.fingerprints(docs).collect()}
    assert prints == {(i, omh.written(omh.sketch(t or ""))) for i, t, _ in ROWS}
