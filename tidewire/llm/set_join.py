"""N-gram Jaccard join of documents: a size-aware heavy-light join, and its classes.

A document's set: its distinct five-word shingles (`shingles`). Two documents link when 100 * intersection >= 80 * union. Equal
sets are one class from the start; what follows runs on classes, by a 64-bit sum of the set.

1. Elements dealt by hash: for each class, how many of its elements occur in another class. A class with a link has at least
   four fifths of them shared; the others, most of the corpus, end here. Exact but for more rarely shared elements than
   32 bits within a bucket can tell apart, which only let classes pass.
2. Light classes, of few elements: for each size a partner may have, the subsets of the fixed size that the two must share
   are enumerated; equal subsets are links, without a comparison.
3. Heavy classes: inverted lists of the rarest elements, as many of each class as a link must hit. A list is scanned
   against its hub first, pairs are compared, links united; pairs still apart are all scanned at the end. So a group of
   thousands of near copies costs a comparison with hubs for each, not all pairs, and no link between components is lost.
The boundary between light and heavy is where the counted costs of the two are least.

Defined results: null and empty texts, and those without words, have an empty set, link with nothing and are a component
each. Repeated rows are one class. Null ids are never the smallest of a component that has others. An empty table gives no
rows. Other columns aren't looked at.
"""

from __future__ import annotations

import struct
from hashlib import blake2b
from itertools import combinations, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components, labels
from .shingles import digests, shingles, slices

#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Elements a task holds before it deals them out; bytes of text for a bucket of elements, which a task holds as a whole.
HELD, BUCKET_BYTES = 1_000_000, 40_000_000
#: Bits of a set's digest that go with its elements into buckets: two sets that share elements have the same in one of 2 ** 48 cases.
DIGEST_BITS = 48
#: Rows of a batch where sets go to Python, and subsets that a task makes before it hands them on.
SETS_AT_ONCE, SUBSETS_AT_ONCE = 256, 50_000
#: Classes up to this number are broadcast to find their documents again, 24 bytes each; more are joined by shuffle.
BROADCAST_CLASSES = 400_000
#: Sizes at which sets may be light; as many pairs between components for each posting are scanned all at once; hub rounds at most before that; words of a bitmap.
LIGHT, PAIRS_EACH, HUB_ROUNDS, BITMAP = range(4, 25), 200, 4, 16


def overlap(a: int, b: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def least_shared(n: Column) -> Column:
    """Least intersection of a set of n elements with any set linked to it."""
    return F.ceil(n * PERCENT / 100)


def _packed(kept: list, parts: int):
    """A block for each bucket: DIGEST_BITS of digests, numbers of elements up to 255, and the lower halves of the elements in the order of the sets.

    With many buckets a set has an element or two in each, so what stands before them weighs more than they do: 7 bytes here.
    """
    size, h, d = (np.concatenate(x) for x in zip(*kept))
    of = np.repeat(np.arange(len(size)), size)
    bucket = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    h, of = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), of[order]
    ends = np.cumsum(np.bincount(bucket, minlength=parts))
    for b, (z, n) in enumerate(zip(ends, np.diff(ends, prepend=0))):
        if n:
            own = of[z - n : z]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            count = np.diff(np.append(first, n))
            pieces = -(-count // 255)
            digest = np.repeat(d[own[first]], pieces)
            size = np.full(len(digest), 255, "u1")
            size[np.cumsum(pieces) - 1] = count - 255 * (pieces - 1)
            digest = (digest & 0xFFFFFFFF).astype("<u4").tobytes() + (digest >> 32 & 0xFFFF).astype("<u2").tobytes()
            yield b, struct.pack("<Q", len(size)) + digest + size.tobytes() + h[z - n : z].tobytes()


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements; digests, lower DIGEST_BITS; numbers of elements of each. A set of over 255 has several entries."""
    (n,) = struct.unpack_from("<Q", block)
    digest = np.frombuffer(block, "<u4", n, 8) + (np.frombuffer(block, "<u2", n, 8 + 4 * n).astype(np.int64) << 32)
    return np.frombuffer(block, "<u4", -1, 8 + 7 * n), digest, np.frombuffer(block, "u1", n, 8 + 6 * n)


def _shared_elements(key: np.ndarray, sets: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests, and how many of each one's elements here occur with another digest too."""
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    several = np.append(same, False) | np.insert(same, 0, False)
    # Whose an element is, is looked up for those that occur twice alone.
    key, d = key[several], sets[np.searchsorted(np.cumsum(count, dtype=np.int64), order[several], "right")]
    order = np.lexsort((d, key))
    key, d = key[order], d[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (d[1:] != d[:-1])
    key, d = key[new], d[new]
    same = key[1:] == key[:-1]
    several = np.append(same, False) | np.insert(same, 0, False) if len(key) else np.zeros(0, bool)
    return np.unique(d[several], return_counts=True)


def _dealt(rows: DataFrame, parts: int, kind: str) -> DataFrame:
    """One pass over the texts: rows (id, n, d1, d2) of documents, and rows (d1, n) of the number of shared elements of a class in a bucket, d1 cut to DIGEST_BITS there."""

    def cut(batches):
        kept, held, row = [], 0, 0
        for b in (x for batch in batches for x in slices(batch)):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for a, z, size, h in shingles(texts):
                d1, d2 = digests(size, h)
                bucket = np.arange(row, row + z - a) % parts
                row += z - a
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), b.column(0).slice(a, z - a), pa.array(size, pa.int64()), pa.array(d1), pa.array(d2), pa.nulls(z - a, pa.binary())], names)
                kept.append((size, h, d1))
                held += len(h)
                if held >= HELD:
                    yield from flushed(b, kept)
                    kept, held = [], 0
        if held:
            yield from flushed(b, kept)

    def flushed(b, kept):
        for bucket, block in _packed(kept, parts):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.nulls(1, b.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.binary())], names)

    def counted(batches):
        blocks: dict[int, list[bytes]] = {}
        for b in batches:
            block = b.column("block")
            docs = b.filter(block.is_null())
            if docs.num_rows:
                yield docs.select(["id", "n", "d1", "d2"])
            for i in np.flatnonzero(block.is_valid().to_numpy(zero_copy_only=False)):
                blocks.setdefault(b.column("bucket")[int(i)].as_py(), []).append(block[int(i)].as_py())
            kind = b.column("id").type
        for some in blocks.values():
            d, n = _shared_elements(*(np.concatenate(x) for x in zip(*map(_unpacked, some))))
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), kind), pa.array(n, pa.int64()), pa.array(d), pa.nulls(len(d), pa.int64())], ["id", "n", "d1", "d2"])

    names = ["bucket", "id", "n", "d1", "d2", "block"]
    first = rows.mapInArrow(cut, f"bucket int, id {kind}, n long, d1 long, d2 long, block binary")
    return first.repartitionById(parts, F.col("bucket")).mapInArrow(counted, f"id {kind}, n long, d1 long, d2 long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, elements of the wanted classes, made anew from the text of each one's first document."""
    few = wanted.select(F.col("id").alias("id_"), F.col("d1").alias("node"), "d2")
    few = F.broadcast(few) if wanted.count() <= BROADCAST_CLASSES else few
    picked = rows.join(few, F.col("id").eqNullSafe(F.col("id_")), "inner").select("node", "d2", "text")

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            for a, z, size, h in shingles(texts):
                d1, d2 = digests(size, h)
                fits = (d1 == b.column(0).slice(a, z - a).to_numpy()) & (d2 == b.column(1).slice(a, z - a).to_numpy())
                at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                made = pa.RecordBatch.from_arrays([pa.array(d1), pa.array(size, pa.int64()), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))], ["node", "n", "elements"])
                yield made.filter(pa.array(fits))

    return picked.mapInArrow(run, "node long, n long, elements array<long>").dropDuplicates(["node"])


def _ordered(sets: DataFrame) -> DataFrame:
    """node, n, elements: those that occur in two sets or more, rarest first; common: how many sets hold an element, on average. Sets with too few are gone."""
    each = sets.select("node", "n", F.explode("elements").alias("e"))
    common = each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = each.join(common, "e").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("x"), (F.sum("df") / F.col("n")).alias("common"))
    return met.where(F.size("x") >= least_shared(F.col("n"))).select("node", "n", F.col("x.e").alias("elements"), "common")


def light_cost(n: int, limit: int) -> int:
    return sum(comb(n, overlap(n, m)) for m in range(-(-PERCENT * n // 100), min(limit, 100 * n // PERCENT) + 1))


def boundary(sizes: dict[int, int]) -> int:
    """Largest light size: where subsets of the light and postings and comparisons of the heavy together are fewest."""

    def cost(limit: int) -> int:
        heavy = sum(c * (n - overlap(n, n) + 2 + n) for n, c in sizes.items() if n >= overlap(limit + 1, limit + 1) * PERCENT // 100)
        return sum(c * light_cost(n, limit) for n, c in sizes.items() if n <= limit) + heavy

    return min(LIGHT, key=lambda b: (cost(b), b))


def _light(sets: DataFrame, limit: int) -> DataFrame:
    """Links among the light: sets that share a subset of the size that sets of their two sizes must share."""

    def run(batches):
        for b in batches:
            subsets = made(b)
            while some := list(islice(subsets, SUBSETS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["key", "small", "n", "node"])

    def made(b):
        for node, n, elements in zip(*(c.to_pylist() for c in b.columns)):
            for m in range(-(-PERCENT * n // 100), min(limit, 100 * n // PERCENT) + 1):
                a, z, k = min(n, m), max(n, m), overlap(n, m)
                for some in combinations(sorted(elements), k):
                    yield blake2b(struct.pack(f"<BB{k}q", a, z, *some), digest_size=16).digest(), a, n, node

    keys = sets.where(F.col("n") <= limit).select("node", "n", "elements").mapInArrow(run, "key binary, small long, n long, node long")
    hubs = keys.groupBy("key").agg(F.min(F.struct("n", "node")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = keys.join(hubs, "key").where((F.col("hub.n") == F.col("small")) & (F.col("node") != F.col("hub.node")))
    return met.select(F.col("hub.node").alias("u"), F.col("node").alias("v"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that link: the sets come to each pair once, the larger groups of pairs to their hub."""
    a = sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("elements").alias("eu"))
    b = sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("elements").alias("ev"))
    met = F.size(F.array_intersect("eu", "ev"))
    return pairs.join(b, "v").join(a, "u").where(100 * met >= PERCENT * (F.col("nu") + F.col("nv") - met)).select("u", "v")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """node, b0, b1, ...: for each set the parity of its elements in each of 64 * BITMAP places. Where two bitmaps differ, so do the sets."""

    def run(batches):
        for b in batches:
            e = b.column(1)
            size = np.diff(e.offsets.to_numpy())
            h = e.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            maps = np.zeros((len(size), BITMAP), np.uint64)
            np.bitwise_xor.at(maps, (np.repeat(np.arange(len(size)), size), (h >> np.uint64(6)) % np.uint64(BITMAP)), np.uint64(1) << (h & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(maps[:, k].view(np.int64)) for k in range(BITMAP))], ["node", *(f"b{k}" for k in range(BITMAP))])

    return sets.select("node", "elements").mapInArrow(run, "node long, " + ", ".join(f"b{k} long" for k in range(BITMAP)))


def _unlike(lists: DataFrame) -> DataFrame:
    """One of the lists with the same members each, of those with two or more: near copies share many, and any of them leads to the same pairs."""
    kinds = lists.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b")).where("c > 1")
    return lists.join(kinds.groupBy("c", "a", "b").agg(F.min("e").alias("e")).select("e"), "e", "left_semi")


def _heavy(sets: DataFrame, limit: int) -> DataFrame:
    """Links that join up all components of the heavy."""
    heavy = sets.where(F.col("n") * 100 >= PERCENT * (limit + 1))
    held = F.size("elements") - least_shared(F.col("n")).cast("int") + 1
    own = ["node", "n", "at", "left", "common"]
    lists = heavy.select("node", "n", "common", F.posexplode(F.slice("elements", F.lit(1), held)).alias("at", "e"), F.size("elements").alias("left"))
    lists = shared.keep(_unlike(lists.withColumn("root", F.col("node"))), "lists")
    links, before, first = None, None, None
    for turn in range(HUB_ROUNDS + 1):
        if turn:
            # Lists whose members are one component by now have nothing left to find.
            roots = labels(links)
            now = lists.drop("root").join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").drop("node_").withColumn("root", F.coalesce("root", "node"))
            apart = now.groupBy("e").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("e")
            lists = shared.keep(now.join(apart, "e", "left_semi"), "apart")
            sizes = lists.groupBy("e", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("e").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
            rows, left = sizes.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
            if not rows:
                break
            first = first or rows
            last = turn == HUB_ROUNDS or left <= PAIRS_EACH * first or before is not None and left > 0.7 * before
            before = left
        else:
            last = False
        n, m = F.col("x.n"), F.col("y.n")
        # The most that two sets can share: what follows their places in this list, and what comes before.
        most = 1 + F.least(F.col("x.left") - F.col("x.at"), F.col("y.left") - F.col("y.at")) + F.least("x.at", "y.at")
        may = (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & ((100 + PERCENT) * most >= PERCENT * (n + m))
        if last:
            # Whatever is still apart: every pair of a list between two components, if places and bitmaps leave it a chance.
            # Sets may be long: a batch of many would fill the memory beside the heap.
            with shared.small_batches(sets.sparkSession, SETS_AT_ONCE):
                maps = shared.keep(_bitmaps(sets.join(lists.select("node").distinct(), "node", "left_semi")), "maps")
            marked = lists.join(maps, "node")
            x, y = marked.alias("x"), marked.alias("y")
            differ = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(BITMAP)), F.lit(0))
            alike = (100 + PERCENT) * (F.col("x.left") + F.col("y.left") - differ) >= 2 * PERCENT * (n + m)
            pairs = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.root") < F.col("y.root")) & may & alike)
        else:
            # The hub of a list shares most with other sets: of copies that differ each in their own way, the one they come from.
            by = F.struct(F.col("common").alias("h") if not turn else F.xxhash64("node", F.lit(turn)).alias("h"), *own, "root")
            hubs = lists.groupBy("e").agg(F.max(by).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("e", *[f"hub.{c}" for c in (*own, "root")])
            pairs = hubs.alias("x").join(lists.alias("y"), F.col("x.e") == F.col("y.e")).where((F.col("x.root") != F.col("y.root")) & may)
        pairs = pairs.select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()
        found = shared.keep(_verified(pairs, sets), "found")
        links = found if links is None else links.unionByName(found)
        if last:
            break
    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_shingles, component_id (the smallest id that links lead to)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # A class has a row for each bucket that holds a shared element of it: half as many as shuffle partitions, but as many as the text asks for.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-size // BUCKET_BYTES))
    with shared.small_batches(spark):
        both = shared.keep(_dealt(rows, parts, kind), "dealt")
    members = both.where("d2 IS NOT NULL")
    equal = members.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id"))
    counts = both.where("d2 IS NULL").groupBy("d1").agg(F.sum("n").alias("met")).withColumnRenamed("d1", "low")
    low = F.col("d1").bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))
    wanted = shared.keep(equal.join(counts, low == F.col("low")).where(F.col("met") >= least_shared(F.col("n"))).select("id", "d1", "d2", "n"), "wanted")
    with shared.small_batches(spark):
        sets = shared.keep(_ordered(_sets(rows, wanted)), "sets")
    sizes = {r["n"]: r["c"] for r in sets.where(F.col("n") <= 2 * max(LIGHT)).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # sizes, of bounded number
    limit = boundary(sizes)
    links = _light(sets, limit).unionByName(_heavy(sets, limit))
    roots = shared.keep(components(links), "roots")
    ids = wanted.select(F.col("d1").alias("node"), "id").join(roots, "node")
    least = ids.groupBy("root").agg(F.min("id").alias("component"))
    moved = ids.join(least, "root").select(F.col("node").alias("d1"), "component").dropDuplicates(["d1"])
    named = equal.join(moved, "d1", "left").select(F.col("d1").alias("d1_"), F.col("d2").alias("d2_"), F.coalesce("component", "id").alias("component"))
    out = members.join(named, (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component kept: the first by id and hash of the text. Of rows equal in both, one stays."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    found = classes(docs.select(key.alias("id"), F.col(text_col).alias("text")), "id", "text")
    kept = found.where(F.col("id") == F.col("component_id")).select(F.col("id.id").alias("id_"), F.col("id.th").alias("th_")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "th").orderBy("th"))
    return met.withColumn("k_", first).where("k_ = 1").select("row.*")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
