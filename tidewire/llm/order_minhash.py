"""Order MinHash: fingerprints whose agreement falls with edit distance, not only with other content.

The elements of a text are its k-mers of code points, each with the number of its earlier occurrences. Every slot of a
fingerprint has an order of its own over the elements; it takes the first EACH of them, puts them back into the order of the
text, and hashes the tuple of their k-mers. Two texts agree in a slot where they share these k-mers in the same order.

The orders are drawn in turns: in each, an element falls into one slot, with a value; a slot takes its elements by turn, then by
value. After as many turns as slots, each slot in turn is offered every element. So a text of many k-mers is hashed about once, a
short one a few times, and all are compared alike.

Edited texts need each document's next one. Rows are dealt by the order of ids into blocks, a block for each task and more; its
bounds are the least and greatest key of ranges that Spark draws over ids alone. The first document of a block is sent to the block
before as well, so a task reads on from document to document, holding two, and texts are shuffled once.

Defined results: a null text is empty, its slots are 0, and it is like an empty text alone. A text of fewer than k code points is
one k-mer. The order is by id, descending, null last; rows that share an id stand by a hash of their text, so a single row is its
own next one. An empty table gives no rows. Other columns aren't looked at. Beside a text a worker holds some 60 bytes for each of
its characters.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import U, mix, slices

K, EACH, SLOTS = 8, 2, 64
#: Elements drawn at once for a short text.
AT_ONCE = 700
#: Blocks for each of the session's shuffle partitions.
BLOCKS = 4

#: Bits of a slot's number, and of a value; the turn stands between.
_BITS = SLOTS.bit_length() - 1
_LOW = 64 - 2 * _BITS - 1
_TOP = U((SLOTS - 1) << (64 - _BITS))
_MIDDLE = U((2 * SLOTS - 1) << _LOW)
_R, _TURN, _AGAIN = U(0x9E3779B97F4A7C15 | 3), U(0xD1342543DE82EF95), U(0x2545F4914F6CDD1D)


def kmers(text: str) -> np.ndarray:
    """A hash of each k-mer: polynomials of two, four, eight code points, each from the one before."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    if len(h) < K:  # one k-mer, of length len(h)
        with np.errstate(over="ignore"):
            return (np.add.reduce(h * _R ** np.arange(1, len(h) + 1, dtype=U), keepdims=True) + U(len(h)))[: len(h)]
    size, r = 1, _R
    with np.errstate(over="ignore"):
        while size < K:
            h, size, r = h[:-size] * r + h[size:], 2 * size, r * r
    return h


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    out = np.zeros(len(h), U)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        low = np.zeros(1 << 16, bool)  # few values that occur once pass by their low bits; sorting tells
        low[twice & U(0xFFFF)] = True
        at = np.flatnonzero(low[h & U(0xFFFF)])
        at = at[np.argsort(h[at], kind="stable")]
        v = h[at]
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        out[at] = np.arange(len(v)) - np.repeat(new, np.diff(np.append(new, len(v))))
    return out


def _drawn(e: np.ndarray, turns: range) -> np.ndarray:
    """For each turn and element, as one number: slot, turn, value. In the first turn they are the element's own bits."""
    if turns == range(1):
        return e & ~_MIDDLE
    t = np.arange(turns.start, turns.stop, dtype=U)[:, None]
    p = mix(e[None, :] + t * _TURN)
    if not turns.start:
        p[0] = e
    slot = p & _TOP if turns.start < SLOTS else (t - U(SLOTS)) << U(64 - _BITS)
    return (slot | (t << U(_LOW)) | (p & U((1 << _LOW) - 1))).ravel()


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where each slot begins among ordered numbers; at last, their count."""
    return np.append(np.searchsorted(ordered, np.arange(SLOTS, dtype=U) << U(64 - _BITS)), len(ordered))


def _first(e: np.ndarray) -> np.ndarray | None:
    """The places chosen where the first turn fills every slot; else None."""
    p = _drawn(e, range(1))
    s = np.sort(p)
    edge = _edges(s)
    if np.diff(edge).min() < EACH:
        return None
    at = np.flatnonzero(p <= s[edge[:-1] + EACH - 1][(p >> U(64 - _BITS)).astype(np.int64)])
    return at[np.argsort(p[at] >> U(64 - _BITS), kind="stable")] if len(at) == SLOTS * EACH else None


def chosen(e: np.ndarray) -> np.ndarray:
    """Slot by slot the places of its first EACH elements (all, if fewer), ascending in each."""
    n, want = len(e), min(EACH, len(e))
    if n >= AT_ONCE and (found := _first(e)) is not None:
        return found
    turns = min(SLOTS, -(-AT_ONCE // n))
    while True:
        p = _drawn(e, range(turns))
        if turns == SLOTS:  # and last, every element to each slot in turn
            p = np.concatenate([p, _drawn(e, range(SLOTS, 2 * SLOTS))])
        order = np.argsort(p, kind="stable")
        edge = _edges(p[order])
        count = np.diff(edge)
        wide = 4 * want
        while count.min() >= want:
            wide = min(wide, int(count.max()))
            k = np.arange(wide)
            place = np.where(k < count[:, None], order[np.minimum(edge[:-1, None] + k, len(p) - 1)] % n, -1)
            # An element counts where a slot first takes it.
            new = (place >= 0) & ~((place[:, :, None] == place[:, None, :]) & (k[:, None] > k)).any(2)
            taken = new & (np.cumsum(new, 1) <= want)
            if (taken.sum(1) == want).all():
                return np.sort(place[taken].reshape(SLOTS, want), 1).ravel()
            if wide == count.max():
                break
            wide *= 2
        turns = min(SLOTS, 2 * turns)


def sketch(text: str) -> np.ndarray:
    """The slots of a text, 32 bits each."""
    h = kmers(text)
    if not len(h):
        return np.zeros(SLOTS, np.uint32)
    with np.errstate(over="ignore"):
        tuples = h[chosen(mix(h + occurrences(h) * _AGAIN))].reshape(SLOTS, -1)
        out = np.zeros(SLOTS, U)
        for i in range(tuples.shape[1]):
            out = mix(out * _R + tuples[:, i] + U(1))
    return np.maximum(out >> U(32), U(1)).astype(np.uint32)


def written(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of slots in which two fingerprints agree."""
    each = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: (F.substr(a, 8 * i + 1, F.lit(8)) == F.substr(b, 8 * i + 1, F.lit(8))).cast("int"))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x) / SLOTS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, fingerprint of each document: one pass without a shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            texts = b["text"].to_pylist()
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(map(len, texts), pa.int64()), pa.array([written(sketch(t)) for t in texts])], ["id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _blocks(rows: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The least and the greatest key of each block, ascending: as many as ranges, of ids and hashes alone."""
    n = BLOCKS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("told", "id", "h")
    found = rows.select("told", "id", "h").repartitionByRange(n, "told", "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("least"), F.max(key).alias("most")).collect()
    found = sorted((tuple(r["least"]), tuple(r["most"])) for r in found)
    return [a for a, _ in found], [z for _, z in found]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, more, id, text: rows of a block stand together in the order of documents; behind them, marked, the first of the next block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).isNotNull().alias("told"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    least, most = _blocks(rows)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        last = {key: k for k, key in enumerate(most)}
        for b in (x for batch in batches for x in slices(batch)):
            keys = [*zip(b["told"].to_pylist(), b["id"].to_pylist(), b["h"].to_pylist())]
            block = [bisect_right(least, key) - 1 for key in keys]
            also = [(i, (last[key] + 1) % len(most)) for i, key in enumerate(keys) if key in last]
            at = pa.array([*range(len(keys)), *(i for i, _ in also)], pa.int64())
            told = [pa.array([*block, *(k for _, k in also)], pa.int32()), pa.array([False] * len(keys) + [True] * len(also), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*told, *[b[c].take(at) for c in ("told", "id", "h", "text")]], ["block", "more", "told", "id", "h", "text"])

    dealt = rows.mapInArrow(run, f"block int, more boolean, told boolean, id {kind}, h long, text string").repartition("block")
    return dealt.sortWithinPartitions("block", "more", F.desc("told"), F.desc("id"), F.desc("h"), F.desc("text")).select("block", "more", "id", "text")


def edited(text: str, then: str) -> str:
    """text with its last half replaced by as much of what follows, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + then[:half]


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each document."""
    rows = in_order(docs, id_col, text_col)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held = None  # block, id, text and sketch of the document whose next one is still to come
        for b in (x for batch in batches for x in slices(batch, 200)):
            ids, out = [], []
            for i, (block, more, text) in enumerate(zip(b["block"].to_pylist(), b["more"].to_pylist(), b["text"].to_pylist())):
                s = sketch(text) if not more or held else None
                if held and held[0] == block:
                    _, id, before, t = held
                    new = edited(before, text)
                    u = sketch(new)
                    ids.append(id)
                    out.append((len(before), hashlib.sha256(new.encode()).hexdigest(), written(t), written(u), float(np.mean(t == u)), float(np.mean(t == s))))
                held = None if more else (block, b["id"].slice(i, 1), text, s)
            made = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids) if ids else b["id"].slice(0, 0), *made], names)

    said = f"id {rows.schema['id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, said).withColumnRenamed("id", id_col)


def op11_order_minhash(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
