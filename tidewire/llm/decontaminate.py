"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. A window is `window` consecutive words of
an item; a shorter item with at least one word is a window as a whole. Texts are handled as UTF-8 bytes: normalising maps
byte to byte, so a place in the normalised words leads back to the original without a table.

Defined results: a null or empty text has no words, no hits, is clean. An item without words matches nothing; an item with
a null id is left out; repeated item ids count once. Repeated documents get a row each. Other columns, whatever their
names, are not looked at. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shingles import slices

#: Byte to byte: A-Z to lower case, what is not a word to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
STRETCHES = "array<struct<start:int,end:int>>"
SCHEMA = f"id {{kind}}, n_words long, n_hit long, items array<string>, runs {STRETCHES}, spans {STRETCHES}"
#: Words of a pattern of the automaton; pairs of its places in text and items that are looked at in one go.
SEED, PLACES_AT_ONCE = 5, 1 << 20
#: One automaton holds items of so many bytes at most, for which it was measured to take 0.46 GB of a worker; a larger benchmark is
#: scanned for in blocks of this size.
BLOCK_BYTES = 20_000_000


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Patterns:
    """The automaton of the items, of which there are some with words.

    Words of items are numbered, and the automaton reads a number as digits, each place with an alphabet of its own, so a pattern is found
    at words alone and no state has many steps. Its patterns are SEED words in every `stride` of an item: any window holds one of
    them, whole. Where one is found, the words around it are held against the item's at all places that have it, up to a window's
    reach; a stretch as long as a window is one, or several. So the automaton takes less than the items' words, not 13 times them.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        sizes = np.array([len(w) for _, w in items])
        self.number = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws), 1)}
        #: All items one after the other, each behind a -1; the ends are padded, so that no place is out of bounds.
        self.pad = window
        self.starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 1])) + window
        self.words = np.full(self.starts[-1] + sizes[-1] + window, -1, np.int32)
        for at, (_, ws) in zip(self.starts, items):
            self.words[at : at + len(ws)] = [self.number[w] for w in ws]
        self.least = np.minimum(sizes, window)
        base = 64
        self.digits = next(d for d in itertools.count(1) if base**d > len(self.number))
        places = np.arange(len(self.number) + 1)[:, None] // base ** np.arange(self.digits) % base + base * np.arange(self.digits)
        if self.digits > 4:
            raise ValueError("over 16 million different words in a block of items")
        self.code = places.astype(np.uint8)
        seed = min(SEED, window)
        stride = window - seed + 1
        self.reach = window - seed
        found: dict[bytes, list[int]] = {}
        for at, n in zip(self.starts.tolist(), sizes.tolist()):
            length = min(seed, n)
            for i in range(at, at + (n - length if n >= window else 0) + 1, stride):
                found.setdefault(self.words[i : i + length].tobytes(), []).append(i)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, key in enumerate(found):
            self.auto.add_word(self._coded(np.frombuffer(key, np.int32)), k)
        self.auto.make_automaton()
        self.size = np.array([len(key) // 4 for key in found])
        #: Where each pattern stands in the items.
        self.first = np.cumsum([0, *map(len, found.values())])
        self.places = np.concatenate([np.array(x, np.int32) for x in found.values()])

    def _coded(self, numbers: np.ndarray) -> str:
        return self.code[numbers].tobytes().decode("latin-1")

    def hits(self, w: list[bytes]) -> tuple[np.ndarray, list[str]] | None:
        """Whether each word is hit, and the items; None where nothing is."""
        text = np.zeros(len(w) + 2 * self.pad, np.int32)
        text[self.pad : self.pad + len(w)] = np.fromiter(map(self.number.get, w, itertools.repeat(0)), np.int32, len(w))
        found = list(self.auto.iter(self._coded(text[self.pad : self.pad + len(w)])))
        if not found:
            return None
        end, seed = np.array(found).T
        at = (end + 1) // self.digits - self.size[seed] + self.pad
        many = self.first[seed + 1] - self.first[seed]
        step, items, a = np.zeros(len(text) + 1, np.int64), set(), 0
        total = np.cumsum(many)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PLACES_AT_ONCE)))
            self._extended(text, np.repeat(at[a:b], many[a:b]), np.repeat(seed[a:b], many[a:b]), many[a:b], step, items)
            a = b
        if not items:
            return None
        return np.cumsum(step)[self.pad : self.pad + len(w)] > 0, sorted({self.names[k] for k in items})

    def _extended(self, text: np.ndarray, at: np.ndarray, seed: np.ndarray, many: np.ndarray, step: np.ndarray, items: set[int]) -> None:
        """Adds what the patterns at these words of the text, each with all its places in the items, grow to."""
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        place = self.places[self.first[seed] + nth]
        last = self.size[seed] - 1
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for grown, x, y, way in ((left, at, place, -1), (right, at + last, place + last, 1)):
            same = np.arange(len(at))
            for k in range(1, self.reach + 1):
                same = same[text[x[same] + way * k] == self.words[y[same] + way * k]]
                if not len(same):
                    break
                grown[same] = k
        item = np.searchsorted(self.starts, place, "right") - 1
        whole = left + last + 1 + right >= self.least[item]
        np.add.at(step, (at - left)[whole], 1)
        np.add.at(step, (at + last + right + 1)[whole], -1)
        items.update(np.unique(item[whole]).tolist())


def automaton(items: list[tuple[str, bytes]], window: int) -> Patterns | None:
    several = [(name, w) for name, w in ((name, words(text)) for name, text in items) if w]
    return Patterns(several, window) if several else None


def scan_text(text: bytes, patterns: Patterns | None) -> tuple[int, int, list[str], list[dict], list[dict]]:
    """Number of words, hit words, items, and the hit stretches as word numbers and as code point offsets of the original text."""
    w = words(text)
    found = patterns.hits(w) if w and patterns is not None else None
    if found is None:
        return len(w), 0, [], [], []
    hit, items = found
    raw = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], raw.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
    runs = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    runs = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1))]
    spans = [{"start": int(point[starts[r["start"]]]), "end": int(point[ends[r["end"] - 1]])} for r in runs]
    return len(w), int(hit.sum()), items, runs, spans


_built: dict[tuple[str, int], Patterns | None] = {}


def _patterns(told, window: int):
    """Built once in each worker, for the block that the name broadcast with it stands for."""
    name, items = told.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = automaton(items, window)
    return _built[name, window]


def _told(spark, block: list[tuple[str, bytes]]):
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """Items, BLOCK_BYTES of them at a time: the driver holds a block, not the benchmark."""
    block, held = [], 0
    for item, text in benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string"), item_text_col).toLocalIterator():
        data = text.encode("utf-8", "surrogatepass")
        if block and held + len(data) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((item, data))
        held += len(data)
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_words, n_hit, items, spans. One pass without a shuffle; blocks only where the benchmark is over BLOCK_BYTES."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    stretches = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), stretches, stretches]

    def scanner(items):
        def run(batches):
            found = _patterns(items, window)
            for b in (x for batch in batches for x in slices(batch)):
                got = [scan_text(x or b"", found) for x in b.column(1).cast(pa.binary()).to_pylist()]
                made = [pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made], ["id", "n_words", "n_hit", "items", "runs", "spans"])

        return run

    parts = [scanner(_told(spark, b)) for b in _blocks(benchmark, item_col, item_text_col)]
    if len(parts) == 1:
        return rows.mapInArrow(parts[0], SCHEMA.format(kind=kind)).drop("runs").withColumnRenamed("id", id_col)
    # Several blocks: documents get a number of their own by which their parts meet again; texts aren't shuffled.
    numbered = shared.keep(rows.withColumn("n", F.monotonically_increasing_id()), "numbered")
    return _merged([numbered.select(F.struct("n", "id").alias("id"), "text").mapInArrow(p, SCHEMA.format(kind=f"struct<n:long,id:{kind}>")) for p in parts]).withColumnRenamed("id", id_col)


def _merged(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    joined = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]),
            F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("runs")), lambda r: F.sequence(r["start"], r["end"] - 1)))))
    return (
        both.groupBy("id")
        .agg(F.max("n_words").alias("n_words"), hit.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), joined.alias("spans"))
        .select(F.col("id.id").alias("id"), "n_words", "n_hit", "items", "spans")
    )


def flagged(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """scan() with `contaminated`: at least one hit word, and one in twenty words or more."""
    return scan(docs, benchmark, **kw).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with their own columns. Rows pass by the automaton; they meet their verdicts by number only where there are several blocks."""
    blocks = list(itertools.islice(_blocks(benchmark, item_col, item_text_col), 2))
    if len(blocks) > 1:
        numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("text"))
        numbered = shared.keep(numbered, "numbered")
        good = flagged(numbered, benchmark, window=window, id_col="n", item_col=item_col, item_text_col=item_text_col).where(~F.col("contaminated")).select("n")
        return numbered.join(good, "n", "left_semi").select("row.*")
    items = _told(docs.sparkSession, blocks[0])
    at = docs.columns.index(text_col)

    def run(batches):
        found = _patterns(items, window)
        for b in (x for batch in batches for x in slices(batch)):
            hits = [scan_text(x or b"", found)[:2] for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array([not (hit > 0 and 20 * hit >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = flagged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "spans"
    )
