"""Token ids as binary files: one concatenated id array a shard, document boundaries in Elias-Fano code.

A store is a folder of shards in ascending order of id. `shard-N.bin` holds the ids, little-endian, in two bytes each where
the vocabulary allows and else in four. `shard-N.idx` holds the document ids (an Arrow stream) and the boundaries: n + 1
ascending numbers below u cost about n * (2 + log2(u / n)) bits; a sample of select positions leads to any of them without
a table of 64-bit offsets.

Defined results: a null or empty text has the end id alone. Null document ids come first, as one group; rows that share an id
stand together in any order. Other columns are not looked at. An empty table gives an empty store.
"""

from __future__ import annotations

import bisect
import gc
import io
import json
import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .shingles import mix, powers

#: Every so many boundaries, the place of one is stored.
SAMPLE = 256
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Bytes of text encoded at once, ids read at once.
AT_ONCE = 2_000_000


#: Fixed values of byte-level tokenizers: the characters that stand for bytes; in BYTES, by Latin letter.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}
BYTES = {c: "".join([BYTE[b] for b in chr(c).encode()]) for c in range(0xA1, 0x250)}
#: A piece that needs no pattern: a space, letters up to this one, then signs.
LATIN, TAIL = "\u024f", ".,;:!?*$%&#|"
_VALUES = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, 256, np.uint64)


class EliasFano:
    """Ascending numbers: `low` bits of each packed, the rest in unary; select(i) gives the i-th."""

    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low, self.lows, self.high, self.sample = n, low, lows, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, low, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8"))

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // SAMPLE]), i % SAMPLE
        byte, skip = divmod(at, 8)
        left += int(self.high[byte] & ((1 << skip) - 1)).bit_count()
        while (ones := int(self.high[byte]).bit_count()) <= left:
            left -= ones
            byte += 1
        bit = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[left]
        value = byte * 8 + int(bit) - i
        first = i * self.low
        window = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return value << self.low | (window >> first % 8) & ((1 << self.low) - 1)

    def between(self, i: int, j: int) -> np.ndarray:
        """The i-th to the one before the j-th, decoded from the sampled place before them on."""
        if not 0 <= i < j <= self.n:
            raise IndexError((i, j))
        at, stop = int(self.sample[i // SAMPLE]), -(-j // SAMPLE)
        byte, stop = at // 8, int(self.sample[stop]) // 8 + 1 if stop < len(self.sample) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + 8 * byte
        places = places[np.searchsorted(places, at) + i % SAMPLE :][: j - i]
        first, skip = divmod(i * self.low, 8)
        bits = np.unpackbits(self.lows[first:], count=skip + (j - i) * self.low, bitorder="little")[skip:].reshape(j - i, self.low).astype(np.int64)
        return (places - np.arange(i, j) << self.low) + bits @ (1 << np.arange(self.low, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQBQ", self.n, self.low, len(self.lows), len(self.high), self.sample.itemsize, len(self.sample))
        return head + self.lows.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low, a, b, wide, c = struct.unpack_from("<QBQQBQ", data)
        at = struct.calcsize("<QBQQBQ")
        return cls(n, low, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, f"<u{wide}", c, at + a + b))


def flat(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size


class Encoder:
    """Encodes as the tokenizer does, with a memory of the pieces between single spaces.

    The byte-level pre-tokenizer never joins what stands before a space that follows a non-space with what comes after, so
    the ids of a text are those of its pieces, each with its leading space, one after the other. Pieces are found and told
    apart by 64-bit hashes, many at once; a new piece of Latin letters, then signs, is two words to the pre-tokenizer and
    goes to the tokenizer's model at once; any other goes the whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.model = self.of.model
        made = json.loads(self.of.to_str())
        pre = made.get("pre_tokenizer") or {}
        added = [x["content"] for x in made["added_tokens"]]
        self.pieces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and made.get("normalizer") is None and all(not x["lstrip"] and not x["rstrip"] and not x["single_word"] for x in made["added_tokens"])
        # An added token must not be cut by a space, nor look like letters and signs.
        self.pieces = self.pieces and all(" " not in x and not x.rstrip(TAIL).isalpha() for x in added)
        self.wide = self.of.get_vocab_size() > 1 << 16
        self.forget()

    def forget(self) -> None:
        """slot: of a piece's hash; words, signs: slots of the words after a space and of the signs after them that pieces are made of."""
        self.slot: dict[int, int] = {}
        self.words: dict[str, int] = {}
        self.signs: dict[str, int] = {}
        self.ids, self.first, self.size, self.used, self.slots = np.empty(1 << 21, np.uint32), np.empty(1 << 19, np.int64), np.empty(1 << 19, np.int64), 0, 0

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.of.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, ids: np.ndarray, size: np.ndarray) -> range:
        """Slots for runs of ids of these sizes."""
        stop, n = self.used + len(ids), self.slots + len(size)
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(stop, np.uint32)])
        if n > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.empty(n, np.int64)]), np.concatenate([self.size, np.empty(n, np.int64)])
        self.ids[self.used : stop] = ids
        self.first[self.slots : n], self.size[self.slots : n] = self.used + np.cumsum(size) - size, size
        new = range(self.slots, n)
        self.used, self.slots = stop, n
        return new

    def gathered(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[slots]
        upto = np.cumsum(size)
        place = np.repeat(self.first[slots] - upto + size, size)
        place += np.arange(len(place))
        return self.ids[place], size

    def learn(self, pieces: list[str], keys: list[int]) -> None:
        """Gives each piece that follows a space a slot, and each word and run of signs that pieces are made of."""
        known, signs, model, space = self.words, self.signs, self.model.tokenize, BYTE[32]
        words, whole, whole_keys, cores, tails, signed_keys, rest, rest_keys = {}, [], [], [], [], [], [], []
        for p, key in zip(pieces, keys):
            core = p.rstrip(TAIL)
            if not core.isalpha() or not p.isascii() and max(p) > LATIN:
                rest.append(f" {p}")
                rest_keys.append(key)
                continue
            if core not in known:
                words[core] = None
            n = len(core)
            if n == len(p):
                whole.append(p)
                whole_keys.append(key)
            else:
                cores.append(core)
                tails.append(tail := p[n:])
                signed_keys.append(key)
                if tail not in signs:
                    signs.update(zip([tail], self.add(*flat([[t.id for t in model(tail)]]))))
        made = [model(space + (w if w.isascii() else w.translate(BYTES))) for w in words]
        known.update(zip(words, self.add(*flat([[t.id for t in x] for x in made]))))
        self.slot.update(zip(whole_keys, map(known.__getitem__, whole)))
        self.slot.update(zip(rest_keys, self.add(*flat(self.plain(rest)))))
        pairs = np.empty(2 * len(cores), np.int64)
        pairs[::2] = np.fromiter(map(known.__getitem__, cores), np.int64, len(cores))
        pairs[1::2] = np.fromiter(map(signs.__getitem__, tails), np.int64, len(cores))
        ids, size = self.gathered(pairs)
        self.slot.update(zip(signed_keys, self.add(ids, size[::2] + size[1::2])))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, `end` after each, and the number of each."""
        if not self.pieces:
            return flat([[*x, end] for x in self.plain([t.decode() for t in texts])])
        if self.slots > REMEMBERED or self.used > 8 * REMEMBERED:
            self.forget()
        data = b"".join(texts)
        doc = np.cumsum([0, *map(len, texts)])
        begin, hashes = hashed(data, doc[:-1])
        some, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        get = self.slot.get
        found = np.fromiter((get(k, -1) for k in some.tolist()), np.int64, len(some))
        if len(new := np.flatnonzero(found < 0)):
            first = at[new]
            last = np.append(begin, len(data))[first + 1]
            after = np.frombuffer(data, np.uint8)[begin[first]] == 32
            first, fresh = begin[first], some[new]
            self.learn([data[a + 1 : z].decode() for a, z in zip(first[after].tolist(), last[after].tolist())], fresh[after].tolist())
            heads = self.plain([data[a:z].decode() for a, z in zip(first[~after].tolist(), last[~after].tolist())])
            self.slot.update(zip(fresh[~after].tolist(), self.add(*flat(heads))))
            found[new] = [get(k) for k in some[new].tolist()]
        ids, size = self.gathered(found[back])
        pieces = np.concatenate([[0], np.cumsum(size)])
        stop = pieces[np.searchsorted(begin, doc, "left")]
        return np.insert(ids, stop[1:], end), np.diff(stop) + 1


def hashed(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts that start at `starts` begin, and a hash of each. A piece begins at a space after a non-space, by no means after one of Unicode's spaces."""
    b = np.frombuffer(data, np.uint8)
    space = np.flatnonzero(b == 32)
    one, two, three = (b[np.maximum(space - k, 0)] for k in (1, 2, 3))
    plain = (one < 128) & (one > 32) | (one >= 128) & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    begin = np.sort(np.concatenate([space[plain & (space > 0)], starts[starts < len(b)]]))
    begin = begin[np.diff(begin, prepend=-1) > 0]
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[b] * up[:-1], dtype=np.uint64)])
    stop = np.append(begin[1:], len(b)).astype(np.int64)
    return begin, mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches(ids: pa.Array, texts: pa.Array):
    """Runs of rows of about AT_ONCE bytes."""
    held, first = 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        held += n
        if held >= AT_ONCE or i + 1 == len(sizes):
            yield ids.slice(first, i + 1 - first), texts.slice(first, i + 1 - first)
            held, first = 0, i + 1


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store into folder; returns shard, n_docs, n_tokens, first (ids in the shards before).

    Rows meet once, dealt by ranges of the id and, among equal ids, of the row's number, so that no id fills one task. A task
    writes under a name of its own and renames at its end: a second attempt leaves the same files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("n"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.col("n")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("n")).select("id", "text")

    def run(batches):
        code = encoder(tokenizer)
        gc.disable()  # nothing here makes cycles; the collector would walk the encoder's memory again and again
        shard, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, top = pafs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        kept, sizes, out = [], [], None
        try:
            for b in batches:
                for ids, texts in _batches(b.column(0), b.column(1)):
                    found, size = code.encode([x or b"" for x in texts.cast(pa.binary()).to_pylist()], end)
                    out = out or fs.open_output_stream(f"{top}/.{mine}.bin")
                    out.write(found.astype("<u4" if code.wide else "<u2").tobytes())
                    kept.append(ids)
                    sizes.append(size)
        finally:
            gc.enable()
        if out is None:
            return
        out.close()
        size = np.concatenate(sizes)
        table = pa.table({"id": pa.chunked_array(kept)})
        names = io.BytesIO()
        with pa.ipc.new_stream(names, table.schema) as w:
            w.write_table(table)
        bounds = EliasFano.of(np.concatenate([[0], np.cumsum(size)])).to_bytes()
        with fs.open_output_stream(f"{top}/.{mine}.idx") as f:
            f.write(struct.pack("<4sBQ", b"TOK1", 4 if code.wide else 2, len(bounds)) + bounds + names.getvalue())
        for kind in ("bin", "idx"):
            fs.move(f"{top}/.{mine}.{kind}", f"{top}/shard-{shard:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(size)], "n_tokens": [int(size.sum())]})

    shared_list = shared.keep(dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return shared_list.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """Random access to a shard: its document ids, and the ids of its i-th document."""

    def __init__(self, folder: str, shard: int):
        self.fs, top = pafs.FileSystem.from_uri(folder)
        self.bin = f"{top}/shard-{shard:06d}.bin"
        with self.fs.open_input_stream(f"{top}/shard-{shard:06d}.idx") as f:
            data = f.read()
        _, self.wide, n = struct.unpack_from("<4sBQ", data)
        at = struct.calcsize("<4sBQ")
        self.bounds = EliasFano.from_bytes(data[at : at + n])
        self.names = pa.ipc.open_stream(data[at + n :]).read_all().column("id")

    def __len__(self) -> int:
        return self.bounds.n - 1

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        with self.fs.open_input_file(self.bin) as f:
            return np.frombuffer(f.read_at((b - a) * self.wide, a * self.wide), f"<u{self.wide}")

    def runs(self):
        """First document of a run, the bounds of its documents and their ids, front to back.

        A run has AT_ONCE ids at most, or is one document. Its end is searched for by select, and its own bounds alone are decoded.
        """
        with self.fs.open_input_stream(self.bin) as f:
            i = 0
            while i < len(self):
                start = self.bounds.select(i)
                j = max(i + 1, bisect.bisect_right(range(len(self) + 1), start + AT_ONCE, lo=i, key=self.bounds.select) - 1)
                bounds = self.bounds.between(i, j + 1)
                yield i, bounds, np.frombuffer(f.read(int(bounds[-1] - start) * self.wide), f"<u{self.wide}").astype("<u4")
                i = j


def read(spark: SparkSession, shards: DataFrame, folder: str, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """A row for each document of the store: id, start over all shards, n_tokens, ids_crc32 (of its ids in four bytes each)."""

    def run(batches):
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Shard(folder, shard)
                for i, bounds, ids in s.runs():
                    at, n = bounds - bounds[0], len(bounds) - 1
                    crc = [zlib.crc32(ids[at[k] : at[k + 1]].data) for k in range(n)]
                    name = s.names.slice(i, n).combine_chunks()
                    yield pa.RecordBatch.from_arrays([name, pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    many = shards.select("shard", "first").repartition(F.col("shard"))
    return many.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    folder = shared.folder(spark, "tokens")
    return read(spark, write(docs, folder, tokenizer, end, id_col, text_col), folder, docs.schema[id_col].dataType.simpleString(), id_col)


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
