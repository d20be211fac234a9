"""Language-model scores of whole documents: exact unigram counts, and a gated recurrent model with a class-factored softmax.

Tokens: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+`, then one end. Documents whose crc32(id as text) mod 5 is 1 are held out.
Words are told apart by 64-bit hashes, which meet once in 2 ** 64.

1. Counts of all training tokens: summed within each task, then by a shuffle, into a table that grows with the corpus.
2. Classes: the HEAD most frequent tokens in classes of CLASS each; all others by their spelling, KINDS classes. A word of a
   spelling class has its share of the class's training tokens, smoothed, with one place for all unseen words.
3. The model reads every training document as a whole, by truncated backpropagation, in each shard from the same start; the
   shards' weights are averaged by their tokens. Its biases start from the counts. A shard has about SHARD tokens: its
   documents are dealt and sorted by a hash of text and id, and sums run in a fixed order, so that no score depends on
   how the table lay in partitions.
4. Scores: the state is carried to the end of each document. Counts of the FAST most frequent words are broadcast, all
   others joined by shuffle. The probability of a document is an even mixture of the network's and that of the counts alone
   (the base), so that no document scores more than log10(2) below its base.

Defined results: a null text is empty, one end token. A null id is kept in training. Repeated rows count and score each. With no
training document, counts are 0 and every document still has scores. Other columns aren't looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .gru import Gru
from .shingles import AT_ONCE, U, _runs, slices, word_hashes

HEAD, CLASS, FAST = 512, 32, 100_000
#: State size, steps of a window, lanes at most, learning rate, tokens that a task reads at a time.
HIDDEN, WINDOW, WIDE, RATE, CHUNK = 12, 16, 384, 0.01, 1_000_000
#: Training tokens of a shard.
SHARD = 2_000_000
#: Distinct words a task sums before it hands them on.
HELD = 1_500_000
END = U(0x5851F42D4C957F2D)
#: Classes by spelling: 16 kinds of last letter, with or without a sign after it.
KINDS = 32
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_LAST = np.full(256, 14, np.uint8)
_LAST[_SIGN] = 15
_LAST[48:58] = 13
for _c in range(26):
    _LAST[97 + _c] = _LAST[65 + _c] = _c // 2


def tokens(texts: list[bytes | None]):
    """For runs of texts: first, end, each text's number of tokens, all tokens' hashes and spelling kinds in order."""
    for a, z in _runs(texts):
        some = [t or b"" for t in texts[a:z]]
        parts = []
        if len(some) == 1 and len(some[0]) > AT_ONCE:
            text, at = some[0], 0
            while at < len(text):
                to = min(len(text), at + AT_ONCE)
                while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
                    to += 1
                parts.append(_read(text[at:to])[1:])
                at = to
            h, kind = (np.concatenate(x) for x in zip(*parts))
            doc = np.zeros(len(h), np.int64)
        else:
            start, h, kind = _read(b" ".join(some))
            doc = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in some)]), start, "right") - 1
        n = np.bincount(doc, minlength=len(some))
        ends = np.cumsum(n)
        yield a, z, n + 1, np.insert(h, ends, END), np.insert(kind, ends, 0)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end, h = word_hashes(data)
    b = np.frombuffer(data, np.uint8)
    if not len(start):
        return start, h, np.empty(0, np.uint8)
    sign = _SIGN[b[end - 1]]
    last = b[np.maximum(end - 1 - sign, start)]
    return start, h, _LAST[last] * 2 + sign


def counted(rows: DataFrame) -> DataFrame:
    """h, kind, c: the number of each token in rows (text)."""

    def run(batches):
        held, n = [], 0

        def summed(parts):
            h, kind, c = (np.concatenate(x) for x in zip(*parts))
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
            return h, kind[first], np.bincount(back, c).astype(np.int64)

        def rows_of(part):
            h, kind, c = part
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(kind[i : i + 100_000].astype(np.int32)), pa.array(c[i : i + 100_000])], ["h", "kind", "c"])

        for b in (x for batch in batches for x in slices(batch)):
            for _, _, _, h, kind in tokens(b.column(0).cast(pa.binary()).to_pylist()):
                held.append(summed([(h, kind, np.ones(len(h)))]))
                n += len(held[-1][0])
                if n > 2 * HELD:
                    held = [summed(held)]
                    n = len(held[0][0])
                    if n > HELD:
                        yield from rows_of(held[0])
                        held, n = [], 0
        if held:
            yield from rows_of(summed(held))

    return rows.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c"))


class Model:
    """What all tasks share: head words, the fast counts, each spelling class's sums, and the network."""

    def __init__(self, top: tuple[np.ndarray, np.ndarray, np.ndarray], kinds: dict[int, tuple[int, int]], total: int, distinct: int):
        h, kind, c = top
        order = np.argsort(h.view(U))
        self.fast, self.fast_count = h.view(U)[order], c[order]
        k = min(HEAD, len(h))
        self.n_head = k
        self.head_word = np.argsort(h[:k].view(U))
        self.head = h[:k].view(U)[self.head_word]
        self.class_of = np.arange(k) // CLASS
        self.head_classes = -(-k // CLASS)
        sums = np.zeros((KINDS, 2))
        for i, pair in kinds.items():
            sums[i] = pair
        np.subtract.at(sums, kind[:k], np.stack([c[:k], np.ones(k)], axis=1))
        self.places = np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1))
        by_class = np.concatenate([np.bincount(self.class_of, c[:k], self.head_classes) if k else np.empty(0), sums[:, 0]])
        self.total, self.distinct, self.weights = total, distinct, None
        self.class_bias, self.word_bias = np.log(by_class + 1.0), np.log(c[:k] + 0.5)

    def network(self) -> Gru:
        g = Gru(self.n_head + KINDS, self.class_of, self.class_bias, self.word_bias, HIDDEN)
        if self.weights is not None:
            g.load(self.weights)
        return g

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place among the fast words, or -1."""
        return _found(self.fast, h)

    def coded(self, size: np.ndarray, h: np.ndarray, kind: np.ndarray):
        """Class, head word (or -1), and the token read before it. Head words are few, so they are looked up by themselves."""
        kind = kind.astype(np.int64)
        at = _found(self.head, h)
        word = np.where(at >= 0, self.head_word[at], -1) if self.n_head else at
        cls = np.where(word >= 0, self.class_of[word] if self.n_head else 0, self.head_classes + kind)
        read = np.empty(len(h), np.int64)
        read[1:] = np.where(word >= 0, word, self.n_head + kind)[:-1]
        read[np.cumsum(size) - size] = self.n_head + KINDS
        return cls, word, read


def _found(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each h in an ascending array, or -1."""
    if not len(sorted_):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[at] == h, at, -1)


def _chunks(batches, columns: int):
    """Runs of documents of about CHUNK tokens: their rows of the first columns, numbers of tokens, hashes, kinds."""
    rows, parts, n = [], [], 0
    for b in (x for batch in batches for x in slices(batch)):
        for a, z, size, h, kind in tokens(b.column(columns).cast(pa.binary()).to_pylist()):
            rows.append(b.slice(a, z - a).select(list(range(columns))))
            parts.append((size, h, kind))
            n += len(h)
            if n >= CHUNK:
                yield rows, *(np.concatenate(x) for x in zip(*parts))
                rows, parts, n = [], [], 0
    if parts:
        yield rows, *(np.concatenate(x) for x in zip(*parts))


def trained(rows: DataFrame, model: Model) -> np.ndarray | None:
    """Weights after each shard's training documents have been read, averaged by tokens: summed in 16 tasks, and those sums here."""
    told = rows.sparkSession.sparkContext.broadcast(model)
    shards = max(1, round(model.total / SHARD))

    def run(batches):
        net, seen = told.value.network(), 0
        for of, size, h, kind in _chunks(batches, 1):
            shard = of[0].column(0)[0].as_py()
            cls, word, read = told.value.coded(size, h, kind)
            net.run(size, read, cls, word, int(np.clip(len(h) // (WINDOW * 200), 8, WIDE)), WINDOW, RATE)
            seen += len(h)
        if seen:
            w = (net.flat().astype(np.float64) * seen).tobytes()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": [seen], "w": pa.array([w], pa.binary())})

    def added(batches):
        n, w, part = 0, None, 0
        for b in batches:
            part = b.column(0)[0].as_py() % 16
            for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                n, w = n + k, np.frombuffer(x) if w is None else w + np.frombuffer(x)
        if w is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n], "w": pa.array([w.tobytes()], pa.binary())})

    place = F.xxhash64("text", "id")
    dealt = rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), "text", place.alias("place"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("place").select("shard", "text")
    read = dealt.mapInArrow(run, "shard int, n long, w binary").repartitionById(16, F.pmod("shard", F.lit(16)).cast("int")).sortWithinPartitions("shard")
    sums = sorted(read.mapInArrow(added, "part int, n long, w binary").collect(), key=lambda r: r["part"])
    return sum(np.frombuffer(r["w"]) for r in sums) / sum(r["n"] for r in sums) if sums else None


def scored(rows: DataFrame, model: Model, kind_of_id: str) -> DataFrame:
    """Rows of documents (n, id, held_out, n_tokens, n_known, sum of log10(c + 0.5) of fast words, score but for slow words) and rows (n, h) of slow words."""
    told = rows.sparkSession.sparkContext.broadcast(model)
    names = ["n", "id", "held_out", "n_tokens", "n_known", "counts", "score", "h"]

    def run(batches):
        m = told.value
        net = m.network()
        for docs, size, h, kind in _chunks(batches, 3):
            at, (cls, word, read) = m.look_up(h), m.coded(size, h, kind)
            logs = net.run(size, read, cls, word, WIDE, 4 * WINDOW) / np.log(10)
            of = np.repeat(np.arange(len(size)), size)
            fast, rest = at >= 0, word < 0
            count = np.where(fast, np.log10(m.fast_count[at] + 0.5), 0.0) if len(m.fast) else np.zeros(len(h))
            own = logs + np.where(rest, count - m.places[kind], 0.0)
            total = lambda x: np.bincount(of, x, len(size))
            table = pa.Table.from_batches(docs).combine_chunks()
            n = table.column(0).combine_chunks()
            k = len(size)
            yield pa.RecordBatch.from_arrays([n, *(table.column(c).combine_chunks() for c in (1, 2)), pa.array(size), pa.array(total(fast).astype(np.int64)), pa.array(total(count)), pa.array(total(own)), pa.nulls(k, pa.int64())], names)
            slow = np.flatnonzero(~fast)
            for i in range(0, len(slow), 100_000):
                s = slow[i : i + 100_000]
                none = [pa.nulls(len(s), t) for t in (table.column(1).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(n.to_numpy()[of[s]]), *none, pa.array(h[s].view(np.int64))], names)

    return rows.mapInArrow(run, f"n long, id {kind_of_id}, held_out boolean, n_tokens long, n_known long, counts double, score double, h long")


def fitted(rows: DataFrame, counts: DataFrame) -> Model:
    train = rows.where(~F.col("held_out"))
    sums = {r["kind"]: (r["c"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}  # KINDS rows
    top = counts.orderBy(F.desc("c"), "h").limit(FAST).toArrow()
    columns = [top.column(c).to_numpy() for c in ("h", "kind", "c")]
    model = Model(tuple(columns), sums, sum(c for c, _ in sums.values()), sum(v for _, v in sums.values()))
    model.weights = trained(train, model)
    return model


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 1, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), out.alias("held_out"), F.col(text_col).alias("text"))
    counts = shared.keep(counted(rows.where(~F.col("held_out"))), "counts")
    model = fitted(rows, counts)
    found = shared.keep(scored(rows, model, rows.schema["id"].dataType.simpleString()), "scored")
    slow = found.where("h IS NOT NULL").select("n", "h").join(counts.select("h", "c"), "h", "left")
    slow = slow.groupBy("n").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.count("c").alias("known"))
    every = found.where("h IS NULL").drop("h").join(slow, "n", "left")
    more = F.coalesce("more", F.lit(0.0))
    places = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    base, own = F.col("counts") + more - F.col("n_tokens") * places, F.col("score") + more
    mixed = F.greatest(base, own) + F.log10((1 + F.pow(F.lit(10.0), -F.abs(base - own))) / 2)
    return every.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), mixed.alias("score"),
    )


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
