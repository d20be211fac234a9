"""Fill-in-middle: texts cut at two of their tokens' bounds, and put together with the middle last.

Tokens are those of the tokenizers library's Split pre-tokenizer, runs of A-Z and a-z and single other characters, whose offsets
count code points. It needs no training. A space is a token of its own, so a text is split at its spaces first, each piece's offsets
come from the pre-tokenizer, and a worker remembers how many a piece has; a long piece is cut before characters that aren't
letters. The number of offsets gives n, the offsets of two ranks give prefix, middle and suffix. Everything after that is Spark's:
which form a document takes, its output, and the text rebuilt from it.

    psm  <P>prefix<S>suffix<M>middle
    spm  <S>suffix<P>prefix<M>middle

Defined results: a null text is empty; an empty text and one that holds a control string are plain. A null id counts as no
digits; rows that share an id take the same ranks, each of its own text. An empty table gives no rows. Other columns aren't looked at.
A text of any length is one value; beside it a worker holds its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .shingles import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many change form; of a hundred of these, how many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Characters given to the pre-tokenizer at once; pieces up to KEPT characters are remembered, so many of them.
AT_ONCE, KEPT, REMEMBERED = 50_000, 64, 500_000

_NO_LETTER = re.compile("[^A-Za-z]")


class Offsets:
    """Offsets of the tokens of texts, in code points."""

    def __init__(self):
        self.split = Split(Regex("[A-Za-z]+|[^A-Za-z]"), behavior="isolated")
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> Iterator[np.ndarray]:
        """Starts of the tokens of a piece, a stretch of it at a time; stretches end before characters that aren't letters."""
        at = 0
        while at < len(piece):
            cut = _NO_LETTER.search(piece, at + AT_ONCE)
            to = cut.start() if cut else len(piece)
            yield np.array([start for _, (start, _) in self.split.pre_tokenize_str(piece[at:to])], np.int64) + at
            at = to

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = sum(map(len, self.of(piece)))
            if len(piece) <= KEPT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def cuts(self, text: str, ranks) -> tuple[int, list[int]]:
        """n, and the offsets at which the tokens of the ranks (functions of n, 0 to n) start; n's is the end."""
        pieces = text.split(" ")
        ends = np.cumsum(np.fromiter(map(self.count, pieces), np.int64, len(pieces)) + 1)  # with the space after each
        n = int(ends[-1]) - 1
        return n, [self.start(text, pieces, ends, rank) for rank in ranks(n)]

    def start(self, text: str, pieces: list[str], ends: np.ndarray, rank: int) -> int:
        k = int(np.searchsorted(ends, rank, "right"))
        if k == len(pieces):
            return len(text)
        at = sum(map(len, pieces[:k])) + k
        left = rank - (int(ends[k - 1]) if k else 0)
        for starts in self.of(pieces[k]):
            if left < len(starts):
                return at + int(starts[left])
            left -= len(starts)
        return at + len(pieces[k])


def draws(id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits of an id: the first groups of the digest of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars (null if plain), output: a row for each document. One pass without a shuffle."""
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))

    def run(batches):
        offsets = Offsets()
        for b in (x for batch in batches for x in slices(batch)):
            made = [offsets.cuts(t, lambda n, r=r: sorted(x % (n + 1) for x in r)) for t, *r in zip(b["text"].to_pylist(), b["h1"].to_pylist(), b["h2"].to_pylist())]
            found = [pa.array([n for n, _ in made], pa.int64()), *[pa.array([cuts[k] for _, cuts in made], pa.int64()) for k in range(2)]]
            yield pa.RecordBatch.from_arrays([b["id"], b["text"], b["h3"], b["h4"], *found], ["id", "text", "h3", "h4", "n", "first", "second"])

    kind = rows.schema["id"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"id {kind}, text string, h3 long, h4 long, n long, first long, second long")
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("h3") % 100 >= rate)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    part = lambda a, z: F.substr("text", (F.lit(a) if isinstance(a, int) else F.col(a)).cast("int") + 1, (z - (F.lit(a) if isinstance(a, int) else F.col(a))).cast("int"))
    prefix, middle, suffix = part(0, F.col("first")), part("first", F.col("second")), part("second", F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    told = F.col("form") != "plain"
    return cut.select(
        F.col("id").alias(id_col), "n", "form", F.when(told, F.col("first")).alias("prefix_chars"), F.when(told, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, by its control strings alone: no part of a text holds one, and none can begin in a part and end in another."""
    between = lambda a, z: F.substring_index(F.substr(output, F.instr(output, a) + len(a)), z, 1)
    middle = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same in DuckDB: tokens as a list, parts joined from its slices.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens FROM documents
), h AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
