"""Ranked lexical search: postings dealt into buckets of terms, joined with the items' terms, summed by item and document.

Terms are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. Postings (term, document, occurrences, the
document's length) are made where a text is read, of the items' terms alone where these are few enough to be sent to every
task, and written into a folder for each bucket of terms. A search reads the buckets that its terms fall into. A bucket that a very frequent term
makes large is split over tasks, in writing and in reading. A match's score is an integer; it is the same for all items, so it
is found once for a posting. Postings then meet by document, the items' terms join them there, and sums by item and document
and each task's best documents of an item need no further exchange.

Defined results: a null text has no terms. Rows that share a document id are documents of their own, and those of equal score
may have equal ranks exchanged; null ids stand last among equal scores. Rows that share an item id are one item with all their
terms; a null item id is an item. Items without a match have no row, an empty table gives none. Other columns aren't looked at.
A worker holds the terms of one text at a time.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .shingles import slices

BUCKETS = 16
#: Bytes of terms and item numbers that are sent to every task, counted before; beyond that they join by shuffle.
BROADCAST_BYTES = 32_000_000
K1_TENTHS, SCALE, B_HUNDREDTHS = 8, 1_000_000_000, 90

#: What a byte becomes before white space cuts the words: a space, unless it belongs to a term.
_BYTE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTE).split()


def counted(rows: DataFrame, wanted: frozenset | None = None) -> DataFrame:
    """row, id, n, term, tf of rows (row, id, text): a row for each term of `wanted` (None: all) in a text, and one with a null term for a text with any term."""
    kind = rows.schema["id"].dataType.simpleString()
    told = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        only = told.value if told else None
        for b in (x for batch in batches for x in slices(batch)):
            at, lengths, words, times = [], [], [], []
            for i, text in enumerate(b["text"].cast(pa.binary())):
                found = terms(text.as_py())
                if not found:
                    continue
                count = Counter(found)
                some = count.keys() if only is None else count.keys() & only
                words += [None, *some]
                times += [0, *(count[w] for w in some)]
                at += [i] * (len(some) + 1)
                lengths += [len(found)] * (len(some) + 1)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b["row"].take(at), b["id"].take(at), pa.array(lengths, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["row", "id", "n", "term", "tf"])

    return rows.mapInArrow(run, f"row long, id {kind}, n long, term string, tf long")


def _bucket(buckets: int) -> Column:
    return F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: frozenset | None = None, buckets: int = BUCKETS) -> DataFrame:
    """bucket, term, row, id, n, tf, written once: a folder for each bucket, in it term by term. Null terms, a row for each document with terms, are bucket -1."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = counted(rows, wanted).withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    return shared.keep(dealt.sortWithinPartitions("bucket", "term"), "postings", "bucket")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: once each."""
    rows = items.select(F.lit(0).cast("long").alias("row"), F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    return shared.keep(counted(rows).where("term IS NOT NULL").select(F.col("id").alias("item"), "term").distinct(), "item-terms")


def few(asked: DataFrame) -> bool:
    """Whether the items' terms may be sent to every task."""
    return (asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= BROADCAST_BYTES


def weights(index: DataFrame, asked: DataFrame, totals: DataFrame) -> DataFrame:
    """term, w, and the sums docs_ and terms_ of all documents: of the asked terms that some document holds, by the number of documents that do."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.log((2 * F.col("docs_") + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = asked.select("term").distinct()
    held = df.join(F.broadcast(terms) if few(asked) else terms, "term", "left_semi")
    return held.crossJoin(F.broadcast(totals)).select("term", w.alias("w"), "docs_", "terms_")  # one row of sums


def search(index: DataFrame, asked: DataFrame, k: int = 10, buckets: int = BUCKETS) -> DataFrame:
    """item, rank, id, score: each item's k best documents of postings()."""
    small = few(asked)
    told = F.broadcast if small else lambda df: df
    totals = index.where("bucket = -1").agg(F.count(F.lit(1)).alias("docs_"), F.sum("n").alias("terms_"))
    read = [r["b"] for r in asked.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most as many as buckets
    index = index.where(F.col("bucket").isin(read))
    w = shared.keep(weights(index, asked, totals), "weights")
    m = F.expr(f"{100 - B_HUNDREDTHS} + ({B_HUNDREDTHS} * n * docs_) div terms_")
    score = F.expr(f"w * (({SCALE} * tf) div (1000 * tf + {K1_TENTHS} * m))")
    scored = index.join(told(w), "term").withColumn("m", m).select("term", "row", "id", score.alias("score")).where("score > 0")
    matches = (scored.repartition("row") if small else scored).join(told(asked), "term")
    sums = matches.groupBy("item", "row", "id").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, highest first; those with a score above 0."""
    asked = item_terms(items, item_col, item_text_col)
    wanted = frozenset(r["term"].encode() for r in asked.select("term").distinct().toLocalIterator()) if few(asked) else None  # at most BROADCAST_BYTES
    index = postings(docs, id_col, text_col, wanted)
    return search(index, asked, k).withColumnsRenamed({"item": item_col, "id": id_col})


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), l AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
), t AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM l
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, t GROUP BY term, N_
), s AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * N_) // L_)))) AS score FROM p JOIN w USING (term) JOIN l USING (doc_id), t
), a AS (SELECT item_id, doc_id, CAST(sum(score) AS BIGINT) AS score FROM s JOIN i USING (term) GROUP BY ALL HAVING sum(score) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 10
"""
