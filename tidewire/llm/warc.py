"""WARC records of pages, and a Merkle fixity audit of two replicas of them.

A record is its header and the page, as bytes. The records of the first replica stand in order of page id, which gives each a
position and an offset; the second's are aligned with them by page id. A tree's leaves are record digests; a node
covers FANOUT nodes below it, as an ordered range of offsets, and hashes that range with their digests. The audit compares
roots, then only children of nodes that differ, down to the records that are corrupt or missing.

Defined results: a null url or html is empty; pages with a null id stand first. Of rows that share an id, the k-th by digest are
compared. An empty table has no tree and gives no rows. Records that only the second replica has are reported as extra. Other
columns aren't looked at. All of it is Spark expressions; a node gathers FANOUT digests at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FANOUT = 64
#: Every record's WARC-Date: tables hold no crawl time, and a record's bytes must not depend on when it is written.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 resource record, as text."""
    html = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF * 2),
    )
    return F.concat(head, html, F.lit(CRLF * 2))


def read_record(text: Column) -> Column:
    """Struct (url, html) of a record."""
    head = F.substring_index(text, CRLF * 2, 1)
    url = F.substring_index(F.substring_index(head, f"{CRLF}WARC-Date: {DATE}", 1), "WARC-Target-URI: ", -1)
    body = F.substr(text, F.length(head) + 5)
    return F.struct(url.alias("url"), F.substr(body, F.lit(1), F.length(body) - 4).alias("html"))


def hashed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, k (place among rows of one id), size in bytes and digest of each record."""
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(id_col), F.col(url_col), F.col(html_col)).alias("record"))
    rows = rows.select("id", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("digest"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("digest")))


def manifest(records: DataFrame) -> DataFrame:
    """The records with pos and size_before, the offset at which each begins."""
    return shared.keep(shared.ranked(records, [F.col("id").asc_nulls_first(), F.col("k").asc()], "ranges", ("size",)), "manifest")


def _above(nodes: DataFrame) -> DataFrame:
    """The level above: nodes (pos, start, end, digest) -> the same, of FANOUT each."""
    children = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    grouped = nodes.groupBy(F.floor(F.col("pos") / FANOUT).cast("long").alias("pos")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(children, lambda x: x["digest"]), "").alias("below"))
    return grouped.select("pos", "start", "end", F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "below"), 256).alias("digest"))


def tree(leaves: DataFrame, n: int) -> list[DataFrame]:
    """Levels from the leaves (pos, start, end, digest) up to the root."""
    levels = [leaves]
    while n > 1 or len(levels) == 1:
        levels.append(shared.keep(_above(levels[-1]), f"level{len(levels)}"))
        n = -(-n // FANOUT)
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """pos of the leaves that differ; from the root down, only below nodes that differ."""
    found = None
    for x, y in zip(reversed(a), reversed(b)):
        if found is not None:
            up = F.floor(F.col("pos") / FANOUT).cast("long")
            x, y = (t.join(found, up == F.col("up"), "left_semi") for t in (x, y))
        y = y.select(F.col("pos").alias("p"), F.col("digest").alias("d"))
        bad = x.join(y, F.col("pos") == F.col("p")).where(F.col("digest") != F.col("d"))
        found = shared.keep(bad.select(F.col("pos").alias("up")), "differing")
    return found.withColumnRenamed("up", "pos")


def audit(first: DataFrame, second: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each record: id, pos, start, size, digest, replica_digest (where it isn't ok), status: ok, corrupt, missing; extra for those that only second has."""
    listed = manifest(hashed(first, id_col, url_col, html_col))
    other = shared.keep(hashed(second, id_col, url_col, html_col), "replica")
    keys = F.col("id").eqNullSafe(F.col("id_")) & (F.col("k") == F.col("k_"))
    theirs = other.select(F.col("id").alias("id_"), F.col("k").alias("k_"), F.col("digest").alias("replica_digest"), F.col("size").alias("replica_size"))
    start, end = F.col("size_before"), F.col("size_before") + F.col("size")
    leaves = listed.select("pos", start.alias("start"), end.alias("end"), "digest")
    copied = shared.keep(listed.join(theirs, keys, "left").select("pos", start.alias("start"), end.alias("end"), F.coalesce("replica_digest", F.lit("")).alias("digest")), "aligned")
    n = listed.count()
    if n == 0:
        bad = listed.select("pos").limit(0)
    else:
        bad = differing(tree(leaves, n), tree(copied, n))
    located = bad.join(copied.select(F.col("pos").alias("p"), F.col("digest").alias("replica_digest")), F.col("pos") == F.col("p")).select(F.col("pos").alias("bad"), "replica_digest")
    rows = listed.join(located, F.col("pos") == F.col("bad"), "left")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("replica_digest") == "", "missing").otherwise("corrupt")
    rows = rows.select(F.col("id").alias(id_col), "pos", start.alias("start"), "size", "digest", F.nullif("replica_digest", F.lit("")).alias("replica_digest"), status.alias("status"))
    only = theirs.join(listed.select("id", "k"), keys, "left_anti")
    none = F.lit(None).cast("long")
    extra = only.select(F.col("id_").alias(id_col), none.alias("pos"), none.alias("start"), F.col("replica_size").alias("size"), F.lit(None).cast("string").alias("digest"), "replica_digest", F.lit("extra").alias("status"))
    return rows.unionByName(extra)


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults in known places: by the page's md5, one in 256 each has a character altered or its end cut off, or is lost."""
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    html = F.when(mark == "07", F.concat(F.lit("~"), F.substr("html", F.lit(2)))).when(mark == "08", F.substr("html", F.lit(1), F.floor(F.length("html") / 2).cast("int"))).otherwise(F.col("html"))
    return pages.where(mark != "09").withColumn("html", html)


def op4_warc_audit(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


#: The same in DuckDB, without a tree.
SQL = r"""
WITH r AS (
  SELECT page_id, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), b AS (
  SELECT page_id, mark, url, html,
    CASE mark WHEN '07' THEN '~' || substr(html, 2) WHEN '08' THEN substr(html, 1, length(html) // 2) ELSE html END AS other
  FROM r
), h AS (
  SELECT page_id, mark,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
      || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, html, other
  FROM b
), w AS (
  SELECT page_id, mark,
    head || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    head || CAST(strlen(other) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS copy
  FROM h
)
SELECT page_id,
  row_number() OVER (ORDER BY page_id) - 1 AS pos,
  CAST(coalesce(sum(strlen(record)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(strlen(record) AS BIGINT) AS size,
  sha256(record) AS digest,
  CASE WHEN mark <> '09' AND sha256(copy) <> sha256(record) THEN sha256(copy) END AS replica_digest,
  CASE WHEN mark = '09' THEN 'missing' WHEN sha256(copy) <> sha256(record) THEN 'corrupt' ELSE 'ok' END AS status
FROM w
"""
