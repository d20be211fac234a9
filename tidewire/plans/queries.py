"""Named queries over the sample tables, each with the same in SQL where SQL can say it.

A query is a function of (spark, folder of tables). Columns have the same names and types on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import operators as op
from ..functions.text import NOISE
from ..lineage import cut, scratch
from ..operators.keywords import STOP_WORDS
from ..operators.preprocess import SENTIMENT_COLUMNS
from ..sources import conform, from_tables, read_articles
from ..sources.articles import NULL_TOKENS
from ..streaming import latest, narratives, read_event_stream, run_to_files, run_to_tables, tumbling_volumes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What counts as a conversion in the sample queries.
KEYWORDS, TAGS, PUBLICATIONS, QUANTILE = ["tionthe", "EREN"], ["Ring"], ["SRC3", "src7"], 0.5
#: Orders that two parts or suppliers share, at least, to be linked.
SHARED_ORDERS = 2

# Parts of the SQL side: the articles, and their cleaned text.
_ARTICLES = """
raw AS (
  SELECT d.doc_id AS ord, CAST(d.doc_id AS VARCHAR) AS article_id, d.source AS publication, CAST(e.ts AS DATE) AS day, d.lang AS country, CAST(e.user_id AS VARCHAR) AS author, NULL AS link,
    split_part(d.text, chr(10), 1) AS headline, d.text AS text, p.p_type AS source_type, replace(p.p_name, ' ', ', ') AS tags,
    CASE WHEN d.doc_id % 10 = 3 THEN 'n/a' ELSE CAST(d.n_chars AS VARCHAR) END AS circulation, e.event_type AS channel,
    CASE WHEN l.quality = 1 THEN 'Positive' WHEN l.quality = 0 THEN ' negative ' END AS ph,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.toxic = 0 THEN 'neutral' END AS wh
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN part p ON p.p_partkey = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
), art AS (
  SELECT *, CAST(date_trunc('week', day) AS DATE) AS week, CAST(date_trunc('month', day) AS DATE) AS month,
    trim(regexp_replace(regexp_replace(text, '{noise}', ' ', 'g'), '\\s+', ' ', 'g')) AS text_clean,
    trim(regexp_replace(regexp_replace(headline, '{noise}', ' ', 'g'), '\\s+', ' ', 'g')) AS headline_clean,
    list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '') AS tags_list,
    TRY_CAST(circulation AS DOUBLE) AS circ,
    CASE lower(trim(ph)) WHEN 'positive' THEN 1.0::DOUBLE WHEN 'neutral' THEN 0.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE END AS ph_num,
    CASE lower(trim(wh)) WHEN 'positive' THEN 1.0::DOUBLE WHEN 'neutral' THEN 0.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE END AS wh_num
  FROM raw
), a AS (
  SELECT *, CASE WHEN coalesce(ph_num, wh_num) > 0.05 THEN 'Positive' WHEN coalesce(ph_num, wh_num) < -0.05 THEN 'Negative' ELSE 'Neutral' END AS bin FROM art
)
""".replace("{noise}", NOISE).replace("\\\\s", "\\s")
_FLAGGED = f"""
, q AS (SELECT quantile_cont(circ, {QUANTILE}) AS q FROM a), c AS (
  SELECT a.*, CASE WHEN (contains(lower(headline_clean), 'tionthe') OR contains(lower(text_clean), 'tionthe') OR contains(lower(headline_clean), 'eren') OR contains(lower(text_clean), 'eren')
      OR list_contains(list_transform(coalesce(tags_list, []), lambda x: lower(x)), 'ring') OR coalesce(lower(publication) IN ('src3', 'src7'), false)) AND coalesce(circ >= q, false) THEN 1 ELSE 0 END AS conversion
  FROM a, q
)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def articles(spark: SparkSession, sf: str) -> DataFrame:
    return op.preprocess(from_tables(spark, sf))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return op.derive_conversion_flag(articles(spark, sf), KEYWORDS, TAGS, PUBLICATIONS, QUANTILE)


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("null_profile", f"WITH {_ARTICLES} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 'string' AS type, count({s}) AS non_null, count(*) - count({s}) AS nulls FROM a" for c, s in {
    "ARTICLE_ID": "article_id", "PUBLICATION": "publication", "LOAD_DATE": "day", "COUNTRY": "country", "HEADLINE": "headline", "ARTICLE TEXT": "text", "AUTHOR": "author", "LINK": "link", "SOURCE TYPE": "source_type",
    "TAGS": "tags", "CIRCULATION SIZE": "circulation", "CHANNEL": "channel", "Public Health SENTIMENT": "ph", "World Health Leadership SENTIMENT": "wh"}.items()))
def _(spark, sf):
    return op.null_profile(from_tables(spark, sf).drop("_ord"))


@query("csv_articles", f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS article_id, replace(text, chr(13), '') AS text, source, n_chars, doc_id FROM documents)
SELECT article_id, md5(CASE WHEN text NOT IN ({', '.join(f"'{t}'" for t in NULL_TOKENS)}) THEN text END) AS text_md5, source AS publication, CASE WHEN doc_id % 10 <> 3 THEN CAST(n_chars AS DOUBLE) END AS circulation FROM d""")
def _(spark, sf):
    """The articles, written as a CSV export and read again; carriage returns within quotes aren't told from line feeds by readers."""
    folder = scratch(spark, "csv")
    given = from_tables(spark, sf).drop("_ord").withColumn("ARTICLE TEXT", F.replace("ARTICLE TEXT", F.lit("\r"), F.lit("")))
    given.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    read = conform(read_articles(spark, folder))
    return read.select(F.col("ARTICLE_ID").alias("article_id"), F.md5("`ARTICLE TEXT`").alias("text_md5"), F.col("PUBLICATION").alias("publication"), fn.to_number(F.col("`CIRCULATION SIZE`")).alias("circulation"))


@query("preview", "SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS publication FROM documents ORDER BY doc_id LIMIT 5")
def _(spark, sf):
    return op.preview(from_tables(spark, sf)).select(F.col("ARTICLE_ID").alias("article_id"), F.col("PUBLICATION").alias("publication"))


@query("preprocess_core", f"""WITH {_ARTICLES} SELECT article_id, day, week, month, md5(text_clean) AS text_md5, md5(headline_clean) AS headline_md5, coalesce(array_to_string(tags_list, '|'), '') AS tags, circ,
  ph_num, wh_num, coalesce(ph_num, wh_num) AS overall, bin, CAST(len(list_filter(string_split(text_clean, ' '), lambda x: x <> '')) AS INTEGER) AS words, CAST(length(text_clean) AS INTEGER) AS chars FROM a""")
def _(spark, sf):
    a = articles(spark, sf)
    ph, wh = (F.col(f"`{c}__num`") for c in SENTIMENT_COLUMNS)
    return a.select(
        F.col("ARTICLE_ID").alias("article_id"), F.col("DAY").alias("day"), F.col("WEEK").alias("week"), F.col("MONTH").alias("month"), F.md5("ARTICLE_TEXT_CLEAN").alias("text_md5"),
        F.md5("HEADLINE_CLEAN").alias("headline_md5"), F.array_join("TAGS_LIST", "|").alias("tags"), F.col("CIRCULATION_SIZE_NUM").alias("circ"), ph.alias("ph_num"), wh.alias("wh_num"),
        F.col("SENT_OVERALL_NUM").alias("overall"), F.col("SENT_OVERALL_BIN").alias("bin"), F.col("WORD_LEN").alias("words"), F.col("CHAR_LEN").alias("chars"),
    )


@query("dedup_first", "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, sf):
    d = op.dedup_first(_read(spark, sf, "documents"), "text", "doc_id")
    return d.select(F.md5("text").alias("text_md5"), "doc_id")


@query("remove_empty", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def _(spark, sf):
    joined = _read(spark, sf, "documents").select("doc_id").join(_read(spark, sf, "labels"), "doc_id", "left").withColumn("empty", F.lit(None).cast("string"))
    return op.remove_empty_columns(op.remove_empty_rows(joined, but=("doc_id",)), but=("doc_id",))


@query("clean_text", f"WITH {_ARTICLES} SELECT article_id, text_clean, CAST(length(text_clean) AS INTEGER) AS chars FROM a")
def _(spark, sf):
    d = _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("article_id"), fn.clean_text(F.col("text")).alias("text_clean"))
    return d.withColumn("chars", F.length("text_clean"))


@query("repair_text", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'café ' || doc_id WHEN 1 THEN 'a & b "' || doc_id || '"' WHEN 2 THEN 'it''s ' || doc_id ELSE 'ok ' || doc_id END AS text FROM documents""")
def _(spark, sf):
    n = F.col("doc_id").cast("string")
    said = F.array(F.concat(F.lit("caf\u00c3\u00a9 "), n), F.concat(F.lit("a &amp; b \u201c"), n, F.lit("\u201d")), F.concat(F.lit("it\u2019s "), n, F.lit("\U0001f600")), F.concat(F.lit("ok \u2600\ufe0f"), n))
    return _read(spark, sf, "documents").select("doc_id", fn.clean_text(F.get(said, (F.col("doc_id") % 4).cast("int"))).alias("text"))


@query("parse_date", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month FROM events")
def _(spark, sf):
    formats = ["yyyy-MM-dd", "M/d/yyyy", "d MMMM yyyy", "MMM d, yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss"]
    said = F.element_at(F.array(*[F.date_format("ts", f) for f in formats]), (F.col("event_id") % len(formats) + 1).cast("int"))
    d = _read(spark, sf, "events").select("event_id", fn.parse_date(said).alias("day"))
    return d.select("event_id", "day", fn.week_start(F.col("day")).alias("week"), fn.month_start(F.col("day")).alias("month"))


@query("split_tags", "SELECT p_partkey, list_filter(list_transform(string_split(' ' || replace(p_name, ' ', ' ,, ') || ',', ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part")
def _(spark, sf):
    said = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" ,, ")), F.lit(","))
    return _read(spark, sf, "part").select("p_partkey", fn.split_tags(said).alias("tags"))


@query("sentiment_scores", f"WITH {_ARTICLES} SELECT article_id, ph_num, wh_num, coalesce(ph_num, wh_num) AS overall, bin FROM a")
def _(spark, sf):
    a = from_tables(spark, sf)
    ph, wh = (fn.sentiment_score(F.col(f"`{c}`")) for c in SENTIMENT_COLUMNS)
    a = a.select(F.col("ARTICLE_ID").alias("article_id"), ph.alias("ph_num"), wh.alias("wh_num")).withColumn("overall", fn.overall_sentiment(F.col("ph_num"), F.col("wh_num")))
    return a.withColumn("bin", fn.sentiment_bin(F.col("overall")))


@query("to_number", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CAST(n_chars AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN n_chars + 0.5::DOUBLE WHEN 3 THEN NULL ELSE -CAST(n_chars AS DOUBLE) END AS number FROM documents""")
def _(spark, sf):
    n = F.col("n_chars").cast("string")
    said = F.element_at(F.array(n, F.concat(F.lit("1,"), n), F.concat(F.lit(" "), n, F.lit(".5 ")), F.concat(n, F.lit("d")), F.concat(F.lit("-"), n)), (F.col("doc_id") % 5 + 1).cast("int"))
    return _read(spark, sf, "documents").select("doc_id", fn.to_number(said).alias("number"))


@query("normalize_source", "SELECT doc_id, CASE source WHEN 'src1' THEN 'source one' ELSE source END AS source FROM documents")
def _(spark, sf):
    said = F.concat(F.lit(" HTTPS://www."), F.upper("source"), F.lit("/ "))
    return _read(spark, sf, "documents").select("doc_id", fn.normalize_source(said, {"src1": "source one"}).alias("source"))


def _count_sql(key: str, name: str, limit: int | None = None, order: str = "count DESC, 1") -> str:
    return f"WITH {_ARTICLES} SELECT {key} AS {name}, count(article_id) AS count FROM a WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


@query("top_publications", _count_sql("publication", "publication", 30))
def _(spark, sf):
    return _renamed(op.top_publications(articles(spark, sf)), "publication", "count")


@query("top_publications_cut", _count_sql("publication", "publication", 7))
def _(spark, sf):
    return _renamed(op.top_publications(articles(spark, sf), 7), "publication", "count")


@query("sources_count_avg_circ", f"WITH {_ARTICLES} SELECT publication, count(article_id) AS articles, round(avg(circ), 6) AS avg_circ FROM a GROUP BY 1")
def _(spark, sf):
    return _renamed(op.sources_count_avg_circ(articles(spark, sf)).withColumn("avg_circ", F.round("avg_circ", 6)), "publication", "articles", "avg_circ")


@query("sources_by_avg_circ", f"WITH {_ARTICLES} SELECT publication, count(article_id) AS articles, round(avg(circ), 6) AS avg_circ FROM a GROUP BY 1 ORDER BY avg(circ) DESC NULLS LAST, 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return _renamed(op.sources_by_avg_circ(articles(spark, sf)).limit(10).withColumn("avg_circ", F.round("avg_circ", 6)), "publication", "articles", "avg_circ")


for _name, _key, _col in (("by_source_type", "SOURCE TYPE", "source_type"), ("by_channel", "CHANNEL", "channel"), ("by_country", "COUNTRY", "country")):

    @query(_name, _count_sql(_col, _col))
    def _(spark, sf, key=_key, col=_col):
        return _renamed(op.count_by(articles(spark, sf), key), col, "count")


for _name, _key in (("volume_daily", "DAY"), ("volume_weekly", "WEEK"), ("volume_monthly", "MONTH")):

    @query(_name, _count_sql(_key.lower(), _key.lower(), order="1"))
    def _(spark, sf, key=_key):
        return _renamed(op.volume(articles(spark, sf), key), key.lower(), "count")


@query("top_tags", f"WITH {_ARTICLES} SELECT tag, count(article_id) AS count FROM (SELECT article_id, unnest(tags_list) AS tag FROM a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, sf):
    return _renamed(op.top_tags(articles(spark, sf)), "tag", "count")


@query("top_tags_cut", f"WITH {_ARTICLES} SELECT tag, count(article_id) AS count FROM (SELECT article_id, unnest(tags_list) AS tag FROM a) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 9")
def _(spark, sf):
    return _renamed(op.top_tags(articles(spark, sf), 9), "tag", "count")


@query("overall_sentiment", f"WITH {_ARTICLES} SELECT bin AS overall_bin, count(*) AS count FROM a GROUP BY 1")
def _(spark, sf):
    return op.overall_sentiment_counts(articles(spark, sf))


@query("sentiment_by_topic", f"""WITH {_ARTICLES}, l AS (SELECT article_id, 'Public Health SENTIMENT' AS topic, ph AS label FROM a UNION ALL SELECT article_id, 'World Health Leadership SENTIMENT', wh FROM a)
SELECT topic, label, count(article_id) AS count FROM l WHERE label IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return op.sentiment_by_topic(articles(spark, sf))


@query("conversion_flag", f"WITH {_ARTICLES} {_FLAGGED} SELECT article_id, conversion FROM c")
def _(spark, sf):
    return flagged(spark, sf).select(F.col("ARTICLE_ID").alias("article_id"), F.col("CONVERSION").alias("conversion"))


#: One rule each, and the quantile beside one: what it asks of the operator, and the same in SQL. Keywords hold characters that are special in patterns.
_RULES = {
    "conversion_by_text": ({"text_keywords": ["and.", "(c)", "a|b"]}, "contains(lower(headline_clean || chr(0) || text_clean), 'and.') OR contains(lower(headline_clean || chr(0) || text_clean), '(c)') OR contains(lower(headline_clean || chr(0) || text_clean), 'a|b')"),
    "conversion_by_tag": ({"tag_includes": TAGS}, "list_contains(list_transform(coalesce(tags_list, []), lambda x: lower(x)), 'ring')"),
    "conversion_by_publication": ({"publication_includes": PUBLICATIONS}, "coalesce(lower(publication) IN ('src3', 'src7'), false)"),
    "conversion_by_circulation": ({"publication_includes": PUBLICATIONS, "min_circulation_quantile": 0.9}, "coalesce(lower(publication) IN ('src3', 'src7') AND circ >= (SELECT quantile_cont(circ, 0.9) FROM a), false)"),
}
for _name, (_rule, _said) in _RULES.items():

    @query(_name, f"WITH {_ARTICLES} SELECT article_id, CASE WHEN {_said} THEN 1 ELSE 0 END AS conversion FROM a")
    def _(spark, sf, rule=_rule):
        return op.derive_conversion_flag(articles(spark, sf), **rule).select(F.col("ARTICLE_ID").alias("article_id"), F.col("CONVERSION").alias("conversion"))


@query("conversion_summary", f"""WITH {_ARTICLES} {_FLAGGED} SELECT 'total_articles' AS metric, CAST(count(*) AS DOUBLE) AS value FROM c UNION ALL SELECT 'conversion_articles', CAST(sum(conversion) AS DOUBLE) FROM c
UNION ALL SELECT 'conversion_rate', CAST(sum(conversion) AS DOUBLE) / count(*) FROM c""")
def _(spark, sf):
    return op.conversion_summary(flagged(spark, sf))


@query("keywords_high_circ", f"""WITH {_ARTICLES} {_FLAGGED}, s AS (SELECT * FROM c WHERE conversion = 1 OR (SELECT sum(conversion) FROM c) = 0), h AS (SELECT quantile_cont(circ, 0.75) AS h FROM s),
k AS (SELECT article_id, list_filter(regexp_extract_all(lower(text_clean), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in STOP_WORDS)}], w)) AS w FROM s, h WHERE circ >= h),
g AS (SELECT article_id, unnest(w) AS term FROM k UNION ALL SELECT article_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM k)
SELECT term, count(*) AS count FROM g GROUP BY 1 HAVING count(DISTINCT article_id) >= 2 AND count(DISTINCT article_id) <= 0.9 * (SELECT count(*) FROM k) ORDER BY 2 DESC, 1 DESC LIMIT 20""")
def _(spark, sf):
    # Three aggregates read these columns: they are made once.
    every = flagged(spark, sf).select("CONVERSION", "CIRCULATION_SIZE_NUM", "ARTICLE_TEXT_CLEAN")
    # Of articles that have converted, if any has, the others' texts aren't needed.
    kept = cut(every.where("CONVERSION = 1"))
    return op.keywords_high_circ_conversion(cut(every) if kept.isEmpty() else kept)


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").where("event_type <> 'purchase'").select(F.col("user_id").alias("journey_id"), F.col("event_id").alias("mention_id"), F.col("event_type").alias("channel"), "ts")


def _purchases(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("journey_id"), "event_id", "ts")


def sample_paths(spark: SparkSession, sf: str) -> DataFrame:
    return op.build_paths(_mentions(spark, sf), _purchases(spark, sf), 7)


_PATHS = """
touch AS (
  SELECT p.event_id, p.user_id, m.event_type, m.ts, m.event_id AS mention_id FROM events p JOIN events m ON m.user_id = p.user_id AND m.ts < p.ts AND m.ts >= p.ts - INTERVAL 7 DAY
  WHERE p.event_type = 'purchase' AND m.event_type <> 'purchase'
), paths AS (
  SELECT event_id, user_id AS journey_id, string_agg(event_type, ' > ' ORDER BY ts, mention_id) AS path, list(event_type ORDER BY ts, mention_id) AS c FROM touch GROUP BY 1, 2
), steps AS (
  SELECT '(start)' AS src, c[1] AS dst FROM paths UNION ALL SELECT c[len(c)], '(conversion)' FROM paths
  UNION ALL SELECT s.a, s.b FROM (SELECT unnest(list_transform(range(1, len(c)), lambda i: {'a': c[i], 'b': c[i + 1]})) AS s FROM paths)
), sums AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM steps GROUP BY 1, 2
), chain AS (SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY src) AS p FROM sums)
"""


@query("build_paths", f"WITH {_PATHS} SELECT event_id, journey_id, path, CAST(len(c) AS INTEGER) AS touches, CAST(1 AS BIGINT) AS conv FROM paths")
def _(spark, sf):
    return sample_paths(spark, sf)


@query("transition_matrix", f"WITH {_PATHS} SELECT src, dst, weight, round(p, 9) AS probability FROM chain")
def _(spark, sf):
    return op.transition_matrix(sample_paths(spark, sf)).withColumn("probability", F.round("probability", 9))


@query("markov_attribution", f"""WITH RECURSIVE {_PATHS}, t AS (SELECT src, dst, p FROM chain UNION ALL SELECT '(conversion)', '(conversion)', 1.0),
gone AS (SELECT DISTINCT src AS channel FROM chain WHERE src <> '(start)' UNION ALL SELECT ''),
it AS (
  SELECT 0 AS k, channel, '(conversion)' AS state, 1.0::DOUBLE AS h FROM gone
  UNION ALL
  SELECT it.k + 1, it.channel, t.src, sum(t.p * it.h) FROM it JOIN t ON t.dst = it.state WHERE it.k < 400 AND t.src <> it.channel GROUP BY 1, 2, 3
), hit AS (SELECT channel, h FROM it WHERE k = 400 AND state = '(start)'),
e AS (SELECT g.channel, 1 - coalesce(hit.h, 0) / (SELECT h FROM hit WHERE channel = '') AS effect FROM gone g LEFT JOIN hit ON hit.channel = g.channel WHERE g.channel <> ''),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM paths)
SELECT channel, n AS total_conversions, round(effect, 6) AS removal_effect, round(n * effect / (SELECT sum(effect) FROM e), 4) AS attribution FROM e, n""")
def _(spark, sf):
    return op.run_attribution_model(sample_paths(spark, sf)).withColumns({"removal_effect": F.round("removal_effect", 6), "attribution": F.round("attribution", 4)})


#: States are the last two channels; a path of one channel has that alone.
_PAIRS = """
states AS (SELECT list_transform(range(1, greatest(len(c) - 1, 1) + 1), lambda i: array_to_string(c[i:i + 1], '>')) AS s FROM paths),
steps2 AS (
  SELECT '(start)' AS src, s[1] AS dst FROM states UNION ALL SELECT s[len(s)], '(conversion)' FROM states
  UNION ALL SELECT x.a, x.b FROM (SELECT unnest(list_transform(range(1, len(s)), lambda i: {'a': s[i], 'b': s[i + 1]})) AS x FROM states)
), chain2 AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM steps2 GROUP BY 1, 2)
"""


@query("markov_attribution_order2", f"""WITH RECURSIVE {_PATHS}, {_PAIRS}, t AS (SELECT src, dst, p FROM chain2 UNION ALL SELECT '(conversion)', '(conversion)', 1.0),
gone AS (SELECT DISTINCT unnest(string_split(src, '>')) AS channel FROM chain2 WHERE src <> '(start)' UNION ALL SELECT ''),
it AS (
  SELECT 0 AS k, channel, '(conversion)' AS state, 1.0::DOUBLE AS h FROM gone
  UNION ALL
  SELECT it.k + 1, it.channel, t.src, sum(t.p * it.h) FROM it JOIN t ON t.dst = it.state WHERE it.k < 400 AND NOT list_contains(string_split(t.src, '>'), it.channel) GROUP BY 1, 2, 3
), hit AS (SELECT channel, h FROM it WHERE k = 400 AND state = '(start)'),
e AS (SELECT g.channel, 1 - coalesce(hit.h, 0) / (SELECT h FROM hit WHERE channel = '') AS effect FROM gone g LEFT JOIN hit ON hit.channel = g.channel WHERE g.channel <> ''),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM paths)
SELECT channel, n AS total_conversions, round(effect, 6) AS removal_effect, round(n * effect / (SELECT sum(effect) FROM e), 4) AS attribution FROM e, n""")
def _(spark, sf):
    return op.run_attribution_model(sample_paths(spark, sf), order=2).withColumns({"removal_effect": F.round("removal_effect", 6), "attribution": F.round("attribution", 4)})


def together(spark: SparkSession, sf: str, key: str, least: int = SHARED_ORDERS) -> DataFrame:
    """Edges between the parts or suppliers that share so many orders."""
    lines = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col(key).cast("string").alias("entities"))
    return op.cooccurrence_edges(lines, least)


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    return together(spark, sf, "l_partkey")


def supplier_edges(spark: SparkSession, sf: str) -> DataFrame:
    return together(spark, sf, "l_suppkey")


def _edges_sql(key: str) -> str:
    return f"""m AS (SELECT DISTINCT l_orderkey AS d, CAST({key} AS VARCHAR) AS e FROM lineitem),
edges AS (SELECT x.e AS src, y.e AS dst, count(*) AS weight FROM m x JOIN m y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= {SHARED_ORDERS}),
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), nodes AS (SELECT DISTINCT a AS node FROM both_ways)
"""


_EDGES = _edges_sql("l_partkey")
#: Levels of the walk from each node; a shortest path may not be longer.
_LEVELS = 16


def _betweenness_sql(both: str, name: str, levels: int = _LEVELS) -> str:
    """Tables ending in `name` (node, degree, betweenness), of the pairs (a, b) of `both`: out level by level, and back."""
    w, c = f"{name}_w", f"{name}_c"
    parts = [f"{w}0 AS (SELECT DISTINCT a AS s, a AS t, 1.0::DOUBLE AS paths FROM {both})"]
    for k in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, t FROM {w}{j}" for j in range(max(0, k - 2), k))
        parts.append(f"{w}{k} AS MATERIALIZED (SELECT w.s, b.b AS t, sum(w.paths) AS paths FROM {w}{k - 1} w JOIN {both} b ON b.a = w.t WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.s = w.s AND z.t = b.b) GROUP BY 1, 2)")
    for k in range(levels, 0, -1):
        given = f"SELECT c.s, b.b AS t, sum((1 + c.x) / c.paths) AS y FROM {c}{k + 1} c JOIN {both} b ON b.a = c.t GROUP BY 1, 2" if k < levels else "SELECT NULL AS s, NULL AS t, 0.0::DOUBLE AS y"
        parts.append(f"{c}{k} AS MATERIALIZED (SELECT w.s, w.t, w.paths, w.paths * coalesce(g.y, 0) AS x FROM {w}{k} w LEFT JOIN ({given}) g ON g.s = w.s AND g.t = w.t)")
    every = " UNION ALL ".join(f"SELECT t, x FROM {c}{k}" for k in range(1, levels + 1))
    parts.append(f"""{name} AS (SELECT g.node, g.degree, CASE WHEN n > 2 THEN coalesce(x.x, 0) / ((n - 1) * (n - 2)) ELSE 0 END AS betweenness FROM (SELECT a AS node, count(*) AS degree FROM {both} GROUP BY 1) g
  LEFT JOIN (SELECT t, sum(x) AS x FROM ({every}) GROUP BY 1) x ON x.t = g.node, (SELECT count(DISTINCT a) AS n FROM {both}))""")
    return ", ".join(parts)


@query("cooccurrence_edges", f"WITH {_EDGES} SELECT src, dst, weight FROM edges")
def _(spark, sf):
    return part_edges(spark, sf)


@query("degree", f"WITH {_EDGES} SELECT a AS node, count(*) AS degree FROM both_ways GROUP BY 1")
def _(spark, sf):
    return op.degrees(part_edges(spark, sf))


# The second by joins whatever its size, so that both forms are held against the same SQL.
for _name, _key, _small in (("network_summary", "l_suppkey", op.SMALL), ("part_network_summary", "l_partkey", 0)):

    @query(_name, f"WITH {_edges_sql(_key)}, {_betweenness_sql('both_ways', 'central')} SELECT node, degree, round(betweenness, 9) AS betweenness FROM central")
    def _(spark, sf, key=_key, small=_small):
        return op.network_summary(cut(together(spark, sf, key)), small).withColumn("betweenness", F.round("betweenness", 9))


_COMPONENTS = f"""WITH RECURSIVE {_EDGES}, r AS (SELECT node AS s, node AS t FROM nodes UNION SELECT r.s, b.b FROM r JOIN both_ways b ON b.a = r.t),
c AS (SELECT s AS node, min(t) AS component FROM r GROUP BY 1)"""


@query("graph_components", f"{_COMPONENTS} SELECT node, component FROM c")
def _(spark, sf):
    return op.components(cut(part_edges(spark, sf)))


@query("largest_component", f"""{_COMPONENTS}, top AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT node, component FROM c WHERE component = (SELECT component FROM top)""")
def _(spark, sf):
    found = op.components(cut(part_edges(spark, sf)))
    top = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return found.join(F.broadcast(top), "component", "left_semi").select("node", "component")


#: The 40 most central suppliers, the largest component among them, its heavier half of edges, and that graph's own figures.
_VIEW = f"""WITH RECURSIVE {_edges_sql("l_suppkey")}, {_betweenness_sql("both_ways", "central")},
top AS (SELECT node FROM (SELECT node, round(betweenness, 12) AS b, degree FROM central) ORDER BY b DESC, degree DESC, node LIMIT 40),
inner_edges AS (SELECT src, dst, weight FROM edges WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)),
near AS (SELECT src AS a, dst AS b FROM inner_edges UNION ALL SELECT dst, src FROM inner_edges),
reach AS (SELECT a AS s, a AS t FROM near UNION SELECT r.s, b.b FROM reach r JOIN near b ON b.a = r.t),
comp AS (SELECT s AS node, min(t) AS component FROM reach GROUP BY 1),
largest AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
held AS (SELECT * FROM inner_edges WHERE src IN (SELECT node FROM comp WHERE component = (SELECT component FROM largest))),
kept AS (SELECT src, dst, weight, 0.6 + ln(1 + weight) AS width FROM held WHERE weight >= (SELECT quantile_cont(weight, 0.5) FROM held)),
shown AS (SELECT src AS a, dst AS b FROM kept UNION ALL SELECT dst, src FROM kept)"""


@query("network_view", f"""{_VIEW}, {_betweenness_sql("shown", "again")}, placed AS (SELECT node, betweenness, row_number() OVER (ORDER BY round(betweenness, 12) DESC, node) AS rank, count(*) OVER () AS n FROM again)
SELECT node, round(betweenness, 9) AS betweenness, CAST(rank AS INTEGER) AS rank, round(CASE WHEN n > 1 THEN 400 + (rank - 1) * 1800.0::DOUBLE / (n - 1) ELSE 400.0 END, 6) AS size, rank <= 12 AS label FROM placed""")
def _(spark, sf):
    edges = cut(supplier_edges(spark, sf))
    return op.network_view(edges, op.network_summary(edges))[0].withColumns({"betweenness": F.round("betweenness", 9), "size": F.round("size", 6)})


@query("network_view_edges", f"{_VIEW} SELECT src, dst, weight, round(width, 9) AS width FROM kept")
def _(spark, sf):
    edges = cut(supplier_edges(spark, sf))
    return op.network_view(edges, op.network_summary(edges))[1].withColumn("width", F.round("width", 9))


@query("text_network")
def _(spark, sf):
    # Texts are dealt before they are cleaned and tagged, as a file of one row group is one task otherwise.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    given = op.preprocess(from_tables(spark, sf).repartition(tasks, "_ord"))
    return op.eda_network(given, sample_n=None, min_cooccurrences=2, chars=None, extractor=op.named_entities())[1]


@query("first_mover", """SELECT user_id AS narrative, first(event_type ORDER BY ts, event_id) AS originator, min(ts) AS first_ts, count(DISTINCT event_type) - 1 AS amplifiers, count(*) AS mentions
FROM events GROUP BY 1""")
def _(spark, sf):
    e = _read(spark, sf, "events").select(F.col("user_id").alias("narrative"), F.col("event_type").alias("actor"), "ts", F.col("event_id").alias("mention_id"))
    return op.first_movers(e, "narrative", "actor")


@query("amplifier_lag", """WITH o AS (SELECT user_id AS narrative, event_type AS actor, count(*) AS mentions, min(ts) AS began FROM events GROUP BY 1, 2)
SELECT narrative, actor, mentions, CAST(epoch_us(began) - epoch_us(min(began) OVER (PARTITION BY narrative)) AS DOUBLE) / 1e6 AS lag_seconds, CAST(row_number() OVER (PARTITION BY narrative ORDER BY began, actor) AS INTEGER) AS place FROM o""")
def _(spark, sf):
    e = _read(spark, sf, "events").select(F.col("user_id").alias("narrative"), F.col("event_type").alias("actor"), "ts")
    return op.amplifier_lags(e, "narrative", "actor")


#: Each mention follows the latest one by another actor in the seven days before it.
_LINKS = """links AS (
  SELECT m.user_id AS narrative, m.event_id AS id, m.event_type AS actor, m.ts, arg_max(p.event_id, (p.ts, p.event_id)) AS parent FROM events m
  LEFT JOIN events p ON p.user_id = m.user_id AND p.event_type <> m.event_type AND (p.ts < m.ts OR p.ts = m.ts AND p.event_id < m.event_id) AND p.ts >= m.ts - INTERVAL 7 DAY GROUP BY ALL
)"""


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(F.col("user_id").alias("narrative"), F.col("event_type").alias("actor"), "ts", F.col("event_id").alias("mention_id"))


@query("predecessors", f"WITH {_LINKS} SELECT narrative, id AS mention_id, coalesce(parent, -1) AS parent FROM links")
def _(spark, sf):
    return op.predecessors(_spread(spark, sf)).select("narrative", "mention_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("cascades", f"""WITH RECURSIVE {_LINKS}, tree AS (SELECT id, id AS root, 0::BIGINT AS depth FROM links WHERE parent IS NULL UNION ALL SELECT l.id, t.root, t.depth + 1 FROM tree t JOIN links l ON l.parent = t.id),
levels AS (SELECT root, depth, count(*) AS n FROM tree GROUP BY ALL), wide AS (SELECT root, max(n) AS breadth FROM levels GROUP BY 1)
SELECT r.narrative, t.root, r.actor AS originator, r.ts AS started, count(*) AS size, max(t.depth) AS depth, any_value(w.breadth) AS breadth, count(DISTINCT l.actor) AS actors
FROM tree t JOIN links l ON l.id = t.id JOIN links r ON r.id = t.root JOIN wide w ON w.root = t.root GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return op.cascades(_spread(spark, sf))


@query("streaming_daily_volume", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def _(spark, sf):
    counts = run_to_tables(tumbling_volumes(read_event_stream(spark, sf)), scratch(spark, "volumes"))
    return counts.select(F.col("start").cast("date").alias("day"), "event_type", "count")


@query("streaming_narratives", """WITH o AS (SELECT user_id AS narrative, event_type AS actor, count(*) AS mentions, min(ts) AS joined, arg_min(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2),
f AS (SELECT *, first_value(actor) OVER (PARTITION BY narrative ORDER BY joined, id) AS originator, min(joined) OVER (PARTITION BY narrative) AS began FROM o)
SELECT narrative, actor, originator, mentions, CAST(epoch_us(joined) - epoch_us(began) AS DOUBLE) / 1e6 AS lag_seconds, CAST(row_number() OVER (PARTITION BY narrative ORDER BY joined, actor) AS INTEGER) AS place FROM f""")
def _(spark, sf):
    e = read_event_stream(spark, sf).select(F.col("user_id").alias("narrative"), F.col("event_type").alias("actor"), F.col("event_id").alias("mention_id"), "ts")
    told = run_to_files(narratives(e), scratch(spark, "narratives"))
    return latest(told).select("narrative", "actor", "originator", "mentions", "lag_seconds", "place")
