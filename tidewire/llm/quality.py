"""Quality rules by host: rule failures of a document, failure rates of its host shrunk by a beta prior, verdicts joined back.

Words are `[^\\x20\\x09-\\x0D]+`. A document fails at once if it has under `min_words` words or if over half of its words lie
in three-word windows that the text holds twice or more. Further rules look at symbols, repeated lines and word length. A
host (`source`) whose failure rate, shrunk towards all hosts' by an empirical beta prior, is over `max_rate` takes all its
documents with it.

Defined results: a null text is as an empty one, without words, and fails. Null hosts are one host of their own. Repeated
rows count each. An empty table gives no rows. Other columns aren't looked at; names of theirs may clash with the results'.
All of it is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Fixed values of the contract: white space, symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Rules of our own: most symbols for each 100 words, most repeated lines for each 100 words, bounds of the mean word length.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 20, 20, (2, 40)
#: A host is rejected when its shrunk failure rate is over this.
MAX_RATE = 0.7
#: Hosts up to this number are broadcast; more are joined by a salted shuffle.
BROADCAST_HOSTS, SALTS = 200_000, 16


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words inside a three-word window that the array holds twice or more: equal windows meet by sorting their hashes with their places."""
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def twice(sorted_windows: Column) -> Column:
        return F.filter(sorted_windows, lambda x, k: ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_windows, k + 1)["h"] == x["h"], F.lit(False)))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
            lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["to"]))).alias("n"), (p + 3).alias("to")), lambda a: a["n"],
        )

    def bound(value: Column, f) -> Column:
        """f(value), with value computed once a row."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    any_twice = bound(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    counted = bound(F.array_sort(windows), lambda s: covered(F.array_sort(F.transform(twice(s), lambda x: x["i"]))))
    return F.when(any_twice, counted).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, id_col: str, text_col: str, host_col: str, carry: bool = False) -> DataFrame:
    """id, host and the five counts of each text; with carry, also the whole row as a struct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"), *more)
    n = lambda c: F.size(c).cast("long")
    counted = F.get(
        F.transform(
            F.array(words(F.col("text"))),
            lambda w: F.struct(n(w).alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")),
        ),
        F.lit(0),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    symbols = F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))
    dup_lines = F.get(F.transform(F.array(lines), lambda x: n(x) - n(F.array_distinct(x))), F.lit(0))
    carried = ["row"] if carry else []
    found = rows.select("id", "host", *carried, counted.alias("c"), symbols.cast("long").alias("n_symbols"), dup_lines.alias("n_dup_lines"))
    return found.select("id", "host", *carried, "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def with_rules(m: DataFrame) -> DataFrame:
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    own = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * n)
        | (F.col("word_chars") < WORD_LENGTH[0] * n) | (F.col("word_chars") > WORD_LENGTH[1] * n)
    )
    return m.withColumns({"base_failed": base, "rule_failed": base | own})


def host_rates(m: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk): a beta prior by moments of the hosts' own rates, one row of sums over all hosts.

    With mean p and variance v of the rates, a + b = p (1 - p) / v - 1, kept between 1 and a thousand."""
    hosts = m.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("p"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.col("p") * (1 - F.col("p")) / F.col("v") - 1))).otherwise(F.lit(1000.0))
    prior = prior.select("p", strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("p") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", shrunk.alias("rate"))  # one row of sums


def join_hosts(rows: DataFrame, hosts: DataFrame, host: str = "host") -> DataFrame:
    """rows with host_rate. The rates are broadcast after a count; beyond the bound each host's rows are dealt over SALTS tasks."""
    hosts = shared.keep(hosts.select(F.col("host").alias("host_"), F.col("rate").alias("host_rate")), "hosts")
    if hosts.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(hosts), F.col(host).eqNullSafe(F.col("host_")), "left").drop("host_")
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = hosts.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, F.col(host).eqNullSafe(F.col("host_")) & (F.col("salt_") == F.col("salt__")), "left").drop("host_", "salt_", "salt__")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: id, host, measures, base_failed, rule_failed, host_rate, kept. Texts are read once; narrow rows are written and read again."""
    m = shared.keep(with_rules(measures(docs, id_col, text_col, host_col)), "measures")
    judged = join_hosts(m, host_rates(m))
    kept = ~F.col("rule_failed") & (F.col("host_rate") <= MAX_RATE)
    return judged.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that verdicts() keeps, with their own columns.

    The rules are found a second time, beside the row itself, so that texts aren't shuffled; the hosts' rates are joined on."""
    m = shared.keep(with_rules(measures(docs, id_col, text_col, host_col)).select("host", "rule_failed"), "measures")
    rows = with_rules(measures(docs, id_col, text_col, host_col, carry=True)).where(~F.col("rule_failed")).select("id", "host", "row")
    return join_hosts(rows, host_rates(m)).where(F.col("host_rate") <= MAX_RATE).select("row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    v = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")
