"""Chat formatting, relationally: turns of a conversation sorted as an array of structs, adjacent turns of one role merged, all joined up.

    <turn>ROLE
    TEXT<next>TEXT</turn>

A block holds the turns of one role that follow each other. In texts and roles `&` is written `&amp;` and `<` is written
`&lt;`, so no text holds a control string, and reading back is exact; a line feed in a role is written `&#10;`. The loss mask has
a stretch for each turn's segment of the output, as `<next>` and `</turn>` cut it: all of an assistant's text, nothing of
others'. A conversation becomes one value, as long as its turns together.

Defined results: a null text or role is empty; turns stand by number, null first, then by role and text; repeated rows are
turns each. A null conversation id is one conversation. An empty table gives no rows. Other columns aren't looked at.
All of it is Spark expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, NEXT, END = "<turn>", "<next>", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id, formatted, loss (array of start, end within each segment)."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = turns.select(F.col(conv_col).alias("id"), one.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A block begins where the role isn't the one before; its texts are those of the turns up to the next block.
    changes = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    rows = rows.select("id", "turns", changes.alias("begins"))
    texts = lambda i, k: F.slice("turns", i + 1, F.coalesce(F.get("begins", k + 1), F.size("turns")) - i)["text"]
    rows = rows.select("id", F.transform("begins", lambda i, k: F.struct(F.get("turns", i)["role"].alias("role"), texts(i, k).alias("texts"))).alias("blocks"))
    said = lambda b: F.struct(
        F.concat(F.lit(BEGIN), F.replace(escaped(b["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"), F.transform(b["texts"], escaped).alias("bodies"), (b["role"] == LOSS_ROLE).alias("loss")
    )
    rows = rows.select("id", F.transform("blocks", said).alias("blocks"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["bodies"], NEXT), F.lit(END))), "")

    def stretches(b: Column) -> Column:
        begin = lambda k: F.when(b["loss"] & (k == 0), F.length(b["head"])).otherwise(0)
        return F.transform(b["bodies"], lambda x, k: F.struct(begin(k).alias("start"), (begin(k) + F.when(b["loss"], F.length(x)).otherwise(0)).alias("end")))

    return rows.select(F.col("id").alias(conv_col), formatted.alias("formatted"), F.flatten(F.transform("blocks", stretches)).alias("loss"))


def _blocks(formatted: Column) -> Column:
    cut = F.split(formatted, END)
    return F.slice(cut, F.lit(1), F.size(cut) - 1)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""

    def turns(block: Column) -> Column:
        raw = F.substr(F.substring_index(block, "\n", 1), F.lit(len(BEGIN) + 1))
        texts = F.split(F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2), NEXT)
        role = F.array(unescaped(F.replace(raw, F.lit("&#10;"), F.lit("\n"))))  # found once for a block
        return F.get(F.transform(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescaped(x).alias("text")))), F.lit(0))

    return F.flatten(F.transform(_blocks(formatted), turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Array of the texts under the mask, of segments with any."""
    segments = F.flatten(F.transform(_blocks(formatted), lambda b: F.split(b, NEXT)))
    return F.zip_with(segments, loss, lambda s, m: unescaped(F.substr(s, m["start"] + 1, m["end"] - m["start"])))


def op6_format_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chat(turns.unionByName(more))
    out = out.withColumns({"turns": read_turns(F.col("formatted")), "under": F.array_join(read_loss(F.col("formatted"), F.col("loss")), "")})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same in DuckDB, from the turns themselves.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *,
    CASE WHEN before = role THEN 0 ELSE 7 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) END
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
    + CASE WHEN after = role THEN 6 ELSE 8 END AS chars
  FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
