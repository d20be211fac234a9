import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "NaT":
        return "null"
    if isinstance(x, (int, float)):
        return repr(round(float(x), 9))
    return str([*x]) if not isinstance(x, str) and hasattr(x, "__len__") else str(x).removesuffix(" 00:00:00")


def canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(x) for x in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert canon(entry.queries()[name](spark, SF).toPandas()) == canon(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel", "total_conversions", "removal_effect", "attribution"] and df.count() > 0


def test_nothing_else_needs_llm():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "tidewire", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "llm" not in open(path).read(), path


def test_network_view_of_all_orders(spark, con):
    pairs = con.execute("""WITH m AS (SELECT DISTINCT l_orderkey AS d, CAST(l_suppkey AS VARCHAR) AS e FROM lineitem)
    SELECT x.e, y.e, count(*) FROM m x JOIN m y ON x.d = y.d AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""").fetchall()
    assert len({x for p in pairs for x in p[:2]}) <= 40  # all are shown
    weights = sorted(n for _, _, n in pairs)
    bar = (weights[(len(weights) - 1) // 2] + weights[len(weights) // 2]) / 2
    kept = {p for p in pairs if p[2] >= bar}
    assert {(r["src"], r["dst"], r["weight"]) for r in entry.queries()["network_view_edges"](spark, SF).collect()} == kept
    assert {r["node"] for r in entry.queries()["network_view"](spark, SF).collect()} == {x for p in kept for x in p[:2]}


def test_text_network_of_whole_texts(spark, tmp_path):
    for f in glob.glob(f"{SF}/*.parquet"):
        os.symlink(f, tmp_path / os.path.basename(f))
    os.remove(tmp_path / "documents.parquet")
    given = spark.read.parquet(f"{SF}/documents.parquet")
    far = "concat(repeat('word ', 500), 'Ann Lee met Bob Ray')"
    more = spark.range(2500).selectExpr("id + 1000000 AS doc_id", f"CASE WHEN id >= 2498 THEN {far} ELSE 'word' END AS text", "'en' AS lang", "'src1' AS source", "4 AS n_chars")
    more = more.select(*[more[c].cast(given.schema[c].dataType).alias(c) for c in given.columns])
    given.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["node"]: r["degree"] for r in entry.queries()["text_network"](spark, str(tmp_path)).collect()}
    assert found["Ann Lee"] >= 1 and found["Bob Ray"] >= 1
