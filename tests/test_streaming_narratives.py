"""Narratives over a stream: the same as over the table, across a stop and restart, with late rows and expiry."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewire import operators as op
from tidewire.streaming import latest, narratives, run_to_files, run_to_tables, tumbling_volumes
from tidewire.streaming.narratives import Narrative

T0 = datetime(2025, 1, 1)
KINDS = "narrative long, actor string, mention_id long, ts timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put.path = str(tmp_path)
    put.stream = lambda: spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return put


def batch(spark, rows):
    df = spark.createDataFrame(rows, KINDS)
    lags = op.amplifier_lags(df, "narrative", "actor").join(op.first_movers(df, "narrative", "actor").select("narrative", "originator"), "narrative")
    return sorted((r["narrative"], r["actor"], r["originator"], r["mentions"], r["lag_seconds"], r["place"]) for r in lags.collect())


def told(df):
    return sorted((r["narrative"], r["actor"], r["originator"], r["mentions"], r["lag_seconds"], r["place"]) for r in df.collect())


def test_stop_and_restart_give_the_result_of_the_whole_table(spark, folder):
    rows = [(n, "ABC"[(n + k) % 3], 10 * k + n, T0 + timedelta(hours=7 * k - n * (k % 2))) for k in range(6) for n in range(3)]
    folder("a", rows[:5])
    folder("b", rows[5:9])
    first = run_to_files(narratives(folder.stream()), f"{folder.path}/run")
    assert told(latest(first)) == batch(spark, rows[:9])
    n = first.count()
    assert run_to_files(narratives(folder.stream()), f"{folder.path}/run").count() == n  # nothing new, nothing twice
    folder("c", rows[9:])
    assert told(latest(run_to_files(narratives(folder.stream()), f"{folder.path}/run"))) == batch(spark, rows)


def test_late_rows_are_dropped_and_quiet_narratives_closed(spark, folder):
    day = timedelta(days=1)
    folder("a", [(1, "A", 1, T0), (1, "B", 2, T0 + timedelta(hours=1)), (None, "A", 3, T0), (2, None, 4, T0)])
    run_to_files(narratives(folder.stream(), "1 day", 2 * 86_400_000), f"{folder.path}/run")
    folder("b", [(2, "A", 5, T0 + 10 * day)])
    run_to_files(narratives(folder.stream(), "1 day", 2 * 86_400_000), f"{folder.path}/run")
    folder("c", [(1, "C", 6, T0 + timedelta(hours=2)), (1, "C", 7, T0 + 11 * day)])  # too late; and a new narrative of the same name
    out = run_to_files(narratives(folder.stream(), "1 day", 2 * 86_400_000), f"{folder.path}/run")
    closed = out.where("closed").select("narrative", "actor", "originator", "mentions", "seen").orderBy("narrative", "actor").collect()
    assert [tuple(r) for r in closed] == [(1, "A", "A", 1, 2), (1, "B", "A", 1, 2)]
    again = out.where("narrative = 1 AND NOT closed AND actor = 'C'").select("originator", "mentions", "first_ts").collect()
    assert [tuple(r) for r in again] == [("C", 1, T0 + 11 * day)]


def test_volumes_by_table(spark, folder):
    rows = [(k % 3, "AB"[k % 2], k, T0 + timedelta(hours=9 * k)) for k in range(12)]
    make = lambda: tumbling_volumes(folder.stream().select(F.col("actor").alias("event_type"), "ts", F.col("narrative").alias("user_id")))
    folder("a", rows[:6])
    assert run_to_tables(make(), f"{folder.path}/run").agg(F.sum("count")).first()[0] == 6
    folder("b", rows[6:])
    out = run_to_tables(make(), f"{folder.path}/run")
    want = {}
    for _, a, _, ts in rows:
        want[ts.replace(hour=0), a] = want.get((ts.replace(hour=0), a), 0) + 1
    assert {(r["start"], r["event_type"]): r["count"] for r in out.collect()} == want


def test_a_call_reads_state_once_and_writes_the_actors_named():
    class State(dict):
        calls = []

        def iterator(self):
            self.calls.append("read")
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self.calls.append(key[0])
            self[key] = value

    n = Narrative(None)
    n.actors = State({("A",): (5, 1, 2), ("B",): (9, 2, 1)})
    rows = [Row(actor=a, us=us, mention_id=m) for a, us, m in (("B", 4, 7), ("C", 6, 3), ("B", 4, 6))]
    out = [*n.handleInputRows((1,), iter(rows), None)]
    assert sorted(State.calls) == ["B", "C", "read"] and dict(n.actors) == {("A",): (5, 1, 2), ("B",): (4, 6, 3), ("C",): (6, 3, 1)}
    assert [(r["actor"], r["originator"], r["joined_us"], r["place"], r["seen"]) for r in out] == [("B", "B", 4, 1, 6), ("A", "B", 5, 2, 6), ("C", "B", 6, 3, 6)]
