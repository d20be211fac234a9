"""Who started a narrative and how long others took to join, kept over a stream: state of one's own with timers in event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A row for each actor of a narrative, each time the narrative changes: `seen` counts its mentions so far, `closed` rows are its last.
OUTPUT = "narrative long, actor string, originator string, first_ts timestamp, joined_ts timestamp, mentions long, lag_seconds double, place int, seen long, closed boolean"
_NAMES = [c.split(" ")[0] for c in OUTPUT.split(", ")]
#: The same with times in microseconds, as state has them.
_TOLD = OUTPUT.replace("_ts timestamp", "_us long")
#: What arbitrary state is kept in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Narrative(StatefulProcessor):
    """State of one narrative: a row for each actor, with its first mention and the number of its mentions.

    With quiet_ms the narrative is closed and its state dropped once the watermark has passed its newest mention by so much.
    A call reads the state once and writes the actors that its rows name: each access to state is a message to another process."""

    def __init__(self, quiet_ms: int | None):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.actors = handle.getMapState("actors", "actor string", "joined_us long, mention long, mentions long")
        if self.quiet_ms is not None:
            self.newest = handle.getValueState("newest", "ms long")

    def _held(self) -> dict[str, tuple[int, int, int]]:
        return {actor: (us, mention, n) for (actor,), (us, mention, n) in self.actors.iterator()}

    def _rows(self, key, held: dict[str, tuple[int, int, int]], closed: bool) -> Iterator[Row]:
        found = sorted((us, mention, actor, n) for actor, (us, mention, n) in held.items())
        began, _, originator, _ = found[0]
        places = {actor: k for k, (_, actor) in enumerate(sorted((us, actor) for us, _, actor, _ in found), 1)}
        seen = sum(n for *_, n in found)
        for us, _, actor, n in found:
            yield Row(narrative=key[0], actor=actor, originator=originator, first_us=began, joined_us=us, mentions=n, lag_seconds=(us - began) / 1e6, place=places[actor], seen=seen, closed=closed)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, named, newest = self._held(), set(), None
        for r in rows:
            actor, us, mention = r["actor"], r["us"], r["mention_id"]
            old = held.get(actor)
            held[actor] = (us, mention, 1) if old is None else (*min((us, mention), old[:2]), old[2] + 1)
            named.add(actor)
            newest = us if newest is None else max(newest, us)
        for actor in named:
            self.actors.updateValue((actor,), held[actor])
        if self.quiet_ms is not None:
            newest = max(newest // 1000, *(self.newest.get() if self.newest.exists() else ()), -(1 << 62))
            for at in [*self.handle.listTimers()]:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(newest + self.quiet_ms)
            self.newest.update((newest,))
        yield from self._rows(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._rows(key, self._held(), True)
        self.actors.clear()
        self.newest.clear()

    def close(self) -> None:
        pass


def narratives(mentions: DataFrame, late: str = "1 day", quiet_ms: int | None = None) -> DataFrame:
    """A stream of mentions (narrative, actor, mention_id, ts) into OUTPUT rows: a narrative as it stands, each time a batch touches it.

    Mentions later than `late` behind the newest one of all are dropped, by the watermark. A narrative that has been quiet for
    quiet_ms is told once more, as closed, and forgotten; if it speaks up again it is a new one. Null narratives, actors and times are left out.
    State is a row for each actor of a running narrative, in RocksDB under the query's checkpoint."""
    mentions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = mentions.select("narrative", "actor", "mention_id", "ts", F.unix_micros("ts").alias("us")).dropna(subset=["narrative", "actor", "ts"]).withWatermark("ts", late)
    told = rows.groupBy("narrative").transformWithState(Narrative(quiet_ms), outputStructType=_TOLD, outputMode="Append", timeMode="EventTime" if quiet_ms is not None else "None")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("first_us", "joined_us")}).toDF(*_NAMES)


def latest(told: DataFrame) -> DataFrame:
    """Of what narratives() has written, each narrative as it was told last. Only for streams without quiet_ms: there a narrative is one."""
    return told.withColumn("last", F.max("seen").over(Window.partitionBy("narrative"))).where("seen = last").drop("last")


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what there is into Parquet files under folder/out, with its checkpoint beside them, and reads them back.

    Called again with the same folder it goes on where it stopped; files and checkpoint are written once for each batch, whatever fails between."""
    started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_to_tables(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream that sums up over what there is; each batch writes the whole table anew, under its number, and the last is read back."""

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k:09d}")

    started = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start()
    started.awaitTermination()
    spark = stream.sparkSession
    read = spark.read.schema(stream.schema.add("batch", "string")).parquet(f"{folder}/out")
    last = read.agg(F.max("batch")).first()[0]
    return read.where(F.col("batch") == F.lit(last)).drop("batch")
