"""Markov attribution: an absorbing chain over channels, and what conversion loses without each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

START, CONVERSION, NULL = "(start)", "(conversion)", "(null)"
#: States of k channels are named by their channels, joined by this.
JOINED = ">"
#: What is left of a solution's residual, or of a walk's probability, when it counts as solved.
LEFT = 1e-12
#: Directions that a solution is searched in, at first, before it starts anew; steps of a walk between two cuts of its lineage.
DIRECTIONS, STEPS = 40, 8


def transition_matrix(paths: DataFrame, path_col: str = "path", conv_col: str = "conv", order: int = 1, null_col: str | None = None) -> DataFrame:
    """src, dst, weight, probability. States are the last `order` channels; paths weigh by their conversions, and lead to null by null_col's count.

    Bigrams are made within rows and summed with partial aggregates; what is left has a row for each pair of states."""
    channels = F.filter(F.transform(F.split(path_col, ">"), lambda c: F.trim(c)), lambda c: c != "")
    cols = [channels.alias("c"), F.coalesce(F.col(conv_col).cast("double"), F.lit(0.0)).alias("conv")]
    cols.append(F.coalesce(F.col(null_col).cast("double"), F.lit(0.0)).alias("none") if null_col else F.lit(0.0).alias("none"))
    rows = paths.select(*cols).where((F.size("c") > 0) & ((F.col("conv") > 0) | (F.col("none") > 0)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("c") - (order - 1), F.lit(1))), lambda i: F.array_join(F.slice("c", i, F.lit(order)), JOINED))
    rows = rows.select(grams.alias("s"), "conv", "none")
    inner = rows.select(F.concat(F.array(F.lit(START)), "s").alias("s"), (F.col("conv") + F.col("none")).alias("w"))
    inner = inner.select(F.posexplode("s").alias("i", "src"), "s", "w").where(F.col("i") + 1 < F.size("s")).select("src", F.get("s", F.col("i") + 1).alias("dst"), "w")
    ends = rows.select(F.element_at("s", -1).alias("src"), F.inline(F.array(F.struct(F.lit(CONVERSION).alias("dst"), F.col("conv").alias("w")), F.struct(F.lit(NULL).alias("dst"), F.col("none").alias("w"))))).where("w > 0")
    sums = inner.unionByName(ends).groupBy("src", "dst").agg(F.sum("w").alias("weight"))
    out = sums.groupBy("src").agg(F.sum("weight").alias("out")).withColumnRenamed("src", "s_")
    return sums.join(out, F.col("src") == F.col("s_")).select("src", "dst", "weight", (F.col("weight") / F.col("out")).alias("probability"))


class Chain:
    """An absorbing chain as sparse arrays: states by number, edges from state to state, what leads to conversion."""

    def __init__(self, edges: list[tuple[str, str, float]]):
        self.states = sorted({s for s, _, _ in edges})
        number = {s: i for i, s in enumerate(self.states)}
        n = len(self.states)
        inner = [(number[s], number[d], x) for s, d, x in edges if d in number]
        self.src, self.dst = (np.array([e[k] for e in inner], np.int64) for k in range(2))
        self.p = np.array([e[2] for e in inner], float)
        self.r = np.bincount([number[s] for s, d, _ in edges if d == CONVERSION], [x for _, d, x in edges if d == CONVERSION], n) if n else np.zeros(0)
        self.start = number.get(START)
        self.holds: dict[str, list[int]] = {}
        for s, i in number.items():
            for c in set(s.split(JOINED)) if s != START else ():
                self.holds.setdefault(c, []).append(i)

    def solved(self, without: str | None = None) -> np.ndarray:
        """Of each state the probability to convert, with the states that hold the channel leading nowhere.

        Generalised minimal residuals, restarted, on rows divided by the chance to leave a state; what is left of the residual
        is below LEFT. A state that never leads to an end, but only round in circles, has zero."""
        n = len(self.states)
        keep = np.ones(n, bool)
        keep[self.holds.get(without, [])] = False
        keep &= self._ends(keep)
        some = keep[self.src] & keep[self.dst]
        stay = self.src == self.dst
        leave = 1 - np.bincount(self.src[some & stay], self.p[some & stay], n)
        leave[~keep] = 1.0
        some &= ~stay
        src, dst, p = self.src[some], self.dst[some], self.p[some] / leave[self.src[some]]
        b = np.where(keep, self.r / leave, 0.0)
        return _minimal(lambda x: x - np.bincount(src, p * x[dst], n), b)

    def _ends(self, keep: np.ndarray) -> np.ndarray:
        """Which states lead to conversion at all, along states that are kept."""
        found = keep & (self.r > 0)
        while True:
            more = found.copy()
            more[self.src[found[self.dst]]] = True
            more &= keep
            if (more == found).all():
                return found
            found = more

    def converts(self, without: str | None = None) -> float:
        return float(np.clip(self.solved(without)[self.start], 0, 1)) if self.start is not None else 0.0


def _minimal(times, b: np.ndarray) -> np.ndarray:
    """x with times(x) = b. Where a round brings little, the next has twice as many directions."""
    x, last, most = np.zeros(len(b)), np.inf, min(DIRECTIONS, len(b))
    while True:
        r = b - times(x)
        size = np.linalg.norm(r)
        if abs(r).max(initial=0.0) <= LEFT:
            return x
        if size > last / 4:
            most = min(2 * most, len(b))
        last = size
        q, h = np.zeros((most + 1, len(b))), np.zeros((most + 1, most))
        q[0] = r / size
        for k in range(most):
            v = times(q[k])
            for _ in range(2):  # twice is enough for directions to be at right angles
                c = q[: k + 1] @ v
                h[: k + 1, k] += c
                v = v - c @ q[: k + 1]
            h[k + 1, k] = np.linalg.norm(v)
            if h[k + 1, k] <= 1e-14:
                break
            q[k + 1] = v / h[k + 1, k]
        k += 1
        y = np.linalg.lstsq(h[: k + 1, :k], size * np.eye(k + 1)[0], rcond=None)[0]
        step = y @ q[:k]
        if np.linalg.norm(step) <= 1e-16 * (1 + np.linalg.norm(x)):
            return x
        x = x + step


def conversion_probability(edges: list[tuple[str, str, float]], without: str | None = None) -> float:
    """From the start, with every state that holds the channel leading nowhere."""
    return Chain(edges).converts(without)


def _solved(chain: DataFrame, channels: DataFrame) -> DataFrame:
    """channel, reach: by a solution for each channel, dealt over tasks that share the chain, whose size was checked."""
    spark = chain.sparkSession
    told = spark.sparkContext.broadcast(Chain([tuple(r) for r in chain.select("src", "dst", "probability").collect()]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"channel": b["channel"], "reach": [told.value.converts(None if c is None else c) for c in b["channel"]]})

    return channels.repartition("channel").mapInPandas(run, "channel string, reach double")


def _walked(chain: DataFrame, channels: DataFrame) -> DataFrame:
    """channel, reach: by walks from the start, one without each channel, step by step as joins.

    A walk ends when less than LEFT of its probability is on the way, which bounds its error. In each step states
    are left for good: staying is counted in by dividing by the chance to leave."""
    stay = chain.where("src = dst").select("src", F.col("probability").alias("stay"))
    rows = chain.where("src <> dst").join(stay, "src", "left").select("src", "dst", (F.col("probability") / (1 - F.coalesce("stay", F.lit(0.0)))).alias("p"))
    # What has converted stays where it is.
    rows = cut(rows.unionByName(chain.sparkSession.createDataFrame([(CONVERSION, CONVERSION, 1.0)], "src string, dst string, p double")))
    lost = lambda c, s: c.isNotNull() & F.array_contains(F.split(s, JOINED), c) & ~s.isin(START, CONVERSION, NULL)
    at = cut(channels.select("channel", F.lit(START).alias("state"), F.lit(1.0).alias("mass")))
    while True:
        for _ in range(STEPS):
            moved = at.join(rows, F.col("state") == F.col("src")).where(~lost(F.col("channel"), F.col("dst")))
            at = moved.groupBy("channel", F.col("dst").alias("state")).agg(F.sum(F.col("mass") * F.col("p")).alias("mass"))
        at = cut(at.where(F.col("state") != NULL))
        left = at.where(F.col("state") != CONVERSION).groupBy("channel").agg(F.sum("mass").alias("m")).agg(F.max("m")).first()[0]
        if (left or 0.0) <= LEFT:
            break
    found = at.where(F.col("state") == CONVERSION).select(F.col("channel").alias("c"), "mass")
    return channels.join(found, F.col("channel").eqNullSafe(F.col("c")), "left").select("channel", F.coalesce("mass", F.lit(0.0)).alias("reach"))


def run_attribution_model(paths: DataFrame, path_col: str = "path", conv_col: str = "conv", order: int = 1, null_col: str | None = None, max_edges: int = 1_000_000) -> DataFrame:
    """channel, total_conversions, removal_effect, attribution: each channel's share of all conversions by what is lost without it.

    The chain is summed by Spark. Of up to max_edges edges it is sent to tasks, each of which solves it without some of the
    channels; a larger one is walked through step by step in Spark. Both have an error below 1e-9 where paths are not
    of many thousand steps on average."""
    missing = [c for c in (path_col, conv_col, null_col) if c and c not in paths.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among the paths' columns {', '.join(paths.columns)}")
    chain = cut(transition_matrix(paths, path_col, conv_col, order, null_col))
    names = chain.where(F.col("src") != START).select(F.explode(F.split("src", JOINED)).alias("channel")).distinct()
    channels = cut(names.unionByName(chain.sparkSession.createDataFrame([(None,)], "channel string")))
    reach = cut(_solved(chain, channels) if chain.count() <= max_edges else _walked(chain, channels))
    whole = reach.where("channel IS NULL").select(F.col("reach").alias("whole"))
    total = chain.where(F.col("dst") == CONVERSION).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_conversions"))
    effect = F.when(F.col("whole") > 0, 1 - F.col("reach") / F.col("whole")).otherwise(0.0)
    effects = reach.where("channel IS NOT NULL").crossJoin(F.broadcast(whole)).select("channel", effect.alias("removal_effect"))
    every = effects.agg(F.sum("removal_effect").alias("every"))
    # Three tables of one row.
    out = effects.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(every))
    share = F.when(F.col("every") != 0, F.col("total_conversions") * F.col("removal_effect") / F.col("every")).otherwise(0.0)
    return out.select("channel", "total_conversions", "removal_effect", share.alias("attribution")).orderBy("channel")
