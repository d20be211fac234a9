"""The forms that large inputs take, forced on small ones, against plain Python and numpy."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire import operators as op
from tidewire.operators import attribution, centrality, network, quantiles


def numpy_betweenness(pairs):
    """Brandes on an adjacency matrix, a source at a time."""
    names = sorted({x for p in pairs for x in p})
    n = len(names)
    adj = np.zeros((n, n))
    for a, b in pairs:
        adj[names.index(a), names.index(b)] = adj[names.index(b), names.index(a)] = 1
    total = np.zeros(n)
    for s in range(n):
        far, paths = np.full(n, -1), np.zeros(n)
        far[s], paths[s] = 0, 1
        level = 0
        while (far == level).any():
            new = (far < 0) & (adj[far == level].sum(0) > 0)
            paths = np.where(new, (paths * (far == level)) @ adj, paths)
            far[new] = level = level + 1
        share = np.zeros(n)
        for d in range(level - 1, 0, -1):
            given = np.where(far == d + 1, (1 + share) / np.where(paths > 0, paths, 1), 0)
            share = np.where(far == d, paths * (adj @ given), share)
        total += np.where(far > 0, share, 0)
    return dict(zip(names, total / ((n - 1) * (n - 2)) if n > 2 else total))


@pytest.mark.parametrize("rows, part, edges", [(20_000_000, 20_000, 70), (900, 3, 45), (30, 1, 20)])
def test_betweenness_in_batches_and_parts(spark, monkeypatch, rows, part, edges):
    monkeypatch.setattr(centrality, "PART", part)
    for name, small in (("BROADCAST_EDGES", 1_000_000), ("BROADCAST_ROWS", 100_000), ("EXPANDED", 1_000_000)):
        monkeypatch.setattr(centrality, name, 10 if part < 20_000 else small)
    rng = random.Random(edges)
    names = [f"n{i:02d}" for i in range(30 if edges > 20 else 9)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(edges)} | {("hub", x) for x in names[: len(names) // 2]}
    pairs = {tuple(sorted(p)) for p in pairs}
    df = spark.createDataFrame([(*p, 2) for p in pairs], "src string, dst string, weight long")
    want = numpy_betweenness(pairs)
    for small in (0, 500_000):
        got = {r["node"]: r["betweenness"] for r in op.betweenness(df, rows, small).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_betweenness_of_apart_and_empty_graphs(spark):
    make = lambda pairs: spark.createDataFrame([(*p, 2) for p in pairs], "src string, dst string, weight long")
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "z"), ("z", "w"), ("l", "l")]
    got = {r["node"]: r["betweenness"] for r in op.betweenness(make(pairs), small=0).collect()}
    assert got == pytest.approx(numpy_betweenness(pairs[:-1]))
    assert op.betweenness(make([])).collect() == []
    long = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(12)]
    assert {r["node"]: r["betweenness"] for r in op.betweenness(make(long), small=0).collect()} == pytest.approx(numpy_betweenness(long))


def brute_quantile(values, q):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    if not v:
        return None
    at = q * (len(v) - 1)
    a, z = v[math.floor(at)], v[math.ceil(at)]
    return a if a == z else a + (z - a) * (at - math.floor(at))


INF = math.inf
COLUMNS = [
    [None, 3.0, 1.0, 2.0, math.nan, 2.0], [5.0], [None], [], [7.0] * 50, [1e308, -1e308, 0.0, 1e-300, -1e-300], [INF, 1.0, 2.0, -INF, -INF, -INF, 3.0], [0.0, 1.0] * 40,
    [float(x) for x in range(500)], [random.Random(2).gauss(0, 1) * 10 ** random.Random(i).randrange(-8, 9) for i in range(400)],
]


@pytest.mark.parametrize("few, ranges", [(10_000, 4096), (1, 7)])
def test_quantile(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    for k, values in enumerate(COLUMNS):
        df = spark.createDataFrame([(v,) for v in values], "`a b` double").repartition(3)
        for q in (0.0, 0.37, 0.5, 1.0) if few > 1 and k < 8 else (0.37, 0.75):
            got, want = op.quantile(df, "a b", q), brute_quantile(values, q)
            assert got == want or math.isclose(got, want, rel_tol=1e-12) or math.isnan(got) and math.isnan(want), (k, q)  # between infinities is nothing
    with pytest.raises(ValueError):
        op.quantile(df, "a b", 1.5)


def brute_paths(mentions, events, days, keep):
    out = []
    for journey, event, at in events:
        found = sorted((ts, i, c) for j, i, c, ts in mentions if j == journey and at - timedelta(days=days) <= ts < at)
        if found or keep:
            out.append((event, journey, " > ".join(c for *_, c in found), len(found), 1))
    return sorted(out)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("days, keep", [(7, False), (0.25, True), (1e-9, False), (4000, True)])
def test_paths_by_buckets(spark, kind, days, keep):
    rng = random.Random(int(days * 4))
    at = lambda: datetime(1970, 1, 3) + timedelta(seconds=rng.randrange(-900_000, 2_000_000), microseconds=rng.choice([0, 0, 1, 999_999]))
    times = [at() for _ in range(60)]
    journey = lambda: 1 if rng.random() < 0.6 else rng.randrange(2, 6)
    mentions = [(journey(), i, rng.choice("ABC"), rng.choice(times)) for i in range(150)]
    events = [(journey(), 1000 + i, rng.choice(times) + rng.choice([timedelta(0), timedelta(days=7), timedelta(days=0.25)])) for i in range(50)]
    m = spark.createDataFrame(mentions, f"journey_id long, mention_id long, channel string, ts {kind}")
    e = spark.createDataFrame(events, f"journey_id long, event_id long, ts {kind}")
    assert sorted(map(tuple, op.build_paths(m, e, days, keep_empty=keep).collect())) == brute_paths(mentions, events, days, keep)


def test_a_long_journey_is_spread_by_time(spark):
    m = spark.range(200_000).selectExpr("1L AS journey_id", "id AS mention_id", "'A' AS channel", "timestamp_seconds(id * 3600) AS ts")
    e = spark.range(2_000).selectExpr("1L AS journey_id", "id AS event_id", "timestamp_seconds(id * 360000 + 1) AS ts")
    near = op.touches(m, e).withColumn("task", F.spark_partition_id())
    by_task = [r["n"] for r in near.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()]
    # 168 hourly mentions a week for each event, fewer for the first: in every task of the session.
    assert sum(by_task) == sum(min(168, 100 * i + 1) for i in range(2_000)) and len(by_task) == 4 and max(by_task) < 0.5 * sum(by_task)


def random_chain(rng, n, channels, stay=0.0):
    edges, states = [], [attribution.START, *(f"{rng.choice(channels)}>{i}x" for i in range(n))]
    rest = states[1:]
    for s in states:
        to = [*rng.sample(rest, min(n, 3)), rng.choice([attribution.CONVERSION, attribution.NULL])]
        w = [rng.random() for _ in to]
        own = [(s, s, stay)] if stay and s != attribution.START and s not in to else []
        scale = (1 - stay if own else 1.0) / sum(w)
        seen = {}
        for d, x in zip(to, w):
            seen[d] = seen.get(d, 0.0) + x * scale
        edges += [(s, d, x) for d, x in seen.items()] + own
    return edges


def dense(edges, without=None):
    gone = lambda s: without is not None and without in s.split(">")
    states = sorted({s for s, _, _ in edges if not gone(s)})
    number = {s: i for i, s in enumerate(states)}
    p, r = np.zeros((len(states),) * 2), np.zeros(len(states))
    for s, d, x in edges:
        if s in number and d == attribution.CONVERSION:
            r[number[s]] += x
        elif s in number and d in number:
            p[number[s], number[d]] += x
    return float(np.linalg.solve(np.eye(len(states)) - p, r)[number[attribution.START]])


def test_sparse_chains_equal_dense_ones():
    rng = random.Random(3)
    for n, stay in ((1, 0), (2, 0.5), (40, 0), (300, 0.999), (300, 0.3)):
        edges = random_chain(rng, n, "ABCD", stay)
        assert attribution.conversion_probability(edges) == pytest.approx(dense(edges), abs=1e-9)
        for c in "ABCD":
            assert attribution.conversion_probability(edges, c) == pytest.approx(dense(edges, c), abs=1e-9)
    line = [(attribution.START, "s0", 1.0), *((f"s{i}", f"s{i + 1}", 0.5) for i in range(300)), *((f"s{i}", f"s{max(0, i - 1)}", 0.5) for i in range(300)), ("s300", attribution.CONVERSION, 1.0)]
    assert attribution.conversion_probability(line) == pytest.approx(1.0, abs=1e-9)  # a drunkard's walk: slow, and certain to end
    rounds = [(attribution.START, "a", 0.5), (attribution.START, "b", 0.5), ("a", "c", 1.0), ("c", "a", 1.0), ("b", attribution.CONVERSION, 1.0)]
    assert attribution.conversion_probability(rounds) == pytest.approx(0.5) and attribution.conversion_probability(rounds, "b") == 0.0


def test_a_chain_of_many_states():
    rng = random.Random(7)
    n = 100_000
    edges = random_chain(rng, n, [f"c{i}" for i in range(30)])
    chain = attribution.Chain(edges)
    h = chain.solved()
    # Held against the equations themselves.
    back = chain.r + np.bincount(chain.src, chain.p * h[chain.dst], len(h))
    assert len(h) == n + 1 and abs(back - h).max() < 1e-10 and 0 < chain.converts("c3") < chain.converts()


def test_attribution_by_walks(spark):
    rng = random.Random(5)
    paths = [(" > ".join(rng.choice("ABBC") for _ in range(rng.randrange(1, 5))), rng.randrange(3), rng.randrange(2)) for _ in range(60)]
    df = spark.createDataFrame(paths, "path string, conv int, none int")
    a, b = (op.run_attribution_model(df, order=2, null_col="none", max_edges=m).collect() for m in (1_000_000, 0))
    assert [r["channel"] for r in a] == ["A", "B", "C"]
    for x, y in zip(a, b):
        assert list(x)[1:] == pytest.approx(list(y)[1:], abs=1e-9)
    assert op.run_attribution_model(df.where("conv = 9"), max_edges=0).count() == 0


def brute_parents(mentions, days):
    out = {}
    for g, i, a, ts in mentions:
        before = [(t, j) for h, j, b, t in mentions if h == g and b != a and (t, j) < (ts, i) and t >= ts - timedelta(days=days)]
        out[i] = max(before)[1] if before else None
    return out


@pytest.mark.parametrize("days", [7, 0.5, 300])
def test_cascades(spark, days):
    rng = random.Random(int(days * 2))
    at = lambda: datetime(2025, 3, 1) + timedelta(seconds=rng.choice([0, 1800, 86_400 * 3]) + rng.randrange(0, 3_000_000) // 600 * 600)
    mentions = [(1 if rng.random() < 0.5 else rng.randrange(2, 5), i, rng.choice(["A", "A", "B", "C"]), at()) for i in rng.sample(range(1000), 160)]
    df = spark.createDataFrame(mentions, "narrative long, mention_id long, actor string, ts timestamp_ntz").repartition(3)
    parents = brute_parents(mentions, days)
    assert {r["mention_id"]: r["parent"] for r in op.predecessors(df, days).collect()} == parents
    trees = {}
    for g, i, a, ts in mentions:
        root, depth = i, 0
        while parents[root] is not None:
            root, depth = parents[root], depth + 1
        trees.setdefault(root, []).append((depth, a))
    own = {i: (g, a, ts) for g, i, a, ts in mentions}
    want = [(own[r][0], r, own[r][1], own[r][2], len(t), max(d for d, _ in t), max([d for d, _ in t].count(x) for x, _ in t), len({a for _, a in t})) for r, t in trees.items()]
    assert sorted(map(tuple, op.cascades(df, days).collect())) == sorted(want) and max(x[5] for x in want) > 2
    assert op.cascades(df.limit(0)).count() == 0


def test_pairs_in_blocks(spark, monkeypatch):
    from tidewire.operators import network

    rng = random.Random(2)
    docs = [(i, rng.sample([f"n{k}" for k in range(40)], rng.randrange(0, 30)) + ["n1", " n1 "]) for i in range(12)] + [(99, ["once", "n1"]), (100, None)]
    df = spark.createDataFrame(docs, "doc_id long, entities array<string>")
    names = [{x.strip() for x in e or []} for _, e in docs]
    want = {}
    for e in names:
        for a in e:
            for b in e:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for block, least in ((500, 1), (500, 3), (4, 1), (1, 3)):
        monkeypatch.setattr(network, "BLOCK", block)
        got = {(r["src"], r["dst"]): r["weight"] for r in op.cooccurrence_edges(df, least).collect()}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_rare_names_make_no_pairs_and_a_large_document_is_spread(spark, request):
    from tidewire.operators import network

    # 3,000 names in one document, of which 100 occur again: without the others 4,950 pairs of it instead of 4,498,500.
    rows = [(1, [f"x{i:04d}" for i in range(3000)]), (2, [f"x{i:04d}" for i in range(100)])]
    df = spark.createDataFrame(rows, "doc_id long, entities array<string>")
    named = network._named(df, 2, "doc_id", "entities")
    assert named.count() == 200 and network._pairs(named).count() == 2 * 4950
    assert op.cooccurrence_edges(df, 2).agg(F.count(F.lit(1)), F.min("weight")).first()[:] == (4950, 2)
    for name, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        request.addfinalizer(lambda name=name, before=spark.conf.get(name): spark.conf.set(name, before))
        spark.conf.set(name, value)
    everything = network._pairs(network._named(df, 1, "doc_id", "entities")).groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in everything)
    assert total == 4_498_500 + 4950 and max(r["count"] for r in everything) < 0.6 * total


def test_betweenness_splits_components(spark, monkeypatch):
    """Components are searched apart: one that a task cannot hold by joins, the others in tasks, the larger ones in several slices."""
    clique = [(f"a{i}", f"a{j}") for i in range(12) for j in range(i + 1, 12)]
    path = [(f"b{i:02d}", f"b{i + 1:02d}") for i in range(15)]
    wheel = [("c", f"c{i}") for i in range(9)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    lollipop = [("d0", "d1"), ("d0", "d2"), ("d1", "d2"), ("d2", "d3"), ("d3", "d4")]
    pairs = [tuple(sorted(p)) for p in clique + path + wheel + lollipop]
    monkeypatch.setattr(centrality, "ALONE", 0)
    monkeypatch.setattr(centrality, "WORK", 20)
    told = []
    whole = centrality._in_tasks
    monkeypatch.setattr(centrality, "_in_tasks", lambda both, deal, tasks: told.append(sorted((r["m"], r["slices"] > 1) for r in both.join(deal, "component").groupBy("component", "slices").count().withColumnRenamed("count", "m").collect())) or whole(both, deal, tasks))
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = {r["node"]: r["betweenness"] for r in op.betweenness(df, small=40).collect()}
    assert told == [[(10, False), (30, True), (36, True)]]
    assert got == pytest.approx(numpy_betweenness(pairs))


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """More rows and pairs go to more tasks, and names are found once however often they are asked for."""
    from tidewire.operators import network

    monkeypatch.setattr(network, "ROWS", 10)
    monkeypatch.setattr(network, "PAIRS", 20)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def names(d):
        seen.add(1)
        return [f"n{(d * k) % 17}" for k in range(1, 6)]

    edges = op.cooccurrence_edges(spark.range(1, 41).select(F.col("id").alias("doc_id"), names("id").alias("entities")), 2)
    assert edges.rdd.getNumPartitions() == 20 or "REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()
    want = {}
    for d in range(1, 41):
        found = sorted({f"n{(d * k) % 17}" for k in range(1, 6)})
        for i, a in enumerate(found):
            for b in found[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {k: v for k, v in want.items() if v > 1}
    assert seen.value == 40


def test_names_one_a_row_are_lists_nowhere(spark, monkeypatch):
    """Rows of names make the edges that lists make, repeats, blanks and nulls counted once or not at all; they're dealt by their number, and so are the parts of an order."""
    from tidewire.operators import network
    from tidewire.plans import queries

    rows = spark.range(400).select((F.col("id") % 40).alias("doc_id"), F.when(F.col("id") % 23 > 0, F.concat(F.lit(" n"), F.col("id") * 7 % 17)).alias("entities"))
    lists = rows.groupBy("doc_id").agg(F.collect_list("entities").alias("entities"))
    want = {tuple(r) for r in op.cooccurrence_edges(lists, 2).collect()}
    monkeypatch.setattr(network, "ROWS", 20)
    assert {tuple(r) for r in op.cooccurrence_edges(rows, 2).collect()} == want and want
    assert network._named(rows, 1, "doc_id", "entities").rdd.getNumPartitions() >= 19
    seen = []
    monkeypatch.setattr(queries.op, "cooccurrence_edges", lambda docs, least: seen.append(docs))
    queries.part_edges(spark, "/root/testdata/sf0.001")
    assert dict(seen[0].dtypes)["entities"] == "string"


def test_ids_that_never_repeat_are_not_sorted(spark):
    """Without repeats no window stands over the texts; with them, nulls among them, the first row of each id stays."""
    rows = lambda ids: spark.createDataFrame([(i, f"t{k}", k) for k, i in enumerate(ids)], "ARTICLE_ID string, HEADLINE string, _ord long")
    once = op.preprocess(rows(["a", "b", "c"]))
    assert "Window" not in once._jdf.queryExecution().optimizedPlan().toString() and once.count() == 3
    again = op.preprocess(rows(["a", None, "a", None, "b"]))
    assert {(r["ARTICLE_ID"], r["HEADLINE"]) for r in again.select("ARTICLE_ID", "HEADLINE").collect()} == {("a", "t0"), (None, "t1"), ("b", "t4")}
    assert op.preprocess(rows(["a"]).limit(0)).count() == 0


def _graph(src, dst):
    src, dst = np.r_[src, dst], np.r_[dst, src]
    _, s = np.unique(src, return_inverse=True)
    order = np.argsort(s, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(s))]), np.searchsorted(np.unique(src), dst[order])


def test_twins_and_matrices_carry_the_same_as_a_search_from_each_node(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(5))
    for n, p in ((3, 1), (6, 0.4), (30, 0.1), (50, 0.9), (120, 0.03), (100, 0.3)):
        x, y = np.triu_indices(n, 1)
        some = rng.random(len(x)) < p
        some[0] = True
        g = _graph(x[some], y[some])
        want = sum(centrality._dependencies(*g, s) for s in range(len(g[0]) - 1))
        for dense in (0, 3000):
            monkeypatch.setattr(centrality, "DENSE", dense)
            for slices in (1, 3):
                assert np.allclose(sum(centrality._carried(*g, k, slices) for k in range(slices)), want, rtol=1e-12, atol=1e-9)


def test_a_search_for_each_kind_of_node_and_none_where_a_matrix_holds_the_edges(monkeypatch):
    searched, one = [], centrality._dependencies
    monkeypatch.setattr(centrality, "_dependencies", lambda first, to, s: searched.append(s) or one(first, to, s))
    assert centrality._carried(*_graph(np.zeros(200, int), np.arange(1, 201)), 0, 1).tolist() == [200 * 199.0] + [0.0] * 200 and len(searched) == 2
    searched.clear()
    x, y = np.triu_indices(80, 1)
    centrality._carried(*_graph(x[1:], y[1:]), 0, 1)
    assert not searched


def test_components_read_the_edges_of_a_dense_graph_in_one_round(spark, monkeypatch):
    from tidewire.operators import connected

    rows, cut = [], connected.cut
    monkeypatch.setattr(connected, "cut", lambda df: (lambda r: rows.append(r.count()) or r)(cut(df)))
    edges = [(a + 100 * k, b + 100 * k) for k in range(3) for a in range(30) for b in range(a + 1, 30)]
    got = {r[0]: r[1] for r in connected.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {a + 100 * k: 100 * k for k in range(3) for a in range(30)}
    assert sum(n >= len(edges) for n in rows) == 1
    path = [(i * 7919 % 101, (i + 1) * 7919 % 101) for i in range(99)] + [(500, 500), (600, 601), (601, 600)]
    got = {r[0]: r[1] for r in connected.components(spark.createDataFrame(path, "src long, dst long")).collect()}
    one = {n for e in path[:99] for n in e}
    assert got == {n: min(one) for n in one} | {500: 500, 600: 600, 601: 600}


def test_names_are_not_dealt_by_name_where_all_are_in_documents_enough(spark, monkeypatch):
    dealt, own = [], network._dealt
    monkeypatch.setattr(network, "_dealt", lambda df, rows, each, *keys: dealt.append(keys) or own(df, rows, each, *keys))
    rows = [(d, e) for d in range(6) for e in ("a", " b", "c ", "a")] + [(7, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, entities string")
    assert sorted(map(tuple, network.cooccurrence_edges(docs).collect())) == [("a", "b", 6), ("a", "c", 6), ("b", "c", 6)] and ("e",) not in dealt
    docs = spark.createDataFrame(rows + [(1, "z")], "doc_id long, entities string")
    assert network.cooccurrence_edges(docs).count() == 3 and ("e",) in dealt
    assert network.cooccurrence_edges(docs.limit(0)).count() == 0


def test_a_dense_component_is_not_copied_to_more_tasks_than_its_products_are_worth(spark, monkeypatch):
    from tidewire.operators import connected

    x, y = np.triu_indices(40, 1)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x[1:], y[1:])], "src long, dst long")
    monkeypatch.setattr(centrality, "WORK", 2 * 779 * 40 / 8)
    deals, own = [], centrality._in_tasks
    monkeypatch.setattr(centrality, "_in_tasks", lambda both, deal, tasks: deals.append(deal.first()["slices"]) or own(both, deal, tasks))
    got = {r["node"]: r["betweenness"] for r in centrality.betweenness(edges).collect()}
    assert deals == [1] and got == pytest.approx({k: 1 / 39 / 38 * 2 / 38 if k > 1 else 0 for k in range(40)})
    monkeypatch.setattr(connected, "BROADCAST_NODES", 0)  # joined by shuffle
    assert {r["node"]: r["betweenness"] for r in centrality.betweenness(edges).collect()} == pytest.approx(got)
