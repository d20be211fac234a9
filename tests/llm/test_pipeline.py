"""The pipeline against a brute-force version of its stages, the queries against their SQL, and what is left without this folder."""

import glob
import hashlib
import math
import os
import subprocess
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_hits, brute_measures, brute_targets, key, spaced
from tidewire.llm import quality, queries

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [*docs[["doc_id", "text", "source"]].itertuples(index=False, name=None)]
    # 7: rules, hosts
    m = {i: brute_measures(t) for i, t, _ in rows}

    def failed(n, chars, symbols, dup, repeated):
        return n < 50 or 100 * repeated > 50 * n or 100 * symbols > quality.MAX_SYMBOLS * n or 100 * dup > quality.MAX_DUP_LINES * n or not quality.WORD_LENGTH[0] * n <= chars <= quality.WORD_LENGTH[1] * n

    hosts = defaultdict(list)
    for i, _, s in rows:
        hosts[s].append(failed(*m[i]))
    rate = {s: sum(x) / len(x) for s, x in hosts.items()}
    p, v = np.mean([*rate.values()]), np.var([*rate.values()], ddof=1)
    strength = min(1000.0, max(1.0, p * (1 - p) / v - 1))
    bad = {s for s, x in hosts.items() if (sum(x) + p * strength) / (len(x) + strength) > quality.MAX_RATE}
    rows = [r for r in rows if not failed(*m[r[0]]) and r[2] not in bad]
    # 8: the smallest id of each component
    _, groups = brute_classes(rows)
    rows = [rows[min(g, key=lambda i: rows[i][0])] for g in groups.values()]
    # 2
    items = [*pd.read_parquet(f"{SF}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None)]
    rows = [r for r in rows for n, hit, _ in [brute_hits(r[1], items)] if not (hit and 20 * len(hit) >= n)]
    # 9
    size = {i: len(spaced(t)) for i, t, _ in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    sums = {s: sum(size[r[0]] for r in x) for s, x in by.items()}
    want, out = brute_targets(sums), []
    for s, x in by.items():
        u = int(hashlib.md5(f"mix-1/s{s}".encode()).hexdigest()[:8], 16) / 2**32
        each = want[s] / sums[s]
        for k, r in enumerate(sorted(x, key=lambda r: (size[r[0]], r[0]))):
            out += [r] * (math.floor((k + 1) * each + u) - math.floor(k * each + u))
    # 10
    t, at, told = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text, _ in sorted(out, key=lambda r: r[0]):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        told.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == sorted(told) and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    a, b = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted((tuple(None if pd.isna(x) else x for x in r) for r in d[cols].itertuples(index=False)), key=key)
    assert rows(a) == rows(b)


def test_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == [*range(1, 14)] and "pipeline" in entry.queries()


def test_rest_works_without_this_folder():
    code = "import sys; sys.modules['tidewire.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert 'pipeline' not in q and not any(n.startswith('op') for n in q) and len(q) > 30"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__)).returncode == 0
