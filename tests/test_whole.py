"""Queries that take whole tables, against plain Python on small fixtures."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics as M
from corpusloom.operators import stats as A
from corpusloom.operators import tokens as K
from corpusloom.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


def averages(values):
    """One after another."""
    out, now = [], None
    for v in values:
        if v is not None:
            now = v if now is None else 0.95 * now + 0.05 * v
        out.append(now)
    return out


def test_smoothing_in_blocks(spark):
    rows = [(run, i * 3, None if i < 4 or i % 11 == 0 or 40 <= i < 60 else float(i * 37 % 101)) for run in ("a", None) for i in range(120)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    got = {(r.run, r.step): r.smoothed for r in M.smooth(df, "run", "step", "value", block=25).collect()}
    assert len(got) == len(rows)
    for run in ("a", None):
        for i, want in enumerate(averages([v for r, _, v in rows if r == run])):
            have = got[run, i * 3]
            assert have is want is None or abs(have - want) < 1e-9


def test_whole_runs_are_smoothed(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select((F.col("user_id") % 7).alias("run"), "event_id", "value").orderBy("event_id").collect()
    got = {(r.run, r.step): r.smoothed for r in QUERIES["smoothed_loss"](spark, DATA).collect()}
    assert len(got) == len(events) > 1000
    for run in {e.run for e in events}:
        own = [e for e in events if e.run == run]
        assert all(abs(got[run, e.event_id] - want) < 2e-6 for e, want in zip(own, averages([e.value for e in own]), strict=True))


def test_every_record_has_a_rate(spark):
    got = {r.step: r.rate for r in QUERIES["learning_rates"](spark, DATA).collect()}
    assert set(got) == {r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect()}
    for step, rate in got.items():
        seen = step * 512
        share = min(1.0, max(0.0, (seen - 200_000) / 1_800_000))
        want = 0.003 * seen / 200_000 if seen < 200_000 else 0.0003 + 0.0027 * 0.5 * (1 + math.cos(math.pi * share))
        assert abs(rate - want) < 1e-8


def test_all_documents_are_reconciled(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 2, 3, 6, 6)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in (2, 3, 3, 9)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.status) for r in QUERIES["reconciliation"](spark, str(tmp_path)).collect())
    assert got == [(1, "missing"), (2, "both"), (3, "both"), (6, "missing"), (9, "extra")]


def test_orders_match_all_customers(spark, tmp_path):
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1), (2, 3), (3, 7), (4, 7), (5, 8), (6, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r.o_custkey, r.orders) for r in QUERIES["unmatched_rows"](spark, str(tmp_path)).collect())
    assert got == [(7, 2), (8, 1)]


def test_register_of_customers_without_orders(spark, tmp_path):
    """As its SQL has it, which counts 2 for a run without orders."""
    spark.createDataFrame([(i,) for i in (5, 6, 7, 8)], "c_custkey long").toPandas().to_parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 5), (2, 7), (3, 7), (4, 7), (5, 8), (6, 8), (7, 99)], "o_orderkey long, o_custkey long").toPandas().to_parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["experiment_register"](spark, str(tmp_path)).select("run", "orders", "last", "listed", "selected").collect())
    assert got == [(5, 1, 1, 1, False), (6, None, None, 2, False), (7, 3, 4, 2, True), (8, 2, 6, 2, False)]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert got == sorted(con.execute(f"SELECT run, orders, last, listed, selected FROM ({SQL['experiment_register']})").fetchall())


def test_parameters_of_every_configuration(spark, tmp_path):
    orders = [(0, 0), (1, 4), (7, 12), (1003, 5), (9, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["parameter_arithmetic"](spark, str(tmp_path)).select("configuration", "depth", "d_model", "embedding", "blocks").collect())
    want = []
    for key, run in sorted(orders):
        depth, d = 4 + key % 4, None if run is None else 64 * (4 + run % 5)
        want.append((key, depth, d, *((None, None) if d is None else (16384 * d, depth * (2 * d * d + 2 * d * d // 4 + 6 * d * d + 2 * d + 2)))))
    assert got == want


def test_synthetic_tokens_of_all_events(spark, tmp_path):
    events = [(0, 0), (1, 0), (5, 3), (123_456_789, 9), (7_000_000_000, 1)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.pos, r.stream, r.token) for r in QUERIES["synthetic_tokens"](spark, str(tmp_path)).collect())
    assert got == sorted((at, user, (at * 1103515245 + 7 + user) % 16384) for at, user in events)


def test_vocabulary_of_all_sources(spark, tmp_path):
    rows = [(1, "src1", "a b a", "en"), (2, "src2", "b c", "en"), (3, "src7", "d a", "de"), (4, "src9", None, "de")]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.token: r.n for r in QUERIES["vocabulary_frequencies"](spark, str(tmp_path)).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 1}
    vocabulary = spark.createDataFrame([("a",), ("z",)], "token string")
    seen = spark.createDataFrame([("a", 3), ("b", 2)], "token string, n long")
    assert {r.token: r.n for r in A.counted(vocabulary, seen).collect()} == {"a": 3, "z": 0}


@pytest.mark.parametrize("last", [5, 6, 7])
def test_stream_of_documents(spark, last):
    docs = [(i * 700, [10 * i + k % 7 for k in range(n)] + [3]) for i, n in enumerate([2, 0, 40, 1, 1, 15, last], 1)]
    stream = [x for _, ids in docs for x in ids]
    df = spark.createDataFrame(docs, "row_id long, ids array<int>").repartition(3)
    got = {(r.batch * 2 + r.row): (r.inputs, r.targets) for r in K.packed(df, 2, 4).collect()}
    ring = [*stream, stream[0]]
    assert got == {k: (ring[4 * k : 4 * k + 4], ring[4 * k + 1 : 4 * k + 5]) for k in range(len(stream) // 4)}
    shards = {r.shard: (r.least, r.most, r.ends, r.tokens) for r in K.scanned(df, 10, 3).collect()}
    parts = [stream[i : i + 10] for i in range(0, len(stream), 10)]
    assert shards == {i: (min(p), max(p), p.count(3), len(p)) for i, p in enumerate(parts)}


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_streams_of_tables_in_any_layout(spark, tmp_path, layout):
    """A table is one file or a folder of files; tables of like names beside it are left alone."""
    rows = [(i, f"src{i % 3}", None if i == 5 else f"text  {i % 4}", ["en", "de"][i % 2]) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    docs.withColumn("text", F.lit("other")).write.parquet(f"{tmp_path}/documents_old.parquet")
    path = f"{tmp_path}/documents.parquet"
    if layout == "file":
        docs.toPandas().to_parquet(path)
    else:
        docs.repartition(3).write.parquet(path)
    got = sorted((r.source, r.digest) for r in QUERIES["streamed_dedup"](spark, str(tmp_path)).collect())
    assert got == sorted({(s, hashlib.sha256(t.replace("  ", " ").encode()).hexdigest()) for _, s, t, _ in rows if t})
