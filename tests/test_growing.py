"""Growing files as streams, and logs of JSON lines."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import tokens as K
from corpusloom.sources import growing as G
from corpusloom.streaming import streams as T


def lines_of(spark, folder):
    return sorted((r.batch, r.path, r.at, r.value) for r in spark.read.schema("path string, at long, value string, batch long").parquet(f"{folder}/lines").collect())


def test_a_file_grows_breaks_and_begins_anew(spark, tmp_path):
    """Each look is a query of its own, which goes on at the offsets that the one before committed."""
    folder, out = tmp_path / "runs", str(tmp_path / "out")
    (folder / "a").mkdir(parents=True)
    file = folder / "a" / "metrics.jsonl"

    def look(text=None):
        if text is not None:
            file.write_text(text)
        G.tail_into(G.growing_lines(spark, str(folder), "*/metrics.jsonl"), out)
        return [(b, v) for b, _, _, v in lines_of(spark, out)]

    first = '{"step": 1}\n{"step": 2}\n{"st'
    assert look(first) == [(0, '{"step": 1}'), (0, '{"step": 2}')]
    assert look() == look() and len(look()) == 2
    second = first + 'ep": 3}\nbroken\n'
    assert look(second)[2:] == [(1, '{"step": 3}'), (1, "broken")]
    assert [r.step for r in G.current_records(spark, out, "step long").orderBy("at").collect()] == [1, 2, 3]
    assert look('{"step": 1}\n')[4:] == [(2, '{"step": 1}')]  # shorter than before
    assert [r.step for r in G.current_records(spark, out, "step long").collect()] == [1]
    longer = "".join(f'{{"step": {i}, "run": "other"}}\n' for i in range(20, 40))
    assert len(look(longer)) == 25  # longer, but of another first line
    (folder / "b").mkdir()
    (folder / "b" / "metrics.jsonl").write_text('{"step": 7}\nno end')
    look(longer + '{"step": 40}\n')
    got = G.current_records(spark, out, "step long", keep=3).orderBy("path", "at").collect()
    assert [(r.path, r.step) for r in got] == [("a/metrics.jsonl", i) for i in (38, 39, 40)] + [("b/metrics.jsonl", 7)]


def test_spans_hold_each_line_once(tmp_path):
    """Lines of any length, cut into spans of any size, from any start."""
    lines = [b"x" * (i * 7 % 23) for i in range(60)]
    blob = b"".join(x + b"\n" for x in lines)
    path = tmp_path / "f.jsonl"
    path.write_bytes(blob + b"half")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for part in (1, 3, 8, 64, 10_000):
        reader = G._Tail(str(tmp_path), "*.jsonl", part)
        end = reader.latestOffset()
        assert end["f.jsonl"]["end"] == len(blob)
        for k in (0, 1, 17, 59, 60):
            spans = reader.partitions({"f.jsonl": {**end["f.jsonl"], "end": starts[k]}}, end)
            got = [(a, v) for s in spans for b in reader.read(s) for a, v in zip(b["at"].to_pylist(), b["value"].to_pylist(), strict=True)]
            assert got == [(a, x.decode()) for a, x in zip(starts[k:-1], lines[k:], strict=True)]


def test_blocks_smaller_than_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 5)
    test_spans_hold_each_line_once(tmp_path)


def test_metrics_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.jsonl").write_text('{"step": 1, "train_loss": 4.5}\nbroken\n{}\n{"step": 2')
    tail = T.metrics_tail(spark, str(tmp_path / "in"), "step long, train_loss double")
    assert [tuple(r) for r in T.run_once(tail, str(tmp_path / "tail")).collect()] == [(1, 4.5)]
    with open(tmp_path / "in" / "m.jsonl", "a") as f:
        f.write(', "train_loss": 4.0}\n')
    assert sorted(tuple(r) for r in T.run_once(tail, str(tmp_path / "tail")).collect()) == [(1, 4.5), (2, 4.0)]


def test_a_repeated_batch_adds_no_line(spark, tmp_path):
    log, state = str(tmp_path / "log"), tmp_path / "state"
    rows = spark.createDataFrame([(i, f"é\n{i}") for i in range(20)], "n long, s string")
    rows.where("n < 10").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long, s string").parquet(str(tmp_path / "in"))
    G.append_json(stream, log, str(state))
    (state / "commits" / "0").unlink()  # the query broke off after its rows were listed
    for f in (state / "commits").glob(".0*"):
        f.unlink()
    G.append_json(stream, log, str(state))
    rows.where("n >= 10").write.mode("append").parquet(str(tmp_path / "in"))
    G.append_json(stream, log, str(state))
    got = G.logged(spark, log, "n long, s string")
    assert sorted((r.batch, r.n, r.s) for r in got.collect()) == [(i // 10, i, f"é\n{i}") for i in range(20)]
    assert len(list((tmp_path / "log" / "rows").glob("*.jsonl"))) > len(json.loads((tmp_path / "log" / "batches" / "000000000000.json").read_text())) + len(json.loads((tmp_path / "log" / "batches" / "000000000001.json").read_text()))
    G.append_record(log, {"n": 99, "s": "by hand"})
    assert G.logged(spark, log, "n long, s string").where(F.col("n") == 99).first().batch == 2
    assert G.logged(spark, str(tmp_path / "none"), "n long").count() == 0


def test_budgets_of_a_stream(spark, tmp_path):
    """Batches give what one table gives, in both splits, and a batch that is run again takes no more."""
    rows = [("s" if i % 3 else "t", i, 1 + i * 7 % 5) for i in range(90)] + [("none", 200, 3)]
    df = spark.createDataFrame(rows, "source string, row_id long, n_tokens long")
    budgets, val = {"s": 100, "t": 30}, {"s": 40, "t": 9}
    limits = F.when(F.col("source") == "s", 100).when(F.col("source") == "t", 30), F.when(F.col("source") == "s", 40).when(F.col("source") == "t", 9)
    known = df.where("source <> 'none'").withColumns({"budget": limits[0].cast("long"), "val_budget": limits[1].cast("long")})
    want = sorted((r.source, r.row_id, r.split, r["take"]) for r in K.quota(known, 0.3, 7).collect())
    out = str(tmp_path / "out")
    for at in (0, 30, 60):
        df.where((F.col("row_id") >= at) & (F.col("row_id") < (at + 30 if at < 60 else 999))).write.mode("append").parquet(str(tmp_path / "in"))
        for again in (False, True):
            T.fill_budgets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), budgets, out, val, 0.3, 7)
            if not again:  # the query broke off before its batch was committed
                for f in (tmp_path / "out" / "state" / "commits").glob(f"*{at // 30}*"):
                    f.unlink()
    got = T.taken_rows(spark, out)
    assert sorted((r.source, r.row_id, r.split, r["take"]) for r in got.collect()) == want
    assert {r.batch for r in got.select("batch").collect()} <= {0, 1, 2} and {s for _, _, s, _ in want} == {"train", "val"}
    assert got.groupBy("source", "split").agg(F.sum("take").alias("n")).where("source = 't' AND split = 'train'").first().n == 30
