"""The jobs over growing copies of the given tables, by function and by command line."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, search_index, usage_ledger
from jobs.common import defaults, settings
from oracle import SF, connect, table
from quillstone.operators import index

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def statement(sql, view, path):
    db = connect()
    db.execute(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM '{path}/*.parquet'")
    found = db.execute(sql)
    return table([d[0] for d in found.description], found.fetchall())


def rows(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def files(folder):
    return {os.path.join(top, n): os.path.getmtime(os.path.join(top, n)) for top, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_ledger_takes_only_what_is_new(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, target, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    cut = events.selectExpr("percentile_approx(event_id, 0.6) AS cut").first()["cut"]
    late = F.col("event_id") % 10 == 3  # of all days, in the second copy
    run = lambda: usage_ledger.run(spark, source, target, mark, defaults("usage_ledger"))
    first = (F.col("event_id") <= cut) & ~late
    events.where(first).write.parquet(source)
    done = run()
    assert done["rows"] == events.where(first).count()
    assert rows(usage_ledger.read_ledger(spark, target)) == statement(queries.USAGE_LEDGER, "events", source)
    before = files(target)
    assert run() == {"batches": 0, "rows": 0, "days": 0} and files(target) == before
    events.where(~first).write.mode("append").parquet(source)
    done = run()
    assert done["rows"] == events.where(~first).count()
    assert rows(usage_ledger.read_ledger(spark, target)) == statement(queries.USAGE_LEDGER, "events", source)
    # only days with new events were written again
    events.where("event_id = 0").withColumn("event_id", F.lit(10**9).cast("long")).write.mode("append").parquet(source)
    before = files(f"{target}/ledger")
    assert run()["days"] == 1
    after = files(f"{target}/ledger")
    day = events.where("event_id = 0").select(F.date_format("ts", "yyyy-MM-dd")).first()[0]
    changed = {p for p in before.keys() ^ after.keys()} | {p for p in before.keys() & after.keys() if before[p] != after[p]}
    assert changed and all(f"day={day}" in p for p in changed)


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    """The checkpoint's last commit is lost, as if the run had died before it: the batch is taken again, with the same result."""
    source, target, mark = (str(tmp_path / n) for n in ("events", "out", "mark"))
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(source)
    usage_ledger.run(spark, source, target, mark, defaults("usage_ledger"))
    want = rows(usage_ledger.read_ledger(spark, target))
    for name in os.listdir(f"{mark}/commits"):
        os.remove(f"{mark}/commits/{name}")
    assert usage_ledger.run(spark, source, target, mark, defaults("usage_ledger"))["batches"] == 1
    assert rows(usage_ledger.read_ledger(spark, target)) == want


def test_odd_events(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, None, None, None, None), (2, None, 3, "view", 7.9, '{"k": 5}'), (2, None, 3, "view", 7.9, '{"k": 5}'), (None, None, 8, "error", None, "no json")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    source, target = str(tmp_path / "events"), str(tmp_path / "out")
    odd.write.parquet(source)
    usage_ledger.run(spark, source, target, str(tmp_path / "mark"), defaults("usage_ledger"))
    got = {r["claim"]: (r["day"], r["status"], r["helpful"], r["harmful"], r["records"]) for r in usage_ledger.read_ledger(spark, target).collect()}
    assert got == {None: ("undated", "archived", 0, 1, 2), 5: ("undated", "active", 7, 0, 2)}
    empty = str(tmp_path / "none")
    odd.limit(0).write.parquet(empty)
    usage_ledger.run(spark, empty, str(tmp_path / "out2"), str(tmp_path / "mark2"), defaults("usage_ledger"))


def test_index_job_is_rerun_and_searched(spark, tmp_path):
    target = str(tmp_path / "index")
    first = search_index.run(spark, f"{SF}/documents.parquet", target, defaults("search_index"))
    want = rows(search_index.read_index(spark, target).postings)
    assert search_index.run(spark, f"{SF}/documents.parquet", target, defaults("search_index")) == first
    stored = search_index.read_index(spark, target)
    assert rows(stored.postings) == want and first["postings"] == len(want[1])
    tokens = index.token_table(search_index.claims(spark.read.parquet(f"{SF}/documents.parquet"), defaults("search_index")), stemmed=False)
    for terms in (["the", "thing"], ["é"], ["nowhere", "th", "the"], ["web", "src"]):
        for exact in (False, True):
            whole, found = (rows(index.bm25(t, terms, stemmed=False, exact=exact)) for t in (tokens, stored))
            assert whole == found
    only = [rows(index.bm25(t, ["web", "th"], stemmed=False, fields=("entities", "refs"))) for t in (tokens, stored)]
    assert only[0] == only[1]


def test_a_search_reads_ranges_only(spark, tmp_path):
    stored = index.write_index(index.token_table(spark.createDataFrame([("a", "thing onto", None, [], []), ("b", "", None, None, None)], "id string, text string, why string, entities array<string>, refs array<string>"), stemmed=False), str(tmp_path))
    plan = index.bm25(stored, ["thin"], stemmed=False)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,thin)" in plan and "PartitionFilters: [isnotnull(shard" in plan
    assert [r["id"] for r in index.bm25(stored, ["thin"], stemmed=False).collect()] == ["a"]
    assert index.bm25(stored, [], stemmed=False).count() == 0 == index.bm25(stored, ["x"], stemmed=False).count()


def test_an_index_reads_its_rows_for_ranges_and_lists_only(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    claims = spark.read.parquet(f"{SF}/documents.parquet")
    table = index.token_table(search_index.claims(claims, defaults("search_index")), stemmed=False)
    stored = index.write_index(table.mapInArrow(counted, table.schema), str(tmp_path))
    assert read.value <= 2 * claims.count()
    assert stored.lists.count() < stored.size == stored.postings.count()  # lists are shuffled, not postings
    assert rows(stored.statistics) == rows(table.where("length > 0").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average")))


def test_lists_are_cut_between_rows(spark, tmp_path, monkeypatch):
    """Whatever a task makes lists of at once, a row longer than that included."""
    import pyarrow as pa

    a, b = ["x"] * 5 + ["y"], ["y"]
    none: list[str] = []
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t, "why": None, "entities": none, "refs": none, "length": len(t)} for i, t in (("1", b), ("2", a), ("3", none), ("4", b))], pa.schema({"id": pa.string(), **{f: pa.list_(pa.string()) for f in index.FIELDS}, "length": pa.int64()}))
    want = {("x", "2", 5, 6), ("y", "1", 1, 1), ("y", "2", 1, 6), ("y", "4", 1, 1)}
    for together, parts in ((1, 3), (2, 3), (100, 1)):
        monkeypatch.setattr(index, "TOGETHER", together)
        made = [r for x in index._lists([batch.slice(0, 2), batch.slice(2)] if together < 100 else [batch]) for r in x.to_pylist()]
        counts = [r for r in made if r["token"] is None]
        assert (sum(r["n"] for r in counts), sum(r["total"] for r in counts)) == (3, 8) and len(counts) == parts
        assert {(r["token"], p["id"], p["tf"], p["length"]) for r in made if r["token"] for p in r["list"]} == want


def test_an_empty_table_has_an_index(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "none"))
    done = search_index.run(spark, str(tmp_path / "none"), str(tmp_path / "index"), defaults("search_index"))
    assert done == {"documents": 0, "postings": 0}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_jobs_equal_their_statements(spark, name):
    found = connect().execute(queries.SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert rows(queries.QUERIES[name](spark, SF)) == want


def test_settings_are_checked(spark, tmp_path):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"day": "'once'"}))
    assert settings(spark, "usage_ledger", str(path))["day"] == "'once'"
    path.write_text(json.dumps({"dya": "x"}))
    with pytest.raises(ValueError, match="dya"):
        settings(spark, "usage_ledger", str(path))


def test_command_line(tmp_path):
    """In a process of its own: it makes and stops its session."""
    (tmp_path / "own.json").write_text(json.dumps({"day": "'once'"}))
    command = [sys.executable, "-m", "jobs.usage_ledger", "--events", f"{SF}/events.parquet", "--target", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/own.json"]
    ran = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert ran.returncode == 0 and "1 batches" in ran.stderr
    db = duckdb.connect()
    assert db.execute(f"SELECT sum(records) FROM '{tmp_path}/out/ledger/*/*.parquet'").fetchone() == db.execute(f"SELECT count(*) FROM '{SF}/events.parquet'").fetchone()
