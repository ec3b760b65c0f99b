"""Increments of two and more runs, replays, late rows; batch equals stream."""

import os
import shutil
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.money import to_minor
from tallyloom.operators.incremental import (
    BucketTable,
    append_rows,
    append_to,
    combine_buckets,
    combine_partitions,
    delete_insert,
    key_bucket,
    merge_rows,
    newer_rows,
    refresh_partitions,
    run_increment,
    run_increment_in_place,
    split_from,
)
from tallyloom.plans.registry import MODELS
from tallyloom.session import scratch_path
from tallyloom.sources.readers import (
    SHOP_SCHEMAS,
    TABLES,
    ShopTables,
    named_source,
    read_csv,
    read_csv_parted,
    read_tasks,
    read_tasks_parted,
)
from tallyloom.sources.sinks import VersionedTable, materialize
from tallyloom.streaming.upsert import above_mark, into_buckets, into_partitions, into_versions, load_arrived
from tests.conftest import rows
from tests.oracle import check, connect

SCHEMA = "id int, v string, d date"


def day(n):
    return date(2024, 1, n)


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def upsert(target, batch):
    return merge_rows(target, batch, ["id"], ["-d"])


def test_high_water_mark_is_strict(spark):
    target = frame(spark, (1, "a", day(5)), (2, "b", None))
    source = frame(spark, (3, "late", day(4)), (4, "equal", day(5)), (5, "new", day(6)), (6, "null", None))
    assert rows(newer_rows(source, target, "d")) == [(5, "new", day(6))]
    back = rows(newer_rows(source, target, "d", look_back="1 days"))
    assert [r[0] for r in back] == [4, 5]
    assert newer_rows(source, None, "d").count() == 4
    assert newer_rows(source, target.filter("id = 2"), "d").count() == 4


def test_merge_takes_the_newest_of_the_batch(spark):
    target = frame(spark, (1, "old", day(1)), (2, "keep", day(1)))
    batch = frame(spark, (1, "x", day(2)), (1, "y", day(3)), (3, "n", day(2)))
    assert rows(upsert(target, batch)) == [(1, "y", day(3)), (2, "keep", day(1)), (3, "n", day(2))]


def test_delete_insert_adds_the_whole_batch(spark):
    target = frame(spark, (1, "old", day(1)), (2, "keep", day(1)))
    batch = frame(spark, (1, "x", day(2)), (1, "y", day(3)))
    got = rows(delete_insert(target, batch, ["id"]))
    assert got == [(1, "x", day(2)), (1, "y", day(3)), (2, "keep", day(1))]
    assert rows(append_rows(target, batch))[0][0] == 1


def test_three_increments_and_a_replay(spark):
    table = VersionedTable(spark, scratch_path(spark, "t"))
    assert table.current() is None
    sources = [
        frame(spark, (1, "a", day(1)), (2, "b", day(2))),
        frame(spark, (2, "b2", day(3)), (3, "c", day(3)), (1, "equal", day(2))),
        frame(spark, (3, "c2", day(5)), (9, "late", day(1))),
    ]
    for source in sources:
        run_increment(table, source, "d", upsert)
    want = [(1, "a", day(1)), (2, "b2", day(3)), (3, "c2", day(5))]
    assert rows(table.current()) == want
    run_increment(table, sources[-1], "d", upsert)
    assert rows(table.current()) == want


def test_an_unfinished_version_is_not_read(spark):
    path = scratch_path(spark, "t")
    table = VersionedTable(spark, path)
    table.commit(frame(spark, (1, "a", day(1))))
    conf = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    frame(spark, (2, "half", day(2))).write.options(**conf).parquet(table.version_path(1))
    assert rows(table.current()) == [(1, "a", day(1))]
    table.commit(frame(spark, (3, "c", day(3))))
    assert rows(table.current()) == [(3, "c", day(3))]


def test_append_and_partition_refresh(spark):
    path = scratch_path(spark, "a")
    append_to(path, frame(spark, (1, "a", day(1))), "d", first_run=True)
    got = append_to(path, frame(spark, (1, "a", day(1)), (2, "b", day(2))), "d", first_run=False)
    assert rows(got) == [(1, "a", day(1)), (2, "b", day(2))]

    path = scratch_path(spark, "p")

    def count(df):
        return df.groupBy("d").agg(F.count("*").alias("n"))

    refresh_partitions(path, frame(spark, (1, "a", day(1)), (2, "b", day(2))), "d", count)
    # Day 1 is closed: its late row is not counted; day 2 is recomputed.
    later = frame(spark, (8, "late", day(1)), (2, "b", day(2)), (3, "c", day(2)), (4, "d", day(3)))
    got = refresh_partitions(path, later, "d", count)
    assert rows(got.select("d", "n")) == [(day(1), 1), (day(2), 2), (day(3), 1)]


def test_partition_merge_touches_only_its_partitions(spark):
    path = scratch_path(spark, "m")

    def parts(*data):
        return frame(spark, *data).withColumn("p", F.col("id") % 3)

    first = parts((1, "a", day(1)), (2, "b", day(1)), (3, "c", day(1)))
    combine_partitions(path, first, upsert, "p")
    files = {f for f in spark.read.parquet(path).inputFiles() if "p=2" in f or "p=0" in f}
    second = parts((1, "a2", day(2)), (1, "a3", day(3)), (4, "n", day(2)))
    for _ in range(2):
        got = combine_partitions(path, second, upsert, "p")
    assert rows(got.select("id", "v")) == [(1, "a3"), (2, "b"), (3, "c"), (4, "n")]
    assert files <= set(got.inputFiles())


@pytest.mark.parametrize("per_trigger", [None, 1])
@pytest.mark.parametrize("kind", ["versions", "partitions", "buckets"])
def test_stream_equals_batch(spark, per_trigger, kind):
    folder, progress, out = (scratch_path(spark, p) for p in ("in", "cp", "out"))
    table = VersionedTable(spark, out)
    buckets = BucketTable(spark, out, ["id"], 1)
    if kind == "versions":
        apply = into_versions(table, upsert)
    elif kind == "buckets":
        apply = into_buckets(buckets, upsert)
    else:
        apply = into_partitions(out, upsert, "p")

    def state():
        if kind == "partitions":
            df = spark.read.parquet(out)
        else:
            df = (table if kind == "versions" else buckets).current()
        return rows(df.select("id", "v", "d"))

    drops = [
        frame(spark, (1, "a", day(1)), (2, "b", day(1))),
        frame(spark, (2, "b2", day(2)), (3, "c", day(2))),
        frame(spark, (1, "a3", day(3))),
    ]
    batch = None
    for drop in drops:
        arrived = drop.withColumn("p", F.col("id") % 2)
        arrived.coalesce(1).write.mode("append").parquet(folder)
        load_arrived(spark, folder, arrived.schema, progress, apply, per_trigger)
        batch = upsert(batch, drop)
        assert state() == rows(batch)
    # Nothing new: the state stays. A replayed micro-batch writes the same state.
    load_arrived(spark, folder, arrived.schema, progress, apply)
    assert state() == rows(batch)
    apply(arrived, 2)
    assert state() == rows(batch)


# --- sources and sinks ------------------------------------------------------


def test_csv_types_and_nulls(spark, tmp_path):
    file = tmp_path / "sessions.csv"
    file.write_text(
        "id,customer_id,session_start,session_end,device_type,channel\n"
        "1,7,2024-01-01 10:00:00,2024-01-01 10:30:00,mobile,web\n"
        "2,,2024-01-02 00:00:00,,,\"a, b\"\n"
    )
    df = read_csv(spark, str(file), SHOP_SCHEMAS["sessions"])
    second = df.filter("id = 2").first()
    assert df.schema == SHOP_SCHEMAS["sessions"]
    assert second["customer_id"] is None and second["device_type"] is None
    assert second["channel"] == "a, b"
    assert len(SHOP_SCHEMAS) == 22


def test_tasks_skip_blank_lines_and_demos(spark, tmp_path):
    file = tmp_path / "tasks.jsonl"
    file.write_text(
        '{"instance_id": "t2", "instruction": "b", "output_schema": {"x": {"columns": {"A": "INT"}}}}\n\n'
        '{"instance_id": "demo1", "instruction": "c"}\n   \n{"instruction": "no id"}\n'
        '{"instance_id": "t1", "instruction": "a"}\n'
    )
    got = read_tasks(spark, str(file))
    assert sorted(r["instruction"] for r in got.collect()) == ["a", "b", "no id"]
    assert read_tasks(spark, str(file), max_tasks=1).count() == 1


def test_materialize_kinds(spark):
    df = frame(spark, (1, "a", day(1)))
    assert materialize(df, "ephemeral", "x") is df
    assert rows(materialize(df, "view", "tallyloom_test")) == rows(df)
    assert rows(materialize(df, "table", "x", scratch_path(spark, "x"), ("d",)).select("id")) == [(1,)]
    with pytest.raises(ValueError, match="path"):
        materialize(df, "table", "x")


def test_buckets_follow_the_size_and_untouched_ones_stay(spark):
    def files(path):
        return set(spark.read.parquet(path).inputFiles())

    path = scratch_path(spark, "buckets")
    first = spark.createDataFrame([(i, i % 5, 0) for i in range(40)], "k int, d int, v int")

    def upsert(target, batch):
        return merge_rows(target, batch, ["k"], ["-v"])

    state = run_increment_in_place(path, first, "d", upsert, ["k"], rows_per_bucket=6)
    assert state.count() == 40 and len(files(path)) > 4
    before = files(path)
    second = spark.createDataFrame([(3, 9, 1), (None, 9, 1)], "k int, d int, v int")
    state = run_increment_in_place(path, first.unionByName(second), "d", upsert, ["k"], rows_per_bucket=6)
    assert state.count() == 41 and state.filter("v = 1").count() == 2
    kept = before & files(path)
    assert len(before) - 2 <= len(kept) < len(before), "only touched buckets are written"


KV = "k int, d int, v int"


def newest(target, batch):
    return merge_rows(target, batch, ["k"], ["-v"])


def bucket_sizes(spark, path):
    return {r.bucket: r.n for r in spark.read.parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def test_buckets_split_as_the_table_grows(spark):
    path = scratch_path(spark, "grown")
    state = combine_buckets(path, spark.range(10).selectExpr("int(id) k", "0 d", "0 v"), newest, ["k"], 100)
    assert list(bucket_sizes(spark, path).values()) == [10]
    many = spark.range(20_000).selectExpr("int(id) k", "1 d", "1 v")
    state = combine_buckets(path, many, newest, ["k"], 100)
    sizes = bucket_sizes(spark, path)
    assert state.count() == 20_000 and state.filter("v <> 1").isEmpty()
    assert len(sizes) == 201 and max(sizes.values()) < 400
    # one bucket more: the one it is split from and the touched one are written
    before = set(spark.read.parquet(path).inputFiles())
    table = BucketTable(spark, path, ["k"], 100)
    state = table.apply(spark.createDataFrame([(5, 2, 9), (90_000, 2, 9)], KV), newest)
    assert state.count() == 20_001 and table.buckets() == 201
    state = table.apply(spark.range(90_001, 90_101).selectExpr("int(id) k", "2 d", "9 v").limit(60), newest)
    assert table.buckets() == 201 and state.count() == 20_061
    assert len(before & set(spark.read.parquet(path).inputFiles())) > 100
    assert sorted(r.k for r in state.filter("v = 9").select("k").collect())[:2] == [5, 90_000]


def test_growth_moves_keys_of_one_bucket_only(spark):
    for n in (1, 2, 3, 5, 8, 13):
        moved = spark.range(2_000).select(key_bucket(["id"], n).alias("a"), key_bucket(["id"], n + 1).alias("b"))
        gone = {(r.a, r.b) for r in moved.filter("a <> b").distinct().collect()}
        assert gone <= {(split_from(n, n), n)} and gone
        assert {r.a for r in moved.select("a").distinct().collect()} == set(range(n))


def test_rows_without_a_key_survive_and_come_once(spark):
    data = [(None, 1, 1), (None, 1, 2), (None, 1, 2), (3, 1, 3)]
    batch = spark.createDataFrame(data, KV)
    path = scratch_path(spark, "loose")
    for _ in range(3):
        state = combine_buckets(path, batch, newest, ["k"], 2)
        assert rows(state) == sorted(data, key=repr)

    def replace(target, batch):
        return delete_insert(target, batch, ["k"])

    path = scratch_path(spark, "loose")
    twice = batch.unionByName(spark.createDataFrame([(3, 1, 3)], KV))
    for _ in range(2):
        state = combine_buckets(path, twice, replace, ["k"], 2)
        assert rows(state) == sorted([*data, (3, 1, 3)], key=repr)


def test_empty_batches_change_nothing(spark):
    path, none = scratch_path(spark, "empty"), spark.createDataFrame([], KV)
    first = run_increment_in_place(path, none, "d", newest, ["k"])
    assert first.columns == ["k", "d", "v"] and first.count() == 0
    rows_in = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], KV)
    assert run_increment_in_place(path, rows_in, "d", newest, ["k"]).count() == 2
    files = set(spark.read.parquet(path).inputFiles())
    assert run_increment_in_place(path, none, "d", newest, ["k"]).count() == 2
    assert files == set(spark.read.parquet(path).inputFiles())


def test_a_run_that_stops_before_its_buckets_count(spark, monkeypatch):
    path = scratch_path(spark, "stopped")
    table = BucketTable(spark, path, ["k"], 5)
    table.apply(spark.range(10).selectExpr("int(id) k", "0 d", "0 v"), newest)
    batch = spark.range(5, 40).selectExpr("int(id) k", "1 d", "1 v")
    real = BucketTable._replace
    for stop in (1, 2):  # before the new number of buckets counts, and after
        calls = []

        def failing(self, rows, calls=calls, stop=stop):
            calls.append(1)
            if len(calls) == stop and stop == 2:
                raise OSError("lost")
            real(self, rows)
            if len(calls) == stop:
                raise OSError("lost")

        monkeypatch.setattr(BucketTable, "_replace", failing)
        with pytest.raises(OSError):
            table.apply(batch, newest)
        got = table.current()
        assert got.select("k").distinct().count() == got.count() >= 10
        assert got.filter("k < 5").count() == 5
    monkeypatch.setattr(BucketTable, "_replace", real)
    state = table.apply(batch, newest)
    want = [(k, int(k >= 5), int(k >= 5)) for k in range(10)] + [(k, 1, 1) for k in range(10, 40)]
    assert rows(state) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n in MODELS if n.startswith("inc_") and n not in ("inc_06_incremental_aggregate",)])
def test_increments_with_null_keys(spark, tmp_path, name):
    """Orders and lines without a number, in all models of this family."""
    for source in TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{source}.parquet", tmp_path)
    for source, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey")):
        file = f"{tmp_path}/{source}.parquet"
        duckdb.sql(f"""COPY (SELECT * EXCLUDE (r) REPLACE (CASE WHEN r % 17 = 0 THEN NULL ELSE {key} END AS {key})
                       FROM (SELECT *, row_number() OVER () AS r FROM '{file}')) TO '{file}.new' (FORMAT parquet)""")
        os.replace(f"{file}.new", file)
    assert check(spark, connect(str(tmp_path)), str(tmp_path), MODELS[name]) is None


def test_null_partitions_are_kept(spark):
    path = scratch_path(spark, "parts")
    schema = "k int, p string"

    def upsert(target, batch):
        return merge_rows(target, batch, ["k"], ["k"])

    combine_partitions(path, spark.createDataFrame([(1, None), (2, "a")], schema), upsert, "p")
    got = combine_partitions(path, spark.createDataFrame([(3, None)], schema), upsert, "p")
    assert rows(got.select("k", "p")) == [(1, None), (2, "a"), (3, None)]


def test_late_rows_are_appended_once(spark):
    path = scratch_path(spark, "late")
    day = "k int, d date"
    rows_of = [(1, date(2024, 1, 1)), (2, date(2024, 1, 5))]
    append_to(path, spark.createDataFrame(rows_of, day), "d", True)
    late = spark.createDataFrame([*rows_of, (3, date(2024, 1, 4)), (4, date(2024, 1, 6))], day)
    for _ in range(2):
        got = append_to(path, late, "d", False, look_back="3 days", keys=["k"])
    assert [r.k for r in got.orderBy("k").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="keys"):
        append_to(path, late, "d", False, look_back="3 days")


def test_named_sources_reach_the_csv_tables(spark, tmp_path):
    (tmp_path / "raw_warehouses.csv").write_text("id,name,city,state,capacity\n1,Main,Ulm,,12\n")
    got = named_source(spark, {"raw": str(tmp_path)}, "raw", "warehouses")
    assert rows(got) == [(1, "Main", "Ulm", None, 12)]
    assert ShopTables(spark, str(tmp_path)).warehouses.schema == SHOP_SCHEMAS["warehouses"]
    with pytest.raises(KeyError, match="unknown source"):
        named_source(spark, {"raw": str(tmp_path)}, "raw", "nothing")
    with pytest.raises(KeyError, match="unknown group"):
        named_source(spark, {}, "raw", "warehouses")


def test_broken_input_stops_the_read(spark, tmp_path):
    (tmp_path / "raw_warehouses.csv").write_text("id,name,city,state,capacity\n1,Main,Ulm,,twelve\n")
    with pytest.raises(Exception, match="MALFORMED"):
        ShopTables(spark, str(tmp_path)).warehouses.collect()
    (tmp_path / "tasks").write_text('{"instance_id": "a", "instruction": "x"}\n{"instance_id": "b"}\n\n')
    assert [r.instance_id for r in read_tasks(spark, str(tmp_path / "tasks")).collect()] == ["a", "b"]
    (tmp_path / "bad").write_text('{"instance_id": "a"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED"):
        read_tasks(spark, str(tmp_path / "bad")).collect()


def test_money_that_does_not_fit_is_null(spark):
    df = spark.createDataFrame([(1, 1.125), (2, float("nan")), (3, 1e17), (4, -2.5), (5, None)], "i int, x double")
    assert rows(df.select("i", to_minor("x"))) == [(1, 113), (2, None), (3, None), (4, -250), (5, None)]


def test_rows_that_do_not_parse_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,v,d\n1,x,2024-01-02\nno,"y, z",2024-01-03\n3,,\n4,w,2024-13-77\nno,w,never\n5,w,2024-01-05,more\n6,w\n'
    )
    (tmp_path / "b.csv").write_text("id,v,d\n7,x,2024-01-02\nno,q,2024-01-02\n")
    schema = spark.createDataFrame([], SCHEMA).schema
    parsed = read_csv_parted(spark, f"{tmp_path}/*.csv", schema)
    assert parsed.rows.schema == schema
    assert rows(parsed.rows) == [(1, "x", date(2024, 1, 2)), (3, None, None), (7, "x", date(2024, 1, 2))]
    got = {(r.file.rsplit("/", 1)[1], r.line): r.reason for r in parsed.rejects.collect()}
    assert got == {
        ("a.csv", 'no,"y, z",2024-01-03'): "id is not int",
        ("a.csv", "4,w,2024-13-77"): "d is not date",
        ("a.csv", "no,w,never"): "id is not int, d is not date",
        ("a.csv", "5,w,2024-01-05,more"): "too many fields",
        ("a.csv", "6,w"): "wrong number of fields",
        ("b.csv", "no,q,2024-01-02"): "id is not int",
    }
    counts = {(r.file.rsplit("/", 1)[1], r.reason): r.lines for r in parsed.counts().collect()}
    assert counts["a.csv", "id is not int"] == 1 and counts["b.csv", "id is not int"] == 1 and len(counts) == 6
    # Columns left out of a query do not change which lines fail.
    assert rows(parsed.rows.select("v")) == [("x",), ("x",), (None,)]
    with pytest.raises(Exception):
        read_csv(spark, f"{tmp_path}/a.csv", schema).collect()
    (tmp_path / "none.csv").write_text("")
    nothing = read_csv_parted(spark, f"{tmp_path}/none.csv", schema)
    assert rows(nothing.rows) == [] and rows(nothing.counts()) == []


def test_lines_that_are_no_tasks_are_set_aside(spark, tmp_path):
    (tmp_path / "tasks.jsonl").write_text(
        '{"instance_id": "t1", "instruction": "do"}\n\n{"instance_id": "demo1"}\nnot json\n'
        '{"instance_id": "t2", "output_schema": 7}\n{"instance_id": "t3"\n'
    )
    parsed = read_tasks_parted(spark, f"{tmp_path}/tasks.jsonl")
    assert [r.instance_id for r in parsed.rows.collect()] == ["t1"]
    assert {r.line: r.reason for r in parsed.rejects.collect()} == {
        "not json": "not JSON",
        '{"instance_id": "t2", "output_schema": 7}': "does not fit the schema",
        '{"instance_id": "t3"': "not JSON",
    }


def arrivals(spark):
    """Deliveries of (id, v, at): late rows within and beyond two days, rows
    that come again in the same file and later, and a newer version."""
    days = [
        [(1, "a", 1), (2, "b", 5), (2, "b", 5)],
        [(3, "c", 4), (4, "late", 2), (2, "b", 5), (5, "d", 9)],
        [(6, "e", 8), (2, "b", 5), (5, "d2", 9), (7, "late", 7), (5, "d", 9)],
        [(8, "f", 10), (6, "e", 8), (9, "g", 12)],
        [(10, "late", 10), (11, "h", 11), (11, "h", 11)],
    ]
    schema = "id int, v string, day int"
    at = F.timestamp_seconds(F.col("day") * 86_400).alias("at")
    return [spark.createDataFrame(d, schema).select("id", "v", at) for d in days]


@pytest.mark.parametrize("restarts", [False, True])
def test_late_and_repeated_rows_in_a_stream(spark, tmp_path, restarts):
    """The stream keeps what the batch form with the same look-back keeps;
    every row once, in one call and with a restart after each file."""
    files = arrivals(spark)
    want, taken = None, set()
    for f in files:
        new = newer_rows(f, want, "at", "2 days")
        taken |= {(r.id, r.v) for r in new.collect()}
        want = new if want is None else want.unionByName(new)
    assert "late" not in {v for _, v in taken} and len(taken) == 9

    source = tmp_path / "in"
    table = VersionedTable(spark, str(tmp_path / "table"))
    apply = above_mark(str(tmp_path / "marks"), "at", into_versions(table, append_rows), "2 days")
    for i, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(str(source))
        newest = max(source.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))
        if restarts:
            load_arrived(spark, str(source), f.schema, str(tmp_path / "progress"), apply, 1, ("at", "2 days"))
    load_arrived(spark, str(source), f.schema, str(tmp_path / "progress"), apply, 1, ("at", "2 days"))
    got = [(r.id, r.v) for r in table.current().collect()]
    assert sorted(got) == sorted(taken)
    assert len(os.listdir(tmp_path / "marks")) <= 2


def test_replayed_micro_batch_is_cut_at_the_same_mark(spark, tmp_path):
    files, seen = arrivals(spark), []
    apply = above_mark(str(tmp_path / "m"), "at", lambda b, n: seen.append(rows(b)), "2 days")
    for n in (0, 1, 1, 2, 2):
        apply(files[n], n)
    assert seen[1] == seen[2] and seen[3] == seen[4] and len(seen[1]) == 3
