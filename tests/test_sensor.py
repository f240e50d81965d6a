import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill import functions as fn
from pulsemill.operators import models
from pulsemill.operators.upsert import DuplicateKeys, check_source
from pulsemill.plans import ledger, pipeline, sql, worker
from pulsemill.plans.store import Conflict, Store
from pulsemill.schemas import HOURLY, LOCATION_DIM, LOCATION_HLP, QUEUE, RAW, SPECTRUM
from pulsemill.session import load_config
from pulsemill.sources import files as landed
from pulsemill.sources import landing, mqtt
from pulsemill.streaming import live

T0 = dt.datetime(2026, 3, 1, 10, 0, 0)
NOW, LATER = dt.datetime(2026, 5, 1), dt.datetime(2026, 5, 2)


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def tone(location="Lahore_1", n=100, start=T0, hertz=10.0):
    return [(start + dt.timedelta(milliseconds=10 * k), location, math.sin(2 * math.pi * hertz * k / 100), 0.0, 1.0) for k in range(n)]


class Chain:
    """The models by hand, batch after batch."""

    def __init__(self, spark):
        self.spark = spark
        empty = lambda s: spark.createDataFrame([], s)
        self.helper, self.dim, self.hourly, self.spectrum = empty(LOCATION_HLP), empty(LOCATION_DIM), empty(HOURLY), empty(SPECTRUM)

    def keep(self, df):
        rows = df.collect()
        return self.spark.createDataFrame(rows, df.schema)

    def batch(self, rows, name, now=NOW, spectrum=True):
        stg = self.keep(models.staged(raw(self.spark, rows), name, now))
        self.helper = self.keep(self.helper.unionByName(models.new_locations(stg, self.helper, name, now)))
        self.dim = self.keep(models.dimension_step(self.dim, self.helper, name, now))
        self.fact = self.keep(models.facts(stg, self.dim, name, now))
        self.hourly = self.keep(models.merged_summary(self.hourly, models.hourly_summary(self.fact, self.dim, name, now), now))
        if spectrum:
            self.spectrum = self.keep(models.merged_spectra(self.spectrum, models.spectra(self.fact, name, now), now))
        return self


def test_pure_tone(spark):
    (row,) = Chain(spark).batch(tone(), "a").spectrum.collect()
    assert row.sample_count == 100 and len(row.fft_x) == len(row.freq_hz) == 51
    assert max(range(51), key=row.fft_x.__getitem__) == 10 and row.freq_hz[10] == 10.0 and abs(row.fft_x[10] - 50) < 1e-9
    x = [r[2] for r in tone()]
    power = (row.fft_x[0] ** 2 + 2 * sum(v * v for v in row.fft_x[1:50]) + row.fft_x[50] ** 2) / 100
    assert abs(power - sum(v * v for v in x)) < 1e-9  # Parseval


def test_tiny_groups(spark):
    rows = [r for k, n in enumerate((1, 4, 5)) for r in tone(n=n, start=T0 + dt.timedelta(minutes=k))]
    got = {r.sample_count: r for r in Chain(spark).batch(rows, "a").spectrum.collect()}
    assert got[1].freq_hz == [0.0] and got[4].freq_hz == [0.0, 25.0, 50.0] and got[5].freq_hz == [0.0, 20.0, 40.0]


def test_single_reading_has_no_deviation(spark):
    (row,) = Chain(spark).batch(tone(n=1), "a").hourly.collect()
    assert row.stddev_magnitude is None and row.sample_count == 1


def test_null_axis(spark):
    rows = tone(n=4)
    rows[1] = (*rows[1][:2], None, 1.0, 1.0)
    chain = Chain(spark).batch(rows, "a", spectrum=False)
    (row,) = chain.hourly.collect()
    assert row.sample_count == 4 and row.avg_y == 0.25
    assert chain.fact.where("magnitude is null").count() == 1
    with pytest.raises(Exception, match="null x in window 2026-03-01"):
        models.spectra(chain.fact, "a", NOW).collect()


def test_null_location_gets_a_key_in_each_batch(spark):
    chain = Chain(spark).batch(tone(None, 4), "a").batch(tone(None, 4), "b")
    assert [r.location_key for r in chain.helper.orderBy("location_key").collect()] == [1, 2]
    assert chain.fact.where("location_key is not null").count() == 0
    assert chain.hourly.count() == 2 and chain.spectrum.count() == 2


def test_case_variants(spark):
    chain = Chain(spark).batch(tone("Lahore_1", 2) + tone("lahore_1", 3), "a")
    assert chain.helper.count() == 2 and chain.fact.count() == 10
    chain = Chain(spark).batch(tone("Lahore_1", 2), "a").batch(tone("lahore_1", 3), "b")
    assert chain.helper.count() == 1 and chain.fact.count() == 3


def test_city_without_mark(spark):
    assert Chain(spark).batch(tone("lahore", 1), "a").helper.first().city == "lahore"


def test_split_minute_and_hour(spark):
    chain = Chain(spark).batch(tone(n=10), "a", NOW).batch(tone(n=4, start=T0 + dt.timedelta(seconds=30), hertz=1), "b", LATER)
    (s,) = chain.spectrum.collect()
    assert s.sample_count == 4 and s.ins_tmstmp == NOW and s.upd_tmstmp == LATER and s.batch_id == "b"
    (h,) = chain.hourly.collect()
    one = Chain(spark).batch(tone(n=10), "a").hourly.first()
    two = Chain(spark).batch(tone(n=4, start=T0 + dt.timedelta(seconds=30), hertz=1), "b").hourly.first()
    assert h.sample_count == 14 and h.avg_x == round((one.avg_x + two.avg_x) / 2 * 10000) / 10000
    assert h.stddev_magnitude == two.stddev_magnitude and h.max_magnitude == max(one.max_magnitude, two.max_magnitude) and h.ins_tmstmp == NOW


def test_three_batches_depend_on_order(spark):
    parts = [[(T0, "a_1", v, 0.0, 0.0)] for v in (1.0, 2.0, 4.0)]
    forth, back = Chain(spark), Chain(spark)
    for k in range(3):
        forth.batch(parts[k], str(k), spectrum=False)
        back.batch(parts[2 - k], str(k), spectrum=False)
    assert forth.hourly.first().avg_x == 2.75 and back.hourly.first().avg_x == 2.0


def test_rounding_is_binary(spark):
    got = spark.createDataFrame([(5.015, 2), (0.00005, 4), (-0.00015, 4)], "v double, p int").select(fn.rounded(F.col("v"), 2).alias("two"), fn.rounded(F.col("v")).alias("four")).collect()
    assert got[0].two == 5.01 and got[1].four == 0.0001 and got[2].four == -0.0001 or got[2].four == -0.0002


def test_scd2(spark):
    chain = Chain(spark).batch(tone("a_1", 1) + tone("b_1", 1), "a")
    edited = chain.helper.withColumn("city", F.when(F.col("location_name") == "a_1", "new").otherwise(F.lit(None).cast("string")))
    rows = models.dimension_step(chain.dim, edited, "b", LATER).orderBy("location_key", "valid_from").collect()
    assert [(r.location_key, r.city, r.is_current, r.oper) for r in rows] == [(1, "a", False, "U"), (1, "new", True, "I"), (2, "b", True, "I")]
    assert rows[0].valid_to == LATER and rows[1].valid_from == LATER and rows[1].valid_to is None


def test_two_source_rows_for_one_target(spark):
    t = spark.createDataFrame([(1, 1)], "k int, v int")
    check_source(t, spark.createDataFrame([(2, 1), (2, 2), (None, 1), (None, 2)], "k int, v int"), ["k"])
    with pytest.raises(DuplicateKeys):
        check_source(t, spark.createDataFrame([(1, 1), (1, 2)], "k int, v int"), ["k"])


def test_equal_times_have_one_order(spark):
    rows = [(T0, "a_1", float(v), float(-v), 0.0) for v in (3, 1, 2)]
    (s,) = Chain(spark).batch(rows, "a").spectrum.collect()
    assert np.allclose(s.fft_x, np.abs(np.fft.rfft([1, 2, 3]))) and np.allclose(s.fft_y, np.abs(np.fft.rfft([-1, -2, -3])))


def write(spark, rows, path, schema=RAW):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path) + ".d")
    part = next(p for p in os.listdir(str(path) + ".d") if p.endswith(".parquet"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    os.rename(f"{path}.d/{part}", path)
    for p in os.listdir(str(path) + ".d"):
        os.remove(f"{path}.d/{p}")
    os.rmdir(f"{path}.d")


def test_mixed_types_and_missing_columns(spark, tmp_path):
    write(spark, [("2026-03-01T10:00:00", "a_1", 1, 2, 3)], f"{tmp_path}/a.parquet", "timestamp string, location string, x long, y long, z long")
    write(spark, [(T0, "b_1", 2.7, 1.5, 0.5, "more")], f"{tmp_path}/b.parquet", "timestamp timestamp_ntz, location string, x double, y double, z double, extra string")
    got = landed.read_raw(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"]).orderBy("location").collect()
    assert [r.x for r in got] == [1.0, 2.7] and got[0].timestamp == T0
    write(spark, [(T0, "a_1", 1.0, 2.0)], f"{tmp_path}/c.parquet", "timestamp timestamp_ntz, location string, x double, z double")
    with pytest.raises(ValueError, match="no column y"):
        landed.read_raw(spark, [f"{tmp_path}/c.parquet"])
    assert landed.read_raw(spark, []).count() == 0


def test_ready_gate(spark, tmp_path):
    for name in ("none", "fresh", "old"):
        write(spark, tone(n=1), f"{tmp_path}/{name}/data.parquet")
        if name != "none":
            (tmp_path / name / "_READY").touch()
    os.utime(tmp_path / "old" / "_READY", (1, 1))
    assert landed.ready_folders(spark, str(tmp_path), settle_seconds=60) == [f"{tmp_path}/old"]
    assert [f.path for f in landed.files_in(spark, [f"{tmp_path}/old", str(tmp_path)])] == [f"{tmp_path}/{n}/data.parquet" for n in ("fresh", "none", "old")]
    assert len(landed.raw_folders(spark, str(tmp_path))) == 4


def test_chunks():
    assert [len(c) for c in landed.chunks(list(range(25)), 10)] == [10, 10, 5]
    assert landed.chunks([1, 2], 0) == [[1, 2]] and landed.chunks([], 0) == [] and landed.chunks([], 5) == []


def test_config(tmp_path):
    (tmp_path / "dev.env").write_text("# note\na=b=c\n\nmax_files_per_batch=3\n")
    got = load_config(str(tmp_path / "dev.env"))
    assert got["a"] == "b=c" and got["max_files_per_batch"] == "3" and got["worker_settle_seconds"] == "60"


def test_store_commits_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"s.t": RAW, "s.u": RAW})
    with store.begin() as tx:
        tx.append("s.t", raw(spark, tone(n=2)), "a")
        tx.append("s.u", raw(spark, tone(n=1)))
    with pytest.raises(RuntimeError, match="stop"), store.begin() as tx:
        tx.append("s.t", raw(spark, tone(n=5)), "b")
        assert tx.read("s.t").count() == 7
        raise RuntimeError("stop")
    assert store.read("s.t").count() == 2 and store.read("s.t", ["b"]).count() == 0 and store.read("s.u").count() == 1
    with pytest.raises(Conflict), store.begin() as tx:
        with store.begin() as other:
            other.append("s.t", raw(spark, tone(n=1)), "a")
        tx.append("s.t", raw(spark, tone(n=9)), "c")
    assert store.read("s.t").count() == 3
    store.compact("s.t")
    store.clean(keep=1)
    assert store.read("s.t", ["a"]).count() == 3 and len(store.files.names(f"{tmp_path}/_manifests")) == 1


@pytest.fixture
def lake(spark, tmp_path):
    config = {"data_path": f"{tmp_path}/raw", "catalog_path": f"{tmp_path}/lake", "max_files_per_batch": "2", "worker_retry_delay_seconds": "0", "worker_settle_seconds": "0"}
    for k in range(3):
        folder = tmp_path / "raw" / "20260301" / f"10000{k}"
        write(spark, tone(n=10, start=T0 + dt.timedelta(seconds=20 * k)), f"{folder}/data.parquet")
        (folder / "_READY").touch()
    return config


def test_batch_run(spark, lake):
    assert pipeline.run(spark, lake) == 2
    store = Store(spark, lake["catalog_path"])
    assert store.read(pipeline.FACT).count() == 30 and store.read(pipeline.CDC).where("status = 'SUCCESS'").count() == 3
    assert store.read(pipeline.HOURLY).first().sample_count == 30 and store.read(pipeline.SPECTRUM).first().sample_count == 10
    steps = store.read(pipeline.BENCHMARK)
    assert steps.count() == 12 and steps.where("status <> 'SUCCESS'").count() == 0
    assert sorted(r.data_ingested_rows for r in steps.where("step_name = '3_fact'").collect()) == [10, 20]
    assert pipeline.run(spark, lake) == 0 and pipeline.run(spark, lake, "latest") == 0
    with pytest.raises(ValueError):
        pipeline.run(spark, lake, "some")


def test_latest_takes_the_last_path(spark, lake):
    assert pipeline.run(spark, lake, "latest") == 1
    assert Store(spark, lake["catalog_path"]).read(pipeline.CDC).first().raw_file.endswith("100002/data.parquet")


def test_failed_batch_leaves_nothing_and_comes_again(spark, lake, tmp_path):
    bad = f"{tmp_path}/raw/20260301/100000/data.parquet"
    os.remove(bad)
    write(spark, [(T0, "Lahore_1", None, 1.0, 1.0)], bad)
    assert worker.work(spark, lake) == 1
    store = Store(spark, lake["catalog_path"])
    assert store.read(pipeline.FACT).count() == 10  # the second batch alone
    queue = {r.file_path[-19:-13]: r for r in store.read(worker.QUEUE).collect()}
    assert [queue[f"10000{k}"].status for k in range(3)] == ["FAILED", "FAILED", "SUCCESS"] and queue["100000"].attempts == 1
    assert "null x" in queue["100000"].last_error
    assert ledger.failed_steps(store.read(pipeline.BENCHMARK)).count() == 1
    os.remove(bad)
    write(spark, tone(n=10), bad)
    assert worker.work(spark, lake) == 0 and worker.work(spark, lake) == 0
    assert store.read(pipeline.FACT).count() == 30 and store.read(pipeline.HOURLY).first().sample_count == 30


def queue_row(path="/r/a/data.parquet", size=1, mtime=1, status="QUEUED", attempts=0, retry=NOW, updated=NOW):
    return (path, path.rpartition("/")[0], size, mtime, status, attempts, retry, "e", "run", NOW, updated)


def test_queue(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), QUEUE)
    same = ledger.enqueued(make(queue_row(status="SUCCESS", attempts=3)), make(queue_row()), LATER).first()
    assert (same.status, same.attempts) == ("SUCCESS", 3)
    other = ledger.enqueued(make(queue_row(status="SUCCESS", attempts=3)), make(queue_row(size=2)), LATER).first()
    assert (other.status, other.attempts, other.last_error, other.last_run_id, other.created_ts, other.next_retry_ts) == ("QUEUED", 0, None, "run", NOW, LATER)
    q = make(queue_row())
    for attempt, wait in ((1, 120), (2, 240), (3, 480)):
        q = ledger.running(q, ["/r/a/data.parquet"], "r", LATER)
        assert q.first().attempts == attempt - 1  # as only a failure counts
        q = ledger.failed(q, ["/r/a/data.parquet"], "r2", "x" * 3000, 120, LATER)
        row = q.first()
        assert row.last_run_id == "r2"
        assert row.attempts == attempt and row.next_retry_ts == LATER + dt.timedelta(seconds=wait) and len(row.last_error) == 2000
    assert ledger.reclaimed(make(queue_row(status="RUNNING")), LATER, 60).first().status == "QUEUED"
    assert ledger.reclaimed(make(queue_row(status="RUNNING", updated=LATER)), LATER, 60).first().status == "RUNNING"
    rows = make(queue_row("/r/not/d.parquet", updated=dt.datetime(2020, 1, 1)), queue_row("/r/b/d.parquet"), queue_row("/r/c/d.parquet", attempts=10), queue_row("/r/b/e.parquet", retry=dt.datetime(2030, 1, 1)), queue_row("/r/b/f.parquet", status="RUNNING"))
    assert [r.file_path for r in ledger.due(rows, LATER, 1, 10, ["/r/b", "/r/c"]).collect()] == ["/r/b/d.parquet"]


def test_landing(spark, tmp_path):
    at = dt.datetime(2026, 3, 1, 10, 0, 5)
    text = [json.dumps({"timestamp": "2026-03-01T10:00:00", "location": "a_1", "x": 1, "y": 2.5, "z": 0})]
    rows = landing.decoded(spark.createDataFrame([(t,) for t in text], "value string"))
    one, two = landing.land(rows, str(tmp_path), at), landing.land(rows, str(tmp_path), at)
    assert one.endswith("/20260301/100005") and two.endswith("/20260301/100005_1")
    assert os.path.exists(f"{one}/_READY") and landed.read_raw(spark, [f"{one}/data.parquet"]).first().y == 2.5
    assert landing.land(rows.limit(0), str(tmp_path), at) is None


def test_lander_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"timestamp": "2026-03-01T10:00:00", "location": "a_1", "x": 1, "y": 2, "z": 0}) + "\n")
    landing.start_lander(spark.readStream.text(f"{tmp_path}/in"), f"{tmp_path}/raw", f"{tmp_path}/check", once=True).awaitTermination()
    assert len(landed.raw_files(spark, f"{tmp_path}/raw")) == 1


def test_mqtt_reader_hands_out_and_commits():
    reader = mqtt.MqttReader({})
    reader.client = object()
    reader.receive("t", b"1")
    reader.receive("t", b"2")
    rows, end = reader.read({"n": 0})
    assert list(rows) == [("t", b"1"), ("t", b"2")] and end == {"n": 2}
    reader.receive("t", b"3")
    assert list(reader.readBetweenOffsets({"n": 1}, {"n": 3})) == [("t", b"2"), ("t", b"3")]
    reader.commit({"n": 2})
    rows, end = reader.read({"n": 2})
    assert list(rows) == [("t", b"3")] and end == {"n": 3}


def test_stream_of_files(spark, lake, tmp_path):
    store = Store(spark, lake["catalog_path"])
    for _ in range(2):  # the second run finds nothing new
        live.start(spark, lake["data_path"], store, f"{tmp_path}/check", lake, 1).awaitTermination()
        assert store.read(pipeline.FACT).count() == 30 and store.read(pipeline.HOURLY).first().sample_count == 30


def test_extra_functions(spark):
    row = spark.range(1).select(fn.parent_path(F.lit("/a/b/c.parquet")).alias("p"), fn.megabytes(F.lit(358088202)).alias("mb"), fn.retry_delay(120, F.lit(9)).alias("d"), fn.truncated("hour", F.lit(None).cast("timestamp_ntz")).alias("h")).first()
    assert (row.p, row.mb, row.d, row.h) == ("/a/b", 341.5, 7680.0, None)


def test_sql_over_a_store(spark, lake):
    pipeline.run(spark, lake)
    store = Store(spark, lake["catalog_path"])
    sql.register_functions(spark)
    sql.register_views(store)
    assert spark.sql("SELECT sum(sample_count) FROM marts.accel_hourly_summary").first()[0] == 30
    assert spark.sql("SELECT count(*) FROM marts.pipeline_benchmark WHERE status = 'FAILED'").first()[0] == 0
    assert spark.sql("SELECT count(*) FROM staging.realtime_job_queue").first()[0] == 0
    row = spark.sql("SELECT fft_magnitude(collect_list(x)) AS m, fft_freqs(collect_list(x), 100.0D) AS f FROM curated.fact_accelerometer").first()
    assert len(row.m) == len(row.f) == 16 and row.f[1] == 100.0 / 30


def test_sql_statements_and_parameters(spark, tmp_path):
    assert sql.statements("a; b -- c; d\n;;/* e; */ 'f;''g' \"h;\" `i;`") == ["a", "b -- c; d", "/* e; */ 'f;''g' \"h;\" `i;`"]
    (tmp_path / "m.sql").write_text("SELECT 1;\nSELECT CAST(:v AS INT) AS v, ':v' AS t, '10:30'::STRING AS c -- :none\n")
    assert tuple(sql.run_sql_file(spark, f"{tmp_path}/m.sql", {"v": "7", "w": 1}).first()) == (7, ":v", "10:30")
    assert sql.run_sql(spark, " ; -- nothing\n") is None
    with pytest.raises(Exception, match="missing"):
        sql.run_sql(spark, "SELECT :missing")
