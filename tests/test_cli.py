import datetime as dt
import json

import pytest

from pulsemill.plans import pipeline, worker
from pulsemill.plans.store import Store

from .test_sensor import T0, tone, write


@pytest.fixture
def project(spark, tmp_path, monkeypatch):
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "dev.env").write_text(f"# paths\ndata_path={tmp_path}/raw\ncatalog_path={tmp_path}/lake\nworker_settle_seconds=0\n")
    for k in range(2):
        write(spark, tone(n=5, start=T0 + dt.timedelta(minutes=k)), f"{tmp_path}/raw/20260301/10000{k}/data.parquet")
        (tmp_path / "raw" / "20260301" / f"10000{k}" / "_READY").touch()
    monkeypatch.chdir(tmp_path)
    for module in (pipeline, worker):
        monkeypatch.setattr(module, "session", lambda: spark)
    return tmp_path


def test_batch_command(spark, project, capsys):
    assert pipeline.main(["dev", "some"]) == 1
    assert pipeline.main(["dev"]) == 0 and "1 batches" in capsys.readouterr().out
    assert pipeline.main(["dev", "backfill"]) == 0 and "0 batches" in capsys.readouterr().out
    assert Store(spark, f"{project}/lake").read(pipeline.SPECTRUM).count() == 2


def test_worker_command(spark, project, capsys):
    import fcntl

    lock = f"{project}/lock"
    with open(lock, "w") as held:
        fcntl.flock(held, fcntl.LOCK_EX)
        assert worker.main(["dev", "--lock-file", lock]) == 0 and "another" in capsys.readouterr().out
    assert worker.main(["dev", "--lock-file", lock]) == 0
    queue = Store(spark, f"{project}/lake").read(worker.QUEUE).collect()
    assert len(queue) == 2 and {r.status for r in queue} == {"SUCCESS"} and {r.attempts for r in queue} == {0}


def test_metrics_row(spark, project):
    pipeline.main(["dev"])
    row = Store(spark, f"{project}/lake").read(pipeline.BENCHMARK).where("step_name = '4_hourly_summary'").first()
    assert row.data_ingested_rows == 1 and row.duration_ms > 0 and row.start_ts <= row.end_ts and row.data_ingested_bytes > 0
    assert json.loads(json.dumps(row.raw_file)).count("data.parquet") == 2
