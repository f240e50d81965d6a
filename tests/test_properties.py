import duckdb
import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsemill.functions import rounded, spectrum_frequencies, spectrum_magnitude
from pulsemill.operators.upsert import upsert

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
KEY = st.one_of(st.none(), st.integers(0, 6))


def test_rounding_is_the_engines(spark):
    rng = np.random.default_rng(0)
    ties = rng.integers(-10**7, 10**7, 3000) / 2e4 + rng.integers(-1000, 1000, 3000)
    values = np.r_[ties, rng.normal(size=2000) * 10.0 ** rng.integers(-6, 7, 2000), 0.0, 5.015, 1e300]
    frame = pd.DataFrame({"i": range(len(values)), "v": values})
    ours = spark.createDataFrame(frame).select("i", rounded(F.col("v")).alias("r")).toPandas().sort_values("i")["r"].to_numpy()
    theirs = duckdb.sql("SELECT round(v, 4) + 0.0 AS r FROM frame ORDER BY i").df()["r"].to_numpy()
    assert (ours == theirs).all()


@SLOW
@given(st.lists(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40), min_size=1, max_size=6))
def test_spectrum(spark, series):
    rows = spark.createDataFrame([(s,) for s in series], "v array<double>").select("v", spectrum_magnitude("v").alias("m"), spectrum_frequencies(F.size("v"), 100.0).alias("f")).collect()
    for r in rows:
        n, m = len(r.v), np.array(r.m)
        assert len(m) == n // 2 + 1 and np.allclose(r.f, np.fft.rfftfreq(n, 0.01))
        weight = np.full(len(m), 2.0)
        weight[0] = 1
        if n % 2 == 0:
            weight[-1] = 1
        assert np.isclose((weight * m**2).sum() / n, np.square(r.v).sum(), rtol=1e-6, atol=1e-6)


@SLOW
@given(st.lists(st.tuples(KEY, st.integers(0, 9)), max_size=8, unique_by=lambda r: (r[0] is None, r[0])), st.lists(st.tuples(KEY, st.integers(0, 9)), max_size=8, unique_by=lambda r: (r[0] is None, r[0])))
def test_upsert(spark, target, source):
    make = lambda rows: spark.createDataFrame([(k, v, v) for k, v in rows], "k int, v int, kept int")
    got = upsert(make(target), make(source), ["k"], {"v": lambda t, s: t("v") + s("v")}, lambda t, s: t("v") != s("v")).collect()
    new = {k: v for k, v in source if k is not None}
    want = [(k, v + new[k] if k in new and new[k] != v else v, v) for k, v in target]
    old = {k for k, _ in target if k is not None}
    want += [(k, v, v) for k, v in source if k not in old or k is None]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
