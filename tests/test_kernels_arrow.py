"""Kernels on views of Arrow batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from echograin.operators import kernels as kn


def test_lines_are_views_of_their_batch():
    column = pa.array([[9.0], [1.0, None], None, [], [2.0, 3.0]], pa.list_(pa.float64()))
    batch = column.slice(1)
    rows = list(kn._rows(batch))
    assert np.allclose(rows[0], [1, np.nan], equal_nan=True) and rows[1] is None and len(rows[2]) == 0 and rows[3].tolist() == [2, 3]
    assert kn._lists([np.array([1.0]), None, np.zeros(0)]).to_pylist() == [[1.0], None, []]


def test_null_lines_stay_null(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None)], "k int, x array<double>")
    got = df.orderBy("k").select(kn.envelope()(F.col("x")), kn.fft_1d()(F.col("x"), F.lit(None).cast("array<double>")), kn.cross_correlated(F.col("x"), F.col("x"))).collect()
    assert np.allclose(got[0][1]["re"], np.fft.fft([1, 2, 3]).real) and np.allclose(got[0][2], np.correlate([1, 2, 3], [1, 2, 3], "full"))
    assert got[1][0] is None and got[1][1]["re"] is None and got[1][2] is None
