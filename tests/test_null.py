"""The strategy's place among random selections."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import statistics as st


@pytest.mark.parametrize("noise", [0.0, 1e-13, -1e-13])
def test_trials_that_differ_in_their_last_bits_are_ties(spark, noise):
    own = 0.1 + 0.2
    trials = spark.createDataFrame([(own + noise * i,) for i in range(50)] + [(own - 1,), (own + 1,)], "total_pct double")
    assert st.percentile_of(trials, "total_pct", F.lit(0.3)).first()[0] == pytest.approx(100 / 52)
