"""Model queries take every curve and order, whatever its id."""

import pytest
from pyspark.sql import functions as F

from chartmill import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("shifted"))
    for name, key in (("events", "user_id"), ("lineitem", "l_orderkey")):
        spark.read.parquet(f"{DIR}/{name}.parquet").withColumn(key, F.col(key) + 100_000).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("name", ["model_adaptive_knots", "model_charge_table", "model_spice_text", "model_chain_segments"])
def test_every_id(spark, shifted, name):
    q = queries.queries()[name]
    there, here = q(spark, shifted), q(spark, DIR)
    key = "panel" if "panel" in here.columns else "curve"
    count = lambda df, off: {r[0] - off: r[1] for r in df.groupBy(key).count().collect()}
    assert count(there, 100_000) == count(here, 0) != {}
