"""The keyed permutation behind shuffled passes."""

import pytest
from pyspark.sql import functions as F

from nightgrid.operators import batches


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 26, 997, 1024, 5003])
def test_permutation(spark, n):
    size, key = F.lit(n).cast("bigint"), batches.batch_key(7, 2, F.lit(3))
    to = spark.range(n).withColumn("to", batches.permuted(F.col("id"), size, key))
    back = to.withColumn("back", batches.permuted(F.col("to"), size, key, inverse=True)).collect()
    assert sorted(r.to for r in back) == list(range(n)) and all(r.back == r.id for r in back)
    if n > 900:
        assert sum(r.to == r.id for r in back) < 20
        other = {r.id: r.to for r in spark.range(n).withColumn("to", batches.permuted(F.col("id"), size, batches.batch_key(7, 3, F.lit(3)))).collect()}
        assert sum(other[r.id] == r.to for r in back) < 20
