import math

from pyspark.sql import functions as F

from stresslens.functions import scalars


def test_null_has_no_logit(spark):
    d = spark.createDataFrame([(None,), (0.0,), (1.0,), (0.5,)], "p double")
    got = [r.x for r in d.select(scalars.logit(F.col("p"), 1e-6).alias("x")).collect()]
    assert got[0] is None and math.isclose(got[1], -got[2], rel_tol=1e-9) and got[3] == 0.0
