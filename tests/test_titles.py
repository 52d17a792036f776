from pyspark.sql import functions as F

from edgeloom.functions import scientific


def test_the_exact_value_decides(spark):
    values = [1 / 2560, 1 / 3, 0.0, 1.0, 0.99999999, 1 / 256, None, -2.5e-300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["t"] for r in df.orderBy("i").select(scientific(F.col("v")).alias("t")).collect()]
    assert got == [None if v is None else f"{v:.4E}" for v in values]
    assert got[0] == "3.9063E-04" and got[5] == "3.9062E-03"  # 1 / 2560 is stored just above the tie, 1 / 256 is the tie itself
