from pyspark.sql import Window
from pyspark.sql import functions as F

from plethora.operators.windows import spread_row_number


def test_spread_numbers_equal_plain_ones(spark):
    rows = [(k % 3 if k % 11 else None, float(k * 7919 % 101) if k % 7 else None, k) for k in range(500)]
    d = spark.createDataFrame(rows, "g int, s double, id long")
    order = [F.desc("s"), F.asc("id")]
    plain = d.withColumns({"rn": F.row_number().over(Window.partitionBy("g").orderBy(*order)), "n": F.count(F.lit(1)).over(Window.partitionBy("g"))})
    assert sorted(map(str, spread_row_number(d, ["g"], order, "rn", "n").collect())) == sorted(map(str, plain.collect()))
    whole = spread_row_number(d.select("id"), [], [F.desc("id")])
    assert sorted((r["rn"], r["id"]) for r in whole.collect()) == [(k + 1, 499 - k) for k in range(500)]
    assert spread_row_number(d.limit(0), ["g"], order).count() == 0
