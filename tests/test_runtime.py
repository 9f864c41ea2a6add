import gc
import os

import pytest
from pyspark.sql import functions as F

from nodeloom.operators import hierarchy as H
from nodeloom.runtime import Scratch


def test_a_table_belongs_to_its_frame(spark):
    s = Scratch(spark, "own")
    kept = []
    for i in range(200):
        f, _ = s.cut(spark.range(1).withColumn("v", F.lit(i))) if i < 4 else (spark.range(1).select("id"), None)
        kept.append(f.select("v")) if i < 4 else None
        del f
        gc.collect()
    for f in kept:
        assert f.count() == 1
    with pytest.raises(ValueError):
        s.drop(spark.range(1))
    a, c = s.cut(spark.range(5), n=F.count(F.lit(1)))
    with pytest.raises(ValueError):
        s.drop(a.select("id"))
    assert c["n"] == 5
    path = s.tables[-1][1].removeprefix("file://")
    assert os.path.exists(path)
    s.drop(a)
    assert not os.path.exists(path)
    with pytest.raises(ValueError):
        s.drop(a)


def test_loops_do_not_lose_tables(spark):
    par = {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {f"t{i}": f"r{i % 9}" for i in range(20)} | {f"c{i:02d}": f"c{i - 1:02d}" if i else None for i in range(20)}
    d = spark.createDataFrame(list(par.items()), "id STRING, parent STRING")
    for _ in range(2):
        h = H.hierarchy(spark, d)
        junk = [spark.range(3).select("id") for _ in range(50)]
        gc.collect()
        assert h.count() == len(par) and len(junk) == 50
        assert h.filter("depth = -1").count() == 9 and h.filter("depth = -2").count() == 20
