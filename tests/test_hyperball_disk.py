import os

from edgeloom.operators import distances
from edgeloom.operators.simplify import simplify
from edgeloom.plans import durable


def test_only_the_last_sketches_stay(spark):
    begun = len(durable._PATHS)
    g = simplify(spark.createDataFrame([(k, k + 1) for k in range(4)], "src long, dst long"))
    assert [r["t"] for r in distances.hyperball(g).orderBy("t").collect()] == [0, 1, 2, 3, 4, 5]
    balls = [p.removeprefix("file://") for p in durable._PATHS[begun:] if "/balls-" in p]
    assert len(balls) == 6 and [os.path.isdir(p) for p in balls] == [False] * 5 + [True]
