import random

from pyspark.sql import functions as F

from quarterloom.operators import embed as V
from quarterloom.operators import metrics as M


def test_blocks_are_told_apart(spark):
    """Filers hold securities of their own block; pairs kept back are ranked above pairs across blocks."""
    rng = random.Random(2)
    edges, back = [], []
    for f in range(40):
        for s in range(30):
            if f % 2 == s % 2 and rng.random() < 0.6:
                (back if rng.random() < 0.2 else edges).append((f"f{f:02d}", f"s{s:02d}"))
    e = spark.createDataFrame(edges, "cik string, cusip string")
    names = sorted({s for _, s in edges})
    numbered = spark.createDataFrame([(s, 0, i, len(names)) for i, s in enumerate(names)], "cusip string, per int, b long, n long")
    z = V.train(e, numbered, lambda c: F.lit(0), epochs=8)
    across = [(f"f{f:02d}", f"s{s:02d}") for f in range(40) for s in range(30) if f % 2 != s % 2]
    pairs = spark.createDataFrame([(*p, 1) for p in back] + [(*p, 0) for p in across], "cik string, cusip string, label int")
    assert M.auc(V.score(z, pairs)).first()["auc"] > 0.9
