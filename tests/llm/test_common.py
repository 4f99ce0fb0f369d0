import random

from pagestrata.llm.common import split_by


def test_split_by_loses_no_row(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(4000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, -1)], "h long, i int")
    for n in (0, 1, 700, 3000):
        ids = spark.createDataFrame([(k,) for k in keys[:n]] + [(None,)], "x long")
        some, rest = split_by(df, "h", ids, "x")
        assert some.columns == rest.columns == df.columns
        got, left = {r["i"] for r in some.collect()}, {r["i"] for r in rest.collect()}
        assert got >= set(range(n)) and not got & left and len(got | left) == 4001 and -1 in left
        assert len(got) <= n + 0.15 * (4000 - n)
