import numpy as np
from pyspark.sql import functions as F

from firmlake.llm.mixing import copies, mix, targets


def waterfill(sizes, weights, cap=3):
    """Reshare the excess until no target is above its cap."""
    sizes, weights = np.array(sizes, float), np.array(weights, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = sizes.sum()
    while open_.any():
        share = weights * (left - out[~open_].sum()) / weights[open_].sum()
        over = open_ & (share > cap * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * sizes[over]
        open_ &= ~over
    return out


def test_targets(spark):
    rng = np.random.default_rng(1)
    for _ in range(6):
        sizes = [int(x) for x in rng.integers(0, 1000, 9) ** rng.integers(1, 3)]
        rows = spark.createDataFrame([(f"s{k}" if k < 8 else None, x) for k, x in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in targets(rows).collect()}
        want = waterfill(sizes, [k % 3 + 1 for k in range(9)])
        assert np.allclose([got[f"s{k}" if k < 8 else None] for k in range(9)], want)


def test_odd_rows(odd):
    clash = copies(odd)
    assert clash.columns[: len(odd.columns)] == odd.columns and clash.columns[-4:] == ["__size", "_source_size", "_target", "_copies"]
    assert sorted(map(str, clash.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    df = copies(odd.drop("_size")).cache()
    assert df.count() == 10 and df.where("_copies > 3 OR _copies < 0").count() == 0
    assert {r._size for r in df.where("text IS NULL OR trim(text) = ''").collect()} == {0}
    a, b = (sorted(map(str, mix(odd).collect())) for _ in range(2))
    assert a == b and mix(odd).columns == odd.columns
    assert mix(odd.where("false")).count() == 0


def test_taken_is_near_the_target(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    df = copies(docs).groupBy("source").agg(F.first("_target").alias("t"), F.sum(F.col("_size") * F.col("_copies")).alias("n"))
    assert all(abs(r.n / r.t - 1) < 0.05 for r in df.collect())
