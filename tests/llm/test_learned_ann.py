"""Learned partitions: recall against brute force, exact scores, ties and unusable vectors."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import learned_ann as ann


def brute(rows, queries, top=10):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:top]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(150)] + [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(200, 230)]
    bad = [(900, None), (1000, [0.0] * 4), (1100, [1.0, None, 0.0, 0.0]), (1200, [float("nan"), 1.0, 1.0, 1.0]), (1300, [float("inf"), 1.0, 1.0, 1.0]), (1400, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    got = ann.nearest(spark, df, df.where("vec_id % 100 = 0"), block_rows=50).orderBy("query_id", "rank").collect()
    want = brute(rows, [0, 100, 200])
    assert {r.query_id for r in got} == set(want)
    for q, expected in want.items():
        mine = [(r.vec_id, r.score) for r in got if r.query_id == q]
        assert [m[0] for m in mine] == [e[0] for e in expected] and np.allclose([m[1] for m in mine], [e[1] for e in expected], rtol=1e-12)
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert ann.nearest(spark, few, few.where("vec_id = 0")).count() == 3
    assert ann.nearest(spark, df.where(F.lit(False)), df).count() == 0


def test_recall_of_learned_parts(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.6, (6000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clean = ann.usable(df)
    router = ann.fit(spark, clean, 6000, parts=12)
    assert router is not None
    got = ann.nearest(spark, df, df.where("vec_id % 100 = 0"), router=router, probes=4).toPandas()
    want = brute(rows, range(0, 6000, 100))
    hits = sum(len({v for v, _ in want[q]} & set(p.vec_id)) for q, p in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.9
    assert (got.groupby("query_id")["rank"].max() == 10).all()


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 8))
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8)
    assert np.bincount(label, minlength=8).max() <= 110


def test_the_measured_number_of_parts_finds_neighbours_without_structure(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"part": F.lit("clash"), "v": F.lit("clash")})
    got = ann.nearest(spark, table, table.where("vec_id % 20 = 0")).toPandas()
    want = brute(rows, range(0, 3000, 20))
    hits = sum(len({v for v, _ in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert got.groupby("query_id").size().eq(10).all() and hits >= 0.9 * 10 * 150
