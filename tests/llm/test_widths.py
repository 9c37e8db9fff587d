"""Vectors of several lengths in one table."""

from meterlake.llm import near_vectors


def test_links_of_every_width(spark):
    rows = [(i, [1.0, float(i)] * 4, 1) for i in range(5)] + [(i, [3.0, 1.0, 2.0], 1) for i in (10, 11)] + [(12, [3.0, 1.0, 2.01], 1), (13, [3.0, 1.0, 2.0], 2), (14, [0.0] * 3, 1), (20, [2.0], 1), (21, [3.0], 1), (22, [-1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near(df).collect()}
    assert [got[i] for i in range(10, 15)] == [(2, 10, True), (2, 10, False), (2, 10, False), (0, 13, True), (0, 14, True)]
    assert [got[i] for i in range(20, 23)] == [(1, 20, True), (1, 20, False), (0, 22, True)]
    assert len(got) == len(rows)
