"""Similar vectors against a plain loop, over more vectors than one look-up considers."""

import numpy as np

from tidewatch.plans import relation_queries


def test_every_vector_is_looked_up(spark, tmp_path):
    rng = np.random.default_rng(2)
    n = 1300
    ids = sorted(int(i) for i in rng.choice(9000, n, replace=False))
    groups = rng.normal(size=(150, 8))
    vectors = (groups[rng.integers(150, size=n)] + rng.normal(scale=0.05, size=(n, 8))).astype("float32").astype(float)
    labels = [int(x) for x in rng.integers(3, size=n)]
    rows = [(i, [float(x) for x in v], y) for i, v, y in zip(ids, vectors, labels, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    want = {}
    for k in range(n):
        found = [(round(float(vectors[k] @ vectors[j] / np.linalg.norm(vectors[k]) / np.linalg.norm(vectors[j])), 6), ids[j]) for j in range(max(0, k - 500), k) if labels[j] == labels[k]]
        alike = [f for f in found if f[0] >= relation_queries.ALIKE]
        if alike:
            want[ids[k]] = max(alike, key=lambda f: f[1])
    got = {r.vec_id: (r.cosine, r.other_id) for r in relation_queries.similar_images(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and sum(i < ids[-500] for i in got) > 500
    assert all(abs(got[i][0] - want[i][0]) < 2e-6 and (got[i][1] == want[i][1] or abs(got[i][0] - want[i][0]) > 0) for i in got)


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert relation_queries.similar_images(spark, str(tmp_path)).count() == 0
