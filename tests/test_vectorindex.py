import numpy as np

from skein.operators import vectorindex
from skein.operators.vectorindex import VectorIndex, build


def test_recall_and_exact_mode(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "BLOCK", 150)
    monkeypatch.setattr(vectorindex, "QUERIES", 12)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    vectors = np.concatenate([rng.normal(size=(500, 16)), hot + 0.3 * rng.normal(size=(300, 16))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows + odd, "id int, embedding array<float>")
    build(table, str(tmp_path / "index"), cells=12, groups=8)
    index = VectorIndex(spark, str(tmp_path / "index"))
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {i: sorted(range(len(unit)), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:10] for i in range(0, len(unit), 20)}
    asked = table.where("id % 20 = 0")

    def found(**how):
        out = {}
        for r in index.search(asked, 10, **how).orderBy("query", "place").collect():
            out.setdefault(r["query"], []).append(r["id"])
        return out

    assert found(exact=True) == want
    near = found(probes=5, again=60)
    assert near.keys() == want.keys() and all(len(v) == 10 for v in near.values())
    assert np.mean([len(set(near[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    assert index.search(asked.limit(0)).isEmpty()
