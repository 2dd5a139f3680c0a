import numpy as np

from rollgrid.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def _vectors(n=900, size=32):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(n // 3, size))
    rows = []
    for i in range(n):
        own = base[rng.integers(len(base))] if i % 3 else base[0] * rng.uniform(1, 2)
        noise = rng.normal(size=size) * (0.25 if i % 3 else 0.05)
        rows.append((i, [float(np.float32(x)) for x in own + noise], int(i % 7 == 0)))
    return rows


def brute(rows, threshold=0.93):
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    return near


def test_recall_and_counts(spark):
    rows = _vectors()
    near = brute(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    settings = forest.Settings(leaf=64, block=128)
    got = {r["vec_id"]: r for r in forest.embedding_components(df, settings).collect()}
    assert len(got) == len(rows)
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i) and r["component_id"] <= i


def test_exact_without_splits(spark):
    rows = _vectors(300)
    near = brute(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    got = {r["vec_id"]: r for r in forest.embedding_components(df, forest.Settings(leaf=10_000, block=50)).collect()}
    assert [got[i]["n_links"] for i in range(300)] == near.sum(1).tolist()
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(near, label[None, :], 300).min(1))
    assert [got[i]["component_id"] for i in range(300)] == label.tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 5, "a"), (2, [2.0, 0.0], 5, "a"), (3, [1.0, 0.0], 6, "a"), (4, [1.0, 0.0], None, "a"), (5, None, 5, "a"), (6, [0.0, 0.0], 5, "a"), (7, [nan, 1.0], 5, "a"), (8, [inf, 1.0], 5, "a"), (9, [None, 1.0], 5, "a"), (10, [], 5, "a"), (11, [1.0, 0.0, 0.0], 5, "a"), (1, [1.0, 0.0], 5, "a"), (None, [1.0, 0.0], 5, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in forest.embedding_components(df).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *alone])
    assert forest.embedding_components(df.limit(0)).count() == 0


def test_oversized_leaves_are_split_again(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 32))
    rows = [(i, [float(x) for x in base[i % 150] + rng.normal(size=32) * 0.12], 0) for i in range(600)]
    rows += [(600 + i, [float(x) for x in base[0] + rng.normal(size=32) * 0.05], 0) for i in range(120)]  # these don't come apart
    near = brute(rows)
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA)
    settings = forest.Settings(leaf=400, sample=64, leaf_sample=64, block=48, trees=4)
    got = {r["vec_id"]: r["n_links"] for r in forest.embedding_components(df, settings).collect()}
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum() > 0


def test_magnitudes(spark):
    rows = [(1, [1e-170, 2e-170], 1, "a"), (2, [1e160, 2e160], 1, "a"), (3, [3.0, 6.0], 1, "a"), (4, [2e300, -1e300], 1, "a"), (5, [1.0, -0.5], 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in forest.embedding_components(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}
