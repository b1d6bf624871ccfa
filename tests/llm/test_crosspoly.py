import numpy as np
import pytest
from pyspark.sql import functions as F

from toposim.llm import crosspoly as cp


def brute(ids, vectors, least=cp.LEAST):
    """{row: (id, links, component)} by comparing all rows."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for v, g in zip(vectors, good)]
    n = len(ids)
    link = [[j for j in range(n) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    comp = [-1] * n
    for i in range(n):
        if comp[i] < 0:
            todo, comp[i] = [i], i
            while todo:
                for j in link[todo.pop()]:
                    if comp[j] < 0:
                        comp[j] = i
                        todo.append(j)
    out = []
    for i in range(n):
        names = [ids[j] for j in range(n) if comp[j] == comp[i] and ids[j] is not None]
        c = min(names) if names else None
        out.append((ids[i], len(link[i]), c, ids[i] is not None and ids[i] == c))
    return sorted(map(repr, out))


def got(df, **kw):
    return sorted(repr(tuple(r)) for r in cp.near(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect())


@pytest.fixture(scope="module")
def cloud(spark):
    """Random vectors, groups of near ones (one large), exact copies, bad rows."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24))
    rows = [b.tolist() for b in base]
    rows += [(base[0] + rng.normal(size=24) * 0.1).tolist() for _ in range(150)]
    for k in range(1, 40):
        rows += [(base[k] + rng.normal(size=24) * s).tolist() for s in (0.05, 0.15, 0.25, 0.3)]
    rows += [base[50].tolist()] * 60 + [(base[50] * 3).tolist()]
    rows += [None, [0.0] * 24, [], [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0], [2.0], base[7, :5].tolist(), base[7, :5].tolist()]
    ids = [int(i) for i in rng.permutation(len(rows))]
    ids[3], ids[5] = None, ids[4]
    return spark.createDataFrame(list(zip(ids, rows)), "vec_id long, embedding array<double>")


def test_links_equal_brute_force(cloud):
    rows = cloud.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert got(cloud, found=0.99999) == want
    # many small buckets, cut into blocks, several tables: every pair still counts once
    assert got(cloud.repartition(5), bucket=8, block=10, found=0.99999999) == want


def test_never_too_many_and_recall(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1500, 32))
    b = rng.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.concatenate((a, 0.951 * a + np.sqrt(1 - 0.951**2) * b)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in cp.near(df, bucket=32).collect()}
    assert max(links.values()) == 1 and sum(links.values()) >= 0.98 * 3000
    assert cp.near(df, least=0.9999).agg(F.sum("n_links")).first()[0] == 0


def test_rotation_and_buckets():
    x = np.random.default_rng(1).normal(size=(50, 16))
    y = cp.turned(x, 16, 0, 0)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cp.hadamard(x), x @ h)
    p = cp.Plan(16, (16, 4), 1, 6)
    b = cp.buckets(x, p, 0)
    first, second = cp.turned(x, 16, 0, 0), cp.turned(x, 16, 0, 1)[:, :4]
    corner = lambda y: 2 * np.abs(y).argmax(1) + (np.take_along_axis(y, np.abs(y).argmax(1)[:, None], 1)[:, 0] < 0)
    assert (b[:, 0] == corner(first) + 32 * corner(second)).all()
    assert all(len(set(r)) == 6 for r in b.tolist())
    many = cp.plan(64, 10**9)
    assert len(many.sizes) == 3 and many.probes >= 2
    assert cp.plan(1, 10).tables >= 1


def test_empty_and_clashing(spark, cloud):
    assert cp.near(cloud.where("false")).count() == 0
    some = cloud.where("vec_id < 80 OR vec_id IS NULL")
    more = some
    for c in ("id", "dim", "copies", "first", "v", "name", "links", "component", "least", "blocks", "mine", "tab", "bucket", "n_links"):
        more = more.withColumn(c, F.lit("x"))
    assert got(more) == got(some)
