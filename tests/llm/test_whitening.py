import math
import random

import numpy as np
import pytest

from quillon.llm import whitening

ROW = "vec_id long, embedding array<float>"


def plain(rows, top=8):
    """The contract by numpy, over whole numbers."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in sound], dtype=object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    v = (y.T.dot(y)).astype(float) / n**3
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    w = (y.astype(float) / n) @ q / np.sqrt(e)
    return [i for i, _ in sound], n, (y * y).sum(1).tolist(), w, e / np.trace(v)


def vectors(n, d, seed=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1 + 3 / (k + 1)) for k in range(d)]) for i in range(n)]


@pytest.mark.parametrize("d", [12, 3])
def test_against_numpy(spark, d):
    rows = vectors(300, d)
    bad = [(900, None), (901, []), (902, [None] * d), (903, [math.nan] + [0.0] * (d - 1)), (904, [math.inf] + [0.0] * (d - 1)), (905, [1.0] * (d + 1))]
    got = whitening.whitened(spark.createDataFrame(rows + bad, ROW).repartition(3)).collect()
    ids, n, deviation, w, explained = plain(rows)
    k = min(8, d)
    assert len(got) == n * k and {r.n for r in got} == {n}
    at = {i: p for p, i in enumerate(ids)}
    sign = {}
    for r in got:
        p, c = at[r.vec_id], r.component - 1
        s = sign.setdefault(c, 1 if r.whitened * w[p, c] > 0 else -1)
        assert int(r.deviation) == deviation[p] and abs(s * r.whitened - w[p, c]) < 1e-8 and abs(r.explained - explained[c]) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    assert whitening.whitened(frame([])).count() == 0 and whitening.whitened(frame([(1, None)])).count() == 0
    one = whitening.whitened(frame([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, None, None, None), (2, 1, None, None, None)]
    rows = [(i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(40)] + [(3, [1.0, 2.0, 7.0])] * 3 + [(None, [0.0, 0.0, 7.0])]
    flat = whitening.whitened(frame(rows)).collect()  # a line in three dimensions, with equal ids and none
    assert len(flat) == 3 * 44 and {r.component for r in flat if r.whitened is not None} == {1} and flat[0].identity_error < 1e-9
    odd = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)], 1, "w") for i in range(9)], "vec_id long, embedding array<float>, n int, w string")
    assert whitening.whitened(odd).count() == 18


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(2**22) * (1 if i % 2 else -1), float(i)]) for i in range(4000)]
    got = whitening.whitened(spark.createDataFrame(rows, ROW)).where("component = 1 and vec_id < 9").collect()
    want = plain(rows)[2]
    assert all(int(r.deviation) == want[r.vec_id] > 2**63 for r in got) and len(got) == 9
