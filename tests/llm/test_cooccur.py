import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from quantloom.llm import cooccur as C


def brute(rows, min_count=1, min_share=0.0, min_lift=0.0):
    baskets = defaultdict(set)
    for s, i in rows:
        if s is not None and i is not None and i >= 0:
            baskets[s].add(i)
    n, single, both = len(baskets), Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        both.update(combinations(sorted(items), 2))
    return {p: (k, single[p[0]], single[p[1]]) for p, k in both.items() if k >= min_count and k >= n * min_share and k * n >= min_lift * single[p[0]] * single[p[1]]}


def data(seed, wide):
    rng = random.Random(seed)
    rows = [(s, min(int(rng.expovariate(0.1)), 60)) for s in range(400) for _ in range(rng.randrange(1, 9))]
    rows += [(9999, i) for i in range(wide)] + [(None, 1), (3, None), (3, -1), (5, 2), (5, 2), (5, 2)]
    rows += [(1000 + k, i) for k in range(30) for i in (70, 71)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"min_count": 8, "min_share": 1 / 2000, "min_lift": 4}, {"min_count": 3, "min_lift": 1.5}])
@pytest.mark.parametrize("wide", [0, 60, 200])
def test_pairs(spark, monkeypatch, limits, wide):
    monkeypatch.setattr(C, "BLOCK_ITEMS", 16)
    rows = data(wide, wide)
    df = spark.createDataFrame(rows, "session_id long, item_id long").selectExpr("*", "1 as n_ab", "'x' as basket")
    got = {(r.item_a, r.item_b): r for r in C.cooccurring_items(df, **limits).collect()}
    want = brute(rows, **limits)
    assert {k: (r.n_ab, r.n_a, r.n_b) for k, r in got.items()} == want
    for r in list(got.values())[:50]:
        cells = [r.n_ab, r.n_a - r.n_ab, r.n_b - r.n_ab, r.n - r.n_a - r.n_b + r.n_ab]
        expected = [r.n_a * r.n_b / r.n, r.n_a * (r.n - r.n_b) / r.n, (r.n - r.n_a) * r.n_b / r.n, (r.n - r.n_a) * (r.n - r.n_b) / r.n]
        llr = 2 * sum(o * math.log(o / e) for o, e in zip(cells, expected) if o)
        assert abs(r.llr - llr) < 1e-6 * max(1, llr)


def test_empty(spark):
    df = spark.createDataFrame([(None, 1)], "session_id long, item_id long")
    assert C.cooccurring_items(df).count() == 0
    assert C.cooccurring_items(df, min_count=8, min_share=0.1, min_lift=4).count() == 0


def test_small_combine_limit(spark, monkeypatch):
    rows = data(7, 120)
    df = spark.createDataFrame(rows, "session_id long, item_id long").repartition(7)
    assert {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in C.cooccurring_items(df).collect()} == brute(rows)


def test_significance_and_salted_joins(spark, monkeypatch):
    import math
    import random

    from quantloom.llm import cooccur as C

    rng = random.Random(9)
    baskets = [{1, *rng.sample(range(2, 30), 4)} if i % 3 else {40, 41, *rng.sample(range(2, 30), 2)} for i in range(200)]
    rows = [(b, i) for b, s in enumerate(baskets) for i in s]
    df = spark.createDataFrame(rows, "session_id long, item_id long")
    n = len(baskets)
    have = lambda *x: sum(1 for b in baskets if b >= set(x))
    xlogx = lambda v: v * math.log(v) if v else 0.0
    want = {}
    for a in range(1, 42):
        for b in range(a + 1, 42):
            k, x, y = have(a, b), have(a), have(b)
            if k:
                llr = 2 * (xlogx(k) + xlogx(x - k) + xlogx(y - k) + xlogx(n - x - y + k) + xlogx(n) - xlogx(x) - xlogx(n - x) - xlogx(y) - xlogx(n - y))
                want[a, b] = (k, x, y, k * n / (x * y), llr)
    for limit in (1 << 20, 0):
        monkeypatch.setattr(C, "BROADCAST_BYTES", limit)
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in C.cooccurring_items(df).collect()}
        assert got == {k: v[:3] for k, v in want.items()}
        sure = {(r.item_a, r.item_b) for r in C.cooccurring_items(df, min_llr=10.83).collect()}
        assert sure == {k for k, v in want.items() if v[4] >= 10.83 and v[3] > 1} and (40, 41) in sure
