import random
from collections import defaultdict

import numpy as np
import pytest

from quantloom.llm.packing import first_fit_decreasing, pack_documents, pack_sizes


def brute(sizes, capacity):
    bins, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for b, used in enumerate(bins):
            if used + sizes[i] <= capacity:
                bins[b] += sizes[i]
                where[i] = b
                break
        else:
            where[i] = len(bins)
            bins.append(sizes[i])
    return where


def test_tournament_tree_equals_plain_first_fit():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randrange(0, 60))]
        assert first_fit_decreasing(np.array(sizes, dtype=np.int64), 50).tolist() == brute(sizes, 50)
    with pytest.raises(ValueError):
        first_fit_decreasing(np.array([51]), 50)


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 400)])) for i in range(2000)] + [(5000, 0), (5001, None), (None, 7), (None, 7), (1, 100), (6000, 200), (6001, 100)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 as part", "'x' as container_id")
    got = pack_sizes(df, capacity=100, group_rows=500).collect()
    used, docs = defaultdict(int), defaultdict(list)
    for r in got:
        if r.n_tokens:
            used[r.container_id] += r.n_tokens
        else:
            assert r.container_id is None
        docs[r.doc_id].append(r)
    assert max(used.values()) <= 100
    total = sum(n or 0 for _, n in rows)
    assert sum(used.values()) == total
    assert total / (100 * len(used)) > 0.97
    for doc, n in rows:
        if doc is not None and doc != 1:
            parts = sorted(docs[doc], key=lambda r: r.part)
            assert len(parts) == max(1, -(-(n or 0) // 100)) == parts[0].n_parts
            assert sum(p.n_tokens for p in parts) == (n or 0)
            assert [p.first_token for p in parts] == [100 * i for i in range(len(parts))]
    assert len(docs[None]) == 2
    assert pack_sizes(df.limit(0)).count() == 0


def test_equal_rows_are_all_kept(spark):
    df = spark.range(0, 300).selectExpr("cast(null as long) doc_id", "60L n_tokens")
    assert pack_sizes(df, capacity=100, group_rows=50).select("container_id").distinct().count() == 300


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "word " * 50)], "doc_id long, text string")
    got = {(r.doc_id, r.part): r.n_tokens for r in pack_documents(docs, capacity=16).collect()}
    assert got[1, 0] == 3 and got[2, 0] == got[3, 0] == 0
    assert sum(n for (d, _), n in got.items() if d == 4) == 51 or sum(n for (d, _), n in got.items() if d == 4) == 50 + 1
