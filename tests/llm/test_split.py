import random

import numpy as np
import pytest

from quantloom.llm import split as S

ROLES = [("pad", 0, 0), ("period", 13, 13), ("newline", 198, 198), ("turn_end", 50256, 50256), ("item_level_0", 50257, 50512), ("item_level_1", 50513, 50768), ("item_level_2", 50769, 51024), ("item_start", 51025, 51025), ("item_end", 51026, 51026)]


def brute_cohesion(tokens, places, block):
    out = []
    for p in places:
        a, b = tokens[max(0, p - block) : p].tolist(), tokens[p : p + block].tolist()
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        na, nb = (sum(x.count(w) ** 2 for w in set(x)) for x in (a, b))
        out.append(dot / (na * nb) ** 0.5 if na * nb else 0.0)
    return out


def test_cohesion(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(S, "CHUNK", 16)
    for n in (5, 60, 700):
        tokens = rng.integers(0, 30, n)
        places = np.sort(rng.choice(np.arange(n + 1), min(n, 50), replace=False))
        assert np.allclose(S.cohesion(tokens, places, 8), brute_cohesion(tokens, places, 8))


def test_deepest_valley_wins():
    topics = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 7, 8, 9, 7, 8, 9, 7, 8, 9, 7, 8, 9])
    assert S.split_points(topics, np.array([9, 12, 15]), 16, 2, 6) == [(0, 12), (10, 24)]
    assert S.split_points(topics, np.array([], dtype=int), 16, 2, 6) == [(0, 16), (14, 24)]
    assert S.split_points(topics[:16], np.array([3]), 16, 2, 6) == [(0, 16)]


def check_pieces(tokens, pieces, limit, overlap, ends):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(tokens)
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s2 == e - overlap and e2 > e and e - s <= limit and e2 - s2 <= limit
        reachable = [x for x in ends if max(s + overlap, 0) < x <= s + limit]
        assert e in reachable if reachable else True


def test_every_cut_is_natural_where_it_can_be():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        tokens = rng.integers(0, 20, n)
        ends = np.flatnonzero(np.append(False, rng.random(n) < rng.choice([0, 0.02, 0.2])))
        pieces = S.split_points(tokens, ends, 32, 4, 4)
        check_pieces(tokens, pieces, 32, 4, set(ends.tolist()))


def samples(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, split string, input_ids array<int>, tokens string")


def test_samples(spark):
    rng = random.Random(3)
    text = [rng.randrange(100, 190) for _ in range(700)]
    dotted = [13 if i % 20 == 19 else t for i, t in enumerate(text)]
    item = [51025, 50300, 50600, 50800, 51026]
    tight = [rng.randrange(100, 190) for _ in range(254)] + item + [rng.randrange(100, 190) for _ in range(100)]
    rows = [(1, "train", [0] * 9 + dotted + [0] * 5, "x"), (1, "train", [0] * 9 + dotted + [0] * 5, "x"), (2, "eval", None, "x"), (3, "eval", [], "x"), (4, "eval", [0] * 300, "x"), (5, "train", text, "x"), (6, None, [0, 0, *text[:100], 0], "x"), (7, "train", tight, "x"), (None, "train", text, "x"), (8, "train", [0] * 100 + text[:256] + [0] * 44, "x"), (9, "train", [None] * 300, "x"), (1, "eval", [0, 5, 0, 6, 0], "x")]
    roles = spark.createDataFrame(ROLES, "token_role string, first_id int, last_id int")
    got = {}
    for r in sorted(S.split_samples(samples(spark, rows), roles).collect(), key=lambda r: r.piece):
        got.setdefault((r.rec_id, r.split), []).append((r.start, list(r.tokens)))
    assert set(got) == {(1, "train"), (2, "eval"), (3, "eval"), (4, "eval"), (5, "train"), (6, None), (7, "train"), (8, "train"), (9, "train"), (1, "eval")}
    assert got[2, "eval"] == got[3, "eval"] == got[4, "eval"] == [(0, [])]
    assert got[6, None] == [(0, text[:100])] and got[1, "eval"] == [(0, [5, 0, 6])] and got[8, "train"] == [(0, text[:256])]
    for key, full in (((1, "train"), dotted), ((5, "train"), text), ((7, "train"), tight), ((9, "train"), [-1] * 300)):
        pieces = got[key]
        assert len(pieces) > 1
        for i, (start, tokens) in enumerate(pieces):
            assert tokens == full[start : start + len(tokens)] and len(tokens) <= 256
            if i:
                assert tokens[:32] == pieces[i - 1][1][-32:]
            if key == (1, "train") and i < len(pieces) - 1:
                assert tokens[-1] == 13
    assert pieces[-1][0] + len(pieces[-1][1]) == 300
    assert got[7, "train"][0][1] == tight[:254]  # not inside the item block
    assert S.split_samples(samples(spark, []), roles).count() == 0


def test_history(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    seen = [(i, 7, i // 6, i % 11, t0 + timedelta(minutes=i)) for i in range(60)]
    seen += seen[10:20] + [(1000, 7, None, -1, t0), (1001, 7, 5, None, t0), (1002, None, 5, 3, t0)]
    interactions = spark.createDataFrame(seen, "interaction_id long, user_id long, session_id long, item_id long, ts timestamp").repartition(3)
    items = [i % 11 for i in range(58)]
    rows = [(7, "train", [*items[:10], -1, None, *items[10:], -1]), (7, "train", [*items[:10], -1, None, *items[10:], -1]), (7, "eval", items[:20]), (8, "train", list(range(30))), (9, "test", None), (None, "train", items)]
    got = {}
    for r in sorted(S.split_history(spark.createDataFrame(rows, "user_id long, split string, items array<long>"), interactions).collect(), key=lambda r: r.piece):
        got.setdefault((r.rec_id, r.split), []).append((r.start, list(r.tokens)))
    assert set(got) == {(7, "train"), (7, "eval"), (8, "train"), (9, "test")}
    assert got[7, "eval"] == [(0, items[:20])] and got[9, "test"] == [(0, [])]
    assert [len(t) for _, t in got[8, "train"]] == [20, 14]
    pieces = got[7, "train"]
    for i, (start, tokens) in enumerate(pieces):
        assert tokens == items[start : start + len(tokens)] and len(tokens) <= 20
        assert i == len(pieces) - 1 or (start + len(tokens)) % 6 == 0  # where a session ends
        assert not i or tokens[:4] == pieces[i - 1][1][-4:]


def test_history_null_in_place_of_an_interaction(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    interactions = spark.createDataFrame([(i, 7, i // 6, 100 + i, t0 + timedelta(minutes=i)) for i in range(60)], "interaction_id long, user_id long, session_id long, item_id long, ts timestamp")
    items = [100 + i for i in range(58)]
    items[3] = items[31] = None
    rows = [(7, "train", [*items[:20], -1, *items[20:]])]
    pieces = sorted(S.split_history(spark.createDataFrame(rows, "user_id long, split string, items array<long>"), interactions).collect(), key=lambda r: r.piece)
    assert len(pieces) > 2 and sum((p.tokens if i == 0 else p.tokens[4:] for i, p in enumerate(pieces)), []) == [x for x in items if x is not None]
    for p in pieces[:-1]:
        assert (p.tokens[-1] - 99) % 6 == 0  # where a session ends


def test_places():
    seen = {i: 100 + i for i in range(12)}
    assert S._places([100, None, 102, 103], seen).tolist() == [0, 2, 3]
    assert S._places([100, None, 101, 102], seen).tolist() == [0, 1, 2]
    assert S._places([None, None, 101, None, 102, 103, None, None, 106], seen).tolist() == [1, 2, 3, 6]
    assert S._places([100, None], {}).tolist() == [0] and S._places([None], seen).tolist() == [] and S._places([], seen).tolist() == []


def test_many_ranges(spark, monkeypatch):
    roles = spark.createDataFrame([(*ROLES[i % len(ROLES)][:1], i, i) for i in range(300)], "token_role string, first_id int, last_id int")
    assert len(S.token_ranges(roles)) == len(ROLES)
    monkeypatch.setattr(S, "MOST_ROLES", 299)
    with pytest.raises(ValueError):
        S.token_ranges(roles)


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        S._check(10, 5)
