import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import vector as V
from quantloom.operators import metrics as M
from quantloom.operators import quantize as Q
from quantloom.operators import sequences as S
from quantloom.operators import skew as K
from quantloom.operators import trie as T
from quantloom.operators.rqvae import Autoencoder, AutoencoderConfig
from quantloom.session import distributed_rank
from quantloom.sources import files


def vectors(spark, n=200, d=8, seed=0, bad=True):
    x = np.random.default_rng(seed).normal(size=(n, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows + ([(n, None), (n + 1, [1.0])] if bad else []), "item_id long, embedding array<double>")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_keyed_quantiles(spark, broadcast_bytes):
    rng = random.Random(1)
    rows = [(1, rng.randrange(-(10**12), 10**12)) for _ in range(3000)] + [(rng.randrange(2, 9), rng.randrange(5)) for _ in range(300)] + [(None, 4), (None, 5), (20, None), (21, 2**63 - 1), (21, -(2**63))]
    rows += [(9, 7)] * 50
    df = spark.createDataFrame(rows, "k long, v long").selectExpr("*", "1 as n_rows", "'x' as q0")
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    got = {r.k: r for r in K.keyed_quantiles(df, ["k"], "v", (0.0, 0.5, 0.9, 1.0), broadcast_bytes).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        known = sorted(v for v in values if v is not None)
        want = [known[max(1, math.ceil(p * len(known) - 1e-9)) - 1] if known else None for p in (0.0, 0.5, 0.9, 1.0)]
        assert [got[k][f"q{i}"] for i in range(4)] == want and got[k].n_rows == len(values) and got[k].n_values == len(known)
    assert K.keyed_quantiles(df.limit(0), ["k"], "v").count() == 0
    bare = K.keyed_quantiles(df, ["k"], "v", ()).collect()
    assert {r.k: (r.n_rows, r.n_values) for r in bare} == {k: (r.n_rows, r.n_values) for k, r in got.items()}
    with pytest.raises(TypeError):
        K.keyed_quantiles(df.withColumn("v", F.lit(0.5)), ["k"], "v")


def test_long_text_keys_are_not_broadcast(spark, monkeypatch):
    seen = []
    refine = K._refine
    monkeypatch.setattr(K, "_refine", lambda *a: seen.append(a[-1]) or refine(*a))
    df = spark.createDataFrame([("k" * 5000 + str(i % 3), i * i) for i in range(60)], "k string, v long")
    got = {r.k[-1]: r.q0 for r in K.keyed_quantiles(df, ["k"], "v", (0.5,), broadcast_bytes=9_000).collect()}
    assert got == {str(j): sorted(i * i for i in range(60) if i % 3 == j)[9] for j in range(3)} and seen and not any(seen)


def test_heavy_keys_come_out_of_full_results(spark, tmp_path, monkeypatch):
    from quantloom.plans.skew import p3_found

    start = datetime(2024, 1, 1)
    # Item 1 holds most rows; 2 to 101 hold one each; the last two rows do not count.
    items = [1] * 900 + list(range(2, 102)) + [-1, None]
    rows = [(i, item, start, start + timedelta(microseconds=i * i)) for i, item in enumerate(items)]
    spark.createDataFrame(rows + rows[:50], "interaction_id long, item_id long, ts timestamp, arrived_at timestamp").write.parquet(str(tmp_path / "interactions.parquet"))
    # Code 7 has no second level at all.
    codes = [(i, [3, i]) for i in range(60)] + [(60 + i, [7]) for i in range(30)] + [(90 + i, [100 + i, 0]) for i in range(10)]
    spark.createDataFrame(codes, "item_id long, codes array<int>").write.parquet(str(tmp_path / "codes.parquet"))
    rounds = []
    refine = K._refine
    monkeypatch.setattr(K, "_refine", lambda *a: rounds.append(a) or refine(*a))
    found = p3_found(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("codes", 3), ("codes", 7), ("ids", 1)] and rounds
    # A lost rank of the heaviest key may not pass unseen.
    monkeypatch.setattr(K, "_refine", lambda *a: refine(*a).filter("not (_key0 = 'ids' and _key1 = 1 and _i = 1)"))
    with pytest.raises(Exception, match="lacks its quantiles"):
        p3_found(spark, str(tmp_path)).collect()


def test_distributed_rank(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i) for i in rng.sample(range(1000), 400)]
    got = distributed_rank(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"], partitions=7).collect()
    for r in got:
        assert r["rank"] == sum(1 for k, v in rows if k == r.k and v < r.v)
    assert len(got) == len(rows)


GOLDEN = [([[1, 2, 1], [3, 1, 2], [3, 1, 3]], [0, 2, 3, 4, 5, 7, 7, 7], [1, 3, 2, 1, 1, 2, 3, -1], [1, 2, 3, 4, 5, 6, 7, -1]), ([[42]], [0, 1], [42, -1], [1, -1]), ([[1, 2, 3]], [0, 1, 2, 3], [1, 2, 3, -1], [1, 2, 3, -1]), ([[1, 2, 3], [1, 2, 7], [1, 2, 7], None, []], [0, 1, 2, 4, 4], [1, 2, 3, 7, -1], [1, 2, 3, 4, -1])]


@pytest.mark.parametrize(("rows", "ptrs", "cols", "vals"), GOLDEN)
def test_trie(spark, rows, ptrs, cols, vals):
    trie = T.Trie.from_codes(spark.createDataFrame([(r,) for r in rows], "codes array<int>"))
    assert trie.csr() == (ptrs, cols, vals)


def test_beams(spark):
    paths = [[1, 2, 3], [1, 2, 7], [3, 1, 2], [2, 5, 1], [4, 6, 2]]
    trie = T.Trie.from_codes(spark.createDataFrame([(p,) for p in paths], "codes array<int>"))
    logit = {(s, t): math.sin(3 * s + t) for s in range(3) for t in range(8)}
    table = spark.createDataFrame([(s, t, v) for (s, t), v in logit.items()], "step int, token int, logit double")
    score = lambda c, step: c.join(table.filter(F.col("step") == step).drop("step"), "token")
    queries = spark.range(2).withColumnRenamed("id", "query_id")

    def log_prob(path):
        total = 0.0
        for s in range(3):
            options = {p[s] for p in paths if p[:s] == path[:s]}
            total += logit[s, path[s]] - math.log(sum(math.exp(logit[s, o]) for o in options))
        return total

    want = sorted(paths, key=lambda p: -log_prob(p))
    got = T.beam_search(queries, trie, score, T.GenerationConfig(3, 5, 5)).filter("query_id = 0").orderBy("rank").collect()
    assert [r.tokens for r in got] == want and all(abs(r.log_prob - log_prob(r.tokens)) < 1e-9 for r in got)
    for config in (T.GenerationConfig(3, 2, 3, 0.7, seed=5), T.GenerationConfig(3, 2, 2, strategy="topk")):
        assert {tuple(r.tokens) for r in T.beam_search(queries, trie, score, config).collect()} <= set(map(tuple, paths))
    free = spark.createDataFrame([(0, 5, 1.0), (5, 90, 2.0), (91, 99, 1.0)], "last_token int, token int, logit double")
    out = T.generate_interleaved(spark.createDataFrame([(1, 0)], "query_id long, last_token int"), trie, lambda rows: rows.join(free, "last_token"), 90, 91, 3, 99, 8).first()
    assert out.tokens == [5, 90, 1, 2, 3, 91]


def test_generated_items_follow_the_scorer(spark):
    paths = [[1, 2, 3], [1, 2, 7], [3, 1, 2], [3, 6, 1], [2, 5, 1]]
    trie = T.Trie.from_codes(spark.createDataFrame([(p,) for p in paths], "codes array<int>"))
    # 4 is the best token of all, but no child of the root; 9 none of node (3).
    logits = spark.createDataFrame([(0, 90, 1.0), (90, 4, 9.0), (90, 1, 0.5), (90, 2, 0.1), (90, 3, 2.0), (3, 9, 5.0), (3, 1, 1.0), (3, 6, 1.5), (6, 1, 0.0), (91, 99, 1.0)], "last_token int, token int, logit double")
    prompts = spark.createDataFrame([(i, 0) for i in range(40)], "query_id long, last_token int")
    score = lambda rows: rows.join(logits, "last_token")
    assert {tuple(r.tokens) for r in T.generate_interleaved(prompts, trie, score, 90, 91, 3, 99, 8).collect()} == {(90, 3, 6, 1, 91)}
    drawn = [T.generate_interleaved(prompts, trie, score, 90, 91, 3, 99, 8, temperature=2.0, seed=5).collect() for _ in range(2)]
    assert sorted(drawn[0]) == sorted(drawn[1]) and {r.tokens[0] for r in drawn[0]} == {90}
    assert {tuple(r.tokens[1:4]) for r in drawn[0]} <= set(map(tuple, paths)) and len({r.tokens[1] for r in drawn[0]}) == 3


def test_residual_kmeans(spark, tmp_path):
    x, df = vectors(spark)
    model = Q.ResidualKMeans(levels=2, codes=4, seed=3).fit(df, epochs=2)
    codes = {r.item_id: r.codes for r in model.transform(df).collect()}
    assert codes[200] is None and codes[201] is None
    left = x.copy()
    for k in range(2):
        want = np.argmin(((left[:, None] - model.books[k][None]) ** 2).sum(2), axis=1)
        assert [codes[i][k] for i in range(200)] == want.tolist()
        left = left - model.books[k][want]
    rebuilt = {r.item_id: r.vec for r in model.inverse_transform(model.transform(df)).collect()}
    assert np.allclose([rebuilt[i] for i in range(200)], x - left) and rebuilt[200] is None
    model.save(spark, str(tmp_path / "m"))
    again = Q.ResidualKMeans.load(spark, str(tmp_path / "m"))
    assert all(np.array_equal(a, b) for a, b in zip(model.books, again.books))
    with pytest.raises(RuntimeError):
        Q.ResidualKMeans().transform(df)
    with pytest.raises(ValueError):
        Q.ResidualKMeans(codes=4).fit_step(df.limit(0))


def test_unusable_vectors_get_no_code_and_move_no_centre(spark):
    x, clean = vectors(spark, bad=False)
    bad = [[float("nan"), *[0.0] * 7], [float("inf"), *[0.0] * 7], [None, *[0.0] * 7], None, [1.0]]
    df = clean.unionByName(spark.createDataFrame([(200 + i, v) for i, v in enumerate(bad)], clean.schema))
    a, b = (Q.ResidualKMeans(levels=2, codes=4, seed=3).fit(t, epochs=2) for t in (clean, df))
    assert all(np.allclose(p, q) for p, q in zip(a.books, b.books)) and all(c.sum() == 400 for c in b.counts)
    codes = {r.item_id: r.codes for r in b.transform(df).collect()}
    assert len({tuple(codes[i]) for i in range(200)}) > 4 and all(codes[200 + i] is None for i in range(len(bad)))
    book = Q.codebook_table(spark, b.books[:1]).select("code", "vec")
    plain = {r.item_id: r.code for r in Q.find_nearest_sql(df, "embedding", book).collect()}
    assert plain == {i: None if c is None else c[0] for i, c in codes.items()}
    config = AutoencoderConfig(input_dim=8, hidden_dim=16, latent_dim=4, levels=2, codes=8, epochs=2)
    model = Autoencoder(config).fit(df)
    assert np.isfinite(model.losses).all() and [r.codes for r in model.transform(df).filter("item_id >= 200").collect()] == [None] * len(bad)


def test_autoencoder(spark, tmp_path):
    x, df = vectors(spark, 2000)
    for learnable, layers in ((False, 2), (True, 3)):
        config = AutoencoderConfig(input_dim=8, hidden_dim=16, latent_dim=4, levels=2, codes=8, epochs=6, batch=32, layers=layers, learnable=learnable)
        model = Autoencoder(config).fit(df)
        assert len(model.losses) == 6 and model.losses[-1] < model.losses[0]
        out = model.forward(x)
        assert out["codes"].shape == (2000, 2) and 0 < out["p_unique"] <= 1 and out["loss"] > ((out["rebuilt"] - x) ** 2).mean()
    with pytest.raises(ValueError):
        Autoencoder(AutoencoderConfig(layers=1))
    rebuilt = model.inverse_transform(model.transform(df)).filter("item_id = 5 or codes is null").orderBy("item_id").collect()
    assert np.allclose(rebuilt[0].vec, out["rebuilt"][5]) and [r.vec for r in rebuilt[1:]] == [None, None]
    model.save(spark, str(tmp_path / "a"))
    a, b = ([r.codes for r in m.transform(df).orderBy("item_id").collect()] for m in (model, Autoencoder.load(spark, str(tmp_path / "a"))))
    assert a == b and a[-1] is None and a[-2] is None


def test_sequences(spark):
    rows = [(1, [0, 5, 60, 61, 7]), (2, [5]), (3, None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>").withColumn("b", F.lit(0))
    out = {r.id: r for r in S.collate(df, "b", "ids", side="right", loss_on="items", text_size=50).collect()}
    assert out[1].padded_labels == [-100, -100, 60, 61, -100] and out[2].padded_ids == [5, 0, 0, 0, 0] and out[2].attention_mask == [1, 0, 0, 0, 0] and out[3].padded_labels == [-100] * 5
    left = {r.id: r for r in S.collate(df, "b", "ids", side="left", max_length=2).collect()}
    assert left[2].padded_ids == [0, 5] and left[1].padded_ids == [0, 5] and left[1].padded_labels == [-100, 5]
    v = S.Vocabulary(50, 2, 4)
    parts = [("text", "a", None), ("item", None, [1, 2]), ("item", None, [0, 3]), ("text", "b", None)]
    p = spark.createDataFrame([(1, parts)], "id long, parts array<struct<type string, text string, codes array<int>>>").withColumn("ids", S.encode_parts("parts", v, lambda t: F.array(F.ascii(t) - 90)))
    assert p.first().ids == [7, v.start, 51, 56, v.end, 50, 57, v.end, 8]
    runs = S.decode_ids(p, "ids", v, "id").orderBy("run").collect()
    assert [(r.kind, r.codes) for r in runs] == [("text", None), ("item", [1, 2]), ("item", [0, 3]), ("text", None)]
    asked = spark.createDataFrame([("buy the big red car now",), ("nothing",), (None,)], "prompt string")
    known = spark.createDataFrame([(3, " big red car "), (2, "the big red car now"), (1, "blue"), (4, None)], "item_id long, item_text string")
    assert {r.prompt: r.item_id for r in S.first_contained(asked, known).collect()} == {"buy the big red car now": 2, "nothing": None, None: None}


def test_history(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, 1, i * 7 % 31, t0 + timedelta(minutes=i)) for i in range(25)] + [(3, 1, 21, t0 + timedelta(minutes=3)), (90, 2, 5, t0), (91, 1, -1, t0), (92, None, 1, t0)]
    seen = spark.createDataFrame(rows, "interaction_id long, user_id long, item_id long, ts timestamp")
    got = {r.split: r for r in S.leave_out_splits(S.user_sequences(seen)).collect()}
    items = [i * 7 % 31 for i in range(25)]
    assert got["train"]["items"] == items[:-2] and got["train"].item_fut == items[-2]
    assert got["eval"]["items"] == got["test"]["items"] == items[4:24] and got["test"].item_fut == items[-1]


def test_metrics(spark):
    pred = spark.createDataFrame([([1, 2, 3], 2), ([4], 9), (None, 1)], "pred array<long>, fut long")
    r = M.recall_at(pred, "pred", "fut", (1, 2)).first()
    assert (r.n, r.recall_at_1, r.recall_at_2) == (3, 0.0, 1 / 3)
    stats = M.length_stats(spark.createDataFrame([("a", 1), ("a", 3), ("b", 4)], "k string, n long"), "n", ["k"])
    delta = {x.metric: x.delta for x in M.stats_delta(stats, "k", "a", "b").collect()}
    assert delta["mean"] == 2.0 and delta["n"] == -1.0
    d = spark.createDataFrame([([1.0, 0.0], [0, 1, 1])], "v array<double>, m array<int>")
    assert d.select(V.last_token_pool(F.array(F.lit("a"), F.lit("b"), F.lit("c")), "m")).first()[0] == "c"


def test_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("1 5 6\n\n 2  7 \n")
    assert sorted((r.user_id, r["items"]) for r in files.read_sequences(spark, str(tmp_path / "s.txt")).collect()) == [(0, [4, 5]), (1, [6])]
    (tmp_path / "m.json").write_text('{"item2id": {"A1": "1", "B2": "2"}}')
    (tmp_path / "meta").write_text("{'asin': 'A1', 'title': 'Box', 'price': 2.5, 'categories': [['x', 'y']]}\nbroken\n")
    ids = files.read_id_map(spark, str(tmp_path / "m.json"))
    text = files.items_with_text(files.read_metadata(spark, str(tmp_path / "meta")), ids).first()
    assert (text.item_id, text.item_text) == (0, "Box by Unknown is categorized under x, y and is priced at 2.5.")
    df = spark.createDataFrame([(1, "train"), (2, "eval")], "id long, split string")
    files.write_samples(df, str(tmp_path / "out"), {"levels": 3})
    rows, meta = files.read_samples(spark, str(tmp_path / "out"), "eval")
    assert meta == {"levels": 3} and [r.id for r in rows.collect()] == [2]
    files.write_once(df, str(tmp_path / "w"))
    assert files.write_once(df.limit(0), str(tmp_path / "w")).count() == 2
    for step in (1, 2):
        files.log_metrics(spark, str(tmp_path / "log"), step, {"loss": 2.0 / step})
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).collect())) == [(1, "loss", 2.0), (2, "loss", 1.0)]
    files.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "csv")).collect())) == [("1", "train"), ("2", "eval")]


def test_streams(spark, tmp_path):
    from quantloom.streaming.online import encode_stream, fit_stream

    _, df = vectors(spark, bad=False)
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    model = Q.ResidualKMeans(levels=2, codes=4)
    fit_stream(stream(), model, str(tmp_path / "snap"), str(tmp_path / "c1")).awaitTermination()
    assert sum(model.counts[0]) == 200
    encode_stream(stream(), model, str(tmp_path / "codes"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "codes")).filter("size(codes) = 2").count() == 200
