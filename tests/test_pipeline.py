import json
import math
import random
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import text as X
from quantloom.functions import vector as V
from quantloom.operators import base as B
from quantloom.operators import metrics as M
from quantloom.operators import quantize as Q
from quantloom.operators import sequences as S
from quantloom.operators import trie as T
from quantloom.session import join_hot
from quantloom.sources import files
from quantloom.streaming.online import fit_batch

PATHS = [[1, 2, 1], [3, 1, 2], [3, 1, 3]]


def trie(spark, paths=PATHS):
    return T.Trie.from_codes(spark.createDataFrame([(p,) for p in paths], "codes array<int>"))


def test_children_of_nodes(spark):
    t = trie(spark)
    rng = np.random.default_rng(0)
    logit = rng.normal(size=(5, 8))
    beams = spark.createDataFrame([(n, n) for n in range(5)], "row_id int, node_id long")
    logits = spark.createDataFrame([(n, k, float(logit[n, k])) for n in range(5) for k in range(8)], "row_id int, token int, logit double")
    masked = T.mask(beams, t, logits)
    valid = {0: [1, 3], 1: [2], 2: [1], 3: [1], 4: [2, 3]}
    got = {}
    for r in masked.collect():
        got.setdefault(r.node_id, {})[r.token] = (r.child_id, r.logit)
    assert {k: sorted(v) for k, v in got.items()} == valid and all(x == logit[k, tok] for k, v in got.items() for tok, (_, x) in v.items())
    padded = {r.row_id: (r.tokens, r.next_nodes) for r in T.padded_children(masked, ["row_id"], 3).collect()}
    assert padded[0] == ([1, 3, -1], [1, 2, -1]) and padded[4] == ([2, 3, -1], [6, 7, -1])
    best = {r.row_id: r.token for r in T.top_k(masked, ["row_id"], 1).collect()}
    assert best == {n: max(valid[n], key=lambda k: logit[n, k]) for n in valid}
    assert {r.row_id for r in T.top_k(masked, ["row_id"], 9).filter("rank = 2").collect()} == {0, 4}  # fewer rows where there are fewer children


def test_linear_with_and_without_bias(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=(2, 16)), rng.normal(size=(16, 8))
    beams = spark.createDataFrame([(i, 0 if i == 0 else 4, a[i].tolist()) for i in range(2)], "row_id int, node_id long, h array<double>")
    weights = spark.createDataFrame([(k, b[:, k].tolist(), float(k)) for k in range(8)], "token int, w array<double>, bias double")
    for w, bias in ((weights, 1), (weights.drop("bias"), 0)):
        got = {(r.row_id, r.token): r.logit for r in T.linear(beams, trie(spark), w).collect()}
        assert sorted(got) == [(0, 1), (0, 3), (1, 2), (1, 3)]
        assert all(abs(v - (a[i] @ b[:, k] + bias * k)) < 1e-9 for (i, k), v in got.items())


def test_sampling_follows_the_distribution(spark):
    rows = spark.range(4000).selectExpr("id as query_id", "explode(array(0, 1, 2)) as token").withColumn("logit", F.element_at(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), F.col("token") + 1))
    p = np.exp([0, 1, 2]) / np.exp([0, 1, 2]).sum()
    for uniform in (V.hash_uniform, T.lcg_uniform):
        counts = {r.token: r["count"] for r in T.sample(rows, ["query_id"], 1, 1.0, 7, uniform=uniform).groupBy("token").count().collect()}
        assert all(abs(counts[k] / 4000 - p[k]) < 0.04 for k in range(3))


def test_strategies(spark):
    with pytest.raises(ValueError):
        T.GenerationConfig(3, strategy="best")
    with pytest.raises(ValueError):
        T.GenerationConfig(3, k=2, strategy="sample")
    logits = spark.createDataFrame([(k, float(k)) for k in range(8)], "token int, logit double")
    score = lambda c, step: c.join(logits, "token")
    queries = spark.range(30).withColumnRenamed("id", "query_id")
    got = T.beam_search(queries, trie(spark), score, T.GenerationConfig(3, strategy="sample", temperature=1.0, seed=1)).collect()
    assert len(got) == 30 and {r.log_prob for r in got} == {0.0} and {tuple(r.tokens) for r in got} <= set(map(tuple, PATHS)) and len({tuple(r.tokens) for r in got}) > 1
    warm = T.beam_search(queries, trie(spark), score, T.GenerationConfig(3, 2, 2, 5.0, "topk")).filter("query_id = 0").orderBy("rank").collect()
    assert [r.tokens for r in warm] == [[3, 1, 3], [3, 1, 2]]  # the temperature is ignored
    assert abs(warm[0].log_prob - (-math.log(1 + math.exp(-2)) - math.log(1 + math.exp(-1)))) < 1e-9


def test_beams_to_items(spark):
    codes = spark.createDataFrame([(7, [0, 1]), (5, [0, 1]), (9, [1, 1]), (None, [1, 0]), (8, None)], "item_id long, codes array<int>")
    index = T.reverse_index(codes)
    beams = spark.createDataFrame([(1, [0, 1]), (1, [1, 1]), (2, [1, 0])], "query_id int, codes array<int>")
    assert sorted((r.query_id, r.item_id) for r in T.with_items(beams, index).collect()) == [(1, 5), (1, 9), (2, -1)]
    logits = spark.createDataFrame([(k, 0.0) for k in range(20)], "token int, logit double")
    t = T.item_trie(codes.filter("codes is not null"), 10, 2, 3)
    got = T.retrieve(spark.range(2).withColumnRenamed("id", "query_id"), t, lambda c, s: c.join(logits, "token"), index, T.GenerationConfig(2, 3, 3), 10, 3).collect()
    assert {tuple(r.pred) for r in got} == {(5, -1, 9)} and len(got) == 2


def test_prefixes_of_a_depth(spark):
    t = trie(spark)
    assert {(tuple(r.prefix), r.node_id) for r in t.prefixes(1).collect()} == {((1,), 1), ((3,), 2)}
    assert {(tuple(r.prefix), r.token) for r in t.allowed(1).collect()} == {((1,), 2), ((3,), 1)}
    assert {r.token for r in t.allowed(0).collect()} == {1, 3}
    many = [[a, b] for a in range(20) for b in range(a % 4)]
    ptrs = [r.row_ptr for r in trie(spark, many).row_ptrs().orderBy("node_id").collect()]
    kids = [r.n_children for r in trie(spark, many).nodes.orderBy("node_id").collect()]
    assert ptrs == np.concatenate([[0], np.cumsum(kids)[:-1]]).tolist()


def test_chats(spark):
    df = spark.createDataFrame([("hi", "yö"), (None, "a"), ("b", None)], "prompt string, answer string")
    got = S.chat_samples(df, X.char_ids, "be brief").collect()
    prompt = "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    answer = "yö<|im_end|>\n"
    assert got[0].input_ids == [ord(c) for c in prompt + answer] and got[0].labels == [-100] * len(prompt) + [ord(c) for c in answer]
    assert got[1].input_ids is None and got[2].labels is None
    assert df.select(S.chat_prompt("prompt")).first()[0] == prompt[prompt.index("<|im_start|>user") :]


def test_parts_with_a_public_tokenizer(spark):
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ids = X.bpe_ids("/opt/tokenizers/byte_bpe_50k.tiktoken", pattern)
    v = S.Vocabulary(50_257, 2, 8)
    df = spark.createDataFrame([(1, "a red box", [3, 4]), (2, None, [0, 7])], "id long, t string, codes array<int>").withColumn("t", F.coalesce("t", F.lit(""))).withColumn("ti", ids("t"))
    item = F.concat(F.array(F.lit(v.start)), v.item_token_ids("codes"), F.array(F.lit(v.end)))
    rows = df.withColumn("ids", F.concat("ti", item))
    runs = {}
    for r in S.decode_ids(rows, "ids", v, "id").orderBy("id", "run").collect():
        runs.setdefault(r.id, []).append((r.kind, r.codes))
    assert runs == {1: [("text", None), ("item", [3, 4])], 2: [("item", [0, 7])]}
    assert df.filter("id = 1").first().ti == X._bpe("/opt/tokenizers/byte_bpe_50k.tiktoken", pattern).encode_ordinary("a red box")


def test_contained_texts(spark):
    rng = random.Random(5)
    words = ["red", "blue", "big", "small", "car", "box", "x", "ab"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(60)] + [" ", None, "é", "b", "blue"]
    items = list(enumerate(texts))
    prompts = [" ".join(rng.choices([*words, "shoe"], k=rng.randrange(1, 9))) for _ in range(80)] + [None, "", "blueish", "é!"]
    got = S.first_contained(spark.createDataFrame([(p, 1) for p in prompts], "prompt string, _t int"), spark.createDataFrame(items, "item_id long, item_text string")).collect()
    want = sorted((str(p), str(min((i for i, t in items if p is not None and t and t.strip() and t.strip() in p), default=None))) for p in prompts)
    assert sorted((str(r.prompt), str(r.item_id)) for r in got) == want


def test_lookup_and_samples(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    table = spark.createDataFrame([(1, 10)], "id long, v long")
    assert sorted((str(r.k), r.v) for r in S.lookup(df, "k", table, "id", "v", -1).collect()) == [("1", 10), ("2", -1), ("None", -1)]
    rows = spark.range(1000)
    a, b = (sorted(r.id for r in S.sample_rows(rows.repartition(n), "id", 50).collect()) for n in (2, 5))
    assert a == b and len(a) == 50 and S.sample_rows(rows.limit(3), "id", 50).count() == 3
    left = spark.createDataFrame([(i % 3 if i % 5 else 7, i) for i in range(500)] + [(None, -1)], "k int, row int")
    right = spark.createDataFrame([(0, "a"), (7, "b"), (9, "c")], "k int, v string")
    got = sorted((r.row, r.v) for r in join_hot(left, right, "k", "row", share=0.3, salts=8).collect())
    assert got == sorted((i, "a" if i % 5 else "b") for i in range(500) if i % 5 == 0 or i % 3 == 0)


def test_metrics_of_batches(spark):
    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.normal(size=301)] + [None, None]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for q in (0.0, 0.25, 0.8, 1.0):
        assert abs(M.total_quantile(df, "v", q).first().edge - np.quantile(v[:301], q)) < 1e-12
    assert M.total_quantile(df.limit(0), "v", 0.5).first().edge is None
    flags = M.quantile_flag(df, "v").groupBy("is_low").count().collect()
    assert {r.is_low: r["count"] for r in flags} == {True: 241, False: 60, None: 2}
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0), (2, None)], "b int, loss double")
    assert tuple(M.batch_mean(rows, "b", "loss").first()) == (5.0, 2)
    r = spark.createDataFrame([([1.0, 1.0], [0.0, 2.0])], "x array<double>, y array<double>")
    one = M.level_losses(r, ["x", "y"]).first()
    assert (one.loss_0, one.loss_1, one.loss) == (0.25, 0.5, 0.75) and M.level_losses(r, []).first().loss == 0.0
    assert M.level_losses(r, ["x"], learnable=True).first().loss == 2.5
    pred = spark.createDataFrame([([[1, 2], [3, 4]], [3, 4]), ([[1, 2]], [9, 9])], "pred array<array<int>>, truth array<int>")
    assert M.evaluate(pred, "truth", spark.createDataFrame([(0.0, 3)], "loss double, n_tokens int"), cuts=(2,)).first()[:] == (2, 0.5, 1.0)
    table = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 2, 7)], "r string, c int, v int")
    assert sorted(map(tuple, M.pivot(table, "r", "c", [1, 2], "v").collect())) == [("a", 5, 6), ("b", None, 7)]


def test_codebooks(spark):
    book = spark.createDataFrame([(0, k, [float(k), 1.0]) for k in range(4)], "level int, code int, vec array<double>")
    new = spark.createDataFrame([(0, 2, [9.0, 9.0]), (0, 7, [5.0, 5.0])], "level int, code int, vec array<double>")
    assert isinstance(B.TableCodebook(book), B.Codebook) and isinstance(Q.ResidualKMeans(), B.Tokenizer)
    changed = B.TableCodebook(book).update(new)
    rows = spark.createDataFrame([(1, [2]), (2, [7]), (3, [-1]), (4, None), (5, [None])], "id int, codes array<int>")
    assert {r.id: r.vec for r in changed.lookup(rows, "codes").collect()} == {1: [9.0, 9.0], 2: None, 3: None, 4: None, 5: None}
    batch = spark.createDataFrame([(1, [7.0, 7.0]), (2, None), (3, [8.0, 8.0]), (4, [float("nan"), 1.0])], "id int, v array<double>")
    idle = book.selectExpr("level", "code", "case when code = 1 then 3 else 20 + code end as idle")
    got = {r.code: (r.vec, r.idle) for r in Q.restart_dead(book, idle, batch, "v", "id").collect()}
    assert got == {0: ([7.0, 7.0], 0), 1: ([1.0, 1.0], 3), 2: ([8.0, 8.0], 0), 3: ([7.0, 7.0], 0)}
    assert {r.code: r.idle for r in Q.restart_dead(book, idle, batch.limit(0), "v", "id").collect()} == {0: 20, 1: 3, 2: 22, 3: 23}
    q = {r.id: (r.code, r.quantized, r.residual) for r in Q.quantize(batch, "v", book).collect()}
    assert q[1] == (3, [3.0, 1.0], [4.0, 6.0]) and q[2] == (None, None, None) == q[4]
    a, b = ({r.id: r.code for r in Q.assign(batch, "v", book, most=m).collect()} for m in (0, 100))
    assert a == b == {1: 3, 2: None, 3: 3, 4: None}
    top = {r.id: r.top for r in Q.top_dot(batch, "v", np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]]), 2).collect()}
    assert [(t.code, t.score) for t in top[1]] == [(2, 14.0), (0, 7.0)] and top[2] is None
    assert B.Online().fit_step(batch) is not None


def test_texts_and_configs(spark, tmp_path):
    @dataclass
    class Settings:
        levels: int
        codes: int = 256

    (tmp_path / "c.json").write_text(json.dumps({"levels": 2}))
    assert files.read_config(str(tmp_path / "c.json"), Settings) == Settings(2)
    (tmp_path / "c.json").write_text(json.dumps({"depth": 2}))
    with pytest.raises(TypeError):
        files.read_config(str(tmp_path / "c.json"), Settings)
    (tmp_path / "meta").write_text("{'asin': 'A1', 'title': 'Box'}\nbroken\n\n{'title': 'x'}\n")
    assert tuple(files.unreadable_lines(spark, str(tmp_path / "meta")).first()) == (3, 2)
    one = spark.range(1).select(X.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("b"))), X.instruction("find", F.lit("x")), X.char_ids(F.lit(""))).first()
    assert tuple(one) == (["b", "a", "c"], "Instruct: find\nQuery:x", [])
    items = spark.createDataFrame([(1, True), (2, False), (3, None)], "item_id long, is_train boolean")
    assert [files.split_filter(items, w).count() for w in ("train", "eval", "all")] == [1, 1, 3]
    assert spark.createDataFrame([([1, 4],), ([2],), (None,)], "c array<int>").agg(V.largest_base("c")).first()[0] == 5
    flags = S.train_flag(spark.range(2000), "id").filter("is_train").count()
    assert 1850 < flags < 1950


def test_a_repeated_batch_counts_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = [spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(60, 4))], "embedding array<double>") for _ in range(3)]
    plain = Q.ResidualKMeans(levels=2, codes=4)
    for i, b in enumerate(batches):
        fit_batch(b, i, plain, str(tmp_path / "a"))
    again = Q.ResidualKMeans(levels=2, codes=4)
    for i in (0, 1, 1, 1, 2, 2):
        if i == 2:
            again.books[0][:] = 99.0  # whatever a failed attempt left in memory
        fit_batch(batches[i], i, again, str(tmp_path / "b"))
    fit_batch(batches[0].limit(0), 3, again, str(tmp_path / "b"))
    assert all(np.array_equal(x, y) for x, y in zip(plain.counts, again.counts)) and again.counts[0].sum() == 180
    assert all(np.allclose(x, y) for x, y in zip(plain.books, again.books))
    more = Q.ResidualKMeans(levels=2, codes=4, books=[b.copy() for b in plain.books], counts=[c.copy() for c in plain.counts])
    for _ in range(2):
        fit_batch(batches[0], 0, more, str(tmp_path / "c"))
    assert more.counts[0].sum() == 240


def test_free_and_constrained_generation(spark):
    logits = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 3, 0.5), (3, 9, 2.0), (5, 6, 1.0), (6, 6, 1.0)], "last_token int, token int, logit double")
    prompts = spark.createDataFrame([(1, 0), (2, 5), (3, 7)], "query_id long, last_token int")
    score = lambda rows: rows.join(logits, "last_token")
    got = {r.query_id: r.tokens for r in T.generate(prompts, score, eos_id=9, max_new=4).collect()}
    assert got == {1: [1, 3], 2: [6, 6, 6, 6], 3: []}
    with pytest.raises(ValueError):
        T.generate(prompts, score, trie(spark))
    best = spark.createDataFrame([(k, float(k)) for k in range(8)], "token int, logit double")
    beams = T.generate(prompts, lambda c, s: c.join(best, "token"), trie(spark), T.GenerationConfig(3))
    assert {tuple(r.tokens) for r in beams.collect()} == {(3, 1, 3)}


def test_functions_in_sql(spark):
    from quantloom.functions.register import register

    book = np.array([[0.0, 0.0], [4.0, 4.0]])
    register(spark, [book, book / 4])
    row = spark.sql("SELECT vec_dot(array(1D, 2D), array(3D, 4D)) a, vec_l2sq(array(1D, 2D), array(3D, 4D)) b, strip_padding(array(1L, -1L, NULL)) c, flat_ids(array(1, 2), 10L) d, sid_string(array(1, 2)) e, encode_codes(array(4D, 5.5D)) f, encode_codes(array(1D)) g").first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (11.0, 8.0, [1], 12, "<|item_start|><item_L0_C1><item_L1_C2><|item_end|>", [1, 1], None)
    rows = spark.sql("SELECT * FROM sequence_tokens(array(5, 51, 57, 58), 50, 2, 4)").collect()
    assert [(r.kind, r.code) for r in rows] == [("text", None), ("item", 1), ("item", 3), ("mark", None)]


def test_hooks_and_helpers(spark):
    rng = np.random.default_rng(2)
    batches = [spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(30, 4))], "embedding array<double>") for _ in range(2)]
    seen = []
    model = Q.fit_batches(Q.ResidualKMeans(levels=1, codes=3), batches, on_step=lambda i, m: seen.append((i, int(m.counts[0].sum()))))
    assert seen == [(0, 30), (1, 60)] and model.books[0].shape == (3, 4)
    v = S.Vocabulary(50, 2, 4)
    one = spark.range(1).select(v.codes_of(v.item_token_ids(F.array(F.lit(3), F.lit(2)))).alias("c"), V.vadd(F.array(F.lit(1.0)), F.array(F.lit(2.0))).alias("s"), V.vscale(F.array(F.lit(2.0)), F.lit(3)).alias("k")).first()
    assert tuple(one) == ([3, 2], [3.0], [6.0])
    df = spark.createDataFrame([("Red box, red car",), ("",), (None,)], "t string")
    a, b, c = (r.e for r in df.select(X.hashed_embedding("t", 16).alias("e")).collect())
    assert abs(sum(x * x for x in a) - 1) < 1e-12 and sorted(a)[-1] > 0.8 and b == [0.0] * 16 and c is None
    ids = spark.range(50)
    first, again, other = ({r.id: r.batch for r in S.batch_ids(ids.repartition(n), "id", 8, seed=s).collect()} for n, s in ((2, 1), (5, 1), (2, 2)))
    assert first == again != other and sorted(first.values()) == sorted(i // 8 for i in range(50))
