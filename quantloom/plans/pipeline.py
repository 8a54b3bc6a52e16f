"""More queries of the core: constrained decoding, retrieval, codebook maintenance, matching and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quantloom.functions.vector import dot, flat_ids, largest_base
from quantloom.operators import metrics as M
from quantloom.operators import quantize as Q
from quantloom.operators import sequences as S
from quantloom.operators import trie as T
from quantloom.plans.reference import _CODES, _ITEMS, _RQ_ITEMS, _SCORE, _TRIE, _beams_sql, _books, _codes, _gumbel_sql, _items, _level, _query, _read, _scorer, _text, _users


def _trie(spark, d) -> T.Trie:
    return T.Trie.from_codes(_codes(spark, d))


@_query(_TRIE + "SELECT n.node_id, CAST(coalesce(sum(count(g.token)) OVER (ORDER BY n.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM n LEFT JOIN g USING (node_id) GROUP BY n.node_id")
def trie_row_ptrs(spark, d):
    return _trie(spark, d).row_ptrs()


@_query(_TRIE + "SELECT array_to_string(prefix[1:1], ',') AS prefix, prefix[2] AS token FROM n WHERE depth = 2")
def trie_allowed(spark, d):
    """Which second tokens may follow each first one."""
    return _trie(spark, d).allowed(1).select(_text("prefix").alias("prefix"), "token")


def _masked(spark, d):
    """Logits of one and the same table for every inner node, masked to its children."""
    trie, score = _trie(spark, d), _scorer(spark, d)
    every = _read(spark, d, "codebook").select(F.col("level").alias("depth"), F.col("code").alias("token"))
    logits = [score(every.filter(F.col("depth") == i), i) for i in range(3)]
    return T.mask(trie.nodes.filter("n_children > 0").select("node_id", "depth"), trie, logits[0].unionByName(logits[1]).unionByName(logits[2]))


@_query(_SCORE + "SELECT g.node_id, g.token, g.child_id, round(s.base + (g.token % 7) / 10.0, 6) AS logit FROM g JOIN s ON s.level = g.depth AND s.token = g.token")
def constrained_mask(spark, d):
    return _masked(spark, d).select("node_id", "token", "child_id", F.round("logit", 6).alias("logit"))


@_query(_TRIE + "SELECT node_id, array_to_string(list_resize(list(token ORDER BY token), 256, -1), ',') AS tokens, array_to_string(list_resize(list(child_id ORDER BY token), 256, -1), ',') AS next_nodes FROM g GROUP BY node_id")
def constrained_children(spark, d):
    """Tokens and next nodes of every inner node, filled up to the width of a level."""
    out = T.padded_children(_masked(spark, d), ["node_id"], 256)
    return out.select("node_id", _text("tokens").alias("tokens"), _text("next_nodes").alias("next_nodes"))


@_query(f"WITH {_ITEMS}, {_CODES}, r AS (SELECT DISTINCT codes[1] AS token FROM c), x AS (SELECT vec_id AS item_id, token, list_inner_product(v, w) + token / 1000.0 AS logit FROM e, r JOIN k ON level = 0 AND code = token), y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY logit DESC, token) AS rank FROM x) SELECT item_id, rank, token, round(logit, 5) AS logit FROM y WHERE rank <= 5")
def constrained_linear(spark, d):
    """Hidden states (the items' vectors) times weights (the first codebook) plus a bias, at the children of the root only."""
    beams = _items(spark, d).filter("embedding is not null").select("item_id", F.col("embedding").alias("h"), F.lit(0).cast("long").alias("node_id"))
    book = _read(spark, d, "codebook").filter("level = 0")
    weights = F.broadcast(book.select(F.col("code").alias("token"), F.col("vec").cast("array<double>").alias("w"), (F.col("code") / 1000).alias("bias")))  # one row a code
    top = T.top_k(T.linear(beams, _trie(spark, d), weights), ["item_id"], 5)
    return top.select("item_id", "rank", "token", F.round("logit", 5).alias("logit"))


@_query(f"WITH {_ITEMS}, y AS (SELECT vec_id AS item_id, code, list_inner_product(v, w) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY list_inner_product(v, w) DESC, code) AS rank FROM e, k WHERE level = 0) SELECT item_id, rank, code, round(score, 5) AS score FROM y WHERE rank <= 5")
def vec_dot_topk(spark, d):
    rows = Q.top_dot(_items(spark, d), "embedding", _books(spark, d)[0], 5).filter("top is not null")
    return rows.select("item_id", F.posexplode("top").alias("p", "t")).select("item_id", (F.col("p") + 1).alias("rank"), "t.code", F.round("t.score", 5).alias("score"))


@_query(_SCORE + f", x AS (SELECT g.node_id, g.token, row_number() OVER (PARTITION BY g.node_id ORDER BY (s.base + (g.token % 7) / 10.0) / 0.7 + {_gumbel_sql(5, 'g.node_id', 'g.token')} DESC, g.token) AS rank FROM g JOIN s ON s.level = g.depth AND s.token = g.token) SELECT node_id, rank, token FROM x WHERE rank <= 3")
def gumbel_sample(spark, d):
    """Three draws without replacement from the children of every inner node."""
    return T.sample(_masked(spark, d), ["node_id"], 3, 0.7, 5, uniform=T.lcg_uniform).select("node_id", "rank", "token")


_PRED = _beams_sql(3, 4) + ", r AS (SELECT codes, min(item_id) AS item_id FROM c GROUP BY codes), pd AS (SELECT query_id, list(coalesce(r.item_id, -1) ORDER BY beam_id) AS pred, list(tokens ORDER BY beam_id) AS tuples FROM b2 LEFT JOIN r ON r.codes = b2.tokens GROUP BY query_id)"
_FUT = ", f AS (SELECT user_id AS query_id, max(item_fut) AS item_fut FROM history WHERE split = 'test' AND user_id IS NOT NULL AND item_fut >= 0 GROUP BY user_id)"


def _retrieved(spark, d):
    codes = _codes(spark, d)
    trie = T.item_trie(codes, 50_257, 3, 256)
    plain = _scorer(spark, d)

    def score(candidates, step):
        first = 50_257 + 256 * step
        scored = plain(candidates.withColumn("token", F.col("token") - first), step)
        return scored.withColumn("token", (F.col("token") + first).cast("int"))

    config = T.GenerationConfig(steps=3, k=3, beam_size=4)
    return T.retrieve(_users(spark, d), trie, score, T.reverse_index(codes), config, 50_257, 256)


def _future(spark, d):
    return _read(spark, d, "history").filter("split = 'test' and user_id is not null and item_fut >= 0").groupBy(F.col("user_id").alias("query_id")).agg(F.max("item_fut").alias("item_fut"))


@_query(_PRED + " SELECT query_id, array_to_string(pred, ',') AS pred FROM pd")
def beam_items(spark, d):
    """The items of each user's beams over token ids, -1 where no item has the codes."""
    return _retrieved(spark, d).select("query_id", _text("pred").alias("pred"))


@_query(_PRED + _FUT + ", l AS (SELECT exp(sum(abs(sin(sample_id)) * len(input_ids)) / sum(len(input_ids))) AS perplexity FROM samples WHERE input_ids IS NOT NULL) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN list_contains(pred[1:{c}], item_fut) THEN 1 ELSE 0 END), 9) AS recall_at_{c}" for c in (1, 3)) + ", round(any_value(perplexity), 6) AS perplexity FROM pd JOIN f USING (query_id), l")
def retrieval_evaluation(spark, d):
    """Recall of the future items of the test split among the retrieved ones, with the perplexity of the samples beside it."""
    losses = _read(spark, d, "samples").filter("input_ids is not null").select(F.abs(F.sin("sample_id")).alias("loss"), F.size("input_ids").alias("n_tokens"))
    out = M.evaluate(_retrieved(spark, d).join(_future(spark, d), "query_id"), "item_fut", losses, cuts=(1, 3))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("recall_at_1", "recall_at_3")], F.round("perplexity", 6).alias("perplexity"))


@_query(_PRED + _FUT + " SELECT count(*) AS n, round(avg(CASE WHEN list_contains(tuples, c.codes) THEN 1 ELSE 0 END), 9) AS recall_at_3 FROM pd JOIN f USING (query_id) JOIN c ON c.item_id = f.item_fut")
def retrieval_code_recall(spark, d):
    """The same on code tuples."""
    beams = T.beam_search(_users(spark, d), _trie(spark, d), _scorer(spark, d), T.GenerationConfig(steps=3, k=3, beam_size=4))
    pred = beams.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tokens"))), lambda x: x["tokens"]).alias("pred"))
    truth = _future(spark, d).join(_codes(spark, d).withColumnRenamed("item_id", "item_fut"), "item_fut")
    return M.recall_at(pred.join(truth, "query_id"), "pred", "codes", (3,)).select("n", F.round("recall_at_3", 9).alias("recall_at_3"))


@_query(f"WITH {_CODES}, b AS (SELECT max(list_max(codes)) + 1 AS base FROM c) SELECT DISTINCT h.user_id, h.split, h.item_fut, coalesce((codes[1] * base + codes[2]) * base + codes[3], -1) AS flat_id FROM history h CROSS JOIN b LEFT JOIN c ON c.item_id = h.item_fut WHERE user_id IS NOT NULL")
def item_lookup_join(spark, d):
    """The code number of each history's future item, by the smallest base that holds all codes; -1 if it has none."""
    codes = _codes(spark, d)
    known = codes.crossJoin(F.broadcast(codes.agg(largest_base("codes").alias("base")))).select("item_id", flat_ids("codes", "base").alias("flat_id"))  # one row on the right
    rows = _read(spark, d, "history").filter("user_id is not null").select("user_id", "split", "item_fut").distinct()
    return S.lookup(rows, "item_fut", known, "item_id", "flat_id", -1)


_MATCH = "t AS (SELECT item_id, min(item_text) AS t FROM catalog_items WHERE item_id IS NOT NULL GROUP BY item_id)"


@_query(f"WITH {_MATCH}, p AS (SELECT item_id AS asked, CASE WHEN item_id % 3 = 0 THEN 'about ' || t ELSE 'I want ' || t || ' now' END AS prompt FROM t) SELECT asked, min(t.item_id) AS item_id FROM p LEFT JOIN t ON trim(t.t) <> '' AND contains(p.prompt, trim(t.t)) GROUP BY asked")
def prompt_match(spark, d):
    """Which item a prompt about every item of the catalogue names."""
    items = _read(spark, d, "catalog_items").filter("item_id is not null").groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    prompt = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("about "), "item_text")).otherwise(F.concat(F.lit("I want "), "item_text", F.lit(" now")))
    return S.first_contained(items.select(F.col("item_id").alias("asked"), prompt.alias("prompt")), items).select("asked", "item_id")


@_query(f"WITH {_ITEMS}{_level(0)} SELECT vec_id AS item_id, c0 AS code, round(list_sum(w), 5) AS quantized, round(sqrt(list_inner_product(r0.v, r0.v)), 5) AS residual FROM r0 JOIN k ON k.level = 0 AND k.code = c0")
def quantize_residuals(spark, d):
    rows = Q.quantize(_items(spark, d).filter("embedding is not null"), "embedding", _read(spark, d, "codebook"))
    return rows.select("item_id", "code", F.round(F.aggregate("quantized", F.lit(0.0), lambda s, x: s + x), 5).alias("quantized"), F.round(F.sqrt(dot("residual", "residual")), 5).alias("residual"))


@_query(_RQ_ITEMS + ", l AS (SELECT (SELECT 0.25 * sum(list_inner_product(v, v)) / sum(64) FROM r0) AS a, (SELECT 0.25 * sum(list_inner_product(v, v)) / sum(64) FROM r1) AS b, (SELECT 0.25 * sum(list_inner_product(v, v)) / sum(64) FROM r2) AS c) SELECT round(a, 8) AS loss_0, round(b, 8) AS loss_1, round(c, 8) AS loss_2, round(a + b + c, 8) AS loss FROM l")
def commitment_loss(spark, d):
    """Commitment loss of each level of the codebook on every item, and their sum."""
    rows = Q.encode(_items(spark, d).filter("embedding is not null"), "embedding", _books(spark, d))
    book = _read(spark, d, "codebook")
    for k in range(3):
        rows = Q.decode(rows.withColumn("_c", F.slice("codes", 1, k + 1)), "_c", book, "_v").withColumn(f"r{k}", F.zip_with("embedding", "_v", lambda x, y: x - y))
    return M.level_losses(rows, ["r0", "r1", "r2"]).select(*[F.round(c, 8).alias(c) for c in ("loss_0", "loss_1", "loss_2", "loss")])


@_query(f"WITH {_ITEMS}{_level(0)}, t AS (SELECT c0 AS code, generate_subscripts(e.v, 1) AS i, unnest(e.v) AS x FROM r0 JOIN e USING (vec_id)), s AS (SELECT code, i, sum(x) AS x, count(*) AS n FROM t GROUP BY ALL) SELECT k.code, CAST(k.code + 1 + coalesce(max(s.n), 0) AS BIGINT) AS n, round(sum(CASE WHEN s.n IS NULL THEN NULL ELSE (k.w[s.i] * (k.code + 1) + s.x) / (k.code + 1 + s.n) END), 5) AS total FROM k LEFT JOIN s ON s.code = k.code WHERE k.level = 0 AND s.n IS NOT NULL GROUP BY k.code")
def kmeans_running_mean(spark, d):
    """One batch (the catalogue) on centres that have seen code + 1 vectors each; codes without members keep theirs and are not listed."""
    book = _books(spark, d)[0]
    before = np.arange(1, len(book) + 1)
    model = Q.ResidualKMeans(levels=1, codes=len(book), books=[book], counts=[before]).fit_step(_items(spark, d))
    rows = [(k, int(n), float(v.sum())) for k, (n, v) in enumerate(zip(model.counts[0], model.books[0])) if n > before[k]]
    return spark.createDataFrame(rows, "code int, n long, total double").withColumn("total", F.round("total", 5))


@_query(f"WITH {_ITEMS}, dead AS (SELECT level, code, row_number() OVER (ORDER BY level, code) - 1 AS i FROM k WHERE code % 40 >= 20), v AS (SELECT e.v, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM e), x AS (SELECT level, code, v FROM dead JOIN v ON v.i = dead.i % least(v.n, (SELECT count(*) FROM dead))) SELECT k.level, k.code, CASE WHEN x.v IS NULL THEN k.code % 40 ELSE 0 END AS idle, round(list_sum(coalesce(x.v, k.w)), 5) AS total FROM k LEFT JOIN x USING (level, code)")
def dead_code_restart(spark, d):
    """Codes idle for 20 steps or more (here those with code % 40 >= 20) start again at items in order of their ids."""
    book = _read(spark, d, "codebook")
    idle = book.select("level", "code", (F.col("code") % 40).alias("idle"))
    out = Q.restart_dead(book, idle, _items(spark, d), "embedding", "item_id")
    return out.select("level", "code", "idle", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@_query("WITH n AS (SELECT 1 AS level, code, vec FROM codebook WHERE level = 0 AND code % 10 = 0) SELECT k.level, k.code, round(list_sum(CAST(coalesce(n.vec, k.vec) AS DOUBLE[])), 5) AS total FROM codebook k LEFT JOIN n USING (level, code)")
def codebook_overwrite(spark, d):
    book = _read(spark, d, "codebook")
    new = book.filter("level = 0 and code % 10 = 0").select(F.lit(1).alias("level"), "code", "vec")
    return Q.overwrite_codes(book, new).select("level", "code", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _stats_sql(source: str, by: str = "") -> str:
    cols = [("n", "count(*)"), ("min", "min(l)"), ("max", "max(l)"), ("mean", "avg(l)"), ("std", "stddev_pop(l)"), *[(f"p{p}", f"quantile_cont(l, {p / 100})") for p in M.PERCENTILES]]
    return f"SELECT {by}{', '.join(f'{e} AS {n}' for n, e in cols)} FROM {source}"


_METRICS = ("n", "min", "max", "mean", "std", *[f"p{p}" for p in M.PERCENTILES])


@_query("WITH l AS (SELECT split, len(input_ids) AS l FROM samples WHERE input_ids IS NOT NULL), a AS (" + _stats_sql("l WHERE split = 'train'") + "), b AS (" + _stats_sql("l WHERE split = 'eval'") + ") " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(CAST(a.{m} AS DOUBLE), 6) AS a, round(CAST(b.{m} AS DOUBLE), 6) AS b, round(CAST(b.{m} AS DOUBLE) - a.{m}, 6) AS delta, round(CASE WHEN a.{m} <> 0 THEN 100 * (CAST(b.{m} AS DOUBLE) - a.{m}) / a.{m} END, 6) AS percent FROM a, b" for m in _METRICS))
def length_stats_delta(spark, d):
    """Lengths of training samples against those of evaluation samples."""
    rows = _read(spark, d, "samples").filter("input_ids is not null").select("split", F.size("input_ids").alias("l"))
    out = M.stats_delta(M.length_stats(rows, "l", ["split"]), "split", "train", "eval")
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta", "percent")])


@_query("WITH l AS (SELECT 'samples' AS source, len(input_ids) AS l FROM samples WHERE input_ids IS NOT NULL UNION ALL SELECT 'history', len(items) FROM history WHERE items IS NOT NULL), x AS (" + _stats_sql("l GROUP BY ROLLUP (source)", "source, ") + ") SELECT source, n, min, max, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS[3:]) + " FROM x")
def length_stats_union(spark, d):
    """Lengths of two tables together and apart."""
    rows = _read(spark, d, "samples").filter("input_ids is not null").select(F.lit("samples").alias("source"), F.size("input_ids").alias("l"))
    rows = rows.unionByName(_read(spark, d, "history").filter("items is not null").select(F.lit("history").alias("source"), F.size("items").alias("l")))
    return M.length_stats(rows, "l", ["source"], total=True).select("source", "n", "min", "max", *[F.round(m, 6).alias(m) for m in _METRICS[3:]])


@_query("WITH b AS (SELECT sample_id // 64 AS batch, avg(abs(sin(sample_id))) AS m FROM samples GROUP BY 1) SELECT round(avg(m), 9) AS loss, count(*) AS n_batches FROM b")
def batch_losses(spark, d):
    rows = _read(spark, d, "samples").select(F.floor(F.col("sample_id") / 64).alias("batch"), F.abs(F.sin("sample_id")).alias("loss"))
    return M.batch_mean(rows, "batch", "loss").select(F.round("loss", 9).alias("loss"), "n_batches")


@_query("SELECT template, " + ", ".join(f"nullif(count(*) FILTER (split = '{s}'), 0) AS \"{s}\"" for s in ("train", "eval", "test")) + " FROM samples GROUP BY template")
def sample_pivot(spark, d):
    counts = _read(spark, d, "samples").groupBy("template", "split").agg(F.count("*").alias("n"))
    return M.pivot(counts, "template", "split", ("train", "eval", "test"), "n")


@_query("SELECT user_id FROM (SELECT DISTINCT user_id FROM history WHERE user_id IS NOT NULL) ORDER BY ((user_id % 2147483647) * 48271 + 42 * 7919) % 2147483647, user_id LIMIT 100")
def seeded_sample(spark, d):
    """A sampling operator: 100 users in a seeded order."""
    return S.sample_rows(_read(spark, d, "history").filter("user_id is not null").select("user_id").distinct(), "user_id", 100)
