"""Queries of the quantization, trie, decoding, sequence and metric operators, with their SQL.

Arrays come out joined by commas, so both engines compare plain strings. Every query runs over whole tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.text import char_ids
from quantloom.functions.vector import dot, finite, flat_ids, l2_normalize, sid_string, strip_padding, tail
from quantloom.operators import metrics as M
from quantloom.operators import quantize as Q
from quantloom.operators import sequences as S
from quantloom.operators import trie as T
from quantloom.operators.rqvae import Autoencoder, AutoencoderConfig
from quantloom.session import stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
VOCABULARY = S.Vocabulary(50_257, 3, 256)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _books(spark: SparkSession, d: str) -> list:
    return Q.codebook_arrays(_read(spark, d, "codebook"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """One full, valid tuple an item."""
    ok = (F.size("codes") == 3) & F.forall("codes", lambda c: c.isNotNull() & (c >= 0))
    return _read(spark, d, "codes").filter("item_id is not null").filter(ok).groupBy("item_id").agg(F.min("codes").alias("codes"))


_CODES = "c AS (SELECT item_id, min(codes) AS codes FROM codes WHERE item_id IS NOT NULL AND len(codes) = 3 AND len(list_filter(codes, lambda x: x >= 0)) = 3 GROUP BY item_id)"
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT level, code, CAST(vec AS DOUBLE[]) AS w FROM codebook)"


def _level(i: int) -> str:
    source, vector = ("e", "v") if i == 0 else (f"r{i - 1}", "v")
    keep = "" if i == 0 else ", " + ", ".join(f"c{j}" for j in range(i))
    return f""", d{i} AS (SELECT vec_id{keep}, {vector} AS v, code AS c{i}, w, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance({vector}, w), code) AS rn FROM {source}, k WHERE level = {i}),
 r{i} AS (SELECT vec_id{keep}, c{i}, list_transform(list_zip(v, w), lambda z: z[1] - z[2]) AS v FROM d{i} WHERE rn = 1)"""


_RQ = "WITH " + _E + _level(0) + _level(1) + _level(2)


@_query(f"WITH {_E}{_level(0)} SELECT vec_id, c0 AS code FROM r0")
def nn_assign(spark, d):
    return Q.find_nearest(_read(spark, d, "embeddings"), "embedding", _books(spark, d)[0]).select("vec_id", "code")


@_query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT a.vec_id, b.vec_id AS code, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rn FROM e a, e b WHERE b.vec_id < 16) SELECT code, count(*) AS n FROM x WHERE rn = 1 GROUP BY code")
def nn_assign_counts(spark, d):
    """The small-codebook form: one expression, no Python."""
    e = _read(spark, d, "embeddings")
    book = e.filter("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("embedding").cast("array<double>").alias("vec"))
    return Q.find_nearest_sql(e, "embedding", book).groupBy("code").agg(F.count("*").alias("n"))


@_query(_RQ + " SELECT vec_id, concat_ws(',', c0, c1, c2) AS codes FROM r2")
def rq_encode(spark, d):
    return Q.encode(_read(spark, d, "embeddings"), "embedding", _books(spark, d)).select("vec_id", _text("codes").alias("codes"))


@_query(f"WITH {_CODES}, k AS (SELECT level, code, CAST(vec AS DOUBLE[]) AS w FROM codebook) SELECT item_id, round(x.w[1] + y.w[1] + z.w[1], 6) AS first, round(list_sum(x.w) + list_sum(y.w) + list_sum(z.w), 5) AS total FROM c JOIN k x ON x.level = 0 AND x.code = codes[1] JOIN k y ON y.level = 1 AND y.code = codes[2] JOIN k z ON z.level = 2 AND z.code = codes[3]")
def rq_decode(spark, d):
    out = Q.decode(_codes(spark, d), "codes", _read(spark, d, "codebook"))
    return out.select("item_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@_query(_RQ + " SELECT round(sum(list_inner_product(v, v)) / sum(len(v)), 8) AS mse, count(*) AS n FROM r2")
def rq_reconstruction(spark, d):
    df = Q.encode(_read(spark, d, "embeddings"), "embedding", _books(spark, d))
    return M.reconstruction_error(Q.decode(df, "codes", _read(spark, d, "codebook")), "embedding", "vec").select(F.round("mse", 8).alias("mse"), "n")


@_query(f"WITH {_E}{_level(0)}, t AS (SELECT c0 AS code, generate_subscripts(e.v, 1) AS i, unnest(e.v) AS x FROM r0 JOIN e USING (vec_id)) SELECT code, i - 1 AS pos, round(avg(x), 6) AS centre, count(*) AS n FROM t GROUP BY ALL")
def kmeans_minibatch_step(spark, d):
    """One step from the given first level with counts of 0: the new centre of a code is its batch mean."""
    books = _books(spark, d)
    sums = Q.partial_sums(_read(spark, d, "embeddings"), "embedding", books, 0)
    return sums.select("code", "n", F.posexplode("total").alias("pos", "t")).select("code", "pos", F.round(F.col("t") / F.col("n"), 6).alias("centre"), "n")


@_query(f"WITH {_E}{_level(0)}, t AS (SELECT c0 AS code, generate_subscripts(e.v, 1) AS i, unnest(e.v) AS x FROM r0 JOIN e USING (vec_id)), s AS (SELECT code, i, sum(x) AS x, count(*) AS n FROM t GROUP BY ALL) SELECT s.code, i - 1 AS pos, round((0.99 * k.w[i] + 0.01 * x) / (0.99 + 0.01 * n), 6) AS vec FROM s JOIN k ON k.level = 0 AND k.code = s.code")
def ema_step(spark, d):
    """One moving-average step of the active codes, from sizes of 1 and sums equal to the codes."""
    return _ema(spark, _read(spark, d, "embeddings"), _books(spark, d)[0])


def _ema(spark: SparkSession, vectors: DataFrame, book: np.ndarray) -> DataFrame:
    n, total = np.zeros(len(book), dtype=np.int64), np.zeros_like(book)
    for r in Q.partial_sums(vectors, "embedding", [book], 0).collect():  # one row a code
        n[r.code], total[r.code] = r.n, r.total
    moved = Q.ema_update(np.ones(len(book)), book, book, n, total)[2]
    table = spark.createDataFrame([(int(k), moved[k].tolist()) for k in np.flatnonzero(n)], "code int, vec array<double>")
    return table.select("code", F.posexplode("vec").alias("pos", "v")).select("code", "pos", F.round("v", 6).alias("vec"))


@_query()
def rq_kmeans_fit(spark, d):
    e = _read(spark, d, "embeddings")
    model = Q.ResidualKMeans(levels=3, codes=16, seed=1).fit(e, epochs=2)
    return M.reconstruction_error(model.inverse_transform(model.transform(e)), "embedding", "vec")


@_query()
def rqvae_fit(spark, d):
    e = _read(spark, d, "embeddings")
    model = Autoencoder(AutoencoderConfig(codes=16)).fit(e)
    return M.reconstruction_error(model.inverse_transform(model.transform(e)), "embedding", "vec")


@_query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, CAST(1 AS DOUBLE) AS unit FROM embeddings")
def vec_norm(spark, d):
    u = l2_normalize("embedding")
    return _read(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm"), F.round(dot(u, u), 6).alias("unit"))


def _latest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, v) of every item of the catalogue: its latest usable vector, ties by content, else null.

    Usable are 64 finite numbers that are not all zero.
    """
    usable = (F.size("embedding") == 64) & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    best = F.max(F.when(usable, F.struct("loaded_at", "embedding")))["embedding"]
    return _read(spark, d, "catalog_items").filter("item_id is not null").groupBy("item_id").agg(best.alias("v"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """The same at unit length, as the codebook expects them."""
    return _latest_vectors(spark, d).select("item_id", l2_normalize("v").alias("embedding"))


_ITEMS = """u AS (SELECT item_id, max({'at': coalesce(loaded_at, TIMESTAMP '0001-01-01'), 'v': embedding}).v AS v FROM catalog_items WHERE item_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY item_id),
 w AS (SELECT item_id, CAST(v AS DOUBLE[]) AS v FROM u), n AS (SELECT item_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS norm FROM w),
 e AS (SELECT item_id AS vec_id, list_transform(list_zip(v, list_resize([norm], 64, norm)), lambda z: z[1] / z[2]) AS v FROM n),
 a AS (SELECT DISTINCT item_id FROM catalog_items WHERE item_id IS NOT NULL), k AS (SELECT level, code, CAST(vec AS DOUBLE[]) AS w FROM codebook)"""
_RQ_ITEMS = "WITH " + _ITEMS + _level(0) + _level(1) + _level(2)


@_query(f"WITH {_ITEMS}{_level(0)} SELECT item_id, c0 AS code FROM a LEFT JOIN r0 ON vec_id = item_id")
def nn_assign_items(spark, d):
    return Q.find_nearest(_items(spark, d), "embedding", _books(spark, d)[0]).select("item_id", "code")


@_query(f"WITH {_ITEMS}{_level(0)} SELECT c0 AS code, count(*) AS n FROM a LEFT JOIN r0 ON vec_id = item_id GROUP BY c0")
def nn_assign_counts_items(spark, d):
    """The form without Python over the first level; items without a usable vector count under null."""
    book = _read(spark, d, "codebook").filter("level = 0").select("code", F.col("vec").cast("array<double>").alias("vec"))
    return Q.find_nearest_sql(_items(spark, d), "embedding", book).groupBy("code").agg(F.count("*").alias("n"))


@_query(_RQ_ITEMS + " SELECT item_id, CASE WHEN c0 IS NOT NULL THEN concat_ws(',', c0, c1, c2) END AS codes FROM a LEFT JOIN r2 ON vec_id = item_id")
def rq_encode_items(spark, d):
    return Q.encode(_items(spark, d), "embedding", _books(spark, d)).select("item_id", _text("codes").alias("codes"))


@_query(_RQ_ITEMS + " SELECT round(sum(list_inner_product(v, v)) / sum(len(v)), 8) AS mse, count(*) AS n FROM r2")
def rq_reconstruction_items(spark, d):
    df = Q.encode(_items(spark, d).filter("embedding is not null"), "embedding", _books(spark, d))
    return M.reconstruction_error(Q.decode(df, "codes", _read(spark, d, "codebook")), "embedding", "vec").select(F.round("mse", 8).alias("mse"), "n")


@_query(f"WITH {_ITEMS}{_level(0)}, t AS (SELECT c0 AS code, generate_subscripts(e.v, 1) AS i, unnest(e.v) AS x FROM r0 JOIN e USING (vec_id)) SELECT code, i - 1 AS pos, round(avg(x), 6) AS centre, count(*) AS n FROM t GROUP BY ALL")
def kmeans_minibatch_step_items(spark, d):
    sums = Q.partial_sums(_items(spark, d), "embedding", _books(spark, d), 0)
    return sums.select("code", "n", F.posexplode("total").alias("pos", "t")).select("code", "pos", F.round(F.col("t") / F.col("n"), 6).alias("centre"), "n")


@_query(f"WITH {_ITEMS}{_level(0)}, t AS (SELECT c0 AS code, generate_subscripts(e.v, 1) AS i, unnest(e.v) AS x FROM r0 JOIN e USING (vec_id)), s AS (SELECT code, i, sum(x) AS x, count(*) AS n FROM t GROUP BY ALL) SELECT s.code, i - 1 AS pos, round((0.99 * k.w[i] + 0.01 * x) / (0.99 + 0.01 * n), 6) AS vec FROM s JOIN k ON k.level = 0 AND k.code = s.code")
def ema_step_items(spark, d):
    return _ema(spark, _items(spark, d), _books(spark, d)[0])


@_query(f"WITH {_ITEMS} SELECT item_id, round(norm, 6) AS norm, CASE WHEN norm IS NOT NULL THEN CAST(1 AS DOUBLE) END AS unit FROM a LEFT JOIN n USING (item_id)")
def vec_norm_items(spark, d):
    """Length of each item's latest usable vector as stored, and that of its unit vector."""
    rows = _latest_vectors(spark, d)
    u = l2_normalize("v")
    return rows.select("item_id", F.round(F.sqrt(dot("v", "v")), 6).alias("norm"), F.round(dot(u, u), 6).alias("unit"))


@_query()
def rq_kmeans_fit_items(spark, d):
    """Three epochs of three levels of 256 codes, as in the project, over the whole catalogue."""
    e = stage(_items(spark, d).filter("embedding is not null"))
    model = Q.ResidualKMeans(seed=1).fit(e)
    return M.reconstruction_error(model.inverse_transform(model.transform(e)), "embedding", "vec")


@_query()
def rqvae_fit_items(spark, d):
    """256 codes a level, as in the project."""
    e = stage(_items(spark, d).filter("embedding is not null"))
    model = Autoencoder(AutoencoderConfig(codes=256)).fit(e)
    return M.reconstruction_error(model.inverse_transform(model.transform(e)), "embedding", "vec")


@_query(f"WITH {_CODES} SELECT item_id, CAST((codes[1] * 256 + codes[2]) * 256 + codes[3] AS BIGINT) AS flat_id FROM c")
def flat_code_ids(spark, d):
    return _codes(spark, d).select("item_id", flat_ids("codes", 256).alias("flat_id"))


@_query(f"WITH {_CODES} SELECT count(*) AS n, count(DISTINCT codes) AS n_unique, round(count(DISTINCT codes) / count(*), 9) AS p_unique FROM c")
def code_uniqueness(spark, d):
    return M.unique_share(_codes(spark, d)).withColumn("p_unique", F.round("p_unique", 9))


@_query(f"WITH {_CODES}, x AS (SELECT generate_subscripts(codes, 1) - 1 AS level, unnest(codes) AS code FROM c), y AS (SELECT level, code, count(*) AS k FROM x GROUP BY ALL), z AS (SELECT *, k / sum(k) OVER (PARTITION BY level) AS p FROM y) SELECT level, count(*) AS n_codes, round(sum(-p * ln(p)), 6) AS entropy FROM z GROUP BY level")
def code_entropy(spark, d):
    return M.level_entropy(_codes(spark, d)).withColumn("entropy", F.round("entropy", 6))


@_query(f"WITH {_CODES} SELECT array_to_string(codes, ',') AS codes, min(item_id) AS item_id, count(*) AS n_items FROM c GROUP BY 1")
def code_reverse_index(spark, d):
    return T.reverse_index(_codes(spark, d)).select(_text("codes").alias("codes"), "item_id", "n_items")


_TRIE = f"""WITH {_CODES}, p AS (SELECT DISTINCT l AS depth, codes[1:l] AS prefix FROM c, (SELECT unnest([1, 2, 3]) AS l)),
 n AS (SELECT 0 AS node_id, 0 AS depth, CAST([] AS INT[]) AS prefix UNION ALL SELECT row_number() OVER (ORDER BY depth, prefix), depth, prefix FROM p),
 g AS (SELECT a.node_id, a.depth, b.prefix[-1] AS token, b.node_id AS child_id FROM n a JOIN n b ON b.depth = a.depth + 1 AND b.prefix[1:a.depth] = a.prefix)
"""


@_query(_TRIE + "SELECT n.node_id, n.depth, array_to_string(n.prefix, ',') AS prefix, count(g.token) AS n_children FROM n LEFT JOIN g USING (node_id) GROUP BY ALL")
def trie_nodes(spark, d):
    return T.Trie.from_codes(_codes(spark, d)).nodes.select("node_id", "depth", _text("prefix").alias("prefix"), "n_children")


@_query(_TRIE + "SELECT node_id, depth, token, child_id FROM g")
def trie_edges(spark, d):
    return T.Trie.from_codes(_codes(spark, d)).edges


@_query(_TRIE + ", m AS (SELECT n.depth, n.node_id, count(g.token) AS k FROM n LEFT JOIN g USING (node_id) GROUP BY ALL) SELECT depth, max(k) AS max_branches FROM m GROUP BY depth")
def trie_branches(spark, d):
    return T.Trie.from_codes(_codes(spark, d)).layer_max_branches()


@_query(_TRIE + "SELECT k.code AS code, n.node_id FROM codebook k LEFT JOIN n ON n.prefix = [k.code] WHERE k.level = 0")
def trie_prefix_lookup(spark, d):
    asked = _read(spark, d, "codebook").filter("level = 0").select("code", F.array("code").alias("asked"))
    return T.Trie.from_codes(_codes(spark, d)).find_prefix(asked, "asked").select("code", "node_id")


def _scorer(spark, d):
    """Logits by how many items have a code at a level, and by the query; a fixed table of levels x codes rows at most."""
    seen = _codes(spark, d).select(F.posexplode("codes").alias("level", "token")).groupBy("level", "token").agg(F.count("*").alias("c"))

    def score(candidates: DataFrame, step: int) -> DataFrame:
        table = seen.filter(F.col("level") == step).select("token", F.ln(F.col("c").cast("double") + 1).alias("base"))
        query = F.col("query_id") if "query_id" in candidates.columns else F.lit(0)
        return candidates.join(F.broadcast(table), "token").withColumn("logit", F.col("base") + F.pmod(F.col("token") + query, F.lit(7)) / 10).drop("base")

    return score


def _users(spark, d) -> DataFrame:
    return _read(spark, d, "history").filter("user_id is not null").select(F.col("user_id").alias("query_id")).distinct()


_SCORE = _TRIE + ", s AS (SELECT level, code AS token, ln(count(*) + 1) AS base FROM (SELECT generate_subscripts(codes, 1) - 1 AS level, unnest(codes) AS code FROM c) GROUP BY level, code), q AS (SELECT DISTINCT user_id AS query_id FROM history WHERE user_id IS NOT NULL)"


def _gumbel_sql(seed: int, *parts: str) -> str:
    total = " + ".join([str(seed * 7_919), *[f"CAST({p} AS BIGINT) * {k}" for p, k in zip(parts, (104_729, 1_299_709, 15_485_863))]])
    h = f"[({total}) % 1000003]"
    for _ in range(3):
        h = f"list_transform({h}, lambda x: (x * x * 31 + x * 17 + 7) % 1000003)"
    u = f"({h}[1] + 0.5) / 1000003.0"
    return f"(-ln(-ln({u} + 1e-10) + 1e-10))"


def _beams_sql(k: int, width: int, temperature: float = 0.0, seed: int = 0) -> str:
    """Three unrolled steps; the last beams are b2."""
    sql, before = _SCORE, "(SELECT query_id, 1 AS beam_id, CAST([] AS INT[]) AS tokens, 0 AS node_id, CAST(0 AS DOUBLE) AS log_prob FROM q)"
    warm = temperature or 1.0
    for i in range(3):
        noise = _gumbel_sql(seed + i, "query_id", "beam_id", "token") if temperature else "0"
        sql += f""", a{i} AS (SELECT b.query_id, b.beam_id, b.tokens, b.log_prob, g.token, g.child_id, (s.base + ((g.token + b.query_id) % 7) / 10.0) / {warm} AS logit FROM {before} b JOIN g ON g.node_id = b.node_id JOIN s ON s.level = {i} AND s.token = g.token),
 z{i} AS (SELECT *, logit - max(logit) OVER (PARTITION BY query_id, beam_id) AS z FROM a{i}),
 l{i} AS (SELECT *, z - ln(sum(exp(z)) OVER (PARTITION BY query_id, beam_id)) AS lp, row_number() OVER (PARTITION BY query_id, beam_id ORDER BY logit + {noise} DESC, token) AS rn FROM z{i}),
 m{i} AS (SELECT query_id, list_append(tokens, token) AS tokens, child_id AS node_id, log_prob + lp AS log_prob FROM l{i} WHERE rn <= {width}),
 o{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY log_prob DESC, tokens) AS beam_id FROM m{i}),
 b{i} AS (SELECT * FROM o{i} WHERE beam_id <= {k})"""
        before = f"b{i}"
    return sql


_BEAMS = " SELECT query_id, beam_id AS rank, array_to_string(tokens, ',') AS tokens, round(log_prob, 6) AS log_prob FROM b2"


def _shown(beams: DataFrame) -> DataFrame:
    return beams.select("query_id", "rank", _text("tokens").alias("tokens"), F.round("log_prob", 6).alias("log_prob"))


@_query(_beams_sql(3, 4) + _BEAMS)
def beam_search_greedy(spark, d):
    """Logits differ between users, and so do their beams."""
    return _shown(T.beam_search(_users(spark, d), T.Trie.from_codes(_codes(spark, d)), _scorer(spark, d), T.GenerationConfig(steps=3, k=3, beam_size=4)))


@_query(_beams_sql(2, 2, 0.8, 3) + _BEAMS)
def beam_search_sampled(spark, d):
    config = T.GenerationConfig(steps=3, k=2, beam_size=2, temperature=0.8, seed=3, uniform=T.lcg_uniform)
    return _shown(T.beam_search(_users(spark, d), T.Trie.from_codes(_codes(spark, d)), _scorer(spark, d), config))


def _interleaved(spark, d, temperature: float) -> DataFrame:
    """An item after each user's prompt and, for odd users, a period and an item again; logits differ between users."""
    first, start, end = 50_257, VOCABULARY.start, VOCABULARY.end
    codes = _codes(spark, d)
    seen = codes.select(F.posexplode("codes").alias("level", "code")).groupBy("level", "code").agg(F.count("*").alias("c"))
    table = seen.select("level", (first + F.col("level") * 256 + F.col("code")).cast("int").alias("token"), F.ln(F.col("c").cast("double") + 1).alias("base"), "code")
    last = F.col("last_token")
    level = F.when(last == start, F.lit(0)).when((last >= first) & (last < start), F.floor((last - first) / 256).cast("int") + 1)

    def score(rows: DataFrame) -> DataFrame:
        entry = lambda token, logit: F.struct(F.lit(token).alias("token"), logit.cast("double").alias("logit"))
        text = F.when(last == end, F.array(entry(50_256, F.lit(0.0)), entry(13, F.col("query_id") % 2 - 0.5))).otherwise(F.array(entry(start, F.lit(1.0)), entry(13, F.lit(0.5))))
        free = rows.filter(level.isNull()).select("query_id", "last_token", F.explode(text).alias("e")).select("query_id", "last_token", "e.token", "e.logit")
        item = rows.filter(level.isNotNull()).select("query_id", "last_token", level.alias("level")).join(F.broadcast(table), "level")  # levels x codes rows
        return free.unionByName(item.select("query_id", "last_token", "token", (F.col("base") + F.pmod(F.col("code") + F.col("query_id"), F.lit(7)) / 10).alias("logit")))

    prompts = _users(spark, d).select("query_id", F.pmod("query_id", F.lit(100)).cast("int").alias("last_token"))
    out = T.generate_interleaved(prompts, T.item_trie(codes, first, 3, 256), score, start, end, 3, 50_256, 12, temperature, 3)
    return out.select("query_id", _text("tokens").alias("tokens"))


def _interleaved_sql() -> str:
    sql, before = _TRIE + ", q AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS r), s AS (SELECT level, code, ln(count(*) + 1) AS base FROM (SELECT generate_subscripts(codes, 1) - 1 AS level, unnest(codes) AS code FROM c) GROUP BY level, code)", "(SELECT r, CAST([] AS INT[]) AS path, 0 AS node_id FROM q)"
    for i in range(3):
        sql += f", x{i} AS (SELECT b.r, list_append(b.path, {50_257 + 256 * i} + g.token) AS path, g.child_id AS node_id, row_number() OVER (PARTITION BY b.r ORDER BY s.base + ((g.token + b.r) % 7) / 10.0 DESC, g.token) AS rn FROM {before} b JOIN g ON g.node_id = b.node_id JOIN s ON s.level = {i} AND s.code = g.token), y{i} AS (SELECT r, path, node_id FROM x{i} WHERE rn = 1)"
        before = f"y{i}"
    return sql + ", z AS (SELECT r, '51025,' || array_to_string(path, ',') || ',51026' AS item FROM y2) SELECT user_id AS query_id, CASE WHEN user_id % 2 = 0 THEN item ELSE item || ',13,' || item || ',13' END AS tokens FROM (SELECT DISTINCT user_id FROM history WHERE user_id IS NOT NULL) JOIN z ON r = user_id % 7"


@_query(_interleaved_sql())
def generate_interleaved_greedy(spark, d):
    return _interleaved(spark, d, 0.0)


@_query()
def generate_interleaved_sampled(spark, d):
    return _interleaved(spark, d, 0.8)


@_query(_SCORE + ", x AS (SELECT g.node_id, g.token, s.base + (g.token % 7) / 10.0 AS logit, row_number() OVER (PARTITION BY g.node_id ORDER BY s.base + (g.token % 7) / 10.0 DESC, g.token) AS rank FROM g JOIN s ON s.level = g.depth AND s.token = g.token) SELECT node_id, token, round(logit, 6) AS logit, rank FROM x WHERE rank <= 5")
def constrained_topk(spark, d):
    """The five best children of every node."""
    trie, score = T.Trie.from_codes(_codes(spark, d)), _scorer(spark, d)
    parts = [score(trie.edges.filter(F.col("depth") == i), i) for i in range(3)]
    top = T.top_k(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["node_id"], 5)
    return top.select("node_id", "token", F.round("logit", 6).alias("logit"), "rank")


_SEEN = """WITH i AS (SELECT user_id, interaction_id, min({'ts': ts, 'item_id': item_id}) AS e FROM interactions WHERE user_id IS NOT NULL AND item_id >= 0 GROUP BY 1, 2),
 q AS (SELECT user_id, list(e.item_id ORDER BY e.ts, interaction_id) AS items, count(*) AS n FROM i GROUP BY user_id)
"""


@_query(
    _SEEN
    + """SELECT user_id, 'train' AS split, array_to_string(items[1:n-2], ',') AS items, items[n-1] AS item_fut FROM q WHERE n >= 3
UNION ALL SELECT user_id, s, array_to_string(list_resize(items[greatest(n-20, 1):n-1], 20, -1), ','), items[n] FROM q, (SELECT unnest(['eval', 'test']) AS s) WHERE n >= 3"""
)
def history_splits(spark, d):
    return S.leave_out_splits(S.user_sequences(_read(spark, d, "interactions"))).select("user_id", "split", _text("items").alias("items"), "item_fut")


@_query("SELECT user_id, split, array_to_string(x[greatest(len(x)-4, 1):], ',') AS last_items, len(x) AS n FROM (SELECT DISTINCT user_id, split, list_filter(items, lambda y: y >= 0) AS x FROM history WHERE items IS NOT NULL)")
def history_tail(spark, d):
    rows = _read(spark, d, "history").filter("items is not null").select("user_id", "split", strip_padding("items").alias("x")).distinct()
    return rows.select("user_id", "split", _text(tail("x", 5)).alias("last_items"), F.size("x").alias("n"))


@_query("SELECT p_partkey, coalesce(p_name, 'nan') || ' by ' || coalesce(p_brand, 'Unknown') || ' is categorized under ' || coalesce(p_type, '') || ' and is priced at ' || coalesce(CAST(p_size AS VARCHAR), 'nan') || '.' AS item_text FROM part")
def item_sentences(spark, d):
    return S.item_text(_read(spark, d, "part"), "p_name", "p_brand", "p_type", "p_size").select("p_partkey", "item_text")


@_query(f"WITH {_CODES} SELECT item_id, concat_ws(',', 50257 + codes[1], 50513 + codes[2], 50769 + codes[3]) AS token_ids, '<|item_start|><item_L0_C' || codes[1] || '><item_L1_C' || codes[2] || '><item_L2_C' || codes[3] || '><|item_end|>' AS sid FROM c")
def item_tokens(spark, d):
    return _codes(spark, d).select("item_id", _text(VOCABULARY.item_token_ids("codes")).alias("token_ids"), sid_string("codes").alias("sid"))


_CHARS = "list_transform(string_split({0}, ''), lambda x: unicode(x))"
_TEXTS = "it AS (SELECT c.item_id, any_value(c.codes) AS codes, min(i.item_text) AS item_text, '<|item_start|><item_L0_C' || any_value(c.codes[1]) || '><item_L1_C' || any_value(c.codes[2]) || '><item_L2_C' || any_value(c.codes[3]) || '><|item_end|>' AS sid FROM c JOIN catalog_items i USING (item_id) GROUP BY c.item_id)"


def _item_texts(spark, d) -> DataFrame:
    return _read(spark, d, "catalog_items").filter("item_id is not null").groupBy("item_id").agg(F.min("item_text").alias("item_text")).join(_codes(spark, d), "item_id")


@_query(f"WITH {_CODES}, {_TEXTS}, m AS (SELECT item_id, concat_ws(',', 50257 + codes[1], 50513 + codes[2], 50769 + codes[3], 51026) AS ids, array_to_string({_CHARS.format('item_text')}, ',') AS t FROM it WHERE item_text <> '') SELECT item_id, md5(t || ',51025,' || ids || ',' || ids || ',32,116,111,111') AS ids FROM m")
def encode_parts(spark, d):
    """A text part, two item parts and a text part of each item, texts as characters."""
    part = lambda kind, text, codes: F.struct(F.lit(kind).alias("type"), text.alias("text"), codes.alias("codes"))
    text, item = lambda t: part("text", t, F.lit(None).cast("array<int>")), part("item", F.lit(None).cast("string"), F.col("codes"))
    parts = F.array(text(F.col("item_text")), item, item, text(F.lit(" too")))
    rows = _item_texts(spark, d).filter("item_text <> ''").withColumn("parts", parts)
    return rows.select("item_id", F.md5(_text(S.encode_parts("parts", VOCABULARY, char_ids))).alias("ids"))


@_query(f"WITH {_CODES} SELECT item_id, unnest([1, 2, 3, 4]) AS run, unnest(['text', 'item', 'item', 'text']) AS kind, unnest([CAST(item_id % 100 AS VARCHAR) || ',7', concat_ws(',', 50257 + codes[1], 50513 + codes[2], 50769 + codes[3]), concat_ws(',', 50257 + codes[1], 50513 + codes[2]), '9']) AS tokens, unnest([NULL, array_to_string(codes, ','), codes[1] || ',' || codes[2], NULL]) AS codes FROM c")
def decode_items(spark, d):
    """Text, an item, an item that breaks off, and text again."""
    one = VOCABULARY.item_token_ids("codes")
    ids = F.concat(F.array(F.pmod("item_id", F.lit(100)).cast("int"), F.lit(7), F.lit(VOCABULARY.start)), one, F.array(F.lit(VOCABULARY.end)), F.slice(one, 1, 2), F.array(F.lit(9)))
    rows = _codes(spark, d).select("item_id", ids.alias("ids"))
    return S.decode_ids(rows, "ids", VOCABULARY, "item_id").select("item_id", "run", "kind", _text("tokens").alias("tokens"), _text("codes").alias("codes"))


@_query(f"""WITH {_CODES}, {_TEXTS}, two AS (SELECT item_id, 'description_to_sid' AS template, item_text AS prompt, sid AS answer FROM it WHERE item_text IS NOT NULL UNION ALL SELECT item_id, 'sid_to_description', sid, item_text FROM it WHERE item_text IS NOT NULL),
 x AS (SELECT item_id, template, '<|im_start|>system' || chr(10) || 'Recommend.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS p, answer || '<|im_end|>' || chr(10) AS a FROM two)
 SELECT item_id, template, md5(array_to_string({_CHARS.format('p || a')}, ',')) AS ids, md5(array_to_string(list_concat(list_resize(CAST([] AS INT[]), length(p), -100), {_CHARS.format('a')}), ',')) AS labels FROM x""")
def chat_samples(spark, d):
    """Both samples of every item as chats, texts as characters; labels ignore the prompt."""
    rows = S.chat_samples(S.item_samples(_item_texts(spark, d)), char_ids, system="Recommend.")
    return rows.select("item_id", "template", F.md5(_text("input_ids")).alias("ids"), F.md5(_text("labels")).alias("labels"))


_SAMPLES = "s AS (SELECT sample_id, split, ids, labels, max(len(ids)) OVER (PARTITION BY sample_id // 32) AS w FROM (SELECT DISTINCT sample_id, split, coalesce(input_ids, []) AS ids, labels FROM samples))"


def _padded_sql(labels: str, side: str = "right") -> str:
    """``labels``: the labels of ``ids`` before padding."""
    pad = (lambda a, v: f"list_concat({a}, list_resize(CAST([] AS INT[]), w - len(ids), {v}))") if side == "right" else (lambda a, v: f"list_concat(list_resize(CAST([] AS INT[]), w - len(ids), {v}), {a})")
    ones = "list_transform(ids, lambda x: 1)"
    return f"WITH {_SAMPLES} SELECT sample_id, split, " + ", ".join(f"md5(array_to_string({pad(a, v)}, ',')) AS {n}" for a, v, n in (("ids", 0, "padded_ids"), (ones, 0, "attention_mask"), (labels, -100, "padded_labels"))) + " FROM s"


_GIVEN = "list_resize(coalesce(labels, CAST([] AS INT[])), len(ids), -100)"


def _collated(spark, d, **options) -> DataFrame:
    empty = F.array().cast("array<int>")
    rows = _read(spark, d, "samples").select("sample_id", "split", F.coalesce("input_ids", empty).alias("input_ids"), "labels").distinct().withColumn("batch", F.floor(F.col("sample_id") / 32))
    return S.collate(rows, "batch", "input_ids", **options).select("sample_id", "split", *[F.md5(_text(c)).alias(c) for c in ("padded_ids", "attention_mask", "padded_labels")])


@_query(_padded_sql(_GIVEN, "left"))
def collate_samples(spark, d):
    """Batches of 32 padded on the left, with the labels as stored."""
    return _collated(spark, d, labels="labels", side="left")


@_query(_padded_sql(_GIVEN))
def collate_right(spark, d):
    return _collated(spark, d, labels="labels", side="right")


@_query(_padded_sql("list_transform(list_zip(ids, range(len(ids))), lambda z: CASE WHEN z[2] > 0 AND z[1] >= 50257 THEN z[1] ELSE -100 END)"))
def loss_mask_items(spark, d):
    """Labels on the tokens of items only."""
    return _collated(spark, d, loss_on="items", text_size=50_257)


@_query("SELECT template, count(*) AS n, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean, round(stddev_pop(l), 6) AS std, " + ", ".join(f"round(quantile_cont(l, {p / 100}), 6) AS p{p}" for p in M.PERCENTILES) + " FROM (SELECT template, len(input_ids) AS l FROM samples) WHERE l IS NOT NULL GROUP BY template")
def length_statistics(spark, d):
    rows = _read(spark, d, "samples").filter("input_ids is not null").select("template", F.size("input_ids").alias("l"))
    out = M.length_stats(rows, "l", ["template"])
    return out.select("template", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", *[f"p{p}" for p in M.PERCENTILES])])


@_query("SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN list_contains(list_filter(items, lambda x: x >= 0)[1:{c}], item_fut) THEN 1 ELSE 0 END), 9) AS recall_at_{c}" for c in (1, 5, 10)) + " FROM history WHERE split = 'test' AND items IS NOT NULL")
def history_recall(spark, d):
    """How often the future item is among the first items of the history itself."""
    rows = _read(spark, d, "history").filter("split = 'test' and items is not null").select(strip_padding("items").alias("pred"), "item_fut")
    out = M.recall_at(rows, "pred", "item_fut")
    return out.select("n", *[F.round(f"recall_at_{c}", 9).alias(f"recall_at_{c}") for c in (1, 5, 10)])


@_query("SELECT round(exp(sum(l * n) / sum(n)), 6) AS perplexity FROM (SELECT abs(sin(sample_id)) AS l, len(input_ids) AS n FROM samples WHERE input_ids IS NOT NULL)")
def sample_perplexity(spark, d):
    rows = _read(spark, d, "samples").filter("input_ids is not null").select(F.abs(F.sin("sample_id")).alias("loss"), F.size("input_ids").alias("n_tokens"))
    return M.perplexity(rows).select(F.round("perplexity", 6).alias("perplexity"))


@_query("SELECT p_partkey, p_retailprice <= (SELECT quantile_cont(p_retailprice, 0.8) FROM part) AS is_low FROM part")
def quantile_split(spark, d):
    return M.quantile_flag(_read(spark, d, "part"), "p_retailprice").select("p_partkey", "is_low")


@_query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 64 AS batch FROM part")
def ordered_batches(spark, d):
    return S.batch_ids(_read(spark, d, "part").select("p_partkey"), "p_partkey", 64)


@_query(f"""WITH {_CODES}, {_TEXTS}, h AS (SELECT DISTINCT user_id, split, list_filter(items, lambda x: x >= 0) AS x, item_fut FROM history WHERE item_fut >= 0),
 t AS (SELECT user_id, split, item_fut, x[greatest(len(x) - 19, 1):] AS x FROM h WHERE len(x) > 0), s AS (SELECT user_id, split, item_fut, generate_subscripts(x, 1) AS pos, unnest(x) AS item_id FROM t),
 l AS (SELECT user_id, split, item_fut, string_agg(sid, ', ' ORDER BY pos) AS sids, string_agg(coalesce(item_text, ''), ', ' ORDER BY pos) AS texts, string_agg(coalesce(item_text, '') || ' ' || sid, ', ' ORDER BY pos) AS mixed FROM s JOIN it USING (item_id) GROUP BY user_id, split, item_fut),
 f AS (SELECT l.*, it.sid AS fs, it.sid || ' ' || coalesce(it.item_text, '') AS fb FROM l JOIN it ON it.item_id = l.item_fut),
 u AS (SELECT 'user' AS src, user_id AS id, split, 'sid_sequence_to_sid' AS template, sids AS prompt, fs AS answer FROM f UNION ALL SELECT 'user', user_id, split, 'description_sequence_to_sid', texts, fs FROM f UNION ALL SELECT 'user', user_id, split, 'mixed_sequence_to_sid', mixed, fs FROM f
  UNION ALL SELECT 'user', user_id, split, 'description_sequence_to_sid_and_description', texts, fb FROM f UNION ALL SELECT 'user', user_id, split, 'sid_sequence_to_sid_and_description', sids, fb FROM f
  UNION ALL SELECT 'item', item_id, NULL, 'description_to_sid', item_text, sid FROM it WHERE item_text IS NOT NULL UNION ALL SELECT 'item', item_id, NULL, 'sid_to_description', sid, item_text FROM it WHERE item_text IS NOT NULL)
 SELECT src, id, split, template, md5(prompt) AS prompt, md5(answer) AS answer FROM u""")
def training_samples(spark, d):
    """Five samples a history and two an item."""
    items = _item_texts(spark, d)
    history = _read(spark, d, "history").dropDuplicates(["user_id", "split"])
    users = S.sequence_samples(history, items).select(F.lit("user").alias("src"), F.col("user_id").alias("id"), "split", "template", "prompt", "answer")
    both = users.unionByName(S.item_samples(items).select(F.lit("item").alias("src"), F.col("item_id").alias("id"), F.lit(None).cast("string").alias("split"), "template", "prompt", "answer"))
    return both.select("src", "id", "split", "template", F.md5("prompt").alias("prompt"), F.md5("answer").alias("answer"))
