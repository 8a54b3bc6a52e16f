"""The catalogue of valid code tuples as a relational prefix trie, and constrained decoding over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.vector import gumbel, hash_uniform
from quantloom.session import BROADCAST_BYTES, broadcast_if_small, distributed_rank, stage


@dataclass
class Trie:
    """``nodes(node_id, depth, prefix, n_children, first_child)`` and ``edges(node_id, depth, token, child_id)``.

    Node 0 is the root; the others are numbered from 1, depth by depth, in the order of their
    prefixes. ``depth`` of an edge is that of its parent. Null and empty tuples and tuples with
    nulls are left out; repeated tuples count once. ``first_child`` is null for leaves. ``row_ptrs``
    and ``edges`` in order of ``child_id`` are the compressed rows of the trie as tables.
    """

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_codes(cls, codes: DataFrame, column: str = "codes") -> Trie:
        valid = codes.select(F.col(column).cast("array<int>").alias("c")).filter((F.size("c") > 0) & F.forall("c", lambda x: x.isNotNull())).distinct()
        prefixes = valid.select("c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("depth")).select("depth", F.slice("c", F.lit(1), F.col("depth")).alias("prefix")).distinct()
        ranked = distributed_rank(prefixes, ["depth"], ["prefix"], "r")
        per_depth = ranked.groupBy("depth").agg(F.count("*").alias("n"))
        offsets = per_depth.select("depth", F.coalesce(F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))  # one row a level
        numbered = stage(ranked.join(F.broadcast(offsets), "depth").select((F.col("r") + F.col("o") + 1).alias("node_id"), "depth", "prefix"))
        root = codes.sparkSession.createDataFrame([(0, 0, [])], "node_id long, depth int, prefix array<int>")
        all_ = root.unionByName(numbered)
        parent = all_.select(F.col("node_id").alias("parent_id"), F.col("prefix").alias("parent_prefix"))
        edges = stage(
            numbered.withColumn("parent_prefix", F.slice("prefix", F.lit(1), F.col("depth") - 1)).join(parent, "parent_prefix").select(F.col("parent_id").alias("node_id"), (F.col("depth") - 1).alias("depth"), F.try_element_at("prefix", F.lit(-1)).alias("token"), F.col("node_id").alias("child_id"))
        )
        children = edges.groupBy("node_id").agg(F.count("*").alias("n_children"), F.min("child_id").alias("first_child"))
        # Children are numbered in order of their parents, so an inner node's row begins at its first child.
        nodes = all_.join(children, "node_id", "left").select("node_id", "depth", "prefix", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child")
        return cls(nodes, edges)

    def layer_max_branches(self) -> DataFrame:
        return self.nodes.groupBy("depth").agg(F.max("n_children").alias("max_branches"))

    def find_prefix(self, prefixes: DataFrame, column: str = "prefix") -> DataFrame:
        """Rows of ``prefixes`` with the node they lead to, null if there is none."""
        known = self.nodes.select(F.col("prefix").alias("_p"), "node_id")
        return prefixes.join(known, F.col(column).cast("array<int>") == F.col("_p"), "left").drop("_p")

    def prefixes(self, depth: int) -> DataFrame:
        """(prefix, node_id) of one depth: the states behind ``depth`` tokens, in the order of their prefixes."""
        return self.nodes.filter(F.col("depth") == depth).select("prefix", "node_id")

    def allowed(self, depth: int) -> DataFrame:
        """(prefix, token): which tokens may follow the prefixes of a depth; the dense mask without its empty places."""
        return self.nodes.filter(F.col("depth") == depth + 1).select(F.slice("prefix", F.lit(1), F.lit(depth)).alias("prefix"), F.try_element_at("prefix", F.lit(-1)).alias("token"))

    def row_ptrs(self) -> DataFrame:
        """(node_id, row_ptr): edges of all nodes before each node, up to the last inner node; from distributed ranks.

        Children are numbered in the order of their parents, so the first edge of an inner node is the
        one before its first child; a leaf takes the pointer of the next inner node, the edges' number if there is none.
        """
        edges = self.edges.agg(F.count("*").alias("m"))
        inner = self.nodes.select("node_id", (F.col("first_child") - 1).alias("p"))
        n = int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = stage(inner.repartitionByRange(n, "node_id").withColumn("_r", F.spark_partition_id()))
        after = Window.partitionBy("_r").orderBy("node_id").rowsBetween(0, Window.unboundedFollowing)
        later = ranged.groupBy("_r").agg(F.min("p").alias("q")).select("_r", F.min("q").over(Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing)).alias("q"))  # one row a range
        filled = ranged.withColumn("p", F.min("p").over(after)).join(F.broadcast(later), "_r").crossJoin(F.broadcast(edges))
        return filled.select("node_id", F.coalesce("p", "q", "m").alias("row_ptr"))

    def csr(self) -> tuple[list[int], list[int], list[int]]:
        """(row_ptrs, cols, vals) with -1 behind the last edge; collects, so for small catalogues and tests."""
        edges = [(r.token, r.child_id) for r in self.edges.orderBy("child_id").collect()]
        ptrs = [r.row_ptr for r in self.row_ptrs().orderBy("node_id").collect()]
        return ptrs, [*[e[0] for e in edges], -1], [*[e[1] for e in edges], -1]


def reverse_index(codes: DataFrame, column: str = "codes", item: str = "item_id") -> DataFrame:
    """(codes, item_id, n_items): the smallest item of each code tuple."""
    return codes.filter(F.col(column).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(column).alias("codes")).agg(F.min(item).alias("item_id"), F.countDistinct(item).alias("n_items"))


def item_trie(codes: DataFrame, first_id: int, levels: int, codes_per_level: int, column: str = "codes") -> Trie:
    """A trie over token ids: level l, code c has the id first_id + l * codes_per_level + c."""
    tokens = F.transform(column, lambda c, i: (F.lit(first_id) + i * codes_per_level + c).cast("int"))
    return Trie.from_codes(codes.filter(F.size(column) == levels).select(tokens.alias("tokens")), "tokens")


def mask(beams: DataFrame, trie: Trie, logits: DataFrame) -> DataFrame:
    """Logits of the children of each beam's node; other tokens have no row.

    ``beams``: any columns with ``node_id``; ``logits``: (keys shared with beams, token, logit).
    """
    keys = [c for c in logits.columns if c in beams.columns]
    edges = trie.edges.select("node_id", "token", "child_id")
    return beams.join(edges, "node_id").join(logits, [*keys, "token"])


def linear(beams: DataFrame, trie: Trie, weights: DataFrame, hidden: str = "h") -> DataFrame:
    """Logits h . w (+ bias) computed for the children of each beam only. ``weights``: (token, w[, bias])."""
    from quantloom.functions.vector import dot

    bias = F.coalesce("bias", F.lit(0.0)) if "bias" in weights.columns else F.lit(0.0)
    joined = beams.join(trie.edges.select("node_id", "token", "child_id"), "node_id").join(weights, "token")
    return joined.withColumn("logit", dot(hidden, "w") + bias).drop("w", "bias")


def padded_children(masked: DataFrame, by: list[str], width: int) -> DataFrame:
    """One row for each group of ``masked``: ``tokens`` and ``next_nodes`` of its children in order of tokens, filled up with -1 to ``width``."""
    rows = masked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("token", "child_id"))).alias("_c"))
    fill = lambda name, kind: F.concat(F.transform("_c", lambda c: c[name]), F.array_repeat(F.lit(-1).cast(kind), F.greatest(F.lit(width) - F.size("_c"), F.lit(0))))
    return rows.select(*by, fill("token", "int").alias("tokens"), fill("child_id", "long").alias("next_nodes"))


def _ranked(by: list[str], score: str, ties: tuple[str, ...] = ("token",)):
    """One ordering for the rank and for sums over all rows of a group, so that one sort serves both."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return w, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def log_softmax(df: DataFrame, by: list[str], logit: str = "logit", out: str = "log_prob") -> DataFrame:
    _, all_ = _ranked(by, logit)
    return df.withColumn("_z", F.col(logit) - F.max(logit).over(all_)).withColumn(out, F.col("_z") - F.ln(F.sum(F.exp("_z")).over(all_))).drop("_z")


def top_k(df: DataFrame, by: list[str], k: int, score: str = "logit", ties: tuple[str, ...] = ("token",)) -> DataFrame:
    """The k best rows of each group; ties go to the smaller token."""
    return df.withColumn("rank", F.row_number().over(_ranked(by, score, ties)[0])).filter(F.col("rank") <= k)


def lcg_uniform(seed: int, *parts) -> Column:
    """A reproducible number in (0, 1) from whole numbers, by plain arithmetic that any engine repeats."""
    total = F.lit(seed * 7_919)
    for part, factor in zip(parts, (104_729, 1_299_709, 15_485_863, 32_452_843)):
        total = total + F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit(0)).cast("long") * factor
    h = F.array(F.pmod(total, F.lit(1_000_003)))
    for _ in range(3):  # squares, so that neighbouring numbers do not stay neighbours
        h = F.transform(h, lambda x: F.pmod(x * x * 31 + x * 17 + 7, F.lit(1_000_003)))
    return (F.get(h, F.lit(0)).cast("double") + 0.5) / 1_000_003


def sample(df: DataFrame, by: list[str], k: int, temperature: float, seed: int, logit: str = "logit", uniform=hash_uniform) -> DataFrame:
    """k draws without replacement from softmax(logit / temperature), by seeded Gumbel noise. ``uniform(seed, *columns)`` gives the noise's source."""
    noise = gumbel(uniform(seed, *by, "token"))
    return top_k(df.withColumn("_g", F.col(logit) / temperature + noise), by, k, "_g").drop("_g")


STRATEGIES = ("default", "sample", "topk")


@dataclass
class GenerationConfig:
    """``strategy``: default (greedy, or draws without replacement if ``temperature`` is over 0), sample (one
    draw a step, reported with a log-probability of 0; needs k = beam_size = 1) or topk (greedy, normalised
    over the kept tokens only, whatever the temperature). ``uniform`` is the source of random numbers."""

    steps: int
    k: int = 1
    beam_size: int = 1
    temperature: float = 0.0
    strategy: str = "default"
    seed: int = 0
    uniform: Callable = hash_uniform

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy {self.strategy!r} is none of {STRATEGIES}")
        if self.strategy == "sample" and (self.k, self.beam_size) != (1, 1):
            raise ValueError("strategy sample needs k = beam_size = 1")


def beam_search(queries: DataFrame, trie: Trie, scorer, config: GenerationConfig) -> DataFrame:
    """(query_id, rank, tokens, node_id, log_prob) of the best ``k`` paths of ``steps`` tokens from the root.

    ``scorer(candidates, step)`` gets the candidate rows (query_id, beam_id, tokens, node_id, token,
    child_id) and adds ``logit``. All queries advance at once; fewer than k rows come out where the
    trie has fewer paths. Rows stay partitioned by query while the levels of the trie are small enough to
    be broadcast, so a step is one sort and no shuffle.
    """
    beams = queries.select("query_id").distinct().select("query_id", F.lit(1).alias("beam_id"), F.array().cast("array<int>").alias("tokens"), F.lit(0).cast("long").alias("node_id"), F.lit(0.0).alias("log_prob"))
    rows = {r.depth: r["count"] for r in trie.edges.groupBy("depth").count().collect()}  # one row a level
    by = ["query_id", "beam_id"]
    for step in range(config.steps):
        # Near the root few nodes are shared by all beams; those levels are small and go to the beams instead.
        edges = broadcast_if_small(trie.edges.filter(F.col("depth") == step).select("node_id", "token", "child_id"), rows.get(step, 0), 32)
        scored = scorer(beams.join(edges, "node_id"), step)
        drawn = config.temperature > 0 and config.strategy != "topk"
        if drawn or config.strategy == "sample":
            warm = config.temperature if config.temperature > 0 else 1.0
            noise = gumbel(config.uniform(config.seed + step, *by, "token"))
            scored = scored.withColumn("logit", F.col("logit") / warm).withColumn("_order", F.col("logit") + noise)
        else:
            scored = scored.withColumn("_order", F.col("logit"))
        w, all_ = _ranked(by, "_order")
        if config.strategy == "topk":
            scored = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= config.beam_size)
        shifted = scored.withColumn("_r", F.row_number().over(w)).withColumn("_z", F.col("logit") - F.max("logit").over(all_))
        kept = shifted.withColumn("lp", F.col("_z") - F.ln(F.sum(F.exp("_z")).over(all_))).filter(F.col("_r") <= config.beam_size)
        gained = F.lit(0.0) if config.strategy == "sample" else F.col("lp")
        moved = kept.select("query_id", F.concat("tokens", F.array("token")).alias("tokens"), F.col("child_id").alias("node_id"), (F.col("log_prob") + gained).alias("log_prob"))
        best = Window.partitionBy("query_id").orderBy(F.desc("log_prob"), "tokens")
        beams = moved.withColumn("beam_id", F.row_number().over(best)).filter(F.col("beam_id") <= config.k)
        if step % 4 == 3:
            beams = stage(beams)
    return beams.select("query_id", F.col("beam_id").alias("rank"), "tokens", "node_id", "log_prob")


def with_items(beams: DataFrame, index: DataFrame, codes: str = "codes", default: int = -1) -> DataFrame:
    """Generated code tuples with their item (``index`` as of ``reverse_index``), ``default`` if no item has the tuple."""
    known = index.select(F.col("codes").alias("_c"), F.col("item_id").alias("item_id"))
    return beams.join(known, F.col(codes) == F.col("_c"), "left").drop("_c").withColumn("item_id", F.coalesce("item_id", F.lit(default).cast("long")))


def retrieve(queries: DataFrame, trie: Trie, scorer, index: DataFrame, config: GenerationConfig, first_id: int | None = None, codes_per_level: int = 0) -> DataFrame:
    """(query_id, pred): the items of each query's beams, best first; -1 where no item has the tuple.

    With ``first_id`` the trie holds token ids (see ``item_trie``), which become codes again.
    """
    beams = beam_search(queries, trie, scorer, config)
    if first_id is not None:
        beams = beams.withColumn("tokens", F.transform("tokens", lambda t: ((t - first_id) % codes_per_level).cast("int")))
    rows = with_items(beams, index, "tokens")
    return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("pred"))  # config.k rows a query


def generate_interleaved(prompts: DataFrame, trie: Trie, scorer, start_id: int, end_id: int, levels: int, eos_id: int, max_new: int, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """Generation of text and items: free tokens until ``start_id``, then ``levels`` tokens of the trie and ``end_id``.

    ``prompts``: (query_id, last_token). ``scorer(rows)`` gets (query_id, last_token, tokens) rows, inside
    items too, and gives (query_id, last_token, token, logit). Each step takes the token of the best
    logit, inside an item among the children of the state's node only, or with a ``temperature`` over 0
    a seeded draw from their softmax. Ties go to the smaller token; a child without a logit comes after
    all that have one. A state machine over all prompts at once, staged at every step.
    Output: (query_id, tokens) without the prompt and the final ``eos_id``.
    """
    state = prompts.select("query_id", "last_token", F.array().cast("array<int>").alias("tokens"), F.lit(0).alias("inside"), F.lit(0).cast("long").alias("node_id"), F.lit(False).alias("done"))
    # The upper levels are shared by all states; as many as are small go to the states.
    rows = {r.depth: r["count"] for r in trie.edges.groupBy("depth").count().collect()}  # one row a level
    small = 0
    while small in rows and sum(rows[i] for i in range(small + 1)) * 32 <= BROADCAST_BYTES:
        small += 1
    edges = trie.edges.select("node_id", "depth", F.col("token").alias("t"), "child_id")

    def children(states: DataFrame) -> DataFrame:
        """(query_id, t, child_id) below the node of each state."""
        upper = states.filter(F.col("inside") <= small).join(F.broadcast(edges.filter(F.col("depth") < small)), "node_id")
        out = upper.select("query_id", "t", "child_id")
        if any(k >= small for k in rows):
            lower = states.filter(F.col("inside") > small).join(edges.filter(F.col("depth") >= small), "node_id")
            out = out.unionByName(lower.select("query_id", "t", "child_id"))
        return out

    for step in range(max_new):
        score = F.col("logit").cast("double")
        if temperature > 0:
            score = score / temperature + gumbel(hash_uniform(seed, F.lit(step), "query_id", "token"))
        asked = ["query_id", "last_token", "tokens"]
        free = scorer(state.filter("inside = 0 and not done").select(*asked)).withColumn("s", score)
        free = free.groupBy("query_id").agg(F.max(F.struct("s", (-F.col("token")).alias("m"))).alias("b")).select("query_id", (-F.col("b.m")).alias("free"))
        within = state.filter((F.col("inside") >= 1) & (F.col("inside") <= levels) & ~F.col("done"))
        scored = scorer(within.select(*asked)).select("query_id", F.col("token").alias("t"), score.alias("s"))
        item = children(within).join(scored, ["query_id", "t"], "left").withColumn("s", F.coalesce("s", F.lit(float("-inf"))))
        item = item.groupBy("query_id").agg(F.max(F.struct("s", (-F.col("t")).alias("m"), "child_id")).alias("e")).select("query_id", (-F.col("e.m")).alias("t"), F.col("e.child_id").alias("child_id"))
        joined = state.join(free, "query_id", "left").join(item, "query_id", "left")
        inside = F.col("inside")
        token = F.when(inside == 0, F.coalesce("free", F.lit(eos_id))).when(inside <= levels, F.coalesce("t", F.lit(end_id))).otherwise(F.lit(end_id))
        moved = joined.withColumn("token", F.when(~F.col("done"), token).cast("int"))
        ends = F.col("done") | (F.col("token") == eos_id)
        # Each step reads the state several times, so it is written once a step.
        state = stage(moved.select(
            "query_id",
            F.coalesce("token", "last_token").alias("last_token"),
            F.when(ends, F.col("tokens")).otherwise(F.concat("tokens", F.array("token"))).alias("tokens"),
            F.when(ends, F.lit(0)).when((inside == 0) & (F.col("token") == start_id), F.lit(1)).when(inside == 0, F.lit(0)).when(inside > levels, F.lit(0)).otherwise(inside + 1).alias("inside"),
            F.when((inside >= 1) & (inside <= levels), F.coalesce("child_id", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("node_id"),
            ends.alias("done"),
        ))
    return state.select("query_id", "tokens")


def generate(prompts: DataFrame, scorer, trie: Trie | None = None, config: GenerationConfig | None = None, eos_id: int | None = None, max_new: int = 0) -> DataFrame:
    """With a trie the beams of ``beam_search``, which needs a config; without one free generation.

    Free generation takes (query_id, last_token) prompts and gives (query_id, tokens): each step the token of
    the best logit of ``scorer`` (ties: the smaller), or a draw if the config has a temperature, until
    ``eos_id``, ``max_new`` tokens or a state that the scorer knows nothing for.
    """
    if trie is not None:
        if config is None:
            raise ValueError("constrained generation needs a config")
        return beam_search(prompts, trie, scorer, config)
    warm, seed = (config.temperature, config.seed) if config else (0.0, 0)
    state = prompts.select("query_id", "last_token", F.array().cast("array<int>").alias("tokens"), F.lit(False).alias("done"))
    for step in range(max_new):
        asked = scorer(state.filter("not done").select("query_id", "last_token", "tokens"))
        score = F.col("logit").cast("double")
        if warm > 0:
            score = score / warm + gumbel(hash_uniform(seed, F.lit(step), "query_id", "token"))
        best = asked.groupBy("query_id").agg(F.max(F.struct(score.alias("s"), (-F.col("token")).alias("m"))).alias("b")).select("query_id", (-F.col("b.m")).cast("int").alias("token"))
        ends = F.col("done") | F.col("token").isNull() | (F.col("token") == F.lit(eos_id))
        ends = F.coalesce(ends, F.lit(False))
        moved = state.join(best, "query_id", "left")
        state = stage(moved.select("query_id", F.when(ends, F.col("last_token")).otherwise(F.col("token")).alias("last_token"), F.when(ends, F.col("tokens")).otherwise(F.concat("tokens", F.array("token"))).alias("tokens"), ends.alias("done")))
    return state.select("query_id", "tokens")
