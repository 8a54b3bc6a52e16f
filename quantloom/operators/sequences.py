"""Items, histories, token sequences and samples: assembly as array expressions and windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.vector import pad_right, sid_string, strip_padding, tail
from quantloom.session import distributed_rank, join_hot, stage

IGNORED = -100
#: Items of a history.
HISTORY = 20


@dataclass
class Vocabulary:
    """Text ids below ``text_size``, then the items' ids level by level, then the start and the end mark."""

    text_size: int
    levels: int
    codes: int

    @property
    def start(self) -> int:
        return self.text_size + self.levels * self.codes

    @property
    def end(self) -> int:
        return self.start + 1

    @property
    def size(self) -> int:
        return self.end + 1

    def item_token_ids(self, codes: Column | str) -> Column:
        return F.transform(codes, lambda c, i: (F.lit(self.text_size) + i * self.codes + c).cast("int"))

    def codes_of(self, tokens: Column | str) -> Column:
        return F.transform(tokens, lambda t, i: (t - self.text_size - i * self.codes).cast("int"))


def item_text(items: DataFrame, title: str, brand: str, category: str, price: str, out: str = "item_text") -> DataFrame:
    """The sentence of an item; a null brand reads Unknown, a null title or price reads nan, as in the source data."""
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    return items.withColumn(out, F.concat(text(title, "nan"), F.lit(" by "), text(brand, "Unknown"), F.lit(" is categorized under "), text(category, ""), F.lit(" and is priced at "), text(price, "nan"), F.lit(".")))


def train_flag(items: DataFrame, item: str, share: float = 0.95, seed: int = 42, out: str = "is_train") -> DataFrame:
    """A reproducible random share of the items."""
    return items.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), item), F.lit(10_000)) < int(share * 10_000))


def user_sequences(interactions: DataFrame) -> DataFrame:
    """(user_id, items): each user's valid items in order of ts; redelivered interactions count once.

    Positions come from a distributed rank, so the sort of one user is spread; the list itself is one
    value of one row, as the history format demands.
    """
    once = interactions.filter("user_id is not null and item_id >= 0").groupBy("user_id", "interaction_id").agg(F.min(F.struct("ts", "item_id")).alias("e")).select("user_id", "interaction_id", "e.ts", "e.item_id")
    ranked = distributed_rank(once, ["user_id"], ["ts", "interaction_id"], "pos")
    return ranked.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("items"))


def leave_out_splits(sequences: DataFrame, length: int = HISTORY) -> DataFrame:
    """(user_id, split, items, item_fut) from (user_id, items) lists of three items or more.

    train: all but the last two, the next one is the future item. eval and test: the last ``length``
    before the last item, padded with -1 on the right; the last item is the future one.
    """
    ok = sequences.filter(F.size("items") >= 3)
    n = F.size("items")
    train = F.struct(F.lit("train").alias("split"), F.slice("items", F.lit(1), n - 2).alias("items"), F.element_at("items", n - 1).alias("item_fut"))
    before = pad_right(tail(F.slice("items", F.lit(1), n - 1), length), length)
    late = [F.struct(F.lit(s).alias("split"), before.alias("items"), F.element_at("items", n).alias("item_fut")) for s in ("eval", "test")]
    return ok.select("user_id", F.explode(F.array(train, *late)).alias("s")).select("user_id", "s.*")


def clean_history(history: DataFrame, length: int = HISTORY) -> DataFrame:
    """Histories without fillers, cut to the last items; rows without a future item or history are left out."""
    return history.withColumn("items", tail(strip_padding("items"), length)).filter("item_fut >= 0 and size(items) > 0")


def encode_parts(parts: Column | str, v: Vocabulary, text_ids) -> Column:
    """Ids of a list of parts (type, text, codes); an item gets a start mark only behind text, and always an end mark.

    ``text_ids`` maps a text column to its ids.
    """
    p = F.col(parts) if isinstance(parts, str) else parts

    def one(part: Column, i: Column) -> Column:
        behind_text = F.get(p, i - 1)["type"] == "text"
        lead = F.when((i > 0) & behind_text, F.array(F.lit(v.start))).otherwise(F.array().cast("array<int>"))
        return F.when(part["type"] == "item", F.concat(lead, v.item_token_ids(part["codes"]), F.array(F.lit(v.end)))).otherwise(text_ids(part["text"]))

    return F.flatten(F.transform(p, one))


def decode_ids(df: DataFrame, ids: str, v: Vocabulary, key: str) -> DataFrame:
    """Runs of each id list: (key, run, kind, tokens, codes). Marks part runs; ``levels`` item ids make an item, fewer a partial one."""
    t = df.select(key, F.posexplode(ids).alias("pos", "t"))
    kind = F.when(F.col("t") < v.text_size, "text").when(F.col("t") < v.start, "item").otherwise("mark")
    w = Window.partitionBy(key).orderBy("pos")
    t = t.withColumn("kind", kind).withColumn("new", (F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))).cast("int")).withColumn("block", F.sum("new").over(w))
    inner = Window.partitionBy(key, "block").orderBy("pos")
    t = t.filter("kind <> 'mark'").withColumn("part", F.when(F.col("kind") == "item", F.floor((F.row_number().over(inner) - 1) / v.levels)).otherwise(0))
    runs = t.groupBy(key, "block", "part", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("tokens"), F.min("pos").alias("at"))
    codes = F.when(F.col("kind") == "item", F.transform("tokens", lambda x: ((x - v.text_size) % v.codes).cast("int")))
    return runs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("run"), "kind", "tokens", codes.alias("codes"))


def item_samples(items: DataFrame) -> DataFrame:
    """Two samples an item: its text asks for its codes and the other way round. Columns item_id, template, prompt, answer."""
    sid = sid_string("codes")
    both = F.array(F.struct(F.lit("description_to_sid").alias("template"), F.col("item_text").alias("prompt"), sid.alias("answer")), F.struct(F.lit("sid_to_description").alias("template"), sid.alias("prompt"), F.col("item_text").alias("answer")))
    return items.filter("codes is not null and item_text is not null").select("item_id", F.explode(both).alias("s")).select("item_id", "s.*")


def sequence_samples(history: DataFrame, items: DataFrame) -> DataFrame:
    """Five samples a history: (user_id, split, template, prompt, answer). ``items``: (item_id, item_text, codes), one row an item.

    Items without codes are skipped; a history without any, or whose future item has none, gives no sample.
    """
    known = items.filter("item_id is not null and codes is not null").select("item_id", F.coalesce("item_text", F.lit("")).alias("text"), sid_string("codes").alias("sid"))
    rows = clean_history(history)
    seen = join_hot(rows.select("user_id", "split", "item_fut", F.posexplode("items").alias("pos", "item_id")), known, "item_id", "user_id")
    lists = seen.groupBy("user_id", "split", "item_fut").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "sid"))).alias("h"))
    full = join_hot(lists, known.select(F.col("item_id").alias("item_fut"), F.col("text").alias("ft"), F.col("sid").alias("fs")), "item_fut", "user_id")
    join = lambda f: F.array_join(F.transform("h", f), ", ")
    sids, texts, mixed = join(lambda x: x["sid"]), join(lambda x: x["text"]), join(lambda x: F.concat(x["text"], F.lit(" "), x["sid"]))
    both = F.concat("fs", F.lit(" "), "ft")
    kinds = [("sid_sequence_to_sid", sids, F.col("fs")), ("description_sequence_to_sid", texts, F.col("fs")), ("mixed_sequence_to_sid", mixed, F.col("fs")), ("description_sequence_to_sid_and_description", texts, both), ("sid_sequence_to_sid_and_description", sids, both)]
    five = F.array(*[F.struct(F.lit(n).alias("template"), p.alias("prompt"), a.alias("answer")) for n, p, a in kinds])
    return full.select("user_id", "split", F.explode(five).alias("s")).select("user_id", "split", "s.*")


def chat_text(role: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def chat_prompt(user: Column | str, system: str | None = None) -> Column:
    """System and user message, then the opening of the assistant's answer; a null user text gives null."""
    user = F.col(user) if isinstance(user, str) else user
    lead = [chat_text(F.lit("system"), F.lit(system))] if system is not None else []
    return F.concat(*lead, chat_text(F.lit("user"), user), F.lit("<|im_start|>assistant\n"))


def chat_samples(df: DataFrame, text_ids, system: str | None = None, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Add ``input_ids`` and ``labels`` of a chat of one turn: the prompt's ids are ignored, the answer's count.

    ``text_ids`` maps a text column to its ids. Rows without a prompt or an answer get nulls. The answer ends with the end mark of its turn.
    """
    asked, told = text_ids(chat_prompt(prompt, system)), text_ids(F.concat(F.col(answer), F.lit("<|im_end|>\n")))
    rows = df.withColumn("_p", asked).withColumn("_a", told)
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size("_p")), "_a")
    there = F.col(prompt).isNotNull() & F.col(answer).isNotNull()
    return rows.withColumn("input_ids", F.when(there, F.concat("_p", "_a"))).withColumn("labels", F.when(there, labels)).drop("_p", "_a")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default, out: str | None = None) -> DataFrame:
    """``value`` of the row of ``table`` (one a key) for each row, ``default`` where there is none."""
    known = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"))
    return df.join(known, F.col(key) == F.col("_k"), "left").withColumn(out or value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, all if there are fewer: those first in a seeded order of a whole-number key. No more than n rows of each task are compared."""
    mixed = F.pmod((F.col(key).cast("long") % 2_147_483_647) * 48_271 + F.lit(seed * 7_919), F.lit(2_147_483_647))
    return df.orderBy(mixed, key).limit(n)


def batch_ids(df: DataFrame, key: str, size: int, seed: int | None = None, out: str = "batch") -> DataFrame:
    """Consecutive batches in order of the key, or in a seeded random order; numbered without one global sort task."""
    order = F.xxhash64(F.lit(seed), key) if seed is not None else F.lit(0).cast("long")
    rows = df.withColumn("_all", F.lit(0)).withColumn("_o", order)
    ranked = distributed_rank(rows, ["_all"], ["_o", key], "_r")
    return ranked.withColumn(out, F.floor(F.col("_r") / size)).drop("_all", "_o", "_r")


def collate(df: DataFrame, batch: str, ids: str, labels: str | None = None, side: str = "right", pad_id: int = 0, max_length: int | None = None, loss_on: str = "all", text_size: int | None = None) -> DataFrame:
    """Pad each batch to its longest list: adds input_ids, attention_mask and labels.

    Without given labels they follow ``loss_on`` (all, items or text; an item id is >= ``text_size``)
    and the first token is ignored. Padding is ignored always. Given labels shorter than their ids are
    filled up with ignored ones. Null lists count as empty.
    """
    from quantloom.functions.vector import pad_left

    cut = lambda a: F.slice(a, 1, max_length) if max_length else a
    long = lambda c: F.coalesce(F.col(c).cast("array<long>"), F.array().cast("array<long>"))
    rows = df.withColumn("_ids", cut(long(ids)))
    if labels:
        rows = rows.withColumn("_labels", F.slice(pad_right(cut(long(labels)), F.size("_ids"), IGNORED), F.lit(1), F.size("_ids")))
    else:
        keep = {"all": lambda x: F.lit(True), "items": lambda x: x >= text_size, "text": lambda x: x < text_size}[loss_on]
        rows = rows.withColumn("_labels", F.transform("_ids", lambda x, i: F.when((i > 0) & keep(x), x).otherwise(F.lit(IGNORED).cast("long"))))
    widest = rows.groupBy(batch).agg(F.max(F.size("_ids")).alias("_w"))
    rows = rows.join(widest, batch)
    pad = pad_right if side == "right" else pad_left
    mask = pad(F.transform("_ids", lambda x: F.lit(1).cast("long")), "_w", 0)
    return rows.select(*df.columns, pad("_ids", "_w", pad_id).alias("padded_ids"), mask.alias("attention_mask"), pad("_labels", "_w", IGNORED).alias("padded_labels"))


def first_contained(prompts: DataFrame, items: DataFrame, prompt: str = "prompt", text: str = "item_text") -> DataFrame:
    """Prompts with the smallest item whose trimmed text they contain, null if none does.

    Candidates are found by an equi-join, so no theta join is needed: a prompt that contains a text has all
    inner words of the text as words, and the rarest of them (over all texts) is the key. Texts without an
    inner word are keyed by their first letters, up to three, which prompts have as n-grams. Of items with
    one text only the smallest is looked up. Null and blank texts match nothing; null prompts stay with null.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = items.filter("item_id is not null").select("item_id", F.trim(text).alias("_t")).filter("_t <> ''").groupBy("_t").agg(F.min("item_id").alias("item_id")).withColumn("_w", words("_t"))
    inner = F.array_distinct(F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 2, F.lit(0))))
    listed = stage(known.select("item_id", "_t", F.explode_outer(inner).alias("_k")))
    common = listed.filter("_k is not null").groupBy("_k").agg(F.count("*").alias("_n"))
    keyed = listed.join(common, "_k").groupBy("item_id", "_t").agg(F.min(F.struct("_n", "_k")).alias("b")).select("item_id", "_t", F.col("b._k").alias("_k"))
    asked = prompts
    texts = asked.filter(F.col(prompt).isNotNull()).select(F.col(prompt).alias("_p")).distinct()
    by_word = texts.select("_p", F.explode(F.array_distinct(words("_p"))).alias("_k")).join(keyed, "_k")
    short = listed.filter("_k is null").select("item_id", "_t", F.substring("_t", 1, 3).alias("_k"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_p") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_p"), i, F.lit(n)))
    by_gram = texts.select("_p", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("_k")).join(short, "_k") if not short.isEmpty() else None
    hits = by_word.select("_p", "_t", "item_id")
    hits = hits.unionByName(by_gram.select("_p", "_t", "item_id")) if by_gram is not None else hits
    best = hits.filter(F.contains("_p", "_t")).groupBy("_p").agg(F.min("item_id").alias("item_id"))
    return asked.join(best, F.col(prompt) == F.col("_p"), "left").drop("_p")
