"""Encoding of whole documents with a public byte-level BPE vocabulary.

Texts up to ``chunk_chars`` are encoded where they lie. Longer texts are cut into chunks that are
encoded in parallel; a cut before white space is always a boundary of the tokenizer's own splitting,
so those chunks just follow each other. Text without such a place (scripts without spaces, encoded
images, one repeated letter) is cut anywhere and joined by tree concatenation: neighbouring halves
are merged pairwise, a growing window around each join is encoded again, and its ids replace the
old ones as soon as the window agrees with both sides.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the public vocabularies; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk of a long document.
CHUNK_CHARS = 16_384
#: Output rows of an Arrow batch.
BATCH_ROWS = 512
#: Words whose ids a worker remembers, and their longest length.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Copies of a long text that one task joins with its ids, and the most tasks for the copies of one text.
COPIES, MOST_SALTS = 64, 256
#: The longest stretch of bytes that is simply encoded again at a join.
DIRECT_BYTES = 2_048

#: The same splitting in terms of Python's own engine, for texts in which every character is of a class both see alike.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?(?:[^\W\d_]+|\d+|[^\w\s]+(?:_+[^\w\s]*)*|_+(?:[^\w\s]+_*)*)|\s+(?!\S)|\s+")
_LETTER, _DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")
_SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")
_WHITE = frozenset("\t\n\x0b\x0c\r\x85")


class Encoder:
    """Exact ids of a rank file, with a memory of frequent words. One per worker and vocabulary."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = {rank: word for word, rank in ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self._known: dict[str, bytes] = _Words(self.piece)
        self._plain: set[str] = set()
        self._odd: set[str] = set()

    def piece(self, word: str | bytes) -> np.ndarray:
        """Ids of one word of the splitting."""
        return np.array(self.bpe._encode_single_piece(word), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        if self._fast(text):
            return np.frombuffer(b"".join(map(self._known.__getitem__, _FAST.findall(text))), dtype=np.int32)
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def _fast(self, text: str) -> bool:
        new = set(text) - self._plain
        if not new:
            return True
        if new & self._odd:
            return False
        for c in new:
            (self._plain if _alike(c) else self._odd).add(c)
        return not new & self._odd


class _Words(dict):
    def __init__(self, piece) -> None:
        super().__init__()
        self._piece = piece

    def __missing__(self, word: str) -> bytes:
        ids = self._piece(word).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _alike(c: str) -> bool:
    """Whether Python's engine puts a character into the class that the public pattern puts it into."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Cs", "Nl", "No"):
        return False
    space = kind[0] == "Z" or c in _WHITE
    return bool(_LETTER.match(c)) == (kind[0] == "L") and bool(_DIGIT.match(c)) == (kind == "Nd") and c.isspace() == space and (kind[0] in "LN" or c == "_" or not (c.isalnum()))


@lru_cache(maxsize=4)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


class Segment:
    """The exact encoding of ``text[start:end]`` taken alone, with what a join needs to know of its ends."""

    __slots__ = ("end", "head_end", "head_ids", "ids", "last", "last_ids", "start", "tail", "tail_ids")

    def __init__(self, start: int, end: int, ids: np.ndarray, head: tuple[int, int], tail: tuple[int, int], last: tuple[int, int]) -> None:
        self.start, self.end, self.ids = start, end, ids
        self.head_end, self.head_ids = head  # where the first word ends; its ids
        self.tail, self.tail_ids = tail  # where scanning must begin again if text follows; ids before it
        self.last, self.last_ids = last  # where the last word begins; ids before it


def _words(enc: Encoder, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in enc.pattern.finditer(text, start, end))


def leaf(enc: Encoder, text: str, start: int, end: int, ids: np.ndarray | None = None) -> Segment:
    """The segment of one chunk; a word can change by what follows only if it ends less than 3 characters before the end."""
    if ids is None:
        ids = enc.encode(text[start:end])
    spans = list(_words(enc, text, start, end))
    tail = next(i for i, (_, e) in enumerate(spans) if e > end - 3)
    count = lambda a, b: len(enc.encode(text[a:b])) if b > a else 0
    tail_len, last_len = count(spans[tail][0], end) if tail else len(ids), count(spans[-1][0], end) if len(spans) > 1 else len(ids)
    head_len = count(*spans[0]) if len(spans) > 1 else len(ids)
    return Segment(start, end, ids, (spans[0][1], head_len), (spans[tail][0], len(ids) - tail_len), (spans[-1][0], len(ids) - last_len))


def _join_word(enc: Encoder, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of one long word from the ids of its halves: a window around the join grows until its first and last two ids are those of the halves."""
    width = 8
    while True:
        wa, wb = min(width, len(a)), min(width, len(b))
        window = enc.piece(b"".join(enc.words[i] for i in [*a[len(a) - wa :].tolist(), *b[:wb].tolist()]))
        left = wa == len(a) or (len(window) > 4 and np.array_equal(window[:2], a[len(a) - wa :][:2]))
        right = wb == len(b) or (len(window) > 4 and np.array_equal(window[-2:], b[:wb][-2:]))
        if left and right:
            return np.concatenate([a[: len(a) - wa], window, b[wb:]])
        width *= 2


def join(enc: Encoder, text: str, a: Segment, b: Segment) -> Segment:
    """The encoding of two neighbouring segments as one."""
    scan, known = _words(enc, text, a.tail, b.end), _words(enc, text, b.start, b.end)
    words: list[tuple[int, int]] = []
    old: list[tuple[int, int]] = []
    at = b.start
    for s, e in scan:
        if s >= b.start and s == at:
            break
        words.append((s, e))
        while at < e:
            old.append(next(known))
            at = old[-1][1]
    sync = words[-1][1] if words else b.start
    skipped = 0
    parts: list[np.ndarray] = []
    for s, e in old:
        skipped += b.head_ids if s == b.start else len(enc.piece(text[s:e]))
    for s, e in words:
        if s < b.start < e and s == a.last and e == b.head_end and len(text[s:e].encode()) > DIRECT_BYTES:
            parts.append(_join_word(enc, a.ids[a.last_ids :], b.ids[: b.head_ids]))
        else:
            parts.append(enc.piece(text[s:e]))
    ids = np.concatenate([a.ids[: a.tail_ids], *parts, b.ids[skipped:]])
    shift = len(ids) - len(b.ids)
    if sync < b.end:  # the ends of b as b knows them, if they lie behind the place of agreement
        tail = (b.tail, b.tail_ids + shift) if b.tail >= sync and not any(e > b.end - 3 for _, e in words) else None
        last = (b.last, b.last_ids + shift) if b.last >= sync else None
    else:
        tail = last = None
    if tail is None or last is None:
        starts, before = [], a.tail_ids
        for (s, e), part in zip(words, parts):
            starts.append((s, e, before))
            before += len(part)
        if sync < b.end:  # a few words of b between the agreement and its end
            for s, e in _words(enc, text, sync, b.end):
                starts.append((s, e, before))
                before += len(enc.piece(text[s:e]))
        if last is None:
            last = (starts[-1][0], starts[-1][2])
        if tail is None:
            s, _, n = next(x for x in starts if x[1] > b.end - 3)
            tail = (s, n)
    head = (a.head_end, a.head_ids) if a.head_end <= a.tail else (words[0][1], len(parts[0])) if words else (a.head_end, a.head_ids)
    return Segment(a.start, b.end, ids, head, tail, last)


def concatenate(enc: Encoder, text: str, segments: list[Segment]) -> np.ndarray:
    """All ids of a text from its chunks, joined as a balanced tree."""
    while len(segments) > 1:
        pairs = [join(enc, text, a, b) for a, b in zip(segments[::2], segments[1::2])]
        segments = pairs + segments[len(pairs) * 2 :]
    return segments[0].ids


def cut(text: str, size: int, anywhere: bool = False) -> list[tuple[str, bool]]:
    """Chunks of at most ``size`` characters and whether each begins at a safe place (before white space); with ``anywhere`` no such place is sought."""
    out, start, safe = [], 0, True
    while start < len(text):
        end = min(start + size, len(text))
        ends_safe = True
        if end < len(text) and anywhere:
            ends_safe = False
        elif end < len(text):
            places = [m.start() for m in _SAFE_CUT.finditer(text, start + size // 2, end + 1) if m.start() <= end]
            ends_safe = bool(places)
            end = places[-1] if places else end
        out.append((text[start:end], safe))
        start, safe = end, ends_safe
    return out


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.array([], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk_chars: int = CHUNK_CHARS, counts_only: bool = False, cut_anywhere: bool = False) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row, or (doc_id, n_tokens BIGINT) with ``counts_only``.

    No special tokens. A null or empty text gives an empty list (0 tokens); a null or repeated id is
    kept, one output row for each input row; an empty table gives no rows. Other columns are left
    out, so their names cannot clash. Only texts over ``chunk_chars`` characters are shuffled, in
    chunks, so that one very long text is encoded by many tasks. Chunks carry the hash of their text, so
    a task that is run again gives the same chunks in any order, and copies of a text are encoded once.
    With ``cut_anywhere`` all joins are made by tree concatenation, also where white space would spare them.
    """
    if chunk_chars < 16:
        raise ValueError("chunk_chars must be 16 at least")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    result = "n_tokens long" if counts_only else "ids array<int>"

    def made(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        if counts_only:
            return pa.RecordBatch.from_arrays([keys, pa.array(lengths)], names=["doc_id", "n_tokens"])
        return pa.RecordBatch.from_arrays([keys, _id_lists(ids)], names=["doc_id", "ids"])

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                yield made(part.column(0), [enc.encode(t or "") for t in part.column(1).to_pylist()])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # long texts of one task
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if key in seen:
                    continue
                seen.add(key)
                pieces = cut(batch.column(1)[i].as_py(), chunk_chars, cut_anywhere)
                unsafe = [not s for _, s in pieces] + [False]
                for k in range(0, len(pieces), 64):
                    part = pieces[k : k + 64]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * n, pa.binary()), pa.array(list(range(k, k + n)), pa.int32()), pa.array([t for t, _ in part]), pa.array([s for _, s in part]), pa.array([unsafe[k + j] or unsafe[k + j + 1] for j in range(n)])],
                        names=["key", "k", "text", "safe", "keep"],
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(vocabulary), set()
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                own = list(zip(part.column("key").to_pylist(), part.column("k").to_pylist()))
                new = [j for j, x in enumerate(own) if x not in seen and own.index(x) == j]
                seen.update(own)
                part = part.take(pa.array(new, pa.int64()))
                texts = part.column("text").to_pylist()
                ids = [enc.encode(t) for t in texts]
                kept = [t if k else None for t, k in zip(texts, part.column("keep").to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", "k", "safe")], pa.array(kept, pa.string()), _id_lists(ids)], names=["key", "k", "safe", "text", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        enc = encoder(vocabulary)
        table = table.sort_by("k")
        safe, texts = table.column("safe").to_pylist(), table.column("text").to_pylist()
        ids = [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int32) for x in table.column("ids")]
        out: list[np.ndarray] = []
        run: list[int] = []
        for k in range(len(ids) + 1):
            if run and (k == len(ids) or safe[k]):
                if len(run) == 1:
                    out.append(ids[run[0]])
                else:
                    text = "".join(texts[i] for i in run)
                    at, segments = 0, []
                    for i in run:
                        segments.append(leaf(enc, text, at, at + len(texts[i]), ids[i]))
                        at += len(texts[i])
                    out.append(concatenate(enc, text, segments))
                run = []
            run.append(k)
        made_ = made(table.column("key").slice(0, 1).combine_chunks(), [np.concatenate(out)])
        return pa.Table.from_batches([made_]).rename_columns(["key", result.split()[0]])

    short = rows.filter(~long).mapInArrow(short_texts, f"doc_id long, {result}")
    key = F.unhex(F.sha2("text", 256))
    pieces = rows.filter(long).select(key.alias("key"), "text").mapInArrow(chunks, "key binary, k int, text string, safe boolean, keep boolean")
    parts = pieces.repartition("key", "k").mapInArrow(encoded, "key binary, k int, safe boolean, text string, ids array<int>")
    known = parts.groupBy("key").applyInArrow(joined, f"key binary, {result}")
    # Rows of one text are spread over salts, as many as its copies need.
    wanted = rows.filter(long).select("doc_id", key.alias("key"))
    salts = wanted.groupBy("key").agg(F.least(F.lit(MOST_SALTS), F.ceil(F.count("*") / F.lit(COPIES))).cast("int").alias("salts"))
    known = known.join(salts, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = wanted.join(salts, "key").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return short.unionByName(own.select("doc_id", "key", "salt").join(known.drop("salts"), ["key", "salt"]).select("doc_id", result.split()[0]))


def decode_ids(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of a list of ids; used for round trips."""
    words = encoder(vocabulary).words
    return b"".join(words[i] for i in ids).decode("utf-8", errors="replace")
