"""Sentence ends in many languages and scripts, as SQL expressions only.

A text is first put into a shadow alphabet of the same length: signs of one role become one Latin-1
or control character, so the patterns stay cheap. Full stops that end nothing (decimals, file names,
addresses, initials, abbreviations, quoted sentences) then give way to a private-use placeholder, breaks
between blocks become a sign of their own, and a mark is inserted behind every end that script-specific
patterns find. Placeholders keep every position, so the text of a sentence is restored by its place.

No pattern looks a bounded way ahead or back for what may be of any length: quotations, indents, list
items, spaces before a line's end and enumerations are followed to their end. Counts left in the
patterns are part of a form: item numbers and footnotes of one to three digits, German ordinals of one
or two, headings of one to six signs, interjections of one or two characters, enumerated Thai words of
one to five letters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs of the shadow alphabet.
MASK, BREAK, MARK, INDENT = chr(0xE000), chr(2), chr(3), chr(4)
_SHADOW = {
    5: "\u2026",  # ellipsis
    6: "\u0964\u0965",  # danda
    7: "\u3002",  # full stop of scripts without spaces
    8: "\uff01\uff1f",
    11: "\uff0e",
    14: "\u201c",
    15: "\u201e",
    16: "\u201d",
    17: "\u300c\u300e\u300a\u3010",
    18: "\u300d\u300f\u300b\u3011",
    19: "\uff08",
    20: "\uff09",
    21: "\u2018",
    32: "\r\x0b\x0c\x85\u2028\u2029",
    39: "\u2019",
    58: "\uff1a",
    63: "\u061f\u203d",
    127: "".join(map(chr, [*range(9), *range(14, 32), *range(127, 133), *range(134, 160), 0xE000])),
    160: "\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u205f\u3000\ufeff",
    171: "\u2039",
    178: "\u2070" + "".join(map(chr, range(0x2074, 0x207A))),
    187: "\u203a",
}
_FROM = "".join(_SHADOW.values())
_TO = "".join(chr(k) * len(v) for k, v in _SHADOW.items())

# Character classes of the patterns, without their brackets.
_WS = r" \t\n\xa0\x04"
_SP = r" \t\xa0\x04"
_NL = r"\n\x02"
_TERM = r".!?\x05\x06\x07\x08\x0b"
_CJK = r"\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_CJK_ALL = _CJK + r"\x07\x08\x0b\x11-\x14\u3001-\u301f\uff01-\uff20\uff3b-\uff40\uff5b-\uff65"
_THAI = r"\u0e01-\u0e2e\u0e30-\u0e3a\u0e40-\u0e45\u0e47-\u0e4e"
_THAI_SIGNS = r"\u0e2f\u0e46"
_DEVA = r"\u0900-\u0963\u0966-\u097f"
_ARAB = r"\u0620-\u064a\u066e-\u06d3"
_CLOSE = r"\"'\x0e\x10\xbb)\]\x12\x14*_"
#: Closing marks behind a terminator: quotes and brackets, also behind a narrow space, and footnote marks.
_CLOSERS = rf"(?:[{_CLOSE}\xb9\xb2\xb3]|\xa0(?=\xbb)|\[\d{{1,3}}\])"
_OPENERS = r"\"'\x0e\x0f\x11\x13\x15\xab\xbf\xa1(\[`$"

# Abbreviations behind which a sentence goes on even if a capital or a digit follows.
ABBREVIATIONS = """
    dr prof mr mrs ms gen col capt lt sgt sen rep gov hon rev st mt ft mgr mme mlle messrs
    fig figs sec secs eq eqs ch vol vols chap ed eds pp cf vs ca approx incl min max viz resp
    e.g i.e
    abb abs bd bzw evtl ggf hrsg inkl kap nr tab vgl zzgl z.b d.h u.a o.ä str
    sr sra srta dra ing av avda pág págs núm aprox EE ej
    env chap
    рис стр табл гл проф акад доц им см тыс ср напр т.е
    डॉ प्रो पृ श्री
    ดร รศ ผศ
""".split()
# Words before a German ordinal, months behind one.
_ORDINAL_BEFORE = "[Aa]m|[Ii]m|[Vv]om|[Zz]um|[Bb]eim|[Dd]er|[Dd]ie|[Dd]as|[Dd]em|[Dd]en|[Dd]es|[Uu]nd|[Bb]is"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
# Conjunctions that carry a Chinese or Japanese sentence on behind an ellipsis or a quotation.
_CJK_ON = "但|不过|而|可是|却|然后|于是|就|并|だが|だけど|しかし|けど|けれど|ただ"

_WORD = r"[\p{L}\p{M}\p{N}]"
_RULE = r"(?:-{3,}|={3,}|_{3,}|\*{3,})"
_BLOCK = rf"[{_SP}]*(?:#{{1,6}} |[-*+\u2022] |\||!\[|\$\$|{_RULE}[{_SP}]*(?:[{_NL}]|$))"
_ITEM = rf"[{_SP}]*\d{{1,3}}[.)] "
#: Where a line begins, behind its indent.
_AT_LINE = rf"(?:^|[{_NL}{INDENT}])"
#: The first characters of a block of one line: heading, table row, image, formula.
_ONE_LINE = rf"[#|!$](?<={_AT_LINE}[#|!$])(?:(?<=#)#{{0,5}} |(?<=\|)|(?<=!)\[|(?<=\$)\$)"


def _forms(*words: str) -> list[str]:
    """Each word with composed and with decomposed accents."""
    return sorted({unicodedata.normalize(form, w) for w in words for form in ("NFC", "NFD")}, key=lambda w: (-len(w), w))


def _any(words: str) -> str:
    return "|".join(_forms(*words.split("|")))


def _abbreviations() -> str:
    """A look-behind for each length, so that most words fail at their first letter."""
    words = sorted({f for w in ABBREVIATIONS for v in (w, w[0].upper() + w[1:]) for f in _forms(v)})
    by_length = {n: "|".join(w.replace(".", rf"[.{MASK}]") for w in words if len(w) == n) for n in sorted({len(w) for w in words})}
    return "|".join(rf"(?<=(?<!{_WORD})(?:{alternatives})\.)" for alternatives in by_length.values())


def _inside(opener: str, marks: str, closing: str, last: bool) -> str:
    """One terminator within a quotation or bracket; with ``last`` also those right before the closing mark.

    The match begins at the opening mark or where the one before it ended.
    """
    start = rf"{opener}(?=[^{marks}\x02]++[{closing}])"
    return rf"((?:\G(?!^)|{start})[^{marks}\x02{_TERM}]*)[{_TERM}]" + ("" if last else rf"(?![{_TERM}]*[{_SP}]?[{closing}])")


def _has(*signs: str) -> Column:
    found = F.col("_m").contains(signs[0])
    for sign in signs[1:]:
        found = found | F.col("_m").contains(sign)
    return found


def _steps() -> list[tuple[str, str, Column | None]]:
    """(pattern, replacement, what a text must have for the step to be tried), in order. Patterns begin with a sign of a small class."""
    keep, mark = "$1" + MASK, "$1" + MARK
    east, thai, deva, arab = (F.col(c) for c in ("_east", "_thai", "_deva", "_arab"))
    breaks = [
        # Indents get a sign of their own, so that one sign tells the beginning of a line whatever the indent.
        (r"(?:\G|(?<=\n))[ \t\xa0]", INDENT, F.col("_m").rlike(r"(?:^|\n)[ \t\xa0]")),
        # Blank lines, lines that begin a block, blocks of one line, rules, numbered lists, lines of scripts without spaces.
        (rf"\n(?=[{_SP}]*\n)", BREAK, _has("\n")),
        (rf"\n(?<=[\x02{INDENT}]\n)", BREAK, _has(BREAK)),
        (rf"\n(?={_BLOCK})", BREAK, _has("\n")),
        (rf"({_ONE_LINE}[^{_NL}]*)\n", "$1" + BREAK, _has("\n")),
        (rf"([-=_*](?<={_AT_LINE}[-=_*])(?:(?<=-)-{{2,}}|(?<==)={{2,}}|(?<=_)_{{2,}}|(?<=\*)\*{{2,}})[{_SP}]*)\n", "$1" + BREAK, _has("---", "===", "___", "***")),
        (rf"((?:(?<![^\x02])(?={_ITEM})|\G(?!^))[^{_NL}]*+(?:\n(?!{_ITEM})[^{_NL}]*+)*+)\n(?={_ITEM})", "$1" + BREAK, F.col("_m").rlike(rf"\n{_ITEM}")),
        (rf"\n(?=[{_SP}]*[{_CJK_ALL}{_THAI}])", BREAK, (east | thai) & _has("\n")),
        (rf"([{_CJK_ALL}{_THAI}{_THAI_SIGNS}][{_SP}]*+)\n", "$1" + BREAK, (east | thai) & _has("\n")),
    ]
    masks = [
        # Headings, table rows, images and formula lines are one unit each.
        (rf"((?:{_ONE_LINE}|\G(?!^))[^{_NL}{_TERM}]*)[{_TERM}]", keep, _has("#", "|", "![", "$$")),
        (
            r"[.?!\x0b](?:"
            # decimals, versions, file names, addresses; a sign before a capitalised word only behind few small letters
            rf"(?=[\p{{L}}\p{{N}}_/=&])(?<=[\p{{L}}\p{{N}}_/~)=&-].)(?:(?!\p{{Lu}}\p{{Ll}})|(?<!\p{{Ll}}{{3}}.))(?<![{_CJK}][?!\x0b])"
            # numbers of list items
            rf"|(?=[{_SP}])(?<=\d\.)(?<={_AT_LINE}\d{{1,3}}\.)"
            # initials: a capital before a capital; a small letter before one, unless it ends "a. m." or "t. d."
            rf"|(?=[{_WS}]*[\p{{Lu}}\p{{Lt}}])(?<=\p{{Lu}}\.)(?<!{_WORD}.\.)"
            rf"|(?=[{_WS}]+\p{{Lu}})(?<=\p{{Ll}}\.)(?<![\p{{L}}\p{{N}}].\.)(?<!т[.{MASK}][{_WS}]{{0,2}}.\.)(?<!\p{{Ll}}[.{MASK}].\.)"
            rf"|(?=[{_WS}])(?<=[\p{{L}}\p{{M}}]\.)(?:{_abbreviations()})"
            # German ordinals
            rf"|(?=[{_WS}])(?<=\d\.)(?:(?<=\b(?:{_ORDINAL_BEFORE})[{_WS}]\d{{1,2}}\.)|(?=[{_WS}]+(?:{_any(_MONTHS)})\b)(?<=\b\d{{1,2}}\.))"
            r")",
            MASK,
            _has(".", "?", "!", chr(11)),
        ),
        (rf"\.(?=[{_WS}])(?<=(?<![\p{{L}}\p{{M}}])[{_ARAB}]\p{{M}}{{0,2}}\.)", MASK, arab & _has(".")),
        # Full stops behind letters of scripts that do not end sentences with them.
        (rf"\.(?<=[{_DEVA}{_THAI}{_THAI_SIGNS}]\.)(?!\.)", MASK, (deva | thai) & _has(".")),
        # Quotations and brackets: what is inside ends nothing, but for what ends the sentence around it.
        (_inside(r"[\x0e\x0f\xab\x11]", r"\x0e-\x12\xab\xbb", r"\x0e\x10\x12\xbb", False), keep, _has(chr(14), chr(15), chr(171), chr(17))),
        (_inside(r'"(?<![\p{L}\p{N}.!?,\x05\x06]")(?=\S)', '"', '"', False), keep, _has('"')),
        (_inside(rf"[(\x13](?:(?<=[\p{{L}}\p{{N}},;:%'\x0e-\x10\xab\xbb\"][{_WS}]\()|(?<=[\p{{L}}\p{{N}}]\x13))", r"()\x13\x14", r")\x14", True), keep, _has("(", chr(19))),
        (_inside(r"[(\x13]", r"()\x13\x14", r")\x14", False), keep, _has("(", chr(19))),
        # Quotations that their sentence goes on behind, in scripts without capitals.
        (rf"[{_TERM}](?=[{_TERM}]*\x12[{_SP}]*[^{_WS}{_NL}])", MASK, _has(chr(18))),
        (rf"((?:^|[^:{_SP}])[{_SP}]?\x0e[^\x0e\x10\x02{_TERM}]*)[{_TERM}](?=\x10[{_CJK}])", keep, east & _has(chr(16))),
        (rf"[{_TERM}](?=[{_TERM}]*\x10(?:{_any(_CJK_ON)}))", MASK, east & _has(chr(16))),
        (rf"[{_TERM}](?=[\"\x10\xbb)]+[{_SP}]*\n?[{_SP}]*[{_DEVA}{_THAI}])", MASK, deva | thai),
        (rf"[!?](?=[\"\x10\xbb]+[{_WS}]+(?:\u062b\u0645|\u0648[{_ARAB}]+)[{_WS}])", MASK, arab),
        # An ellipsis that its sentence goes on behind: after an interjection or before a conjunction.
        (rf"(?:(?=[.\x05]++[{_CJK}])(?<=(?:^|[\x07\x08\x0b\x10\x12\x14{_WS}\x02])[{_CJK}]{{1,2}})|\G(?!^))[.\x05]", MASK, east & _has("...", chr(5))),
        (rf"(?:\x05|\.(?:(?<=\.\.)|(?=\.\.)))(?=[.\x05]*(?:{_any(_CJK_ON)}))", MASK, east & _has("...", chr(5))),
        (rf"\.\.\.(?=[{_WS}]+[{_ARAB}{_DEVA}])", MASK * 3, (arab | deva) & _has("...")),
        # Thai enumerations before "and so on".
        (rf"((?<![{_SP}][{_THAI}]{{1,5}})(?=[{_SP}][{_THAI}]{{1,5}}(?:[{_SP}][{_THAI}]{{1,5}})*+[{_SP}]\u0e2f\u0e25\u0e2f)|\G(?!^)[{_THAI}]{{1,5}})[{_SP}](?=[{_THAI}])", keep, thai & _has("\u0e2f\u0e25\u0e2f")),
    ]
    ends = [
        (
            # any terminator before a capital, a letter without case, an opening mark or a leading ellipsis
            rf"((?:[.!?\x05\x06]+{_CLOSERS}*(?=[{_WS}]+(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}{_OPENERS}]|\*{{1,2}}\p{{L}}|\.\.\.\p{{L}}))"
            # before a digit: behind a word, a number or a closing mark
            rf"|(?:[!?\x05\x06]|\.(?<=[\p{{L}}\p{{M}}]{{3}}\.|\p{{N}}\.|[{_CLOSE}]\.)){_CLOSERS}*(?=[{_WS}]+\p{{N}})"
            # before a small letter: a question or exclamation mark, a single full stop behind a long word or in a quotation behind a word
            rf"|(?:[!?]|\.(?<=[\p{{L}}\p{{M}}]{{5}}\.)|\.(?<=[\p{{L}}\p{{M}}]{{3}}\.)[\"\x10])(?=[{_WS}]+\p{{Ll}})"
            # no space between two sentences
            r"|[.!?](?<=\p{Ll}{3}.)(?=\p{Lu}\p{Ll})))",
            mark,
            _has(".", "?", "!", chr(5), chr(6)),
        ),
        (rf"(\x06+{_CLOSERS}*)(?=[{_DEVA}])", mark, deva),
        (rf"((?:[\x07\x08\x0b]|[!?](?<=[{_CJK}].)|\x05(?<=[{_CJK_ALL}\x05]\x05)(?![\x05.])|\.{{3,}}(?<=[{_CJK}]\.{{3}}))[\x07\x08\x0b!?\x05]*+[\x10'\x12\x14)]*+)(?=[{_SP}]*[^{_WS}{_NL}])", mark, east),
        (rf"([{_SP}])(?<=[{_THAI}][{_SP}])(?=[{_SP}]*[{_THAI}])", MARK + "$1", thai),
        (r"\x02", BREAK + MARK, _has(BREAK)),
    ]
    return [*breaks, *masks, *ends]


def masked(rows: DataFrame, text: str) -> DataFrame:
    """``text`` with masks, breaks and marks as column ``_m``; without its marks it has the length of ``text``.

    One projection a step; which scripts a text has is found once.
    """
    rows = rows.withColumn("_m", F.translate(text, _FROM, _TO))
    for name, letters in (("_east", _CJK), ("_thai", _THAI), ("_deva", _DEVA), ("_arab", _ARAB)):
        rows = rows.withColumn(name, (F.octet_length("_m") > F.length("_m")) & F.col("_m").rlike(f"[{letters}]"))
    for pattern, replacement, needed in _steps():
        step = F.regexp_replace("_m", F.lit(pattern), F.lit(replacement))
        rows = rows.withColumn("_m", step if needed is None else F.when(needed, step).otherwise(F.col("_m")))
    return rows


def _prefix_sums(lengths: Column) -> Column:
    """Running sums of an array, in blocks of 128 so that long arrays stay cheap."""
    size, zero = 128, F.lit(0).cast("bigint")

    def running(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(values, first, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")), lambda acc: acc["a"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), lambda b: F.slice(lengths, b * size + 1, size))
    starts = running(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x)), zero)
    return F.flatten(F.zip_with(blocks, F.concat(F.array(zero), starts), lambda b, s: F.when(b.isNotNull(), running(b, s)).otherwise(F.array().cast("array<bigint>"))))


def _cut(text: Column, starts: Column, lengths: Column) -> Column:
    """``text`` cut at ascending places (from 0), in blocks of 64 pieces: each piece is sought in its block only, not from the text's start."""
    size = 64
    blocks = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor((F.size(starts) - 1) / size).cast("int")), lambda b: F.size(starts) > 0),
        lambda b: F.struct(F.slice(starts, b * size + 1, size).alias("s"), F.slice(lengths, b * size + 1, size).alias("n")),
    )
    first = lambda b: F.array_min(b["s"])
    last = lambda b: F.array_max(F.zip_with(b["s"], b["n"], lambda s, n: s + n))
    held = F.transform(blocks, lambda b: F.struct(b["s"].alias("s"), b["n"].alias("n"), first(b).alias("lo"), F.substring(text, (first(b) + 1).cast("int"), (last(b) - first(b)).cast("int")).alias("t")))
    return F.flatten(F.transform(held, lambda b: F.zip_with(b["s"], b["n"], lambda s, n: F.substring(b["t"], (s - b["lo"] + 1).cast("int"), n.cast("int")))))


def sentence_units(cells: DataFrame, text: str = "cell_text", sentence: str | None = None) -> DataFrame:
    """One row per sentence of each row's ``text``: the row's other columns, ``start`` and ``end`` (characters from the start of the text, end exclusive).

    With ``sentence`` a column of that name holds the sentence as it stands in the text, so no join
    with the text is needed. Null, empty and blank texts give no rows; units without a letter or digit
    (lines of dashes) are left out; white space never begins or ends a unit. Every row is treated on
    its own, so repeated rows repeat their sentences. Columns named like the helper columns are not
    allowed to clash: all helpers begin with an underscore.
    """
    keep = [c for c in cells.columns if c != text]
    trail = rf"[{_WS}{_NL}]+$"
    pieces = masked(cells.filter(F.col(text).isNotNull()), text).select(*keep, F.split("_m", MARK).alias("_pieces"), *([F.col(text).alias("_text")] if sentence else []))
    lengths = F.transform("_pieces", lambda p: F.length(p).cast("bigint"))
    pieces = pieces.withColumn("_ends", _prefix_sums(lengths))
    zipped = ["_pieces", "_ends"]
    if sentence:
        starts = F.zip_with("_ends", lengths, lambda e, n: e - n)
        pieces = pieces.withColumn("_raw", _cut(F.col("_text"), starts, lengths)).drop("_text")
        zipped.append("_raw")
    rows = pieces.select(*keep, F.explode(F.arrays_zip(*zipped)).alias("_z"))
    rows = rows.select(*keep, F.col("_z._pieces").alias("_piece"), F.col("_z._ends").alias("_end"), *([F.col("_z._raw").alias("_raw")] if sentence else [])).filter(F.col("_piece").rlike(r"[\p{L}\p{N}]"))
    body = F.regexp_replace("_piece", F.lit(trail), F.lit(""))
    lead = F.length("_piece") - F.length(F.regexp_replace("_piece", F.lit(rf"^[{_WS}{_NL}]+"), F.lit("")))
    own = [F.substring("_raw", lead + 1, F.length(body) - lead).alias(sentence)] if sentence else []
    return rows.select(*keep, (F.col("_end") - F.length("_piece") + lead).cast("bigint").alias("start"), (F.col("_end") - F.length("_piece") + F.length(body)).cast("bigint").alias("end"), *own)


def document_sentences(docs: DataFrame, kind: str = "text", sentence: str | None = None) -> DataFrame:
    """(doc_id, start_pos, end_pos) of each sentence in the cells of a kind; positions in characters of ``text``.

    With ``sentence`` a column of that name holds the sentence itself. Null texts or cells, cells of
    other kinds and cells beyond the text give no rows. Each cell is its own row while it is split, so
    the tasks of a document with many cells can be spread.
    """
    wanted = F.array_sort(F.transform(F.filter("cells", lambda c: (c["kind"] == kind) & (c["n"] > 0) & (c["pos"] >= 0)), lambda c: F.struct(c["pos"].cast("bigint").alias("pos"), c["n"].cast("bigint").alias("n"))))
    rows = docs.filter("text is not null").select("doc_id", "text", wanted.alias("_c")).filter("size(_c) > 0")
    texts = _cut(F.col("text"), F.transform("_c", lambda c: c["pos"]), F.transform("_c", lambda c: c["n"]))
    cells = rows.select("doc_id", F.explode(F.arrays_zip(F.col("_c").alias("c"), texts.alias("t"))).alias("z")).select("doc_id", F.col("z.c.pos").alias("pos"), F.col("z.t").alias("cell_text"))
    units = sentence_units(cells, sentence=sentence)
    return units.select("doc_id", (F.col("pos") + F.col("start")).alias("start_pos"), (F.col("pos") + F.col("end")).alias("end_pos"), *([sentence] if sentence else []))
