import unicodedata

import pytest

from quantloom.llm.sentences import document_sentences, sentence_units

CASES = [
    ["Dr. Tarrenby reported 9.197 mm in Fig. 199, i.e. far below.", " ", "The run stopped at 8 p.m.", " ", "Nothing was lost."],
    ["The maker is Quendle & Sons Inc.", " ", "Never mix v0.5.2 with README.md!", " ", "J. R. Osk et al. agree (cf. Eq. 3)."],
    ['The note reads "Stop. Nothing was saved!" and then ends.', "  ", "“Why now?” she asked.", " ", "It is “ready.”", " ", "They asked (was it Osk?) for more.", " ", "(It is only a guess.)", " ", "The index is known since 1965.[10]", " ", "It ended..."],
    ["Wait... the grid is odd.", " ", "It never ended...", " ", "...and the draft came back.", " ", "Really?!", " ", "flakewise prints one per loss."],
    ["It hides a ledger, not the\nharbour.", "\n", "Two things matter."],
    ["One thing.", "", "Two things follow."],
    ["# 3. A title. With stops", "\n\n", "1. First thing", "\n", "2. Second.", " ", "Third one", "\n\n", "| a. | 1.2 | no. 3 |", "\n", "![fig. 2](img/plot.v2.png)", "\n", "$$ y = 0.5 x. $$", "\n\n---\n\n", "- last item"],
    ["Am 12. und 13. Februar fehlt die Zelle u. a. wegen Prof. Osk.", " ", "Gemessen wurden Wind usw.", " ", "Dr. Osk maß am\n3. Mai z. B. 4,5 mm.", " ", "„Es geht nicht. Noch einmal!“, steht im Protokoll.", " ", "Sie sagte: „Die Kurve ist leer.“", " ", "Siehe Abb. 2 bzw. Tab. 3."],
    ["En EE. UU. la curva vale 1.813,25.", " ", "¿Por qué?", " ", "El Sr. Osk anotó 2,5 mm en la pág. 13.", " ", "«Falló. ¡Otra vez!», dice el registro."],
    ["Il a écrit\xa0: «\xa0La mesure est vide.\xa0»", " ", "Attention à la table !", " ", "M. Osk a noté C.-à-d. rien."],
    ["А. Б. Велмарин получил 4,5 мм, т. е. меньше нормы.", " ", "Там есть ветер и т. д.", " ", "«Не вышло. Ещё раз!» — пишет журнал.", " ", "Ну... строка не готова."],
    ["他说：“失败了。再试一次！”然后特征继续运行。", "", "他问：“曲线在哪里？”", "", "真的吗？！", "", "“窗口稳定吗？”有人在评论里问。", "", "等等……残差还没算完。", "", "比v2.7版小...但差别不大。", "", "（模型只是猜测。）", "", "结果还没有出来……", "\n", "第8.94节"],
    ["本当か！？", "", "彼は「格子がない。」と言った。", "", "『入門。改訂版』を参照。", "", "約18.0倍…だが差は小さい。", "\n", "次の行"],
    ["จริงหรือ?!", " ", "ดร. Osk ใช้ v3.8.8 กับเซลล์นี้", " ", "เวลา 4.30 น. ระบบหยุดทำงาน", " ", "มีทั้งลม ฝน ฯลฯ ในตัวอย่างนี้", " ", "ลองทำซ้ำบ่อย ๆ กับหน้าต่างนั้น", " ", 'บันทึกเขียนว่า "ล้มเหลว! ทำใหม่" แล้วก็จบ'],
    ["انتظر... الخلية غير جاهز.", " ", "القيمة ٣٫٥ تقريبا…", " ", "قال السجل: «توقف. أعد المحاولة!» ثم انتهى.", " ", "قال: «انتهى المتوسط.»", " ", "راجع ص. 420 من كتاب أ. د. Osk أولا."],
    ["“ठीक है।” उसने कहा।", " ", "डॉ. Osk ने 19.5 मि.मी. बताया।", " ", "यह सही है या नहीं?", " ", "ठहरो... संकेत अभी अधूरा है॥"],
]


@pytest.mark.parametrize(("crlf", "form"), [(False, "NFC"), (True, "NFD")])
def test_units(spark, crlf, form):
    rows, want = [], {}
    for i, parts in enumerate(CASES):
        parts = [unicodedata.normalize(form, p.replace("\n", "\r\n") if crlf else p) for p in parts]
        rows.append((i, "".join(parts)))
        want[i] = parts[::2]
    got = {i: [] for i in want}
    texts = dict(rows)
    for r in sentence_units(spark.createDataFrame(rows, "id long, cell_text string")).orderBy("start").collect():
        got[r.id].append(texts[r.id][r.start : r.end])
    for i in want:
        assert got[i] == want[i], i


def test_documents(spark):
    text = "\U0001f600 First one. Second\n\ncode. Not this. Here\n\nThird."
    cell = "kind string, pos int, n int, exec_no int"
    cells = [("text", 0, 19, None), ("code", 21, 20, 1), ("text", 43, 6, None), ("text", 99, 5, None), (None, 0, 5, None), ("text", None, None, None)]
    rows = [(1, text, cells, "x"), (2, None, cells, "x"), (3, "", cells[:1], "x"), (4, " \n \n", [("text", 0, 4, None)], "x"), (5, "a. b", None, "x"), (1, text, cells, "x"), (6, "---\n\n***", [("text", 0, 8, None)], "x")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, cells array<struct<{cell}>>, end_pos string")
    got = sorted((r.doc_id, text[r.start_pos : r.end_pos]) for r in document_sentences(df).collect())
    assert got == sorted(2 * [(1, "\U0001f600 First one."), (1, "Second"), (1, "Third.")])
    assert document_sentences(df.limit(0)).count() == 0


def test_long_texts_and_private_signs(spark):
    text = "Some words here. " * 3000 + "\x01\x02\x03 end"
    (n,) = spark.createDataFrame([(text,)], "cell_text string").transform(sentence_units).selectExpr("count(*)").first()
    assert n == 3000
    rows = [("x" * 200_000 + ".",), ("\n" * 5000,), ("1. a\n" * 3000,), ('"' * 3000,), ("(" * 3000 + ".",), ("." * 5000 + " A",), ("a.b" * 5000,)]
    assert spark.createDataFrame(rows, "cell_text string").transform(sentence_units).count() >= 3000


def units(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, cell_text string").transform(lambda df: sentence_units(df, sentence="s")).collect()
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.s
    return [[r.s for r in sorted((x for x in rows if x.id == i), key=lambda x: x.start)] for i in range(len(texts))]


def test_nothing_is_too_long_for_a_pattern(spark):
    filler = "very " * 1000 + "long"
    listed = "\n".join(["1. An entry", *["that goes on"] * 200, "2. The next"])
    thai = "ลม " * 40 + "ฯลฯ ในตัวอย่าง"
    indented = "\n".join(" " * 20 + line for line in ("Text before", "# Heading v. 2", "- one", "- two", "Last line"))
    got = units(
        spark,
        [
            f'She said "Stop. It is {filler}. Go!" and left. Then nothing.',
            f"It works (see there. It is {filler}. Really) at last. Then nothing.",
            listed,
            indented,
            "一行" + " " * 50 + "\n二行",
            "มีทั้ง " + thai,
            "嗯" + "." * 12 + "他走了。好。",
            "\xa0" * 30 + "1. Some title. With more\n" + " " * 300 + "\n" + "End here",
        ],
    )
    assert [len(x) for x in got] == [2, 2, 2, 4, 2, 1, 2, 3]
    assert got[3][1:3] == ["# Heading v. 2", "- one"] and got[2][1] == "2. The next" and len(got[5][0]) == len("มีทั้ง " + thai)


def test_many_sentences_and_cells(spark):
    text = "ä. ".join(f"Satz {i} geht" for i in range(700))
    cells = [("text", 3 + 20 * i, 15, None) for i in range(300, -1, -1)]
    (got,) = units(spark, [text])
    assert len(got) == 700 and got[5] == "Satz 5 gehtä."
    df = spark.createDataFrame([(1, text, cells)], "doc_id long, text string, cells array<struct<kind string, pos int, n int, exec_no int>>")
    rows = document_sentences(df, sentence="s").collect()
    assert len(rows) >= 300 and all(text[r.start_pos : r.end_pos] == r.s for r in rows)
