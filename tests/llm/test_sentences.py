import pytest

from sieveline.llm import sentences as p9

CASES = [
    (None, []), ("", []), (" \n\ufeff\n", []), ("No stop", ["No stop"]),
    ("Mr. Lint left at 9 a.m. the other day. Page us at 5 p.m. The end.", ["Mr. Lint left at 9 a.m. the other day.", "Page us at 5 p.m.", "The end."]),
    ("See Fig. 3 and Sec. 4.2. It took approx. 3 s on No. 7 of them, e.g. os.popen() or x.", ["See Fig. 3 and Sec. 4.2.", "It took approx. 3 s on No. 7 of them, e.g. os.popen() or x."]),
    ("Keep logs, dumps, etc. At once! os.popen() is here. 12 files were skipped.", ["Keep logs, dumps, etc.", "At once!", "os.popen() is here.", "12 files were skipped."]),
    ('"Is it so?" asked he. “Do it now.” Then go. He wrote “Stop. Now.” and left.', ['"Is it so?" asked he.', "“Do it now.”", "Then go.", "He wrote “Stop. Now.” and left."]),
    ("The fix (see a. It is short.) went out. Wait... the end?!", ["The fix (see a. It is short.) went out.", "Wait... the end?!"]),
    ("Der 5. Lauf brach nach ca. 6 ms ab. Dr. Scan schrieb: „Nein. Nie.“ und ging. Das sind z. B. drei.", ["Der 5. Lauf brach nach ca. 6 ms ab.", "Dr. Scan schrieb: „Nein. Nie.“ und ging.", "Das sind z. B. drei."]),
    ("Voir la fig. 8 et l’art. 2. Arrêtez\xa0! «\xa0Non.\xa0» C’est p. ex. ici.", ["Voir la fig. 8 et l’art. 2.", "Arrêtez\xa0!", "«\xa0Non.\xa0»", "C’est p. ex. ici."]),
    ("¿Es seguro? ¡Paren! Los de EE. UU. usan uno.", ["¿Es seguro?", "¡Paren!", "Los de EE. UU. usan uno."]),
    ("Смените и т. д. Всего пять, т. е. много. См. рис. 5.", ["Смените и т. д.", "Всего пять, т. е. много.", "См. рис. 5."]),
    ("Ποιος είναι; Ο κανόνας, δηλ. αυτός.", ["Ποιος είναι;", "Ο κανόνας, δηλ. αυτός."]),
    ("先换。“先换密钥。”他写道：“不要。停。”然后走了。没人了……停！", ["先换。", "“先换密钥。”", "他写道：“不要。停。”然后走了。", "没人了……", "停！"]),
    ("「できるか？」と尋ねた。「先に。」止めて！", ["「できるか？」と尋ねた。", "「先に。」", "止めて！"]),
    ("उसने लिखा “नहीं। रुको।” और गया। डॉ. लिंट है। क्या?", ["उसने लिखा “नहीं। रुको।” और गया।", "डॉ. लिंट है।", "क्या?"]),
    ("هل هذا آمن؟ كتب «لا. أبدا.» ثم ذهب؛ نعم.", ["هل هذا آمن؟", "كتب «لا. أبدا.» ثم ذهب؛ نعم."]),
    ("그는 “안돼. 멈춰.”라고 썼다. kettle 모듈은 없다.", ["그는 “안돼. 멈춰.”라고 썼다.", "kettle 모듈은 없다."]),
    ("กฎเปลี่ยนไปแล้ว ใครตรวจ a.py เมื่อวานนี้ ไม่มี", ["กฎเปลี่ยนไปแล้ว", "ใครตรวจ a.py เมื่อวานนี้", "ไม่มี"]),
    ("# Head. line\n\nOne\ntwo. Three\r\n\r\n- a. B\n- c\n\n1. x. Y\n2) z\n\n```py\na. B\n\nc\n```\ntail", ["# Head. line", "One\ntwo.", "Three", "- a. B", "- c", "1. x. Y", "2) z", "```py\na. B\n\nc\n```", "tail"]),
    ("```\nnever closed. A\n\nB", ["```\nnever closed. A\n\nB"]),
    ("An open (bracket. Never closed. End", ["An open (bracket.", "Never closed.", "End"]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_units(text, expected):
    assert [text[a:b] for a, b in p9.units(text)] == expected


def test_the_document_decides():
    text = "The zq. value is set. We read the zq. of Foo. Then Foo left and Foo came."
    assert len(p9.units(text)) == 3
    other = "The word is done. Then it ends. A word here."
    assert len(p9.units(other)) == 3


def test_long_text():
    text = "One sentence here. " * 20_000
    assert len(p9.units(text)) == 20_000
    assert len(p9.units("x" * 500_000)) == 1


def test_table_and_corpus(spark):
    rows = [(i, f"Use the qmx. value {i} now. Nothing else ends here.") for i in range(60)] + [(100, None), (101, ""), (102, "He gave qmx. 5 to us. Bye."), (102, "He gave qmx. 5 to us. Bye.")]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id bigint, text string, words string")
    got = sorted(tuple(r) for r in p9.split_documents(df, "doc_id", "text", texts=True).collect() if r.doc_id >= 100)
    assert got == [(102, 1, 1, 21, "He gave qmx. 5 to us."), (102, 1, 1, 21, "He gave qmx. 5 to us."), (102, 2, 23, 26, "Bye."), (102, 2, 23, 26, "Bye.")]
    alone = p9.split_documents(df.filter("doc_id = 102"), "doc_id", "text").select("start_pos").distinct().collect()
    assert sorted(r[0] for r in alone) == [1, 14, 23]
    assert p9.split_documents(df.limit(0), "doc_id", "text").count() == 0


def test_the_document_speaks_before_the_corpus_and_the_lists():
    assert len(p9.units("The answer is no. 12 files remain.")) == 2
    assert len(p9.units("See No. 12 of it. Done.")) == 2
    assert len(p9.units("We count to max. 5 runs are kept.")) == 1
    assert len(p9.units("We know the max of it. We count to max. 5 runs are kept.")) == 3
    assert len(p9.units("We count to max. 5 runs are kept.", plain=frozenset(["max"]))) == 2
    assert len(p9.units("It is qmx. Then it ends.")) == 2 and len(p9.units("It is qmx. Then it ends.", known=frozenset(["qmx"]))) == 1


def test_the_corpus_overrules_the_lists(spark):
    rows = [(i, f"They run on max.\n\nEach day {i} ends with max.\n\nNothing more.") for i in range(30)] + [(100, "It was at max. 12 files remain.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.start_pos for r in p9.split_documents(df, "doc_id", "text").collect() if r.doc_id == 100) == [1, 16]


def test_very_long_words_and_runs():
    text = "x" * 300_000 + ". Next one. " + "a. " * 50_000 + "1" + " " * 50_000 + "2. Z"
    assert len(p9.units(text)) >= 2
