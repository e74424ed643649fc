import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentences import sentences, split_sentences


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


@pytest.mark.parametrize("text", [
    "It is 3.5 of 7. | Dr. Who came at 5 p.m. local time.", "We met J. R. Smith et al. in Jan. 2020. | Fine!", 'She said "No. Stop it." and left. | He stayed.', 'She said "Stop it." | He stayed.',
    "See fig. 3, p. 11, of vol. 2. | (It is old.) | Done.", "He works at Foo Inc. | We know.", "It starts at 5 a.m. | As said.", "e.g. the one in a.txt works. | iFoo is next.", "Wait... it works. | Good?! | Yes...",
    "Am 1. Mai war z. B. alles gut, vgl. Kap. 3. | Die Datei „a. Bitte warten.“ steht da. | Ende.", "M. Dupont dit « Absent. Essayez. » chaque nuit. | L'entrée n° 12 est lue...", "C'est vers 9 h. | M. Dupont arrive.",
    "Según la Sra. Gil, p. ej. con x. | ¿Qué? | ¡Hola!", "EE. UU. y otros.", "Это было в 2026 г. на сервере. | Удалите и т. д. по списку! | См. рис. 3.", "ログには「開けません。再試行します。」と出ます。|本当ですか！？|はい。",
    "日志里写着“无法打开。请稍后。”然后没有了。|真的吗？！|我不太明白……|好。", '로그에 "열 수 없습니다. 다시 하세요." 라고 나옵니다. | abc 모듈은 읽습니다.', 'लॉग में "नहीं मिली। फिर करें।" लिखा है। | abc मॉड्यूल पढ़ता है। | डॉ. Who की सलाह।',
    "الرسالة «لا توجد. انتظر.» تظهر. | لماذا؟ | يقول د. Who إن.", "ต้องลบก่อน แล้วเริ่มใหม่ครับ | ขอบคุณค่ะ", "It works 🙂! | Next one.", "Set it to No. 35 now. | run.cfg() is fine.", "y = 9.9. | foo.bar_x is next.",
])
def test_sentences(text):
    want = [x.strip() for x in text.split("|")]
    assert cut(text.replace("|", "")) == want


@pytest.mark.parametrize("text,want", [
    ("Hi all,\nIt works. Thanks\n\nBye", ["Hi all,", "It works.", "Thanks", "Bye"]), ("a.\r\n  B c.\r\n", ["a.", "B c."]), ("```py\nx = 1. Y\n\nz\n```\nDone. ", ["```py\nx = 1. Y\n\nz\n```", "Done."]),
    ("```\nopen. No end\n", ["```\nopen. No end"]), ("Look:\n    a = 1. B\n      c\nend", ["Look:", "a = 1. B\n      c", "end"]), ("- one. Two\n* three\n1. four. Five\n> quoted. Line", ["- one. Two", "* three", "1. four. Five", "> quoted. Line"]),
    ("", []), (None, []), (" \n\t ", []), (".", ["."]), ("( open. Bracket", ["( open.", "Bracket"]),
])
def test_blocks_and_edges(text, want):
    assert cut(text) == want


@settings(max_examples=300, deadline=None)
@given(st.text("aB.!?。\"“”(）\n -`>1ค", max_size=60))
def test_units_are_ordered_trimmed_and_complete(text):
    spans, last = list(sentences(text)), 0
    for a, b in spans:
        assert last <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        assert text[last:a].strip() == ""
        last = b
    assert text[last:].strip() == ""


def test_table(spark):
    rows = [(1, "A b. C d.", 5), (1, "A b. C d.", 5), (2, None, None), (3, "", None), (4, "x " * 200_000, None), (None, "Hi.", None), (5, "🙂 a. B.", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_pos bigint")
    got = split_sentences(df).collect()
    assert sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in got) == [(0, 0, 3), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 399_999), (5, 0, 4), (5, 5, 7)]
    assert split_sentences(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["It is old.|The next one. |Is it?|Yes it is.", "See Node.Js there.", 'She said "No, do it first."|なぜですか？|はい。', "We got 17 runs.|voskの列はどこですか？", "なぜsetup.iniが消えるのですか？", "It is a cache.|Спасибо, всё работает."])
def test_missing_blanks(text):
    assert cut(text.replace("|", "")) == [x.strip() for x in text.split("|")]


@pytest.mark.parametrize("mark", ["\u0f0d", "\u0f0e", "\u1367", "\u1803", "\u1362", "\u0964", "\u104b"])
def test_script_ends(mark):
    letter = {"\u0f0d": "\u0f40", "\u0f0e": "\u0f40", "\u1367": "\u1210", "\u1803": "\u1820", "\u1362": "\u1210", "\u0964": "\u0915", "\u104b": "\u1000"}[mark]
    assert cut(f"{letter * 3}{mark} {letter * 2}{mark}") == [letter * 3 + mark, letter * 2 + mark]


@pytest.mark.parametrize("text", ["Das gilt z. B. tar.gz und i. d. R. auch foo_bar. | So ist es.", "Это диск, т. е. старый том. | Да и т. д. по списку.", "See e. g. old_mirror and i. e. this. | Fine.", "He saw it at the U. N. yesterday. | Fine."])
def test_abbreviations_in_parts(text):
    assert cut(text.replace("|", "")) == [x.strip() for x in text.split("|")]


UNITS = ["It is e.g. the one of 3.5 and Dr. Who came. ", "a.b.c.", "((", "(a. b)", '"x. ', "日本語。「あ。」x.y", "foo.Bar", "(“«[", "abc! def ", ".    ", "12.", "(a. B ", "日x.Yab ", "x"]


@pytest.mark.parametrize("unit", [*UNITS, None])
def test_a_long_line_takes_time_by_its_length(unit):
    size = 2_000_000
    text = "(" * 400_000 + "a. B" + ")" * 400_000 if unit is None else (unit * (size // len(unit) + 1))[:size]
    began = time.process_time()
    found = list(sentences(text))
    # quadratic work would take hours
    assert time.process_time() - began < 60 and found[0][0] == 0 and found[-1][1] == len(text.rstrip())
