import unicodedata

import pytest

from glyphmill.llm import forms
from glyphmill.llm.lookalike import SpellingTrie, canonical_columns, canonical_text, same_looking, vocabulary


@pytest.mark.parametrize(("typed", "shown"), [
    ("ȝ ʿ i̓ i҆", "ꜣ ꜥ ꞽ ꞽ"), ("ｔ．ｗ", "t.w"), ("h̲ ẖ h​̲", "ẖ ẖ ẖ"), ("𝗍𝚠", "tw"), ("ԝһѕурԁԛі", "whsypdqi"), ("a b　c d", "a b c d"),
    ("s­﻿t", "st"), ("s̲", "s̱"), ("i̯", "i̯"), ("⸗f", "⸗f"), ("꞊f", "=f"), ("ḥ ≠ h\t\n x", "ḥ ≠ h\t\n x"), ("", ""), (None, None), ("Ȝ I̓", "Ꜣ Ꞽ"),
])
def test_consistent(typed, shown):
    assert forms.consistent(typed) == shown


def test_comparison():
    assert forms.comparison("  SMꞼK H̱.t = [ꜣ] 3") == "smꞽkẖtꜣ3"
    assert forms.comparison(None) == forms.comparison(" .=-") == ""
    assert forms.payload_form('{"b": "X.", "a" : ""}') == forms.payload_form('{"a":" ","b":"x"}') != forms.payload_form('{"b":"x"}')
    assert forms.payload_form("{}") == forms.payload_form("") == "" and forms.payload_form("no json") == "text\x1fnojson"
    assert forms.sign_terms("𓀀\U00013430𓀁 <g>Z1</g>𓀂") == ["𓀀𓀁", "𓀂"] and forms.sign_string("x𓀀 𓀁\U00013430") == "𓀀𓀁"


def test_trie_reaches_the_same_spellings():
    words = ["ꞽw", "ẖr", "ḥtp", "n.t", "sḏm", "i̯", "šps", "=f", "Ꞽmn"]
    trie = SpellingTrie(words)
    typed = ["i̓w", "i҆w", "һ̲r", "ｈ̣tp", "ո.t", "s​d̲m", "і̯", "ѕ̌ps", "꞊f", "I̓mn", "unknown", "s", ""]
    for t in typed:
        assert trie.spelling(t) in (None, forms.consistent(t))
    assert [trie.spelling(t) for t in typed[:10]] == ["ꞽw", "ꞽw", "ẖr", "ḥtp", "n.t", "sḏm", "i̯", "šps", "=f", "Ꞽmn"] and trie.spelling("unknown") is None
    text = " i̓w һ̲r \n un­known"
    assert canonical_text(text, trie, {}) == forms.consistent(text)
    assert unicodedata.is_normalized("NFC", canonical_text(text, trie, {}))


def test_same_looking(spark):
    e = spark.createDataFrame([(1, "ꞽw ḥr", "x"), (2, None, "x"), (3, "sḏm", "x"), (4, "", "x")], "id long, transliteration_gold string, typed string")
    a = spark.createDataFrame([(10, 1, "i̓w ḥr"), (11, 1, "ꞽw ḥr"), (12, 1, "ꞽw hr"), (13, 2, "x"), (14, 3, "sd̲m"), (15, 3, None), (16, 9, "a"), (17, 1, "i̓w ḥr"), (18, 4, " ")], "id long, example_id long, transliteration string")
    want = {(1, 10), (3, 14), (1, 17)}
    assert {(r.example_id, r.annotation_id) for r in same_looking(a, e).collect()} == want
    assert {(r.example_id, r.annotation_id) for r in same_looking(a, e, 0).collect()} == want
    assert same_looking(a.limit(0), e).count() == 0
    assert vocabulary(e, "transliteration_gold", 2) == [] and vocabulary(e, "transliteration_gold", 3) == ["sḏm", "ḥr", "ꞽw"]
    assert {r.typed_form for r in canonical_columns(a.select(a.transliteration.alias("typed")), ["typed"], []).collect()} >= {None, "ꞽw ḥr"}
