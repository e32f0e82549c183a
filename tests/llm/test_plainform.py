import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runweave.llm.plainform import changed, normalised, plain_column

CASES = {
    "Plain": "Plain", "Ｆｕｌｌ　ｗｉｄｔｈ": "Full width", "éa": "éa", "a​b﻿": "ab", "no break": "no break", "non‑breaking": "non-breaking",
    "so­ft": "soft", "\U0001d400\U0001d41b\U0001d5a2": "AbC", "ﬁshﬆ": "fishst", "Аndrew Вlеhain": "Andrew Blehain", "Qυiet Memοry": "Quiet Memory", "Северный Шум": "Северный Шум",
    "Cеверный Шум": "Северный Шум", "Μικρό Λιμάνι": "Μικρό Λιμάνι", "Vectοr Χ": "Vector X", "Ѕоса": "Soca", "👩‍🚀 x": "👩‍🚀 x", "🏳️‍🌈": "🏳️‍🌈", "☀️": "☀️",
    "a‍": "a", "はな": "はな", "ﾊﾟ": "パ", "단": "단", "Ångström": "Ångström", "tab\there": "tab\there", "ộ": "ộ", "ộ": "ộ", "": "",
    "́": "́", "Joubrorn Живая Глина": "Joubrorn Живая Глина", "می‌خواهم": "می‌خواهم",
}


def test_cases():
    got = plain_column(pa.array(list(CASES), pa.string()))[0].to_pylist()
    assert got == list(CASES.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8", exclude_categories=["Cs"]), st.sampled_from("aeoаеοẹ́̂‍Α가각"))), max_size=8))
def test_settled_and_composed(texts):
    once = plain_column(pa.array(texts, pa.string()))[0].to_pylist()
    assert plain_column(pa.array(once, pa.string()))[0].to_pylist() == once
    assert [unicodedata.normalize("NFC", x) for x in once] == once
    # Rows do not touch one another.
    assert [plain_column(pa.array([t], pa.string()))[0].to_pylist()[0] for t in texts] == once


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcéàüñ ̧̣́̀̈̄aeiou가각한"), min_size=1, max_size=6))
def test_composition_is_nfc(texts):
    assert plain_column(pa.array(texts, pa.string()))[0].to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_nulls_slices_and_bad_bytes():
    col = pa.array([None, "x", "ａ", None, "ｂ"], pa.string())
    assert plain_column(col)[0].to_pylist() == [None, "x", "a", None, "b"]
    assert plain_column(col.slice(2, 3))[0].to_pylist() == ["a", None, "b"]
    assert plain_column(col.slice(0, 0))[0].to_pylist() == []
    bad = pa.StringArray.from_buffers(2, pa.array([0, 2, 4], pa.int32()).buffers()[1], pa.py_buffer(b"\xff\xfeab"))
    assert plain_column(bad)[0].to_pylist() == ["��", "ab"]


def test_long_text():
    text = "ａ" * 400_000 + "é" * 100_000
    assert plain_column(pa.array([text], pa.string()))[0].to_pylist() == ["a" * 400_000 + "é" * 100_000]


@pytest.mark.parametrize("key", ["id", "plain", "k", "f0"])
def test_changed_with_clashing_names(spark, key):
    df = spark.createDataFrame([(1, "ａ", "x", "b"), (1, "ａ", "x", "b"), (2, None, "", "c d"), (None, "ok", "ok", "ok")], f"{key} int, t string, original string, u string")
    got = sorted(map(tuple, changed(df, key, ["t", "u"]).collect()))
    assert got == [(1, "t", "ａ", "a"), (1, "t", "ａ", "a"), (2, "u", "c d", "c d")]
    assert changed(df.limit(0), key, ["t"]).count() == 0


def test_normalised_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "ａ", [1]), (2, None, None)], "id int, t string, plain array<int>")
    assert sorted(map(tuple, normalised(df, ["t"]).collect())) == [(1, "a", [1]), (2, None, None)]


def test_invisible_signs_by_rule():
    cases = {"a\U000e0041b": "ab", "a︀b": "ab", "a⁪b": "ab", "aㅤb": "ab", "a￹b": "ab", "a\U0001d173b": "ab", "a᠎b": "ab", "x\U000e0100": "x", "؀١": "؀١"}
    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0073\U000e0063\U000e0074\U000e007f"
    cases[flag] = flag
    cases[f"{flag}a\U000e0067"] = f"{flag}a"
    assert plain_column(pa.array(list(cases), pa.string()))[0].to_pylist() == list(cases.values())
