import pytest

from runweave.operators.multivalue import Delimiters, exchanged, given_names, given_words, split_values

PROTECTED = ["Moss & Thread", "Salt, Ash and Bone", "Tide, Tide, Tide", "Vector X", "The And", "With Regards", "Lark vs the Machine", "Vex / Nil"]
GIVEN = ["Thomas", "Marek"]
CASES = {
    "A Bee": ["A Bee"],
    " A Bee feat. Cee ": ["A Bee", "Cee"],
    "A Bee (feat. Cee ft. Dee)": ["A Bee", "Cee", "Dee"],
    "A,B ,C;D/E|F & G+H": ["A", "B", "C", "D", "E", "F", "G", "H"],
    "A // B": ["A", "B"],
    "A x B X C": ["A", "B", "C"],
    "A vs. B vs C b2b D B2B E w/ F": ["A", "B", "C", "D", "E", "F"],
    "A · Bé": ["A", "Bé"],
    "One\nTwo": ["One", "Two"],
    "Moss & Thread": ["Moss & Thread"],
    "moss &  thread & Other": ["moss &  thread", "Other"],
    "Tide, Tide, Tide, Tide One": ["Tide, Tide, Tide", "Tide One"],
    '"Salt, Ash and Bone" & B': ["Salt, Ash and Bone", "B"],
    "'Silk, Smoke' / Don't Stop": ["Silk, Smoke", "Don't Stop"],
    '"Ann ""Big"" Lee" feat. C': ['Ann "Big" Lee', "C"],
    'Ann "Big & Bad" Lee & C': ['Ann "Big & Bad" Lee', "C"],
    'A "open & B': ['A "open', "B"],
    "The And / B": ["The And", "B"],
    "Vector X": ["Vector X"],
    "With Regards with Vector X": ["With Regards", "Vector X"],
    "Derakost, Thomas": ["Derakost, Thomas"],
    "Nosher, R.": ["Nosher, R."],
    "Echo Brothers, The": ["Echo Brothers, The"],
    "Derakost, Thomas Lee": ["Derakost", "Thomas Lee"],
    "A, B, and C": ["A", "B", "C"],
    "Andrew Sandxy Withers": ["Andrew Sandxy Withers"],
    "NAME,": ["NAME"],
    ", ;": [],
    "  ": [],
    "\U0001f680 & 日本": ["\U0001f680", "日本"],
}


def split(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id int, v string, n string")
    got = {}
    for r in sorted(split_values(df, "id", "v", protected=PROTECTED, given=GIVEN, **kw).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.pos, r["name"]))
    return got


def test_cases(spark):
    got = split(spark, list(CASES))
    for i, (text, want) in enumerate(CASES.items()):
        assert got.get(i, []) == [(k + 1, w) for k, w in enumerate(want)], text


def test_repeats_nulls_and_empty(spark):
    got = split(spark, ["A & B", "A & B", None, ""])
    assert got == {0: [(1, "A"), (2, "B")], 1: [(1, "A"), (2, "B")]}
    assert split_values(spark.createDataFrame([], "id int, v string"), "id", "v").count() == 0


def test_least_and_whole(spark):
    texts = ["A & B", "C", "MOSS - & - THREAD", "Mоss & Ｔhread", "Mo\u200bss\u00a0&\u00a0Thread", "Мосс & Тхреад", "Moss & Threads", "É & B"]
    got = split(spark, texts, least=2, whole=PROTECTED)
    assert set(got) == {0, 5, 6, 7}


@pytest.mark.parametrize("key", ["name", "pos", "n", "k", "v"])
def test_clashing_key(spark, key):
    df = spark.createDataFrame([("x", "A & B")], f"{key} string, field string")
    rows = split_values(df, key, "field").collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r[1])] == [("x", 1, 2, "A"), ("x", 2, 2, "B")]


def test_very_long(spark):
    text = " & ".join(f"name {i}" for i in range(100_000))
    got = split_values(spark.createDataFrame([(1, text)], "id int, v string"), "id", "v")
    assert got.count() == 100_000 and got.where("pos = 100000").first()["name"] == "name 99999"


def test_given_names():
    assert given_names(["Ann Lee", "Ann Poe", "Bob Lee", "DJ X1", "Solo"]) == {"ann"}


def test_delimiters_are_a_parameter(spark):
    texts = ["Ａ＆Ｂ", "李，王、張", "A\\B × C • D", "“Bo, Ray” & C", "«Un, Deux», Trois", "„Eins & Zwei“ / Drei", "“Bo, Ray", "A versus B meets C", "A und B"]
    got = split(spark, texts)
    assert [[v for _, v in got[i]] for i in range(len(texts))] == [
        ["Ａ", "Ｂ"], ["李", "王", "張"], ["A", "B", "C", "D"], ["Bo, Ray", "C"], ["Un, Deux", "Trois"], ["Eins & Zwei", "Drei"], ["“Bo", "Ray"], ["A", "B", "C"], ["A und B"],
    ]
    own = Delimiters(symbols=("~",), always=(), between=("und",), quotes=())
    assert [v for _, v in split(spark, ["A und B~C, D"], delimiters=own)[0]] == ["A", "B", "C, D"]


def test_register_of_any_size(spark):
    """300,000 registered names: they are joined, so there is no limit, and only the texts' own stretches meet them."""
    names = spark.range(300_000).selectExpr("concat('Act ', id, ' & The ', id * 7, ' Others') AS name")
    df = spark.createDataFrame([(1, "act 5 & the 35  others"), (2, "Act 299999 & The 2099993 Others / B"), (3, "Act 5 & The 36 Others"), (4, "B & Act 7 & The 49 Others")], "id int, v string")
    got = {}
    for r in split_values(df, "id", "v", protected=names, given=given_words(names), least=2, whole=names).collect():
        got.setdefault(r.id, {})[r.pos] = r["name"]
    assert got == {2: {1: "Act 299999 & The 2099993 Others", 2: "B"}, 3: {1: "Act 5", 2: "The 36 Others"}, 4: {1: "B", 2: "Act 7 & The 49 Others"}}


def test_given_words_of_a_table(spark):
    names = spark.createDataFrame([("Ann Lee",), ("Ann Poe",), ("Bob Lee",), ("DJ X1",), ("Solo",), (None,), ("",)], "name string")
    assert [r["name"] for r in given_words(names).collect()] == ["ann"]
    df = spark.createDataFrame([(1, "Poe, Ann"), (2, "Poe, Bob")], "id int, v string")
    assert {(r.id, r["name"]) for r in split_values(df, "id", "v", given=given_words(names)).collect()} == {(1, "Poe, Ann"), (2, "Poe"), (2, "Bob")}


def test_exchanged_by_the_row_itself(spark):
    names = spark.createDataFrame([("Noor & Co",), ("Solo",), (None,)], "name string")
    rows = [(1, "Quiet, Slow", "noor - & CO"), (2, "Noor & Co", "Solo"), (3, "A, B", "Song"), (4, None, "Solo"), (5, "A, B", None), (6, "A, B", "")]
    got = exchanged(spark.createDataFrame(rows, "id int, a string, t string"), "id", "a", "t", names)
    assert {r.id for r in got.collect()} == {1, 4}


def test_one_text_in_most_rows(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 < 2 THEN 'Moss & Thread & Bo' ELSE concat('Act ', id, ', Bee') END AS v")
    got = split_values(df, "id", "v", protected=PROTECTED, least=2)
    assert got.groupBy("name").count().where("name IN ('Moss & Thread', 'Bo')").agg({"count": "sum"}).first()[0] == 4000
    assert got.count() == 6000
