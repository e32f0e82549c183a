import pytest
from pyspark.sql import functions as F

from runweave.llm.variants import credit, resolve, rewritings, sound, tokens

REGISTER = [
    (1, "Nicholas Zailewol"), (2, "The Slow Station Quartet"), (3, "DJ Huthasear"), (4, 'Edward "Tunnel" Flavupalks'), (5, "Electric Harbour Radio"), (6, "Edward Prealucrex"), (7, "Elizabeth Prealucrex"),
    (8, "Séréna Voulzé"), (9, "Moss and Thread"), (10, "Retrehiv 84"), (11, "Günther Öhlmark"), (12, "Zoupopougra"), (13, "Белый Дым"), (None, "Nobody Atall"), (14, None), (1, "Nicholas Zailewol"),
]
TYPED = {
    "Nick Zailewol": (1, "nickname"), "Zailewol, Nicholas": (1, "order"), "N. Zailewol": (1, "initial"), "Zailewol, N.": (1, "initial"), "DJ Nicholas Zailewol": (1, "prefix"), "Nicholas Zailwol": (1, "slip"), "Nicholas Zialewol": (1, "slip"),
    "Slow Station Qtet": (2, "legal form"), "Slow Station Quartet, The": (2, "order"), "Slow Station Quartet": (2, "article"), "Huthasear (DJ)": (3, "order"), "Huthasaer, DJ": (3, "slip"), "Slwo Station Quartet, The": (2, "slip"), "Edward Flavupalks": (4, "middle"), "Elektric Harbour Radio": (5, "sound"),
    "Serena Voulze": (8, "accents"), "Guenther Oehlmark": (11, "accents"), "Moss Thread": (9, "ampersand"), "Zoupopougrra": (12, "sound"), "Ed Prealucrex": (6, "nickname"), "Beth Prealucrex": (7, "nickname"), "N. Zialewol": (1, "slip"),
}
NOT = ["Nicholas Zailewol", "NICHOLAS-ZAILEWOL", "Nісholas Zailewol", "E. Prealucrex", "Retrehiv 85", "Someone Else", "M. Zailewol", "", None, "...", "Nobody Attall", "Белый Дым", "Mick Zailewol"]


def test_cases(spark):
    typed = spark.createDataFrame([(x, 1) for x in [*TYPED, *NOT, *TYPED]], "name string, id int")
    register = spark.createDataFrame([(i, n, "x") for i, n in REGISTER], "id int, name string, form string")
    rows = resolve(typed, register).collect()
    assert {r["name"]: (r.id, r.rule) for r in rows} == TYPED
    assert len(rows) == len(TYPED)


def test_empty_and_long(spark):
    typed, register = spark.createDataFrame([("x" * 100_000,)], "name string"), spark.createDataFrame([(1, "y" * 100_000)], "id int, name string")
    assert resolve(typed, register).count() == 0
    assert resolve(typed.limit(0), register).count() == 0 and resolve(typed, register.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for _, n in REGISTER if n])
def test_forms_hold_the_name_itself(name):
    forms = rewritings(name)
    assert ("".join(tokens(name)), 0) in {(f, c) for f, _, _, c in forms} and len({f for f, *_ in forms}) == len(forms)


def test_sound():
    assert sound("piskiemir") == sound("piskymir") and sound("skoquaihum") == sound("skokwaihum") and sound("abc") != sound("abd")


def test_credit(spark):
    cases = {
        "T (Ann Lee Remix)": "Ann Lee", "T [Ann Lee Extended Mix]": "Ann Lee", "T (Live) (The Band Rework) -": "The Band", "T (Remixed by Ann)": "Ann", "T (Ann Lee)": None, "T": None, "(Ann Edit) T": None, "": None, None: None,
        "T（Ａｎｎ Dub）": "Ａｎｎ", "T (Remix)": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.c for r in df.select("i", credit(F.col("t")).alias("c")).orderBy("i").collect()] == list(cases.values())


def found(spark, register, typed, **kw):
    r = spark.createDataFrame(list(enumerate(register)), "id int, name string")
    t = spark.createDataFrame([(x,) for x in typed], "name string")
    return {x["name"]: (x.id, x.rule) for x in resolve(t, r, **kw).collect()}


def test_short_names_that_no_list_holds(spark):
    """Names of our own outside the tables: short forms that stand for one word often enough are learned, others come by rule."""
    surnames = ["Quiroga", "Belmonte", "Valdivia", "Zamorano", "Etxeberria"]
    others = ["Lombardo", "Ferrante", "Castelli", "Moretti", "Santoro"]
    register = [f"Francisco {s}" for s in surnames] + [f"Giuseppe {s}" for s in others] + ["Wolfgang Ossietz", "Anna Maria Rossi", "Mary Louise Ann Parker", "Foo Records", "Bar Records", "Baz Records"]
    typed = [f"Paco {s}" for s in surnames[:4]] + [f"Beppe {s}" for s in others[1:]] + ["Wolfi Ossietz", "A. M. Rossi", "Rossi, A. M.", "Parker, Mary Louise Ann", "M. L. A. Parker", "Mary Louise Parker", "Foo Recs", "Bar Recs", "Baz Recs"]
    got = found(spark, register, typed)
    assert all(got[f"Paco {s}"] == (i, "learned") for i, s in enumerate(surnames[:4]))
    assert all(got[f"Beppe {s}"] == (6 + i, "learned") for i, s in enumerate(others[1:]))
    assert got["Wolfi Ossietz"] == (10, "nickname") and got["A. M. Rossi"] == (11, "initial") and got["Rossi, A. M."] == (11, "initial")
    assert got["Parker, Mary Louise Ann"] == (12, "order") and got["M. L. A. Parker"] == (12, "initial")
    assert [got[f"{x} Recs"] for x in ("Foo", "Bar", "Baz")] == [(13, "learned"), (14, "learned"), (15, "learned")]


def test_words_of_the_register_are_not_learned(spark):
    """Other acts share all words but one, too: a word that the register knows, or that stands beside several words alike, is none."""
    nouns = ["Lantern", "Harbour", "Meadow", "Skyline"]
    register = [f"Hollow {n}" for n in nouns] + [f"Crooked {n}" for n in nouns] + ["Verdant Oak"]
    got = found(spark, register, [f"Verdant {n}" for n in nouns] + [f"Sombre {n}" for n in nouns])
    assert got == {}


@pytest.mark.parametrize("length", [5, 70, 300])
def test_slips_at_any_length(spark, length):
    name = "".join(chr(97 + (k * k * 7 + 3 * k) % 26) for k in range(length))
    for at in (1, length // 2 - 1, length // 2, length - 2):
        variants = [name[:at] + name[at + 1 :], name[:at] + "z" + name[at:], name[:at] + name[at + 1] + name[at] + name[at + 2 :]]
        got = found(spark, [name], [v for v in variants if v != name])
        assert all(got.get(v) == (0, "slip") for v in variants if v != name), at
        if length > 5:
            break
    assert found(spark, [name], ["z" + name[1:2] + "q" + name[3:]]) == {}


def test_short_forms_keep_their_first_letter(spark):
    assert found(spark, ["Elin", "Abc"], ["Elinn", "Olin", "Elim", "Abd", "Ab"]) == {"Elinn": (0, "slip"), "Elim": (0, "slip")}


def test_rarity_counts_both_sides(spark):
    """A form that many names give scores less than one that few give."""
    r = spark.createDataFrame([(1, "Anton Veljanov"), (2, "Maria Quist")], "id int, name string")
    t = spark.createDataFrame([(x,) for x in ["M. Quist", "M Quist", "M.Quist", "m. quist", "A. Veljanov"]], "name string")
    score = {x["name"]: x.score for x in resolve(t, r).collect()}
    assert len(score) == 5 and score["A. Veljanov"] > score["M. Quist"] == score["m. quist"]
