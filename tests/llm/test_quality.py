import numpy as np
import pyarrow as pa

from runweave.llm.quality import NAMES, divergence, measure, statistics

PROSE = {
    "en": "The page lists some of the tracks that were played on that night, and it helps to write down the time of every one before you open the editor. Nobody in the room knew why the sound had stopped, yet all of them waited for it.",
    "de": "Die Aufnahme wurde in kurze Abschnitte geteilt, damit jedes Lied erkannt werden konnte. Nach dem ersten Teil war der Raum still, weil der Verstärker ausgefallen war, und niemand wollte gehen.",
    "es": "Para el archivo quitamos los silencios y ajustamos el volumen con cuidado. Nadie sabía quién había traído aquel disco, pero todos lo esperaban en la sala hasta que terminó la noche.",
    "fr": "Le logiciel n'a pas trouvé le nom du morceau parce que la voix était trop basse. Personne ne savait qui avait apporté ce disque, mais tout le monde l'attendait dans la salle.",
}
JUNK = {
    "table": "| # | artist | title | bpm |\n|---|---|---|---|\n" + "\n".join(f"| {i} | Ann Lee | Some Song | {100 + i} |" for i in range(12)),
    "log": "\n".join(f"[0:{i:02d}] INFO sample {i} matched {i}ms" for i in range(30)),
    "encoded": "\n".join("xK3v9Qz/AbC7dEf2GhI5jKl8MnOpQ+RsTuVw1XyZ0aBcDeF4gH6iJ" for _ in range(8)),
    "signs": "\n".join(("=" * 30, "*" * 25, "~-" * 14, "#" * 40)),
    "keywords": " ".join("free download mix house techno best live full hq dj set 2025".split() * 6),
    "names": ", ".join(f"{a} {b}" for a in ("Ann", "Bob", "Cid") for b in ("Lee", "Poe", "Roe", "Doe", "Moe")) + ".",
    "navigation": "\n".join("Home Login About Share Cart Archive Sitemap".split() * 5),
    "shuffled": "is as with tower the of market that on was river is and harbour on shadow the was mirror the in on for glacier was the in with it to is that of",
    "repeated": "\n".join(["LE LOGIC..."] * 20),
    "json": "[" + ",".join(f'{{"timestamp":{i},"artist":"A{i}","title":"B","rejected":false}}' for i in range(15)) + "]",
}


def junk(texts):
    m = measure(pa.array(texts, pa.string()))
    return ((m["prose_share"] < 0.5) | (m["repeated_chars"] > 0.5)).tolist(), m


def test_prose_and_junk():
    texts = [*PROSE.values(), *(p.lower().replace(",", "").replace(".", "") for p in PROSE.values()), *JUNK.values()]
    got, m = junk(texts)
    assert got == [False] * 8 + [True] * len(JUNK)
    assert [NAMES[p] for p in m["profile"][:4]] == [f"prose {x}" for x in PROSE]


def test_more_than_half_decides():
    prose = PROSE["en"]
    assert junk([prose * 3 + "\n\n" + JUNK["table"], prose + "\n\n" + JUNK["table"] * 3, prose.replace(" ", "\n", 8)])[0] == [False, True, False]


def test_counts():
    m = measure(pa.array(["One two, three.\n\nFour 55!\nfive", "", None, "ab\nab\nab"], pa.string()))
    assert m["n_words"].tolist() == [6, 0, 0, 3] and m["n_lines"].tolist() == [3, 0, 0, 3] and m["n_chars"].tolist() == [30, 0, 0, 8]
    assert m["word_length"][0] == (3 + 3 + 5 + 4 + 2 + 4) / 6 and m["closed_lines"][0] == 2 / 3 and round(m["repeated_lines"][3], 6) == round(2 / 3, 6)
    assert m["profile"].tolist()[1:3] == [-1, -1]


def test_rows_do_not_touch():
    texts = [*PROSE.values(), "", *JUNK.values(), None, *PROSE.values()]
    whole = measure(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        one = measure(pa.array([t], pa.string()))
        assert all(np.isclose(one[k][0], whole[k][i]) for k in one), i


def test_statistics(spark):
    rows = [(1, PROSE["en"], "x"), (1, PROSE["en"], "x"), (2, None, None), (3, "", "x"), (None, JUNK["log"], "x"), (4, "word " * 300_000, "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, profile string")
    got = statistics(df, "id", "text").collect()
    by = {r.id: r for r in got}
    assert len(got) == 6 and by[None].not_prose and not by[1].not_prose and not by[2].not_prose and by[2].prose_share is None and by[3].profile == "empty" and by[4].not_prose and by[4].n_words == 300_000
    assert statistics(df.limit(0), "id", "text").count() == 0


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    d = divergence(p, p)
    assert np.allclose(np.diag(d), 0) and 0 < d[0, 1] < 1 and np.allclose(d, d.T) and np.isclose(divergence(np.array([[1.0, 0]]), np.array([[0.0, 1]]))[0, 0], 1)
