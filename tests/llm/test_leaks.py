import random

import numpy as np
import pytest

from runweave.llm.fmindex import FMIndex, suffix_array
from runweave.llm.leaks import leaks, prepared, words

ITEMS = {
    1: "Answer using the text. The drone known as Quojomeax was first interrupted at 123 beats in Dafoklom although the Hezigoush logbook gives a different ladder and nobody ever asked the keeper why it hung there",
    2: "Answer using the text. Because Thenapos had rebuilt the arpeggio in one long sweep the jury of Klewieskert counted 58 faults and blamed the Zouthatrilk amplifier for most of them until morning came",
    3: "Answer using the text. Without the Kleakoukloth preamp no lighting operator in Rodroblel could have flooded the spectral drone that Proufihex wanted for the last transition of that long and rainy night",
    4: "short one",
}


def body(i):
    return ITEMS[i].split(". ", 1)[-1]


DOCS = {
    "whole": ("intro words here. " + body(1) + " and an end", {1}),
    "layout": ("* " + body(2).upper().replace(" ", "\n").replace("58", "<b>58</b>"), {2}),
    "changed": (body(3).replace("lighting", "sound").replace("wanted", "hoped").replace("rainy", "windy"), {3}),
    "missing and added": (body(1).replace("first ", "").replace("logbook", "big logbook"), {1}),
    "part": (" ".join(body(1).split()[5:27]), {1}),
    "too short": (" ".join(body(1).split()[5:15]), set()),
    "pattern": ("The bass known as Abcdef was first softened at 99 beats in Ghijkl although the Mnopqr logbook gives a different window and somebody once asked", set()),
    "two": (body(1) + " " + body(2), {1, 2}),
    "instruction": ("Answer using the text. Something else entirely follows here, of no interest to anybody at all today", set()),
    "both ends": (body(3) + " filler " * 50 + body(3), {3}),
    "null": (None, set()), "empty": ("", set()), "signs": ("--- *** <b></b>", set()),
    "long": ("lorem ipsum dolor " * 60_000 + body(2), {2}),
}


def test_cases(spark):
    df = spark.createDataFrame([(k, t, 5) for k, (t, _) in DOCS.items()], "id string, text string, item_id int")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS.items()] + [(9, None, "x"), (None, "a b", "x"), (10, "", "x")], "item_id bigint, text string, matched string")
    rows = leaks(df, "id", "text", items).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.item_id)
    assert got == {k: v for k, (_, v) in DOCS.items() if v}
    ends = [r for r in rows if r.id == "both ends"]
    assert len(ends) == 2
    for r in rows:
        if r.id in ("whole", "layout"):
            text = DOCS[r.id][0]
            assert words(text[r.begin : r.end]) == words(body(r.item_id))


def test_small_shards_and_repeats(spark):
    df = spark.createDataFrame([(i, DOCS["whole"][0]) for i in range(7)], "id int, text string").coalesce(1)
    items = spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")
    a = sorted(map(tuple, leaks(df, "id", "text", items, shard_words=40).collect()))
    assert a == sorted(map(tuple, leaks(df, "id", "text", items).collect())) and len(a) == 7
    assert leaks(df.limit(0), "id", "text", items).count() == 0 and leaks(df, "id", "text", items.limit(0)).count() == 0
    assert a == sorted(map(tuple, leaks(df, "id", "text", items, block=1).collect()))


def bodies(spark, texts):
    return {r.item_id: r for r in prepared(spark.createDataFrame(list(texts.items()), "item_id int, text string")).collect()}


def test_instructions(spark):
    got = bodies(spark, {i: t for i, t in ITEMS.items() if i < 4})
    assert got[1].words[:3] == ["the", "drone", "known"] and got[2].words[0] == "because"
    assert bodies(spark, {1: "A b. c d", 2: "A b. e f"})[1].words == ["a", "b", "c", "d"]
    twice = bodies(spark, {i: f"Read this. Then that. Body number {i} here" for i in range(3)})
    assert twice[2].words == ["body", "number", "2", "here"] and sorted(twice[2].own) == [0, 1]


def planted(spark, rnd, passages, length, change, n=60):
    """Share of stretches found, each changed by ``change``, in a document of other words."""
    docs = []
    for k in range(n):
        i = rnd.randrange(len(passages))
        p = passages[i]
        at = rnd.randrange(len(p) - length + 1)
        noise = [f"n{rnd.randrange(500)}" for _ in range(80)]
        docs.append((k, " ".join(noise[:40] + change(p[at : at + length]) + noise[40:]), i))
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id int, text string")
    found = {(r.id, r.item_id) for r in leaks(spark.createDataFrame([d[:2] for d in docs], "id int, text string"), "id", "text", items).collect()}
    return sum((k, i) in found for k, _, i in docs) / n


def one_in_eight(rnd):
    def change(ws):
        ws = list(ws)
        for at in sorted(rnd.sample(range(1, len(ws) - 1), round(len(ws) / 8)), reverse=True):
            ws[at : at + 1] = rnd.choice([[], ["other"], [ws[at], "more"]])
        return ws

    return change


def test_passages_of_few_words(spark):
    """Passages from 60 common words with three scarce ones each: stretches with just these changed, and with changes anywhere."""
    rnd = random.Random(5)
    common = [f"w{k}" for k in range(60)]
    passages = []
    for k in range(40):
        p = [rnd.choice(common) for _ in range(40)]
        for j, at in enumerate((12, 18, 26)):
            p[at] = f"scarce{k}x{j}"
        passages.append(p)
    swap = lambda ws: [w if not w.startswith("scarce") else "other" for w in ws]
    assert planted(spark, rnd, [p[8:30] for p in passages], 22, swap) == 1
    assert planted(spark, rnd, passages, 20, one_in_eight(rnd)) >= 0.95


def test_passages_of_many_words(spark):
    rnd = random.Random(6)
    passages = [[f"w{int(2000 * rnd.random() ** 2)}" for _ in range(60)] for _ in range(40)]
    assert planted(spark, rnd, passages, 20, one_in_eight(rnd)) >= 0.95
    assert planted(spark, rnd, passages, 13, lambda ws: ws) == 0


def test_patterns_are_no_passages(spark):
    """Documents that fill a pattern of many passages with other words."""
    rnd = random.Random(7)
    name = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(4))
    make = lambda: f"{name()} claimed that {rnd.randrange(10, 99)} of the {name()} samples kept in the {name()} tunnel had been {name()} for no clear reason by a label owner named {name()}"
    texts = [make() for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([(k, make()) for k in range(200)] + [(1000, texts[3]), (1001, "Said " + texts[4].replace("kept", "left").replace("clear", "good"))], "id int, text string")
    assert {(r.id, r.item_id) for r in leaks(docs, "id", "text", items).collect()} == {(1000, 3), (1001, 4)}


def test_any_number_of_passages(spark):
    """25,000 passages in blocks, none of which is ever on the driver with another."""
    rnd = random.Random(8)
    texts = [" ".join(f"w{rnd.randrange(30_000)}" for _ in range(24)) for _ in range(25_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id int, text string")
    docs = spark.createDataFrame([(k, f"so {texts[k]} then") for k in (0, 9_999, 24_999)] + [(7, "nothing")], "id int, text string")
    assert {(r.id, r.item_id) for r in leaks(docs, "id", "text", items, block=9_000).collect()} == {(0, 0), (9_999, 9_999), (24_999, 24_999)}


@pytest.mark.parametrize("seed", range(8))
def test_index_against_brute_force(seed):
    rnd = random.Random(seed)
    v, n = rnd.choice([(2, 60), (5, 400), (300, 3000)])
    text = np.array([rnd.randrange(1, v + 1) for _ in range(n)] * rnd.choice([1, 2]) + [0])
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = FMIndex(text, sample=rnd.choice([1, 3, 16]))
    k = rnd.choice([1, 2, 4])
    phrases = np.array([text[i : i + k] for i in (rnd.randrange(n - k) for _ in range(30))] + [[v + 5] * k])
    lo, hi = index.search(phrases)
    phrase, at = index.locate(lo, hi)
    got = {(p, a) for p, a in zip(phrase.tolist(), at.tolist())}
    assert len(got) == len(at)
    assert got == {(p, i) for p, x in enumerate(phrases.tolist()) for i in range(len(text) - k + 1) if text[i : i + k].tolist() == x}


def test_changes_near_the_ends(spark):
    w = body(1).split()
    cut = ["other" if k in (1, 18) else x for k, x in enumerate(w[4:24])]
    df = spark.createDataFrame([(1, "before it " + " ".join(cut) + " after it"), (2, "before it " + " ".join(w[4:20]) + " after it")], "id int, text string")
    items = spark.createDataFrame(list(ITEMS.items()), "item_id bigint, text string")
    assert [(r.id, r.item_id) for r in leaks(df, "id", "text", items).collect()] == [(1, 1)]


def test_a_stretch_after_many_repeats(spark):
    item = [f"w{k}" for k in range(69)]
    repeats, stretch = item[:10] * 40, item[30:55]
    docs = {
        "after": repeats + stretch, "before": stretch + repeats, "between": repeats + stretch + repeats, "alone": repeats,
        "both": item[30:55] + repeats + item[40:65], "joined": item[:15] + item[29:54] + item[:10] * 9,
    }
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "id string, text string")
    rows = leaks(df, "id", "text", spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    got = sorted((r.id, r.first_word, r.last_word) for r in rows)
    assert got == [("after", 400, 424), ("before", 0, 24), ("between", 400, 424), ("both", 0, 24), ("both", 425, 449), ("joined", 15, 39)]
