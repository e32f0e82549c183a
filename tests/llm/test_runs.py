import random

import pytest

from runweave.llm import runs as module
from runweave.llm.names import within
from runweave.llm.runs import Same, runs

SCHEMA = "seq string, idx bigint, ts bigint, artist string, title string, received int, block int, n string"


def table(spark, rows):
    return spark.createDataFrame([(s, i, None if i is None else i * 30, a, t, r, 1, "x") for s, i, a, t, r in rows], SCHEMA)


def collapsed(spark, rows, **kw):
    return sorted((r.seq, r.first_ts, r.last_ts, r.n, r.artist, r.title) for r in runs(table(spark, rows), **kw).collect())


def brute(rows, same):
    best = {}
    for s, i, a, t, r in rows:
        if s is not None and i is not None:
            best[(s, i)] = max(best.get((s, i), (-1, "", "")), (r, a or "", t or ""))
    out = []
    for (s, i), (_, a, t) in sorted(best.items()):
        if not a and not t:
            continue
        if out and out[-1][0] == s and same(out[-1][3], (a, t)):
            out[-1][2], out[-1][3], out[-1][4] = i, (a, t), out[-1][4] + 1
        else:
            out.append([s, i, i, (a, t), 1, (a, t)])
    return sorted((s, a * 30, b * 30, n, *first) for s, a, b, _, n, first in out)


@pytest.mark.parametrize("width", [1, 2, 7, 4096])
def test_against_a_plain_scan(spark, width):
    rnd = random.Random(11)
    titles = ["One Two", "one two", "One Tow", "Other", "Other (Live)", "Pt. 1", "Pt. 2", "", None]
    rows = []
    for s in range(12):
        t = "One Two"
        for i in range(rnd.randrange(1, 60)):
            if rnd.random() < 0.3:
                t = rnd.choice(titles)
            if rnd.random() < 0.9:
                rows.append((f"s{s}", i, "" if not t else "A", t, 1))
            if rnd.random() < 0.1:
                rows.append((f"s{s}", i, "A", "late", 2))
    rows += [(None, 1, "a", "b", 1), ("s0", None, "a", "b", 1)] + rows[:20]
    rnd.shuffle(rows)
    assert collapsed(spark, rows, width=width) == brute(rows, Same(2))


SAME = {
    ("One Two", "one-two"): True, ("Hidden Circuit", "Hdden Cirucit"): True, ("Ember No. 36", "Eober No. 36"): True, ("Ember No. 36", "Ember No. 37"): False, ("X Pt. 1", "X Pt. 2"): False, ("X Part II", "X Part III"): False,
    ("X", "X (Live)"): False, ("X (A Mix)", "X (A Remix)"): False, ("X (Night Edit)", "X (Night Editt)"): True, ("Brokеn", "Broken"): True, ("Wholly Other", "Some Thing"): False, ("", ""): True,
}


@pytest.mark.parametrize("pair", sorted(SAME))
def test_same_recording(pair):
    a, b = (("Artist", t) for t in pair)
    assert Same(2)(a, b) == Same(2)(b, a) == SAME[pair]


def test_within_is_osa():
    def osa(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 8))) for _ in "ab")
        for k in (1, 2, 3):
            assert within(a, b, k) == (osa(a, b) <= k), (a, b, k)
    assert within("x" * 200_000 + "ab", "y" + "x" * 200_000 + "ba", 2)


def test_empty_and_long(spark):
    assert collapsed(spark, []) == []
    assert collapsed(spark, [("s", 0, None, None, 1), ("s", 1, "", "", 1)]) == []
    long = "word " * 100_000
    assert [r[3] for r in collapsed(spark, [("s", 0, "A", long, 1), ("s", 1, "A", long + "x", 1)])] == [2]


def test_only_one_field(spark):
    assert [r[1:4] for r in collapsed(spark, [("s", 0, "A", None, 1), ("s", 1, "A", "", 1), ("s", 2, "", "A", 1)])] == [(0, 30, 2), (60, 60, 1)]


@pytest.mark.parametrize(("width", "fan"), [(1, 2), (2, 3), (3, 8)])
def test_edges_are_joined_in_bounded_blocks(spark, monkeypatch, width, fan):
    sizes, level = [], module._level

    def spy(summaries, *rest):
        sizes.append(summaries.groupBy("seq", "block").count().agg({"count": "max"}).first()[0])
        return level(summaries, *rest)

    monkeypatch.setattr(module, "_level", spy)
    rnd = random.Random(3)
    rows = [(s, i, "A", rnd.choice(["Some Title", "Other Song"]) if rnd.random() < 0.4 or 20 < i < 30 else "Some Title", 1) for s in ("a", "b") for i in range(-40, 60)]
    assert collapsed(spark, rows, width=width, fan=fan) == brute(rows, Same(2))
    assert len(sizes) >= 3 and sizes[0] <= width and max(sizes[1:]) <= 2 * fan


def test_levels_of_bounded_blocks(spark):
    """An endless sequence at a small width needs four levels; no task of a level sees more than two rows per block that it joins."""
    from unittest.mock import patch

    from runweave.llm import runs as module

    names = ["aaaa bbbb", "cccc dddd"]
    rows = [("endless", k, 30 * k, names[k // 70 % 2], "t", 1) for k in range(1200)]
    events = spark.createDataFrame(rows, "seq string, idx bigint, ts int, artist string, title string, received int")
    want = [(30 * k, 30 * (k + 69), 70) for k in range(0, 1190, 70)] + [(1190 * 30, 1199 * 30, 10)]
    seen = []
    level = module._level

    def counted(summaries, slips, edges, whole):
        if edges:
            seen.append(summaries.groupBy("seq", "block").count().agg({"count": "max"}).first()[0])
        return level(summaries, slips, edges, whole)

    with patch.object(module, "_level", counted):
        got = sorted((r.first_ts, r.last_ts, r.n) for r in module.runs(events, width=10, fan=4).collect())
    assert got == want
    assert len(seen) == 4 and max(seen) <= 2 * 4
