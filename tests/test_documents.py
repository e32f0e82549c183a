from pyspark.sql import functions as F

from runweave.operators import choice, corrections, documents, edits, signals

TRACKS = "array<struct<ts:int,artist:string,title:string,rejected:boolean,shazam_url:string,album:string,coverart_url:string>>"


def lists(spark, tracks, source="mix.mp3", date="2026-01-31 20:00"):
    rows = [(ts, a, t, r, None, None, None) for ts, a, t, r in tracks]
    return spark.createDataFrame([("s", source, date, rows)], f"set_id string, source_file string, generated_on string, tracks {TRACKS}")


def render(df):
    return df.select("set_id", documents.markdown(F.col("source_file"), F.col("generated_on"), F.col("tracks"), F.lit("now")).alias("m"))


def test_markdown_numbers_what_is_kept(spark):
    df = lists(spark, [(0, "A", "B", False), (90, "X", "Y", True), (3700, "", "", None)])
    assert render(df).first().m == "# Tracklist: mix.mp3\n\n*Generated on 2026-01-31 20:00*\n\n1. **A** - B (0:00)\n2. *Unidentified* (1:01:40)\n"
    assert render(lists(spark, [], date=None)).first().m == "# Tracklist: mix.mp3\n\n*Generated on now*\n\n"


def test_round_trip_and_what_it_loses(spark):
    df = lists(spark, [(0, "A", "B - C", False), (60, "", "no artist", False), (120, "no title", "", False), (180, "x", "y (1:23) z", False), (240, "", "", False)])
    p = documents.parsed(render(df), "set_id", "m").first()
    assert p.source_file == "mix.mp3" and p.generated_on == "2026-01-31 20:00"
    # The track without an artist does not parse; a time inside a title ends it.
    assert [(t.ts, t.artist, t.title) for t in p.tracks] == [(0, "A", "B - C"), (120, "no title", ""), (83, "x", "y"), (240, "", "")]
    assert [t.original_artist for t in p.tracks] == ["A", "no title", "x", None]


def test_parse_ignores_other_lines(spark):
    text = "junk\n# Tracklist:  a.mp3 \n*Generated on d*\nx\n1. **Aé** - T\u0085 (0:05)\n12) no\n"
    df = spark.createDataFrame([("k", text), ("e", ""), ("n", None)], "id string, m string")
    got = {r.id: r for r in documents.parsed(df, "id", "m").collect()}
    assert got["k"].source_file == "a.mp3" and [t.ts for t in got["k"].tracks] == [5]
    assert got["e"].tracks == [] and got["n"].tracks == [] and got["n"].source_file == ""


def test_json_keeps_nulls_and_unidentified(spark):
    df = lists(spark, [(5, "", "", False), (9, "a", "b", True)])
    assert df.select(documents.json_text(F.col("tracks"))).first()[0] == '[{"timestamp":5,"time":"0:05","artist":"","title":"","rejected":false,"shazam_url":null,"album":null,"coverart_url":null}]'


def test_chapters(spark):
    df = lists(spark, [(0, "A", "B", False), (90, "", "", False), (50, "C", "D", False)])
    c = df.select(documents.chapters(F.col("tracks"), F.lit(600000)).alias("c"), documents.has_identified(F.col("tracks")).alias("h")).first()
    assert [tuple(x) for x in c.c] == [(0, "chp000", 0, 90000, "A - B"), (1, "chp001", 90000, 50000, "Unknown Track"), (2, "chp002", 50000, 600000, "C - D")]
    assert c.h and not lists(spark, [(0, "", "", False), (1, "a", "b", True)]).select(documents.has_identified(F.col("tracks"))).first()[0]


def test_sidecar_last_wins_even_if_empty(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (0,)], "ts int")
    extra = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 1), (1, "", 2)], "ts int, url string, seq int")
    got = sorted(documents.sidecar(rows, extra, ["ts"], "url", ["seq"]).collect())
    assert [(r.ts, r.url) for r in got] == [(0, "b"), (0, "b"), (1, None), (2, None)]


def test_corrections_hops_and_identity(spark):
    log = spark.createDataFrame(
        [("a|||t", "b", "t", "a", "t", "2026-01-01"), ("a|||t", "old", "t", "a", "t", "2025-01-01"), ("b|||t", "c", "t", "b", "t", "2026-01-01"), ("|||", "ghost", "g", "", "", "2026-01-01")],
        "cor_key string, artist string, title string, original_artist string, original_title string, corrected_at string",
    )
    rows = spark.createDataFrame([(" A ", "T", None, None), ("", "", None, None), (None, None, None, None), ("z", "z", "o", None)], "artist string, title string, original_artist string, original_title string")
    dim = corrections.dimension(log)
    one = [tuple(r) for r in corrections.apply(rows, dim).collect()]
    assert ("b", "t", " A ", "T", True) in one and ("", "", None, None, False) in one and ("z", "z", "o", None, False) in one
    two = [tuple(r) for r in corrections.apply(rows, dim, hops=2).collect()]
    assert ("c", "t", "b", "t", True) in two
    assert ("ghost", "g", "", "", True) in [tuple(r) for r in corrections.apply(rows, dim, skip_unidentified=False).collect()]


def test_correction_store_round_trip(spark):
    text = '{"corrections":{"a|||t":{"artist":"b","title":"t","original_artist":"a","original_title":"t","corrected_at":"2026"}}}'
    df = spark.createDataFrame([(text,), ("not json {{{",), (None,)], "value string")
    rows = corrections.from_store(df)
    assert [tuple(r) for r in rows.collect()] == [("a|||t", "b", "t", "a", "t", "2026")]
    assert corrections.to_store(corrections.dimension(rows)).first()[0] == text


def test_learned(spark):
    e = spark.createDataFrame([("b", "t", "a", "t"), ("a", "t", "a", "t"), ("x", "y", None, None)], "artist string, title string, original_artist string, original_title string")
    assert [r.cor_key for r in corrections.learned(e, F.lit("now")).collect()] == ["a|||t"]


def test_first_success(spark):
    df = spark.createDataFrame([("k", 1, ""), ("k", 2, None), ("k", 4, "b"), ("k", 3, "a"), ("n", 1, None)], "k string, p int, v string")
    assert {(r.k, r.v) for r in choice.first_success(df, ["k"], "p", "v", ["v"]).collect()} == {("k", "a"), ("n", None)}


def test_candidates(spark):
    df = spark.createDataFrame([("A feat. B", "T", "https://x/400x400bb.jpg"), ("A", "T", "")], "a string, t string, u string")
    got = [[(c.source, c.address) for c in r[0]] for r in df.select(choice.candidates(F.col("a"), F.col("t"), F.col("u"))).collect()]
    assert [s for s, _ in got[0]] == list(choice.SOURCES) and got[0][0][1] == "https://x/600x600bb.jpg"
    assert [s for s, _ in got[1]] == ["song exact", "album", "recording"]


def test_matching_file(spark):
    lists_ = spark.createDataFrame([("mix_tracklist",), ("x",), ("none",)], "list_stem string")
    files = spark.createDataFrame([("/a/mix.flac", "mix", ".flac"), ("/a/mix.mp3", "mix", ".mp3"), ("/a/x.txt", "x", ".txt"), ("/b/mix_tracklist.wav", "mix_tracklist", ".wav")], "path string, stem string, suffix string")
    got = {r.list_stem: r.path for r in choice.matching_file(lists_, files, (".mp3", ".wav", ".flac")).collect()}
    assert got == {"mix_tracklist": "/b/mix_tracklist.wav", "x": None, "none": None}


def test_edit_fold(spark):
    log = spark.createDataFrame(
        [("k", 1, "edit", "b", "t", "a", "t"), ("k", 2, "toggle", None, None, None, None), ("k", 3, "edit", "c", None, "b", "t"), ("k", 4, "toggle", None, None, None, None), ("k", 5, "toggle", None, None, None, None)],
        "k string, seq int, action string, artist string, title string, before_artist string, before_title string",
    )
    r = edits.folded(log, ["k"], ["seq"]).first()
    assert (r.rejected, r.artist, r.title, r.original_artist, r.original_title, r.edits) == (True, "c", None, "a", "t", 2)


def test_slices(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 30000), ("d", 30001), ("e", None)], "s string, ms bigint")
    got = sorted((r.s, r.sample_idx, r.ts, r.start_ms, r.end_ms) for r in signals.slices(df, "ms").collect())
    assert got == [("b", 0, 0, 0, 1), ("c", 0, 0, 0, 30000), ("d", 0, 0, 0, 30000), ("d", 1, 30, 30000, 30001)]


def plain_profile(values, points):
    if not values:
        return []
    size = max(1, len(values) // points)
    means = [sum(values[i : i + size]) / len(values[i : i + size]) for i in range(0, len(values), size)][:points]
    low, span = min(means), max(means) - min(means)
    return [0.5 if span < 0.01 else (m - low) / span for m in means]


def test_profile_both_ways(spark):
    series = {"a": [float(i % 17) for i in range(119)], "b": [1.0, 1.004], "c": [-3.0], "d": [float(i) for i in range(1000)]}
    long = spark.createDataFrame([(k, i, v) for k, x in series.items() for i, v in enumerate(x)], "g string, i int, v double")
    got = {}
    for r in sorted(signals.profile(long, "g", ["i"], "v", 60).collect()):
        got.setdefault(r.g, []).append(r.level)
    arrays = spark.createDataFrame([(k, x) for k, x in series.items()] + [("e", [])], "g string, v array<double>")
    held = {r.g: r.p for r in arrays.select("g", signals.profile_array(F.col("v"), 60).alias("p")).collect()}
    for k, x in series.items():
        want = plain_profile(x, 60)
        assert [round(a, 9) for a in got[k]] == [round(a, 9) for a in held[k]] == [round(a, 9) for a in want]
    assert held["e"] == []
