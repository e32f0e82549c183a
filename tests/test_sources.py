import os

import pytest
from pyspark.sql import functions as F

from runweave.sources import files
from runweave.sources.providers import TableProvider, ask, waits, waterfall, with_retry
from runweave.streaming import jobs


def test_audio_files(spark, tmp_path):
    for n in ("b.MP3", "a.wav", "readme.txt", ".mp3"):
        (tmp_path / n).write_bytes(b"xy")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.mp3").write_bytes(b"x")
    got = files.audio_files(spark, [str(tmp_path)]).collect()
    assert [(r.stem, r.suffix, r.size) for r in got] == [("a", ".wav", 2), ("b", ".mp3", 2)]


def test_audio_files_missing_and_twice(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"xy")
    with pytest.warns(UserWarning, match="nowhere"):
        got = files.audio_files(spark, [str(tmp_path), str(tmp_path / "a.wav"), str(tmp_path), str(tmp_path / "nowhere")]).collect()
    assert [r.stem for r in got] == ["a"]
    with pytest.warns(UserWarning):
        assert files.audio_files(spark, [str(tmp_path / "nowhere")]).count() == 0


def test_progress(spark):
    df = spark.createDataFrame([("s", '[[0,{"title":"T","artist":"A"}],[30,null]]'), ("t", None)], "k string, value string")
    got = sorted(files.progress(df, F.col("k")).collect())
    assert [(r.set_id, r.sample_idx, r.ts, r.hit and r.hit.title) for r in got] == [("s", 0, 0, "T"), ("s", 1, 30, None)]
    bad = df.unionByName(spark.createDataFrame([("u", "not valid json {{{")], "k string, value string"))
    assert files.progress(bad, F.col("k"), strict=False).count() == 2
    with pytest.raises(Exception, match="corrupt progress log of u"):
        files.progress(bad, F.col("k")).collect()


def test_progress_is_written_in_parts(spark, tmp_path):
    at = str(tmp_path / "log")
    assert files.read_progress(spark, at, 30).count() == 0
    schema = f"set_id string, sample_idx bigint, ts int, hit {files.HIT}"
    hit = lambda k: ('T "q" \\ é', "A", None, None, f"u{k}") if k % 3 else None
    rows = [("s", k, 30 * k, hit(k)) for k in range(25) if k != 7] + [("t", 0, 0, None)]
    files.write_progress(spark.createDataFrame(rows, schema), at, width=10)
    assert sorted(map(tuple, files.read_progress(spark, at, 30).collect())) == sorted(rows)
    files.write_progress(spark.createDataFrame([("s", 20, 600, hit(1))], schema), at, width=10)
    got = sorted(map(tuple, files.read_progress(spark, at, 30).collect()))
    assert got == sorted([r for r in rows if not (r[0] == "s" and r[1] >= 20)] + [("s", 20, 600, hit(1))])


def test_one_save_of_an_editor(spark, tmp_path):
    track = "struct<ts:int,artist:string,title:string,rejected:boolean,shazam_url:string,album:string,coverart_url:string>"
    lists = spark.createDataFrame([("s", "m.mp3", None, [(0, "A", "One", False, None, None, None)])], f"set_id string, source_file string, generated_on string, tracks array<{track}>")
    edits = spark.createDataFrame([("A", "One", "a", "oen"), ("B", "Two", None, None)], "artist string, title string, original_artist string, original_title string")
    log = spark.createDataFrame([("a|||oen", "old", "old", "a", "oen", "2020"), ("k|||k", "K", "K", "k", "k", "2020")], "cor_key string, artist string, title string, original_artist string, original_title string, corrected_at string")
    for _ in range(2):
        files.save_lists(lists, edits, log, str(tmp_path), F.lit("2025"))
    read = lambda kind: {r.document: r.value for r in spark.read.text(str(tmp_path / kind), wholetext=True).collect()}
    assert read("markdown")["s"].startswith("# Tracklist: m.mp3") and '"artist":"A"' in read("json")["s"]
    assert sorted((r.cor_key, r.artist) for r in spark.read.parquet(str(tmp_path / "corrections")).collect()) == [("a|||oen", "A"), ("k|||k", "K")]


def test_documents_are_replaced_by_key(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(x, "k string, t string")
    files.write_documents(rows(("a", "1\n2"), ("b", "x")), at, "k", "t")
    files.write_documents(rows(("a", "3")), at, "k", "t")
    got = {r.document: r.value for r in spark.read.text(at, wholetext=True).collect()}
    assert {k: v.strip() for k, v in got.items()} == {"a": "3", "b": "x"}


def test_numbers_and_lines(spark):
    df = spark.createDataFrame([("12.5\n",), ("N/A",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(files.number(F.col("v"))).collect()] == [12.5, None, None, None]
    assert spark.range(1).select(files.first_line(F.lit("tool 7.1\nmore"))).first()[0] == "tool 7.1"


def test_retry_rule():
    assert waits() == [30.0, 60.0, 120.0, 240.0]
    slept = []

    def fails(message, times):
        left = [times]

        def call(_):
            if left[0]:
                left[0] -= 1
                raise RuntimeError(message)
            return "ok"

        return call

    args = {"sleep": slept.append, "chance": lambda: 1.0}
    assert with_retry(fails("429", 2), "x", **args) == ("ok", 3, None)
    assert slept == pytest.approx([33.0, 66.0])
    assert with_retry(fails("Too Many", 9), "x", **args)[:2] == (None, 5)
    assert with_retry(fails("reset", 1), "x", **args) == (None, 1, "reset")


def test_ask(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad")], "i int, q string")
    got = sorted(ask(df, "q", lambda: TableProvider({"a": "A", "bad": RuntimeError("reset")})).collect())
    assert [(r.i, r.answer, r.attempts, r.failure) for r in got] == [(1, "A", 1, None), (2, None, 0, None), (3, None, 1, "reset")]


def test_waterfall_is_lazy(spark):
    df = spark.createDataFrame([("k", [("one", "u1"), ("two", "u2"), ("three", "u3")]), ("n", [])], "k string, c array<struct<source:string,address:string>>")
    # u3 would fail the whole row if it were asked after the success.
    answers = {"u1": "", "u2": b"data", "u3": RuntimeError("asked")}
    got = {r.k: (r.source, r.data and bytes(r.data)) for r in waterfall(df, "c", lambda: TableProvider(answers)).collect()}
    assert got == {"k": ("two", b"data"), "n": (None, None)}


def test_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("sample_idx"), F.lit("s").alias("set_id"))
    rows(0, 5).write.mode("append").parquet(src)
    go = lambda: jobs.run_available(jobs.stream(spark, src, rows(0, 1)), jobs.append_to(out), mark)
    counts = []
    for more in (None, (5, 9), None):
        if more:
            rows(*more).write.mode("append").parquet(src)
        go()
        counts.append(spark.read.parquet(out).count())
    assert counts == [5, 9, 9]


def test_collapse_of_touched_sets(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "set_id string, sample_idx bigint, received_at timestamp, k string"
    put = lambda *r: spark.createDataFrame([(s, i, None, k) for s, i, k in r], schema).write.mode("append").parquet(src)
    sink = jobs.collapse_touched(lambda: spark.read.parquet(src), out, lambda: F.col("k"), ["k"])
    go = lambda: jobs.run_available(jobs.stream(spark, src, spark.createDataFrame([], schema)), sink, mark)
    put(("a", 0, "x"), ("a", 1, "x"), ("b", 0, "y"), ("b", 1, "y"))
    go()
    put(("a", 5, "z"), ("a", 6, "z"))
    go()
    got = sorted((r.set_id, r.sample_idx, r.k) for r in spark.read.parquet(out).where("matched").collect())
    assert got == [("a", 0, "x"), ("a", 5, "z"), ("b", 0, "y")]


def test_running_collapse(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "g string, i bigint, k string"
    put = lambda *r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(src)
    go = lambda: jobs.run_available(jobs.running_collapse(jobs.stream(spark, src, spark.createDataFrame([], schema)), "g", "i", "k"), jobs.append_to(out), mark)
    put(("a", 0, "x"), ("a", 1, "x"), ("a", 2, None))
    go()
    put(("a", 3, "x"), ("a", 4, "y"))
    go()
    got = sorted((r.g, r.i, r.k, r.kind) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, "x", "start"), ("a", 4, "y", "start")]


def test_the_end_of_a_set_withdraws_what_came_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "g string, i bigint, k string, done boolean"
    put = lambda *r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(src)
    go = lambda: jobs.run_available(jobs.running_collapse(jobs.stream(spark, src, spark.createDataFrame([], schema)), "g", "i", "k", closing="done"), jobs.append_to(out), mark)
    put(("a", 0, "x", None), ("a", 1, "x", None), ("a", 2, "y", None))
    go()
    put(("a", 3, "z", False), ("a", 4, None, True))
    go()
    got = sorted((r.i, r.k, r.kind) for r in spark.read.parquet(out).where("g = 'a'").collect())
    assert got == [(0, "x", "start"), (2, "y", "start"), (2, "y", "withdrawn"), (3, "z", "start"), (3, "z", "withdrawn")]


def test_late_rows_are_left_out_once_their_window_is_closed(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put = lambda *t: spark.createDataFrame([("s", x) for x in t], "g string, x string").selectExpr("g", "CAST(x AS timestamp_ntz) AS at").coalesce(1).write.mode("append").parquet(src)
    like = spark.sql("SELECT 's' AS g, timestamp_ntz'2026-01-01 00:00:00' AS at")
    go = lambda: jobs.run_available(jobs.tumbling(jobs.stream(spark, src, like), "at", "g", late="1 minute"), jobs.append_to(out), mark)
    put("2026-01-01 00:00:10", "2026-01-01 00:05:00")
    go()
    put("2026-01-01 00:00:20", "2026-01-01 00:04:40", "2026-01-01 00:20:00")
    go()
    got = sorted((str(r.window_start), r.n) for r in spark.read.parquet(out).collect())
    assert got == [("2026-01-01 00:00:00", 1), ("2026-01-01 00:04:30", 1), ("2026-01-01 00:05:00", 1)]


def test_late_rows_and_windows(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    df = spark.sql("SELECT 's' AS g, timestamp_ntz'2026-01-01 00:00:10' AS at UNION ALL SELECT 's', timestamp_ntz'2026-01-01 00:00:35'")
    df.write.parquet(src)
    counts = jobs.tumbling(jobs.stream(spark, src, df), "at", "g", late="1 hour")
    jobs.run_available(counts, lambda b, n: b.write.mode("overwrite").parquet(out), mark, mode="complete")
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 1]
    assert os.path.exists(mark)
