from pyspark.sql import functions as F

from runweave.functions import audio, rows, text


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_labels(spark):
    assert values(spark, text.time_label, [0, 45, 90, 3661, 37845, None], "int") == ["0:00", "0:45", "1:30", "1:01:01", "10:30:45", None]
    assert values(spark, text.duration_label, [0.0, 125.5, 3600.0, 7325.9], "double") == ["0s", "2m 5s", "1h 0m 0s", "2h 2m 5s"]
    assert values(spark, text.seconds_of, ["1:30:45", "3:00", "x", "1:2:3:4", None]) == [5445, 180, None, None, None]


def test_keys_and_names(spark):
    assert values(spark, text.strip, ["  a b\t", "", None]) == ["a b", "", None]
    assert values(spark, text.search_name, ["Track Name (Original Mix)", "Artist feat. Someone", "Track (Remix) [Extended]", "", "A ft. B"]) == ["Track Name", "Artist", "Track", "", "A"]
    assert values(spark, text.resized, ["https://x/12x34/400x400bb.jpg", "https://x/400x400cc.jpg", "https://x/a.jpg"]) == ["https://x/12x34/600x600bb.jpg", "https://x/600x600cc.jpg", "https://x/a.jpg"]
    assert values(spark, text.query_part, ["a b*~&é"]) == ["a+b%2A~%26%C3%A9"]
    df = spark.createDataFrame([(" Daft ", "One\t"), (None, None)], "a string, t string")
    assert [r[0] for r in df.select(text.correction_key(F.col("a"), F.col("t"))).collect()] == ["daft|||one", "|||"]


def test_files(spark):
    assert values(spark, text.suffix, ["/a/x.MP3", "/a/.mp3", "/a/b.c/d", "x.tar.gz"]) == [".mp3", "", "", ".gz"]
    assert values(spark, text.stem, ["/a/x.MP3", "/a/.mp3", "/a/b.c/d"]) == ["x", ".mp3", "d"]
    assert values(spark, text.episode_label, ["/a/mix_tracklist.md"]) == ["mix"]


def test_sparkline(spark):
    df = spark.createDataFrame([([0.0, 0.5, 1.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(text.sparkline(F.col("v"))).collect()] == ["▁▅█", ""]


def test_change_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.0, 0.25), (0.0, 0.35), (0.0, -0.04), (None, 1.0)], "b double, a double")
    assert [r[0] for r in df.select(text.signed_change(F.col("b"), F.col("a"))).collect()] == ["+0.2", "+0.3", "-0.0", None]


def test_predicates(spark):
    df = spark.createDataFrame([("", "", None, None), ("a", "", None, None), ("a", "b", "a", "b"), ("a", "b", "x", None)], "a string, t string, oa string, ot string")
    c = [F.col(x) for x in ("a", "t", "oa", "ot")]
    got = df.select(rows.is_unidentified(*c[:2]), rows.was_corrected(*c)).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False), (False, True)]
    assert values(spark, rows.may_retry, ["HTTP 429", "Too many", "bitrate", "reset"]) == [True, True, True, False]


def test_recognised(spark):
    answers = [
        '{"track":{"title":"T","subtitle":"A","url":"u","images":{"coverarthq":"","coverart":"c"},"sections":[{"metadata":[{"text":"L"}]}]}}',
        '{"track":{"sections":[]}}', '{"matches":[]}', "no json", None,
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    got = [r.m for r in rows.recognised(df, F.col("a"), "m").orderBy("i").collect()]
    assert tuple(got[0]) == ("T", "A", "u", "L", "c")
    assert tuple(got[1]) == ("Unknown Title", "Unknown Artist", None, None, None)
    assert got[2:] == [None, None, None]


def test_reports(spark):
    good = 'x {"input_i" : "-14.2", "input_tp" : "-1.0"} y'
    got = values(spark, rows.loudness, [good, '{"input_i" : "inf?"}', "none"])
    assert tuple(got[0]) == (-14.2, -1.0, 0.0) and got[1:] == [None, None]
    assert values(spark, rows.levels, ["RMS_level=-3.5 RMS_level=-inf RMS_level=2", ""]) == [[-3.5, 2.0], []]


def test_settings(spark):
    def chain(**change):
        config = {k: F.lit(v) for k, v in (audio.DEFAULTS | change).items()}
        return spark.range(1).select(audio.filter_chain(config)).first()[0]

    assert chain() == "silenceremove=start_periods=1:start_threshold=-50.0dB:start_duration=0.1,acompressor=threshold=-18.0dB:ratio=3.0:attack=20.0:release=250.0,loudnorm=I=-16.0:TP=-1.5:LRA=11.0"
    assert chain(remove_silence=False, apply_compression=False, apply_normalization=False) == ""
    assert values(spark, audio.listing_line, ["/a/it's.wav"]) == ["file '/a/it'\\''s.wav'"]
    config = {k: F.lit(v) for k, v in audio.DEFAULTS.items()}
    steps = audio.stages(config, F.lit(True))
    got = spark.range(1).select(audio.selected(steps), audio.selected(audio.toggled(steps, ["silence"])), audio.selected(audio.switched(steps, False))).first()
    assert list(got[0]) == ["concat", "silence", "compress", "normalize", "export"] and list(got[1]) == ["concat", "compress", "normalize", "export"] and list(got[2]) == []
