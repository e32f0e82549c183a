import json

from pyspark.sql import functions as F

from runweave.functions import audio
from runweave.operators import documents
from runweave.operators.covers import covers
from runweave.plans.pipelines import chapter_plan, processing_plan, processing_report, recognise, tracklists
from runweave.sources.providers import TableProvider

HIT = "struct<title:string,artist:string,shazam_url:string,album:string,coverart_url:string>"
LOG = "cor_key string, artist string, title string, original_artist string, original_title string, corrected_at string"


def answer(artist, title):
    return json.dumps({"track": {"title": title, "subtitle": artist, "images": {"coverart": f"https://x/{title}/400x400bb.jpg"}}})


def test_recognise_to_markdown(spark):
    sets = spark.createDataFrame([("s", "mix.mp3", 240_000), ("none", "empty.mp3", 0)], "set_id string, source_file string, duration_ms bigint")
    heard = [("A", "One"), ("A", "One"), None, ("a", "oen"), ("B", "Two"), ("B", "Two"), ("C", "once")]
    answers = {f"s@{i * 30_000}": answer(*h) if h else '{"matches":[]}' for i, h in enumerate(heard)}
    done = spark.createDataFrame([("s", 0, 0, ("One", "A", None, None, "done"))], f"set_id string, sample_idx bigint, ts int, hit {HIT}")
    samples = recognise(sets, done, lambda: TableProvider({k: v for k, v in answers.items() if k != "s@0"}))
    assert samples.count() == 8 and samples.where("hit.coverart_url = 'done'").count() == 1
    log = spark.createDataFrame([("a|||oen", "A", "One", "a", "oen", "2026")], LOG)
    lists = tracklists(samples, sets, log, F.lit("2025-05-04 12:00"))
    got = {r.set_id: r for r in lists.collect()}
    # The correction makes the misheard sample part of the first run; its gap and the single match stay as gaps.
    assert [(t.ts, t.artist, t.title) for t in got["s"].tracks] == [(0, "A", "One"), (60, "", ""), (120, "B", "Two"), (180, "", "")]
    assert got["none"].tracks == []
    md = {r.set_id: r.m for r in lists.select("set_id", documents.markdown(F.col("source_file"), F.col("generated_on"), F.col("tracks"), F.lit("now")).alias("m")).collect()}
    assert md["s"].endswith("1. **A** - One (0:00)\n2. *Unidentified* (1:00)\n3. **B** - Two (2:00)\n4. *Unidentified* (3:00)\n")


def test_chapters_with_images(spark):
    texts = spark.createDataFrame([("s", "# Tracklist: m.mp3\n1. **A** - One (0:00)\n2. *Unidentified* (1:30)\n3. **B (Live)** - Two (2:00)"), ("n", "1. *Unidentified* (0:00)")], "set_id string, markdown string")
    extra = spark.createDataFrame([("s", 0, "https://x/400x400bb.jpg", 1)], "set_id string, ts int, coverart_url string, seq int")
    sets = spark.createDataFrame([("s", 300_000)], "set_id string, duration_ms bigint")
    answers = {"https://x/400x400bb.jpg": b"one", "https://itunes.apple.com/search?term=B+Two&entity=song&limit=1": '{"resultCount": 1, "results": [{"artworkUrl100": "https://i/100x100bb.jpg"}]}', "https://i/600x600bb.jpg": b"two"}
    images, contents = chapter_plan(texts, extra, sets, lambda: TableProvider(answers))
    got = [(r.pos, r.start_ms, r.end_ms, r.title, r.source, r.image and bytes(r.image)) for r in images.orderBy("pos").collect()]
    assert got == [(0, 0, 90_000, "A - One", "cdn original", b"one"), (1, 90_000, 120_000, "Unknown Track", None, None), (2, 120_000, 300_000, "B (Live) - Two", "song cleaned", b"two")]
    toc = contents.collect()
    assert [(r.set_id, list(r.child_element_ids), bytes(r.episode_image)) for r in toc] == [("s", ["chp000", "chp001", "chp002"], b"one")]


def test_processing(spark):
    config = {k: F.lit(v) for k, v in audio.DEFAULTS.items()}
    jobs = spark.createDataFrame([(1, ["/a.wav"]), (2, ["/a.wav", "/it's.wav"])], "job_id int, inputs array<string>")
    one, two = processing_plan(jobs, config, F.lit("/out.mp3"), "/work/").orderBy("job_id").collect()
    assert one.arguments[:4] == ["ffmpeg", "-y", "-i", "/a.wav"] and one.arguments[-5:] == ["-c:a", "libmp3lame", "-b:a", "192k", "/out.mp3"]
    assert two.arguments[2:8] == ["-f", "concat", "-safe", "0", "-i", "/work/2.txt"] and two.listing == "file '/a.wav'\nfile '/it'\\''s.wav'"
    assert [s.key for s in one.stages] == ["silence", "compress", "normalize", "export"] and two.stages[0].key == "concat"


def test_report(spark):
    loud = '{{"input_i" : "{}", "input_tp" : "-1.0", "input_lra" : "5.0"}}'
    rows = [(1, "before", 6453.0, 2 * 1048576, loud.format(-20.0), "RMS_level=-30 RMS_level=-10"), (1, "after", 6321.0, 1048576, loud.format(-16.0), ""), (2, "before", None, 0, "", ""), (2, "after", 5.0, 9, "", "")]
    df = spark.createDataFrame(rows, "job_id int, phase string, duration double, size_bytes bigint, report string, levels string")
    one, two = processing_report(df).orderBy("job_id").collect()
    assert (one.duration_before, one.duration_after, one.trimmed, one.mb_before, one.loudness_change, one.peak_change, one.waveform_before, one.waveform_after) == ("1h 47m 33s", "1h 45m 21s", "2m 12s", 2.0, "+4.0", "+0.0", "▁█", "")
    assert (two.duration_before, two.trimmed, two.mb_before, two.loudness_change) == (None, None, None, None)


def test_covers_source_by_source(spark):
    """Two requests for a search; what a search answers is never the image; nothing behind the first image is asked."""
    seen = spark.sparkContext.accumulator(0)
    hit = '{"resultCount": 1, "results": [{"artworkUrl100": "https://i/100x100bb.jpg"}]}'
    answers = {
        "https://itunes.apple.com/search?term=A+One&entity=song&limit=1": hit, "https://i/600x600bb.jpg": b"song",
        "https://itunes.apple.com/search?term=B+Two&entity=song&limit=1": '{"resultCount": 0, "results": []}',
        "https://api.deezer.com/search?q=artist%3A%22B%22+track%3A%22Two%22": '{"data": [{"album": {"cover_xl": "", "cover_big": "https://d/500x500-1.jpg"}}]}', "https://d/600x600-1.jpg": b"album",
        "https://musicbrainz.org/ws/2/recording?query=artist%3A%22C%22+AND+recording%3A%22Three%22&fmt=json&limit=1": '{"recordings": [{"releases": [{"id": "r1"}]}]}', "https://coverartarchive.org/release/r1/front-500": b"front",
        "https://x/400x400bb.jpg": b"original", "https://itunes.apple.com/search?term=D+Four&entity=song&limit=1": "not json",
    }

    class Counting(TableProvider):
        def call(self, request):
            seen.add(1)
            return super().call(request)

    rows = [(1, "A", "One", None), (2, "B", "Two", ""), (3, "C", "Three", None), (4, "Z", "Last", "https://x/400x400bb.jpg"), (5, "D", "Four", None), (6, None, None, None)]
    df = spark.createDataFrame(rows, "i int, artist string, title string, data_url string")
    got = {r.i: (r.source, r.address, r.data and bytes(r.data)) for r in covers(df, "artist", "title", "data_url", lambda: Counting(answers)).collect()}
    assert got == {
        1: ("song exact", "https://i/600x600bb.jpg", b"song"), 2: ("album", "https://d/600x600-1.jpg", b"album"), 3: ("recording", "https://coverartarchive.org/release/r1/front-500", b"front"),
        4: ("cdn original", "https://x/400x400bb.jpg", b"original"), 5: (None, None, None), 6: (None, None, None),
    }
    # 1: search, image. 2: two searches, image. 3: three searches, image. 4: two images. 5 and 6: three searches each.
    assert seen.value == 2 + 3 + 4 + 2 + 3 + 3
