"""Queries over rows that the test tables or the SQL leave out, against plain Python."""

import re
from urllib.parse import quote_plus

from runweave.plans.queries import QUERIES

NAMES = [
    ("Björk", "Jóga (Live)"), ("Кино", "Группа крови feat. Цой"), ("Ωmega", "Δ [Mix]"), ("東京事変", "群青日和（Live）"), ("ＦＵＬＬ", "Ｗidth"), ("a b", "c FT. d"), ("d'Arc", "Don't \"Stop\" *~%+%7E&=?/#"),
    ("x\x1c(y)", "\x1fz\x85"), (" A　", "B feat C D\nE"), ("😀 act", "é ​ft ​"), ("A", "B feat. C\nD (E)"), ("A", "b FeaturİNG c"), ("A", "b featurıng c"), ("Ascii", "Plain (Mix)"), ("", ""), ("A", " "), ("(all)", "\\Q$1"),
    *[("w", f"a{chr(c)}(b){chr(c)}feat{chr(c)}d") for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)],
]


def cleaned(name):
    name = re.sub(r"\s*[(\[][^)\]]*[)\]]", "", name)
    return re.sub(r"\s+(?:feat\.?|ft\.?|featuring)\s+.*", "", name, flags=re.I).strip()


def run(spark, folder, table, rows, schema, name):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]


def tracks(spark, folder, name):
    rows = [(i, a, t, "https://x/400x400bb.jpg" if i % 2 else None) for i, (a, t) in enumerate(NAMES)]
    return rows, run(spark, folder, "tracks", rows, "track_id bigint, artist string, title string, coverart_url string", name)


def test_all_titles_are_cleaned(spark, tmp_path):
    rows, got = tracks(spark, tmp_path, "clean_query")
    assert sorted(got) == sorted({(t, cleaned(t)) for _, _, t, _ in rows})


def test_all_tracks_have_addresses(spark, tmp_path):
    rows, got = tracks(spark, tmp_path, "search_addresses")
    song = lambda a, t: f"https://itunes.apple.com/search?term={quote_plus(f'{a} {t}')}&entity=song&limit=1"
    recording = lambda a, t: "https://musicbrainz.org/ws/2/recording?query=" + quote_plus(f'artist:"{a}" AND recording:"{t}"') + "&fmt=json&limit=1"
    album = lambda a, t: "https://api.deezer.com/search?q=" + quote_plus(f'artist:"{a}" track:"{t}"')
    assert sorted(got) == [(i, song(a, t), album(a, t), recording(a, t)) for i, a, t, _ in rows]


def test_all_tracks_have_sources(spark, tmp_path):
    rows, got = tracks(spark, tmp_path, "waterfall_order")
    tried = lambda a, t, u: ["cdn resized", "cdn original"] * bool(u) + ["song exact"] + ["song cleaned"] * ((cleaned(a), cleaned(t)) != (a, t)) + ["album", "recording"]
    assert sorted(got) == [(i, ",".join(tried(a, t, u))) for i, a, t, u in rows]


def test_report_of_short_and_long_items(spark, tmp_path):
    values = {1: (45.5, 40.0), 2: (125.0, 125.0), 3: (7325.9, 7000.0), 4: (0.0, 2.0), 5: (59.9, 61.0), 6: (3600.0, 1.0)}
    rows = [(2 * u + phase, u, v) for u, pair in values.items() for phase, v in enumerate(pair)] + [(100, 7, 5.0)]
    got = run(spark, tmp_path, "events", rows, "event_id bigint, user_id bigint, value double", "before_after")
    assert {r[0]: r[1:3] for r in got} == {1: ("45s", 5.5), 2: ("2m 5s", None), 3: ("2h 2m 5s", 325.9), 4: (None, None), 5: ("59s", None), 6: ("1h 0m 0s", 3599.0)}


COVERS = [(1, "https://x/400x400bb.jpg", "L"), (2, "https://x/a.jpg", None), (3, None, "M"), (5, "", "N"), (6, None, None), (7, "https://x/1x1cc", None)]


def test_every_source_is_offered(spark, tmp_path):
    got = run(spark, tmp_path, "tracks", COVERS, "track_id bigint, coverart_url string, album string", "waterfall_first")
    want = [(1, "cdn resized", "https://x/600x600bb.jpg"), (2, "cdn resized", "https://x/a.jpg"), (3, "album", "M"), (5, "album", "N"), (6, None, None), (7, "cdn resized", "https://x/600x600cc")]
    assert sorted(got) == want


def test_tracks_without_address_are_kept(spark, tmp_path):
    got = run(spark, tmp_path, "tracks", COVERS, "track_id bigint, coverart_url string, album string", "resize_url")
    resized = {1: "https://x/300x300bb.jpg", 2: "https://x/a.jpg", 3: None, 5: "", 6: None, 7: "https://x/300x300cc"}
    assert sorted(got) == [(i, r, f"https://x/{i}/600x600-000.jpg", f"https://x/{i}/600x600bb.jpg") for i, r in resized.items()]
