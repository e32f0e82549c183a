"""Queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions import audio, rows, text
from runweave.operators import choice, corrections, covers, documents, edits, runs, signals
from runweave.operators import multivalue as mv
from runweave.session import checkpoint_dir
from runweave.sources.tables import table
from runweave.streaming import jobs

#: Stands for the present wherever a document needs a date, so that results can be repeated.
NOW = "2025-05-04 12:00"
HIT = ["title", "artist", "shazam_url", "album", "coverart_url"]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Several acts in one field ------------------------------------------------------------


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Acts of the tracks with several. Where artist and title stand in each other's place, artist holds no acts."""
    names, tracks = table(spark, d, "artists").select("name"), table(spark, d, "tracks")
    acts = mv.split_values(tracks, "track_id", "artist", protected=names, given=mv.given_words(names), least=2, whole=names)
    return acts.join(_exchanged(spark, d), "track_id", "left_anti").select("track_id", "pos", "name")


def _exchanged(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "tracks").where(F.col("artist").rlike(mv.DEFAULT.pattern()))
    return mv.exchanged(tracks, "track_id", "artist", "title", table(spark, d, "artists").select("name"))


_ONLY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"


@query(f"""WITH r AS (SELECT DISTINCT {_ONLY.format('name')} AS l FROM artists WHERE name IS NOT NULL), t AS (SELECT track_id, {_ONLY.format("coalesce(artist, '')")} AS a, {_ONLY.format("coalesce(title, '')")} AS l FROM tracks WHERE regexp_matches(artist, '{mv.DEFAULT.pattern()}'))
SELECT track_id, l <> '' AND l IN (SELECT l FROM r) AND a NOT IN (SELECT l FROM r) AS exchanged FROM t""")
def p5_exchanged(spark: SparkSession, d: str) -> DataFrame:
    """The tracks whose artist looks like several acts, and whether the title is the registered act instead."""
    tracks = table(spark, d, "tracks").where(F.col("artist").rlike(mv.DEFAULT.pattern())).select("track_id")
    return tracks.join(_exchanged(spark, d).withColumn("e", F.lit(True)), "track_id", "left").select("track_id", F.coalesce("e", F.lit(False)).alias("exchanged"))


@query()
def p5_acts(spark: SparkSession, d: str) -> DataFrame:
    """Every act of every track with its position."""
    names = table(spark, d, "artists").select("name")
    return mv.split_values(table(spark, d, "tracks"), "track_id", "artist", protected=names, given=mv.given_words(names))


# Samples: last delivery, corrections, runs --------------------------------------------

_LATEST = """s AS (SELECT set_id, sample_idx, ts, hit.title AS title, hit.artist AS artist, hit.shazam_url AS shazam_url, hit.album AS album, hit.coverart_url AS coverart_url
  FROM samples WHERE set_id IS NOT NULL AND sample_idx IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY set_id, sample_idx ORDER BY received_at DESC, ts DESC, hit.title DESC, hit.artist DESC, hit.shazam_url DESC NULLS LAST, hit.album DESC NULLS LAST, hit.coverart_url DESC NULLS LAST) = 1)"""
_DIMENSION = """c AS (SELECT cor_key, artist AS ca, title AS ct FROM corrections
  QUALIFY row_number() OVER (PARTITION BY cor_key ORDER BY corrected_at DESC, artist DESC, title DESC, original_artist DESC, original_title DESC) = 1)"""
_KEY = r"""regexp_replace(lower(regexp_replace({a}, '^\s+|\s+$', '', 'g')) || '|||' || lower(regexp_replace({t}, '^\s+|\s+$', '', 'g')), '', '')"""


def _key(a: str, t: str) -> str:
    return _KEY.format(a=f"coalesce({a}, '')", t=f"coalesce({t}, '')")


def _runs_sql(source: str) -> str:
    """``source`` names a CTE with set_id, sample_idx, ts, artist, title, k0 (null in gaps)."""
    return f"""f AS (SELECT *, CASE WHEN count(k0) OVER (PARTITION BY set_id, k0) > 1 THEN k0 END AS k FROM {source}),
l AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pk FROM f),
g AS (SELECT *, (k IS NOT NULL AND k IS DISTINCT FROM pk) AS st, sum(CASE WHEN k IS NOT NULL AND k IS DISTINCT FROM pk THEN 1 ELSE 0 END) OVER (PARTITION BY set_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING) AS run FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY set_id, run, k IS NULL ORDER BY sample_idx) AS rn FROM g)
SELECT set_id, sample_idx, CAST(ts AS BIGINT) AS ts, CASE WHEN st THEN artist ELSE '' END AS artist, CASE WHEN st THEN title ELSE '' END AS title, CAST(run AS BIGINT) AS run
FROM n WHERE st OR (k IS NULL AND run > 0 AND rn = 1)"""


def latest_samples(spark: SparkSession, d: str, fields: list[str] = HIT) -> DataFrame:
    s = table(spark, d, "samples").where("set_id IS NOT NULL AND sample_idx IS NOT NULL").select("set_id", "sample_idx", "ts", "received_at", *[F.col(f"hit.{c}").alias(c) for c in fields])
    return runs.latest(s, ["set_id", "sample_idx"], ["received_at", "ts", *fields], ["ts", *fields])


def _collapsed(spark: SparkSession, d: str, then=None) -> DataFrame:
    """Runs of the last delivery of each sample; the samples are read and moved once."""
    s = table(spark, d, "samples").select("set_id", "sample_idx", "ts", "received_at", *[F.col(f"hit.{c}").alias(c) for c in ("title", "artist")])
    key = F.when(~rows.is_unidentified(F.col("artist"), F.col("title")), text.recording_key(F.col("artist"), F.col("title")))
    out = runs.collapse(s, "set_id", "sample_idx", key, ["ts", "artist", "title"], order=["received_at", "ts", "title", "artist"], then=then)
    named = lambda c: F.when(F.col("matched"), F.col(c)).otherwise("").alias(c)
    return out.select("set_id", "sample_idx", F.col("ts").cast("bigint").alias("ts"), named("artist"), named("title"), "run")


_K0 = "CASE WHEN coalesce(artist, '') <> '' OR coalesce(title, '') <> '' THEN lower(title) || chr(1) || lower(artist) END AS k0"


@query(f"WITH {_LATEST}, {_DIMENSION}, x AS (SELECT set_id, sample_idx, ts, CASE WHEN c.cor_key IS NULL THEN s.artist ELSE ca END AS artist, CASE WHEN c.cor_key IS NULL THEN s.title ELSE ct END AS title FROM s LEFT JOIN c ON c.cor_key = {_key('s.artist', 's.title')} AND s.title IS NOT NULL), y AS (SELECT *, {_K0} FROM x), {_runs_sql('y')}")
def dedup_samples(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: last delivery of each sample, corrections applied, one-off matches suppressed, runs collapsed with gaps."""
    log = corrections.dimension(table(spark, d, "corrections"))
    empty = {c: F.lit(None).cast("string") for c in ("original_artist", "original_title")}
    return _collapsed(spark, d, lambda s: corrections.apply(s.withColumns(empty), log, skip_unidentified=False, only=F.col("title").isNotNull()))


@query(f"WITH {_LATEST}, y AS (SELECT *, {_K0} FROM s), {_runs_sql('y')}")
def dedup_raw(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d)


@query("""WITH y AS (SELECT user_id AS set_id, event_id AS sample_idx, event_id AS ts, '' AS artist, event_type AS title, CASE WHEN event_type <> 'error' THEN lower(event_type) END AS k0 FROM events), """ + _runs_sql("y"))
def dedup_events(spark: SparkSession, d: str) -> DataFrame:
    """The same operator over other ordered events; errors are gaps."""
    e = table(spark, d, "events").select(F.col("user_id").alias("set_id"), F.col("event_id").alias("sample_idx"), F.col("event_id").alias("ts"), F.lit("").alias("artist"), F.col("event_type").alias("title"))
    out = runs.collapse(e, "set_id", "sample_idx", F.when(F.col("title") != "error", F.lower("title")), ["ts", "artist", "title"])
    return out.select("set_id", "sample_idx", "ts", "artist", F.when(F.col("matched"), F.col("title")).otherwise("").alias("title"), "run")


@query(f"WITH {_LATEST} SELECT * FROM s")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    return latest_samples(spark, d)


@query("SELECT set_id, count(*) AS samples, count(*) FILTER (coalesce(hit.artist, '') = '' AND coalesce(hit.title, '') = '') AS unmatched, count(DISTINCT sample_idx) AS positions FROM samples GROUP BY set_id")
def sample_counts(spark: SparkSession, d: str) -> DataFrame:
    none = rows.is_unidentified(F.col("hit.artist"), F.col("hit.title"))
    return table(spark, d, "samples").groupBy("set_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(none).alias("unmatched"), F.countDistinct("sample_idx").alias("positions"))


@query("""WITH x AS (SELECT set_id, lower(hit.title) || chr(1) || lower(hit.artist) AS k, count(*) AS n FROM samples WHERE hit IS NOT NULL AND (hit.artist <> '' OR hit.title <> '') GROUP BY 1, 2)
SELECT set_id, count(*) AS keys, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons FROM x GROUP BY set_id""")
def key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keys of a set and how many of them occur once; counted by aggregation, not by window."""
    s = table(spark, d, "samples").where("hit IS NOT NULL AND (hit.artist <> '' OR hit.title <> '')")
    n = s.groupBy("set_id", text.recording_key(F.col("hit.artist"), F.col("hit.title")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("set_id").agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") == 1).alias("singletons"))


# Corrections -----------------------------------------------------------------------------


@query(f"WITH {_DIMENSION} SELECT t.track_id, CASE WHEN c.cor_key IS NULL THEN t.artist ELSE ca END AS artist, CASE WHEN c.cor_key IS NULL THEN t.title ELSE ct END AS title, CASE WHEN c.cor_key IS NULL THEN t.original_artist ELSE t.artist END AS original_artist, CASE WHEN c.cor_key IS NULL THEN t.original_title ELSE t.title END AS original_title, c.cor_key IS NOT NULL AS corrected FROM tracks t LEFT JOIN c ON c.cor_key = {_key('t.artist', 't.title')} AND NOT (coalesce(t.artist, '') = '' AND coalesce(t.title, '') = '')")
def correction_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "artist", "title", "original_artist", "original_title")
    return corrections.apply(t, corrections.dimension(table(spark, d, "corrections")))


@query(f"""WITH {_DIMENSION}, a AS (SELECT t.track_id, CASE WHEN c.cor_key IS NULL THEN t.artist ELSE ca END AS artist, CASE WHEN c.cor_key IS NULL THEN t.title ELSE ct END AS title, c.cor_key IS NOT NULL AS h1 FROM tracks t LEFT JOIN c ON c.cor_key = {_key('t.artist', 't.title')} AND NOT (coalesce(t.artist, '') = '' AND coalesce(t.title, '') = '')),
b AS (SELECT a.track_id, CASE WHEN c.cor_key IS NULL THEN a.artist ELSE ca END AS artist, CASE WHEN c.cor_key IS NULL THEN a.title ELSE ct END AS title, h1 OR c.cor_key IS NOT NULL AS corrected FROM a LEFT JOIN c ON c.cor_key = {_key('a.artist', 'a.title')} AND NOT (coalesce(a.artist, '') = '' AND coalesce(a.title, '') = ''))
SELECT * FROM b""")
def correction_two_hops(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", "artist", "title", "original_artist", "original_title")
    return corrections.apply(t, corrections.dimension(table(spark, d, "corrections")), hops=2).select("track_id", "artist", "title", "corrected")


@query(f"WITH {_DIMENSION} SELECT t.set_id, count(*) AS tracks, CAST(sum(CASE WHEN c.cor_key IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS applied FROM tracks t LEFT JOIN c ON c.cor_key = {_key('t.artist', 't.title')} AND NOT (coalesce(t.artist, '') = '' AND coalesce(t.title, '') = '') GROUP BY t.set_id")
def correction_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("set_id", "artist", "title", "original_artist", "original_title")
    return corrections.apply(t, corrections.dimension(table(spark, d, "corrections"))).groupBy("set_id").agg(F.count(F.lit(1)).alias("tracks"), F.count_if("corrected").alias("applied"))


@query("""SELECT cor_key, artist, title, original_artist, original_title, corrected_at FROM corrections
QUALIFY row_number() OVER (PARTITION BY cor_key ORDER BY corrected_at DESC, artist DESC, title DESC, original_artist DESC, original_title DESC) = 1""")
def correction_dimension(spark: SparkSession, d: str) -> DataFrame:
    return corrections.dimension(table(spark, d, "corrections"))


@query(f"""WITH e AS (SELECT {_key('original_artist', 'original_title')} AS cor_key, artist, title, original_artist, original_title, strftime(edited_at, '%Y-%m-%dT%H:%M:%S') AS corrected_at FROM tracks
  WHERE (original_artist IS NOT NULL OR original_title IS NOT NULL) AND (artist IS DISTINCT FROM original_artist OR title IS DISTINCT FROM original_title)
  UNION ALL SELECT cor_key, artist, title, original_artist, original_title, corrected_at FROM corrections)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cor_key ORDER BY corrected_at DESC, artist DESC, title DESC, original_artist DESC NULLS LAST, original_title DESC NULLS LAST) = 1""")
def corrections_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The log with what the edits of tracks teach, compacted: last write wins."""
    new = corrections.learned(table(spark, d, "tracks"), F.date_format("edited_at", "yyyy-MM-dd'T'HH:mm:ss"))
    log = table(spark, d, "corrections").select(*new.columns)
    return corrections.dimension(log.unionByName(new))


@query(f"SELECT t.track_id FROM tracks t WHERE {_key('t.artist', 't.title')} IN (SELECT cor_key FROM corrections)")
def membership_semi(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("track_id", text.correction_key(F.col("artist"), F.col("title")).alias("cor_key"))
    return t.join(table(spark, d, "corrections").select("cor_key"), "cor_key", "left_semi").select("track_id")


# Signals: slices, resume, profiles -------------------------------------------------------

_DURATION = "du AS (SELECT set_id, (max(CAST(ts AS BIGINT)) + 30) * 1000 - 500 AS duration_ms FROM samples GROUP BY set_id)"


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").groupBy("set_id").agg(((F.max(F.col("ts").cast("bigint")) + 30) * 1000 - 500).alias("duration_ms"))


_SLICES = "sl AS (SELECT set_id, duration_ms, (p // 30000) AS sample_idx, p // 1000 AS ts, p AS start_ms, least(p + 30000, duration_ms) AS end_ms FROM (SELECT set_id, duration_ms, unnest(range(0, duration_ms, 30000)) AS p FROM du))"


@query(f"WITH {_DURATION}, {_SLICES} SELECT * FROM sl")
def slice_signal(spark: SparkSession, d: str) -> DataFrame:
    return signals.slices(_durations(spark, d), "duration_ms")


@query(f"WITH {_DURATION}, {_SLICES} SELECT set_id, sample_idx, start_ms FROM sl WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.set_id = sl.set_id AND s.sample_idx = sl.sample_idx)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Slices that still have to be recognised: those that were lost."""
    parts = signals.slices(_durations(spark, d), "duration_ms").select("set_id", "sample_idx", "start_ms")
    return signals.unfinished(parts, table(spark, d, "samples"), ["set_id", "sample_idx"])


@query("SELECT user_id, event_id, CAST(value * 1000 AS BIGINT) AS ms, CAST(coalesce(sum(CAST(value * 1000 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM events")
def joined_parts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 1000).cast("bigint").alias("ms"))
    return signals.joined_parts(e, "user_id", "event_id", "ms")


_PROFILE = """nb AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
bk AS (SELECT user_id, CAST((rn - 1) // greatest(1, n // 20) AS BIGINT) AS bucket, avg(value) AS mean FROM nb GROUP BY 1, 2 HAVING bucket < 20),
pr AS (SELECT user_id, bucket, CASE WHEN max(mean) OVER w - min(mean) OVER w < 0.01 THEN 0.5 ELSE (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) END AS level FROM bk WINDOW w AS (PARTITION BY user_id))"""


@query(f"WITH {_PROFILE} SELECT user_id, bucket, round(level, 5) AS level FROM pr")
def profile(spark: SparkSession, d: str) -> DataFrame:
    return signals.profile(table(spark, d, "events"), "user_id", ["event_id"], "value", 20).withColumn("level", F.round("level", 5))


@query(f"WITH {_PROFILE} SELECT user_id, string_agg(substr(' ▁▂▃▄▅▆▇█', least(CAST(floor(round(level, 9) * 8) AS INT) + 1, 8) + 1, 1), '' ORDER BY bucket) AS spark_line FROM pr GROUP BY user_id")
def sparkline(spark: SparkSession, d: str) -> DataFrame:
    p = signals.profile(table(spark, d, "events"), "user_id", ["event_id"], "value", 20)
    levels = p.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", F.round("level", 9).alias("level")))), lambda x: x["level"]).alias("levels"))
    return levels.select("user_id", text.sparkline(F.col("levels")).alias("spark_line"))


@query("SELECT set_id, time_bucket(INTERVAL '30 seconds', received_at) AS window_start, count(*) AS n FROM samples GROUP BY 1, 2")
def tumbling_30s(spark: SparkSession, d: str) -> DataFrame:
    return signals.tumbling(table(spark, d, "samples"), "received_at", "set_id").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Documents -----------------------------------------------------------------------------------


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The exported lists, each once."""
    return table(spark, d, "tracklists").distinct()


_T_SQL = "CASE WHEN t.ts >= 3600 THEN printf('%d:%02d:%02d', t.ts // 3600, t.ts % 3600 // 60, t.ts % 60) ELSE printf('%d:%02d', t.ts // 60, t.ts % 60) END"
_LISTS = "li AS (SELECT DISTINCT set_id, source_file, generated_on, tracks FROM tracklists), k AS (SELECT set_id, source_file, generated_on, list_filter(tracks, lambda t: NOT coalesce(t.rejected, false)) AS tracks FROM li)"
_UNID = "coalesce(t.artist, '') = '' AND coalesce(t.title, '') = ''"
_EACH = "x AS (SELECT set_id, source_file, generated_on, i, tracks[i] AS t, tracks FROM (SELECT set_id, source_file, generated_on, tracks, unnest(range(1, len(tracks) + 1)) AS i FROM k))"
_MARKDOWN = f"""md AS (SELECT k.set_id, '# Tracklist: ' || source_file || chr(10) || chr(10) || '*Generated on ' || coalesce(generated_on, '{NOW}') || '*' || chr(10) || chr(10) || coalesce(lines || chr(10), '') AS markdown
FROM k LEFT JOIN (SELECT set_id, string_agg(i || '. ' || CASE WHEN {_UNID} THEN '*Unidentified*' ELSE '**' || coalesce(t.artist, '') || '** - ' || coalesce(t.title, '') END || ' (' || {_T_SQL} || ')', chr(10) ORDER BY i) AS lines FROM x GROUP BY set_id) USING (set_id))"""


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("set_id", documents.markdown(F.col("source_file"), F.col("generated_on"), F.col("tracks"), F.lit(NOW)).alias("markdown"))


@query(f"WITH {_LISTS}, {_EACH}, {_MARKDOWN} SELECT * FROM md")
def render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d)


@query(rf"""WITH {_LISTS}, {_EACH}, {_MARKDOWN}, ln AS (SELECT set_id, regexp_replace(unnest(string_split(markdown, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM md),
m AS (SELECT set_id, regexp_extract(line, '^\d+\.\s+(?:\*\*(.+?)\*\*\s*-\s*(.+?)|\*Unidentified\*)\s*\((\d+:\d+(?::\d+)?)\)', ['artist', 'title', 'label']) AS r FROM ln
  WHERE regexp_matches(line, '^\d+\.\s+(?:\*\*(.+?)\*\*\s*-\s*(.+?)|\*Unidentified\*)\s*\((\d+:\d+(?::\d+)?)\)'))
SELECT set_id, CAST(CASE WHEN len(string_split(r.label, ':')) = 3 THEN string_split(r.label, ':')[1]::INT * 3600 + string_split(r.label, ':')[2]::INT * 60 + string_split(r.label, ':')[3]::INT ELSE string_split(r.label, ':')[1]::INT * 60 + string_split(r.label, ':')[2]::INT END AS INT) AS ts,
  regexp_replace(r.artist, '^\s+|\s+$', '', 'g') AS artist, regexp_replace(r.title, '^\s+|\s+$', '', 'g') AS title FROM m""")
def parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents parsed back; a track without an artist does not come back, as its line does not parse."""
    p = documents.parsed(_rendered(spark, d), "set_id", "markdown")
    return p.select("set_id", F.explode("tracks").alias("t")).select("set_id", "t.ts", "t.artist", "t.title")


@query(f"WITH {_LISTS} SELECT set_id, trim(source_file) AS source_file, coalesce(generated_on, '{NOW}') AS generated_on FROM k")
def parse_headers(spark: SparkSession, d: str) -> DataFrame:
    return documents.parsed(_rendered(spark, d), "set_id", "markdown").select("set_id", "source_file", "generated_on")


@query(f"WITH {_LISTS}, {_EACH} SELECT set_id, t.ts AS \"timestamp\", {_T_SQL} AS time, t.artist AS artist, t.title AS title, coalesce(t.rejected, false) AS rejected, t.shazam_url AS shazam_url, t.album AS album, t.coverart_url AS coverart_url FROM x")
def export_json_rows(spark: SparkSession, d: str) -> DataFrame:
    out = _lists(spark, d).select("set_id", F.explode(documents.json_rows(F.col("tracks"))).alias("r"))
    return out.select("set_id", "r.*")


@query(f"WITH {_LISTS} SELECT set_id, CAST(to_json(list_transform(tracks, lambda t: {{'timestamp': t.ts, 'time': {_T_SQL}, 'artist': t.artist, 'title': t.title, 'rejected': coalesce(t.rejected, false), 'shazam_url': t.shazam_url, 'album': t.album, 'coverart_url': t.coverart_url}})) AS VARCHAR) AS json FROM k")
def export_json_text(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("set_id", documents.json_text(F.col("tracks")).alias("json"))


_CHAPTERS = f"""{_DURATION}, {_LISTS}, {_EACH}, ch AS (SELECT set_id, CAST(i - 1 AS BIGINT) AS pos, 'chp' || CASE WHEN i - 1 < 1000 THEN lpad(CAST(i - 1 AS VARCHAR), 3, '0') ELSE CAST(i - 1 AS VARCHAR) END AS element_id,
  CAST(t.ts AS BIGINT) * 1000 AS start_ms, CASE WHEN i < len(tracks) THEN CAST(tracks[i + 1].ts AS BIGINT) * 1000 ELSE duration_ms END AS end_ms,
  CASE WHEN {_UNID} THEN 'Unknown Track' ELSE coalesce(t.artist, '') || ' - ' || coalesce(t.title, '') END AS title
  FROM x LEFT JOIN du USING (set_id) WHERE set_id IN (SELECT set_id FROM k WHERE len(list_filter(tracks, lambda t: NOT ({_UNID}))) > 0))"""


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d).where(documents.has_identified(F.col("tracks")))
    return lists.join(_durations(spark, d), "set_id", "left").select("set_id", documents.chapters(F.col("tracks"), F.col("duration_ms")).alias("chapters"))


@query(f"WITH {_CHAPTERS} SELECT * FROM ch")
def chapters(spark: SparkSession, d: str) -> DataFrame:
    return _chapters(spark, d).select("set_id", F.explode("chapters").alias("c")).select("set_id", "c.*")


@query(f"WITH {_CHAPTERS} SELECT set_id, 'Table of Contents' AS title, string_agg(element_id, ' ' ORDER BY pos) AS children FROM ch GROUP BY set_id")
def chapter_contents(spark: SparkSession, d: str) -> DataFrame:
    toc = _chapters(spark, d).select("set_id", documents.contents(F.col("chapters")).alias("c"))
    return toc.select("set_id", "c.title", F.array_join("c.child_element_ids", " ").alias("children"))


@query("""WITH j AS (SELECT set_id, ts, coverart_url FROM tracks QUALIFY row_number() OVER (PARTITION BY set_id, ts ORDER BY edited_at DESC NULLS LAST, track_id DESC) = 1),
li AS (SELECT DISTINCT set_id, source_file, generated_on, tracks FROM tracklists), e AS (SELECT set_id, unnest(tracks) AS t FROM li)
SELECT e.set_id, t.ts AS ts, t.artist AS artist, coalesce(nullif(j.coverart_url, ''), t.coverart_url) AS coverart_url FROM e LEFT JOIN j ON j.set_id = e.set_id AND j.ts = t.ts""")
def sidecar_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = _lists(spark, d).select("set_id", F.explode("tracks").alias("t")).select("set_id", "t.ts", "t.artist", "t.coverart_url")
    return documents.sidecar(e, table(spark, d, "tracks"), ["set_id", "ts"], "coverart_url", ["edited_at", "track_id"]).select("set_id", "ts", "artist", "coverart_url")


@query("""SELECT set_id, CASE WHEN coalesce(rejected, false) THEN 'REJECTED' WHEN (original_artist IS NOT NULL OR original_title IS NOT NULL) AND (artist IS DISTINCT FROM original_artist OR title IS DISTINCT FROM original_title) THEN 'EDITED'
  WHEN coalesce(artist, '') = '' AND coalesce(title, '') = '' THEN 'UNKNOWN' ELSE '' END AS status, count(*) AS n FROM tracks GROUP BY 1, 2""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    a = [F.col(c) for c in ("artist", "title", "original_artist", "original_title")]
    s = rows.status(F.coalesce("rejected", F.lit(False)), rows.was_corrected(*a), rows.is_unidentified(*a[:2]))
    return table(spark, d, "tracks").groupBy("set_id", s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT track_id, row_number() OVER (PARTITION BY set_id ORDER BY ts, track_id) AS number, CASE WHEN coalesce(artist, '') = '' AND coalesce(title, '') = '' THEN 'Unknown Track' ELSE coalesce(artist, '') || ' - ' || coalesce(title, '') END AS label,
  CASE WHEN ts >= 3600 THEN printf('%d:%02d:%02d', ts // 3600, ts % 3600 // 60, ts % 60) ELSE printf('%d:%02d', ts // 60, ts % 60) END AS time,
  CASE WHEN ts >= 3600 THEN printf('%dh %dm %ds', ts // 3600, ts % 3600 // 60, ts % 60) WHEN ts >= 60 THEN printf('%dm %ds', ts // 60, ts % 60) ELSE printf('%ds', ts) END AS duration FROM tracks WHERE NOT coalesce(rejected, false)""")
def numbered_labels(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    t = runs.numbered(table(spark, d, "tracks").where("NOT coalesce(rejected, false)").select("track_id", "set_id", "ts", "artist", "title"), "set_id", ["ts", "track_id"])
    return t.select("track_id", F.col("rn").alias("number"), rows.track_label(F.col("artist"), F.col("title")).alias("label"), text.time_label(ts).alias("time"), text.duration_label(ts).alias("duration"))


# Search terms, answers of services, choice -----------------------------------------------


# Blanks as the operator has them; DuckDB's own class of blanks is ASCII only.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _clean_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({column}, '{_BLANKS}*[(\[][^)\]]*[)\]]', '', 'g'), '(?i){_BLANKS}+(?:feat\.?|ft\.?|featuring){_BLANKS}+.*', '', 'g'), '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"


@query(f"WITH n AS (SELECT DISTINCT title FROM tracks WHERE title IS NOT NULL) SELECT title, {_clean_sql('title')} AS cleaned FROM n")
def clean_query(spark: SparkSession, d: str) -> DataFrame:
    """Every title with its cleaned form."""
    names = table(spark, d, "tracks").select("title").where("title IS NOT NULL").distinct()
    return names.select("title", text.search_name(F.col("title")).alias("cleaned"))


@query(r"""SELECT track_id, regexp_replace(coverart_url, '\d+x\d+(bb|cc)', '300x300\1', 'g') AS resized, regexp_replace('https://x/' || track_id || '/1000x1000-000.jpg', '/\d+x\d+-', '/600x600-', 'g') AS between_, replace('https://x/' || track_id || '/100x100bb.jpg', '100x100bb', '600x600bb') AS literal_ FROM tracks""")
def resize_url(spark: SparkSession, d: str) -> DataFrame:
    """Every track; without an address ``resized`` is null."""
    made = lambda tail: F.concat(F.lit("https://x/"), F.col("track_id").cast("string"), F.lit(tail))
    return table(spark, d, "tracks").select("track_id", text.resized(F.col("coverart_url"), 300).alias("resized"), text.resized_between(made("/1000x1000-000.jpg")).alias("between_"), text.resized_literal(made("/100x100bb.jpg")).alias("literal_"))


@query("""WITH n AS (SELECT track_id, coalesce(artist, '') AS artist, coalesce(title, '') AS title FROM tracks)
SELECT track_id, 'https://itunes.apple.com/search?term=' || replace(url_encode(artist || ' ' || title), '%20', '+') || '&entity=song&limit=1' AS song,
 'https://api.deezer.com/search?q=' || replace(url_encode('artist:"' || artist || '" track:"' || title || '"'), '%20', '+') AS album,
 'https://musicbrainz.org/ws/2/recording?query=' || replace(url_encode('artist:"' || artist || '" AND recording:"' || title || '"'), '%20', '+') || '&fmt=json&limit=1' AS recording FROM n""")
def search_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of every track in three catalogues; a null name counts as empty."""
    names = [F.coalesce(c, F.lit("")) for c in ("artist", "title")]
    return table(spark, d, "tracks").select("track_id", *[text.search_address(c, *names).alias(c) for c in ("song", "album", "recording")])


_ANSWERED = """a AS (SELECT set_id, sample_idx, received_at, CASE WHEN hit IS NULL THEN '{"matches": []}' ELSE CAST(to_json({'track': {'title': hit.title, 'subtitle': hit.artist, 'url': hit.shazam_url, 'images': {'coverarthq': '', 'coverart': hit.coverart_url}, 'sections': [{'metadata': [{'text': hit.album}]}]}}) AS VARCHAR) END AS answer FROM samples)"""


@query(f"""WITH {_ANSWERED} SELECT set_id, sample_idx, received_at, coalesce(json_extract_string(answer, '$.track.title'), CASE WHEN json_exists(answer, '$.track') THEN 'Unknown Title' END) AS title,
 coalesce(json_extract_string(answer, '$.track.subtitle'), CASE WHEN json_exists(answer, '$.track') THEN 'Unknown Artist' END) AS artist, json_extract_string(answer, '$.track.sections[0].metadata[0].text') AS album,
 coalesce(nullif(json_extract_string(answer, '$.track.images.coverarthq'), ''), nullif(json_extract_string(answer, '$.track.images.coverart'), '')) AS coverart_url FROM a""")
def recogniser_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a recogniser, as JSON, projected to matches."""
    s = table(spark, d, "samples")
    meta = F.array(F.struct(F.array(F.struct(F.col("hit.album").alias("text"))).alias("metadata")))
    track = F.struct(F.col("hit.title").alias("title"), F.col("hit.artist").alias("subtitle"), F.col("hit.shazam_url").alias("url"), F.struct(F.lit("").alias("coverarthq"), F.col("hit.coverart_url").alias("coverart")).alias("images"), meta.alias("sections"))
    answer = F.when(F.col("hit").isNull(), F.lit('{"matches": []}')).otherwise(F.to_json(F.struct(track.alias("track")), {"ignoreNullFields": "false"}))
    m = rows.recognised(s.select("set_id", "sample_idx", "received_at", answer.alias("answer")), F.col("answer"), "m")
    return m.select("set_id", "sample_idx", "received_at", "m.title", "m.artist", "m.album", "m.coverart_url")


@query("""WITH q AS (SELECT track_id, CASE WHEN track_id % 3 = 0 THEN '{"resultCount":0,"results":[]}' ELSE '{"resultCount":1,"results":[{"artworkUrl100":"https://x/' || track_id || '/100x100bb.jpg"}]}' END AS a1,
  CASE WHEN track_id % 4 = 0 THEN '{"data":[]}' WHEN track_id % 4 = 1 THEN '{"data":[{"album":{"cover_xl":"","cover_big":"https://x/b' || track_id || '"}}]}' ELSE '{"data":[{"album":{"cover_xl":"https://x/x' || track_id || '"}}]}' END AS a2,
  CASE WHEN track_id % 5 = 0 THEN '{"recordings":[]}' ELSE '{"recordings":[{"releases":[{"id":"r' || track_id || '"}]}]}' END AS a3 FROM tracks)
SELECT track_id, CASE WHEN CAST(json_extract(a1, '$.resultCount') AS INT) > 0 THEN nullif(json_extract_string(a1, '$.results[0].artworkUrl100'), '') END AS song,
  coalesce(nullif(json_extract_string(a2, '$.data[0].album.cover_xl'), ''), nullif(json_extract_string(a2, '$.data[0].album.cover_big'), '')) AS album, json_extract_string(a3, '$.recordings[0].releases[0].id') AS release FROM q""")
def catalogue_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three catalogues, as JSON, projected to addresses."""
    i = F.col("track_id")
    s = i.cast("string")
    a1 = F.when(i % 3 == 0, F.lit('{"resultCount":0,"results":[]}')).otherwise(F.concat(F.lit('{"resultCount":1,"results":[{"artworkUrl100":"https://x/'), s, F.lit('/100x100bb.jpg"}]}')))
    a2 = F.when(i % 4 == 0, F.lit('{"data":[]}')).when(i % 4 == 1, F.concat(F.lit('{"data":[{"album":{"cover_xl":"","cover_big":"https://x/b'), s, F.lit('"}}]}'))).otherwise(F.concat(F.lit('{"data":[{"album":{"cover_xl":"https://x/x'), s, F.lit('"}}]}')))
    a3 = F.when(i % 5 == 0, F.lit('{"recordings":[]}')).otherwise(F.concat(F.lit('{"recordings":[{"releases":[{"id":"r'), s, F.lit('"}]}]}')))
    return table(spark, d, "tracks").select("track_id", rows.song_cover(a1).alias("song"), rows.album_cover(a2).alias("album"), rows.release_id(a3).alias("release"))


@query(r"""WITH e AS (SELECT track_id, 1 AS priority, 'cdn resized' AS source, regexp_replace(coverart_url, '\d+x\d+(bb|cc)', '600x600\1', 'g') AS address FROM tracks UNION ALL
 SELECT track_id, 2, 'cdn original', coverart_url FROM tracks UNION ALL SELECT track_id, 3, 'album', album FROM tracks)
SELECT track_id, arg_min(source, priority) FILTER (address IS NOT NULL AND address <> '') AS source, arg_min(address, priority) FILTER (address IS NOT NULL AND address <> '') AS address FROM e GROUP BY track_id""")
def waterfall_first(spark: SparkSession, d: str) -> DataFrame:
    """The first address of each track, every source offered; those without an address fall through."""
    t = table(spark, d, "tracks")
    one = lambda p, name, url: t.select("track_id", F.lit(p).alias("priority"), F.lit(name).alias("source"), url.alias("address"))
    e = one(1, "cdn resized", text.resized(F.col("coverart_url"))).unionByName(one(2, "cdn original", F.col("coverart_url"))).unionByName(one(3, "album", F.col("album")))
    return choice.first_success(e, ["track_id"], "priority", "address", ["source", "address"])


@query(f"""WITH c AS (SELECT *, {_clean_sql('artist')} AS ca, {_clean_sql('title')} AS ct FROM tracks)
SELECT track_id, CASE WHEN coverart_url <> '' THEN 'cdn resized,cdn original,' ELSE '' END || 'song exact,' || CASE WHEN ca <> artist OR ct <> title THEN 'song cleaned,' ELSE '' END || 'album,recording' AS tried FROM c""")
def waterfall_order(spark: SparkSession, d: str) -> DataFrame:
    """Which sources are tried for a cover, in order, of every track."""
    c = choice.candidates(F.col("artist"), F.col("title"), F.col("coverart_url"))
    return table(spark, d, "tracks").select("track_id", F.array_join(F.transform(c, lambda x: x["source"]), ",").alias("tried"))


class _Recorded:
    """Answers as three catalogues and an image store give them, by the length of what is asked. An image store gives no JSON, a catalogue no image."""

    def call(self, request: str) -> str | bytes:
        import json
        from urllib.parse import parse_qs, urlsplit

        at = urlsplit(request)
        asked = parse_qs(at.query, keep_blank_values=True)
        n = len(next(iter(asked.values()))[0]) if asked else 0
        if at.netloc == "itunes.apple.com":
            return json.dumps({"resultCount": 0, "results": []} if n % 3 else {"resultCount": 1, "results": [{"artworkUrl100": f"https://img/s{n}/100x100bb.jpg"}]})
        if at.netloc == "api.deezer.com":
            return json.dumps({"data": []} if n % 2 else {"data": [{"album": {"cover_xl": "", "cover_big": f"https://img/a{n}/500x500-0.jpg"}}]})
        if at.netloc == "musicbrainz.org":
            return json.dumps({"recordings": [] if n % 5 == 0 else [{"releases": [{"id": f"r{n}"}]}]})
        if len(request) % 7 == 0:
            raise RuntimeError("no such image")
        return f"image of {request}".encode()


def _covers_sql() -> str:
    fetched = lambda c: f"({c} IS NOT NULL AND length({c}) % 7 <> 0)"
    song = lambda a, t: f"CASE WHEN length({a} || ' ' || {t}) % 3 = 0 THEN 'https://img/s' || length({a} || ' ' || {t}) || '/600x600bb.jpg' END"
    return f"""WITH n AS (SELECT track_id, coalesce(artist, '') AS artist, coalesce(title, '') AS title, nullif(coverart_url, '') AS url FROM tracks),
c AS (SELECT *, {_clean_sql('artist')} AS ca, {_clean_sql('title')} AS ct FROM n),
e AS (SELECT track_id, regexp_replace(url, '\\d+x\\d+(bb|cc)', '600x600\\1', 'g') AS u1, url AS u2, {song('artist', 'title')} AS u3, CASE WHEN ca <> artist OR ct <> title THEN {song('ca', 'ct')} END AS u4,
 CASE WHEN (length(artist) + length(title) + 18) % 2 = 0 THEN 'https://img/a' || (length(artist) + length(title) + 18) || '/600x600-0.jpg' END AS u5,
 CASE WHEN (length(artist) + length(title) + 26) % 5 <> 0 THEN 'https://coverartarchive.org/release/r' || (length(artist) + length(title) + 26) || '/front-500' END AS u6 FROM c)
SELECT track_id, CASE WHEN {fetched('u1')} THEN 'cdn resized' WHEN {fetched('u2')} THEN 'cdn original' WHEN {fetched('u3')} THEN 'song exact' WHEN {fetched('u4')} THEN 'song cleaned' WHEN {fetched('u5')} THEN 'album' WHEN {fetched('u6')} THEN 'recording' END AS source,
 'image of ' || CASE WHEN {fetched('u1')} THEN u1 WHEN {fetched('u2')} THEN u2 WHEN {fetched('u3')} THEN u3 WHEN {fetched('u4')} THEN u4 WHEN {fetched('u5')} THEN u5 WHEN {fetched('u6')} THEN u6 END AS image FROM e"""


@query(_covers_sql())
def covers_fetched(spark: SparkSession, d: str) -> DataFrame:
    """The cover of every track by search, answer and download, with recorded answers."""
    t = table(spark, d, "tracks").select("track_id", "artist", "title", "coverart_url")
    return covers.covers(t, "artist", "title", "coverart_url", _Recorded).select("track_id", "source", F.col("data").cast("string").alias("image"))


@query("SELECT set_id, arg_min(coverart_url, CAST(ts AS BIGINT) * 10000000000 + track_id) FILTER (coverart_url <> '') AS episode_image, count(*) FILTER (coverart_url <> '') AS images FROM tracks GROUP BY set_id")
def episode_image(spark: SparkSession, d: str) -> DataFrame:
    """The first image of a set."""
    has = F.col("coverart_url") != ""
    return table(spark, d, "tracks").groupBy("set_id").agg(F.min_by(F.when(has, F.col("coverart_url")), F.when(has, F.struct("ts", "track_id"))).alias("episode_image"), F.count_if(has).alias("images"))


@query("""WITH a AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'bitrate unknown' ELSE 'connection reset' END AS message, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 5 AS INT) AS attempt FROM events)
SELECT event_id, regexp_matches(lower(message), '429|too many|rate') AS again, CASE WHEN regexp_matches(lower(message), '429|too many|rate') AND attempt < 4 THEN CAST(30 * pow(2, attempt) AS DOUBLE) END AS wait_s FROM a""")
def retry_waits(spark: SparkSession, d: str) -> DataFrame:
    """The retry rule over a log of failures."""
    message = F.expr("CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Too Many Requests' WHEN 2 THEN 'bitrate unknown' ELSE 'connection reset' END")
    a = runs.numbered(table(spark, d, "events").select("event_id", "user_id"), "user_id", ["event_id"]).select("event_id", message.alias("message"), (F.col("rn") % 5).alias("attempt"))
    again = rows.may_retry(F.col("message"))
    return a.select("event_id", again.alias("again"), F.when(again & (F.col("attempt") < 4), 30 * F.pow(F.lit(2.0), F.col("attempt"))).alias("wait_s"))


# Edits -------------------------------------------------------------------------------------

_LOG = """lg AS (SELECT set_id, ts, edited_at, track_id, CASE WHEN rejected THEN 'toggle' ELSE 'edit' END AS action, artist, title, original_artist AS before_artist, original_title AS before_title FROM tracks)"""


@query(f"""WITH {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY set_id, ts, action ORDER BY edited_at NULLS FIRST, track_id) AS rn, row_number() OVER (PARTITION BY set_id, ts, action ORDER BY edited_at DESC NULLS LAST, track_id DESC) AS rd FROM lg)
SELECT set_id, ts, count(*) FILTER (action = 'toggle') % 2 = 1 AS rejected, max(artist) FILTER (action = 'edit' AND rd = 1) AS artist, max(title) FILTER (action = 'edit' AND rd = 1) AS title, max(before_artist) FILTER (action = 'edit' AND rn = 1) AS original_artist, max(before_title) FILTER (action = 'edit' AND rn = 1) AS original_title, count(*) FILTER (action = 'edit') AS edits
FROM o GROUP BY set_id, ts""")
def edit_log_fold(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tracks").select("set_id", "ts", "edited_at", "track_id", F.when(F.col("rejected"), "toggle").otherwise("edit").alias("action"), "artist", "title", F.col("original_artist").alias("before_artist"), F.col("original_title").alias("before_title"))
    return edits.folded(t, ["set_id", "ts"], ["edited_at", "track_id"])


# Processing settings and reports -----------------------------------------------------------


def _config(i: Column) -> dict[str, Column]:
    c = {k: F.lit(v) for k, v in audio.DEFAULTS.items()}
    return c | {"remove_silence": i % 2 == 0, "apply_compression": i % 3 == 0, "apply_normalization": i % 5 != 0, "target_loudness": -(F.col("n") % 10 + 10).cast("double")}


_CHAIN = """concat_ws(',', CASE WHEN i % 2 = 0 THEN 'silenceremove=start_periods=1:start_threshold=-50.0dB:start_duration=0.1' END, CASE WHEN i % 3 = 0 THEN 'acompressor=threshold=-18.0dB:ratio=3.0:attack=20.0:release=250.0' END,
 CASE WHEN i % 5 <> 0 THEN 'loudnorm=I=-' || (i % 10 + 10) || '.0:TP=-1.5:LRA=11.0' END)"""
_ITEMS = "it AS (SELECT artist_id AS i, name FROM artists)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artists").select(F.col("artist_id").alias("n"), "name")


@query(f"WITH {_ITEMS} SELECT i AS n, {_CHAIN} AS chain FROM it")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("n", audio.filter_chain(_config(F.col("n"))).alias("chain"))


@query(f"""WITH {_ITEMS} SELECT i AS n, concat_ws(' ', 'ffmpeg -y', CASE WHEN i % 2 = 0 THEN '-i /in/' || name || '.wav' ELSE '-f concat -safe 0 -i /work/list.txt' END, CASE WHEN {_CHAIN} <> '' THEN '-af ' || {_CHAIN} END, '-c:a libmp3lame -b:a 192k /out.mp3') AS command,
 'file ''' || replace('/in/' || name || '.wav', '''', '''\\''''') || '''' AS listing FROM it""")
def encoder_arguments(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    path = F.concat(F.lit("/in/"), F.col("name"), F.lit(".wav"))
    inputs = F.when(n % 2 == 0, F.array(path)).otherwise(F.array(path, path))
    args = audio.arguments(inputs, F.lit("/work/list.txt"), audio.filter_chain(_config(n)), F.lit("192k"), F.lit("/out.mp3"))
    return _items(spark, d).select("n", F.array_join(args, " ").alias("command"), audio.listing_line(path).alias("listing"))


@query(f"""WITH {_ITEMS} SELECT i AS n, concat_ws(',', CASE WHEN i % 7 = 0 THEN 'concat' END, CASE WHEN (i % 2 = 0) THEN 'silence' END, CASE WHEN (i % 3 = 0) <> (true) THEN 'compress' END, CASE WHEN i % 5 <> 0 THEN 'normalize' END, 'export') AS toggled,
 concat_ws(',', CASE WHEN i % 7 = 0 THEN 'concat' END, 'silence,compress,normalize,export') AS all_on, CAST(0 AS INT) AS none_on FROM it""")
def stage_selection(spark: SparkSession, d: str) -> DataFrame:
    s = audio.stages(_config(F.col("n")), F.col("n") % 7 == 0)
    keys = lambda x: F.array_join(audio.selected(x), ",")
    return _items(spark, d).select("n", keys(audio.toggled(s, ["compress"])).alias("toggled"), keys(audio.switched(s, True)).alias("all_on"), F.size(audio.selected(audio.switched(s, False))).alias("none_on"))


@query(r"""WITH r AS (SELECT event_id, 'pre {"input_i" : "-' || (event_id % 30) || '.5", "input_tp" : "' || CASE WHEN event_id % 11 = 0 THEN 'inf?' ELSE '-1.' || (event_id % 10) END || '"' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ', "input_lra" : "7.25"' END || '} RMS_level=-' || (event_id % 60) || '.25 RMS_level=-inf RMS_level=-12.5' AS report FROM events)
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST('-' || (event_id % 30) || '.5' AS DOUBLE) END AS loudness_i, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE 7.25::DOUBLE END END AS loudness_range,
 len(regexp_extract_all(report, 'RMS_level=(-?[\d.]+)', 1)) AS series, round(list_sum(list_transform(regexp_extract_all(report, 'RMS_level=(-?[\d.]+)', 1), lambda x: CAST(x AS DOUBLE))), 4) AS total FROM r""")
def report_figures(spark: SparkSession, d: str) -> DataFrame:
    """Loudness and level series taken from a tool's report."""
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    peak = F.when(i % 11 == 0, F.lit("inf?")).otherwise(F.concat(F.lit("-1."), s(i % 10)))
    lra = F.when(i % 3 == 0, F.lit("")).otherwise(F.lit(', "input_lra" : "7.25"'))
    report = F.concat(F.lit('pre {"input_i" : "-'), s(i % 30), F.lit('.5", "input_tp" : "'), peak, F.lit('"'), lra, F.lit("} RMS_level=-"), s(i % 60), F.lit(".25 RMS_level=-inf RMS_level=-12.5"))
    series = rows.levels(F.col("report"))
    out = table(spark, d, "events").select("event_id", report.alias("report")).select("event_id", rows.loudness(F.col("report")).alias("l"), series.alias("v"))
    return out.select("event_id", "l.loudness_i", "l.loudness_range", F.size("v").cast("bigint").alias("series"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH p AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, sum(CASE WHEN value > 0 THEN value END) AS duration, count(*) AS files, count(*) * 1048576 AS size FROM events GROUP BY 1, 2),
j AS (SELECT b.user_id, b.duration AS bd, a.duration AS ad, b.size AS bs, a.size AS az FROM p b JOIN p a ON a.user_id = b.user_id AND a.phase = 'after' WHERE b.phase = 'before')
SELECT user_id, CASE WHEN bd >= 3600 THEN printf('%dh %dm %ds', CAST(floor(bd / 3600) AS BIGINT), CAST(floor(bd % 3600 / 60) AS BIGINT), CAST(floor(bd % 60) AS BIGINT)) WHEN bd >= 60 THEN printf('%dm %ds', CAST(floor(bd / 60) AS BIGINT), CAST(floor(bd % 60) AS BIGINT)) WHEN bd IS NOT NULL THEN printf('%ds', CAST(floor(bd) AS BIGINT)) END AS before_, CASE WHEN bd - ad > 1.0 THEN round(bd - ad, 4) END AS trimmed, CAST(bs / 1048576.0 AS DOUBLE) AS mb_before, CASE WHEN round(ad - bd, 6) >= 0 THEN '+' ELSE '' END || printf('%.1f', round(ad - bd, 6)) AS change FROM j""")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    """The report of a processing step: two phases of each item side by side."""
    e = table(spark, d, "events")
    phase = F.when(F.col("event_id") % 2 == 0, "before").otherwise("after")
    p = e.groupBy("user_id", phase.alias("phase")).agg(F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("duration"), (F.count(F.lit(1)) * 1048576).alias("size"))
    b, a = (p.where(F.col("phase") == x).select("user_id", F.col("duration").alias(f"{x[0]}d"), F.col("size").alias(f"{x[0]}s")) for x in ("before", "after"))
    j = b.join(a, "user_id")
    change = text.signed_change(F.lit(0.0), F.round(F.col("ad") - F.col("bd"), 6))
    return j.select("user_id", text.duration_label(F.col("bd")).alias("before_"), F.when(F.col("bd") - F.col("ad") > 1.0, F.round(F.col("bd") - F.col("ad"), 4)).alias("trimmed"), text.megabytes(F.col("bs")).alias("mb_before"), change.alias("change"))


@query("""WITH s AS (SELECT part_id, size, CAST(floor(size * 0.72::DOUBLE) AS INT) AS bar, size // 30 AS pad, greatest(size // 18, 16) AS th, greatest(size // 22, 13) AS ah FROM (SELECT p_partkey AS part_id, CAST(p_size AS INT) * 20 AS size FROM part))
SELECT part_id, bar AS bar_top, pad AS padding, th AS title_height, ah AS artist_height, bar + pad AS title_y, bar + pad + th + pad // 2 AS artist_y, size - 2 * pad AS text_width, '.aac, .aiff, .flac, .m4a, .mp3, .ogg, .wav, .wma' AS formats FROM s""")
def card_geometry(spark: SparkSession, d: str) -> DataFrame:
    """The layout of image cards of many sizes, and the formats that a message names."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), rows.card_layout(F.col("p_size").cast("int") * 20).alias("c"))
    return p.select("part_id", "c.*", rows.supported_formats().alias("formats"))


# Files ---------------------------------------------------------------------------------------


@query(r"""WITH f AS (SELECT DISTINCT set_id, '/in/' || source_file AS path FROM tracklists), s AS (SELECT set_id, path, lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS suffix, regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1) AS stem FROM f)
SELECT set_id, path, suffix, stem || '_tracklist.md' AS markdown, stem || '_progress.json' AS progress, stem || '.json' AS sidecar, stem AS label FROM s WHERE suffix IN ('.mp3', '.wav', '.flac', '.m4a', '.ogg', '.aac', '.wma', '.aiff')""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Audio files and the names of what is made from them."""
    f = table(spark, d, "tracklists").select("set_id", F.concat(F.lit("/in/"), F.col("source_file")).alias("path")).distinct()
    base = text.stem(F.col("path"))
    named = lambda tail: F.concat(base, F.lit(tail))
    s = f.select("set_id", "path", text.suffix(F.col("path")).alias("suffix"), named("_tracklist.md").alias("markdown"), named("_progress.json").alias("progress"), named(".json").alias("sidecar"), text.episode_label(named("_tracklist.md")).alias("label"))
    return s.where(rows.is_audio(F.col("suffix")))


@query(r"""WITH f AS (SELECT DISTINCT regexp_extract(source_file, '([^/]*?)(\.[^./]*)?$', 1) AS stem, set_id FROM tracklists WHERE source_file IS NOT NULL), p AS (SELECT stem || '_tracklist' AS list_stem, '/a/' || stem || e AS path, e, row_number() OVER () AS x FROM f, (SELECT unnest(['.flac', '.mp3']) AS e))
SELECT list_stem, min(path) FILTER (e = '.mp3') AS path FROM p GROUP BY list_stem""")
def matching_files(spark: SparkSession, d: str) -> DataFrame:
    """The audio file of each list by stem; a fixed order of extensions decides."""
    f = table(spark, d, "tracklists").where("source_file IS NOT NULL").select(text.stem(F.col("source_file")).alias("stem")).distinct()
    files = f.select("stem", F.explode(F.array(F.lit(".flac"), F.lit(".mp3"))).alias("suffix")).withColumn("path", F.concat(F.lit("/a/"), "stem", "suffix"))
    return choice.matching_file(f.select(F.concat("stem", F.lit("_tracklist")).alias("list_stem")), files, rows.AUDIO)


@query("SELECT count(*) AS files, count(DISTINCT set_id) AS sets, CAST(sum(len(tracks)) AS BIGINT) AS tracks, max(source_file) AS last_file FROM tracklists")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tracklists").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("set_id").alias("sets"), F.sum(F.size("tracks")).alias("tracks"), F.max("source_file").alias("last_file"))


@query("SELECT set_id, sample_idx, 'old' AS origin FROM samples WHERE sample_idx < 10 UNION ALL SELECT set_id, sample_idx, 'new' FROM samples WHERE sample_idx >= 10")
def resumed_union(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples").select("set_id", "sample_idx")
    return s.where("sample_idx < 10").withColumn("origin", F.lit("old")).unionByName(s.where("sample_idx >= 10").withColumn("origin", F.lit("new")))


@query("SELECT set_id, arg_max(track_id, CAST(ts AS BIGINT) * 10000000000 + track_id) AS last_track, CAST(max(ts) AS BIGINT) AS last_ts FROM tracks GROUP BY set_id")
def last_processed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tracks").groupBy("set_id").agg(F.max_by("track_id", F.struct("ts", "track_id")).alias("last_track"), F.max("ts").cast("bigint").alias("last_ts"))


# Streams -------------------------------------------------------------------------------------


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a stream writes."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _sample_stream(spark: SparkSession, d: str, per_trigger: int = 4) -> DataFrame:
    return jobs.stream(spark, f"{d}/samples.parquet*", table(spark, d, "samples"), per_trigger)


@query("SELECT set_id, sample_idx, received_at FROM samples")
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """All files loaded by a stream, in steps; a second run finds nothing new and adds nothing."""
    at = _work_folder(spark, "incremental")
    for _ in range(2):
        jobs.run_available(_sample_stream(spark, d).select("set_id", "sample_idx", "received_at"), jobs.append_to(f"{at}/out"), f"{at}/offsets")
    return spark.read.parquet(f"{at}/out").select("set_id", "sample_idx", "received_at")


def _as_received(samples: DataFrame, folder: str, batch: Callable[[DataFrame], None], steps: int = 3) -> None:
    """The samples in ``steps`` parts in the order in which they were received: each is written to the folder and streamed before the next one comes."""
    rows_ = samples.withColumn("_us", F.unix_micros(F.col("received_at").cast("timestamp")))
    at = rows_.agg(F.percentile_approx("_us", [k / steps for k in range(1, steps)]).alias("q")).first()["q"] or []
    for lo, hi in zip([None, *at], [*at, None]):
        part = rows_.where((F.coalesce(F.col("_us") > lo, F.lit(False)) if lo is not None else F.lit(True)) & (F.coalesce(F.col("_us") <= hi, F.lit(True)) if hi is not None else F.lit(True)))
        part.drop("_us").write.mode("append").parquet(folder)
        batch(jobs.stream(samples.sparkSession, folder, samples))


@query("""WITH w AS (SELECT set_id, time_bucket(INTERVAL '30 seconds', received_at) AS window_start, count(*) AS n FROM samples WHERE set_id IS NOT NULL GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL '30 seconds' <= (SELECT max(received_at) - INTERVAL '10 minutes' FROM samples)""")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Windows of the clock over a stream in several batches, each given once, when the watermark has passed its end; files come in the order of arrival, so none is late."""
    at = _work_folder(spark, "tumbling")
    rows_ = table(spark, d, "samples").where("set_id IS NOT NULL").select("set_id", "received_at")
    counted = lambda x: jobs.run_available(jobs.tumbling(x, "received_at", "set_id", late="10 minutes"), jobs.append_to(f"{at}/out"), f"{at}/offsets")
    _as_received(rows_, f"{at}/in", counted)
    return spark.read.parquet(f"{at}/out").select("set_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(f"WITH {_LATEST}, y AS (SELECT *, {_K0} FROM s), {_runs_sql('y')}")
def stream_collapse(spark: SparkSession, d: str) -> DataFrame:
    """The collapse kept up to date by a stream of several batches: each collapses the sets again that it touches."""
    at = _work_folder(spark, "collapse")
    s = table(spark, d, "samples").where("set_id IS NOT NULL AND sample_idx IS NOT NULL")
    s = s.select("set_id", "sample_idx", "received_at", F.col("ts").cast("bigint").alias("ts"), F.col("hit.artist").alias("artist"), F.col("hit.title").alias("title"))
    key = lambda: F.when(~rows.is_unidentified(F.col("artist"), F.col("title")), text.recording_key(F.col("artist"), F.col("title")))
    sink = jobs.collapse_arrived(f"{at}/store", f"{at}/out", key, ["ts", "artist", "title"])
    _as_received(s, f"{at}/in", lambda x: jobs.run_available(x, sink, f"{at}/offsets"))
    named = lambda c: F.when(F.col("matched"), F.col(c)).otherwise("").alias(c)
    return spark.read.parquet(f"{at}/out").select("set_id", "sample_idx", "ts", named("artist"), named("title"), "run")
