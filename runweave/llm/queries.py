"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import copies, heavy, leaks, packing, pairs, plainform, quality, runs, variants
from runweave.operators import multivalue
from runweave.operators.joins import spread_join
from runweave.sources.tables import table


def _hit_fields() -> dict:
    return {"artist": F.col("hit.artist"), "title": F.col("hit.title")}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.by_share(table(spark, d, "samples"), _hit_fields(), 8, 1000).select("field", "item")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    return heavy.top_k(table(spark, d, "samples"), _hit_fields(), 50)


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tracklists").select(F.col("set_id").alias("basket"), F.explode("tracks").alias("t"))
    return rows.where("NOT coalesce(t.rejected, false)").select("basket", pairs.plain(F.col("t.title")).alias("item"))


def _pairs(spark: SparkSession, d: str, least: int = 5) -> DataFrame:
    n = table(spark, d, "tracklists").agg(F.countDistinct("set_id").alias("n"))
    return pairs.pairs(_baskets(spark, d), min_count=least).crossJoin(F.broadcast(n))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("n_ab * n >= 5 * n_a * n_b").select(F.col("item_a").alias("title_a"), F.col("item_b").alias("title_b"))


def _scores(found: DataFrame) -> DataFrame:
    out = pairs.scored(found, F.col("n"))
    return out.select(F.col("item_a").alias("title_a"), F.col("item_b").alias("title_b"), "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of five sets or more."""
    return _scores(_pairs(spark, d))


def p2_all_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that occurs at all."""
    return _scores(_pairs(spark, d, 1))


def p3_plain(spark: SparkSession, d: str) -> DataFrame:
    return plainform.changed(table(spark, d, "tracks"), "track_id", ["artist", "title"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_plain(spark, d).select("track_id", "field")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    events = s.select(F.col("set_id").alias("seq"), F.col("sample_idx").alias("idx"), "ts", F.col("hit.artist").alias("artist"), F.col("hit.title").alias("title"), F.col("received_at").alias("received"))
    return runs.runs(events).withColumnRenamed("seq", "set_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_runs(spark, d).where("n > 1").select("set_id", "first_ts", "last_ts")


def _one_act(spark: SparkSession, d: str, names: DataFrame) -> DataFrame:
    """The names that hold a single act."""
    register = table(spark, d, "artists").select("name")
    twice = names.select(F.col("name").alias("whole"), F.col("name").alias("text"))
    given = multivalue.given_words(register).unionByName(spark.createDataFrame([(n,) for n in sorted(variants.FIRST)], "name string"))
    several = multivalue.split_values(twice, "whole", "text", protected=register, given=given, least=2, whole=register).select(F.col("whole").alias("name")).distinct()
    return names.join(several, "name", "left_anti")


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Fields of tracks that name one act of the register in another spelling, with the rule."""
    t = table(spark, d, "tracks")
    fields = {"artist": F.col("artist"), "original_artist": F.col("original_artist"), "title": variants.credit(F.col("title"))}
    held = t.select("track_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("name")) for n, c in fields.items()])).alias("x")).select("track_id", "x.field", "x.name").where("name <> ''")
    distinct = held.select("name").distinct()
    single = _one_act(spark, d, distinct)
    found = variants.resolve(single, table(spark, d, "artists").select(F.col("artist_id").alias("id"), "name"))
    return spread_join(held, found, "name", "track_id", "inner").select("track_id", "field", F.col("id").alias("artist_id"), "name", "rule", F.round("score", 6).alias("score"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).select("track_id", "field", "artist_id")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """One row per entry with its number of copies."""
    return _copies(spark, d).where("id = keep_id").select(F.col("keep_id"), F.col("n").alias("copies"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "tracks"), "track_id", ["artist", "title"], ["set_id", "ts"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))


#: Tokens that a container holds.
CONTAINER_TOKENS = 4096


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one over the capacity, with its container and place in it."""
    sized = packing.count_tokens(table(spark, d, "documents"), "doc_id", "text")
    return packing.fill(sized, CONTAINER_TOKENS).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, how many the search made, and how many lie in shards whose number of containers is not known to be the least."""
    each = p8_containers(spark, d).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.first("made").alias("made"), F.min("proven").alias("proven"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
        F.lit(CONTAINER_TOKENS).cast("bigint").alias("capacity"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * CONTAINER_TOKENS), 6).alias("filled"),
        F.count_if(F.col("made") == "search").alias("by_search"), F.count_if(F.col("made") == "best fit").alias("by_best_fit"), F.count_if(~F.col("proven")).alias("unproven"),
    )


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of documents to remove, with the passage that each holds."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items")).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "item_id").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts alone."""
    return p10_statistics(spark, d).select("doc_id", "n_chars", "n_words", "n_lines", F.round("repeated_lines", 6).alias("repeated_lines"), F.round("closed_lines", 6).alias("closed_lines"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("not_prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p2_found, p2_scores, p2_all_scores, p3_found, p3_plain, p4_found, p4_runs, p6_found, p6_links, p7_found, p7_copies, p8_containers, p8_fill, p9_found, p9_spans, p10_found, p10_statistics, p10_counts)}

_VALUES = """SELECT 'artist' AS field, hit.artist AS item FROM samples WHERE hit.artist <> ''
  UNION ALL SELECT 'title', hit.title FROM samples WHERE hit.title <> ''"""

_PAIRS_FROM = r"""it AS (
  SELECT DISTINCT set_id, trim(regexp_replace(lower(t.title), '\s+', ' ', 'g')) AS title
  FROM (SELECT set_id, unnest(tracks) AS t FROM tracklists) WHERE NOT coalesce(t.rejected, false)
), i AS (SELECT * FROM it WHERE title <> '' AND set_id IS NOT NULL),
c AS (SELECT title, count(*) AS n_i FROM i GROUP BY 1),
n AS (SELECT count(DISTINCT set_id) AS n FROM tracklists),
f AS (SELECT set_id, title FROM i JOIN c USING (title) WHERE n_i >= LEAST_SETS),
ab AS (SELECT x.title AS title_a, y.title AS title_b, count(*) AS n_ab FROM f x JOIN f y ON x.set_id = y.set_id AND x.title < y.title GROUP BY 1, 2 HAVING count(*) >= LEAST_SETS),
s AS (SELECT title_a, title_b, ca.n_i AS n_a, cb.n_i AS n_b, n_ab, n FROM ab JOIN c ca ON ca.title = title_a JOIN c cb ON cb.title = title_b CROSS JOIN n)"""

_PAIRS, _ALL_PAIRS = (_PAIRS_FROM.replace("LEAST_SETS", n) for n in ("5", "1"))

# Rows of one entry that share the joined text of their fields in either order, and what follows from them.
_COPIES = r"""k AS (SELECT track_id, coalesce('=' || set_id, '-') || chr(1) || coalesce('=' || ts, '-') AS g, regexp_replace(lower(nfc_normalize(coalesce(artist, ''))), '[^\p{L}\p{N}]', '', 'g') AS a, regexp_replace(lower(nfc_normalize(coalesce(title, ''))), '[^\p{L}\p{N}]', '', 'g') AS t FROM tracks WHERE track_id IS NOT NULL),
j AS (SELECT track_id, g, a || t AS s FROM k WHERE a || t <> '' UNION SELECT track_id, g, t || a FROM k WHERE a || t <> ''),
e AS (SELECT DISTINCT x.track_id AS u, y.track_id AS v FROM j x JOIN j y ON x.g = y.g AND x.s = y.s),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
m AS (SELECT u AS track_id, min(v) AS keep_id, count(*) AS n FROM r GROUP BY u)"""

# Lines, words and repeated lines as the operator counts them: tags are blanks, a word is a run of letters, marks and digits.
_COUNTS = r"""t AS (SELECT doc_id, text, regexp_replace(text, '<(/|[A-Za-z])[^>]{0,58}>', ' ', 'g') AS bare FROM documents),
l AS (SELECT doc_id, list_filter(string_split(replace(text, chr(13), ' '), chr(10)), lambda x: regexp_matches(regexp_replace(x, '<(/|[A-Za-z])[^>]{0,58}>', ' ', 'g'), '[^\s\p{Z}]')) AS lines FROM t),
r AS (SELECT doc_id, count(*) AS k, count(DISTINCT lower(line)) AS u, count(*) FILTER (regexp_matches(line, '[.!?…:;"”»]([\s\p{Z}]|<(/|[A-Za-z])[^>]{0,58}>)*$')) AS closed FROM (SELECT doc_id, unnest(lines) AS line FROM l) GROUP BY doc_id)"""

SQL = {
    "p10_counts": f"""WITH {_COUNTS} SELECT doc_id, length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(bare, ''), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS n_words, coalesce(k, 0) AS n_lines,
  round(CAST(k - u AS DOUBLE) / k, 6) AS repeated_lines, round(CAST(closed AS DOUBLE) / k, 6) AS closed_lines FROM t LEFT JOIN r USING (doc_id)""",
    "p7_found": f"WITH RECURSIVE {_COPIES} SELECT keep_id, track_id AS dup_id FROM m WHERE track_id <> keep_id",
    "p7_copies": f"WITH RECURSIVE {_COPIES} SELECT keep_id, n AS copies FROM m WHERE track_id = keep_id",
    "p1_found": f"""WITH v AS ({_VALUES}), t AS (SELECT field, count(*) AS total FROM v GROUP BY 1)
SELECT field, item FROM v JOIN t USING (field) GROUP BY field, item, total HAVING count(*) * 1000 >= total * 8""",
    "p1_top": f"""WITH v AS ({_VALUES}), c AS (SELECT field, item, count(*) AS n FROM v GROUP BY 1, 2)
SELECT * FROM (SELECT field, item, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, item) AS rank FROM c) WHERE rank <= 50""",
    "p2_found": f"WITH {_PAIRS} SELECT title_a, title_b FROM s WHERE n_ab * n >= 5 * n_a * n_b",
    "p2_scores": f"""WITH {_PAIRS} SELECT title_a, title_b, n_a, n_b, n_ab,
  round(CAST(n_ab * n AS DOUBLE) / (n_a * n_b), 6) AS lift,
  round(CASE WHEN n_a > n_ab THEN CAST(n_a * (n - n_b) AS DOUBLE) / (n * (n_a - n_ab)) END, 6) AS conviction FROM s""",
    "p2_all_scores": f"""WITH {_ALL_PAIRS} SELECT title_a, title_b, n_a, n_b, n_ab,
  round(CAST(n_ab * n AS DOUBLE) / (n_a * n_b), 6) AS lift,
  round(CASE WHEN n_a > n_ab THEN CAST(n_a * (n - n_b) AS DOUBLE) / (n * (n_a - n_ab)) END, 6) AS conviction FROM s""",
}
