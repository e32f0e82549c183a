"""The three ways through the engine, as plans over tables with providers for what lies outside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.functions import audio, rows, text
from runweave.operators import corrections, documents, runs, signals
from runweave.operators.covers import covers
from runweave.session import cut
from runweave.sources.providers import Provider, ask

HIT = ["title", "artist", "shazam_url", "album", "coverart_url"]


def recognise(sets: DataFrame, done: DataFrame | None, make: Callable[[], Provider], *, step_ms: int = 30_000, delay: float = 0.0, tasks: int | None = None) -> DataFrame:
    """sets: set_id, duration_ms. done: set_id, sample_idx, ts, hit of finished samples. Gives all samples, asking the
    provider only for slices that are not done. The request is ``set_id`` and the slice's start."""
    parts = signals.slices(sets.select("set_id", "duration_ms"), "duration_ms", step_ms)
    if done is not None:
        parts = signals.unfinished(parts, done, ["set_id", "sample_idx"])
    asked = ask(parts.withColumn("request", F.concat_ws("@", "set_id", F.col("start_ms").cast("string"))), "request", make, delay=delay, tasks=tasks)
    # Settled, as every later use of the rows would ask the provider again.
    new = rows.recognised(cut(asked), F.col("answer"), "hit").select("set_id", "sample_idx", F.col("ts").cast("int").alias("ts"), "hit")
    return new if done is None else done.select("set_id", "sample_idx", "ts", "hit").unionByName(new)


def tracklists(samples: DataFrame, sets: DataFrame, log: DataFrame, generated_on: Column) -> DataFrame:
    """samples: set_id, sample_idx, ts, hit. sets: set_id, source_file. log: the corrections. Gives set_id, source_file,
    generated_on and the array of tracks: corrected, one-off matches suppressed, runs collapsed with gaps."""
    flat = samples.select("set_id", "sample_idx", "ts", *[F.col(f"hit.{c}").alias(c) for c in HIT], F.lit(None).cast("string").alias("original_artist"), F.lit(None).cast("string").alias("original_title"), F.col("hit").isNotNull().alias("is_match"))
    # Samples without a match do not take part: nothing could be found for them.
    every = corrections.apply(flat, corrections.dimension(log), skip_unidentified=False, only=F.col("is_match"))
    key = F.when(~rows.is_unidentified(F.col("artist"), F.col("title")), text.recording_key(F.col("artist"), F.col("title")))
    fields = ["ts", "artist", "title", "shazam_url", "album", "coverart_url", "original_artist", "original_title"]
    out = runs.collapse(every, "set_id", "sample_idx", key, fields)
    kept = lambda c, empty: F.when(F.col("matched"), F.col(c)).otherwise(empty).alias(c)
    track = F.struct(
        "ts", kept("artist", F.lit("")), kept("title", F.lit("")), F.lit(False).alias("rejected"),
        *[kept(c, F.lit(None).cast("string")) for c in ("shazam_url", "album", "coverart_url", "original_artist", "original_title")],
    )
    # A tracklist is a document of its set, which its reader holds whole.
    lists = out.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", track.alias("t")))).alias("a"))
    held = sets.select("set_id", "source_file").join(lists, "set_id", "left")
    none = F.array().cast(lists.select(F.transform("a", lambda x: x["t"]).alias("t")).schema["t"].dataType)
    return held.select("set_id", "source_file", generated_on.alias("generated_on"), F.coalesce(F.transform("a", lambda x: x["t"]), none).alias("tracks"))


def chapter_plan(texts: DataFrame, extra: DataFrame, sets: DataFrame, make: Callable[[], Provider]) -> tuple[DataFrame, DataFrame]:
    """texts: set_id, markdown. extra: set_id, ts, coverart_url, seq (sidecars). sets: set_id, duration_ms. Gives the chapters
    with their images, and of each set the contents and the first image. Sets without a named track have no chapters."""
    parsed = documents.parsed(texts, "set_id", "markdown").select("set_id", F.expr("transform(tracks, t -> named_struct('ts', t.ts, 'artist', t.artist, 'title', t.title, 'rejected', false))").alias("tracks"))
    lists = parsed.where(documents.has_identified(F.col("tracks"))).join(sets.select("set_id", "duration_ms"), "set_id", "left")
    made = lists.select("set_id", documents.chapters(F.col("tracks"), F.col("duration_ms")).alias("chapters"), "tracks")
    each = made.select("set_id", F.explode(F.arrays_zip("chapters", "tracks")).alias("z")).select("set_id", "z.chapters.*", F.col("z.tracks.ts").alias("ts"), F.col("z.tracks.artist").alias("artist"), F.col("z.tracks.title").alias("track_title"))
    covered = documents.sidecar(each, extra, ["set_id", "ts"], "coverart_url", ["seq"])
    named = ~rows.is_unidentified(F.col("artist"), F.col("track_title"))
    images = covers(covered, "artist", "track_title", "coverart_url", make, wanted=named).select("set_id", "pos", "element_id", "start_ms", "end_ms", "title", "source", F.col("data").alias("image"))
    first = F.min_by("image", F.when(F.col("image").isNotNull(), F.col("pos")))
    contents = images.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("pos", "element_id"))).alias("c"), first.alias("episode_image"))
    return images, contents.select("set_id", F.transform("c", lambda x: x["element_id"]).alias("child_element_ids"), "episode_image")


def processing_plan(jobs: DataFrame, config: dict[str, Column], output: Column, folder: str = "") -> DataFrame:
    """jobs: job_id, inputs (array of paths). Gives the steps on offer, the filter chain and the encoder's arguments of each.
    folder: where the encoder finds the listing files, with a slash at its end."""
    chain = audio.filter_chain(config)
    listing = F.concat(F.lit(folder), F.col("job_id").cast("string"), F.lit(".txt"))
    return jobs.select(
        "job_id", audio.stages(config, F.size("inputs") > 1).alias("stages"), chain.alias("chain"),
        audio.arguments(F.col("inputs"), listing, chain, config["bitrate"], output).alias("arguments"), F.array_join(F.transform("inputs", audio.listing_line), "\n").alias("listing"),
    )


def processing_report(analyses: DataFrame) -> DataFrame:
    """analyses: job_id, phase ('before' or 'after'), duration, size_bytes, report (loudness), levels (report). One row per job with
    both phases side by side; a figure that is missing on either side is left out."""
    figures = analyses.select("job_id", "phase", "duration", "size_bytes", rows.loudness(F.col("report")).alias("l"), signals.profile_array(rows.levels(F.col("levels"))).alias("w"))
    of = lambda p: figures.where(F.col("phase") == p).select("job_id", *[F.col(c).alias(f"{c}_{p}") for c in ("duration", "size_bytes", "l", "w")])
    j = of("before").join(of("after"), "job_id")
    both = (F.col("duration_before") > 0) & (F.col("duration_after") > 0)
    trimmed = F.col("duration_before") - F.col("duration_after")
    sized = (F.col("size_bytes_before") > 0) & (F.col("size_bytes_after") > 0)
    change = lambda k: text.signed_change(F.col(f"l_before.{k}"), F.col(f"l_after.{k}"))
    return j.select(
        "job_id",
        F.when(both, text.duration_label(F.col("duration_before"))).alias("duration_before"), F.when(both, text.duration_label(F.col("duration_after"))).alias("duration_after"),
        F.when(both & (trimmed > 1.0), text.duration_label(trimmed)).alias("trimmed"),
        F.when(sized, text.megabytes(F.col("size_bytes_before"))).alias("mb_before"), F.when(sized, text.megabytes(F.col("size_bytes_after"))).alias("mb_after"),
        change("loudness_i").alias("loudness_change"), change("true_peak").alias("peak_change"), change("loudness_range").alias("range_change"),
        text.sparkline(F.col("w_before")).alias("waveform_before"), text.sparkline(F.col("w_after")).alias("waveform_after"),
    )
