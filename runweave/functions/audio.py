"""Settings of the processing step as columns: filter chain, arguments, stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the processing step.
DEFAULTS = {
    "silence_threshold_db": -50.0, "silence_duration": 0.1, "compressor_threshold_db": -18.0, "compressor_ratio": 3.0, "compressor_attack": 20.0, "compressor_release": 250.0,
    "target_loudness": -16.0, "true_peak": -1.5, "loudness_range": 11.0, "bitrate": "192k", "remove_silence": True, "apply_compression": True, "apply_normalization": True,
}
# The encoder's filters, their options in order, and the switch of each.
FILTERS = (
    ("remove_silence", "silenceremove=start_periods=1", (("start_threshold", "silence_threshold_db", "dB"), ("start_duration", "silence_duration", ""))),
    ("apply_compression", "acompressor", (("threshold", "compressor_threshold_db", "dB"), ("ratio", "compressor_ratio", ""), ("attack", "compressor_attack", ""), ("release", "compressor_release", ""))),
    ("apply_normalization", "loudnorm", (("I", "target_loudness", ""), ("TP", "true_peak", ""), ("LRA", "loudness_range", ""))),
)


def filter_chain(config: dict[str, Column]) -> Column:
    """The enabled filters, joined by commas; empty if none is."""
    parts = []
    for switch, name, options in FILTERS:
        text = [F.concat(F.lit(f"{key}="), config[field].cast("string"), F.lit(unit)) for key, field, unit in options]
        joined = F.concat(F.lit(name), F.lit(":" if "=" in name else "="), F.concat_ws(":", *text))
        parts.append(F.when(config[switch], joined))
    return F.concat_ws(",", *parts)


def arguments(inputs: Column, listing: Column, chain: Column, bitrate: Column, output: Column) -> Column:
    """The encoder's argument list: one input as it is, several by a listing file."""
    one = F.size(inputs) == 1
    source = F.when(one, F.concat(F.array(F.lit("-i")), F.slice(inputs, 1, 1))).otherwise(F.array(*map(F.lit, ("-f", "concat", "-safe", "0", "-i")), listing))
    filters = F.when(chain != "", F.array(F.lit("-af"), chain)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("ffmpeg"), F.lit("-y")), source, filters, F.array(F.lit("-c:a"), F.lit("libmp3lame"), F.lit("-b:a"), bitrate, output))


def listing_line(path: Column) -> Column:
    """A line of the listing file; single quotes in the path are closed, escaped and opened again."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def stages(config: dict[str, Column], several: Column) -> Column:
    """The steps on offer: key, label, enabled."""
    step = lambda key, label, on: F.struct(F.lit(key).alias("key"), label.alias("label"), on.alias("enabled"))
    rows = F.array(
        step("silence", F.lit("Remove leading silence"), config["remove_silence"]),
        step("compress", F.lit("Apply compression"), config["apply_compression"]),
        step("normalize", F.concat(F.lit("Normalize loudness ("), config["target_loudness"].cast("string"), F.lit(" LUFS)")), config["apply_normalization"]),
        step("export", F.concat(F.lit("Export MP3 @ "), config["bitrate"]), F.lit(True)),
    )
    return F.when(several, F.concat(F.array(step("concat", F.lit("Concatenate files"), F.lit(True))), rows)).otherwise(rows)


def toggled(stage_rows: Column, keys: Iterable[str]) -> Column:
    """The steps with those of the given keys switched over."""
    keys = list(keys)
    return F.transform(stage_rows, lambda s: F.struct(s["key"].alias("key"), s["label"].alias("label"), (s["enabled"] != s["key"].isin(keys)).alias("enabled")))


def switched(stage_rows: Column, on: bool) -> Column:
    return F.transform(stage_rows, lambda s: F.struct(s["key"].alias("key"), s["label"].alias("label"), F.lit(on).alias("enabled")))


def selected(stage_rows: Column) -> Column:
    return F.transform(F.filter(stage_rows, lambda s: s["enabled"]), lambda s: s["key"])
