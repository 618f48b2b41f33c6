"""Reads of the catalogue: listings, lookups, ownership, and instrument layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.arithmetic import bars_to_beats
from ..functions.text import base_name

def list_projects(projects: DataFrame, project_type: str | None = None) -> DataFrame:
    """Newest first; of one type if given."""
    found = projects if project_type is None else projects.where(F.col("project_type") == project_type)
    return found.orderBy(F.desc("created_at"), F.desc("id"))


def by_id(rows: DataFrame, key: int) -> DataFrame:
    return rows.where(F.col("id") == key)


def first_of(rows: DataFrame) -> DataFrame:
    """One row, that of the smallest id."""
    return rows.orderBy("id").limit(1)


def of_type(rows: DataFrame, project_type: str) -> DataFrame:
    """Projects of one type; fails at run time on one of another."""
    other = F.coalesce(F.col("project_type") != project_type, F.lit(True))
    message = F.concat(F.lit(f"not a {project_type}: "), F.coalesce("project_type", F.lit("null")))
    return rows.withColumn("project_type", F.when(other, F.raise_error(message).cast("string")).otherwise(F.col("project_type")))


def midi_files_of(files: DataFrame, session_id: int) -> DataFrame:
    """A session's files, oldest first."""
    return files.where(F.col("capture_session_id") == session_id).orderBy("created_at", "id")


def layers(groups: DataFrame) -> DataFrame:
    """Velocity layers, loudest first."""
    return groups.orderBy(F.desc("high_vel"), "id")


def owned(recordings: DataFrame, recording_id: int, project_id: int) -> DataFrame:
    return recordings.where((F.col("id") == recording_id) & (F.col("project_id") == project_id))


def counts(projects: DataFrame, recordings: DataFrame, samples: DataFrame) -> DataFrame:
    """(project_id, recordings, samples) of every project, also of empty ones."""
    per_recording = samples.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    joined = recordings.select("id", "project_id").join(per_recording, F.col("id") == F.col("recording_id"), "left")
    per_project = joined.groupBy("project_id").agg(F.count(F.lit(1)).alias("recordings"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return projects.select(F.col("id").alias("project_id")).join(per_project, "project_id", "left").select("project_id", zero("recordings"), zero("samples"))


def first_mapping(items: DataFrame) -> DataFrame:
    """Each sample's mapping item with the smallest id; of several with one id, the first by their other columns, in the order given."""
    ties = [c for c in items.columns if c not in ("sample_id", "id")]
    return items.withColumn("__n", F.row_number().over(Window.partitionBy("sample_id").orderBy("id", *ties))).where("__n = 1").drop("__n")


def key_zones(samples: DataFrame, items: DataFrame) -> DataFrame:
    """(sample_id, velocity_group_id, root_note, lo_key, hi_key): 0 counts as missing, a missing root is 60."""
    given = lambda c: F.nullif(F.col(c), F.lit(0))
    root = F.coalesce(given("root_note"), F.lit(60))
    joined = samples.select(F.col("id").alias("sample_id")).join(first_mapping(items).drop("id"), "sample_id")
    return joined.select("sample_id", given("velocity_group_id").alias("velocity_group_id"), root.alias("root_note"), F.coalesce(given("key_range_start"), root).alias("lo_key"), F.coalesce(given("key_range_end"), root).alias("hi_key"))


def velocity_layout(groups: DataFrame, zones: DataFrame) -> DataFrame:
    """Every group with its number of samples, empty groups too; samples without group are 'Unassigned' (id null)."""
    per_group = zones.groupBy("velocity_group_id").agg(F.count(F.lit(1)).alias("samples"))
    named = groups.select(F.col("id").alias("group_id"), "name", "low_vel", "high_vel").join(per_group, F.col("group_id") == F.col("velocity_group_id"), "left").drop("velocity_group_id")
    loose = per_group.where("velocity_group_id IS NULL").select(F.lit(None).cast("bigint").alias("group_id"), F.lit("Unassigned").alias("name"), F.lit(0).alias("low_vel"), F.lit(127).alias("high_vel"), "samples")
    return named.withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint"))).unionByName(loose)


def upsert_devices(devices: DataFrame, names: DataFrame, now) -> DataFrame:
    """Known names get a new updated_at, new ones a row with the next ids."""
    seen = names.select("name").where("name IS NOT NULL").distinct().withColumn("__seen", F.lit(True))
    top = devices.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    both = devices.join(seen, "name", "full_outer").crossJoin(F.broadcast(top))
    fresh = F.col("id").isNull()
    order = F.row_number().over(Window.partitionBy(fresh).orderBy("name"))
    return both.select(
        F.when(fresh, F.col("__top") + order).otherwise(F.col("id")).alias("id"), "name", "description", F.when(fresh, True).otherwise(F.col("is_available")).alias("is_available"),
        "metadata_json", F.when(fresh, now).otherwise(F.col("created_at")).alias("created_at"), F.when(F.col("__seen"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    ).select(*devices.columns)


def update(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """rows with the status and metadata of patches (id, status, metadata_json); nulls change nothing.

    Metadata is merged key by key, the patch winning. patches has at most one row an id.
    """
    new = patches.select("id", F.col("status").alias("__status"), F.col("metadata_json").alias("__patch"))
    merged = F.when(F.col("__patch").isNull(), F.col("metadata_json")).otherwise(tags.merge(F.col("metadata_json"), F.col("__patch")))
    return rows.join(new, "id", "left").withColumns({"status": F.coalesce("__status", "status"), "metadata_json": merged}).select(*rows.columns)


def device_ids(devices: DataFrame, names: DataFrame) -> DataFrame:
    """(device_id, name) of the asked names that are known; fails at run time if none of them is."""
    asked = names.select("name").where("name IS NOT NULL").distinct()
    known = devices.select(F.col("id").alias("device_id"), "name").join(asked, "name").select("device_id", "name")
    none = known.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.raise_error(F.lit("none of the named devices is known")).cast("bigint").alias("device_id"), F.lit(None).cast("string").alias("name"))
    return known.unionByName(none)


def render_jobs(jobs: DataFrame, generation: DataFrame, rendering: DataFrame) -> DataFrame:
    """jobs (generation_id, rendering_id, ...) with both of their configurations; a missing one fails at run time."""
    g = generation.select(F.col("id").alias("generation_id"), F.struct(*[c for c in generation.columns if c != "id"]).alias("generation"))
    r = rendering.select(F.col("id").alias("rendering_id"), F.struct(*[c for c in rendering.columns if c != "id"]).alias("rendering"))
    joined = jobs.join(g, "generation_id", "left").join(r, "rendering_id", "left")
    found = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} configuration not found")).cast(joined.schema[c].dataType)).otherwise(F.col(c))
    return joined.withColumns({c: found(c) for c in ("generation", "rendering")})


def ingest(headers: DataFrame, project_id: int, first_id: int, now) -> DataFrame:
    """Recordings of files, as probed by wav.read_headers, with ids from first_id upwards, gaps between partitions; a file that can't be read fails."""
    path = F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("not readable: "), "path", F.lit(": "), F.col("error"))).cast("string"))
    return headers.select(
        (F.monotonically_increasing_id() + first_id).alias("id"), F.lit(project_id).cast("bigint").alias("project_id"), base_name(F.col("path")).alias("name"), path.alias("file_path"), F.col("bytes").alias("file_size_bytes"), "duration", "sample_rate",
        "channels", F.lit("uploaded").alias("status"), F.lit("wav").alias("file_format"), F.to_json("tags").alias("metadata_json"), now.alias("created_at"),
    )


def loop_entries(loops: DataFrame) -> DataFrame:
    """(kind, label, duration, metadata_json): the recording and the sample that a rendered loop adds.

    loops: label, tempo, key, meter, bars, engine, midi_file_id, tail (seconds), tags_json. A loop
    lasts its beats and the tail; the tags win over what the loop itself says.
    """
    about = F.struct("tempo", "key", "bars")
    whole = F.struct("tempo", "key", "bars", "meter", "engine", "midi_file_id", F.lit("generated_loop").alias("source"))
    seconds = bars_to_beats(F.col("bars"), F.col("meter")) * 60.0 / F.col("tempo") + F.col("tail")
    entry = lambda kind, made, length: F.struct(F.lit(kind).alias("kind"), "label", length.alias("duration"), tags.merge(F.to_json(made), F.col("tags_json")).alias("metadata_json"))
    both = F.array(entry("recording", whole, F.lit(None).cast("double")), entry("sample", about, seconds.cast("double")))
    dealt = loops.repartition("label", "midi_file_id")  # rows are small, and merging takes long
    return dealt.select(F.explode(both).alias("e")).select("e.*")
