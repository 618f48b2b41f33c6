"""The catalogue's tables as fixed struct types, and the values allowed in their enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STAMPS = "created_at timestamp_ntz, updated_at timestamp_ntz"
_DDL = {
    "projects": f"id bigint, name string, description string, project_type string, metadata_json string, base_note int, round_robins int, {_STAMPS}",
    "recordings": "id bigint, project_id bigint, name string, file_path string, file_size_bytes bigint, duration double, sample_rate int, channels int, status string, file_format string, metadata_json string, created_at timestamp_ntz",
    "samples": "id bigint, recording_id bigint, name string, file_path string, start_time double, duration double, sample_type string, status string, metadata_json string, created_at timestamp_ntz",
    "velocity_groups": "id bigint, project_id bigint, name string, low_vel int, high_vel int",
    "sample_mapping_items": "id bigint, sample_id bigint, velocity_group_id bigint, key_range_start int, key_range_end int, root_note int, created_at timestamp_ntz",
    "midi_devices": f"id bigint, name string, description string, is_available boolean, metadata_json string, {_STAMPS}",
    "midi_capture_sessions": f"id bigint, project_id bigint, name string, status string, start_time timestamp_ntz, end_time timestamp_ntz, {_STAMPS}",
    "midi_files": "id bigint, capture_session_id bigint, device_id bigint, channel int, file_data binary, created_at timestamp_ntz",
    "loop_generation_configs": "id bigint, name string, engine_id string, key string, meter string, tempo double, bars int, seed bigint, engine_options_json string, chords_json string",
    "loop_rendering_configs": "id bigint, name string, midi_port string, audio_device_index int, capture_tail_seconds double, patch_data_json string",
    "manifests": f"id bigint, project_id bigint, {_STAMPS}",
    "manifest_rules": f"id bigint, manifest_id bigint, name string, required_tags_json string, target_count int, category string, {_STAMPS}",
}
_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp_ntz": T.TimestampNTZType()}


def _struct(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, ddl.split(", "))])


TABLES: dict[str, T.StructType] = {k: _struct(v) for k, v in _DDL.items()}
DEFAULTS = {
    "recordings": {"status": "uploaded"},
    "samples": {"sample_type": "one_shot", "status": "pending"},
    "velocity_groups": {"name": "default", "low_vel": 0, "high_vel": 127},
    "loop_generation_configs": {"engine_id": "bass", "key": "C", "meter": "4/4", "tempo": 120.0, "bars": 4, "seed": 42},
    "loop_rendering_configs": {"capture_tail_seconds": 2.0},
    "manifest_rules": {"target_count": 1},
}
ENUMS = {
    "project_type": ("sample_pack", "virtual_instrument", "construction_kit"),
    "sample_type": ("one_shot", "loop", "ambient", "fill", "transition", "unknown"),
    "sample_pack_status": ("pending", "processing", "completed", "failed"),
    "sample_status": ("pending", "processing", "processed", "failed"),
    "session_status": ("pending", "recording", "completed", "failed", "completed_empty"),
}
#: Child table -> (column, parent): what goes when a parent row goes.
PARENTS = {
    "recordings": ("project_id", "projects"), "samples": ("recording_id", "recordings"), "velocity_groups": ("project_id", "projects"),
    "sample_mapping_items": ("sample_id", "samples"), "midi_capture_sessions": ("project_id", "projects"),
    "midi_files": ("capture_session_id", "midi_capture_sessions"), "manifests": ("project_id", "projects"), "manifest_rules": ("manifest_id", "manifests"),
}


def with_defaults(name: str, rows: DataFrame) -> DataFrame:
    """rows in the table's columns and types; missing or null ones get the table's defaults."""
    have, defaults = set(rows.columns), DEFAULTS.get(name, {})

    def value(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in have else F.lit(None)
        return F.coalesce(c, F.lit(defaults[f.name])).cast(f.dataType) if f.name in defaults else c.cast(f.dataType)

    return rows.select(*[value(f).alias(f.name) for f in TABLES[name]])


def check_enum(rows: DataFrame, column: str, enum: str) -> DataFrame:
    """rows, failing at run time on a value outside the enumeration; null is allowed."""
    bad = F.col(column).isNotNull() & ~F.col(column).isin(*ENUMS[enum])
    message = F.concat(F.lit(f"{column} is not a {enum}: "), F.col(column))
    return rows.withColumn(column, F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col(column)))


def cascade(tables: dict[str, DataFrame], keep: DataFrame, root: str = "projects") -> dict[str, DataFrame]:
    """Every table without the descendants of root rows that are not in keep (one semi-join a table)."""
    out = {root: tables[root].join(keep.select("id"), "id", "left_semi")}
    for child, (column, parent) in PARENTS.items():
        if child in tables and parent in out:
            ids = out[parent].select(F.col("id").alias(column))
            out[child] = tables[child].join(ids, column, "left_semi").select(*tables[child].columns)
    return out
