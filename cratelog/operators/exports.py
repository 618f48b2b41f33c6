"""Export plans: where each asset of a kit goes, and the groups and zones of a preset."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import base_name, infer_role, role_priority, sanitize, session_name, title
from ..schema import check_enum, with_defaults
from ..sources import files as sinks
from ..sources import wav
from . import chunks, ordered, spectral


def kit_paths(rules: DataFrame, matches: DataFrame, assets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(project_id, rule_id, kind, asset_id, path): Song/Section/Rule_n.ext, and Unassigned/ with samples under their files' own names.

    rules: project_id, rule_id, name, category; assets: project_id, kind, asset_id, tags_json, ext, file_path.
    The folder comes from the tags of the rule's first sample match. n counts samples, then MIDI, also
    those whose file is missing from ``existing`` (kind, asset_id) and which are then left out.
    """
    key, lone = ["project_id", "kind", "asset_id"], F.col("rule_id").isNull()
    each = assets.join(matches.select(*key, "rule_id").distinct(), key, "left").where(~lone | (F.col("kind") == "sample"))
    # A loose file is a group of its own, as all of a project's would be one large group for nothing.
    parts = each.select(
        *key, "rule_id", "ext", F.when(lone, F.col("asset_id")).alias("alone"), (F.col("kind") == "midi").alias("late"),
        F.when(~lone, F.col("tags_json")).alias("tags_json"), F.when(lone, base_name(F.col("file_path"))).alias("file"),
    )
    w = Window.partitionBy("project_id", "rule_id", "alone").orderBy("late", "asset_id")
    numbered = parts.withColumn("n", F.row_number().over(w))
    song, section = sanitize(tags.get(F.col("tags_json"), "song", "General")), F.when(tags.has_key(F.col("tags_json"), "section"), sanitize(tags.get(F.col("tags_json"), "section")))
    lead = F.when(~lone & ~F.col("late") & (F.col("n") == 1), F.struct(song.alias("song"), section.alias("section")))  # read from one row of a rule
    led = numbered.withColumn("lead", lead).withColumn("lead", F.first("lead").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spare = F.when(F.coalesce("category", F.lit("")) == "", "Other").otherwise(F.col("category"))
    named = led.join(rules.select("project_id", "rule_id", sanitize(F.col("name")).alias("title"), sanitize(spare).alias("spare")), ["project_id", "rule_id"], "left").where(lone | F.col("title").isNotNull())
    path = F.concat(F.coalesce("lead.song", F.lit("General")), F.lit("/"), F.coalesce("lead.section", "spare"), F.lit("/"), "title", F.lit("_"), "n", "ext")
    out = named.select("project_id", F.col("rule_id").cast("bigint").alias("rule_id"), "kind", "asset_id", F.when(lone, F.concat(F.lit("Unassigned/"), "file")).otherwise(path).alias("path"))
    return out if existing is None else out.join(existing, ["kind", "asset_id"], "left_semi")


def preset_xml(rows: list[dict]) -> str:
    """A sampler preset of one instrument from its rows (group, lo_vel, hi_vel, path, root_note, lo_key, hi_key).

    A row without path stands for a group without samples. An instrument's rows are few; they are
    what a caller has collected for one file. Samples lie in the preset's own folder Samples.
    """
    root = ElementTree.Element("DecentSampler")
    groups: dict[str, ElementTree.Element] = {}
    holder = ElementTree.SubElement(root, "groups")
    for r in rows:
        if r["group"] not in groups:
            groups[r["group"]] = ElementTree.SubElement(holder, "group", name=r["group"], loVel=str(r["lo_vel"]), hiVel=str(r["hi_vel"]))
        if r["path"]:
            name = r["path"].rpartition("/")[2]
            ElementTree.SubElement(groups[r["group"]], "sample", path=f"Samples/{name}", rootNote=str(r["root_note"]), loKey=str(r["lo_key"]), hiKey=str(r["hi_key"]))
    return ElementTree.tostring(root, encoding="unicode")


def preset_files(rows: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, xml): a preset of each instrument. rows: key and the fields of preset_xml; a group's zones go by root note and path."""
    fields = ("group", "lo_vel", "hi_vel", "root_note", "path", "lo_key", "hi_key")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([preset_xml(r) for r in b.column(1).to_pylist()], pa.string())], names=[b.schema.names[0], "xml"])

    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    return packed.mapInArrow(run, f"{key} {kind}, xml string")


def equalized_kit(files: DataFrame, rate: int = 44_100) -> DataFrame:
    """files (project_id, path, content) whose stems mask each other corrected: WAV files that share a folder Song/Section, as mono 16-bit audio.

    A stem for which spectral.eq_plan has no filter, one that can't be read, one alone in its section, and
    what lies under Unassigned stay as they are. Spectra and filters run over chunks.
    """
    key, folder = F.concat(F.col("project_id").cast("string"), F.lit("/"), F.col("path")), F.regexp_extract("path", r"^(?!Unassigned/)([^/]+/[^/]+)/[^/]+\.wav$", 1)
    some = files.where(F.col("content").isNotNull() & (folder != "")).select(key.alias("stem"), F.concat(F.col("project_id").cast("string"), F.lit("/"), folder).alias("section"), base_name(F.col("path")).alias("name"), F.col("content").cast("binary").alias("content"))
    sure = wav.headers(some.select(F.col("stem").alias("path"), "content")).where("error IS NULL AND frames > 0").select(F.col("path").alias("stem"))
    stems = some.join(sure, "stem", "left_semi")
    several = stems.groupBy("section").count().where("count > 1").select("section")
    stems = stems.join(several, "section", "left_semi")
    audio = chunks.resampled(wav.chunks(stems.select(F.col("stem").alias("path"), "content")).withColumnRenamed("path", "stem").select("stem", "first_frame", "sample_rate", "samples"), rate, "stem")
    role = infer_role(F.col("name"))
    known = stems.select("section", "stem", role.alias("role"), role_priority(role).alias("priority")).join(chunks.spectral_features(audio, "stem").select("stem", "spectrum"), "stem")
    plan = spectral.eq_plan(known, spectral.masking_pairs(known), rate / 2048).select("stem", "filter", "hz", "gain_db")
    made = wav.joined(chunks.equalized(audio.join(plan, "stem", "left_semi"), plan, "stem"), "stem", 16)
    named = files.withColumn("stem", key).join(made, "stem", "left")
    return named.select(*[F.coalesce("wav", F.col("content").cast("binary")).alias(c) if c == "content" else F.col(c) for c in files.columns])


#: A zip file's own numbers: versions, the method deflate, the flag for UTF-8 names, the first day of 1980.
_NEEDS, _DEFLATE, _UTF8, _DAY = 20, 8, 0x800, 33
_WIDE = 0xFFFFFFFF
#: Bytes of members that are handed on together.
_HELD = 4 << 20


def _deflated(path: str, body: bytes) -> tuple[bytes, int, int]:
    """A member with its header in front, its checksum and its deflated size."""
    squeeze = zlib.compressobj(wbits=-15)
    packed, check, name = squeeze.compress(body) + squeeze.flush(), zlib.crc32(body), path.encode()
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, _NEEDS, _UTF8, _DEFLATE, 0, _DAY, check, len(packed), len(body), len(name), 0) + name + packed, check, len(packed)


def _listed(path: str, check: int, packed: int, size: int, at: int) -> bytes:
    """A member's entry in the directory."""
    name, extra = path.encode(), struct.pack("<HHQ", 1, 8, at) if at >= _WIDE else b""
    return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if extra else _NEEDS, _UTF8, _DEFLATE, 0, _DAY, check, packed, size, len(name), len(extra), 0, 0, 0, 0, min(at, _WIDE)) + name + extra


def _closing(count: int, size: int, at: int) -> bytes:
    """What ends the file: how many members there are, and where the directory begins."""
    wide = b""
    if count >= 0xFFFF or at >= _WIDE or size >= _WIDE:
        wide = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
    return wide + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, _WIDE), min(at, _WIDE), 0)


def zip_members(files: DataFrame, key: str = "project_id") -> DataFrame:
    """(key, path, body, check, packed, size): each file (key, path, content; null is left out) deflated where it lies, with its header. Map-only."""
    rows = files.where(F.col("content").isNotNull() & F.col("path").isNotNull() & F.col(key).isNotNull()).select(key, "path", F.col("content").cast("binary").alias("content"))
    schema = f"{key} {files.schema[key].dataType.simpleString()}, path string, body binary, check long, packed long, size long"

    def made(part: list[tuple], keys: pa.Array, paths: pa.Array) -> pa.RecordBatch:
        numbers = [pa.array([m[k] for m in part], pa.int64()) for k in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([keys, paths, pa.array([m[0] for m in part], pa.binary()), *numbers], names=[key, "path", "body", "check", "packed", "size"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, first, held = [], 0, 0
            for i in range(b.num_rows):
                content = b.column(2)[i].as_py()
                part.append((*_deflated(b.column(1)[i].as_py(), content), len(content)))
                held += len(part[-1][0])
                if held > _HELD or i == b.num_rows - 1:
                    yield made(part, b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)))
                    part, first, held = [], i + 1, 0

    return rows.mapInArrow(run, schema)


def zip_parts(members: DataFrame, key: str = "project_id", folder: str | None = None) -> DataFrame:
    """(key, at, body): the parts of each key's zip file and where each belongs, the directory behind the members, in the order of paths.

    The members are read twice, so give a written table. Only their paths and sizes are dealt by key and path; places are
    running sums over ranges of paths, so a zip of any number of members is placed by many tasks. Sizes and places are written to ``folder``, else to the shared one.
    """
    length, entry = F.octet_length("body").cast("bigint"), (F.lit(46) + F.octet_length("path")).cast("bigint")
    sizes = ordered.runs(members.select(key, "path", "check", "packed", "size", length.alias("length")), key, "path", folder=folder)
    ends_at = sizes.groupBy(key).agg(F.sum("length").alias("end"))
    placed = ordered.running(sizes, (key, "path"), (key,), at=F.col("length"))
    placed = placed.withColumn("entry", entry + F.when(F.col("at") >= _WIDE, 12).otherwise(0))
    placed = ordered.written(placed, "placed", folder)
    listed = ordered.running(placed, (key, "path"), (key,), listed_at=F.col("entry")).join(ends_at, key).withColumn("listed_at", F.col("listed_at") + F.col("end"))
    placed = placed.join(ends_at, key)
    bodies = members.select(key, "path", "body").join(placed.select(key, "path", "at"), [key, "path"]).select(key, "at", "body")
    listed = chunks.mapped(listed, {"body": "binary"}, lambda *x: (_listed(*x),), "path", "check", "packed", "size", "at").select(key, F.col("listed_at").alias("at"), "body")
    whole = placed.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.sum("entry").alias("size"), F.max("end").alias("end"))
    ends = chunks.mapped(whole, {"body": "binary"}, lambda *x: (_closing(*x),), "count", "size", "end").select(key, (F.col("end") + F.col("size")).alias("at"), "body")
    return bodies.unionByName(listed).unionByName(ends)


def save_kits(kits: DataFrame, folder: str, key: str = "project_id") -> int:
    """Write each key's files (key, path, content) as <key>.zip to a POSIX folder that all executors share; how many zips were written.

    Members are deflated and put in their places by many tasks, one project's too; a repeated task writes the same bytes to the same places.
    A zip gets its name when it is complete. Two files of one path are an error.
    """
    spark, staging = kits.sparkSession, f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    _, root = sinks.filesystem(staging)

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for b in batches:
            for name, at, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                out, view, done = os.open(f"{root}/{name}.zip", os.O_CREAT | os.O_WRONLY, 0o644), memoryview(body.as_buffer()), 0
                try:
                    while done < len(view):
                        done += os.pwrite(out, view[done:], at + done)
                finally:
                    os.close(out)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["name"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                if os.path.exists(made := f"{root}/{name}.zip"):
                    os.replace(made, f"{os.path.dirname(root)}/{name}.zip")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        members = zip_members(kits, key)
        members.write.parquet(f"{staging}/members")
        members = spark.read.schema(members.schema).parquet(f"{staging}/members")
        if twice := members.groupBy(key, "path").count().where("count > 1").limit(5).collect():
            raise ValueError(f"several files of one path: {', '.join(r['path'] for r in twice)}")
        parts = zip_parts(members, key, staging).select(F.col(key).cast("string").alias("name"), "at", "body")
        parts.mapInArrow(put, "name string").distinct().write.parquet(f"{staging}/names")
        names = spark.read.schema("name string").parquet(f"{staging}/names")
        return names.mapInArrow(place, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    finally:
        sinks.delete(spark, staging)


def _varlen(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def midi_bytes(notes: list[tuple[int, int, int, int]], ticks: int = 960, channel: int = 0) -> bytes:
    """A standard MIDI file of one track from (start, dur, pitch, velocity) in ticks; notes end before others begin at the same tick."""
    events = sorted([(s, 1, p, v) for s, _, p, v in notes] + [(s + d, 0, p, 0) for s, d, p, _ in notes])
    track, now = bytearray(), 0
    for at, on, pitch, velocity in events:
        track += _varlen(at - now) + bytes([(0x90 if on else 0x80) | channel, pitch & 127, velocity & 127])
        now = at
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + (6).to_bytes(4, "big") + (0).to_bytes(2, "big") + (1).to_bytes(2, "big") + ticks.to_bytes(2, "big") + b"MTrk" + len(track).to_bytes(4, "big") + bytes(track)


def midi_files(notes: DataFrame, key: str, ticks: int = 960, velocity: int | None = 100) -> DataFrame:
    """(key, midi, file_data): a MIDI file of each key's notes (key, start, dur, pitch, velocity), and the same as base64 text.

    All notes get one velocity unless it is None. A key's notes are one loop's and so few.
    """
    kind = notes.schema[key].dataType.simpleString()
    loud = F.col("velocity") if velocity is None else F.lit(velocity)
    packed = notes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "dur", "pitch", loud.alias("velocity")))).alias("notes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [midi_bytes([tuple(n.values()) for n in notes], ticks) for notes in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=[b.schema.names[0], "midi"])

    return packed.mapInArrow(run, f"{key} {kind}, midi binary").withColumn("file_data", F.base64("midi"))


def generated_rows(files: DataFrame, devices: DataFrame, name: str, now: Column, first_session: int, first_file: int) -> tuple[DataFrame, DataFrame]:
    """Session and MIDI-file rows of generated loops (project_id, label, file_data), in the columns of the catalogue's tables.

    The device is that of the given name, which must be there (see catalogue.upsert_devices). The loops are written once in the
    order of their numbers, so that both kinds of rows have the same ones.
    """
    numbered = ordered.running(ordered.runs(files, "project_id", "label"), ("project_id", "label"), n_=F.lit(1))
    each = numbered.crossJoin(devices.where(F.col("name") == name).select(F.col("id").alias("device_id")).limit(1))
    stamps = {c: now for c in ("start_time", "end_time", "created_at", "updated_at")}
    sessions = each.select((F.col("n_") + first_session).alias("id"), "project_id", session_name(F.col("label"), now).alias("name"), F.lit("completed").alias("status")).withColumns(stamps)
    rows = each.select((F.col("n_") + first_file).alias("id"), (F.col("n_") + first_session).alias("capture_session_id"), "device_id", F.lit(0).alias("channel"), midi_content(F.col("file_data")).alias("file_data"), now.alias("created_at"))
    return with_defaults("midi_capture_sessions", sessions), with_defaults("midi_files", rows)


def readme(projects: DataFrame, base: str) -> DataFrame:
    """(project_id, path, content): the file that says what a project's folder holds."""
    path = F.concat(F.lit(f"{base}/project_"), F.col("id").cast("string"), F.lit("/README.md"))
    return projects.select(F.col("id").alias("project_id"), path.alias("path"), F.concat(F.lit("# "), "name", F.lit("\n\nType: "), title(F.col("project_type")), F.lit("\n")).alias("content"))


def preset_rows(groups: DataFrame, zones: DataFrame, samples: DataFrame, key: str = "project_id") -> DataFrame:
    """The rows that preset_files takes: every velocity group with its samples, groups without any too, and "Unassigned" for samples without group.

    groups: key, id, name, low_vel, high_vel; zones: see catalogue.key_zones; samples: key, id, file_path.
    """
    placed = samples.select(key, F.col("id").alias("sample_id"), F.col("file_path").alias("path")).join(zones, "sample_id")
    own = placed.select(key, "path", "root_note", "lo_key", "hi_key", F.col("velocity_group_id").alias("id"))
    named = groups.select(key, "id", F.col("name").alias("group"), F.col("low_vel").alias("lo_vel"), F.col("high_vel").alias("hi_vel")).join(own, [key, "id"], "left").drop("id")
    loose = own.where("id IS NULL").select(key, F.lit("Unassigned").alias("group"), F.lit(0).alias("lo_vel"), F.lit(127).alias("hi_vel"), "path", "root_note", "lo_key", "hi_key")
    return named.unionByName(loose)


def midi_content(file_data: Column) -> Column:
    """The bytes of a MIDI file that is kept as base64 text."""
    return F.unbase64(file_data.cast("string"))


#: Folders below a project's own.
FOLDERS = {
    "virtual_instrument": ("samples", "samples/raw", "samples/processed", "samples/mapped", "presets", "exports", "midi", "metadata"),
    "sample_pack": ("samples", "exports", "midi"),
    "construction_kit": ("samples", "exports", "midi"),
}


def project_folders(projects: DataFrame, base: str) -> DataFrame:
    """(project_id, path): the folders that each project wants; an unknown project_type fails."""
    checked = check_enum(projects, "project_type", "project_type")
    of = F.create_map(*[x for k, v in FOLDERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    each = checked.select(F.col("id").alias("project_id"), F.explode(F.coalesce(F.try_element_at(of, F.col("project_type")), F.array(*map(F.lit, FOLDERS["sample_pack"])))).alias("f"))
    return each.select("project_id", F.concat(F.lit(f"{base}/project_"), F.col("project_id").cast("string"), F.lit("/"), F.col("f")).alias("path"))
