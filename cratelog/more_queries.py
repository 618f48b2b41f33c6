"""More of the operators over the synthetic tables: sources and sinks, catalogue rows, texts, kernels, chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schema
from .functions import arithmetic, signal, tags, text
from .operators import audio, catalogue, exports, loops, manifest, segments, symbolic, vocal
from .plans import chain
from .queries import _BEATS, _BUF, _ON, _beats, _buffers, _onsets, query
from .session import shared_folder, table
from .sources import wav
from .streaming import capture

def _now():
    return F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")


# --- sources and sinks ---------------------------------------------------------------------------


def _wavs(spark: SparkSession, d: str, depth: int = 16) -> DataFrame:
    """Embeddings as 16-bit files at 8 kHz, titled by their id."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.lit(8000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"), F.create_map(F.lit("title"), F.concat(F.lit("take "), "vec_id")).alias("about"))
    return wav.to_wav(rows, depth, "about").select(F.col("name").alias("path"), F.col("wav").alias("content"))


@query("SELECT vec_id, 8000 AS sample_rate, 1 AS channels, 16 AS bit_depth, CAST(len(embedding) AS BIGINT) AS frames, len(embedding) / 8000.0 AS duration, 'take ' || vec_id AS title FROM embeddings")
def wav_headers(spark: SparkSession, d: str) -> DataFrame:
    h = wav.headers(_wavs(spark, d))
    return h.select(F.col("path").cast("bigint").alias("vec_id"), "sample_rate", "channels", "bit_depth", "frames", "duration", F.try_element_at("tags", F.lit("title")).alias("title"))


@query(f"""WITH {_BUF} SELECT vec_id, round(list_sum(list_transform(y, lambda v: abs(greatest(-32768, least(32767, round_even(v * 32768, 0))) / 32768))), 6) AS total, CAST(len(y) AS INTEGER) AS n FROM b""")
def wav_samples(spark: SparkSession, d: str) -> DataFrame:
    whole = wav.whole(wav.chunks(_wavs(spark, d), chunk=20))
    return whole.select(F.col("path").cast("bigint").alias("vec_id"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))), 6).alias("total"), F.size("samples").alias("n"))


@query("""WITH t AS (SELECT n_nationkey, 110.0 * (n_nationkey + 1) AS hz FROM nation)
SELECT n_nationkey, round(list_sum(list_transform(range(800), lambda i: abs(sin(i * hz * 2 * pi() / 8000) * 0.5))), 5) AS tone, round(list_sum(list_transform(range(800), lambda i: abs(sin(i * hz * 2 * pi() / 8000) * exp(-20.0 * i / 8000)))), 5) AS hit FROM t""")
def synthetic_tones(spark: SparkSession, d: str) -> DataFrame:
    hz = (F.col("n_nationkey") + 1) * F.lit(110.0)
    total = lambda y: F.round(F.aggregate(y, F.lit(0.0), lambda s, v: s + F.abs(v)), 5)
    return table(spark, d, "nation").select("n_nationkey", total(wav.sine(0.1, hz, 8000)).alias("tone"), total(wav.drum_hit(0.1, hz, 8000)).alias("hit"))


@query("""SELECT o_orderkey AS id, o_custkey AS recording_id, CASE WHEN o_orderkey % 2 = 0 THEN 'loop' ELSE 'one_shot' END AS sample_type, 'pending' AS status, CAST(NULL AS DOUBLE) AS duration FROM orders""")
def row_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recording_id"), F.when(F.col("o_orderkey") % 2 == 0, "loop").alias("sample_type"))
    return schema.check_enum(schema.with_defaults("samples", rows), "sample_type", "sample_type").select("id", "recording_id", "sample_type", "status", "duration")


@query("""SELECT s_suppkey AS id, s_nationkey AS manifest_id, s_name AS name, 2 AS target_count, '{"a":1}' AS required_tags_json FROM supplier WHERE s_nationkey <> 3
UNION ALL SELECT n_nationkey, 3, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 1 END, CASE WHEN n_nationkey % 3 = 0 THEN '{"b":2}' ELSE '{}' END FROM nation""")
def replaced_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_nationkey").cast("bigint").alias("manifest_id"), F.col("s_name").alias("name"), F.lit(2).alias("target_count"), F.lit('{"a":1}').alias("required_tags_json"))
    new = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, 5).alias("target_count"), F.when(F.col("n_nationkey") % 3 == 0, '{"b":2}').alias("required_tags_json"))
    return manifest.replace_rules(rules, 3, new)


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'take_click_removed' WHEN 1 THEN 'take.one' ELSE 'take_perfected_denoised' END || '_perfected' AS name FROM customer""")
def processed_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("c_custkey") % 3 == 0, "/in/take_click_removed_adjusted.wav").when(F.col("c_custkey") % 3 == 1, "/in/take.one_denoised.aiff").otherwise("take_perfected_denoised_perfected.wav")
    return table(spark, d, "customer").select("c_custkey", text.processed_name(path, "_perfected").alias("name"))


@query("""SELECT user_id AS session_id, CAST(sum(2) AS BIGINT) AS frames, sha256(string_agg(CAST(event_id AS VARCHAR) || ',' || CAST(-event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS audio FROM events GROUP BY user_id""")
def recorded_takes(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.struct("ts", "event_id").alias("seq"), F.array("event_id", -F.col("event_id")).alias("chunk"))
    return capture.joined_audio(chunks).select("session_id", F.size("audio").cast("bigint").alias("frames"), F.sha2(F.array_join(F.transform("audio", lambda v: v.cast("string")), ",").cast("binary"), 256).alias("audio"))


@query("""SELECT n_nationkey AS project_id, '/audio/project_' || n_nationkey || '/README.md' AS path, '# ' || n_name || chr(10) || chr(10) || 'Type: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'Sample Pack' ELSE 'Virtual Instrument' END || chr(10) AS content FROM nation""")
def project_readme(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") % 2 == 0, "sample_pack").otherwise("virtual_instrument")
    return exports.readme(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), kind.alias("project_type")), "/audio")


@query("""SELECT o_orderkey AS id, o_comment_ AS text, CAST(octet_length(encode(o_comment_)) AS INTEGER) AS bytes FROM (SELECT o_orderkey, 'MThd' || o_orderkey || o_orderstatus AS o_comment_ FROM orders)""")
def midi_rows(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("MThd"), "o_orderkey", "o_orderstatus")
    kept = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.base64(F.encode(body, "UTF-8")).alias("file_data"))
    return kept.select("id", exports.midi_content(F.col("file_data")).cast("string").alias("text"), F.octet_length(exports.midi_content(F.col("file_data"))).alias("bytes"))


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS l FROM lineitem), ev AS (SELECT k, l * 960 AS t, 1 AS on_, l + 60 AS p FROM n UNION ALL SELECT k, l * 960 + 100, 0, l + 60 FROM n),
g AS (SELECT k, t, on_, p, t - coalesce(lag(t) OVER (PARTITION BY k ORDER BY t, on_, p), 0) AS dt FROM ev),
b AS (SELECT k, string_agg((CASE WHEN dt >= 128 THEN printf('%02X', 128 + dt // 128) ELSE '' END) || printf('%02X', dt % 128) || (CASE WHEN on_ = 1 THEN '90' ELSE '80' END) || printf('%02X', p) || (CASE WHEN on_ = 1 THEN '64' ELSE '00' END), '' ORDER BY t, on_, p) || '00FF2F00' AS h FROM g GROUP BY k)
SELECT k AS l_orderkey, CAST(22 + length(h) // 2 AS INTEGER) AS bytes, sha256('4D546864000000060000000103C04D54726B' || printf('%08X', length(h) // 2) || h) AS content FROM b""")
def midi_files(spark: SparkSession, d: str) -> DataFrame:
    """Every byte of a file for each order."""
    notes = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", (F.col("l_linenumber") * 960).cast("bigint").alias("start"), F.lit(100).cast("bigint").alias("dur"), (F.col("l_linenumber") + 60).cast("int").alias("pitch"), F.lit(80).alias("velocity"))
    made = exports.midi_files(notes, "l_orderkey")
    return made.select("l_orderkey", F.octet_length("midi").alias("bytes"), F.sha2(F.hex("midi").cast("binary"), 256).alias("content"))


@query("""WITH f AS (SELECT p_partkey AS project_id, 'loop_' || p_size AS label, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)
SELECT 100 + n AS id, 500 + n AS session_id, project_id, 'Generation ' || label || ' 20240506_070809' AS name, 'completed' AS status, 7 AS device_id, 'x' || project_id AS body FROM f""")
def generated_sessions(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select(F.col("p_partkey").alias("project_id"), F.concat(F.lit("loop_"), "p_size").alias("label"), F.base64(F.encode(F.concat(F.lit("x"), "p_partkey"), "UTF-8")).alias("file_data"))
    devices = spark.createDataFrame([(7, "Internal")], "id long, name string")
    sessions, files = exports.generated_rows(made, devices, "Internal", _now(), 500, 100)
    joined = files.join(sessions.select(F.col("id").alias("capture_session_id"), "project_id", "name", "status"), "capture_session_id")
    return joined.select("id", F.col("capture_session_id").alias("session_id"), "project_id", "name", "status", "device_id", F.col("file_data").cast("string").alias("body"))


# --- catalogue -----------------------------------------------------------------------------------


@query("""WITH d AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0), top AS (SELECT coalesce(max(id), 0) AS top FROM d)
SELECT id, name, s_nationkey % 2 = 0 AS touched FROM d JOIN supplier ON id = s_suppkey
UNION ALL SELECT top + row_number() OVER (ORDER BY s_name), s_name, true FROM supplier, top WHERE s_suppkey % 2 = 1 AND s_nationkey % 2 = 0""")
def device_upsert(spark: SparkSession, d: str) -> DataFrame:
    s, old = table(spark, d, "supplier"), F.lit("2020-01-01").cast("timestamp_ntz")
    known = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("description"), F.lit(True).alias("is_available"), F.lit("{}").alias("metadata_json"), old.alias("created_at"), old.alias("updated_at"))
    seen = s.where("s_nationkey % 2 = 0").select(F.col("s_name").alias("name"))
    return catalogue.upsert_devices(known, seen.unionByName(seen), _now()).select("id", "name", (F.col("updated_at") == _now()).alias("touched"))


@query("SELECT s_suppkey AS device_id, s_name AS name FROM supplier WHERE s_suppkey % 3 = 0")
def device_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    asked = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("name"))
    return catalogue.device_ids(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), asked.unionByName(asked.select(F.concat("name", F.lit("?")).alias("name"))))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY o_orderdate, o_orderkey")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    files = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("capture_session_id"), F.col("o_orderdate").alias("created_at"))
    least = orders.agg(F.min("o_custkey")).first()[0]
    return catalogue.midi_files_of(files, -1 if least is None else least).select("id", "created_at")


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 1")
def first_recording(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.first_of(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT p_partkey AS id, p_size AS high_vel FROM part ORDER BY p_size DESC, p_partkey")
def layers_by_velocity(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.layers(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("high_vel")))


@query("SELECT n_nationkey AS id, 'construction_kit' AS project_type FROM nation WHERE n_regionkey = 1")
def kit_projects(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n_regionkey") == 1, "construction_kit").otherwise("sample_pack")
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), kind.alias("project_type"))
    return catalogue.of_type(projects.where("project_type = 'construction_kit'"), "construction_kit")


@query("""SELECT 'projects' AS name, count(*) AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'recordings', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2
UNION ALL SELECT 'samples', count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2""")
def cascaded_deletes(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_regionkey")
    recordings = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recording_id"))
    left = schema.cascade({"projects": projects, "recordings": recordings, "samples": samples}, projects.where("n_regionkey <> 2"))
    each = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""SELECT project_id, kind, count(*) AS assets, count(*) FILTER (has) AS tagged FROM (SELECT c_nationkey AS project_id, 'sample' AS kind, true AS has FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT s_nationkey, 'midi', false FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""")
def project_assets(spark: SparkSession, d: str) -> DataFrame:
    recordings = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recording_id"), F.lit('{"a":1}').alias("metadata_json"))
    midi = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("capture_session_id"))
    sessions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"))
    return manifest.project_assets(samples, recordings, midi, sessions).groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("tags_json") != "{}").alias("tagged"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders), m AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber = 1)
SELECT 'midi' AS kind, id AS asset_id FROM m UNION ALL SELECT 'sample', id FROM a WHERE s <> 'F'""")
def unassigned_assets(spark: SparkSession, d: str) -> DataFrame:
    one = F.lit(1).cast("bigint").alias("project_id")
    samples = table(spark, d, "orders").select(one, F.lit("sample").alias("kind"), F.col("o_orderkey").alias("asset_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("tags_json"))
    midi = table(spark, d, "lineitem").where("l_linenumber = 1").select(one, F.lit("midi").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("asset_id"), F.lit("{}").alias("tags_json"))
    rules = spark.createDataFrame([(1, 1, '{"s":"f"}')], "project_id long, rule_id int, required_tags_json string")
    assets = samples.unionByName(midi)
    return manifest.unassigned(assets, manifest.match(rules, assets)).select("kind", "asset_id")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey AS project_id, o_orderkey AS asset_id, 'General/Other/Hits_' || n || '.wav' AS path FROM a WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_custkey, o_orderkey, 'Unassigned/' || o_orderkey || '.wav' FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 0""")
def kit_files_there(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    assets = orders.select(F.col("o_custkey").alias("project_id"), F.lit("sample").alias("kind"), F.col("o_orderkey").alias("asset_id"), F.to_json(F.struct(F.col("o_orderstatus").alias("s"))).alias("tags_json"), F.lit(".wav").alias("ext"), F.concat(F.lit("/in/"), "o_orderkey", F.lit(".wav")).alias("file_path"))
    rules = orders.select(F.col("o_custkey").alias("project_id")).distinct().select("project_id", F.lit(1).alias("rule_id"), F.lit("Hits").alias("name"), F.lit("").alias("category"), F.lit('{"s":"F"}').alias("required_tags_json"))
    there = assets.where("asset_id % 2 = 0").select("kind", "asset_id")
    return exports.kit_paths(rules, manifest.match(rules, assets), assets, there).select("project_id", "asset_id", "path")


_PRESET = """WITH s AS (SELECT c_custkey AS id, c_nationkey AS project_id FROM customer), z AS (SELECT id, project_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g, 60 + id % 12 AS note FROM s),
e AS (SELECT project_id, CASE WHEN g IS NULL THEN 'Unassigned' ELSE 'layer ' || g END AS grp, 'Samples/' || id || '.wav' AS path, '/in/' || id || '.wav' AS whole, note FROM z),
g AS (SELECT n_nationkey AS project_id, 'layer ' || k AS grp, k * 40 AS lo, k * 40 + 39 AS hi FROM nation, (VALUES (1), (2), (3)) v(k) UNION ALL SELECT DISTINCT project_id, 'Unassigned', 0, 127 FROM e WHERE grp = 'Unassigned'),
x AS (SELECT g.project_id, g.grp, '<group name="' || g.grp || '" loVel="' || lo || '" hiVel="' || hi || '"' || CASE WHEN count(path) = 0 THEN ' />' ELSE '>' || string_agg('<sample path="' || path || '" rootNote="' || note || '" loKey="' || note || '" hiKey="' || note || '" />', '' ORDER BY note, whole) || '</group>' END AS body
 FROM g LEFT JOIN e ON g.project_id = e.project_id AND g.grp = e.grp GROUP BY g.project_id, g.grp, lo, hi)"""


@query(f"""{_PRESET} SELECT project_id, '<DecentSampler><groups>' || string_agg(body, '' ORDER BY grp) || '</groups></DecentSampler>' AS xml FROM x GROUP BY project_id""")
def preset_xml(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    samples = c.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("id"), F.concat(F.lit("/in/"), "c_custkey", F.lit(".wav")).alias("file_path"))
    items = c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("sample_id"), (F.col("c_custkey") % 3).alias("velocity_group_id"), F.lit(0).alias("key_range_start"), F.lit(0).alias("key_range_end"), (F.col("c_custkey") % 12 + 60).alias("root_note"))
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("id")).select("project_id", F.col("id").cast("bigint").alias("id"), F.concat(F.lit("layer "), "id").alias("name"), (F.col("id") * 40).alias("low_vel"), (F.col("id") * 40 + 39).alias("high_vel"))
    return exports.preset_files(exports.preset_rows(groups, catalogue.key_zones(samples, items), samples))


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'completed' ELSE 'completed_empty' END WHEN 1 THEN 'failed' ELSE 'pending' END AS status FROM supplier""")
def session_ends(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    session = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 3 == 0, "recording").when(k % 3 == 1, "failed").otherwise("pending").alias("status"))
    files = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(k.alias("capture_session_id"))
    return capture.session_status(session, files.unionByName(files))


@query("""SELECT session_id AS capture_session_id, user_id AS device_id, CASE WHEN event_type = 'view' THEN -1 ELSE length(event_type) END AS channel, 'dev_' || user_id || '_ch' || CASE WHEN event_type = 'view' THEN 'sys' ELSE CAST(length(event_type) AS VARCHAR) END AS name, CAST(count(*) AS INTEGER) AS messages
FROM (SELECT *, 1 AS session_id FROM events) WHERE user_id % 2 = 0 GROUP BY ALL""")
def flushed_tracks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    channel = capture.channel_of(F.when(F.col("event_type") != "view", F.length("event_type")))
    log = e.select(F.lit(1).alias("session_id"), F.col("user_id").alias("device_id"), channel.alias("channel"), F.struct("ts", "event_id").alias("seq"), F.col("event_id").alias("message"))
    devices = e.where("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("dev "), "id"))
    return capture.flush(log, 1, devices).withColumn("messages", F.size("messages"))


# --- texts and tags ------------------------------------------------------------------------------


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 AS a, l_quantity / 16 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(a, 2) AS peak_db, round_even(b, 3) AS score, round_even(b, 4) AS zero_crossing_rate FROM q""")
def report_rounding(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_quantity") / 8, F.col("l_quantity") / 16
    report = F.struct(*[a.alias(c) for c in ("peak_db", "rms_db", "noise_floor_db", "clip_ratio", "dc_offset", "dynamic_range_db", "snr_db")], b.alias("zero_crossing_rate"), b.alias("score"))
    return table(spark, d, "lineitem").withColumn("r", report).select("l_orderkey", "l_linenumber", *[c for c, n in zip(signal.rounded("r"), ("peak_db", "rms", "nf", "cr", "dc", "dr", "snr", "zcr", "score"), strict=True) if n in ("peak_db", "zcr", "score")])


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'One Shot' WHEN 1 THEN 'Virtual Instrument' ELSE 'Loop' END AS label, 'session ' || CASE WHEN p_size % 2 = 0 THEN p_size || ' ' ELSE '' END || '20240506_070809' AS session FROM part""")
def enum_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "one_shot").when(F.col("p_size") % 3 == 1, "virtual_instrument").otherwise("loop")
    label = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.title(kind).alias("label"), text.session_name(label, _now(), "session").alias("session"))


@query("""SELECT o_orderkey, concat_ws('; ', 'Stabs: ' || o_orderkey % 9, CASE WHEN o_orderkey % 4 > 0 THEN 'Average silence: ' || o_orderkey % 4 || '.5 ms' END, CASE WHEN o_orderkey % 3 > 0 THEN 'Issues: ' || CASE WHEN o_orderkey % 3 = 1 THEN 'short' ELSE 'short, ' || repeat('y', 100) || '...' END END) AS comment,
concat_ws(', ', CASE WHEN o_orderkey % 5 = 0 THEN 'tempo missing' END, CASE WHEN o_orderkey % 7 < 2 THEN 'key missing' END, CASE WHEN o_orderkey % 2 = 0 THEN 'cue labels missing' END) AS missing FROM orders""")
def comment_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    issues = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("short"))).otherwise(F.array(F.lit("short"), F.lit("y" * 101)))
    silence = F.when(k % 4 > 0, (k % 4).cast("double") + 0.5)
    key = F.when(k % 7 == 0, "").when(k % 7 != 1, "Am")
    labels = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 2 == 1, F.array(F.lit("a")))
    missing = vocal.metadata_issues(F.when(k % 10 != 0, (k % 5).cast("double")), key, labels)
    return table(spark, d, "orders").select("o_orderkey", vocal.comment(k % 9, silence, issues).alias("comment"), F.array_join(missing, ", ").alias("missing"))


@query("""SELECT event_id, event_id % 4 IN (0, 2) AS a_equals_b, CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 12 ELSE 0 END AS strict FROM events""")
def mixed_equality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    a = F.when(k % 4 == 0, "120").when(k % 4 == 1, '"120"').when(k % 4 == 2, '"Bass"').otherwise('["A"]')
    b = F.when(k % 4 == 0, "120.0").when(k % 4 == 1, "120").when(k % 4 == 2, '"bASS"').otherwise('["a"]')
    options = F.when(k % 3 == 0, '{"depth":7}').when(k % 3 == 1, '{"depth":12,"x":[1]}').otherwise('{"depth":0}')
    same = tags.canonical(F.parse_json(a)) == tags.canonical(F.parse_json(b))
    return table(spark, d, "events").select("event_id", same.alias("a_equals_b"), F.variant_get(tags.parse_strict(options), "$.depth", "int").alias("strict"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 1.5 ELSE 2.5 END AS start_time, CAST(4 AS DOUBLE) AS end_time, CASE WHEN o_orderkey % 2 = 0 THEN 'one_shot' ELSE 'loop' END AS type FROM orders""")
def slice_point_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    json = F.when(k % 3 == 0, '{"start":null,"start_time":9,"end":4}').when(k % 3 == 1, '{"start":1.5,"start_time":9,"end":4}').otherwise('{"start_time":2.5,"end_time":4}')
    return table(spark, d, "orders").select("o_orderkey", segments.point_bounds(json).alias("b"), F.coalesce(F.when(k % 2 == 1, "loop"), F.lit("one_shot")).alias("type")).select("o_orderkey", "b.start_time", "b.end_time", "type")


# --- segments, loops, stabs ----------------------------------------------------------------------


@query("""SELECT event_id, CAST(event_id % 7 AS DOUBLE) AS t FROM events WHERE event_id % 3 <> 0""")
def numeric_onsets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(k % 3 != 0, (k % 7).cast("string")).when(k % 2 == 0, "soon").otherwise("NaN").alias("t"))
    return segments.numeric_onsets(rows)


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS dur, l_extendedprice / 10 AS cen, l_discount / 2 AS flat, l_tax AS lev FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN flat < 0.005 THEN 'tonal' WHEN flat > 0.05 THEN 'noisy' ELSE 'hybrid' END AS character, 'one_shot' AS type,
 CASE WHEN cen < 1800 AND flat < 0.01 THEN 'kick' WHEN cen > 5000 THEN 'hihat' WHEN flat > 0.01 THEN 'snare' WHEN flat < 0.01 THEN 'tom' ELSE 'perc' END AS instrument,
 concat_ws(',', 'one_shot', CASE WHEN cen < 1800 AND flat < 0.01 THEN 'drum,kick' WHEN cen > 5000 THEN 'drum,hihat,' || CASE WHEN dur > 0.3 THEN 'open_hat' ELSE 'closed_hat' END WHEN flat > 0.01 THEN 'drum,snare' WHEN flat < 0.01 THEN 'drum,tom' ELSE 'perc' END,
 CASE WHEN flat < 0.005 THEN 'tonal' WHEN flat > 0.05 THEN 'noisy' END, CASE WHEN lev > 0.1 THEN 'high_energy' WHEN lev < 0.01 THEN 'low_energy' END) AS tags FROM f""")
def sound_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("start_time"), (F.col("l_quantity") / 100).alias("end_time"), (F.col("l_extendedprice") / 10).alias("centroid"), (F.col("l_discount") / 2).alias("flatness"), F.col("l_tax").alias("rms"))
    made = segments.described(rows)
    return made.select("l_orderkey", "l_linenumber", "character", "type", F.col("instrument_type").alias("instrument"), F.array_join("tags", ",").alias("tags"))


@query("""WITH s AS (SELECT CASE l_linenumber WHEN 1 THEN 'kick' WHEN 2 THEN 'snare' WHEN 3 THEN 'hihat' END AS c, CAST(l_partkey AS DOUBLE) AS cen, CAST(l_suppkey AS DOUBLE) AS flat FROM lineitem),
a AS (SELECT c, min(cen) AS lo, max(cen) AS hi, min(flat) AS f FROM s WHERE c IS NOT NULL GROUP BY c)
SELECT (max(hi) FILTER (c = 'kick') + min(lo) FILTER (c <> 'kick')) / 2 AS kick_centroid, coalesce((max(lo) FILTER (c = 'hihat') + max(hi) FILTER (c <> 'hihat')) / 2, max(lo) FILTER (c = 'hihat') * 0.8) AS hat_centroid, max(f) FILTER (c = 'snare') * 0.9 AS snare_flatness FROM a""")
def drum_limits(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "kick").when(F.col("l_linenumber") == 2, "snare").when(F.col("l_linenumber") == 3, "hihat")
    rows = table(spark, d, "lineitem").select(name.alias("category"), F.col("l_partkey").cast("double").alias("centroid"), F.col("l_suppkey").cast("double").alias("flatness"), F.col("l_quantity").alias("duration"))
    return segments.propose_cuts(segments.drum_thresholds(rows))


@query(f"""WITH {_ON}, p AS (SELECT recording_id, t AS a, greatest(least(coalesce(lead(t) OVER w, t + 10.0), t + 10.0), t + 0.05) AS b FROM o WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
c AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY a, b) - 1 AS idx, CAST(trunc(a * 100) AS BIGINT) AS x, least(150000, CAST(trunc(b * 100) AS BIGINT)) AS y FROM p)
SELECT recording_id, CAST(idx AS INTEGER) AS idx, format('rec_slice_{{:03d}}', idx + 1) AS name, x AS first_sample, y AS last_sample FROM c WHERE x < y AND x >= 0 AND (y - x) / 100.0 BETWEEN 0.1 AND 10.0""")
def slicing_chain(spark: SparkSession, d: str) -> DataFrame:
    onsets = _onsets(spark, d)
    recordings = onsets.select("recording_id").distinct().select("recording_id", F.lit("rec").alias("base"), F.lit(100).alias("sample_rate"), F.lit(150_000).cast("bigint").alias("n_samples"))
    steps = [{"stage_name": n} for n in ("slice_planning", "segment_classification", "slice_points", "slicing")]
    made = chain.segmentation(recordings).run(steps, onsets, chain.ONSETS)
    return made.data.select("recording_id", "idx", "name", "first_sample", "last_sample")


@query("""WITH r AS (SELECT c_custkey AS recording_id, c_custkey % 40 + 1.0 AS duration, 60.0 + c_custkey % 5 * 30 AS bpm FROM customer), b AS (SELECT *, bars, 240.0 / bpm AS bar FROM r, (VALUES (1), (2), (4), (8), (16)) v(bars)),
f AS (SELECT * FROM b WHERE bars * bar BETWEEN 0.5 AND 32 AND bars * bar <= duration), e AS (SELECT *, unnest(range(0, CAST(floor((duration - bars * bar) / bar) AS BIGINT) + 1)) AS k FROM f)
SELECT recording_id, bars, k * bar AS start_time, k * bar + bars * bar AS end_time FROM e""")
def grid_loops(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("recording_id"), (k % 40 + 1.0).alias("duration"), (k % 5 * 30 + 60.0).alias("bpm"))
    return loops.grid_candidates(rows, cap=None)


@query(f"""WITH {_BEATS}, b AS (SELECT recording_id, list(t ORDER BY i) AS ts FROM e GROUP BY recording_id), g AS (SELECT recording_id, median(gap) AS period FROM (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY i) AS gap FROM e) GROUP BY recording_id),
n AS (SELECT recording_id, ts, ts[1] + 0.4 AS a, ts[1] + 9.0 AS z, CASE WHEN len(ts) > 1 THEN greatest(period, 1e-9) ELSE 0.5 END AS period FROM b JOIN g USING (recording_id))
SELECT recording_id, round((greatest(0, least(1, 1 - list_min(list_transform(ts, lambda t: abs(t - a))) / period)) + greatest(0, least(1, 1 - list_min(list_transform(ts, lambda t: abs(t - z))) / period))) / 2, 5) AS beat_alignment FROM n""")
def beat_alignment(spark: SparkSession, d: str) -> DataFrame:
    lists = _beats(spark, d).groupBy("recording_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("ts"))
    first = F.get("ts", F.lit(0))
    return lists.select("recording_id", F.round(loops.beat_alignment(first + 0.4, first + 9.0, F.col("ts")), 5).alias("beat_alignment"))


@query("""WITH c AS (SELECT o_orderkey, o_orderkey % 977 / 7.0 AS a, o_orderkey % 977 / 7.0 + o_orderkey % 31 AS b, o_orderkey % 5 * 40.0 AS bpm FROM orders)
SELECT o_orderkey, CAST(trunc(a * 44100) AS BIGINT) AS loop_start, CAST(trunc(b * 44100) AS BIGINT) AS loop_end, (b - a) / CASE WHEN bpm > 0 THEN 240.0 / bpm ELSE 2.0 END AS bars FROM c""")
def loop_bounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, rate = k % 977 / F.lit(7.0), F.lit(44_100)
    b, bpm = a + k % 31, k % 5 * F.lit(40.0)
    return table(spark, d, "orders").select("o_orderkey", arithmetic.seconds_to_samples(a, rate).alias("loop_start"), arithmetic.seconds_to_samples(b, rate).alias("loop_end"), ((b - a) / arithmetic.bar_seconds(bpm)).alias("bars"))


@query("""SELECT o_orderkey, round(greatest(0, least(1, 0.2 * x + 0.25 * y + 0.2 * z + 0.05 * x + 0.1 * y + 0.1 * z + 0.5 * x)), 6) AS score FROM (SELECT o_orderkey, o_orderkey % 11 / 10.0 AS x, o_orderkey % 7 / 10.0 AS y, o_orderkey % 3 / 10.0 AS z FROM orders)""")
def loop_score(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = (F.col("o_orderkey") % n / F.lit(10.0) for n in (11, 7, 3))
    names = dict(zip(loops.WEIGHTS, (x, y, z, x, y, z, x), strict=True))
    return table(spark, d, "orders").select("o_orderkey", F.round(loops.overall(names, {"spectral_stability": 0.5}), 6).alias("score"))


@query("""WITH o AS (SELECT user_id AS file_id, CAST(event_id * 10 AS BIGINT) AS s FROM events), n AS (SELECT file_id, max(s) + 500 AS n FROM o GROUP BY file_id)
SELECT file_id, CAST(row_number() OVER w - 1 AS INTEGER) AS stab, s AS start_sample, coalesce(lead(s) OVER w, n) AS end_sample FROM o JOIN n USING (file_id) WINDOW w AS (PARTITION BY file_id ORDER BY s)""")
def stab_rows(spark: SparkSession, d: str) -> DataFrame:
    onsets = table(spark, d, "events").select(F.col("user_id").alias("file_id"), (F.col("event_id") * 10).cast("bigint").alias("start_sample"))
    return vocal.stabs(onsets, onsets.groupBy("file_id").agg((F.max("start_sample") + 500).alias("n_samples")))


@query("""WITH j AS (SELECT p_partkey, p_size AS seed, unnest([1, 2, 3, 4]) AS v FROM part) SELECT p_partkey, 'loop_var' || v AS label, CAST(seed + v - 1 AS BIGINT) AS seed FROM j""")
def loop_variations(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.variations(table(spark, d, "part").select("p_partkey", F.lit("loop").alias("label"), F.col("p_size").alias("seed"))).select("p_partkey", "label", "seed")


# --- signals and kernels -------------------------------------------------------------------------


@query("SELECT o_orderkey, true AS is_silent, CAST(0 AS DOUBLE) AS score, CAST(-120 AS DOUBLE) AS peak_db, 'silent' AS issues FROM orders")
def empty_buffers(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("o_orderkey") % 2 == 0, F.array().cast("array<double>"))
    return table(spark, d, "orders").withColumn("r", signal.quality_report(y)).select("o_orderkey", "r.is_silent", "r.score", "r.peak_db", F.array_join("r.issues", ",").alias("issues"))


@query(f"""WITH {_BUF}, c AS (SELECT vec_id, list_transform(y[1:12], lambda v: abs(v)) AS c FROM b), t AS (SELECT vec_id, c, list_position(c, list_max(c)) - 1 AS t FROM c)
SELECT vec_id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][t + 1] || CASE WHEN c[(t + 4) % 12 + 1] > c[(t + 3) % 12 + 1] THEN '' ELSE 'm' END AS key FROM t""")
def key_names(spark: SparkSession, d: str) -> DataFrame:
    return _buffers(spark, d).select("vec_id", audio.key_name(F.transform(F.slice("y", 1, 12), lambda v: F.abs(v.cast("double")))).alias("key"))


_TURNS = "list_filter(range(1, 64), lambda i: sign(y[i]) <> sign(y[i + 1]))"


@query(f"""WITH {_BUF}, c AS (SELECT vec_id, y, CAST(vec_id % 64 AS INTEGER) AS p, {_TURNS} AS turns FROM b),
n AS (SELECT *, list_min(list_transform(turns, lambda i: abs(i - 1 - p) * 1000 + i)) % 1000 AS q, list_min(list_transform(turns, lambda i: abs(i - p) * 1000 + i)) % 1000 AS r FROM c)
SELECT vec_id, CAST(CASE WHEN len(turns) = 0 THEN list_position(list_transform(y, lambda v: abs(v)), list_min(list_transform(y, lambda v: abs(v)))) - 1 WHEN abs(y[q]) < abs(y[q + 1]) THEN q - 1 ELSE q END AS BIGINT) AS quiet, CAST(CASE WHEN len(turns) = 0 THEN p ELSE r END AS BIGINT) AS after FROM n""")
def nearest_crossings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") % 64).cast("int").alias("p"))
    return audio.crossings(rows, "p").select("vec_id", "quiet", "after")


@query(f"""WITH {_BUF} SELECT vec_id, len(list_filter(range(greatest(0, p - 3) + 1, least(64, p + 3)), lambda i: sign(y[i]) <> sign(y[i + 1]))) > 0 AS clean FROM (SELECT vec_id, y, CAST(vec_id % 64 AS INTEGER) AS p FROM b)""")
def crosses_near(spark: SparkSession, d: str) -> DataFrame:
    return _buffers(spark, d).select("vec_id", signal.crosses_near(F.col("y"), (F.col("vec_id") % 64).cast("int"), 3).alias("clean"))


@query(f"""WITH {_BUF}, k AS (SELECT range AS k FROM range(1025)), w AS (SELECT vec_id, list_transform(range(64), lambda j: y[j + 1] * (0.5 - 0.5 * cos(2 * pi() * (1024 + j) / 2048))) AS y FROM b),
s AS (SELECT vec_id, k, sqrt(pow(list_sum(list_transform(range(64), lambda j: y[j + 1] * cos(2 * pi() * k * j / 2048))), 2) + pow(list_sum(list_transform(range(64), lambda j: y[j + 1] * sin(2 * pi() * k * j / 2048))), 2)) AS m FROM w, k)
SELECT vec_id, round(sum(k * 8000 / 2048 * m) / sum(m), 3) AS centroid, round(exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)), 6) AS flatness, round(sum(m), 4) AS loud FROM s GROUP BY vec_id""")
def segment_features(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(8000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))
    made = audio.segment_features(rows, "vec_id").select("vec_id", F.round("centroid", 3).alias("centroid"), F.round("flatness", 6).alias("flatness"))
    spectrum = audio.features(rows, "vec_id").select("vec_id", F.round(F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v), 4).alias("loud"))
    return made.join(spectrum, "vec_id")


@query(f"""WITH {_BUF} SELECT vec_id, CAST(len(y) * 2 AS INTEGER) AS n, 16000 AS sample_rate,
round(list_sum(list_transform(range(128), lambda j: abs(list_sum(list_transform(range(64), lambda k: y[k + 1] * CASE WHEN j = 2 * k THEN 1 WHEN j % 2 = 0 OR abs(j / 2 - k) > 16 THEN 0 ELSE sin(pi() * (j / 2 - k)) / (pi() * (j / 2 - k)) * (0.5 + 0.5 * cos(pi() * (j / 2 - k) / 16)) END))))), 3) AS total FROM b""")
def resampled_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Twice the sample rate, against the windowed sinc written out."""
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(8000).alias("sample_rate"), F.col("embedding").alias("samples"))
    return wav.resampled(rows, "vec_id", 16_000).select("vec_id", F.size("samples").alias("n"), "sample_rate", F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))), 3).alias("total"))


_NEAR = "coalesce(list_min(list_transform(list_filter(range({a}, {b}), lambda k: (y[k + 1] < 0) <> (y[k] < 0)), lambda k: abs(k - {at}) * 100 + k)) % 100, {at})"


@query(f"""WITH {_BUF}, m AS (SELECT vec_id, y, {_NEAR.format(a=1, b=4, at=0)} AS p, {_NEAR.format(a=29, b=36, at=32)} AS q, {_NEAR.format(a=61, b=64, at=64)} AS r FROM b)
SELECT vec_id, CAST(r - p + 3 AS INTEGER) AS n, round(list_sum(list_transform(y[p + 1 : r], lambda v: abs(v))), 5) AS total, CAST(q - p + 3 AS BIGINT) AS second_start, CAST(r - p + 3 AS BIGINT) AS second_end FROM m""")
def joined_stabs(spark: SparkSession, d: str) -> DataFrame:
    """Two stabs moved to the changes of sign within four samples, with three samples of silence between."""
    stabs = F.array(F.struct(F.lit(0).cast("bigint").alias("start_sample"), F.lit(32).cast("bigint").alias("end_sample")), F.struct(F.lit(32).cast("bigint").alias("start_sample"), F.lit(64).cast("bigint").alias("end_sample")))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit(8000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"), stabs.alias("stabs"))
    out = vocal.repair(rows, silence_ms=0.375, reach_ms=1.0)
    second = F.get("stabs", F.lit(1))
    return out.select(F.col("file_id").alias("vec_id"), F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("total"), second["start_sample"].alias("second_start"), second["end_sample"].alias("second_end"))


# --- made-up audio: the SQL says what must be found in it ----------------------------------------


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a written table, as stages read audio several times."""
    rows.write.parquet(path := f"{shared_folder(rows.sparkSession)}/audio-{uuid.uuid4().hex}")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _loops(spark: SparkSession, d: str) -> DataFrame:
    """A 16-beat loop at 8 kHz for each nation, at 80, 100, 120, 140 or 160 beats a minute."""
    key, y = F.col("n_nationkey"), F.array().cast("array<double>")
    for k, bpm in enumerate((80, 100, 120, 140, 160)):
        y = F.when(key % 5 == k, wav.beat_loop(bpm, 16, 8000)).otherwise(y)
    return _kept(table(spark, d, "nation").select(key.cast("bigint").alias("recording_id"), F.lit(8000).alias("sample_rate"), y.alias("samples")))


_BPM = "(80 + 20 * (n_nationkey % 5))"


@query("""SELECT n_nationkey, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][n_nationkey % 12 + 1] AS tonic FROM nation""")
def tone_keys(spark: SparkSession, d: str) -> DataFrame:
    hz = F.pow(F.lit(2.0), (F.col("n_nationkey") % 12 - 9) / 12.0) * 440.0
    rows = table(spark, d, "nation").select("n_nationkey", F.lit(8000).alias("sample_rate"), wav.sine(1.0, hz, 8000).alias("samples"))
    return audio.described(audio.features(rows, "n_nationkey")).select("n_nationkey", F.regexp_replace("key", "m$", "").alias("tonic"))


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS recording_id, true AS tempo_found, true AS beats_found, CAST(16 * CAST(trunc(60.0 / {_BPM} * 8000) AS INTEGER) / 8000.0 AS DOUBLE) AS duration FROM nation""")
def beat_tempo(spark: SparkSession, d: str) -> DataFrame:
    want = (F.col("recording_id") % 5) * 20 + 80
    near = lambda x: F.abs(F.col("bpm") / (want * x) - 1) < 0.05
    gap = F.transform(F.sequence(F.lit(1), F.size("beats") - 1), lambda i: F.get("beats", i) - F.get(F.col("beats"), i - 1))
    steady = F.forall(gap, lambda g: F.abs(g * F.col("bpm") / 60 - 1) < 0.2)
    return audio.beat_times(_loops(spark, d)).select("recording_id", near(1.0).alias("tempo_found"), ((F.size("beats") >= 6) & steady).alias("beats_found"), "duration")


@query(f"""SELECT CAST(n_nationkey AS BIGINT) AS recording_id, 8000 AS sample_rate, 16 * CAST(trunc(60.0 / {_BPM} * 8000) AS INTEGER) / 8000.0 AS duration, true AS hits_found, true AS loops_found, true AS whole_beats, true AS loops_ordered, true AS loops_apart, true AS flag_follows FROM nation""")
def loop_records(spark: SparkSession, d: str) -> DataFrame:
    """The metadata record of each loop: onsets at nearly all hits, at least one loop, all of whole beats and inside the audio, by rank, none overlapping another by more than half."""
    buffers = _loops(spark, d)
    timed = audio.beat_times(buffers)
    found = loops.search(buffers, timed)
    files = buffers.withColumns({"channels": F.lit(1), "bit_depth": F.lit(16)})
    made = audio.record(files, audio.described(audio.features(buffers, "recording_id")), found)
    c = F.coalesce("loop_candidates", F.array().cast(made.schema["loop_candidates"].dataType))
    ordered = F.forall(F.transform(c, lambda x, i: (x["rank"] == i + 1) & (x["end_time"] > x["start_time"]) & (x["confidence"] >= 0.3)), lambda ok: ok)
    apart = F.forall(c, lambda a: F.forall(c, lambda b: (a["rank"] >= b["rank"]) | (arithmetic.overlap_ratio(a["start_time"], a["end_time"], b["start_time"], b["end_time"]) <= 0.5)))
    follows = F.col("is_loop") == F.coalesce(F.get(c, F.lit(0))["confidence"] > 0.7, F.lit(False))
    beats = lambda x: (x["end_time"] - x["start_time"]) * ((F.col("recording_id") % 5) * 20 + 80) / 60
    whole = F.forall(c, lambda x: (F.abs(beats(x) - F.round(beats(x))) < 0.15) & (beats(x) > 3.5) & (x["start_time"] >= 0) & (x["end_time"] <= F.col("duration")))
    return made.select("recording_id", "sample_rate", "duration", F.size("transient_positions").between(12, 20).alias("hits_found"), (F.size(c) >= 1).alias("loops_found"), whole.alias("whole_beats"), ordered.alias("loops_ordered"), apart.alias("loops_apart"), follows.alias("flag_follows"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS file_id, 'chop' || n_nationkey || '_perfected' AS name, true AS counted, 'T' || n_nationkey AS title, true AS laid_out, true AS gaps_told, false AS labels_missing FROM nation""")
def vocal_chops(spark: SparkSession, d: str) -> DataFrame:
    files = _loops(spark, d).select(F.col("recording_id").alias("file_id"), F.concat(F.lit("/in/chop"), "recording_id", F.lit("_denoised.wav")).alias("name"), "sample_rate", "samples", F.array(F.lit("ah")).alias("labels"), F.create_map(F.lit("title"), F.concat(F.lit("T"), "recording_id")).alias("tags"))
    made = chain.workflows().run("VocalChopPerfection", files).data
    n = F.regexp_extract(F.col("tags")["comment"], r"^Stabs: (\d+); ", 1).cast("int")
    step = F.floor(F.lit(60.0 * 8000) / ((F.col("file_id") % 5) * 20 + 80)).cast("int")
    longer = F.size("samples") - n * step - (n - 1) * 600  # 75 ms of silence after each stab but the last, stabs moved by 5 ms at most, the first onset by 1,024 samples
    return made.select("file_id", "name", n.between(14, 17).alias("counted"), F.col("tags")["title"].alias("title"), longer.between(-80 * n, 80 * n + 1024).alias("laid_out"), F.array_contains("issues", "no silence or overlap").alias("gaps_told"), F.array_contains("issues", "cue labels missing").alias("labels_missing"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS recording_id, true AS several, true AS in_order, true AS checked FROM nation WHERE n_nationkey % 5 <> 4""")
def sample_packs(spark: SparkSession, d: str) -> DataFrame:
    """The whole workflow from audio to checked, faded slices: several a loop, all inside it. Nothing of the recordings that are one clipped hum passes the gate."""
    hum = F.transform(F.sequence(F.lit(0), F.lit(31_999)), lambda i: F.when(F.floor(i / 40) % 2 == 0, 1.0).otherwise(0.9) * F.when(i % 8000 < 4000, 1.0).otherwise(0.995))
    buffers = _kept(_loops(spark, d).withColumn("samples", F.when(F.col("recording_id") % 5 == 4, hum).otherwise(F.col("samples"))))
    recordings = buffers.select("recording_id", F.lit("take").alias("base"), "sample_rate", F.size("samples").cast("bigint").alias("n_samples"))
    rows = chain.workflows(recordings, buffers).run("SamplePack", buffers, {"onset_detection": {"sr": None}}).data
    inside = (F.col("first_sample") >= 0) & (F.size("samples") == F.col("last_sample") - F.col("first_sample")) & (F.get("samples", F.lit(0)) == 0)
    return rows.groupBy("recording_id").agg((F.count(F.lit(1)) >= 8).alias("several"), F.bool_and(inside).alias("in_order"), F.bool_and((F.col("qc_status") == "passed") & F.col("score").between(0.5, 1.0)).alias("checked"))
