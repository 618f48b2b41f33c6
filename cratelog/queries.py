"""The operators over the synthetic tables: each query stands beside the SQL that says the same.

nation plays the projects, customer the recordings, orders the samples; events are onsets with
user_id as the recording, an embedding is a short audio buffer, and lineitems are notes and stabs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import arithmetic, signal, tags, text
from .operators import catalogue, exports, loops, manifest, segments, spectral, symbolic, vocal
from .session import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import audio_queries, more_queries  # register their own

    assert audio_queries and more_queries
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


#: (rule_id, required tags, target, name, category); one in another case, one without tags.
RULES = [
    (1, '{"status":"F"}', 10, "Final Takes", "Bass"),
    (2, '{"status":"o","prio":"1-URGENT"}', 500, "Urgent Open", None),
    (3, '{"prio":"2-high"}', 30000, "High", "Keys"),
    (4, "{}", 1, "Anything", "Drums"),
    (5, '{"status":"P","prio":"5-LOW"}', 0, "Slow", ""),
]


def _rules(spark: SparkSession, d: str) -> DataFrame:
    names = ("rule_id", "required_tags_json", "target_count", "name", "category")
    rules = F.array(*[F.struct(*[F.lit(v).cast("int" if n in ("rule_id", "target_count") else "string").alias(n) for n, v in zip(names, rule)]) for rule in RULES])
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.inline(rules))


def _assets(spark: SparkSession, d: str) -> DataFrame:
    recordings = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    meta = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio")))
    samples = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("recording_id"), meta.alias("metadata_json"))
    return manifest.project_assets(samples, recordings)


_MATCH = """
a AS (SELECT c_nationkey AS project_id, o_orderkey AS asset_id, o_orderstatus AS status, o_orderpriority AS prio FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT project_id, asset_id, 1 AS rule_id FROM a WHERE lower(status) = 'f'
      UNION ALL SELECT project_id, asset_id, 2 FROM a WHERE lower(status) = 'o' AND lower(prio) = '1-urgent'
      UNION ALL SELECT project_id, asset_id, 3 FROM a WHERE lower(prio) = '2-high'
      UNION ALL SELECT project_id, asset_id, 5 FROM a WHERE lower(status) = 'p' AND lower(prio) = '5-low'),
rules(rule_id, target) AS (VALUES (1, 10), (2, 500), (3, 30000), (4, 1), (5, 0)),
s AS (SELECT n_nationkey AS project_id, rule_id, target, (SELECT count(*) FROM m WHERE m.project_id = n_nationkey AND m.rule_id = rules.rule_id) AS match_count FROM nation, rules),
st AS (SELECT project_id, rule_id, target AS target_count, match_count, CAST(CASE WHEN target <= 0 THEN 100 ELSE least(100, trunc(match_count / target * 100.0)) END AS INTEGER) AS progress, match_count >= target AS is_fulfilled FROM s)
"""


@query(f"WITH {_MATCH} SELECT * FROM st")
def manifest_rule_status(spark: SparkSession, d: str) -> DataFrame:
    rules = _rules(spark, d)
    return manifest.rule_status(rules, manifest.match(rules, _assets(spark, d)))


@query(f"WITH {_MATCH} SELECT project_id, CAST(trunc(avg(progress)) AS INTEGER) AS progress, CAST(NULL AS VARCHAR) AS message FROM st GROUP BY project_id")
def manifest_progress(spark: SparkSession, d: str) -> DataFrame:
    rules = _rules(spark, d)
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    status = manifest.rule_status(rules, manifest.match(rules, _assets(spark, d)))
    return manifest.project_progress(projects, projects.withColumnRenamed("id", "project_id"), status)


@query(f"WITH {_MATCH} SELECT project_id, 'sample' AS kind, asset_id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project_id = a.project_id AND m.asset_id = a.asset_id)")
def manifest_unassigned(spark: SparkSession, d: str) -> DataFrame:
    assets = _assets(spark, d)
    return manifest.unassigned(assets, manifest.match(_rules(spark, d), assets)).select("project_id", "kind", "asset_id")


@query(f"WITH {_MATCH} SELECT project_id, rule_id, string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY asset_id) AS assets FROM m GROUP BY project_id, rule_id")
def manifest_match_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = manifest.match_lists(manifest.match(_rules(spark, d), _assets(spark, d)))
    return lists.select("project_id", "rule_id", F.array_join(F.transform("matches", lambda m: m["asset_id"].cast("string")), ",").alias("assets"))


@query(f"""WITH {_MATCH}, names(rule_id, name, spare) AS (VALUES (1, 'Final Takes', 'Bass'), (2, 'Urgent Open', 'Other'), (3, 'High', 'Keys'), (5, 'Slow', 'Other'))
SELECT project_id, CAST(rule_id AS BIGINT) AS rule_id, asset_id, 'General/' || spare || '/' || name || '_' || row_number() OVER (PARTITION BY project_id, rule_id ORDER BY asset_id) || '.wav' AS path FROM m JOIN names USING (rule_id)
UNION ALL SELECT project_id, 0, asset_id, 'Unassigned/take ' || asset_id % 1000 || '.wav' FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project_id = a.project_id AND m.asset_id = a.asset_id)""")
def kit_export_paths(spark: SparkSession, d: str) -> DataFrame:
    assets, rules = _assets(spark, d).withColumns({"ext": F.lit(".wav"), "file_path": F.concat(F.lit("/in/take "), F.col("asset_id") % 1000, F.lit(".wav"))}), _rules(spark, d)
    return exports.kit_paths(rules.select("project_id", "rule_id", "name", "category"), manifest.match(rules, assets), assets).drop("kind").withColumn("rule_id", F.coalesce("rule_id", F.lit(0).cast("bigint")))


@query("""SELECT r_name AS song, n_name AS section, part, lower(split_part(part, ' ', 1)) AS instrument, r_name || ' - ' || n_name || ' - ' || part AS name
FROM region, nation, (VALUES ('Bass Line'), ('Drums'), ('Lead Synth')) p(part)""")
def rule_grid(spark: SparkSession, d: str) -> DataFrame:
    parts = spark.createDataFrame([("Bass Line",), ("Drums",), ("Lead Synth",)], "part string")
    return manifest.rule_grid(table(spark, d, "region").withColumnRenamed("r_name", "song"), table(spark, d, "nation").withColumnRenamed("n_name", "section"), parts)


@query("""WITH r AS (SELECT p_partkey AS rule_id, p_name AS name, p_brand AS brand, p_size AS n FROM part), e AS (SELECT rule_id, name, brand, CAST(unnest(range(0, n)) AS INTEGER) AS i FROM r)
SELECT rule_id, i, replace(name, ' ', '_') || '_v' || (i + 1) AS label, CAST(i + 42 AS BIGINT) AS seed, 'C' AS key, CAST(120 AS DOUBLE) AS tempo, brand AS engine FROM e""")
def generation_jobs(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("name"), F.col("p_size").alias("target_count"), F.to_json(F.struct(F.col("p_brand").alias("instrument"))).alias("required_tags_json"))
    return manifest.generation_jobs(rules)


# --- catalogue ---------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderpriority AS project_type, o_orderdate AS created_at FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC")
def list_projects(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project_type"), F.col("o_orderdate").alias("created_at"))
    return catalogue.list_projects(projects, "1-URGENT")


@query("SELECT c_custkey AS id, c_nationkey AS project_id, c_name AS name FROM customer WHERE c_custkey = 7 AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def owned_recording(spark: SparkSession, d: str) -> DataFrame:
    recordings = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"))
    first = catalogue.by_id(recordings, 7).first()
    return catalogue.owned(recordings, 7, first["project_id"] if first else -1)


@query("""SELECT n_nationkey AS project_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS recordings,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS samples FROM nation""")
def catalogue_counts(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    recordings = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    return catalogue.counts(projects, recordings, table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Mapping items of parts (samples) by lineitem; suppliers 0 to 7 are the velocity groups, 0 being none; a line that comes twice is told apart by its supplier."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("sample_id"), "l_suppkey", (F.col("l_suppkey") % 8).alias("velocity_group_id"),
        (F.col("l_quantity").cast("int") % 5).alias("key_range_start"), (F.col("l_quantity").cast("int") % 7).alias("key_range_end"), (F.col("l_linenumber") % 4).alias("root_note"),
    )


_ZONES = """i AS (SELECT l_partkey AS sample_id, l_suppkey % 8 AS g, CAST(l_quantity AS INTEGER) % 5 AS a, CAST(l_quantity AS INTEGER) % 7 AS b, l_linenumber % 4 AS r,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey) AS n FROM lineitem),
z AS (SELECT sample_id, nullif(g, 0) AS velocity_group_id, coalesce(nullif(r, 0), 60) AS root_note, coalesce(nullif(a, 0), nullif(r, 0), 60) AS lo_key, coalesce(nullif(b, 0), nullif(r, 0), 60) AS hi_key FROM i JOIN part ON sample_id = p_partkey WHERE n = 1)"""


@query(f"WITH {_ZONES} SELECT sample_id, coalesce(velocity_group_id, 0) AS velocity_group_id, root_note, lo_key, hi_key FROM z")
def key_zones(spark: SparkSession, d: str) -> DataFrame:
    return _zones(spark, d).withColumn("velocity_group_id", F.coalesce("velocity_group_id", F.lit(0).cast("bigint")))


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.key_zones(table(spark, d, "part").select(F.col("p_partkey").alias("id")), _items(spark, d))


@query(f"""WITH {_ZONES}, g AS (SELECT unnest(range(1, 10)) AS id) SELECT CAST(id AS BIGINT) AS group_id, 'layer ' || id AS name, CAST(id * 10 AS INTEGER) AS low_vel, CAST(id * 10 + 9 AS INTEGER) AS high_vel, (SELECT count(*) FROM z WHERE velocity_group_id = id) AS samples FROM g
UNION ALL SELECT 0, 'Unassigned', 0, 127, count(*) FROM z WHERE velocity_group_id IS NULL HAVING count(*) > 0""")
def velocity_layout(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.range(1, 10).select("id", F.concat(F.lit("layer "), "id").alias("name"), (F.col("id") * 10).cast("int").alias("low_vel"), (F.col("id") * 10 + 9).cast("int").alias("high_vel"))
    return catalogue.velocity_layout(groups, _zones(spark, d)).withColumn("group_id", F.coalesce("group_id", F.lit(0).cast("bigint")))


# --- tags and text -----------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, event_id % 5 <> 0 AS has_k,
CASE WHEN event_id % 5 = 0 THEN '{"z":1}' WHEN event_id % 3 = 0 THEN '{"k":"over","z":1}' ELSE '{"k":' || json_extract_string(props, '$.k') || ',"z":1}' END AS merged FROM events""")
def json_tags(spark: SparkSession, d: str) -> DataFrame:
    bad = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("{oops"), F.lit("[1]")), (F.floor(F.col("event_id") / 5) % 4 + 1).cast("int"))
    props = F.when(F.col("event_id") % 5 == 0, bad).otherwise(F.col("props"))
    rows = table(spark, d, "events").select("event_id", props.alias("p"))
    right = F.when((F.col("event_id") % 3 == 0) & (F.col("event_id") % 5 != 0), '{"k":"over","z":1}').otherwise('{"z":1}')
    return rows.select("event_id", tags.get(F.col("p"), "k").alias("k"), tags.has_key(F.col("p"), "k").alias("has_k"), tags.merge(F.col("p"), right).alias("merged"))


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name || ' #' || p_size, '[^\p{L}\p{N} _-]', '_', 'g')) AS kit, regexp_replace(replace(p_type || ' (mix)', ' ', '_'), '[^\w.-]', '', 'g') AS midi,
lower(replace(p_name, ' ', '_')) AS preset, format('{}_slice_{:03d}', p_brand, p_size + 1) AS slice, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS label FROM part""")
def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.upper(F.substr("p_type", F.lit(1), F.lit(1))), F.lower(F.substr("p_type", F.lit(2))))
    return table(spark, d, "part").select(
        "p_partkey", text.sanitize(F.concat("p_name", F.lit(" #"), "p_size")).alias("kit"), text.sanitize_filename(F.concat("p_type", F.lit(" (mix)"))).alias("midi"),
        text.preset_filename(F.col("p_name")).alias("preset"), text.slice_name(F.col("p_brand"), F.col("p_size")).alias("slice"), one.alias("label"),
    )


@query(r"""WITH n AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'SamplePackWorkflow' WHEN 1 THEN 'VST3PluginStage' WHEN 2 THEN 'audioIngestion' WHEN 3 THEN 'HTMLToMIDIExport2Go' WHEN 4 THEN 'My_Class' WHEN 5 THEN 'a__b' ELSE 'Sub___BassTake_' END AS n FROM part)
SELECT p_partkey, CASE n WHEN 'SamplePackWorkflow' THEN 'sample_pack_workflow' WHEN 'VST3PluginStage' THEN 'vst3_plugin_stage' WHEN 'audioIngestion' THEN 'audio_ingestion' WHEN 'HTMLToMIDIExport2Go' THEN 'html_to_midi_export2_go' WHEN 'My_Class' THEN 'my_class' WHEN 'a__b' THEN 'a_b' ELSE 'sub_bass_take_' END AS snake FROM n""")
def camel_to_snake(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("SamplePackWorkflow", "VST3PluginStage", "audioIngestion", "HTMLToMIDIExport2Go", "My_Class", "a__b", "Sub___BassTake_")))
    return table(spark, d, "part").select("p_partkey", text.camel_to_snake(F.element_at(names, (F.col("p_size") % 7 + 1).cast("int"))).alias("snake"))


_FILES = ("SubBass_01.wav", "lead melody.wav", "soft_pad.wav", "Kick.wav", "perc_loop.wav", "vox.aiff", "noise.wav", "snare_hat.wav", "sub kick.wav")
_FILES_SQL = "[" + ", ".join(f"'{f}'" for f in _FILES) + "]"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, lower({_FILES_SQL}[1 + l_partkey % {len(_FILES)}]) AS n FROM lineitem),
r AS (SELECT *, CASE WHEN contains(n, 'bass') OR contains(n, 'sub') THEN 'bass' WHEN contains(n, 'lead') OR contains(n, 'melody') OR contains(n, 'synth') THEN 'lead' WHEN contains(n, 'chord') OR contains(n, 'pad') OR contains(n, 'piano') THEN 'chords'
 WHEN contains(n, 'kick') THEN 'kick' WHEN contains(n, 'drum') OR contains(n, 'perc') OR contains(n, 'loop') THEN 'drums' WHEN contains(n, 'vocal') OR contains(n, 'vox') THEN 'vocal' ELSE 'other' END AS role FROM f)
SELECT role, CASE role WHEN 'vocal' THEN 10 WHEN 'kick' THEN 9 WHEN 'bass' THEN 8 WHEN 'lead' THEN 7 WHEN 'drums' THEN 6 WHEN 'chords' THEN 5 ELSE 4 END AS priority,
 CASE WHEN contains(n, 'kick') THEN 'kick' WHEN contains(n, 'snare') THEN 'snare' WHEN contains(n, 'hat') THEN 'hihat' WHEN contains(n, 'tom') THEN 'tom' WHEN contains(n, 'perc') THEN 'perc' END AS category, count(*) AS files FROM r GROUP BY ALL""")
def stem_roles(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("l_partkey") % len(_FILES) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(name.alias("n")).select(text.infer_role(F.col("n")).alias("role"), text.drum_category(F.col("n")).alias("category"))
    return rows.groupBy("role", text.role_priority(F.col("role")).alias("priority"), "category").agg(F.count(F.lit(1)).alias("files"))


_KINDS = ("PCM_16", "PCM_24", "FLOAT", "DOUBLE", "Float 64 bit", "ULAW")


@query(f"""WITH s AS (SELECT c_custkey, c_acctbal, {"[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"}[1 + c_custkey % 6] AS s FROM customer)
SELECT c_custkey, CASE WHEN regexp_extract(s, '\\d+') <> '' THEN CAST(regexp_extract(s, '\\d+') AS INTEGER) WHEN contains(upper(s), 'FLOAT') THEN 32 ELSE 0 END AS depth,
 CASE CAST(c_custkey % 12 AS INTEGER) WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'D#' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'G#' WHEN 9 THEN 'A' WHEN 10 THEN 'A#' ELSE 'B' END AS note,
 CASE WHEN c_custkey % 2 = 0 THEN 'take_denoised' ELSE 'take' END AS stem, CASE WHEN c_custkey % 7 = 0 THEN 'N/A' ELSE CAST(c_custkey % 5 AS VARCHAR) || '.5 MB' END AS size FROM s""".replace("\\\\d", "\\d"))
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("c_custkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/in/take"), F.when(F.col("c_custkey") % 2 == 0, "_denoised_adjusted").otherwise("_adjusted_denoised"), F.lit(".wav"))
    size = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 5) * 1048576 + 524288)
    return table(spark, d, "customer").select("c_custkey", F.coalesce(text.bit_depth(kind), F.lit(0)).alias("depth"), text.note_name(F.col("c_custkey") + 60).alias("note"), text.strip_suffixes(text.stem(path)).alias("stem"), text.size_label(size).alias("size"))


# --- segmentation ------------------------------------------------------------------------------


def _onsets(spark: SparkSession, d: str) -> DataFrame:
    """Onsets in seconds from a fixed day, sped up so that neighbours are seconds apart."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_700_000_000_000_000) / F.lit(4_000_000_000.0)
    return table(spark, d, "events").select(F.col("user_id").alias("recording_id"), t.alias("t"))


_ON = "o AS (SELECT user_id AS recording_id, (epoch_us(ts) - 1700000000000000) / 4000000000.0 AS t FROM events)"


@query(f"""WITH {_ON} SELECT recording_id, CAST(row_number() OVER w - 1 AS INTEGER) AS segment, t AS start_time, greatest(least(coalesce(lead(t) OVER w, t + 10.0), t + 10.0), t + 0.05) AS end_time
FROM o WINDOW w AS (PARTITION BY recording_id ORDER BY t)""")
def one_shot_plan(spark: SparkSession, d: str) -> DataFrame:
    return segments.one_shots(_onsets(spark, d))


@query(f"""WITH {_ON}, b AS (SELECT recording_id, min(t) AS lo, max(t) AS hi FROM o GROUP BY recording_id), a AS (SELECT * FROM o UNION ALL SELECT recording_id, 0.0 FROM b WHERE lo > 0.1 UNION ALL SELECT recording_id, 2000.0 FROM b WHERE hi < 2000.0 - 0.1)
SELECT * FROM (SELECT recording_id, t AS start_time, lead(t) OVER (PARTITION BY recording_id ORDER BY t) AS end_time FROM a) WHERE end_time IS NOT NULL""")
def onset_bookends(spark: SparkSession, d: str) -> DataFrame:
    onsets = _onsets(spark, d)
    return segments.between_onsets(onsets, onsets.select("recording_id").distinct().withColumn("duration", F.lit(2000.0)))


@query(f"WITH {_ON} SELECT recording_id, 0.0::DOUBLE AS start_time, max(t) + 1.0 AS end_time, 'loop' AS type, CAST(0.5 AS DOUBLE) AS confidence FROM o GROUP BY recording_id")
def loop_fallback(spark: SparkSession, d: str) -> DataFrame:
    return segments.plan(_onsets(spark, d), "virtual_instrument")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity / 4 AS dur, l_extendedprice / 10 AS cen, l_discount / 2 AS flat, l_tax AS lev FROM lineitem),
c AS (SELECT *, CASE WHEN dur >= 5 THEN 'ambient' WHEN dur <= 2 THEN 'one_shot' WHEN dur BETWEEN 0.5 AND 32 THEN 'loop' ELSE 'unknown' END AS type FROM f)
SELECT l_orderkey, l_linenumber, type, CAST(CASE type WHEN 'ambient' THEN 0.85 WHEN 'one_shot' THEN 0.9 WHEN 'loop' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence,
CASE WHEN type = 'one_shot' THEN CASE WHEN cen < 1800 AND flat < 0.01 THEN 'kick' WHEN cen > 5000 THEN 'hihat' WHEN flat > 0.01 THEN 'snare' WHEN flat < 0.01 THEN 'tom' ELSE 'perc' END ELSE '' END AS drum,
concat_ws(',', CASE WHEN flat < 0.005 THEN 'tonal' WHEN flat > 0.05 THEN 'noisy' END, CASE WHEN lev > 0.1 THEN 'high_energy' WHEN lev < 0.01 THEN 'low_energy' END) AS tags FROM c""")
def segment_class(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("dur"), (F.col("l_extendedprice") / 10).alias("cen"), (F.col("l_discount") / 2).alias("flat"), F.col("l_tax").alias("lev"))
    f = f.withColumn("c", segments.duration_class(F.col("dur")))
    drum = F.when(F.col("c.type") == "one_shot", segments.drum_type(F.col("cen"), F.col("flat"))).otherwise("")
    return f.select("l_orderkey", "l_linenumber", "c.type", "c.confidence", drum.alias("drum"), F.array_join(segments.sound_tags(F.col("flat"), F.col("lev")), ",").alias("tags"))


@query(f"""WITH {_ON}, p AS (SELECT recording_id, row_number() OVER w - 1 AS idx, t AS a, lead(t) OVER w AS b FROM o WINDOW w AS (PARTITION BY recording_id ORDER BY t)),
s AS (SELECT recording_id, idx, a, b, greatest(0, least(8000 * 1500, CAST(trunc(a * 8000) AS BIGINT))) AS x, greatest(0, least(8000 * 1500, CAST(trunc(b * 8000) AS BIGINT))) AS y FROM p WHERE b IS NOT NULL)
SELECT recording_id, CAST(idx AS INTEGER) AS idx, format('rec{{}}_slice_{{:03d}}', recording_id, idx + 1) AS name, a AS start_time, b - a AS duration, CAST(x AS BIGINT) AS first_sample, CAST(y AS BIGINT) AS last_sample, (y - x) / 8000.0 AS audio_duration
FROM s WHERE x < y AND (y - x) / 8000.0 BETWEEN 0.1 AND 10.0""")
def slice_filter(spark: SparkSession, d: str) -> DataFrame:
    onsets = _onsets(spark, d)
    w = Window.partitionBy("recording_id").orderBy("t")
    points = onsets.select("recording_id", (F.row_number().over(w) - 1).alias("idx"), F.col("t").alias("start_time"), F.lead("t").over(w).alias("end_time"))
    recordings = onsets.select("recording_id").distinct().select("recording_id", F.concat(F.lit("rec"), "recording_id").alias("base"), F.lit(8000).alias("sample_rate"), F.lit(8000 * 1500).cast("bigint").alias("n_samples"))
    return segments.slices(points, recordings)


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'unchecked' ELSE 'passed' END AS qc_status FROM lineitem WHERE l_linenumber = 7 OR NOT l_quantity / 50 < 0.5""")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, "x.wav").alias("file_path"), (F.col("l_quantity") / 50).alias("score"))
    return segments.quality_control(rows).select("l_orderkey", "l_linenumber", "qc_status")


@query("""WITH f AS (SELECT CASE l_linenumber WHEN 1 THEN 'kick' WHEN 2 THEN 'snare' WHEN 3 THEN 'hihat' END AS c, CAST(l_partkey AS DOUBLE) AS cen, CAST(l_suppkey AS DOUBLE) AS flat, l_quantity AS dur FROM lineitem)
SELECT c AS category, count(*) AS n, min(cen) AS min_centroid, max(cen) AS max_centroid, round(avg(cen), 6) AS mean_centroid, min(flat) AS min_flatness, max(flat) AS max_flatness, round(avg(flat), 6) AS mean_flatness, min(dur) AS min_duration, max(dur) AS max_duration, round(avg(dur), 6) AS mean_duration
FROM f WHERE c IS NOT NULL GROUP BY c""")
def drum_thresholds(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("l_linenumber") == 1, "kick").when(F.col("l_linenumber") == 2, "snare").when(F.col("l_linenumber") == 3, "hihat")
    stats = segments.drum_thresholds(table(spark, d, "lineitem").select(name.alias("category"), F.col("l_partkey").cast("double").alias("centroid"), F.col("l_suppkey").cast("double").alias("flatness"), F.col("l_quantity").alias("duration")))
    return stats.withColumns({f"mean_{c}": F.round(f"mean_{c}", 6) for c in ("centroid", "flatness", "duration")})


# --- signals -----------------------------------------------------------------------------------

_BUF = "b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings)"
_ABS = "list_transform(y, lambda v: abs(v))"
_SNR = """fr AS (SELECT vec_id, list_sort(list_transform(range(4), lambda k: sqrt(list_sum(list_transform(y[k * 16 + 1 : k * 16 + 16], lambda v: v * v)) / 16))) AS l FROM b),
sn AS (SELECT vec_id, l[1] AS noise, (l[3] + l[4]) / 2 AS sig FROM fr)"""


def _buffers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("y"))


@query(f"""WITH {_BUF}, {_SNR}, q AS (SELECT vec_id, list_max({_ABS}) AS peak, sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y)) AS rms, list_sum(y) / len(y) AS dc, quantile_5 AS low, clips, zc FROM b
 JOIN (SELECT vec_id, quantile_cont(abs(u), 0.05) AS quantile_5, count(*) FILTER (abs(u) >= 0.3) AS clips FROM (SELECT vec_id, unnest(y) AS u FROM b) GROUP BY vec_id) USING (vec_id)
 JOIN (SELECT vec_id, len(list_filter(range(2, len(y) + 1), lambda i: sign(y[i]) <> sign(y[i - 1]))) AS zc FROM b) USING (vec_id)),
s AS (SELECT vec_id, 20 * log10(peak) AS pk, 20 * log10(rms) AS rm, CASE WHEN low > 0 THEN 20 * log10(low) ELSE -120 END AS nf, clips, dc, zc, CASE WHEN noise <= 0 THEN CASE WHEN sig > 0 THEN 96 ELSE 0 END WHEN sig <= noise THEN 0 ELSE 20 * log10(sig / noise) END AS snr FROM q JOIN sn USING (vec_id))
SELECT vec_id, round(pk, 4) AS peak_db, round(rm, 4) AS rms_db, round(nf, 4) AS noise_floor_db, CAST(clips AS INTEGER) AS clip_count, round(dc, 6) AS dc_offset, round(pk - nf, 4) AS dynamic_range_db, round(snr, 4) AS snr_db, zc / 64.0 AS zero_crossing_rate,
 (CASE WHEN rm < -60 THEN 0 ELSE 30 END + CASE WHEN clips = 0 THEN 25 WHEN clips / 64.0 < 0.001 THEN 15 WHEN clips / 64.0 < 0.01 THEN 5 ELSE 0 END + CASE WHEN abs(dc) <= 0.01 THEN 10 WHEN abs(dc) < 0.05 THEN 5 ELSE 0 END
 + CASE WHEN pk - nf >= 6 THEN 20 WHEN pk - nf >= 3 THEN 10 ELSE 0 END + CASE WHEN snr >= 10 THEN 15 WHEN snr >= 5 THEN 7 ELSE 0 END) / 100.0 AS score FROM s""")
def signal_quality(spark: SparkSession, d: str) -> DataFrame:
    r = _buffers(spark, d).select("vec_id", signal.quality_report(F.col("y"), least=64, clip_level=0.3).alias("r"))
    near = lambda c, n=4: F.round(f"r.{c}", n).alias(c)
    return r.select("vec_id", near("peak_db"), near("rms_db"), near("noise_floor_db"), "r.clip_count", near("dc_offset", 6), near("dynamic_range_db"), near("snr_db"), "r.zero_crossing_rate", "r.score")


@query(f"""WITH {_BUF}, p AS (SELECT vec_id, y, list_max({_ABS}) AS top, sqrt(list_sum(list_transform(y[1:5], lambda v: v * v)) / 5) AS head FROM b),
t AS (SELECT *, pow(10, greatest(-60.0, 20 * log10(head) + 6) / 20) AS thr FROM p)
SELECT vec_id, round(list_sum(list_transform(y, lambda v: CASE WHEN abs(v) < thr THEN 0.0 ELSE abs(v) END)), 5) AS gated, round(list_sum(list_transform(y, lambda v: abs(v / top * pow(10, -0.7)))), 5) AS normalized FROM t""")
def gate_and_normalize(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v)), 5)
    return _buffers(spark, d).select("vec_id", total(signal.noise_gate(y, signal.gate_threshold(y, 100))).alias("gated"), total(signal.normalize(y)).alias("normalized"))


@query(f"""WITH {_BUF}, g AS (SELECT vec_id, list_transform(range(64), lambda i: y[i + 1] * CASE WHEN i < 10 THEN i / 9.0 ELSE 1 END * CASE WHEN 63 - i < 20 THEN (63 - i) / 19.0 ELSE 1 END) AS f FROM b)
SELECT vec_id, round(list_sum(list_transform(f, lambda v: abs(v))), 5) AS faded, f[1] = 0 AND f[64] = 0 AS silent_ends FROM g""")
def slice_fades(spark: SparkSession, d: str) -> DataFrame:
    rows = _buffers(spark, d).select("vec_id", signal.fades(F.col("y"), 10, 20).alias("f"))
    return rows.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("faded"), ((F.get("f", F.lit(0)) == 0) & (F.get("f", F.lit(63)) == 0)).alias("silent_ends"))


@query(f"""WITH {_BUF}, e AS (SELECT vec_id, list_transform(range(3, 65), lambda i: abs(y[i] - 2 * y[i - 1] + y[i - 2])) AS d FROM b), m AS (SELECT vec_id, d, list_max(d) AS top, list_position(d, list_max(d)) - 1 AS p FROM e),
w AS (SELECT vec_id, top, d[greatest(0, p - 20) + 1 : least(62, p + 20)] AS n FROM m) SELECT vec_id, top > 0.1 AND top > 2.5 * list_sum(n) / len(n) AS click FROM w""")
def click_detect(spark: SparkSession, d: str) -> DataFrame:
    return _buffers(spark, d).select("vec_id", signal.has_click(F.col("y"), ratio=2.5).alias("click"))


@query(f"""WITH {_BUF}, l AS (SELECT vec_id, y, list_transform(range(16), lambda k: sqrt(list_sum(list_transform(y[k * 4 + 1 : k * 4 + 4], lambda v: v * v)) / 4)) AS l FROM b), m AS (SELECT *, list_sum(l) / 16 AS m FROM l)
SELECT vec_id, round(greatest(0, least(1, 1 - sqrt(list_sum(list_transform(l, lambda v: (v - m) * (v - m))) / 16) / m)), 6) AS rms_consistency,
 round(greatest(0, least(1, list_sum(list_transform(range(1, 33), lambda i: y[i] * y[i + 32])) / sqrt(list_sum(list_transform(y[1:32], lambda v: v * v)) * list_sum(list_transform(y[33:64], lambda v: v * v))))), 6) AS continuity FROM m""")
def loop_texture(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    halves = arithmetic.cosine(F.slice(y, 1, 32), F.slice(y, 33, 32))
    return _buffers(spark, d).select("vec_id", F.round(signal.rms_consistency(y), 6).alias("rms_consistency"), F.round(halves, 6).alias("continuity"))


# --- loops, stabs, events ----------------------------------------------------------------------


def _beats(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("t", "event_id")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_700_000_000_000_000) / F.lit(20_000_000_000.0)
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("recording_id"), t.alias("t"))
    return rows.select("recording_id", (F.row_number().over(w) - 1).alias("i"), "t", F.lit(120.0).alias("bpm"))


_BEATS = "e AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) - 1700000000000000) / 20000000000.0, event_id) - 1 AS i, (epoch_us(ts) - 1700000000000000) / 20000000000.0 AS t FROM events)"
_PAIRS = f"""{_BEATS}, pr AS (SELECT x.recording_id, bars, x.i, z.i AS j, x.t AS start_time, z.t AS end_time FROM e x JOIN e z ON x.recording_id = z.recording_id AND z.i > x.i JOIN (VALUES (1), (2), (4), (8), (16)) b(bars) ON abs(z.t - x.t - bars * 2.0) <= 0.3),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY bars, i, j) AS n FROM pr) WHERE n <= 200)"""


@query(f"WITH {_PAIRS} SELECT recording_id, bars, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, start_time, end_time FROM cap")
def loop_candidates(spark: SparkSession, d: str) -> DataFrame:
    return loops.bar_pairs(_beats(spark, d))


@query(f"""WITH RECURSIVE {_PAIRS}, sc AS (SELECT recording_id, n, start_time, end_time, (bars * 37 + i * 11 + j * 7) % 100 / 100.0 AS score FROM cap),
c AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, n) AS k, start_time AS s, end_time AS t, score FROM sc WHERE score >= 0.3),
g AS (SELECT recording_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS ss, CAST([] AS DOUBLE[]) AS tt, CAST([] AS DOUBLE[]) AS vv FROM (SELECT DISTINCT recording_id FROM c)
 UNION ALL SELECT g.recording_id, c.k, CASE WHEN ok THEN list_append(ss, s) ELSE ss END, CASE WHEN ok THEN list_append(tt, t) ELSE tt END, CASE WHEN ok THEN list_append(vv, CAST(score AS DOUBLE)) ELSE vv END
 FROM g JOIN c ON c.recording_id = g.recording_id AND c.k = g.k + 1, LATERAL (SELECT len(ss) < 5 AND len(list_filter(range(1, len(ss) + 1), lambda q: greatest(0, least(t, tt[q]) - greatest(s, ss[q])) / least(t - s, tt[q] - ss[q]) > 0.5)) = 0 AS ok)),
f AS (SELECT recording_id, ss, tt, vv, row_number() OVER (PARTITION BY recording_id ORDER BY k DESC) AS z FROM g)
SELECT recording_id, CAST(r AS INTEGER) AS rank, ss[r] AS start_time, tt[r] AS end_time, vv[r] AS score FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS r FROM f WHERE z = 1)""")
def loop_topn(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("bars", "i", "j"))
    score = (F.col("bars") * 37 + F.col("i") * 11 + F.col("j") * 7) % 100 / F.lit(100.0)
    scored = loops.bar_pairs(_beats(spark, d)).select("recording_id", n.alias("idx"), "start_time", "end_time", score.alias("score"))
    return loops.select_best(scored).drop("idx")


@query("""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 1 - least(abs(q - 1), abs(q - 2), abs(q - 4), abs(q - 8), abs(q - 16)) / greatest(q, 1))), 6) AS duration_quantization,
CASE WHEN bpm < 40 THEN bpm * 2 WHEN bpm > 200 THEN bpm / 2 ELSE bpm END AS tempo, CAST(round_even(l_partkey / 12.0, 0) * 12 AS BIGINT) AS snapped FROM (SELECT *, l_quantity / 2 AS q, CAST(l_partkey % 300 + 1 AS DOUBLE) AS bpm FROM lineitem)""")
def loop_lengths(spark: SparkSession, d: str) -> DataFrame:
    bars, bpm = F.col("l_quantity") / 2, (F.col("l_partkey") % 300 + 1).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(arithmetic.bar_fit(bars, bpm), 6).alias("duration_quantization"), arithmetic.fix_tempo(bpm).alias("tempo"), arithmetic.snap(F.col("l_partkey"), F.lit(12)).alias("snapped"))


@query(f"""WITH {_BEATS}, g AS (SELECT recording_id, t - lag(t) OVER (PARTITION BY recording_id ORDER BY i) AS gap FROM e)
SELECT recording_id, round(CASE WHEN count(gap) = 0 OR avg(gap) < 1e-10 THEN 0.3 ELSE greatest(0, least(1, 1 - stddev_pop(gap) / avg(gap))) END, 6) AS onset_regularity FROM g GROUP BY recording_id""")
def onset_regularity(spark: SparkSession, d: str) -> DataFrame:
    beats = _beats(spark, d)
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("recording_id").orderBy("i"))
    return loops.onset_regularity(beats.withColumn("gap", gap), "recording_id").withColumn("onset_regularity", F.round("onset_regularity", 6))


_STABS = "s AS (SELECT user_id AS file_id, event_id, epoch_us(ts) / 100000000.0 AS a, epoch_us(ts) / 100000000.0 + value AS b FROM events)"


@query(f"""WITH {_STABS}, g AS (SELECT file_id, lead(a) OVER (PARTITION BY file_id ORDER BY a, b) - b AS gap FROM s)
SELECT file_id, count(*) AS stabs, round(CASE WHEN count(*) > 1 THEN coalesce(avg(CASE WHEN gap > 0 THEN gap END), 0) END, 3) AS average_silence_ms, count(*) FILTER (gap < 75) AS short_gaps, count(*) IN (2, 4, 8, 16, 32, 64) AS ideal FROM g GROUP BY file_id""")
def stab_silence(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(100_000_000.0)
    rows = table(spark, d, "events").select(F.col("user_id").alias("file_id"), at.alias("start_ms"), (at + F.col("value")).alias("end_ms"))
    out = vocal.silence(vocal.gaps(rows))
    return out.select("file_id", "stabs", F.round("average_silence_ms", 3).alias("average_silence_ms"), "short_gaps", vocal.count_is_ideal(F.col("stabs")).alias("ideal"))


@query("""WITH o AS (SELECT *, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) * 100 + 3307) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 100 AS n, out_start, out_start + CAST(l_quantity AS BIGINT) * 100 AS out_end FROM o""")
def stab_layout(spark: SparkSession, d: str) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", *order, (F.col("l_quantity").cast("bigint") * 100).alias("n"))
    return vocal.layout(rows, "l_orderkey", order, "n", 3307).drop(*order[1:])


@query("""SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_quantity < 5 THEN 'zero length' END, CASE WHEN l_returnflag = 'R' THEN 'no zero crossing at start' END, CASE WHEN l_returnflag = 'A' THEN 'no zero crossing at end' END, CASE WHEN l_linestatus = 'F' THEN 'clicks or pops' END) AS issues FROM lineitem""")
def stab_issues(spark: SparkSession, d: str) -> DataFrame:
    issues = vocal.stab_issues(F.lit(5.0), F.when(F.col("l_quantity") < 5, 5.0).otherwise(6.0), F.col("l_returnflag") != "R", F.col("l_returnflag") != "A", F.col("l_linestatus") == "F")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(issues, "; ").alias("issues"))


_EV = """ev AS (SELECT l_orderkey, CASE WHEN l_linenumber = 5 THEN 'control' ELSE 'note' END AS kind, l_partkey % 4000 AS s, CAST(l_quantity AS BIGINT) * 20 AS dur FROM lineitem),
q AS (SELECT *, CAST(round_even(s / 120.0, 0) * 120 AS BIGINT) AS qs FROM ev), r AS (SELECT *, kind = 'note' AND qs + dur > 3840 AS clipped, CASE WHEN kind = 'note' AND qs + dur > 3840 THEN 3840 - qs ELSE dur END AS qd FROM q),
x AS (SELECT *, CASE WHEN kind = 'note' THEN qd <= 0 ELSE s >= 3840 END AS dropped FROM r)"""


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 5, "control").otherwise("note").alias("kind"), (F.col("l_partkey") % 4000).alias("start"), (F.col("l_quantity").cast("bigint") * 20).alias("dur"), F.lit(3840).cast("bigint").alias("loop_len"))


@query(f"WITH {_EV} SELECT l_orderkey, count(*) FILTER (NOT dropped) AS kept, count(*) FILTER (clipped) AS clipped, count(*) FILTER (dropped) AS dropped FROM x GROUP BY l_orderkey")
def grid_quantize(spark: SparkSession, d: str) -> DataFrame:
    return symbolic.quantize_counts(symbolic.quantize(_notes(spark, d), 120), "l_orderkey")


@query(f"""WITH {_EV} SELECT l_orderkey, round(greatest(0, least(1, 0.4 * count(*) FILTER (s + dur <= 3840) / count(*) + 0.3 * max(CASE WHEN s * 16 <= 3840 THEN 1 ELSE 0 END) + 0.3 * least(1, count(*) FILTER (s + dur > 2880 AND s < 3840) / greatest(1, floor(count(*) / 4))))), 6) AS fitness
FROM ev WHERE kind = 'note' GROUP BY l_orderkey
UNION ALL SELECT DISTINCT l_orderkey, 0.0 FROM ev WHERE l_orderkey NOT IN (SELECT l_orderkey FROM ev WHERE kind = 'note')""")
def loop_fitness(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d).where("kind = 'note'").withColumn("whole", F.lit(3840))
    return symbolic.fitness(notes, "l_orderkey", table(spark, d, "lineitem").select("l_orderkey")).withColumn("fitness", F.round("fitness", 6))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
a AS (SELECT l_orderkey, l_linenumber AS attempt, l_quantity / 50 AS fitness, coalesce(max(l_quantity / 50) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 0.7, false) AS done FROM l)
SELECT l_orderkey, attempt, fitness FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY fitness DESC, attempt) AS n FROM a WHERE NOT done) WHERE n = 1""")
def best_attempt(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey", F.col("l_linenumber").alias("attempt")).agg((F.max("l_quantity") / 50).alias("fitness"))
    return symbolic.best_attempt(rows, "l_orderkey")


# --- spectra, capture --------------------------------------------------------------------------

_STEMS = """st AS (SELECT vec_id // 6 AS section, vec_id AS stem, CAST(4 + vec_id * 7 % 7 AS INTEGER) AS pr, list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v)) AS y FROM embeddings), nz AS (SELECT section, stem, pr, list_transform(y, lambda v: v / (list_max(y) + 1e-6)) AS y FROM st),
pp AS (SELECT a.section, a.stem, b.stem AS other, list_transform(range(1, 65), lambda i: CASE WHEN b.y[i] > 0.3 AND a.y[i] > 0.2 THEN b.y[i] ELSE 0.0 END) AS c FROM nz a JOIN nz b ON a.section = b.section AND b.pr > a.pr),
mp AS (SELECT section, stem, other, CAST(list_position(c, list_max(c)) - 1 AS INTEGER) AS bin, list_max(c) AS strength FROM pp WHERE list_max(c) > 0)"""


def _stems(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 6).cast("bigint").alias("section"), F.col("vec_id").alias("stem"), (F.col("vec_id") * 7 % 7 + 4).cast("int").alias("fixed"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("spectrum"), F.when(F.col("vec_id") % 3 == 0, "bass").otherwise("lead").alias("role"))


@query(f"WITH {_STEMS.replace('vec_id * 7 % 7', 'vec_id * 5 % 7')} SELECT section, stem, other, bin, round(strength, 6) AS strength FROM mp")
def masking_pairs(spark: SparkSession, d: str) -> DataFrame:
    stems = _stems(spark, d).withColumn("priority", (F.col("stem") * 5 % 7 + 4).cast("int"))
    return spectral.masking_pairs(stems).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {_STEMS.replace('vec_id * 7 % 7', 'vec_id * 5 % 7')} SELECT section, stem, 'highpass' AS filter, CAST(100 AS DOUBLE) AS hz, CAST(0 AS DOUBLE) AS gain_db FROM st WHERE stem % 3 <> 0
UNION ALL SELECT section, stem, 'peak', bin * 100.0, -3.0 FROM mp WHERE bin * 100.0 BETWEEN 20 AND 20000 AND NOT (stem % 3 = 0 AND bin * 100.0 < 150)""")
def eq_plan(spark: SparkSession, d: str) -> DataFrame:
    stems = _stems(spark, d).withColumn("priority", (F.col("stem") * 5 % 7 + 4).cast("int"))
    return spectral.eq_plan(stems, spectral.masking_pairs(stems), 100.0)


@query("""SELECT user_id AS device_id, event_type AS channel, count(*) AS messages, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id)) AS track FROM events GROUP BY user_id, event_type""")
def session_capture(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.capture import tracks

    rows = table(spark, d, "events").select(F.col("user_id").alias("device_id"), F.col("event_type").alias("channel"), F.struct("ts", "event_id").alias("seq"), F.col("event_id").cast("string").alias("message"))
    out = tracks(rows)
    return out.select("device_id", "channel", F.size("messages").cast("bigint").alias("messages"), F.sha2(F.array_join("messages", ",").cast("binary"), 256).alias("track"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS messages FROM n GROUP BY user_id, k""")
def capture_sessions(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.capture import sessions

    return sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query(f"""WITH {_BUF}, q AS (SELECT vec_id, quantile_cont(abs(u), 0.05) AS low FROM (SELECT vec_id, unnest(y) AS u FROM b) GROUP BY vec_id)
SELECT vec_id, round(20 * log10(sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(y))), 4) AS loudness, CASE WHEN low > 0 THEN round(20 * log10(list_max({_ABS}) / low), 4) ELSE 0 END AS dynamic_range FROM b JOIN q USING (vec_id)""")
def loudness_range(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    return _buffers(spark, d).select("vec_id", F.round(signal.loudness(y), 4).alias("loudness"), F.round(signal.dynamic_range(y), 4).alias("dynamic_range"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'processed' ELSE 'pending' END AS status,
 '{"prio":"' || o_orderpriority || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"quality":1' ELSE '' END || ',"status":"' || CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE o_orderstatus END || '"}' AS metadata_json FROM orders""")
def metadata_update(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    meta = F.concat(F.lit('{"prio":"'), "o_orderpriority", F.lit('","status":"'), "o_orderstatus", F.lit('"}'))
    rows = orders.select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"), meta.alias("metadata_json"))
    patch = F.when(F.col("o_orderkey") % 3 == 0, '{"status":"done","quality":1}')
    patches = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "processed").alias("status"), patch.alias("metadata_json"))
    return catalogue.update(rows, patches)


@query("""WITH p AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'virtual_instrument' WHEN 1 THEN 'sample_pack' ELSE 'construction_kit' END AS kind FROM nation),
f AS (SELECT * FROM (VALUES ('samples', true), ('samples/raw', false), ('samples/processed', false), ('samples/mapped', false), ('presets', false), ('exports', true), ('midi', true), ('metadata', false)) v(folder, everywhere))
SELECT id AS project_id, '/audio/project_' || id || '/' || folder AS path FROM p JOIN f ON everywhere OR kind = 'virtual_instrument'""")
def project_folders(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "virtual_instrument").when(key % 3 == 1, "sample_pack").otherwise("construction_kit")
    return exports.project_folders(table(spark, d, "nation").select(key.alias("id"), kind.alias("project_type")), "/audio")


@query("""WITH g AS (SELECT p_partkey AS id, p_size % 7 + 1 AS bars, 60 + p_size AS tempo FROM part), e AS (SELECT * FROM g, (VALUES ('recording'), ('sample')) k(kind))
SELECT kind, 'loop_' || id AS label, CASE WHEN kind = 'sample' THEN round(bars * 4 * 60.0 / tempo + 2, 6) END AS duration,
 CASE WHEN kind = 'sample' THEN '{"bars":' || bars || ',"key":"D","tempo":' || tempo || '}' ELSE '{"bars":' || bars || ',"engine":"bass","key":"D","meter":"4/4","midi_file_id":' || id || ',"source":"generated_loop","tempo":' || tempo || '}' END AS metadata_json FROM e""")
def loop_entries(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    rows = part.select(
        F.concat(F.lit("loop_"), "p_partkey").alias("label"), (F.col("p_size") + 60).alias("tempo"), F.lit("C").alias("key"), F.lit("4/4").alias("meter"), (F.col("p_size") % 7 + 1).alias("bars"),
        F.lit("bass").alias("engine"), F.col("p_partkey").alias("midi_file_id"), F.lit(2.0).alias("tail"), F.lit('{"key":"D"}').alias("tags_json"),
    )
    return catalogue.loop_entries(rows).withColumn("duration", F.round("duration", 6))


@query("""SELECT p_partkey AS job_id, p_brand AS engine, s_name AS port FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1""")
def render_jobs(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier")
    last = suppliers.agg(F.max("s_suppkey").alias("last"))
    jobs = table(spark, d, "part").crossJoin(F.broadcast(last)).select(F.col("p_partkey").alias("job_id"), F.col("p_partkey").alias("generation_id"), (F.col("p_partkey") % F.col("last") + 1).alias("rendering_id"))
    generation = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("engine_id"))
    rendering = suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("midi_port"))
    return catalogue.render_jobs(jobs, generation, rendering).select("job_id", F.col("generation.engine_id").alias("engine"), F.col("rendering.midi_port").alias("port"))
