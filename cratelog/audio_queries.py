"""Chunks, files, written tables and streams over the synthetic tables, each beside its SQL.

Sixteen or four embeddings in a row are a recording; what is written goes to the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dsp
from .operators import audio, catalogue, chunks, exports, loops, manifest, ordered
from .plans import chain
from .queries import query
from .session import shared_folder, table
from .sources import riff, tables, wav
from .streaming import session


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pieces(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Recordings of n embeddings each, in chunks of 64 frames; only whole ones."""
    rows = table(spark, d, "embeddings").select(F.expr(f"vec_id DIV {n}").alias("rec"), ((F.col("vec_id") % n) * 64).alias("first_frame"), F.lit(8000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))
    return rows.join(rows.groupBy("rec").count().where(f"count = {n}").select("rec"), "rec", "left_semi")


def _recordings(n: int) -> str:
    """SQL: rec, i (from 0) and y of the same."""
    return f"w AS (SELECT vec_id // {n} AS rec FROM embeddings GROUP BY 1 HAVING count(*) = {n}), x AS (SELECT vec_id // {n} AS rec, (vec_id % {n}) * 64 + unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS y FROM embeddings WHERE vec_id // {n} IN (SELECT rec FROM w))"


# --- kernels over chunks -------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_recordings(4)},
c AS (SELECT tan(pi() * 100 / 8000) AS t, sin(2 * pi() * 1000 / 8000) / 2 AS al, cos(2 * pi() * 1000 / 8000) AS co, pow(10, -3.0 / 40) AS g),
k AS (SELECT 1 / (1 + t) AS h0, (t - 1) / (t + 1) AS h1, (1 + al * g) / (1 + al / g) AS b0, -2 * co / (1 + al / g) AS b1, (1 - al * g) / (1 + al / g) AS b2, (1 - al / g) / (1 + al / g) AS a2 FROM c),
f(rec, i, y, h, h2, p, p2) AS (SELECT rec, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM w UNION ALL
  SELECT f.rec, x.i, x.y, h0 * (x.y - f.y) - h1 * f.h, f.h, b0 * (h0 * (x.y - f.y) - h1 * f.h) + b1 * f.h + b2 * f.h2 - b1 * f.p - a2 * f.p2, f.p FROM f JOIN x ON x.rec = f.rec AND x.i = f.i + 1 CROSS JOIN k)
SELECT rec, round(sum(abs(p)), 4) AS total, round(max(p) FILTER (i = 255), 5) AS last FROM f WHERE i >= 0 GROUP BY rec""")
def equalized_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A high-pass and a dip over chunks of 64 frames, against the recursion sample by sample."""
    rows = _pieces(spark, d, 4)
    steps = spark.createDataFrame([("highpass", 100.0, 0.0), ("peak", 1000.0, -3.0)], "filter string, hz double, gain_db double")
    out = chunks.equalized(rows, rows.select("rec").distinct().crossJoin(F.broadcast(steps)), "rec").select("rec", "first_frame", F.posexplode("samples").alias("i", "p"))
    return out.groupBy("rec").agg(F.round(F.sum(F.abs(F.col("p").cast("double"))), 4).alias("total"), F.round(F.max(F.when(F.col("first_frame") + F.col("i") == 255, F.col("p").cast("double"))), 5).alias("last"))


@query(f"""WITH {_recordings(4)}, t AS (SELECT unnest(range(17)) AS t), k AS (SELECT unnest(range(33)) AS k),
m AS (SELECT rec, t, k, sqrt(pow(sum(y * (0.5 - 0.5 * cos(2 * pi() * (i - t * 16 + 32) / 64)) * cos(2 * pi() * k * (i - t * 16 + 32) / 64)), 2) + pow(sum(y * (0.5 - 0.5 * cos(2 * pi() * (i - t * 16 + 32) / 64)) * sin(2 * pi() * k * (i - t * 16 + 32) / 64)), 2)) AS m
      FROM x JOIN t ON i >= t * 16 - 32 AND i < t * 16 + 32 CROSS JOIN k GROUP BY rec, t, k),
s AS (SELECT rec, t, sum(k * 8000 / 64 * m) / sum(m) AS c, exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)) AS f, sum(m) AS loud FROM m GROUP BY rec, t)
SELECT rec, round(avg(c), 3) AS centroid, round(avg(f), 6) AS flatness, round(avg(loud), 4) AS loud, CAST(256 AS BIGINT) AS n_frames FROM s GROUP BY rec""")
def chunk_spectra(spark: SparkSession, d: str) -> DataFrame:
    """Spectra of 17 centred windows over tiles of 64 frames, each with half a window of its neighbours."""
    made = chunks.spectral_features(_pieces(spark, d, 4), "rec", size=64, n_fft=64, hop=16)
    return made.select("rec", F.round("centroid", 3).alias("centroid"), F.round("flatness", 6).alias("flatness"), F.round(F.aggregate("spectrum", F.lit(0.0), lambda s, v: s + v), 4).alias("loud"), "n_frames")


_MEL = "(2595 * log10(1 + {} / 700.0))"
_EDGE = "(700 * (pow(10, ({}) * " + _MEL.format(4000) + " / 41 / 2595) - 1))"


@query(f"""WITH {_recordings(16)}, t AS (SELECT unnest([0, 512, 1024]) AS t), k AS (SELECT unnest(range(1025)) AS k),
h AS (SELECT rec, t, i - t + 1024 AS n, y * (0.5 - 0.5 * cos(2 * pi() * (i - t + 1024) / 2048)) AS y FROM x JOIN t ON i >= t - 1024 AND i < t + 1024),
s AS (SELECT rec, t, k, pow(sum(y * cos(2 * pi() * ((k * n) % 2048) / 2048)), 2) + pow(sum(y * sin(2 * pi() * ((k * n) % 2048) / 2048)), 2) AS p FROM h CROSS JOIN k GROUP BY rec, t, k),
b AS (SELECT unnest(range(40)) AS b), e AS (SELECT b, {_EDGE.format("b")} AS lo, {_EDGE.format("b + 1")} AS mid, {_EDGE.format("b + 2")} AS hi FROM b),
m AS (SELECT rec, b, t, sum(p * greatest(0, least((k * 8000 / 2048.0 - lo) / (mid - lo), (hi - k * 8000 / 2048.0) / (hi - mid)))) AS m FROM s CROSS JOIN e GROUP BY rec, b, t),
dm AS (SELECT rec, m, abs(m - lag(m) OVER (PARTITION BY rec, b ORDER BY t)) AS d FROM m)
SELECT rec, round(greatest(0, least(1, 1 - avg(d) / (avg(m) + 1e-10))), 6) AS stability FROM dm GROUP BY rec""")
def spectral_stability(spark: SparkSession, d: str) -> DataFrame:
    """How little the mel spectrum of the first recordings changes over three windows."""
    rows = _pieces(spark, d, 16)
    whole = chunks.tiles(rows, "rec", size=1024).where("tile = 0")
    return chunks.mapped(whole, {"stability": "double"}, lambda y, rate: (dsp.spectral_change(y, rate),), "samples", "sample_rate").select("rec", F.round("stability", 6).alias("stability"))


@query(f"""WITH {_recordings(16)}, t AS (SELECT unnest(range(5)) AS t, unnest([0, 128, 256, 384, 512]) AS c), k AS (SELECT unnest(range(257)) AS k), part AS (SELECT rec, i // 512 AS part, i % 512 AS i, y FROM x),
h AS (SELECT rec, part, t, i - c + 256 AS n, y * (0.5 - 0.5 * cos(2 * pi() * (i - c + 256) / 512)) AS y FROM part JOIN t ON i >= c - 256 AND i < c + 256),
s AS (SELECT rec, part, t, k, pow(sum(y * cos(2 * pi() * ((k * n) % 512) / 512)), 2) + pow(sum(y * sin(2 * pi() * ((k * n) % 512) / 512)), 2) AS p FROM h CROSS JOIN k GROUP BY rec, part, t, k),
b AS (SELECT unnest(range(40)) AS b), e AS (SELECT b, {_EDGE.format("b")} AS lo, {_EDGE.format("b + 1")} AS mid, {_EDGE.format("b + 2")} AS hi FROM b),
m AS (SELECT rec, part, t, b, ln(sum(p * greatest(0, least((k * 8000 / 512.0 - lo) / (mid - lo), (hi - k * 8000 / 512.0) / (hi - mid)))) + 1e-10) AS m FROM s CROSS JOIN e GROUP BY rec, part, t, b),
q AS (SELECT unnest(range(13)) AS q), f AS (SELECT rec, part, q, sum(m * cos(pi() / 40 * (b + 0.5) * q)) / 5 AS v FROM m CROSS JOIN q GROUP BY rec, part, q),
v AS (SELECT a.rec, sum(a.v * z.v) / sqrt(sum(a.v * a.v) * sum(z.v * z.v)) AS c FROM f a JOIN f z ON a.rec = z.rec AND a.q = z.q AND a.part = 0 AND z.part = 1 GROUP BY a.rec)
SELECT rec, round(greatest(0, least(1, c)), 6) AS likeness FROM v""")
def mfcc_likeness(spark: SparkSession, d: str) -> DataFrame:
    """How alike the two halves of a recording are, by the cosine of their mean cepstra."""
    whole = chunks.tiles(_pieces(spark, d, 16), "rec", size=1024).where("tile = 0")
    return chunks.mapped(whole, {"likeness": "double"}, lambda y, rate: (dsp.loop_features(y, rate, 0, len(y))[0],), "samples", "sample_rate").select("rec", F.round("likeness", 6).alias("likeness"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Five hits a nation at 8 kHz, half a second apart, the first n / 100 + 0.2 seconds in; in one chunk of 3 seconds."""
    n = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(n.cast("bigint").alias("recording_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk"), n)
    one = lambda x: F.when((x >= 0) & (x < 5 * 4000), F.sin((x % 4000) * 0.5) * F.exp((x % 4000) / -200.0)).otherwise(0.0)
    samples = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda k: one(F.col("chunk") * 8000 + k - (F.col("n_nationkey") * 80 + 1600)))
    return rows.select("recording_id", (F.col("chunk") * 8000).cast("bigint").alias("first_frame"), F.lit(8000).alias("sample_rate"), samples.alias("samples"))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS recording_id, hit, true AS near FROM nation, (SELECT unnest([1, 2, 3, 4, 5]) AS hit)""")
def onset_times(spark: SparkSession, d: str) -> DataFrame:
    """The stage with its own parameters over chunks finds the five hits, each within 40 ms, and nothing else."""
    params = {"sr": None, "hop_length": 64, "n_fft": 256, "snap_to_zero_crossing": False, "detection_params": {"fmin": 100.0, "fmax": 4000.0, "aggregate": "mean", "delta": 0.2}}
    found = chain.segmentation().run([{"stage_name": "onset_detection", "params": params}], _hits(spark, d), chain.AUDIO).data
    first = F.col("recording_id") / 100 + 0.2
    hit = F.round((F.col("t") - first) / 0.5).cast("int")
    return found.select("recording_id", (hit + 1).alias("hit"), (F.abs(F.col("t") - first - hit * 0.5) < 0.04).alias("near"))


@query("""SELECT n_nationkey, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][n_nationkey % 12 + 1] || CASE WHEN n_nationkey % 2 = 0 THEN 'm' ELSE '' END AS key FROM nation""")
def triad_keys(spark: SparkSession, d: str) -> DataFrame:
    """Major and minor triads from C2 up over chunks, told by the constant-Q transform."""
    n, note = F.col("n_nationkey"), lambda k: F.pow(F.lit(2.0), (F.col("n_nationkey") % 12 + 36 + 12 * (F.col("n_nationkey") % 3) + k - 69) / 12.0) * 440.0
    third = note(F.when(n % 2 == 0, 3).otherwise(4))
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c"))
    wave = lambda hz, t: F.sin(t * hz * (2 * 3.141592653589793 / 8000))
    samples = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda k: wave(note(F.lit(0)), F.col("c") * 4000 + k) + wave(third, F.col("c") * 4000 + k) * 0.7 + wave(note(F.lit(7)), F.col("c") * 4000 + k) * 0.5)
    made = chunks.chroma(rows.select("n_nationkey", (F.col("c") * 4000).cast("bigint").alias("first_frame"), F.lit(8000).alias("sample_rate"), samples.alias("samples")), "n_nationkey", highest=8000)
    return made.select("n_nationkey", audio.key_name(F.col("chroma")).alias("key"))


# --- files ---------------------------------------------------------------------------------------


def _saved(spark: SparkSession, d: str) -> str:
    """Recordings of four embeddings as files rec/<k>/<n>.wav."""
    rows = chunks.tiles(_pieces(spark, d, 4), "rec", size=256).where("tile = 0")
    named = rows.select(F.concat(F.lit("rec/"), F.col("rec") % 3, F.lit("/"), "rec").alias("name"), "sample_rate", "samples", F.create_map(F.lit("title"), F.concat(F.lit("take "), "rec")).alias("tags"))
    wav.export(wav.to_wav(named, 16, "tags"), folder := _folder(spark, "takes"))
    return folder


@query(f"""WITH {_recordings(4)} SELECT rec, CAST(4 AS BIGINT) AS chunks, CAST(256 AS BIGINT) AS frames, round(sum(abs(greatest(-32768, least(32767, round_even(y * 32768, 0))) / 32768)), 5) AS total FROM x GROUP BY rec""")
def audio_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Files in folders, each read by several tasks in ranges of 100 bytes: every frame comes once."""
    rows = wav.read_audio(spark, _saved(spark, d), "*.wav", chunk=70, split=100)
    rec = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    return rows.groupBy(rec.alias("rec")).agg(F.count("*").alias("chunks"), F.sum(F.size("samples")).alias("frames"), F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))), 5).alias("total"))


@query(f"""WITH {_recordings(4)} SELECT CAST(rec AS VARCHAR) || '.wav' AS name, CAST(7 AS BIGINT) AS project_id, 'rec/' || (rec % 3) || '/' || rec || '.wav' AS place, 256 / 8000.0 AS duration, 8000 AS sample_rate, 1 AS channels, 'uploaded' AS status, '{{"title":"take ' || rec || '"}}' AS metadata_json FROM w""")
def ingested_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of all files below a folder, by their headers alone."""
    made = catalogue.ingest(wav.read_headers(spark, folder := _saved(spark, d)), 7, 1, F.lit("2024-01-01").cast("timestamp_ntz"))
    return made.select("name", "project_id", F.replace("file_path", F.lit(f"{folder.removeprefix('file:').removeprefix('//')}/"), F.lit("")).alias("place"), "duration", "sample_rate", "channels", "status", "metadata_json")


@query("""SELECT vec_id, CAST(2 AS INTEGER) AS markers, CAST(vec_id % 64 AS BIGINT) AS first_at, 'stab ' || vec_id AS label, CAST(60 + vec_id % 12 AS INTEGER) AS unity_note, CAST(vec_id % 64 AS BIGINT) AS loop_end, CASE WHEN vec_id % 2 = 0 THEN CAST(vec_id % 128 AS INTEGER) END AS low_note FROM embeddings""")
def marked_files(spark: SparkSession, d: str) -> DataFrame:
    """Cue points, labels, sampler loops and instruments there and back."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("embedding").cast("array<double>").alias("samples"), "vec_id")

    def made(y, n) -> tuple:
        note = dict(zip(("unshifted_note", "fine_tune", "gain", "low_note", "high_note", "low_velocity", "high_velocity"), (60, -1, -2, n % 128, 127, 1, 127), strict=True)) if n % 2 == 0 else None
        sampler = {"unity_note": 60 + n % 12, "loops": [{"id": 1, "type": 0, "start": 0, "end": n % 64, "fraction": 0, "count": 0}]}
        return (wav.encode(y, 8000, 16, None, riff.write([{"id": 2, "at": 64, "label": None}, {"id": 1, "at": n % 64, "label": f"stab {n}", "note": "x"}], sampler, note)),)

    found = riff.marked(chunks.mapped(rows, {"content": "binary"}, made, "samples", "vec_id"))
    return found.select(F.col("path").cast("bigint").alias("vec_id"), F.size("markers").alias("markers"), F.get("markers", F.lit(0))["at"].alias("first_at"), F.array_join("labels", ",").alias("label"), "sampler.unity_note", F.get("sampler.loops", F.lit(0))["end"].alias("loop_end"), "instrument.low_note")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS recording_id, CAST(4 AS BIGINT) AS files, true AS at_rest, true AS at_full_scale, true AS as_told FROM nation""")
def written_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices on disk by the workflow: all but the last, which is longer than the audio left, of each recording's five; they begin and end at 0, at full scale, with the frames told."""
    parts = _hits(spark, d)
    recordings = parts.groupBy("recording_id").agg(F.lit("take").alias("base"), F.max("sample_rate").alias("sample_rate"), F.lit(24_000).cast("bigint").alias("n_samples"))
    folder = _folder(spark, "slices")
    onset = {"sr": None, "hop_length": 128, "n_fft": 512, "detection_params": {"fmin": 100.0, "fmax": 4000.0, "delta": 0.1}}
    rows = chain.workflows(recordings, parts).run("SliceFiles", parts, {"onset_detection": onset, "slicing": {"longest": 0.6}, "slice_files": {"folder": folder}}).data
    told = rows.select(F.col("recording_id"), F.concat(F.col("recording_id").cast("string"), F.lit("/"), "name", F.lit(".wav")).alias("file"), (F.col("last_sample") - F.col("first_sample")).alias("n"))
    read = wav.read_audio(spark, folder, "*.wav").select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), "samples")
    y = F.col("samples")
    both = read.join(told, "file", "full")
    return both.groupBy("recording_id").agg(F.count("samples").alias("files"), F.bool_and((F.get(y, F.lit(0)) == 0) & (F.get(y, F.size(y) - 1) == 0)).alias("at_rest"), F.bool_and(F.abs(F.array_max(F.transform(y, lambda v: F.abs(v))) - 1) < 1e-6).alias("at_full_scale"), F.bool_and(F.size(y) == F.col("n")).alias("as_told"))


@query("""WITH p AS (SELECT o_custkey % 5 AS project_id, 'Song/Verse/' || o_orderkey || '.txt' AS path, repeat(o_orderpriority, 20) AS t FROM orders)
SELECT CAST(project_id AS BIGINT) AS project_id, count(*) AS members, CAST(sum(length(t)) AS BIGINT) AS bytes, true AS gapless FROM p GROUP BY project_id""")
def zipped_kits(spark: SparkSession, d: str) -> DataFrame:
    """Zips whose parts are made by many tasks: all members are listed, and each part begins where the last ended."""
    files = table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("bigint").alias("project_id"), F.concat(F.lit("Song/Verse/"), "o_orderkey", F.lit(".txt")).alias("path"), F.encode(F.repeat("o_orderpriority", F.lit(20)), "UTF-8").alias("content"))
    members = ordered.written(exports.zip_members(files), "members")
    parts = exports.zip_parts(members)
    ends = F.array(F.struct(F.col("at").alias("place"), F.lit(1).alias("starts"), F.lit(0).alias("ends")), F.struct((F.col("at") + F.octet_length("body")).alias("place"), F.lit(0).alias("starts"), F.lit(1).alias("ends")))
    member = (F.hex(F.substr("body", F.lit(1), F.lit(4))) == "504B0102").cast("int")
    each = parts.select("project_id", F.explode(ends).alias("e"), member.alias("member")).select("project_id", "e.*", (F.col("member") * F.col("e.starts")).alias("member"))
    # parts are not empty, so they follow each other if one begins at 0, one ends last, and at all other places one ends and one begins
    places = each.groupBy("project_id", "place").agg(F.sum("starts").alias("starts"), F.sum("ends").alias("ends"), F.sum("member").alias("members"))
    met, first = (F.col("starts") == 1) & (F.col("ends") == 1), (F.col("place") == 0) & (F.col("starts") == 1) & (F.col("ends") == 0)
    last = (F.col("starts") == 0) & (F.col("ends") == 1)
    gapless = F.bool_and(met | first | last) & (F.count_if(first) == 1) & (F.count_if(last) == 1)
    whole = places.groupBy("project_id").agg(gapless.alias("gapless"), F.sum("members").alias("members"))
    return whole.join(members.groupBy("project_id").agg(F.sum("size").alias("bytes")), "project_id").select("project_id", "members", "bytes", "gapless")


# --- tables --------------------------------------------------------------------------------------

_ROWS = "id long, name string, manifest_id long"


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS manifest_id FROM supplier WHERE s_nationkey NOT IN (3, 4) AND NOT (s_nationkey = 5 AND s_suppkey % 2 = 0)
UNION ALL SELECT s_suppkey, 'changed', s_nationkey FROM supplier WHERE s_nationkey = 5 AND s_suppkey % 2 = 0
UNION ALL SELECT n_nationkey, n_name, 3 FROM nation UNION ALL SELECT 1000000 + n_nationkey, 'added', n_nationkey FROM nation WHERE n_nationkey > 20""")
def written_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules appended, replaced for manifest 3, deleted for 4, changed and added by key; then read."""
    path = _folder(spark, "rules")
    own = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("bigint").alias("manifest_id"))
    nations = table(spark, d, "nation")
    tables.append(own, path, "manifest_id")
    tables.replace_partitions(nations.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit(3).cast("bigint").alias("manifest_id")), path, "manifest_id", [3, 4])
    added = nations.where("n_nationkey > 20").select((F.col("n_nationkey") + 1_000_000).cast("bigint").alias("id"), F.lit("added").alias("name"), F.col("n_nationkey").cast("bigint").alias("manifest_id"))
    tables.upsert(own.where("manifest_id = 5 AND id % 2 = 0").withColumn("name", F.lit("changed")).unionByName(added), path, "manifest_id", "id")
    return tables.read(spark, path, _ROWS)


@query("""WITH r AS (SELECT c_nationkey AS project_id, c_custkey AS rule_id, 'o' || (c_custkey * 10) AS name FROM customer), a AS (SELECT c_nationkey AS project_id, o_orderkey AS asset_id, 'O' || o_orderkey AS name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS matches FROM r JOIN a ON r.project_id = a.project_id AND r.name = lower(a.name)""")
def rarest_tags(spark: SparkSession, d: str) -> DataFrame:
    """Rules that ask for a tag of all assets and for a rare one meet no more assets than they match."""
    both = lambda name: F.to_json(F.struct(F.lit("sample").alias("type"), F.lit(True).alias("ready"), name.alias("name")))
    customers = table(spark, d, "customer")
    rules = customers.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("rule_id"), both(F.concat(F.lit("o"), F.col("c_custkey") * 10)).alias("required_tags_json"))
    assets = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("project_id"), F.lit("sample").alias("kind"), F.col("o_orderkey").alias("asset_id"), both(F.concat(F.lit("O"), "o_orderkey")).alias("tags_json"))
    pairs = manifest.meetings(rules, assets)
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.size(F.array_except("wanted", "own")) == 0).alias("matches"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey % 1000 / 10.0 AS a, l_partkey % 1000 / 10.0 + 1 + l_suppkey % 8 AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)),
g(k, r, kept) AS (SELECT k, CAST(0 AS BIGINT), [] :: STRUCT(a DOUBLE, b DOUBLE, i INTEGER)[] FROM c GROUP BY k UNION ALL
  SELECT g.k, c.r, CASE WHEN len(list_filter(kept, lambda o: (least(c.b, o.b) - greatest(c.a, o.a)) / least(c.b - c.a, o.b - o.a) > 0.5)) = 0 THEN list_append(kept, {'a': CAST(c.a AS DOUBLE), 'b': CAST(c.b AS DOUBLE), 'i': CAST(c.i AS INTEGER)}) ELSE kept END FROM g JOIN c ON c.k = g.k AND c.r = g.r + 1)
SELECT CAST(k AS BIGINT) AS l_orderkey, CAST(len(kept) AS BIGINT) AS chosen, CAST(list_sum(list_transform(kept, lambda o: o.i)) AS BIGINT) AS lines FROM (SELECT k, kept, row_number() OVER (PARTITION BY k ORDER BY r DESC) AS n FROM g) WHERE n = 1""")
def many_loops(spark: SparkSession, d: str) -> DataFrame:
    """Interval suppression without a cap on how many are chosen."""
    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_extendedprice"))
    rows = table(spark, d, "lineitem").withColumn("n", one).where("n = 1")
    start = (F.col("l_partkey") % 1000) / 10.0
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    scored = rows.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("idx"), start.alias("start_time"), (start + 1 + F.col("l_suppkey") % 8).alias("end_time"), (1.0 / F.row_number().over(order)).alias("score"))
    best = loops.select_best(scored, "l_orderkey", n=1 << 30, least=0.0)
    return best.groupBy("l_orderkey").agg(F.count("*").alias("chosen"), F.sum("idx").cast("bigint").alias("lines"))


# --- streams -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS first FROM events GROUP BY user_id), e AS (SELECT user_id, first, (SELECT min(event_id) FROM events x WHERE x.user_id = s.user_id AND x.event_type = 'error' AND x.event_id > first) AS last FROM s WHERE first IS NOT NULL),
m AS (SELECT e.user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events x JOIN e ON x.user_id = e.user_id AND event_id > first AND event_id < last AND event_type NOT IN ('signup', 'error') GROUP BY e.user_id)
SELECT CAST(user_id AS BIGINT) AS session_id, CASE WHEN last IS NULL THEN 'recording' WHEN n IS NULL THEN 'completed_empty' ELSE 'completed' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS messages, coalesce(ids, '') AS ids FROM e LEFT JOIN m USING (user_id)""")
def completed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Capture as one stateful stream: a user's session goes from the first signup to the next error."""
    for k, v in session.STATE_STORE.items():
        spark.conf.set(k, v)
    folder, source = _folder(spark, "sessions"), f"{d}/events.parque[t]"  # a pattern, as a stream is read from no single file
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop").otherwise("message")
    events = rows.select(F.col("user_id").cast("bigint").alias("session_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("bigint").alias("seq"), F.lit(1).alias("ports"), F.lit(1).cast("bigint").alias("device_id"), F.lit("Key").alias("device"), F.lit(0).alias("channel"), F.col("event_id").cast("string").alias("message"))
    session.capture_sessions(events, f"{folder}/out", f"{folder}/checkpoint", idle="100000 days").awaitTermination()
    told, made = session.statuses(spark, f"{folder}/out"), session.saved_tracks(spark, f"{folder}/out")
    return told.join(made, "session_id", "left").select("session_id", "status", F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("messages"), F.coalesce(F.array_join("messages", ","), F.lit("")).alias("ids"))
