"""Manifest evaluation: which assets fulfil which tag rules of their project, and how far.

Tag matching is a relational division. A rule and an asset meet only on the rule's rarest tag, told by
how many assets of the project have each tag; the rule's other tags are then looked up in the pair. So a tag that all
assets have costs nothing but to rules that ask for no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.arithmetic import percent_done


def project_assets(samples: DataFrame, recordings: DataFrame, midi_files: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """(project_id, kind, asset_id, tags_json) of samples, then of MIDI files, whose tags are empty."""
    found = samples.alias("s").join(recordings.alias("r"), F.col("s.recording_id") == F.col("r.id")).select("r.project_id", F.lit("sample").alias("kind"), F.col("s.id").alias("asset_id"), F.col("s.metadata_json").alias("tags_json"))
    if midi_files is None or sessions is None:
        return found
    midi = midi_files.alias("m").join(sessions.alias("c"), F.col("m.capture_session_id") == F.col("c.id")).select("c.project_id", F.lit("midi").alias("kind"), F.col("m.id").alias("asset_id"), F.lit("{}").alias("tags_json"))
    return found.unionByName(midi)


def meetings(rules: DataFrame, assets: DataFrame) -> DataFrame:
    """(project_id, rule_id, kind, asset_id, wanted, own): pairs that share the rule's rarest tag, with the tags of both. See ``match``.

    An asset's tags are listed once and dealt by asset; the counts and the pairs both start from there. For that both need the same
    rows, so assets without id, which nothing can refer to, are left out first. A rule's rarest tag is kept by a semi-join, after which
    rules are estimated as small as they are: few ones are sent to all assets, and only many are met by a shuffle.
    """
    each, known = F.struct("tag", "value"), ["project_id", "tag", "value"]
    need = tags.explode(rules, "required_tags_json", "project_id", "rule_id")
    there = F.col("project_id").isNotNull() & F.col("kind").isNotNull() & F.col("asset_id").isNotNull()
    own = assets.where(there).select("project_id", "kind", "asset_id", tags.listed(F.col("tags_json")).alias("own")).repartition("project_id", "asset_id")
    # The outer form, as the other's test of the list for being empty would be moved to where the list is made, and make it twice.
    have = own.select("*", F.explode_outer("own").alias("x")).select("project_id", F.col("x.tag").alias("tag"), F.col("x.value").alias("value"), "kind", "asset_id", "own")
    counts = have.join(need.select(*known).distinct(), known, "left_semi").groupBy(*known).agg(F.count(F.lit(1)).alias("held"))
    told = need.join(counts, known, "left").withColumn("held", F.coalesce("held", F.lit(0).cast("bigint")))
    least = told.groupBy("project_id", "rule_id").agg(F.min_by(each, F.struct("held", "tag", "value")).alias("rarest"), F.min("held").alias("held")).where("held > 0")
    wants = need.groupBy("project_id", "rule_id").agg(F.collect_set(each).alias("wanted")).select("*", F.explode("wanted").alias("x"))
    same = (F.col("w.project_id") == F.col("l.project_id")) & F.col("w.rule_id").eqNullSafe(F.col("l.rule_id")) & (F.col("w.x") == F.col("l.rarest"))
    rarest = wants.alias("w").join(least.alias("l"), same, "left_semi").select("project_id", "rule_id", F.col("x.tag").alias("tag"), F.col("x.value").alias("value"), "wanted")
    return have.join(rarest, known).select("project_id", "rule_id", "kind", "asset_id", "wanted", "own")


def match(rules: DataFrame, assets: DataFrame) -> DataFrame:
    """(project_id, rule_id, kind, asset_id) of every match; one asset may match several rules.

    rules: project_id, rule_id, required_tags_json. A rule without tags matches nothing.
    """
    there = (F.size("wanted") == 1) | (F.size(F.array_except("wanted", "own")) == 0)  # they share one
    return meetings(rules, assets).where(there).select("project_id", "rule_id", "kind", "asset_id")


def rule_status(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Every rule with match_count, progress and is_fulfilled; rules without match have 0."""
    counts = matches.groupBy("project_id", "rule_id").agg(F.count(F.lit(1)).alias("match_count"))
    joined = rules.join(counts, ["project_id", "rule_id"], "left").withColumn("match_count", F.coalesce("match_count", F.lit(0).cast("bigint")))
    target = F.coalesce("target_count", F.lit(1))
    return joined.select("project_id", "rule_id", "target_count", "match_count", percent_done(F.col("match_count"), target).alias("progress"), (F.col("match_count") >= target).alias("is_fulfilled"))


def match_lists(matches: DataFrame) -> DataFrame:
    """(project_id, rule_id, matches): samples first, then MIDI, each by id."""
    order = F.struct((F.col("kind") == "midi").alias("late"), "asset_id", "kind")
    return matches.groupBy("project_id", "rule_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["kind"].alias("kind"), x["asset_id"].alias("asset_id"))).alias("matches"))


def project_progress(projects: DataFrame, manifests: DataFrame, status: DataFrame) -> DataFrame:
    """(project_id, progress, message): truncated mean over rules; 0 without manifest, 100 without rules."""
    mean = status.groupBy("project_id").agg(F.avg("progress").cast("int").alias("mean"))
    have = manifests.select("project_id").distinct().withColumn("has", F.lit(True))
    joined = projects.select(F.col("id").alias("project_id")).join(have, "project_id", "left").join(mean, "project_id", "left")
    return joined.select(
        "project_id", F.when(F.col("has").isNull(), 0).otherwise(F.coalesce("mean", F.lit(100))).alias("progress"),
        F.when(F.col("has").isNull(), "no manifest").when(F.col("mean").isNull(), "no rules").alias("message"),
    )


def unassigned(assets: DataFrame, matches: DataFrame) -> DataFrame:
    """Assets that match no rule of their project."""
    return assets.join(matches, ["project_id", "kind", "asset_id"], "left_anti")


def replace_rules(rules: DataFrame, manifest_id: int, new: DataFrame) -> DataFrame:
    """All rules with those of one manifest replaced; missing target 1, missing tags none."""
    made = new.withColumns({"manifest_id": F.lit(manifest_id).cast("bigint"), "target_count": F.coalesce("target_count", F.lit(1)), "required_tags_json": F.coalesce("required_tags_json", F.lit("{}"))})
    return rules.where(F.col("manifest_id") != manifest_id).unionByName(made, allowMissingColumns=True)


def rule_grid(songs: DataFrame, sections: DataFrame, parts: DataFrame) -> DataFrame:
    """A rule for each song, section and part; the instrument is the part's first word in lower case."""
    grid = songs.select("song").crossJoin(sections.select("section")).crossJoin(parts.select("part"))
    instrument = F.lower(F.element_at(F.split("part", " "), 1))
    return grid.select("song", "section", "part", instrument.alias("instrument"), F.concat_ws(" - ", "song", "section", "part").alias("name"))


def generation_jobs(rules: DataFrame, seed: int = 42) -> DataFrame:
    """target_count jobs for each rule, whatever matches it already; key, tempo and engine from its tags, which are read once a rule."""
    j = F.col("required_tags_json")
    told = rules.where("target_count > 0").select(
        "rule_id", "target_count", F.concat(F.replace("name", F.lit(" "), F.lit("_")), F.lit("_v")).alias("label"), tags.get(j, "key", "C").alias("key"),
        F.try_to_number(tags.get(j, "tempo", "120"), F.lit("999.99")).cast("double").alias("tempo"), tags.get(j, "instrument", "bass").alias("engine"),
    )
    dealt = told.repartition("rule_id")  # rules are few and small, their jobs many
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("target_count") - 1)).alias("i"))
    return each.select("rule_id", "i", F.concat("label", F.col("i") + 1).alias("label"), (F.col("i") + seed).cast("bigint").alias("seed"), "key", "tempo", "engine")
