"""The operators' queries over the synthetic tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, debruijn, decontam, langid, licenses, merkle, packing, ppm, quality, rabitq, secrets, simhash, toxicity
from .common import in_fold, read_table, written


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, read_table(spark, sf_dir, "labels"), "quality", ~in_fold("doc_id", 4, 2))
    return _judged(quality.score(docs, trees, "score"), 4, 2)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each candidate: doc_id, nth (in the document), length, score, is_secret, sha256 of the candidate."""
    p = secrets.ForestParams()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.findings(docs, secrets.train(secrets.labelled_findings(spark), p), "source")
    each = found.select("doc_id", F.posexplode("findings").alias("nth", "f"))
    return each.select(
        "doc_id", "nth", F.length("f.candidate").alias("length"), "f.score", (F.col("f.score") >= p.threshold).alias("is_secret"),
        F.sha2(F.col("f.candidate").cast("binary"), 256).alias("candidate_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, read_table(spark, sf_dir, "benchmark"), 10)
    hit = F.aggregate("contaminated_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])
    items = F.col("contaminated_items")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs, ~in_fold("doc_id", 3, 1))
    out = langid.identify(docs.select("doc_id", "text"), net, "lang_pred", "score")
    return out.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", in_fold("doc_id", 7, 2))
    docs = docs.withColumn("learn", ~F.col("held_out"))
    return ppm.score(docs, ppm.train(docs, "learn"), ("doc_id", "held_out"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.cluster(docs, shingle=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), "toxic", ~in_fold("doc_id", 3, 1))
    return _judged(toxicity.score(docs, model, "score"), 3, 1)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return debruijn.mark(docs, 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered leaf goes along with each leaf and is folded with the untampered one's proof."""
    docs = read_table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = merkle.leaf({c: F.col(c) for c in merkle.FIELDS} | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    made = merkle.build(spark, docs, extra={"changed": F.when(hit & F.col("text").contains("\n"), changed)})
    folded = merkle.fold(F.coalesce(F.lower(F.hex("changed")), "leaf"), F.col("steps"))
    out = made.proofs().select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    out = written(out.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-result")
    made.remove()
    return out


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, licenses.index(docs))
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["first"])
    named = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def _judged(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    return scored.select("doc_id", in_fold("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_quality, op2_secrets, op3_decontaminate, op4_pack, op5_langid, op6_lm_score, op7_simhash, op8_toxicity, op9_substring_dedup, op10_nearest, op11_alignment, op12_merkle, op13_licenses)
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM s),
sizes AS (SELECT DISTINCT n FROM t),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT r, p.n, i, item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM p) p JOIN t ON p.n = t.n AND p.win = t.win),
words AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM h),
hit AS (SELECT r, count(*) AS n_hit FROM words GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
starts AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM p WHERE win IN (SELECT win FROM rep)),
gone AS (SELECT r, unnest(range(greatest(i, coalesce(before + 35, i)), i + 35)) AS k FROM starts),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (r, k) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


_leaf_sql = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("a", "source", "lang", "m", text)) + ")"
#: The nodes of all levels by recursion; each row's own or changed leaf climbs, and its proof grows on the way. crc is CRC-32 bit by bit, but for its last step, which turns every bit.
OP12_SQL = rf"""
WITH RECURSIVE f AS (SELECT doc_id, source, lang, text, CAST(doc_id AS VARCHAR) AS a, CAST(n_chars AS VARCHAR) AS m, replace(text, chr(10), '') AS cut FROM documents),
g AS (SELECT *, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(a, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc FROM f),
l AS (SELECT doc_id, source, row_number() OVER () AS r, {_leaf_sql("text")} AS leaf, CASE WHEN crc % 2 = 1 THEN {_leaf_sql("cut")} END AS changed FROM g),
o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM o UNION ALL
       SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subs AS (SELECT tree, h FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM subs) AS n, h FROM subs UNION ALL
        SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
climb AS (SELECT r, tree, 0 AS lvl, pos, n, '' AS proof, coalesce(changed, leaf) AS h FROM o UNION ALL
          SELECT c.r, c.tree, c.lvl + 1, c.pos // 3, (c.n + 2) // 3, c.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> c.pos), ''),
                 sha256(string_agg(CASE WHEN u.pos = c.pos THEN c.h ELSE u.h END, '' ORDER BY u.pos))
          FROM climb c JOIN up u ON u.tree = c.tree AND u.lvl = c.lvl AND u.pos // 3 = c.pos // 3 WHERE c.n > 1 GROUP BY c.r, c.tree, c.lvl, c.pos, c.n, c.proof),
mount AS (SELECT r, 0 AS lvl, tree AS pos, (SELECT count(*) FROM subs) AS n, proof, h FROM climb WHERE n = 1 UNION ALL
          SELECT c.r, c.lvl + 1, c.pos // 3, (c.n + 2) // 3, c.proof || coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos <> c.pos), ''),
                 sha256(string_agg(CASE WHEN u.pos = c.pos THEN c.h ELSE u.h END, '' ORDER BY u.pos))
          FROM mount c JOIN top u ON u.lvl = c.lvl AND u.pos // 3 = c.pos // 3 WHERE c.n > 1 GROUP BY c.r, c.lvl, c.pos, c.n, c.proof),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subs.h AS subroot, root, sha256(proof) AS proof_sha256, mount.h AS folded_root, mount.h = root AS verified
FROM o JOIN subs USING (tree) JOIN mount ON mount.r = o.r AND mount.n = 1 CROSS JOIN root
"""


def _op13_sql() -> str:
    """Every template looked for at every word, without an index."""
    rows = [
        f"({k}, '{t.label}', {str(t.base).lower()}, [{', '.join(repr(x) for x in t.words)}], [{', '.join(str(i) for i in t.must)}])"
        for k, t in enumerate(licenses.templates())
    ]
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{licenses.WORD}') AS w FROM documents),
t AS (SELECT * FROM (VALUES {', '.join(rows)}) v(k, label, base, words, must)),
p AS (SELECT r, w, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT r, w, k, label, base, words, must, i - must[1] AS b, i FROM p JOIN t ON x = words[must[1] + 1]),
hit AS (SELECT r, label, base, i, len(list_filter(range(0, len(words)), lambda j: b + j >= 0 AND b + j < len(w) AND w[b + j + 1] = words[j + 1])) / len(words) AS score
        FROM s WHERE len(list_filter(must, lambda j: b + j < len(w) AND w[b + j + 1] = words[j + 1])) = len(must)),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r)
"""


OP13_SQL = _op13_sql()


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op9_substring_dedup": OP9_SQL, "op10_nearest": OP10_SQL, "op12_merkle": OP12_SQL, "op13_licenses": OP13_SQL}
