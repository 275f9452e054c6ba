"""Samples, rankings, agreement and mixture statistics."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import stats as S
from sievewright.functions import text as T
from sievewright.tables import once, positions, table

SEED = "2026"
#: Addresses, account and personal numbers, as Java's engine and RE2 read alike.
IDENTIFIER = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}|\b[Tt][Rr][0-9]{24}\b|(?:^|[^0-9])[0-9]{11}(?:[^0-9]|$)"


def round9(c: Column) -> Column:
    return F.round(c, 9)


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each contribution once, its newest delivery."""
    c = table(spark, sf_dir, "contributions").select("contribution_id", "task_type", "contributor_id", "item_language", "item_domain", "review_status", "created_at", "updated_at")
    newest = F.max_by(F.struct(*[x for x in c.columns if x != "contribution_id"]), F.struct("updated_at", "created_at", "review_status")).alias("c")
    return c.groupBy("contribution_id").agg(newest).select("contribution_id", "c.*")


CONTRIBUTIONS_SQL = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contribution_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, review_status DESC NULLS LAST) AS k FROM contributions) WHERE k = 1)"


def uniform_sample(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Bottom-k by a seeded hash; TakeOrderedAndProject keeps k rows a task."""
    key = F.sha2(F.concat_ws("\x1f", F.lit("uniform"), F.lit(SEED), F.col("doc_id").cast("string")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("sample_key")).orderBy("sample_key", "doc_id").limit(size)


def calibration_sample(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    f = table(spark, sf_dir, "document_fingerprints").select("source_sha256", "source_ordinal").where("source_sha256 is not null").distinct()
    key = F.substring(F.sha2(F.concat_ws(":", "source_sha256", F.col("source_ordinal").cast("string")), 256), 1, 32)
    return f.select("source_sha256", "source_ordinal", key.alias("sample_key")).orderBy("sample_key", "source_sha256", "source_ordinal").limit(size)


def stratified_audit_sample(spark: SparkSession, sf_dir: str, each: int = 5) -> DataFrame:
    """Bottom-k of each stratum; a rank limit over a hot stratum is pushed below the shuffle as a group limit."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source_ordinal", F.coalesce("doc_domain", F.lit("unknown")).alias("stratum"), F.sha2("text", 256).alias("sha"))
    key = F.sha2(F.concat_ws(":", F.lit(SEED), F.coalesce("sha", F.lit("")), F.col("doc_id").cast("string")), 256)
    w = Window.partitionBy("stratum").orderBy("sample_key", "doc_id")
    return d.select("doc_id", "stratum", key.alias("sample_key")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("doc_id", "stratum", F.col("rank").cast("long").alias("rank"))


def reservoir_indices(eligible: int, size: int, seed: str) -> dict[int, int]:
    """slot -> 1-based index of the row that a reservoir over so many rows keeps there.

    The choice depends on counts only, so rows needn't pass through one task;
    rows between two replacements are skipped at once, so the steps grow with
    the logarithm of the rows.
    """
    rng, kept = random.Random(int(seed[:16], 16)), {i: i + 1 for i in range(min(size, eligible))}
    at, w = size, 1.0
    while size and at <= eligible:
        w *= math.exp(math.log(1.0 - rng.random()) / size)
        at += math.floor(math.log(1.0 - rng.random()) / math.log1p(-w)) + 1 if w < 1 else 1
        if at <= eligible:
            kept[rng.randrange(size)] = at
    return kept


def reservoir_sample(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """Reservoir over all documents with a text (a sampling operator), in slot order."""
    docs = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").select("doc_id", F.lit(1).alias("all"))
    numbered = positions(docs, "all", ["doc_id"], "index")  # by ranges, no task sorts all
    kept = reservoir_indices(docs.count(), size, "9f86d081884c7d65")
    slots = spark.createDataFrame(list(kept.items()), "slot long, index long")
    return numbered.join(F.broadcast(slots), "index").select("slot", "doc_id").orderBy("slot")


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons and capped score of each line, of its text and of its form."""
    lines = table(spark, sf_dir, "source_lines").where("raw_line is not null").select("record_id", "raw_line")
    field = lambda k: F.nullif(F.trim(F.get_json_object("raw_line", f"$.{k}")), F.lit(""))
    is_json = F.ltrim("raw_line").startswith("{")
    d = once(lines, "m", F.struct(F.when(is_json, F.try_parse_json("raw_line").isNotNull()).alias("parsed"), F.when(is_json, F.coalesce(field("text"), field("content"), field("body"))).alias("body")))
    d = once(d.select("record_id", F.col("m.parsed").alias("parsed"), F.col("m.body").alias("body"), F.coalesce("m.body", "raw_line").alias("text")), "w", F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), 0))
    text, n = F.col("text"), F.char_length("text")
    symbols = F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\s]"))
    reasons = [
        ("short_text", 1, n < 24),
        ("long_text", 2, n > 4000),
        ("control_characters", 3, text.rlike(r"[\x00-\x08\x0e-\x1b\x7f-\x{0084}\x{0086}-\x{009f}\p{Cf}]")),
        ("high_symbol_ratio", 2, (n >= 40) & (symbols * 100 > n * 35)),
        ("repeated_character_run", 2, text.rlike(r"(?s)(.)\1{7,}")),
        ("low_lexical_diversity", 2, (F.size("w") >= 20) & (F.size(F.array_distinct("w")) * 4 < F.size("w"))),
        ("identifier_pattern", 3, text.rlike(IDENTIFIER)),
        ("malformed_json", 2, F.coalesce(~F.col("parsed"), F.lit(False))),
        ("missing_text_field", 2, F.coalesce(F.col("parsed") & F.col("body").isNull(), F.lit(False))),
    ]
    named = F.filter(F.array(*(F.when(test, F.lit(name)) for name, _, test in reasons)), lambda x: x.isNotNull())
    score = sum((F.when(test, points).otherwise(0) for _, points, test in reasons), F.lit(0))
    return d.select("record_id", F.array_join(named, "|").alias("reasons"), F.least(score, F.lit(10)).cast("long").alias("score"))


def risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by risk reason."""
    d = risk_score(spark, sf_dir).select("score", F.explode(F.split("reasons", "\\|")).alias("reason")).where("reason <> ''")
    return d.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"), F.max("score").alias("highest"))


def line_key() -> Column:
    return F.sha2(F.concat_ws(":", F.lit(SEED), F.col("record_id").cast("string")), 256)


def risk_top_k(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """The riskiest lines, up to half of a sample (a sampling operator), equal scores in the order of a seeded hash."""
    return risk_score(spark, sf_dir).where("score > 0").select("*", line_key().alias("k")).orderBy(F.desc("score"), F.desc("k"), F.desc("record_id")).limit(max(1, size // 2)).drop("k")


def combined_sample(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """A sample of the riskiest lines, filled up with others in the order of a seeded hash (a sampling operator)."""
    risky = risk_top_k(spark, sf_dir, size).select("record_id", F.lit("risk").alias("part"))
    others = table(spark, sf_dir, "source_lines").where("raw_line is not null").select("record_id", line_key().alias("k")).orderBy("k", "record_id").limit(size + size // 2)  # enough, as at most half of them are risky
    fill = others.join(risky, "record_id", "left_anti").orderBy("k", "record_id").limit(size - size // 2).select("record_id", F.lit("fill").alias("part"))
    return risky.unionByName(fill)


def mixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of two versions in one blind order by a seeded hash, numbered within hash ranges so that none is sorted whole."""
    s = table(spark, sf_dir, "pii_scans").where("object_sha256 is not null").select("scan_id", "scanner_version", F.sha2(F.concat_ws(":", F.lit(SEED), "scan_id"), 256).alias("k"))
    return positions(s.withColumn("all", F.lit(1)), "all", ["k", "scan_id"], "no").select("no", "scan_id", "scanner_version")


def keyset_page(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """The page after a (time, id) key, newest first."""
    after = F.lit("2026-06-01 00:00:00").cast("timestamp")
    d = table(spark, sf_dir, "documents").select("doc_id", "ingested_at")
    page = d.where((F.col("ingested_at") < after) | ((F.col("ingested_at") == after) & (F.col("doc_id") < 1000)))
    return page.orderBy(F.desc("ingested_at"), F.desc("doc_id")).limit(size)


def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scan of each object and version, by keep-latest aggregation."""
    s = table(spark, sf_dir, "pii_scans").where("object_sha256 is not null")
    newest = F.max_by(F.struct("scan_id", "scan_status", "findings"), F.struct("scanned_at", "scan_id")).alias("s")
    return s.groupBy("object_sha256", "scanner_version").agg(newest, F.count(F.lit(1)).alias("scans")).select("object_sha256", "scanner_version", "s.scan_id", "s.scan_status", "s.findings", "scans")


def latest_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(newest).select("event_type", "e.event_id", "e.ts")


def review_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts of each task type with the approval rate and its interval."""
    k, n = F.col("approved"), F.col("reviewed")
    c = contributions(spark, sf_dir).groupBy("task_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_status").isin("approved", "rejected", "auto_rejected")).alias("reviewed"),
        F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_distinct("contributor_id").alias("contributors"),
    )
    w = S.wilson(k, n)
    return c.select("task_type", "total", "reviewed", "approved", "contributors", round9(k / n).alias("rate"), round9(w["low"]).alias("low"), round9(w["high"]).alias("high"))


def scanner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each object under both scanner versions."""
    s = latest_scan(spark, sf_dir).groupBy("object_sha256").pivot("scanner_version", ["basic-tr-v1", "basic-tr-v2"]).agg(F.first("scan_status"))
    return s.select("object_sha256", F.col("basic-tr-v1").alias("a"), F.col("basic-tr-v2").alias("b")).where("a is not null and b is not null")


def scanner_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of two scanners over the objects that both scanned."""
    cells = scanner_pairs(spark, sf_dir).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))  # a confusion matrix: labels squared
    label = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("row"), F.lit(0).alias("col")), F.struct(F.col("b").alias("label"), F.lit(0).alias("row"), F.col("n").alias("col"))))
    margins = cells.select(label.alias("m")).groupBy("m.label").agg(F.sum("m.row").alias("row"), F.sum("m.col").alias("col"))
    expected = margins.agg(F.sum("row").alias("pairs"), (F.sum(F.col("row") * F.col("col")) / (F.sum("row") * F.sum("row"))).alias("expected"))
    observed = cells.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("observed"))
    one = expected.join(F.broadcast(observed), F.lit(True)).where("pairs is not null")  # one row each
    return one.select("pairs", round9("observed").alias("observed"), round9("expected").alias("expected"), round9(S.kappa(F.col("observed"), F.col("expected"))).alias("kappa"))


def pair_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with two or more scans: one label, or disagreement."""
    s = table(spark, sf_dir, "pii_scans").where("object_sha256 is not null and scan_status is not null").groupBy("object_sha256").agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("scan_status").alias("labels"), F.min("scan_status").alias("label"))
    return s.where("reviews >= 2").select("object_sha256", "reviews", F.when(F.col("labels") == 1, F.col("label")).alias("consensus"), (F.col("labels") > 1).alias("disagreement"))


def stratum_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flagged revisions in each reason stratum, weighted by characters."""
    d = revisions(spark, sf_dir).select(F.coalesce(F.nullif("edit_reason", F.lit("")), F.lit("none")).alias("stratum"), F.char_length("content_text").alias("chars"), (F.col("word_count") == 0).alias("bad"))
    g = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.count_if("bad").alias("mistakes"))
    w = S.wilson(F.col("mistakes"), F.col("records"))
    return g.select("stratum", "records", "chars", "mistakes", round9(F.col("mistakes") / F.col("records")).alias("rate"), round9(w["low"]).alias("low"), round9(w["high"]).alias("high"))


def overall_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character-weighted rate over strata with its effective sample size."""
    s = stratum_scores(spark, sf_dir).where("chars > 0")
    a = s.agg(F.sum(F.col("chars")).alias("t"), F.sum(F.col("chars") * F.col("mistakes") / F.col("records")).alias("wr"), F.sum(F.col("chars") * F.col("chars") / F.col("records")).alias("ww"))
    return a.select(round9(F.col("wr") / F.col("t")).alias("rate"), F.round(F.col("t") * F.col("t") / F.col("ww"), 6).alias("effective_n"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision once."""
    return table(spark, sf_dir, "document_revisions").dropDuplicates(["revision_id"])


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed columns between consecutive versions of a document."""
    r = revisions(spark, sf_dir).select("document_id", "document_version", "revision_id", "edit_reason", "char_count", "word_count", F.sha2("content_text", 256).alias("content"))
    w = Window.partitionBy("document_id").orderBy("document_version", "revision_id")
    names = ["content", "edit_reason", "char_count", "word_count"]
    before = r.select("*", *(F.lag(c).over(w).alias(f"old_{c}") for c in names), F.lag("revision_id").over(w).alias("old_id"))
    changed = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in names)), lambda x: x.isNotNull())
    return before.select("revision_id", F.when(F.col("old_id").isNull(), "insert").otherwise("update").alias("operation"), F.when(F.col("old_id").isNotNull(), F.array_join(changed, ",")).alias("changed_columns"))


def stored_count_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts that differ from the text, null-safe."""
    n = F.char_length("content_text")
    return revisions(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("revisions"), F.count_if(~F.col("char_count").eqNullSafe(n.cast("long"))).alias("drifted"), F.count_if(F.col("char_count").isNull()).alias("missing"))


def mixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, bytes, lines and share of bytes by each of five dimensions, in one pass by grouping sets."""
    dims = ["source_type", "license_id", "rights_status", "source_language", "media_type"]
    s = table(spark, sf_dir, "release_sources").groupBy("source_id", "source_version").agg(*(F.max(c).alias(c) for c in [*dims, "byte_size", "line_count"]))
    s.createOrReplaceTempView("mixture_sources")
    sets = ", ".join(f"({d})" for d in dims)
    label = " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims)
    value = " ".join(f"WHEN grouping({d}) = 0 THEN {d}" for d in dims)
    g = spark.sql(f"SELECT CASE {label} END AS dimension, coalesce(CASE {value} END, 'unknown') AS value, count(*) AS sources, coalesce(sum(byte_size), 0) AS bytes, coalesce(sum(line_count), 0) AS lines FROM mixture_sources GROUP BY GROUPING SETS ({sets})")
    total = F.sum("bytes").over(Window.partitionBy("dimension"))
    return g.select("dimension", "value", "sources", "bytes", "lines", T.basis_points(F.col("bytes"), total).alias("share_points"))


def status_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review statuses by language, domain and task type, unpivoted."""
    c = contributions(spark, sf_dir).select("review_status", *(F.coalesce(x, F.lit("unknown")).alias(x) for x in ("item_language", "item_domain", "task_type")))
    tall = c.unpivot(["review_status"], ["item_language", "item_domain", "task_type"], "dimension", "value")
    return tall.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if(F.col("review_status").isin("rejected", "auto_rejected")).alias("rejected"))


def membership_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the members of each release in order."""
    m = table(spark, sf_dir, "release_mixture").select("release_id", "mixture_name", F.sha2(F.concat_ws("|", "release_id", "mixture_name", F.array_join("source_ids", ",")), 256).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mixture_name", "h"))), lambda x: x["h"]), "")
    return m.groupBy("release_id").agg(F.count(F.lit(1)).alias("members"), F.sha2(ordered, 256).alias("root"))


def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds before the next attempt, doubled each time up to five minutes."""
    a = spark.range(1, 13).select(F.col("id").alias("attempts"))
    return a.select("attempts", F.least(F.lit(300), 5 * F.pow(2, F.col("attempts") - 1)).cast("long").alias("seconds"))


def excluded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without documents that a component names, as one ordered array."""
    named = table(spark, sf_dir, "release_mixture").select("release_id", F.explode("source_ids").alias("source_id")).distinct()
    have = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    gone = named.join(have, "source_id", "left_anti")
    return gone.groupBy("release_id").agg(F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))


REV = "r AS (SELECT DISTINCT * FROM document_revisions)"
SCANS = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_sha256, scanner_version ORDER BY scanned_at DESC NULLS LAST, scan_id DESC) AS k, count(*) OVER (PARTITION BY object_sha256, scanner_version) AS scans FROM pii_scans WHERE object_sha256 IS NOT NULL) WHERE k = 1)"
PT = T.PROFILE_SQL.format("text")
_BODY = "coalesce(" + ", ".join(f"nullif(trim(json_extract_string(j, '$.{k}'), ' '), '')" for k in ("text", "content", "body")) + ")"
RISK_SQL = f"""WITH l AS (SELECT record_id, raw_line, starts_with(ltrim(raw_line, ' '), '{{') AS o, CASE WHEN starts_with(ltrim(raw_line, ' '), '{{') AND json_valid(raw_line) THEN raw_line END AS j FROM source_lines WHERE raw_line IS NOT NULL),
    d AS (SELECT record_id, o, j, {_BODY} AS body, coalesce({_BODY}, raw_line) AS text FROM l),
    e AS (SELECT *, length(text) AS n, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\t\\n\\f\\r\\x0b ]')) AS y FROM d),
    f AS (SELECT record_id, n < 24 AS a, n > 4000 AS b, regexp_matches(text, '[\\x00-\\x08\\x0e-\\x1b\\x7f-\\x{{0084}}\\x{{0086}}-\\x{{009f}}\\p{{Cf}}]') AS c, n >= 40 AND y * 100 > n * 35 AS d, len(list_filter(range(1, n - 6), lambda i: substr(text, i, 8) = repeat(substr(text, i, 1), 8))) > 0 AS r,
      len(w) >= 20 AND len(list_distinct(w)) * 4 < len(w) AS e, regexp_matches(text, '{IDENTIFIER}') AS g, o AND j IS NULL AS h, j IS NOT NULL AND body IS NULL AS m FROM e)
    SELECT record_id, concat_ws('|', CASE WHEN a THEN 'short_text' END, CASE WHEN b THEN 'long_text' END, CASE WHEN c THEN 'control_characters' END, CASE WHEN d THEN 'high_symbol_ratio' END, CASE WHEN r THEN 'repeated_character_run' END, CASE WHEN e THEN 'low_lexical_diversity' END,
      CASE WHEN g THEN 'identifier_pattern' END, CASE WHEN h THEN 'malformed_json' END, CASE WHEN m THEN 'missing_text_field' END) AS reasons,
      least(10, a::INT + 2*b::INT + 3*c::INT + 2*d::INT + 2*r::INT + 2*e::INT + 3*g::INT + 2*h::INT + 2*m::INT)::BIGINT AS score FROM f"""
_KEY = "sha256('2026:' || record_id)"
_TOP = f"(SELECT record_id, reasons, score FROM ({RISK_SQL}) WHERE score > 0 ORDER BY score DESC, {_KEY} DESC, record_id DESC LIMIT 25)"
STRATA_SQL = f"""WITH {REV}, g AS (SELECT coalesce(nullif(edit_reason, ''), 'none') AS stratum, count(*) AS records, coalesce(sum(length(content_text)), 0)::BIGINT AS chars, count(*) FILTER (word_count = 0) AS mistakes FROM r GROUP BY 1)
    SELECT stratum, records, chars, mistakes, round(mistakes / records::DOUBLE, 9) AS rate, round({S.WILSON_LOW.format(k="mistakes", n="records")}, 9) AS low, round({S.WILSON_HIGH.format(k="mistakes", n="records")}, 9) AS high FROM g"""
_DIMS = ["source_type", "license_id", "rights_status", "source_language", "media_type"]

QUERIES = {
    "uniform_sample": (uniform_sample, "SELECT doc_id, sha256('uniform' || chr(31) || '2026' || chr(31) || doc_id::VARCHAR) AS sample_key FROM documents ORDER BY sample_key, doc_id LIMIT 50"),
    "calibration_sample": (
        calibration_sample,
        "SELECT DISTINCT source_sha256, source_ordinal, substr(sha256(source_sha256 || ':' || source_ordinal::VARCHAR), 1, 32) AS sample_key FROM document_fingerprints WHERE source_sha256 IS NOT NULL ORDER BY sample_key, source_sha256, source_ordinal LIMIT 100",
    ),
    "stratified_audit_sample": (
        stratified_audit_sample,
        "WITH d AS (SELECT doc_id, coalesce(doc_domain, 'unknown') AS stratum, sha256('2026:' || coalesce(sha256(text), '') || ':' || doc_id::VARCHAR) AS k FROM documents), r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 5",
    ),
    "reservoir_sample": (reservoir_sample, None),
    "risk_score": (risk_score, RISK_SQL),
    "risk_top_k": (risk_top_k, f"SELECT * FROM {_TOP}"),
    "risk_reasons": (risk_reasons, f"WITH x AS (SELECT score, unnest(string_split(reasons, '|')) AS reason FROM ({RISK_SQL})) SELECT reason, count(*) AS lines, max(score) AS highest FROM x WHERE reason <> '' GROUP BY reason"),
    "combined_sample": (
        combined_sample,
        f"WITH t AS {_TOP} SELECT record_id, 'risk' AS part FROM t UNION ALL SELECT * FROM (SELECT record_id, 'fill' FROM source_lines WHERE raw_line IS NOT NULL AND record_id NOT IN (SELECT record_id FROM t) ORDER BY {_KEY}, record_id LIMIT 25)",
    ),
    "mixed_runs": (mixed_runs, "SELECT row_number() OVER (ORDER BY sha256('2026:' || scan_id), scan_id) AS no, scan_id, scanner_version FROM pii_scans WHERE object_sha256 IS NOT NULL"),
    "keyset_page": (keyset_page, "SELECT doc_id, ingested_at FROM documents WHERE ingested_at < TIMESTAMP '2026-06-01' OR (ingested_at = TIMESTAMP '2026-06-01' AND doc_id < 1000) ORDER BY ingested_at DESC, doc_id DESC LIMIT 20"),
    "latest_scan": (latest_scan, f"WITH {SCANS} SELECT object_sha256, scanner_version, scan_id, scan_status, findings, scans FROM s"),
    "latest_per_type": (latest_per_type, "SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    "review_quality": (
        review_quality,
        f"""WITH {CONTRIBUTIONS_SQL}, g AS (SELECT task_type, count(*) AS total, count(*) FILTER (review_status IN ('approved', 'rejected', 'auto_rejected')) AS reviewed, count(*) FILTER (review_status = 'approved') AS approved, count(DISTINCT contributor_id) AS contributors FROM c GROUP BY task_type)
        SELECT *, round(approved / reviewed::DOUBLE, 9) AS rate, round({S.WILSON_LOW.format(k="approved", n="reviewed")}, 9) AS low, round({S.WILSON_HIGH.format(k="approved", n="reviewed")}, 9) AS high FROM g""",
    ),
    "scanner_pairs": (
        scanner_pairs,
        f"WITH {SCANS}, p AS (SELECT object_sha256, max(scan_status) FILTER (scanner_version = 'basic-tr-v1') AS a, max(scan_status) FILTER (scanner_version = 'basic-tr-v2') AS b FROM s GROUP BY 1) SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    ),
    "scanner_agreement": (
        scanner_agreement,
        f"""WITH {SCANS}, p AS (SELECT object_sha256, max(scan_status) FILTER (scanner_version = 'basic-tr-v1') AS a, max(scan_status) FILTER (scanner_version = 'basic-tr-v2') AS b FROM s GROUP BY 1), q AS (SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
        t AS (SELECT count(*) AS pairs, count(*) FILTER (a = b) / count(*)::DOUBLE AS observed FROM q),
        e AS (SELECT coalesce(sum(x.n * y.n), 0) / ((SELECT pairs FROM t) * (SELECT pairs FROM t))::DOUBLE AS expected FROM (SELECT a, count(*) AS n FROM q GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM q GROUP BY b) y ON x.a = y.b)
        SELECT pairs, round(observed, 9) AS observed, round(expected, 9) AS expected, round(CASE WHEN expected < 1 THEN (observed - expected) / (1 - expected) END, 9) AS kappa FROM t, e WHERE pairs > 0""",
    ),
    "pair_consensus": (
        pair_consensus,
        "WITH g AS (SELECT object_sha256, count(*) AS reviews, count(DISTINCT scan_status) AS labels, min(scan_status) AS label FROM pii_scans WHERE object_sha256 IS NOT NULL AND scan_status IS NOT NULL GROUP BY 1) SELECT object_sha256, reviews, CASE WHEN labels = 1 THEN label END AS consensus, labels > 1 AS disagreement FROM g WHERE reviews >= 2",
    ),
    "stratum_scores": (stratum_scores, STRATA_SQL),
    "overall_rate": (overall_rate, f"SELECT round(sum(chars * mistakes / records::DOUBLE) / sum(chars), 9) AS rate, round(sum(chars)::DOUBLE * sum(chars) / sum(chars * chars / records::DOUBLE), 6) AS effective_n FROM ({STRATA_SQL}) WHERE chars > 0"),
    "row_changes": (
        row_changes,
        f"""WITH {REV}, b AS (SELECT revision_id, sha256(content_text) AS content, edit_reason, char_count, word_count, lag(sha256(content_text)) OVER w AS o1, lag(edit_reason) OVER w AS o2, lag(char_count) OVER w AS o3, lag(word_count) OVER w AS o4, lag(revision_id) OVER w AS oid FROM r WINDOW w AS (PARTITION BY document_id ORDER BY document_version, revision_id))
        SELECT revision_id, CASE WHEN oid IS NULL THEN 'insert' ELSE 'update' END AS operation, CASE WHEN oid IS NOT NULL THEN concat_ws(',', CASE WHEN content IS DISTINCT FROM o1 THEN 'content' END, CASE WHEN edit_reason IS DISTINCT FROM o2 THEN 'edit_reason' END, CASE WHEN char_count IS DISTINCT FROM o3 THEN 'char_count' END, CASE WHEN word_count IS DISTINCT FROM o4 THEN 'word_count' END) END AS changed_columns FROM b""",
    ),
    "stored_count_drift": (stored_count_drift, f"WITH {REV} SELECT source_id, count(*) AS revisions, count(*) FILTER (char_count IS DISTINCT FROM length(content_text)) AS drifted, count(*) FILTER (char_count IS NULL) AS missing FROM r GROUP BY source_id"),
    "mixture_report": (
        mixture_report,
        "WITH s AS (SELECT source_id, source_version, " + ", ".join(f"max({c}) AS {c}" for c in [*_DIMS, "byte_size", "line_count"]) + " FROM release_sources GROUP BY 1, 2), g AS ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({d}, 'unknown') AS value, count(*) AS sources, coalesce(sum(byte_size), 0)::BIGINT AS bytes, coalesce(sum(line_count), 0)::BIGINT AS lines FROM s GROUP BY {d}" for d in _DIMS)
        + ") SELECT *, ((bytes * 10000 + sum(bytes) OVER (PARTITION BY dimension) // 2) // sum(bytes) OVER (PARTITION BY dimension))::BIGINT AS share_points FROM g",
    ),
    "status_mixture": (
        status_mixture,
        f"WITH {CONTRIBUTIONS_SQL}, t AS (" + " UNION ALL ".join(f"SELECT review_status, '{d}' AS dimension, coalesce({d}, 'unknown') AS value FROM c" for d in ("item_language", "item_domain", "task_type"))
        + ") SELECT dimension, value, count(*) AS items, count(*) FILTER (review_status = 'approved') AS approved, count(*) FILTER (review_status IN ('rejected', 'auto_rejected')) AS rejected FROM t GROUP BY ALL",
    ),
    "membership_root": (membership_root, "SELECT release_id, count(*) AS members, sha256(string_agg(sha256(release_id || '|' || mixture_name || '|' || array_to_string(source_ids, ',')), '' ORDER BY mixture_name)) AS root FROM release_mixture GROUP BY release_id"),
    "retry_delay": (retry_delay, "SELECT a AS attempts, least(300, 5 * pow(2, a - 1))::BIGINT AS seconds FROM range(1, 13) t(a)"),
    "excluded_sources": (excluded_sources, "WITH n AS (SELECT DISTINCT release_id, unnest(source_ids) AS s FROM release_mixture) SELECT release_id, string_agg(s, ',' ORDER BY s) AS sources FROM n WHERE s NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY release_id"),
}
