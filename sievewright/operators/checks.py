"""Validation, coverage, drift and bundling of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.review import CONTRIBUTIONS_SQL, contributions, revisions
from sievewright.tables import once, positions, table


def named(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_join(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull()), "|")


def document_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken fields of each document, as codes in a fixed order."""
    tests = {
        "text_missing": F.coalesce(F.trim("text"), F.lit("")) == "",
        "ordinal": F.col("source_ordinal").isNull() | (F.col("source_ordinal") < 1),
        "chars": F.col("text").isNotNull() & ~F.col("n_chars").eqNullSafe(F.char_length("text").cast("long")),
        "language": F.col("lang").isNotNull() & ~F.col("lang").rlike("^[a-z]{2,3}(-[A-Za-z]{2})?$"),
        "url": F.col("url").isNotNull() & ~F.col("url").rlike("^https?://[^/ ]+(/[^ ]*)?$"),
        "times": F.col("ingested_at") < F.col("crawled_at"),
    }
    return table(spark, sf_dir, "documents").select("doc_id", named(tests).alias("problems"))


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "documents").where("url is not null").select(F.call_function("parse_url", "url", F.lit("HOST")).alias("host"), "source")
    return u.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


def json_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in JSON lines and whether the closed schema knows them."""
    known = ["text", "url", "title", "date", "domain"]
    j = table(spark, sf_dir, "source_lines").where(F.col("raw_line").startswith("{") & F.col("raw_line").endswith("}"))
    names = j.select(F.explode(F.array_distinct(F.json_object_keys("raw_line"))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("lines")).select("name", "lines", F.col("name").isin(*known).alias("known"))


def line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("raw_line")
    form = F.when(x.startswith("{") & x.endswith("}"), "json").when(x.startswith("{"), "unfinished").when(x.rlike(r"^[A-Za-z_]+="), "pairs").otherwise("plain")
    return table(spark, sf_dir, "source_lines").where("raw_line is not null").groupBy("source_id", form.alias("form")).agg(F.count(F.lit(1)).alias("lines"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came in more than a day after they were observed, by source."""
    late = (F.unix_micros("ingested_at") - F.unix_micros("observed_at")) > 86_400_000_000
    return table(spark, sf_dir, "source_lines").groupBy("source_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("observed_at").isNull()).alias("unobserved"), F.count_if(late).alias("late"))


def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without scan, scans without text, and both, as set operations on hashes."""
    have = revisions(spark, sf_dir).where("content_text is not null").select(F.sha2("content_text", 256).alias("h")).distinct()
    scanned = table(spark, sf_dir, "pii_scans").where("object_sha256 is not null").select(F.col("object_sha256").alias("h")).distinct()
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("objects")).select(F.lit(name).alias("kind"), "objects")
    return count(have.subtract(scanned), "unscanned").unionByName(count(scanned.subtract(have), "unknown")).unionByName(count(have.intersect(scanned), "scanned"))


def occurrence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans matched to revisions of the same text, n-th to n-th; a hot text is numbered by ranges."""
    r = revisions(spark, sf_dir).where("content_text is not null").select("revision_id", F.sha2("content_text", 256).alias("h"))
    s = table(spark, sf_dir, "pii_scans").where("object_sha256 is not null").select("scan_id", F.col("object_sha256").alias("h"))
    r, s = positions(r, "h", ["revision_id"], "k"), positions(s, "h", ["scan_id"], "k")
    return s.join(r, ["h", "k"]).select("scan_id", "revision_id")


def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that differ, null-safe, between consecutive versions of a source."""
    columns = ["license_id", "rights_status", "source_language", "source_domain", "byte_size", "line_count", "media_type"]
    s = table(spark, sf_dir, "release_sources").groupBy("source_id", "source_version").agg(*(F.max(c).alias(c) for c in columns))
    w = Window.partitionBy("source_id").orderBy("source_version")
    both = s.select("source_id", "source_version", F.lag("source_version").over(w).alias("before"), *columns, *(F.lag(c).over(w).alias(f"old_{c}") for c in columns))
    return both.where("before is not null").select("source_id", "source_version", named({c: ~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in columns}).alias("drifted"))


VERDICTS = {"approved": "keep", "rejected": "drop", "auto_rejected": "drop", "sensitive_review": "unsure", "needs_review": "unsure", "submitted": "open"}


def normalized_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    verdict = F.coalesce(pairs[F.lower(F.trim("review_status"))], F.lit("unknown"))
    return contributions(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("contributor_id").alias("contributors"))


def contributor_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of a contributor's items are dated, reviewed and of one language."""
    c = contributions(spark, sf_dir).where("contributor_id is not null")
    g = c.groupBy("contributor_id").agg(
        F.count(F.lit(1)).alias("items"), F.bool_and(F.col("created_at").isNotNull() & (F.col("updated_at") >= F.col("created_at"))).alias("dated"),
        F.bool_and(F.col("review_status").isin("approved", "rejected", "auto_rejected")).alias("reviewed"), F.count_distinct("item_language").alias("languages"),
    )
    return g.select("contributor_id", "items", (F.coalesce("dated", F.lit(False)) & F.coalesce("reviewed", F.lit(False)) & (F.col("languages") == 1)).alias("valid"))


def drop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected items of each task type: count, rate in hundredths of a percent, and a sum over their ids' hashes."""
    c = contributions(spark, sf_dir).select("task_type", "contribution_id", F.col("review_status").isin("rejected", "auto_rejected").alias("bad"))
    part = F.conv(F.substring(F.sha2("contribution_id", 256), 1, 8), 16, 10).cast("long")  # a sum of hashes needs no list of ids
    g = c.groupBy("task_type").agg(F.count(F.lit(1)).alias("items"), F.count_if("bad").alias("dropped"), F.coalesce(F.sum(F.when(F.col("bad"), part)), F.lit(0)).alias("ids_sum"))
    return g.select("task_type", "items", "dropped", T.basis_points(F.col("dropped"), F.col("items")).alias("points"), "ids_sum")


def anchor_rows(spark: SparkSession, sf_dir: str, size: int = 30) -> DataFrame:
    """Longest approved and rejected items in turn."""
    c = table(spark, sf_dir, "contributions").where("review_status in ('approved', 'rejected') and output_text is not null").groupBy("contribution_id").agg(F.max("review_status").alias("class"), F.max(F.char_length("output_text")).alias("n"))
    turn = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "contribution_id"))  # two classes; the limit below keeps few a task
    return c.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", "class").limit(size).select("contribution_id", "class", F.col("turn").cast("long").alias("turn"))


def capped_evidence(spark: SparkSession, sf_dir: str, cap: int = 3) -> DataFrame:
    """First lines of each repeated text, with the exact number of lines and an overflow flag."""
    f = table(spark, sf_dir, "document_fingerprints").where("normalized_sha256 is not null").select("normalized_sha256", "source_id", "source_ordinal").distinct()
    n = f.groupBy("normalized_sha256").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    w = Window.partitionBy("normalized_sha256").orderBy("source_id", "source_ordinal")
    top = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return top.join(n, "normalized_sha256").select("normalized_sha256", "source_id", "source_ordinal", F.col("rank").cast("long").alias("rank"), "lines", (F.col("lines") > cap).alias("overflow"))


def prompt_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt for each component and kind, by templates."""
    m = table(spark, sf_dir, "release_mixture").select("release_id", "mixture_name", F.coalesce("mixture_domain", F.lit("")).alias("topic"))
    kinds = F.explode(F.array(F.lit("Explain {topic} briefly."), F.lit("Ask about {topic}."))).alias("template")
    return m.select("release_id", "mixture_name", "topic", kinds).select("release_id", "mixture_name", F.replace("template", F.lit("{topic}"), F.col("topic")).alias("prompt"))


def bundled_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved items as one-turn conversations in JSON."""
    c = table(spark, sf_dir, "contributions").where("review_status = 'approved' and input_text is not null and output_text is not null").dropDuplicates(["contribution_id"])
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    line = F.to_json(F.struct(F.col("contribution_id").alias("id"), F.array(message("user", "input_text"), message("assistant", "output_text")).alias("messages")))
    d = once(c.select("contribution_id", line.alias("line")), "b", F.from_json("line", "struct<id:string,messages:array<struct<role:string,content:string>>>"))
    return d.select("contribution_id", F.md5(F.col("b.messages")[0]["content"]).alias("input_md5"), F.md5(F.col("b.messages")[1]["content"]).alias("output_md5"), F.size("b.messages").cast("long").alias("messages"))


def last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last error before it, as of its time (an extension)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w).alias("error_id"))
    return e.where("event_type = 'click'").select("event_id", "error_id")


REV = "r AS (SELECT DISTINCT * FROM document_revisions)"
_C = ["license_id", "rights_status", "source_language", "source_domain", "byte_size", "line_count", "media_type"]

QUERIES = {
    "document_validation": (
        document_validation,
        """SELECT doc_id, concat_ws('|', CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'text_missing' END, CASE WHEN source_ordinal IS NULL OR source_ordinal < 1 THEN 'ordinal' END, CASE WHEN text IS NOT NULL AND n_chars IS DISTINCT FROM length(text) THEN 'chars' END,
        CASE WHEN lang IS NOT NULL AND NOT regexp_matches(lang, '^[a-z]{2,3}(-[A-Za-z]{2})?$') THEN 'language' END, CASE WHEN url IS NOT NULL AND NOT regexp_matches(url, '^https?://[^/ ]+(/[^ ]*)?$') THEN 'url' END, CASE WHEN ingested_at < crawled_at THEN 'times' END) AS problems FROM documents""",
    ),
    "url_hosts": (url_hosts, "SELECT regexp_extract(url, '^https?://([^/:]+)', 1) AS host, count(*) AS documents, count(DISTINCT source) AS sources FROM documents WHERE url IS NOT NULL GROUP BY 1"),
    "json_names": (
        json_names,
        "WITH j AS (SELECT unnest(list_distinct(json_keys(CASE WHEN json_valid(raw_line) THEN raw_line END))) AS name FROM source_lines WHERE starts_with(raw_line, '{') AND ends_with(raw_line, '}')) SELECT name, count(*) AS lines, name IN ('text', 'url', 'title', 'date', 'domain') AS known FROM j GROUP BY name",
    ),
    "line_forms": (
        line_forms,
        "SELECT source_id, CASE WHEN starts_with(raw_line, '{') AND ends_with(raw_line, '}') THEN 'json' WHEN starts_with(raw_line, '{') THEN 'unfinished' WHEN regexp_matches(raw_line, '^[A-Za-z_]+=') THEN 'pairs' ELSE 'plain' END AS form, count(*) AS lines FROM source_lines WHERE raw_line IS NOT NULL GROUP BY ALL",
    ),
    "late_rows": (late_rows, "SELECT source_id, count(*) AS lines, count(*) FILTER (observed_at IS NULL) AS unobserved, count(*) FILTER (epoch_us(ingested_at) - epoch_us(observed_at) > 86400000000) AS late FROM source_lines GROUP BY source_id"),
    "scan_coverage": (
        scan_coverage,
        f"WITH {REV}, h AS (SELECT DISTINCT sha256(content_text) AS h FROM r WHERE content_text IS NOT NULL), s AS (SELECT DISTINCT object_sha256 AS h FROM pii_scans WHERE object_sha256 IS NOT NULL) SELECT 'unscanned' AS kind, count(*) AS objects FROM (FROM h EXCEPT FROM s) UNION ALL SELECT 'unknown', count(*) FROM (FROM s EXCEPT FROM h) UNION ALL SELECT 'scanned', count(*) FROM (FROM h INTERSECT FROM s)",
    ),
    "occurrence_match": (
        occurrence_match,
        f"WITH {REV}, a AS (SELECT revision_id, sha256(content_text) AS h, row_number() OVER (PARTITION BY sha256(content_text) ORDER BY revision_id) AS k FROM r WHERE content_text IS NOT NULL), b AS (SELECT scan_id, object_sha256 AS h, row_number() OVER (PARTITION BY object_sha256 ORDER BY scan_id) AS k FROM pii_scans WHERE object_sha256 IS NOT NULL) SELECT scan_id, revision_id FROM b JOIN a USING (h, k)",
    ),
    "source_drift": (
        source_drift,
        "WITH s AS (SELECT source_id, source_version, " + ", ".join(f"max({c}) AS {c}" for c in _C) + " FROM release_sources GROUP BY 1, 2), b AS (SELECT *, lag(source_version) OVER w AS before, " + ", ".join(f"lag({c}) OVER w AS old_{c}" for c in _C)
        + " FROM s WINDOW w AS (PARTITION BY source_id ORDER BY source_version)) SELECT source_id, source_version, concat_ws('|', " + ", ".join(f"CASE WHEN {c} IS DISTINCT FROM old_{c} THEN '{c}' END" for c in _C) + ") AS drifted FROM b WHERE before IS NOT NULL",
    ),
    "normalized_verdicts": (
        normalized_verdicts,
        f"WITH {CONTRIBUTIONS_SQL} SELECT CASE lower(trim(review_status)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICTS.items()) + " ELSE 'unknown' END AS verdict, count(*) AS items, count(DISTINCT contributor_id) AS contributors FROM c GROUP BY 1",
    ),
    "contributor_validity": (
        contributor_validity,
        f"WITH {CONTRIBUTIONS_SQL} SELECT contributor_id, count(*) AS items, coalesce(bool_and(created_at IS NOT NULL AND updated_at >= created_at), false) AND coalesce(bool_and(review_status IN ('approved', 'rejected', 'auto_rejected')), false) AND count(DISTINCT item_language) = 1 AS valid FROM c WHERE contributor_id IS NOT NULL GROUP BY 1",
    ),
    "drop_list": (
        drop_list,
        f"WITH {CONTRIBUTIONS_SQL}, g AS (SELECT task_type, count(*) AS items, count(*) FILTER (review_status IN ('rejected', 'auto_rejected')) AS dropped, coalesce(sum(('0x' || substr(sha256(contribution_id), 1, 8))::BIGINT) FILTER (review_status IN ('rejected', 'auto_rejected')), 0)::BIGINT AS ids_sum FROM c GROUP BY 1) SELECT task_type, items, dropped, ((dropped * 10000 + items // 2) // items)::BIGINT AS points, ids_sum FROM g",
    ),
    "anchor_rows": (
        anchor_rows,
        "WITH c AS (SELECT contribution_id, max(review_status) AS class, max(length(output_text)) AS n FROM contributions WHERE review_status IN ('approved', 'rejected') AND output_text IS NOT NULL GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY n DESC, contribution_id) AS turn FROM c) SELECT contribution_id, class, turn FROM t ORDER BY turn, class LIMIT 30",
    ),
    "capped_evidence": (
        capped_evidence,
        "WITH f AS (SELECT DISTINCT normalized_sha256, source_id, source_ordinal FROM document_fingerprints WHERE normalized_sha256 IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY normalized_sha256 ORDER BY source_id, source_ordinal) AS rank, count(*) OVER (PARTITION BY normalized_sha256) AS lines FROM f) SELECT *, lines > 3 AS overflow FROM t WHERE lines > 1 AND rank <= 3",
    ),
    "prompt_fanout": (prompt_fanout, "SELECT release_id, mixture_name, replace(t, '{topic}', coalesce(mixture_domain, '')) AS prompt FROM release_mixture, (VALUES ('Explain {topic} briefly.'), ('Ask about {topic}.')) v(t)"),
    "bundled_contributions": (
        bundled_contributions,
        "SELECT DISTINCT contribution_id, md5(input_text) AS input_md5, md5(output_text) AS output_md5, 2::BIGINT AS messages FROM (SELECT *, row_number() OVER (PARTITION BY contribution_id) AS k FROM contributions WHERE review_status = 'approved' AND input_text IS NOT NULL AND output_text IS NOT NULL) WHERE k = 1",
    ),
    "last_error": (
        last_error,
        "WITH e AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_id FROM events) SELECT event_id, error_id FROM e WHERE event_type = 'click'",
    ),
}
