"""Reviews in effect, occurrences, crosstabs, merged reports, snapshots and set operations over decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import stats as S
from sievewright.functions import text as T
from sievewright.operators.candidates import STAGED, drop_list, staged
from sievewright.operators.dedup import _NEAR, closest_pairs, edges, revision_texts, signatures
from sievewright.operators.review import CONTRIBUTIONS_SQL, REV, contributions, latest_scan, revisions, round9, stratum_scores
from sievewright.tables import once, spread, table


def named(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order, joined by bars."""
    return F.array_join(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull()), "|")


def named_sql(tests: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + ")"


def fingerprint_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of fingerprint records that break a rule of their form, by source."""
    hexed = r"^[0-9a-f]{64}$"
    bad = {
        "source_hash": ~F.coalesce(F.col("source_sha256").rlike(hexed), F.lit(False)), "text_hash": ~F.coalesce(F.col("normalized_sha256").rlike(hexed), F.lit(False)), "ordinal": F.coalesce(F.col("source_ordinal") < 1, F.lit(True)),
        "short": F.coalesce(F.col("normalized_char_count") < T.LEAST_CHARS, F.lit(True)), "undated": F.col("created_at").isNull(),
    }
    return table(spark, sf_dir, "document_fingerprints").select("source_id", named(bad).alias("problems")).where("problems <> ''").groupBy("source_id", "problems").agg(F.count(F.lit(1)).alias("lines"))


_BAD = {
    "source_hash": "NOT coalesce(regexp_matches(source_sha256, '^[0-9a-f]{64}$'), false)", "text_hash": "NOT coalesce(regexp_matches(normalized_sha256, '^[0-9a-f]{64}$'), false)", "ordinal": "coalesce(source_ordinal < 1, true)",
    "short": "coalesce(normalized_char_count < 32, true)", "undated": "created_at IS NULL",
}


def mixture_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each component's input, as names in a fixed order, and the release's sum of shares."""
    have = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).where("id is not null").distinct()
    m = table(spark, sf_dir, "release_mixture")
    gone = m.select("release_id", "mixture_name", F.explode("source_ids").alias("id")).join(have, "id", "left_anti").groupBy("release_id", "mixture_name").agg(F.count_distinct("id").alias("gone"))
    bad = {
        "share": F.coalesce(~F.col("target_share").between(0, 1), F.lit(True)), "no_weight": F.col("sample_weight").isNull(), "repeats": F.coalesce(F.col("max_repeats") < 1, F.lit(True)), "no_sources": F.coalesce(F.size("source_ids") < 1, F.lit(True)),
        "same_source": F.size("source_ids") > F.size(F.array_distinct("source_ids")), "without_documents": F.coalesce(F.col("gone") > 0, F.lit(False)),
    }
    j = m.join(gone, ["release_id", "mixture_name"], "left")
    return j.select("release_id", "mixture_name", named(bad).alias("problems"), round9(F.sum("target_share").over(Window.partitionBy("release_id"))).alias("release_share"))  # a configuration table


_BAD_MIXTURE = {
    "share": "coalesce(NOT target_share BETWEEN 0 AND 1, true)", "no_weight": "sample_weight IS NULL", "repeats": "coalesce(max_repeats < 1, true)", "no_sources": "coalesce(len(source_ids) < 1, true)",
    "same_source": "len(source_ids) > len(list_distinct(source_ids))", "without_documents": "coalesce(gone > 0, false)",
}


def effective_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses that no later delivery of the same item has replaced, by status."""
    c = table(spark, sf_dir, "contributions").select("contribution_id", "review_status", "updated_at").where("updated_at is not null").distinct()
    later = c.groupBy("contribution_id").agg(F.max("updated_at").alias("last"))
    replaced = c.join(later, (c["contribution_id"] == later["contribution_id"]) & (c["updated_at"] < later["last"]), "left_semi")
    stands = c.join(replaced, ["contribution_id", "review_status", "updated_at"], "left_anti")
    return stands.groupBy("review_status").agg(F.count(F.lit(1)).alias("reviews"), F.count_distinct("contribution_id").alias("items"))


def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest edit of each document under a named reason."""
    r = revisions(spark, sf_dir).where("edit_reason is not null and edit_reason <> ''")
    newest = F.max_by(F.struct("revision_id", "edit_reason", "document_version"), F.struct("edited_at", "revision_id")).alias("r")
    return r.groupBy("document_id").agg(newest, F.count(F.lit(1)).alias("edits")).select("document_id", "r.*", "edits")


def component_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters that each component can draw on; sources are aggregated before they are joined."""
    per = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    m = table(spark, sf_dir, "release_mixture").select("release_id", "mixture_name", F.explode_outer(F.array_distinct("source_ids")).alias("id"))
    return m.join(per, "id", "left").groupBy("release_id", "mixture_name").agg(F.count("id").alias("sources"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export of each source without the texts of a drop list: all their occurrences are taken out, whatever their ids."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("source", F.sha2("text", 256).alias("sha"))
    j = d.join(drop_list(spark, sf_dir), "sha", "left")
    return j.groupBy("source").agg(F.count_if(F.col("drop_reason").isNull()).alias("exported"), F.count_if(F.col("drop_reason").isNotNull()).alias("excluded"))


def dropped_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the lines that were never observed, and how often and in how many sources each occurs."""
    lines = spread(table(spark, sf_dir, "source_lines").where("raw_line is not null")).select("record_id", "source_id", "observed_at", F.sha2("raw_line", 256).alias("sha"))
    picked = lines.where("observed_at is null").groupBy("sha").agg(F.min("record_id").alias("first_id"))
    every = lines.join(picked, "sha", "left_semi").groupBy("sha").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("source_id").alias("sources"))
    return picked.join(every, "sha").select("first_id", "occurrences", "sources")


def duplicate_preview(spark: SparkSession, sf_dir: str, size: int = 60) -> DataFrame:
    """Each duplicate beside the document it repeats: a preview of both (a report's feature) and whether they are equal to the letter."""
    dup = staged(spark, sf_dir).where("stage = 'duplicate'").select("doc_id", "duplicate_of")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = dup.join(d, "doc_id").select("doc_id", "duplicate_of", F.col("text").alias("own"))
    both = own.join(d.select(F.col("doc_id").alias("duplicate_of"), F.col("text").alias("first")), "duplicate_of")
    return both.select("doc_id", "duplicate_of", F.substring("own", 1, size).alias("preview"), F.substring("first", 1, size).alias("first_preview"), (F.col("own") == F.col("first")).alias("equal"))


def rule_scan_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's outcome against a scanner's status, text by text."""
    rule = revisions(spark, sf_dir).where("content_text is not null").select(F.sha2("content_text", 256).alias("h"), F.when(F.col("content_text").rlike("[0-9]{10}"), "digits").otherwise("none").alias("rule")).distinct()
    s = latest_scan(spark, sf_dir).select(F.col("object_sha256").alias("h"), "scanner_version", "scan_status")
    return rule.join(s, "h").groupBy("rule", "scanner_version", "scan_status").agg(F.count(F.lit(1)).alias("objects"))


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each item, newest first: a change where it was changed later, else its creation."""
    c = table(spark, sf_dir, "contributions").select("contribution_id", "review_status", "created_at", "updated_at").distinct()
    when = F.coalesce("updated_at", "created_at")
    w = Window.partitionBy("contribution_id").orderBy(F.desc_nulls_last("at"), "review_status", F.desc_nulls_last("created_at"))
    return c.withColumn("at", when).select("contribution_id", "review_status", "at", F.row_number().over(w).cast("long").alias("place"))


def valid_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of each source that is cleared and that no later version blocks."""
    s = table(spark, sf_dir, "release_sources").groupBy("source_id", "source_version").agg(F.max("rights_status").alias("rights_status"), F.max("license_id").alias("license_id"))
    ok = s.where("rights_status = 'cleared' and license_id is not null")
    bad = s.where("rights_status = 'blocked'").select(F.col("source_id").alias("b"), F.col("source_version").alias("v"))
    left = ok.join(bad, (F.col("source_id") == F.col("b")) & (F.col("v") > F.col("source_version")), "left_anti")
    return left.groupBy("source_id").agg(F.max_by(F.struct("source_version", "license_id"), "source_version").alias("s")).select("source_id", "s.source_version", "s.license_id")


def pair_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest pairs with both sides fetched again: distance by new signatures, and a preview of both texts."""
    pairs = closest_pairs(spark, sf_dir)
    texts = revision_texts(spark, sf_dir)
    ids = pairs.select(F.explode(F.array("left_id", "right_id")).alias("doc_id")).distinct()
    again = signatures(texts.join(ids, "doc_id", "left_semi"), "doc_id")
    side = lambda n: again.select(F.col("doc_id").alias(f"{n}_id"), F.col("signature").alias(f"{n}_s"))
    j = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    new = T.hamming(F.col("left_s"), F.col("right_s")).cast("long")
    return j.groupBy("distance").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(new == F.col("distance")).alias("verified"))


def orphan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that only blocked sources refer to, and those kept because another refers to them too."""
    s = table(spark, sf_dir, "release_sources").where("source_sha256 is not null").groupBy("source_id", "source_version", "source_sha256").agg(F.max("rights_status").alias("r"))
    purged = s.where("r = 'blocked'").select("source_sha256").distinct()
    others = s.where("r <> 'blocked' or r is null").select("source_sha256").union(table(spark, sf_dir, "document_fingerprints").select("source_sha256")).where("source_sha256 is not null").distinct()
    gone = purged.join(others, "source_sha256", "left_anti").select("source_sha256", F.lit("orphan").alias("outcome"))
    return gone.unionByName(purged.join(others, "source_sha256", "left_semi").select("source_sha256", F.lit("referenced").alias("outcome")))


def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by domain and band of length, with the mean length in thousandths."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    band = F.when(n < 200, "short").when(n < 1000, "middle").otherwise("long")
    g = table(spark, sf_dir, "documents").groupBy(F.coalesce("doc_domain", F.lit("unknown")).alias("domain_name"), band.alias("band")).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("chars"))
    return g.select("domain_name", "band", "documents", "chars", F.floor((F.col("chars") * 1000 + F.floor(F.col("documents") / 2)) / F.col("documents")).cast("long").alias("mean_milli"))


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over the ordered lines of each release's table, each line ended by a line feed."""
    line = F.concat_ws("\t", "mixture_name", F.coalesce("mixture_domain", F.lit("")), F.array_join("source_ids", ","), F.coalesce(F.col("max_repeats").cast("string"), F.lit("")))
    m = table(spark, sf_dir, "release_mixture").select("release_id", F.struct(F.col("mixture_name").alias("k"), line.alias("line")).alias("x"))
    ordered = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n"), F.lit("\n"))  # a configuration table
    return m.groupBy("release_id").agg(F.count(F.lit(1)).alias("lines"), F.sha2(ordered, 256).alias("snapshot"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by condition and means of the stored counts of each source's revisions."""
    r = revisions(spark, sf_dir)
    g = r.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("revisions"), F.count_distinct("document_id").alias("documents"), F.count_if(F.col("edit_reason").isNotNull() & (F.col("edit_reason") != "")).alias("explained"),
        F.count_if(F.col("received_at") > F.col("edited_at") + F.expr("interval 1 day")).alias("late"), F.avg("char_count").alias("c"), F.avg("word_count").alias("w"), F.avg(F.when(F.col("document_version") > 1, F.col("char_count"))).alias("again"),
    )
    return g.select("source_id", "revisions", "documents", "explained", "late", round9("c").alias("mean_chars"), round9("w").alias("mean_words"), round9("again").alias("mean_chars_of_later"))


def item_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of items turned down, with and without the undecided, of each task type with its interval."""
    c = contributions(spark, sf_dir).groupBy("task_type").agg(
        F.count_if(F.col("review_status").isin("rejected", "auto_rejected")).alias("junk"), F.count_if(F.col("review_status").isin("needs_review", "sensitive_review")).alias("unsure"), F.count_if(F.col("review_status") != "submitted").alias("judged"),
    )
    w = S.wilson(F.col("junk") + F.col("unsure"), F.col("judged"))
    return c.select("task_type", "junk", "unsure", "judged", round9((F.col("junk") + F.col("unsure")) / F.col("judged")).alias("rate"), round9(F.col("junk") / F.col("judged")).alias("strict_rate"), round9(w["low"]).alias("low"), round9(w["high"]).alias("high"))


def four_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, rules, scanners and reviewers in one report: cases and judged of each."""
    d = staged(spark, sf_dir).agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.size("personal") > 0).alias("p"), F.count_if(F.size("reasons") > 0).alias("r"))
    own = d.select(F.explode(F.array(F.struct(F.lit("personal_data").alias("measure"), F.col("p").alias("cases"), "judged"), F.struct(F.lit("rules").alias("measure"), F.col("r").alias("cases"), "judged"))).alias("x")).select("x.*")
    s = latest_scan(spark, sf_dir).where("scan_status <> 'not_evaluated'").agg(F.count_if(F.col("scan_status") == "flagged").alias("cases"), F.count(F.lit(1)).alias("judged")).select(F.lit("scanners").alias("measure"), "cases", "judged")
    c = contributions(spark, sf_dir).where("review_status <> 'submitted'").agg(F.count_if(F.col("review_status").isin("rejected", "auto_rejected")).alias("cases"), F.count(F.lit(1)).alias("judged")).select(F.lit("reviewers").alias("measure"), "cases", "judged")
    return own.unionByName(s).unionByName(c).select("measure", "cases", "judged", T.basis_points(F.col("cases"), F.col("judged")).alias("points"))


def merged_reports(spark: SparkSession, sf_dir: str, samples: int = 100) -> DataFrame:
    """Reports of all sources merged by form of line: sums, the union of sources, and the first records as samples."""
    form = F.when(F.col("raw_line").startswith("{"), "json").when(F.col("raw_line").contains("\t"), "fields").otherwise("plain")
    d = table(spark, sf_dir, "source_lines").where("raw_line is not null").select(form.alias("form"), "source_id", "record_id", F.octet_length("raw_line").cast("long").alias("bytes"))
    sums = d.groupBy("form").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))  # a set of sources, not of lines
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy("record_id"))).where(F.col("k") <= samples)  # a group limit: each task keeps so many rows a form
    return sums.join(first.groupBy("form").agg(F.max("record_id").alias("last_sample"), F.count(F.lit(1)).alias("samples")), "form")


def top_strata(spark: SparkSession, sf_dir: str, size: int = 3) -> DataFrame:
    """The strata that contribute most mistakes (a top-k report)."""
    return stratum_scores(spark, sf_dir).orderBy(F.desc("mistakes"), F.desc("records"), "stratum").limit(size).select("stratum", "mistakes", "records")


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest pairs numbered by distance, then ids."""
    return closest_pairs(spark, sf_dir).select("left_id", "right_id", "distance", F.row_number().over(Window.orderBy("distance", "left_id", "right_id")).cast("long").alias("rank"))  # the hundred rows of a report


def decision_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the candidate pass and of the later drops as one list, each document's in order."""
    made = staged(spark, sf_dir).where("stage <> 'kept'").select("doc_id", F.col("stage").alias("decision_type"), F.lit("pass").alias("run"))
    later = table(spark, sf_dir, "token_estimates").where("estimated_token_count > 500").select("doc_id", F.lit("oversized_estimate").alias("decision_type"), F.lit("drop").alias("run")).distinct()
    both = made.unionByName(later)
    return both.select("doc_id", "decision_type", "run", F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "decision_type")).cast("long").alias("place"))  # few decisions a document


def selection_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a later drop is refused: unknown document, one that was held out, one already decided, one listed twice."""
    drops = table(spark, sf_dir, "token_estimates").where("estimated_token_count > 500").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    j = drops.join(staged(spark, sf_dir).select("doc_id", "stage", "partition"), "doc_id", "left")
    bad = {"unknown": F.col("stage").isNull(), "held_out": F.coalesce(F.col("partition") == "held_out", F.lit(False)), "decided": F.coalesce(F.col("stage") != "kept", F.lit(False)), "twice": F.col("n") > 1}
    return j.select("doc_id", named(bad).alias("refused")).where("refused <> ''")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two kinds, once each: sources mixed together and versions that refer to an earlier one."""
    own = table(spark, sf_dir, "release_sources").select(F.regexp_extract("lineage_ref", "^lineage/([^/]+)/v", 1).alias("parent_id"), F.col("source_id").alias("child_id"), F.lit("reference").alias("kind")).where("parent_id <> ''")
    return edges(spark, sf_dir).select("parent_id", "child_id", F.lit("mixture").alias("kind")).union(own).distinct()


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in small letters with i and ı apart, and in plain letters."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(T.fold_turkish(F.col("text"))).alias("folded_md5"), F.md5(T.fold_ascii(F.col("text"))).alias("plain_md5"))


def shown_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target share in hundredths of a percent, shown and read back."""
    points = F.round(F.col("target_share") * 10000).cast("long")
    m = table(spark, sf_dir, "release_mixture").where("target_share is not null").select("release_id", "mixture_name", points.alias("points"), T.format_points(points).alias("shown"))
    return m.withColumn("read_back", (F.col("shown").cast("decimal(7,2)") * 100).cast("long"))


def extracted_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON object within a line, however much stands around it, and its number of fields; null where it is none."""
    found = F.regexp_extract("raw_line", r"(?s)\{.*\}", 0)
    d = once(table(spark, sf_dir, "source_lines").where("raw_line is not null").select("record_id", found.alias("found")), "fields", F.when(F.try_parse_json("found").isNotNull(), F.size(F.json_object_keys("found"))))
    return d.where("found <> ''").select("record_id", F.md5("found").alias("object_md5"), F.col("fields").cast("long").alias("fields"))


def differing_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose answer says the same as their question once case and white space are set aside, by task type."""
    c = table(spark, sf_dir, "contributions").select("contribution_id", "task_type", "input_text", "output_text").dropDuplicates(["contribution_id"])
    same = T.profile_text(F.col("input_text")).eqNullSafe(T.profile_text(F.col("output_text")))
    return c.groupBy("task_type").agg(F.count(F.lit(1)).alias("items"), F.count_if(same).alias("same"))


def line_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the lines' addresses: the line's own url, else that of its provenance."""
    url = F.coalesce(F.get_json_object("raw_line", "$.url"), F.get_json_object("raw_line", "$.provenance.url"))
    d = table(spark, sf_dir, "source_lines").where(F.col("raw_line").startswith("{") & F.col("raw_line").rlike(r"\}\s*$")).select(F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"))
    return d.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("lines"))


def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in lines: canonical microsecond times, plain days that exist, and others, by source."""
    date = F.get_json_object("raw_line", "$.date")
    form = F.when(date.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$") & F.try_to_timestamp(date).isNotNull(), "canonical").when(date.rlike(r"^\d{4}-\d\d-\d\d$") & date.try_cast("date").isNotNull(), "day").otherwise("other")
    d = table(spark, sf_dir, "source_lines").where(F.col("raw_line").startswith("{") & F.col("raw_line").rlike(r"\}\s*$") & date.isNotNull())
    return d.groupBy("source_id", form.alias("form")).agg(F.count(F.lit(1)).alias("lines"))


_JSON = "starts_with(raw_line, '{') AND json_valid(raw_line)"
_ST = f"WITH RECURSIVE {STAGED}"
_LATEST = "ls AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_sha256, scanner_version ORDER BY scanned_at DESC NULLS LAST, scan_id DESC) AS k FROM pii_scans WHERE object_sha256 IS NOT NULL) WHERE k = 1)"
_DROPS = "dp AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM token_estimates WHERE estimated_token_count > 600))"
_UNSURE = "((junk + unsure))"

QUERIES = {
    "fingerprint_problems": (fingerprint_problems, f"SELECT source_id, problems, count(*) AS lines FROM (SELECT source_id, {named_sql(_BAD)} AS problems FROM document_fingerprints) WHERE problems <> '' GROUP BY ALL"),
    "mixture_problems": (
        mixture_problems,
        f"""WITH g AS (SELECT release_id, mixture_name, count(DISTINCT id) AS gone FROM (SELECT release_id, mixture_name, unnest(source_ids) AS id FROM release_mixture) WHERE id NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY ALL)
        SELECT m.release_id, m.mixture_name, {named_sql(_BAD_MIXTURE)} AS problems, round(sum(target_share) OVER (PARTITION BY m.release_id), 9) AS release_share FROM release_mixture m LEFT JOIN g USING (release_id, mixture_name)""",
    ),
    "effective_reviews": (
        effective_reviews,
        "WITH c AS (SELECT DISTINCT contribution_id, review_status, updated_at FROM contributions WHERE updated_at IS NOT NULL) SELECT review_status, count(*) AS reviews, count(DISTINCT contribution_id) AS items FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.contribution_id = c.contribution_id AND d.updated_at > c.updated_at) GROUP BY review_status",
    ),
    "latest_review": (
        latest_review,
        f"WITH {REV}, k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY edited_at DESC NULLS LAST, revision_id DESC) AS k, count(*) OVER (PARTITION BY document_id) AS edits FROM r WHERE edit_reason IS NOT NULL AND edit_reason <> '') SELECT document_id, revision_id, edit_reason, document_version, edits FROM k WHERE k = 1",
    ),
    "component_totals": (
        component_totals,
        """WITH p AS (SELECT source AS id, count(*) AS documents, sum(n_chars) AS chars FROM documents GROUP BY source), m AS (SELECT release_id, mixture_name, unnest(list_distinct(source_ids)) AS id FROM release_mixture)
        SELECT m.release_id, m.mixture_name, count(m.id) AS sources, coalesce(sum(documents), 0)::BIGINT AS documents, coalesce(sum(chars), 0)::BIGINT AS chars FROM m LEFT JOIN p USING (id) GROUP BY ALL""",
    ),
    "exclusion_counts": (exclusion_counts, f"WITH {_DROPS} SELECT source, count(*) FILTER (sha256(text) NOT IN (SELECT sha FROM dp)) AS exported, count(*) FILTER (sha256(text) IN (SELECT sha FROM dp)) AS excluded FROM documents WHERE text IS NOT NULL GROUP BY source"),
    "dropped_occurrences": (
        dropped_occurrences,
        "WITH p AS (SELECT raw_line, min(record_id) AS first_id FROM source_lines WHERE raw_line IS NOT NULL AND observed_at IS NULL GROUP BY raw_line) SELECT first_id, count(*) AS occurrences, count(DISTINCT source_id) AS sources FROM source_lines JOIN p USING (raw_line) GROUP BY first_id",
    ),
    "duplicate_preview": (duplicate_preview, f"{_ST} SELECT a.doc_id, a.first_id AS duplicate_of, substr(a.text, 1, 60) AS preview, substr(b.text, 1, 60) AS first_preview, a.text = b.text AS equal FROM st a JOIN documents b ON b.doc_id = a.first_id WHERE a.stage = 'duplicate'"),
    "rule_scan_crosstab": (
        rule_scan_crosstab,
        f"WITH {_LATEST}, r AS (SELECT DISTINCT sha256(content_text) AS h, CASE WHEN regexp_matches(content_text, '[0-9]{{10}}') THEN 'digits' ELSE 'none' END AS rule FROM document_revisions WHERE content_text IS NOT NULL) SELECT rule, scanner_version, scan_status, count(*) AS objects FROM r JOIN ls ON ls.object_sha256 = r.h GROUP BY ALL",
    ),
    "review_history": (
        review_history,
        """WITH c AS (SELECT DISTINCT contribution_id, review_status, created_at, updated_at FROM contributions)
        SELECT contribution_id, review_status, coalesce(updated_at, created_at) AS at, row_number() OVER (PARTITION BY contribution_id ORDER BY coalesce(updated_at, created_at) DESC NULLS LAST, review_status NULLS FIRST, created_at DESC NULLS LAST) AS place FROM c""",
    ),
    "valid_versions": (
        valid_versions,
        """WITH s AS (SELECT source_id, source_version, max(rights_status) AS rights_status, max(license_id) AS license_id FROM release_sources GROUP BY ALL)
        SELECT source_id, max(source_version) AS source_version, arg_max(license_id, source_version) AS license_id FROM s WHERE rights_status = 'cleared' AND license_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.source_id = s.source_id AND b.source_version > s.source_version AND b.rights_status = 'blocked') GROUP BY source_id""",
    ),
    "pair_verification": (pair_verification, f"WITH {_NEAR}, p AS (SELECT * FROM np ORDER BY distance, left_id, right_id LIMIT 100) SELECT distance, count(*) AS pairs, count(*) FILTER (bit_count(xor(a.signature, b.signature)) = distance) AS verified FROM p JOIN s a ON a.doc_id = left_id JOIN s b ON b.doc_id = right_id GROUP BY distance"),
    "orphan_objects": (
        orphan_objects,
        """WITH s AS (SELECT source_id, source_version, source_sha256, max(rights_status) AS r FROM release_sources WHERE source_sha256 IS NOT NULL GROUP BY ALL), o AS (SELECT source_sha256 FROM s WHERE r <> 'blocked' OR r IS NULL UNION SELECT source_sha256 FROM document_fingerprints WHERE source_sha256 IS NOT NULL)
        SELECT DISTINCT source_sha256, CASE WHEN source_sha256 IN (SELECT source_sha256 FROM o) THEN 'referenced' ELSE 'orphan' END AS outcome FROM s WHERE r = 'blocked'""",
    ),
    "quality_bands": (
        quality_bands,
        """WITH d AS (SELECT coalesce(doc_domain, 'unknown') AS domain_name, length(coalesce(text, '')) AS n FROM documents), g AS (SELECT domain_name, CASE WHEN n < 200 THEN 'short' WHEN n < 1000 THEN 'middle' ELSE 'long' END AS band, count(*) AS documents, sum(n)::BIGINT AS chars FROM d GROUP BY ALL)
        SELECT *, ((chars * 1000 + documents // 2) // documents)::BIGINT AS mean_milli FROM g""",
    ),
    "snapshot_hash": (
        snapshot_hash,
        "SELECT release_id, count(*) AS lines, sha256(string_agg(mixture_name || chr(9) || coalesce(mixture_domain, '') || chr(9) || array_to_string(source_ids, ',') || chr(9) || coalesce(max_repeats::VARCHAR, ''), chr(10) ORDER BY mixture_name) || chr(10)) AS snapshot FROM release_mixture GROUP BY release_id",
    ),
    "quality_summary": (
        quality_summary,
        f"""WITH {REV} SELECT source_id, count(*) AS revisions, count(DISTINCT document_id) AS documents, count(*) FILTER (edit_reason IS NOT NULL AND edit_reason <> '') AS explained, count(*) FILTER (received_at > edited_at + INTERVAL 1 DAY) AS late,
        round(avg(char_count), 9) AS mean_chars, round(avg(word_count), 9) AS mean_words, round(avg(char_count) FILTER (document_version > 1), 9) AS mean_chars_of_later FROM r GROUP BY source_id""",
    ),
    "item_rates": (
        item_rates,
        f"""WITH {CONTRIBUTIONS_SQL}, g AS (SELECT task_type, count(*) FILTER (review_status IN ('rejected', 'auto_rejected')) AS junk, count(*) FILTER (review_status IN ('needs_review', 'sensitive_review')) AS unsure, count(*) FILTER (review_status <> 'submitted') AS judged FROM c GROUP BY task_type)
        SELECT *, round((junk + unsure) / judged::DOUBLE, 9) AS rate, round(junk / judged::DOUBLE, 9) AS strict_rate, round({S.WILSON_LOW.format(k=_UNSURE, n="judged")}, 9) AS low, round({S.WILSON_HIGH.format(k=_UNSURE, n="judged")}, 9) AS high FROM g""",
    ),
    "four_rates": (
        four_rates,
        f"""{_ST}, {_LATEST}, {CONTRIBUTIONS_SQL.replace("c AS (", "cn AS (", 1)}, x AS (SELECT 'personal_data' AS measure, count(*) FILTER (personal <> '') AS cases, count(*) AS judged FROM st UNION ALL SELECT 'rules', count(*) FILTER (reasons <> ''), count(*) FROM st
        UNION ALL SELECT 'scanners', count(*) FILTER (scan_status = 'flagged'), count(*) FROM ls WHERE scan_status <> 'not_evaluated' UNION ALL SELECT 'reviewers', count(*) FILTER (review_status IN ('rejected', 'auto_rejected')), count(*) FROM cn WHERE review_status <> 'submitted')
        SELECT measure, cases, judged, ((cases * 10000 + judged // 2) // judged)::BIGINT AS points FROM x""",
    ),
    "merged_reports": (
        merged_reports,
        """WITH d AS (SELECT CASE WHEN starts_with(raw_line, '{') THEN 'json' WHEN contains(raw_line, chr(9)) THEN 'fields' ELSE 'plain' END AS form, source_id, record_id, strlen(raw_line) AS b FROM source_lines WHERE raw_line IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY record_id) AS k FROM d)
        SELECT form, count(*) AS lines, sum(b)::BIGINT AS bytes, array_to_string(list_sort(list(DISTINCT source_id) FILTER (source_id IS NOT NULL)), ',') AS sources, max(record_id) FILTER (k <= 100) AS last_sample, count(*) FILTER (k <= 100) AS samples FROM k GROUP BY form""",
    ),
    "top_strata": (top_strata, f"WITH {REV} SELECT coalesce(nullif(edit_reason, ''), 'none') AS stratum, count(*) FILTER (word_count = 0) AS mistakes, count(*) AS records FROM r GROUP BY 1 ORDER BY mistakes DESC, records DESC, stratum LIMIT 3"),
    "ranked_pairs": (ranked_pairs, f"WITH {_NEAR} SELECT left_id, right_id, distance, row_number() OVER (ORDER BY distance, left_id, right_id) AS rank FROM np ORDER BY rank LIMIT 100"),
    "decision_union": (
        decision_union,
        f"{_ST}, x AS (SELECT doc_id, stage AS decision_type, 'pass' AS run FROM st WHERE stage <> 'kept' UNION ALL SELECT DISTINCT doc_id, 'oversized_estimate', 'drop' FROM token_estimates WHERE estimated_token_count > 500) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run, decision_type) AS place FROM x",
    ),
    "selection_refusals": (
        selection_refusals,
        f"""{_ST}, dr AS (SELECT doc_id, count(*) AS k FROM token_estimates WHERE estimated_token_count > 500 GROUP BY doc_id), y AS (SELECT dr.doc_id, concat_ws('|', CASE WHEN st.stage IS NULL THEN 'unknown' END, CASE WHEN partition = 'held_out' THEN 'held_out' END, CASE WHEN st.stage <> 'kept' THEN 'decided' END, CASE WHEN k > 1 THEN 'twice' END) AS refused
        FROM dr LEFT JOIN st ON st.doc_id IS NOT DISTINCT FROM dr.doc_id) SELECT * FROM y WHERE refused <> ''""",
    ),
    "lineage_edges": (
        lineage_edges,
        "SELECT * FROM (SELECT DISTINCT source_ids[1] AS parent_id, unnest(source_ids[2:]) AS child_id, 'mixture' AS kind FROM release_mixture WHERE len(source_ids) > 1) WHERE parent_id <> child_id UNION SELECT regexp_extract(lineage_ref, '^lineage/([^/]+)/v', 1), source_id, 'reference' FROM release_sources WHERE regexp_extract(lineage_ref, '^lineage/([^/]+)/v', 1) <> ''",
    ),
    "folded_texts": (folded_texts, "SELECT doc_id, md5(lower(translate(text, 'Iİ', 'ıi'))) AS folded_md5, md5(translate(text, 'çğıöşüâîûÇĞİÖŞÜÂÎÛ', 'cgiosuaiuCGIOSUAIU')) AS plain_md5 FROM documents WHERE text IS NOT NULL"),
    "shown_points": (shown_points, "WITH p AS (SELECT release_id, mixture_name, round(target_share * 10000)::BIGINT AS points FROM release_mixture WHERE target_share IS NOT NULL) SELECT *, (points // 100) || '.' || lpad((points % 100)::VARCHAR, 2, '0') AS shown, points AS read_back FROM p"),
    "extracted_objects": (
        extracted_objects,
        "WITH d AS (SELECT record_id, regexp_extract(raw_line, '(?s)\\{.*\\}') AS found FROM source_lines WHERE raw_line IS NOT NULL) SELECT record_id, md5(found) AS object_md5, CASE WHEN json_valid(found) THEN len(json_keys(found)) END::BIGINT AS fields FROM d WHERE found <> ''",
    ),
    "differing_branches": (
        differing_branches,
        f"WITH c AS (SELECT DISTINCT ON (contribution_id) * FROM contributions) SELECT task_type, count(*) AS items, count(*) FILTER ({T.PROFILE_SQL.format('input_text')} IS NOT DISTINCT FROM {T.PROFILE_SQL.format('output_text')}) AS same FROM c GROUP BY task_type",
    ),
    "line_urls": (
        line_urls,
        f"WITH u AS (SELECT regexp_extract(coalesce(json_extract_string(raw_line, '$.url'), json_extract_string(raw_line, '$.provenance.url')), '^https?://([^/]+)', 1) AS host FROM (SELECT raw_line FROM source_lines WHERE {_JSON})) SELECT host, count(*) AS lines FROM u WHERE host <> '' GROUP BY host",
    ),
    "timestamp_forms": (
        timestamp_forms,
        f"""WITH d AS (SELECT source_id, json_extract_string(raw_line, '$.date') AS x FROM (SELECT source_id, raw_line FROM source_lines WHERE {_JSON}))
        SELECT source_id, CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\.\\d{{6}}\\+00:00$') THEN 'canonical' WHEN regexp_matches(x, '^\\d{{4}}-\\d\\d-\\d\\d$') AND try_cast(x AS DATE) IS NOT NULL THEN 'day' ELSE 'other' END AS form, count(*) AS lines FROM d WHERE x IS NOT NULL GROUP BY ALL""",
    ),
}
