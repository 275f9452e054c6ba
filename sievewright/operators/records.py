"""Records: text resolution from raw lines, canonical conversations, adapters, exports and personal-number gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators.review import revisions
from sievewright.tables import once, table

MAX_LINE_BYTES = 262144


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def json_fields(line: Column) -> Column:
    """Text fields of a JSON object line; null where the line is none."""
    return F.when(line.startswith("{") & line.rlike(r"\}\s*$"), F.from_json(line, "struct<text:string,content:string,body:string,url:string,title:string,date:string,domain:string>"))


def resolved_text(line: Column, fields: Column) -> Column:
    """First non-blank of text, content and body of an object, else the line itself."""
    return F.coalesce(blank_to_null(fields["text"]), blank_to_null(fields["content"]), blank_to_null(fields["body"]), line)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_lines").where("raw_line is not null")


def line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = once(lines(spark, sf_dir).select("record_id", "raw_line"), "f", json_fields(F.col("raw_line")))
    text = resolved_text(F.col("raw_line"), F.col("f"))
    return d.select("record_id", F.md5(text).alias("text_md5"), F.char_length(text).cast("long").alias("chars"), F.col("f.url").alias("url"))


def line_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, blanks, oversized lines and bytes with line feeds, by source."""
    n = F.octet_length("raw_line") + 1
    return table(spark, sf_dir, "source_lines").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("raw_line") == "").alias("blank"), F.count_if(n > MAX_LINE_BYTES).alias("oversized"), F.sum(n).alias("bytes")
    )


def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last ordinal, repeated ordinals and gaps of each source.

    A gap begins after an ordinal whose next is missing, found by a join on
    (source, ordinal), so no task sees all rows of a hot source.
    """
    d = table(spark, sf_dir, "source_lines").where("source_ordinal is not null").groupBy("source_id", "source_ordinal").agg(F.count(F.lit(1)).alias("n"))
    after = d.select(F.col("source_id").alias("_s"), (F.col("source_ordinal") - 1).alias("_o"))
    j = d.join(after, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("source_ordinal") == F.col("_o")), "left")
    g = j.groupBy("source_id").agg(F.max("source_ordinal").alias("last_ordinal"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("_o").isNull()).alias("ends"))
    return g.select("source_id", "last_ordinal", "repeated", (F.col("ends") - 1).alias("gaps"))


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact JSON candidate line of each document, null url kept, with its hash."""
    line = F.to_json(F.struct("text", "url"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(line, 256).alias("line_sha"), F.octet_length(line).cast("long").alias("bytes"))


def export_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered export of documents by source: records, characters, first and last id."""
    key = F.struct("source_ordinal", "doc_id")
    d = table(spark, sf_dir, "documents").where(F.trim(F.regexp_replace("text", T.SPACES, " ")) != "")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.char_length("text")).alias("chars"), F.min_by("doc_id", key).alias("first_id"), F.max_by("doc_id", key).alias("last_id"))


def export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record id of each exported line."""
    f = table(spark, sf_dir, "document_fingerprints").where("source_sha256 is not null and normalized_sha256 is not null").select("source_sha256", "source_ordinal", "normalized_sha256").distinct()
    return f.select("source_ordinal", F.sha2(F.concat_ws(":", "source_sha256", F.col("source_ordinal").cast("string"), "normalized_sha256"), 256).alias("record_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample once."""
    return table(spark, sf_dir, "canonical_conversations").dropDuplicates(["sample_id"])


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank message texts of each sample, in order."""
    said = F.filter(F.transform("messages", lambda m: m["content_text"]), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return conversations(spark, sf_dir).select("sample_id", F.md5(F.array_join(said, "\n")).alias("text_md5"), F.size(said).cast("long").alias("messages"))


def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = conversations(spark, sf_dir).select("sample_id", F.explode("messages").alias("m"))
    return d.groupBy(F.col("m.message_role").alias("message_role")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("sample_id").alias("samples"), F.count_if(F.col("m.content_text").isNull()).alias("without_text"))


def conversation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural errors of each sample, as codes in a fixed order."""
    m = F.col("messages")
    calls = F.transform(F.filter(m, lambda x: (x["message_role"] == "assistant") & x["tool_call_id"].isNotNull()), lambda x: x["tool_call_id"])
    results = F.transform(F.filter(m, lambda x: x["message_role"] == "tool"), lambda x: x["tool_call_id"])
    checks = {
        "no_messages": F.size(m) == 0,
        "unknown_role": F.exists(m, lambda x: ~x["message_role"].isin("system", "user", "assistant", "tool")),
        "no_user": ~F.exists(m, lambda x: x["message_role"] == "user"),
        "no_answer": ~F.exists(m, lambda x: x["message_role"] == "assistant"),
        "late_system": F.exists(F.slice(m, F.lit(2), F.greatest(F.size(m), F.lit(0))), lambda x: x["message_role"] == "system"),
        "call_without_result": F.size(F.array_except(calls, results)) > 0,
        "result_without_call": F.size(F.array_except(results, calls)) > 0,
        "blank_text": F.exists(m, lambda x: (F.trim(F.coalesce(x["content_text"], F.lit(""))) == "") & x["tool_call_id"].isNull()),
    }
    codes = F.filter(F.array(*(F.when(test, F.lit(code)) for code, test in checks.items())), lambda x: x.isNotNull())
    return conversations(spark, sf_dir).select("sample_id", F.array_join(codes, "|").alias("errors"))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+"), 0)


def number_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with valid check digits in each revision: national ids, cards and IBANs without separators."""
    d = revisions(spark, sf_dir).where("content_text is not null").select("revision_id", "content_text")
    runs = d.select("revision_id", F.explode(F.array_distinct(F.concat(digit_runs(F.col("content_text")), F.regexp_extract_all(F.upper("content_text"), F.lit(r"TR[0-9]{24}"), 0)))).alias("run"))
    runs = runs.where("char_length(run) in (11, 26) or char_length(run) between 13 and 19")
    r = F.col("run")
    return runs.groupBy("revision_id").agg(F.count_if(T.national_id_valid(r)).alias("national_ids"), F.count_if(r.rlike("^[0-9]+$") & T.luhn_valid(r)).alias("cards"), F.count_if(T.iban_valid(r)).alias("ibans"))


def pii_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner findings by type: total, documents and the first three objects."""
    s = table(spark, sf_dir, "pii_scans").where("findings is not null").select("object_sha256", F.explode(F.from_json("findings", "map<string,bigint>")).alias("pii_type", "n"))
    s = s.where("n > 0 and object_sha256 is not null")
    ranked = s.withColumn("k", F.dense_rank().over(Window.partitionBy("pii_type").orderBy("object_sha256")))  # rank limit: at most three kept a task
    top = ranked.where("k <= 3").groupBy("pii_type").agg(F.array_join(F.array_sort(F.collect_set("object_sha256")), ",").alias("first_objects"))
    totals = s.groupBy("pii_type").agg(F.sum("n").alias("findings"), F.count_distinct("object_sha256").alias("objects"))
    return totals.join(top, "pii_type")


def pii_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged, clear or not evaluated by source, from the numbers found and the source's language."""
    found = number_gate(spark, sf_dir).select("revision_id", (F.col("national_ids") + F.col("cards") + F.col("ibans")).alias("n"))
    d = revisions(spark, sf_dir).select("revision_id", "source_id").join(found, "revision_id", "left")
    g = d.groupBy("source_id").agg(F.count(F.lit(1)).alias("revisions"), F.coalesce(F.sum("n"), F.lit(0)).alias("numbers"))
    return g.withColumn("status", F.when(F.col("numbers") > 0, "flagged").when(F.col("source_id").contains("-tr-"), "clear").otherwise("not_evaluated"))


def signals_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite token counts of each document as a map with sorted names."""
    names = ["lower_bound", "estimated_token_count", "upper_bound", "whitespace_units"]
    e = table(spark, sf_dir, "token_estimates").select("doc_id", "source_id", "estimate_method", "estimated_at", F.map_from_arrays(F.array(*map(F.lit, sorted(names))), F.array(*(F.col(c).cast("double") for c in sorted(names)))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v.isNotNull() & ~F.isnan(v))
    return e.groupBy("doc_id", "source_id", "estimate_method", "estimated_at").agg(F.count(F.lit(1)).alias("rows"), F.max(F.array_join(F.map_keys(kept), ",")).alias("signals"))


def rejection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection record of each blank, short or repeated document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.fingerprint(T.profile_text(F.col("text"))).alias("fp"))
    first = d.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    d = d.join(first, "fp", "left")
    blank = F.coalesce(F.trim(F.regexp_replace("text", T.SPACES, " ")), F.lit("")) == ""
    reasons = F.filter(F.array(F.when(blank, "blank"), F.when(~blank & F.col("fp").isNull(), "too_short"), F.when(F.col("first_id") < F.col("doc_id"), "duplicate")), lambda x: x.isNotNull())
    r = d.select("doc_id", F.array_join(reasons, "|").alias("reasons"), F.char_length("text").cast("long").alias("char_count"), F.when(F.col("first_id") < F.col("doc_id"), F.col("first_id")).alias("duplicate_of"))
    return r.where("reasons <> ''")


REV = "r AS (SELECT DISTINCT * FROM document_revisions)"
CONV = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id) AS k FROM canonical_conversations) WHERE k = 1)"
P = T.PROFILE_SQL.format("text")
UNITS = r"trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"
J = "CASE WHEN starts_with(raw_line, '{') AND json_valid(raw_line) THEN nullif(trim(json_extract_string(raw_line, '$.{}'), ' '), '') END"
_D = "list_transform(range(1, 12), lambda i: substr(run, i, 1)::INT)"
NUMBERS_SQL = f"""{REV}, t AS (SELECT revision_id, unnest(list_distinct(list_concat(regexp_extract_all(content_text, '[0-9]+'), regexp_extract_all(upper(content_text), 'TR[0-9]{{24}}')))) AS run FROM r WHERE content_text IS NOT NULL),
    k AS (SELECT * FROM t WHERE length(run) IN (11, 26) OR length(run) BETWEEN 13 AND 19),
    v AS (SELECT revision_id, run, length(run) = 11 AND run[1] <> '0' AND regexp_matches(run, '^[0-9]{{11}}$') AS id11 FROM k),
    w AS (SELECT revision_id,
      CASE WHEN id11 THEN (((substr(run,1,1)::INT + substr(run,3,1)::INT + substr(run,5,1)::INT + substr(run,7,1)::INT + substr(run,9,1)::INT) * 7 - (substr(run,2,1)::INT + substr(run,4,1)::INT + substr(run,6,1)::INT + substr(run,8,1)::INT)) % 10 + 10) % 10 = substr(run,10,1)::INT
        AND list_sum({_D}[1:10]) % 10 = substr(run,11,1)::INT ELSE false END AS a,
      CASE WHEN length(run) BETWEEN 13 AND 19 AND regexp_matches(run, '^[0-9]+$') THEN len(list_distinct(string_split(run, ''))) > 1 AND list_sum(list_transform(range(1, length(run) + 1), lambda i: CASE WHEN (length(run) - i) % 2 = 0 THEN substr(run, i, 1)::INT ELSE CASE WHEN substr(run, i, 1)::INT > 4 THEN substr(run, i, 1)::INT * 2 - 9 ELSE substr(run, i, 1)::INT * 2 END END)) % 10 = 0 ELSE false END AS b,
      CASE WHEN length(run) = 26 AND starts_with(run, 'TR') THEN (substr(run, 5) || '2927' || substr(run, 3, 2))::HUGEINT % 97 = 1 ELSE false END AS c FROM v),
    n AS (SELECT revision_id, count(*) FILTER (a) AS national_ids, count(*) FILTER (b) AS cards, count(*) FILTER (c) AS ibans FROM w GROUP BY revision_id)"""

QUERIES = {
    "line_text": (
        line_text,
        f"WITH t AS (SELECT record_id, coalesce({J.replace('$.{}', '$.text')}, {J.replace('$.{}', '$.content')}, {J.replace('$.{}', '$.body')}, raw_line) AS x, CASE WHEN starts_with(raw_line, '{{') AND json_valid(raw_line) THEN json_extract_string(raw_line, '$.url') END AS url FROM source_lines WHERE raw_line IS NOT NULL) SELECT record_id, md5(x) AS text_md5, length(x)::BIGINT AS chars, url FROM t",
    ),
    "line_scan_report": (line_scan_report, "SELECT source_id, count(*) AS lines, count(*) FILTER (trim(raw_line, ' ') = '') AS blank, count(*) FILTER (strlen(raw_line) + 1 > 262144) AS oversized, sum(strlen(raw_line) + 1)::BIGINT AS bytes FROM source_lines GROUP BY source_id"),
    "ordinal_gaps": (
        ordinal_gaps,
        "WITH d AS (SELECT source_id, source_ordinal, lag(source_ordinal) OVER (PARTITION BY source_id ORDER BY source_ordinal, record_id) AS b FROM source_lines) SELECT source_id, max(source_ordinal) AS last_ordinal, count(*) FILTER (source_ordinal <= b) AS repeated, count(*) FILTER (source_ordinal > b + 1) AS gaps FROM d GROUP BY source_id",
    ),
    "candidate_lines": (
        candidate_lines,
        """WITH l AS (SELECT doc_id, '{"text":' || replace(to_json(text)::VARCHAR, chr(127), '\\u007F') || ',"url":' || coalesce(to_json(url)::VARCHAR, 'null') || '}' AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(line) AS line_sha, strlen(line)::BIGINT AS bytes FROM l""",
    ),
    "export_counters": (
        export_counters,
        f"SELECT source, count(*) AS records, sum(length(text))::BIGINT AS chars, first(doc_id ORDER BY source_ordinal, doc_id) AS first_id, last(doc_id ORDER BY source_ordinal, doc_id) AS last_id FROM documents WHERE {UNITS} <> '' GROUP BY source",
    ),
    "export_ids": (
        export_ids,
        "WITH f AS (SELECT DISTINCT source_sha256, source_ordinal, normalized_sha256 FROM document_fingerprints WHERE source_sha256 IS NOT NULL AND normalized_sha256 IS NOT NULL) SELECT source_ordinal, sha256(source_sha256 || ':' || source_ordinal::VARCHAR || ':' || normalized_sha256) AS record_id FROM f",
    ),
    "conversation_text": (
        conversation_text,
        f"WITH {CONV}, t AS (SELECT sample_id, list_filter(list_transform(messages, lambda m: m.content_text), lambda x: x IS NOT NULL AND trim(x, ' ') <> '') AS x FROM c) SELECT sample_id, md5(array_to_string(x, chr(10))) AS text_md5, len(x)::BIGINT AS messages FROM t",
    ),
    "conversation_roles": (
        conversation_roles,
        f"WITH {CONV}, t AS (SELECT sample_id, unnest(messages) AS m FROM c) SELECT m.message_role AS message_role, count(*) AS messages, count(DISTINCT sample_id) AS samples, count(*) FILTER (m.content_text IS NULL) AS without_text FROM t GROUP BY 1",
    ),
    "conversation_errors": (
        conversation_errors,
        f"""WITH {CONV}, t AS (SELECT sample_id, messages AS m, list_transform(list_filter(messages, lambda x: x.message_role = 'assistant' AND x.tool_call_id IS NOT NULL), lambda x: x.tool_call_id) AS a, list_transform(list_filter(messages, lambda x: x.message_role = 'tool'), lambda x: x.tool_call_id) AS b FROM c)
        SELECT sample_id, concat_ws('|', CASE WHEN len(m) = 0 THEN 'no_messages' END,
          CASE WHEN len(list_filter(m, lambda x: x.message_role NOT IN ('system', 'user', 'assistant', 'tool'))) > 0 THEN 'unknown_role' END,
          CASE WHEN len(list_filter(m, lambda x: x.message_role = 'user')) = 0 THEN 'no_user' END,
          CASE WHEN len(list_filter(m, lambda x: x.message_role = 'assistant')) = 0 THEN 'no_answer' END,
          CASE WHEN len(list_filter(m[2:], lambda x: x.message_role = 'system')) > 0 THEN 'late_system' END,
          CASE WHEN len(list_filter(a, lambda x: NOT coalesce(list_contains(b, x), false))) > 0 THEN 'call_without_result' END,
          CASE WHEN len(list_filter(b, lambda x: NOT coalesce(list_contains(a, x), false))) > 0 THEN 'result_without_call' END,
          CASE WHEN len(list_filter(m, lambda x: trim(coalesce(x.content_text, ''), ' ') = '' AND x.tool_call_id IS NULL)) > 0 THEN 'blank_text' END) AS errors FROM t""",
    ),
    "number_gate": (number_gate, f"WITH {NUMBERS_SQL} SELECT * FROM n"),
    "pii_triage": (
        pii_triage,
        """WITH s AS (SELECT object_sha256, unnest(json_keys(findings)) AS pii_type, findings FROM pii_scans WHERE findings IS NOT NULL), v AS (SELECT object_sha256, pii_type, json_extract_string(findings, '$.' || pii_type)::BIGINT AS n FROM s), p AS (SELECT * FROM v WHERE n > 0 AND object_sha256 IS NOT NULL),
        k AS (SELECT DISTINCT pii_type, object_sha256 FROM p WHERE object_sha256 IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY pii_type ORDER BY object_sha256) AS i FROM k)
        SELECT pii_type, sum(n)::BIGINT AS findings, count(DISTINCT object_sha256) AS objects, (SELECT string_agg(object_sha256, ',' ORDER BY object_sha256) FROM r WHERE r.pii_type = p.pii_type AND i <= 3) AS first_objects FROM p GROUP BY pii_type""",
    ),
    "pii_status": (
        pii_status,
        f"WITH {NUMBERS_SQL}, g AS (SELECT r.source_id, count(*) AS revisions, coalesce(sum(national_ids + cards + ibans), 0)::BIGINT AS numbers FROM r LEFT JOIN n ON n.revision_id = r.revision_id GROUP BY 1) SELECT *, CASE WHEN numbers > 0 THEN 'flagged' WHEN contains(source_id, '-tr-') THEN 'clear' ELSE 'not_evaluated' END AS status FROM g",
    ),
    "signals_map": (
        signals_map,
        "SELECT doc_id, source_id, estimate_method, estimated_at, count(*) AS rows, max(concat_ws(',', CASE WHEN estimated_token_count IS NOT NULL THEN 'estimated_token_count' END, CASE WHEN lower_bound IS NOT NULL THEN 'lower_bound' END, CASE WHEN upper_bound IS NOT NULL THEN 'upper_bound' END, CASE WHEN whitespace_units IS NOT NULL THEN 'whitespace_units' END)) AS signals FROM token_estimates GROUP BY 1, 2, 3, 4",
    ),
    "rejection_report": (
        rejection_report,
        f"""WITH d AS (SELECT doc_id, text, CASE WHEN length({P}) >= 32 THEN sha256({P}) END AS fp, coalesce({UNITS}, '') = '' AS blank FROM documents), f AS (SELECT *, CASE WHEN fp IS NOT NULL THEN min(doc_id) OVER (PARTITION BY fp) END AS first_id FROM d),
        r AS (SELECT doc_id, concat_ws('|', CASE WHEN blank THEN 'blank' END, CASE WHEN NOT blank AND fp IS NULL THEN 'too_short' END, CASE WHEN first_id < doc_id THEN 'duplicate' END) AS reasons, length(text)::BIGINT AS char_count, CASE WHEN first_id < doc_id THEN first_id END AS duplicate_of FROM f) SELECT * FROM r WHERE reasons <> ''""",
    ),
}
