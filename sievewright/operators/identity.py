"""Identity, normalization and document-local measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.tables import once, positions, spread, table

P = T.PROFILE_SQL.format("text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), T.storage_key(F.sha2("text", 256)).alias("storage_key"))


def normalize_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = T.profile_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(normal).alias("normal_md5"), F.char_length(normal).cast("long").alias("normal_chars"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", T.normalize_text("text").alias("normal_text"))


def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = T.profile_text(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(normal).alias("fingerprint"), F.char_length(normal).cast("long").alias("normal_chars"))


def fingerprint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("source", F.char_length(T.profile_text(F.col("text"))).alias("n"), (F.octet_length("text") + 1).alias("bytes"))
    large = F.col("bytes") > 262144
    short = F.coalesce(F.col("n"), F.lit(0)) < T.LEAST_CHARS
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(large).alias("oversized"),
        F.count_if(~F.coalesce(large, F.lit(False)) & short).alias("too_short"),
        F.count_if(~F.coalesce(large, F.lit(False)) & ~short).alias("indexed"),
    )


def single_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.substring(T.single_line(F.col("text")), 1, 200).alias("preview"))


def blind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = T.single_line(F.col("text"))
    long = F.char_length(whole) > 6000
    shown = F.when(long, F.rtrim(F.substring(whole, 1, 6000))).otherwise(whole)
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5(shown).alias("shown_md5"), long.alias("cut"), F.char_length("text").cast("long").alias("char_count"))


def grams(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, g) with all word n-grams of each text."""
    words = once(spread(docs.where("text is not null").select("doc_id", "text")), "w", T.tokens(T.profile_text(F.col("text")))).select("doc_id", "w")
    return once(words, "g", T.ngrams(F.col("w"), n)).select("doc_id", "g")


def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grams(documents(spark, sf_dir), 3)
    return d.select("doc_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"), F.md5(F.array_join(F.array_sort(F.array_distinct("g")), "\x1e")).alias("grams_md5"))


def unique_fivegrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = grams(documents(spark, sf_dir), 5)
    n = F.size("g")
    return d.select("doc_id", F.when(n > 0, F.floor(F.size(F.array_distinct("g")) * 1000 / n).cast("long")).alias("permille"))


def repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding-window coding ratio of the texts whose 5-grams repeat."""
    d = once(documents(spark, sf_dir).where("text is not null").select("doc_id", "text"), "w", T.tokens(T.profile_text(F.col("text"))))
    d = once(d, "g", T.ngrams(F.col("w"), 5)).select("doc_id", "text", (F.size(F.array_distinct("g")) * 1000 / F.nullif(F.size("g"), F.lit(0))).alias("permille"))
    kept = d.where("permille <= 600").select("doc_id", "text", F.floor("permille").cast("long").alias("permille"))
    return kept.select("doc_id", "permille", T.lz77_permille("text").alias("lz_permille"), T.deflate_permille("text").alias("deflate_permille"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of token counts from bytes, code points and white-space units."""
    units = F.when(F.trim(F.regexp_replace("text", T.SPACES, " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace("text", T.SPACES, " ")), " ")))
    s = documents(spark, sf_dir).where("text is not null").groupBy("source").agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.char_length("text")).alias("codepoints"), F.sum(units).alias("units")
    )
    ceil = lambda n: F.ceil(F.col("codepoints") / n)
    s = s.withColumn("lower_bound", F.greatest("units", ceil(6)))
    s = s.withColumn("estimate", F.greatest("lower_bound", ceil(4)))
    return s.withColumn("upper_bound", F.greatest("estimate", ceil(2)))


def language_subtag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether language-bound rules apply to a document."""
    tag = T.subtag(F.col("lang"))
    status = F.when(tag.isNull() | (tag == "und"), "applied_language_unknown").when(tag == "tr", "applied").otherwise("not_evaluated")
    return documents(spark, sf_dir).groupBy(tag.alias("subtag"), status.alias("status")).agg(F.count(F.lit(1)).alias("documents"))


def heldout_split(spark: SparkSession, sf_dir: str, modulus: int = 25) -> DataFrame:
    bucket = F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long") % modulus
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.when(bucket == 0, "held_out").otherwise("train").alias("partition"))


def perturbed(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, kind, text, words) of each text with its middle word dropped, replaced, swapped, or its middle tenth dropped."""
    w = F.col("w")
    n = F.size(w)
    mid = F.floor(n / 2).cast("int")
    span = F.greatest(F.floor(n / 10).cast("int"), F.lit(1))
    first = F.floor((n - span) / 2).cast("int")
    tail = lambda at: F.slice(w, at + 1, F.greatest(n - at, F.lit(0)))
    kinds = {
        "drop": F.concat(F.slice(w, F.lit(1), mid), tail(mid + 1)),
        "replace": F.concat(F.slice(w, F.lit(1), mid), F.array(F.lit("zzz")), tail(mid + 1)),
        "swap": F.concat(F.slice(w, F.lit(1), mid - 1), F.slice(w, mid + 1, F.lit(1)), F.slice(w, mid, F.lit(1)), tail(mid + 1)),
        "drop_span": F.concat(F.slice(w, F.lit(1), first), tail(first + span)),
    }
    d = once(docs.select(id_col, "text"), "w", T.tokens(T.profile_text(F.col("text")))).where(F.size("w") >= 5)
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.array_join(v, " ").alias("text")) for k, v in kinds.items()))).alias("p")
    return d.select(id_col, made, F.size("w").alias("words")).select(id_col, "p.kind", "p.text", "words")


def token_perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = perturbed(table(spark, sf_dir, "documents"), "doc_id")
    return p.select("doc_id", "kind", F.md5("text").alias("text_md5"), F.size(F.split("text", " ")).cast("long").alias("words"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repacked into pieces of at most 4,000 characters."""
    d = spread(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.posexplode(T.packed("text")).alias("piece", "piece_text"))


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(T.tokens(F.col("text")))
    bucket = F.when(n >= 32, "32+").when(n >= 16, "16-31").when(n >= 8, "8-15").when(n >= 5, "5-7")
    c = documents(spark, sf_dir).where("text is not null").select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("documents"))
    return c.join(F.broadcast(c.agg(F.sum("documents").alias("t"))), F.lit(True)).select("bucket", "documents", T.basis_points(F.col("documents"), F.col("t")).alias("share_points"))


def token_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of words per document by source."""
    d = documents(spark, sf_dir).where("text is not null").select("source", F.size(T.tokens(F.col("text"))).alias("n"))
    q = lambda p: F.expr(f"percentile_disc({p / 100}) within group (order by n)").cast("long").alias(f"p{p}")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), q(50), q(90), q(95), q(99))


def encoding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement characters and wrongly decoded sequences by source."""
    bad = r"[ÃÂ][\x{80}-\x{BF}]|â€"
    d = documents(spark, sf_dir).where("text is not null")
    n = lambda p: F.regexp_count("text", F.lit(p))
    return d.groupBy("source").agg(F.sum(n("�")).alias("replacement_chars"), F.sum(n(bad)).alias("sequences"), F.count_if(F.col("text").contains("�")).alias("documents"))


def document_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of each document in its source."""
    return positions(documents(spark, sf_dir).select("doc_id", "source", "source_ordinal"), "source", ["source_ordinal", "doc_id"], "position").drop("source_ordinal")


LOCAL = r"'[\p{L}\p{N}_]+'"
GRAMS = "CASE WHEN len(w) >= {0} THEN list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i + {0} - 1], chr(31))) ELSE [] END"
WORDS = f"SELECT doc_id, regexp_extract_all({P}, {LOCAL}) AS w FROM documents WHERE text IS NOT NULL"
UNITS = r"trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"


def perturbed_sql(name: str, key: str) -> str:
    return f"""pw AS (SELECT {key}, regexp_extract_all({P}, {LOCAL}) AS w FROM {name}), pn AS (SELECT *, len(w) AS n, len(w) // 2 AS m, greatest(len(w) // 10, 1) AS s FROM pw WHERE len(w) >= 5),
    pt AS (SELECT {key}, 'drop' AS kind, n, w[1:m] || w[m+2:] AS v FROM pn UNION ALL SELECT {key}, 'replace', n, w[1:m] || ['zzz'] || w[m+2:] FROM pn
      UNION ALL SELECT {key}, 'swap', n, w[1:m-1] || [w[m+1]] || [w[m]] || w[m+2:] FROM pn UNION ALL SELECT {key}, 'drop_span', n, w[1:(n-s)//2] || w[(n-s)//2+s+1:] FROM pn)"""


QUERIES = {
    "document_id": (
        document_id,
        "SELECT doc_id, sha256(text) AS sha256, 'objects/sha256/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS storage_key FROM documents",
    ),
    "normalize_profile": (normalize_profile, f"SELECT doc_id, md5({P}) AS normal_md5, length({P})::BIGINT AS normal_chars FROM documents"),
    "normalize_text": (normalize_text, None),
    "document_fingerprint": (document_fingerprint, f"SELECT doc_id, CASE WHEN length({P}) >= 32 THEN sha256({P}) END AS fingerprint, length({P})::BIGINT AS normal_chars FROM documents"),
    "fingerprint_report": (
        fingerprint_report,
        f"""WITH d AS (SELECT source, coalesce(length({P}), 0) AS n, coalesce(strlen(text) + 1 > 262144, false) AS large FROM documents)
        SELECT source, count(*) AS total, count(*) FILTER (large) AS oversized, count(*) FILTER (NOT large AND n < 32) AS too_short, count(*) FILTER (NOT large AND n >= 32) AS indexed FROM d GROUP BY source""",
    ),
    "single_line_text": (single_line_text, f"SELECT doc_id, substr({UNITS}, 1, 200) AS preview FROM documents"),
    "blind_rows": (
        blind_rows,
        f"SELECT doc_id, md5(CASE WHEN length({UNITS}) > 6000 THEN rtrim(substr({UNITS}, 1, 6000), ' ') ELSE {UNITS} END) AS shown_md5, length({UNITS}) > 6000 AS cut, length(text)::BIGINT AS char_count FROM documents WHERE text IS NOT NULL",
    ),
    "word_ngrams": (
        word_ngrams,
        f"WITH t AS ({WORDS}), g AS (SELECT doc_id, {GRAMS.format(3)} AS g FROM t) SELECT doc_id, len(g)::BIGINT AS grams, len(list_distinct(g))::BIGINT AS distinct_grams, md5(array_to_string(list_sort(list_distinct(g)), chr(30))) AS grams_md5 FROM g",
    ),
    "unique_fivegrams": (
        unique_fivegrams,
        f"WITH t AS ({WORDS}), g AS (SELECT doc_id, {GRAMS.format(5)} AS g FROM t) SELECT doc_id, CASE WHEN len(g) > 0 THEN (len(list_distinct(g)) * 1000 // len(g))::BIGINT END AS permille FROM g",
    ),
    "repetition_ratio": (repetition_ratio, None),
    "token_estimate": (
        token_estimate,
        f"""WITH s AS (SELECT source, sum(strlen(text))::BIGINT AS bytes, sum(length(text))::BIGINT AS codepoints, sum(CASE WHEN {UNITS} = '' THEN 0 ELSE len(string_split({UNITS}, ' ')) END)::BIGINT AS units FROM documents WHERE text IS NOT NULL GROUP BY source)
        SELECT *, greatest(units, (codepoints + 5) // 6) AS lower_bound, greatest(units, (codepoints + 5) // 6, (codepoints + 3) // 4) AS estimate, greatest(units, (codepoints + 5) // 6, (codepoints + 3) // 4, (codepoints + 1) // 2) AS upper_bound FROM s""",
    ),
    "language_subtag": (
        language_subtag,
        """WITH d AS (SELECT nullif(regexp_extract(lower(trim(lang)), '^([^-_]*)', 1), '') AS subtag FROM documents)
        SELECT subtag, CASE WHEN subtag IS NULL OR subtag = 'und' THEN 'applied_language_unknown' WHEN subtag = 'tr' THEN 'applied' ELSE 'not_evaluated' END AS status, count(*) AS documents FROM d GROUP BY ALL""",
    ),
    "heldout_split": (heldout_split, "SELECT doc_id, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 25 = 0 THEN 'held_out' ELSE 'train' END AS partition FROM documents WHERE text IS NOT NULL"),
    "token_perturbations": (token_perturbations, f"WITH {perturbed_sql('documents', 'doc_id')} SELECT doc_id, kind, md5(array_to_string(v, ' ')) AS text_md5, len(v)::BIGINT AS words FROM pt"),
    "packed_documents": (packed_documents, None),
    "length_buckets": (
        length_buckets,
        f"""WITH d AS (SELECT len(regexp_extract_all(text, {LOCAL})) AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT CASE WHEN n >= 32 THEN '32+' WHEN n >= 16 THEN '16-31' WHEN n >= 8 THEN '8-15' ELSE '5-7' END AS bucket, count(*) AS documents FROM d WHERE n >= 5 GROUP BY 1)
        SELECT bucket, documents, ((documents * 10000 + (SELECT sum(documents) FROM b) // 2) // (SELECT sum(documents) FROM b))::BIGINT AS share_points FROM b""",
    ),
    "token_length_quantiles": (
        token_length_quantiles,
        f"WITH d AS (SELECT source, len(regexp_extract_all(text, {LOCAL})) AS n FROM documents WHERE text IS NOT NULL) SELECT source, count(*) AS documents, quantile_disc(n, 0.5)::BIGINT AS p50, quantile_disc(n, 0.9)::BIGINT AS p90, quantile_disc(n, 0.95)::BIGINT AS p95, quantile_disc(n, 0.99)::BIGINT AS p99 FROM d GROUP BY source",
    ),
    "encoding_statistics": (
        encoding_statistics,
        r"SELECT source, sum(len(regexp_extract_all(text, '\x{FFFD}')))::BIGINT AS replacement_chars, sum(len(regexp_extract_all(text, '[ÃÂ][\x{80}-\x{BF}]|â€')))::BIGINT AS sequences, count(*) FILTER (contains(text, chr(65533))) AS documents FROM documents WHERE text IS NOT NULL GROUP BY source",
    ),
    "document_positions": (document_positions, "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY source_ordinal, doc_id) AS position FROM documents"),
}
