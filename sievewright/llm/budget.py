"""Problem 4: token budget by source, language and domain.

A worker loads the tokenizer once and encodes all its documents in batches;
exact counts are summed by source before any shuffle, and the few sums are
joined with the newest version of each release source and cubed. The stored
estimates come beside them: the newest estimate of a document counts.

Defined results: null and empty texts have zero tokens; documents of an
unknown or null source count under language and domain 'unknown'; spellings
of languages and domains are united (primary subtag, first part, lower case);
estimates that are null are left out of the sum and of its document count;
documents without id keep their tokens; empty tables give no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.bpe import PATTERN, VOCABULARY
from sievewright.tables import spread


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source_id, tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            counts = [len(ids) for a in range(0, len(texts), 500) for ids in encoder.encode_ordinary_batch(texts[a : a + 500], num_threads=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source_id", "tokens"])

    rows = docs.select(docs[id_col].cast("long"), docs[source_col].cast("string"), docs[text_col].cast("string"))
    return spread(rows).mapInArrow(run, "doc_id long, source_id string, tokens long")


def spelled(c: Column) -> Column:
    """One spelling of a language or domain tag."""
    return F.coalesce(F.nullif(F.regexp_extract(F.translate(F.lower(F.translate(F.trim(c), "İI", "ii")), "ı", "i"), r"^([^-_\s]+)", 1), F.lit("")), F.lit("unknown"))


def source_tags(sources: DataFrame) -> DataFrame:
    """(source_id, source_language, source_domain) of each source's newest version."""
    newest = F.max_by(F.struct("source_language", "source_domain"), F.struct("source_version", "added_at")).alias("s")
    return sources.groupBy("source_id").agg(newest).select("source_id", spelled(F.col("s.source_language")).alias("source_language"), spelled(F.col("s.source_domain")).alias("source_domain"))


def estimates_by_source(estimates: DataFrame) -> DataFrame:
    """Sum of each document's newest estimate."""
    newest = F.max_by("estimated_token_count", F.struct("estimated_at", "estimate_method", F.coalesce("estimated_token_count", F.lit(-1)))).alias("n")
    each = estimates.groupBy("source_id", "doc_id").agg(newest)
    return each.groupBy("source_id").agg(F.sum("n").alias("estimated_tokens"), F.count("n").alias("estimated_documents"))


def cube(sums: DataFrame, sources: DataFrame, measures: list[str]) -> DataFrame:
    tagged = sums.join(source_tags(sources), "source_id", "left")
    named = tagged.select(F.coalesce("source_id", F.lit("unknown")).alias("source_id"), *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("source_language", "source_domain")), *measures)
    out = named.cube("source_id", "source_language", "source_domain").agg(F.grouping_id().alias("level"), *(F.sum(m).alias(m) for m in measures))
    return out.select("source_id", "source_language", "source_domain", F.col("level").cast("int").alias("level"), *measures)


def token_budget(docs: DataFrame, estimates: DataFrame, sources: DataFrame, path: str = VOCABULARY) -> DataFrame:
    exact = token_counts(docs, path=path).groupBy("source_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    both = exact.join(estimates_by_source(estimates), "source_id", "full")
    return cube(both, sources, ["documents", "tokens", "estimated_documents", "estimated_tokens"])


def estimate_budget(estimates: DataFrame, sources: DataFrame) -> DataFrame:
    return cube(estimates_by_source(estimates), sources, ["estimated_documents", "estimated_tokens"])


ESTIMATE_SQL = """
WITH newest AS (
  SELECT source_id, doc_id, last(estimated_token_count ORDER BY estimated_at, estimate_method, coalesce(estimated_token_count, -1)) AS n
  FROM token_estimates GROUP BY source_id, doc_id),
sums AS (SELECT source_id, count(n) AS estimated_documents, sum(n) AS estimated_tokens FROM newest GROUP BY source_id),
versions AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY source_version DESC, added_at DESC) AS k FROM release_sources),
tags AS (SELECT source_id,
  coalesce(nullif(regexp_extract(translate(lower(translate(trim(source_language), 'İI', 'ii')), 'ı', 'i'), '^([^-_\\s]+)', 1), ''), 'unknown') AS source_language,
  coalesce(nullif(regexp_extract(translate(lower(translate(trim(source_domain), 'İI', 'ii')), 'ı', 'i'), '^([^-_\\s]+)', 1), ''), 'unknown') AS source_domain
  FROM versions WHERE k = 1),
named AS (SELECT coalesce(s.source_id, 'unknown') AS source_id, coalesce(source_language, 'unknown') AS source_language, coalesce(source_domain, 'unknown') AS source_domain, estimated_documents, estimated_tokens
  FROM sums s LEFT JOIN tags t ON s.source_id = t.source_id)
SELECT source_id, source_language, source_domain,
  CAST(grouping(source_id, source_language, source_domain) AS INT) AS level,
  CAST(sum(estimated_documents) AS BIGINT) AS estimated_documents, CAST(sum(estimated_tokens) AS BIGINT) AS estimated_tokens
FROM named GROUP BY CUBE (source_id, source_language, source_domain)"""
