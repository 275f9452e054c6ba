"""Reading and writing of line, JSON, tab-separated and Parquet sources."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

DOCUMENT_SCHEMA = """doc_id string, text string, source_id string, source_ordinal bigint,
    provenance struct<dataset:string,revision:string,file:string,row:bigint,external_id:string,url:string,crawl_date:string>,
    language struct<declared:string,detected:string,score:double>, signals map<string,double>, license_id string, extra string"""
MAX_LINE_BYTES = 262144


def bare_path(path: str) -> str:
    """A path without its scheme, relative ones made whole."""
    return re.sub("^[a-z0-9]+:/*(?=/)", "", path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path))


def file_path() -> Column:
    """Whole path of a row's file as bare_path gives it, so that equal base names in two folders stay apart."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*(?=/)", "")


def file_facts(spark: SparkSession, paths: list[str], chunk: int = 8 << 20) -> DataFrame:
    """(path, length, sha256, line_feeds, utf8) of whole files of any size, each streamed by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
                digest, decoder, n, feeds, valid = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), 0, 0, True
                with system.open_input_stream(place) as f:
                    while part := f.read(chunk):
                        digest.update(part)
                        n, feeds = n + len(part), feeds + part.count(b"\n")
                        try:
                            decoder.decode(part)
                        except UnicodeDecodeError:
                            valid = False
                try:
                    decoder.decode(b"", final=True)
                except UnicodeDecodeError:
                    valid = False
                rows.append((path, n, digest.hexdigest(), feeds, valid))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256", "line_feeds", "utf8"])

    one_each = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return one_each.mapInPandas(run, "path string, length long, sha256 string, line_feeds long, utf8 boolean")


def read_lines(spark: SparkSession, paths: list[str], max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """(file, source_ordinal, line, oversized) of text files, ordinals from 1 across the files in order.

    Lines are numbered within their file by file offset order and shifted by
    the counts of the files before; blank lines take an ordinal; an oversized
    line (bytes with its line feed) has a null line.
    """
    rank = {bare_path(p): i for i, p in enumerate(paths)}
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_name").alias("file"), file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    place = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col("path")]
    raw = raw.withColumn("file_no", place)
    # Rows of one block come in order from one task; counts by block are few, so numbering needs no global sort of lines.
    w = Window.partitionBy("file_no", "block").orderBy("row")
    numbered = raw.withColumn("in_block", F.row_number().over(w))
    counts = raw.groupBy("file_no", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file_no", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    large = F.octet_length("value") + 1 > max_bytes
    return numbered.join(before, ["file_no", "block"]).select(
        "file", (F.col("before") + F.col("in_block")).alias("source_ordinal"), F.when(~large, F.regexp_replace("value", r"\r+$", "")).alias("line"), large.alias("oversized")
    )


@dataclass
class Adapter:
    """Mapping of a foreign table onto documents.

    text and others name columns; constants fill fields that no column gives;
    signals become doubles; columns named nowhere are kept as canonical JSON
    in extra unless they are skipped on purpose.
    """

    text: str
    source_id: str
    license_id: str | None = None
    language: str | None = None
    declared_language: str | None = None
    url: str | None = None
    external_id: str | None = None
    crawl_date: str | None = None
    dataset: str | None = None
    revision: str | None = None
    signals: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    problems: list[str] = field(default_factory=list)

    def named(self) -> list[str]:
        return [c for c in (self.text, self.language, self.url, self.external_id, self.crawl_date, *self.signals) if c]

    def plan(self, columns: list[str]) -> tuple[list[str], list[str]]:
        """(columns to read, unlisted among them); a missing mapped column is an error."""
        missing = [c for c in self.named() if c not in columns]
        if missing:
            raise ValueError(f"mapped columns are missing: {missing}")
        both = [c for c in self.named() if c in self.skip]
        if both:
            raise ValueError(f"columns are both mapped and skipped: {both}")
        unlisted = sorted(c for c in columns if c not in self.named() and c not in self.skip)
        return [*dict.fromkeys(self.named()), *unlisted], unlisted

    def documents(self, rows: DataFrame, ordinal: Column) -> DataFrame:
        """Documents of the rows; only planned columns are read."""
        read, unlisted = self.plan(rows.columns)
        rows = rows.select(*read, ordinal.alias("source_ordinal"))
        text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
        values = [F.when(~F.isnan(F.col(s).try_cast("double")) & (F.abs(F.col(s).try_cast("double")) != float("inf")), F.col(s).try_cast("double")) for s in sorted(self.signals)]
        signals = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, sorted(self.signals))), F.array(*values)), lambda k, v: v.isNotNull()) if self.signals else F.create_map().cast("map<string,double>")
        extra = F.to_json(F.struct(*unlisted)) if unlisted else F.lit(None).cast("string")
        return rows.where(F.trim(F.col(self.text)) != "").select(
            F.sha2(F.col(self.text), 256).alias("doc_id"), F.col(self.text).alias("text"), F.lit(self.source_id).alias("source_id"), F.col("source_ordinal").cast("long"),
            F.struct(
                F.lit(self.dataset).cast("string").alias("dataset"), F.lit(self.revision).cast("string").alias("revision"), F.lit(None).cast("string").alias("file"), F.col("source_ordinal").cast("long").alias("row"),
                text(self.external_id).alias("external_id"), text(self.url).alias("url"), text(self.crawl_date).alias("crawl_date"),
            ).alias("provenance"),
            F.struct(F.coalesce(text(self.language), F.lit(self.declared_language).cast("string")).alias("declared"), F.lit(None).cast("string").alias("detected"), F.lit(None).cast("double").alias("score")).alias("language"),
            signals.alias("signals"), F.lit(self.license_id).cast("string").alias("license_id"), extra.alias("extra"),
        )


def read_json_lines(lines: DataFrame, schema: StructType | DataType | str) -> DataFrame:
    """Records of JSON lines; blank lines are left out, a malformed line fails the read."""
    kept = lines.where(F.trim("line") != "")
    return kept.select("source_ordinal", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("source_ordinal", "r.*")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a header, as spreadsheets write them: cells with tabs, line feeds or quotes stand in quotes, a quote inside is doubled.

    An empty cell is null and a ragged row fails the read.
    """
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="", emptyValue="", mode="FAILFAST", quote='"', escape='"', multiLine=True)


def read_shards(spark: SparkSession, paths: list[str], columns: list[str], schema: str) -> DataFrame:
    """Parquet shards of one declared schema, only the named columns read."""
    return spark.read.schema(schema).parquet(*paths).select(*columns)


def verify_manifest(spark: SparkSession, manifest: list[dict], ordinal: str = "source_ordinal") -> DataFrame:
    """Problems of each shard: size, hash, rows and strictly rising ordinals against its manifest entry."""
    paths = [m["path"] for m in manifest]
    expected = spark.createDataFrame([(m["path"], bare_path(m["path"]), m["bytes"], m["sha256"], m["rows"], m["first"], m["last"]) for m in manifest], "path string, file string, bytes long, sha256 string, rows long, first long, last long")
    here = [p for p in paths if _exists(spark, p)]
    files = file_facts(spark, here).select("path", "length", F.col("sha256").alias("sha")) if here else spark.createDataFrame([], "path string, length long, sha string")
    rows = spark.read.parquet(*here).select(file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col(ordinal).alias("o")) if here else spark.createDataFrame([], "file string, block long, row long, o long")
    rising = F.col("o") > F.lag("o").over(Window.partitionBy("file").orderBy("block", "row"))  # rows of one shard, whose size its writer bounds
    per = rows.withColumn("rising", F.coalesce(rising, F.lit(True))).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.bool_and("rising").alias("rising"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    j = expected.join(files, "path", "left").join(per, "file", "left")
    tests = {"missing": F.col("length").isNull(), "size": F.col("length") != F.col("bytes"), "hash": F.col("sha") != F.col("sha256"), "rows": F.col("n") != F.col("rows"), "ordinals": ~F.col("rising") | (F.col("lo") != F.col("first")) | (F.col("hi") != F.col("last"))}
    return j.select("path", F.array_join(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull()), "|").alias("problems"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Hash, bytes, line feeds and UTF-8 validity of whole files."""
    return file_facts(spark, paths)


def write_shards(docs: DataFrame, path: str, rows: int = 100_000) -> None:
    """Parquet shards of at most so many rows, each sorted by ordinal."""
    docs.repartitionByRange("source_id", "source_ordinal").sortWithinPartitions("source_id", "source_ordinal").write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def write_json_lines(rows: DataFrame, order: list[str], path: str) -> None:
    """Compact JSON lines with sorted names, files in global order."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    rows.select(*order, line.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def write_manifest(summary: DataFrame, path: str) -> str:
    """Small aggregate as canonical JSON with a final line feed."""
    rows = [r.asDict(recursive=True) for r in summary.orderBy(*summary.columns).collect()]
    text = json.dumps(rows, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str) + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """Append-only facts, one folder for each value of a key of few values."""
    rows.repartition(key, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(64))).write.mode("append").partitionBy(key).parquet(path)
