"""Audit sheets, verdict and drop lists, and tables bound to the identity of what made them."""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T

SHEET_LIMIT = 100_000  # rows of a sheet that people read; larger frames are refused, never cut


def policy_identity(rules: list[tuple[str, str]]) -> str:
    """One hash over ordered (name, definition) pairs: equal rules have equal identities."""
    return hashlib.sha256("".join(f"{name}\x1f{definition}\n" for name, definition in rules).encode()).hexdigest()


def write_sheet(rows: DataFrame, path: str, order: list[str], headers: dict[str, str] | None = None) -> str:
    """An audit sheet for people: byte-order mark, comment lines, then comma-separated rows.

    A sheet is a bounded sample by its purpose; a frame of more than
    SHEET_LIMIT rows is an error before anything is written.
    """
    taken = rows.orderBy(*order).limit(SHEET_LIMIT + 1).collect()
    if len(taken) > SHEET_LIMIT:
        raise ValueError(f"a sheet has at most {SHEET_LIMIT} rows")
    out = io.StringIO()
    for k, v in (headers or {}).items():
        out.write(f"# {k}: {v}\n")
    made = csv.writer(out, lineterminator="\n")
    made.writerow(rows.columns)
    made.writerows(["" if v is None else v for v in r] for r in taken)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(out.getvalue())
    return hashlib.sha256(("﻿" + out.getvalue()).encode()).hexdigest()


def read_sheet(spark: SparkSession, path: str, key: str = "sha256", verdict: str = "verdict") -> tuple[DataFrame, dict[str, str]]:
    """(rows, headers) of an audit sheet; a key listed twice is an error, verdicts come back trimmed and in small letters."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    headers = {r["k"]: r["v"] for r in lines.where(F.col("value").rlike("^# [^:]+: ")).select(F.regexp_extract("value", "^# ([^:]+): ", 1).alias("k"), F.regexp_extract("value", "^# [^:]+: (.*)$", 1).alias("v")).collect()}  # comment lines
    with open(path, encoding="utf-8-sig", newline="") as f:
        names = next(row for row in csv.reader(line for line in f if not line.startswith("#")))
    rows = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), comment="#", multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.where(~(F.regexp_replace(F.col(f"`{names[0]}`"), "^﻿", "") == names[0]))
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"listed twice: {twice[0][key]}")
    return rows.withColumn(verdict, F.nullif(F.lower(F.trim(verdict)), F.lit(""))) if verdict in names else rows, headers


def read_verdicts(spark: SparkSession, path: str, expected: DataFrame, key: str = "no") -> tuple[DataFrame, DataFrame]:
    """(verdicts, missing) of a JSON-lines file; a number that was not asked or that comes twice is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{key} long, verdict string, kind string, reason string").alias("v")).select("v.*")
    twice = raw.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    unknown = raw.join(expected.select(key), key, "left_anti").limit(1).collect()
    if twice or unknown:
        raise ValueError(f"verdict listed twice: {twice[0][key]}" if twice else f"verdict of an unknown number: {unknown[0][key]}")
    return raw, expected.select(key).join(raw.select(key), key, "left_anti")


def read_drop_list(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, reason, details) of a JSON-lines drop list; the last line of a hash wins, other fields stay in details."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row")).where(F.trim("value") != "")
    d = raw.select(F.lower(F.get_json_object("value", "$.sha256")).alias("sha256"), F.get_json_object("value", "$.reason").alias("reason"), F.col("value").alias("details"), "row")
    bad = d.where(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"no hash in drop list: {bad[0]['details'][:80]}")
    return d.groupBy("sha256").agg(F.max_by(F.struct("reason", "details"), "row").alias("d")).select("sha256", "d.reason", "d.details")


def write_bound(rows: DataFrame, path: str, identity: str) -> None:
    """A table under the identity of the rules that made it; other identities stay beside it."""
    rows.write.mode("overwrite").parquet(f"{path}/identity={identity}")


def read_bound(spark: SparkSession, path: str, identity: str) -> DataFrame | None:
    """The table made by these rules; None where other rules made all that is there, so it must be made anew."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/identity={identity}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/identity={identity}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.parquet(f"{path}/identity={identity}")


def legacy_documents(lines: DataFrame, source_id: str, license_id: str | None = None) -> DataFrame:
    """Document rows of numbered lines (source_ordinal, line): the text of a JSON object or the line itself; blank lines keep their ordinal and give no row."""
    line = F.col("line")
    field = lambda k: F.nullif(F.trim(F.get_json_object(line, f"$.{k}")), F.lit(""))
    text = F.when(F.ltrim(line).startswith("{"), F.coalesce(field("text"), field("content"), field("body"), line)).otherwise(line)
    d = lines.where(line.isNotNull() & (F.trim(F.regexp_replace(line, T.SPACES, " ")) != ""))
    url = F.when(F.ltrim(line).startswith("{"), F.coalesce(F.get_json_object(line, "$.url"), F.get_json_object(line, "$.provenance.url")))
    return d.select(F.sha2(text, 256).alias("doc_id"), text.alias("text"), F.lit(source_id).alias("source_id"), "source_ordinal", url.alias("url"), F.lit(license_id).cast("string").alias("license_id"))


def canonical_pass(lines: DataFrame) -> DataFrame:
    """Lines with whether each is a canonical sample: an object with a version, messages and only known fields. Lines stay as they are."""
    known = ["schema_version", "record_type", "sample_id", "content_purpose", "task_type", "language", "domain", "train_policy", "created_at", "created_by", "messages", "tools", "preference", "metadata"]
    valid = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
    keys = F.when(valid, F.json_object_keys("line"))
    tests: dict[str, Column] = {
        "not_an_object": ~F.coalesce(valid, F.lit(False)),
        "unknown_field": F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0, F.lit(False)),
        "no_version": valid & ~F.coalesce(F.array_contains(keys, "schema_version"), F.lit(False)),
        "no_messages": valid & ~F.coalesce(F.array_contains(keys, "messages") | F.array_contains(keys, "preference"), F.lit(False)),
    }
    return lines.withColumn("problems", F.array_join(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull()), "|"))


def write_export(docs: DataFrame, path: str, order: list[str]) -> DataFrame:
    """JSON lines of documents with all their fields in global order; gives rows, bytes and a hash of each file's lines in order."""
    line = F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"})
    made = docs.select(*order, line.alias("value")).repartitionByRange(*order).sortWithinPartitions(*order)
    made.select("value").write.text(path)
    back = docs.sparkSession.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    w = Window.partitionBy("file").orderBy("block", "row")
    each = back.select("file", F.octet_length("value").alias("n"), F.sha2(F.concat_ws(":", F.row_number().over(w).cast("string"), "value"), 256).alias("h"))
    part = F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")  # numbered lines, so a sum tells order too and needs no list
    return each.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("n") + 1).alias("bytes"), F.sum(part).alias("checksum"))


def card_front_matter(fields: dict[str, object]) -> str:
    """Front matter of a dataset card: scalars and lists, names in order."""
    out = ["---"]
    for k in sorted(fields):
        v = fields[k]
        if isinstance(v, list | tuple):
            out += [f"{k}:", *(f"- {json.dumps(x, ensure_ascii=False)}" for x in v)]
        else:
            out.append(f"{k}: {json.dumps(v, ensure_ascii=False)}")
    return "\n".join([*out, "---", ""])
