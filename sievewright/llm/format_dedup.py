"""Problem 2: records that differ only in formatting.

A record is JSON, tab-separated ``key=value`` fields, or plain text. Its
canonical form is the kind of line plus its sorted (name, value) fields, each
value without white space and punctuation and with letter case folded
(i, ı, İ and I are one letter, ß is ss).

Canonical records are written once, range-partitioned by (hash of the key,
record id) and sorted in each partition by (hash, full key, record id);
Spark's sort spills.
One scan then compares full neighbouring keys. A group may span any number of
partitions, so a group with a third of all rows is still spread evenly; the
first and last runs of each partition are stitched through a table of at most
two hashes a partition.

Defined results: a null line belongs to no group; an unfinished JSON line
equals nothing; a blank line is plain text with an empty value and equals
other blank lines; rows without record id are counted as copies but never
named, and a group of such rows alone has no first id; repeated (record id,
line) rows count once each as copies while the id pairs stay distinct; the
largest possible id stands for none; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.tables import spread, written

FIELD, VALUE, NULL = "\u0001", "\u0002", "\u0003"
_PAIR = re.compile(r"\s*([A-Za-z_]\w*)=(.*)", re.S)
_DECODE = json.JSONDecoder(object_pairs_hook=list, parse_int=str, parse_float=str, strict=False).decode
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> folded code point, 0 where it is dropped."""
    if not _FOLD:
        table = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x20000):
            ch = chr(cp)
            low = ch.lower()
            if unicodedata.category(ch)[0] in "PZ" or unicodedata.category(ch) in ("Cf", "Cc") or ch.isspace() or cp == 0x307:
                table[cp] = 0
            elif len(low) == 1:
                table[cp] = ord(low)
        for ch in "İIıi":
            table[ord(ch)] = ord("i")
        for mark in (FIELD, VALUE, NULL):
            table[ord(mark)] = ord(mark)
        _FOLD.append(table)
    return _FOLD[0]


def folded(values: list[str]) -> list[str]:
    """Values without white space, punctuation and letter case, all in one pass.

    The values are joined with a mark; one table lookup folds them all.
    """
    if not values:
        return []
    joined = FIELD.join(values)
    if joined.count(FIELD) != len(values) - 1 or VALUE in joined:
        joined = FIELD.join(v.replace(FIELD, " ").replace(VALUE, " ") for v in values)
    joined = joined.replace("ß", "ss").replace("ẞ", "ss")
    points = _fold_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return points[points != 0].tobytes().decode("utf-32-le", "replace").split(FIELD)


def fields_of(line: str) -> tuple[str, list[tuple[str, str | None]]] | None:
    """(form, fields) of a line; None for an unfinished JSON object."""
    bare = line.strip().strip("\ufeff").strip()
    if bare.startswith("{"):
        try:
            pairs = _DECODE(bare)
        except (ValueError, RecursionError):
            return None
        return "j", [(str(k), v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in pairs]
    found = [_PAIR.fullmatch(part) for part in line.strip("\r\n").split("\t")]
    if all(found):
        return "k", [m.groups() for m in found]
    return "p", [("", line)]


def canonical_keys(lines: list[str | None]) -> list[str | None]:
    """Full canonical key of each line, None where it can equal no other."""
    parsed = [None if x is None else fields_of(x) for x in lines]
    values = iter(folded([NULL if v is None else v for p in parsed if p for _, v in p[1]]))
    return [None if p is None else p[0] + FIELD + FIELD.join(sorted(k + VALUE + (next(values) if v is not None else NULL + next(values)) for k, v in p[1])) for p in parsed]


NAMELESS = (1 << 63) - 1  # stands for a missing record id; sorts last


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array(canonical_keys(batch.column(1).to_pylist()), type=pa.string())
        made = pa.RecordBatch.from_arrays([batch.column(0), keys], names=["record_id", "key"])
        yield made.filter(pc.is_valid(keys))


SCANNED = "h long, first_id long, record_id long, run long, edge boolean, edge_key string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted (h, key, record_id); runs of equal full keys.

    Emits each member with the run's first id. Members of hashes that touch
    the partition's ends are marked, and the first of each such run carries
    the key for stitching. Only the runs of the current last hash are held,
    as ids, never the keys of earlier runs.
    """
    schema = pa.schema([("h", pa.int64()), ("first_id", pa.int64()), ("record_id", pa.int64()), ("run", pa.int64()), ("edge", pa.bool_()), ("edge_key", pa.string())])
    prev_h = prev_key = None
    first_id, run, first_h = None, 0, None
    held: list[pa.RecordBatch] = []  # rows whose hash may turn out to be the partition's last

    def out(*columns):
        return pa.RecordBatch.from_arrays(list(columns), schema=schema)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h, key, rid = batch.column("h"), batch.column("key"), batch.column("record_id")
        if first_h is None:
            first_h = h[0].as_py()
        starts = pa.concat_arrays([
            pa.array([prev_h is None or h[0].as_py() != prev_h or key[0].as_py() != prev_key]),
            pc.or_(pc.not_equal(h.slice(1), h.slice(0, n - 1)), pc.not_equal(key.slice(1), key.slice(0, n - 1))),
        ])
        s = starts.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(s)
        ids = rid.to_numpy(zero_copy_only=False)
        runs = run + np.cumsum(s)
        firsts = np.empty(n, dtype=np.int64)
        lead = at[0] if len(at) else n
        if lead:
            firsts[:lead] = first_id
        if len(at):
            firsts[lead:] = ids[at][np.cumsum(s)[lead:] - 1]
        run, first_id = int(runs[-1]), int(firsts[-1])
        hs = h.to_numpy(zero_copy_only=False)
        last_h = hs[-1]
        edge = hs == first_h
        keys = np.full(n, None, dtype=object)
        for i in np.flatnonzero(s & (edge | (hs == last_h))):
            keys[i] = key[int(i)].as_py()
        if held and last_h != prev_h:
            yield from held
            held = []
        body = np.searchsorted(hs, last_h, "left")
        made = out(pa.array(hs), pa.array(firsts), pa.array(ids), pa.array(runs), pa.array(edge), pa.array(keys, type=pa.string()))
        if body:
            yield made.slice(0, int(body))
        if edge[body]:  # the whole partition so far has one hash: final already
            yield made.slice(int(body))
        else:
            held.append(made.slice(int(body)))
        prev_h, prev_key = int(last_h), key[n - 1].as_py()
    for made in held:
        yield out(made.column("h"), made.column("first_id"), made.column("record_id"), made.column("run"), pa.array([True] * made.num_rows), made.column("edge_key"))


def _keyed(lines: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """(h, record_id, key) of the lines whose canonical form is known."""
    rows = lines.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NAMELESS)).alias("record_id"), F.col(line_col).cast("string").alias("line"))
    keyed = spread(rows).mapInArrow(_keys, "record_id long, key string")
    return keyed.select(F.xxhash64("key").alias("h"), "record_id", "key")


def copy_members(lines: DataFrame, id_col: str = "record_id", line_col: str = "raw_line", partitions: int | None = None) -> DataFrame:
    """(h, first_record_id, record_id) of every row whose canonical form is known; h is the hash of that form."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, as the range partitioning reads its columns twice: once to sample them
    keyed = written(_keyed(lines, id_col, line_col), "keys").repartitionByRange(n, "h", "record_id").sortWithinPartitions("h", "key", "record_id")
    scanned = written(keyed.mapInArrow(_scan, SCANNED), "runs")
    # At most two hashes a partition: bounded by the number of partitions, not by the data.
    edges = scanned.where(F.col("edge") & F.col("edge_key").isNotNull()).select(F.col("h").alias("eh"), "edge_key", F.col("first_id").alias("local_id"))
    edges = edges.select("eh", "local_id", F.min("local_id").over(Window.partitionBy("eh", "edge_key")).alias("whole_id")).distinct()
    inner = scanned.where(~F.col("edge")).select("h", F.col("first_id").alias("first_record_id"), "record_id")
    outer = scanned.where("edge").join(F.broadcast(edges), (F.col("h") == F.col("eh")) & (F.col("first_id") == F.col("local_id")))
    return inner.unionByName(outer.select("h", F.col("whole_id").alias("first_record_id"), "record_id"))


def copy_pairs(lines: DataFrame, id_col: str = "record_id", line_col: str = "raw_line", partitions: int | None = None) -> DataFrame:
    """(first_record_id, copy_record_id): the group's smallest id with each other id."""
    named = lines.where(F.col(id_col).isNotNull())
    return (
        copy_members(named, id_col, line_col, partitions)
        .where("record_id <> first_record_id")
        .select("first_record_id", F.col("record_id").alias("copy_record_id"))
    )


def representatives(lines: DataFrame, id_col: str = "record_id", line_col: str = "raw_line", partitions: int | None = None) -> DataFrame:
    """One row per group: its smallest record id, that record's line and the exact number of copies.

    Copies are counted over ids alone, then each line is joined once. Groups of
    nameless rows are told by the 64-bit hash of their canonical form, and the
    smallest of their lines stands for them, as it does where one id stands on
    several lines.
    """
    counts = copy_members(lines, id_col, line_col, partitions).groupBy("first_record_id", "h").agg(F.count(F.lit(1)).alias("copies"))
    texts = lines.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("first_record_id")).agg(F.min(F.col(line_col).cast("string")).alias("record"))
    named = counts.where(F.col("first_record_id") != NAMELESS).join(texts, "first_record_id")
    bare = lines.where(F.col(id_col).isNull() & F.col(line_col).isNotNull())
    keyed = bare.select(F.lit(NAMELESS).alias("record_id"), F.col(line_col).cast("string").alias("line")).mapInArrow(_with_line, "h_key string, line string")
    spoken = keyed.groupBy(F.xxhash64("h_key").alias("h")).agg(F.min("line").alias("record"))
    nameless = counts.where(F.col("first_record_id") == NAMELESS).join(spoken, "h")
    return named.select("first_record_id", "record", "copies").unionByName(nameless.select(F.lit(None).cast("long").alias("first_record_id"), "record", "copies"))


def _with_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array(canonical_keys(batch.column(1).to_pylist()), type=pa.string())
        yield pa.RecordBatch.from_arrays([keys, batch.column(1)], names=["h_key", "line"]).filter(pc.is_valid(keys))
