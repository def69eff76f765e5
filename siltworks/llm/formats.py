"""Duplicates hidden by formatting differences (problem 6)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import blank_to_null, folded
from siltworks.operators.skew import salted_join
from siltworks.plans.runtime import materialize, shuffle_partitions

_OTHER = re.compile("[^a-z0-9]+")


def _refuse(name: str):
    raise ValueError(name)


def _value(v) -> object:
    """A value as text, folded; arrays entry by entry."""
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    text = {True: "true", False: "false", None: "null"}[v] if v is None or isinstance(v, bool) else v
    return _OTHER.sub("", text.lower())


def canonical_json(line: str | None) -> str | None:
    """The record of a JSON object with its fields in order of their names and its values as folded text; None for anything else. Numbers keep their spelling; of a field named twice the last counts."""
    try:
        record = json.loads(line, parse_float=str, parse_int=str, parse_constant=_refuse) if line else None
    except (ValueError, RecursionError):
        return None
    return json.dumps(_value(record), sort_keys=True, ensure_ascii=True, separators=(",", ":")) if isinstance(record, dict) else None


def _canonical_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical_json(x) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "canon"])


def canonical_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, canon): the folded text, null where it is empty."""
    return df.select(F.col(key).cast("long").alias("id"), blank_to_null(folded(F.col(text))).alias("canon"))


def canonical_records(df: DataFrame, key: str, line: str) -> DataFrame:
    """(id, canon): the canonical form of a line's JSON object, null without one."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(line)).mapInArrow(_canonical_rows, "id long, canon string")


def _runs(counting: bool):
    """Rows sorted by (h, canon, id) -> (edge, h, canon, first, id, n): for a whole run inside a batch one row a copy with the run's first id, or counting one row with its first id and its number of rows; for a partition's first run, its last one and those that go on in another batch, which may go on elsewhere, every row with the key and n = 1. A repeated id is one row."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None  # (h, canon, first id, last id) of the run that the last batch ended in
        opening = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, canon, who = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            new = np.ones(len(h), bool)
            if len(h) > 1:
                new[1:] = (h[1:] != h[:-1]) | pc.not_equal(canon[1:], canon[:-1]).to_numpy(zero_copy_only=False)
            if tail is not None and h[0] == tail[0] and canon[0].as_py() == tail[1]:
                new[0] = False
            run = np.cumsum(new)
            firsts = who[new]
            first = firsts[run - 1] if new[0] else np.concatenate([[tail[2]], firsts])[run]
            if opening is None:
                opening = (int(h[0]), canon[0].as_py())
            again = ~new & (who == np.concatenate([[tail[3] if tail is not None else who[0]], who[:-1]]))
            size = np.bincount(run, ~again)
            in_open = (h == opening[0]) & pc.equal(canon, pa.scalar(opening[1], canon.type)).to_numpy(zero_copy_only=False)
            edge = in_open | (run == run[-1]) | ((run == run[0]) & (not new[0]))
            give = ~again & (edge | (new if counting else who != first))
            picked = canon.take(pa.array(np.flatnonzero(give))).to_pylist()
            flags = edge[give]
            n = np.where(flags, 1, size[run[give]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flags), pa.array(h[give]), pa.array([c if f else None for c, f in zip(picked, flags)], pa.string()), pa.array(first[give]), pa.array(who[give]), pa.array(n)], names=["edge", "h", "canon", "first", "id", "n"])
            tail = (int(h[-1]), canon[-1].as_py(), int(first[-1]), int(who[-1]))

    return run_


def _scanned(records: DataFrame, counting: bool) -> DataFrame:
    """What _runs gives of records (id, canon), range-partitioned by a hash of the canonical form and the id and sorted; edge rows name their form by its digest.

    The canonical forms are written once, so that the ranges are sampled from the hashes alone."""
    keyed = materialize(records.where(F.col("canon").isNotNull() & F.col("id").isNotNull()).select(F.xxhash64("canon").alias("h"), "canon", "id"))
    rows = keyed.repartitionByRange(shuffle_partitions(records.sparkSession), "h", "id").sortWithinPartitions("h", "canon", "id").mapInArrow(_runs(counting), "edge boolean, h long, canon string, first long, id long, n long")
    return materialize(rows.select("edge", F.sha2("canon", 256).alias("digest"), "first", "id", "n"))


def copy_pairs(records: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of every record (id, canon) whose canonical form an earlier one has, the one with the smallest id.

    The records are range-partitioned by a hash of the canonical form and the id, so that even a form that a third of all rows has spreads over many partitions, sorted within, and scanned; adjacent full forms are compared. Runs at a partition's ends and at the ends of the scanner's batches, a bounded number for each batch, are put together by their key afterwards. Null forms and null ids are left out; a repeated id is one record."""
    given = _scanned(records, False)
    inner = given.where(~F.col("edge")).select(F.col("first").alias("keep_id"), F.col("id").alias("copy_id"))
    edges = given.where(F.col("edge"))
    heads = edges.groupBy("digest").agg(F.min("first").alias("keep_id"))
    outer = salted_join(edges, heads, "digest", "inner").where(F.col("id") != F.col("keep_id")).select("keep_id", F.col("id").alias("copy_id"))
    return inner.unionByName(outer).where("keep_id < copy_id").distinct()


def collapse_copies(records: DataFrame) -> DataFrame:
    """(keep_id, copies): one representative for each canonical form and the number of records that have it. Records without a form are left out; empty input gives no row."""
    given = _scanned(records, True)
    inner = given.where(~F.col("edge")).select(F.col("first").alias("keep_id"), F.col("n").alias("copies"))
    outer = given.where("edge").groupBy("digest").agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies")).drop("digest")
    return inner.unionByName(outer)
