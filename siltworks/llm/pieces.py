"""Splitting oversized texts at natural boundaries (problem 5)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries by strength: a cut may follow a match's end. A blank line, a closing brace in the first column, a line, a statement, a blank.
_BOUNDARIES = [re.compile(p) for p in (r"\n[ \t\r]*\n+|\n\}[^\n]*\n", r"\n", r"[;{}]+[ \t]*", r"\s+")]


def cut_points(text: str, limit: int = 6000, overlap: int = 200) -> list[tuple[int, int]]:
    """[start, end) of each piece: at most ``limit`` characters, together the whole text, each but the first beginning about ``overlap`` characters before the end of the one before.

    The least possible number of pieces gets equal targets; each target moves to the strongest boundary within a quarter of the slack around it (of equal ones the nearest), and where a piece would exceed the limit, one more piece is tried. Without any boundary the cut is at the target itself. A piece begins at a line or, failing that, statement boundary between half and one and a half times the overlap, otherwise exactly at the overlap."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = min(overlap, limit // 4)
    ends = [[m.end() for m in p.finditer(text)] for p in _BOUNDARIES]
    most = overlap + overlap // 2
    count = max(2, math.ceil((n - overlap) / (limit - overlap)))
    while True:
        step = (n - overlap) / count
        reach = max(1, int(min(step, limit) / 4))
        pieces, start, ok = [], 0, True
        for i in range(1, count):
            target = int(i * step) + overlap
            low, high = max(start + most + 1, target - reach), min(target + reach, start + limit, n - 1)
            if high < low:
                ok = False
                break
            cut = None
            for e in ends:
                a, b = bisect_left(e, low), bisect_right(e, high)
                if a < b:
                    c = bisect_left(e, target, a, b)
                    cut = min((x for x in e[max(a, c - 1) : min(b, c + 1)]), key=lambda x: (abs(x - target), x))
                    break
            cut = min(max(target, low), high) if cut is None else cut
            pieces.append((start, cut))
            begin = cut - overlap
            for e in ends[1:3]:
                a, b = bisect_left(e, cut - most), bisect_right(e, cut - overlap // 2)
                if a < b:
                    begin = min(e[a:b], key=lambda x: (abs(cut - overlap - x), x))
                    break
            start = begin
        if ok and n - start <= limit and all(e - s <= limit for s, e in pieces):
            return [*pieces, (start, n)]
        count += 1


_PIECE = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)


def _cut(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = cut_points(text, limit, overlap)
                out.extend((i, no, len(at), s, e, text[s:e]) for no, (s, e) in enumerate(at))
                size += len(text)
                if size > 4_000_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


def split_oversized(df: DataFrame, key: str = "fn_id", text: str = "func", limit: int = 6000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, pieces, start, end, text) of every text longer than ``limit`` code points, by cut_points.

    Texts within the limit and null texts stay in the JVM and give no row. Rows with the same or a null key are cut each by itself."""
    long_ = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    return long_.mapInArrow(_cut(limit, overlap), "id long, piece_no int, pieces int, start int, end int, text string").withColumnRenamed("id", key)
