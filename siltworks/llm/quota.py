"""A sample whose categories hold wanted shares (problem 1)."""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import cwe_class

#: Rows of a targets table at most: their quotas are found on the driver and broadcast.
CATEGORIES = 100_000


def _max_flow(n: int, edges: list[tuple[int, int, int]], s: int, t: int) -> list[int]:
    """The flow on each edge of a maximum flow (shortest augmenting paths; the graph has one edge a category)."""
    to, cap, out = [], [], [[] for _ in range(n)]
    for u, v, c in edges:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(0)
    while True:
        came: dict[int, int] = {s: -1}
        queue = deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] and to[e] not in came:
                    came[to[e]] = e
                    queue.append(to[e])
        if t not in came:
            return [cap[2 * i + 1] for i in range(len(edges))]
        path, v = [], t
        while v != s:
            path.append(came[v])
            v = to[came[v] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def unmet(cells: dict[tuple, tuple[int, int]]) -> dict[tuple, int]:
    """What each category lacks: the capacity that a maximum flow from the rows available (first number) to the rows needed (second) leaves open at the categories; only categories that lack some are named."""
    order = sorted(cells, key=str)
    n = len(order)
    edges = [(2 * n, i, cells[c][0]) for i, c in enumerate(order)] + [(i, n + i, max(cells[c])) for i, c in enumerate(order)] + [(n + i, 2 * n + 1, cells[c][1]) for i, c in enumerate(order)]
    flow = _max_flow(2 * n + 2, edges, 2 * n, 2 * n + 1)[2 * n :]
    return {c: cells[c][1] - f for c, f in zip(order, flow) if f < cells[c][1]}


def controlled_rounding(cells: dict[tuple, Fraction], bounds: dict[tuple, tuple[int, int]] | None = None) -> dict[tuple, int]:
    """Integer quotas of a fractional two-way table: every cell, every row total, every column total and the grand total become the integer below or above.

    What is above the integer below is rounded by a feasible flow rows -> columns with lower and upper bounds; it exists as the fractions themselves are one. Integer entries stay. bounds: other lower and upper bounds of cells, as for minimum rows and rows available; totals then keep their integers as far as the bounds let them reach, and where no table has all of them, first the totals of rows and then those of columns are given up."""
    box = {k: (math.floor(x), math.ceil(x)) for k, x in cells.items()} | (bounds or {})
    for free in ((), ("r",), ("r", "c")):
        found = _bounded_table(cells, box, free)
        if found is not None:
            return found
    raise AssertionError("every cell at its lower bound is a table")


def _bounded_table(cells: dict[tuple, Fraction], box: dict[tuple, tuple[int, int]], free: tuple[str, ...]) -> dict[tuple, int] | None:
    rows, cols = sorted({r for r, _ in cells}, key=str), sorted({c for _, c in cells}, key=str)
    node = {("r", r): 2 + i for i, r in enumerate(rows)} | {("c", c): 2 + len(rows) + i for i, c in enumerate(cols)}
    n = 4 + len(rows) + len(cols)
    top, bottom = n - 2, n - 1
    edges: list[tuple[int, int, int]] = []
    excess = [0] * n
    placed: list[tuple[tuple | None, int]] = []

    def bounded(u: int, v: int, low: int, high: int, cell: tuple | None = None) -> None:
        placed.append((cell, low))
        edges.append((u, v, high - low))
        excess[v] += low
        excess[u] -= low

    def total(which: list[tuple], kind: str) -> tuple[int, int]:
        least, most, x = sum(box[k][0] for k in which), sum(box[k][1] for k in which), sum((cells[k] for k in which), Fraction(0))
        return (least, most) if kind in free else (min(max(math.floor(x), least), most), max(min(math.ceil(x), most), least))

    for k in sorted(cells, key=str):
        bounded(node["r", k[0]], node["c", k[1]], *box[k], k)
    for r in rows:
        bounded(0, node["r", r], *total([k for k in cells if k[0] == r], "r"))
    for c in cols:
        bounded(node["c", c], 1, *total([k for k in cells if k[1] == c], "c"))
    bounded(1, 0, *total(list(cells), "c"))
    for v, x in enumerate(excess):
        if x > 0:
            edges.append((top, v, x))
        elif x < 0:
            edges.append((v, bottom, -x))
    flow = _max_flow(n, edges, top, bottom)
    if any(f < c for (u, _, c), f in zip(edges, flow) if u == top):
        return None
    return {cell: low + f for (cell, low), f in zip(placed, flow) if cell is not None}


def target_report(df: DataFrame, targets: DataFrame, divisor: int = 10, target: str = "target", cwe: str = "cwe") -> DataFrame:
    """One row for each wanted category: available rows, rows needed, the quota drawn and whether it falls short.

    The sample has S = rows // divisor rows. Needed is the larger of min_rows and share_permille * S / 1000 rounded up. The quota is the controlled rounding of the shares with min_rows and the rows available as bounds of the flow; a category falls short where the flow from the rows available does not fill its need. A row counts by its target 0 or 1 and its class of ``cwe`` (``none`` without one); other targets count in S only. Targets named twice are added up (the larger minimum holds); a null share or minimum is 0. An empty table gives S = 0 and every needed minimum short. The targets table is a parameter, one row a category; more than 100,000 rows are refused."""
    spark = df.sparkSession
    wanted: dict[tuple, list[int]] = {}
    named_rows = targets.select("target", "cwe", "share_permille", "min_rows").limit(CATEGORIES + 1).collect()
    if len(named_rows) > CATEGORIES:
        raise ValueError(f"more than {CATEGORIES} rows of targets")
    for r in named_rows:
        w = wanted.setdefault((r.target, r.cwe), [0, 0])
        w[0] += r.share_permille or 0
        w[1] = max(w[1], r.min_rows or 0)
    counts = df.groupBy(F.col(target).alias("t"), cwe_class(F.col(cwe)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    names = targets.select(F.col("target").alias("t"), F.col("cwe").alias("c"), F.lit(True).alias("named")).distinct()
    per = counts.join(names, ["t", "c"], "left").groupBy("named", *[F.when(F.col("named"), F.col(x)).alias(x) for x in "tc"]).agg(F.sum("n").alias("n")).collect()  # one row a category and one for the rest
    have, total = {(r.t, r.c): r.n for r in per if r.named}, sum(r.n for r in per)
    size = total // divisor
    share = {k: Fraction(s * size, 1000) for k, (s, _) in wanted.items()}
    need = {k: (have.get(k, 0), max(least, math.ceil(share[k]))) for k, (_, least) in wanted.items()}
    lack = unmet(need)
    box = {k: tuple(min(max(edge(share[k]), least), have.get(k, 0)) for edge in (math.floor, math.ceil)) for k, (_, least) in wanted.items()}
    quota = controlled_rounding(share, box)
    rows = [(*k, *need[k], quota[k], k in lack) for k in wanted]
    return spark.createDataFrame(rows, "target int, cwe string, available long, needed long, quota long, short boolean")


def quota_sample(df: DataFrame, targets: DataFrame, divisor: int = 10, seed: int = 42, key: str = "fn_id", target: str = "target", cwe: str = "cwe") -> DataFrame:
    """Exactly the quota of rows of each category (target_report), those with the smallest random keys, with every column of df and the category as sample_cwe (a column of that name is replaced).

    The random key is a hash of the seed and the row's key. A histogram over hash buckets finds for each category the bucket in which its quota ends; rows of earlier buckets are taken as they are and only that bucket's rows are ranked, so no category is gathered in one task. Rows with the same key (repeated or null) tie and are told apart by a hash of the whole row and then arbitrarily; the quota holds. Rows outside the wanted categories are never drawn."""
    report = target_report(df, targets, divisor, target, cwe)
    quotas = F.broadcast(report.select(F.col("target").alias("__t"), F.col("cwe").alias("__c"), F.col("quota").alias("__q")))  # one row a category
    drawn = [F.col(target).alias("__t"), cwe_class(F.col(cwe)).alias("__c"), F.xxhash64(F.lit(seed), F.col(key)).alias("__h")]
    bucket = F.shiftrightunsigned("__h", 50).cast("int")
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *drawn).withColumn("__b", bucket)
    narrow = df.select(*drawn).withColumn("__b", bucket).drop("__h")
    counts = narrow.join(quotas, ["__t", "__c"]).groupBy("__t", "__c", "__q", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__t", "__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("__before", before).where((F.col("__before") < F.col("__q")) & (F.col("__before") + F.col("__n") >= F.col("__q")))
    cut = F.broadcast(cut.select("__t", "__c", F.col("__b").alias("__edge"), (F.col("__q") - F.col("__before")).alias("__left")))  # one row a category
    near = keyed.join(cut, ["__t", "__c"]).where(F.col("__b") <= F.col("__edge"))
    whole = near.where(F.col("__b") < F.col("__edge"))
    rank = F.row_number().over(W.partitionBy("__t", "__c").orderBy("__h", F.xxhash64("__row")))
    edge = near.where(F.col("__b") == F.col("__edge")).withColumn("__rank", rank).where(F.col("__rank") <= F.col("__left")).drop("__rank")
    return whole.unionByName(edge).select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c != "sample_cwe"], F.col("__c").alias("sample_cwe"))
