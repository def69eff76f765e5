"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import commit_key, label_key
from siltworks.operators.skew import salted_join
from siltworks.plans.runtime import materialize, shuffle_partitions

SMALL_GRAPH = 10_000
SALTS = 8


def _driver_components(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def components(edges: DataFrame, depth: int = 0) -> DataFrame:
    """(node, component) of an undirected graph (a, b), for the nodes with an edge to another node.

    The edges become adjacency lists partitioned by node (a node of many edges is salted). Every node whose hash is below those of its neighbours is a seed; all seeds expand at once, one level a step, and a node takes the least seed that reaches it. Where two seeds meet, their labels become an edge of a smaller graph, which is solved the same way; below 10,000 edges (checked) on the driver. A component is named by one of its nodes. Loops and null ends are ignored."""
    spark = edges.sparkSession
    e = edges.select(F.col("a"), F.col("b")).where(F.col("a") != F.col("b"))
    arcs = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if depth:
        few = arcs.where("a < b").limit(SMALL_GRAPH + 1).collect()
        if len(few) <= SMALL_GRAPH:
            return spark.createDataFrame(_driver_components([(r.a, r.b) for r in few]), "node string, component string")
    # adjacency lists stay partitioned by node (and salt), so that a step moves the frontier only; a lost partition is read again from the table
    lists = arcs.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).repartition(shuffle_partitions(spark), "a", "salt").persist(StorageLevel.DISK_ONLY)
    h = lambda c: F.struct(F.xxhash64(F.lit(depth), c), c)
    seeds = arcs.groupBy("a").agg(F.min(h(F.col("b"))).alias("least")).where(h(F.col("a")) < F.col("least")).select(F.col("a").alias("node"), F.col("a").alias("label"))
    frontier = materialize(seeds)
    labelled, met = [frontier], []
    while True:
        spread = frontier.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        reached = materialize(lists.join(spread, (lists.a == spread.node) & (lists.salt == spread.salt)).select(F.col("b").alias("node"), "label").distinct())
        known = labelled[0]
        for x in labelled[1:]:
            known = known.unionByName(x)
        first = reached.groupBy("node").agg(F.min("label").alias("label")).join(known.select("node", F.col("label").alias("old")), "node", "left")
        step = materialize(first.select("node", F.coalesce("old", "label").alias("own"), F.col("old").isNull().alias("new")))
        # every label that arrives is tied to the one the node has or takes, row by row: a node that many seeds meet is salted
        met.append(materialize(salted_join(reached, step, "node", "inner", SALTS).where(F.col("own") != F.col("label")).select(F.col("own").alias("a"), F.col("label").alias("b")).distinct()))
        new = step.where("new").select("node", F.col("own").alias("label"))
        if new.isEmpty():
            break
        frontier = new
        labelled.append(new)
    lists.unpersist()
    known = labelled[0]
    for x in labelled[1:]:
        known = known.unionByName(x)
    ties = met[0]
    for x in met[1:]:
        ties = ties.unionByName(x)
    merged = components(ties, depth + 1)
    return known.join(merged.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def _held_commits(rows: DataFrame) -> DataFrame:
    """(project, commit, held) of the rows that have both, distinct. held names the commit: its 40 digits, or its first 12 where the 12 alone stand for it in some row."""
    short = rows.where(F.col("commit").isNotNull()).groupBy(F.left("commit", F.lit(12)).alias("prefix")).agg(F.max((F.length("commit") == 12).cast("int")).alias("short"))
    both = rows.where(F.col("commit").isNotNull()).select("project", "commit").distinct().withColumn("prefix", F.left("commit", F.lit(12)))
    return both.join(short, "prefix").select("project", "commit", F.when(F.col("short") == 1, F.col("prefix")).otherwise(F.col("commit")).alias("held"))


def linked_components(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((project, component) of every project, (commit, component) of every commit).

    Rows link by project and commit, directly or through others. A commit of several projects ties each of them to the first, so a commit of many projects gives a star, not all pairs. Only distinct (project, commit) pairs are shuffled."""
    rows = df.select(label_key(F.col("project")).alias("project"), commit_key(F.col("commit_id")).alias("commit")).distinct()
    held = materialize(_held_commits(rows))
    hub = held.groupBy("held").agg(F.min("project").alias("hub"))
    star = held.where(F.col("project").isNotNull()).select("project", "held").distinct().join(hub, "held").select(F.col("hub").alias("a"), F.col("project").alias("b"))
    found = materialize(components(star))
    projects = rows.where(F.col("project").isNotNull()).select("project").distinct().join(found.withColumnRenamed("node", "project"), "project", "left").select("project", F.coalesce(F.col("component"), F.col("project")).alias("component"))
    projects = materialize(projects)
    named = hub.join(projects.withColumnRenamed("project", "hub"), "hub", "left").select("held", F.coalesce(F.concat(F.lit("project:"), "component"), F.concat(F.lit("commit:"), "held")).alias("component"))
    commits = held.select("commit", "held").distinct().join(named, "held").select("commit", "component")
    return projects, commits


def shared_split_pairs(df: DataFrame) -> DataFrame:
    """(project_a, project_b), a < b, of every two projects of one component: all pairs are the result asked for."""
    projects, _ = linked_components(df)
    a = projects.select(F.col("project").alias("project_a"), "component")
    b = projects.select(F.col("project").alias("project_b"), "component")
    return a.join(b, "component").where("project_a < project_b").select("project_a", "project_b")


def linked_split(df: DataFrame, plan: DataFrame, seed: int = 42, key: str = "fn_id") -> DataFrame:
    """(key, component, split) of every row: the rows of a component share a split and the splits hold the plan's shares as nearly as components allow.

    Components of at least a thousandth of the rows (at most 1,000) are placed first, the largest first, each in the split that lacks most; the rest follow in order of a hash of their name, cut where the rows still wanted by each split are reached. Rows with neither key are components of their own; rows that share a null key count as rows each. A plan whose shares do not add up to 1,000 is scaled; an empty table gives an empty result."""
    projects, commits = linked_components(df)
    rows = df.select(F.col(key).alias("__id"), label_key(F.col("project")).alias("project"), commit_key(F.col("commit_id")).alias("commit"))
    with_p = salted_join(rows.where(F.col("project").isNotNull()), projects, "project").select("__id", F.concat(F.lit("project:"), "component").alias("component"))
    with_c = salted_join(rows.where(F.col("project").isNull() & F.col("commit").isNotNull()), commits, "commit").select("__id", "component")
    alone = rows.where(F.col("project").isNull() & F.col("commit").isNull()).select("__id", F.concat(F.lit("row:"), F.coalesce(F.col("__id").cast("string"), F.lit("none"))).alias("component"))
    placed = materialize(with_p.unionByName(with_c).unionByName(alone))
    sizes = materialize(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shares = [(r.split, r.share_permille or 0) for r in plan.orderBy(F.col("share_permille").desc_nulls_last(), "split").collect()]  # one row a split
    whole = sum(s for _, s in shares) or 1
    lack = {s: total * p / whole for s, p in shares}
    large = sizes.where(F.col("n") * 1000 >= max(total, 1)).orderBy(F.col("n").desc(), "component").collect()  # at most 1,000
    fixed = []
    for r in large:
        best = max(lack, key=lambda s: lack[s])
        lack[best] -= r.n
        fixed.append((r.component, best))
    rest_total = total - sum(r.n for r in large)
    open_ = {s: max(0.0, x) for s, x in lack.items()}
    scale = rest_total / (sum(open_.values()) or 1)
    edge, at = F.lit(shares[-1][0] if shares else None), sum(open_.values()) * scale
    for s, _ in reversed(shares):  # from the last split to the first: below each upper bound its own name
        edge = F.when(F.col("middle") <= at + 1e-9, F.lit(s)).otherwise(edge)
        at -= open_[s] * scale
    order = sizes.where(F.col("n") * 1000 < max(total, 1)).withColumn("h", F.xxhash64(F.lit(seed), "component")).withColumn("bucket", F.shiftrightunsigned("h", 52))
    buckets = order.groupBy("bucket").agg(F.sum("n").alias("rows"))
    start = F.broadcast(buckets.select("bucket", F.coalesce(F.sum("rows").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start")))  # at most 4,096 rows
    inner = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("h", "component").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = order.join(start, "bucket").withColumn("middle", F.col("start") + inner + F.col("n") / 2).select("component", edge.alias("split"))
    assigned = rest.unionByName(df.sparkSession.createDataFrame(fixed, "component string, split string"))
    return salted_join(placed, assigned, "component").select(F.col("__id").alias(key), "component", "split")
