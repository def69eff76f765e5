"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import label_key
from siltworks.functions.tokens import default_vocabulary, encoding
from siltworks.plans.runtime import materialize

#: Blocks at least and at most that a source's records are dealt into, tokens of a block between the two, and output shards.
BLOCKS, MOST_BLOCKS, BLOCK_TOKENS, SHARDS = 256, 4096, 1 << 26, 16


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def token_sizes(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of every record with a source, trimmed and lower-cased; null and empty texts have no token."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), label_key(F.col(source)).alias("source"), F.col(text).alias("text")).where(F.col("source").isNotNull())
    return rows.mapInArrow(_count(vocabulary or default_vocabulary()), "doc_id long, source string, tokens long")


def _wanted(targets: DataFrame) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for r in targets.select(label_key(F.col("source")).alias("s"), "weight_permille", "max_repeats").where("s IS NOT NULL").collect():  # one row a source, a parameter
        w, m = out.get(r.s, (0, 0))
        out[r.s] = (w + (r.weight_permille or 0), max(m, r.max_repeats or 0))
    return out


def _plan(sizes: DataFrame, targets: DataFrame) -> tuple[list[tuple], int]:
    """([source, size, records, weight, repeats allowed, quota]) and the total size."""
    wanted = _wanted(targets)
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    have = {r.source: (r.size, r.n) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("n")).where(F.col("source").isin(list(wanted))).collect()}
    rows = []
    for s, (weight, repeats) in sorted(wanted.items()):
        size, n = have.get(s, (0, 0))
        rows.append((s, size, n, weight, repeats, min(-(-weight * total // 1000), repeats * size)))
    return rows, total


def mix_report(df: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per wanted source: its size in tokens, quota, share wanted, share of the mix that was drawn, and whether what was drawn falls short of the weight.

    The mix aims at the total size of all records that have a source; a source gives its weight of it, at most max_repeats times its size. Sources named twice are added up; a null weight is 0. A wanted source without records has size 0 and falls short of any positive weight."""
    sizes = materialize(token_sizes(df, vocabulary=vocabulary))
    rows, total = _plan(sizes, targets)
    used = {r.source: r.tokens for r in _dealt(sizes.where("tokens > 0"), rows).groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a wanted source
    whole = sum(used.values())
    out = [(s, size, n, quota, w / 1000, used.get(s, 0) / whole if whole else 0.0, used.get(s, 0) * 1000 < w * total) for s, size, n, w, _, quota in rows]
    return df.sparkSession.createDataFrame(out, "source string, tokens long, records long, quota long, wanted_share double, reached_share double, short boolean")


def splitting_tree(blocks: list[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """How many blocks of each source every shard gets: the shards are halved again and again and each half draws its share of all blocks, a multivariate hypergeometric number of each source's, so the counts add up exactly and every dealing of blocks is as likely as any other."""
    if shards == 1:
        return [blocks]
    left = shards // 2
    take = sum(blocks) * left // shards
    draw = rng.multivariate_hypergeometric(blocks, take, method="marginals") if sum(blocks) else np.zeros(len(blocks), int)
    rest = [b - int(d) for b, d in zip(blocks, draw)]
    return splitting_tree([int(d) for d in draw], left, rng) + splitting_tree(rest, shards - left, rng)


def mixed(df: DataFrame, targets: DataFrame, shards: int = SHARDS, seed: int = 42, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, copy_no, tokens, shard, place): the mix. copy_no: 1 for the first use of a record; place: a random place within the shard, by which a shard is shuffled locally.

    A source's records fall into blocks by a hash. Its quota is so many whole passes over them and, in one more pass, the records before the quota is reached in the order of a hash, counted by block and then within the one block that the quota ends in: the quota is met to within one record, with no source gathered in one task. Each (pass, block) with records to use is dealt to a shard by the splitting tree and a permutation of the source's blocks. Records without tokens are left out, repeated ids each take part."""
    sizes = materialize(token_sizes(df, vocabulary=vocabulary).where("tokens > 0"))
    return _dealt(sizes, _plan(sizes, targets)[0], shards, seed)


def _dealt(sizes: DataFrame, rows: list[tuple], shards: int = SHARDS, seed: int = 42) -> DataFrame:
    spark = sizes.sparkSession
    blocks = max(BLOCKS, min(MOST_BLOCKS, max((r[1] for r in rows), default=0) // BLOCK_TOKENS))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(blocks)).cast("int")
    rng = np.random.default_rng(seed)
    per_block = {(r.source, r.block): r.tokens for r in sizes.withColumn("block", bucket).groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).where(F.col("source").isin([r[0] for r in rows])).collect()}  # at most MOST_BLOCKS rows a wanted source
    used: dict[str, list[tuple[int, int, int]]] = {}  # source -> (pass, block, tokens wanted of it or -1 for all)
    for s, size, _, _, _, quota in rows:
        whole, left = divmod(quota, size) if size else (0, 0)
        own = [(p, b, -1) for p in range(1, whole + 1) for b in range(blocks) if (s, b) in per_block]
        for b in range(blocks):
            have = per_block.get((s, b), 0)
            if have and left > 0:
                own.append((whole + 1, b, -1 if have <= left else left))
                left -= have
        used[s] = [own[i] for i in rng.permutation(len(own))]
    names = sorted(used)
    dealt, at = [], dict.fromkeys(names, 0)
    for shard, counts in enumerate(splitting_tree([len(used[s]) for s in names], shards, rng)):
        for s, n in zip(names, counts):
            dealt.extend((s, *block, shard) for block in used[s][at[s] : at[s] + n])
            at[s] += n
    plan = F.broadcast(spark.createDataFrame(dealt, "source string, copy_no int, block int, upto long, shard int"))  # sources x repeats x MOST_BLOCKS rows at most
    joined = sizes.withColumn("block", bucket).join(plan, ["source", "block"])
    whole = joined.where("upto < 0")
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source", "block", "copy_no").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = joined.where("upto >= 0").withColumn("before", before).where("before < upto").drop("before")
    return whole.unionByName(part).select("doc_id", "source", "copy_no", "tokens", "shard", F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no").alias("place"))
