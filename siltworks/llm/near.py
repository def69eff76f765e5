"""Near-duplicate records (problem 3): a parity-sketch join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import folded
from siltworks.llm import sketch
from siltworks.llm.shingles import chunks, mix, shingle_sets
from siltworks.llm.split import components
from siltworks.operators.skew import salted_join
from siltworks.plans.runtime import materialize

#: Sketch words used of a band, the most sets that a word may tie together directly, and the rows of one word that a task holds at once.
USED, CROWD, HELD = 48, 32, 100_000
#: Kinds of row beside the bands 0, 1, ...: a text's identity, and a copy met in the same batch.
IDENTITY, COPY = 100, 101
#: Kinds of what the scan gives: a pair, a copy with its representative, a word of a crowd.
PAIR, MEMBER, CROWDED = 0, 1, 2
_LOW24 = (1 << 24) - 1


def _sketch_rows(k: int, t: float):
    """(id, text) -> (kind, key, id, aux); aux holds 39 bits of the text's hash above 24 bits of its size, for a copy the id of the copy that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                own = ids[a:b]
                owner, sh, n, seq = shingle_sets(texts[a:b], k)
                order = np.lexsort((own, seq))
                order = order[seq[order] != 0]
                lead = np.ones(len(order), bool)
                lead[1:] = seq[order][1:] != seq[order][:-1]
                first = order[lead]
                stands = own[first][np.cumsum(lead) - 1] if len(order) else own[:0]
                keep = np.zeros(b - a, bool)
                keep[first] = True
                inside = keep[owner]
                doc, band, key = sketch.sketch_words(owner[inside], sh[inside], np.where(keep, n, 0), t, USED)
                aux = ((seq >> np.uint64(25)).astype(np.int64) << 24) | np.minimum(n, _LOW24)
                copies = order[~lead]
                kind = np.concatenate([band, np.full(len(first), IDENTITY), np.full(len(copies), COPY)]).astype(np.int8)
                keys = np.concatenate([key, mix(seq[first]), mix(own[copies].astype(np.uint64))]).view(np.int64)
                who = np.concatenate([own[doc], own[first], own[copies]])
                extra = np.concatenate([aux[doc], aux[first], stands[~lead]])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), pa.array(who), pa.array(extra)], names=["kind", "key", "id", "aux"])

    return run


def _scan(t: float):
    """Rows sorted by (key, kind, aux, id) -> (kind, a, b, weight): pairs that share a word, copies, and words of crowds (a: id, b: key, weight: aux)."""

    def groups(kind, key, who, aux, crowd_key, begun):
        """The result of whole groups. crowd_key: a key known to be a crowd's; begun: (key, hash and size, representative) of the class in which the rows before ended, kept up to date."""
        out = []
        special = kind == COPY
        if special.any():
            out.append((np.full(int(special.sum()), MEMBER), aux[special], who[special], np.zeros(int(special.sum()), np.int64)))
        same = kind == IDENTITY
        if same.any():
            k, w, x = key[same], who[same], aux[same]
            lead = np.ones(len(k), bool)
            lead[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
            rep = w[lead][np.cumsum(lead) - 1]
            if begun and begun[:2] == [k[0], x[0]]:
                rep[np.cumsum(lead) == 1] = begun[2]
            begun[:] = [k[-1], x[-1], rep[-1]]
            out.append((np.full(len(k), MEMBER), rep, w, np.zeros(len(k), np.int64)))
        word = ~special & ~same
        kind, key, who, aux = kind[word], key[word], who[word], aux[word]
        lead = np.ones(len(key), bool)
        lead[1:] = (key[1:] != key[:-1]) | (aux[1:] != aux[:-1])
        kind, key, who, aux = kind[lead], key[lead], who[lead], aux[lead]
        if len(key):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            size = np.repeat(size, size)
            hot = (size > CROWD) | (key == crowd_key if crowd_key is not None else False)
            if hot.any():
                out.append((np.full(int(hot.sum()), CROWDED), who[hot], key[hot], aux[hot]))
            some = (size > 1) & ~hot
            kind, key, who, aux = kind[some].astype(np.int64), key[some], who[some], aux[some]
            n = aux & _LOW24
            low = sketch.low_of(kind)
            for s in range(1, CROWD):
                if s >= len(key):
                    break
                m = key[s:] == key[:-s]
                if not m.any():
                    break
                x, y = who[s:][m], who[:-s][m]
                most, least = np.maximum(n[s:][m], n[:-s][m]), np.minimum(n[s:][m], n[:-s][m])
                f = (least >= t * most - 1e-9) & (most > low[s:][m]) & (x != y)
                weight = np.where(kind[s:][m][f] == 0, 2, 1)
                x, y = x[f], y[f]
                out.append((np.full(len(x), PAIR), np.minimum(x, y), np.maximum(x, y), weight))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        crowd_key = None
        begun: list = []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            last = int(np.searchsorted(cols[1], cols[1][-1]))
            if len(cols[1]) - last > HELD:  # a crowd too large to hold: it streams through as such
                streamed = cols[1][-1]
                yield from _batch(groups(*cols, streamed, begun))
                crowd_key, carry = streamed, None
                continue
            yield from _batch(groups(*[c[:last] for c in cols], crowd_key, begun))
            carry = [c[last:] for c in cols]
        if carry is not None:
            yield from _batch(groups(*carry, crowd_key, begun))

    def _batch(out):
        if out:
            k, a, b, w = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int8)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(w.astype(np.int64))], names=["kind", "a", "b", "weight"])

    return run


def _set_rows(k: int):
    """(id, text, fold) -> (id, fold, n, bits, shingles); bits: the parity sketch, shingles: the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                owner, sh, n, _ = shingle_sets(texts[a:b], k)
                bits = sketch.parity_bits(owner, sh, b - a, 4)
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([sh[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())],
                    names=["id", "fold", "n", "bits", "shingles"],
                )

    return run


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, 4) for i in (4, 5)]
            # the sketches' distance is at most the symmetric difference: what exceeds the largest allowed one is out
            near = np.flatnonzero(sketch.hamming(*bits) <= sketch.most_apart(na + nb, t)) if len(na) else []
            keep, sim = [], []
            for i in near:
                x, y = (np.frombuffer(batch.column(c)[int(i)].as_py(), np.uint64) for c in (6, 7))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if sketch.jaccard_at_least(inter, len(x), len(y), t):
                    keep.append(i)
                    sim.append(inter / (len(x) + len(y) - inter))
            keep = pa.array(np.asarray(keep, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, t: float) -> DataFrame:
    """The pairs (a, b) of ids in texts (id, text) with different non-empty folded texts and a similarity of at least t, with it."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    of = texts.join(need, "id", "left_semi").select("id", "text", F.sha2(folded(F.col("text")), 256).alias("fold"))
    sets = materialize(of.mapInArrow(_set_rows(k), "id long, fold string, n int, bits binary, shingles binary"))
    side = lambda s: sets.select(*[F.col(c).alias(f"{c}_{s}") for c in sets.columns])
    j = pairs.select("a", "b").join(side("x"), F.col("a") == F.col("id_x")).join(side("y"), F.col("b") == F.col("id_y"))
    j = j.where((F.col("fold_x") != F.col("fold_y")) & (F.least("n_x", "n_y") >= t * F.greatest("n_x", "n_y") - 1e-9))
    return j.select("a", "b", "n_x", "n_y", "bits_x", "bits_y", "shingles_x", "shingles_y").mapInArrow(_verify(t), "a long, b long, similarity double")


def near_links(df: DataFrame, key: str = "fn_id", text: str = "func", k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity), a < b, between class representatives whose sets of k-word shingles have a Jaccard similarity of at least t and whose folded texts differ; members (rep, id) of every row with words, where a class holds the rows of the same word sequence and its least id represents it.

    Each set gives its sketch's words (siltworks.llm.sketch) for its size band and those above that may hold a similar set; sets that share two words (one in band 0) are candidates. At similarity t exactly a pair shares a dozen words on average, and misses with a chance of some 1e-4; above t the chance falls fast; in band 0 none is missed. Words shared by more than 32 sets lose no pair either: sets with two such words (in band 0 one) are joined on them, in salted blocks, and they count for two sets that share one other word. Candidates are compared by parity sketch, then exactly.

    Rows without words (null, empty, other scripts) are in no class; a null id is ignored; repeated ids count once a text. Copies move as one row for each batch."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    rows = texts.where(F.col("text").rlike(r"[a-zA-Z0-9\u212a\u0130]")).mapInArrow(_sketch_rows(k, t), "kind byte, key long, id long, aux long")
    found = materialize(rows.repartition("key").sortWithinPartitions("key", "kind", "aux", "id").mapInArrow(_scan(t), "kind byte, a long, b long, weight long"))

    batch_reps = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("rep"), F.col("b").alias("id")).distinct()
    # a copy met in a batch names that batch's copy, whose own row names the class
    up = batch_reps.withColumnRenamed("rep", "top").withColumnRenamed("id", "rep")
    members = batch_reps.join(up, "rep", "left").select(F.coalesce("top", "rep").alias("rep"), "id").groupBy("id").agg(F.min("rep").alias("rep"))

    crowded = found.where(F.col("kind") == CROWDED).select(F.col("a").alias("id"), F.col("b").alias("key"), F.col("weight").alias("aux"))
    n = F.col("aux").bitwiseAND(F.lit(_LOW24))
    crowd_docs = crowded.groupBy("id", "aux").agg(F.count(F.lit(1)).alias("hot")).where((F.col("hot") >= 2) | (n <= sketch.FIRST))
    rest = crowded.join(crowd_docs.select("id"), "id", "left_semi")
    blocks = 8
    l = rest.select(F.col("id").alias("a"), "key", n.alias("na"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    r = rest.select(F.col("id").alias("b"), "key", n.alias("nb"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(blocks)])).alias("block"))
    both = l.join(r, ["key", "block"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9))
    extra = both.groupBy("a", "b").agg(F.sum(F.when(F.greatest("na", "nb") <= sketch.FIRST, 2).otherwise(1)).alias("weight"))
    direct = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    # two sets that share one other word: the crowded words that they share count too
    x, y = crowded.select(F.col("id").alias("a"), "key").distinct(), crowded.select(F.col("id").alias("b"), "key").distinct()
    lifted = direct.where("weight = 1").select("a", "b").join(x, "a").join(y, ["b", "key"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    pairs = materialize(direct.unionByName(extra).unionByName(lifted).groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= 2).select("a", "b"))
    return verified(pairs, texts, k, t), members


def near_pairs(df: DataFrame, key: str = "fn_id", text: str = "func", k: int = 5, t: float = 0.8) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of every two rows in linked classes."""
    links, members = near_links(df, key, text, k, t)
    links, members = materialize(links), materialize(members)
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    return links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def near_groups(df: DataFrame, key: str = "fn_id", text: str = "func", k: int = 5, t: float = 0.8) -> DataFrame:
    """(key, group_id, links): one row for each row with words, its group (rows tied by near links and copies, named by the least id) and the number of other classes its class is linked to."""
    links, members = near_links(df, key, text, k, t)
    links, members = materialize(links), materialize(members)
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    parts = components(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))).select(F.col("node").cast("long").alias("rep"), "component")
    parts = salted_join(parts, parts.groupBy("component").agg(F.min("rep").alias("group_id")), "component", "inner").select("rep", "group_id")
    return members.join(degree, "rep", "left").join(parts, "rep", "left").select(F.col("id").alias(key), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
