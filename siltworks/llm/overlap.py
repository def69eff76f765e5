"""The same or near-same records across splits (problem 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltworks.functions.text import commit_key, label_key, number_key
from siltworks.llm.keymap import key_map, may_hold
from siltworks.llm.near import verified
from siltworks.llm.shingles import chunks, mix, words
from siltworks.plans.runtime import materialize, shuffle_partitions

#: Words of a coverage passage, passages of one automaton, bytes of text that one automaton is given, and words that a task takes at once.
PASSAGE, SHARD, LOAD, STEP = 5, 100_000, 64 << 20, 150_000
#: Slots of the table of frequencies, whatever the input's size.
SLOTS = 1 << 20
#: Every byte that folding removes.
_DROPPED = bytes(b for b in range(256) if not (48 <= b <= 57 or 97 <= b <= 122))
#: Bytes of a word's code, and the ranges of its letters.
WORD = 4
_RANGES = np.arange(1, WORD + 1, dtype=np.uint16) * 256


def _strings(codes: list[bytes]) -> list[str]:
    """Four letters a word, each from a range of its own: matches begin and end at words, and a node of the automaton has at most 256 children."""
    whole = (np.frombuffer(b"".join(codes), np.uint8).reshape(-1, WORD) + _RANGES).astype("<u2").tobytes().decode("utf-16-le")
    out, at = [], 0
    for code in codes:
        out.append(whole[at : at + len(code)])
        at += len(code)
    return out


def _encode(k: int):
    """(id, held, text) -> (id, held, seq, n, grams, fold, letters); grams: the number of distinct runs of k words, fold: a digest of the folded text. Texts without words give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                h, doc = words(texts[a:b])
                count = np.bincount(doc, minlength=b - a)
                at = np.concatenate([[0], np.cumsum(count)])
                letters = h.astype(np.uint32)
                has = np.flatnonzero(count)
                if not len(has):
                    continue
                with np.errstate(over="ignore"):
                    pos = np.arange(len(h)) - at[doc]
                    seq = mix(np.add.reduceat(h * (mix((pos + 1).astype(np.uint64)) | np.uint64(1)), at[has])).view(np.int64)
                raws = [letters[at[i] : at[i + 1]].tobytes() for i in has]
                owner, _, key, _ = _grams(raws, k)
                ends = np.searchsorted(owner, np.arange(len(has) + 1))
                grams = [len(np.unique(key[x:y])) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                sel = pa.array(has)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b].take(sel), batch.column(1)[a:b].take(sel), pa.array(seq), pa.array(count[has].astype(np.int32)), pa.array(grams, pa.int32()), pa.array([hashlib.blake2b((texts[a + i] or "").lower().encode().translate(None, _DROPPED), digest_size=16).digest() for i in has], pa.binary()), pa.array(raws, pa.binary())],
                    names=["id", "held", "seq", "n", "grams", "fold", "letters"],
                )

    return run


def _grams(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the joined words, hash) of every run of k words of the texts' letters, in order, and the joined words."""
    count = np.asarray([len(r) // WORD for r in raws], np.int64)
    codes = np.frombuffer(b"".join(raws), np.uint32)
    first = np.cumsum(count) - count
    n = max(0, len(codes) - k + 1)
    wide = codes.astype(np.uint64)
    key = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + n])
    owner = np.repeat(np.arange(len(raws)), count)[:n]
    at = np.flatnonzero(np.arange(n) - first[owner] + k <= count[owner])
    return owner[at], at, key[at], codes


def _steps(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of some STEP words (a longer text comes alone)."""
    first, size = 0, 0
    for i, r in enumerate(raws):
        if size and size + len(r) > STEP * WORD:
            yield first, i
            first, size = i, 0
        size += len(r)
    if first < len(raws):
        yield first, len(raws)


def _frequencies(k: int):
    """(letters) -> (slot, n): how often runs of k words fall in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for a, b in _steps(raws):
                slot, n = np.unique(_grams(raws[a:b], k)[2] & np.uint64(SLOTS - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    return run


def _least(n, t: float):
    """The least number of a set's n members that a set of similarity t shares."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def _prefixes(k: int, t: float, shared):
    """(seq, letters) -> (seq, grams, passage, letters): the n - ceil(t * n) + 1 rarest of a text's n distinct runs of k words; a similar text has one of them at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            seqs, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in _steps(raws):
                owner, at, key, codes = _grams(raws[a:b], k)
                order = np.lexsort((key, table[(key & np.uint64(SLOTS - 1)).astype(np.int64)], owner))
                owner, at, key = owner[order], at[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                owner, at, key = owner[new], at[new], key[new]
                n = np.bincount(owner, minlength=b - a)
                first = np.cumsum(n) - n
                keep = np.arange(len(key)) - first[owner] < (n - _least(n, t) + 1)[owner]
                owner, at, key = owner[keep], at[keep], key[keep]
                raw = codes[at[:, None] + np.arange(k)].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seqs[a:b][owner]), pa.array(n[owner].astype(np.int32)), pa.array(key.view(np.int64)), pa.array([raw[i : i + WORD * k] for i in range(0, len(raw), WORD * k)], pa.binary())],
                    names=["seq", "grams", "passage", "letters"],
                )

    return run


def _train_grams(sizes: list[int]):
    """(letters) -> (passage) of the runs of each size, once for some STEP words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for a, b in _steps(raws):
                for size in sizes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_grams(raws[a:b], size)[2]).view(np.int64))], names=["passage"])

    return run


def _all_runs(shared):
    """(seq, letters) -> (seq, pos, n, passage, letters) of the passage at every word that the map of training runs may hold; a text of fewer words is one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, raws = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size in range(1, PASSAGE + 1):
                of = [i for i, r in enumerate(raws) if len(r) // WORD == size or (size == PASSAGE and len(r) // WORD > size)]
                for a, b in _steps([raws[i] for i in of]):
                    part = of[a:b]
                    count = np.asarray([len(raws[i]) // WORD for i in part])
                    owner, at, key, codes = _grams([raws[i] for i in part], size)
                    held = may_hold(shared.value, key)
                    owner, at, key = owner[held], at[held], key[held]
                    raw = codes[at[:, None] + np.arange(size)].tobytes()
                    step = WORD * size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seqs[part][owner]), pa.array((at - (np.cumsum(count) - count)[owner]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(key.view(np.int64)), pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())],
                        names=["seq", "pos", "n", "passage", "letters"],
                    )

    return run


def _stretches(sizes: list[int], shards: int, shared):
    """(seq, grams, letters) -> (shard, seq, grams, letters): for each shard the places of a text where the map of passages allows one of it, runs that overlap written once and the others apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            seqs, grams, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in _steps(raws):
                for k in sizes:
                    owner, at, key, codes = _grams(raws[a:b], k)
                    hit = may_hold(bits, key)
                    if not len(hit):
                        continue
                    owner, at = owner[hit], at[hit]
                    shard = ((key[hit] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                    order = np.lexsort((at, shard, owner))
                    owner, at, shard = owner[order], at[order], shard[order]
                    new = np.ones(len(at), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
                    ahead = np.concatenate([[0], at[1:] - at[:-1]])
                    joined = ~new & (ahead < k)
                    # words that a place adds: all of it, after a word that is none, or what goes beyond the place before
                    size = np.where(new, k, np.where(joined, ahead, k + 1))
                    ends = np.cumsum(size)
                    back = np.repeat(ends, size) - np.arange(ends[-1])  # k + 1 at the word between
                    source = np.repeat(at + k, size) - back
                    text = np.where(back > k, np.uint32(0), codes[np.maximum(source, 0)]).astype(np.uint32)
                    start = np.flatnonzero(new)
                    offsets = np.concatenate([(ends - size)[start], ends[-1:]]) * WORD
                    letters = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                    who = a + owner[start]
                    yield pa.RecordBatch.from_arrays([pa.array(shard[start].astype(np.int32)), pa.array(seqs[who]), pa.array(grams[who]), letters], names=["shard", "seq", "grams", "letters"])

    return run


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, salt, kind, key, grams, letters) sorted by the first three, a shard's passages (kind 0) before its texts (kind 1) -> (passage, t_seq, t_grams) of every passage in a text."""
    import ahocorasick

    now, keys, codes, automaton = None, [], [], None
    for batch in batches:
        shard = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
        kind = batch.column(2).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])).tolist() + [len(shard)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b <= a:
                continue
            if shard[a] != now:
                now, keys, codes, automaton = shard[a], [], [], None
            part, letters = batch.column(3)[a:b].to_numpy(), batch.column(5)[a:b].to_pylist()
            if kind[a] == 0:
                keys.append(part)
                codes.extend(letters)
                continue
            if not codes:
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for i, passage in enumerate(_strings(codes)):
                    automaton.add_word(passage, i)
                automaton.make_automaton()
                known = np.concatenate(keys)
            which, where = [], []
            for i, text in enumerate(_strings(letters)):
                hits = {j for _, j in automaton.iter(text)}
                which.extend(hits)
                where.extend([i] * len(hits))
            if which:
                yield pa.RecordBatch.from_arrays([pa.array(known[which]), pa.array(part[where]), pa.array(batch.column(4)[a:b].to_numpy()[where])], names=["passage", "t_seq", "t_grams"])


def scan_passages(train: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, t_seq, t_grams): which passages (passage, letters; distinct) occur in which training texts (seq, grams, letters; a text once).

    The passages are dealt into shards of some 100,000, each of which becomes one Aho-Corasick automaton in one task and scans the training texts there. A map of fixed size, one bit for each passage's hash, tells at which places of a text a passage of a shard may stand; only those places go to the shard, so the work does not grow with the number of automata while the map is sparse (some 30 million passages; beyond, more places are scanned in vain and none is missed). A shard with more text than LOAD is built in several tasks, which share its texts."""
    spark = train.sparkSession
    passages = materialize(passages)
    n = passages.count()
    if not n:
        return spark.createDataFrame([], "passage long, t_seq long, t_grams int")
    shards = max(shuffle_partitions(spark), -(-n // SHARD))
    sizes = sorted(r.k for r in passages.select((F.length("letters") / WORD).cast("int").alias("k")).distinct().collect())  # PASSAGE or shingle sizes
    shared = spark.sparkContext.broadcast(key_map(passages, "passage"))
    texts = materialize(train.select("seq", "grams", "letters").mapInArrow(_stretches(sizes, shards, shared), "shard int, seq long, grams int, letters binary"), "lz4")
    dealt = passages.withColumn("shard", F.pmod(F.shiftrightunsigned("passage", 32), F.lit(shards)).cast("int"))
    load = materialize(texts.groupBy("shard").agg((F.sum(F.length("letters") + 24) / LOAD).cast("int").alias("extra")).where("extra > 0"))  # shards that need several tasks
    more = load.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]
    parts = F.coalesce("extra", F.lit(0)) + 1
    left = dealt.join(load, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("passage").alias("key"), F.lit(0).alias("grams"), "letters")
    right = texts.join(load, "shard", "left").select("shard", F.pmod(F.xxhash64("seq"), parts).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("seq").alias("key"), "grams", "letters")
    tasks = max(shuffle_partitions(spark), shards + more)
    return materialize(left.unionByName(right).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_find, "passage long, t_seq long, t_grams int"))


#: Values of one kind and key agree: always, but for commits of 40 digits with other ends.
_AGREE = "fa IS NULL OR fa = fb OR length(fa) <> length(fb)"


class Overlap:
    """The overlaps of a table's held-out splits with its training split.

    Rows with other splits or a null id take no part. Empty texts overlap with nothing; copies count row by row."""

    def __init__(self, df: DataFrame, key: str = "fn_id", text: str = "func", train: str = "train", held: tuple[str, ...] = ("valid", "test"), k: int = 5, t: float = 0.8):
        self.df, self.key, self.text, self.k, self.t, self.held_splits = df, key, text, k, t, held
        split = F.lower(F.trim(F.col("split")))
        self.rows = df.where(split.isin(train, *held) & F.col(key).isNotNull()).withColumn("__held", split != train)
        self._codes = self._links = None

    def _values(self) -> DataFrame:
        """(id, held, kind, v, full) of every value by which rows may agree."""
        keys = self.rows.select(F.col(self.key).cast("long").alias("id"), F.col("__held").alias("held"), number_key(F.col("hash")).alias("h"), commit_key(F.col("commit_id")).alias("c"), number_key(F.col("big_vul_idx"), decimal_zero=True).alias("b"))
        entry = lambda kind, value, full: F.struct(F.lit(kind).alias("kind"), value.alias("v"), full.alias("full"))
        none = F.lit(None).cast("string")
        all_ = F.array(entry("hash", F.col("h"), none), entry("commit_id", F.left("c", F.lit(12)), F.col("c")), entry("big_vul_idx", F.col("b"), none))
        rows = keys.select("id", "held", F.inline(all_)).where(F.col("v").isNotNull())
        return rows.unionByName(self.codes.select("id", "held", F.lit("same").alias("kind"), F.hex("fold").alias("v"), none.alias("full")))

    def equal(self) -> DataFrame:
        """(kind, id_a, id_b) of a training and a held-out row with the same folded text, hash value, commit or record number.

        All kinds are matched in one join. Null values agree with nothing. Commits meet by their first 12 digits: 12 agree with 12 and with every 40 that begin with them."""
        rows = materialize(self._values())
        a, b = rows.where("NOT held").select("kind", "v", F.col("full").alias("fa"), F.col("id").alias("x")), rows.where("held").select("kind", "v", F.col("full").alias("fb"), F.col("id").alias("y"))
        j = a.join(b, ["kind", "v"]).where(_AGREE)
        return j.select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def _pairs(self, kind: str, j: DataFrame) -> DataFrame:
        return j.select(F.lit(kind).alias("kind"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    @property
    def codes(self) -> DataFrame:
        """(id, held, seq, n, grams, fold, letters) of the normalised texts, four bytes a word."""
        if self._codes is None:
            rows = self.rows.select(F.col(self.key).cast("long").alias("id"), F.col("__held").alias("held"), F.col(self.text).alias("text")).where(F.col("text").isNotNull())
            self._codes = materialize(rows.mapInArrow(_encode(self.k), "id long, held boolean, seq long, n int, grams int, fold binary, letters binary"))
        return self._codes

    def _once(self, which: str) -> DataFrame:
        """The held-out or training texts, equal word sequences once."""
        first = [F.first(c).alias(c) for c in ("n", "grams", "letters")]
        return self.codes.where(which).groupBy("seq").agg(*first)

    def coverage(self) -> DataFrame:
        """(id, words, covered) of every held-out row with words: how many of its words lie in runs of five words (a shorter text: in itself) that occur in training texts, overlapping runs merged.

        The run at every word of the held-out texts is searched, so a copied stretch of five words or more counts wherever it begins; those that a map of the training texts' runs shows to be in none make no passage."""
        held, train = self.codes.where("held"), self._once("NOT held")
        sizes = sorted({PASSAGE, *(r.n for r in held.where(F.col("n") < PASSAGE).select("n").distinct().collect())})
        known = self.df.sparkSession.sparkContext.broadcast(key_map(self.codes.where("NOT held").select("letters").mapInArrow(_train_grams(sizes), "passage long"), "passage"))
        runs = materialize(self._once("held").select("seq", "letters").mapInArrow(_all_runs(known), "seq long, pos int, n int, passage long, letters binary"))
        hits = scan_passages(train, runs.groupBy("passage").agg(F.first("letters").alias("letters"))).select("passage").distinct()
        before = F.lag("pos").over(W.partitionBy("seq").orderBy("pos"))
        hit = runs.select("seq", "pos", "n", "passage").join(hits, "passage", "left_semi")
        per = hit.withColumn("gain", F.least("n", F.coalesce(F.col("pos") - before, F.col("n")))).groupBy("seq").agg(F.sum("gain").alias("covered"))
        return held.select("id", "seq", F.col("n").alias("words")).join(per, "seq", "left").select("id", "words", F.coalesce("covered", F.lit(0)).alias("covered"))

    def tied(self) -> DataFrame:
        """(seq, t_seq) of held-out and training word sequences that are similar and differ in their folded form.

        Of a held-out text's n distinct runs of k words a text of similarity t has ceil(t * n) at least, so it has one at least of any n - ceil(t * n) + 1 of them: these, the rarest among held-out texts, are the passages that are searched, in every text. A candidate of m runs must have as many of them as the ceil(t / (1 + t) * (n + m)) runs that the two share leave at least. Nothing similar is left out. Candidates are compared exactly. Texts of fewer than k words are similar to equal ones only."""
        if self._links is None:
            spark, t = self.df.sparkSession, self.t
            held = self._once("held").where(F.col("n") >= self.k).select("seq", "letters")
            rows = held.select("letters").mapInArrow(_frequencies(self.k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
            table = np.zeros(SLOTS, np.int64)
            table[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
            own = materialize(held.mapInArrow(_prefixes(self.k, t, spark.sparkContext.broadcast(table)), "seq long, grams int, passage long, letters binary"))
            hits = scan_passages(self._once("NOT held"), own.groupBy("passage").agg(F.first("letters").alias("letters")))
            n, m = F.col("grams"), F.col("t_grams")
            j = own.select("seq", "grams", "passage").join(hits, "passage").where((F.col("seq") != F.col("t_seq")) & (F.least(n, m) >= t * F.greatest(n, m) - 1e-9))
            shared = j.groupBy("seq", "t_seq", "grams", "t_grams").agg(F.count(F.lit(1)).alias("shared"))
            unseen = F.ceil(t * n - 1e-9) - 1
            seqs = shared.where(F.col("shared") >= F.ceil(t / (1 + t) * (n + m) - 1e-9) - unseen).select("seq", "t_seq")
            reps = self.codes.groupBy("seq").agg(F.min("id").alias("rep"))
            pairs = materialize(seqs.join(reps.select("seq", F.col("rep").alias("a")), "seq").join(reps.select(F.col("seq").alias("t_seq"), F.col("rep").alias("b")), "t_seq"))
            texts = self.rows.select(F.col(self.key).cast("long").alias("id"), F.col(self.text).alias("text"))
            good = verified(pairs.select("a", "b").distinct(), texts, self.k, t).select("a", "b")
            self._links = materialize(pairs.join(good, ["a", "b"]).select("seq", "t_seq"))
        return self._links

    def near(self) -> DataFrame:
        """(kind, id_a, id_b) of similar rows whose folded texts differ: every held-out and training row of tied sequences."""
        ids = self.codes.select("id", "held", "seq")
        held, train = ids.where("held").select("seq", F.col("id").alias("x")), ids.where("NOT held").select(F.col("seq").alias("t_seq"), F.col("id").alias("y"))
        return self._pairs("near", self.tied().join(held, "seq").join(train, "t_seq"))

    def all(self) -> DataFrame:
        """(kind, id_a, id_b) of every overlap, once a kind."""
        return self.near().unionByName(self.equal()).distinct()

    def report(self) -> DataFrame:
        """Per held-out split, project and kind: the held-out rows that overlap with training rows and the pairs; project null where a row has none.

        Pairs are counted from the training rows of each value or sequence, not listed."""
        rows = materialize(self._values())
        many = rows.where("NOT held").groupBy("kind", "v", F.col("full").alias("fa")).agg(F.count(F.lit(1)).alias("m"))
        same = rows.where("held").withColumnRenamed("full", "fb").join(many, ["kind", "v"]).where(_AGREE).groupBy("kind", "id").agg(F.sum("m").alias("pairs"))
        ids = self.codes.select("id", "held", "seq")
        copies = ids.where("NOT held").groupBy(F.col("seq").alias("t_seq")).agg(F.count(F.lit(1)).alias("m"))
        near = self.tied().join(copies, "t_seq").groupBy("seq").agg(F.sum("m").alias("pairs")).join(ids.where("held"), "seq").select(F.lit("near").alias("kind"), "id", "pairs")
        held = self.rows.where("__held").select(F.col(self.key).cast("long").alias("id"), F.lower(F.trim("split")).alias("split"), label_key(F.col("project")).alias("project"))
        return same.unionByName(near).join(held, "id").groupBy("split", "project", "kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("pairs").alias("pairs"))
