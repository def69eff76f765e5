"""Evaluation texts leaking into training text (problem 8): latent semantic retrieval with exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.shingles import mix
from siltworks.plans.runtime import materialize

#: Words of a passage and of a run that counts as a leak, step of the passages, hashed terms, rank and its surplus, power iterations, least cosine, item passages searched at once.
RUN, STEP, TERMS, RANK, EXTRA, POWER, COSINE, BLOCK = 12, 4, 1 << 15, 128, 8, 2, 0.75, 16_384
#: Step of the items' passages, cells that an item's passage is in, and cells that a document's passage is compared in.
EVERY, HOMES, PROBES = 2, 2, 3
#: The documents, at most, that the basis is fitted on (term frequencies cover all), and the least common subsequence and answer share of a paraphrase.
FIT, PARAPHRASE, ANSWER = 20_000, 0.6, 0.8
_BLOCKS, _FITTERS = 64, 16
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def word_hashes(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """The words of a text, maximal runs of Unicode letters and digits, lower-cased, as 64-bit hashes."""
    out = []
    for w in _WORD.findall(text or ""):
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w.lower())
        out.append(h)
    return np.asarray(out, np.uint64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([word_hashes(t, cache).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "words"])


def encoded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words): the hashes of each text's words, 8 bytes a word; texts without words are left out."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return materialize(rows.mapInArrow(_encode, "id long, words binary").where(F.length("words") > 0))


def _steps(raws: list[bytes]) -> Iterator[list[int]]:
    """Consecutive indices whose texts together have at most some 100,000 words (a longer text comes alone)."""
    own, size = [], 0
    for i, r in enumerate(raws):
        if own and size + len(r) > 800_000:
            yield own
            own, size = [], 0
        own.append(i)
        size += len(r)
    if own:
        yield own


def _terms(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(TERMS)).astype(np.int64)


def _passage_terms(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(term, passage) of each word; passages of RUN words side by side."""
    counts = np.asarray([len(r) // 8 for r in raws])
    words = np.frombuffer(b"".join(raws), np.uint64)
    pos = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    per = -(-counts // RUN)
    return _terms(words), pos // RUN + np.repeat(np.cumsum(per) - per, counts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS + 1, np.int64)  # the last: passages
    for batch in batches:
        raws = batch.column(1).to_pylist()
        for own in _steps(raws):
            term, passage = _passage_terms([raws[i] for i in own])
            once = np.unique(passage * TERMS + term)
            total[:TERMS] += np.bincount(once % TERMS, minlength=TERMS)
            total[TERMS] += int(passage[-1]) + 1
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["term", "n"])


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """The inverse document frequency of each hashed term over all passages; 32,768 numbers whatever the input's size."""
    rows = words.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS + 1)
    for r in rows:
        n[r.term] = r.n
    return (np.log((1 + n[TERMS]) / (1 + n[:TERMS])) + 1).astype(np.float32)


def _products(shared):
    """One pass of AᵀA·Q over a partition's passages, as one row of summed values for each block of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        out = np.zeros((TERMS, q.shape[1]), np.float32)
        for batch in batches:
            raws = batch.column(1).to_pylist()
            for own in _steps(raws):
                term, passage = _passage_terms([raws[i] for i in own])
                start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                weight = idf[term]
                norm = np.sqrt(np.add.reduceat(weight * weight, start))
                weight = weight / norm[passage]
                y = np.add.reduceat(weight[:, None] * q[term], start, axis=0)
                order = np.argsort(term, kind="stable")
                t = term[order]
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                out[t[first]] += np.add.reduceat(weight[order][:, None] * y[passage[order]], first, axis=0)
        rows = out.reshape(_BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "part"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(raw, np.float32)
            sums[b] = sums[b] + part if b in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"])


def latent_basis(words: DataFrame, idf: np.ndarray, fit: int = FIT, seed: int = 7) -> np.ndarray:
    """An orthonormal basis (terms x rank) of the leading right singular vectors of the TF-IDF passages of at most about ``fit`` texts, drawn by a hash of their id.

    Randomised SVD: a random start, power iterations each of one pass over the passages whose partial products are added up by block of terms, QR between them, and a final rotation by the small Gram matrix. The driver holds terms x rank numbers (18 MB), whatever the input's size."""
    spark = words.sparkSession
    share = min(1.0, fit / max(1, words.count()))
    words = words.where(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 1) <= F.lit(int(share * (1 << 53)) << 10 if share < 1 else (1 << 63) - 1))
    words = materialize(words.repartition(_FITTERS, "id"))  # at most about fit texts: as many partial products as parts, whatever the input's size
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA)).astype(np.float32))[0]
    for i in range(POWER):
        shared = spark.sparkContext.broadcast((idf, q))
        parts = words.mapInArrow(_products(shared), "block int, part binary").repartition(_BLOCKS // 4, "block").mapInArrow(_add_up, "block int, part binary").collect()
        shared.unpersist()
        if len(parts) < _BLOCKS:
            return q[:, :RANK]
        g = np.vstack([np.frombuffer(p.part, np.float32).reshape(TERMS // _BLOCKS, -1) for p in sorted(parts, key=lambda p: p.block)])
        if i == POWER - 1:  # qᵀAᵀAq gives the rotation to singular vectors
            values, turn = np.linalg.eigh((q.T @ g).astype(np.float64))
            del values
            return np.ascontiguousarray((q @ turn[:, ::-1][:, :RANK].astype(np.float32)))
        q = np.linalg.qr(g)[0].astype(np.float32)
    return q[:, :RANK]


def _windows(words: np.ndarray, starts: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the passages of RUN words (fewer at a text's end) that begin at the given words: each word adds its term's row of ``weighted``, the basis times the terms' weights."""
    upto = np.zeros((len(words) + 1, weighted.shape[1]), np.float32)
    np.cumsum(weighted[_terms(words)], axis=0, out=upto[1:])
    total = upto[np.minimum(starts + RUN, len(words))] - upto[starts]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def cells(queries: np.ndarray, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """(centres, members of each cell): the passages of a block of items, each in the HOMES cells with the nearest centres, of which there are twice the root of their number (spherical k-means, a few rounds)."""
    n = max(1, math.ceil(2 * math.sqrt(len(queries)))) if len(queries) > 4 * PROBES else 1
    centres = queries[np.random.default_rng(seed).choice(len(queries), n, False)]
    for _ in range(6):
        own = (queries @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, queries)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centres)
    homes = np.argsort(-(queries @ centres.T), axis=1)[:, :HOMES]
    return centres.astype(np.float32), [np.flatnonzero((homes == c).any(axis=1)) for c in range(n)]


def _near_pairs(vectors: np.ndarray, queries: np.ndarray, centres: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, query, cosine) of the pairs that reach the threshold among the PROBES cells nearest to each vector; a pair may come twice."""
    k = min(PROBES, len(centres))
    probes = np.argpartition(-(vectors @ centres.T), k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(k), (len(vectors), 1))
    order = np.argsort(probes.ravel(), kind="stable")
    bounds = np.searchsorted(probes.ravel()[order], np.arange(len(centres) + 1))
    out = []
    for c, own in enumerate(members):
        rows = order[bounds[c] : bounds[c + 1]] // k
        if len(rows) and len(own):
            sim = vectors[rows] @ queries[own].T
            i, j = np.nonzero(sim >= COSINE)
            out.append((rows[i], own[j], sim[i, j]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0, np.float32))


def _runs(words: np.ndarray) -> np.ndarray:
    """A hash of every RUN consecutive words."""
    n = len(words) - RUN + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(RUN if n > 0 else 0):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return out


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest run of consecutive words that a and b share."""
    best, run = 0, np.zeros(len(b) + 1, np.int32)
    for x in a:
        run[1:] = np.where(b == x, run[:-1] + 1, 0)
        m = int(run.max())
        best = max(best, m)
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, by bit rows over b."""
    at: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full, row = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a.tolist():
        m = row & at.get(x, 0)
        row = (row + m) | (row - m)
        row &= full
    return len(b) - row.bit_count()


def windowed_subsequence(text: np.ndarray, words: np.ndarray) -> int:
    """The longest common subsequence of an item's words and any stretch of twice their number of the text (stretches at every item's length), so that a long text does not hold a subsequence by its length alone."""
    common = np.flatnonzero(np.isin(text, words))  # only words of the item belong to a common subsequence
    n, best = len(words), 0
    for s in range(0, max(1, len(text) - n), n):
        a, b = np.searchsorted(common, [s, s + 2 * n])
        if b - a > best:
            best = max(best, common_subsequence(text[common[a:b]], words))
    return best


def _search(shared):
    """(id, words) -> (doc_id, item_id, cosine, run, subsequence, answer) of every document and item of the block with passages whose latent cosine reaches the threshold, or with a run of 12 words in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, owner, queries, (centres, members), items = shared.value  # items: id -> (words, words of the answer)
        held = [(set(w.tolist()), set(_runs(w).tolist())) for _, w, _ in items]
        with_run: dict[int, list[int]] = {}
        for k, (_, own_runs) in enumerate(held):
            for r in own_runs:
                with_run.setdefault(r, []).append(k)
        known = np.sort(np.fromiter(with_run, np.uint64, len(with_run)))
        for batch in batches:
            ids, raws = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for own in _steps(raws):
                texts = [np.frombuffer(raws[i], np.uint64) for i in own]
                found: dict[tuple[int, int], float] = {}
                starts = [np.arange(0, max(1, len(t) - RUN + STEP), STEP) for t in texts]
                vectors = np.concatenate([_windows(t, s, weighted) for t, s in zip(texts, starts)])
                whose = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
                i, j, sim = _near_pairs(vectors, queries, centres, members)
                if len(i):
                    pair = whose[i] * len(items) + owner[j]
                    order = np.argsort(pair, kind="stable")
                    pair = pair[order]
                    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
                    for p, c in zip(pair[first].tolist(), np.maximum.reduceat(sim[order], first).tolist()):
                        k = divmod(p, len(items))
                        found[k] = max(found.get(k, 0.0), c)
                ends = np.cumsum([len(t) for t in texts])
                runs = _runs(np.concatenate(texts))  # those over a text's end are no runs
                near = np.minimum(np.searchsorted(known, runs), max(0, len(known) - 1))
                for at in np.flatnonzero(known[near] == runs).tolist() if len(known) else []:  # a leak is one whatever its passages' cosine
                    d = int(np.searchsorted(ends, at, side="right"))
                    if at + RUN <= ends[d]:
                        for k in with_run[int(runs[at])]:
                            if (d, k) not in found:
                                found[d, k] = float((vectors[whose == d] @ queries[owner == k].T).max())
                rows = []
                bags: dict[int, tuple[set, set]] = {}
                for (d, k), c in found.items():
                    item, words, answer = items[k]
                    text = texts[d]
                    if d not in bags:
                        bags[d] = (set(text.tolist()), set(_runs(text).tolist()))
                    bag, runs = bags[d]
                    verbatim = not runs.isdisjoint(held[k][1])
                    # a common subsequence holds no more distinct words than both share
                    if not verbatim and len(bag & held[k][0]) < PARAPHRASE * len(held[k][0]) - 1:
                        continue
                    r = longest_run(words, text)
                    s = windowed_subsequence(text, words)
                    have = len(set(answer.tolist()) & bag) / max(1, len(set(answer.tolist())))
                    rows.append((ids[own[d]], item, c, r, s / len(words), have))
                if rows:
                    doc, item, c, r, s, h = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(c, pa.float64()), pa.array(r, pa.int32()), pa.array(s, pa.float64()), pa.array(h, pa.float64())], names=["doc_id", "item_id", "cosine", "run", "subsequence", "answer"])

    return run


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, run, subsequence, answer) of the documents and items that retrieval brings together.

    All documents are cut into passages of 12 words at every fourth word; a run of 12 words of an item shares nine or more words with one of the item's own passages (one at every other word and the last), whose latent cosine mostly stays above the threshold of 0.75; as it does not for some runs of just 12 words, equal runs of 12 words bring documents and items together too. run: the longest run of consecutive shared words (12 or more: a leak); subsequence: the longest common subsequence against the item's length (a paraphrase from 0.6 on with an answer share of 0.8); answer: the share of the words of the item's last sentence in the document. Items are searched in blocks of at most 16,384 passages, each of bounded size on the workers: a block's passages are dealt into cells about centres (each in two), and a document's passage is compared in the three cells whose centres are nearest; every document is searched. Against the comparison with all passages, 0.96 of the pairs of passages and 0.998 of the pairs of a passage and an item above the threshold are found (check_s, all 50,086 passages of 1,500 documents). Null, empty and wordless texts leak nothing; repeated documents each count; an item of fewer than 12 words has one passage and cannot reach a run of 12."""
    spark = documents.sparkSession
    words = encoded(documents, key, text)
    idf = inverse_frequencies(words)
    weighted = latent_basis(words, idf) * idf[:, None]
    cache: dict[str, int] = {}
    out, block, size = None, [], 0

    def search(block: list) -> DataFrame:
        owner, vectors = [], []
        for i, (_, w, _) in enumerate(block):
            starts = np.unique([*range(0, max(1, len(w) - RUN + 1), EVERY), max(0, len(w) - RUN)])
            owner.append(np.full(len(starts), i))
            vectors.append(_windows(w, starts, weighted))
        queries = np.ascontiguousarray(np.concatenate(vectors))
        shared = spark.sparkContext.broadcast((weighted, np.concatenate(owner), queries, cells(queries), block))
        return materialize(words.mapInArrow(_search(shared), "doc_id long, item_id long, cosine double, run int, subsequence double, answer double"))

    for r in items.select(F.col(item_key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        w = word_hashes(r.text, cache)
        if not len(w):
            continue
        sentences = [s for s in regex.split(r"(?<=[.!?])\s+", r.text.strip()) if s]
        block.append((r.id, w, word_hashes(sentences[-1], cache)))
        size += 2 + len(w) // EVERY
        if size >= BLOCK:
            found = search(block)
            out, block, size = found if out is None else out.unionByName(found), [], 0
    if block:
        found = search(block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, run int, subsequence double, answer double")
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("run").alias("run"), F.max("subsequence").alias("subsequence"), F.max("answer").alias("answer"))
