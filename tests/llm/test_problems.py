import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import formats, leakage, mixing, near, overlap, pieces, quota, residue, split
from siltworks.llm.shingles import shingle_sets

FUNCTIONS = "fn_id long, split string, func string, target int, cwe array<string>, project string, commit_id string, big_vul_idx string, hash string"
DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile("[a-z0-9]+")
#: Columns whose names the operators use themselves.
CLASHES = ["id", "key", "text", "a", "b", "rep", "kind", "n", "aux", "seq", "held", "node", "label", "component", "block", "tokens", "skeleton", "words", "canon", "h", "__t", "__row", "sample_cwe"]


def function(i, func, split="train", target=0, cwe=None, project=None, commit=None, idx=None, hash=None):
    return (i, split, func, target, cwe, project, commit, idx, hash)


def functions(spark, rows, clash=False):
    df = spark.createDataFrame(rows, FUNCTIONS)
    for c in CLASHES if clash else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def documents(spark, rows, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES if clash else []:
        if c != "text":
            df = df.withColumn(c, F.lit("x"))
    return df


def body(rng, n):
    return " ".join(f"{rng.choice(['a', 'b', 'c'])}{rng.randrange(400)}" for _ in range(n))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=3, n=40):
    """Families of edited copies, exact copies, reformatted copies, odd rows and one text of a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = body(rng, rng.choice([3, 5, 12, 40, 90, 200, 450]))
        split_ = rng.choice(["train", "valid", "test"])
        rows.append((base, split_))
        for e in (0, 1, 3, 8):
            rows.append((edited(rng, base, e), rng.choice(["train", "valid", "test"])))
        rows.append((base.upper().replace(" ", "  \r\n"), rng.choice(["train", "test"])))
    hot = body(rng, 60)
    rows += [(hot, rng.choice(["train", "valid"])) for _ in range(len(rows) // 2)]
    rows += [(None, "train"), ("", "train"), ("  \n", "valid"), ("ß été", "train"), ("x", "train"), ("x", "valid")]
    return [function(i, f, s) for i, (f, s) in enumerate(rows)]


def brute_near(rows, k=4, t=0.6):
    sets, fold = {}, {}
    for r in rows:
        w = WORD.findall((r[2] or "").lower())
        if w:
            fold[r[0]] = "".join(w)
            sets[r[0]] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    ids = sorted(sets)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if fold[a] != fold[b]:
                x = len(sets[a] & sets[b])
                if x >= t * (len(sets[a]) + len(sets[b]) - x) - 1e-9:
                    out.add((a, b))
    return out


# ---- problem 1


def test_controlled_rounding_keeps_margins():
    rng = random.Random(1)
    for _ in range(60):
        cells = {(r, c): Fraction(rng.randrange(0, 4000), 1000) for r in range(3) for c in range(4) if rng.random() < 0.8}
        q = quota.controlled_rounding(cells)
        near_ = lambda got, want: abs(got - want) < 1
        assert all(near_(q[k], x) for k, x in cells.items())
        for axis in (0, 1):
            for v in range(4):
                own = [k for k in cells if k[axis] == v]
                assert near_(sum(q[k] for k in own), sum(cells[k] for k in own))
        assert near_(sum(q.values()), sum(cells.values()))


def targets(spark, rows):
    return spark.createDataFrame(rows, "target int, cwe string, share_permille int, min_rows int")


def test_quota_sample_is_exact(spark):
    rows = [function(i, "x", target=i % 20 == 0 and 1 or 0, cwe=["CWE-0787"] if i % 4 == 0 else None) for i in range(2000)]
    rows += [function(None, None, target=None), function(7, "x", target=2), function(7, "x", target=0), function(7, "x", target=0)]
    df = functions(spark, rows, clash=True)
    t = targets(spark, [(0, "none", 500, 1), (1, "CWE-787", 300, 1), (1, "CWE-1", 100, 5), (None, None, None, None)])
    report = {(r.target, r.cwe): r for r in quota.target_report(df, t).collect()}
    assert report[1, "CWE-1"].short and not report[0, "none"].short
    got = quota.quota_sample(df, t)
    counts = {(r.target, r.sample_cwe): r["count"] for r in got.groupBy("target", "sample_cwe").count().collect()}
    assert counts == {k: r.quota for k, r in report.items() if r.quota}
    assert set(got.columns) == set(df.columns)


def test_minimum_and_available_rows_are_bounds_of_the_flow():
    rng = random.Random(5)
    for _ in range(60):
        cells = {(r, c): Fraction(rng.randrange(4000), 100) for r in range(2) for c in range(6)}
        box = {}
        for k, x in cells.items():
            have = rng.randrange(60)
            least = rng.choice([0, 0, 5])
            box[k] = (min(max(int(x), least), have), min(max(-int(-x // 1), least), have))
        got = quota.controlled_rounding(cells, box)
        assert all(box[k][0] <= got[k] <= box[k][1] for k in cells)
        for c in range(6):  # a total that its cells' bounds reach is kept
            x, least, most = (sum(v[k] for k in cells if k[1] == c) for v in (cells, {k: b[0] for k, b in box.items()}, {k: b[1] for k, b in box.items()}))
            total = sum(got[k] for k in cells if k[1] == c)
            assert least <= total <= most
    assert quota.unmet({("a", 1): (3, 5), ("b", 1): (9, 5), ("c", 2): (0, 0)}) == {("a", 1): 2}


def test_quota_of_an_empty_table(spark):
    df = functions(spark, [])
    t = targets(spark, [(0, "none", 500, 3)])
    assert [(r.available, r.needed, r.quota, r.short) for r in quota.target_report(df, t).collect()] == [(0, 3, 0, True)]
    assert quota.quota_sample(df, t).collect() == []


# ---- problem 2


def split_rows():
    rng = random.Random(5)
    commits = [f"{rng.getrandbits(160):040x}" for _ in range(60)]
    rows = []
    for i in range(400):
        p = rng.choice([f"p{rng.randrange(40)}", "HOT ", None, " "]) if i % 3 else "hot"
        c = rng.choice([commits[rng.randrange(60)], commits[rng.randrange(60)][:12], None, "HEAD", "0" * 40]) if i % 4 == 0 else f"{rng.getrandbits(160):040x}"
        rows.append(function(i, "x", project=p, commit=c))
    return rows


def brute_components(rows):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        p = (r[5] or "").strip().lower()
        c = (r[6] or "").strip().lower()
        c = c[:12] if re.fullmatch("[0-9a-f]{12}|[0-9a-f]{40}", c) and c.strip("0") else ""
        keys = ([f"p{p}"] if p else []) + ([f"c{c}"] if c else [])
        for k in keys:
            parent[root(k)] = root(keys[0])
    return root


def test_shared_split_pairs_equal_brute_force(spark):
    rows = split_rows()
    root = brute_components(rows)
    names = sorted({r[5].strip().lower() for r in rows if (r[5] or "").strip()})
    want = {(a, b) for a in names for b in names if a < b and root("p" + a) == root("p" + b)}
    got = split.shared_split_pairs(functions(spark, rows, clash=True)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_chain_needs_many_steps(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(80)] + [("x", "x"), (None, "y"), ("u", "v"), ("u", "v")], "a string, b string")
    got = {r.node: r.component for r in split.components(edges).collect()}
    assert len({v for k, v in got.items() if k[0] == "n"}) == 1 and got["u"] == got["v"] != got["n000"] and "y" not in got


def test_linked_split(spark):
    rows = split_rows() + [function(None, None), function(None, None)]
    plan = spark.createDataFrame([("train", 600), ("valid", 200), ("test", 200)], "split string, share_permille int")
    got = split.linked_split(functions(spark, rows, clash=True), plan).collect()
    assert len(got) == len(rows) and all(r.split for r in got)
    of = defaultdict(set)
    for r in got:
        of[r.component].add(r.split)
    assert all(len(s) == 1 for s in of.values())
    assert split.linked_split(functions(spark, []), plan).collect() == []


# ---- problem 3


def test_near_pairs_equal_brute_force(spark):
    rows = corpus()
    want = brute_near(rows)
    got = [(r.id_a, r.id_b) for r in near.near_pairs(functions(spark, rows, clash=True).drop("text"), k=4, t=0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_near_crowded_words(spark):
    rng = random.Random(9)
    shared = body(rng, 30)
    rows = [function(i, f"{shared} {body(rng, 3)}") for i in range(60)]  # every word of the sketches is a crowd's
    want = brute_near(rows)
    got = {(r.id_a, r.id_b) for r in near.near_pairs(functions(spark, rows), k=4, t=0.6).collect()}
    assert got == want and len(want) == 60 * 59 // 2


def test_near_of_small_sets_that_share_one_crowded_word(spark):
    rng = random.Random(5)
    place = lambda w: int(shingle_sets([" ".join(w)], 4)[1][0]) / 2**64
    word = lambda: f"v{rng.randrange(10**6)}"
    w = [word(), word(), word()]
    for low, high in [(0, 0.25)] * 12 + [(0.25, 0.5)] + [(0.5, 1)] * 19:  # the longer text's prefix: the first 13 shingles
        w.append(next(x for x in iter(word, None) if low < place([*w[-3:], x]) < high))
    one, texts = w[12:16], [w, w[12:]]
    while len(texts) < 60:
        t = [*one, word(), word()]
        if min(place(t[i : i + 4]) for i in (1, 2)) > place(one):
            texts.append(t)
    rows = [function(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_near(rows)
    assert (0, 1) in want and {(r.id_a, r.id_b) for r in near.near_pairs(functions(spark, rows), k=4, t=0.6).collect()} == want


def test_a_text_of_many_batches_is_one_class(spark, monkeypatch):
    monkeypatch.setattr(near, "HELD", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        rng = random.Random(9)
        text = body(rng, 50)
        rows = [function(i, text) for i in range(400)] + [function(900 + i, edited(rng, text, 1)) for i in range(5)]
        rng.shuffle(rows)
        got = near.near_groups(functions(spark, rows), k=4, t=0.6).collect()
        assert len(got) == 405 and len({r.group_id for r in got}) == 1
        assert len({r.links for r in got if r.fn_id < 400}) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_groups_and_odd_tables(spark):
    rows = corpus(n=6)
    got = {r.fn_id: r for r in near.near_groups(functions(spark, rows), k=4, t=0.6).collect()}
    assert len(got) == sum(1 for r in rows if WORD.search((r[2] or "").lower()))
    for a, b in brute_near(rows):
        assert got[a].group_id == got[b].group_id and got[a].links
    assert near.near_pairs(functions(spark, [])).collect() == []
    nulls = functions(spark, [function(None, "a b c d e"), function(1, None), function(2, None)])
    assert near.near_pairs(nulls).collect() == []
    long_ = body(random.Random(2), 60_000)
    two = functions(spark, [function(1, long_), function(2, long_ + " end")])
    assert [(r.id_a, r.id_b) for r in near.near_pairs(two).collect()] == [(1, 2)]


# ---- problem 5


@pytest.mark.parametrize("seed", range(12))
def test_pieces(seed):
    rng = random.Random(seed)
    alphabet = [" ", "\n", ";", "{", "}", "x", "yy", "\n\n", "é"] if seed % 3 else ["x"]
    text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40_000)))
    at = pieces.cut_points(text)
    assert at[0][0] == 0 and at[-1][1] == len(text)
    assert all(0 < e - s <= 6000 for s, e in at)
    for (s, e), (s2, e2) in zip(at, at[1:]):
        assert s < s2 < e < e2 and 100 <= e - s2 <= 300
    assert (len(at) == 1) == (len(text) <= 6000)


def test_split_oversized(spark):
    line = "int x = call(1);\n"
    rows = [function(1, line * 800), function(2, "é" * 6000), function(3, "é" * 6001), function(None, line * 400), function(4, None), function(5, ""), function(6, "z" * 300_000)]
    got = pieces.split_oversized(functions(spark, rows, clash=True)).collect()
    assert {r.fn_id for r in got} == {1, 3, None, 6}
    assert all(len(r.text) <= 6000 for r in got) and all(r.text.endswith(";\n") for r in got if r.fn_id == 1)
    assert pieces.split_oversized(functions(spark, [])).collect() == []


# ---- problem 6


def test_copies_of_functions(spark):
    rows = corpus()
    of = defaultdict(list)
    for r in rows:
        f = "".join(WORD.findall((r[2] or "").lower()))
        if f:
            of[f].append(r[0])
    df = formats.canonical_text(functions(spark, rows, clash=True).drop("text"), "fn_id", "func")
    got = [tuple(r) for r in formats.copy_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(min(v), x) for v in of.values() for x in v if x != min(v)}
    assert {tuple(r) for r in formats.collapse_copies(df).collect()} == {(min(v), len(v)) for v in of.values()}
    empty = formats.canonical_text(functions(spark, []), "fn_id", "func")
    assert formats.copy_pairs(empty).collect() == [] and formats.collapse_copies(empty).collect() == []


def test_run_over_many_batches(spark):
    rows = [function(i, "int Main ( )" if i % 2 else "INT main()") for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in formats.copy_pairs(formats.canonical_text(functions(spark, rows), "fn_id", "func")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(0, i) for i in range(1, 500)}


@pytest.mark.parametrize("a, b, same", [
    ('{"a": "X y", "b": [1, "Z"]}', '{"b":["1","z."],"a":"xY"}', True),
    ('{"a": 1.50}', '{"a": "1.50"}', True),
    ('{"a": ["x", "y"]}', '{"a": ["xy"]}', False),
    ('{"a": 1}', '{"A": 1}', False),
    ('{"a": true, "b": null}', '{"b": "null", "a": "True"}', True),
])
def test_canonical_json(a, b, same):
    assert (formats.canonical_json(a) == formats.canonical_json(b)) is same


@pytest.mark.parametrize("line", [None, "", "[1]", "{", '{"a": NaN}', '"x"', "{" * 5000])
def test_no_record(line):
    assert formats.canonical_json(line) is None


# ---- problem 7


def test_overlap_equals_brute_force(spark):
    rows = corpus(seed=8, n=30)
    c = ["a" * 40, "a" * 12, "b" * 40, "0" * 40, None, "HEAD"]
    rng = random.Random(4)
    rows = [(*r[:6], rng.choice(c), rng.choice(["7", "07.0", None, "-1", "nan"]), rng.choice(["12", "0", "1.17e+38", None])) for r in rows]
    train = [r for r in rows if r[1] == "train"]
    held = [r for r in rows if r[1] != "train"]
    fold = lambda r: "".join(WORD.findall((r[2] or "").lower()))
    want, near_ = set(), brute_near(rows)
    for x in train:
        for y in held:
            p = (min(x[0], y[0]), max(x[0], y[0]))
            if p in near_:
                want.add(("near", *p))
            if fold(x) and fold(x) == fold(y):
                want.add(("same", *p))
            if x[6] in c[:3] and y[6] in c[:3] and x[6][:12] == y[6][:12]:
                want.add(("commit_id", *p))
            if x[7] in ("7", "07.0") and y[7] in ("7", "07.0"):
                want.add(("big_vul_idx", *p))
            if x[8] == y[8] == "12":
                want.add(("hash", *p))
    o = overlap.Overlap(functions(spark, rows, clash=True).drop("text"), k=4, t=0.6)
    got = [tuple(r) for r in o.all().collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(k == "near" for k, *_ in want)
    cover = {r.id: r for r in o.coverage().collect()}
    assert all(0 <= r.covered <= r.words for r in cover.values())
    assert o.report().count() > 0


def test_overlap_of_odd_tables(spark):
    assert overlap.Overlap(functions(spark, [])).all().collect() == []
    odd = functions(spark, [function(1, None), function(2, None, "valid"), function(None, "a b", "valid"), function(3, "a b", None)])
    assert overlap.Overlap(odd).all().collect() == []


@pytest.mark.parametrize("n", [4, 6, 7, 8, 12, 19, 25])
def test_short_texts_without_their_ends_are_near(spark, n):
    rows = []
    for i in range(12):
        w = [f"w{i}x{j}" for j in range(n + 4)]
        inner = w[2:-2]
        rows += [function(10 * i, " ".join(inner)), function(10 * i + 1, " ".join(w[1:-1]), "valid"), function(10 * i + 2, " ".join(w[1:-2]), "test"), function(10 * i + 3, " ".join(["e", *inner[1:-1], "f"]))]
    split_of = {r[0]: r[1] for r in rows}
    want = {p for p in brute_near(rows) if (split_of[p[0]] == "train") != (split_of[p[1]] == "train")}
    got = {(r.id_a, r.id_b) for r in overlap.Overlap(functions(spark, rows), k=4, t=0.6).near().collect()}
    assert got == want and (want or n < 6)


def test_common_passages_count_for_texts_that_share_another(spark):
    rng = random.Random(2)
    frame, own = body(rng, 15), [body(rng, 5) for _ in range(12)]  # 15 passages, 3 of them common and 3 others unbroken
    rows = [function(i, f"{frame} {body(rng, 40)}") for i in range(300)]
    broken = [w if j > 8 else " ".join([w.split()[0], "q", *w.split()[1:]]) for j, w in enumerate(own)]
    rows += [function(900, f"{frame} {' '.join(own)}", "test"), function(901, f"{frame} {' '.join(own[10:])}"), function(902, f"{frame} {' '.join(broken)}")]
    got = overlap.Overlap(functions(spark, rows), k=4, t=0.2).near()
    assert {(r.id_a, r.id_b) for r in got.collect()} >= {p for p in brute_near(rows[-3:], t=0.2) if 900 in p} != set()


def test_a_block_of_hundreds_of_texts_loses_no_pair(spark):
    rng = random.Random(7)
    block = body(rng, 55)
    rows = [function(i, f"{block} {body(rng, 30)}") for i in range(310)]
    own = body(rng, 40).split()
    rows += [function(900, f"{block} {' '.join(own)}", "valid"), function(901, f"{block} {' '.join(own[:16])} {body(rng, 24)}"), function(902, f"{block} {' '.join(own[:22])} {body(rng, 18)}")]
    want = {p for p in brute_near(rows) if 900 in p}
    got = {(r.id_a, r.id_b) for r in overlap.Overlap(functions(spark, rows), k=4, t=0.6).near().collect()}
    assert got == want and (900, 902) in want


def test_one_shard_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(overlap, "LOAD", 2_000)
    rows = corpus(seed=21, n=25)
    split_of = {r[0]: r[1] for r in rows}
    want = {p for p in brute_near(rows) if (split_of[p[0]] == "train") != (split_of[p[1]] == "train")}
    got = {(r.id_a, r.id_b) for r in overlap.Overlap(functions(spark, rows), k=4, t=0.6).near().collect()}
    assert got == want and want


def test_report_counts_the_pairs(spark):
    rows = corpus(seed=33, n=25)
    o = overlap.Overlap(functions(spark, rows), k=4, t=0.6)
    pairs = o.all().collect()
    told = o.report().groupBy("kind").sum("pairs").collect()
    want = {}
    for r in pairs:
        want[r.kind] = want.get(r.kind, 0) + 1
    assert {r[0]: r[1] for r in told} == want


@pytest.mark.parametrize("n", [1, 3, 5, 59, 60, 100, 203])
def test_a_copied_text_is_covered_whole(spark, n):
    rng = random.Random(n)
    text = body(rng, n)
    rows = [function(1, f"{body(rng, 7)} {text} {body(rng, 9)}"), function(2, text, "valid"), function(3, text, "test")]
    cover = {r.id: (r.words, r.covered) for r in overlap.Overlap(functions(spark, rows)).coverage().collect()}
    assert cover == {2: (n, n), 3: (n, n)}


def test_coverage_equals_brute_force(spark):
    rng = random.Random(12)
    pool = [body(rng, 120) for _ in range(4)]
    rows = [function(i, t) for i, t in enumerate(pool)]
    for i in range(10, 50):  # copied stretches of 2 to 40 words at any place among other words
        w = []
        for _ in range(rng.randrange(1, 5)):
            a, n = rng.randrange(80), rng.randrange(2, 41)
            w += rng.choice(pool).split()[a : a + n] + [f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
        rows.append(function(i, " ".join(w), rng.choice(["valid", "test"])))
    grams = {tuple(t.split()[a : a + 5]) for t in pool for a in range(116)}
    want = {}
    for r in rows[4:]:
        w = r[2].split()
        size = min(5, len(w))
        seen = {a + j for a in range(len(w) - size + 1) if (tuple(w[a : a + 5]) in grams if size == 5 else any(tuple(w) == g[j : j + size] for g in grams for j in range(6 - size))) for j in range(size)}
        want[r[0]] = (len(w), len(seen))
    got = {r.id: (r.words, r.covered) for r in overlap.Overlap(functions(spark, rows)).coverage().collect()}
    assert got == want


# ---- problem 8


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"wort{i}" for i in range(600)] + ["Ä", "Straße", "été"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(60) + ". " + prose(9) + ".") for i in range(15)] + [(90, None), (91, ""), (92, "short item")]
    rows = []
    for i in range(150):
        w = prose(rng.randrange(30, 140)).split()
        if i % 3 == 0:
            q = items[rng.randrange(15)][1].split()
            n, a, at = rng.choice([9, 11, 12, 13, 40]), rng.randrange(15), rng.randrange(len(w))
            w[at:at] = (" - ".join(q[a : a + n])).upper().split(" ")
        rows.append((i, "\n".join(w), "de", "s"))
    rows += [(500, None, None, None), (501, "", "en", None), (502, "---", None, None), (503, prose(40_000), None, None)]
    cut = lambda t: [x.lower() for x in re.findall(r"[^\W_]+", t or "")]
    grams = defaultdict(set)
    for k, t in items:
        w = cut(t)
        for a in range(len(w) - 11):
            grams[tuple(w[a : a + 12])].add(k)
    want = {(d, k) for d, t, *_ in rows for w in [cut(t)] for a in range(len(w) - 11) for k in grams.get(tuple(w[a : a + 12]), ())}
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = leakage.leaks(documents(spark, rows, clash=True), it)
    got = {(r.doc_id, r.item_id) for r in found.where("run >= 12").collect()}
    assert got == want and len(want) >= 20
    assert leakage.leaks(documents(spark, []), it).collect() == []
    assert leakage.leaks(documents(spark, rows[:3]), it.where("false")).collect() == []


def test_cells_find_what_all_passages_find():
    rng = np.random.default_rng(3)
    themes = rng.standard_normal((40, 32))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    queries = unit(themes[rng.integers(0, 40, 900)] + 0.9 * rng.standard_normal((900, 32)))
    vectors = unit(np.concatenate([queries[rng.integers(0, 900, 2000)] + 0.1 * rng.standard_normal((2000, 32)), rng.standard_normal((2000, 32))]))
    i, j = np.nonzero(vectors @ queries.T >= leakage.COSINE)
    a, b, c = leakage._near_pairs(vectors, queries, *leakage.cells(queries))
    found = set(zip(a.tolist(), b.tolist()))
    assert found <= set(zip(i.tolist(), j.tolist())) and len(found) >= 0.9 * len(i) and len(set(a.tolist())) >= 0.97 * len(set(i.tolist()))
    assert len(leakage.cells(queries[:5])[0]) == 1


def test_paraphrases_are_found(spark):
    rng = random.Random(15)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(40)) for i in range(20)]
    docs = [(100 + i, text(200)) for i in range(60)]
    for i, w in items:
        said = [rng.choice(vocabulary) if k % 9 == 4 else x for k, x in enumerate(w)]
        docs.append((i, [*text(50), *said, *text(50)]))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, it).where(f"subsequence >= {leakage.PARAPHRASE} AND answer >= {leakage.ANSWER}").collect()}
    want = {(i, i) for i, _ in items}
    assert len(got & want) >= 18 and len(got - want) <= 1


def test_subsequence_of_a_long_text_is_windowed():
    words = np.arange(30, dtype=np.uint64)
    spread = np.concatenate([np.concatenate([[x], np.full(60, 99, np.uint64)]) for x in words]).astype(np.uint64)
    assert leakage.windowed_subsequence(spread, words) <= 2 and leakage.windowed_subsequence(np.concatenate([spread, words]), words) == 30


def test_a_run_is_a_leak_whatever_its_cosine(spark, monkeypatch):
    rng = random.Random(4)
    w = [[f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(6)]
    rows = [(i, " ".join(w[0][i : i + 20] + w[1][5 : 5 + n] + w[2][:20]), "en", "s") for i, n in enumerate([11, 12, 12, 30])]
    monkeypatch.setattr(leakage, "COSINE", 2.0)  # retrieval alone finds nothing
    search = leakage._search(type("Shared", (), {"value": _block(spark, rows, w[1])})())
    words = leakage.encoded(documents(spark, rows), "doc_id", "text").toArrow().to_batches()
    got = {(d, r) for b in search(iter(words)) for d, r in zip(b.column(0).to_pylist(), b.column(3).to_pylist())}
    assert got == {(1, 12), (2, 12), (3, 30)}


def _block(spark, rows, item):
    words = leakage.encoded(documents(spark, rows), "doc_id", "text")
    idf = leakage.inverse_frequencies(words)
    weighted = leakage.latent_basis(words, idf) * idf[:, None]
    w = leakage.word_hashes(" ".join(item), {})
    starts = np.arange(len(w) - leakage.RUN + 1)
    queries = leakage._windows(w, starts, weighted)
    return weighted, np.zeros(len(starts), int), queries, leakage.cells(queries), [(7, w, w[-5:])]


def test_common_subsequence():
    a, b = np.array([1, 9, 2, 3, 8, 4], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)
    assert leakage.common_subsequence(a, b) == 4 and leakage.longest_run(a, b) == 2


# ---- problem 9


def test_splitting_tree_deals_all():
    rng = np.random.default_rng(1)
    for shards in (1, 2, 3, 7, 16):
        got = np.array(mixing.splitting_tree([100, 3, 0, 41], shards, rng))
        assert got.shape == (shards, 4) and got.sum(0).tolist() == [100, 3, 0, 41] and got.sum(1).max() - got.sum(1).min() <= shards


def test_mix(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [(i, text(rng.randrange(5, 60)), None, rng.choice(["Big", "big ", "BIG"])) for i in range(600)]
    rows += [(1000 + i, text(20), None, "small") for i in range(40)] + [(2000, None, None, "small"), (2001, "", None, None), (2001, "x y", None, "tiny"), (2001, "x y", None, "tiny")]
    t = spark.createDataFrame([("big", 700, 1), ("small", 200, 3), ("tiny", 50, 8), ("absent", 50, 2), (None, None, None)], "source string, weight_permille int, max_repeats int")
    df = documents(spark, rows, clash=True)
    report = {r.source: r for r in mixing.mix_report(df, t).collect()}
    assert {s for s, r in report.items() if r.short} >= {"absent", "tiny"} and not report["big"].short
    got = mixing.mixed(df, t, shards=5).collect()
    size = defaultdict(int)
    seen = set()
    for r in got:
        size[r.source] += r.tokens
        assert r.copy_no <= {"big": 1, "small": 3, "tiny": 8}[r.source]
        if r.source != "tiny":
            assert (r.source, r.doc_id, r.copy_no) not in seen
        seen.add((r.source, r.doc_id, r.copy_no))
    for s in ("big", "small"):
        assert 0 <= size[s] - report[s].quota <= 200
    assert {r.shard for r in got} == set(range(5))
    assert mixing.mixed(documents(spark, []), t).collect() == [] and all(r.quota == 0 for r in mixing.mix_report(documents(spark, []), t).collect())


# ---- problem 10


@pytest.mark.parametrize("text, bad", [
    ("Fixed in {{ version }}.", True),
    ("Dear <REPORTER>, thank you for the report.", True),
    ("Summary\n__COMPONENT__", True),
    ("Impact: [your cve_id here]", True),
    ("TODO: add title", True),
    ("Contact: owner: TBD by author", True),
    ("&lt;version&gt; was reported against the current release.", True),
    ("sample text sample text sample text sample te", True),
    ("Menu Login Help\nPAGE NOT FOUND\nBack to start", True),
    ("Ohne Skripte bleibt diese Ansicht leer.", True),
    ("<h1>You need to enable scripts to run this app.</h1>", True),
    ("Veuillez rÃ©essayer plus tard.", True),
    ("Pravis ostia fusto dorum aeris cevit velat mira lorem gremi condat sintar dorum fusto.", True),
    ("The template engine evaluates `{{ name }}` taken from leaf, so code could run.", False),
    ("Replace the TODO in shell_fill(): it hides a 500 from the gateway.", False),
    ('Users of nimbra saw "access denied" in the audit trail.', False),
    ("With JavaScript disabled the upload form skips its check, which core_open() should repeat.", False),
    ("Fixed in 8.23.4.", False),
    ("Menu Login Help\nThe fix is in velkern 7.1.6; older releases wait.\nBack to start", False),
    ("```c\nint __attribute__ = {{ x }};\n```\nFine text about the parser and the lock.", False),
    ("", False),
    (None, False),
])
def test_residue(spark, text, bad):
    rows = [(1, text, None, None), (2, "Fixed in 1.2.3.", None, None), (3, "Dear nimbra team, thank you for the report.", None, None)]
    got = {r.doc_id for r in residue.residue(documents(spark, rows, clash=True)).collect()}
    assert got == ({1} if bad else set())


def test_a_template_that_names_marks_alike_is_no_residue(spark):
    rows = [(i, f"Our generator keeps $name$ in header {i} of the release.", None, None) for i in range(5)]
    assert residue.residue(documents(spark, rows)).collect() == []
    assert residue.residue(documents(spark, [])).collect() == []
    assert residue.residue(documents(spark, [(None, "{{ x }}", None, None), (1, "word " * 100_000 + "lock_a", None, None)])).collect() == []


@pytest.mark.parametrize("line", [
    "Hello {{ customer_name }}, your order has shipped.",
    "Hello $customer_name$, your order has shipped.",
    "Hello ${customer_name}, your order has shipped.",
    "Contact for this page: [insert your name] of the team.",
])
@pytest.mark.parametrize("copies", [1, 2, 40])
def test_unfilled_copies_are_residue_however_many(spark, line, copies):
    rows = [(i, line, None, None) for i in range(copies)] + [(100 + i, f"{line}\nThe lock of part {i} is held too long.", None, None) for i in range(copies)] + [(900, "The lock is held too long.", None, None)]
    got = {r.doc_id for r in residue.residue(documents(spark, rows)).collect()}
    assert got == {r[0] for r in rows if r[0] != 900}


def test_a_slot_form_is_residue_where_all_instances_are_unfilled_alike(spark):
    rows = [(i, f"Hello {{{{ customer_name }}}}, your order {i} has shipped.", None, None) for i in range(6)]
    assert {r.doc_id for r in residue.residue(documents(spark, rows)).collect()} == set(range(6))


@pytest.mark.parametrize("message", [
    "Our servers are having a bad day, reload in a moment.",
    "What you wanted failed to arrive.",
    "Si è verificato un errore imprevisto.",
    "Deze pagina kon niet gevonden worden, probeer het opnieuw.",
    "Возникла непредвиденная ошибка.",
])
def test_a_repeated_error_page_of_no_list_is_residue(spark, message):
    assert not residue.is_page_text(residue._plain(message))
    rows = [(i, f"Menu Help\n{message}\nBack to start", None, None) for i in range(5)] + [(10, message, None, None), (10, message, None, None)]
    other = [(20 + i, "The lock of the parser is held while the queue grows.", None, None) for i in range(5)]  # repeated, but no page
    other += [(30, f"We saw it in core_open().\n{message}", None, None), (31, "", None, None)]
    got = {r.doc_id for r in residue.residue(documents(spark, rows + other)).collect()}
    assert got == {0, 1, 2, 3, 4, 10}


def test_a_text_with_a_cue_in_fewer_documents_or_about_a_subject_is_no_residue(spark):
    line = "The upload failed and nobody saw why."
    rows = [(1, line, None, None), (1, line, None, None), (1, f"{line} {line}", None, None), (2, line, None, None)]
    rows += [(10 + i, "The upload of lock_a failed and nobody saw why it was.", None, None) for i in range(5)]
    assert residue.residue(documents(spark, rows)).collect() == []


UNSEEN = [
    "Hello ##CUSTOMER##, your parcel is on its way.",
    "Dear %%FIRST_NAME%%, thank you for signing up.",
    "Good morning *|FNAME|*, here is the news of this week.",
    "Error establishing a database connection",
    "You have been logged out.",
    "This page isn't working. The server could not handle this request.",
    "Please verify that you are human to continue.",
    "Resource limit is reached. The website is unable to service your request.",
    "Die Seite konnte nicht geladen werden.",
    "La connexion au serveur a échoué. Veuillez réessayer.",
    "No se pudo cargar la página solicitada.",
]
HONEST = [
    "Sorry, I missed this review yesterday. The patch looks good to me.",
    "Oops, I broke the build with my last commit. Fixed now.",
    "Coming soon in the next release: a new parser and faster scans of large folders.",
    "The review of the quarter lists what the team has built and what is left.",
    "We measured the time of each request: the server answers in 20 ms and nothing is lost.",
]


def test_residue_of_no_list(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(UNSEEN + HONEST)]
    got = {r.doc_id for r in residue.residue(documents(spark, rows)).collect()}
    assert len(got & set(range(len(UNSEEN)))) >= 0.9 * len(UNSEEN) and not got - set(range(len(UNSEEN)))


def test_slots_are_induced_from_records_of_one_template(spark):
    names = ["Maria", "Tomas", "Ines", "Jean", "Olga", "Petra"]
    texts = [f"Dear {n}, we have received your order and will ship it soon." for n in names] + ["Dear customer_name, we have received your order and will ship it soon."]
    texts += [f"The invoice goes to {c} before the end of the week." for c in ["Bonn", "Paris", "Madrid", "Vienna", "Oslo", "Rome", "Lyon"]] + ["The invoice goes to __ before the end of the week.", "The invoice goes to companyName before the end of the week."]
    # names as values: what most instances hold is no slot left open
    texts += [f"The module calls {v} for every single entry of the log." for v in ["order_id", "user_name", "account_id", "item_price", "parser", "loader", "reader"]]
    got = {r.doc_id: r.slots for r in residue.residue(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {6: 1, 14: 1, 15: 1}
