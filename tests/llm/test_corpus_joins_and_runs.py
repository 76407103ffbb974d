"""Periodic runs, Jaccard classes and Merkle proofs against plain versions, and their odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_texts import prose
from tabloom.llm import merkle, periodic, set_join

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """(start, length, period) by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(rng):
    letters, words = rng.choice([1, 2, 3, 5, 100]), []
    some = lambda n: [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        block = some(rng.randint(1, 90))
        if rng.random() < 0.5:
            block = some(rng.randint(1, 4)) * rng.randint(5, 40) + some(rng.randint(0, 2))
        words += block * rng.randint(1, 4) + block[: rng.randint(0, len(block))]
    return words[:900]


def test_runs_of_any_text():
    rng = random.Random(5)
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    texts = [b, [0] * 700, ([0, 1] * 50 + [0]) * 2, [0] * 200 + [1] + [0] * 200, []] + [repetitive(rng) for _ in range(150)]
    for at in range(0, len(texts), 5):
        part = texts[at : at + 5]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        got = periodic.runs_of(np.array(sum(part, []), np.int64), bounds)
        want = [(s + int(low), n, q) for low, t in zip(bounds, part) for s, n, q in plain_runs(t)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_periodic_runs_and_their_collapse(make_docs):
    line = "one two three four five six seven"
    docs = make_docs([
        (1, f"start {' '.join([line] * 3)} end"), (2, None), (3, ""), (4, " \t\n"), (5, " ".join(["x"] * 30_000)), (None, line),
        (6, f"{line} {line}"), (6, line), (7, " ".join(["A a"] * 6)), (8, " ".join([prose(2, 4_000)] * 2)), (9, " ".join(["é"] * 11)),
    ])
    got = sorted(((r.id, [tuple(x) for x in r.runs], r.n_words, r.collapsed) for r in
                  periodic.periodic_runs(docs.drop("id").withColumnRenamed("doc_id", "id"), "id").collect()), key=str)
    by = {g[0]: g for g in got if g[0] != 6}
    assert len(got) == 11 and by[1][1:] == ([(1, 21, 7)], 23, f"start {line} end")
    assert all(by[i][1:] == ([], 0, "") for i in (2, 3, 4))
    assert by[5][1:] == ([(0, 30_000, 1)], 30_000, "x") and by[None][1:] == ([], 7, line)
    assert [g for g in got if g[0] == 6] == [(6, [(0, 14, 7)], 14, line), (6, [], 7, line)]
    assert by[7][1:] == ([(0, 12, 2)], 12, "A a") and by[9][1] == []
    assert (0, 8_000, 4_000) in by[8][1]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_repeated_tail(spark):
    texts = [prose(1, 40), "a b  c", "", None, "x"]
    rows = [(i, t) for i in range(80) for t in texts]
    df = spark.createDataFrame(rows, "seed long, text string").withColumn("told", periodic.with_repeated_tail(F.col("text"), F.col("seed")))
    for r in df.collect():
        words = SPACE.findall(r.text or "")
        if r.seed % 10 == 0 and words:
            g = r.seed // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert SPACE.findall(r.told or "") == words


def plain_classes(rows, percent, width):
    sets = []
    for _, text in rows:
        w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return {doc_id: (len(s), least[top(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize(("percent", "width", "seed"), [(85, 4, 1), (60, 2, 2), (80, 5, 3)])
def test_jaccard_classes(make_docs, percent, width, seed, monkeypatch):
    """Chains of edits, common passages of all lengths, and members that their leader does not link to."""
    monkeypatch.setattr(set_join, "_BLOCK", 3)
    monkeypatch.setattr(set_join, "_LEADER_ROWS", 5)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    common = [rng.choices(vocabulary, k=40) for _ in range(3)]
    texts = []
    for family in range(25):
        base = rng.choices(vocabulary, k=rng.randint(1, 60))
        if rng.random() < 0.6:
            base += rng.choice(common)[: rng.randint(5, 40)]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(base))
                base = base[:at] + rng.choice([[], [f"f{family}x{rng.randrange(9)}"], base[at : at + 1] + ["Y"]]) + base[at + 1 :] or ["z"]
    rows = list(enumerate(texts, 100)) + [(1, None), (2, ""), (3, " \n"), (5, "a b"), (6, "A  B"), (7, "a b c")]
    rng.shuffle(rows)
    want = plain_classes(rows, percent, width)
    assert len({c for _, c in want.values()}) > 20
    got = set_join.jaccard_classes(make_docs(rows), percent=percent, width=width)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_jaccard_classes_of_odd_rows(make_docs):
    long = prose(4, 20_000)
    docs = make_docs([(1, long), (2, long + " end"), (2, long + " end"), (3, "b c"), (3, "one two three four five"), (None, long), (None, ""), (9, None), (8, "b C")])
    got = sorted((tuple(r) for r in set_join.jaccard_classes(docs).collect()), key=str)
    n = {r[0]: r[1] for r in got}
    assert len(got) == 9 and n[2] == n[1] + 1
    assert [r[2] for r in got if r[0] in (1, 2)] == [1, 1, 1]
    assert got.count((3, 1, 3)) == 1 and got.count((3, 2, 3)) == 1 and (8, 1, 3) in got and (9, 0, 9) in got
    assert {r[2] for r in got if r[0] is None} == {None}
    assert set_join.jaccard_classes(docs.limit(0)).count() == 0
    assert {r.component_id for r in set_join.jaccard_classes(make_docs([(4, None), (4, "")])).collect()} == {4}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        g = i // 16 * 16
        out.append(("".join(nodes[g:i]), "".join(nodes[i + 1 : g + 16])))
        i //= 16
    return out


def plain_proofs(rows):
    """Rows (id, source, leaf, claimed)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {s: plain_tree([r[2] for r in groups[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path, folded = plain_path(trees[s], i) + plain_path(top, k), r[3] or r[2]
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r[0], r[2], trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


LEAVES = "id long, source string, leaf string, claimed string"


@pytest.mark.parametrize(("sizes", "range_rows"), [
    ([700, 1, 16, 17, 256, 3], 50), ([5] * 40 + [300], 7), ([1] * 300, 20), ([1], 10), ([33], 2), ([2, 1], 1), ([257, 0, 4096], 100),
])
def test_merkle_proofs(spark, sizes, range_rows, monkeypatch):
    """Trees within a range, over many ranges, and many trees in one range."""
    monkeypatch.setattr(merkle, "_RANGE_ROWS", range_rows)
    rng = random.Random(len(sizes))
    rows = []
    for k, n in enumerate(sizes):
        source = None if k == 1 else f"s{k}é" if k % 2 else f"S{k}"
        rows += [(rng.randrange(10**6), source, sha(f"{k}/{i}"), sha("x") if i % 7 == 0 else None) for i in range(n)]
    if len(rows) > 20:
        rows += rows[:5] + [(None, "S0", sha("n"), None), (None, "S0", sha("m"), sha("m")), (rows[0][0], rows[0][1], sha("tie"), None)]
    rng.shuffle(rows)
    got = merkle.merkle_proofs(spark.createDataFrame(rows, LEAVES).withColumn("at", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=str) == plain_proofs(rows)


def test_merkle_of_nothing(spark):
    empty = spark.createDataFrame([], LEAVES)
    assert merkle.merkle_proofs(empty).count() == 0
    names = merkle.merkle_proofs(empty).columns
    one = merkle.merkle_proofs(spark.createDataFrame([(1, None, sha("a"), None)], LEAVES)).first()
    assert names == list(one.asDict()) and one.leaf == one.root == one.subroot == one.folded_root
    assert one.proof_sha256 == sha("") and one.verified


def test_leaf_digest(spark):
    df = spark.createDataFrame([(12, None, "é"), (None, "", "x" * 70_000)], "a long, b string, c string")
    got = [r.h for r in df.select(merkle.leaf_digest([F.col("a"), F.col("b"), F.col("c")]).alias("h")).collect()]
    assert got == [sha("2:12-2:é"), sha("-0:70000:" + "x" * 70_000)]
