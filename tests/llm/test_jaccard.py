"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import textkernel as tk
from tidelog.llm.jaccard import Rule, divide_skip, jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)], links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=12, per=14):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=30)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 90]))
        for _ in range(rng.randint(1, per)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w += passage
            rows.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(rows)
    rows += ["", None, " \t\n", "one", "one", "ONE two", "one two", "É é", "é É", "é É"]
    out = [(i * 3, t) for i, t in enumerate(rows)]
    return out + [(None, out[0][1]), (6, out[2][1]), (6, "w1 w2 w3 w4 w5 w6")]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 4, 50), (4, 1, 100)])
def test_against_brute_force(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard_join(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tiles_lose_no_link(spark, monkeypatch):
    rows = corpus(9, groups=3, per=60)
    monkeypatch.setattr("tidelog.llm.jaccard.TILE_SHINGLES", 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_join(df, 4, 85).collect()), key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("heap", [0, 10**9])
def test_divide_skip_counts(monkeypatch, heap):
    monkeypatch.setattr("tidelog.llm.jaccard.HEAP_POSTINGS", heap)
    rng = np.random.default_rng(3)
    for percent in (40, 70, 90):
        sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 40))) for _ in range(80)]
        rule = Rule(4, percent)
        got = {tuple(sorted((x, int(y)))) for x, ys in divide_skip(sets, rule) for y in ys}
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert got == want


def test_kernel_windows_match(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("aB \n\tcé") for _ in range(rng.choice([0, 1, 5, 300, 5000]))) for _ in range(60)] + ["x" * 9000]
    whole = [s.tolist() for s in tk.shingle_sets(pa.array(texts), 4)]
    assert [len(s) for s in whole] == [len(shingles(t, 4)) for t in texts]
    monkeypatch.setattr(tk, "WINDOW", 64)
    assert [s.tolist() for s in tk.shingle_sets(pa.array(texts), 4)] == whole
