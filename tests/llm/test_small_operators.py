"""Chat formatting, URL filters, top-k search, licenses, decontamination, quality."""

import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import chat, decontaminate, licenses, quality, topk, urlfilter

# --- chat ---------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "</turn>", "### ", "<\\e/turn>", "#\\h## ", "#", "<", "\n", "é", "user", ":", "a", "### assistant:\n", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Odd: role\n", None]), rng.choice([None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(6)]])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "x"), (None, 1, "user", "y"), (50, 1, "assistant", "same"), (50, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in chat.read_conversations(formatted).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        assert got[c] == (turns, "".join(x for r, x in turns if r == "assistant"))
    for r in formatted.collect():
        assert r.formatted.count("### ") == 1 + sum(a[0] != b[0] for a, b in zip(got[r.conv_id][0], got[r.conv_id][0][1:], strict=False))
    assert chat.format_conversations(spark.createDataFrame([], df.schema)).collect() == []


def test_long_conversation(spark):
    """Many turns: exact spans, and a cost that does not grow with their square."""
    n = 30_000
    rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 3 = 1, 'assistant', 'user') role", "concat('t', id, if(id % 5 = 0, '### ', '')) text")
    got = chat.format_conversations(rows.unionByName(spark.createDataFrame([(2, 0, "assistant", "one")], "conv_id long, turn long, role string, text string")))
    back = {r.conv_id: r for r in chat.read_conversations(got).collect()}
    assert back[2].loss_text == "one" and len(back[1].turns) == n
    assert back[1].loss_text == "".join(f"t{i}" + "### " * (i % 5 == 0) for i in range(n) if i % 3 == 1)
    assert [t.text for t in back[1].turns[:6]] == ["t0### ", "t1", "t2", "t3", "t4", "t5### "]


# --- url filter ------------------------------------------------------------------------


def test_url_filter_against_brute_force(spark):
    rng = random.Random(3)
    rules = [(h, p, a) for h in ("com", "a.com", "b.a.com", "net", "x") for p in ("/", "/en/", "/en/a", "") for a in (rng.choice(["allow", "block"]),)] + [(None, "/", "allow"), ("", "/", "block")]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "no-scheme", "") for h in ("A.com", "c.b.a.com", "net", "x.net.", "xcom", "", "x:80", "..com") for p in ("", "/", "/en/", "/en/ab?x=/en/#y", "?q", "#/en/", "/EN/\n/z")] + [None, "http://a.com/?u=http://b.net/en/", "http://a.com/é/" + "z" * 5000]
    df = spark.createDataFrame([(i % 7 or None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in urlfilter.judge(df, spark.createDataFrame(rules, "host string, path string, action string"), "block").collect())
    want = []
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((str(i % 7 or None), host, path, str(best and best[3]), best[4] if best else "block"))
    assert got == sorted(want)
    none = urlfilter.judge(df, spark.createDataFrame([], "host string, path string, action string"))
    assert none.where("verdict = 'allow' and rule is null").count() == len(urls)


def test_rules_that_end_within_a_segment(spark):
    """Random rules, with and without a slash at the end, against a plain search of the longest."""
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5)))
    hosts = ["com", "x.com", "a.x.com", "org", "b.org", "c.b.org"]
    rules = sorted({(rng.choice(hosts), "/" * rng.randint(0, 1) + part()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [f"http://{rng.choice(['', 'w.', 'A.'])}{rng.choice(hosts)}{rng.choice(['/' + part() + part(), '', '?/a', '#x'])}" for _ in range(300)]
    want = {}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), re.split("[?#]", rest[end:])[0]
        fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for (h, p), a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = (host, path, *(max(fits)[3:] if fits else (None, "allow")))
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, prefixes int")
    frame = spark.createDataFrame([(h, p, a) for (h, p), a in rules], "host string, path string, action string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, frame).collect()} == want


# --- top-k -------------------------------------------------------------------------------


def test_top_k_of_large_components(spark):
    """Exact for every finite vector, and empty ones, against Python integers."""
    rng = random.Random(4)
    values = [0.0, 1.0, -1.0, 1.5, 2.0**52, -(2.0**53), 1e16, -1e16, 3e18, 1e19, -1e19, 1e200, -1e200, 1.7e308, -1.7e308, 1e-300, -1e-300]
    vectors = [(i, [rng.choice(values[: rng.choice([4, 9, 17])]) for _ in range(3)]) for i in range(60)] + [(60, []), (61, []), (62, [1.0]), (63, None), (64, [None, 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0]), (66, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in vectors[:63]}
    want = {}
    for q, v in whole.items():
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole.items() if i != q and len(w) == len(v))
        want[q] = [(i, -s) for s, i in scores[:7]]
    got = {}
    for r in topk.top_k(df, df, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: v for q, v in want.items() if v} and 60 in got and 62 not in got
    small = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e16, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(small, small.where("vec_id = 0"), 10).orderBy("rank").collect()] == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, 3 << 20)]


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e15])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_QUERIES", 3)
    monkeypatch.setattr(topk, "TILE_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (np.round(rng.normal(size=4), 1) * scale).tolist()) for i in range(120)] + [(i, [scale, scale, 0.0, 0.0]) for i in range(200, 240)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 1.0, 1.0, 1.0]), (303, [float("inf"), 1.0, 1.0, 1.0]), (304, []), (None, [1.0, 1.0, 1.0, 1.0]), (305, [1.0, 2.0]), (310, [3.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 10 = 0"), 6).collect())
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in [*rows, (305, [1.0, 2.0]), (310, [3.0, 1.0])]}
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = []
    for q in (i for i in ints if i % 10 == 0):
        scored = sorted((-clip(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:6])]
    assert got == sorted(want)
    assert topk.top_k(df, df.where("false"), 6).collect() == []


# --- licenses ------------------------------------------------------------------------------


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    long = licenses.TEMPLATES["MIT-text"]
    broken = long.replace("free of charge", "gratis").replace("publish, ", "")
    rows = [(1, f"Été. {mit}\nmore"), (2, f"x {gpl.upper()} y {mit} z {mit}"), (3, None), (4, ""), (5, "a license of mit"), (6, f"w {broken} v"), (None, mit), (7, "word " * 30_000 + mit)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, matches int")
    got = {r.doc_id: [(m.license, m.start, m.end) for m in r.matches] for r in licenses.scan(df).collect()}
    assert got[1] == [("MIT", 5, 5 + len(mit) - 1)]
    assert [m[0] for m in got[2]] == ["GPL-3.0", "MIT", "MIT"]
    assert got[3] == got[4] == got[5] == []
    assert [m[0] for m in got[6]] == ["MIT-text"] and got[6][0][1:] == (2, 2 + len(broken) - 1)
    assert got[None] == [("MIT", 0, len(mit) - 1)] and got[7] == [("MIT", 150_000, 150_000 + len(mit) - 1)]
    assert licenses.scan(spark.createDataFrame([], df.schema)).collect() == []


def _best_windows(text, template, percent=80):
    """(start, equal words) of every place where so many words of the template stand at their place."""
    out = []
    for a in range(1 - len(template), len(text)):
        n = sum(0 <= a + i < len(text) and text[a + i] == w for i, w in enumerate(template))
        if 100 * n >= percent * len(template):
            out.append((a, n))
    return out


def test_licenses_against_every_window(spark):
    """Each place that has 80 % of a template word for word is in a match of no less coverage; each match has its coverage."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(40)]
    templates = {f"t{n}": " ".join(rng.choices(vocab, k=n)) for n in (2, 4, 5, 6, 9, 11, 15, 16, 17, 24, 60)}
    texts = []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 4)):
            words += rng.choices(vocab, k=rng.randint(0, 30))
            t = rng.choice(list(templates.values())).split()
            for i in rng.sample(range(len(t)), len(t) // 5):
                t[i] = rng.choice(vocab)
            words += t
        texts.append(words)
    df = spark.createDataFrame([(i, ", ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.matches for r in licenses.scan(df, templates).collect()}
    seen = 0
    for i, words in enumerate(texts):
        at, places = 0, {}
        for k, w in enumerate(words):
            places[at] = k
            at += len(w) + 2
        spans = {}
        for m in got[i]:
            a, n = places[m.start], len(", ".join(words)[m.start : m.end].split(", "))
            spans.setdefault(m.license, []).append((a, a + n, m.coverage))
            t = templates[m.license].split()
            table = [[0] * (n + 1) for _ in range(len(t) + 1)]  # the longest common subsequence
            for x, u in enumerate(t):
                for y in range(n):
                    table[x + 1][y + 1] = table[x][y] + 1 if u == words[a + y] else max(table[x][y + 1], table[x + 1][y])
            assert 0.8 <= m.coverage <= table[-1][-1] / len(t) + 1e-6
        for name, t in templates.items():
            t = t.split()
            for a, n in _best_windows(words, t):
                seen += 1
                assert any(x < a + len(t) and a < y for x, y, _ in spans.get(name, [])), (i, name, a, n)
    assert seen > 300


def test_a_license_repeated_many_times(spark):
    mit = licenses.TEMPLATES["MIT"]
    df = spark.createDataFrame([(1, f"é {mit} " * 500), (2, "the license " * 20_000), (3, "Released under an MIT License")], "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.start) for m in r.matches] for r in licenses.scan(df).collect()}
    assert got[1] == [("MIT", 2 + i * (len(mit) + 3)) for i in range(500)] and got[2] == [] and [m[0] for m in got[3]] == ["MIT"]


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50):
        g = rng.integers(0, 9, size=n).astype(np.uint64)
        kept = licenses.winnow(g)
        assert kept.any() and all(kept[i : i + licenses.WINNOW].any() for i in range(max(1, n - licenses.WINNOW + 1)))


# --- decontamination -------------------------------------------------------------------------


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (40, 25, 12, 7, 3)]
    fill = lambda n: [word() for _ in range(n)]
    near = list(items[0])
    for i in (4, 11, 19, 20, 33):
        near[i] = word()
    seven = list(items[3])
    seven[2] = word()
    docs = [
        (1, fill(50) + items[0] + fill(9), {0: 40}), (2, fill(5) + near + fill(5), {0: 35}), (3, fill(200), {}), (4, items[1][:14] + fill(30), {1: 14}), (5, items[1][:8] + fill(30), {}),
        (6, fill(3) + items[2] + items[3], {2: 12, 3: 7}), (7, fill(4) + seven + fill(4), {}), (8, fill(4) + items[4] + fill(4), {}), (None, items[1], {1: 25}),
    ]
    text = lambda w: ", ".join(w).upper()
    df = spark.createDataFrame([*[(d, text(w), 1) for d, w, _ in docs], (10, None, 1), (11, "", 1)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([*[(i, " ".join(w)) for i, w in enumerate(items)], (None, " ".join(items[0])), (9, None)], "item_id long, text string")
    want = {d: h for d, _, h in docs} | {10: {}, 11: {}}
    for words in (decontaminate.BLOCK_WORDS, 20):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert {r.doc_id: {h.item_id: h.words for h in r.hits} for r in decontaminate.find(df, bench).collect()} == want
    assert all(not r.hits for r in decontaminate.find(df, bench.where("false")).collect())
    assert decontaminate.find(spark.createDataFrame([], df.schema), bench).collect() == []


def longest_equal(text, item):
    """Equal words of the best stretch on any diagonal, by trying all; 0 if none."""
    best = 0
    for start in range(1 - len(item), len(text)):
        lo, hi = max(0, -start), min(len(item), len(text) - start)
        same = [text[start + i] == item[i] for i in range(lo, hi)]
        for a in range(len(same)):
            for b in range(a + min(12, len(item)), len(same) + 1):
                if 4 * sum(same[a:b]) >= 3 * (b - a):
                    best = max(best, sum(same[a:b]))
    return best


def test_stretch_against_all_segments():
    rng = np.random.default_rng(7)
    item = np.arange(1, 31, dtype=np.uint64)
    for n in (15, 26, 30):
        for edits in range(10):
            text = item[30 - n :].copy()
            text[rng.permutation(n)[:edits]] = 0
            assert decontaminate.verified(text, item, n - 30) == longest_equal(text.tolist(), item.tolist())


def test_edited_passages_of_longer_items(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(40)]
    one = [*item[:3], word(), *item[4:15]]
    gap = [*item[5:16], *[word() for _ in range(4)], *item[20:31]]
    texts = [[word() for _ in range(6)] + p + [word() for _ in range(6)] for p in (one, gap, item[:8])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [h.words for h in r.hits] for r in decontaminate.find(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {i: [n] if (n := longest_equal(t, item)) else [] for i, t in enumerate(texts)} and [bool(got[i]) for i in range(3)] == [True, True, False]


def test_masks_miss_no_admitted_edit():
    for n, edits in ((10, 2), (12, 3), (16, 4), (20, 5)):
        fits = [{i + j for j, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for i in range(n - len(m) + 1)]
        assert all(any(f.isdisjoint(gone) for f in fits) for gone in itertools.combinations(range(n), edits))


def test_every_edit_within_the_rule_is_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", 5, raising=False)
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 50, raising=False)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items, texts = [], []
    for n, places in [(10, (0,)), (10, (9,)), (10, (3, 6)), (11, (3, 7)), (12, (3, 6, 9)), (16, (3, 7, 11, 15)), (60, range(3, 60, 4)), (12, (0, 4, 8, 11))] + [(n, rng.sample(range(n), n // 4)) for n in range(10, 25)]:
        item = [word() for _ in range(n)]
        items += [item, [word() for _ in range(9)] + [word() if i % 4 == 3 else w for i, w in enumerate(item)] + [word()]]
        texts.append([word() for _ in range(4)] + [word() if i in places else w for i, w in enumerate(item)] + [word() for _ in range(4)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: {h.item_id: h.words for h in r.hits} for r in decontaminate.find(docs, bench).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {j: n for j, w in enumerate(items) if (n := longest_equal(t, w))}
    assert [2 * i in got[i] for i in range(8)] == [True] * 7 + [False]


def test_random_passages_against_all_diagonals(spark):
    """Small vocabularies, so that texts and items repeat their words, short items included."""
    rng = random.Random(14)
    for vocab, shortest in ((2, 5), (6, 1), (40, 5)):
        word = lambda n: [f"w{rng.randrange(vocab)}" for _ in range(n)]  # noqa: B023, E731
        items = [word(n) for n in (1, 3, 5, 7, 9, 10, 13, 20, 33)]
        texts = []
        for _ in range(40):
            part = list(rng.choice(items))
            for i in rng.sample(range(len(part)), len(part) // 4):
                part[i] = word(1)[0]
            texts.append(word(rng.randint(0, 12)) + part[rng.randint(0, 3) :] + word(rng.randint(0, 12)))
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
        bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
        got = {r.doc_id: {h.item_id: h.words for h in r.hits} for r in decontaminate.find(docs, bench, shortest=shortest).collect()}
        for i, t in enumerate(texts):
            want = {}
            for j, w in enumerate(items):
                if len(w) < shortest:
                    continue
                n = longest_equal(t, w) if len(w) >= 10 else len(w) * any(t[a : a + len(w)] == w for a in range(len(t)))
                if n:
                    want[j] = n
            assert got[i] == want


def test_repeated_words_cost_no_more():
    import resource
    import time

    texts = ["w " * 20_000, "x y " * 10_000, "a b c d e f g " * 3_000, ""]
    items = ["w " * 200, "x y " * 100, "a b c d e f g " * 20, "w w x x y y a a b b c c"]
    h, first = decontaminate._word_lists(pa.array(texts))
    g, f = decontaminate._word_lists(pa.array(items))
    index = decontaminate.Items([0, 1, 2, 3], [g[a:b] for a, b in zip(f[:-1], f[1:], strict=True)])
    decontaminate.contained(index, h[:1000], np.array([0, 1000]))
    before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    assert decontaminate.contained(index, h, first) == {(0, 0): 200, (1, 1): 200, (2, 2): 140}
    assert time.process_time() - t < 5 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


# --- quality ---------------------------------------------------------------------------------


def test_statistics_of_odd_texts():
    rows = quality.statistics(pa.array(["", None, " \n ", "a", "É é É", "word " * 5000]))
    assert (rows[:2] == 0).all() and np.isfinite(rows).all() and rows[4][0] == 5 and rows[5][quality.STATS.index("words")] == 5000


def test_rules_compile_and_learn(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 80)))
    bad = lambda: " ".join([good().split()[0].upper() + "!!"] * rng.randint(5, 40))
    rows = [(i, good() if i % 3 else bad()) for i in range(900)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int")
    labels = spark.createDataFrame([(i, int(bool(i % 3))) for i, _ in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.classify(docs, model).collect()}
    assert sum(got[i][1] == int(bool(i % 3)) for i in got) > 890
    stats = quality.statistics(pa.array([t for _, t in rows]))
    assert np.allclose([got[i][0] for i, _ in rows], model.score(stats))
    odd = quality.classify(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), model).collect()
    assert len(odd) == 2 and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit(docs, labels.where("quality = 1")).rules == []
    assert quality.fit(docs, labels.where("false")).bias == 0
    assert quality.classify(docs.where("false"), model).collect() == []


def test_held_out_fold(spark):
    import zlib

    got = {r.doc_id: r.h for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", quality.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}
