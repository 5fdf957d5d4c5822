"""The pipeline's stages against brute force, on a small corpus with odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from tidelog.llm import pieces, pii, quality
from tidelog.llm.queries import tokenizer_model

from .test_jaccard import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, hits string, words int, gone int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(17)
    vocab = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = prose(30)
    texts = [prose(rng.randint(20, 120)) for _ in range(120)]
    texts += [t + " more" for t in texts[:20]] + texts[20:30]
    texts += [" ".join([w.upper() + "!!"] * 30) for w in vocab[:40]]
    texts += [f"{prose(10)} {item} {prose(10)}", f"{prose(20)} a.b@c.example.org {prose(5)} +1 (743) 555-3824", "", None, prose(20_000)]
    rng.shuffle(texts)
    rows = [(i * 2, t, None, "s", None, 1, "h", 3, 4) for i, t in enumerate(texts)]
    rows += [(None, "no id here " + prose(20), None, None, 1, None, None, None, None), (0, texts[0], "x", "y", 1, 2, "h", 3, 4)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 0 if r[1] and r[1].endswith("!!") else 1, 0) for r in rows if r[0] is not None] + [(None, 1, 0), (4, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item, "x"), (2, None, "x")], "item_id long, text string, hits string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, item


def test_all_stages(spark, corpus):
    d, rows, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: (str(r.doc_id), r.text or "")

    kept = P.classify_quality(spark, docs, d).collect()
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    ok = model.score(quality.statistics(pa.array([r[1] for r in rows]))) >= 0.5
    assert sorted(map(key, kept)) == sorted((str(r[0]), r[1] or "") for r, k in zip(rows, ok, strict=True) if k)
    assert not any(r.text.endswith("!!") for r in kept) and len(kept) > 120

    given = spark.createDataFrame(kept, COLUMNS)
    single = P.drop_near_copies(spark, given, d).collect()
    want = [r for r in brute([(r.doc_id, r.text) for r in kept], 5, 80) if r[0] is None or r[0] == r[2]]
    assert sorted(str(r.doc_id) for r in single) == sorted(str(r[0]) for r in want)
    assert len(single) < len(kept)

    clean = P.drop_contaminated(spark, spark.createDataFrame(single, COLUMNS), d).collect()
    assert sorted(map(key, clean)) == sorted(key(r) for r in single if item not in r.text) and len(clean) == len(single) - 1

    masked = P.mask_personal_data(spark, spark.createDataFrame(clean, COLUMNS), d).collect()
    crf = pii.fit(pii.labelled_table())
    spans = [[(a, b, pii.KINDS[k]) for k, a, b, _ in s] for s in pii.all_spans([r.text for r in clean], crf)]
    assert sorted(map(key, masked)) == sorted((str(r.doc_id), pii.redact(r.text, s)) for r, s in zip(clean, spans, strict=True))
    assert sum("<EMAIL>" in r.text and "<PHONE>" in r.text for r in masked) == 1 and all(r.n_chars == len(r.text) for r in masked)
    assert {tuple(r)[5:] for r in masked} <= {(1, "h", 3, 4), (None, None, None, None), (2, "h", 3, 4)}

    tokens = P.tokenize(spark, spark.createDataFrame(masked, COLUMNS), d).collect()
    sp = pieces.load(tokenizer_model())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in tokens) == sorted((str(r.doc_id), len(i := sp.encode(r.text)), i) for r in masked)

    whole = P.run(spark, d).collect()
    assert sorted((str(r.doc_id), r.ids) for r in whole) == sorted((str(r.doc_id), r.ids) for r in tokens)


def test_empty_documents(spark, corpus, tmp_path):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, d).collect() == []


def test_columns_are_kept(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, d).dtypes == docs.dtypes
    assert np.all([callable(f) for _, f in P.STAGES]) and P.ORACLE_SQL is None


def test_near_copies_are_told_by_row(spark, corpus):
    d, _, _ = corpus
    rng = random.Random(3)
    one, two = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one), (2, one + " more"), (2, two), (3, two + " more"), (4, None), (4, one.upper())]
    docs = spark.createDataFrame([(i, t, None, None, None, n, "h", 3, 4) for n, (i, t) in enumerate(rows)], COLUMNS)
    assert sorted(r.row for r in P.drop_near_copies(spark, docs, d).collect()) == [0, 2, 4]
