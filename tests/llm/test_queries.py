"""The registered corpus queries against SQL, or against their own operators' brute force."""

import hashlib
import os

import oracle
import pyarrow.parquet as pq
import pytest

from tidelog.llm import pieces, queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.rows(queries.queries()[name](spark, oracle.SF)) == oracle.expected(con, queries.oracle_sql()[name])


def test_tokens_equal_the_library(spark):
    sp = pieces.load(queries.tokenizer_model())
    docs = pq.read_table(f"{oracle.SF}/documents.parquet").to_pydict()
    want = []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = sp.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op2_sentencepiece(spark, oracle.SF).collect())) == sorted(want)


def test_personal_data_digests(spark):
    from tidelog.llm import pii

    from .test_pii import plain_base

    docs = pq.read_table(f"{oracle.SF}/documents.parquet").to_pydict()
    want = {}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        base = plain_base(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        want[d] = (*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), set(filter(None, joined.split(","))))
    for r in queries.op4_pii(spark, oracle.SF).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id][:5]
        assert want[r.doc_id][5] <= set(filter(None, r.spans.split(",")))


def test_held_out_accuracy(spark):
    docs = queries.op7_quality(spark, oracle.SF.replace("sf0.001", "sf0.01")).where("held_out").select("doc_id", "predicted")
    labels = spark.read.parquet(f"{oracle.SF.replace('sf0.001', 'sf0.01')}/labels.parquet")
    assert docs.join(labels, "doc_id").selectExpr("avg(cast(predicted = quality as int))").first()[0] > 0.95


def test_benchmark_passages_are_found(spark):
    bench = [t for t in pq.read_table(f"{oracle.SF}/benchmark.parquet").column("text").to_pylist()]
    docs = pq.read_table(f"{oracle.SF}/documents.parquet").to_pydict()
    exact = {d for d, t in zip(docs["doc_id"], docs["text"], strict=True) if any(b in (t or "") for b in bench)}
    got = {r.doc_id for r in queries.op8_decontaminate(spark, oracle.SF).where("contaminated").collect()}
    assert exact <= got and len(got) <= len(exact) + 3


def test_license_lines_are_found(spark):
    docs = pq.read_table(f"{oracle.SF}/documents.parquet").to_pydict()
    lines = ("Released under the MIT License", "Licensed under the Apache License, Version 2.0", "GNU General Public License, version 3", "Licensed under CC BY-NC 4.0")
    want = {d for d, t in zip(docs["doc_id"], docs["text"], strict=True) if any(x in (t or "") for x in lines)}
    assert {r.doc_id for r in queries.op5_license_scan(spark, oracle.SF).where("n_matches > 0").collect()} == want
