"""SentencePiece against the library's own encode and decode."""

import random

import pytest

from tidelog.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "  ", "a ", " a", "▁", "▁▁a", "a▁b", "\n", "a\n b", "\x00x", "<s>hi</s>", "ﬁ①é", " x", "﻿x", "日本語 テスト", "a  b   c ", "x" * 500, "😀 😀", " \n ", "a\tb"]


def texts(seed, n=150):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", " ", "  ", "▁", "\n", "é", "ß", "1", "23", ".", ",", "日", "😀", "​", "Ding", "tion"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_round_trip_equals_library(spark):
    sp = pieces.load(MODEL)
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame([*[(i, t, "x") for i, t in rows], (None, "no id", "x"), (-1, None, "x"), (-1, None, "x")], "doc_id long, text string, ids string").repartition(3)
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    want = sorted([(i, sp.encode(t), sp.decode(sp.encode(t))) for i, t in rows] + [(-1, [], "")] * 2 + [(None, sp.encode("no id"), "no id")], key=str)
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == want


def test_parts_and_table_limits(monkeypatch):
    monkeypatch.setattr(pieces, "PART_CHARS", 7)
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 20)
    monkeypatch.setattr(pieces, "TABLE_CHARS", 3)
    table = pieces.ChunkTable(MODEL)
    for text in texts(2):
        out, at = table.encode([pieces.chunks(p) for p in pieces.parts(text)])
        assert out.tolist() == table.sp.encode(text) and at[-1] == len(out)


def test_decode_in_parts(spark, monkeypatch):
    sp = pieces.load(MODEL)
    monkeypatch.setattr(pieces, "PART_IDS", 3)
    rows = [(i, sp.encode(t)) for i, t in enumerate(texts(3, 60))]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])
    (out,) = pieces._decode(MODEL)([batch])
    assert out.column("text").to_pylist() == [sp.decode(ids) for _, ids in rows]


def test_empty_table_and_null_ids(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
    assert [tuple(r) for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()] == [(1, [], "")]
