"""SentencePiece encoding and decoding through a distinct-chunk table.

In a model none of whose pieces holds a whitespace marker after another
character, no merge can cross from a word into the next marker.  A text then
falls into chunks - a run of markers with the word after it - that can be
segmented one by one.  Every batch builds the table of its distinct chunks,
looks most of them up in the table that the task carries along, has the
library segment the rest once each, and joins the ids back by position.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import bounded_batches, texts

MARK = "▁"
#: Chunks that a task carries from batch to batch, and the longest of them.
TABLE_CHUNKS, TABLE_CHARS = 300_000, 48
#: Characters of a text, and ids, that are worked on at a time.
PART_CHARS, PART_IDS = 1 << 20, 1 << 18
_spaced = re.compile(" +[^ ]*")
_word_end = re.compile("[^ ] ")


def load(model: str):
    """The processor for a model file; ValueError if chunks are not independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces) or sp.encode("a  b") != [*sp.encode("a"), *sp.encode(" b")]:
        raise ValueError("pieces of this model can cross whitespace markers")
    return sp


def parts(text: str):
    """Bounded parts whose chunks, in order, are the text's; none of an empty text.

    A part leaves out the first marker of its first chunk.
    """
    if not text:
        return
    text = text.replace(MARK, " ")
    at = 0
    while len(text) - at > PART_CHARS and (m := _word_end.search(text, at + PART_CHARS)):
        yield text[at : m.start() + 1]
        at = m.end()
    yield text[at:] if at else text


def chunks(text: str) -> list[str]:
    """The chunks of a part, each without the first of its markers."""
    words = text.split(" ")
    return [c[1:] for c in _spaced.findall(" " + text)] if "" in words else words


class ChunkTable:
    """Distinct chunks and where their ids lie in one flat array."""

    def __init__(self, model: str):
        self.sp = load(model)
        self.bare = self.sp.piece_to_id(MARK)
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def encode(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the lists of chunks, and the offsets of each list."""
        new = [c for c in set(chain.from_iterable(lists)) if c not in self.row]
        for c, ids in zip(new, self.sp.encode(new) if new else [], strict=True):
            self.row[c] = len(self.ends) - 1
            self.ids.extend(ids if c else [self.bare])
            self.ends.append(len(self.ids))
        flat, ends = np.array(self.ids, dtype=np.int32), np.array(self.ends)
        n = np.array([len(x) for x in lists], dtype=np.int64)
        row = np.fromiter(map(self.row.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(n.sum()))
        length = ends[row + 1] - ends[row]
        at = np.r_[0, np.cumsum(length)]
        out = flat[np.repeat(ends[row] - at[:-1], length) + np.arange(at[-1])]
        if len(self.row) > TABLE_CHUNKS or len(self.ids) > 8 * TABLE_CHUNKS:
            self.clear()
        elif any(len(c) > TABLE_CHARS for c in new):
            for c in new:  # a long chunk is unlikely to come again
                if len(c) > TABLE_CHARS:
                    del self.row[c]
        return out, at[np.r_[0, np.cumsum(n)]]


def _encode(model: str):
    def run(batches):
        table = ChunkTable(model)
        for batch in batches:
            lists, owner, held, ids, sizes = [], [], 0, [], np.zeros(batch.num_rows, np.int64)

            def flush():
                if lists:
                    out, at = table.encode(lists)
                    ids.append(out)
                    np.add.at(sizes, owner, np.diff(at))
                    lists.clear()
                    owner.clear()

            for i, text in enumerate(batch.column("text")):
                for part in parts(text.as_py() or ""):
                    lists.append(chunks(part))
                    owner.append(i)
                    held += len(part)
                    if held > PART_CHARS:
                        flush()
                        held = 0
            flush()
            at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _decode(model: str):
    def run(batches):
        sp = load(model)
        opens = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(sp.get_piece_size())])

        def whole(ids: np.ndarray) -> str:
            out, a = [], 0
            while len(ids) - a > PART_IDS and len(cuts := np.flatnonzero(opens[ids[a + PART_IDS :]])):
                b = a + PART_IDS + int(cuts[0])
                out.append(sp.decode(ids[a:b].tolist()))
                a = b
            out.append(sp.decode(ids[a:].tolist()))
            return " ".join(out)  # decode() drops the first marker of each part

        for batch in batches:
            lists = batch.column("ids")
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            said = [whole(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(said, pa.string())], names=["doc_id", "ids", "text"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as the library encodes it.

    No begin or end ids.  A null or empty text has no ids.  Repeated rows and
    null ids of documents are kept; other columns of the input are ignored.
    ``model`` is a path that every executor can read.
    """
    bounded_batches(docs.sparkSession)
    load(model)
    return texts(docs, id_col, text_col).mapInArrow(_encode(model), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text): the library's decode(ids) of every row; null ids are empty."""
    bounded_batches(encoded.sparkSession)
    rows = encoded.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"coalesce(cast(`{ids_col}` as array<int>), array()) ids")
    return rows.mapInArrow(_decode(model), "doc_id bigint, ids array<int>, text string")
