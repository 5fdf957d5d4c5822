"""Benchmark decontamination by spaced-seed hashing.

A seed hashes the words of a window at the positions that a fixed mask keeps,
so words at the ignored positions may differ.  The masks together miss nothing
that the rule admits.  Seeds of the training texts meet those of the test items
in a hash join inside each task, behind a small bitmap; of hits that follow each
other on a diagonal only the first is made, so repeated words cost no more than
others.  The words of every diagonal that is hit are counted, and on those with
enough equal ones the longest gapless stretch of the item that is mostly equal
must be long enough.  Texts are worked on in groups of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkernel as tk
from tidelog.llm.common import bounded_batches, ddl, texts

#: One of these fits between the replaced words of every stretch of ten words
#: with two replaced, 12 with three, 16 with four and 20 with five (tried one by
#: one in the tests).  Every stretch of 12 words or more with a quarter replaced
#: holds such a stretch: one half of it does from 24 words on.
MASKS = ("1101011", "1100010011", "11111", "1011001001")
#: A stretch must have so many words (or the whole of a shorter item) ...
LEAST_WORDS = 12
#: ... of which at least this percentage is equal.
LEAST_EQUAL = 75
#: Items with fewer words than this need all their words equal ...
EDITED_ITEM = 10
#: ... and with fewer than this are no evidence, unless the caller says otherwise.
SHORTEST_ITEM = 5
#: Words of the texts, seed hits, and words of their diagonals that are worked on at once.
TEXT_WORDS, HITS_AT_ONCE, WORDS_AT_ONCE = 1 << 17, 1 << 18, 1 << 20
#: Words of the items that are broadcast at once.
BLOCK_WORDS = 250_000
BITMAP_BITS = 23


@dataclass
class Items:
    """Word hashes of some items and the index of their seeds.

    Postings are sorted by (seed, the seed one word before), so that those
    which only follow another hit on the same diagonal are one range.
    """

    ids: list[int]
    words: list[np.ndarray]
    shortest: int = SHORTEST_ITEM

    def __post_init__(self):
        seeds, item, place, before = [], [], [], []
        for i, w in enumerate(self.words):
            if len(w) >= max(1, self.shortest):
                for s in [masked(w, m) for m in range(len(MASKS))] if len(w) >= EDITED_ITEM else [short_seeds(w, len(w))]:
                    seeds.append(s)
                    item.append(np.full(len(s), i))
                    place.append(np.arange(len(s)))
                    before.append(np.r_[np.zeros(min(1, len(s)), np.uint64), s[:-1]])
        self.lengths = sorted({len(w) for w in self.words if max(1, self.shortest) <= len(w) < EDITED_ITEM})
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([np.zeros(0, np.uint64), *self.words])
        self.seeds = np.concatenate([np.zeros(0, np.uint64), *seeds])
        before = np.concatenate([np.zeros(0, np.uint64), *before])
        order = np.lexsort((before, self.seeds))
        self.seeds, before = self.seeds[order], before[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *item])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order]
        both = tk.mix(self.seeds + tk.LANES[50] * before)
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        end = np.r_[start[1:], len(both)][: len(start)]
        by = np.argsort(both[start], kind="stable")
        self.pair, self.pair_start, self.pair_end = both[start][by], start[by], end[by]
        self._mark()

    def _mark(self):
        self.bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bitmap[self.seeds >> np.uint64(64 - BITMAP_BITS)] = True

    def __getstate__(self):
        """Without the bitmap, which every task makes anew from the seeds."""
        return {k: v for k, v in self.__dict__.items() if k != "bitmap"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._mark()

    def hits(self, seeds: np.ndarray):
        """(position in seeds, item, place in the item) of equal seeds, in blocks.

        Left out are hits that the position before has on the same diagonal;
        a seed of zero stands for a window that reaches into another text.
        """
        at = np.flatnonzero(self.bitmap[seeds >> np.uint64(64 - BITMAP_BITS)])
        lo, hi = np.searchsorted(self.seeds, seeds[at], "left"), np.searchsorted(self.seeds, seeds[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(at):
            return
        before = np.where(at > 0, seeds[at - 1], np.uint64(0))
        both = tk.mix(seeds[at] + tk.LANES[50] * before)
        p = np.minimum(np.searchsorted(self.pair, both), len(self.pair) - 1)
        follows = (self.pair[p] == both) & (before != 0)
        a, b = np.where(follows, self.pair_start[p], hi), np.where(follows, self.pair_end[p], hi)
        at, lo, n = np.r_[at, at], np.r_[lo, b], np.r_[a - lo, hi - b]
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        for x, y in blocks(n, HITS_AT_ONCE):
            pick = ragged_range(lo[x:y], n[x:y])
            yield np.repeat(at[x:y], n[x:y]), self.item[pick], self.place[pick]


def masked(h: np.ndarray, m: int) -> np.ndarray:
    """Seeds of one mask at every window of the words."""
    n = len(h) - len(MASKS[m]) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tk.LANES[32 + m])
    for j, kept in enumerate(MASKS[m]):
        if kept == "1":
            out += h[j : j + n] * tk.LANES[j]
    return tk.mix(out)


def short_seeds(h: np.ndarray, k: int) -> np.ndarray:
    """Seeds of all words of every window of k words."""
    return tk.mix(tk.grams(h, k) + tk.LANES[40 + k]) if len(h) >= k else np.zeros(0, np.uint64)


def blocks(sizes: np.ndarray, most: int):
    """Bounds of runs of sizes that hold ``most`` together, or a single larger one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def ragged_range(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """The longest stretch of which LEAST_EQUAL percent are equal: (equal words, start, end).

    No other such stretch has more equal words, as all can be extended until
    the percentage is used up.
    """
    gain = np.r_[0, np.cumsum(np.where(equal, 100, 0) - LEAST_EQUAL)]
    first = np.searchsorted(-np.minimum.accumulate(gain), -gain)  # the earliest start for every end
    b = int(np.argmax(np.arange(len(gain)) - first))
    a = int(first[b])
    return int(equal[a:b].sum()), a, b


def verified(text: np.ndarray, item: np.ndarray, start: int) -> int:
    """Equal words of the item laid on the text from ``start``; 0 if too few."""
    lo, hi = max(0, -start), min(len(item), len(text) - start)
    if hi <= lo:
        return 0
    equal = text[start + lo : start + hi] == item[lo:hi]
    if len(item) < EDITED_ITEM:
        return len(item) if hi - lo == len(item) and equal.all() else 0
    n, a, b = stretch(equal)
    return n if b - a >= min(LEAST_WORDS, len(item)) else 0


def _word_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, _, first = tk.words(*tk.buffers(column), tk.NOT_ALNUM)
    return h, first


def _equal_words(items: Items, h: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Equal words of every whole diagonal; no stretch of it can have more."""
    lo, hi = np.maximum(0, -start), np.minimum(items.sizes[item], first[doc + 1] - first[doc] - start)
    n = hi - lo
    enough = np.zeros(len(doc), np.int64)
    for a, b in blocks(n, WORDS_AT_ONCE):
        text = ragged_range((first[doc] + start + lo)[a:b], n[a:b])
        equal = h[text] == items.flat[ragged_range((items.first[item] + lo)[a:b], n[a:b])]
        enough[a:b] = np.add.reduceat(equal.astype(np.int64), np.cumsum(n[a:b]) - n[a:b])
    return enough


def contained(items: Items, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], int]:
    """Of (text, item): the most equal words of the item on a diagonal that fits the rule.

    ``h`` has the word hashes of all texts, those of text d from ``first[d]``
    to before ``first[d + 1]``.
    """
    best: dict[tuple[int, int], int] = {}
    most_words = int(items.sizes.max(initial=0))
    span = int(np.diff(first).max(initial=0)) + most_words + 1
    inner = np.zeros(len(h), dtype=bool)
    for m, k in [*enumerate(map(len, MASKS)), *((None, k) for k in items.lengths)]:
        seeds = short_seeds(h, k) if m is None else masked(h, m)
        if not len(seeds):
            continue
        inner[:] = True  # windows that lie within one text
        for j in range(1, k):
            inner[np.maximum(first[1:] - j, 0)] = False
        for at, item, place in items.hits(np.where(inner[: len(seeds)], seeds, np.uint64(0))):
            doc = np.searchsorted(first, at, "right") - 1
            start = at - first[doc] - place
            key = np.unique((doc * len(items.ids) + item) * span + start + most_words)
            pair, start = key // span, key % span - most_words
            doc, item = pair // len(items.ids), pair % len(items.ids)
            enough = _equal_words(items, h, first, doc, item, start)
            likely = 100 * enough >= LEAST_EQUAL * np.minimum(LEAST_WORDS, items.sizes[item])
            doc, item, start, enough = doc[likely], item[likely], start[likely], enough[likely]
            order = np.argsort(-enough, kind="stable")
            for d, i, s, n in zip(doc[order].tolist(), item[order].tolist(), start[order].tolist(), enough[order].tolist(), strict=True):
                if n > best.get((d, i), 0) and (n := verified(h[first[d] : first[d + 1]], items.words[i], s)):
                    best[d, i] = max(n, best.get((d, i), 0))
    return best


def _scan(sent: list):
    def run(batches):
        blocks_of_items = [x.value for x in sent]
        for batch in batches:
            h, first = _word_lists(batch.column("text"))
            found: dict[int, list[tuple[int, int]]] = {}
            for a, b in blocks(np.diff(first), TEXT_WORDS):
                for items in blocks_of_items:
                    for (d, i), n in contained(items, h[first[a] : first[b]], first[a : b + 1] - first[a]).items():
                        found.setdefault(a + d, []).append((items.ids[i], n))
            rows = [[{"item_id": i, "words": n} for i, n in sorted(found.get(d, ()))] for d in range(batch.num_rows)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "hits"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False, shortest: int = SHORTEST_ITEM) -> DataFrame:
    """(doc_id, text, hits), with ``carry`` also the other columns as ``row``: for every row the items it contains.

    ``hits`` lists (item_id, equal words) by item_id.  Words are runs of
    ASCII letters and digits and of all other non-ASCII characters, A-Z
    lower-cased.  Null and empty texts, and items of fewer than ``shortest``
    words, match nothing (with ``shortest=1`` every item that has a word
    counts; items of fewer than EDITED_ITEM words must be wholly equal).
    Items with a null id are ignored; repeated rows stay, repeated items are
    listed as often.  The items are broadcast in blocks of bounded size, and
    each text is searched for all of them in turn.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = texts(benchmark, item_col, item_text_col).where("doc_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (8 * BLOCK_WORDS)))
    sent = []
    for b in range(parts):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == b).orderBy("doc_id", "text").toArrow()
        h, first = _word_lists(part.column("text"))
        sent.append(spark.sparkContext.broadcast(Items(part.column("doc_id").to_pylist(), [h[a:z] for a, z in zip(first[:-1], first[1:], strict=True)], shortest)))
    out = texts(docs, id_col, text_col, carry)
    found = out.mapInArrow(_scan(sent), f"{ddl(out, *out.columns)}, hits array<struct<item_id:bigint,words:int>>")
    return found.select("doc_id", "text", *["row"] * carry, "hits")
