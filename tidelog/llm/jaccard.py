"""N-gram Jaccard join by T-occurrence search.

1. Hash every text to its set of distinct k-word shingles.  Equal sets share
   a 64-bit node, so exact copies are collapsed before anything is joined.
2. Post the smallest hashes of each set.  Two sets that are similar enough
   share at least ``floor_shared`` posted hashes, so a node that shares fewer
   with all others together has no partner and drops out, exactly.
3. Over the rest, order shingles by document frequency; two similar sets share
   one of their rarest.  The lists of these, cut where sizes are too far apart,
   chain nodes to blocks, and a block is dealt in order of size and rarest
   shingle into tiles of bounded size.
4. Search each tile: merge a set's short inverted lists, probe its long ones by
   binary search as in DivideSkip, and keep the partners with the required
   overlap.  Two tiles are searched against each other only if one list of
   step 3 spans both and their sizes are near enough.
5. Tiles return a spanning forest and link counts instead of all pairs;
   connected components finish the job.

Lists are made by sorting (shingle, node) rows in range partitions, not by
grouping, so a shingle of very many nodes is spread over tasks.  No list, group
or candidate set is capped.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkernel as tk
from tidelog.llm.common import bounded_batches, cut, marked, partitions, texts
from tidelog.llm.graph import components

#: Shingles of one tile of a block at most, but for a single larger set; two tiles meet in a task.
TILE_SHINGLES = 300_000
#: Join keys over which a component is spread.
SALTS = 16
#: The place of a shingle whose frequency is not known, after all others.
MOST = (1 << 62) - 1
#: Nodes whose postings a task remembers, so as not to repeat them.
SEEN_NODES = 500_000
#: DivideSkip's weight of the longest list's logarithm.
MU = 0.0085
#: Postings that a heap merges at most.
HEAP_POSTINGS = 1024


@dataclass(frozen=True)
class Rule:
    """Sets link when 100 * shared >= percent * union; k words a shingle."""

    k: int = 5
    percent: int = 80

    def least_shared(self, n: int) -> int:
        """Shared shingles that any partner of a set of n needs, and its least size."""
        return -(-self.percent * n // 100)

    def ell(self, n: int) -> int:
        """Common hashes looked for among the posted ones; grows with n."""
        return 1 + 3 * (n - self.least_shared(n)) // 5

    def posted(self, n: int) -> int:
        return min(n, n - self.least_shared(n) + self.ell(n))

    def sql_least(self, n: str) -> str:
        return f"(({self.percent} * {n} + 99) div 100)"

    def sql_floor_shared(self, n: str) -> str:
        """ell() of the smallest possible partner."""
        least = self.sql_least(n)
        return f"(1 + 3 * ({least} - {self.sql_least(least)}) div 5)"


def _base(rule: Rule):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, posts, known = [], [], [], []
            for s in tk.shingle_sets(batch.column("text"), rule.k):
                n = len(s)
                node = tk.set_id(s) if n else None
                sizes.append(n)
                nodes.append(node)
                again = node is None or node in seen
                known.append(again)
                posts.append(s[:0] if again else s[: rule.posted(n)].view(np.int64))
                if not again:
                    if len(seen) >= SEEN_NODES:
                        seen.clear()
                    seen.add(node)
            post = tk.ragged([p.view(np.int64) for p in posts])
            own = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), post], names=[*own, "n", "node", "post"])

    return run


def _shared_counts(batches):
    """Of rows sorted by (gram, node): how many grams each node shares.

    The first and the last gram of a partition count as shared, as their
    other rows may be next door; that only lets a node through.
    """
    gram = node = np.zeros(0, np.int64)
    counted, first = False, True

    def rows(nodes):
        names, times = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(times.astype(np.int64))], names=["node", "c"])

    for batch in batches:
        if not batch.num_rows:
            continue
        gram = np.concatenate([gram, batch.column(0).to_numpy()])
        node = np.concatenate([node, batch.column(1).to_numpy()])
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node = gram[fresh], node[fresh]
        start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        length = np.diff(np.r_[start, len(gram)])
        shared = np.repeat(length > 1, length)
        if first:
            shared[: length[0]] = True
            first = False
        out = shared.copy()
        if counted:
            out[0] = False
        if out.any():
            yield rows(node[out])
        counted = bool(shared[-1])
        gram, node = gram[-1:], node[-1:]
    if len(gram) and not counted:
        yield rows(node)


def _frequencies(batches):
    """Of rows sorted by (gram, node): (node, gram, df) of grams of several nodes.

    All rows of a gram that touches a border of its partition get the same
    last place in the order of frequencies: other partitions may have more of
    it.  Any order that all sets share is right, and such grams are few.
    """
    held: list[np.ndarray] = []

    def rows(gram, node, first, last):
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node = gram[fresh], node[fresh]
        start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        size = np.diff(np.r_[start, len(gram)])
        if first:
            size[0] = MOST
        if last:
            size[-1] = MOST
        df = np.repeat(size, np.diff(np.r_[start, len(gram)]))
        keep = df > 1
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(gram[keep]), pa.array(df[keep])], names=["node", "gram", "df"])

    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).to_numpy()
        held.append(np.stack([gram, batch.column(1).to_numpy()]))
        if held[0][0, 0] == gram[-1]:
            continue  # one gram so far
        gram, node = np.concatenate(held, axis=1)
        cut_at = int(np.searchsorted(gram, gram[-1]))
        yield rows(gram[:cut_at], node[:cut_at], first, False)
        held, first = [np.stack([gram[cut_at:], node[cut_at:]])], False
    if held:
        gram, node = np.concatenate(held, axis=1)
        yield rows(gram, node, first, True)


def _chains(rule: Rule):
    """Of rows sorted by (gram, n, node): edges that chain each list's nodes.

    Neighbours whose sizes are too far apart are not chained, as nobody on
    either side can be similar.  A gram is a vertex of its own where a border
    of the partition may have cut its list.
    """

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, n, node = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                gram, n, node = np.r_[last[0], gram], np.r_[last[1], n], np.r_[last[2], node]
            else:
                yield _pairs(node[:1], _vertex(gram[:1]))
            near = (gram[1:] == gram[:-1]) & (node[1:] != node[:-1])
            near &= rule.percent * n[1:] <= 100 * n[:-1]
            yield _pairs(node[:-1][near], node[1:][near])
            last = gram[-1], n[-1], node[-1]
        if last is not None:
            yield _pairs(np.array([last[2]]), _vertex(np.array([last[0]])))

    return run


def _vertex(gram: np.ndarray) -> np.ndarray:
    return tk.mix(gram.view(np.uint64) ^ tk.LANES[61]).view(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _sets(rule: Rule):
    def run(batches):
        for batch in batches:
            keep, arrays = [], []
            want = batch.column("node").to_pylist()
            for i, s in enumerate(tk.shingle_sets(batch.column("text"), rule.k)):
                if len(s) and tk.set_id(s) == want[i]:
                    keep.append(i)
                    arrays.append(s.view(np.int64))
            rest = batch.select(["node", "n", "copies"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, tk.ragged(arrays)], names=["node", "n", "copies", "grams"])

    return run


def merge_lists(lists: list[np.ndarray], d: int) -> np.ndarray:
    """How often each of d documents occurs in some sorted lists.

    A heap merges the lists while they are short together; beyond, an array
    of counters gives the same counts in less time.
    """
    if sum(map(len, lists)) > HEAP_POSTINGS:
        return np.bincount(np.concatenate(lists), minlength=d)
    hits = np.zeros(d, np.int64)
    for doc, run in groupby(heapq.merge(*[x.tolist() for x in lists])):
        hits[doc] = sum(1 for _ in run)
    return hits


def divide_skip(sets: list[np.ndarray], rule: Rule, side: np.ndarray | None = None):
    """Partners of each set among those before it in (size, position) order.

    Yields (x, partners) as positions in ``sets``.  With ``side``, partners
    are only looked for on the other side.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    n, d = size[order], len(sets)
    doc = np.repeat(np.arange(d), n)
    flat = np.concatenate([sets[i] for i in order]) if d else np.zeros(0, np.int64)
    _, token = np.unique(flat, return_inverse=True)
    keys = np.sort(token * d + doc)  # the inverted lists, one after another
    post = keys % max(d, 1)
    at = np.r_[0, np.cumsum(n)]
    sides = side[order] if side is not None else None
    for x in range(d):
        own = token[at[x] : at[x + 1]]
        t = rule.least_shared(int(n[x]))
        lo = int(np.searchsorted(n, t))
        if lo >= x or not t:
            continue
        # Only the sets in [lo, x) are asked for: a window of each list.
        a, b = np.searchsorted(keys, own * d + lo), np.searchsorted(keys, own * d + x)
        own, a, b = own[b > a], a[b > a], b[b > a]
        if len(own) < t:
            continue
        by = np.argsort(b - a, kind="stable")
        own, a, b = own[by], a[by], b[by]
        aside = min(t - 1, int(t / (MU * np.log2(max(2, b[-1] - a[-1])) + 1)))
        cut_at = len(own) - aside
        long = own[cut_at:]
        hits = merge_lists([post[i:j] for i, j in zip(a[:cut_at], b[:cut_at], strict=True)], d)
        c = lo + np.flatnonzero(hits[lo:x] >= t - aside)
        if sides is not None:
            c = c[sides[c] != sides[x]]
        if not len(c):
            continue
        if len(c) * len(long) > 4 * int((b - a)[cut_at:].sum()):  # merging the long lists is cheaper than probing them
            hits = hits + merge_lists([post[i:j] for i, j in zip(a[cut_at:], b[cut_at:], strict=True)], d)
        else:
            for i in range(0, len(c), step := max(1, (1 << 18) // max(1, len(long)))):
                want = (long[:, None] * d + c[None, i : i + step]).ravel()
                found = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                hits[c[i : i + step]] += found.reshape(len(long), -1).sum(axis=0)
        c = c[100 * hits[c] >= rule.percent * (n[x] + n[c] - hits[c])]
        if len(c):
            yield int(order[x]), order[c]


def _linked(rule: Rule, node: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None):
    """(position of the component's first node, links) of every node of some sets."""
    low, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    for x, ys in divide_skip(sets, rule, side):
        links[x] += copies[ys].sum()
        links[ys] += copies[x]
        roots = np.unique(low[np.r_[ys, x]])
        if len(roots) > 1:
            low[np.isin(low, roots)] = roots[0]
    return low, links


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


TILED = "node bigint, tile bigint, least bigint, most bigint, root bigint, links bigint"


def _tiles(rule: Rule, most: int):
    """Deal sorted rows (part, block, node, n, copies, grams) into tiles of ``most`` shingles, and search each in itself."""

    def searched(held: list[tuple], tile: int):
        n = [h[1] for h in held]
        node, copies = np.array([h[0] for h in held]), np.array([h[2] for h in held])
        low, links = _linked(rule, node, copies, [h[3] for h in held])
        same = [[x] * len(held) for x in (tile, min(n), max(n))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, *same, node[low], links)], names=[x.split()[0] for x in TILED.split(", ")])

    def run(batches):
        held: list[tuple] = []
        block = before = None
        size = tile = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = tile or batch.column(0)[0].as_py() << 32
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), _lists(batch.column(5)), strict=True):
                if row[0] == before:
                    continue  # a row that repeats id and text
                if held and (b != block or size + row[1] > most):
                    yield searched(held, tile)
                    held, size, tile = [], 0, tile + 1
                block, before = b, row[0]
                held.append(row)
                size += row[1]
        if held:
            yield searched(held, tile)

    return run


def _search(rule: Rule):
    def run(key, table):
        table = table.take(pa.array(np.sort(np.unique(table.column("node").to_numpy(), return_index=True)[1])))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        low, links = _linked(rule, node, copies, _lists(table.column("grams").combine_chunks()), table.column("tile").to_numpy())
        has = links > 0
        return pa.table({"node": node[has], "root": node[low[has]], "links": links[has]})

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    With ``hashed`` also text_hash, the xxhash64 of the text (of "" for null),
    which tells rows apart that share an id.

    ``component_id`` is the smallest doc_id that links reach, ``n_links`` the
    number of other documents (copies included) linked directly.  A null or
    empty text has no shingles and links with nothing.  A row with a null id
    is returned with null component and no links.  Rows that repeat an id are
    returned once each; they count as separate copies.  Further columns of
    the input are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rule = Rule(k, percent)
    docs = texts(docs, id_col, text_col)
    given = docs.withColumn("text_hash", F.xxhash64("text")) if hashed else docs
    names = ", ".join(f"{c} bigint" for c in given.columns if c != "text")
    base = cut(given.mapInArrow(_base(rule), f"{names}, n bigint, node bigint, post array<bigint>"))
    nodes = base.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
    postings = base.where("size(post) > 0 and doc_id is not null").select(F.explode("post").alias("gram"), "node")
    counts = postings.repartitionByRange("gram", "node").sortWithinPartitions("gram", "node").mapInArrow(_shared_counts, "node bigint, c bigint").groupBy("node").agg(F.sum("c").alias("c"))
    rest = nodes.join(counts, "node").where(f"c >= {rule.sql_floor_shared('n')}").select("node", "n", "copies", "rep")
    # While few texts are wanted, a bitmap spares the others the shuffle.
    sets = marked(docs.withColumnRenamed("doc_id", "rep"), rest, "rep").where("marked").join(rest, "rep").select("node", "n", "copies", "text")
    # Rows that repeat both id and text repeat a node here; what follows takes each node once.
    sets = cut(sets.mapInArrow(_sets(rule), "node bigint, n bigint, copies bigint, grams array<bigint>"))

    post = sets.select(F.explode("grams").alias("gram"), "node").repartitionByRange("gram", "node").sortWithinPartitions("gram", "node")
    common = post.mapInArrow(_frequencies, "node bigint, gram bigint, df bigint").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("common"))
    # A set's rarest shingles: those that no other set has come first, and so many that the rest is too small for a partner.
    want = F.expr(f"n - {rule.sql_least('n')} + 1 - (n - size(common))").cast("int")
    rare = common.join(sets.select("node", "n").distinct(), "node").withColumn("want", want).where("want > 0")
    lists = cut(rare.select("node", "n", F.expr("slice(common, 1, want).gram").alias("grams")))
    listed = lists.select(F.explode("grams").alias("gram"), "n", "node")
    near = listed.repartitionByRange("gram", "n", "node").sortWithinPartitions("gram", "n", "node").mapInArrow(_chains(rule), "a bigint, b bigint")
    blocks = components(near).withColumnRenamed("root", "block")

    level = F.floor(F.log(100 / rule.percent, F.col("n"))) if percent < 100 else F.col("n")
    placed = lists.select("node", F.col("grams")[0].alias("rarest"), level.alias("level")).join(blocks, "node")
    order = ["block", "level", "rarest", "node"]
    members = sets.join(placed, "node").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    tiled = cut(members.select(F.spark_partition_id().cast("bigint").alias("part"), "block", "node", "n", "copies", "grams").mapInArrow(_tiles(rule, TILE_SHINGLES), TILED))

    # Tiles that a list spans, each set of tiles once; those of one size or nearly so meet.
    tile = tiled.select("node", F.struct("tile", "least", "most").alias("t"))
    spans = lists.join(tile, "node").select(F.explode("grams").alias("gram"), "t").groupBy("gram").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    pairs = spans.where("size(ts) > 1").select("ts").distinct().select(F.posexplode("ts").alias("at", "x"), "ts")
    pairs = pairs.select("x", F.explode(F.expr("slice(ts, at + 2, size(ts))")).alias("y")).distinct()
    pairs = pairs.where(f"{rule.percent} * x.least <= 100 * y.most and {rule.percent} * y.least <= 100 * x.most")
    cells = pairs.select(F.expr("struct(x.tile as i, y.tile as j)").alias("cell"), F.explode(F.expr("array(x.tile, y.tile)")).alias("tile"))
    cells = cells.join(tiled.select("node", "tile"), "tile").join(sets.select("node", "copies", "grams"), "node")
    crossed = cut(cells.repartition(partitions(spark), "cell").groupBy("cell").applyInArrow(_search(rule), "node bigint, root bigint, links bigint"))
    found = tiled.select("node", "root", "links").where("links > 0").unionByName(crossed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # A component can hold a large part of all nodes: its smallest id is found by partial aggregation and spread over salts to be joined back.
    linked = nodes.join(roots, "node").select("node", "rep", "root", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    named = linked.join(least, ["root", "salt"]).select("node", "component_id")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    classes = nodes.join(named, "node", "left").join(links, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), n_links)
    own = F.col("doc_id").isNotNull()
    return base.join(classes, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"),
        *["text_hash"] * hashed,
    )
