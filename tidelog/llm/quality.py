"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow boosted trees are grown on the statistics of a bounded sample of
labelled texts, every path of a tree becomes a conjunctive rule, an L1
penalised logistic regression keeps few of the rules, and those are compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import textkernel as tk
from tidelog.llm.common import bounded_batches, ddl, texts

#: Labelled rows that a fit uses at most; they are chosen by a hash of the id.
SAMPLE_ROWS = 20_000
STATS = (
    "chars", "words", "word_len", "upper", "digit", "stop", "comma", "bang", "symbol", "wide",
    "distinct", "top", "echo", "pairs", "lines", "line_len", "same_lines", "blank",
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True


def _ratio(a: float, b: float) -> float:
    return float(a) / float(b) if b else 0.0


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text; an empty text has zeros only."""
    data, at = tk.buffers(column)
    h, _, first = tk.words(data, at)
    out = np.zeros((len(at) - 1, len(STATS)))
    for i in range(len(out)):
        raw = data[at[i] : at[i + 1]]
        if not len(raw):
            continue
        own = h[first[i] : first[i + 1]]
        n = len(own)
        seen = np.bincount(raw, minlength=256)
        chars = int(len(raw) - seen[0x80:0xC0].sum())
        ink = chars - int(seen[tk.BLANK].sum())
        times = np.unique(own, return_counts=True)[1]
        pairs = own[:-1] * tk.LANES[0] + own[1:] * tk.LANES[1]
        lines = raw.tobytes().split(b"\n")
        out[i] = (
            chars, n, _ratio(ink, n), _ratio(seen[65:91].sum(), ink), _ratio(seen[48:58].sum(), ink), _ratio(seen[46], n), _ratio(seen[44], n), _ratio(seen[33], n),
            _ratio(seen[_SYMBOL].sum(), ink), _ratio(seen[0xC0:].sum(), ink), _ratio(len(times), n), _ratio(times.max(initial=0), n), _ratio((own[1:] == own[:-1]).sum(), n),
            _ratio(len(np.unique(pairs)), len(pairs)), len(lines), _ratio(n, len(lines)), 1 - _ratio(len(set(lines)), len(lines)), _ratio(chars - ink, chars),
        )
    return out


def _stats_batches(batches):
    for batch in batches:
        rows = statistics(batch.column("text"))
        kept = [c for c in batch.schema.names if c in ("doc_id", "row") or (c == "text" and "row" in batch.schema.names)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(rows[:, j]) for j in range(len(STATS)))], names=[*kept, *STATS])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, one double per entry of STATS) for every row, with ``carry``
    also the text and the other columns as ``row``."""
    bounded_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col, carry)
    kept = ["doc_id", "text", "row"] if carry else ["doc_id"]
    return rows.mapInArrow(_stats_batches, f"{ddl(rows, *kept)}, " + ", ".join(f"`{s}` double" for s in STATS))


@dataclass
class Rules:
    """bias + sum of the weights of the rules that hold, through a sigmoid.

    A rule is a tuple of (statistic, is_above, threshold) conditions.
    """

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps([self.bias, self.rules])

    @classmethod
    def from_json(cls, text: str) -> Rules:
        bias, rules = json.loads(text)
        return cls(bias, [(tuple((j, above, limit) for j, above, limit in path), w) for path, w in rules])

    def score(self, stats: np.ndarray) -> np.ndarray:
        z = np.full(len(stats), self.bias)
        for conditions, w in self.rules:
            z += w * _holds(conditions, stats)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score as a Spark expression over the columns of STATS."""
        z = F.lit(self.bias)
        for conditions, w in self.rules:
            test = F.lit(True)
            for j, above, limit in conditions:
                c = F.col(STATS[j])
                test = test & ((c > limit) if above else (c <= limit))
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _holds(conditions, stats: np.ndarray) -> np.ndarray:
    ok = np.ones(len(stats), dtype=bool)
    for j, above, limit in conditions:
        ok &= (stats[:, j] > limit) if above else (stats[:, j] <= limit)
    return ok


def _grow(bins, cuts, gradient, weight, rows, depth, features, path, found, out):
    """One regression tree; appends every path and adds its leaf values to out."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-3, None, None)
    if depth and len(rows) >= 20:
        for j in features:
            k = len(cuts[j])
            if not k:
                continue
            gs = np.cumsum(np.bincount(bins[rows, j], gradient[rows], k + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], weight[rows], k + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], j, i)
    _, j, i = best
    if j is None:
        out[rows] += 0.3 * g / (h + 1)
        return
    low = bins[rows, j] <= i
    for above, part in ((False, rows[low]), (True, rows[~low])):
        own = (*path, (int(j), above, float(cuts[j][i])))
        found.append(own)
        _grow(bins, cuts, gradient, weight, part, depth - 1, features, own, found, out)


def fit_rules(stats: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, seed: int = 7) -> Rules:
    """Fit on a sample.  Without both classes the score is the smoothed share of ones."""
    n, ones = len(labels), int(labels.sum())
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return Rules(prior)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(stats[:, j], np.linspace(0.02, 0.98, 33), method="lower")) for j in range(stats.shape[1])]
    bins = np.stack([np.searchsorted(c, stats[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    y = labels.astype(float)
    z, found = np.full(n, prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(n) < 0.7)
        features = np.sort(rng.choice(stats.shape[1], size=stats.shape[1] * 2 // 3, replace=False))
        step = np.zeros(n)
        _grow(bins, cuts, y - p, p * (1 - p), rows, depth, features, (), found, step)
        z += step
    kept, seen = [], set()
    for path in found:
        held = _holds(path, stats)
        key = np.packbits(held).tobytes()
        if 0.002 < held.mean() < 0.998 and key not in seen:
            seen.add(key)
            kept.append((path, held))
    if not kept:
        return Rules(prior)
    x = np.empty((n, len(kept)), dtype=np.float32)
    for j, (_, held) in enumerate(kept):
        x[:, j] = held
    mean = np.array([held.mean() for _, held in kept])
    scale = np.sqrt(mean * (1 - mean))  # a rule holds or does not
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    w, b = _lasso(x, y.astype(np.float32), penalty, prior)
    w = w / scale
    return Rules(float(b - w @ mean), [(path, float(v)) for (path, _), v in zip(kept, w, strict=True) if v])


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, bias: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """FISTA for the L1 penalised mean log loss; the bias is free."""
    n, m = x.shape
    unit = np.ones(m, x.dtype) / np.sqrt(m).astype(x.dtype)
    for _ in range(20):  # the largest eigenvalue of x'x / n
        v = x.T @ (x @ unit) / n
        unit = v / np.linalg.norm(v)
    step = float(4 / (np.linalg.norm(v) * 1.05 + 1))
    w = at = np.zeros(m, x.dtype)
    b = b_at = bias
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(x @ at + b_at))) - y
        new = at - step * (x.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - x.dtype.type(step * penalty), 0)
        b_new = b_at - step * float(r.mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = float((t - 1) / t_new)
        at, b_at = new + pull * (new - w), b_new + pull * (b_new - b)
        w, b, t = new, b_new, t_new
    return w, float(b)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of every fit: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold.

    Labels other than 0 and 1 and null ids are ignored; of repeated labels the
    rounded mean counts, of repeated documents the one with the least
    statistics.  The sample is bounded, so it may be broadcast and gathered in
    one task, which fits; only the rules come to the driver.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    ids = F.broadcast(chosen)
    stats = with_statistics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = stats.groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).join(ids, "doc_id").select("doc_id", "label", "s.*")
    said = rows.coalesce(1).mapInArrow(_fit_batches, "rules string").first()
    return Rules.from_json(said[0]) if said else Rules(0.0)


def _fit_batches(batches):
    """Fit on all rows of the one partition, in order of their ids; one row of JSON."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held).sort_by("doc_id")
        model = fit_rules(np.stack([rows.column(s).to_numpy() for s in STATS], axis=1), rows.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], names=["rules"])


def classify(docs: DataFrame, model: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row.

    A null text counts as empty and is scored as such; null ids and repeated
    rows stay.  Other columns are ignored.
    """
    scored = with_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
