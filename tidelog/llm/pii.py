"""Personal data: fixed patterns, and a linear-chain CRF over word shapes.

The patterns give the base spans.  The CRF reads the words that hold a digit
or an at sign; every other word is outside by definition, which cuts a text
into short independent chains.  It is trained from a small labelled table
(made by rules below, or the caller's), and decoded by Viterbi in numpy for
all chains of a batch at once.  Labels tell the first word of a value from its
others, so values may stand side by side.  Its spans are added where no base
span lies.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded_batches, ddl, texts

KINDS = ("email", "ip", "card", "phone")
#: Labels: a kind for the first word of a value, OUTSIDE, and INSIDE + kind for
#: its other words, so that label % INSIDE is the kind or OUTSIDE.
OUTSIDE = len(KINDS)
INSIDE = OUTSIDE + 1
LABELS = INSIDE + len(KINDS)
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# The patterns of the contract.  The look-behinds only spare
# starts inside a run of digits, which fail where the run's start has failed.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = max(done, at + 1)  # no later match starts before this sign
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# --- the sequence model ------------------------------------------------------------

_SEED = re.compile(r"[0-9@]\S*")
_EDGE_L, _EDGE_R = "\"'<[{,;:.!?*#$%&=`|/\\", "\"'>]},;:.!?*#$%&=`|/\\"
#: Words of a chain whose features are held at once; it is decoded as a whole.
PART = 512


def chains(text: str):
    """Runs of words with a digit or at sign, one blank apart: lists of spans."""
    run: list[tuple[int, int]] = []
    for m in _SEED.finditer(text):
        a, b = m.span()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        if run and not (a - run[-1][1] == 1 and text[a - 1] in " \t"):
            yield run
            run = []
        run.append((a, b))
    if run:
        yield run


def shape(word: str) -> str:
    """Digits as d, letters as x, the rest as it is; runs as their length, up to 9."""
    kinds = ("d" if "0" <= c <= "9" else "x" if c.isalpha() else c for c in word)
    return "".join(f"{c}{min(n, 9)}" if c in "dx" and (n := sum(1 for _ in g)) else c for c, g in groupby(kinds))


def _cue(word: str) -> str:
    return word.lower().strip("".join(set(_EDGE_L + _EDGE_R)) + "()")


def _word_before(text: str, at: int) -> str:
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at]


_NEXT = re.compile(r"\s*(\S+)")


def features(text: str, run: list[tuple[int, int]], lo: int = 0, hi: int | None = None) -> list[list[str]]:
    """The features of each word of a chain, or of its words from ``lo`` to before ``hi``."""
    hi = len(run) if hi is None else min(hi, len(run))
    bare = {i: text[slice(*run[i])].lstrip(_EDGE_L).rstrip(_EDGE_R) for i in range(max(0, lo - 1), min(len(run), hi + 1))}
    shapes = {i: shape(w) for i, w in bare.items()}
    after = _NEXT.match(text, run[-1][1]) if hi == len(run) else None
    cue, cue2 = _cue(_word_before(text, run[0][0])) if lo == 0 else "", _cue(after[1]) if after else ""
    rows = []
    for i in range(lo, hi):
        w, s = bare[i], shapes[i]
        d = sum("0" <= c <= "9" for c in w)
        rows.append([
            "1", f"s={s}", f"n={min(d, 20)}", f"len={min(len(w), 24)}", f"abc={any(c.isalpha() for c in w)}", f"at={'@' in w}", f"dots={min(w.count('.'), 4)}", f"dash={min(w.count('-'), 4)}",
            f"open={w[:1] in '(+'}", f"p={shapes[i - 1] if i else '^'}", f"ps={shapes[i - 1] if i else '^'}|{s}", f"f={shapes[i + 1] if i + 1 < len(run) else '$'}", f"cue={cue if i == 0 else ''}", f"cue2={cue2 if i + 1 == len(run) else ''}", f"run={min(len(run), 6)}",
        ])
    return rows


@dataclass
class Crf:
    """Weights by feature name and label, and of the label pairs."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        ids = [[self.index.get(f, 0) for f in row] for row in rows]
        return self.emit[np.array(ids)].sum(axis=1)

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of every chain; all chains step together, longest first."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        sizes = np.array([len(chains[i]) for i in order])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        at = 0
        while at < len(order):  # a block of chains whose padding stays small
            width = int(sizes[at])
            end = at + max(1, min(4096, (1 << 18) // max(width, 1)))
            block = order[at:end]
            n, length = len(block), sizes[at : at + len(block)]
            padded = np.zeros((n, width, self.move.shape[0]))
            for r, i in enumerate(block):
                padded[r, : length[r]] = chains[i]
            score, back = padded[:, 0], np.zeros((n, width, self.move.shape[0]), dtype=np.int8)
            for t in range(1, width):
                live = int(np.searchsorted(-length, -t, side="left"))
                step = score[:live, :, None] + self.move[None]
                back[:live, t] = step.argmax(axis=1)
                score[:live] = step.max(axis=1) + padded[:live, t]
            label = score.argmax(axis=1)
            path = np.zeros((n, width), dtype=np.int64)
            for t in range(width - 1, -1, -1):
                here = t < length
                path[here, t] = label[here]
                if t:
                    label[here] = back[here, t, label[here]]
            for r, i in enumerate(block):
                out[i] = path[r, : length[r]]
            at += len(block)
        return out


def labelled_table(rows: int = 900, seed: int = 11) -> list[tuple[str, list[int]]]:
    """A small labelled table: texts with the label of each word of their chain.

    Made by rules: personal data in usual notations after usual words, and
    numbers that are none (years, prices, versions, hashes, counts, dates).
    A part of the chains has several values, of one notation, of one kind or of any.
    """
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 9)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    kinds = [
        (3, ["tel", "phone", "call", "fax", "mobile", "on"], [lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", lambda: f"+{n(2)} {n(3)} {n(7)}", lambda: f"{n(3)}.{n(3)}.{n(4)}"]),
        (2, ["card", "visa", "number", "pay", "with"], [lambda: n(16), lambda: f"{n(4)} {n(4)} {n(4)} {n(4)}", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}", lambda: f"{n(4)} {n(6)} {n(5)}"]),
        (1, ["host", "server", "from", "ip", "address"], [lambda: ".".join(str(rng.randrange(256)) for _ in range(4))]),
        (0, ["mail", "email", "write", "to", "contact"], [lambda: f"{word()}.{n(2)}@{word()}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}{n(1)}@{word()}"]),
        (OUTSIDE, ["in", "page", "version", "price", "chapter", "about", "token", "commit"], [
            lambda: str(rng.randrange(1900, 2040)), lambda: f"{n(1)}.{n(1)}", lambda: f"${n(2)}.{n(2)}", lambda: n(rng.randint(1, 5)), lambda: f"{n(4)}-0{rng.randint(1, 9)}-1{n(1)}", lambda: hexa(40), lambda: f"{n(2)}%", lambda: f"{n(1)}.{n(2)}.{n(1)}",
            lambda: f"{n(2)} {n(2)} {n(2)}", lambda: f"{word()}{n(2)}", lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)},{n(3)}", lambda: f"AKIA{n(16)}", lambda: n(rng.randint(11, 15)), lambda: f"@{word()}", lambda: f"{n(4)} {n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}",
        ]),
    ]
    out = []
    for _ in range(rows):
        kind, cues, makers = rng.choice(kinds)
        values = [(kind, make := rng.choice(makers))]
        if rng.random() < 0.4:
            alike = rng.choice(["notation", "kind", "any"])
            for _ in range(rng.randint(1, 5)):
                k, _, m = (kind, None, makers) if alike != "any" else rng.choice(kinds)
                values.append((k, make if alike == "notation" else rng.choice(m)))
        text, gold = f"{word()} {rng.choice(cues) if rng.random() < 0.6 else word()}", []
        for k, make in values:
            value = make()
            text += f" {value}{rng.choice(['', '', '.', ','])}"
            gold += [k] + [k if k == OUTSIDE else INSIDE + k] * value.count(" ")
        text += f" {word()}"
        for run in chains(text):
            if len(run) == len(gold):
                out.append((text, gold))
    return out


def fit(table: list[tuple[str, list[int]]], rounds: int = 120, l2: float = 2e-4) -> Crf:
    """Maximum likelihood by AdaGrad; each text of the table has one chain."""
    labels = LABELS
    index = {"": 0}
    rows = []
    for text, gold in table:
        run = next(iter(chains(text)), None)
        if run and len(run) == len(gold):
            rows.append(([[index.setdefault(f, len(index)) for f in w] for w in features(text, run)], gold))
    emit, move = np.zeros((len(index), labels)), np.zeros((labels, labels))
    g_emit, g_move = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    same = [list(g) for _, g in groupby(sorted(rows, key=lambda r: len(r[1])), key=lambda r: len(r[1]))]
    groups = [(np.array([r[0] for r in g]), np.array([r[1] for r in g])) for g in same]
    total = max(1, len(rows))
    for _ in range(rounds):
        d_emit, d_move = l2 * emit, l2 * move
        d_emit[0] = 0
        for ids, gold in groups:
            n, t, _ = ids.shape
            e = emit[ids].sum(axis=2)
            fwd, bwd = np.zeros((t, n, labels)), np.zeros((t, n, labels))
            fwd[0] = e[:, 0]
            for i in range(1, t):
                fwd[i] = np.logaddexp.reduce(fwd[i - 1][:, :, None] + move, axis=1) + e[:, i]
            for i in range(t - 2, -1, -1):
                bwd[i] = np.logaddexp.reduce(move[None] + (bwd[i + 1] + e[:, i + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(fwd[-1], axis=1)
            for i in range(t):
                p = np.exp(fwd[i] + bwd[i] - z[:, None])
                p[np.arange(n), gold[:, i]] -= 1
                np.add.at(d_emit, ids[:, i].ravel(), np.repeat(p / total, ids.shape[2], axis=0))
                if i:
                    q = np.exp(fwd[i - 1][:, :, None] + move + (e[:, i] + bwd[i])[:, None, :] - z[:, None, None])
                    d_move += q.sum(axis=0) / total
                    np.add.at(d_move, (gold[:, i - 1], gold[:, i]), -1 / total)
        d_emit[0] = 0
        g_emit += d_emit**2
        g_move += d_move**2
        emit -= 0.4 * d_emit / np.sqrt(g_emit)
        move -= 0.4 * d_move / np.sqrt(g_move)
    return Crf(index, emit, move)


@cache
def default_model() -> Crf:
    """The model of the built-in table, fitted once a process."""
    return fit(labelled_table())


def _plausible(kind: int, s: str) -> bool:
    """Whether a span that the CRF found can be what it is labelled."""
    d = _digits(s)
    if kind == 0:
        left, _, right = s.partition("@")
        return bool(left) and bool(right) and right[0].isalnum() and len(s.split()) == 1
    if kind == 1:
        return bool(re.fullmatch(r"\d+(\.\d+){3}", s)) and all(int(p) <= 255 for p in s.split(".") if len(p) < 4)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and not any(c.isalpha() for c in s)
    return 8 <= len(d) <= 15 and "+" not in s[1:] and not any(c.isalpha() for c in s)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    raw = text[a:b]
    return a + len(raw) - len(raw.lstrip(_EDGE_L)), b - len(raw) + len(raw.rstrip(_EDGE_R))


def _values(text: str, run: list[tuple[int, int]], kind: int, begins: list[bool], fits) -> list[tuple[int, int]]:
    """The spans of the values among adjacent words of one kind.

    Where the model's own borders leave a part that does not fit, the parts
    that do and cover most words are taken: of these, those that keep most of
    its borders, then those of the most even lengths.
    """
    starts = [0, *(i for i in range(1, len(run)) if begins[i]), len(run)]
    spans = [_trim(text, run[i][0], run[j - 1][1]) for i, j in zip(starts, starts[1:], strict=False)]
    if len(run) == 1 or all(fits(kind, *s) for s in spans):
        return [s for s in spans if fits(kind, *s)]
    digits = [len(_digits(text[a:b])) for a, b in run]
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    last: list[tuple[int, tuple[int, int] | None]] = [(0, None)]
    for j in range(1, len(run) + 1):
        top, step, d = best[j - 1], (j - 1, None), 0
        for i in range(j - 1, max(-1, j - 1 - (1 if kind < 2 else 19)), -1):
            d += digits[i]
            if kind >= 2 and d > 19:
                break
            span = _trim(text, run[i][0], run[j - 1][1])
            score = (best[i][0] + j - i, best[i][1] + (1 if begins[i] or not i else -1), best[i][2] - d * d)
            if score > top and fits(kind, *span):
                top, step = score, (i, span)
        best.append(top)
        last.append(step)
    out, j = [], len(run)
    while j:
        j, span = last[j]
        if span:
            out.append(span)
    return out[::-1]


def _apart(spans: list[tuple[int, int, int, bool]]):
    """Whether a place meets none of some spans, as a function."""
    starts, ends = [], []
    for a, b in sorted(s[1:3] for s in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)

    def apart(a: int, b: int) -> bool:
        i = bisect_right(ends, a)
        return i == len(ends) or b <= starts[i]

    return apart


def all_spans(text_list: list[str], model: Crf) -> list[list[tuple[int, int, int, bool]]]:
    """For each text (kind, start, end, base), by kind, then start."""
    out = [[(*s, True) for s in base_spans(t)] for t in text_list]
    where, runs, scores = [], [], []
    apart = {}

    def decode():
        for i, run, labels in zip(where, runs, model.viterbi(scores), strict=True):
            text = text_list[i]
            if i not in apart:
                apart[i] = _apart(out[i])
            fits = lambda kind, a, b, free=apart[i], text=text: a < b and free(a, b) and _plausible(kind, text[a:b])
            k = 0
            for kind, group in groupby((labels % INSIDE).tolist()):
                m = k + sum(1 for _ in group)
                if kind != OUTSIDE:
                    begins = (labels[k:m] < INSIDE).tolist()
                    out[i] += [(kind, a, b, False) for a, b in _values(text, run[k:m], kind, begins, fits)]
                k = m
        where.clear(), runs.clear(), scores.clear(), apart.clear()

    words = 0
    for i, text in enumerate(text_list):
        for run in chains(text):
            where.append(i)
            runs.append(run)
            scores.append(np.concatenate([model.emissions(features(text, run, a, a + PART)) for a in range(0, len(run), PART)]))
            words += len(run)
        if words > 20_000:
            decode()
            words = 0
    decode()
    return [sorted(x) for x in out]


def _find(model: Crf):
    def run(batches):
        for batch in batches:
            found = all_spans(batch.column("text").to_pylist(), model)
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in x] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(rows, kind)], names=["doc_id", "text", "spans"])

    return run


def find(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) for every row; spans by kind as in KINDS, then start.

    Offsets are code points, the end exclusive; ``base`` tells pattern spans
    from those that the CRF adds.  A null text counts as empty and has no
    spans; null ids and repeated rows stay; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_find(model or default_model()), f"doc_id bigint, text string, spans {SPANS}")


def _mask(model: Crf):
    def run(batches):
        for batch in batches:
            given = batch.column("text").to_pylist()
            found = all_spans(given, model)
            new = [redact(t, [(a, b, KINDS[k]) for k, a, b, _ in s]) if s else t for t, s in zip(given, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(new, pa.string()), batch.column("row")], names=["doc_id", "text", "row"])

    return run


def mask(docs: DataFrame, model: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): every span of find() replaced by its kind, as in ``<EMAIL>``."""
    bounded_batches(docs.sparkSession)
    rows = texts(docs, id_col, text_col, carry=True)
    return rows.mapInArrow(_mask(model or default_model()), ddl(rows, "doc_id", "text", "row"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each of its (start, end, kind) spans, overlaps joined, as ``<KIND>``."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
