"""Personal data: the fixed patterns against plain regexes, and the CRF."""

import random
import re

import numpy as np

from tidelog.llm import pii


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    alphabet = ["a", "b", "@", ".", "_", "-", "+", "1", "25", "9", " ", "\n", "é", "(", ")", "4381893557741609", "x@y.z", "1.2.3.4", "+1 (234) 555-1234"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_stay_linear():
    for unit in ("1", "a", "@", "+", "1.", "a@", "+1 "):
        assert pii.base_spans(unit * 200_000) == [] or unit in ("1.", "a@")


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    model = pii.Crf({}, np.zeros((1, 5)), rng.normal(size=(5, 5)))
    chains = [rng.normal(size=(n, 5)) for n in (1, 3, 2, 5, 1, 4)]
    for e, got in zip(chains, model.viterbi(chains), strict=True):
        best = max(np.ndindex(*(5,) * len(e)), key=lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(got) == best


def test_crf_learns_its_table():
    table = pii.labelled_table(700, seed=3)
    model = pii.fit(table)
    fresh = pii.labelled_table(300, seed=99)
    right = total = 0
    for text, gold in fresh:
        run = next(pii.chains(text))
        labels = model.viterbi([model.emissions(pii.features(text, run))])[0]
        right += int((labels == np.array(gold)).sum())
        total += len(gold)
    assert right / total > 0.9


def test_added_spans_and_clean_text(spark):
    rows = [
        (1, "call (743) 555-3824 now"),
        (2, "in 1999 we saw 12 of 40, at 3.5% or $20.10, version 2.0.1, 2024-05-06"),
        (3, None),
        (None, "mail ab.12@mail3.example.com, or é 10.0.0.1"),
        (5, ""),
        (5, "x " * 50_000 + "+1 (743) 555-3824"),
    ]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, row int, spans string")
    got = {r.text[:4]: [tuple(s) for s in r.spans] for r in pii.find(df).collect()}
    assert got["call"] == [("phone", 5, 19, False)]
    assert got["in 1"] == [] and got[""] == []
    assert got["mail"] == [("email", 5, 28, True), ("ip", 35, 43, True)]
    assert got["x x "] == [("phone", 100_000, 100_017, True)]
    masked = {r.row.doc_id: r.text for r in pii.mask(df).collect() if r.row.doc_id != 5}
    assert masked[1] == "call <PHONE> now" and masked[None] == "mail <EMAIL>, or é <IP>"
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_values_side_by_side():
    model = pii.fit(pii.labelled_table())
    for kind, values in [
        (3, ["555-123-4567", "555-987-6543"]), (3, ["(743) 555-3824", "(212) 555-1234", "(305) 555-7788"]), (3, ["555-123-4567", "+1 (743) 555-3824"]),
        (2, ["4381893557741609", "4381893557741609"]), (2, ["4381 8935 5774 1609"] * 2), (0, ["bob1@host", "ann2@host"]),
    ]:
        for gap in " \t":
            text = f"see {gap.join(values)} end"
            found = pii.all_spans([text], model)[0]
            assert [(k, text[a:b]) for k, a, b, _ in found] == [(kind, v) for v in values], text
    mixed = "id 17 555-123-4567 4381893557741609 2024-05-06 x"
    assert [(k, mixed[a:b]) for k, a, b, _ in pii.all_spans([mixed], model)[0]] == [(2, "4381893557741609"), (3, "555-123-4567")]


def test_merged_values_are_split_at_word_borders():
    text = "(743) 555-3824 (212) 555-1234"
    model = pii.Crf({}, np.zeros((1, 9)), np.zeros((9, 9)))
    model.emissions = lambda rows: np.eye(9)[[3] + [8] * (len(rows) - 1)]  # one phone of all words
    assert pii.all_spans([text], model) == [[(3, 0, 14, False), (3, 15, 29, False)]]


def test_long_chains_are_decoded_whole():
    model = pii.fit(pii.labelled_table())
    for n in range(508, 514):
        text = "12 " * n + "(743) 555-3824 " + "12 " * 600 + "x"
        assert [(k, text[a:b]) for k, a, b, _ in pii.all_spans([text], model)[0]] == [(3, "(743) 555-3824")], n
    run = next(pii.chains(text))
    assert [r for a in range(0, len(run), 7) for r in pii.features(text, run, a, a + 7)] == pii.features(text, run)


def test_redact_joins_overlaps():
    assert pii.redact("abcdefgh", [(1, 4, "phone"), (3, 6, "card"), (6, 7, "ip")]) == "a<PHONE><IP>h"


#: Written by hand, not by the rules of labelled_table(); values are marked [kind|value].
BY_HAND = [
    "You can reach me at [phone|(415) 555-2671] after six.",
    "Office: [phone|212-555-0187], ask for Ann.",
    "Tel.: [phone|(020) 794-0958]",
    "My cell is [phone|646.555.0142] and the door code is 4411.",
    "Rufen Sie [phone|+49 30 1234567] an.",
    "Appelez le [phone|+33 (142) 685-3000] avant midi",
    "Fax [phone|(305) 555-0199], room 12",
    "Send a text to [phone|917-555-0123]!",
    "He wrote: [phone|(702) 555-0110]",
    "phones: [phone|213-555-0100] [phone|213-555-0101]",
    "Amex [card|3782 822463 10005] was charged $42.10 on 2023-04-05.",
    "Visa [card|4111 1111 1111 1111] exp 12/27",
    "pay with [card|5500-0000-0000-0004], please",
    "the card number [card|6011000000000004] was stolen",
    "Card: [card|3714 496353 98431].",
    "ssh root at [ip|192.168.0.17] port 22",
    "blocked [ip|10.20.30.40], [ip|172.16.254.1] and 3 more",
    "server=[ip|8.8.8.8]",
    "Write to [email|jane.doe42@mail.example.org].",
    "contact [email|ops7@intranet] for access",
    "Mail [email|first.last@example.co.uk] or [email|x_1@y.io]",
    "cc: [email|dev2@buildhost]",
    "Please call [phone|555-867-5309] or [phone|(555) 867-5310].",
    "Ring [phone|(617) 555-0147] between 9 and 17.",
    "kontakt [phone|089.555.0123]",
    "mobile [phone|+1 (650) 555-0182]",
    "on [phone|303-555-0176] we answer",
    "Questions? [phone|(808) 555-0133] - aloha",
    "Hotline [phone|800-555-0199] (24/7)",
    "[phone|312-555-0164] is the desk",
    "In 2019, 45 of 120 people paid 3.50 for 2 items.",
    "Version 1.2.3 fixed 17 bugs in 2020-11-05.",
    "pages 120-135, ISBN 978-3-16-148410-0",
    "commit 9fceb02d0ae598e95dc970b74767f19372d61af8",
    "The year 1984 and 2001 at 10:45, 1,000,000 views",
    "SSN 078-05-1120 looks like one",
    "total 12 345 678 units",
    "order 20230405123 shipped",
    "ratio 16:9, 1920x1080 px, 4k",
    "temperature -12.5 to 30.25 degrees",
    "lot 4455 6677 in hall 3",
    "3.14159 26535 89793",
    "tracking 1234567890123",
]


def test_recall_on_texts_written_by_hand():
    model = pii.fit(pii.labelled_table())
    right = missed = extra = 0
    for marked in BY_HAND:
        want, text = set(), ""
        for kind, value, rest in re.findall(r"\[(\w+)\|([^\]]*)\]|([^\[]+)", marked):
            if kind:
                want.add((kind, len(text), len(text) + len(value)))
            text += value or rest
        got = {(pii.KINDS[k], a, b) for k, a, b, _ in pii.all_spans([text], model)[0]}
        right, missed, extra = right + len(want & got), missed + len(want - got), extra + len(got - want)
    assert right / (right + missed) >= 0.9 and right / (right + extra) >= 0.9


def test_features_see_whole_words():
    """Shapes, cues and contexts beyond 64, 16 and 32 characters."""
    text = f"{'c' * 40}{' ' * 50}{'a1-' * 40}x 5{' ' * 60}{'d' * 30} z"
    run = next(pii.chains(text))
    first, last = pii.features(text, run)
    assert f"cue={'c' * 40}" in first and f"cue2={'d' * 30}" in last and f"s={pii.shape('a1-' * 40 + 'x')}" in first
    assert pii.shape("a1-" * 40) != pii.shape("a1-" * 39) and "cue=" in pii.features("7", next(pii.chains("7")))[0]


def test_many_values_stay_fast():
    import time

    model = pii.fit(pii.labelled_table())
    took = []
    for n in (2000, 8000):
        t = time.process_time()
        assert len(pii.all_spans(["call 555-123-4567\n" * n], model)[0]) == n
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 1
