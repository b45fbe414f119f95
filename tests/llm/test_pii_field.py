"""The semi-Markov field beside all segmentations, small steps, held-out forms and very long texts."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from nestframe.llm import pii

PROSE = "the cat and the dog went over the hill to see what they could see and came home again"
#: Forms that the training does not use.
CALLED = ("(NNN)NNN-NNNN", "NNN-NNN-NNNN", "NNN.NNN.NNNN", "1-NNN-NNN-NNNN", "00NN NN NNNNNNN")
NOBODYS = ("Fig. N.NN", "20NN.0N.1N", "NNNN-NNNN-NNNN", "N,NNN,NNN", "chapter NN.N.N", "0xNNNNNNNN", "1N.NN.20NN 1N:2N", "ISBN-13: 978 N NN NNNNNN N", "RFC NNNN section N.N.N", "$N,NNN.NN", "rows 1000 2000 3000", "2024-01-02 10:11:12", "ssn 078-05-1120")


@pytest.fixture(scope="module")
def field():
    rng = random.Random(1)
    words = PROSE.split()
    return pii.fit([" ".join(rng.choices(words, k=30)) for _ in range(300)])


def segmentations(n, candidates, at=0):
    """All ways from an atom on, as lists of (candidate or None, first atom)."""
    if at == n:
        yield []
        return
    for rest in segmentations(n, candidates, at + 1):
        yield [(None, at), *rest]
    for c, (i, j) in enumerate(candidates):
        if i == at:
            for rest in segmentations(n, candidates, j):
                yield [(c, at), *rest]


def values(n, candidates, scores, turns):
    """The weight of every labelled segmentation, with its spans."""
    for way in segmentations(n, candidates):
        todo = [(0, 0.0, [])]
        for c, _ in way:
            if c is None:
                todo = [(0, v + turns[y, 0], s) for y, v, s in todo]
            else:
                todo = [(k + 1, v + turns[y, k + 1] + scores[c, k], [*s, (*candidates[c], k)]) for y, v, s in todo for k in range(scores.shape[1])]
        for _, v, s in todo:
            yield v, s


def test_decoding_is_best():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        candidates = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1) if rng.random() < 0.5]
        first, after = (np.array([c[k] for c in candidates], int) for k in (0, 1))
        scores, turns = rng.normal(size=(len(candidates), 2)), rng.normal(size=(3, 3))
        turns[0, 0] = 0
        got = pii.decode(n, first, after, scores, turns)
        best, spans = max(values(n, candidates, scores, turns), key=lambda x: x[0])
        assert got == spans or best == pytest.approx(next(v for v, s in values(n, candidates, scores, turns) if s == got))


def test_candidates_that_are_passed_over_change_nothing():
    rng = np.random.default_rng(5)
    text = "a1@b.co +1 (017) 555-7713 4111111111111111 10.2.3.4"
    for _ in range(20):
        field = pii.Field(rng.normal(size=(pii.SIZE, len(pii.KINDS))), rng.normal(size=(len(pii.KINDS) + 1,) * 2))
        field.turns[0, 0] = 0
        own = pii.Pieces([(text, 0, len(text))])
        first, after, x = own.candidates(0, len(own))
        every = pii.decode(len(own), first, after, x @ field.weights, field.turns)
        assert pii.added([(text, 0, len(text))], field) == [[(int(own.start[i]) + own.shift[0], int(own.end[j - 1]) + own.shift[0], k) for i, j, k in every]]


def test_likelihood_and_slopes():
    """Beside all segmentations, and small steps."""
    examples = [("call (017) 555-77 ok", [(5, 17, 3)]), ("at 12-34-56 no", [])]
    cases = pii.Cases.of(examples)
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.SIZE, len(pii.KINDS))) * 0.3, rng.normal(size=(len(pii.KINDS) + 1,) * 2) * 0.3)
    of = lambda f: cases.step(f)[0] + float((cases.seen_turns * f.turns).sum())
    total = 0.0
    for w, n in enumerate(cases.atoms.tolist()):
        mine = np.flatnonzero(cases.window == w)
        candidates = [(int(cases.first[c]), int(cases.first[c] + cases.size[c] + 1)) for c in mine]
        total += np.logaddexp.reduce([v for v, _ in values(n, candidates, (cases.x @ field.weights)[mine], field.turns)])
    marked = cases.gold >= 0
    gold = float((cases.x @ field.weights)[marked, cases.gold[marked]].sum() + (cases.seen_turns * field.turns).sum())
    assert len(cases.atoms) == 2 and of(field) == pytest.approx(gold - total)
    _, slope, expected = cases.step(field)
    for name, at in (("weights", (0, 3)), ("weights", (8, 3)), ("weights", (44, 1)), ("turns", (0, 4)), ("turns", (4, 0)), ("turns", (0, 0)), ("turns", (3, 2))):
        up, down = (pii.Field(field.weights.copy(), field.turns.copy()) for _ in range(2))
        getattr(up, name)[at] += 1e-5
        getattr(down, name)[at] -= 1e-5
        mine = slope[at] if name == "weights" else (cases.seen_turns - expected)[at]
        assert mine == pytest.approx((of(up) - of(down)) / 2e-5, abs=1e-4)


def test_windows_are_what_spans_leave():
    rng = random.Random(2)
    bits = ["ab", "a1", "@x", "12", " ", "  ", "\n", "token = ", "key: "]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        at, taken = 0, []
        while at < len(text):
            a, b = at + rng.randint(0, 9), at + rng.randint(10, 16)
            if b < len(text):
                taken.append((a, b, 0))
            at = b
        got = list(pii.windows(text, taken))
        assert got == sorted(got) and all(b - a >= pii.SHORTEST for a, b in got)
        assert not any(a < e and s < b for a, b in got for s, e, _ in taken)
        free = [i for i, c in enumerate(text) if c in "0123456789@" and not any(a <= i < b for a, b, _ in taken)]
        left = [i for i in free if not any(a <= i < b for a, b in got)]
        edges = sorted({0, len(text), *(x for a, b, _ in taken for x in (a, b))})
        # A token that isn't looked at is too short to hold a span, as spans leave it.
        for i in left:
            a, b = max(x for x in edges if x <= i), min(x for x in edges if x > i)
            assert len(re.split(r"\s", text[a:i])[-1]) + len(re.split(r"\s", text[i:b])[0]) < pii.SHORTEST


def outcome(field, form, kind, rng, cue=""):
    before, after = (" ".join(rng.choices(PROSE.split(), k=5)) for _ in range(2))
    new = pii.secret(rng) if kind == 4 else pii.number(form, rng)
    start = len(before) + 1 + len(cue)
    (base, every), = pii.found([f"{before} {cue}{new} {after}"], field)
    return set(every) - set(base), (start, start + len(new), kind)


def test_numbers_that_are_nobodys_stay(field):
    rng = random.Random(7)
    wrong = Counter(form for form in NOBODYS for _ in range(20) if outcome(field, form, None, rng)[0])
    assert sum(wrong.values()) <= 0.02 * 20 * len(NOBODYS), wrong


def test_held_out_forms_are_found(field):
    rng = random.Random(8)
    called = [outcome(field, form, 3, rng) for form in CALLED for _ in range(20)]
    secrets = [outcome(field, "", 4, rng, cue) for cue in ("pwd: ", "credentials=", "SECRET_KEY = ") for _ in range(20)]
    assert np.mean([gold in spans for spans, gold in secrets]) >= 0.95
    assert np.mean([gold in spans for spans, gold in called]) >= 0.5


def test_very_long_texts(field):
    """Time grows with the text, whatever it holds."""
    for text in ("a1" * 250_000, "a" * 500_000 + "1", "1-" * 50_000, "x@" * 50_000, "a@b.co " * 20_000, "token = " * 20_000):
        began = time.time()
        (base, every), = pii.found([text], field)
        assert time.time() - began < 20 and set(base) <= set(every)
