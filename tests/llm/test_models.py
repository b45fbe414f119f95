"""Quality and language scores beside plain recomputations."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from nestframe.llm import langid, quality


def test_quality_scores_are_those_of_plain_compression(spark):
    """Sizes by the library, block by block, and the logistic function by hand."""
    rng = random.Random(1)
    rows = [{"text": " ".join(rng.choices(["river", "stone", "walked", "slowly", "under", "trees"], k=rng.randint(5, 200))), "quality": 1} for _ in range(80)]
    rows += [{"text": " ".join(rng.choices(["CLICK", "buy!!", "$$$", "#ad", "win", "now"], k=rng.randint(5, 200))), "quality": 0} for _ in range(60)]
    model = quality.fit(rows, (60, 80))
    texts = [r["text"] for r in rows[::7]] + ["", "Ä" * 3000, None]

    def plain(text):
        raw, d = (text or "").encode(), []
        for block in (256, 2048):
            for good, bad in model.pairs:
                sizes = []
                for data in (good, bad):
                    c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
                    sizes.append(sum(len(c.compress(raw[i : i + block])) for i in range(0, max(len(raw), 1), block)))
                d.append((sizes[1] - sizes[0]) / (sizes[1] + sizes[0]))
        z = [max(-4.0, min(4.0, (x - m) / s)) for x, m, s in zip(d, model.mean, model.deviation, strict=True)]
        terms = [1.0, *z, *(z[i] * z[j] for i in range(len(z)) for j in range(i, len(z)))]
        return 1 / (1 + np.exp(-sum(t * w for t, w in zip(terms, model.weights, strict=True))))

    got = [r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert got == pytest.approx([plain(t) for t in texts], abs=1e-9)
    assert np.mean([(s >= 0.7) == r["quality"] for s, r in zip(got, rows[::7], strict=False)]) > 0.95


def test_quality_fit_ends_at_the_least_loss(monkeypatch):
    """Classes nearly apart: whole Newton steps overshoot here, until every text scores 0 or every one 1."""
    rng = np.random.default_rng(163)
    bad = rng.standard_t(3, (40, 1)) * 0.05 - 0.3 + rng.standard_t(3, (40, 6)) * 0.01
    good = rng.standard_t(3, (40, 1)) * 0.02 + rng.standard_t(3, (40, 6)) * 0.01
    x = {f"{q} {i}": row for q, rows in enumerate((bad, good)) for i, row in enumerate(rows, 26)}  # the first 26 go to the dictionaries
    monkeypatch.setattr(quality, "Sizer", lambda pairs: lambda text: x[text])
    model = quality.fit([{"text": f"{q} {i}", "quality": q} for q in (0, 1) for i in range(66)], (1, 7))
    y = np.repeat([0, 1], 40)
    differences = np.array(list(x.values()))
    assert ((model.score(differences) >= 0.7) == y).mean() > 0.95
    terms, weight = model.terms(differences), np.repeat([1 / 4, 7 / 4], 40)
    uphill = terms.T @ (weight * (model.score(differences) - y)) + 1e-2 * model.weights
    assert np.abs(uphill).max() < 1e-3


class Plain:
    """Interpolated Kneser-Ney by dictionaries, up to five characters, over words with a start and an end mark."""

    def __init__(self, words: Counter, characters: int) -> None:
        self.floor, self.orders = 1 / (characters + 1), []
        grams = [Counter() for _ in range(6)]
        for w, n in words.items():
            marked = "\x01" + w + "\x02"
            for end in range(1, len(marked)):
                for size in range(1, 6):
                    if end - size + 1 >= 0:
                        grams[size][marked[end - size + 1 : end + 1]] += n
        for size in range(1, 6):
            count = Counter(grams[5]) if size == 5 else Counter()
            if size < 5:
                for g in grams[size + 1]:
                    count[g[1:]] += 1
                for g, n in grams[size].items():
                    if g[0] == "\x01":
                        count[g] += n
            once, twice = (sum(v == k for v in count.values()) for k in (1, 2))
            discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            total, kinds = defaultdict(int), defaultdict(int)
            for g, v in count.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            self.orders.append((count, discount, total, kinds))

    def __call__(self, context: str, c: str) -> float:
        p = self.floor
        for size, (count, discount, total, kinds) in enumerate(self.orders, 1):
            h = context[len(context) - size + 1 :] if size > 1 else ""
            if len(h) < size - 1 or not total[h]:
                break
            p = max(count[h + c] - discount, 0) / total[h] + discount * kinds[h] / total[h] * p
        return p


TEXTS = {"x": ["abba baab abab cab", "bca cab abba", "aaaa"], "y": ["ddc cdd dcdcd", "c d ccc ddd cdc"]}


def plain_models():
    of = {k: Counter(w for t in v for w in t.split()) for k, v in TEXTS.items()}
    characters = max(len(set("".join(c))) + 1 for c in of.values())
    return {k: Plain(c, characters) for k, c in of.items()}, characters


def test_kneser_ney_is_the_plain_one():
    model, (plain, _) = langid.fit(TEXTS), plain_models()
    words = ["abba", "cab", "cc", "dcd", "a", "zebra", "abcabcabc", "ddddd"]
    losses, sizes = model.words(words)
    for w, row, size in zip(words, losses, sizes, strict=True):
        marked = "\x01" + w + "\x02"
        for k, name in enumerate(model.languages):
            assert row[k] == pytest.approx(-sum(np.log(plain[name](marked[:i], marked[i])) for i in range(1, len(marked))), abs=1e-9)
        assert size == len(w) + 1


def test_kneser_ney_sums_to_one():
    """After any context, over the characters that the floor counts: the known ones, the end, and those never seen."""
    plain, characters = plain_models()
    for name, model in plain.items():
        known = {c for t in TEXTS[name] for c in t if c != " "} | {"\x02"}
        for context in ("\x01", "\x01a", "\x01ab", "\x01abb", "\x01cab", "\x01ddc", "\x01zz", "\x01abba", "\x01cdcd"):
            total = sum(model(context, c) for c in known) + (characters + 1 - len(known)) * model(context, "never seen")
            assert total == pytest.approx(1.0, abs=1e-12)


def test_words_are_scored_alike_however_they_are_remembered(monkeypatch):
    model = langid.fit(TEXTS)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 90))) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a" * 5000, None, ""]
    whole = langid.Scorer(model)(texts)
    monkeypatch.setattr(langid, "MEMORY", 40)
    monkeypatch.setattr(langid, "KEPT_WORDS", 10)
    small = langid.Scorer(model)
    assert np.allclose(np.concatenate([small(texts[i : i + 7]) for i in range(0, len(texts), 7)]), whole)
    plain = [sum(model.words([w])[0][0] for w in t.split()) if t else np.zeros(2) for t in texts]
    assert np.allclose(whole[:, :-1], np.array(plain))


def test_ties_go_to_the_first_language():
    model = langid.fit({"b": ["same words here"], "a": ["same words here"]})
    found, score, _, _ = langid.choose(model, langid.Scorer(model)(["words", "12 34"]))
    assert found == ["a", "und"] and score[0] == pytest.approx(0.5)
