"""Links are those of the words: words made to collide, large keys of unlike sets, boxes cut by the tree."""

import random
from collections import Counter

import numpy as np

from nestframe.llm import jaccard
from nestframe.llm.shingles import shingle_sets, word_sets


def thue_morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    texts = [f"{x}{thue_morse(n, letters)}" for n in (16, 64, 1024, 4096) for letters in ("ab", "ba") for x in ("", "x ", "x y z ")]
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(texts)


def test_hashes_depend_on_the_key_and_sets_do_not():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "Ä", "\x00", "word", "w" * 70]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    one, other = (list(shingle_sets(texts, 3, secret)) for secret in (1, 2))
    assert [len(s) for s in one] == [len(s) for s in other] == [len(word_sets(t, 3)) for t in texts]
    assert any((s != t).any() for s, t in zip(one, other, strict=True) if len(s))


def test_a_large_key_of_unlike_sets(spark):
    """Thousands of texts with a common passage, and a few of them near copies."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(str(rng.randrange(10**6)) for _ in range(12)) for _ in range(3000)]
    texts += [t + " more" for t in texts[:40]]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    assert all(got[3000 + i] == got[i] == i for i in range(40)) and all(got[i] == i for i in range(40, 3000))


def test_every_level_of_the_tree_cuts():
    """Families of near copies: more than half of the pairs of points go at boxes, none that the bound allows is lost."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 12, (60, jaccard.GROUPS))
    x = np.vstack([base + (rng.random(base.shape) < 0.05) for _ in range(20)])
    n, cuts = x.sum(1), Counter()
    tree = jaccard.Tree(x, n)
    left = {tuple(sorted((int(i), int(j)))) for a, b in tree.joined(80, cuts) for i in a for j in b if i != j}
    allowed = np.argwhere(np.triu(np.minimum(x[:, None], x[None]).sum(2) * 180 >= 80 * (n[:, None] + n[None]), 1))
    assert {tuple(p) for p in allowed.tolist()} <= left
    gone = sum(m for (_, on), m in cuts.items() if not on)
    assert gone > 0.5 * len(x) * (len(x) - 1) / 2 and len({d for (d, on), m in cuts.items() if not on and m}) >= 3
