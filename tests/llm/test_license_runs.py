"""Licence notices inside lines, in comment headers and as whole texts; runs against brute force."""

import random
import textwrap

import numpy as np
import pytest

from nestframe.llm import licenses

APACHE = [t for n, t in licenses.TEMPLATES if n == "Apache-2.0"]


def header(mark: str) -> str:
    lines = [*textwrap.wrap(APACHE[1], 70), "", *textwrap.wrap(APACHE[2], 70)]
    return "\n".join(f"{mark} {line}" for line in lines) + "\nint main() { return 0; }"


def found(spark, *docs):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    return [sorted((r["license"], docs[i][r["start"] : r["end"]]) for r in rows if r["doc_id"] == i) for i in range(len(docs))]


def test_inline_notices_and_comment_headers(spark):
    got = found(spark, "Foo is great. Licensed under the MIT License. See the file for more.", "This file is licensed under the MIT License.", header("#"), header(" *"), "İİ x Licensed\n// under CC BY-NC\n// 4.0 y")
    assert got[0] == [("MIT", "Licensed under the MIT License")] and got[1] == [("MIT", "licensed under the MIT License")]
    for rows in got[2:4]:
        assert [n for n, _ in rows] == ["Apache-2.0"] * 2 and all(licenses.bigrams(t) == licenses.bigrams(a) for (_, t), a in zip(rows, APACHE[1:], strict=True))
    assert got[4] == [("CC-BY-NC-4.0", "Licensed\n// under CC BY-NC\n// 4.0")]


def test_whole_texts(spark):
    whole = licenses.texts()
    docs = [f"Some words before.\n{t}\nSome words after." for _, t in whole]
    for (name, text), rows in zip(whole, found(spark, *docs), strict=True):
        longest = max(rows, key=lambda r: len(r[1]))
        assert longest[0] == name and longest[1] in text.strip() and licenses.bigrams(longest[1]) == licenses.bigrams(text)


@pytest.mark.parametrize("seed", range(30))
def test_starts_are_skipped_exactly(seed):
    r = random.Random(seed)
    text = " ".join(r.choices("abcde", k=r.randint(3, 14)))
    words = r.choices("abcde", k=60) + text.split() + r.choices("abcdefgh", k=60)
    runs = licenses.Runs([("T", text)], 0.8)
    _, _, place, _ = runs.candidates(" ".join(words))
    pairs = list(zip(words, words[1:], strict=False))
    before = [max((q for q in range(p) if pairs[q] == pairs[p]), default=-1) for p in range(len(pairs))]
    got = {i: d for d, i, *_ in runs.best(0, place >= 0, np.array(before))}
    own = licenses.bigrams(text)
    expected = {}
    for i in range(len(pairs)):
        best = max(2 * len(own & set(pairs[i : j + 1])) / (len(own) + len(set(pairs[i : j + 1]))) for j in range(i, len(pairs)))
        if best >= 0.8 and pairs[i] in own:
            expected[i] = best
    assert got == expected
