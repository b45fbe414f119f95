"""Language by interpolated Kneser-Ney character models.

Each language has a model of the characters of its words, up to ORDER at a time; a word is scored from
its start mark to its end mark. All n-grams lie in one sorted array of hashes, beside each language's
discounted share (alpha) and, for the n-gram as a context, its weight for the shorter context (gamma).
A text's language has the lowest cross-entropy by character. Words seen before are looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestframe.llm.common import fold, read
from nestframe.llm.shingles import BASE, mix64

ORDER = 5
#: Bounds of what is learned from: documents a language, characters of a text, and languages, the most frequent ones.
DOCS_A_LANGUAGE, CHARS, LANGUAGES = 400, 20_000, 256
#: Words that a task remembers, of up to so many characters, and how many of them, the first and so the frequent ones, it keeps when these
#: are full. Forgetting only costs time.
MEMORY, SHORT, KEPT_WORDS = 400_000, 64, 60_000
#: The share of calibration texts whose cross-entropy a known language's text may not pass.
KEPT = 0.995


def letters(word: str) -> list[str]:
    """Runs of letters, in lower case."""
    low = word.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha() and not low[-1].isalpha():
        return [low[:-1]]
    return "".join([c if c.isalpha() else " " for c in low]).split()


def ngrams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of all predicted characters of the words: the word's index, and for each order the hash of the n-gram that ends there (and whether the word reaches back so far)."""
    lengths = np.array([len(w) for w in words], np.int64)
    # Each word is a start mark (1), its characters and an end mark (2).
    codes = np.frombuffer("".join([f"\x01{w}\x02" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.concatenate(([0], np.cumsum(lengths + 2)[:-1])) if len(words) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(words)), lengths + 2)
    back = np.arange(len(codes)) - start[word] if len(words) else np.zeros(0, np.int64)
    hashes, reach = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        # The n-gram that ends at i: the (n-1)-gram that ends at i, and the character n - 1 before i.
        earlier = np.concatenate((np.zeros(min(n - 1, len(codes)), np.uint64), codes[: max(0, len(codes) - n + 1)]))
        h = mix64(h * BASE + earlier + np.uint64(n))
        hashes.append(h)
        reach.append(back >= n - 1)
    return word, hashes, reach


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted hashes of all orders
    alpha: np.ndarray  # by key and language
    gamma: np.ndarray  # 1 where the language hasn't seen the context
    floor: float
    temperature: float = 1.0
    limit: float = np.inf

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Minus log probability by word and language, and predicted characters by word."""
        word, hashes, reach = ngrams(words)
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        p = np.full((len(word), len(self.languages)), self.floor)
        context = np.full(len(word), -1)  # the entry of the (n-1)-gram that ends one before
        for n in range(1, ORDER + 1):
            # An n-gram is only there if the shorter one that ends with it is.
            look = np.flatnonzero(reach[n - 1] if n == 1 else reach[n - 1] & (at >= 0))
            place = np.minimum(np.searchsorted(self.keys, hashes[n - 1][look]), len(self.keys) - 1)
            at = np.full(len(word), -1)
            at[look] = np.where(self.keys[place] == hashes[n - 1][look], place, -1)
            p *= self.gamma[context] if n > 1 else self.gamma[-2]
            p += self.alpha[at]
            context = np.concatenate(([-1], at[:-1])) if len(at) else at
            context = np.where(reach[n] if n < ORDER else False, context, -1)
        loss = np.where(first[:, None], 0, -np.log(p))
        ends = np.flatnonzero(np.append(first[1:], True)) if len(word) else np.zeros(0, np.int64)
        total = np.cumsum(loss, 0)[ends]
        total[1:] -= total[:-1].copy()
        return total, np.array([len(w) + 1 for w in words])


def fit(texts: dict[str, list[str]]) -> Model:
    """Models of the languages' texts."""
    languages = sorted(texts)
    tables, characters = [], 1
    for language in languages:
        counted = Counter(w for t in texts[language] for token in t.split() for w in letters(token))
        words = list(counted)
        times = np.array(list(counted.values()), np.int64)
        characters = max(characters, len(set("".join(words))) + 1)
        word, hashes, reach = ngrams(words)
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        before = [np.concatenate(([np.uint64(0)], h[:-1])) for h in hashes]
        tables.append((word, hashes, reach, first, before, times))
    known = [np.unique(np.concatenate([h[r & ~f] for _, hashes, reach, f, _, _ in tables for h, r in zip(hashes, reach, strict=True)] + [b[r & ~f] for _, _, reach, f, before, _ in tables for b, r in zip(before[:-1], reach[1:], strict=True)]))] if languages else [np.zeros(1, np.uint64)]
    keys = known[0] if len(known[0]) else np.zeros(1, np.uint64)
    # Two entries more at the end: [-2] the empty context, [-1] what isn't there.
    alpha = np.zeros((len(keys) + 2, len(languages)))
    gamma = np.ones((len(keys) + 2, len(languages)))
    for k, (word, hashes, reach, first, before, times) in enumerate(tables):
        longer = None
        for n in range(ORDER, 0, -1):
            use = reach[n - 1] & ~first
            if n == ORDER:
                gram, one = np.unique(hashes[n - 1][use], return_inverse=True)
                count = np.bincount(one, times[word[use]], len(gram))
                holder = np.zeros(len(gram), np.uint64)
                holder[one] = before[n - 2][use]
            else:
                # Kneser-Ney: an n-gram counts by how many characters precede it; at a word's start, by words.
                starts = reach[n - 1] & ~reach[n] & ~first
                gram, one = np.unique(hashes[n - 1][use], return_inverse=True)
                count = np.zeros(len(gram))
                if len(longer):
                    count += np.bincount(np.searchsorted(gram, longer), minlength=len(gram))
                if starts.any():
                    count += np.bincount(np.searchsorted(gram, hashes[n - 1][starts]), times[word[starts]], len(gram))
                holder = np.zeros(len(gram), np.uint64)
                if n > 1:
                    holder[one] = before[n - 2][use]
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
            context, which = np.unique(holder, return_inverse=True)
            total = np.bincount(which, count)
            kinds = np.bincount(which)
            alpha[np.searchsorted(keys, gram), k] = np.maximum(count - discount, 0) / total[which]
            weight = discount * kinds / total
            if n == 1:
                gamma[-2, k] = weight[0] if len(weight) else 1
            else:
                gamma[np.searchsorted(keys, context), k] = np.minimum(weight, 1)
            # For the order below: the n-1-gram that each distinct n-gram ends with.
            if n > 1:
                shorter = np.zeros(len(gram), np.uint64)
                shorter[one] = hashes[n - 2][use]
                longer = shorter
    return Model(languages, keys, alpha, gamma, 1.0 / (characters + 1))


class Scorer:
    """Losses of whole texts; short words are remembered, in a table that grows as they come."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages) + 1))

    def forget(self, kept: int = 0) -> None:
        self.row = dict(islice(self.row.items(), kept))
        self.table = self.table[: len(self.row) + 1024].copy()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """For each text its loss in each language, and at the end its predicted characters (0: no letter)."""
        counted = [Counter(t.split()) if t else Counter() for t in texts]
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, c in enumerate(counted):
            if long := [w for w in c if len(w) > SHORT]:
                out[i] = self._once([(w, c.pop(w)) for w in long])
        return out + self._short(counted)

    def _short(self, counted: list[Counter]) -> np.ndarray:
        new = list(dict.fromkeys([w for c in counted for w in c if w not in self.row]))
        if len(self.row) + len(new) > MEMORY:
            self.forget(KEPT_WORDS)
            new = list(dict.fromkeys([w for c in counted for w in c if w not in self.row]))
            if len(self.row) + len(new) > MEMORY:
                return np.concatenate([self._short(counted[: len(counted) // 2]), self._short(counted[len(counted) // 2 :])]) if len(counted) > 1 else self._once(list(counted[0].items()))[None]
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            rows = np.arange(len(self.row), len(self.row) + len(part))
            if rows[-1] >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(part)), self.table.shape[1]))])
            self.table[rows] = self._losses(part)
            self.row.update(zip(part, rows.tolist(), strict=True))
        out = np.zeros((len(counted), self.table.shape[1]))
        for i, c in enumerate(counted):
            if c:
                out[i] = np.fromiter(c.values(), float, len(c)) @ self.table[[self.row[w] for w in c]]
        return out

    def _once(self, items: list[tuple[str, int]]) -> np.ndarray:
        """Words with their numbers, that are not remembered: some characters at a time."""
        out, part, size = np.zeros(self.table.shape[1]), [], 0
        for n, (w, times) in enumerate(items):
            part.append((w, times))
            size += len(w)
            if size > 1 << 16 or n == len(items) - 1:
                out += np.array([k for _, k in part], float) @ self._losses([x for x, _ in part])
                part, size = [], 0
        return out

    def _losses(self, tokens: list[str]) -> np.ndarray:
        runs = [letters(t) for t in tokens]
        loss, size = self.model.words([w for r in runs for w in r])
        token = np.repeat(np.arange(len(tokens)), [len(r) for r in runs])
        out = np.zeros((len(tokens), loss.shape[1] + 1))
        np.add.at(out, token, np.column_stack([loss, size]))
        return out


def choose(model: Model, losses: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy and acceptance of each text."""
    size = losses[:, -1]
    if not model.languages:
        return ["und"] * len(losses), np.zeros(len(losses)), np.zeros(len(losses)), np.zeros(len(losses), bool)
    mean = losses[:, :-1] / np.maximum(size, 1)[:, None]
    best = mean.argmin(1)
    # The longer a text, the surer: its evidence grows as the root of its length, as its characters depend on each other.
    z = -(mean - mean.min(1, keepdims=True)) * np.sqrt(size)[:, None] * model.temperature
    score = np.where(size > 0, 1 / np.exp(z).sum(1), 0.0)
    entropy = mean.min(1)
    found = [model.languages[k] if n else "und" for k, n in zip(best, size, strict=True)]
    return found, score, entropy, (size > 0) & (entropy <= model.limit) & (score >= 0.5)


def draw(docs: DataFrame, each: int = DOCS_A_LANGUAGE, chars: int = CHARS, languages: int = LANGUAGES) -> list:
    """About ``each`` documents (text, lang) a language at most, by a hash of doc_id: what the driver learns from.

    Languages are counted over all documents, then each row is kept or not by itself, so that no language's rows meet in one task."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= chars))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * each / n)))])
    h = F.xxhash64(F.lit("language"), "doc_id")
    kept = usable.filter(F.pmod(h, F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text", h.alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= each).drop("rank").collect()


def learn(docs: DataFrame, each: int = DOCS_A_LANGUAGE, chars: int = CHARS) -> Model:
    """A model of docs (doc_id, text, lang); a quarter of the drawn documents calibrates the scores and the rejection."""
    rows = draw(docs, each, chars)
    held = [r for i, r in enumerate(sorted(rows, key=lambda r: r["h"])) if i % 4 == 3]
    seen = {id(r) for r in held}
    texts: dict[str, list[str]] = {r["lang"]: [] for r in rows}
    for r in rows:
        if id(r) not in seen:
            texts[r["lang"]].append(r["text"])
    for r in rows:  # a language with few documents is learned from all of them
        if not texts[r["lang"]]:
            texts[r["lang"]].append(r["text"])
    model = fit(texts)
    losses = Scorer(model)([r["text"] for r in held]) if held and model.languages else np.zeros((0, 1))
    losses, right = losses[losses[:, -1] > 0], np.array([model.languages.index(r["lang"]) for r, l in zip(held, losses, strict=True) if l[-1] > 0], int)
    if len(losses):
        mean = losses[:, :-1] / losses[:, -1:]
        own = mean[np.arange(len(right)), right]

        def log_loss(t: float) -> float:
            z = -(mean - mean.min(1, keepdims=True)) * np.sqrt(losses[:, -1:]) * t
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(right)), right]).mean())

        model.temperature = min((0.1 * 1.5**k for k in range(14)), key=log_loss)
        model.limit = float(np.quantile(own, KEPT)) * 1.05
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted of every whole text of docs (doc_id, text).

    Texts that are null or have no letter are ``und`` with score 0; so is every text if no language was
    learned. ``accepted`` is false where the text is unlike all languages or between two. Ties go to the
    language first by code point. Rows that repeat count each; an empty table gives an empty result;
    other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = choose(sent.value, score(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found[0], pa.string()), *(pa.array(x) for x in found[1:])], names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, accepted boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from documents of the folds other than 1 of 3."""
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
