"""SentencePiece BPE encoding by a prefix table.

In a merge encoding the last token of every prefix is unique: of the pieces that end there (found by an
automaton) it is the one whose predecessor, the last token of the prefix before it, stays beside it,
that is, merging the two pieces' characters gives just these two pieces again. One pass stores these
last tokens; ids are recovered backwards from the end. Pieces never hold a space mark after another
character, so a text's words are encoded each by itself and words seen before are looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nestframe.llm.common import read

MARK = "▁"
#: Words and pairs that a task remembers, and how many of them, the first and so the frequent ones, it keeps
#: when these are full and for the next task. Forgetting only costs time.
MEMORY, KEPT, SHORT = 300_000, 60_000, 64


class Encoder:
    """Ids of a SentencePiece BPE model with identity normalisation, a leading space mark and byte fallback."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        sp, size = self.library, self.library.get_piece_size()
        if sp.normalize("Å Å  ﬁ\t") != f"{MARK}Å{MARK}Å{MARK}{MARK}ﬁ\t":
            raise ValueError("only models with identity normalisation and a leading space are handled")
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.chars = {p for p in self.score if len(p) == 1}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if sp.unk_id() in self.byte:
            raise ValueError("only models with byte fallback are handled")
        self.plain = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.words = re.compile(f"(?s){MARK}+[^{MARK}]*" if self.plain else r"(?s).+")
        self.automaton = ahocorasick.Automaton()
        self.own = {}
        for i, p in self.piece.items():
            if self.merges(p)[-1][1] == p:  # others never stand in an encoding
                self.automaton.add_word(p, (len(p), i))
                self.own[p] = (i,)
        self.states: dict[int, list[tuple[float, str, str]]] = {}
        self.automaton.make_automaton()
        self.stays: dict[int, bool] = {}
        self.seen: dict[str, str] = {}

    def merges(self, text: str) -> list[tuple[float, str, str]]:
        """Plain merging of a short text, best score first, leftmost among equals: for each state its
        first and last part, and the score of the merge that leaves it (none: minus infinity)."""
        parts, states = list(text), []
        while True:
            scored = [(self.score.get(a + b), -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best = max((x for x in scored if x[0] is not None), default=None)
            states.append((best[0] if best else -inf, parts[0], parts[-1]))
            if best is None:
                return states
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters never merges across their border.

        Up to there each side merges as it does alone, the better-scored side first, so it is enough to
        walk the two sides' states and compare the parts at the border."""
        known = self.stays.get(left << 32 | right)
        if known is None:
            if len(self.stays) >= MEMORY:
                self.stays.clear()
            a, b = (self.states.get(x) or self.states.setdefault(x, self.merges(self.piece[x])) for x in (left, right))
            i, j, score = 0, 0, self.score
            known = True
            while True:
                (next_a, _, last), (next_b, first, _) = a[i], b[j]
                across = score.get(last + first)
                if across is not None and across > next_a and across >= next_b:
                    known = False
                    break
                if next_a >= next_b:
                    if next_a == -inf:
                        break
                    i += 1
                else:
                    j += 1
            self.stays[left << 32 | right] = known
        return known

    def run(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        stays = self.stays
        for end, token in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - token[0]
                if start == 0:
                    last[end + 1] = token
                elif (before := last[start]) is not None:
                    ok = stays.get(before[1] << 32 | token[1])
                    if ok or ok is None and self.compatible(before[1], token[1]):
                        last[end + 1] = token
        ids, at = [], len(text)
        while at:
            size, token = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def word(self, key: str) -> str:
        """Ids, joined by commas, of the word that begins with a space mark and goes on with ``key``."""
        word = MARK + key
        ids = self.own.get(word)
        if ids is None:
            if self.chars.issuperset(word):
                ids = self.run(word)
            else:
                ids = []
                start = 0
                for k, c in enumerate(word):
                    if c not in self.chars:
                        ids += self.run(word[start:k]) if k > start else []
                        ids += [self.byte[b] for b in c.encode()]
                        start = k + 1
                ids += self.run(word[start:]) if start < len(word) else []
        out = ",".join(map(str, ids))
        if len(key) <= SHORT:
            if len(self.seen) >= MEMORY:
                self.trim()
            self.seen[key] = out
        return out

    def trim(self) -> None:
        self.seen = dict(islice(self.seen.items(), KEPT))

    def joined(self, text: str) -> str:
        """All ids of a text, joined by commas."""
        if not text:
            return ""
        if self.plain and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            keys = text.split(" ")
        else:
            keys = [w[1:] for w in self.words.findall(MARK + text.replace(" ", MARK))]
        word = self.word
        return ",".join([self.seen.get(k) or word(k) for k in keys])

    def encode(self, text: str) -> list[int]:
        return numbers(self.joined(text))


def numbers(joined: str) -> list[int]:
    return np.fromstring(joined, np.int32, sep=",").tolist() if joined else []


_encoders: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The worker's encoder of this model; it is built once a process."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts (columns doc_id and text) of a few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part.column("doc_id"), part.column("text").to_pylist()


def load(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids array<int> of every row's whole text, as the library encodes without begin or end ids.

    The model (under a megabyte) is read by the driver and sent to the tasks. Null and empty texts have
    no ids; rows that repeat are encoded each; an empty table gives an empty result; other columns are
    not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        own = encoder(model.value)
        for ids, rows in texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([own.encode(t or "") for t in rows], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        own.trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids), by the library's decode; null ids give an empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        own = encoder(model.value)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.library.decode(x) if x else "" for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """encode() and decode() in one pass, of which only sizes and digests are kept: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        own = encoder(model.value)
        for doc_ids, rows in texts(batches):
            sizes, of_ids, of_text = [], [], []
            for text in rows:
                joined = own.joined(text or "")
                ids = numbers(joined)
                sizes.append(len(ids))
                of_ids.append(sha(joined))
                of_text.append(sha(own.library.decode(ids) if ids else ""))
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """The columns of docs but ``text``, with n_tokens, ids, and ``whole``: whether the ids decode to the text."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        own = encoder(model.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [t or "" for t in part.column("text").to_pylist()]
                ids = [own.encode(t) for t in rows]
                whole = [own.library.decode(x) == t if x else t == "" for x, t in zip(ids, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(whole)], names=[*kept, "n_tokens", "ids", "whole"])
        own.trim()

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, n_tokens long, ids array<int>, whole boolean")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
