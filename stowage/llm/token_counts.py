"""Greedy word-piece counts by a linear longest-match automaton (Song et al., 2021), without building pieces.

The vocabulary is a trie over bytes. Each node has a failure link and the number of tokens popped on following it, so a word's greedy
longest-match count is read off in one pass over its bytes, however long it is.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm import common as C

#: Words a worker remembers, of less than 64 characters each: about 40 MB.
MEMO = 150_000
_NONE = -1


class LongestMatch:
    """start: what a word begins with in the vocabulary; pieces after the first have no such mark."""

    def __init__(self, vocabulary: list[bytes], start: bytes = b" "):
        self.start, self.child, token, above = start, {}, [False], [(0, 0)]
        for word in vocabulary:
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(token)
                    token.append(False)
                    above.append((node, b))
                node = self.child[key]
            token[node] = node > 0
        below: list[list[int]] = [[] for _ in token]
        for node in range(1, len(token)):
            below[above[node][0]].append(node)
        self.link, self.pops = [_NONE] * len(token), [0] * len(token)
        queue = deque(below[0])
        while queue:
            v = queue.popleft()
            queue.extend(below[v])
            if token[v]:
                self.link[v], self.pops[v] = 0, 1
                continue
            u, b = above[v]
            n, z = self.pops[u], self.link[u]
            while z != _NONE and z << 8 | b not in self.child:
                n, z = n + self.pops[z], self.link[z]
            if z != _NONE:
                self.link[v], self.pops[v] = self.child[z << 8 | b], n

    def count(self, word: str) -> tuple[int, int]:
        """(tokens, unknown words): a word that can't be matched to its end counts as one token and one unknown word."""
        node, n, child, link, pops = 0, 0, self.child, self.link, self.pops
        for b in self.start + word.encode("utf-8", "surrogatepass"):
            while (to := child.get(node << 8 | b, _NONE)) == _NONE:
                if link[node] == _NONE:
                    return 1, 1
                n += pops[node]
                node = link[node]
            node = to
        while node:
            if link[node] == _NONE:
                return 1, 1
            n += pops[node]
            node = link[node]
        return n, 0


def byte_vocabulary(path: str) -> list[bytes]:
    """The ordinary tokens of a byte-level tokenizer file as bytes; its printable stand-ins follow from the rule of byte-level BPE."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in kept]
    back = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [bytes(back[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > MEMO:
            self.clear()
        found = self.automaton.count(word)
        if len(word) < 64:
            self[word] = found
        return found


_MEMOS: dict = {}


def token_counts(docs: DataFrame, vocabulary: list[bytes], start: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown. Words are runs of anything but ASCII blanks (x20, x09-x0D).

    Null, empty and blank texts have no words and no tokens. Repeated rows and null ids keep a row each; extra columns are ignored. The
    vocabulary goes to the tasks as it is: its size is that of a tokenizer file.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, start))
    blanks = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (len(sent.value[0]), hash(tuple(sent.value[0])), sent.value[1])
        if key not in _MEMOS:
            _MEMOS[key] = _Memo(LongestMatch(*sent.value))
        memo = _MEMOS[key]
        for batch in C.parts(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                found = [memo[w] for w in (text or "").translate(blanks).split(" ") if w]
                rows.append((len(found), sum(f[0] for f in found), sum(f[1] for f in found)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
