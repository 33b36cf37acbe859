"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, from left to right, the longest vocabulary piece that the rest of a word begins
with. Trying lengths from long to short is quadratic in a word. The automaton is a trie of the pieces in which every
node also has a failure link and the number of pieces that are complete when the link is taken (both found once, in
breadth-first order). A word is then read once, and its pieces are counted without being built.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: A vocabulary over this many pieces is refused: the automaton is sent to every worker.
MAX_PIECES = 1_000_000
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pieces", pa.int64()), ("longest_word_pieces", pa.int64())])


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file as the bytes they stand for.

    Such files write each byte as one printable character: printable Latin-1 bytes as themselves, the other bytes as
    the code points from 256 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [bytes(byte[c] for c in p) for p in pieces if all(c in byte for c in p)]


class PieceCounter:
    """Counts greedy longest-match pieces of a byte string; 1 (unknown) if some part matches no piece."""

    def __init__(self, pieces: list[bytes]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are allowed")
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (next_node := self.child.get(key)) is None:
                    next_node = self.child[key] = len(whole)
                    whole.append(False)
                node = next_node
            whole[node] = bool(piece)
        # A node is numbered after its parent, but not in order of depth.
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, node))
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for byte, node in below.get(parent, ()):
                    deeper.append(node)
                    if whole[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    at, popped = self.fail[parent], self.popped[parent]
                    while at >= 0 and (to := self.child.get(at << 8 | byte)) is None:
                        at, popped = self.fail[at], popped + self.popped[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = to, popped
            level = deeper

    def __call__(self, word: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                if (link := fail[node]) < 0:
                    return 1
                count += popped[node]
                node = link
            node = to
        while node:
            if (link := fail[node]) < 0:
                return 1
            count += popped[node]
            node = link
        return count


def count_pieces(docs: DataFrame, pieces: list[bytes], word_start: bytes = b" ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id (nulls stay), number of words, greedy pieces over all words, and the most pieces of one word.

    Each word is read with `word_start` before it, so pieces that begin with it can only start a word. Letters keep
    their case. Null, empty and blank texts have 0 words and 0 pieces; very long texts and words are read whole, in time
    in proportion to their length. Rows are counted one by one without a shuffle: repeated rows give repeated results
    and an empty table an empty one. Further columns of any name are not looked at and not returned. Workers remember
    words up to a fixed number.
    """
    counter = PieceCounter(pieces)
    sent = docs.sparkSession.sparkContext.broadcast(counter)  # at most MAX_PIECES pieces

    def run(batches):
        count = sent.value
        memo = common.Memo(lambda word: count(word_start + word))
        for batch in common.sliced(batches):
            said = common.Words.of(batch.column(1))
            per_word, most, some = said.each(memo)[said.index], np.zeros(len(said), np.int64), said.n > 0
            if some.any():
                most[some] = np.maximum.reduceat(per_word, said.starts[:-1][some])
            yield common.record_batch(COUNTS, batch.column(0), said.n, said.sums(per_word), most)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_words long, n_pieces long, longest_word_pieces long")
