"""Hierarchical packing of tokenised documents into sequences of several context sizes.

Every document is cut into windows of the longest tier. What is left over is routed to the shortest tier that holds
it. Tiers are packed one after the other, the longest first: a window of the tier begins with its longest rest, and the
gap is filled from this tier and the shorter ones, best fit first; where nothing fits, a rest is cut, so every window
is full. The few tokens left at the end of a task become sequences whose lengths are powers of two.

Tokenising and packing happen where the documents are read; a task keeps one pool of rests per tier, and a hot source
or a very long document has no effect on the others. The pieces are then saved, sequences of each length are numbered
over all tasks from their counts, and are dealt by number to step groups that differ by one sequence at most.
"""

from __future__ import annotations

from base64 import b64decode
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Context sizes, longest last; each is a power of two, so full sequences of any tier need no padding.
TIERS = (64, 128, 256, 512, 1024)
#: Tokens that a step group holds, rests kept in the pools of a task, shortest piece cut on purpose.
STEP_TOKENS, POOL, LEAST_PIECE = 64 * 1024, 1024, 16
#: Bits of a sequence id under the number of its task.
TASK_BITS = 33

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, nth long"


class Tokens:
    """Token ids of texts by a byte-level vocabulary, special tokens of the text included, then an end id.

    The vocabulary comes twice: as ranks for a fast encoder, and as the file of the encoder whose ids are wanted. The
    fast one gives the same ids but refuses texts with a run of blanks of about a million; these go to the other."""

    def __init__(self, ranks_file: bytes, pattern: str, special: dict[str, int], end_id: int, whole_file: str):
        self.settings, self.end_id = (ranks_file, pattern, special, whole_file), end_id

    def start(self):
        import tiktoken
        from tokenizers import Tokenizer

        ranks_file, pattern, special, whole_file = self.settings
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        end = np.array([self.end_id], np.uint32)

        def encode(text: str | None) -> np.ndarray:
            if not text:
                return end
            try:
                ids = fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                ids = np.array(Tokenizer.from_str(whole_file).encode(text, add_special_tokens=False).ids, np.uint32)
            return np.concatenate([ids, end])

        return encode


class Packer:
    """Packs the documents of one task; rows come out as their sequences are complete."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.longest, self.base = tiers, tiers[-1], task << TASK_BITS
        #: By tier its rests (length, serial number, doc_id, start, ids, doc_tokens), by length.
        self.pools: dict[int, list[tuple]] = {tier: [] for tier in tiers}
        self.total = self.serial = self.rests = 0
        self.sequences: dict[int, int] = {}  # made so far, by length
        self.rows: list[tuple] = []

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.longest
        for at in range(0, whole, self.longest):
            self._close(self.longest, [(self.longest, 0, doc_id, at, ids[at : at + self.longest], len(ids))])
        if whole < len(ids):
            self._keep(doc_id, whole, ids[whole:].copy(), len(ids))
        if self.rests >= POOL:
            self._pack(2 * self.longest)

    def finish(self) -> None:
        self._pack(1)

    def _pack(self, least: int) -> None:
        """Pack tier after tier while `least` tokens are there."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and self.total >= least:
                self._window(tier)

    def _keep(self, doc_id, start, ids, doc_tokens) -> None:
        self.serial += 1
        self.rests += 1
        self.total += len(ids)
        insort(self.pools[self.tier(len(ids))], (len(ids), self.serial, doc_id, start, ids, doc_tokens), key=lambda x: x[:2])

    def _take(self, tier: int, index: int) -> tuple:
        piece = self.pools[tier].pop(index)
        self.rests -= 1
        self.total -= piece[0]
        return piece

    def _fitting(self, gap: int) -> tuple[int, int] | None:
        """Where the longest rest of at most `gap` tokens is: in the gap's tier or a shorter one."""
        for tier in reversed([t for t in self.tiers if t <= self.tier(gap)]):
            if (at := bisect_left(self.pools[tier], gap + 1, key=lambda x: x[0])) > 0:
                return tier, at - 1
        return None

    def _longer(self, length: int) -> tuple[int, int] | None:
        """Where the shortest rest of at least `length` tokens is."""
        for tier in (t for t in self.tiers if t >= min(length, self.longest)):
            if (at := bisect_left(self.pools[tier], length, key=lambda x: x[0])) < len(self.pools[tier]):
                return tier, at
        return None

    def _window(self, tier: int) -> None:
        size = min(tier, 1 << self.total.bit_length() - 1)  # less than a tier only at the end of the task
        pieces, gap = [], size
        while gap:
            at = (tier, len(self.pools[tier]) - 1) if not pieces and self.pools[tier][-1][0] <= gap else self._fitting(gap)
            left = gap - self.pools[at[0]][at[1]][0] if at else gap
            if at and (left >= LEAST_PIECE or left == 0):
                pieces.append(self._take(*at))
            else:
                # One fits and leaves little, or none fits: a longer one is cut, the fitting one if there is none.
                at = self._longer(gap + LEAST_PIECE) or at or self._longer(gap)
                _, _, doc_id, start, ids, doc_tokens = self._take(*at)
                pieces.append((min(gap, len(ids)), 0, doc_id, start, ids[:gap], doc_tokens))
                if len(ids) > gap:
                    self._keep(doc_id, start + gap, ids[gap:], doc_tokens)
            gap -= pieces[-1][0]
        self._close(size, pieces)

    def _close(self, size: int, pieces: list[tuple]) -> None:
        sequence, offset, nth = self.base + sum(self.sequences.values()), 0, self.sequences.get(size, 0)
        self.sequences[size] = nth + 1
        for length, _, doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, length, ids.tobytes(), doc_tokens, sequence, offset, size, nth))
            offset += length


def pack(docs: DataFrame, tokens: Tokens, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start and length in its document, its `ids` (little-endian 32-bit numbers), the
    document's tokens, sequence_id, offset in the sequence, the sequence's length and its step group.

    Null and empty texts are documents of the end id alone; null ids stay; very long texts are encoded whole and cut in
    windows; repeated rows are packed as often as they come; an empty table gives an empty result. Further columns of
    any name are not looked at and not returned. Each token is in one piece. Sequences have a tier's length, but for
    those made of the last tokens of a task, which have shorter powers of two. A step group has sequences of one
    length; groups of a length differ by one sequence at most. A task that runs again on the same rows gives the same
    pieces.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokens)  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]):
        packer = Packer(TaskContext.get().partitionId())
        encode = sent.value.start()

        def ready(least: int):
            while len(packer.rows) >= least:
                now, packer.rows = packer.rows[:2000], packer.rows[2000:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*now, strict=True), PIECES, strict=True)], schema=PIECES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), encode(text.as_py()))
                if len(packer.rows) >= 2000:
                    yield from ready(2000)
        packer.finish()
        yield from ready(1)
        common.freed()

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return in_step_groups(common.saved(chosen.mapInArrow(run, PIECES_DDL)))


def in_step_groups(packed: DataFrame) -> DataFrame:
    """With `step_id` in the place of `nth`: sequences of a length are numbered over all tasks and cut in groups of
    about STEP_TOKENS tokens, at equal distances."""
    length, task = F.col("sequence_length"), F.shiftright("sequence_id", TASK_BITS)
    counts = packed.groupBy(task.alias("task"), length).agg((F.max("nth") + 1).alias("n"))
    of_length = Window.partitionBy("sequence_length")  # a row per task
    before = F.sum("n").over(of_length.orderBy("task")) - F.col("n")
    counts = common.saved(counts.select("task", "sequence_length", before.alias("before"), F.sum("n").over(of_length).alias("all")))
    numbered = packed.withColumn("task", task).join(common.small(counts, counts.count(), 32), ["task", "sequence_length"])
    groups = F.ceil(F.col("all") * length / STEP_TOKENS)
    group = F.floor((F.col("before") + F.col("nth")) * groups / F.col("all"))
    step = group * 64 + F.log2(length).cast("int")  # unique over lengths, which are powers of two
    return numbered.select(*PIECES.names[:-1], step.cast("long").alias("step_id"))


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence: its step group, length and token ids in order, joined to one binary."""
    joined = "aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (all, x) -> concat(all, x.ids))"
    return packed.groupBy("sequence_id", "step_id", "sequence_length").agg(F.expr(joined).alias("ids"))
