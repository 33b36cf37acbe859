"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector is shared by all grades and the thresholds between them are ordered: P(grade > j) is the sigmoid of
the text's score less threshold j. A score thus gives the expected grade and the probability of every tail, by which
documents are selected. Text is hashed: distinct words, their beginnings and endings, and a few traits of the whole.
The model is fitted on a bounded sample of rated documents; scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .toxicity import held_out, labelled_sample

#: Rated documents to learn from at most, hashed features, rounds over the sample, rows of a step, pull towards 0.
MAX_RATED, FEATURES, EPOCHS, STEP_ROWS, RIDGE = 8_000, 1 << 15, 30, 64, 1e-5
#: Bytes of their features that the driver takes at most; parts of one in a weight as whole number.
MAX_BYTES, UNIT = 128 << 20, 1 << 32
#: Slots at the end of the features for the traits of a whole text, each in so many degrees.
DEGREES = 12
UPPER, LOWER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&|<>"
N_TRAITS = 6


def slots_of_word(word: bytes) -> tuple[int, ...]:
    w = word.lower()
    return tuple(xxhash.xxh32_intdigest(x) % FEATURES for x in (b"w" + w, b"b" + w[:5], b"e" + w[-3:], b"s" + bytes(sorted(set(w) & set(b"#*$%&|<>@=!?0")))))


def traits(raw: bytes, n_words: int, n_distinct: int) -> list[int]:
    """One slot for each trait: length, variety, capitals, symbols, repeated lines, word length."""
    n, size, lines = max(1, n_words), max(1, len(raw)), raw.split(b"\n")
    upper, lower, symbols = (len(raw) - len(raw.translate(None, x)) for x in (UPPER, LOWER, SYMBOLS))
    degrees = (math.log2(n), 12 * n_distinct / n, 12 * upper / max(1, upper + lower), 60 * symbols / size, 12 * (1 - len(set(lines)) / len(lines)), size / n)
    return [FEATURES + DEGREES * i + min(DEGREES - 1, int(x)) for i, x in enumerate(degrees)]


@dataclass
class OrdinalModel:
    weights: np.ndarray  # hashed features, then traits
    thresholds: np.ndarray  # in order, one less than grades

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """(n, grades - 1): P(grade > j)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -50, 50)))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row: doc_id, held_out, expected_grade, tails (array: P(grade > j) for each j). Null and empty texts
        are scored as texts without words; null ids stay; very long texts are read whole; repeated rows give repeated
        results; an empty table gives an empty one. Further columns of any name are not looked at and not returned."""
        chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        sent = docs.sparkSession.sparkContext.broadcast(self)  # of a fixed size

        def run(batches: Iterator[pa.RecordBatch]):
            model = sent.value
            # In whole numbers, so that sums do not depend on the order of words.
            fixed = np.round(model.weights.astype(float) * UNIT).astype(np.int64).tolist()
            memo = common.Memo(lambda word: sum([fixed[s] for s in slots_of_word(word)]))
            schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("tails", pa.list_(pa.float64()))])
            for batch in common.sliced(batches):
                said = common.Words.of(batch.column(1))
                own = said.once()
                scores = own.sums(said.each(memo)[own.index]) / UNIT / np.sqrt(np.maximum(1, own.n))
                raw = pc.fill_null(batch.column(1), "").cast(pa.large_binary()).to_pylist()
                whole = [sum([fixed[s] for s in traits(x, *n)]) for x, *n in zip(raw, said.n.tolist(), own.n.tolist(), strict=True)]
                tails = model.tails(scores + np.array(whole, np.int64) / UNIT)
                yield common.record_batch(schema, batch.column(0), tails.sum(axis=1), tails.tolist())

        scored = chosen.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")
        return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tails")


def _rows(sample: DataFrame) -> DataFrame:
    """label and the features' slots and values, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        memo = common.Memo(slots_of_word)
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("slots", pa.binary()), ("values", pa.binary())])
        for batch in common.sliced(batches):
            slots, values = [], []
            for text in batch.column(2).to_pylist():
                raw = (text or "").encode("utf-8", "replace")
                words = raw.split()
                own = set(words)
                where, times = np.unique(np.array([s for w in own for s in memo[w]], np.int32), return_counts=True)
                whole = np.array(traits(raw, len(words), len(own)), np.int32)
                slots.append(np.concatenate([where, whole]).tobytes())
                values.append(np.concatenate([times / max(1, len(own)) ** 0.5, np.ones(len(whole))]).astype(np.float32).tobytes())
            yield common.record_batch(schema, batch.column(0), batch.column(1), slots, values)

    return sample.select("doc_id", F.col("label").cast("long"), "text").mapInArrow(run, "doc_id long, label long, slots binary, values binary")


def loss_slopes(scores: np.ndarray, theta: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the negative log likelihood of its grade, its slope by the score and its slopes by the thresholds."""
    above = 1 / (1 + np.exp(-np.clip(scores[:, None] - theta, -30, 30)))  # P(grade > j)
    edge = np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1)
    n, slope = np.arange(len(scores)), edge * (1 - edge)
    p = np.maximum(edge[n, grades] - edge[n, grades + 1], 1e-9)
    by_theta = np.zeros_like(edge)
    by_theta[n, grades] += slope[n, grades] / p
    by_theta[n, grades + 1] -= slope[n, grades + 1] / p
    by_theta = by_theta[:, 1:-1]
    return -np.log(p), -by_theta.sum(axis=1), by_theta


def fit_rows(slots: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int, seed: int = 5) -> OrdinalModel:
    """Adaptive gradient steps on the likelihood of cumulative links; thresholds stay in order as sums of exponentials."""
    share = np.array([np.mean(grades > j) if len(grades) else 0.5 for j in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    first, gaps = start[:1].copy(), np.log(np.maximum(np.diff(start), 1e-2))
    weights = np.zeros(FEATURES + DEGREES * N_TRAITS)
    seen_w, seen_f, seen_g = np.full(len(weights), 1e-6), np.full(1, 1e-2), np.full(len(gaps), 1e-2)
    random = np.random.default_rng(seed)
    for epoch in range(EPOCHS if len(grades) else 0):
        order, pace = random.permutation(len(grades)), 0.1 / (1 + epoch / 10)
        for at in range(0, len(order), STEP_ROWS):
            rows = order[at : at + STEP_ROWS]
            where, value = np.concatenate([slots[i] for i in rows]), np.concatenate([values[i] for i in rows])
            starts = np.cumsum([0] + [len(slots[i]) for i in rows[:-1]])
            theta = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            _, by_score, by_theta = loss_slopes(np.add.reduceat(weights[where] * value, starts), theta, grades[rows])
            g = np.bincount(where, np.repeat(by_score, np.diff([*starts, len(where)])) * value, len(weights)) / len(rows) + RIDGE * weights
            seen_w += g * g
            weights -= pace * g / np.sqrt(seen_w)
            t = by_theta.mean(axis=0)
            for parameter, seen, step in ((first, seen_f, np.array([t.sum()])), (gaps, seen_g, np.cumsum(t[::-1])[::-1][1:] * np.exp(gaps))):
                seen += step * step
                parameter -= pace * step / np.sqrt(seen)
    return OrdinalModel(weights.astype(np.float32), first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED, max_bytes: int = MAX_BYTES) -> OrdinalModel:
    """Learn grades 0 .. n_grades - 1, a column over `ratings` (doc_id and more), from at most about `max_rated` rated
    documents that are not held out, and in the order of a hash of the id as many of them as have features of at most
    `max_bytes`: so much the driver holds. Without any, all weights are 0. Null and empty texts count as texts without
    words; very long ones are read whole; for repeated ids see `labelled_sample`; further columns are not looked at."""
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    rows = common.saved(_rows(labelled_sample(chosen, ratings, grade, max_rated)))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")  # about max_rated narrow rows
    fitting = rows.select("doc_id", F.sum(F.length("slots") + F.length("values")).over(order).alias("so_far")).where(F.col("so_far") <= max_bytes)
    rows = rows.join(fitting, "doc_id", "left_semi").collect()  # at most max_bytes
    rows.sort(key=lambda r: r["doc_id"])
    slots, values = [np.frombuffer(r["slots"], np.int32) for r in rows], [np.frombuffer(r["values"], np.float32) for r in rows]
    return fit_rows(slots, values, np.array([r["label"] for r in rows], np.int64), n_grades)
