"""Spelling variants: words that differ by one inserted, deleted or replaced letter, by a dictionary of trie-node pairs.

Every prefix of a word is a node of a trie, every suffix one of the trie of reversed words. A node's number is a 64-bit
hash of its path, so tasks number the same node alike without meeting. A word of m letters gives the pairs (prefix node
before i, suffix node after i), its letter i skipped, and the pairs (prefix node before i, suffix node at i), nothing
skipped. Two words are near exactly if they share a skipped pair, or if one's skipped pair is the other's whole pair: a
letter is inserted there. Each pair carries a second hash of both paths, so a false neighbour would need two nodes that
agree on 128 bits.

A pair belongs to one string with at most one place open, so at most as many words share it as there are letters, and
one whole word with them: no group grows with the data, whatever the words. Rows hold the word's place in code-point
order in its stead, so they have a fixed size also for very long words, and ties between equal counts are ties of numbers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What a word is; runs whose hash it divides lose a letter; least length and count; a form's least share.
RUN, DIVISOR = re.compile("[a-zÀ-ÿ]+"), 97
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

PAIRS = pa.schema([("prefix", pa.int64()), ("suffix", pa.int64()), ("mark", pa.int64()), ("whole", pa.bool_()), ("opens", pa.bool_()), ("place", pa.int64()), ("n", pa.int64())])


def spoilt(run: str, doc_id: int | None) -> str:
    """The run without one letter if the hash of id and run says so; a null id spoils nothing."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % DIVISOR else run[: (i := h % len(run))] + run[i + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over whole texts: runs of letters in lower case, some of them spoilt, of the least length and count. A
    task counts its texts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        for batch in common.sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(RUN.findall(text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER))).items():
                    if start is not None and zlib.crc32(word.encode(), start) % DIVISOR == 0:
                        word = spoilt(word, doc)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
        yield out()

    parts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def placed(words: DataFrame) -> DataFrame:
    """(word, n, place): the place in code-point order from 0. Spark sorts by ranges; a range's place is the number of
    words in those before it, one row a range."""
    ranged = common.saved(words.repartitionByRange("word").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("word"))
    return common.saved(ranged.withColumn("r", within).join(F.broadcast(before), "part").select("word", "n", (F.col("before") + F.col("r") - 1).alias("place")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def nodes(letters: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of the trie nodes on the words' paths, roots included: word i, whose letters begin at starts[i], has its
    nodes from starts[i] + i on. All words take a step down the trie at once."""
    lengths, n = np.diff(starts), len(starts) - 1
    out = np.empty(len(letters) + n, np.uint64)
    first = starts[:-1] + np.arange(n)
    state = np.full(n, seed, np.uint64)
    out[first] = state
    by_length = np.argsort(-lengths, kind="stable")
    going = np.searchsorted(-lengths[by_length], -np.arange(lengths.max(initial=0)), "left")
    for depth, m in enumerate(going.tolist()):
        own = by_length[:m]
        state[own] = _mixed(state[own] * np.uint64(0x9E3779B97F4A7C15) + letters[starts[own] + depth].astype(np.uint64) + np.uint64(seed))
        out[first[own] + depth + 1] = state[own]
    return out


def node_pairs(words: list[str], place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """All skipped and whole pairs of the words. Skipping any letter of a run of one letter spells the same shorter word;
    `opens` marks the first of them, the one to meet a whole word."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    lengths = np.diff(starts)
    of = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(letters)) - starts[of]
    back = letters[starts[of] + lengths[of] - 1 - at]
    before = np.arange(len(letters)) + of  # the prefix node before each letter
    rest = starts[of] + of + lengths[of] - at  # the node of the suffix from each letter on, in the trie of reversed words
    last = starts[1:] + np.arange(len(words))
    end = starts[:-1] + np.arange(len(words))
    columns = []
    for seed in (1, 2):
        prefix, suffix = nodes(letters, starts, 2 * seed), nodes(back, starts, 2 * seed + 1)
        skipped = prefix[before], suffix[rest - 1]
        whole = np.concatenate([prefix[before], prefix[last]]), np.concatenate([suffix[rest], suffix[end]])
        columns.append(tuple(np.concatenate(x) for x in zip(skipped, whole, strict=True)))
    (prefix, suffix), (other, another) = columns
    owner = np.concatenate([of, of, np.arange(len(words))])
    is_whole = np.arange(len(owner)) >= len(of)
    opens = np.concatenate([(at == 0) | (letters != np.roll(letters, 1)), np.zeros(len(owner) - len(of), bool)])
    mark = _mixed(other * np.uint64(0x9E3779B97F4A7C15) + another)
    signed = lambda x: x.view(np.int64)
    return common.record_batch(PAIRS, signed(prefix), signed(suffix), signed(mark), is_whole, opens, place[owner], n[owner])


def pairs(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in common.sliced(batches):
            if batch.num_rows:
                yield node_pairs(batch.column(0).to_pylist(), np.asarray(batch.column(1), np.int64), np.asarray(batch.column(2), np.int64))

    return words.select("word", "place", "n").mapInArrow(run, "prefix long, suffix long, mark long, whole boolean, opens boolean, place long, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(place, n_near, best_n, best_place) of words that have near ones. Of the words of a pair, each with it skipped is
    near all others that skip it; the whole word is near those whose skipped letter begins a run. So two words meet in
    one pair only. Each member of a pair gives one row, with how many it is near there and the best of them."""
    member = F.struct("n", (-F.col("place")).alias("minus"), "whole", "opens")
    met = pairs(words).groupBy("prefix", "suffix", "mark").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)  # as many as letters, and one
    is_near = lambda b: (b["minus"] != F.col("a.minus")) & F.when(F.col("a.whole"), b["opens"]).when(b["whole"], F.col("a.opens")).otherwise(True)
    each = met.select(F.explode("m").alias("a"), "m").select((-F.col("a.minus")).alias("place"), F.filter("m", is_near).alias("near")).where(F.size("near") > 0)
    best = F.max("best").alias("best")
    found = each.select("place", F.size("near").cast("long").alias("k"), F.array_max("near").alias("best")).groupBy("place").agg(F.sum("k").alias("n_near"), best)
    return found.select("place", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.minus")).alias("best_place"))


def roots(forms: DataFrame) -> DataFrame:
    """(place, root) of the words that have a form, from (place, up). A form's count is at least twice as large, so paths
    end after as many steps as a count has bits; each round doubles the steps."""
    paths = common.saved(forms.select("place", F.col("up").alias("root")))
    while True:
        further = common.saved(paths.join(paths.select(F.col("place").alias("root"), F.col("root").alias("top")), "root", "left").select("place", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        paths = further.select("place", "root")
        if further.where("moved").isEmpty():
            return paths


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word that is long and frequent enough.

    Null and empty texts have no words; very long texts and words are read whole; repeated rows count again; rows with a
    null id count, unspoilt; an empty table gives an empty one; further columns are not looked at. Of near words with the
    same count the first in code-point order is the form."""
    words = placed(word_counts(docs, id_col, text_col))
    near = common.saved(near_words(words))
    forms = near.join(words.select("place", "n"), "place").where(F.col("best_n") >= FORM_TIMES * F.col("n")).select("place", F.col("best_place").alias("up"), F.col("best_n").alias("form_n"))
    forms = common.saved(forms)
    joined = words.join(near.select("place", "n_near"), "place", "left").join(forms, "place", "left").join(roots(forms), "place", "left")
    spelt = lambda name: words.select(F.col("place").alias(name), F.col("word").alias(f"{name}_word"))
    named = joined.join(spelt("up"), "up", "left").join(spelt("root"), "root", "left")
    return named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("up_word").alias("form"), "form_n", F.coalesce("root_word", "word").alias("root"))
