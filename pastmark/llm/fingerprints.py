"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the least `K` of the distinct 64-bit hashes of a document's five-word shingles, in ascending order; with
fewer shingles it is all of them, and what is estimated from it is exact. Below the smaller of two sketches' ends both
sets are known whole, as a random sample of their union; its shares estimate resemblance and containment, and the end
itself the number of distinct shingles. The sketch of a union is the least K of the sketches' hashes, so sketches of
parts are merged without the texts.

`edited` compares each document with an edit of it that needs the next document's text. Documents are dealt to ranges of
their order, so that neighbours meet in one task, sorted by Spark; a range is also sent the one document that its last
one needs. Whole texts are shuffled once and no window holds the table.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .near_dedup import shingle_hashes, word_memo

#: Hashes in a sketch; rows sampled for each bound of a range; parts that a group's hashes are dealt to before they meet.
K, SAMPLED, SALTS = 256, 40, 64

EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("contained_edited", pa.float64()), ("n_shingles", pa.float64())])

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, n_shingles double"


def encoded(sketch: np.ndarray) -> str:
    """A sketch as text; equal sketches have equal texts, and the empty one is ''."""
    return b64encode(sketch.astype(">u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(b64decode(text), ">u8").astype(np.uint64)


def known(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of both sketches up to where both sets are known whole."""
    ends = [s[-1] for s in (a, b) if len(s) >= k]
    if not ends:
        return a, b
    return tuple(s[: np.searchsorted(s, min(ends), "right")] for s in (a, b))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays without repeats have in common."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated size of the intersection over that of the union; 1 for two empty sets, 0 if one is empty."""
    a, b = known(a, b, k)
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of the first set that is in the second; 1 for an empty first one."""
    a, b = known(a, b, k)
    return shared(a, b) / len(a) if len(a) else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles, exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def sketched(texts: pa.Array, memo: common.Memo, k: int = K) -> Iterator[np.ndarray]:
    for hashes in shingle_hashes(texts, memo):
        yield hashes[:k].copy()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, sketch) of every row, hashes as array<long> in ascending unsigned order. Null and empty texts have empty
    sketches; very long texts are read whole; repeated rows and null ids stay; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]):
        memo = word_memo()
        for batch in common.sliced(batches):
            found = [s.view(np.int64) for s in sketched(batch.column(1), memo, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "sketch"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, sketch array<long>")


def merged(parts: DataFrame, by: str, k: int = K) -> DataFrame:
    """(by, sketch): the sketches of a group as that of its union. A group's distinct hashes are dealt to `SALTS` parts,
    each keeps its least k, and only these meet, so no task holds a large group. Groups of empty sketches only have an
    empty one; a null group is a group."""
    order = lambda h: h.bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  unsigned order as a signed number
    hashes = parts.select(F.col(by), F.explode("sketch").alias("h")).distinct().select(by, order(F.col("h")).alias("h"))
    least = lambda rows, *keys: rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("r") <= k).drop("r")
    kept = least(least(hashes.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS))), by, "salt"), by)
    whole = kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("h")), order).alias("sketch"))
    groups = parts.select(F.col(by).alias("g")).distinct()
    return groups.join(whole, groups["g"].eqNullSafe(whole[by]), "left").select(F.col("g").alias(by), F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch"))


def edit(text: str, following: str) -> str:
    """The last half of the code points, rounded down, gives way to the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Edits:
    """Rows wait until the next different document comes; those that repeat it wait with it."""

    def __init__(self, k: int = K):
        self.k, self.memo, self.waiting = k, word_memo(), None

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """From (bucket, turn, foreign, doc_id, o, mark, text) in order: the results of the rows that are ready. Foreign
        rows are only next to others; one with turn 1 is so even if it repeats what waits."""
        ready = []
        own = sketched(batch.column("text"), self.memo, self.k)
        fields = ("bucket", "turn", "foreign", "doc_id", "mark", "text")
        for bucket, turn, foreign, doc, mark, text, sketch in zip(*(batch.column(n).to_pylist() for n in fields), own, strict=True):
            last, key = self.waiting, (bucket, doc, mark)
            if last and last[0] == key and not turn:
                last[1] += not foreign
                continue
            if last and last[1] and last[0][0] == bucket:
                ready.append((last, text, sketch))
            self.waiting = [key, int(not foreign), text, sketch]
        texts = [edit(last[2], text) for last, text, _ in ready]
        out: list[list] = [[] for _ in EDITED]
        for (last, _, next_sketch), text, sketch in zip(ready, texts, sketched(pa.array(texts, pa.string()), self.memo, self.k), strict=True):
            (_, doc, _), n, own_text, own_sketch = last
            row = (doc, len(own_text), hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), encoded(own_sketch), encoded(sketch), resemblance(own_sketch, sketch, self.k), resemblance(own_sketch, next_sketch, self.k), containment(own_sketch, sketch, self.k), distinct(own_sketch, self.k))
            for values, value in zip(out, row, strict=True):
                values += [value] * n
        return common.record_batch(EDITED, *out)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars in code points, SHA-256 of the edited text, both fingerprints, their likeness (estimated
    resemblance), that to the next document, the share of the text's shingles that the edit keeps, and the estimated
    number of shingles.

    The next document is the next different one by descending id, nulls last; texts of one id follow each other by hash;
    after the last comes the first, which is the document itself if there is no other. Rows that repeat both id and text
    are one document here and each get its result. Null texts count as empty; very long ones are read whole; an empty
    table gives an empty one; further columns are not looked at. `parts`: ranges, as many as shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc, text = docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(doc.isNull().cast("int").alias("last"), F.coalesce(F.bitwise_not(doc), F.lit(0)).cast("long").alias("o"), F.xxhash64(text).alias("mark"), doc.alias("doc_id"), text.alias("text"))
    keys = common.saved(rows.select("last", "o", "mark"))
    n = keys.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    # A sample of the keys, bounded by the number of ranges, lays the bounds; a random number splits a key that is repeated often.
    sample = sorted(map(tuple, keys.where(F.rand(5) <= SAMPLED * parts / n).withColumn("salt", F.rand(6)).collect()))
    bounds = [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []
    ends = sorted({b[:3] for b in bounds})

    def range_of(last: pd.Series, o: pd.Series, mark: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, x) for x in zip(last.tolist(), o.tolist(), mark.tolist(), salt.tolist(), strict=True)], dtype="int32")

    def gap_of(last: pd.Series, o: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(ends, x) for x in zip(last.tolist(), o.tolist(), mark.tolist(), strict=True)], dtype="int32")

    # The first key after each bound, and the first of all.
    gaps = keys.select(F.pandas_udf(gap_of, "int")("last", "o", "mark").alias("gap"), F.struct("last", "o", "mark").alias("key"))
    after = {r["gap"]: tuple(r["key"]) for r in gaps.groupBy("gap").agg(F.min("key").alias("key")).collect()}
    first = min(after.values())
    needed = []  # of each range: its end, which its last own row may be before, and what follows the end
    for bucket in range(len(bounds) + 1):
        following = None
        if bucket < len(bounds):
            end = bounds[bucket][:3]
            following = after.get(bisect_left(ends, end) + 1)
            needed.append((bucket, 0, *end))
        needed.append((bucket, 0, *following) if following else (bucket, 1, *first))
    foreign = spark.createDataFrame(needed, "bucket int, turn int, last int, o long, mark long")
    wanted = foreign.select("last", "o", "mark").distinct()
    heads = rows.join(F.broadcast(wanted), ["last", "o", "mark"]).groupBy("last", "o", "mark").agg(F.min("text").alias("text"))  # at most two a range
    columns = ["bucket", "turn", "foreign", "last", "o", "mark", "doc_id", "text"]
    theirs = heads.join(F.broadcast(foreign), ["last", "o", "mark"]).withColumns({"foreign": F.lit(True), "doc_id": F.when(F.col("last") == 0, F.bitwise_not(F.col("o")))})
    placed = rows.withColumn("salt", F.rand(7)).withColumn("bucket", F.pandas_udf(range_of, "int")("last", "o", "mark", "salt")).withColumns({"turn": F.lit(0), "foreign": F.lit(False)})
    sorted_rows = placed.select(columns).union(theirs.select(columns)).repartitionById(parts, "bucket").sortWithinPartitions("bucket", "turn", "last", "o", "mark", "foreign")

    def run(batches: Iterator[pa.RecordBatch]):
        edits = Edits(k)
        for batch in common.sliced(batches):
            yield edits.rows(batch)

    return sorted_rows.select("bucket", "turn", "foreign", "doc_id", "mark", "text").mapInArrow(run, RESULT)
