r"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

The index holds, for every document it was given, the keys of its lines (`holders`), the reference count and the
keeper of every key (`counts`), and per shard a chain of cuckoo filters with the fingerprints of the shared keys, those
held by `min_docs` documents or more (`filters`). Inserting and deleting documents change the counts of their keys
only; a key that becomes shared enters its shard's filters and one that ceases to be leaves them, so a deletion undoes
an insertion exactly.

To deduplicate, the keys of the documents' lines are dealt to their shards, where they meet the shard's filters. Keys
outside the filters, nearly all, go no further. The others are looked up in the exact counts, so a false positive of a
filter changes nothing. A shard with many lines, say of one very common line, is cut in parts by document, each of
which gets the shard's filters and counts; this is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: Buckets of one filter, fingerprints in a bucket, moves before a filter counts as full, share of slots to fill.
BUCKETS, SLOTS, MOVES, FULL = 1 << 14, 4, 200, 0.9
#: Lines of a shard that meet its filters in one place, and keys a shard is made for, in the mean.
PART_LINES, SHARD_KEYS = 100_000, 100_000
KEY = ["key_hi", "key_lo"]
LINES = pa.schema([("doc_id", pa.int64()), ("key_hi", pa.int64()), ("key_lo", pa.int64())])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])


class CuckooFilter:
    """A chain of cuckoo filters of one size, as 16-bit fingerprints (0: free); grows by a link when full."""

    def __init__(self, data: bytes = b""):
        self.links = [x.copy() for x in np.frombuffer(data, np.uint16).reshape(-1, BUCKETS, SLOTS)]

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.links)

    @staticmethod
    def places(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets; the shard is taken from other bits of the key."""
        mark = (hi.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        first = (lo.astype(np.uint64) >> np.uint64(20)).astype(np.int64) % BUCKETS
        return mark, first, first ^ CuckooFilter.step(mark)

    @staticmethod
    def step(mark):
        return (mark * 0x5BD1E995 >> 7) % BUCKETS

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(hi, lo)
        found = np.zeros(len(mark), bool)
        for link in self.links:
            found |= (link[first] == mark[:, None]).any(axis=1) | (link[second] == mark[:, None]).any(axis=1)
        return found

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, first, second in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            if not self.links or not self._put(self.links[-1], mark, first, second):
                self.links.append(np.zeros((BUCKETS, SLOTS), np.uint16))
                self._put(self.links[-1], mark, first, second)

    def _put(self, link: np.ndarray, mark: int, first: int, second: int) -> bool:
        moved = []
        at = first
        for n in range(MOVES):
            for bucket in (first, second) if n == 0 else (at,):
                for slot in range(SLOTS):
                    if link[bucket, slot] == 0:
                        link[bucket, slot] = mark
                        return True
            slot = (mark + n) % SLOTS
            moved.append((at, slot, int(link[at, slot])))
            link[at, slot], mark = mark, int(link[at, slot])
            at ^= self.step(mark)
        for bucket, slot, old in reversed(moved):  # full: as it was
            link[bucket, slot] = old
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for mark, first, second in zip(*(x.tolist() for x in self.places(hi, lo)), strict=True):
            for link, bucket, slot in ((x, b, s) for x in self.links for b in (first, second) for s in range(SLOTS)):
                if link[bucket, slot] == mark:
                    link[bucket, slot] = 0
                    break


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits for the stripped line with A-Z lower-cased; None for a line too short to count."""
    line = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "replace").lower()) if len(line) >= min_chars else None


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key_hi, key_lo) from (doc_id, text), each key once in a row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in common.sliced(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and doc_id is not None and (own := {k for line in text.split("\n") if (k := line_key(line))}):
                    ids += [doc_id] * len(own)
                    keys += own
            parts = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield common.record_batch(LINES, np.array(ids, np.int64), parts[:, 0], parts[:, 1])

    return docs.mapInArrow(run, "doc_id long, key_hi long, key_lo long")


@dataclass
class LineIndex:
    """State of the deduplication; every change gives a new index, the old one stays valid."""

    holders: DataFrame  # doc_id, key_hi, key_lo
    counts: DataFrame  # key_hi, key_lo, n_docs, keeper
    filters: DataFrame  # shard, data
    shards: int
    min_docs: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, min_docs: int = MIN_DOCS) -> LineIndex:
        frame = lambda schema: spark.createDataFrame([], schema)
        return cls(frame("doc_id long, key_hi long, key_lo long"), frame("key_hi long, key_lo long, n_docs long, keeper long"), frame("shard long, data binary"), shards, min_docs)

    @staticmethod
    def _counted(holders: DataFrame) -> DataFrame:
        return holders.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents. A document's key counts once, however often it or its row comes; keys that the index has
        for it already change nothing. Rows with a null id or text add nothing. Texts are read whole, however long;
        columns other than the two named are not looked at."""
        chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        new = common.saved(line_keys(chosen).distinct().join(self.holders, ["doc_id", *KEY], "left_anti"))
        counts = self.counts.union(self._counted(new)).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._changed(self.holders.union(new), common.saved(counts))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Forget the documents whose ids are in the only column of `ids`; unknown ids change nothing."""
        ids = ids.toDF("doc_id").distinct()
        left = common.saved(self.holders.join(ids, "doc_id", "left_anti"))
        touched = self.holders.join(ids, "doc_id", "left_semi").select(*KEY).distinct()
        again = self._counted(left.join(touched, KEY, "left_semi"))
        return self._changed(left, common.saved(self.counts.join(touched, KEY, "left_anti").union(again)))

    def _changed(self, holders: DataFrame, counts: DataFrame) -> LineIndex:
        """Bring the filters up to date with the keys that became shared or ceased to be."""
        shared = lambda df: df.where(F.col("n_docs") >= self.min_docs).select(*KEY)
        before, after = shared(self.counts), shared(counts)
        up = after.join(before, KEY, "left_anti").withColumn("up", F.lit(True))
        down = before.join(after, KEY, "left_anti").withColumn("up", F.lit(False))
        change = up.union(down).withColumn("shard", F.pmod("key_lo", F.lit(self.shards)))

        def update(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            chain = CuckooFilter(bytes(old["data"].iloc[0]) if len(old) else b"")
            new = new.sort_values(KEY)
            for up, method in ((True, chain.insert), (False, chain.delete)):
                some = new[new["up"] == up]
                method(some["key_hi"].to_numpy(np.int64), some["key_lo"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [key[0]], "data": [chain.to_bytes()]})

        filters = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(update, "shard long, data binary")
        return replace(self, holders=holders, counts=counts, filters=common.saved(filters))

    def _held(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key_hi, key_lo) of the lines that `docs` (doc_id, text) lose."""
        shard = F.pmod("key_lo", F.lit(self.shards)).alias("shard")
        keys = common.saved(line_keys(docs).distinct().select("doc_id", *KEY, shard))
        parts = keys.groupBy("shard").agg(F.ceil(F.count("*") / PART_LINES).alias("parts"))
        parts = common.saved(parts)
        n_shards = parts.count()
        with_parts = lambda df: df.join(common.small(parts, n_shards, 16), "shard")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        lines = with_parts(keys).select("shard", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"), "doc_id", *KEY)
        filters = with_parts(self.filters).select("shard", every, "data")

        def probe(key, filters: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
            if not len(filters) or not len(lines):
                return lines.iloc[:0]
            chain = CuckooFilter(bytes(filters["data"].iloc[0]))
            return lines[chain.contains(lines["key_hi"].to_numpy(np.int64), lines["key_lo"].to_numpy(np.int64))]

        may = filters.groupBy("shard", "part").cogroup(lines.groupBy("shard", "part")).applyInPandas(probe, "shard long, part long, doc_id long, key_hi long, key_lo long")
        shared = with_parts(self.counts.where(F.col("n_docs") >= self.min_docs).withColumn("shard", shard)).select(every, *KEY, "keeper")
        return may.join(shared, [*KEY, "part"]).where("doc_id <> keeper").select("doc_id", *KEY)

    def _drops(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """`docs` and a last column: the keys that its lines lose, or null."""
        held = self._held(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
        of, keys, apart = (common.fresh(docs, name) for name in ("__of", "__drops", "__apart"))
        # A document's own lines, so as many as its text has at most.
        drops = held.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct(*KEY)).alias(keys)).withColumn(apart, F.lit(0))
        # Rows without an id have nothing to meet, and would else meet each other in one task.
        alone = F.when(docs[id_col].isNull(), F.pmod(F.xxhash64(docs[text_col]), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
        rows = docs.withColumn(apart, alone)
        both = rows.join(drops, (rows[id_col].cast("long") == drops[of]) & (rows[apart] == drops[apart]), "left")
        return both.select(*(rows[c] for c in docs.columns), drops[keys])

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        r"""Per row: doc_id, n_lines, n_dropped and `kept`, the lines that stay, joined by \n.

        A line goes if `min_docs` indexed documents or more hold its key and this document is not the one with the
        largest id; all of a document's lines with that key go or stay together. Short lines stay. Null and empty
        texts have one empty line, kept. Rows with a null id keep all lines. Very long texts and lines are read whole.
        Repeated rows give repeated results, an empty table an empty one. Further columns of any name are not looked
        at and not returned.
        """

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in common.sliced(batches):
                rows: tuple[list, ...] = ([], [], [])
                for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    kept = _kept(lines, drops)
                    for column, value in zip(rows, (len(lines), len(lines) - len(kept), "\n".join(kept)), strict=True):
                        column.append(value)
                yield common.record_batch(KEPT, batch.column(0), *rows)

        both = self._drops(docs.select(id_col, text_col), id_col, text_col)
        return both.select(both[id_col].cast("long"), text_col, both.columns[-1]).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`docs` with its rows and columns, whatever their names, but each text as `dedup` keeps it; n_chars, if there,
        follows the text."""
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in common.sliced(batches):
                pairs = zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
                texts = [t if not drops else "\n".join(_kept((t or "").split("\n"), drops)) for t, drops in pairs]
                columns = batch.columns[:-1]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

        out = self._drops(docs, id_col, text_col).mapInArrow(run, docs.schema)
        return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _kept(lines: list[str], drops: list[dict] | None) -> list[str]:
    if not drops:
        return lines
    gone = {np.array([d["key_hi"], d["key_lo"]], np.int64).tobytes() for d in drops}
    return [x for x in lines if line_key(x) not in gone]


def _index(docs: DataFrame, min_docs: int, id_col: str, text_col: str) -> LineIndex:
    """With shards enough for ten times as many distinct keys as there are documents."""
    return LineIndex.empty(docs.sparkSession, max(16, 10 * docs.count() // SHARD_KEYS), min_docs).insert(docs, id_col, text_col)


def deduplicate_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index all documents and drop their shared lines; see `LineIndex.dedup`."""
    return _index(docs, min_docs, id_col, text_col).dedup(docs, id_col, text_col)


def without_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without its shared lines; see `LineIndex.rewrite`."""
    return _index(docs, min_docs, id_col, text_col).rewrite(docs, id_col, text_col)
