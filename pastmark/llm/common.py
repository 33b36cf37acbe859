"""What the operators of this subpackage share: words, Arrow batches, checkpoints, size-checked broadcasts, components.

Conventions: a word is a maximal run of characters other than blank, tab, line feed, vertical tab, form feed and
carriage return. Operators select the columns they need by name before adding their own, so further columns of the
input, whatever their names, are never in the way.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys remembered by a per-task memo before it is emptied; bounds a Python worker's memory.
MEMO_ENTRIES = 200_000
#: Rows taken at a time from an Arrow batch, and about how many bytes of them.
SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20
#: Edges of a graph that one task may hold; more are dealt to more tasks.
TASK_EDGES = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; null and empty texts have none."""
    return text.encode("utf-8", "replace").lower().split() if text else []


@dataclass
class Words:
    """The words of some texts: `distinct` in UTF-8, `index` into it word by word, text i from starts[i] to starts[i + 1]."""

    distinct: list[bytes]
    index: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False) -> Words:
        """Null, empty and blank texts have no words. With `lower`, A-Z are lower-cased."""
        trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(trimmed) if lower else trimmed)
        n = np.where(np.asarray(pc.binary_length(trimmed)) > 0, np.asarray(pc.list_value_length(lists)), 0)
        flat = lists.flatten()
        flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        return cls(flat.dictionary.cast(pa.binary()).to_pylist(), np.asarray(flat.indices, np.int64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self)), self.n)

    def each(self, memo: Memo, kind: type = np.int64) -> np.ndarray:
        """What the memo gives for each distinct word."""
        return np.fromiter(map(memo.__getitem__, self.distinct), kind, len(self.distinct))

    def once(self) -> Words:
        """The distinct words of each text."""
        pairs = np.unique(self.text_of * max(1, len(self.distinct)) + self.index)
        starts = np.searchsorted(pairs, np.arange(len(self) + 1) * max(1, len(self.distinct)))
        return Words(self.distinct, pairs % max(1, len(self.distinct)), starts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by text of a value per word."""
        return sums(values, self.starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from starts[i] to starts[i + 1]; exact for whole numbers."""
    total = np.concatenate([[0], np.cumsum(values, dtype=float if values.dtype.kind == "f" else np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


class Memo(dict):
    """Remembers what `make` gives for a key; emptied when full, so its size is bounded."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.make(key)
        return value


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir. Without one, a session on one machine gets a local
    folder and any other an error, as its executors share no local folder. Shuffle files of a job that has ended go at
    once, as what is read again is saved."""
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let rows with whole texts travel between Spark and Python by at most so many at a time: executors hold several
    batches of each task outside the heap. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def saved(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: computed once, and still there when an executor is lost."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete what a job has written and no one reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores added until no column of `df` is called so, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_mark(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row, nulls told apart by column."""
    holds_map = lambda t: "map<" in t.simpleString()
    values = [F.to_json(F.struct(df[f.name])) if holds_map(f.dataType) else df[f.name] for f in df.schema]
    return F.xxhash64(*values, *(df[f.name].isNull() for f in df.schema))


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """Hint a broadcast when the counted rows fit the limit; otherwise Spark shuffles the join as usual."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def gathered(df: DataFrame, rows: int, task_rows: int) -> DataFrame:
    """All of the counted rows, in no more tasks than their number asks for: a step over few rows costs a task and not one
    for each partition of the shuffle before. One task needs no shuffle to group or join what it holds."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, so that what a worker makes of texts stays small."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    freed()


def freed() -> None:
    """Give memory that Arrow holds back for later to the system; the worker lives on when its task has ended."""
    pa.default_memory_pool().release_unused()


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (a, b) edges; the component is its smallest node.

    Every round hooks each node to its smallest neighbour, follows the hooks to their end and contracts the edges, so
    at least half of the nodes that have edges go. Rounds end in a checkpoint; nothing is collected but a count, and for
    broadcasts the hooks of at most TASK_EDGES edges. Hubs are harmless: the hook is a minimum with partial aggregation and the joins can be split by AQE. A round has as many tasks
    as its edges ask for, so the last rounds, with few edges, have few. An empty edge table gives an empty result; loops
    and repeated edges change nothing.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    n_edges, found = edges.count(), None
    while True:
        edges = gathered(edges, n_edges, TASK_EDGES)
        near = lambda df: small(df, n_edges, 1, TASK_EDGES)  # noqa: B023, E731  goes whole to a task where the edges do
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        moved = True
        while moved:  # each time through, a node goes four times as far; most trees need it once
            for _ in range(2):
                above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
                hook = hook.select("node", "up").join(near(above), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            hook = gathered(saved(hook), n_edges, TASK_EDGES)
            moved = not hook.where("moved").isEmpty()
        if found is None:
            found = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            found = found.join(near(step), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        at = lambda side: hook.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        left = edges.join(near(at("a")), "a").join(near(at("b")), "b").where("a_up <> b_up")
        edges = saved(left.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        n_edges = edges.count()
        if not n_edges:
            return found
