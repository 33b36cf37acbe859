"""Exact top-k by inner product over an impact-ordered index, score at a time.

Candidates are dealt to shards of bounded size. A shard's index has, for each dimension, the postings of its vectors in
segments by descending quantised size of the component. A query's segments are taken by descending impact, the size of
the segment times the query's component, over all dimensions at once. After each stage every vector has a lower and an
upper bound: what has been seen, more or less what the segments that are left can still add. A query stops only when
the vectors whose upper bound reaches the k-th lower bound are few, or when no segment is left; these possible members
are scored exactly.

Each block of queries meets each shard once. A shard gives at most k rows for a query, so what is merged is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a shard and queries in a block, in the mean; bits of a component's size that a segment keeps.
SHARD, BLOCK, LEVEL_BITS = 4096, 64, 10
#: Blocks that meet a shard in one group.
PART = SHARD // BLOCK
#: Shares of the postings after which a stage ends; share of the shard that is scored without going on.
STAGES, RESCORE = (0.4, 0.55, 0.65, 0.72, 0.78, 0.86, 0.94), 1 / 32
#: Sums below this are exact in doubles.
EXACT = 2.0**52


class ImpactIndex:
    """Posting segments of one shard by descending impact. `vectors`: (n, dimensions) of doubles that are whole."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, (n, dims) = ids, vectors, vectors.shape
        self.most = float(np.abs(vectors).max(initial=0))
        if self.most * max(1, dims) >= EXACT:
            return  # searched without stops
        size = np.abs(vectors).astype(np.int64)
        self.bits = max(0, int(self.most).bit_length() - LEVEL_BITS)
        level = size >> self.bits
        #: Of each dimension: its vectors by descending level, with the least size of the level and the sign.
        self.postings = np.argsort(-level, axis=0, kind="stable").T.copy()
        self.sign = np.sign(np.take_along_axis(vectors.T, self.postings, 1))
        self.base = self.sign * (np.take_along_axis(level.T, self.postings, 1) << self.bits)
        #: ends[d, l]: how many postings of dimension d are in segments of level l or more.
        self.levels = int(level.max(initial=0)) + 1
        counts = np.zeros((dims, self.levels + 1), np.int64)
        np.add.at(counts, (np.arange(dims)[:, None], level.T), 1)
        self.ends = counts[:, ::-1].cumsum(axis=1)[:, ::-1]

    def _stages(self, weight: np.ndarray) -> list[tuple[np.ndarray, float]]:
        """How far each dimension is read after each stage, and the most that a posting not read then can add."""
        unit = 1 << self.bits
        top = float(weight.max(initial=0)) * self.levels * unit
        impacts = top * 2.0 ** -np.arange(0, 16, 0.25)
        least = np.ceil(impacts[:, None] / np.maximum(weight * unit, 1e-300)).clip(0, self.levels).astype(np.int64)
        read = self.ends[np.arange(len(weight)), least]
        share = read.sum(axis=1) / max(1, self.ends[:, 0].sum())
        # A posting of a level below `least` has a size below least * unit.
        rest = (weight * (least * unit - 1).clip(0)).max(axis=1, initial=0)
        at = sorted({int(np.searchsorted(share, s)) for s in STAGES} - {len(impacts)})
        return [(read[i], float(rest[i])) for i in at] + [(self.ends[:, 0], 0.0)]

    def search(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The rows, ids and exact scores of the k best, by score and then id, and the share of postings read. `skip`: an
        id to leave out."""
        n, weight = len(self.ids), np.abs(query)
        possible, read_share = np.ones(n, bool) if skip is None else self.ids != skip, 1.0
        exact = self.most * float(weight.sum()) < EXACT
        if exact and n > k and self.most * max(1, len(query)) < EXACT:
            possible, read_share = self._possible(query, weight, k, possible)
        rows = np.flatnonzero(possible)
        if exact:
            score = (self.vectors[rows] @ query).astype(np.int64)
        else:
            whole = [int(x) for x in query]
            sums = [sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in self.vectors[rows].tolist()]
            score = np.array([min(max(x, -(2**63)), 2**63 - 1) for x in sums], np.int64)
        best = np.lexsort((self.ids[rows], ~score))[:k]  # ~x falls as x rises, and does not overflow
        return rows[best], self.ids[rows][best], score[best], read_share

    def _possible(self, query, weight, k, allowed) -> tuple[np.ndarray, float]:
        n, dims = self.vectors.shape
        lower, spread, seen = np.zeros(n), np.zeros(n), np.zeros(n)
        done, width, active = np.zeros(dims, np.int64), (1 << self.bits) - 1, int((weight > 0).sum())
        for read, rest in self._stages(weight):
            some = np.flatnonzero((read > done) & (weight > 0))
            if len(some):
                spans = [(d, done[d], read[d]) for d in some.tolist()]
                of = lambda x: np.concatenate([x[d, a:b] for d, a, b in spans])
                rows, q = of(self.postings), np.repeat(query[some], read[some] - done[some])
                sure = q * of(self.base)
                if width:
                    open_ = q * of(self.sign) * width
                    spread += np.bincount(rows, np.abs(open_), n)
                    sure += np.minimum(open_, 0)
                lower += np.bincount(rows, sure, n)
                seen += np.bincount(rows, minlength=n)
                done = np.maximum(done, read)
            left = rest * (active - seen)
            worst = np.where(allowed, lower - left, -np.inf)
            possible = allowed & (lower + spread + left >= np.partition(worst, n - k)[n - k])
            if possible.sum() <= max(4 * k, n * RESCORE):
                break
        return possible, float(done.sum()) / max(1, n * dims)


def _packed(df: DataFrame, groups: Column, name: str) -> DataFrame:
    """Rows (id, v, n) dealt by a hash to as many groups for each vector length, each as one row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(pdf["v"].to_numpy()).astype(float)
        order = np.lexsort((*vectors.T[::-1], pdf["id"].to_numpy(np.int64)))
        pdf, vectors = pdf.iloc[order], vectors[order]
        return pd.DataFrame({"length": [vectors.shape[1]], name: [int(pdf["g"].iloc[0])], f"{name}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_n": [pdf["n"].to_numpy(np.int64).tobytes()], f"{name}_vectors": [vectors.tobytes()]})

    dealt = df.withColumn("length", F.size("v").cast("long")).withColumn("g", F.pmod(F.xxhash64("id", "v"), groups))
    return dealt.groupBy("length", "g").applyInPandas(run, f"length long, {name} long, {name}_ids binary, {name}_n binary, {name}_vectors binary")


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * component), whole numbers as doubles; rows with a null id or vector, or with components
    that are null or not finite, before or after, go. Further columns of any name are not looked at."""
    x = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * scale) < float("inf")), F.lit(False)))
    x = x.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).where(sound)
    whole = lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale)
    return x.select("id", F.transform("x", whole).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k best rows of `vectors` for each row of `queries`, both (id, v) as
    `quantised` gives them; all if there are fewer. A query's own id is no candidate. Ties go to the smaller id;
    repeated candidate rows count one by one, but are searched once; of repeated query ids the least vector asks. Only
    vectors of a query's length are its candidates. No candidates or no queries: no rows. Scores are exact; those
    beyond 64 bits are given as the greatest or least number of 64 bits, and tie.
    """
    queries = queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("n", F.lit(1).cast("long"))
    vectors = common.saved(vectors.groupBy("id", "v").agg(F.count("*").alias("n")))
    n_shards, n_blocks = (F.lit(max(1, -(-df.count() // per))) for df, per in ((vectors, SHARD), (queries, BLOCK)))
    shards, blocks = _packed(vectors, n_shards, "shard"), _packed(queries, n_blocks, "block")
    # Both sides move by shard: Spark guesses 100 bytes for a packed row of megabytes and would let joins send one side
    # through the driver. A shard is once in a group, beside as many blocks as are as large as it is.
    part = lambda block: F.floor(block / PART)
    to_all = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), n_shards.cast("long") - 1))).withColumn("part", part(F.col("block")))
    to_parts = shards.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part(n_blocks - 1))))

    def run(blocks: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for ids, n, data in zip(shard["shard_ids"], shard["shard_n"], shard["shard_vectors"], strict=True):
            ids, times = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
            index = ImpactIndex(ids, np.frombuffer(data, float).reshape(len(ids), -1))
            for query_ids, queries in zip(blocks["block_ids"], blocks["block_vectors"], strict=True):
                query_ids = np.frombuffer(query_ids, np.int64).tolist()
                for query_id, query in zip(query_ids, np.frombuffer(queries, float).reshape(len(query_ids), -1), strict=True):
                    rows, found, score, _ = index.search(query, k, query_id)
                    out += zip([query_id] * len(found), found.tolist(), score.tolist(), np.minimum(times[rows], k).tolist(), strict=True)
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 4), columns=["query_id", "vec_id", "score", "n"])

    keys = ["length", "shard", "part"]
    found = to_all.groupBy(*keys).cogroup(to_parts.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score long, n long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
