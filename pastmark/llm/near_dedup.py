"""Near-duplicate documents by min-max hashing.

Each document is its set of five-word shingles. A permutation of the hashed shingles gives two signature values, the
least and the greatest hash, so half the hash evaluations give as many values as plain MinHash; both agree between two
sets with the probability of their Jaccard similarity. Values are cut to 16 bits, put in bands and bucketed by band.

Copies with equal sets first collapse to their smallest id. In every bucket, chunks of bounded size propose the edges
of a maximum spanning forest by signature agreement; proposals are confirmed on full sets; confirmed links give
components. Where a bucket still holds several components, all pairs of different components whose signatures are not
clearly apart are confirmed in place, each pair once, in blocks, and only links leave it. Blocks are made by component:
a large one has blocks of its own, which never meet each other. So a group of near copies is joined through few links,
one that has become one component costs its other members only, and no link between different components is left out,
but for the miss probability of the bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE_WORDS, PERMUTATIONS = 5, 64
#: Bucket members joined to a spanning forest in one place; members compared with each other in one place, and bytes of
#: their sets. Larger buckets are cut in parts and blocks.
PART, BLOCK, BLOCK_BYTES = 512, 1024, 16 << 20
#: Signatures agree on so much less than the threshold only with a probability under 1e-6 (five deviations).
DEVIATIONS = 5.0

SIGNATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("buckets", pa.list_(pa.int64())), ("signature", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def banding(threshold: float, values: int = 2 * PERMUTATIONS, miss: float = 1e-6) -> tuple[int, int]:
    """Rows of a band and number of bands: the longest bands that miss a pair at the threshold with at most `miss`."""
    for rows in range(12, 1, -1):
        bands = values // rows
        if (1 - threshold**rows) ** bands <= miss:
            return rows, bands
    return 1, values


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_memo() -> common.Memo:
    return common.Memo(xxhash.xxh3_64_intdigest)


def shingle_hashes(texts: pa.Array, memo: common.Memo, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles; fewer words than `size` are one shingle, none
    gives none. A-Z count as lower case."""
    said = common.Words.of(texts, lower=True)
    word = said.each(memo, np.uint64)[said.index]
    n_whole = max(0, len(word) - size + 1)
    whole = np.full(n_whole, size, np.uint64)
    for i in range(size):
        whole = _mixed(whole * np.uint64(0x9E3779B97F4A7C15) + word[i : i + n_whole])
    for lo, hi in zip(said.starts[:-1].tolist(), said.starts[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield np.unique(whole[lo : hi - size + 1])
        elif lo == hi:
            yield np.empty(0, np.uint64)
        else:
            out = np.full(1, hi - lo, np.uint64)
            for w in word[lo:hi]:
                out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + w)
            yield out


class MinMax:
    """Signatures and bucket keys of shingle sets."""

    def __init__(self, threshold: float, permutations: int = PERMUTATIONS, seed: int = 20):
        self.rows, self.bands = banding(threshold, 2 * permutations)
        random = np.random.default_rng(seed)
        self.factor = random.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = random.integers(0, 2**63, permutations, np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """2 * permutations values of 16 bits, the least and the greatest in turn."""
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        most = np.zeros(len(self.factor), np.uint64)
        for at in range(0, len(shingles), 2048):  # a long text takes no more memory
            hashed = shingles[at : at + 2048, None] * self.factor + self.shift
            np.minimum(least, hashed.min(axis=0), out=least)
            np.maximum(most, hashed.max(axis=0), out=most)
        return _mixed(np.stack([least, most], axis=1).ravel()).astype(np.uint16)

    def banded(self, signature: np.ndarray) -> np.ndarray:
        """The values by band: (..., bands, rows)."""
        used = signature[..., : self.rows * self.bands]
        return used.reshape(*signature.shape[:-1], self.bands, self.rows)

    def buckets(self, signature: np.ndarray) -> list[int]:
        return [xxhash.xxh3_64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(self.banded(signature))]


def signatures(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, bucket keys and the signature; the last four are null
    without shingles."""

    def run(batches: Iterator[pa.RecordBatch]):
        memo, hasher = word_memo(), MinMax(threshold)
        for batch in common.sliced(batches):
            rows: list[list] = [[] for _ in SIGNATURES]
            for doc, shingles in zip(batch.column(0).to_pylist(), shingle_hashes(batch.column(1), memo), strict=True):
                row = (doc, len(shingles), None, None, None, None)
                if len(shingles):
                    key, signature = xxhash.xxh3_128_digest(shingles.tobytes()), hasher.signature(shingles)
                    halves = (int.from_bytes(key[:8], signed=True), int.from_bytes(key[8:], signed=True))
                    row = (doc, len(shingles), *halves, hasher.buckets(signature), signature.tobytes())
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
            yield common.record_batch(SIGNATURES, *rows)

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_shingles long, set_hi long, set_lo long, buckets array<long>, signature binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted shingle hashes as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        memo = word_memo()
        for batch in common.sliced(batches):
            yield common.record_batch(SETS, batch.column(0), [x.tobytes() for x in shingle_hashes(batch.column(1), memo)])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets that are not empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    both = int(np.count_nonzero(a[at] == b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold: 100 * intersection >= 100 * threshold * union."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=PAIRS).filter(pa.array(keep, pa.bool_()))
        common.freed()

    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("shingles_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("shingles_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "shingles_a", "shingles_b")
    return both.mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows of sorted batches by their first columns; a run of equal keys may go over batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield from groupby(rows, key=lambda row: row[:keys])
    common.freed()


def _pair_batches(found: Iterator[tuple[int, int]]):
    a, b = [], []
    for x, y in found:
        a.append(min(x, y))
        b.append(max(x, y))
        if len(a) >= 20_000:
            yield common.record_batch(PAIRS, a, b)
            a, b = [], []
    yield common.record_batch(PAIRS, a, b)


def least_agreement(threshold: float, values: int) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / values) ** 0.5


def spanning_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """From (bucket, part, doc_id, signature): per bucket and part, a maximum spanning forest by agreement."""

    def run(batches: Iterator[pa.RecordBatch]):
        def found():
            for _, rows in _runs(batches, 2):
                ids, sigs = zip(*((r[2], r[3]) for r in rows), strict=True)
                if len(ids) == 2:
                    yield ids
                    continue
                sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), -1)
                need = least_agreement(threshold, sig.shape[1]) * sig.shape[1]
                best, via = np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)  # Prim's algorithm
                out = np.ones(len(ids), bool)
                at = 0
                for _ in range(len(ids) - 1):
                    out[at] = False
                    same = (sig == sig[at]).sum(axis=1)
                    closer = out & (same > best)
                    best[closer], via[closer] = same[closer], at
                    at = int(np.argmax(np.where(out, best, -2.0)))
                    if best[at] >= need:
                        yield ids[at], ids[via[at]]

        yield from _pair_batches(found())

    return members.mapInArrow(run, "a long, b long")


def crossing_links(members: DataFrame, threshold: float) -> DataFrame:
    """From (bucket, pair, side, doc_id, component, signature, shingles): per bucket and pair of blocks, links between
    different components of its side 0 and side 1, or of all its rows (side 2: one block). Pairs whose signatures may
    reach the threshold are confirmed on full sets at once, in the first band that both share only; what is linked
    already is not looked at again."""
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = MinMax(threshold)

        def found():
            for (bucket, _), rows in _runs(batches, 2):
                side, ids, comps, sigs, sets = zip(*((r[2:]) for r in rows), strict=True)
                side, comps = np.array(side), np.array(comps)
                sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), -1)
                size = np.array([len(s) // 8 for s in sets])
                band = hasher.banded(sig)
                own = next(i for i, x in enumerate(hasher.buckets(sig[0])) if x == bucket)
                need = least_agreement(threshold, sig.shape[1]) * sig.shape[1]
                for i in np.flatnonzero(side != 1):
                    js = np.flatnonzero((side != 0) & (comps != comps[i]))
                    js = js[js > i] if side[i] == 2 else js
                    js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
                    same = (sig[js] == sig[i]).sum(axis=1)
                    js, same = js[same >= need], same[same >= need]
                    first = ~(band[js, :own] == band[i, :own]).all(axis=2).any(axis=1)
                    js = js[first][np.argsort(-same[first], kind="stable")]
                    mine = np.frombuffer(sets[i], np.uint64)
                    for j in js.tolist():
                        if comps[j] != comps[i] and similar(mine, np.frombuffer(sets[j], np.uint64), percent):
                            yield ids[i], ids[j]
                            comps[comps == comps[j]] = comps[i]

        yield from _pair_batches(found())

    return members.mapInArrow(run, "a long, b long")


def _components(reps: DataFrame, links: DataFrame) -> DataFrame:
    found = common.connected_components(links)
    return reps.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def block_pairs(placed: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """From (bucket, doc_id, component, own_bytes): (bucket, pair, side, doc_id, component), each row once for every pair
    of blocks that its block is in. Blocks hold about `block` rows and `block_bytes` bytes; components larger than that
    have blocks of their own, which are not paired with each other."""
    n_blocks = lambda m, b: F.greatest(F.ceil(F.col(m) / block), F.ceil(F.col(b) / block_bytes)).cast("long")
    of = placed.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("own_bytes").alias("b"))
    of = of.withColumn("own", n_blocks("m", "b"))
    pool = of.where("own = 1").groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("b").alias("b")).select("bucket", n_blocks("m", "b").alias("pool"))
    of = of.join(pool, "bucket", "left").select("bucket", "component", "own", "pool")
    alone = F.col("own") > 1
    number = F.when(alone, F.pmod(F.xxhash64("bucket", "doc_id"), "own")).otherwise(F.pmod(F.xxhash64("bucket", "component"), "pool"))
    at = F.struct(F.when(alone, F.col("component")).alias("owner"), number.alias("number"))
    rows = placed.select("bucket", "doc_id", "component").join(of, ["bucket", "component"]).select("bucket", "doc_id", "component", at.alias("at"))
    blocks = rows.select("bucket", "at").distinct()
    left, right = blocks.withColumnRenamed("at", "left"), blocks.withColumnRenamed("at", "right")
    pairs = left.join(right, "bucket").where(F.col("left") <= F.col("right")).where("left.owner is null or right.owner is null or left.owner <> right.owner")
    pairs = pairs.withColumn("pair", F.xxhash64("left", "right"))
    same = F.col("left") == F.col("right")
    uses = pairs.select("bucket", "pair", F.col("left").alias("at"), F.when(same, 2).otherwise(0).alias("side")).union(pairs.where(~same).select("bucket", "pair", F.col("right").alias("at"), F.lit(1).alias("side")))
    return rows.join(uses, ["bucket", "at"]).select("bucket", "pair", "side", "doc_id", "component")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reached by links, itself included) and kept.

    Documents without words have n_shingles 0 and are linked with nothing; fewer than five words are one shingle.
    Equal texts and other texts of equal sets are linked like any. Rows with a null id are kept, with a null
    component. Rows that repeat an id share its component and are all kept or all dropped; if their texts differ, each
    takes part. Very long texts are read whole. An empty table gives an empty result. Further columns of any name are
    not looked at and not returned. Links are exact on full sets (64-bit shingle hashes).
    """
    base = common.saved(signatures(docs, threshold, id_col, text_col))
    sets_known = base.where("doc_id is not null and n_shingles > 0")
    classes = sets_known.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    # One row of each class, with its signature: the one of the smallest id.
    reps = sets_known.join(classes, (sets_known.set_hi == classes.set_hi) & (sets_known.set_lo == classes.set_lo) & (sets_known.doc_id == classes.rep), "left_semi")
    in_band = reps.select(F.explode("buckets").alias("bucket"), "doc_id")
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    members = common.saved(in_band.join(shared, "bucket").select("bucket", "n", "least", "doc_id"))
    involved = common.saved(members.select("doc_id").distinct())
    n_involved = involved.count()
    wanted = common.small(involved, n_involved, 8)
    text = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sets = common.saved(shingle_sets(text.join(wanted, "doc_id", "left_semi")))
    signature = base.where("doc_id is not null").select("doc_id", "signature").join(wanted, "doc_id", "left_semi")

    part = F.when(F.col("n") > PART, F.pmod(F.xxhash64("doc_id", "bucket"), F.ceil(F.col("n") / PART))).otherwise(0).cast("long")
    larger = members.where("n > 2").withColumn("part", part).join(signature, "doc_id")
    larger = larger.select("bucket", "part", "doc_id", "signature").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc_id")
    two = members.where("n = 2").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    proposed = two.union(spanning_pairs(larger, threshold)).where("a <> b").distinct()
    links = common.saved(confirmed(proposed, sets, threshold))
    component = common.saved(_components(involved, links))

    placed = members.where("n > 2").join(component, "doc_id").join(sets.select("doc_id", F.length("shingles").alias("own_bytes")), "doc_id")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    placed = common.saved(placed.join(mixed, "bucket", "left_semi").select("bucket", "doc_id", "component", "own_bytes"))
    crossing = block_pairs(placed).join(signature, "doc_id").join(sets, "doc_id").select("bucket", "pair", "side", "doc_id", "component", "signature", "shingles")
    crossing = crossing.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "doc_id")
    more = crossing_links(crossing, threshold)
    merged = common.connected_components(links.union(more))

    of_class = classes.join(merged, classes.rep == merged.node, "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("class_component"))
    out = base.select("doc_id", "n_shingles", "set_hi", "set_lo").join(of_class, ["set_hi", "set_lo"], "left")
    component_id = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_component", "doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component_id).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
