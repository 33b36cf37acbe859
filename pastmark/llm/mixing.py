"""Mixing sources to target weights by blocks of tokens.

The words of each source, document after document, are packed into blocks of a fixed length. The mix has as many slots
as the targets need blocks, dealt to shards; every slot draws its source on its own, with chances in proportion to the
targets, so the source counts of a shard are a multinomial draw. Over all shards a source is drawn a little too often
or too seldom, by the square root of its slots; slots it has too many, taken at equal distances, are given to sources
that have too few. The slots of a source are then numbered, and slot j takes the block that a pseudorandom permutation
of the source's block numbers gives for j, round after round; slots and blocks are joined by block number.

All of it is columns and SQL functions. Positions in a source come from sums over buckets of bounded size and offsets
of buckets, never from one window over a source; only tables of one row per source are in one task. Rows that are equal
in all columns are one class with a count, however many there are, until the very end. A permutation is a fixed number
of swap-or-not rounds on a hash, so each row finds its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words in a block, slots in an output shard, documents in a bucket and buckets in a group (both in the mean), copies
#: of a row that are made in one place, rounds of a permutation, times a source may be repeated.
BLOCK_WORDS, SHARD_SLOTS, BUCKET_DOCS, GROUP_BUCKETS, COPIES, ROUNDS, MOST = 32, 1024, 128, 4096, 1024, 14, 3
CLASS = ["doc_id", "mark", "key"]


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n - 1, by swap-or-not rounds; works for every n > 0."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) + n - at, n)
        return F.when(F.xxhash64(*key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*(F.lit(r) for r in range(ROUNDS))), x.cast("long"), turn)


def target_sizes(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(key, source, source_size, rank, weight, target) from (key, source, source_size), one row per source.

    Sources in order of code point, null last, weigh 1, 2, 3, repeating; targets share all sizes by weight, but stop
    at `most` times the source's size; the excess is shared again by weight until no target is above its stop. In the
    order of stop per weight the sources that stop come first, and the share of the others rises with each that is
    taken out and falls afterwards: it is the greatest of all.
    """
    ranked = sources.withColumn("rank", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long"))
    weighed = ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    order, whole = Window.orderBy(F.col("stop") / F.col("weight"), "rank"), Window.partitionBy()
    stopped = F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    shares = weighed.withColumn("share", (F.sum("source_size").over(whole) - stopped) / weights)
    target = F.least("stop", F.max("share").over(whole) * F.col("weight"))
    return shares.select("key", "source", F.col("source_size").cast("long"), "rank", "weight", target.alias("target"))


def _offsets(sums: DataFrame, bucket: str, size: str) -> DataFrame:
    """(key, bucket, offset) from (key, bucket, size): the sum of a source's sizes before the bucket."""
    before = lambda column, *by: F.coalesce(F.sum(column).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = sums.select("key", bucket, F.col(size).alias("n"), F.floor(F.col(bucket) / GROUP_BUCKETS).alias("group"))
    groups = grouped.groupBy("key", "group").agg(F.sum("n").alias("group_size"))
    groups = groups.select("key", "group", before("group_size", "key", "group").alias("group_offset"))
    inside = grouped.select("key", "group", bucket, before("n", "key", "group", bucket).alias("inside"))
    return inside.join(groups, ["key", "group"]).select("key", bucket, (F.col("group_offset") + F.col("inside")).alias("offset"))


def _owners(points: DataFrame, at: str, spans: DataFrame, n_spans: int, total: int) -> DataFrame:
    """`points` with the columns of the span (lo, hi and more; end exclusive, spans are disjoint and fill 0 .. total - 1)
    that holds the number `at`. Numbers are dealt to cells of equal width, a few per span, and meet spans by cell."""
    width = max(1, total // (4 * max(1, n_spans)))
    cells = common.saved(spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))))
    both = points.withColumn("cell", F.floor(F.col(at) / width)).join(common.small(cells, cells.count(), 64), "cell")
    return both.where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("cell")


def source_key(source: Column) -> Column:
    """Not null: null sources are one source, apart from empty ones."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def drawn_slots(targets: DataFrame, seed: int) -> DataFrame:
    """(key, blocks, shard, slot, j): for every slot the source that it draws, and its number among the source's slots.
    From (key, rank, draws, blocks), one row per source; over all slots each source has `draws` of them."""
    n_sources, total = targets.agg(F.count("*"), F.coalesce(F.sum("draws"), F.lit(0))).first()
    first = lambda column: F.sum(column).over(Window.orderBy("rank")) - F.col(column)  # noqa: E731  one row per source
    spans = targets.select("key", first("draws").alias("lo"), F.sum("draws").over(Window.orderBy("rank")).alias("hi"))
    slots = targets.sparkSession.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("chance"))
    drawn = _owners(slots, "chance", spans, n_sources, total)
    of_shard = common.saved(drawn.groupBy("shard", "key").agg(F.sort_array(F.collect_list("slot")).alias("slots")))  # SHARD_SLOTS at most
    counts = of_shard.select("shard", "key", F.size("slots").cast("long").alias("n"))

    had = targets.join(counts.groupBy("key").agg(F.sum("n").alias("had")), "key", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    had = had.withColumn("over", F.greatest(F.col("had") - F.col("draws"), F.lit(0))).withColumn("under", F.greatest(F.col("draws") - F.col("had"), F.lit(0)))
    had = common.saved(had.withColumn("over_before", first("over")).withColumn("lo", first("under")).withColumn("hi", F.sum("under").over(Window.orderBy("rank"))))
    moved = had.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]

    numbered = of_shard.join(_offsets(counts, "shard", "n"), ["key", "shard"]).select("key", "shard", "offset", F.posexplode("slots").alias("at", "slot"))
    numbered = numbered.join(common.small(had.select("key", "blocks", "had", "over", "over_before"), n_sources, 128), "key")
    j = F.col("offset") + F.col("at")
    given_before = F.floor(j * F.col("over") / F.col("had"))
    numbered = numbered.withColumn("given_before", given_before).withColumn("given", F.floor((j + 1) * F.col("over") / F.col("had")) > given_before)
    stay = numbered.where("not given").select("key", "blocks", "shard", "slot", (j - F.col("given_before")).alias("j"))
    given = numbered.where("given").select("shard", "slot", (F.col("over_before") + F.col("given_before")).alias("e"))
    given = _owners(given, "e", had.select("key", "blocks", "had", "lo", "hi"), n_sources, moved)
    return stay.union(given.select("key", "blocks", "shard", "slot", F.col("had") + F.col("e") - F.col("lo")))


def mix(docs: DataFrame, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: doc_id, mark (a hash of the row), copy, key (of the source), size, source_size, target,
    start (words of the source before it). The mix, one row per slot and document in its block: shard, slot, block,
    round, key, start (of the document), first (the piece's first word in the document), words.

    A block is taken at most three times, once per round, so no word is taken more often. `copy` numbers rows that
    are equal in all columns; rows that share an id but differ are documents of their own. Documents without words are
    in the first table only. Null sources are one source; null texts have no words; very long texts are counted whole
    and lie in as many blocks as they need; an empty table gives empty results. Further columns of any name only tell
    rows apart. The seed and the rows fix the result, whatever their order.
    """
    source = docs[source_col].cast("string")
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), common.row_mark(docs).alias("mark"), source_key(source).alias("key"), source.alias("source"), common.word_count(docs[text_col]).alias("size"))
    classes = common.saved(sized.groupBy(*CLASS, "source", "size").agg(F.count("*").alias("n")))
    buckets = 1 + classes.count() // BUCKET_DOCS
    parts = classes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets))).withColumn("whole", F.col("size") * F.col("n"))
    sums = common.saved(parts.groupBy("key", "source", "bucket").agg(F.sum("whole").alias("bucket_size")))
    targets = target_sizes(sums.groupBy("key", "source").agg(F.sum("bucket_size").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    draws = F.when(F.col("source_size") > 0, F.round(F.col("target") * blocks / F.col("source_size"))).otherwise(0).cast("long")
    targets = common.saved(targets.withColumn("blocks", blocks).withColumn("draws", draws))

    in_bucket = Window.partitionBy("key", "bucket").orderBy("doc_id", "mark")
    own = F.coalesce(F.sum("whole").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = parts.withColumn("own", own).join(_offsets(sums, "bucket", "bucket_size"), ["key", "bucket"])
    laid = laid.join(common.small(targets.select("key", "source_size", "target"), targets.count(), 64), "key")
    laid = laid.select(*CLASS, "size", "source_size", "target", "n", (F.col("offset") + F.col("own")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    copies = F.sequence(F.col("part") * COPIES, F.least(F.col("part") * COPIES + COPIES, F.col("n")) - 1)
    laid = laid.select(*CLASS, "size", "source_size", "target", "start", F.explode(copies).alias("copy"))
    laid = common.saved(laid.withColumn("start", F.col("start") + F.col("copy") * F.col("size")))

    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("key"))
    # A block is never null; said so, it is not worked out once more to see.
    drawn = drawn_slots(targets, seed).select("key", F.coalesce(block, F.lit(-1)).alias("block"), "shard", "slot", F.floor(F.col("j") / F.col("blocks")).alias("round"))
    touched = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS))))
    first = F.greatest(F.col("block") * BLOCK_WORDS - F.col("start"), F.lit(0))
    words = F.least((F.col("block") + 1) * BLOCK_WORDS - F.col("start"), "size") - first
    pieces = touched.select("key", "block", "start", first.alias("first"), words.alias("words"))
    mixed = drawn.hint("merge").join(pieces, ["key", "block"])  # Spark takes what a sequence explodes to for small
    return laid, mixed.select("shard", "slot", "block", "round", "key", "start", "first", "words")


def shard_counts(mixed: DataFrame) -> DataFrame:
    """(shard, key, slots): how many slots each source was drawn for in each shard."""
    return mixed.groupBy("shard", "key").agg(F.countDistinct("slot").alias("slots"))


def taken(laid: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents of `mix` with `taken`, the words the mix takes of each, repeats counted."""
    sums = mixed.groupBy("key", "start").agg(F.sum("words").alias("sum"))
    some = laid.where("size > 0").join(sums, ["key", "start"], "left").select(*laid.columns, F.coalesce("sum", F.lit(0)).cast("long").alias("taken"))
    return some.unionByName(laid.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, with the columns of `docs`: one row per document and round in which words of it are
    taken. A document taken whole in a round keeps its text; of another the words taken follow each other in order,
    each with the blanks before it. Documents of which no word is taken are left out. See `mix` for odd inputs.
    """
    laid, mixed = mix(docs, seed, id_col, text_col, source_col)
    spans = mixed.groupBy("key", "start", "round").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("__spans"), F.sum("words").alias("__taken"))
    spans = spans.join(laid.where("size > 0").select(*CLASS, "start", "copy", "size"), ["key", "start"])
    spans = spans.select(F.col("doc_id").alias("of"), *CLASS[1:], F.floor(F.col("copy") / COPIES).alias("part"), "size", "__spans", "__taken")
    # Of equal rows one is kept with their number. The columns of `docs` travel in one struct, so their names meet no others.
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(docs[c] for c in others)).alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), common.row_mark(docs).alias("mark"), source_key(docs[source_col]).alias("key"))
    rows = rows.groupBy(*CLASS).agg(F.first("row").alias("row"), F.first("text").alias("text"), F.count("*").alias("n"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    both = rows.join(spans, [*CLASS[1:], "part"]).where(F.col("doc_id").eqNullSafe(F.col("of")))
    partly = F.col("__taken") < F.col("size")
    both = both.withColumn("parts", F.when(partly, F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))))
    some = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("parts", (s["first"] + 1).cast("int"), s["words"].cast("int")))), "")
    # Asked for twice, `parts` stays a column of its own; else Spark would find the parts again for every span.
    both = both.withColumn("text", F.when(F.col("parts").isNotNull(), some).otherwise(F.col("text")))
    new = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))
