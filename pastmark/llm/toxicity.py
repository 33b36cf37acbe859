"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that are in far more toxic than other labelled documents, in tiers by
how sure that is. Features are densities of lexicon words, their nearness to a second person, and rates of capitals,
punctuation and obfuscated spelling. For a document the model is fitted on, the lexicon is counted without its own
third of the documents, so the trees see densities as they will be on new text. The trees are fitted on three quarters
of the labelled sample, the calibration on the rest. Scoring reads each text once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import common

#: Labelled documents to learn from at most, documents that an entry of the lexicon must be in.
MAX_LABELLED, LEAST_DOCS = 10_000, 3
#: Of the learned documents' features, about so many are in one task.
TASK_LABELLED = 1000
#: Entries that the driver and each worker can hold. No entry is ever left out: more are an error.
MOST_TERMS = 2_000_000
#: Deviations above chance for each tier, parts for the left-out lexicons, word beginnings, trees and their depth.
TIERS, FOLDS, BEGINNINGS, TREES, DEPTH = (4.0, 6.0, 9.0), 3, (4, 6), 24, 3
#: Second-person forms in the four languages; characters written for letters.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes su sus vosotros".split()
LOOKALIKES = str.maketrans("013457@$", "oieastas")
UPPER, LOWER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"!?*#%&$@"
#: Words within which a second-person form counts as near.
NEAR = 4
#: Bits of a word's code: tiers by whole words, by beginnings, a second person, obfuscation.
BEGUN, PERSON, ODDLY = 2 * (FOLDS + 1), 4 * (FOLDS + 1), 4 * (FOLDS + 1) + 1


EDGES, OTHERS = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"[\W\d_]+")
ODD = re.compile(r"[^\W\d_][\d@$*_#]+[^\W\d_]|([^\W\d_])\1\1")


def core(word: str) -> str:
    """A word in lower case without what is no letter or digit at its ends."""
    word = word.lower().strip(punctuation)
    return word if word.isalpha() else EDGES.sub("", word)


def letters(word: str) -> str:
    """The letters of a word, as `core` gives it, with characters inside it that stand for letters replaced."""
    return word if word.isalpha() else OTHERS.sub("", word.translate(LOOKALIKES))


def terms(word: bytes) -> tuple[str, ...]:
    w = letters(core(word.decode("utf-8", "replace")))
    return (f"={w}", *(w[:n] for n in BEGINNINGS if len(w) >= n)) if len(w) > 1 else ()


def with_group(sample: DataFrame) -> DataFrame:
    """(doc_id, text, label, grp): copies and most near copies have one `grp`, the least hash of three words running."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in common.sliced(batches):
            groups = []
            for text in batch.column(1).to_pylist():
                w = common.words(text)
                groups.append(min(xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))) >> 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64())], names=["doc_id", "text", "label", "grp"])

    return sample.select("doc_id", "text", F.col("label").cast("long").alias("label")).mapInArrow(run, "doc_id long, text string, label long, grp long")


def fold(grp: Column) -> Column:
    return F.pmod(grp, F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, limit: int) -> DataFrame:
    """doc_id, text, label of labelled documents, at most about `limit`, chosen by a hash of the id; labels without a
    value go, of repeated ones the greatest is taken, and of documents that repeat an id the least text. Held-out ids,
    crc32(id as text) mod 5 = 0, are never in it."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = max(1, -(-known.count() // limit))
    some = common.saved(known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(share)) == 0))
    found = docs.join(common.small(some, some.count(), 16), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_lexicon(sample: DataFrame, most_terms: int = MOST_TERMS) -> dict[str, tuple[int, ...]]:
    """term -> its tier by all of (text, label, grp), then its tiers without each fold: every term of a tier. Of a group
    one document counts, so that words of a text that is copied often seem no surer for it. The sample bounds how many
    there are, as a term is in two of its toxic documents at least; more than `most_terms` are an error."""

    def run(batches: Iterator[pa.RecordBatch]):
        memo = common.Memo(terms)
        schema = pa.schema([("fold", pa.int64()), ("label", pa.int64()), ("terms", pa.list_(pa.string()))])
        for batch in common.sliced(batches):
            found = [sorted({t for w in set(common.words(text)) for t in memo[w]}) for text in batch.column(2).to_pylist()]
            yield common.record_batch(schema, batch.column(0), batch.column(1), found)

    sample = sample.groupBy("grp", "label").agg(F.min("text").alias("text"))
    rows = sample.select(fold(F.col("grp")).alias("fold"), "label", "text").mapInArrow(run, "fold long, label long, terms array<string>")
    of_fold = lambda value, k: F.sum(F.when(F.col("fold") == k, value).otherwise(0))
    counts = lambda value, name: [of_fold(value, k).alias(f"{name}{k}") for k in range(FOLDS)]
    totals = sample.select(fold(F.col("grp")).alias("fold"), "label").agg(*counts(F.lit(1), "n"), *counts(F.col("label"), "t")).first()

    def score(of: list[int]) -> Column:
        docs, toxic = sum(totals[f"n{k}"] or 0 for k in of), sum(totals[f"t{k}"] or 0 for k in of)
        share = max(toxic, 1) / max(docs, 1)
        n, t = (sum((F.col(f"{name}{k}") for k in of[1:]), F.col(f"{name}{of[0]}")) for name in "nt")
        return F.when((n > 0) & (t >= LEAST_DOCS - (len(of) < FOLDS)), (t - n * share) / F.sqrt(n * share * max(1 - share, 0.01))).otherwise(0.0)

    parts = [list(range(FOLDS)), *([k for k in range(FOLDS) if k != out] for out in range(FOLDS))]
    seen = rows.select("fold", "label", F.explode("terms").alias("term")).groupBy("term").agg(*counts(F.lit(1), "n"), *counts(F.col("label"), "t"))
    scored = seen.select("term", *(score(of).alias(f"z{i}") for i, of in enumerate(parts))).where(F.greatest(*(F.col(f"z{i}") for i in range(len(parts)))) >= TIERS[0])
    scored = common.saved(scored)
    if (n := scored.count()) > most_terms:
        raise ValueError(f"{n} terms in the lexicon, more than {most_terms}: learn from fewer labelled documents")
    return {r["term"]: tuple(sum(r[f"z{i}"] >= t for t in TIERS) for i in range(len(parts))) for r in scored.collect()}  # counted


class Coder:
    """The code of a word: two bits for its tier in each lexicon, by the whole word and by its beginnings, two marks."""

    def __init__(self, lexicon: dict[str, tuple[int, ...]]):
        packed = {t: sum(tier << 2 * i for i, tier in enumerate(tiers)) for t, tiers in lexicon.items()}
        self.whole = {t[1:]: code for t, code in packed.items() if t[0] == "="}
        self.begun = {t: code << BEGUN for t, code in packed.items() if t[0] != "="}
        self.second = set(SECOND_PERSON)

    def __call__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        own = core(text)
        w = letters(own)
        out = (own in self.second) << PERSON | (ODD.search(text) is not None) << ODDLY
        if len(w) < 2:
            return out
        out |= self.whole.get(w, 0)
        found = [c for n in BEGINNINGS if len(w) >= n and (c := self.begun.get(w[:n]))]
        if len(found) == 1:
            return out | found[0]
        return out | sum(max(c >> BEGUN + 2 * i & 3 for c in found) << BEGUN + 2 * i for i in range(FOLDS + 1)) if found else out


#: Kinds of bytes that are counted in a text, as one table of bits.
BYTE_KINDS = np.array([sum((b in kind) << i for i, kind in enumerate((UPPER, LOWER, MARKS, b"!?", b"\n"))) for b in range(256)], np.uint8)


def feature_rows(texts: pa.Array, part: np.ndarray, memo: common.Memo) -> np.ndarray:
    """A row of features per text. `part`: 0 for the whole lexicon, k for the one without fold k - 1."""
    said = common.Words.of(texts)
    code_of = said.each(memo, np.int32)
    once, codes, of = said.once(), code_of[said.index], said.text_of.astype(np.int32)
    person = codes >> PERSON & 1
    near = person.copy()
    for shift in range(1, NEAR + 1):
        same = of[shift:] == of[:-shift]
        near[shift:] |= person[:-shift] & same
        near[:-shift] |= person[shift:] & same
    words = np.maximum(said.n, 1)
    rows = [np.log1p(said.n), said.sums(person) / words, said.sums(codes >> ODDLY & 1) / words]
    part = part.astype(np.int32)
    shift, shift_once = 2 * part[of], 2 * np.repeat(part, once.n)
    for kind in (0, BEGUN):
        tier, tier_once = codes >> kind + shift & 3, code_of[once.index] >> kind + shift_once & 3
        for k in range(1, len(TIERS) + 1):
            hits = tier >= k
            rows += [said.sums(hits) / words, np.log1p(once.sums(tier_once >= k)), said.sums(hits & (near > 0)) / words]
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    kinds = BYTE_KINDS[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    upper, lower, marks, calls, breaks = (common.sums(kinds >> i & 1, ends - ends[0]) for i in range(5))
    n_bytes = np.diff(ends)
    size = np.maximum(n_bytes, 1)
    rows += [upper / np.maximum(1, upper + lower), marks / size, calls / size, breaks / size, once.n / words, (n_bytes - said.n) / words]
    return np.stack(rows, axis=1).astype(float)


def features(rows: DataFrame, lexicon: dict[str, tuple[int, ...]]) -> DataFrame:
    """From (row, part, text): row, whatever it is, and an array of features; see `feature_rows`. Without a column text it
    is the field of that name in row, so that it need not travel twice."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most MOST_TERMS entries
    apart = "text" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]):
        memo = common.Memo(Coder(sent.value))
        for batch in common.sliced(batches):
            texts = batch.column(2) if apart else batch.column(0).field("text")
            found = feature_rows(texts, np.asarray(batch.column(1), np.int64), memo)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "features"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("features", ArrayType(DoubleType()))])
    return rows.select("row", F.col("part").cast("int").alias("part"), *(["text"] if apart else [])).mapInArrow(run, schema)


@dataclass
class ToxicityModel:
    lexicon: dict[str, tuple[int, ...]]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    rate: float  # the score where there are no trees

    def _scored(self, rows: DataFrame) -> DataFrame:
        """From (row, text), or row with a field text: row and score."""
        if self.trees is None:
            return rows.select("row", F.lit(self.rate).alias("score"))
        vectors = features(rows.withColumn("part", F.lit(0)), self.lexicon).select("row", array_to_vector("features").alias("features"))
        raw = self.trees.transform(vectors).withColumn("raw", vector_to_array("probability")[1])
        # The curve is a stair; a hundredth of the raw probability orders what is on one step.
        score = F.lit(0.99) * F.col("calibrated") + F.lit(0.01) * F.col("raw")
        return self.curve.transform(raw.select("row", "raw")).select("row", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row: doc_id, held_out, score from 0 to 1, predicted (1 if the score is 0.5 or more). Only the text is
        scored. Null and empty texts are scored as texts without words; null ids stay; very long texts are read whole,
        in one go; repeated rows give repeated results; an empty table gives an empty one. Further columns of any name
        are not looked at and not returned."""
        scored = self._scored(docs.select(docs[id_col].cast("long").alias("row"), docs[text_col].alias("text"))).withColumnRenamed("row", "doc_id")
        return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def clean(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows of `docs`, with their columns, that are not predicted toxic. Each row is judged by its own text,
        whatever its id; for odd texts see `score`. The columns travel in one, so their names meet no others."""
        names = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)}
        kept = self._scored(docs.select(F.struct(*(docs[c].alias(n) for c, n in names.items())).alias("row"))).where("score < 0.5")
        return kept.select(*(F.col("row").getField(n).alias(c) for c, n in names.items()))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, most_terms: int = MOST_TERMS) -> ToxicityModel:
    """Learn from at most about `max_labelled` labelled documents that are not held out, with a lexicon of all their
    terms that reach a tier. With fewer than 20 documents, or all of one label, there are no trees and every score is the
    share of toxic ones (0 without any). Null and empty texts count as texts without words; very long ones are read
    whole; for repeated ids see `labelled_sample`; further columns, whatever their names, are not looked at."""
    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sample = common.saved(with_group(labelled_sample(chosen, labels, F.col(label_col).cast("int"), max_labelled)))
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n < 20 or toxic in (0, n):
        return ToxicityModel({}, None, None, toxic / n if n else 0.0)
    lexicon = learn_lexicon(sample, most_terms)
    rows = sample.select(F.struct("doc_id", F.col("label").cast("double").alias("label")).alias("row"), "text", (fold(F.col("grp")) + 1).alias("part"))
    rows = common.saved(features(rows, lexicon).select("row.doc_id", "row.label", array_to_vector("features").alias("features")))
    apart = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4)) == 0
    # Each level of each tree is a job over all partitions; the sample is counted and small.
    train, judge = common.gathered(rows.where(~apart).orderBy("doc_id"), n, TASK_LABELLED), common.gathered(rows.where(apart), n, TASK_LABELLED)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1, minInstancesPerNode=2).fit(train)
    judged = trees.transform(judge).select("label", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(judged)
    return ToxicityModel(lexicon, trees, curve, toxic / n)
