r"""Quality rules by weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). How far a rule can be trusted is not set by hand:
expectation-maximisation finds, from the votes of all documents, how often each rule gives each vote to good and to
poor ones, and from that each document's probability of being good. Documents above one half are kept, in place of
asking that every rule pass.

All of it is columns and SQL functions. Votes are counted by pattern over the whole table; the patterns number at most
3 ** rules, however large the table, and only their counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Rounds of expectation-maximisation at most, the change of a probability that ends them, and votes added to each
#: count so that no probability is 0.
ROUNDS, SETTLED, ADDED = 500, 1e-9, 1.0


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the counts the rules look at, of whole texts; null and blank texts have none.

    n_words; word_chars, code points in words; n_symbols; n_lines, lines with a word, n_dup_lines, those equal to an
    earlier one; n_distinct_words; n_repeat_words, words in windows of five found twice or more in the text (by
    64-bit hashes); n_capitals, A-Z; n_ends, words that end in a full stop, question or exclamation mark; n_letters, of
    any script; n_symbol_ends, words that end in a symbol.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("w", F.split(F.btrim("text", F.lit(BLANKS)), r"[\x20\x09-\x0D]+"))
    base = base.withColumn("w", F.when(F.col("w")[0] == "", F.array().cast("array<string>")).otherwise(F.col("w")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(common.WORD)))
    base = base.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        F.regexp_count("text", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_symbol_ends"),
    )
    starts = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.element_at("w", i + k) for k in range(WINDOW))))
    base = base.withColumn("h", F.when(F.size("w") > WINDOW, windows)).drop("w")
    # Only texts in which some window comes again are sorted.
    again = F.size(F.array_distinct("h")) < F.size("h")
    base = base.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("s", lambda x, i: F.get("s", i - 1)["h"].eqNullSafe(x["h"]) | F.get("s", i + 1)["h"].eqNullSafe(x["h"]))
    base = base.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gaps = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)).otherwise(0)
    return base.withColumn("n_repeat_words", covered.cast("long")).drop("h", "s", "p")


def votes() -> dict[str, Column]:
    """The rules: 1 for good, -1 for poor, 0 for no opinion."""
    n = F.col("n_words")
    per_word = lambda name: F.col(name) / F.greatest(n, F.lit(1))
    vote = lambda poor, good: F.when(poor, -1).when(good, 1).otherwise(0)
    length, lines = per_word("word_chars"), F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    return {
        "length": vote(n < 10, n >= 50),
        "word_length": vote((length < 2) | (length > 14), (length >= 3) & (length <= 10)),
        "symbols": vote(per_word("n_symbols") > 0.2, per_word("n_symbols") < 0.02),
        "repeated_words": vote(per_word("n_repeat_words") > 0.2, (n >= 20) & (per_word("n_repeat_words") < 0.02)),
        "repeated_lines": vote(lines > 0.3, (F.col("n_lines") >= 3) & (lines == 0)),
        "variety": vote((n >= 20) & (per_word("n_distinct_words") < 0.2), (n >= 20) & (n < 2000) & (per_word("n_distinct_words") > 0.4)),
        "capitals": vote((n >= 10) & (F.col("n_capitals") / F.greatest("word_chars", F.lit(1)) > 0.5), (n >= 10) & (F.col("n_capitals") / F.greatest("word_chars", F.lit(1)) < 0.15)),
        "letters": vote((n >= 10) & (F.col("n_letters") / F.greatest("word_chars", F.lit(1)) < 0.88), F.col("n_letters") / F.greatest("word_chars", F.lit(1)) > 0.92),
        "symbol_words": vote(per_word("n_symbol_ends") > 0.2, per_word("n_symbol_ends") < 0.02),
        "sentences": vote((n >= 100) & (F.col("n_ends") == 0), (per_word("n_ends") > 0.01) & (per_word("n_ends") < 0.3)),
    }


def estimate(patterns: Mapping[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(prior of good, per rule: vote -> its share of the rule's votes on good and on poor ones) from counts of vote
    patterns.

    Abstaining says nothing, so a rule's shares are of the documents it votes on. Rounds begin by taking those with
    any vote against as poor, and end when no pattern's probability changes any more. Without any document the prior is
    one half.
    """
    rules = len(next(iter(patterns), ()))
    good = {p: 0.1 if min(p) < 0 else 0.9 for p in patterns}
    prior, chances = 0.5, [{-1: (0.5, 0.5), 1: (0.5, 0.5)} for _ in range(rules)]
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        prior = min(max(sum(n * good[p] for p, n in patterns.items()) / total, 1e-6), 1 - 1e-6)
        for r in range(rules):
            sums = {(v, k): ADDED + sum(n * (good[p] if k == 0 else 1 - good[p]) for p, n in patterns.items() if p[r] == v) for v in (-1, 1) for k in (0, 1)}
            chances[r] = {v: tuple(sums[v, k] / (sums[-1, k] + sums[1, k]) for k in (0, 1)) for v in (-1, 1)}
        before = good
        z = {p: math.log(prior / (1 - prior)) + sum(math.log(chances[r][v][0] / chances[r][v][1]) for r, v in enumerate(p) if v) for p in patterns}
        good = {p: 1 / (1 + math.exp(-max(min(x, 500), -500))) for p, x in z.items()}
        if max(abs(good[p] - before[p]) for p in patterns) < SETTLED:
            break
    return prior, chances


def accuracies(prior: float, chances: list[dict[int, tuple[float, float]]]) -> list[float]:
    """Of each rule: how often its vote is right."""
    return [prior * c[1][0] + (1 - prior) * c[-1][1] for c in chances]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `features` and `votes` (array in the rules' order), `p_good`, and base_failed: fewer than ten
    words, or more than a fifth of them in repeated windows.

    Repeated rows give repeated results and count as often; rows with a null id are judged too; null, empty and blank
    texts have no words and fail; very long texts are read whole; an empty table gives an empty result. Further columns
    of any name are not looked at and not returned.
    """
    rules = votes()
    rated = common.saved(features(docs, id_col, text_col).withColumn("votes", F.array(*rules.values())))
    counts = {tuple(votes): n for votes, n in rated.groupBy("votes").count().collect()}  # at most 3 ** 10 rows
    prior, chances = estimate(counts)
    z = F.lit(math.log(prior / (1 - prior)))
    for r, c in enumerate(chances):
        weight = {v: math.log(a / b) for v, (a, b) in c.items()}
        z = z + F.when(F.col("votes")[r] > 0, weight[1]).when(F.col("votes")[r] < 0, weight[-1]).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rated.withColumn("p_good", 1 / (1 + F.exp(-z))).withColumn("base_failed", failed)
