"""The registered queries of the operators, over whole tables, and what of them DuckDB can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, secrets, spelling, token_counts, topk, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).score(docs)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid, mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(laid, mixed).select("doc_id", "size", F.col("source_size").cast("long"), "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = token_counts.byte_level_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_pieces(table(spark, sf_dir, "documents"), pieces)


def graded() -> Column:
    """0: of low quality; 1: of high quality, but toxic; 2: of high quality and not toxic."""
    return (F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))).cast("int")


def op5_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.fit(docs, table(spark, sf_dir, "labels"), graded(), 3).score(docs)
    tails = [F.col("tails")[j].alias(f"p_above_{j}") for j in range(2)]
    return scored.select("doc_id", "held_out", "expected_grade", *tails, (F.col("tails")[0] >= 0.5).alias("kept"))


def tokens() -> packing.Tokens:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f, open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as g:
        return packing.Tokens(f.read(), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, 0, g.read())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokens())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 100 = 0"), 10)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select(*base, (~F.col("base_failed") & (F.col("p_good") > 0.5)).alias("kept"), "p_good")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 0.85)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_secret_scan, op3_source_mix, op4_token_counts, op5_quality_grades, op6_packing, op7_line_dedup, op8_exact_topk, op9_quality_rules, op10_near_dedup,
        op11_fingerprints, op12_spelling_variants, op13_whitening,
    )
}

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _kind(order: int, rule: secrets.Rule) -> str:
    """Spans of one kind: matches and the stretches between them give the positions."""
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))).replace("'", "''")
    return f"""k{order} AS (SELECT doc_id, {order} AS ord, '{rule.kind}' AS kind, unnest(m) AS hit, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS a
FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d) WHERE len(m) > 0),
f{order} AS (SELECT *, a + length(hit) AS b FROM k{order} WHERE length(regexp_extract(hit, '{pattern}', {rule.group})) >= {rule.least})"""


def _secrets_sql() -> str:
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    parts = ",\n".join(_kind(i, r) for i, r in enumerate(rules))
    every = " UNION ALL ".join(f"SELECT doc_id, ord, kind, a, b FROM f{i}" for i in range(len(rules)))
    joined = "coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, ord)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{parts},
s AS ({every})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
sha256({joined} FILTER (ord < 3), '')) AS base_sha256, {joined} FILTER (ord IS NOT NULL), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": _secrets_sql(),
    "op7_line_dedup": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM k LEFT JOIN h ON h.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1""",
    "op8_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "op10_near_dedup": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op12_spelling_variants": rf"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c FROM range(256) r(i))),
u AS (SELECT doc_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM u GROUP BY 1, 2),
b AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(bytes, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c // 256, tab[xor(c, x) % 256 + 1]), CAST(4294967295 AS BIGINT))) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM p),
k AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
UNION SELECT d.word, w.word FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word FROM d JOIN w ON w.word = d.rest),
o AS (SELECT a, b, y.n AS n, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) AS place, count(*) OVER (PARTITION BY a) AS n_near FROM k JOIN w y ON y.word = b),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 2 * w.n THEN b END AS form, CASE WHEN o.n >= 2 * w.n THEN o.n END AS form_n FROM w LEFT JOIN o ON o.a = w.word AND place = 1),
g AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON f.word = g.up)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN g ON g.word = f.word WHERE up IS NULL""",
}
