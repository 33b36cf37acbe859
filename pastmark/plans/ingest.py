"""Raw documents, built from the events of a user and day, and their way back to rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pastmark.functions import columns as C
from pastmark.operators import profile as P
from pastmark.operators import quality as Q
from pastmark.operators.state import new_folder, saved
from pastmark.sources import documents as D
from pastmark.plans.base import Registry, table

register = Registry()
FIELDS = ("id", "kind", "amount", "day")


#: Event ids that a page of a user's day spans at most, so no document grows with the table.
PAGE = 5000


def raw(spark, sf_dir, page=PAGE):
    """(file_id, body): a document per user, day and page of event ids; one item alone is an object, not an array. Events
    have one id each, so a page has at most so many items as its span."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    item = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.format_string("%.2f", "value").alias("amount"), day.alias("day")))
    docs = e.select(F.concat_ws("-", "user_id", day, F.floor(F.col("event_id") / page)).alias("file_id"), "event_id", item.alias("item")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "item")))["item"].alias("items"))
    many = F.when(F.size("items") == 1, F.col("items")[0]).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    body = F.concat(F.lit('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":'), F.size("items"), F.lit(',"items":{"item":'), many, F.lit("}}}}"))
    return docs.select("file_id", body.alias("body"))


ROWS = """e0 AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') || '-' || event_id // 5000 AS file_id FROM events),
e AS (SELECT file_id, user_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS INTEGER) AS position, CAST(event_id AS VARCHAR) AS id, event_type AS kind, value, strftime(ts, '%Y%m%d') AS day FROM e0)"""


@register(f"WITH {ROWS} SELECT file_id, position, sha256(file_id || ':' || position) AS row_id, id, kind, CAST(strptime(day, '%Y%m%d') AS DATE) AS day, round(CAST(value AS DECIMAL(18, 2)), 2)::DOUBLE AS amount FROM e")
def explode_documents(spark, sf_dir):
    rows = D.exploded(raw(spark, sf_dir), FIELDS)
    return rows.select("file_id", "position", "row_id", "id", "kind", C.parse_date(F.col("day")).alias("day"), F.col("amount").try_cast("double").alias("amount"))


@register(f"WITH {ROWS}, x AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN '-' || id WHEN CAST(id AS BIGINT) % 3 = 0 THEN '1,' || lpad(id, 3, '0') ELSE id || '.5' END AS text FROM e) SELECT kind, count(*) AS n_rows, count(*) FILTER (CAST(id AS BIGINT) % 5 <> 0 AND CAST(id AS BIGINT) % 3 = 0) AS n_valid, CAST(sum(CASE WHEN CAST(id AS BIGINT) % 5 <> 0 AND CAST(id AS BIGINT) % 3 = 0 THEN CAST(replace(text, ',', '') AS BIGINT) END) AS DOUBLE) AS total FROM x GROUP BY 1")
def parse_amounts(spark, sf_dir):
    rows = D.exploded(raw(spark, sf_dir), FIELDS)
    n = F.col("id").cast("long")
    text = F.when(n % 5 == 0, F.concat(F.lit("-"), "id")).when(n % 3 == 0, F.concat(F.lit("1,"), F.lpad("id", 3, "0"))).otherwise(F.concat("id", F.lit(".5")))
    value, valid = C.parse_amount(F.col("text"))
    return rows.withColumn("text", text).groupBy("kind").agg(F.count("*").alias("n_rows"), F.count_if(valid).alias("n_valid"), F.sum(value).cast("double").alias("total"))


@register("""WITH r AS (SELECT o_custkey % 7 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'NO_DATA' ELSE 'API_ERROR' END AS status FROM orders)
SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'NO_DATA') AS no_data, count(*) FILTER (status = 'API_ERROR') AS failed FROM r GROUP BY 1""")
def batch_rollup(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "NO_DATA").otherwise("API_ERROR")
    return D.batch_rollup(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("batch_id"), status.alias("status")))


def stored(spark, sf_dir):
    """(file_id, user, body, http_status): the documents as answers, of which some users' are faulty."""
    docs = raw(spark, sf_dir).withColumn("user", F.split("file_id", "-")[0].cast("long"))
    k, body = F.col("user") % 10, F.col("body")
    faulty = F.when(k == 0, " ").when(k == 1, F.concat(F.lit("{"), body)).when(k == 3, F.lit('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":0,"items":""}}}')).when(k == 4, F.regexp_replace(body, "resultCode", "code")).when(k == 5, F.regexp_replace(body, '"00"', '"22"')).otherwise(body)
    return docs.select("file_id", "user", faulty.alias("body"), F.when(k == 2, 500).otherwise(200).alias("http_status"))


@register(f"""WITH {ROWS}, d AS (SELECT file_id, max(user_id) AS u, min(kind) AS lo, max(kind) AS hi FROM e GROUP BY 1)
SELECT CASE u % 10 WHEN 0 THEN 'EMPTY_BODY' WHEN 1 THEN 'INVALID_JSON' WHEN 2 THEN 'API_ERROR' WHEN 3 THEN 'NO_DATA' WHEN 4 THEN 'INVALID_SCHEMA' WHEN 5 THEN 'API_ERROR' ELSE CASE WHEN lo = 'click' AND hi = 'click' THEN 'SUCCESS' ELSE 'REQUEST_MISMATCH' END END AS status, count(*) AS n_files FROM d GROUP BY 1""")
def payload_status(spark, sf_dir):
    """All outcomes of an answer."""
    return stored(spark, sf_dir).groupBy(D.payload_status(F.col("body"), F.col("http_status"), F.lit("click"), "kind").alias("status")).agg(F.count("*").alias("n_files"))


@register("""WITH r AS (SELECT o_orderkey AS request_id, o_custkey % 7 AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'NO_DATA' ELSE 'API_ERROR' END AS status, o_totalprice FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY o_totalprice, request_id) AS request_no FROM r), f AS (SELECT DISTINCT l_orderkey AS request_id, 'f' || l_orderkey || '-' || l_linenumber AS file_id FROM lineitem)
SELECT request_no, request_id, file_id FROM n JOIN f USING (request_id) WHERE status = 'SUCCESS' AND batch_id = 3""")
def manifest_scan(spark, sf_dir):
    """The files of one batch's successful requests, in the order of requests."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "NO_DATA").otherwise("API_ERROR")
    requests = o.select(key.alias("request_id"), (F.col("o_custkey") % 7).alias("batch_id"), status.alias("status"), "o_totalprice").withColumn("request_no", F.row_number().over(Window.partitionBy("batch_id").orderBy("o_totalprice", "request_id")))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("f"), "l_orderkey", F.lit("-"), "l_linenumber").alias("file_id")).distinct()
    return D.manifest_scan(requests.select("batch_id").distinct(), requests, files, 3).select("request_no", "request_id", "file_id")


#: Users of a day that share a stored file.
SHARES = 4
FILES = f"""f0 AS (SELECT *, strftime(ts, '%Y%m%d') || '-' || user_id % {SHARES} || '-' || event_id // {PAGE} AS file_id, day(ts) * {SHARES} + user_id % {SHARES} AS f FROM events),
f AS (SELECT file_id, any_value(f) AS f, count(*) AS n_items FROM f0 GROUP BY 1)"""


def stored_batch(spark, sf_dir):
    """Documents of many users' events of a day, written as files with a manifest, some of them faulty: (folder of the
    files, path of the manifest). Of every 13 files one is missing, one longer, one changed, one not listed."""
    e, day, page = table(spark, sf_dir, "events"), F.date_format("ts", "yyyyMMdd"), F.floor(F.col("event_id") / PAGE)
    item = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.format_string("%.2f", "value").alias("amount"), day.alias("day"), F.struct(F.array(F.col("user_id"), F.col("event_id")).alias("of")).alias("more")))
    rows = e.select(F.concat_ws("-", day, F.col("user_id") % SHARES, page).alias("file_id"), (F.dayofmonth("ts") * SHARES + F.col("user_id") % SHARES).alias("f"), "event_id", item.alias("item"))
    docs = rows.groupBy("file_id").agg(F.first("f").alias("f"), F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "item")))["item"], ",").alias("items"), F.count("*").alias("n"))
    body = F.concat(F.lit('{"response":{"header":{"resultCode":"00"},"body":{"totalCount":'), "n", F.lit(',"items":{"item":['), "items", F.lit("]}}}}"))
    docs, f = saved(docs.select("file_id", "f", body.alias("body"))), F.col("f")
    folder = new_folder(spark, "stored")
    kept = F.when(f % 13 == 4, F.concat("body", F.lit(" "))).when(f % 13 == 5, F.concat(F.lit("["), F.substr("body", F.lit(2)))).otherwise(F.col("body"))
    D.store_documents(docs.where(f % 13 != 3).select("file_id", kept.alias("body")), f"{folder}/files")
    whole = F.concat("body", F.lit("\n")).cast("binary")  # as a line of text ends
    status = F.when(f % 7 == 0, "API_ERROR").otherwise("SUCCESS")
    manifest = docs.where(f % 13 != 6).select("file_id", F.col("file_id").alias("request_id"), f.alias("request_no"), F.lit("batch").alias("batch_id"), status.alias("status"), F.length(whole).cast("long").alias("size"), F.sha2(whole, 256).alias("sha256"))
    manifest.write.json(f"{folder}/manifest")
    return f"{folder}/files", f"{folder}/manifest"


MANIFEST = "file_id string, request_id string, request_no int, batch_id string, status string, size long, sha256 string"


@register(f"""WITH {FILES} SELECT file_id, CASE f % 13 WHEN 3 THEN 'MISSING' WHEN 4 THEN 'SIZE' WHEN 5 THEN 'HASH' ELSE 'UNLISTED' END AS issue FROM f WHERE f % 13 BETWEEN 3 AND 6""")
def file_audit(spark, sf_dir):
    """Files as they are stored against their manifest, both read from the file system."""
    files, manifest = stored_batch(spark, sf_dir)
    return D.file_audit(spark.read.schema(MANIFEST).json(manifest), D.stored_documents(spark, files))


@register(f"""WITH {FILES} SELECT CAST(f AS INTEGER) AS request_no, f0.file_id, row_number() OVER (PARTITION BY f0.file_id ORDER BY event_id) AS position, CAST(event_id AS VARCHAR) AS id, '{{"of":[' || user_id || ',' || event_id || ']}}' AS more
FROM f0 WHERE f % 13 NOT BETWEEN 3 AND 6 AND f % 7 <> 0""")
def stored_items(spark, sf_dir):
    """Items of the sound files of a batch's successful requests: manifest, audit and files from the file system. Nested
    values stay as text."""
    files, manifest = stored_batch(spark, sf_dir)
    listed, stored = spark.read.schema(MANIFEST).json(manifest), D.stored_documents(spark, files)
    wanted = D.manifest_scan(listed.select("batch_id").distinct(), listed.select("batch_id", "request_id", "request_no", "status"), listed.select("request_id", "file_id"), "batch")
    sound = stored.join(D.file_audit(listed, stored).select("file_id"), "file_id", "left_anti").select("file_id", F.col("content").cast("string").alias("body"))
    rows = D.exploded(sound, ["id", "more"]).join(wanted.select("file_id", "request_no"), "file_id")
    return rows.select("request_no", "file_id", F.col("position").cast("long").alias("position"), "id", "more")


@register("""SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, 'second' AS version FROM orders GROUP BY ALL""")
def layer_rebuild(spark, sf_dir):
    """A layer that is written three times: the second, audited version takes the first one's place, the third breaks a rule of the
    audit and is refused, so the second is what readers get."""
    orders = table(spark, sf_dir, "orders")
    layer = lambda rows, version: rows.groupBy(F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")).withColumn("version", F.lit(version))
    folder, n = new_folder(spark, "layer"), orders.count()

    def audit(rows):
        repeated = Q.repeated_keys(rows, ["status", "year"]).agg(F.count("*").alias("n_broken")).select(F.lit("repeated_keys").alias("rule"), "n_broken")
        lost = rows.agg((F.lit(n) - F.coalesce(F.sum("n_orders"), F.lit(0))).alias("n_broken")).select(F.lit("lost_orders").alias("rule"), F.abs("n_broken").alias("n_broken"))
        return repeated.unionByName(lost)

    D.write_versioned(layer(orders.where("o_orderkey > 0"), "first"), folder, "1")
    D.write_versioned(layer(orders, "second"), folder, "2", ["year"], audit)
    third = layer(orders, "third")
    try:
        D.write_versioned(third.unionByName(third.where("status = 'F'")), folder, "3", audit=audit)
    except D.Refused:
        pass  # as it must be
    else:
        raise AssertionError("a faulty version was not refused")
    return D.read_current(spark, folder).select("status", "year", "n_orders", "total", "version")


@register("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'a "quoted", part' END AS note FROM customer""")
def csv_export(spark, sf_dir):
    """A query exported as CSV with a header and read again: texts with quotes and commas stay, NULL and blank are one."""
    note = F.when(F.col("c_custkey") % 5 == 0, 'a "quoted", part')
    folder = new_folder(spark, "export")
    D.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", note.alias("note")), folder)
    return spark.read.option("header", True).option("escape", '"').csv(folder)


@register(f"""WITH {ROWS}, x AS (SELECT e.*, CAST(id AS BIGINT) AS k, user_id % 6 AS run FROM e), loaded AS (SELECT run, count(*) AS n FROM x GROUP BY 1) SELECT count(*) AS n_rows, count(*) FILTER (k % 97 = 0) AS orphans, count(*) FILTER (k % 89 = 0 AND k % 97 <> 0) AS wrong_row_id, (SELECT count(*) FROM (SELECT file_id FROM x WHERE k % 97 <> 0 GROUP BY 1 HAVING count(*) <> max(position) OR min(position) <> 1)) AS files_with_gaps, count(*) FILTER (k % 83 = 0) AS wrong_flag,
count(*) FILTER (user_id % 79 = 0 AND k % 97 <> 0) AS wrong_hash, count(*) FILTER (run = 4) AS unfinished, (SELECT count(*) FROM loaded WHERE run = 2) + 1 AS runs_of_other_size FROM x""")
def staging_audit(spark, sf_dir):
    """Staged rows with planted faults against their documents and the log of their runs: rows of no document, row ids,
    sequence, parse flags, contents that have changed since, runs that have not ended or say another number of rows."""
    docs = saved(raw(spark, sf_dir).withColumn("user", F.split("file_id", "-")[0].cast("long")))
    rows, k = D.exploded(docs, FIELDS), F.col("id").cast("long")
    seen = docs.select("file_id", (F.col("user") % 6).alias("run_id"), F.sha2(F.when(F.col("user") % 79 == 0, F.concat("body", F.lit(" "))).otherwise(F.col("body")).cast("binary"), 256).alias("content_hash"))
    rows = rows.join(seen, "file_id").withColumn("valid", C.parse_int(F.col("id"))[1] != (k % 83 == 0)).withColumn("row_id", F.when(k % 89 == 0, "wrong").otherwise(F.col("row_id"))).withColumn("file_id", F.when(k % 97 == 0, F.concat(F.lit("none-"), "id")).otherwise(F.col("file_id")))
    rows = saved(rows)
    log = rows.groupBy("run_id").agg((F.count("*") + F.when(F.first("run_id") == 2, 1).otherwise(0)).alias("n_rows")).withColumn("status", F.when(F.col("run_id") == 4, "RUNNING").otherwise("COMPLETED"))
    log = log.unionByName(spark.range(1).select(F.lit(99).cast("long").alias("run_id"), F.lit(7).cast("long").alias("n_rows"), F.lit("COMPLETED").alias("status")))
    return D.staging_audit(rows, docs, "id", "valid", log)


@register(f"""WITH {ROWS}, x AS (SELECT unnest([{{'f': 'id', 'v': id}}, {{'f': 'kind', 'v': CASE WHEN user_id % 3 = 0 THEN ' ' ELSE kind END}}, {{'f': 'amount', 'v': printf('%.2f', round(CAST(value AS DECIMAL(18, 2)), 2))}}, {{'f': 'day', 'v': day}}]) AS z FROM e)
SELECT z.f AS field, count(*) AS n_rows, count(*) FILTER (trim(z.v) = '') AS n_blank, count(*) FILTER (regexp_full_match(z.v, '[+-]?[0-9]+')) AS n_integer, count(*) FILTER (regexp_full_match(z.v, '[+-]?[0-9]*[.][0-9]+')) AS n_decimal, count(DISTINCT z.v) AS n_distinct FROM x GROUP BY 1""")
def raw_profile(spark, sf_dir):
    """The fields of staged rows: how many are blank, whole, decimal, distinct."""
    rows = D.exploded(raw(spark, sf_dir), FIELDS)
    rows = rows.withColumn("kind", F.when(F.split("file_id", "-")[0].cast("long") % 3 == 0, " ").otherwise(F.col("kind")))
    return P.field_types(rows, FIELDS)


@register(f"WITH {ROWS} SELECT file_id, position, id FROM e WHERE day > (SELECT min(day) FROM e)")
def idempotent_load(spark, sf_dir):
    """The second load of a batch that holds the first day's rows already."""
    rows = D.exploded(raw(spark, sf_dir), FIELDS)
    first = rows.agg(F.min("day").alias("first_day"))
    loaded = rows.join(F.broadcast(first), F.col("day") == F.col("first_day"))  # one row
    return D.new_rows(rows, loaded).select("file_id", "position", "id")


@register(f"""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT unnest(['복식', '쌍식']) AS pool), x AS (SELECT l_orderkey, pool, n FROM g, k WHERE n BETWEEN 2 AND 16)
SELECT l_orderkey, pool, 1::INTEGER AS combination_no, CASE pool WHEN '복식' THEN [1, n] ELSE [n, 1] END::INTEGER[] AS members, pool = '쌍식' AS ordered, CAST(n AS DOUBLE) / 2 AS odds FROM x""")
def parse_combinations(spark, sf_dir):
    """All orders in two pools with one combination each; orders of one member or more than 16 are rejected by the
    parser. `parse_pools` has all pools and the rejected texts."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    rows = g.withColumn("pool", F.explode(F.array(F.lit("복식"), F.lit("쌍식"))))
    text = F.concat(_token(F.col("n")), F.lit("①-"), F.format_string("%.1f", F.col("n") / 2))
    good, _ = D.winning_combinations(rows.withColumn("odds", text))
    return good.select("l_orderkey", "pool", "combination_no", "members", "ordered", F.col("odds_value").cast("double").alias("odds"))


def _token(x):
    return F.when(x <= len(D.CIRCLED), F.substring(F.lit(D.CIRCLED), x, F.lit(1))).otherwise(F.concat(F.lit("("), x.cast("string"), F.lit(")")))


def combination_texts(orders):
    """(l_orderkey, pool, odds) from (l_orderkey, n): up to three combinations a text for each of the seven pools. The
    first member is n, or n less 0 to 2 for pools of one pick; the others count up from the combination's number, so
    small orders repeat a member and are broken. Members above 15 stand in brackets; above 16 there are none, and the
    parser rejects them."""
    j, n = F.col("j"), F.col("n")
    members = {1: [n - j + 1], 2: [n, j], 3: [n, j, j + 1]}
    combination = lambda picks: F.concat(*(_token(x.cast("int")) for x in members[picks]), F.lit("-"), F.format_string("%.1f", (n + j) / 2))
    items = orders.withColumn("j", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(3)).cast("int"))))
    items = items.select("l_orderkey", "j", F.explode(F.array(*(F.struct(F.lit(pool).alias("pool"), combination(picks).alias("item")) for pool, picks in D.PICKS.items()))).alias("x"))
    texts = items.groupBy("l_orderkey", "x.pool").agg(F.array_sort(F.collect_list(F.struct("j", "x.item")))["item"].alias("items"))
    return texts.select("l_orderkey", "pool", F.array_join("items", "  ").alias("odds"))


@register()
def parse_pools(spark, sf_dir):
    """No SQL: compared with a parser by hand. All orders in all seven pools; a rejected text is a row of its own, with
    the text and no members."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    good, rejected = D.winning_combinations(combination_texts(n))
    good = good.select("l_orderkey", "pool", F.lit(False).alias("rejected"), "combination_no", "members", "ordered", F.col("odds_value").cast("double").alias("odds"), F.lit(None).cast("string").alias("text"))
    return good.unionByName(rejected.select("l_orderkey", "pool", F.lit(True).alias("rejected"), F.col("odds").alias("text")), allowMissingColumns=True)


@register("""WITH s AS (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, CAST(round(l_extendedprice / 1000, 1) AS DECIMAL(8, 1)) AS total, CAST(l_partkey % 30 AS DECIMAL(8, 1)) AS passed FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE CAST(q AS INTEGER) END AS kg, CASE l_linenumber % 4 WHEN 0 THEN l_linenumber WHEN 1 THEN 0 ELSE NULL END::INTEGER AS change,
CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'wet' ELSE 'dry' END AS track, CASE WHEN l_linenumber = 7 OR l_linenumber % 2 = 0 THEN l_linenumber END::INTEGER AS percent, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(q AS DOUBLE) END AS seconds,
CAST(CASE WHEN l_suppkey % 3 = 0 THEN total - passed ELSE total - passed + 1 END AS DOUBLE) AS split, CASE WHEN l_suppkey % 3 = 0 THEN 'TOTAL_LESS_PASSED' ELSE 'DIRECT' END AS mapping FROM s""")
def semantic_view(spark, sf_dir):
    """Texts of weights, tracks and times, and what they say; the last split by the way its venue gives it, and which way
    that is."""
    rows, tenth = _semantic_texts(spark, sf_dir), "decimal(8,1)"
    total, passed = F.round(F.col("l_extendedprice") / 1000, 1).cast(tenth), (F.col("l_partkey") % 30).cast(tenth)
    by_difference, direct = F.col("l_suppkey") % 3 == 0, total - passed + F.lit(1).cast(tenth)
    (kg, change), (label, percent) = C.parse_weight(F.col("w")), C.parse_track(F.col("t"))
    split = C.split_seconds(by_difference, total, passed, direct).cast("double")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", kg.alias("kg"), change.alias("change"), label.alias("track"), percent.alias("percent"), C.parse_seconds(F.col("s")).cast("double").alias("seconds"), split.alias("split"), C.mapping_label(by_difference).alias("mapping"))


def _semantic_texts(spark, sf_dir):
    """Line items with texts of weight, track and time; some are broken."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    weight = F.when(n % 4 == 0, F.concat(q, F.lit("(+"), n, F.lit(")"))).when(n % 4 == 1, F.concat(q, F.lit("()"))).when(n % 4 == 2, q).otherwise("broken")
    track = F.when(n == 7, F.concat(F.lit("("), n, F.lit("%)"))).when(n % 2 == 0, F.concat(F.lit("wet ("), n, F.lit("%)"))).otherwise("dry")
    return table(spark, sf_dir, "lineitem").select("*", weight.alias("w"), track.alias("t"), F.when(n % 3 == 0, F.lit("0")).otherwise(q).alias("s"))


@register("""WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem) SELECT count(*) AS n_rows, count(DISTINCT l_orderkey || '-' || l_partkey || '-' || l_linenumber) AS n_ids, count(*) FILTER (l_linenumber % 4 = 3) AS broken_weights, count(*) FILTER (l_linenumber = 7) AS broken_tracks, count(*) FILTER (l_linenumber % 5 = 0) AS broken_times, count(*) FILTER (l_linenumber % 4 <> 3) AS n_weights, CAST(max(CASE WHEN l_linenumber % 4 <> 3 THEN CAST(q AS INTEGER) END) AS INTEGER) AS heaviest FROM s""")
def semantic_audit(spark, sf_dir):
    """What the texts of weights, tracks and times give: rows, ids, and texts that are there but say nothing."""
    n = F.col("l_linenumber")
    rows = _semantic_texts(spark, sf_dir).withColumn("s", F.when(n % 5 == 0, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))).withColumn("id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber"))
    (kg, _), (label, _), seconds = C.parse_weight(F.col("w")), C.parse_track(F.col("t")), C.parse_seconds(F.col("s"))
    silent = lambda value, text: F.count_if(value.isNull() & C.blank_to_null(F.col(text)).isNotNull())
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), silent(kg, "w").alias("broken_weights"), silent(label, "t").alias("broken_tracks"), silent(seconds, "s").alias("broken_times"), F.count(kg).alias("n_weights"), F.max(kg).alias("heaviest"))


@register(f"""WITH {ROWS}, r AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE CAST(id AS BIGINT) % 101 = 0), other AS (SELECT DISTINCT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 103 <> 0 UNION ALL SELECT 'none' AS id),
f AS (SELECT unnest([{{'f': 'id', 'v': id}}, {{'f': 'kind', 'v': kind}}, {{'f': 'day', 'v': day}}]) AS z FROM r), k AS (SELECT id, count(*) AS n FROM r GROUP BY 1), u AS (SELECT count(*) FILTER (k.id IS NOT NULL AND o.id IS NOT NULL) AS shared, count(*) FILTER (o.id IS NULL) AS only_left, count(*) FILTER (k.id IS NULL) AS only_right FROM k FULL JOIN other o ON o.id = k.id)
SELECT 'field:' || z.f AS section, unnest(['n_rows', 'n_blank', 'n_integer', 'n_distinct']) AS measure, unnest([count(*), count(*) FILTER (trim(z.v) = ''), count(*) FILTER (regexp_full_match(z.v, '[+-]?[0-9]+')), count(DISTINCT z.v)]) AS value FROM f GROUP BY z.f
UNION ALL SELECT 'key', unnest(['n_rows', 'n_keys', 'n_repeated_keys', 'n_distinct_rows']), unnest([(SELECT count(*) FROM r), (SELECT count(*) FROM k), (SELECT count(*) FROM k WHERE n > 1), (SELECT count(*) FROM (SELECT DISTINCT file_id, position, id, kind, day FROM r))])
UNION ALL SELECT 'reconciliation', unnest(['shared', 'only_left', 'only_right']), unnest([shared, only_left, only_right]) FROM u""")
def raw_report(spark, sf_dir):
    """One report on a batch of staged rows: its fields, its keys and repeats, and its ids against another source's."""
    rows = D.exploded(saved(raw(spark, sf_dir)), ["id", "kind", "day"]).select("file_id", "position", "id", "kind", "day")
    rows = saved(rows.unionByName(rows.where(F.col("id").cast("long") % 101 == 0)))
    other = table(spark, sf_dir, "events").where("event_id % 103 <> 0").select(F.col("event_id").cast("string").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("none").alias("id")))
    long = lambda df, section, names: df.select(section.alias("section"), *(F.col(n).cast("long").alias(n) for n in names)).unpivot(["section"], names, "measure", "value")
    fields = P.field_types(rows, ["id", "kind", "day"])
    keys = P.key_audit(rows, ["id"])
    return long(fields, F.concat(F.lit("field:"), "field"), ["n_rows", "n_blank", "n_integer", "n_distinct"]).unionByName(long(keys, F.lit("key"), ["n_rows", "n_keys", "n_repeated_keys", "n_distinct_rows"])).unionByName(long(Q.reconcile(rows, other, ["id"]), F.lit("reconciliation"), ["shared", "only_left", "only_right"]))
