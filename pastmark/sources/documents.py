"""Raw JSON documents to rows with lineage, and the audits of a batch. All of it is columns; no Python runs per row."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastmark.operators.quality import sequence_gaps

#: Where the items, the result code and the count stand in a document, and the code of success.
ITEMS, CODE, TOTAL, SUCCESS = "$.response.body.items.item", "$.response.header.resultCode", "$.response.body.totalCount", "00"


def read_documents(spark, path: str) -> DataFrame:
    """(file_id, body): one whole file per row, read by Spark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_id"), F.col("value").alias("body"))


def store_documents(documents: DataFrame, folder: str) -> None:
    """Write each body (file_id, body) as a file of its own in a folder named by its id."""
    documents.select("file_id", "body").write.mode("errorifexists").partitionBy("file_id").text(folder)


def stored_documents(spark, folder: str) -> DataFrame:
    """(file_id, path, size, content) of the files under a folder, as they are."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"file_id=([^/]+)/[^/]*$", 1)
    return found.where(~F.col("path").rlike(r"/[._][^/]*$")).select(name.alias("file_id"), "path", F.col("length").alias("size"), "content")


def items(body: Column) -> Column:
    """The items of a document as an array of JSON texts; one object counts as an array of one, none gives NULL."""
    raw = F.trim(F.get_json_object(body, ITEMS))
    many = F.when(raw.startswith("["), raw).when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]")))
    return F.from_json(many, "array<string>")


def exploded(documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(file_id, position, row_id, source_item, fields): a row per item with its 1-based position, a row id that
    depends on file and position only, and all fields as text."""
    rows = documents.select("file_id", F.posexplode(items(F.col("body"))).alias("p", "source_item"))
    rows = rows.withColumn("position", F.col("p") + 1)
    row_id = F.sha2(F.concat_ws(":", "file_id", "position").cast("binary"), 256)
    return rows.select("file_id", "position", row_id.alias("row_id"), "source_item", *(F.get_json_object("source_item", f"$['{f}']").alias(f) for f in fields))


def staging_audit(rows: DataFrame, documents: DataFrame, whole: str, flag: str, runs: DataFrame) -> DataFrame:
    """One row: staged rows, those of no document, with another row id than their place gives, files whose positions are
    not 1 .. n, rows whose `flag` does not say whether the text in `whole` is a whole number, rows whose document has
    another content than its `content_hash` says, rows of a run that has not ended, and runs (run_id, status, n_rows)
    with another number of rows than they say."""
    known = rows.join(documents.select("file_id", F.sha2(F.col("body").cast("binary"), 256).alias("__hash")), "file_id")
    row_id = F.sha2(F.concat_ws(":", "file_id", "position").cast("binary"), 256)
    of_row = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.trim(whole).rlike("^[+-]?[0-9]+$") != F.col(flag)).alias("wrong_flag"))
    of_known = known.agg(F.count("*").alias("n_known"), F.count_if(F.col("row_id") != row_id).alias("wrong_row_id"), F.count_if(F.col("content_hash") != F.col("__hash")).alias("wrong_hash"))
    files = sequence_gaps(known, ["file_id"], "position").agg(F.count("*").alias("files_with_gaps"))
    said = runs.join(rows.groupBy("run_id").agg(F.count("*").alias("__n")), "run_id", "left").fillna(0, ["__n"])
    of_run = said.agg(F.coalesce(F.sum(F.when(F.col("status") != "COMPLETED", F.col("__n"))), F.lit(0)).alias("unfinished"), F.count_if(F.col("__n") != F.col("n_rows")).alias("runs_of_other_size"))
    out = of_row.crossJoin(of_known).crossJoin(files).crossJoin(of_run)  # one row each
    return out.select("n_rows", (F.col("n_rows") - F.col("n_known")).alias("orphans"), "wrong_row_id", "files_with_gaps", "wrong_flag", "wrong_hash", "unfinished", "runs_of_other_size")


def new_rows(batch: DataFrame, loaded: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows of a batch that are not loaded yet, each id once; loading a batch twice adds nothing."""
    return batch.dropDuplicates([row_id]).join(loaded.select(row_id), row_id, "left_anti")


def payload_status(body: Column, http_status: Column, wanted: Column | None = None, field: str | None = None) -> Column:
    """What a stored answer is. `wanted`: the value that `field` of all items must have."""
    code, total, many = F.get_json_object(body, CODE), F.get_json_object(body, TOTAL).try_cast("int"), items(body)
    mismatch = F.exists(many, lambda x: ~F.get_json_object(x, f"$['{field}']").eqNullSafe(wanted)) if wanted is not None and field else F.lit(False)
    return (
        F.when(body.isNull() | (F.trim(body) == ""), "EMPTY_BODY")
        .when(http_status != 200, "API_ERROR")
        .when(F.get_json_object(body, "$").isNull(), "INVALID_JSON")
        .when(code.isNull() | total.isNull(), "INVALID_SCHEMA")
        .when(code != SUCCESS, "API_ERROR")
        .when(total == 0, "NO_DATA")
        .when(many.isNull() | (F.size(many) == 0), "INVALID_SCHEMA")
        .when(F.coalesce(mismatch, F.lit(False)), "REQUEST_MISMATCH")
        .otherwise("SUCCESS")
    )


def batch_rollup(requests: DataFrame, batch: str = "batch_id", status: str = "status") -> DataFrame:
    """(batch, total, success, no_data, failed)."""
    s = F.col(status)
    return requests.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(s == "SUCCESS").alias("success"), F.count_if(s == "NO_DATA").alias("no_data"), F.count_if(~s.isin("SUCCESS", "NO_DATA")).alias("failed"))


def manifest_scan(batches: DataFrame, requests: DataFrame, files: DataFrame, batch_id: str) -> DataFrame:
    """Files of the successful requests of one batch, in request order."""
    ok = requests.where((F.col("status") == "SUCCESS") & (F.col("batch_id") == batch_id))
    return ok.join(batches.select("batch_id"), "batch_id").join(files, "request_id").orderBy("request_no", "file_id")


def file_audit(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_id, issue): files of the manifest (file_id, size, sha256) that are missing or differ in what is stored
    (file_id, content), and stored ones that it does not list."""
    seen = stored.select("file_id", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("h"), F.lit(True).alias("there"))
    both = manifest.withColumn("listed", F.lit(True)).join(seen, "file_id", "full")
    issue = F.when(F.col("listed").isNull(), "UNLISTED").when(F.col("there").isNull(), "MISSING").when(F.col("n") != F.col("size"), "SIZE").when(F.col("h") != F.col("sha256"), "HASH")
    return both.select("file_id", issue.alias("issue")).where("issue is not null")


#: Circled numbers from 1; the number 16 stands in brackets. Pools by number of picks, and those in order.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"
PICKS = {"단식": 1, "연식": 1, "복식": 2, "쌍식": 2, "복연": 2, "삼복": 3, "삼쌍": 3}
IN_ORDER = ("쌍식", "삼쌍")


def winning_combinations(rows: DataFrame, pool: str = "pool", text: str = "odds") -> tuple[DataFrame, DataFrame]:
    """(good, rejected). Good: the columns of `rows` with combination_no, members, ordered and odds_value, a row per
    combination; members of pools without an order are sorted. A row with one broken item is rejected whole."""
    token = rf"[{CIRCLED}]|\(16\)"
    picks = F.element_at(F.create_map(*(F.lit(x) for kv in PICKS.items() for x in kv)), F.col(pool))
    number = lambda t: F.when(t.startswith("("), F.regexp_replace(t, "[()]", "").try_cast("int")).otherwise(F.instr(F.lit(CIRCLED), t))
    parts = F.filter(F.split(F.trim(text), r"\s{2,}"), lambda x: x != "")

    def parse(item: Column) -> Column:
        members = F.transform(F.regexp_extract_all(item, F.lit(token), F.lit(0)), number)
        return F.struct(F.when(F.col("__ordered"), members).otherwise(F.sort_array(members)).alias("members"), F.regexp_extract(item, rf"^(?:{token})+-([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("decimal(12,4)").alias("odds_value"))

    out = rows.withColumn("__picks", picks).withColumn("__ordered", F.col(pool).isin(*IN_ORDER)).withColumn("__items", F.transform(parts, parse))
    sound = F.forall("__items", lambda x: x["odds_value"].isNotNull() & (F.size(x["members"]) == F.col("__picks")) & (F.size(F.array_distinct(x["members"])) == F.col("__picks")))
    ok = F.coalesce(sound & (F.size("__items") > 0), F.lit(False))
    good = out.where(ok).select(*rows.columns, F.col("__ordered").alias("ordered"), F.posexplode("__items").alias("__p", "__x"))
    good = good.select(*rows.columns, (F.col("__p") + 1).alias("combination_no"), F.col("__x.members").alias("members"), "ordered", F.col("__x.odds_value").alias("odds_value"))
    return good, out.where(~ok).select(*rows.columns)


class Refused(ValueError):
    """An audit has found faults in a layer that was written; readers go on with the old one."""


def write_versioned(df: DataFrame, folder: str, version: str, partition_by: Sequence[str] = (), audit: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """A full rebuild of a layer under its own version: written, then read again and audited, then made current.

    `audit` gives (rule, n_broken) for the rows as they are stored; a rule that is broken refuses the version. `current`
    is a file that names the version. A new one is written beside it and renamed over it, in one step of the file system:
    a reader finds the old or the new name at any time, also if the job dies. Returns the new version's path."""
    spark, path = df.sparkSession, f"{folder}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    if audit is not None:
        broken = {r["rule"]: r["n_broken"] for r in audit(spark.read.parquet(path)).where("n_broken > 0").collect()}  # a row per rule
        if broken:
            raise Refused(f"version {version} of {folder}: {broken}")
    switch(spark, folder, version)
    return path


def switch(spark, folder: str, version: str) -> None:
    """Make a version current by one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    new, current = hadoop.Path(f"{folder}/.current-{uuid.uuid4().hex}"), hadoop.Path(f"{folder}/current")
    store = new.getFileSystem(conf)
    # A local disk renames over a file by its raw file system only; a checksum beside the name would be a second file.
    raw = store.getRawFileSystem() if store.getScheme() == "file" else None
    out = (raw or store).create(new, False)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    if raw is not None:
        if not raw.rename(new, current):
            raise OSError(f"{current} was not switched")
        return
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(store.getUri(), conf).rename(new, current, over)


def read_current(spark, folder: str) -> DataFrame:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    current = jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    stream = current.getFileSystem(conf).open(current)
    try:
        version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(f"{folder}/version={version}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)
