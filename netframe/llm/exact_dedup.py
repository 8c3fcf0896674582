"""Operator 8 [native]: exact deduplication by keyed state of a stream.

DataFrame functions and Structured Streaming only.

1.  Each row gets a digest (SHA-256 of the text without white space), its code points and a content
    locator (file and row number).  This narrow table is what is streamed.
2.  A streaming aggregation keyed by the digest keeps, in RocksDB on disk and without watermark
    or expiry, the number of rows and the row that stays: identifier and locator.  Task-side
    partial aggregation makes a hot digest one row a task before the shuffle.
3.  On hits (digests of several rows), batch by batch, the full texts are fetched by locator and compared
    with the text of the row that stays.  Rows whose bytes differ under one digest are grouped by
    their texts instead, so a collision costs nothing but work.

`state` names a folder that outlives a call: digests, the stream's checkpoint with its state, the groups of
each batch, and the collisions found.  A later call with the same folder and new rows (under the same column
names) meets the state as the earlier ones left it; the files read by earlier calls must still be there, for
their texts are fetched when something new hits them.  The folder must have been written by the same digest
function and numbers of shuffle partitions.  A call that was cut short is taken up by the next one.  Without
`state` a call begins with none.

Of equal texts the row with most code points in the original text stays, then the one with the smallest
doc_id (a null one last), then the first by locator: of repeated rows exactly one is kept.

Cases: a null text is an empty one, and all texts of white space only are equal; an empty table has an
empty result; repeated rows are copies of each other; a very long text travels only if its digest hits;
extra columns are not read by `exact_groups` and pass through `keep_one`, whatever their names.

Each batch overwrites its own folder, so that nothing is counted twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, fresh_dir, materialize

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no disk space is set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # a store's memory goes back when its task ends
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def filed(docs: DataFrame) -> DataFrame:
    """docs if its rows come from files that know their row numbers, else docs written to files."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return materialize(docs, "located")


def located(docs: DataFrame, name: str = "locator") -> DataFrame:
    """docs with a locator struct<file string, row long>; docs not read from files are written first."""
    return filed(docs).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))


def _order() -> Column:
    return F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("nameless"), F.col("id"), F.col("locator"), F.col("call"))


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at path, or one without rows where nothing has been written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stream_groups(keys: DataFrame, state: str, on_batch, files_per_batch: int | None = None) -> T.StructType:
    """Run what is new in state/digests through the stream; the groups that a batch changes go to state/groups.

    keys gives the schema of the digests: digest string, id, n_chars long, locator struct, call int.  Then
    on_batch(changed groups (digest, n, first), batch number) is called.  Returns the groups' schema.
    """
    spark = keys.sparkSession
    reader = spark.readStream.schema(keys.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    counted = reader.parquet(f"{state}/digests").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(_order()).alias("first"))
    schema = counted.withColumn("batch", F.lit(0)).schema

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{state}/groups/{number:08d}"
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(path)
        on_batch(_table(spark, path, schema), number)

    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        query = counted.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return schema


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int | None = None, state: str | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest, locator) of each row of docs (columns id_col, text_col).

    With a state that earlier calls have left, their rows count in the groups too.
    """
    spark = docs.sparkSession
    again, state = state is not None, state or fresh_dir(spark, "exact")
    base = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = base.select("id", digest(normalised(F.col("text"))).alias("digest"), n_chars.alias("n_chars"), "locator", F.lit(0).alias("call"))
    known = _table(spark, f"{state}/digests", rows.schema)
    call = int(known.agg(F.coalesce(F.max("call"), F.lit(-1)).alias("c")).first()["c"]) + 1 if again else 0
    rows = rows.withColumn("call", F.lit(call))
    rows.write.mode("append").parquet(f"{state}/digests")
    keys = spark.read.schema(rows.schema).parquet(f"{state}/digests")
    new, old = (keys.where(F.col("call") == call), keys.where(F.col("call") < call)) if again else (keys, None)

    def texts(wanted: DataFrame, earlier: bool) -> DataFrame:
        """wanted (locator, ...) and the normalised text as bytes."""
        if earlier:
            # one name for each file that holds something that was hit
            files = [r["file"] for r in wanted.select("locator.file").distinct().collect()]
            if not files:
                return wanted.withColumn("bytes", F.lit("")).where("false")
            source = spark.read.schema(T.StructType([docs.schema[text_col]])).parquet(*files)
            source = located(source.select(F.col(text_col).alias("text")))
        else:
            source = base
        return source.select(normalised(F.col("text")).alias("bytes"), F.col("locator").alias("at")).join(wanted, F.col("at") == F.col("locator")).drop("at")

    def check(changed: DataFrame, number: int) -> None:
        hits = changed.where("n > 1").select("digest", F.col("first.locator").alias("keeper"), F.col("first.call").alias("keeper_call"))
        ours = texts(new.join(hits, "digest").select("digest", "keeper", "locator"), False)
        if old is not None:
            # of the earlier rows, equal among themselves, one speaks for all; the row that stays is taken where it is theirs
            stays = F.col("locator") == F.col("keeper")
            theirs = old.join(hits, "digest").groupBy("digest").agg(F.max("keeper").alias("keeper"), F.coalesce(F.max(F.when(stays, F.col("locator"))), F.min("locator")).alias("locator"))
            ours = ours.unionByName(texts(materialize(theirs, "earlier"), True))
        fetched = materialize(ours.select("digest", "bytes", (F.col("locator") == F.col("keeper")).alias("stays")), "hits")
        kept = fetched.where("stays").select(F.col("digest").alias("d"), F.col("bytes").alias("own"))
        # written before anything needs a digest's rows together, so that the join of a hot one can be split
        fetched.where("not stays").join(kept, F.col("digest") == F.col("d")).where("bytes <> own").select("digest").write.mode("overwrite").parquet(f"{state}/collisions/{number:08d}")
        discard(fetched)

    groups = _table(spark, f"{state}/groups/*", stream_groups(keys, state, check, files_per_batch))
    if again or files_per_batch:
        groups = groups.join(new.select("digest").distinct(), "digest", "left_semi") if again else groups
        groups = groups.groupBy("digest").agg(F.max_by(F.struct("n", "first"), "batch").alias("last")).select("digest", "last.n", "last.first")
    differ = _table(spark, f"{state}/collisions/*", keys.select("digest").schema).distinct()
    plain = new.join(groups, "digest").select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest", "locator")
    if differ.isEmpty():
        return plain
    parted = texts(new.join(differ, "digest", "left_semi"), False)
    if old is not None:
        earlier = materialize(old.join(differ, "digest", "left_semi"), "earlier")
        parted = parted.unionByName(texts(earlier, True))
    parted = materialize(parted, "parted")
    sizes = parted.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min(_order()).alias("first"))
    apart = parted.where(F.col("call") == call).join(sizes, ["digest", "bytes"]).select("id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("locator") == F.col("first.locator")).alias("kept"), "digest", "locator")
    return plain.join(differ, "digest", "left_anti").select(apart.columns).unionByName(apart)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None) -> DataFrame:
    """docs with one row of each group of equal texts; with a state, the rows that are the best of their group so far."""
    name, gone_name = free_name(docs, "locator"), free_name(docs, "nf_gone")
    docs = filed(docs)  # both readings must see the same places
    whole = located(docs, name)
    gone = exact_groups(docs, id_col, text_col, state=state).where("not kept").select(F.col("locator").alias(gone_name))
    return whole.join(gone, F.col(name) == F.col(gone_name), "left_anti").drop(name)
