"""Incremental forms of the jobs: file streams whose batches run the same operators against tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonegrid.operators.enrich import LOOKUP_EVENTS, apply_answers, lookup_states
from tonegrid.operators.library import Library, additions, merge_tracks, recounted
from tonegrid.operators.lineage import cut


#: Parts that a table is dealt into by pid unless told otherwise; a batch rewrites those that hold its pids, so a large
#: table wants more of them.
PARTS = 256
BUCKET = "__bucket"


def _dealt(frame: DataFrame, parts: int) -> DataFrame:
    return frame.withColumn(BUCKET, F.pmod(F.xxhash64("pid"), F.lit(parts)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def _begun(spark: SparkSession, table: str) -> bool:
    """Whether the table has a part; its folder alone may be what a write that broke off has left."""
    if not _exists(spark, table):
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(table)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    return any(f.getPath().getName().startswith(f"{BUCKET}=") for f in found)


def _write(frame: DataFrame, table: str) -> None:
    """Replaces the parts of the table that the frame holds, and no others.

    A table without rows would have no file to tell its columns: it has a part without rows.
    """
    frame.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(table)
    if not _begun(frame.sparkSession, table):
        frame.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{table}/{BUCKET}=0")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The table that a stream maintains."""
    return spark.read.parquet(table).drop(BUCKET)


def _upserting(stream: DataFrame, table: str, checkpoint: str, step: Callable[[DataFrame, DataFrame], DataFrame], parts: int, first: DataFrame | None = None, mode: str = "append") -> StreamingQuery:
    """Each batch brings the parts of ``table`` that hold its pids up to date; the table starts as ``first``.

    ``step`` (rows so far, batch) must give the same when the batch was in already, so a batch that runs again after a
    failure does no harm.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if first is not None and not _begun(spark, table):
            _write(_dealt(first, parts), table)
        batch = cut(_dealt(batch, parts))
        touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]  # ``parts`` at most
        before = spark.read.parquet(table).where(F.col(BUCKET).isin(touched)).select(batch.columns if first is None else [*first.columns, BUCKET]) if _begun(spark, table) else batch.limit(0)
        _write(cut(_dealt(step(before.drop(BUCKET), batch.drop(BUCKET)), parts)), table)

    return stream.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_import(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str, files_per_batch: int = 1, parts: int = PARTS) -> StreamingQuery:
    """Track files are merged into the library one after another; a known pid keeps its first row."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    return _upserting(stream, table, checkpoint, merge_tracks, parts)


#: What an import file holds besides ``track`` (a struct of pid, row_idx, collection and whatever tracks have): one row is a
#: track, a membership or a collection; ``label`` names the import.
IMPORT_SCHEMA = "label string, membership struct<playlist: string, pid: string>, collection struct<id: string, label: string, pos: int, track_count: bigint>"


COMMIT_SCHEMA = "label string, added bigint, redundant boolean"


def import_rows(found: Library, label: str) -> DataFrame:
    """A library as the rows of one import file."""
    parts = zip(("track", "membership", "collection"), found, strict=True)
    track, member, collection = (frame.select(F.lit(label).alias("label"), F.struct(*frame.columns).alias(name)) for name, frame in parts)
    return track.unionByName(member, allowMissingColumns=True).unionByName(collection, allowMissingColumns=True)


def _imported(rows: DataFrame) -> Library:
    return Library(*(rows.where(f"{name} is not null").select(f"{name}.*") for name in ("track", "membership", "collection")))


def _committed(spark: SparkSession, store: str) -> int | None:
    """The last batch that is in the store as a whole; the library that it started with is batch -1."""
    if not _exists(spark, f"{store}/commits"):
        return None
    return spark.read.schema(f"{COMMIT_SCHEMA}, batch int").parquet(f"{store}/commits").agg(F.max("batch")).first()[0]


def _commit(added: Library, store: str, number: int, label: str | None, redundant: bool, write: bool = True) -> None:
    if write:
        for name, frame in zip(Library._fields, added, strict=True):
            frame.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
    report = added.tracks.agg(F.count("*").alias("added")).select(F.lit(label).alias("label").cast("string"), "added", F.lit(redundant).alias("redundant"))
    report.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/batch={number}")


def start_library(found: Library, store: str) -> None:
    """Makes a library the first state of a new store."""
    _commit(found, store, -1, None, False)


def read_library(spark: SparkSession, store: str, upto: int | None = None) -> Library:
    """The library that ``stream_library`` maintains, as of its last commit (or of batch ``upto``)."""
    last = _committed(spark, store) if upto is None else upto
    tracks, members, collections = (spark.read.parquet(f"{store}/{name}").where(F.col("batch") <= last).drop("batch") for name in Library._fields)
    return Library(tracks, members, recounted(collections, tracks))


def stream_library(spark: SparkSession, incoming: str, track: str, store: str) -> StreamingQuery:
    """Import files (``import_rows``; ``track`` is the DDL of the struct's fields) are merged one after another.

    A batch adds what ``library.additions`` finds against the commits before it, in files of its own: tracks,
    memberships under their final names, and collections. Nothing that is there is written again, so a batch costs a
    look at the ids and names so far and the rows it brings. Its commit is one row, written last; readers see committed
    batches only, so the three tables change together. A batch that runs again after its commit does nothing, one that
    broke off before it writes its files anew. A file without a new pid commits nothing but its report (batch, label,
    added, redundant). Progress lives in the store, so that neither is restored without the other. A new store may start
    from a library (``start_library``).
    """
    stream = spark.readStream.schema(f"{IMPORT_SCHEMA}, track struct<{track}>").option("maxFilesPerTrigger", 1).parquet(incoming)

    def run(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = _committed(session, store)
        if last is not None and number <= last:
            return
        batch = cut(batch)
        given = _imported(batch)
        nothing = Library(*(frame.limit(0) for frame in given))
        before = nothing if last is None else read_library(session, store, last)
        label = batch.agg(F.min("label")).first()[0]  # one file, one import
        more = additions(before, given, label)
        added = nothing if more is None else Library(cut(more.tracks), *more[1:])
        # the first commit leaves the columns of each table, if no rows
        _commit(added, store, number, label, more is None, write=more is not None or last is None)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{store}/_progress").trigger(availableNow=True).start()


def stream_enrich(spark: SparkSession, answers: str, schema: str, tracks: DataFrame, table: str, checkpoint: str, order: tuple[str, ...] = (), parts: int = PARTS) -> StreamingQuery:
    """Lookup answers (pid, bpm, key, label, source, and the columns ``order``) land in the tracks as they come.

    The first to state a field gives it: across batches the earlier batch, within one the first by ``order``. The
    checkpoint resumes the work.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(answers)
    return _upserting(stream, table, checkpoint, lambda before, batch: apply_answers(before, batch, *order).select(*tracks.columns), parts, tracks)


def stream_lookups(spark: SparkSession, events: str, table: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Keeps ``lookup_states`` of every track that event files (``LOOKUP_EVENTS``) tell of, in state and in ``table``.

    The state of a track is a row of fixed size and holds whatever the order of its events, so work that stops and
    resumes, or comes in other files, ends in the same table; ``enrich.outstanding_lookups`` turns it into the work that
    is left at a time.
    """
    stream = spark.readStream.schema(LOOKUP_EVENTS).option("maxFilesPerTrigger", 1).parquet(events)
    newest = lambda before, batch: before.join(batch.select("pid"), "pid", "left_anti").unionByName(batch)
    return _upserting(lookup_states(stream), table, checkpoint, newest, parts, mode="update")


def stream_place(spark: SparkSession, incoming: str, schema: str, place_batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """New outside tracks are placed on a frozen map and appended; nothing is fitted again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    write = lambda batch, number: place_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
