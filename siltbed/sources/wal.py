"""Write-ahead log: segments, retention, replay, and a reader for binary segment files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siltbed.functions.codec import HEADER, decode_records, record_hex

RECORD = "crc long, ts long, tombstone boolean, key string, value binary, segment_set string"


def running_bytes(log: DataFrame, block: int = 65536) -> DataFrame:
    """Adds ``size`` and ``start``, the byte offset of each record in the log.

    A prefix sum in two steps: totals of blocks of ``block`` sequence numbers first (one small row each), then
    within blocks; no task holds the whole log."""
    size = HEADER + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    sized = log.withColumn("size", size.cast("long")).withColumn("blk", F.floor(F.col("seq") / block))
    totals = sized.groupBy("blk").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("blk", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (sized.join(offsets, "blk")
            .withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("base", "blk"))


def segments(log: DataFrame, segment_bytes: int) -> DataFrame:
    """First and last segment of each record; a record may span any number of segments."""
    first = F.floor(F.col("start") / segment_bytes)
    last = F.floor((F.col("start") + F.col("size") - 1) / segment_bytes)
    return running_bytes(log).withColumn("segment", first).withColumn("last_segment", last)


def memtable_spans(log: DataFrame, segment_bytes: int, run_capacity: int) -> DataFrame:
    """Which part of the log each memtable generation covers."""
    s = segments(log, segment_bytes).withColumn("run_id", F.floor(F.col("seq") / run_capacity).cast("int"))
    return s.groupBy("run_id").agg(
        F.min("segment").alias("start_segment"), (F.min("start") % segment_bytes).alias("start_offset"),
        F.max("last_segment").alias("end_segment"), ((F.max(F.col("start") + F.col("size")) - 1) % segment_bytes + 1).alias("end_offset"))


def retain(segmented: DataFrame, low_water_mark: int) -> DataFrame:
    """Records that survive once segments up to the mark are deleted: those that begin after it."""
    return segmented.filter(F.col("segment") > low_water_mark)


def replay(records: DataFrame) -> DataFrame:
    """Records whose checksum holds; newest-wins over them rebuilds the state. A null value, as deletes have, counts as no bytes."""
    return records.filter(F.crc32(F.coalesce(F.col("value").cast("binary"), F.lit(b""))) == F.col("crc"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Binary ``segment<N>.log`` files of a folder, in order, as records.

    Where the folder has an index (for each segment the offset of the first record that begins in it, and the segment in which the last one
    ends), a segment is a task: it gets its own bytes and those that its last record needs. Without an index the segments of one log
    (one folder) are one byte stream, as a record's start is known only from the record before it; logs are read in parallel then."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "segment*.log").load(path)
             .select(F.regexp_replace("path", r"/[^/]*$", "").alias("segment_set"),
                     F.regexp_extract("path", r"segment(\d+)\.log$", 1).cast("long").alias("n"), "content"))

    def decode(key, pdf):
        import pandas as pd

        data = b"".join(bytes(c) for c in pdf.sort_values("n")["content"])
        rows = [(crc, ts, tomb, k, v, key[0]) for crc, ts, tomb, k, v, _ in decode_records(data)]
        return pd.DataFrame(rows, columns=["crc", "ts", "tombstone", "key", "value", "segment_set"])

    def decode_one(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        at, own = int(pdf["first"].iloc[0]), len(pdf["content"].iloc[0])
        rows = []
        for crc, ts, tomb, k, v, after in decode_records(b"".join(bytes(c) for c in pdf["content"]), at):
            rows.append((crc, ts, tomb, k, v, key[0]))
            if after >= own:  # the next record begins in a later segment
                break
        return pd.DataFrame(rows, columns=["crc", "ts", "tombstone", "key", "value", "segment_set"])

    try:
        index = spark.read.schema(INDEX).parquet(f"{path}/{INDEX_FOLDER}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return files.groupBy("segment_set").applyInPandas(decode, RECORD)
    asked = index.withColumn("n", F.explode(F.sequence("segment", "reach")))
    return files.join(asked, "n").groupBy("segment_set", "segment").applyInPandas(decode_one, RECORD)


INDEX, INDEX_FOLDER = "segment long, first long, reach long", "_index"


def write_segments(records: DataFrame, path: str) -> None:
    """Append sink: the log as Parquet; Spark's commit protocol is what makes it durable."""
    records.write.mode("append").parquet(path)


def write_binary_segments(log: DataFrame, path: str, segment_bytes: int) -> int:
    """Binary sink: the log as ``segment<N>.log`` files of ``segment_bytes`` in a shared folder; gives their number.

    Each segment is put together by one task from the parts of the records that fall into it. A file gets its name only when it
    is complete and always holds the same bytes, so tasks may be repeated."""
    record = record_hex(F.crc32(F.coalesce(F.col("value").cast("binary"), F.lit(b""))), F.col("ts"), F.col("tombstone"), F.col("key"), F.col("value"))
    placed = (segments(log, segment_bytes).withColumn("record", record)
              .withColumn("n", F.explode(F.sequence("segment", "last_segment"))))
    low, high = F.col("n") * segment_bytes, (F.col("n") + 1) * segment_bytes
    begin, end = F.greatest(F.col("start"), low), F.least(F.col("start") + F.col("size"), high)
    part = F.substring(F.col("record"), ((begin - F.col("start")) * 2 + 1).cast("int"), ((end - begin) * 2).cast("int"))
    parts = placed.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", part.alias("part")))).alias("parts"))
    whole = parts.select("n", F.unhex(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("content"))
    begins = segments(log, segment_bytes).groupBy("segment").agg((F.min("start") % segment_bytes).alias("first"), F.max("last_segment").alias("reach"))
    begins.write.mode("overwrite").parquet(f"{path}/{INDEX_FOLDER}")
    folder = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path

    def write(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(base, recursive=True)
        for pdf in batches:
            for n, content in zip(pdf["n"], pdf["content"]):
                unfinished = f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(unfinished, compression=None) as out:
                    out.write(content)
                where.move(unfinished, f"{base}/segment{n}.log")
            yield pd.DataFrame({"n": pdf["n"]})

    return whole.mapInPandas(write, "n long").count()
