"""Structured Streaming jobs, run over what is there (availableNow) into tables of the shared folder."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir of the session or its context); a temporary one, kept for the session, only where that is unset and Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A fresh folder in the shared one."""
    return f"{shared(spark)}/stream-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str, sources: list[str], make: Callable[[str], None], rules: str = "") -> str:
    """A folder that make(path) has written of df, whose rows come from the files of sources as they are now: made where it isn't there, else found again, by later
    sessions too, as long as df's plan and columns, and rules (what else the content hangs on), are the same. It appears under its name when it is whole, so a failed or a second writer does no harm."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    # numbers of columns and of lambdas' variables differ from call to call
    plan = re.sub(r"(_\d+)?#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().analyzed().toString())
    seen = hashlib.md5(f"{plan}{df.schema.json()}{rules}".encode())
    for source in sources:
        found, files = at(source).getFileSystem(conf).listFiles(at(source), True), []
        while found.hasNext():
            f = found.next()
            files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        seen.update("\n".join(sorted(files)).encode())
    path = f"{shared(spark)}/{name}-{seen.hexdigest()}"
    fs = at(path).getFileSystem(conf)
    if not fs.exists(at(path)):
        made = f"{path}-{uuid.uuid4().hex}"
        make(made)
        if not fs.exists(at(path)):
            fs.rename(at(made), at(path))
    return path


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a folder of part files is read as such; a lone file by its name in the folder
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path)


def run(df: DataFrame, out: str, mode: str, each=None) -> None:  # noqa: ANN001
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    (w.foreachBatch(each) if each else w.format("parquet").option("path", f"{out}/rows")).start().awaitTermination()


def hourly_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by hour of event time, with a watermark of a day; each batch's updated windows replace the older ones."""
    out = folder(spark)
    e = stream_of(spark, sf_dir, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = e.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("failed"))
    run(counts, out, "update", lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows"))
    rows = spark.read.schema("w struct<start: timestamp, end: timestamp>, failed long, batch long").parquet(f"{out}/rows")
    return rows.groupBy("w.start").agg(F.max_by("failed", "batch").alias("failed")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "failed")


def dedup_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content. A batch appends what it has of each content that no earlier batch has; batches that are
    written twice after a failure have equal rows, which the read folds."""
    out = folder(spark)
    d = stream_of(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("checksum"), "doc_id")
    run(d, out, "append", lambda b, i: b.groupBy("checksum").agg(F.min("doc_id").alias("doc_id")).write.mode("append").parquet(f"{out}/rows"))
    return spark.read.schema("checksum string, doc_id long").parquet(f"{out}/rows").groupBy("checksum").agg(F.min("doc_id").alias("doc_id"))
