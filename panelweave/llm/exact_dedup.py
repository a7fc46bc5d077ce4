"""Exact duplicates by a stream over keyed state on disk.

The stream reads files as they arrive and keeps, for each digest of a normalised text, the smallest
stable identifier, the place of that document's text (file and row) and a count. The state lives in
RocksDB, has no watermark and never expires, so a copy that comes years later is still found. A row
whose digest is known is a hit; hits are compared with the kept text byte by byte, so that equal
digests of different texts never drop a document.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.shared import SPACE, text_of
from panelweave.session import materialize

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no disk set aside for small states
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Input of one micro-batch; a restart repeats at most so much.
BATCH_BYTES = 64 << 30


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class ExactDedup:
    """Deduplicates the Parquet files of a folder against all it has seen before.

    ``state_dir`` is the stream's checkpoint, in storage that all executors share; opened again it
    goes on where it stopped, also after a crash. ``digest`` maps the normalised text to the state's
    key (tests pass a weak one).
    """

    def __init__(
        self,
        spark: SparkSession,
        state_dir: str,
        doc_id: str = "doc_id",
        text: str = "text",
        digest: Callable[[Column], Column] = sha256,
        batch_bytes: int = BATCH_BYTES,
    ):
        self.spark, self.state_dir = spark, state_dir
        self.doc_id, self.text, self.digest, self.batch_bytes = doc_id, text, digest, batch_bytes

    def _keyed(self, docs: DataFrame, body: bool) -> DataFrame:
        """Digest, identifier (null ids after all others) and place of each row; its text if asked for."""
        id_ = F.struct(
            F.col(self.doc_id).isNull().alias("no_id"),
            F.col(self.doc_id).alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
        plain = normalised(self.text)
        return docs.select(self.digest(plain).alias("digest"), id_.alias("at"), *([plain.alias("body")] if body else []))

    def absorb(self, path: str) -> None:
        """Take in the files of ``path``, a folder or one file, that were not seen yet."""
        schema = self.spark.read.parquet(path).schema
        with _set(self.spark, STATE_CONF):
            # As a pattern, since a stream takes a plain path only where that is a folder.
            pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
            arriving = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", self.batch_bytes).parquet(pattern)
            kept = self._keyed(arriving, False).groupBy("digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
            run = (
                kept.writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", self.state_dir)
                .trigger(availableNow=True)
                .start()
            )
            run.awaitTermination()

    def state(self) -> DataFrame:
        """What the state holds: digest, first (identifier and place of the kept row), n."""
        with _set(self.spark, STATE_CONF):
            held = self.spark.read.format("statestore").load(self.state_dir)
            names = [f.name for f in held.schema["value"].dataType.fields]
            return held.select(F.col("key.digest").alias("digest"), F.col(f"value.`{names[0]}`").alias("first"), F.col(f"value.`{names[1]}`").alias("n"))

    def report(self, path: str) -> DataFrame:
        """One row per row of ``path``, all of which must have been taken in.

        doc_id, keep_id (of the smallest doc_id among equal texts), group_size, kept, text_sha256.
        Null texts equal empty ones. Of rows with the same text and id the first in file and row
        order is kept. An empty table gives an empty result; other columns are not read.
        """
        docs = self._keyed(self.spark.read.parquet(path), True)
        groups = self.state().filter("n > 1")
        # The only shuffle of texts. Members of a group keep theirs for the comparison.
        rows = materialize(
            docs.join(groups, "digest", "left").select(
                "digest", "at", "first", "n", F.when(F.col("n").isNotNull(), F.col("body")).alias("body"), sha256(F.col("body")).alias("text_sha256")
            ),
            "members",
        )
        single = rows.filter("n IS NULL").select(
            F.col("at.id").alias("doc_id"), F.col("at.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
        )
        members = rows.filter("n IS NOT NULL")
        keepers = members.filter("at = first").select("digest", F.col("body").alias("kept_body"))
        same = F.col("body") == F.col("kept_body")
        checked = materialize(
            members.join(keepers, "digest").select(
                "digest", "at", "first", "n", "text_sha256", same.alias("same"), F.when(~same, F.col("body")).alias("other")
            ),
            "checked",
        )
        # Equal digests of different texts: such rows form groups of their own, by their bytes.
        differ = checked.filter("NOT same")
        lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        agreed = (
            checked.filter("same")
            .join(lost, "digest", "left")
            .select(
                F.col("at.id").alias("doc_id"),
                F.col("first.id").alias("keep_id"),
                (F.col("n") - F.coalesce(F.col("lost"), F.lit(0))).alias("group_size"),
                (F.col("at") == F.col("first")).alias("kept"),
                "text_sha256",
            )
        )
        own = differ.groupBy("digest", "other").agg(F.min("at").alias("own_first"), F.count(F.lit(1)).alias("own_n"))
        apart = differ.join(own, ["digest", "other"]).select(
            F.col("at.id").alias("doc_id"),
            F.col("own_first.id").alias("keep_id"),
            F.col("own_n").alias("group_size"),
            (F.col("at") == F.col("own_first")).alias("kept"),
            "text_sha256",
        )
        return single.unionByName(agreed).unionByName(apart)
