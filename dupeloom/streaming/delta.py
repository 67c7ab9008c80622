"""Findings of changed texts against a growing corpus, as a stream (an extension: scans themselves are batches).

Each micro-batch's fingerprints are compared with themselves and with those written before, and then written too;
those written before are not compared with one another again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..operators.pairs import accepted_pairs
from ..sources.textfrag import fingerprints, reportable, text_fragments


def duplicate_stream(docs: DataFrame, prints_path: str, pairs_path: str, checkpoint: str, config: ScanConfig | None = None) -> StreamingQuery:
    """Starts a query over a stream of ``docs`` (doc_id, text, source): pairs with a side in each batch are appended to ``pairs_path``.

    Batches write under their own number and overwrite it, so one that is run again changes nothing.
    """
    config = config or ScanConfig()

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = reportable(fingerprints(text_fragments(rows))).select("frag_id", "exec_lines", "exec_stmts", "root_hash", "shingles", "n")
        new.write.mode("overwrite").parquet(f"{prints_path}/batch={number}")
        known = spark.read.parquet(prints_path).where(F.col("batch") <= number)
        pairs = accepted_pairs(known.withColumn("fresh", F.col("batch") == number).drop("batch"), config)
        pairs.write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
