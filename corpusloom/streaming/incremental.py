"""Incremental forms on Structured Streaming: exact and near duplicates, paragraphs, resumable runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import strip
from corpusloom.operators.dedup import near_dedup, word_bands
from corpusloom.operators.ordering import cut


def exact_dedup_stream(stream: DataFrame, text: str, time: str | None = None, within: str | None = None) -> DataFrame:
    """Each text once, by digest; the state is a digest a text.

    With an event time and an interval a digest is forgotten once the watermark, `within` behind the
    latest time, has passed it by `within`: the state is bounded, and copies farther apart may both stay.
    """
    marked = stream.withColumn("digest", F.md5(F.col(text).cast("binary")))
    if time is None:
        return marked.dropDuplicates(["digest"]).drop("digest")
    return marked.withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def paragraph_stream(lines: DataFrame, source: str, value: str, order: str | None = None) -> DataFrame:
    """(source, paragraph): lines of each source up to a blank one; the state is the open paragraph.

    Lines are in the order of arrival, or of column `order` within a micro-batch. A null line is the
    end of its source: the open paragraph goes out, and no state is left.
    """

    def assemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0].split("\n") if state.exists and state.get[0] else []
        done, ended = [], False
        for batch in batches if order is None else [pd.concat(batches).sort_values(order, kind="stable")]:
            for line in batch[value]:
                ended = line is None
                if line and line.strip():
                    held.append(line)
                elif held:
                    done.append("\n".join(held))
                    held = []
        if not ended:
            state.update(("\n".join(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({source: [key[0]] * len(done), "paragraph": done})

    return lines.groupBy(source).applyInPandasWithState(assemble, f"{source} string, paragraph string", "held string", "append", GroupStateTimeout.NoTimeout)


class NearDedupIndex:
    """What a resumable near-dedup keeps: rows, digests and bands, a folder a batch, in a shared folder.

    A batch is written under its number; one that runs again writes the same rows over its own
    folder and reads the others only, so a crash in between is made good by the next run.
    """

    def __init__(self, spark: SparkSession, path: str, order: str, text: str, make_bands=word_bands):
        self.spark, self.path, self.order, self.text, self.make_bands = spark, path.rstrip("/"), order, text, make_bands

    def _read(self, name: str, before: int) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as error:  # no batch yet
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return df.where(F.col("batch") < before)

    def add(self, df: DataFrame, batch: int) -> DataFrame:
        """The verdicts of a batch of rows; those kept go into the index."""
        digests, old_bands = self._read("digests", batch), self._read("bands", batch)
        if old_bands is not None:
            old_bands = old_bands.select("band_id", "band_hash", F.col(self.order).alias("kept_key"))
        verdicts = cut(near_dedup(df, self.order, self.text, self.make_bands, old_bands, digests))
        kept = df.join(verdicts.where("verdict = 'kept'"), self.order, "left_semi")
        parts = {
            "digests": kept.select(F.md5(F.col(self.text).cast("binary")).alias("digest")),
            "bands": self.make_bands(kept, self.order, F.col(self.text)),
            "rows": kept,
        }
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return verdicts

    def run(self, stream: DataFrame, checkpoint: str):
        """Take in all that a stream has now, batch by batch, and end."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(df: DataFrame, name: str = "progress") -> DataFrame:
    """df with observed counts of rows and blank rows, for listeners."""
    first = df.columns[0]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(strip(F.col(first).cast("string")) == "").alias("blank"))
