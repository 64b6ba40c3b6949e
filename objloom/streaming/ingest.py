"""Streams: packs dropped into a folder, object writes from a table's files, and the log of reference updates.

A micro-batch of packs or objects is an ordinary ingest, which is idempotent by
hash, so a repeated batch after a failure changes nothing.  The log of updates
keeps each store's references as state.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from objloom.operators import packs, stores
from objloom.operators.refs import Op, _Store


def packs_from(spark: SparkSession, folder: str, out: str, checkpoint: str, fmt: str = "sha1") -> StreamingQuery:
    """Ingest every pack that is there; run again for those that have come since."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pack").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(df: DataFrame, _: int) -> None:
        packs.ingest(df.select("path", "content"), out, fmt)  # publishes; the report isn't wanted

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def objects_from(source: DataFrame, out: str, checkpoint: str, fmt: str = "sha1") -> StreamingQuery:
    """Append a stream's ``content`` column to a content-addressed Parquet store."""

    def batch(df: DataFrame, _: int) -> None:
        stores.write(df, out, fmt)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Operations of a store that are Python objects at a time.
LOG_ROWS = 10_000


def ref_log(updates: DataFrame) -> DataFrame:
    """(store, seq, name, status, error) of a stream of updates(store, seq, kind, name, new_id, old_id, new_target, old_target).

    Each update is an operation of its own, applied to its store's references
    in order of seq within a micro-batch.  A store's references are the state
    of its key, so a restarted stream goes on from its checkpoint.  They are
    read and written once in a micro-batch; an update costs what it touches.
    Updates wait for their order as Arrow columns.
    """
    schema = pa.schema([("seq", pa.int64()), *((c, pa.large_string()) for c in Op._fields)])

    def run(key, frames, state):
        store = _Store({k: tuple(v) for k, v in json.loads(state.get[0]).items()} if state.exists else {})
        rows = pa.concat_tables([pa.Table.from_pandas(f[schema.names], schema, preserve_index=False) for f in frames]).combine_chunks()
        order = pc.sort_indices(rows["seq"])
        for at in range(0, len(order), LOG_ROWS):
            seq, *columns = rows.take(order[at : at + LOG_ROWS]).columns
            seq, columns = seq.to_pylist(), [c.to_numpy().tolist() for c in columns]
            got = [*map(store.step, map(Op, *columns))]
            yield pd.DataFrame({"store": [key[0]] * len(seq), "seq": seq, "name": columns[0], "status": [s for s, _ in got], "error": [e for _, e in got]})
        state.update((json.dumps(store.refs),))

    return updates.groupBy("store").applyInPandasWithState(run, "store string, seq long, name string, status string, error string", "refs string", "append", "NoTimeout")
