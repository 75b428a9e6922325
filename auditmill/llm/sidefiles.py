"""One small file for each slice of the documents, in the shared folder, for later scans of the same documents.

A scan over whole texts needs some facts on its own documents that only a shuffle can find. Sending the texts through that
shuffle would cost as much disk as the texts; instead each slice's facts go to a file that the task which scans the slice
again reads. A slice is SLICE rows of one file, by their place in it. That is the same however a scan's splits are planned (they depend on
the cores registered at that moment) and whichever executor runs the task; a slice on both sides of a split's edge is read by both tasks.
A task that runs twice writes the same file twice. Files come by rename and are never half there. Each slice has a file, if only an
empty one, so a missing file is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.shared import filesystem, scratch, written

#: Rows of one file whose facts lie together.
SLICE = 4096


def with_source(docs: DataFrame, *columns: str) -> DataFrame:
    """These columns of docs, with `src`, the slice that a row lies in, and `pos`, its place in the file. Rows whose place in a file is not known are written to files first."""
    place = lambda d: d.select(*columns, F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / SLICE)).alias("src"), F.col("_metadata.row_index").alias("pos"))
    try:
        return place(docs)
    except AnalysisException:
        return place(written(docs.select(*columns), "docs"))


def save(blobs: DataFrame, name: str, sources: DataFrame, join=b"".join) -> str:
    """Write the column blob of each src, joined, to a file of its own; the folder's address. Columns: src, blob. Those of sources (src) without blobs have empty files."""
    address = scratch(blobs.sparkSession, name)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, path = filesystem(address)
        fs.create_dir(path, recursive=True)
        src = int(pdf["src"].iloc[0])
        temporary = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            out.write(join(list(pdf["blob"])))
        fs.move(temporary, f"{path}/{src}")
        return pd.DataFrame({"src": [src]})

    blobs = blobs.unionByName(sources.select("src", F.lit(b"").alias("blob")))
    blobs.groupBy("src").applyInPandas(run, "src long").agg(F.count("*")).collect()
    return address


def load(address: str, src: int) -> bytes:
    """A slice's file."""
    fs, path = filesystem(address)
    with fs.open_input_stream(f"{path}/{src}", compression=None) as f:
        return f.read()


class Facts:
    """A slice's file of facts, read when the first row of the slice that needs it comes."""

    def __init__(self, address: str, parse):
        self.address, self.parse, self.src, self.facts = address, parse, None, None

    def of(self, src: int):
        if self.src != src:
            self.src, self.facts = src, self.parse(load(self.address, src))
        return self.facts


def by_source(src: np.ndarray, rows: np.ndarray) -> list[tuple[int, bytes]]:
    """Each src with the bytes of its rows."""
    if not len(src):
        return []
    order = np.argsort(src, kind="stable")
    src, rows = src[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])).tolist()
    return [(int(src[i]), rows[i:j].tobytes()) for i, j in zip(cut, [*cut[1:], len(src)], strict=True)]


def packed(rows: DataFrame) -> DataFrame:
    """(src, blob) of rows (src and other columns of longs): the bytes of the others, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if own := by_source(np.asarray(batch.column(0)), np.stack([np.asarray(c) for c in batch.columns[1:]], axis=1)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["src", "blob"])

    return rows.mapInArrow(run, "src long, blob binary")


def runs(src: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the rows of one slice each."""
    if len(src):
        cut = [0, *(np.flatnonzero(src[1:] != src[:-1]) + 1).tolist(), len(src)]
        yield from zip(cut[:-1], cut[1:], strict=True)
