"""Token counts of flat token files by separator scan.

A flat file is nothing but token ids of one width, end to end, with an end-of-document id after each document: no index, no header. Tasks
read blocks of it and find separators with one vectorised comparison. A document may span blocks, so counts are made in two passes: the
first finds how many separators each block has and where its last one is; a prefix scan over the blocks' summaries gives each block the
number of documents and the last separator before it; the second pass then emits whole documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.shared import dealt, filesystem, scratch, written

#: Tokens in a block.
BLOCK = 4_000_000
#: Free in the vocabulary's file.
SEPARATOR = 50256
DTYPE = "uint16"


def write_flat(docs: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """Encode docs (doc_id, text) into flat files in the shared folder, one a task; (path, n_bytes, ordinal, doc_id) for each document.

    A null text has no tokens; bytes that are no UTF-8 count as U+FFFD. Files come by rename, under a name of their own for each attempt: the rows of the attempt that
    counted name the file that they describe."""
    from auditmill.llm.bpe import default_tokenizer, read_ranks

    address = scratch(docs.sparkSession, "tokens")
    ranks_path, pattern = default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        fs, path = filesystem(address)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tokens"
        ids: list = []
        size = 0
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/.{name}", compression=None) as out:
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    tokens = np.array([*own.encode_ordinary(t.as_py() or ""), separator], dtype)
                    out.write(tokens.tobytes())
                    size += tokens.nbytes
                    ids.append(d)
        if not ids:
            fs.delete_file(f"{path}/.{name}")
            return
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        for i in range(0, len(ids), 50_000):
            part = ids[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f"{address}/{name}"] * len(part)), pa.array([size] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part, pa.int64())], names=["path", "n_bytes", "ordinal", "doc_id"])

    found = docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(run, "path string, n_bytes long, ordinal long, doc_id long")
    return written(found, "ledger")


def count_tokens(files: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """path, ordinal, start, n_tokens of each document of files (path, n_bytes), by ordinal from 0 in each file; start counts tokens.

    Documents end with a separator, which is not counted; tokens after the last one are a document too. Two separators in a row have an empty
    document between them. Empty files have none. A file that isn't a whole number of tokens is an error. A null path is skipped."""
    width = np.dtype(dtype).itemsize

    def tokens(path: str, at: int) -> np.ndarray:
        fs, local = filesystem(path)
        with fs.open_input_file(local) as f:
            if f.size() % width:
                raise ValueError(f"{path} is not a whole number of tokens")
            f.seek(at * block * width)
            return np.frombuffer(f.read(block * width), dtype)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, at, total in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                hit = np.flatnonzero(tokens(path, at) == separator)
                rows.append((path, at, total, len(hit), at * block + int(hit[-1]) if len(hit) else -1))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "block", "total", "n", "last"])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, total, ordinal, start in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = tokens(path, at)
                end = np.flatnonzero(own == separator) + at * block
                if at * block + len(own) == total and (not len(own) or own[-1] != separator):
                    end = np.append(end, total)
                begin = np.concatenate([[start], end[:-1] + 1])[: len(end)]
                for i in range(0, len(end), 50_000):
                    b, e = begin[i : i + 50_000], end[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(b)), pa.array(ordinal + i + np.arange(len(b))), pa.array(b), pa.array(e - b)], names=["path", "ordinal", "start", "n_tokens"])

    total = F.floor(F.col("n_bytes") / width).cast("long")
    held = files.where("path is not null and n_bytes > 0")
    blocks = held.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(total, F.lit(1)) - 1) / block).cast("long"))).alias("block"), total.alias("total"))
    n, size = held.agg(F.sum(F.ceil(F.greatest(total, F.lit(1)) / block)), F.sum("n_bytes")).first()
    sums = dealt(blocks, n or 0, size or 0).mapInArrow(summed, "path string, block long, total long, n long, last long")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = sums.select("path", "block", "total", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ordinal"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("start"))
    return dealt(scanned, n or 0, size or 0).mapInArrow(emitted, "path string, ordinal long, start long, n_tokens long")


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens of each row of docs (doc_id, text), written to flat files and counted by scanning them.

    A null or empty text has none. Repeated rows are documents of their own. Other columns are not used."""
    ledger = write_flat(docs)
    files = ledger.groupBy("path").agg(F.first("n_bytes").alias("n_bytes"))
    # the ledger's columns compress so well that its files would pass for a table small enough to broadcast
    return ledger.select("path", "ordinal", "doc_id").hint("merge").join(count_tokens(files), ["path", "ordinal"]).select("doc_id", "n_tokens")
