import numpy as np
import pytest
import tiktoken
from auditmill.llm import bpe, token_counts


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_equals_a_plain_scan(spark, tmp_path, block):
    rnd = np.random.default_rng(block)
    files, want = [], []
    for k, ids in enumerate([rnd.choice([1, 2, 9], 40), np.array([9]), np.array([9, 9, 1]), np.array([1, 1]), np.zeros(0)]):
        ids.astype("uint16").tofile(tmp_path / str(k))
        files.append((f"file://{tmp_path}/{k}", 2 * len(ids)))
        start = ordinal = 0
        for i, t in enumerate([*ids.tolist(), None]):
            if t == 9 or (t is None and start < len(ids)):
                want.append((files[-1][0], ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
    got = token_counts.count_tokens(spark.createDataFrame([*files, (None, 4)], "path string, n_bytes long"), separator=9, block=block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_documents_through_files(spark):
    path, pattern = bpe.default_tokenizer()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [(1, "ein Text", 1), (1, "ein Text", 1), (None, "a b c", 1), (2, None, 1), (3, "", 1), (4, "<|endoftext|>", 1), (5, "x y " * 50_000, 1)]
    got = token_counts.document_tokens(spark.createDataFrame(rows, "doc_id long, text string, path int").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(d, len(theirs.encode_ordinary(t or ""))) for d, t, _ in rows], key=str)
    assert token_counts.document_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_half_a_token_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number"):
        token_counts.count_tokens(spark.createDataFrame([(f"file://{tmp_path}/x", 3)], "path string, n_bytes long")).collect()


def test_blocks_are_dealt_to_tasks(spark, tmp_path):
    """With adaptive execution, which would put rows so small in one task."""
    np.tile(np.array([1, 2, 9], "uint16"), 10_000).tofile(tmp_path / "x")
    got = token_counts.count_tokens(spark.createDataFrame([(f"file://{tmp_path}/x", 60_000)], "path string, n_bytes long"), separator=9, block=300)
    assert got.count() == 10_000 and got.selectExpr("spark_partition_id() AS p").distinct().count() == spark.sparkContext.defaultParallelism
