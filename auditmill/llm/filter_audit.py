"""Filter interaction audit: what each filter removes at each place in each order, and its Shapley value.

1. Spark's own expressions give each text a mask of the filters that it fails. Equal texts are told by SHA-256.
2. Documents are counted by part and mask: 2**filters cells a part, whatever the number of documents.
3. All orders are walked by swaps of neighbours. A swap at a place changes what the two filters there remove and nothing else, so these two steps are summed
   anew from the cells; Shapley sums grow along the walk. Parts are walked together, as rows of one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.shared import frugal, written

SPACE = r"[\x20\x09-\x0D]+"
#: Parts that are walked together: they give 600 rows each with five filters.
TOGETHER = 64
#: Filters at most: they have 5,040 orders.
MOST = 7


class Filter(NamedTuple):
    letter: str
    #: Whether a document fails, of its text and its words; None: whether a smaller doc_id has the same text.
    fails: Callable[[Column, Column], Column] | None


FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 200),
    Filter("B", lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50),
    Filter("C", lambda text, words: F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 2),
    Filter("D", lambda text, words: text.rlike("[#$%&*|]")),
    Filter("E", None),
)


def masks(docs: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """doc_id, part, key, mask, n: rows of docs (doc_id, text, source) that agree in the first three. Bit k of mask: filter k fails the text by itself."""
    text = F.coalesce("text", F.lit(""))
    at = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"))
    bits = [F.when(f.fails(F.col("_text"), F.col("_words")), 1 << k).otherwise(0) for k, f in enumerate(filters) if f.fails]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    key = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    return at.select("doc_id", "part", key.alias("key"), mask.alias("mask")).groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by what they fail, and those of them that are labelled so."""
    rows = written(masks(docs, filters), "masks")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    no = F.lit(False)
    # rows without an id have no label, and would meet in one task of the join
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    all_ = known.unionByName(rows.where("doc_id is null").withColumns({"good": no, "toxic": no}))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = all_.groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"))
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    # of equal texts those of the smallest id stay, and rows without an id have no smaller one
    own = F.col("free") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copy = sum(1 << k for k, f in enumerate(filters) if not f.fails)
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("own")).alias("n"))))
    each = alike.withColumn("own", own).select("part", "good", "toxic", split.alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k, so that swapping k and k + 1 one after another visits every order of n things once, from the first."""
    order, way = list(range(n)), [-1] * n
    while True:
        moving = [x for i, x in enumerate(order) if 0 <= i + way[x] < n and order[i + way[x]] < x]
        if not moving:
            return
        x = max(moving)
        i = order.index(x)
        j = i + way[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            way[y] = -way[y]
        yield min(i, j)


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def walk(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """The orders, as they are visited, and MEASURES by part, order, step of cells (part x mask)."""
    mask = np.arange(1 << filters)
    orders, found = [], []
    failing = [n[:, (mask >> f) & 1 == 1].sum(axis=1) for f in range(filters)]
    alone = [n[:, 1 << f] for f in range(filters)]
    shapley = np.zeros((filters, len(n)), np.int64)

    def step(f: int, before: int) -> np.ndarray:
        gone = ((mask >> f) & 1 == 1) & (mask & before == 0)
        removed = n[:, gone].sum(axis=1)
        return np.stack([n[:, mask & (before | 1 << f) == 0].sum(axis=1), removed, failing[f] - removed, alone[f], good[:, gone].sum(axis=1), toxic[:, gone].sum(axis=1)])

    order = list(range(filters))
    steps = [step(f, (1 << f) - 1) for f in order]

    def visit() -> None:
        orders.append(tuple(order))
        found.append(np.stack(steps))
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]

    visit()
    for k in swaps(filters):
        order[k], order[k + 1] = order[k + 1], order[k]
        before = sum(1 << f for f in order[:k])
        steps[k], steps[k + 1] = step(order[k], before), step(order[k + 1], before | 1 << order[k])
        visit()
    total = np.stack([shapley[list(o)] for o in orders])
    return orders, np.concatenate([np.stack(found), total[:, :, None, :]], axis=2).transpose(3, 0, 1, 2)


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of docs (doc_id, text, source) and labels (doc_id,
    quality, toxic); other columns are not used. A row for each source (null: ''), each order of the filters' letters and each step from 1.

    A null text is empty. Each row is a document. A copy is a document whose text a smaller doc_id has, in any part; rows of one doc_id are no copies of each other, and one
    without a doc_id neither is a copy nor makes one, and has no label. Of several labels of a doc_id each one counts: it is good if one says so. An
    empty table gives no rows."""
    if not 0 < len(filters) <= MOST or len({f.letter for f in filters}) < len(filters):
        raise ValueError(f"1 to {MOST} filters, of different letters")
    width = 1 << len(filters)
    values = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    packed = cells(docs, labels, filters).groupBy("part").agg(values.alias("m"))
    each = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("m", k)[c], F.lit(0))).alias(c)
    packed = packed.select("part", each("n"), each("good"), each("toxic"))
    letters = [f.letter for f in filters]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), TOGETHER):
                batch = whole.slice(start, TOGETHER)
                own = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("n", "good", "toxic")]
                orders, found = walk(*own, len(letters))
                parts, each_ = len(batch), len(orders) * len(letters)
                names = pa.array(np.repeat(batch.column("part").to_numpy(zero_copy_only=False), each_), pa.string())
                spelt = ["".join(letters[f] for f in o) for o in orders for _ in o] * parts
                steps = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(orders) * parts)
                own_letters = [letters[f] for o in orders for f in o] * parts
                flat = found.reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([names, pa.array(spelt), pa.array(steps), pa.array(own_letters), *(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(MEASURES)))], ["part", "filter_order", "step", "filter", *MEASURES])

    return packed.mapInArrow(frugal(walked), "part string, filter_order string, step int, filter string, " + ", ".join(f"{m} long" for m in MEASURES))
