"""Source divergence audit: how far the sources of a language are apart in what they say, in exact whole numbers.

1. Tasks count the terms of whole texts for each (lang, source); Spark adds them up. A language keeps the terms of enough of its documents.
2. Kept terms are numbered within vocabulary chunks, and a group's counts in a chunk are packed in one row.
3. Groups are put in blocks. A packed row goes to the tiles of its block with every block of its language. A tile's rows come sorted by chunk: it keeps the
   sums of its pairs and one chunk, whatever the vocabulary. Terms that no group of the tile has add one value for each pair, which is multiplied.

f(p, q) = floor((p - q)**2 / (p + q)) with shares p, q in billionths, which are smoothed by 2. f is symmetric, so tiles above the diagonal are enough.
Shares are exact up to 2.9e14 counts: a billion times a count would pass 64 bits, so it is multiplied in two steps.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.shared import frugal, written

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Documents of a language that a kept term is in, and terms of a group that are told.
LEAST_DOCUMENTS, TOP = 10, 10
#: Terms of a vocabulary chunk and groups of a block, about: both are dealt by hash.
CHUNK_TERMS, BLOCK_GROUPS = 2048, 16
#: Terms that a task holds before it hands them on, about 100 bytes each.
HELD_TERMS = 500_000
#: Characters from which a text's terms are counted as they are found.
LONG = 1_000_000
#: What a share is out of, as a product of which each factor times a count fits 64 bits.
_STEPS = (31_250, 32_000)
#: Bits of a number of documents.
_DOCS = 40
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _terms(text: str) -> dict[str, int]:
    """The terms of a text and how often each is there."""
    plain = text.isascii()
    said = text.lower() if plain else text
    found = Counter(TERM.findall(said) if len(said) < LONG else (m.group() for m in TERM.finditer(said)))
    if plain:
        return found
    out: dict[str, int] = {}
    for term, n in found.items():
        own = term.lower() if term.isascii() else term.translate(_LOWER)
        out[own] = out.get(own, 0) + n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms by group, and a row without a term for each group."""
    # of each term one number: how often it is there, and in the lower bits in how many documents
    held: dict[tuple[str, str], dict[str, int]] = defaultdict(dict)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            n = len(own) + 1
            values = ([0, *(x >> _DOCS for x in own.values())], [0, *(x & (1 << _DOCS) - 1 for x in own.values())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([None, *own], pa.string()), *(pa.array(x, pa.int64()) for x in values)], schema=_COUNTED)
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            own = held[lang.as_py(), source.as_py()]
            size -= len(own)
            for term, n in _terms(text.as_py()).items():
                own[term] = own.get(term, 0) + (n << _DOCS) + 1
            size += len(own)
            if size >= HELD_TERMS:
                yield from rows()
                size = 0
    yield from rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often each group has a term, in how many documents; and a row with a null term for each group."""
    said = docs.select(*(F.make_valid_utf8(F.coalesce(c, F.lit(""))).alias(c) for c in ("lang", "source", "text")))
    found = said.mapInArrow(frugal(_count), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """A count's share in billionths, smoothed: names of the count, the group's sum, and the number of kept terms."""
    a, b = _STEPS
    x, d = f"(({n} + 2) * {a}L)", f"({total} + 2 * {terms})"
    return F.expr(f"1 + ({x} div {d}) * {b}L + (({x} % {d}) * {b}L) div {d}")


def shares(n: np.ndarray, total: int | np.ndarray, terms: int) -> np.ndarray:
    """share() of an array of counts; total may be a column."""
    a, b = _STEPS
    d = total + 2 * terms
    whole, rest = np.divmod((n.astype(np.int64) + 2) * a, d)
    return 1 + whole * b + rest * b // d


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _totals(groups: list[tuple[str, int, int, int]]) -> np.ndarray:
    return np.array([total for _, _, total, _ in groups], np.int64).reshape(-1, 1)


class _Tile:
    """The sums of the pairs of two blocks of groups, of which chunks are added one after another."""

    def __init__(self, groups: list[tuple[str, int, int, int]], low: int, high: int):
        """groups: source, its block, the sum of its counts, the kept terms of its language."""
        self.rows = [g for g in groups if g[1] == low]
        self.columns = [g for g in groups if g[1] == high]
        self.same, self.terms, self.seen = low == high, groups[0][3], 0
        self.sums = np.zeros((len(self.rows), len(self.columns)), np.int64)

    def add(self, cells: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """One chunk: for each source the numbers of its terms, and their counts."""
        there = np.unique(np.concatenate([at for at, _ in cells.values()]))
        self.seen += len(there)

        def unpacked(groups: list) -> np.ndarray:
            n = np.zeros((len(groups), len(there)), np.int64)
            for k, (source, *_) in enumerate(groups):
                if source in cells:
                    at, own = cells[source]
                    n[k, np.searchsorted(there, at)] = own
            return shares(n, _totals(groups), self.terms)

        p = unpacked(self.rows)
        q = p if self.same else unpacked(self.columns)
        for k, own in enumerate(p):
            self.sums[k] += apart(own, q).sum(axis=1)

    def pairs(self) -> Iterator[tuple[str, str, int]]:
        if self.terms and self.sums.size:
            none = lambda groups: shares(np.zeros((len(groups), 1), np.int64), _totals(groups), self.terms)
            self.sums += (self.terms - self.seen) * apart(none(self.rows), none(self.columns).T)
        for a, row in zip(self.rows, self.sums, strict=True):
            for b, value in zip(self.columns, row, strict=True):
                if a[0] != b[0]:
                    yield a[0], b[0], int(value)
                    if not self.same:
                        yield b[0], a[0], int(value)


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each tile, from rows that are sorted by tile and chunk. Chunk -1 holds a row for each group."""

    def rows():
        for batch in batches:
            at, n = batch.column("at"), batch.column("counts")
            flat, counted, ends = at.flatten().to_numpy(zero_copy_only=False), n.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(x or 0 for x in at.value_lengths().to_pylist())])
            plain = zip(*(batch.column(c).to_pylist() for c in ("lang", "low", "high", "chunk", "source", "block", "total", "terms")), strict=True)
            for k, r in enumerate(plain):
                own = slice(ends[k], ends[k + 1])
                # a view would keep the whole batch
                yield r[:3], r[3], r[4:], (flat[own].copy(), counted[own].copy())

    for (lang, low, high), own in groupby(rows(), key=lambda r: r[0]):
        tile = None
        for chunk, part in groupby(own, key=lambda r: r[1]):
            if chunk < 0:
                tile = _Tile([r[2] for r in part], low, high)
            else:
                tile.add({r[2][0]: r[3] for r in part})
        found = list(tile.pairs())
        if found:
            a, b, values = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(values, pa.int64())], schema=_PAIRS)


def _parts(n: int, each: int) -> int:
    return max(1, -(-n // each))


def _most(rows: DataFrame) -> int:
    """Rows of the language that has most."""
    return rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; other columns are not used), where nulls count as ''.

    Part `pair`: for each source every other source of the language (item) and the sum of f over the language's kept terms, 0 where it keeps none. Part
    `term`: the group's own terms whose share is larger than in the whole language, by f, the first `top`. Ranks go from 1 by
    value, largest first, then by item's bytes. A term is a run of letters A to Z (any case) and characters above ASCII, of any length; bytes that are no UTF-8 count as U+FFFD. Each
    row is a document, repeated rows too. A source with no terms is a group all the same. An empty table gives no rows."""
    counted = written(counts(docs), "term-counts")
    terms = counted.where("term is not null")
    kept = written(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    chunk = F.pmod(F.xxhash64("term"), F.lit(_parts(_most(kept), chunk_terms))).cast("int")
    kept = kept.withColumn("chunk", chunk)
    kept = kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    held = written(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")

    groups = counted.where("term is null").select("lang", "source")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blocks = _parts(_most(groups), block_groups)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]).withColumn("block", block)
    groups = written(groups, "groups")

    own = held.join(groups, ["lang", "source"]).withColumns({"p": share("n", "total", "terms"), "q": share("lang_n", "lang_total", "terms")}).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    cells = F.array_sort(F.collect_list(F.struct("at", "n")))
    packed = held.groupBy("lang", "source", "chunk").agg(cells.alias("cells")).select("lang", "source", "chunk", F.col("cells.at").alias("at"), F.col("cells.n").alias("counts"))
    packed = packed.join(groups.select("lang", "source", "block"), ["lang", "source"]).withColumns({"total": F.lit(0).cast("long"), "terms": F.lit(0).cast("long")})
    heads = groups.select("lang", "source", F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("counts"), "block", "total", "terms")
    dealt = packed.unionByName(heads).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    sorted_ = dealt.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk")
    pairs = sorted_.mapInArrow(frugal(_tiles), "lang string, source string, item string, value long")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    return pairs.unionByName(own)
