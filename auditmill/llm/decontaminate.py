"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-case words with single spaces. A test item of m characters may occur with k edits, k being m * EDITS rounded
down, or one more to be odd: the same for items of every length. Cut into k + 1 pieces, one piece of it at least is in the text unchanged; so an automaton over all
pieces finds every place that can hold it. Taken two by two, one pair of pieces has one edit at most, by the same count: a hit is taken up if its pair is there
with one edit. Then Myers' bit-parallel algorithm computes the least edit distance between the item and any string around the place.

Items of fewer than LEAST characters say too little to be told from ordinary text with an edit, and are not looked for; too_short() lists them.

Items lie in files of BLOCK_CHARS in the shared folder, which the tasks read: a benchmark of any size is held against all documents block by
block, and its items pass through neither the driver nor the plan. A worker keeps the automata of KEPT blocks. Texts are not shuffled, and each is read once.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm import sidefiles

#: Share of an item's characters that may be edits.
EDITS = 0.08
#: Characters of the shortest item that is looked for.
LEAST = 20
#: Characters of items in one block.
BLOCK_CHARS = 1_000_000
#: Blocks whose automata a worker keeps.
KEPT = 4
#: Characters of texts that are gathered for each block where there are more blocks.
GATHERED = 16_000_000

_WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    """Lower-case words (runs of letters, digits and underscores), with one space between."""
    return " ".join(_WORDS.findall((text or "").lower()))


def budget(m: int, edits: float = EDITS) -> int:
    return int(m * edits) | 1


def cuts(m: int, k: int) -> list[int]:
    """Where k + 1 pieces of nearly the same length begin, and the end."""
    return [m * i // (k + 1) for i in range(k + 2)]


def masks(item: str) -> dict[str, int]:
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        at[c] |= 1 << i
    return dict(at)


def distance(peq: dict[str, int], m: int, text: str, k: int) -> int:
    """The least edit distance between an item (by its masks) and any substring of text; k + 1 if over k. Myers (1999)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, min(m, k + 1)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Matcher:
    """All items of a block: id -> normal text. Those under `least` characters are left out."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS, least: int = LEAST):
        import ahocorasick

        self.items = [(i, t, k := budget(len(t), edits), cuts(len(t), k)) for i, t in items if len(t) >= max(2, least)]
        self.peq: dict[tuple[int, int], dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, _, cut) in enumerate(self.items):
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                found[t[a:b]].append((n, p))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if self.items:
            self.automaton.make_automaton()

    def _masks(self, n: int, pair: int, string: str) -> dict[str, int]:
        found = self.peq.get((n, pair))
        if found is None:
            found = self.peq[n, pair] = masks(string)
        return found

    def _pair(self, text: str, n: int, pair: int, start: int) -> bool:
        """Whether the item's pair of pieces is in text with one edit at most, were the item to begin at start."""
        _, item, k, cut = self.items[n]
        a, b = cut[2 * pair], cut[2 * pair + 2]
        own = item[a:b]
        low = max(0, start + a)
        return text.startswith(own, low) or distance(self._masks(n, pair, own), b - a, text[max(0, low - 1) : start + b + 1], 1) <= 1

    def find(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """(item id, distance, budget) of each item that text (normal) holds."""
        if not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for n, p in places:
                cut = self.items[n][3]
                s = end + 1 - size - cut[p]
                if s not in starts.get(n, ()) and self._pair(text, n, p // 2, s):
                    starts[n].add(s)
        for n, where in starts.items():
            i, item, k, _ = self.items[n]
            m = len(item)
            peq = self._masks(n, -1, item)
            best, low, high = k + 1, None, None
            for s in [*sorted(where), None]:
                # occurrences start within k of where the piece says; overlapping ones are verified together
                if low is not None and (s is None or s - k > high):
                    best = min(best, distance(peq, m, text[max(0, low) : high], k))
                    low = None
                    if best == 0:
                        break
                if s is not None:
                    low, high = (s - k if low is None else low), s + m + k
            if best <= k:
                yield i, best, k


def _normal_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item): the normal texts of benchmark (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(x) for x in batch.column(1).to_pylist()], pa.string())], names=["item_id", "item"])

    return benchmark.select(F.col("item_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(run, "item_id long, item string")


def too_short(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(item_id, item) of items of benchmark (item_id, text) that are not looked for: of fewer than least characters, empty ones and null ones included."""
    return _normal_items(benchmark).where(F.length("item") < max(2, least))


def _item_blocks(benchmark: DataFrame, least: int) -> tuple[str, int]:
    """Where the blocks of items lie, and how many there are: one at least."""
    n = -(-(benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0) // BLOCK_CHARS) or 1
    items = _normal_items(benchmark).where(F.length("item") >= max(2, least))
    line = F.concat(F.to_json(F.struct("item_id", "item")), F.lit("\n")).cast("binary")
    blobs = items.select(F.pmod(F.xxhash64("item_id", "item"), F.lit(n)).alias("src"), line.alias("blob"))
    return sidefiles.save(blobs, "items", benchmark.sparkSession.range(n).select(F.col("id").alias("src"))), n


_matchers: OrderedDict[tuple, Matcher] = OrderedDict()


def _matcher(address: str, block: int, edits: float, least: int) -> Matcher:
    """The block's matcher, from the worker's own store or its file."""
    key = (address, block, edits, least)
    if key not in _matchers:
        lines = sidefiles.load(address, block).decode().splitlines()
        while len(_matchers) >= KEPT:
            _matchers.popitem(last=False)
        _matchers[key] = Matcher([(x.get("item_id"), x["item"]) for x in map(json.loads, lines)], edits, least)
    _matchers.move_to_end(key)
    return _matchers[key]


def _together(batches: Iterator[pa.RecordBatch], column: int, blocks: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches with their normal texts. Where there are more blocks of items than a worker keeps, texts are gathered, so that a block is built for many of them."""
    held, texts, size = [], [], 0

    def made():
        table = pa.Table.from_batches(held).combine_chunks()
        return table.to_batches()[0], texts

    for batch in batches:
        own = [normal(t) for t in batch.column(column).to_pylist()]
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if len(batch) and (blocks <= KEPT or size >= GATHERED):
            yield made()
            held, texts, size = [], [], 0
    if texts:
        yield made()


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_edits, max_edits: each item of benchmark (item_id, text) that a row of docs (doc_id, text) holds.

    Null and empty texts, and items of fewer than least characters (null ones, and such without a word), hold and are held by nothing: a shorter item
    with an edit is in ordinary text, so what is lost are the leaks of such items, which too_short() lists; least = 2 looks for all of two characters or more. Bytes
    that are no UTF-8 count as U+FFFD. A null doc_id or item_id stays null; repeated rows and items are found repeatedly. Other
    columns are not used. An item occurs once a document at most, with its fewest edits."""
    address, n = _item_blocks(benchmark, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _together(batches, 1, n):
            ids = batch.column(0).to_pylist()
            for b in range(n):
                matcher = _matcher(address, b, edits, least)
                out = [(d, *hit) for d, t in zip(ids, texts, strict=True) for hit in matcher.find(t)]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_edits", "max_edits"])

    return docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(run, "doc_id long, item_id long, n_edits int, max_edits int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, least: int = LEAST) -> DataFrame:
    """The rows of docs that hold no item of benchmark, all columns; what holds an item is as find_leaks() says. No row is shuffled."""
    address, n = _item_blocks(benchmark, least)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _together(batches, text, n):
            clean = list(range(len(texts)))
            for b in range(n):
                matcher = _matcher(address, b, edits, least)
                clean = [k for k in clean if next(matcher.find(texts[k]), None) is None]
            yield batch.take(pa.array(clean, pa.int64()))

    return docs.withColumn("text", F.make_valid_utf8("text")).mapInArrow(run, docs.schema)
