"""Removal of repeated passages by suffix order and longest-previous-factor arrays.

A byte is removed if it lies in a string of LENGTH bytes that also starts earlier: in a document with a smaller doc_id, or in the
same one before. The longest previous factor (LPF) of a position is the longest string that starts there and also at an
earlier position; it is reached at the previous or the next smaller position in suffix order. The starts of removed
strings are those with LPF >= LENGTH, so the order and the LPF values are computed to that depth; the first of equal strings has no such factor.

No task can hold the suffix array of the corpus, so positions that can match are brought together first:

1. Equal texts, by SHA-256: all but the one with the smallest doc_id go whole, if long enough; they take no further part. Of rows with the same
   doc_id and text one is elected; the others take no further part either, and get its marks at the end.
2. Anchors. In each window of LENGTH bytes, the K-gram with the least hash is its anchor: equal windows have equal
   anchors at the same offset. Each task sends its distinct anchors, in blocks of thousands, to parts of the hash space, and gets
   back those that occur twice or more.
3. For each such anchor, the starts whose windows have it are one segment of text. Each task puts its segments in suffix order,
   marks what has an LPF of LENGTH, and sends on only strings that it met first. So a part of the
   hash space gets each string once from a task, however frequent it is.
4. Each part puts all segments of its anchors in suffix order and marks again. Marks go back to the slices they came from.
5. The last scan cuts the marked strings out of the texts.

Of texts that are not equal the bytes themselves are compared: other hashes only bring candidates together. Marks belong to rows, by slice and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm import bytehash, sidefiles
from auditmill.llm.shared import frugal, frugal_group, parts_of, written
from auditmill.llm.sidefiles import Facts, by_source, runs

U64, I64, I32 = np.uint64, np.int64, np.int32
LENGTH = 100
K = 32
#: Bytes of segments that are put in suffix order together; one anchor's are never split.
TOGETHER = 2_000_000
#: A document without an id comes before all others.
NO_ID = -(2**63)
_POSITION = U64(2**31 - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of starts with one anchor: text number, first start, last start (in data), anchor hash."""
    n, k = len(data), min(K, length)
    w = length - k + 1
    sizes = np.diff(offsets)
    if n < length:
        return (np.zeros(0, I64),) * 3 + (np.zeros(0, U64),)
    up, down = bytehash.powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(bytehash._TABLE[data] * up[:n], dtype=U64, out=total[1:])
    h = bytehash.mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
    # the least (hash, position) of every w grams in a row: running minima from both ends of blocks of w
    value = (h & ~_POSITION) | np.arange(len(h), dtype=U64)
    pad = -len(value) % w
    grid = np.concatenate([value, np.full(pad, U64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    starts = len(h) - w + 1
    at = (np.minimum(ahead[:starts], behind[w - 1 : w - 1 + starts]) & _POSITION).astype(I64)
    valid = np.zeros(starts + 1, I32)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:][long] - length + 1), -1)
    s = np.flatnonzero(np.cumsum(valid[:starts]))
    at = at[s]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
    first = s[new]
    last = s[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
    return np.searchsorted(offsets, first, side="right") - 1, first, last, h[at[new]]


_BYTES = U64(256) ** np.arange(8, dtype=U64)


def suffix_order(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The ascending starts (their numbers) in suffix order to the depth of length bytes, equal ones by position; and how long a prefix, to that depth,
    each has in common with the one before it in this order (the first: 0). length bytes follow each start."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    word = np.empty(len(text) + 8, U64)
    for r in range(8):
        part = padded[r : r + (len(padded) - r) // 8 * 8].view(">u8")
        word[r::8] = part[: len(word[r::8])]
    common = np.full(len(starts), length, np.int16)
    if not len(starts):
        return np.zeros(0, I64), common
    depth = min(8, length)
    cut = lambda w, d: w >> U64(8 * (8 - d)) if d < 8 else w
    same = lambda x, y, d: d - np.searchsorted(_BYTES, x ^ y, side="right")  # noqa: E731 - equal first bytes of d
    key = cut(word[starts], depth)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(key[1:] != key[:-1]) + 1
    common[0], common[new] = 0, same(key[new], key[new - 1], depth)
    # ranks that are tied with the one before or after, and where each run of tied ones begins
    edge = common < length
    tied = np.flatnonzero(~edge | ~np.append(edge[1:], True))
    begins = edge[tied]
    at = starts[order[tied]]
    while depth < length and len(tied):
        step = min(8, length - depth)
        key = cut(word[at + depth], step)
        odd = np.flatnonzero((key[1:] != key[:-1]) & ~begins[1:])
        if len(odd):
            run = np.cumsum(begins) - 1
            uneven = np.zeros(run[-1] + 1, bool)
            uneven[run[odd]] = True
            split = np.flatnonzero(uneven[run])
            own, r = key[split], run[split]
            o = np.lexsort((own, r))
            own, r = own[o], r[o]
            order[tied[split]] = order[tied[split]][o]
            parted = np.flatnonzero((own[1:] != own[:-1]) & (r[1:] == r[:-1])) + 1
            common[tied[split[parted]]] = depth + same(own[parted], own[parted - 1], step)
            begins[split[parted]] = True
            stay = ~(begins & np.append(begins[1:], True))
            at[split] = starts[order[tied[split]]]
            tied, begins, at = tied[stay], begins[stay], at[stay]
        depth += step
    # what is equal to this depth goes by position
    order[tied] = np.sort(np.cumsum(begins) << 32 | order[tied]) & 0xFFFFFFFF
    return order, common


def _nearest_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before it whose place is smaller (-1: none), and the prefix in common with it: the least of common from there.

    All ranks look at once: one whose candidate is no smaller goes on to that one's candidate, as all between are larger than both. Candidates' own jumps
    double the distance, so there are a logarithm of rounds."""
    near = np.arange(len(place)) - 1
    least = common.copy()
    least[:1] = 0
    open_ = np.flatnonzero(place[1:] < place[:-1]) + 1
    while len(open_):
        at = near[open_]
        least[open_], near[open_] = np.minimum(least[open_], least[at]), near[at]
        at = near[open_]
        least[open_[at < 0]] = 0
        open_, at = open_[at >= 0], at[at >= 0]
        open_ = open_[place[at] > place[open_]]
    return near, least


def previous_factors(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of starts in suffix order: for each start (by its number) its longest previous factor, and the numbers of its previous and next smaller
    positions in suffix order (-1: none), one of which has that factor in common with it."""
    n = len(order)
    before, least = _nearest_smaller(order, common)
    # the same from the other end
    behind, most = _nearest_smaller(order[::-1], np.concatenate([common[1:], common[:1]])[::-1])
    behind, most = np.where(behind < 0, -1, n - 1 - behind)[::-1], most[::-1]
    lpf, psv, nsv = np.zeros(n, common.dtype), np.full(n, -1), np.full(n, -1)
    lpf[order] = np.maximum(least, most)
    psv[order] = np.where(before < 0, -1, order[before])
    nsv[order] = np.where(behind < 0, -1, order[behind])
    return lpf, psv, nsv


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each of the ascending starts the length, to length bytes at most, of the longest string from there that also begins at an earlier start."""
    return previous_factors(*suffix_order(text, starts, length))[0]


class Segments:
    """Rows of doc_id, h (hash of the text), src and pos (the row), start (in the text), anchor hash, and bytes."""

    KINDS = (I64, I64, I64, I64, I64, U64, I64)
    ANCHOR, BYTES = 5, 6

    def __init__(self, columns: list[np.ndarray], data: np.ndarray):
        self.columns, self.data = columns, data

    @classmethod
    def join(cls, parts: list[Segments]) -> Segments:
        return cls([np.concatenate(c) for c in zip(*(p.columns for p in parts), strict=True)], np.concatenate([p.data for p in parts]))

    def pack(self) -> bytes:
        return b"".join([np.array([len(self.columns[0])], I64).tobytes(), *(c.tobytes() for c in self.columns), self.data.tobytes()])

    @classmethod
    def unpack(cls, blob: bytes) -> Segments:
        n, at, columns = int(np.frombuffer(blob, I64, 1)[0]), 8, []
        for kind in cls.KINDS:
            columns.append(np.frombuffer(blob, kind, n, at))
            at += 8 * n
        return cls(columns, np.frombuffer(blob, np.uint8, -1, at))

    def take(self, rows: np.ndarray, skip: np.ndarray | int = 0, size: np.ndarray | None = None) -> Segments:
        """These rows; of each, size bytes from skip on."""
        doc, h, src, pos, start, anchor, n = (c[rows] for c in self.columns)
        begin = (np.cumsum(self.columns[self.BYTES]) - self.columns[self.BYTES])[rows] + skip
        n = n if size is None else size
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Segments([doc, h, src, pos, start + skip, anchor, n], self.data[at])

    def marked(self, length: int) -> tuple[list[tuple[int, bytes]], Segments]:
        """Marks as (src, blob of pos, first start, last start), and what is not marked."""
        doc, h, src, pos, start, _, _ = self.columns
        own = self.take(np.lexsort((start, pos, src, h, doc)))
        _, _, src, pos, start, _, n = own.columns
        per = n - length + 1
        begin = np.cumsum(n) - n
        seg = np.repeat(np.arange(len(n)), per)
        inside = np.arange(len(seg)) - np.repeat(np.cumsum(per) - per, per)
        mark = longest_previous_factors(own.data, begin[seg] + inside, length) >= length
        edge = np.concatenate([[True], (mark[1:] != mark[:-1]) | (seg[1:] != seg[:-1])]) if len(mark) else np.zeros(0, bool)
        first = np.flatnonzero(edge)
        count = np.diff(np.concatenate([first, [len(mark)]]))
        s, skip, hit = seg[first], inside[first], mark[first]
        rows = np.stack([pos[s], start[s] + skip, start[s] + skip + count - 1], axis=1)[hit]
        at = src[s][hit]
        marks = by_source(at, rows)
        return marks, own.take(s[~hit], skip[~hit], count[~hit] + length - 1)


def _text_hash(text: bytes) -> int:
    """Orders texts of one doc_id; tells nothing apart."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _later(blob: bytes) -> tuple[set, set]:
    """Places of rows that are later copies, and of those that another row with the same doc_id and text stands for."""
    x = np.frombuffer(blob, I64).reshape(-1, 2)
    whole = x[:, 1] == 1
    return set(x[whole, 0].tolist()), set(x[~whole, 0].tolist())


def _rows(batches: Iterator[pa.RecordBatch], later: Facts) -> Iterator[tuple]:
    """Blocks of one slice each, without later copies, rows that another stands for, and short texts: src, places, doc ids, text hashes, bytes, offsets."""
    for batch in batches:
        src = np.asarray(batch.column(2))
        for i, j in runs(src):
            for block, data, offsets in bytehash.blocks(iter([batch.slice(i, j - i)]), "text"):
                # only slices with long texts have files
                copies, others = later.of(int(src[i])) if (np.diff(offsets) >= LENGTH).any() else (set(), set())
                ids = [NO_ID if x is None else x for x in block.column(0).to_pylist()]
                pos = np.asarray(block.column(3))
                own = []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if b - a >= LENGTH:
                        if int(pos[k]) not in copies and int(pos[k]) not in others:
                            own.append((k, ids[k], _text_hash(data[a:b])))
                if not own:
                    continue
                k, doc, h = (np.array(x, I64) for x in zip(*own, strict=True))
                if len(k) < len(ids):
                    data = np.concatenate([data[offsets[x] : offsets[x + 1]] for x in k])
                    offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[k])])
                yield int(src[i]), pos[k], doc, h, data, offsets


def _anchor_blocks(copies: str, length: int, parts: int):
    """(part, src, blob): distinct anchors by parts of the hash space, those met twice here with their lowest bit set."""

    def flush(src: int, held: list) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held) & ~U64(1), return_counts=True)
        h |= (count > 1).astype(U64)
        part = ((h >> U64(33)) % U64(parts)).astype(I32)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        own = [p for p in range(parts) if cut[p + 1] > cut[p]]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([src] * len(own), pa.int64()), pa.array([h[order[cut[p] : cut[p + 1]]].tobytes() for p in own], pa.binary())], names=["part", "src", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, size = [], None, 0
        for src, _, _, _, data, offsets in _rows(batches, Facts(copies, _later)):
            if held and (src != at or size > 2_000_000):
                yield flush(at, held)
                held, size = [], 0
            h = anchors(data, offsets, length)[3]
            at, size = src, size + len(h)
            held.append(h)
        if held:
            yield flush(at, held)

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the hash space: for each slice its anchors that occur twice or more anywhere."""
    blobs = [np.frombuffer(b, U64) for b in pdf["blob"]]
    h = np.concatenate(blobs)
    src = np.repeat(pdf["src"].to_numpy(), [len(b) for b in blobs])
    order = np.argsort(h >> U64(1), kind="stable")
    key = h[order] >> U64(1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.add.reduceat((h[order] & U64(1)).astype(I64) + 1, first)
    several = np.repeat(count > 1, np.diff(np.concatenate([first, [len(h)]])))
    h, src = key[several] << U64(1), src[order][several]
    return pd.DataFrame(by_source(src, h), columns=["src", "blob"])


def _segment_blocks(copies: str, repeated: str, length: int, parts: int):
    """(part, mark, src, blob): segments of repeated anchors by parts of the hash space (mark false), and marks by slice (part any)."""

    def flush(held: list[Segments]) -> pa.RecordBatch:
        marks, rest = Segments.join(held).marked(length)
        part = ((rest.columns[Segments.ANCHOR] >> U64(33)) % U64(parts)).astype(I32)
        out = [(p, False, 0, rest.take(np.flatnonzero(part == p)).pack()) for p in np.unique(part).tolist()]
        out += [(abs(s) % parts, True, s, blob) for s, blob in marks]
        kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "mark", "src", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        wanted = Facts(repeated, lambda blob: np.unique(np.frombuffer(blob, U64)))
        for src, pos, doc, h, data, offsets in _rows(batches, Facts(copies, _later)):
            known = wanted.of(src)
            if not len(known):
                continue
            text, first, last, anchor = anchors(data, offsets, length)
            key = anchor & ~U64(1)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            own = np.flatnonzero(known[at] == key)
            if not len(own):
                continue
            text, first, n = text[own], first[own], last[own] - first[own] + length
            whole = Segments([doc[text], h[text], np.full(len(own), src), pos[text], first - offsets[text], key[own], n], data)
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            held.append(Segments(whole.columns, data[at]))
            size += int(n.sum())
            if size > TOGETHER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _part_marks(length: int):
    """Marks of one part of the hash space; marks that tasks made themselves pass through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = pdf["mark"]
        rows = [(int(s), b) for s, b in zip(pdf["src"][done], pdf["blob"][done], strict=True)]
        if not done.all():
            own = Segments.join([Segments.unpack(b) for b in pdf["blob"][~done]])
            order = np.argsort(own.columns[Segments.ANCHOR], kind="stable")
            anchor = own.columns[Segments.ANCHOR][order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            size = np.add.reduceat(own.columns[Segments.BYTES][order], first)
            batch = np.cumsum(size) // TOGETHER
            cut = first[np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]]))].tolist()
            for i, j in zip(cut, [*cut[1:], len(order)], strict=True):
                rows += own.take(order[i:j]).marked(length)[0]
        return pd.DataFrame(rows, columns=["src", "blob"])

    return run


def _removed(blob: bytes) -> dict[int, np.ndarray]:
    """The (first, last) starts to remove of each row by its place. A row (place, -1, other) has those of the other."""
    x = np.frombuffer(blob, I64).reshape(-1, 3)
    if not len(x):
        return {}
    same, x = x[x[:, 1] < 0], x[x[:, 1] >= 0]
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]]))
    out = {int(x[i, 0]): x[i:j, 1:] for i, j in zip(new, [*new[1:], len(x)], strict=True)}
    return out | {int(pos): out[int(other)] for pos, _, other in same}


def _shared_marks(marks: str):
    """(src, blob): the marks of elected rows (source, at), for the rows of slice src (places) that they stand for. Rows come by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        removed = Facts(marks, _removed)
        for batch in batches:
            out = []
            for source, at, src, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x = removed.of(source).get(at)
                if x is not None:
                    own = [[places[0], *r] for r in x.tolist()] + [[p, -1, places[0]] for p in places[1:]]
                    out.append((src, np.array(own, I64).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], names=["src", "blob"])

    return run


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings with these (first, last) starts, sorted by first, cover."""
    end = np.maximum.accumulate(starts[:, 1] + length)
    new = np.concatenate([[True], starts[1:, 0] > end[:-1]])
    first = np.flatnonzero(new)
    return list(zip(starts[first, 0].tolist(), end[np.concatenate([first[1:] - 1, [len(end) - 1]])].tolist(), strict=True))


def _whole_characters(piece: bytes, before: bool, after: bool) -> bytes:
    """The piece without the rest of a character that a cut before it split, and that of one that a cut after it split."""
    i, j = 0, len(piece)
    while before and i < min(j, 3) and piece[i] & 0xC0 == 0x80:
        i += 1
    if after:
        for k in range(j - 1, max(i, j - 3) - 1, -1):
            if piece[k] & 0xC0 != 0x80:
                j = k if piece[k] >= 0xC0 and k + (2 if piece[k] < 0xE0 else 3 if piece[k] < 0xF0 else 4) > j else j
                break
    return piece[i:j]


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(copies: str, marks: str, shared: str, length: int, texts: bool, extra: list[str], characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later, removed, others = Facts(copies, _later), Facts(marks, _removed), Facts(shared, _removed)
        for batch in batches:
            out = []
            for doc, text, src, pos in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or b""
                spans: list = []
                if len(text) >= length:
                    if pos in later.of(src)[0]:
                        spans = [(0, len(text))]
                    elif (x := removed.of(src).get(pos, others.of(src).get(pos))) is not None:
                        spans = _spans(x, length)
                kept = text
                if spans:
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    pieces = zip(edges[::2], edges[1::2], strict=True)
                    kept = b"".join(_whole_characters(text[i:j], i > 0, j < len(text)) if characters else text[i:j] for i, j in pieces)
                out.append((doc, len(text), sum(j - i for i, j in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            if out:
                columns = zip(*out, strict=True)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(made[: 5 + texts] + batch.columns[4:], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts, *extra])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True, extra: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if texts, kept (the bytes left) of each row of docs (doc_id, text),
    and its columns named in extra.

    A null text is empty. Texts of fewer than length bytes lose nothing. A null doc_id comes before all others; texts
    with the same doc_id count as earlier by the hash of their text, then by place, and repeated rows (same doc_id and text) are one document, with
    one result, returned for each. Cuts may split a character: kept is bytes, and lacks what is left of such
    characters if characters is set (n_removed does not count that). Other columns are not used."""
    if length != LENGTH:
        raise ValueError("segments are cut for LENGTH")
    placed = sidefiles.with_source(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *extra), "doc_id", "text", *extra)
    rows = placed.select("doc_id", "text", "src", "pos")
    whole = placed.select("doc_id", "text", "src", "pos", *extra)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(NO_ID if d is None else d, hashlib.sha256(t).digest(), s, p, len(t)) for d, t, s, p in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) if t and len(t) >= length]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 1 else pa.int64()) for k, c in enumerate(zip(*own, strict=True))], names=["doc", "digest", "src", "pos", "n"])

    ids = written(rows.mapInArrow(frugal(named), "doc long, digest binary, src long, pos long, n long"), "texts")
    parts = parts_of(docs.sparkSession, ids.agg(F.sum("n")).first()[0] or 0)
    sources = written(ids.select("src").distinct(), "sources")
    # the elected row of a document lies in any of its slices, not always in the same one
    row = F.struct("doc", F.xxhash64("digest", "src").alias("draw"), "src", "pos")
    first = ids.groupBy("digest").agg(F.min(row).alias("first"), F.count("*").alias("c")).where("c > 1")
    # a text of thousands of copies is dealt over several tasks
    salted = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    equal = ids.withColumn("salt", F.pmod(F.xxhash64("doc", "src", "pos"), F.lit(16)).cast("int")).join(salted, ["digest", "salt"])
    other = equal.where("doc = first.doc and (src <> first.src or pos <> first.pos)")
    flagged = lambda own, flag: own.select("src", "pos", F.lit(flag).cast("long").alias("whole"))
    later = flagged(equal.where("doc > first.doc"), 1).unionByName(flagged(other, 0))

    copies = sidefiles.save(sidefiles.packed(later), "copies", sources)
    dealt = rows.mapInArrow(frugal(_anchor_blocks(copies, length, parts)), "part int, src long, blob binary")
    repeated = sidefiles.save(dealt.repartitionById(parts, "part").groupBy("part").applyInPandas(frugal_group(_repeated), "src long, blob binary"), "repeated", sources)
    segments = rows.mapInArrow(frugal(_segment_blocks(copies, repeated, length, parts)), "part int, mark boolean, src long, blob binary")
    marks = sidefiles.save(segments.repartitionById(parts, "part").groupBy("part").applyInPandas(frugal_group(_part_marks(length)), "src long, blob binary"), "marks", sources)
    # a place for each row of a slice, so a row of thousands of repeats has one line for each slice
    stands = other.groupBy(F.col("first.src").alias("source"), F.col("first.pos").alias("at"), "src").agg(F.collect_list("pos").alias("places"))
    stands = stands.repartition("source", F.pmod("src", F.lit(64))).sortWithinPartitions("source")
    shared = sidefiles.save(stands.mapInArrow(frugal(_shared_marks(marks)), "src long, blob binary"), "shared", sources)
    schema = ", ".join([OUT] + ["kept binary"] * texts + [f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema.fields[4:]])
    return whole.mapInArrow(frugal(_cut(copies, marks, shared, length, texts, list(extra), characters)), schema)
