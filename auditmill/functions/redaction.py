"""Deletion in JSON text over the bytes of an Arrow batch: members are found by their places, and all else stays as it was written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that are scanned at once; a longer text is alone.
CHUNK = 4 << 20
_MARKS = np.zeros(256, bool)
_MARKS[list(b'{}[]:,"')] = True
_QUOTE, _COLON, _COMMA, _BACKSLASH = b'":,\\'


def redacted(texts: pa.Array, keys: list[str], paths: list[list[str]]) -> pa.Array:
    """texts without members named by keys at any depth and without what paths lead to; an array's item becomes null.

    Nulls, and texts that hold nothing of it or that are not JSON, stay."""
    held = texts.cast(pa.large_string())
    parts = [_scan(held.slice(start, stop - start), keys, paths) for start, stop in _chunks(held)]
    return pa.concat_arrays(parts).cast(texts.type) if parts else texts


def _bounds(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's bytes begin and end in the array's buffer."""
    at = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    return at[:-1], at[1:]


def _chunks(held: pa.Array) -> Iterator[tuple[int, int]]:
    if len(held) and held.buffers()[2]:
        starts, ends = _bounds(held)
        row = 0
        while row < len(held):
            stop = max(row + 1, int(np.searchsorted(ends, starts[row] + CHUNK, "right")))
            yield row, stop
            row = stop


def _escaped(b: np.ndarray) -> np.ndarray:
    """Whether an odd number of backslashes comes right before each byte."""
    at = np.arange(b.size)
    run = at - np.maximum.accumulate(np.where(b == _BACKSLASH, -1, at))
    return np.concatenate([[False], run[:-1] % 2 == 1])


class _Members:
    """The containers' parts of a buffer of JSON texts, in the order of their level and place; what texts that are not JSON give means nothing.

    Each entry is an opening bracket, a comma, a closing one, or a name, which comes right after its bracket or comma."""

    def __init__(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.b = b
        special = _MARKS[b]
        self.slashes = np.flatnonzero(b == _BACKSLASH)
        if self.slashes.size:
            special &= ~((b == _QUOTE) & _escaped(b))
            special[starts[starts < b.size]] = _MARKS[b[starts[starts < b.size]]]
        pos = np.flatnonzero(special)
        row = np.searchsorted(ends, pos, "right")
        whole = np.searchsorted(row, np.arange(len(ends) + 1))
        kind = b[pos]
        quotes = np.concatenate([[0], np.cumsum(kind == _QUOTE)])
        inside = (quotes[1:] - quotes[whole[row]]) % 2 == 1
        kept = (kind == _QUOTE) | ~inside
        pos, row, kind, opening = pos[kept], row[kept], kind[kept], inside[kept]
        # a string and a colon after it are a name
        name = np.zeros(pos.size, bool)
        if pos.size > 2:
            name[:-2] = (kind[:-2] == _QUOTE) & opening[:-2] & (kind[1:-1] == _QUOTE) & (kind[2:] == _COLON) & (row[:-2] == row[2:])
        until = np.append(pos[1:], b.size)
        part = name | ((kind != _QUOTE) & (kind != _COLON))
        pos, row, kind, name, until = pos[part], row[part], kind[part], name[part], until[part]
        opens, closes = np.isin(kind, list(b"{[")), np.isin(kind, list(b"}]"))
        depth = np.concatenate([[0], np.cumsum(opens.astype(np.int64) - closes)])
        first = np.searchsorted(row, np.arange(len(ends) + 1))
        level = depth[1:] - depth[first[row]] + closes
        # texts that are no single bracketed value for sure
        self.broken = (quotes[whole[1:]] - quotes[whole[:-1]]) % 2 + (depth[first[1:]] != depth[first[:-1]]) > 0
        self.broken[row[level < 1]] = True
        level = np.maximum(level, 0)
        by = np.argsort(level, kind="stable")
        self.pos, self.row, self.kind, self.name, self.until, self.level, self.opens, self.closes = (x[by] for x in (pos, row, kind, name, until, level, opens, closes))
        self.key = self.level * (b.size + 1) + self.pos
        self.owner = np.cumsum(self.opens)
        self.opener = np.concatenate([[0], np.flatnonzero(self.opens)])
        commas = np.cumsum(self.kind == _COMMA)
        self.ordinal = commas - commas[self.opener[self.owner]] if self.pos.size else commas

    def named(self, wanted: list[str]) -> np.ndarray:
        """Entries that are one of these names, whether or not they are written with escapes."""
        at = np.flatnonzero(self.name)
        begin, end = self.pos[at] + 1, self.until[at]
        hit = np.zeros(at.size, bool)
        for w in {x.encode() for x in wanted}:
            own = np.flatnonzero(end - begin == len(w))
            if w:
                own = own[self.b[begin[own]] == w[0]]
                own = own[(self.b[begin[own][:, None] + np.arange(len(w))] == np.frombuffer(w, np.uint8)).all(axis=1)]
            hit[own] = True
        for k in np.flatnonzero(np.searchsorted(self.slashes, end) > np.searchsorted(self.slashes, begin)):
            try:
                hit[k] = json.loads(self.b[begin[k] - 1 : end[k] + 1].tobytes().decode()) in wanted
            except ValueError:
                pass
        out = np.zeros(self.pos.size, bool)
        out[at[hit]] = True
        return out

    def items(self, owners: np.ndarray, number: int) -> np.ndarray:
        """The brackets and commas before the item of this number in arrays of owners (a flag for each)."""
        at = np.flatnonzero(owners[self.owner] & (self.ordinal == number) & ~self.closes & ~self.name)
        at = at[(self.kind[self.opener[self.owner[at]]] == b"["[0]) & (at + 1 < self.pos.size)]
        return np.array([k for k in at if self.b[self.pos[k] + 1 : self.pos[k + 1]].tobytes().strip()], np.int64)

    def inner(self, at: np.ndarray) -> np.ndarray:
        """A flag for each container: whether it is the value of one of these entries (with one after them)."""
        out = np.zeros(self.owner[-1] + 1, bool)
        at = at[at + 1 < self.pos.size]
        low = (self.level[at] + 1) * (self.b.size + 1)
        found = np.searchsorted(self.key, low + self.pos[at])
        ok = found < self.pos.size
        found, at = found[ok], at[ok]
        ok = self.opens[found] & (self.level[found] == self.level[at] + 1) & (self.pos[found] < self.pos[at + 1])
        out[self.owner[found[ok]]] = True
        return out


def _json(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of these rows, none of which is broken, that are JSON."""

    def loads(part: np.ndarray) -> bool:
        try:
            json.loads("[" + b",".join([b[x:y].tobytes() for x, y in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]).decode() + "]")
        except ValueError:
            return False
        except RecursionError:
            # too deep to be looked at: what is named goes all the same
            return len(part) == 1
        return True

    # brackets and quotes are balanced in each and no comma is outside, so all together are JSON if each is
    return rows if loads(rows) else rows[[loads(rows[k : k + 1]) for k in range(len(rows))]]


def _scan(held: pa.Array, keys: list[str], paths: list[list[str]]) -> pa.Array:
    """A chunk's texts without these."""
    starts, ends = _bounds(held)
    base = starts[0]
    b = np.frombuffer(held.buffers()[2], np.uint8)[base : ends[-1]]
    starts, ends = starts - base, ends - base
    m = _Members(b, starts, ends)
    if not m.pos.size:
        return held
    gone, items = m.named(keys) if keys else np.zeros(m.pos.size, bool), []
    for path in paths:
        own = np.zeros(m.owner[-1] + 1, bool)
        own[m.owner[m.opens & (m.level == 1)]] = True
        for k, step in enumerate(path):
            members = (m.named([step]) if step else np.zeros(m.pos.size, bool)) & own[m.owner]
            numbered = m.items(own, int(step)) if step.isdecimal() else np.zeros(0, np.int64)
            if k == len(path) - 1:
                gone |= members
                items.append(numbered)
            else:
                own = m.inner(np.concatenate([np.flatnonzero(members), numbered]))
    at = np.flatnonzero(gone)
    at = at[(at > 0) & (at + 1 < m.pos.size)]
    # members that follow only such as go, too, take the comma after them along; others the one before
    before = np.arange(at.size) - np.searchsorted(at, m.opener[m.owner[at]])
    leads = m.ordinal[at] == before
    begin = np.where(leads, m.pos[at - 1] + 1, m.pos[at - 1])
    end = m.pos[at + 1] + (leads & (m.kind[at + 1] == _COMMA))
    nulls = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)
    row, begin, end = np.concatenate([m.row[at], m.row[nulls]]), np.concatenate([begin, m.pos[nulls] + 1]), np.concatenate([end, m.pos[nulls + 1]])
    null = np.arange(row.size) >= at.size
    changed = np.unique(row)
    changed = changed[~m.broken[changed]]
    if not changed.size:
        return held
    good = np.zeros(len(held), bool)
    good[_json(b, starts, ends, changed)] = True
    by = np.lexsort((-end, begin))
    by = by[good[row[by]]]
    # of cuts within one another the outer one counts
    by = by[begin[by] >= np.concatenate([[0], np.maximum.accumulate(end[by])])[: by.size]]
    text, parts, done = memoryview(b), [], 0
    for x, y, put in zip(begin[by].tolist(), end[by].tolist(), null[by].tolist(), strict=True):
        parts.append(text[done:x])
        if put:
            parts.append(b"null")
        done = y
    parts.append(text[done:])
    size = ends - starts + np.bincount(row[by], begin[by] - end[by] + 4 * null[by], len(held)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    new = pa.LargeStringArray.from_buffers(len(held), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))
    return pa.compute.if_else(held.is_valid(), new, pa.scalar(None, pa.large_string())) if held.null_count else new
