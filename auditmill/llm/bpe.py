"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merging a piece: its bytes are nodes of a linked list. Buckets by merge rank hold the list positions whose pair has that
rank, and a bitmap in two levels says which buckets have entries; find-first-set gives the least rank at once. Entries whose pair has
changed since are stale and skipped when they come up. A merge costs a constant number of steps whatever the piece's
length: a piece of megabytes is as cheap a byte as a short one.

Long pieces have a queue each. Short ones, of which a text has very many, share one, and numpy takes a step for many of them at once: the upper bitmap says
which word of ranks is the least with entries; of that word each piece with entries has a lower bitmap of its own, whose first set bit is the rank that
the piece merges next, at its leftmost place. Pieces never touch each other, so each sees just the order of merges that it would see alone.

Texts are cut by the vocabulary's pattern, and each distinct piece is merged once a task (until CACHE of them are kept). The vocabulary's tables stay with
the worker for its next task; pieces do not, as their memory would be missing in the stages that follow.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.shared import release_memory

#: Distinct pieces whose ids a task keeps. When there are more, it starts anew.
CACHE = 300_000
#: Texts of about so many characters are encoded together.
TOGETHER = 4_000_000
#: Bytes from which on a piece has a queue of its own.
LONG = 200
#: Ranks in one word of the bitmap.
_WORD = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Tokenizer:
    """encode() and decode() by ranks; pattern cuts a text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values(), default=0) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.names = [str(r) for r in range(self.size)]
        self.cut = regex.compile(pattern).findall
        #: Rank of a pair of ids (left * size + right), -1 for none; as pairs come up in long pieces.
        self.pairs: dict[int, int] = {}
        #: Words of a long piece's lower bitmap; all empty between pieces.
        self.words = [0] * (self.size // _WORD + 1)
        found = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        #: All pairs with a rank, sorted.
        self.keys, self.key_ranks = np.array(sorted(found), np.int64).reshape(-1, 2).T.copy()
        length = np.array([len(t or b"") for t in self.tokens], np.int64)
        self.token_start, self.token_length = np.cumsum(length) - length, length
        self.token_bytes = np.frombuffer(b"".join(t or b"" for t in self.tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.joined_pieces: list[str] = []

    def _pair(self, key: int) -> int:
        """The rank of a pair that has not come up yet."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        tokens = self.tokens
        r = self.pairs[key] = self.ranks.get(tokens[key // self.size] + tokens[key % self.size], -1)
        return r

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece: always the leftmost pair of the least rank merges next."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        size, known, find, words = self.size, self.pairs.get, self._pair, self.words
        n = len(piece)
        ids = list(map(self.bytes.__getitem__, piece))
        pair = [-1] * (n + 1)
        buckets: dict[int, list[int]] = {}
        top = 0
        last = ids[0]
        for i in range(n - 1):
            right = ids[i + 1]
            key = last * size + right
            last = right
            r = known(key)
            if r is None:
                r = find(key)
            if r >= 0:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            low = bits & -bits
            rank = (w << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = bits = bits ^ low
                if not bits:
                    top ^= 1 << w
            if pair[i] != rank:
                continue  # stale: a neighbour has merged since
            j = after[i]
            ids[i], ids[j] = rank, -1
            pair[i] = pair[j] = -1
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            for x, key in ((i, rank * size + ids[k] if k < n else -1), (h, ids[h] * size + rank if h >= 0 else -1)):
                if key < 0:
                    continue
                r = known(key)
                if r is None:
                    r = find(key)
                pair[x] = r
                if r < 0:
                    continue
                if r in buckets:
                    heappush(buckets[r], x)
                else:
                    buckets[r] = [x]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        return tuple([x for x in ids if x >= 0])

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], -1)

    def merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces (each under LONG bytes), end to end, and each piece's number of them."""
        size = self.size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        length = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(length) - length
        piece = np.repeat(np.arange(len(pieces)), length)
        # node n stands for none, before and after each piece
        ids = np.append(np.array(self.bytes, np.int64)[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[begin + length - 1], before[begin] = n, n
        pair = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self._rank(ids[inner] * size + ids[inner + 1])
        words: list[list[np.ndarray]] = [[] for _ in range(size // _WORD + 1)]
        top = 0

        def push(nodes: np.ndarray) -> int:
            """Into the buckets of their ranks' words; the words' bits."""
            word = pair[nodes] // _WORD
            order = np.argsort(word, kind="stable")
            word, nodes = word[order], nodes[order]
            cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])).tolist() if len(word) else []
            bits = 0
            for i, j in zip(cut, [*cut[1:], len(word)], strict=False):
                words[w := int(word[i])].append(nodes[i:j])
                bits |= 1 << w
            return bits

        top |= push(inner[pair[inner] >= 0])
        while top:
            w = (top & -top).bit_length() - 1
            top &= top - 1
            at = np.unique(np.concatenate(words[w]))
            words[w] = []
            # what is stale has another rank by now, or none
            at = at[pair[at] // _WORD == w]
            if not len(at):
                continue
            p, low = piece[at], pair[at] % _WORD
            first = np.concatenate([[True], p[1:] != p[:-1]])
            group = np.cumsum(first) - 1
            due = low == _first_bits(low, np.flatnonzero(first))[group]
            # nodes ascend, so the first one that is due is the leftmost
            due = np.flatnonzero(due)
            due = due[np.concatenate([[True], group[due[1:]] != group[due[:-1]]])]
            if len(due) < len(at):
                rest = np.ones(len(at), bool)
                rest[due] = False
                words[w].append(at[rest])
                top |= 1 << w
            at = at[due]
            rank = pair[at]
            right = after[at]
            ids[at], ids[right] = rank, -1
            pair[at] = pair[right] = -1
            beyond = after[right]
            after[at] = beyond
            before[beyond] = at
            has = beyond < n
            x, beyond = at[has], beyond[has]
            pair[x] = self._rank(rank[has] * size + ids[beyond])
            left = before[at]
            has = left < n
            y = left[has]
            pair[y] = self._rank(ids[y] * size + rank[has])
            changed = np.concatenate([x, y])
            top |= push(changed[pair[changed] >= 0])
        rest = ids[:n] >= 0
        return ids[:n][rest].astype(np.int32), np.bincount(piece[rest], minlength=len(pieces))

    def _learn(self, new: list[str]) -> None:
        """Merge pieces that are new to the cache."""
        raw = [p.encode() for p in new]
        known = [(self.ranks[p],) if p in self.ranks else self.merge(p) if len(p) >= LONG else None for p in raw]
        short = [k for k, x in enumerate(known) if x is None]
        length = np.array([0 if x is None else len(x) for x in known], np.int64)
        flat, count = self.merge_short([raw[k] for k in short]) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        length[short] = count
        start = np.cumsum(length) - length
        out = np.empty(length.sum(), np.int32)
        own = np.zeros(len(new), bool)
        own[short] = True
        inside = np.repeat(own, length)
        out[inside] = flat
        out[~inside] = [i for x in known if x is not None for i in x]
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, out])
        names, ids = self.names, out.tolist()
        self.joined_pieces += [",".join([names[i] for i in ids[a : a + n]]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]

    def _cut_up(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's pieces in the cache, which learns new ones."""
        if len(self.index) > CACHE:
            self._forget()
        index, out, new = self.index, [], []
        for text in texts:
            pieces = self.cut(text)
            own = list(map(index.get, pieces))
            if None in own:
                for k, x in enumerate(own):
                    if x is None:
                        x = index.get(pieces[k])
                        if x is None:
                            x = index[pieces[k]] = len(index)
                            new.append(pieces[k])
                        own[k] = x
            out.append(own)
        if new:
            self._learn(new)
        return out

    def _ids(self, pieces: list[int]) -> np.ndarray:
        p = np.array(pieces, np.int64)
        return _gather(self.flat, self.start[p], self.length[p])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(p) for p in self._cut_up(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.token_length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return _gather(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids as text, digest of what they decode to, of each text."""
        for pieces in self._cut_up(texts):
            ids = self._ids(pieces)
            yield len(ids), hashlib.sha256(",".join(map(self.joined_pieces.__getitem__, pieces)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(path), pattern)


@contextmanager
def task_tokenizer(path: str, pattern: str) -> Iterator[Tokenizer]:
    """The worker's tokenizer for a task, which leaves no pieces behind."""
    own = _vocabulary(path, pattern)
    try:
        yield own
    finally:
        own._forget()
        own.pairs.clear()
        release_memory()


def _first_bits(low: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first set bit of each group's bitmap of _WORD bits, which has a bit for each of the group's ranks (low)."""
    out = np.full(len(begins), -1)
    for k in range(_WORD // 64 - 1, -1, -1):
        bits = np.bitwise_or.reduceat(np.where(low >> 6 == k, np.uint64(1) << (low & 63).astype(np.uint64), np.uint64(0)), begins)
        one = bits & (~bits + np.uint64(1))
        out = np.where(bits > 0, 64 * k + np.log2(np.maximum(one, np.uint64(1)).astype(float)).astype(np.int64), out)
    return out


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each, end to end."""
    end = np.cumsum(length)
    return flat[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about TOGETHER characters; a longer text comes alone or last."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(d)
            texts.append(t)
            size += len(t)
            if size > TOGETHER:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))


def _lists(made: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, made)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made) if made else [], pa.int32()))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each row of docs (doc_id, text). A null text is empty; an empty one has no ids. Bytes that are no UTF-8 count as U+FFFD."""
    known, cut = default_tokenizer()
    path, pattern = path or known, pattern or cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_tokenizer(path, pattern) as own:
            for docs, texts in _together(batches):
                made = own.encode_all(texts)
                for i in range(0, len(docs), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 500], pa.int64()), _lists(made[i : i + 500])], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and bytes of each row of encoded (doc_id, ids). Null ids are none. An id that is not in the vocabulary is an error."""
    path = path or default_tokenizer()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_tokenizer(path, "") as own:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to).

    A null text is empty; bytes that are no UTF-8 count as U+FFFD. A text is encoded whole, however long. Repeated rows are encoded repeatedly (from the task's cache); other columns
    are not used. An empty table gives no rows."""
    known, cut = default_tokenizer()
    path, pattern = path or known, pattern or cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_tokenizer(path, pattern) as own:
            for docs, texts in _together(batches):
                made = list(own.digests(texts))
                kinds = [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens, text_sha256 of each row of docs: as encode(), with the digest of what the ids decode to."""
    known, cut = default_tokenizer()
    path, pattern = path or known, pattern or cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_tokenizer(path, pattern) as own:
            for docs, texts in _together(batches):
                for i in range(0, len(docs), 500):
                    made = own.encode_all(texts[i : i + 500])
                    digests = [hashlib.sha256(own.decode(x)).hexdigest() for x in made]
                    yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 500], pa.int64()), _lists(made), pa.array([len(x) for x in made], pa.int64()), pa.array(digests)], names=["doc_id", "ids", "n_tokens", "text_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, text_sha256 string")
