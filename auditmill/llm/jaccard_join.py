"""N-gram Jaccard join by set-relation skipping.

1. Texts become sets of hashed word shingles (bytehash.shingles). Equal sets, by 128 bits of a digest, are one set from here on: one row of each is
   elected to stand for it, and sets are numbered, so that no two share a number.
2. Document frequencies of all shingles: each task sends the sets of the rows it scans in blocks of thousands, cut up by parts of the hash space,
   so a shuffle row holds thousands of hashes. Shingles of one set alone cannot link it to anything; the others go back to their block.
3. In the order (document frequency, hash), two sets over the threshold share one of their first
   n - ceil(t * n) + 1 shingles. Sets whose rare shingles fill that prefix have no partner. The rest are `active`.
4. Index lists: one per prefix shingle, with the sets that have it, their sizes, and its position in each.
   First, every set is tried against the list's leader (the set with the fewest shingles of its own), one pair a set. Lists
   whose sets are all linked by then are skipped whole: what holds for the leader holds for them.
5. In the other lists, entries lie in blocks of equal set size, sorted by position. A set skips blocks outside its size
   range, and in a block all entries from the position on at which too few shingles are left. Pairs of linked sets are skipped.
6. For each pair that is left, both leaders' answer is computed once. Jaccard distance is a metric, so the pair's
   answer follows from it wherever the leaders are farther apart than threshold and both sets' distances to their
   leaders together. All others are verified by counting their common shingles.

Steps 4 to 6 lose no pair: their bounds hold for any two sets. Shingles have 64-bit hashes from a seed drawn for each run. Shingles that collide in
different documents are of no account unless they meet in one pair that is held together: at a thousand shingles a document, that is one pair in 10**13,
and it then has one common shingle too many.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditmill.llm import bytehash, sidefiles
from auditmill.llm.components import components
from auditmill.llm.shared import frugal, frugal_group, parts_of, written

U64, I64 = np.uint64, np.int64
#: Share of two sets that must agree.
SIMILARITY = Fraction(8, 10)
WORDS = 5


def _least(n: np.ndarray, t: Fraction) -> np.ndarray:
    """Fewest shingles that a set of n shares with a partner: ceil(t * n)."""
    return -(-n * t.numerator // t.denominator)


def sets(placed: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, text_key, src, pos, n_bytes, n_shingles, set_id) for each row; set_id is null where there are no shingles. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in bytehash.blocks(batches, "text"):
            h, at = bytehash.shingles(data, offsets, words, seed)
            own = [xxhash.xxh3_128_digest(h[i:j].tobytes()) if j > i else None for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(offsets)), pa.array(np.diff(at)), pa.array(own, pa.binary())], names=["doc_id", "text_key", "src", "pos", "n_bytes", "n_shingles", "set_id"])

    return placed.select("doc_id", text_key().alias("text_key"), "src", "pos", "text").mapInArrow(frugal(run), "doc_id long, text_key binary, src long, pos long, n_bytes long, n_shingles long, set_id binary")


def text_key() -> Column:
    """SHA-256 of the text (null: none), which tells rows with the same doc_id (or none) apart."""
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        yield int(part[order[i]]), order[i:j]


def _unpack(blobs: list[bytes], *kinds: type) -> tuple[np.ndarray, ...]:
    """The number of rows of each blob, and the columns of all."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    width, count = sum(np.dtype(k).itemsize for k in kinds), []
    for blob in blobs:
        at, n = 0, len(blob) // width
        count.append(n)
        for k, kind in enumerate(kinds):
            out[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return np.array(count, I64), *(np.concatenate(x) for x in out)


#: Shingles and sets from which on a block is full; up to 10,000 sets come at once, and a place in a block has 16 bits.
BLOCK_SHINGLES, BLOCK_SETS = 1_000_000, 50_000
_DEALT = "part int, whole boolean, block long, blob binary"


def _blocks_by_part(elected: str, words: int, seed: int, parts: int):
    """Blocks of elected rows' sets: their shingles by parts of the hash space (whole false), with the set's place in the block; and
    each block's numbers and sizes of sets (whole true, part any). A block is named by its first set's number."""

    def flush(held: list) -> pa.RecordBatch:
        number, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
        place = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        part = ((h >> U64(32)) % U64(parts)).astype(np.int32)
        rows = [(p, False, h[o].tobytes() + place[o].tobytes()) for p, o in _by_part(part, parts)]
        rows.append((int(number[0]) % parts, True, number.tobytes() + n.astype(I64).tobytes()))
        part, whole, blob = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(whole), pa.array([int(number[0])] * len(rows), pa.int64()), pa.array(blob, pa.binary())], names=["part", "whole", "block", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = sidefiles.Facts(elected, _numbered)
        held, size, count = [], 0, 0
        for batch in batches:
            src, pos = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j in sidefiles.runs(src):
                at, number = facts.of(int(src[i]))
                k = np.minimum(np.searchsorted(at, pos[i:j]), max(len(at) - 1, 0))
                own = np.flatnonzero(at[k] == pos[i:j]) if len(at) else np.zeros(0, I64)
                for own in np.array_split(own, len(own) // 10_000 + 1):
                    done = 0
                    for part, data, offsets in bytehash.blocks(iter([batch.slice(i, j - i).take(pa.array(own))]), "text"):
                        h, edges = bytehash.shingles(data, offsets, words, seed)
                        held.append((number[k[own[done : done + part.num_rows]]], np.diff(edges), h))
                        done, size, count = done + part.num_rows, size + len(h), count + part.num_rows
                        if size >= BLOCK_SHINGLES or count >= BLOCK_SETS:
                            yield flush(held)
                            held, size, count = [], 0, 0
        if held:
            yield flush(held)

    return run


def _numbered(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of elected rows, ascending, and the numbers of their sets."""
    x = np.frombuffer(blob, I64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0])]
    return x[:, 0], x[:, 1]


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one part of the hash space: its shingles that several sets have, by the sets' blocks. What blocks say of themselves passes through."""
    whole = pdf["whole"].to_numpy(bool)
    rows = [(b, True, x) for b, x in zip(pdf["block"][whole], pdf["blob"][whole], strict=True)]
    if not whole.all():
        block = pdf["block"].to_numpy()[~whole]
        count, h, place = _unpack(list(pdf["blob"][~whole]), U64, np.uint16)
        order = np.argsort(h, kind="stable")
        key = h[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        df = np.repeat(c := np.diff(np.concatenate([first, [len(h)]])), c)
        several = df > 1
        order, df = order[several], df[several].astype(np.int32)
        # back into the order of rows, which is that of blobs
        again = np.argsort(order, kind="stable")
        order, df = order[again], df[again]
        cut = np.searchsorted(order, np.concatenate([[0], np.cumsum(count)]))
        for b, i, j in zip(block.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if j > i:
                own = order[i:j]
                rows.append((b, False, h[own].tobytes() + df[i:j].tobytes() + place[own].tobytes()))
    return pd.DataFrame(rows, columns=["block", "whole", "blob"])


ACTIVE = "set_id long, n int, own int, shared binary, prefix array<long>"


def _active(t: Fraction):
    """Of one block: its sets whose prefix holds shingles of other sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["whole"].to_numpy(bool)
        (own_blob,) = pdf["blob"][whole]
        number, sizes = np.frombuffer(own_blob, I64).reshape(2, -1)
        rows = []
        if not whole.all():
            _, h, df, place = _unpack(list(pdf["blob"][~whole]), U64, np.int32, np.uint16)
            order = np.lexsort((h, df, place))
            h, place = h[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            count = np.diff(np.concatenate([first, [len(place)]]))
            n = sizes[place[first]]
            need = _least(n, t)
            for k in np.flatnonzero(count >= need).tolist():
                at, size = first[k], int(n[k])
                own = size - int(count[k])
                tokens = h[at : at + count[k]]
                rows.append((int(number[place[at]]), size, own, np.sort(tokens).tobytes(), tokens[: size - int(need[k]) + 1 - own].view(I64).tolist()))
        return pd.DataFrame(rows, columns=["set_id", "n", "own", "shared", "prefix"])

    return run


def elect(mine: DataFrame) -> DataFrame:
    """set_id, least (doc_id), n_bytes (of a text), src and pos of the row that stands for the set, and the set's number."""
    rows = mine.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("src", "pos")).alias("at"), F.min("doc_id").alias("least"), F.max("n_bytes").alias("n_bytes"))
    return written(rows.select("set_id", "least", "n_bytes", "at.src", "at.pos", F.monotonically_increasing_id().alias("number")), "elected")


def active_sets(placed: DataFrame, mine: DataFrame, elected: DataFrame, words: int, seed: int, t: Fraction = SIMILARITY) -> DataFrame:
    """The sets that can have a partner, each with its size, its number of shingles that no other set has, the others, and its index prefix."""
    parts = parts_of(placed.sparkSession, elected.agg(F.sum("n_bytes")).first()[0] or 0)
    facts = sidefiles.save(sidefiles.packed(elected.select("src", "pos", "number")), "elected", mine.select("src").distinct())
    dealt = placed.select("src", "pos", "text").mapInArrow(frugal(_blocks_by_part(facts, words, seed, parts)), _DEALT)
    back = dealt.repartitionById(parts, "part").groupBy("part").applyInPandas(frugal_group(_shared), "block long, whole boolean, blob binary")
    return written(back.groupBy("block").applyInPandas(frugal_group(_active(t)), ACTIVE), "active")


def _verified(pairs: DataFrame, active: DataFrame, t: Fraction) -> DataFrame:
    """(a, b, common, joint, linked) for pairs (a, b) of sets, by their shingles."""
    own = active.select("set_id", "n", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = np.zeros(batch.num_rows, I64)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                common[k] = (y[np.minimum(at, len(y) - 1)] == x).sum()
            joint = np.asarray(batch.column(2)).astype(I64) + np.asarray(batch.column(3)) - common
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(joint), pa.array(common * t.denominator >= joint * t.numerator)], names=["a", "b", "common", "joint", "linked"])

    x = own.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    y = own.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    found = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(frugal(run), "a long, b long, common long, joint long, linked boolean")
    return written(found, "verified")


#: Pairs of a list that a task holds before it hands them on; those of one entry come at once.
HELD_PAIRS = 50_000


def _list_pairs(t: Fraction):
    """Pairs of index lists (rows sorted by token, n, pos) that sizes and positions allow and that aren't linked yet."""

    def pairs(n: np.ndarray, pos: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        ends = np.concatenate([first[1:], [len(n)]])
        size = n[first]
        left, right, held = [], [], 0
        for i in range(len(n)):
            least = -(-int(n[i]) * t.numerator // t.denominator)
            for b in range(int(np.searchsorted(size, least)), int(np.searchsorted(size, n[i], side="right"))):
                # ceil(t * (n + m) / (1 + t)) shingles are common to sets of sizes n and m over the threshold
                overlap = -(-t.numerator * int(n[i] + size[b]) // (t.numerator + t.denominator))
                if n[i] - pos[i] < overlap:
                    continue
                lo, hi = first[b], min(int(ends[b]), i)
                hi = lo + int(np.searchsorted(pos[lo:hi], size[b] - overlap, side="right")) if hi > lo else lo
                y = np.flatnonzero(comp[lo:hi] != comp[i]) + lo
                if len(y):
                    left.append(np.full(len(y), i))
                    right.append(y)
                    held += len(y)
            if held >= HELD_PAIRS or (left and i == len(n) - 1):
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
            token, sid, n, pos, comp = (np.asarray(table.column(k)) for k in range(5))
            cut = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                for x, y in pairs(n[i:j].astype(I64), pos[i:j].astype(I64), comp[i:j]):
                    x, y = sid[i:j][x], sid[i:j][y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            token = np.asarray(batch.column(0))
            cut = int(np.searchsorted(token, token[-1]))
            if cut or (held and held[-1].column(0)[-1].as_py() != token[-1]):
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from made(pa.Table.from_batches(held))

    return run


def link_paths(active: DataFrame, t: Fraction = SIMILARITY) -> DataFrame:
    """(a, b): links between active sets, each verified; not all of them, but a path between any two sets that links connect. With the sets of documents that is
    membership and links of representatives."""
    posts = written(active.select("set_id", "n", (F.col("own").cast("long") * 1_000_000 / F.col("n")).cast("int").alias("own"), F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos") + 0), "postings")
    ends = active.select("set_id", F.col("own").alias("skipped"))
    lead = posts.groupBy("token").agg(F.min(F.struct("own", "set_id", "n")).alias("lead"), F.count("*").alias("f")).where("f > 1")
    near = posts.join(lead, "token").where((F.col("lead.set_id") != F.col("set_id")) & (F.least("n", "lead.n") * t.denominator >= F.greatest("n", "lead.n") * t.numerator))
    tried = near.groupBy("set_id").agg(F.min("lead").alias("lead")).select(F.col("set_id").alias("a"), F.col("lead.set_id").alias("b"))
    star = _verified(tried, active, t)
    group = written(components(star.where("linked")), "group")
    to = posts.join(group, F.col("set_id") == F.col("node"), "left").join(ends, "set_id").select("token", "set_id", "n", (F.col("pos") + F.col("skipped")).cast("int").alias("pos"), F.coalesce("component", "set_id").alias("comp"))
    to = written(to, "lists")
    mixed = to.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    pairs = to.join(mixed, "token", "left_semi").repartition("token").sortWithinPartitions("token", "n", "pos", "set_id").mapInArrow(frugal(_list_pairs(t)), "a long, b long").distinct()
    pairs = written(pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
    # a set's leader is the one it was found linked to, at a known distance; any other set leads itself
    led = star.where("linked").select(F.col("a").alias("id"), F.col("b").alias("lead"), (1 - F.col("common") / F.col("joint")).alias("far"))
    for x in "ab":
        own = led.select(F.col("id").alias(x), F.col("lead").alias(f"lead_{x}"), F.col("far").alias(f"far_{x}"))
        pairs = pairs.join(own, x, "left").withColumns({f"lead_{x}": F.coalesce(f"lead_{x}", x), f"far_{x}": F.coalesce(f"far_{x}", F.lit(0.0))})
    pairs = written(pairs.select("*", F.least("lead_a", "lead_b").alias("la"), F.greatest("lead_a", "lead_b").alias("lb")), "pairs")
    known = _verified(pairs.where((F.col("la") != F.col("a")) | (F.col("lb") != F.col("b"))).select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), active, t)
    apart = known.select(F.col("a").alias("la"), F.col("b").alias("lb"), (1 - F.col("common") / F.col("joint")).alias("apart"))
    limit = float(1 - t) + 1e-9
    open_ = pairs.join(apart, ["la", "lb"], "left").where(F.coalesce(F.col("apart") - F.col("far_a") - F.col("far_b"), F.lit(0.0)) <= limit).select("a", "b").distinct()
    rest = _verified(open_, active, t)
    return star.select("a", "b", "linked").union(known.select("a", "b", "linked")).union(rest.select("a", "b", "linked")).where("linked").select("a", "b")


def _salted(column: str, n: int = 16) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _each_salt(n: int = 16) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _grouped(placed: DataFrame, words: int, t: Fraction) -> DataFrame:
    """doc_id, text_key, src, pos, n_shingles, component_id for each row."""
    seed = secrets.randbits(62)
    mine = written(sets(placed, words, seed), "sets")
    elected = elect(mine)
    found = written(components(link_paths(active_sets(placed, mine, elected, words, seed, t), t)), "components")
    # a component of thousands of sets, and a set of thousands of copies, are dealt over several tasks: the small side is repeated for each. Its
    # files compress so well that they would pass for a table small enough to broadcast
    linked = written(elected.select("set_id", "least", F.col("number").alias("node")).join(found, "node").select("set_id", "least", "component"), "linked")
    name = linked.groupBy("component").agg(F.min("least").alias("component_id")).select("component", "component_id", _each_salt().alias("salt")).hint("merge")
    named = linked.withColumn("salt", _salted("set_id")).join(name, ["component", "salt"]).select("set_id", "component_id")
    alone = elected.join(linked.select("set_id"), "set_id", "left_anti").select("set_id", F.col("least").alias("component_id"))
    by_set = written(named.unionByName(alone), "named").select("set_id", "component_id", _each_salt().alias("salt")).hint("merge")
    out = mine.withColumn("salt", _salted("pos")).join(by_set, ["set_id", "salt"], "left")
    return out.select("doc_id", "text_key", "src", "pos", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _placed(docs: DataFrame, *columns: Column) -> DataFrame:
    """doc_id, text and the columns of docs, with each row's place."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *columns)
    return sidefiles.with_source(rows, *rows.columns)


def jaccard_components(docs: DataFrame, words: int = WORDS, t: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; other columns are not used).

    Two documents link when their sets of distinct word shingles have a Jaccard similarity of t at least; component_id is
    the smallest doc_id that links lead to. A null or empty text, or one of white space, has no shingles and no links;
    one of fewer words has one shingle. Rows with a null doc_id take part in links, but give a component no name; if all
    of a component's rows have none, its name is null. Repeated rows are returned repeatedly. An empty table gives no rows."""
    return _grouped(_placed(docs), words, t).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, t: Fraction = SIMILARITY) -> DataFrame:
    """The rows of docs, of each component that with the smallest doc_id alone; all columns.

    Rows linked with nothing stay. Repeated rows (same doc_id and text) are one. Rows without a doc_id stay unless they are linked with one
    that has; doc_ids are taken to name one document each: of texts that share a component's smallest doc_id, all stay."""
    placed = _placed(docs, F.struct("*").alias("_row"))
    keepers = _grouped(placed, words, t).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_key").agg(F.min(F.struct("src", "pos")).alias("at"))
    # no text is shuffled: each slice's file says which of its rows stay
    facts = sidefiles.save(sidefiles.packed(keepers.select("at.src", "at.pos")), "keepers", placed.select("src").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = sidefiles.Facts(facts, lambda blob: np.sort(np.frombuffer(blob, I64)))
        for batch in batches:
            src, pos = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, j in sidefiles.runs(src):
                own = batch.slice(i, j - i).filter(pa.array(np.isin(pos[i:j], stay.of(int(src[i])))))
                yield pa.RecordBatch.from_arrays(own.columns[2:], names=["_row"])

    rows = placed.select("src", "pos", "_row")
    return rows.mapInArrow(frugal(run), StructType(rows.schema.fields[2:])).select("_row.*")
