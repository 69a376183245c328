"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is read as three segments of 22, 21 and 21 bits, each padded with zeros to a word of the
perfect binary Golay code of length 23. A word decodes to the codeword within 3 bits of it; the *near* codewords
are those within 4 bits: one, or six. Then

* words 1 bit apart: the codeword that one decodes to is near the other;
* words at most 2 bits apart share a near codeword.

Two fingerprints at most 4 bits apart have segment errors e1 <= e2 <= e3 with a sum of 4 at most, so by pigeonhole
either e1 = 0 and e2 <= 2 (an exact segment and a shared near codeword in another one), or e1 = e2 = 1 (in two
segments, the decoded codeword of one fingerprint is near the other). These two kinds of keys find every pair.

Distinct fingerprints only are keyed, so exact copies cost nothing. A key that very many distinct fingerprints
share (a large group of near copies) would give all their pairs; such fingerprints are dealt with by midpoints:
two words at most 4 bits apart have a common word at most 2 bits from both, and conversely, so linking every
fingerprint to the smallest one at each of its midpoints gives the same components in linear work.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns, components, text_bytes, written

SHINGLE, DISTANCE = 4, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Above this number of rows, a key is linked by midpoints.
HOT_KEY = 2048


def fingerprint(text: bytes) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles; no words: 0."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: 1 - SHINGLE].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(start, end[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 100_000):
        bits = np.unpackbits(hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """All columns but the text, and the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda block: {name: np.fromiter(map(fingerprint, block), np.uint64, len(block)).view(np.int64)}

    return append_columns(docs, make, f"{name} long").drop("text")


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: the decoded codeword's index; by its error pattern's remainder: all errors of up to
    4 bits with that remainder (1 or 6 a remainder, padded by repeating the first)."""
    words = np.arange(1 << 12, dtype=np.int64)
    remainder = words << 11
    for bit in range(22, 10, -1):
        remainder = np.where(remainder >> bit & 1, remainder ^ (GENERATOR << (bit - 11)), remainder)
    table = np.zeros(1 << 11, np.int64)  # of the low 11 bits: themselves
    table[:] = np.arange(1 << 11)
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    bits = [1 << k for k in range(23)]
    sums = [int(remainder[x >> 11]) ^ (x & 2047) for x in bits]
    layer = [(0, 0, 0)]
    for _ in range(5):
        for error, r, _ in layer:
            errors[r].append(error)
        layer = [(e | bits[k], r ^ sums[k], k + 1) for e, r, first in layer for k in range(first, 23)]
    leader = np.array([x[0] for x in errors], np.int64)
    near = np.array([x + [x[0]] * (6 - len(x)) for x in errors], np.int64)
    return np.stack([remainder, remainder]), np.concatenate([leader[:, None], near], axis=1)


def codewords(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index (12 bits) of the decoded codeword, and six near ones, repeats included."""
    remainder, errors = golay()
    syndrome = remainder[0][segment >> 11] ^ (segment & 2047)
    found = errors[syndrome]
    return (segment ^ found[:, 0]) >> 11, (segment[:, None] ^ found[:, 1:]) >> 11


def segments(fp: np.ndarray) -> list[np.ndarray]:
    x = fp.view(np.uint64)
    return [(x >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]


#: role of a key's row: 0 both sides, 1 decoded codewords, 2 near codewords.
KEYS = "key long, role int, fp long"


def keys(fps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fp = np.asarray(batch.column(0)[at : at + 4096].to_numpy(zero_copy_only=False), np.int64)
                part = segments(fp)
                own, near = zip(*map(codewords, part), strict=True)
                out = []
                for i in range(3):
                    for j in range(3):
                        if i != j:  # segment i exact, a near codeword of j
                            key = (part[i][:, None] << 12 | near[j]) << 4 | (3 * i + j)
                            out.append((key, 0))
                for n, (i, j) in enumerate(PAIRS):
                    out.append(((own[i] << 12 | own[j])[:, None] << 4 | (9 + n), 1))
                    both = near[i][:, :, None] << 12 | near[j][:, None, :]
                    out.append((both.reshape(len(fp), -1) << 4 | (9 + n), 2))
                key = np.concatenate([k for k, _ in out], axis=1)
                role = np.concatenate([np.full(k.shape[1], r, np.int32) for k, r in out])
                order = np.argsort(key * 4 + role, axis=1, kind="stable")
                key = np.take_along_axis(key, order, 1)
                role = role[order]
                new = np.ones(key.shape, bool)
                new[:, 1:] = (key[:, 1:] != key[:, :-1]) | (role[:, 1:] != role[:, :-1])
                row, col = np.nonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[row, col]), pa.array(role[row, col]), pa.array(fp[row])], names=["key", "role", "fp"]
                )

    return fps.select("fp").mapInArrow(run, KEYS)


FOUND = "a long, b long, hot boolean"


def pairs_or_hot(most: int = HOT_KEY):
    """From rows sorted by key and role: the linked pairs of each key, or (fp, fp, hot) for every row of a key of
    more than ``most`` rows. Holds one batch and at most ``most`` rows besides."""


    def hot(fp):
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp), pa.array(np.ones(len(fp), bool))], names=["a", "b", "hot"])

    def linked(key, role, fp):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        big = np.repeat(size > most, size)
        if big.any():
            yield hot(fp[big])
        end = np.repeat(start + size, size)
        near = np.repeat(start + np.add.reduceat(role != 2, start), size) if len(key) else start
        at = np.arange(len(key))
        low = np.where(role == 0, at + 1, near)
        many = np.where((role == 2) | big, 0, end - low)
        total = np.cumsum(many)
        cut = [0, *np.searchsorted(total, np.arange(1_000_000, total[-1] if len(total) else 0, 1_000_000)).tolist(), len(key)]
        for x, y in zip(cut, cut[1:], strict=False):
            n = many[x:y]
            if not n.sum():
                continue
            left = np.repeat(at[x:y], n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[x:y], n)
            a, b = fp[left], fp[right]
            ok = (a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE)
            if ok.any():
                both = np.unique(np.stack([np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])]), axis=1)
                no = pa.array(np.zeros(both.shape[1], bool))
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), no], names=["a", "b", "hot"])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        hot_key = None
        for batch in batches:
            now = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(3)]
            if hot_key is not None:
                n = int(np.searchsorted(now[0], hot_key, "right"))
                if n:
                    yield hot(now[2][:n])
                    now = [x[n:] for x in now]
            if not len(now[0]):
                continue
            hot_key = None
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            yield from linked(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
            if len(held[0]) > most:
                yield hot(held[2])
                hot_key, held = held[0][0], [x[:0] for x in held]
        yield from linked(*held)

    return run


def midpoints(fps: DataFrame) -> DataFrame:
    """(mid, fp): every word at most DISTANCE / 2 bits from each fingerprint."""
    one = [1 << k for k in range(64)]
    masks = np.array([0, *one, *(x | y for k, x in enumerate(one) for y in one[:k])], np.uint64).view(np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fp = np.asarray(batch.column(0)[at : at + 256].to_numpy(zero_copy_only=False), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((fp[:, None] ^ masks).ravel()), pa.array(np.repeat(fp, len(masks)))], names=["mid", "fp"]
                )

    return fps.mapInArrow(run, "mid long, fp long")


def links(fps: DataFrame, most: int = HOT_KEY) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all links of at most
    DISTANCE bits."""
    spread = keys(fps).repartition("key").sortWithinPartitions("key", "role")
    found = written(spread.mapInArrow(pairs_or_hot(most), FOUND))
    edges = found.where("not hot").select("a", "b").distinct()
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    mids = written(midpoints(hot))
    lowest = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").select("mid", "a")
    stars = mids.join(lowest, "mid").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return edges.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at most DISTANCE differing
    bits reach, itself included.

    Null and empty texts have fingerprint 0 and link as any other. A null doc_id is kept and never the smallest;
    component_id is null where all are. Repeated rows give repeated rows. Other columns are not read.
    """
    prints = written(with_fingerprint(docs.select(F.col("doc_id").cast("long"), text_bytes())))
    named = _groups(written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"))))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _groups(distinct: DataFrame) -> DataFrame:
    """(fp, root, component_id) for distinct fingerprints with the smallest doc_id of each (low)."""
    tree = components(links(distinct.select("fp")))
    member = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    group = member.groupBy("root").agg(F.min("low").alias("component_id"))
    return member.join(group, "root").select("fp", "root", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
