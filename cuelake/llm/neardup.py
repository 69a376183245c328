"""Near-duplicate texts by the similarity of their word shingles, for the corpus pipeline.

Two texts are near duplicates if the Jaccard similarity of their sets of SHINGLE words is SIMILAR or more. Candidates
come from two searches, and each is verified by both whole sets:

* SimHash links as in op2: most near copies and, by midpoints, large groups of them;
* rare shingles: a set of n shingles has at most n / 5 that a similar one lacks, so that of its n / 5 + 1 rarest shingles
  at least one is among as many rarest ones of the similar set. Rarity is the number of sets in the whole corpus, so that
  shingles of one set only fill most of these places, and a passage of many texts takes none. This finds every pair.

The same holds within a part of all hash values, as long as a set has more than n / 5 shingles in it. Sets of at least
256 shingles look at such a part (PARTS, by size; ten standard deviations wider than needed), which saves half of the rows.
Two sets are compared within the part of the smaller one's class of size. Where any set of the corpus has too few shingles in
its part, all sets are compared as a whole.

Most candidates are ruled out by parities: a set's hashes flip bits of a string about twice as long as the set, and two
strings never differ in more bits than the sets do in elements. Whole texts are brought together for the others only.

A key of more than HOT_KEY sets is first linked by stars, each around another set, and only the sets that are still in
different groups are then paired: no pair is left out, and a large group of copies stays linear. Stars are repeated while
they would leave more than ENOUGH pairs a set. What is left of a key is paired in squares of BLOCK by BLOCK sets, each of
which any task can do by itself, and a pair is ruled out by its parities before it becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm import simhash
from cuelake.llm.common import append_columns, blocks, components, dropped, fresh_name, text_bytes, written
from cuelake.llm.decontam import grams, word_hashes

#: The similarity is the fraction 4 / 5, so that comparisons are of whole numbers.
SHINGLE, SIMILAR = 5, (4, 5)
HOT_KEY, STARS, TURNS, ENOUGH, BLOCK = 32, 4, 2, 256, 512
#: Share of the hash values that sets of 2^k to 2^(k+1) shingles look at; all below the first k, the last one above.
PARTS = {8: 0.5, 9: 0.42, 10: 0.36, 11: 0.31, 12: 0.28, 13: 0.26}
#: Counts of sets from which on a shingle is as common as any.
COMMON = 1000
#: Lower-cased (A-Z), white space as a space: the words of op2.
PLAIN_BYTES = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's shingles; a shorter text is one shingle, one without words has none."""
    hashes, count = word_hashes(texts, PLAIN_BYTES)
    values = grams(hashes, SHINGLE)
    out = []
    for n, end in zip(count.tolist(), np.cumsum(count).tolist(), strict=True):
        start = end - n
        out.append(np.unique(values[start : end - SHINGLE + 1]) if n >= SHINGLE else grams(hashes[start:end], n) if n else values[:0])
    return out


def identity(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes())


def _long(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def bound(size: int) -> int:
    """The first hash value (of 2^64) beyond the part for a class of size."""
    k = min(size.bit_length() - 1, max(PARTS))
    return int(PARTS[k] * 2**64) if k in PARTS else 2**64


def needed(size: int) -> int:
    """So many of a set's rarest shingles hold one of those of each similar set."""
    return size - -(-size * SIMILAR[0] // SIMILAR[1]) + 1


def bounds(size: int, whole: bool = False) -> tuple[int, int]:
    """The bound of a set's own class, and that of the class below if a similar set may be in it, else 0. ``whole``: sets
    are compared as a whole."""
    if whole:
        return 2**64, 0
    below = 1 << max(0, size.bit_length() - 1)
    return bound(size), bound(below - 1) if below > 1 and size * SIMILAR[0] // SIMILAR[1] < below else 0


def within(found: np.ndarray, end: int) -> int:
    return len(found) if end >= 2**64 else int(np.searchsorted(found, np.uint64(end)))


def keys(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(key, id): the shingles of each set within the parts that it is compared in."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in blocks(batch):
                key, ids = [], []
                for found in shingles(part.column(0).to_pylist()):
                    own = identity(found)
                    if own in seen or not len(found):
                        continue
                    seen.add(own)
                    if len(seen) > 200_000:
                        seen.clear()
                    key.append(found[: within(found, max(bounds(len(found), whole)))])
                    ids.append(np.full(len(key[-1]), own, np.uint64))
                if key:
                    columns = [np.concatenate(key).view(np.int64), np.concatenate(ids).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "id"])

    return docs.select(text_bytes()).mapInArrow(run, "key long, id long")


SHARED = "id long, sets int, key long"


def shared_keys(batches):
    """From rows (key, id) sorted by both: those of keys that several sets have, with their number (COMMON at most).
    Holds one batch and at most COMMON rows besides."""

    def made(key, ids, sets):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sets.astype(np.int32)), pa.array(key)], names=["id", "sets", "key"])

    held = [np.zeros(0, np.int64)] * 2
    hot = last = None
    for batch in batches:
        now = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(2)]
        if not len(now[0]):
            continue
        new = np.r_[last != (now[0][0], now[1][0]), (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]
        last = (now[0][-1], now[1][-1])
        now = [x[new] for x in now]
        if hot is not None and len(now[0]):
            n = int(np.searchsorted(now[0], hot, "right"))
            if n:
                yield made(now[0][:n], now[1][:n], np.full(n, COMMON))
                now = [x[n:] for x in now]
        if not len(now[0]):
            continue
        hot = None
        key, ids = (np.concatenate(x) for x in zip(held, now, strict=True))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[start, len(key)])
        sets = np.repeat(many, many)
        cut = start[-1]
        several = np.flatnonzero(sets[:cut] > 1)
        if len(several):
            yield made(key[several], ids[several], np.minimum(sets[several], COMMON))
        held = [key[cut:], ids[cut:]]
        if len(held[0]) >= COMMON:
            yield made(*held, np.full(len(held[0]), COMMON))
            hot, held = held[0][0], [x[:0] for x in held]
    if len(held[0]) > 1:
        yield made(*held, np.full(len(held[0]), len(held[0])))


CHOSEN = "key long, id long, at long, root long"


def rarest(batches, whole: bool = False):
    """From rows (id, sets, key, size, own, below) sorted by id, sets and key, each set's sizes first (sets 0): the keys
    among its rarest shingles that another set has, too. Shingles of one set only come before them."""

    def chosen(rows):
        ids, _, key, size, own, below = rows
        if not len(ids):
            return
        start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(ids)], strict=True):
            n = int(size[a])
            if not n or b == a + 1:
                continue
            mine = key[a + 1 : b].view(np.uint64)
            first = needed(n)
            take, alone = np.zeros(len(mine), bool), None
            for end, many in zip(bounds(n, whole), (int(own[a]), int(below[a])), strict=True):
                at = np.flatnonzero(mine < np.uint64(end)) if end < 2**64 else np.arange(len(mine))
                take[at[: max(0, first - (many - len(at)))]] = True
                # a set that is compared within a part has all of its shingles there counted
                alone = many - len(at) if alone is None else alone
            if take.any():
                out.append((mine[take].view(np.int64), int(ids[a]), n << 32 | alone))
        if out:
            many = [len(k) for k, _, _ in out]
            name = np.repeat([i for _, i, _ in out], many)
            at = np.repeat([n for _, _, n in out], many)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in out])), pa.array(name), pa.array(at), pa.array(name)], names=["key", "id", "at", "root"])

    held = [np.zeros(0, np.int64)] * 6
    for batch in batches:
        now = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(6)]
        if not len(now[0]):
            continue
        now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        yield from chosen([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    yield from chosen(held)


def lacking(prints: DataFrame) -> DataFrame:
    """The rows of ``prints`` whose sets have too few shingles in a part that they are compared in."""
    first = F.expr(f"size - cast(ceil(size * {SIMILAR[0]} / {SIMILAR[1]}) as long) + 1")
    return prints.where((F.col("size") > 0) & ((F.col("own") < first) | ((F.col("below") > 0) & (F.col("below") < first))))


def rare_keys(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(key, id, at, root) of CHOSEN; at holds the set's size, and in its low 32 bits how many of its shingles no other set
    has (within its own class's bound). ``prints`` has id, size, own and below: a
    set's size and the numbers of its shingles within its bounds."""
    whole = not lacking(prints).isEmpty()
    if whole:
        prints = prints.withColumns({"own": F.col("size"), "below": F.lit(0).cast("long")})
    shared = keys(docs, whole).repartition("key").sortWithinPartitions("key", "id").mapInArrow(shared_keys, SHARED)
    zero = F.lit(0).cast("long")
    sizes = prints.select("id", F.lit(0).alias("sets"), zero.alias("key"), "size", "own", "below").distinct()
    both = sizes.unionByName(shared.select("id", "sets", "key", zero.alias("size"), zero.alias("own"), zero.alias("below")))
    return both.repartition("id").sortWithinPartitions("id", "sets", "key").mapInArrow(lambda batches: rarest(batches, whole), CHOSEN)


def enough(at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the shingles that other sets have, too, can make up the overlap that the similarity needs."""
    left = np.minimum((at >> 32) - (at & 0xFFFFFFFF), (other >> 32) - (other & 0xFFFFFFFF))
    return left * sum(SIMILAR) >= ((at >> 32) + (other >> 32)) * SIMILAR[0]


FOUND = "a long, b long, key long, at long, hot boolean"


def pairs_in(most: int):
    """From rows (key, id, at, root) sorted by key and id: pairs of sets of different roots under a key. Rows of a key
    of more than ``most`` sets come back as they are (hot); such a key is passed on as it comes, never held whole."""

    def made(a, b, key, at, hot):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, key, at, np.full(len(a), hot))], names=["a", "b", "key", "at", "hot"])

    def linked(key, ids, at, root):
        if not len(key):
            return
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        end, many = np.repeat(start + size, size), np.repeat(size, size)
        if (hot := many > most).any():
            yield made(ids[hot], ids[hot], key[hot], at[hot], True)
        place = np.arange(len(key))
        right = np.where(many > most, 0, end - place - 1)
        total = np.cumsum(right)
        cut = [0, *np.searchsorted(total, np.arange(1_000_000, total[-1], 1_000_000)).tolist(), len(key)]
        for x, y in zip(cut, cut[1:], strict=False):
            n = right[x:y]
            if not n.sum():
                continue
            i = np.repeat(place[x:y], n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            ok = (root[i] != root[j]) & enough(at[i], at[j])
            if ok.any():
                both = np.unique(np.stack([ids[i[ok]], ids[j[ok]]]), axis=1)
                yield made(both[0], both[1], both[0], both[0], False)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        hot = None  # the key that is passed on
        last = None
        for batch in batches:
            now = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(4)]
            if not len(now[0]):
                continue
            # repeated rows of a set (of equal texts in several tasks) follow one another
            new = np.r_[last != (now[0][0], now[1][0]), (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])]
            last = (now[0][-1], now[1][-1])
            now = [x[new] for x in now]
            if hot is not None and len(now[0]):
                n = int(np.searchsorted(now[0], hot, "right"))
                if n:
                    yield made(now[1][:n], now[1][:n], now[0][:n], now[2][:n], True)
                    now = [x[n:] for x in now]
            if not len(now[0]):
                continue
            hot = None
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            yield from linked(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
            if len(held[0]) > most:
                yield made(held[1], held[1], held[0], held[2], True)
                hot, held = held[0][0], [x[:0] for x in held]
        yield from linked(*held)

    return run


def _pairs(rows: DataFrame, most: int) -> DataFrame:
    rows = rows.select("key", "id", "at", "root").repartition("key").sortWithinPartitions("key", "id")
    return written(rows.mapInArrow(pairs_in(most), FOUND))


SQUARE = ["key", "x", "y"]


def squares(rows: DataFrame, parities: DataFrame, block: int) -> DataFrame:
    """(a, b): the sets of different roots under a key that their parities don't rule out. A key's sets are dealt into
    blocks of about ``block`` by hash; each pair of blocks is a square of its own, in whatever task it falls, and a task
    holds the rows of one square at a time."""
    rows = rows.select("key", "id", "at", "root").dropDuplicates(["key", "id"])
    many = written(rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    rows = rows.join(many, "key").join(parities.select("id", "parity"), "id")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = own.select("key", "id", "at", "root", "parity", "own", other)
    dealt = dealt.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "at", "root", "parity", "own")
    dealt = dealt.repartition(*SQUARE).sortWithinPartitions(*SQUARE, "own", "id")
    low, high = SIMILAR

    def paired(rows):
        x, y = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        ids, at, root, own = (rows.column(k).to_numpy() for k in (3, 4, 5, 7))
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (rows.column(0).to_numpy()[1:] != rows.column(0).to_numpy()[:-1])])
        out = [[], []]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(x)], strict=True):
            left = np.arange(a, b)[own[a:b] == x[a]]
            right = left if x[a] == y[a] else np.arange(a, b)[own[a:b] == y[a]]
            parity = {}
            for i in left.tolist():
                ok = (root[right] != root[i]) & enough(at[right], at[i])
                if x[a] == y[a]:
                    ok &= right > i
                for j in right[ok].tolist():
                    for k in (i, j):
                        if k not in parity:
                            parity[k] = rows.column(6)[k].as_py()
                    if apart(parity[i], parity[j]) * (low + high) <= ((at[i] >> 32) + (at[j] >> 32)) * (high - low):
                        out[0].append(ids[i])
                        out[1].append(ids[j])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None or not held.num_rows else pa.concat_batches([held, pa.RecordBatch.from_arrays(batch.columns, schema=held.schema)])
            if not held.num_rows:
                continue
            last = held.num_rows - 1
            same = np.ones(held.num_rows, bool)
            for k in range(3):
                column = held.column(k).to_numpy()
                same &= column == column[last]
            cut = int(np.flatnonzero(same)[0])
            if cut:
                yield paired(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield paired(held)

    found = written(dealt.select(*SQUARE, "id", "at", "root", "parity", "own").mapInArrow(run, "a long, b long"))
    dropped(many)
    return found


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): each set of a key with STARS others, picked by hash, of another root. A key of one root has none."""
    picks = [F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(turn * STARS + k))) for k in range(STARS)]
    chosen = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.array_distinct(F.array(*picks)).alias("z"))
    both = rows.join(chosen.where("x <> y").select("key", "z"), "key").select("id", "root", F.explode("z").alias("z"))
    return both.where("root <> z.root").select(F.col("z.id").alias("a"), F.col("id").alias("b")).distinct()


def parity(found: np.ndarray) -> bytes:
    """A bit string, as long as the next power of two from twice the set's size on; each element flips the bit that its
    hash names."""
    size = max(64, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ, the longer one folded to the length of the other: the sets differ in no
    fewer elements."""
    if len(x) < len(y):
        x, y = y, x
    a, b, size = int.from_bytes(x, "little"), int.from_bytes(y, "little"), len(x)
    while size > len(y):
        size //= 2
        a = (a >> 8 * size) ^ (a & (1 << 8 * size) - 1)
    return (a ^ b).bit_count()


def signed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text, size, parity) of each set of ``nodes`` (id)."""

    def handle(block):
        sets = [shingles([x])[0] for x in block]
        return {"id": _long([identity(x) for x in sets]), "size": [len(x) for x in sets], "parity": [parity(x) for x in sets]}

    signed = append_columns(docs.select(text_bytes()), lambda: handle, "id long, size long, parity binary")
    return written(signed.join(nodes, "id", "left_semi").dropDuplicates(["id"]).select("id", "text", "size", "parity"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the whole sets are similar enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    side = lambda name, *columns: texts.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])
    small = pairs.join(side("a", "size", "parity"), "a").join(side("b", "size", "parity"), "b")
    low, high = SIMILAR

    def may_be(batches):
        for batch in batches:
            for part in blocks(batch):
                size = part.column("a_size").to_numpy() + part.column("b_size").to_numpy()
                odd = [apart(x, y) for x, y in zip(part.column("a_parity").to_pylist(), part.column("b_parity").to_pylist(), strict=True)]
                ok = np.array(odd, np.int64) * (low + high) <= size * (high - low)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    left = written(small.mapInArrow(may_be, "a long, b long"))

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                sets = [shingles(part.column(k).to_pylist()) for k in (2, 3)]
                ok = []
                for x, y in zip(*sets, strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(shared * (low + high) >= (len(x) + len(y)) * low)
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = left.join(side("a", "text"), "a").join(side("b", "text"), "b")
    found = written(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long"))
    dropped(left)
    return found


def groups(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, root): the components of all pairs of sets (id) that are similar enough; sets without any are left out.
    ``prints`` has the id, fingerprint (fp) and sizes of each row of ``docs``. Tables on the way are deleted."""
    made: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(df)
        return df

    found = kept(_pairs(rare_keys(docs, prints), HOT_KEY))
    hot = found.where("hot").select("key", F.col("a").alias("id"), "at")
    named = kept(written(prints.select("fp", "id").distinct()))
    low = kept(written(named.groupBy("fp").agg(F.min("id").alias("low"))))
    near = simhash.links(low.select("fp"))
    side = lambda name: low.select(F.col("fp").alias(name), F.col("low").alias(f"{name}_id"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    pairs = pairs.union(named.join(low, "fp").select("low", "id")).union(found.where("not hot").select("a", "b"))
    pairs = pairs.union(stars(hot.withColumn("root", F.col("id")), 0)).where("a <> b")
    pairs = kept(written(pairs.distinct()))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(hot.select("id")).distinct()
    texts = kept(signed_texts(docs, nodes))
    edges = kept(verified(pairs, texts))
    tree = components(edges)
    for turn in range(1, TURNS + 1):
        rows = hot.join(tree, hot.id == tree.node, "left").select("key", "id", "at", F.coalesce("root", "id").alias("root"))
        rows = kept(written(rows))
        by_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
        left = by_root.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"), F.sum("n").alias("n")).where("twice > 0")
        ahead, many = left.agg(F.sum("twice") / 2, F.sum("n")).first()
        if not many:
            break
        last = ahead <= ENOUGH * many or turn == TURNS
        new = kept(squares(rows.join(left.select("key"), "key", "left_semi"), texts, BLOCK)) if last else stars(rows, turn)
        # what is linked already counts once for each set, not once for each link
        linked = tree.select(F.col("node").alias("a"), F.col("root").alias("b"))
        made.append(tree)
        tree = components(linked.union(kept(verified(new, texts))))
        if last:
            break
    dropped(*made)
    return tree


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id (nulls last), of rows with
    that id the one with the smallest hash of all columns; rows that agree in everything count once. Texts without
    words are one group."""
    names, mark = docs.columns, fresh_name(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64(*[F.col(f"`{c}`") for c in names]))

    def handle(block):
        sets = [shingles([x])[0] for x in block]
        ends = [bounds(len(x)) for x in sets]
        return {
            "fp": np.fromiter(map(simhash.fingerprint, block), np.uint64, len(block)).view(np.int64),
            "id": _long([identity(x) for x in sets]),
            "size": [len(x) for x in sets],
            "own": [within(x, end) for x, (end, _) in zip(sets, ends, strict=True)],
            "below": [within(x, end) if end else 0 for x, (_, end) in zip(sets, ends, strict=True)],
        }

    added = "fp long, id long, size long, own long, below long"
    prints = written(append_columns(marked.select("doc_id", F.col(mark).alias("mark"), text_bytes()), lambda: handle, added).drop("text"))
    tree = groups(docs, prints)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = prints.join(tree, prints.id == tree.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(order).alias("x"))
    kept = written(first.select(F.col("x.doc_id").alias(fresh_name(marked, "kept_id")), F.col("x.mark").alias(fresh_name(marked, "kept_mark"))))
    dropped(prints, tree)
    rows = marked.join(kept, (F.col(mark) == F.col(kept.columns[1])) & F.col("doc_id").eqNullSafe(F.col(kept.columns[0])))
    return rows.dropDuplicates([mark, "doc_id"]).select(*[F.col(f"`{c}`") for c in names])
