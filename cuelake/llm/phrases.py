"""Collocations: phrases that are frequent in a language, scored by how their parts occur.

Every run of words gets a Rabin-Karp fingerprint, a difference of prefix sums of a polynomial over the hashes of its words.
Three passes over the texts:

1. Words and pairs are counted by short fingerprints in a shuffle, and those that may be frequent mark a table of bits of
   fixed size.
2. Longer runs of marked pairs are counted and marked likewise: a phrase can't be more frequent than the pairs in it.
3. A task gathers the marked runs with their numbers and a pointer to their words, and reads the words once for each
   phrase that it has. Counts are then summed by the words themselves.

So read, a phrase is told by every task that has it: rows are phrases times tasks. Of a language of many words, only its
words are read so; longer phrases first have to show that they may be among the best. Their fingerprints are counted once more,
each with the number of occurrences that a score of SCORES needs at least, given lower bounds of the words' own counts,
and only those that have it are read (and the longer phrases around them, and the parts they are scored by). If fewer than
the asked number turn out to have that score, the next lower one is tried for that language, and at last all are read.

A bit that is set for nothing costs rows in the last pass, never results. Phrases of equal fingerprints come apart: within
a task words are numbered by their bytes, and runs of one fingerprint are compared by these numbers before they are counted
as one; between tasks the words decide. A task passes a phrase on about once, whatever its number, so that no key is hotter
than the number of tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, blocks, dropped, text_bytes, written
from cuelake.llm.decontam import _Powers, mixed
from cuelake.llm.wordspans import Words

LEAST, LONGEST, HALF, FIRST = 10, 3, 50, 2000
#: Bits of the table of pairs, bytes of text at once, fingerprints that a task gathers before it passes them on.
BITS, TEXT_BYTES, HELD = 1 << 27, 1_000_000, 450_000
CHUNK = 1 << 17
#: Slots of the table of lower bounds. Languages of fewer words are read whole. Scores that are tried for the others in turn.
SLOTS, FEW_WORDS, SCORES = 1 << 24, 1 << 20, (100_000, 1_000)
#: Lower-cased (A-Z); the marks that end a piece become line ends, tabs become spaces.
PIECE_BYTES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Runs:
    """Fingerprints of all runs of words of a block of texts."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.words = Words(texts, PIECE_BYTES)
        self.hashes = hashes = self.words.hashes()
        self.piece = np.cumsum(self.words.joined == 10)[self.words.start]
        codes = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(langs)}
        self.lang = np.array([codes[x] for x in langs], np.uint64)[self.words.owner]
        _Powers.to(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _Powers.up[: len(hashes)], out=self.total[1:])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint of the ``n`` words from each word on, and whether they are within a piece."""
        many = len(self.piece) - n + 1
        if many <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        sums = (self.total[n:] - self.total[:-n]) * _Powers.down[:many]
        return mixed(sums + self.lang[:many] + np.uint64(n)), self.piece[:many] == self.piece[n - 1 :]


class Numbers:
    """Numbers of words, equal for equal bytes only, within a task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: Words, hashes: np.ndarray, at=slice(None)) -> np.ndarray:
        """Of the words at ``at``."""
        start, end = words.start[at], words.end[at]
        distinct, first, which = np.unique(hashes[at], return_index=True, return_inverse=True)
        a, b = start[first], end[first]
        own = np.array([self.known.setdefault(words.data[x:y], len(self.known)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        out, size = own[which] if len(own) else np.zeros(0, np.int64), end - start
        same = size == (b - a)[which]
        for n in np.unique(size).tolist():
            some = np.flatnonzero(same & (size == n))
            for part in np.array_split(some, max(1, len(some) * n // TEXT_BYTES)):
                steps = np.arange(n)
                same[part] = (words.joined[start[part][:, None] + steps] == words.joined[a[which[part]][:, None] + steps]).all(1)
        for k in np.flatnonzero(~same).tolist():  # another word of the same hash
            out[k] = self.known.setdefault(words.data[start[k] : end[k]], len(self.known))
        return out


def grouped(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal runs (rows of ``ids``, of equal keys) stand together, and where each group starts in it."""
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(key)]
    inner = ids[order]
    if not (inner == inner[np.flatnonzero(new)[np.cumsum(new) - 1]]).all():
        order = np.lexsort((*ids.T[::-1], key))
        inner = ids[order]
        new = np.r_[True, (key[order][1:] != key[order][:-1]) | (inner[1:] != inner[:-1]).any(1)]
    return order, np.flatnonzero(new)


def _texts(part: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    return part.column(0).to_pylist(), part.column(1).to_pylist()


def dealt(values: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and short form of fingerprints."""
    return (values & np.uint64(0xFFFFFFFF)) % np.uint64(ranges), values >> np.uint64(32)


def places(ranges: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Bit of the table of a fingerprint dealt so."""
    return (mixed(short << np.uint64(32) | ranges) & np.uint64(BITS - 1)).astype(np.int64)


COUNTED = "range int, lang string, found binary, many long"


def may_be(table: np.ndarray, values: np.ndarray, ranges: int) -> np.ndarray:
    spot = places(*dealt(values, ranges))
    return (table[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)


def of_pairs(ok: np.ndarray, pair: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words that are ``ok`` consist of pairs that are."""
    for k in range(n - 1):
        ok = ok & pair[k : k + len(ok)]
    return ok


def summed(key: np.ndarray, many: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of ``many`` and the minimum of ``least`` of each."""
    order = np.argsort(key, kind="stable")
    key, many, least = key[order], many[order], least[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return (key[new], np.add.reduceat(many, new, dtype=np.int64), np.minimum.reduceat(least, new)) if len(new) else (key, many.astype(np.int64), least)


def short_counts(docs: DataFrame, ranges: int, longest: int = 2, pairs=None) -> DataFrame:
    """COUNTED: for each range the short forms of words and pairs of a block with their counts (LEAST at most, as bytes
    behind them); and the number of words of each language under a range of its own. With the table of ``pairs``: those
    of runs of 3 to ``longest`` words, and no numbers of words."""
    arrow = arrow_schema(COUNTED)

    def run(batches):
        held, size, words = [], 0, {}

        def passed():
            key = np.concatenate([k for k, _ in held])
            many = np.concatenate([c for _, c in held])
            order = np.argsort(key, kind="stable")
            key, many = key[order], many[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            many = np.minimum(np.add.reduceat(many, new, dtype=np.int64), LEAST).astype(np.uint8) if len(new) else many.astype(np.uint8)
            key = key[new]
            own = (key >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if len(own) else []
            rows = []
            for a, b in zip(cut, [*cut[1:], len(own)], strict=False):
                rows.append((int(own[a]), None, (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + many[a:b].tobytes(), None))
            return rows

        for batch in batches:
            for part in blocks(batch, TEXT_BYTES):
                texts, langs = _texts(part)
                runs = Runs(texts, langs)
                for lang, n in zip(langs, runs.words.many.tolist(), strict=True):
                    words[lang] = words.get(lang, 0) + n
                if pairs:
                    values, ok = runs.of(2)
                    pair = ok & may_be(pairs.value, values, ranges)
                for n in range(3 if pairs else 1, longest + 1):
                    values, ok = runs.of(n)
                    ok = of_pairs(ok, pair, n) if pairs else ok
                    spot, short = dealt(values[ok], ranges)
                    key, many = np.unique(spot << np.uint64(32) | short, return_counts=True)
                    held.append((key, np.minimum(many, LEAST).astype(np.uint8)))
                    size += len(key)
                if size > 3 * HELD:
                    yield _rows(passed(), arrow)
                    held, size = [], 0
        if held:
            yield _rows(passed(), arrow)
        if pairs:
            return
        yield _rows([(ranges + xxhash.xxh32_intdigest(x.encode()) % ranges, x, None, n) for x, n in words.items()], arrow)

    return docs.mapInArrow(run, COUNTED)


def _rows(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)


MARKED = "chunk int, bits binary, lang string, many long"


def marks(counted: DataFrame, ranges: int, needs: bool = False) -> DataFrame:
    """MARKED of COUNTED: places within chunks of the table of what occurs LEAST times, and the words of languages. With
    ``needs``: of what occurs as often as it needs to (``needed``)."""
    arrow = arrow_schema(MARKED)

    def run(batches):
        now, blobs, found, words = None, [], [], {}

        def ended():
            width, kind = (8, np.uint16) if needs else (5, np.uint8)
            short = np.concatenate([np.frombuffer(x, np.uint32, len(x) // width) for x in blobs])
            many = np.concatenate([np.frombuffer(x, kind, len(x) // width, len(x) // width * 4) for x in blobs])
            least = np.concatenate([np.frombuffer(x, np.uint16, len(x) // width, len(x) // width * 6) for x in blobs]) if needs else np.full(len(short), LEAST)
            short, many, least = summed(short, many, least)
            often = short[many >= np.maximum(least, LEAST)].astype(np.uint64)
            return places(np.full(len(often), now, np.uint64), often)

        def passed():
            at = np.sort(np.concatenate(found))
            cut = np.searchsorted(at, np.arange(0, BITS + 1, CHUNK)).tolist()
            inner = (at % CHUNK).astype(np.uint32)
            return _rows([(k, inner[a:b].tobytes(), None, None) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b], arrow)

        for batch in batches:
            for part in blocks(batch):
                for key, lang, blob, many in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if blob is None:
                        words[lang] = words.get(lang, 0) + many
                        continue
                    if blobs and key != now:
                        found.append(ended())
                        blobs = []
                        if sum(map(len, found)) > HELD:
                            yield passed()
                            found = []
                    now = key
                    blobs.append(blob)
        if blobs:
            found.append(ended())
        if found:
            yield passed()
        yield _rows([(None, None, x, n) for x, n in words.items()], arrow)

    return counted.repartition("range").sortWithinPartitions("range").mapInArrow(run, MARKED)


def bit_table(marked: DataFrame) -> np.ndarray:
    """The table of bits, BITS / 8 bytes whatever the input: each chunk is put together by a task."""

    def run(batches):
        now, bits = None, None
        for batch in batches:
            for chunk, places_in in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["chunk", "bits"])
                    now, bits = chunk, np.zeros(CHUNK, bool)
                bits[np.frombuffer(places_in, np.uint32)] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["chunk", "bits"])

    table = np.zeros(BITS // 8, np.uint8)
    found = marked.where("chunk is not null").select("chunk", "bits").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary")
    for row in found.collect():
        table[row["chunk"] * CHUNK // 8 :][: CHUNK // 8] = np.frombuffer(row["bits"], np.uint8)
    return table


READ = "lang string, phrase string, words int, many long"


def marked_phrases(docs: DataFrame, tables: list, ranges: int, longest: int, sizes: tuple = (), wanted: tuple = ()) -> DataFrame:
    """READ: the runs that are marked in a task's texts, words and pairs in the first of ``tables``, longer ones of such
    pairs in the second. With ``sizes``: those of so many words. With tables ``wanted``: pairs that are marked in one of
    these too, and longer runs that are or that hold such a pair."""
    sizes = sizes or tuple(range(1, longest + 1))
    arrow = arrow_schema(READ)

    def run(batches):
        short, long = (x.value for x in tables)
        chosen = [x.value for x in wanted]
        held, size, numbers, langs = [], 0, Numbers(), []

        def merged():
            """What is held, equal runs as one."""
            key, lang, many, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order, start = grouped(key, ids)
            first = order[start]
            return key[first], lang[first], np.add.reduceat(many[order], start) if len(start) else many, ids[first]

        def passed():
            _, lang, many, ids = held[0]
            words = [x.decode("utf-8", "surrogateescape") for x in numbers.known]
            for a in range(0, len(lang), 200_000):
                rows = ids[a : a + 200_000]
                phrases = [" ".join([words[k] for k in x if k >= 0]) for x in rows.tolist()]
                columns = [pa.array([langs[k] for k in lang[a : a + 200_000].tolist()]), pa.array(phrases), pa.array((rows >= 0).sum(1), pa.int32()), pa.array(many[a : a + 200_000])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for part in blocks(batch, TEXT_BYTES):
                texts, names = _texts(part)
                runs = Runs(texts, names)
                langs += [x for x in dict.fromkeys(names) if x not in langs]
                lang = np.array([langs.index(x) for x in names], np.int32)[runs.words.owner]
                pair = near = None
                told = []
                for n in range(1 if 1 in sizes else 2, max(sizes) + 1):
                    values, ok = runs.of(n)
                    ok = of_pairs(ok, pair, n) if n > 2 else ok
                    at = np.flatnonzero(ok)
                    at = at[may_be(short if n <= 2 else long, values[at], ranges)]
                    if n == 2:
                        pair = np.zeros(len(ok), bool)
                        pair[at] = True
                    if chosen and n > 1:
                        own = np.any([may_be(x, values[at], ranges) for x in chosen], axis=0)
                        if n == 2:
                            near = np.zeros(len(ok), bool)
                            near[at[own]] = True
                        else:
                            own |= np.any([near[at + k] for k in range(n - 1)], axis=0)
                        at = at[own]
                    if n in sizes:
                        told.append((n, at, values[at]))
                used = np.zeros(len(runs.piece), bool)
                for n, at, _ in told:
                    for k in range(n):
                        used[at + k] = True
                used = np.flatnonzero(used)
                word = np.full(len(runs.piece) + longest, -1, np.int32)
                word[used] = numbers.of(runs.words, runs.hashes, used)
                for n, at, values in told:
                    ids = np.stack([word[at + k] if k < n else np.full(len(at), -1, np.int32) for k in range(longest)], axis=1)
                    order, start = grouped(values, ids)
                    first = at[order[start]]  # the pointer to an occurrence of each
                    held.append((values[order[start]], lang[first], np.diff(np.r_[start, len(at)]), ids[order[start]]))
                    size += len(first)
                if size > HELD:
                    held, size = [merged()], 0
                    if len(held[0][0]) > 2 * HELD:
                        yield from passed()
                        held, numbers = [], Numbers()
        if held:
            held = [merged()]
            yield from passed()

    return docs.mapInArrow(run, READ)


def slots(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two slots of the table of lower bounds for each fingerprint of a word."""
    return tuple((mixed(values ^ np.uint64(x)) & np.uint64(SLOTS - 1)).astype(np.int64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def low_counts(ones: DataFrame) -> np.ndarray:
    """A table of SLOTS bytes whatever the input: 4 log2 of the smallest count, rounded down, of the words (READ, counted)
    that share a slot, 0 where there is none. The larger one of a word's two slots is a lower bound of its count."""
    schema = "chunk int, at binary, low binary"
    arrow = arrow_schema(schema)

    def smallest(at, low):
        at, _, low = summed(at, low, low)
        return at, low

    def spread(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            if not texts:
                continue
            values, _ = Runs(texts, batch.column(0).to_pylist()).of(1)
            low = np.floor(4 * np.log2(batch.column(2).to_numpy())).astype(np.uint8)
            at, low = smallest(np.concatenate(slots(values)), np.r_[low, low])
            cut = np.searchsorted(at, np.arange(0, SLOTS + CHUNK, CHUNK)).tolist()
            inner = (at % CHUNK).astype(np.uint32)
            yield _rows([(k, inner[a:b].tobytes(), low[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b], arrow)

    def joined(batches):
        now, blobs = None, []

        def ended():
            at, low = smallest(*(np.concatenate([np.frombuffer(x[k], kind) for x in blobs]) for k, kind in ((0, np.uint32), (1, np.uint8))))
            return _rows([(now, at.tobytes(), low.tobytes())], arrow)

        for batch in batches:
            for chunk, *blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if blobs and chunk != now:
                    yield ended()
                    blobs = []
                now = chunk
                blobs.append(blob)
        if blobs:
            yield ended()

    table = np.zeros(SLOTS, np.uint8)
    found = ones.select("lang", "phrase", "f").mapInArrow(spread, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(joined, schema)
    for row in found.toLocalIterator():
        table[row["chunk"] * CHUNK + np.frombuffer(row["at"], np.uint32).astype(np.int64)] = np.frombuffer(row["low"], np.uint8)
    return table


def needed(docs: DataFrame, tables: list, lows, ranges: int, longest: int, least: int) -> DataFrame:
    """COUNTED of the marked runs of 2 to ``longest`` words: short forms, counts, and the counts without which they can't
    have a score of ``least`` (two bytes each; numbers beyond those count as the largest).

    A pair occurs a times and its words l and r times, so that a * a must be l * r * least / 10^6. Of a longer run the
    rest without its first word, or without its last, occurs a times at least: a must be l * least / 10^6."""
    arrow, most = arrow_schema(COUNTED), (1 << 16) - 1

    def run(batches):
        short, long = (x.value for x in tables)
        low = lows.value
        held, size = [], 0

        def passed():
            key, many, need = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            many = np.minimum(many, most).astype(np.uint16)
            own = (key >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if len(own) else []
            inner = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return _rows([(int(own[a]), None, inner[a:b].tobytes() + many[a:b].tobytes() + need[a:b].tobytes(), None) for a, b in zip(cut, [*cut[1:], len(own)], strict=False)], arrow)

        for batch in batches:
            for part in blocks(batch, TEXT_BYTES):
                runs = Runs(*_texts(part))
                one, other = slots(runs.of(1)[0])
                words, pair = 2.0 ** (np.maximum(low[one], low[other]) / 4), None
                for n in range(2, longest + 1):
                    values, ok = runs.of(n)
                    ok = of_pairs(ok, pair, n) if n > 2 else ok
                    at = np.flatnonzero(ok)
                    at = at[may_be(short if n <= 2 else long, values[at], ranges)]
                    if n == 2:
                        pair = np.zeros(len(ok), bool)
                        pair[at] = True
                    a, b = words[at], words[at + n - 1]
                    need = np.sqrt(a * b * least / 1e6) if n == 2 else np.maximum(a, b) * least / 1e6
                    need = np.minimum(np.ceil(need * (1 - 1e-9)), most).astype(np.uint16)
                    spot, inner = dealt(values[at], ranges)
                    held.append(summed(spot << np.uint64(32) | inner, np.ones(len(at), np.uint8), need))
                    size += len(held[-1][0])
                if size > 2 * HELD:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    return docs.mapInArrow(run, COUNTED)


def parts_table(longer: DataFrame, ranges: int) -> np.ndarray:
    """The table of bits of the pairs in the phrases of ``longer``."""
    arrow = arrow_schema(MARKED)

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                values, ok = Runs([x.encode() for x in part.column(1).to_pylist()], part.column(0).to_pylist()).of(2)
                at = np.unique(places(*dealt(values[ok], ranges)))
                cut = np.searchsorted(at, np.arange(0, BITS + 1, CHUNK)).tolist()
                inner = (at % CHUNK).astype(np.uint32)
                yield _rows([(k, inner[a:b].tobytes(), None, None) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b], arrow)

    return bit_table(longer.select("lang", "phrase").mapInArrow(run, MARKED))


def summed_up(read: DataFrame) -> DataFrame:
    """(lang, phrase, words, f) of what occurs LEAST times, written."""
    return written(read.groupBy("lang", "phrase", "words").agg(F.sum("many").alias("f")).where(F.col("f") >= LEAST))


class Marked:
    """Texts and the tables of their runs of at most ``longest`` words that may occur LEAST times."""

    def __init__(self, docs: DataFrame, longest: int):
        self.share = docs.sparkSession.sparkContext.broadcast
        self.docs = docs = docs.select(text_bytes(), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
        self.longest, self.ranges = longest, min(1 << 16, max(1024, 2 * docs.rdd.getNumPartitions()))
        marked = written(marks(short_counts(docs, self.ranges), self.ranges))
        self.tables = [self.share(bit_table(marked))]
        longer = written(marks(short_counts(docs, self.ranges, longest, self.tables[0]), self.ranges))
        self.tables.append(self.share(bit_table(longer)))
        dropped(longer)
        self.words = marked.where("chunk is null").groupBy("lang").agg(F.sum("many").alias("n"))

    def counts(self, docs: DataFrame, sizes: tuple = (), wanted: tuple = ()) -> DataFrame:
        return summed_up(marked_phrases(docs, self.tables, self.ranges, max(sizes, default=self.longest), sizes, wanted))

    def best_counts(self, docs: DataFrame, ones: DataFrame, lows, least: int) -> DataFrame:
        """Counts of all phrases that may have a score of ``least``, of their parts and of what is longer and holds them."""
        may = written(marks(needed(docs, self.tables, lows, self.ranges, self.longest, least), self.ranges, needs=True))
        wanted = [self.share(bit_table(may))]
        dropped(may)
        counts = ones
        if self.longest > 2:
            longer = self.counts(docs, (3,), wanted)
            wanted.append(self.share(parts_table(longer, self.ranges)))
            counts = ones.union(longer)
        counts = counts.union(self.counts(docs, (2,), wanted))
        for x in wanted:
            x.unpersist()
        return counts


def phrase_counts(docs: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every run of at most ``longest`` words that occurs LEAST times in its language, words
    joined by spaces; and (lang, n), all words of each language."""
    marked = Marked(docs, longest)
    return marked.counts(marked.docs), marked.words


def collocations(docs: DataFrame, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``first`` phrases of 2 to ``longest`` words of each language.

    Null texts are empty, null languages are ``und``; repeated rows count each time; ties are by a and then by the phrase's
    bytes, so that ranks are defined. Products are decimals of 38 digits, exact for counts up to 10^15."""
    marked = Marked(docs, longest)
    large = [x["lang"] for x in marked.words.where(F.col("n") >= FEW_WORDS).collect()] if longest in (2, 3) else []
    done, found = [], []
    if large:
        ones = marked.counts(marked.docs.where(F.col("lang").isin(large)), (1,))
        lows = marked.share(low_counts(ones))
        for least in SCORES:
            open_now = [x for x in large if x not in done]
            if open_now:
                inside = F.col("lang").isin(open_now)
                best = written(ranked(marked.best_counts(marked.docs.where(inside), ones.where(inside), lows, least), first).where(F.col("score") >= least))
                full = [x["lang"] for x in best.groupBy("lang").count().where(F.col("count") >= first).collect()]
                done += full
                found.append(best.where(F.col("lang").isin(full)))
    rest = ~F.col("lang").isin(done)
    if not found or not marked.words.where(rest).isEmpty():
        found.append(ranked(marked.counts(marked.docs.where(rest)), first))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.join(marked.words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(counts: DataFrame, first: int) -> DataFrame:
    """The ``first`` phrases of each language, scored by ``counts``."""
    words_of = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words_of, a, n), " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    whole = lambda x: f"cast({x} as decimal(15, 0))"
    score = F.expr(f"cast(({whole('a')} * {whole('a')} * cast(1000000 as decimal(7, 0))) div ({whole('l')} * {whole('r')}) as long)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = candidates.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {HALF} * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
