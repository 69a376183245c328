"""Removal of long repeated passages: every byte inside a string of LENGTH bytes that also starts elsewhere.

Suffixes of a corpus can't be sorted in one place, so they are first dealt out by anchors. The anchor of a string of
LENGTH bytes is its leftmost smallest hash of GRAM bytes; equal strings have equal anchors at equal places, so equal
strings meet at their anchor's hash. Neighbouring strings with one anchor form a run; runs of equal bytes (by 128 bits of
hashes) are collapsed into one.

Where an anchor has several different runs, their strings are put in suffix order with the lengths of the common
prefixes of neighbours. The previous and the next smaller position in that order give each string's longest previous
factor: where it reaches LENGTH, the string is a later copy. ``keep_first`` removes these only; else the first copies, that
such factors lead to, go too.

Anchors of more runs than a task should sort together are handled in chunks of that many. Two chunks are compared by cores:
the bytes that all strings of a block of BLOCK distances from the anchor hold. Only strings of a block whose core is in
several chunks can be equal to one of another chunk; these are counted by hash in a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, blocks, fresh_name, text_bytes, written
from cuelake.llm.decontam import _Powers, mixed

LENGTH, GRAM = 400, 64
#: Runs of one anchor that are put in suffix order together inside a task; more are handled in chunks.
HOT_RUNS = 4096
#: Distances from the anchor that a block of a chunk's comparison holds.
BLOCK = 16
#: Strings sorted at once.
SORTED = 16_384
#: Text whose anchors are found at once; a longer one goes in overlapping pieces.
PIECE = 4_000_000
#: The order of a text without one: last.
LAST = np.iinfo(np.int64).max


def text_key(text: bytes, order: int) -> bytes:
    """128 bits that stand for a text; where copies are told apart by their order, for the text of that order."""
    return xxhash.xxh128_digest(text, order % (1 << 64))


def ordered(docs: DataFrame, keep_first: bool) -> DataFrame:
    """text (bytes) and place: doc_id where the first copy is kept, the same for all texts otherwise."""
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))) if keep_first else F.lit(0).cast("long")
    return docs.select(text_bytes(), place.alias("place"))


def runs(text: bytes) -> tuple[np.ndarray, ...] | None:
    """Of each run of strings with one anchor: the anchor's hash, the bytes' hash, first start, last start and the
    anchor's place after the first start."""
    if len(text) < LENGTH:
        return None
    parts = []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        x = np.frombuffer(text, np.uint8)[at : at + PIECE + LENGTH - 1]
        n, width = len(x), LENGTH - GRAM + 1
        _Powers.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _Powers.up[:n], out=total[1:])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * _Powers.down[: n - GRAM + 1])
        low = grams >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        anchor = anchor[first]
        shift = anchor - first
        whole = mixed((total[last + LENGTH] - total[first]) * _Powers.down[first])
        whole = mixed(whole ^ (shift * 1_000_003 + last - first).astype(np.uint64))
        parts.append((grams[anchor].view(np.int64), whole.view(np.int64), first + at, last + at, shift))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


RUNS = "anchor long, bytes long, place long, key binary, firsts array<long>, span long, shift long"


def keyed_runs(texts: DataFrame) -> DataFrame:
    """Runs of every text (of ``ordered``), equal ones of one text as a single row with all their starts, so that a line
    repeated over and over is a row for each text; span is last start less first."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                keys, columns, starts = [], [], []
                for text, place in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = runs(text)
                    if found is None:
                        continue
                    anchor, whole, first, last, shift = found
                    order = np.lexsort((first, whole, anchor))
                    anchor, whole, first, last, shift = (x[order] for x in found)
                    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])
                    keys.append((text_key(text, place), place, len(new)))
                    columns.append((anchor[new], whole[new], last[new] - first[new], shift[new], np.diff(np.r_[new, len(first)])))
                    starts.append(first)
                if keys:
                    anchor, whole, span, shift, many = map(np.concatenate, zip(*columns, strict=True))
                    row = np.repeat(np.arange(len(keys)), [n for _, _, n in keys])
                    key = pa.array([k for k, _, _ in keys], pa.binary()).take(pa.array(row))
                    place = np.array([x for _, x, _ in keys])[row]
                    bounds = pa.array(np.r_[0, np.cumsum(many)].astype(np.int32))
                    firsts = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(starts)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(whole), pa.array(place), key, firsts.cast(pa.list_(pa.field("element", pa.int64()))), pa.array(span), pa.array(shift)],
                        names=["anchor", "bytes", "place", "key", "firsts", "span", "shift"],
                    )

    return texts.mapInArrow(run, RUNS)


DECIDED = "anchor long, place long, key binary, first long, last long, shift long, known boolean"


def decided(keep_first: bool = False):
    """From runs sorted by anchor, bytes and place: those that occur twice (known; with ``keep_first`` but the first), and
    those that need a closer look: of each different run the first copy, where an anchor has several. Holds one batch, and
    of the last run two copies at most."""

    def run(batches):
        held, more = None, False  # more: the first anchor had other runs before
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            anchor, whole = table["anchor"].to_numpy(), table["bytes"].to_numpy()
            last = np.flatnonzero((anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            known, look, fresh = _marks(anchor, whole, _many(table), more)
            known[cut + 2 :], known[cut : cut + 2], look[cut:] = True, False, False
            yield from _rows(table, known, True, fresh & keep_first)
            yield from _rows(table, look, False)
            more = cut > 0 and anchor[cut - 1] == anchor[-1] or more and anchor[0] == anchor[-1]
            held = table.slice(cut, 2)
        if held is not None:
            known, look, fresh = _marks(held["anchor"].to_numpy(), held["bytes"].to_numpy(), _many(held), more)
            yield from _rows(held, known, True, fresh & keep_first)
            yield from _rows(held, look, False)

    return run


def _many(table: pa.Table) -> np.ndarray:
    """How many starts each row has."""
    return pc.list_value_length(table["firsts"]).to_numpy()


def _marks(anchor: np.ndarray, whole: np.ndarray, many: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(anchor)]))
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])]
    twice = ~fresh | np.r_[~fresh[1:], False] | (many > 1)
    several = (np.bincount(group, weights=fresh)[group] > 1) | (group == 0) & more
    return twice, several & fresh, fresh


def _rows(table: pa.Table, at: np.ndarray, known: bool, but_first: np.ndarray | None = None):
    """All starts of the rows if they are known to be repeats (but the first one of some rows), else one start of each."""
    if at.any():
        part = table.filter(pa.array(at))
        many = _many(part) if known else np.ones(part.num_rows, np.int64)
        first = pc.list_flatten(part["firsts"]).to_numpy() if known else pc.list_element(part["firsts"], 0).to_numpy()
        row = np.repeat(np.arange(part.num_rows), many)
        if but_first is not None and but_first.any():
            stay = np.ones(len(first), bool)
            stay[(np.cumsum(many) - many)[but_first[at]]] = False
            first, row = first[stay], row[stay]
        last = first + part["span"].to_numpy()[row]
        wide = part.select(["anchor", "place", "key", "shift"]).take(pa.array(row))
        columns = [wide["anchor"], wide["place"], wide["key"], pa.array(first), pa.array(last), wide["shift"], pa.array(np.full(len(first), known))]
        yield from pa.table(columns, names=["anchor", "place", "key", "first", "last", "shift", "known"]).to_batches()


STRINGS = "anchor long, place long, key binary, first long, shift long, part binary"


def strings_of(looks: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of runs that need a closer look, cut out of their texts; of equal texts one is read."""

    def keyed(batches):
        for batch in batches:
            for part in blocks(batch):
                keys = [text_key(t, p) for t, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary())], names=["text", "place", "key"])

    long = texts.where(F.length("text") >= LENGTH).mapInArrow(keyed, "text binary, place long, key binary")
    wanted = looks.groupBy("key").agg(F.collect_set(F.struct("anchor", "first", "last", "shift")).alias("runs"))
    both = long.dropDuplicates(["key"]).join(wanted, "key").select("key", "place", "text", "runs")

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                out = [
                    (r["anchor"], x["place"], x["key"], r["first"], r["shift"], x["text"][r["first"] : r["last"] + LENGTH])
                    for x in part.to_pylist()
                    for r in x["runs"]
                ]
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                columns = [*zip(*out, strict=True)] or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "place", "key", "first", "shift", "part"])

    return both.mapInArrow(run, STRINGS)


def suffix_order(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The order of the strings of LENGTH bytes at ``start``."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - LENGTH + 1, LENGTH), (1, 1))
    return np.argsort(np.ascontiguousarray(view[start]).view(f"S{LENGTH}").ravel(), kind="stable")


def suffix_array(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of the strings at ``start``, and the length of each one's common prefix with the one before
    it in that order, cut off at LENGTH."""
    order = suffix_order(data, start)
    view = np.lib.stride_tricks.as_strided(data, (len(data) - LENGTH + 1, LENGTH), (1, 1))
    wide = np.dtype(np.uint64 if LENGTH % 8 == 0 else np.uint8)
    common = np.zeros(len(start), np.int32)
    for at in range(1, len(order), 4096):
        rows = order[at - 1 : at + 4096]
        sorted_ = np.ascontiguousarray(view[start[rows]]).view(wide)
        differ = sorted_[1:] != sorted_[:-1]
        first = differ.argmax(1)
        row = np.arange(len(first))
        same = ~differ[row, first]
        length = first.astype(np.int32) * wide.itemsize
        if wide.itemsize > 1:  # the first byte that differs is the lowest one of the word
            odd = sorted_[row + 1, first] ^ sorted_[row, first]
            length += np.bitwise_count((odd & -odd) - np.uint64(1)).astype(np.int32) // 8
        common[at : at + len(first)] = np.where(same, LENGTH, length)
    return order, common


def _smaller_before(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of the suffix order, the length of its common prefix with the nearest one before it whose
    position is smaller (0 if there is none). Descends over minima of 2^k places."""
    n = len(position)
    lows, shared = [position], [common]
    while 1 << len(lows) < n:
        half = 1 << (len(lows) - 1)
        low, both = lows[-1].copy(), shared[-1].copy()
        low[half:] = np.minimum(low[half:], lows[-1][:-half])
        both[half:] = np.minimum(both[half:], shared[-1][:-half])
        lows.append(low)
        shared.append(both)
    at = np.arange(n)  # all of those from here on, before the place, are larger
    length = np.full(n, LENGTH, np.int32)
    for k in range(len(lows) - 1, -1, -1):
        free = at >= 1 << k
        before = np.maximum(at - 1, 0)
        step = free & (lows[k][before] > position)
        length = np.where(step, np.minimum(length, shared[k][at]), length)
        at = np.where(step, at - (1 << k), at)
    return np.where(at > 0, np.minimum(length, common[at]), 0)


def _factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """In suffix order, the longer of the common prefixes with the previous and the next smaller position."""
    turned = np.r_[common[:1] * 0, common[:0:-1]]
    return np.maximum(_smaller_before(position, common), _smaller_before(position[::-1], turned)[::-1])


def previous_factors(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The longest previous factor of each string of LENGTH bytes at ``start``, cut off at LENGTH; positions are in the
    order of ``start``."""
    order, common = suffix_array(data, start)
    out = np.zeros(len(start), np.int64)
    out[order] = _factors(order, common)
    return out


def repeated_strings(data: np.ndarray, start: np.ndarray, keep_first: bool = False) -> np.ndarray:
    """Whether each string's longest previous factor reaches LENGTH, or, unless the first is kept, that of another one
    leads to it."""
    out = np.zeros(len(start), bool)
    order, common = suffix_array(data, start)
    whole = common == LENGTH
    rows = np.flatnonzero(whole | np.r_[whole[1:], False])
    if len(rows):  # the factors of strings that share less with both neighbours are shorter
        own = order[rows]
        later = _factors(own, np.minimum.reduceat(common[: rows[-1] + 1], np.r_[0, rows[:-1] + 1])) >= LENGTH
        out[own] = later if keep_first else True  # each class of several holds one string that is no later copy
    return out


FOUND = "key binary, first long, last long, place long, chunk long, core binary, part binary"


def compared(keep_first: bool = False, hot_runs: int = HOT_RUNS):
    """From strings of runs sorted by anchor, place and key: the starts (first to last) that are repeats; of an anchor with
    too many runs, those inside each chunk, and the chunk's blocks with their cores."""

    def some(rows):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = [*zip(*rows, strict=True)] or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "first", "last", "place", "chunk", "core", "part"])

    def together(rows, chunk=None):
        """Rows of whole anchors, or of a chunk of one: (anchor, place, key, first, shift, part)."""
        rows = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        size = np.array([len(r[5]) for r in rows])
        begin = np.cumsum(size) - size
        many = size - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), many)
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = begin[owner] + inside
        repeated = np.zeros(len(start), bool)
        if len(start) <= SORTED:
            repeated = repeated_strings(data, start, keep_first)
        else:  # only strings at the same distance from their anchor can be equal
            distance = inside - np.array([r[4] for r in rows])[owner]
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for part in np.split(order, cuts):
                repeated[part] = repeated_strings(data, start[part], keep_first)
        # stretches of repeats, cut where one run's strings end
        edge = np.flatnonzero(np.diff(np.r_[False, repeated, False].astype(np.int8)))
        cut = np.cumsum(many)
        pieces = []
        for x, y in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True):
            while x <= y:
                k = owner[x]
                end = min(y, int(cut[k]) - 1)
                pieces.append((rows[k][2], rows[k][3] + int(inside[x]), rows[k][3] + int(inside[end]), None, None, None, None))
                x = end + 1
        if pieces:
            yield some(pieces)
        if chunk is not None:
            yield some(cores(rows, chunk))

    def cores(rows, chunk):
        """Each different block of a chunk's runs, its first copy standing for all."""
        seen, out = set(), []
        for anchor, place, key, first, shift, part in rows:
            low, high = -shift, len(part) - LENGTH - shift
            for block in range(low // BLOCK, high // BLOCK + 1):
                a, b = max(low, block * BLOCK), min(high, block * BLOCK + BLOCK - 1)
                own = part[a + shift : b + shift + LENGTH]
                if (a, b, own) not in seen:
                    seen.add((a, b, own))
                    core = part[block * BLOCK + BLOCK - 1 + shift : block * BLOCK + shift + LENGTH]
                    name = xxhash.xxh128_digest(b"%d %d " % (anchor, block) + core)
                    out.append((key, first + a + shift, first + b + shift, place, chunk, name, own))
        return out

    def run(batches):
        held, anchor, chunk, ready, strings = [], None, None, [], 0

        def done():
            nonlocal ready, strings
            if chunk is not None:
                yield from together(held, chunk)
                return
            more = sum(len(r[5]) - LENGTH + 1 for r in held)
            if ready and strings + more > SORTED:
                yield from together(ready)
                ready, strings = [], 0
            ready, strings = ready + held, strings + more

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != anchor:
                    if held:
                        yield from done()
                    held, anchor, chunk = [], row[0], None
                elif len(held) == hot_runs:
                    chunk = 0 if chunk is None else chunk
                    yield from together(held, chunk)
                    held, chunk = [], chunk + 1
                held.append(row)
        if held:
            yield from done()
        if ready:
            yield from together(ready)

    return run


def across_chunks(blocks_: DataFrame, keep_first: bool) -> DataFrame:
    """(key, first, last): the strings of blocks (of FOUND) that are equal to one of another chunk."""
    several = blocks_.groupBy("core").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").select("core")
    live = blocks_.join(several, "core", "left_semi").select("key", "place", "first", "part")

    def run(batches):
        for batch in batches:
            rows = [(k, p, f + n, xxhash.xxh128_digest(x[n : n + LENGTH])) for k, p, f, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n in range(len(x) - LENGTH + 1)]
            columns = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "place", "first", "hash"])

    strings = written(live.mapInArrow(run, "key binary, place long, first long, hash binary"))
    order = F.struct("place", "key", "first")
    often = strings.groupBy("hash").agg(F.count("*").alias("many"), F.min(order).alias("low")).where("many > 1").select("hash", "low")
    equal = strings.join(often, "hash")
    equal = equal.where(order > F.col("low")) if keep_first else equal
    return equal.select("key", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, keep_first: bool = False, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(key, spans): for each different text with repeats, by ``text_key``, its repeated ranges of bytes."""
    texts = ordered(docs, keep_first)
    by_anchor = keyed_runs(texts).repartition("anchor").sortWithinPartitions("anchor", "bytes", "place", "key")
    first = written(by_anchor.mapInArrow(decided(keep_first), DECIDED))
    looks = first.where("not known").distinct()
    parts = strings_of(looks, texts).repartition("anchor").sortWithinPartitions("anchor", "place", "key")
    found = written(parts.mapInArrow(compared(keep_first, hot_runs), FOUND))
    spans = first.where("known").select("key", "first", "last").union(found.where("core is null").select("key", "first", "last"))
    hot = found.where("core is not null")
    if not hot.isEmpty():
        spans = spans.union(across_chunks(hot, keep_first))
    spans = spans.select("key", "first", (F.col("last") + LENGTH).alias("end")).distinct()
    return spans.groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


def without_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS, keep_first: bool = False) -> DataFrame:
    """All columns of ``docs`` with n_bytes, spans (maximal removed ranges of bytes) and kept (the other bytes); own
    columns of these names give way.

    A null text counts as empty; texts of fewer than LENGTH bytes keep all. Of equal texts of at least LENGTH bytes
    nothing is kept. With ``keep_first`` the first copy of each string stays, in the order of doc_id (nulls last) and place;
    rows that agree in doc_id and text are one document then. Repeated rows give equal results.
    """
    added = ("spans", "n_bytes", "kept")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    key_name, place_name = fresh_name(docs, "key"), fresh_name(docs, "place")
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))) if keep_first else F.lit(0)
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{place_name}` long, `{key_name}` binary"])
    schema, text = arrow_schema(full), docs.columns.index("text")

    def name(batches):
        for batch in batches:
            for part in blocks(batch):
                texts = [x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()]
                keys = [text_key(t, p) for t, p in zip(texts, part.column(part.num_columns - 1).to_pylist(), strict=True)]
                own = [c.cast(f.type) for c, f in zip(part.columns, schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.binary())], schema=schema)

    keyed = docs.withColumn(place_name, place.cast("long")).mapInArrow(name, full).drop(place_name)
    both = keyed.join(repeated_spans(docs, keep_first, hot_runs).withColumnRenamed("key", key_name), key_name, "left")

    at, own = both.columns.index("text"), both.columns.index("spans")
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["n_bytes long, spans array<struct<start long, end long>>, kept binary"])
    arrow, kept_names = arrow_schema(full), docs.columns

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                size, spans, kept = [], [], []
                for text, found in zip(texts, part.column(own).to_pylist(), strict=True):
                    union: list[list[int]] = []
                    for x in sorted(found or [], key=lambda s: (s["first"], s["end"])):
                        if union and x["first"] <= union[-1][1]:
                            union[-1][1] = max(union[-1][1], x["end"])
                        else:
                            union.append([x["first"], x["end"]])
                    rest, last = [], 0
                    for a, b in union:
                        rest.append(text[last:a])
                        last = b
                    size.append(len(text))
                    spans.append([{"start": a, "end": b} for a, b in union])
                    kept.append(b"".join([*rest, text[last:]]))
                own_columns = [part.column(part.schema.get_field_index(n)).cast(arrow.field(n).type) for n in kept_names]
                extra = [pa.array(x, arrow.field(n).type) for n, x in (("n_bytes", size), ("spans", spans), ("kept", kept))]
                yield pa.RecordBatch.from_arrays([*own_columns, *extra], schema=arrow)

    return both.mapInArrow(run, full)


def repeat_report(docs: DataFrame) -> DataFrame:
    found = without_repeats(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
