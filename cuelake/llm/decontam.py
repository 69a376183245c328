"""Benchmark decontamination by winnowing.

Every run of SPAN = WINDOW + GRAM - 1 words holds WINDOW hashes of GRAM words; the smallest of each run is kept as a
fingerprint. A span that a document shares with a benchmark item therefore holds a fingerprint of the item at the same
place, so that looking up every place of a document, and extending each one found to the windows around it, finds every
shared span, those of repetitive texts included. A window counts if its words are those of an item's window.
Items of fewer than SPAN words are looked up whole, by the hash of all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import WORD_BYTES, append_columns, arrow_schema, blocks, fresh_name, text_bytes, words, written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: A benchmark of at most so many bytes of text goes to every task whole; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(SPAN)], np.uint64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as longer blocks come."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def word_hashes(texts: list[bytes], table: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in turn, and the number of words of each text. ``table`` makes spaces of bytes
    between words."""
    joined = np.frombuffer(b" ".join([*texts, b""]).translate(table), np.uint8)
    if not len(joined):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    _Powers.to(len(joined) + 1)
    inside = np.zeros(len(joined) + 2, np.int8)
    inside[1:-1] = joined != 32
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    total = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _Powers.up[: len(joined)], out=total[1:])
    hashes = mixed((total[end] - total[start]) * _Powers.down[start])
    bounds = np.cumsum([len(x) + 1 for x in texts])
    return hashes, np.diff(np.r_[0, np.searchsorted(start, bounds)])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    many = max(0, len(hashes) - n + 1)
    total = np.zeros(many, np.uint64)
    for k in range(n if many else 0):
        total += hashes[k : k + many] * _STEPS[k]
    return mixed(total)


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest of each WINDOW values in turn."""
    out = values[: max(0, len(values) - WINDOW + 1)].copy()
    for k in range(1, WINDOW if len(out) else 0):
        np.minimum(out, values[k : k + len(out)], out=out)
    return out


class Index:
    """Fingerprints of benchmark items, with the places that they stand for."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        by_text: dict[tuple, list[str | None]] = {}
        for item, text in items:
            if found := words(text):
                by_text.setdefault(tuple(found), []).append(item)
        self.words, self.names = [*by_text], [*by_text.values()]
        fingerprints: list[np.ndarray] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []  # windows of an item and where each begins
        self.whole: dict[int, dict[int, list[int]]] = {}
        for k, sequence in enumerate(self.words):
            hashes, _ = word_hashes([b" ".join(sequence)])
            if len(sequence) < SPAN:
                short = self.whole.setdefault(len(sequence), {})
                short.setdefault(int(grams(hashes, len(sequence))[0]), []).append(k)
                continue
            fingerprints.append(np.unique(minima(grams(hashes, GRAM))))
            found.append(self._windows(k, grams(hashes, SPAN)))
        several = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        value, item, place = (several([x[n] for x in found], kind) for n, kind in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(value, kind="stable")
        self.windows, self.item, self.place = value[order], item[order], place[order]
        self.sorted = {0: np.unique(several(fingerprints, np.uint64))}
        self.sorted |= {n: np.array(sorted(x), np.uint64) for n, x in self.whole.items()}
        self.rough = {}
        for n, values in self.sorted.items():
            self.rough[n] = np.zeros(1 << 20, bool)
            self.rough[n][(values & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _windows(self, k: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, item and place of each different window of an item."""
        own, (_, first, which) = self.words[k], np.unique(values, return_index=True, return_inverse=True)
        kept = np.zeros(len(values), bool)
        kept[first] = True
        for p in np.flatnonzero(~kept).tolist():  # other words of an equal hash are a window of their own
            q = int(first[which[p]])
            kept[p] = own[p : p + SPAN] != own[q : q + SPAN]
        at = np.flatnonzero(kept)
        return values[at], np.full(len(at), k), at

    def among(self, n: int, values: np.ndarray) -> np.ndarray:
        """Places of values that are fingerprints (n = 0) or whole items of n words."""
        at = np.flatnonzero(self.rough[n][(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        known = self.sorted[n]
        if not len(at) or not len(known):
            return at[:0]
        spot = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
        return at[known[spot] == values[at]]

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[list[int]], list[str]]]:
        """For each text its number of words, the hit spans of words, and the items found."""
        hashes, count = word_hashes(texts)
        first = np.cumsum(count) - count
        hits: dict[int, list[tuple[int, int, int]]] = {}
        at = self.among(0, grams(hashes, GRAM))
        # the windows around the fingerprints, within their text
        begin = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
        begin = begin[begin >= 0]
        doc = np.searchsorted(first + count, begin, "right")
        inside = (begin >= first[doc]) & (begin + SPAN <= (first + count)[doc]) if len(begin) else np.zeros(0, bool)
        begin, doc = begin[inside], doc[inside]
        values = grams(hashes, SPAN)[begin] if len(begin) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.windows, values), np.searchsorted(self.windows, values, "right")
        some = np.flatnonzero(low < high)
        for d, p, x, y in zip(doc[some].tolist(), begin[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
            hits.setdefault(d, []).append((p - int(first[d]), x, y))
        short: dict[int, list[tuple[int, int]]] = {}
        for n, known in self.whole.items():
            values = grams(hashes, n)
            at = self.among(n, values)
            doc = np.searchsorted(first + count, at, "right")
            for p, d, value in zip(at.tolist(), doc.tolist(), values[at].tolist(), strict=True):
                short.setdefault(d, []).extend((p - int(first[d]), k) for k in known[value])
        out = []
        for d, text in enumerate(texts):
            spans, items = self._verified(words(text), hits.get(d, []), short.get(d, [])) if d in hits or d in short else ([], [])
            out.append((int(count[d]), spans, items))
        return out

    def _verified(self, doc: list[bytes], hits: list[tuple[int, int, int]], short: list[tuple[int, int]]) -> tuple[list[list[int]], list[str]]:
        """Spans and items of the windows (place, and bounds among those of one hash) and of the short items (place, item)
        whose words are there. A window that occurs again is compared with its first occurrence only."""
        spans, items = [], set()
        known: dict[int, list[tuple[int, bool]]] = {}  # by hash: a place of each different window, and whether items have it
        for p, x, y in hits:
            own = doc[p : p + SPAN]
            good = next((g for q, g in known.get(x, ()) if doc[q : q + SPAN] == own), None)
            if good is None:
                same = [k for k, q in zip(self.item[x:y].tolist(), self.place[x:y].tolist(), strict=True) if self.words[k][q : q + SPAN] == tuple(own)]
                items.update(same)
                good = bool(same)
                known.setdefault(x, []).append((p, good))
            if good:
                spans.append([p, p + SPAN])
        for p, k in short:
            item = self.words[k]
            if tuple(doc[p : p + len(item)]) == item:
                spans.append([p, p + len(item)])
                items.add(k)
        return merged(spans), sorted({x for k in items for x in self.names[k]}, key=lambda x: (x is None, x))


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


FOUND = "n_words long, spans array<struct<start long, end long>>, items array<string>"


def _found(index: Index, texts: list[bytes]) -> dict[str, list]:
    rows = index.scan(texts)
    return {
        "n_words": [n for n, _, _ in rows],
        "spans": [[{"start": a, "end": b} for a, b in spans] for _, spans, _ in rows],
        "items": [items for _, _, items in rows],
    }


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of ``docs`` (a clashing one gives way) with n_words, spans (merged hit ranges of words) and items
    (ids, as sorted strings, of the items of which some window of SPAN words, or all of fewer, occurs).

    A null or empty text has no words and is clean; an item without words is never found; items of one wording are
    all found; null ids and repeated rows stay, and a null item_id is an item as any other (last in items). The benchmark's size is measured first: up to
    ``broadcast_bytes`` it goes to the tasks whole, beyond that fingerprints are joined by a shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("string"), text_bytes())
    size = items.agg(F.sum(F.length("text") + F.coalesce(F.length("item_id"), F.lit(0)))).first()[0] or 0
    if size > broadcast_bytes:
        return _joined(docs, items)
    known = docs.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in items.collect()])
    return _scanned(docs, lambda: Index(known.value))


def _scanned(docs: DataFrame, make) -> DataFrame:
    def start():
        index = make()
        return lambda texts: _found(index, texts)

    return append_columns(docs, start, FOUND)


PLACES = "fp long, text_key string, place long"


def _hashed(texts: DataFrame, name: str, of, schema: str) -> DataFrame:
    """Rows of ``of`` (arrays of a text's word hashes to columns) for each text, with its key as column ``name``."""
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                made = [of(word_hashes([x])[0]) for x in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(made)), [len(x[0]) for x in made])
                columns = [np.concatenate(c) for c in zip(*made, strict=True)]
                found = {n: pa.array(c.view(np.int64)) for n, c in zip([n for n in arrow.names if n != name], columns, strict=True)}
                found[name] = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([found[n].cast(arrow.field(n).type) for n in arrow.names], schema=arrow)

    return texts.mapInArrow(run, schema)


def kept_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: grams that are the smallest of some window, at each place in it."""
    values = grams(hashes, GRAM)
    low = minima(values)
    kept = np.zeros(len(values), bool)
    for k in range(WINDOW if len(low) else 0):
        kept[k : k + len(low)] |= values[k : k + len(low)] == low
    at = np.flatnonzero(kept)
    return values[at], at


def windows(hashes: np.ndarray) -> tuple[np.ndarray]:
    return (np.unique(grams(hashes, SPAN)),)


def short_windows(lengths: list[int]):
    """The hashes of all runs of so many words, with their places and lengths."""

    def of(hashes):
        made = [grams(hashes, n) for n in lengths]
        size = [len(x) for x in made]
        return np.concatenate(made), np.concatenate([np.arange(n) for n in size]), np.repeat(np.array(lengths, np.int64), size)

    return of


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As the broadcast way, by shuffles. Results hang on a text alone, so that its MD5 stands for it.

    Kept places of texts are semi-joined with the items' fingerprints; around the places that are left, the hashes of all
    runs of SPAN words are joined with those of the items' windows. Items of fewer words are joined by the hash of all their
    words. No pair of a text and an item is made before a whole window of one is found in the other.
    """
    key, n_words, in_spans, in_items = (fresh_name(docs, x) for x in ("text_key", "known_words", "found_spans", "found_items"))
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = written(keyed.select(F.col(key).alias("text_key"), text_bytes()).dropDuplicates(["text_key"]))
    items = items.withColumn("item_key", F.md5("text"))
    tests = written(items.groupBy("item_key").agg(F.first("text").alias("text")).select("item_key", "text"))
    ids = items.select("item_key", "item_id").distinct()

    fps = _hashed(tests, "item_key", lambda hashes: (np.unique(kept_places(hashes)[0]),), "fp long, item_key string").select("fp").distinct()
    places = _hashed(texts, "text_key", kept_places, PLACES).join(fps, "fp", "left_semi")
    near = texts.join(places.groupBy("text_key").agg(F.sort_array(F.collect_set("place")).alias("places")), "text_key")

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                for x in part.to_pylist():
                    values = grams(word_hashes([x["text"]])[0], SPAN)
                    at = np.unique((np.array(x["places"])[:, None] - np.arange(WINDOW)).ravel())
                    at = at[(at >= 0) & (at < len(values))]
                    name = pa.array([x["text_key"]] * len(at), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(values[at].view(np.int64)), name, pa.array(at)], names=["fp", "text_key", "place"])

    whole = _hashed(tests, "item_key", windows, "fp long, item_key string").withColumn("n", F.lit(SPAN).cast("long"))
    looked = near.select("text_key", "text", "places").mapInArrow(run, PLACES).withColumn("n", F.lit(SPAN).cast("long"))
    shorter = _hashed(
        tests, "item_key", lambda hashes: (grams(hashes, len(hashes)), np.full(1, len(hashes))) if 0 < len(hashes) < SPAN else (hashes[:0], np.zeros(0, np.int64)), "fp long, n long, item_key string"
    )
    shorter = written(shorter)
    lengths = [int(r.n) for r in shorter.select("n").distinct().collect()]  # fewer than SPAN values
    if lengths:
        whole = whole.unionByName(shorter)
        looked = looked.unionByName(_hashed(texts, "text_key", short_windows(lengths), PLACES + ", n long"))
    whole = written(whole)
    hits = written(looked.join(whole.select("fp", "n").distinct(), ["fp", "n"], "left_semi"))
    named = hits.select("fp", "n", "text_key").distinct().join(whole, ["fp", "n"]).select("text_key", "item_key").distinct().join(ids, "item_key")
    item = F.struct(F.col("item_id").isNull().alias("last"), "item_id")
    found = named.groupBy("text_key").agg(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["item_id"]).alias("items"))
    by = Window.partitionBy("text_key").orderBy("start", "end")
    runs = hits.select("text_key", F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("end")).distinct()
    reached = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = runs.withColumn("new", (F.col("start") > reached).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    none = F.from_json(F.lit("[]"), "array<struct<start long, end long>>")

    def counted():
        return lambda block: {n_words: word_hashes(block)[1]}

    full = append_columns(keyed, counted, f"`{n_words}` long")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    full = full.select(*own, F.col(key).alias(key), F.col(n_words).alias(n_words))
    both = found.join(spans, "text_key", "full").select(F.col("text_key").alias(key), F.col("spans").alias(in_spans), F.col("items").alias(in_items))
    full = full.join(both, key, "left")
    return full.select(
        *own, F.col(n_words).alias("n_words"), F.coalesce(in_spans, none).alias("spans"), F.coalesce(in_items, F.array().cast("array<string>")).alias("items")
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
