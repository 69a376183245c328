"""Ranked lexical search of all documents for each item of a query table, by classes of equal bags.

A document matters to a score only by how often it has each term of the items, and by m, which comes from its length. Documents
are restricted to the items' vocabulary; those of the same m and the same counts form a class, found by a hash and verified
by comparing the counts themselves. Each class is scored once; the best classes of an item are expanded to their members by
ascending doc_id. The first members of the k best classes (ordered by score, then by smallest member) are k documents that no
other class can beat, so that k classes an item, with k members each, hold its k best documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import BLOCK_BYTES, WORD_BYTES, arrow_schema, blocks, dropped, text_bytes, words, written
from cuelake.llm.wordspans import Words

#: Documents that an item gets, and share (of 100) of m that follows a document's length.
TOP, BY_LENGTH = 10, 90
#: Texts of items that are searched for at once; more are searched for in several passes.
ITEM_BYTES = 4_000_000
#: Cells of a table of scores (classes x items) that a task holds.
CELLS = 4_000_000

_TABLE = bytes(10 if c == 10 else b for c, b in enumerate(WORD_BYTES))


class Vocabulary:
    """The terms of a bounded set of items, and the items of each term."""

    def __init__(self, items: list[tuple[object, bytes]]):
        """``items``: (item_id, text); the texts of one item_id count as one item."""
        bags: dict[object, set[bytes]] = {}
        for item, text in items:
            bags.setdefault(item, set()).update(words(text))
        self.items = [*bags]
        self.terms = sorted(set().union(*bags.values()))
        known = {x: k for k, x in enumerate(self.terms)}
        self.of_term: list[list[int]] = [[] for _ in self.terms]
        for k, bag in enumerate(bags.values()):
            for x in bag:
                self.of_term[known[x]].append(k)
        hashes = Words([b" ".join(self.terms)], bytes(range(256))).hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.length = np.array([len(x) for x in self.terms], np.int64)
        self.first = np.r_[0, np.cumsum(self.length)[:-1]].astype(np.int64)
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)

    def found(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are terms, and of those terms: equal by hash, then compared byte by byte. Terms of
        equal hashes are all tried."""
        hashes = text.hashes()
        if not len(self.terms) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.searchsorted(self.sorted, hashes), np.searchsorted(self.sorted, hashes, "right")
        word, term = [], []
        for k in range(int((high - low).max())):
            at = np.flatnonzero(low + k < high)
            t = self.order[low[at] + k]
            same = text.end[at] - text.start[at] == self.length[t]
            at, t = at[same], t[same]
            for size in np.unique(self.length[t]).tolist():
                some = np.flatnonzero(self.length[t] == size)
                for part in np.array_split(some, max(1, len(some) * size // BLOCK_BYTES)):
                    steps = np.arange(size)
                    equal = (text.joined[text.start[at[part]][:, None] + steps] == self.bytes[self.first[t[part]][:, None] + steps]).all(1)
                    word.append(at[part[equal]])
                    term.append(t[part[equal]])
        return np.concatenate(word), np.concatenate(term)


VECTOR = "doc_id long, n long, vector binary"


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, vector): the number of a document's terms, and its counts of the vocabulary's: numbers of terms in
    order, then how often each one is there, both as 32 bits (empty if none)."""
    arrow = arrow_schema(VECTOR)

    def run(batches):
        own = vocabulary.value
        for batch in batches:
            for part in blocks(batch):
                text = Words(part.column(1).to_pylist(), _TABLE)
                word, term = own.found(text)
                key, tf = np.unique(text.owner[word] * max(1, len(own.terms)) + term, return_counts=True)
                doc, term = np.divmod(key, max(1, len(own.terms)))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                ids, tf = term.astype(np.int32), tf.astype(np.int32)
                packed = [ids[a:b].tobytes() + tf[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text.many), pa.array(packed, pa.binary())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long"), text_bytes()).mapInArrow(run, VECTOR)


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of vectors."""
    many = [len(x) // 8 for x in packed]
    ids = np.concatenate([np.frombuffer(x, np.int32, n) for x, n in zip(packed, many, strict=True)] or [np.zeros(0, np.int32)])
    tf = np.concatenate([np.frombuffer(x, np.int32, n, 4 * n) for x, n in zip(packed, many, strict=True)] or [np.zeros(0, np.int32)])
    return np.repeat(np.arange(len(packed)), many), ids.astype(np.int64), tf.astype(np.int64)


def document_counts(found: DataFrame, terms: int) -> list[int]:
    """How many documents hold each term; counted by task, then summed: a row for each term comes to the driver."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for part in blocks(batch):
                total += np.bincount(_unpacked(part.column(0).to_pylist())[1], minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = [0] * terms
    for row in found.select("vector").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row["term"]] = row["df"]
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


BEST = "item int, score long, class long, first long"


def best_classes(classes: DataFrame, vocabulary, weights, top: int) -> DataFrame:
    """BEST: for each task and item the ``top`` classes of a positive score, by score and then by smallest member.
    ``classes`` has id, first, m and vector."""
    arrow = arrow_schema(BEST)

    def run(batches):
        own, w = vocabulary.value, np.array(weights.value, np.int64)
        many = np.array([len(x) for x in own.of_term], np.int64)
        start = np.r_[0, np.cumsum(many)]
        holder = np.array([x for items in own.of_term for x in items], np.int64)
        items = len(own.items)
        held = [np.zeros(0, np.int64)] * 4  # item, score, class, first
        for batch in batches:
            for chunk in blocks(batch):
                step = max(1, CELLS // items)
                for at in range(0, chunk.num_rows, step):
                    part = chunk.slice(at, step)
                    row, term, tf = _unpacked(part.column(3).to_pylist())
                    m = part.column(2).to_numpy()[row]
                    value = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                    scores = np.zeros((part.num_rows, items), np.int64)
                    for some in np.array_split(np.arange(len(term)), max(1, int(many[term].sum()) // CELLS)):
                        n = many[term[some]]
                        place = np.repeat(start[term[some]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                        np.add.at(scores, (np.repeat(row[some], n), holder[place]), np.repeat(value[some], n))
                    # a null doc_id comes last
                    first = part.column(1).fill_null(np.iinfo(np.int64).max).to_numpy()
                    order = np.argsort(first, kind="stable")
                    scores, name, first = scores[order], part.column(0).to_numpy()[order], first[order]
                    chosen = np.argsort(-scores, axis=0, kind="stable")[:top]
                    item = np.broadcast_to(np.arange(items), chosen.shape).ravel()
                    chosen = chosen.ravel()
                    now = [item, scores[chosen, item], name[chosen], first[chosen]]
                    now = [np.concatenate(x) for x in zip(held, [x[now[1] > 0] for x in now], strict=True)]
                    order = np.lexsort((now[2], now[3], -now[1], now[0]))
                    now = [x[order] for x in now]
                    place = np.arange(len(order)) - np.searchsorted(now[0], now[0])
                    held = [x[place < top] for x in now]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, arrow.types, strict=True)], schema=arrow)

    return classes.select("id", "first", "m", "vector").mapInArrow(run, BEST)


def _search(docs: DataFrame, items: list[tuple[object, bytes]], top: int) -> DataFrame:
    """(item, rank, doc_id, score) for a bounded set of items; item is the number of the item in its vocabulary."""
    spark = docs.sparkSession
    own = Vocabulary(items)
    vocabulary = spark.sparkContext.broadcast(own)
    found = written(vectors(docs, vocabulary))
    documents, terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = spark.sparkContext.broadcast([weight(documents, df) for df in document_counts(found, len(own.terms))])
    m = F.expr(f"{100 - BY_LENGTH} + ({BY_LENGTH} * n * {documents}L) div {max(1, terms)}L")
    marked = found.where("length(vector) > 0").select("doc_id", m.alias("m"), "vector")
    marked = marked.withColumn("hash", F.xxhash64("m", "vector"))
    classes = marked.groupBy("hash", "m", "vector").agg(F.min("doc_id").alias("first"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc_nulls_last("first"), F.asc("class")]
    last = F.lit(2**63 - 1)
    best = best_classes(classes, vocabulary, weights, top).withColumn("first", F.when(F.col("first") < last, F.col("first")))
    best = written(best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= top))
    chosen = classes.join(best.select(F.col("class").alias("id")).distinct(), "id").select("id", "hash", "m", "vector")
    by_id = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("doc_id")))
    members = marked.join(chosen, ["hash", "m", "vector"]).select("id", "doc_id").withColumn("member", by_id).where(F.col("member") <= top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = written(members.join(best, F.col("id") == F.col("class")).select("item", "doc_id", "score", rank.alias("rank")).where(F.col("rank") <= top))
    dropped(found, classes, best)
    return ranked


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` documents; an item without any has no row.

    ``docs``: doc_id, text; ``items``: item_id, text. Null texts have no terms, null ids are ids (as a doc_id the last
    one among equal scores), rows of one item_id are one item, and repeated documents each have a rank."""
    spark = docs.sparkSession
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = -(-size // ITEM_BYTES) or 1
    kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("item_id", text_bytes()).collect()
        texts = [(x["item_id"], bytes(x["text"])) for x in mine]
        names = [*dict.fromkeys(x for x, _ in texts)]
        if not names:
            continue
        found = _search(docs, texts, top)
        table = spark.createDataFrame([*enumerate(names)], f"item int, item_id {kind}")
        found = found.join(F.broadcast(table), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
