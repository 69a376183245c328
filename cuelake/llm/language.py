"""Language identification by a string kernel.

Kernel: the number of shared byte n-grams of 1 to 3 bytes (presence in a blended spectrum, hashed into slots),
divided by the geometric mean of both texts' numbers. Nyström: with landmark texts L, a text x is mapped to
k(x, L) K(L, L)^(-1/2). On these maps, one-versus-rest kernel ridge regression is solved in closed form.
Scoring a block of texts is two matrix products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns

SLOTS = 1 << 15
#: Bounds of what is learned from, for each language: texts and landmarks. Every language is learned; of many languages, each has
#: fewer (but never under the second number).
TEXTS, LANDMARKS = (400, 4), (24, 1)
#: Texts in all from which on a language has fewer, and landmarks in all, of whatever number of languages.
ALL_TEXTS, ALL_LANDMARKS = 8000, 600
#: Languages up to which landmarks and weights go to the tasks as one matrix (of 131 KB a language); of more, the landmarks go as
#: bits (2.4 MB at most), and the weights by themselves (2.4 KB a language).
AS_MATRIX = 64
RIDGE = 1e-3
UNDECIDED = "und"


def presence(text: bytes, row: np.ndarray) -> None:
    """Set the slots of the n-grams of the text, lower-cased (A-Z), digits and white space alike, to 1."""
    x = np.frombuffer(text.translate(_FOLD), np.uint8).astype(np.uint32)
    for n, seed in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        if len(x) >= n:
            h = x[: len(x) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint32(257) + x[k : len(x) - n + 1 + k]
            h = (h + np.uint32(n)) * np.uint32(seed)
            row[(h ^ h >> np.uint32(15)) & np.uint32(SLOTS - 1)] = 1


_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))


def has_letter(text: bytes) -> bool:
    """Whether a character of the text is a letter in Unicode."""
    plain = text.translate(None, _NOT_ASCII_LETTERS)
    if plain:
        if any(c < 128 for c in plain[:64]) or any(c < 128 for c in plain):
            return True
        return any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return False


_NOT_ASCII_LETTERS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))


def share(languages: int, each: tuple[int, int], total: int) -> int:
    return max(each[1], min(each[0], total // max(1, languages)))


def unit(packed: np.ndarray) -> np.ndarray:
    """Presence rows of unit length, from rows packed to bits."""
    row = np.unpackbits(packed, axis=1).astype(np.float32)
    return row / np.sqrt(np.maximum(1, row.sum(1)))[:, None]


class Kernel:
    """Landmarks and one-versus-rest weights. ``matrix`` maps a presence row to class values; with ``marks``, landmarks packed to
    bits, it maps a row's kernel values with them."""

    def __init__(self, languages: list[str], matrix: np.ndarray, marks: np.ndarray | None = None):
        self.languages, self.matrix, self.marks = languages, matrix, marks
        self.unit = None if marks is None else unit(marks).T.copy()

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str]) -> Kernel:
        """From presence rows packed to bits, which are unpacked in blocks."""
        languages = sorted(set(labels))
        if not languages:
            return cls([], np.zeros((SLOTS, 0), np.float32))
        where: dict[str, list[int]] = {}
        for k, x in enumerate(labels):
            where.setdefault(x, []).append(k)
        per = share(len(languages), LANDMARKS, ALL_LANDMARKS)
        chosen = [k for x in languages for k in where[x][:per]]
        if len(chosen) > ALL_LANDMARKS:  # one of each of some languages: the texts come in no order
            chosen = sorted(chosen)[:ALL_LANDMARKS]
        marks = unit(rows[chosen])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        maps = np.concatenate([unit(rows[k : k + 256]) @ marks.T for k in range(0, len(rows), 256)]) @ root
        number = {x: k for k, x in enumerate(languages)}
        own = np.array([number[x] for x in labels])
        weight = 1 / np.bincount(own)[own][:, None]  # every language counts alike
        weighed = weight * maps
        # the targets are 1 for a text's own language and -1 for every other one
        sums = np.zeros((len(languages), maps.shape[1]))
        np.add.at(sums, own, weighed)
        weights = np.linalg.solve(maps.T @ weighed + RIDGE * np.eye(maps.shape[1]), 2 * sums.T - weighed.sum(0)[:, None])
        if len(languages) <= AS_MATRIX:
            return cls(languages, (marks.T @ (root @ weights)).astype(np.float32))
        return cls(languages, (root @ weights).astype(np.float32), rows[chosen])

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best class of each presence row, and its softmax share."""
        size = np.sqrt(np.maximum(1, rows.sum(1, dtype=np.float32)))[:, None]
        value = 4 * ((rows if self.marks is None else rows @ self.unit) @ self.matrix) / size
        share = np.exp(value - value.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        return value.argmax(1), share.max(1)


def train(docs: DataFrame, learn=None, texts: tuple[int, int] = TEXTS) -> Kernel:
    """Learn every lang from at most ``texts`` documents of each, chosen by the hash of their doc_id; of rows that share
    doc_id and lang, one counts (that of the smallest text). Of the chosen ones only packed slots reach the driver."""
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    if learn is not None:
        known = known.where(learn)
    counts = known.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return Kernel.fit(np.zeros((0, SLOTS // 8), np.uint8), [])
    each = share(len(counts), texts, ALL_TEXTS)
    parts = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * each / r["count"] + 50.0 / r["count"])) for r in counts], "lang string, part double")
    mark = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    some = known.select("doc_id", "lang", mark.alias("mark")).join(F.broadcast(parts), "lang").where("mark < part").distinct()
    # about twice as many as wanted are left by now, whatever the corpus
    order = Window.partitionBy("lang").orderBy("mark", "doc_id")
    chosen = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("doc_id", "lang")
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    picked = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def make():
        def handle(block):
            rows = np.zeros((len(block), SLOTS), np.uint8)
            for k, text in enumerate(block):
                presence(text, rows[k])
            return {"slots": [x.tobytes() for x in np.packbits(rows, axis=1)]}

        return handle

    table = append_columns(picked, make, "slots binary").select("doc_id", "lang", "slots").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    packed = np.frombuffer(b"".join(table["slots"].to_pylist()), np.uint8).reshape(-1, SLOTS // 8)
    order = np.argsort(np.random.default_rng(5).random(len(packed)))
    return Kernel.fit(packed[order], [table["lang"][int(k)].as_py() for k in order])


def identified(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1, the predicted language's softmax share).

    Only the whole text is read. A text that is null or has no letter is ``und`` with a score of 0, as is
    every text if nothing was learned. Repeated rows get equal results. One narrow pass; what goes to the tasks is
    8 MB at most for AS_MATRIX languages, and beyond that 2.4 MB and 2.4 KB for each language.
    """
    known = docs.sparkSession.sparkContext.broadcast((kernel.languages, kernel.matrix, kernel.marks))

    def make():
        languages = known.value[0]
        model = Kernel(*known.value)

        def handle(block):
            names, scores = [], []
            for at in range(0, len(block), 256):
                part = block[at : at + 256]
                rows = np.zeros((len(part), SLOTS), np.float32)
                for k, text in enumerate(part):
                    presence(text, rows[k])
                best, share = model.predict(rows) if languages else (None, None)
                for k, text in enumerate(part):
                    sure = bool(languages) and has_letter(text)
                    names.append(languages[best[k]] if sure else UNDECIDED)
                    scores.append(float(share[k]) if sure else 0.0)
            return {"lang_pred": names, "score": scores}

        return handle

    return append_columns(docs, make, "lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    kernel = train(docs, learn=~held & F.col("doc_id").isNotNull())
    found = identified(docs.select("doc_id", "text"), kernel)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
