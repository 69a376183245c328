"""SentencePiece encoding by unigram Viterbi over a double-array trie of pieces, and decoding.

A text is encoded as written: a whitespace marker is put before it and for every space, and the best-scored split
into pieces is taken (of equal scores, the split whose last piece starts first, as SentencePiece has it). A character that
no piece covers costs the smallest score less 10 and becomes its UTF-8 bytes' pieces. A literal marker character is
always encoded as bytes, so that decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Split words of which the encoding is remembered within a task.
REMEMBERED = 250_000
#: Text encoded at once, in bytes.
ENCODED_BYTES = 1_000_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a serialised SentencePiece model: field 1 of it, fields 1 to 3 of each."""

    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                size = varint() if kind == 2 else 4 if kind == 5 else 8
                yield tag >> 3, data[at : at + size]
                at += size

    out = []
    for number, value in fields(model):
        if number == 1:
            piece = dict(fields(value))
            out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, 1)))
    return out


class DoubleArray:
    """A trie in two arrays: the child of s by byte c is base[s] + c if check there is s; value[s] is a piece's id."""

    def __init__(self, base: list[int], check: list[int], value: list[int]):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def of(cls, entries: dict[bytes, int]) -> DoubleArray:
        tree: dict = {}
        for key, number in entries.items():
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = number
        size = 1 << 16
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        hole = tail = 256  # the first free place, and one beyond all used ones; any byte may come first there
        todo = [(0, tree)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            children = sorted(c for c in node if c >= 0)
            if not children:
                continue
            if tail + 600 > len(check):
                more = len(check)
                base += [0] * more
                check += [-1] * more
                value += [-1] * more
            while check[hole] >= 0:
                hole += 1
            first = children[0]
            spot = next(
                (p - first for p in range(hole, min(hole + 64, tail)) if all(check[p - first + c] < 0 for c in children)),
                max(hole, tail) - first,
            )
            base[state] = spot
            for c in children:
                check[spot + c] = state
            tail = max(tail, spot + children[-1] + 1)
            todo += [(spot + c, node[c]) for c in children]
        return cls(base, check, value)


class Model:
    """Pieces, their trie, and the split of texts into runs that can be encoded one by one."""

    def __init__(self, pieces: list[tuple[str, float, int]], arrays: list[np.ndarray] | None = None):
        self.pieces = pieces
        usable = {p.encode(): i for i, (p, _, kind) in reversed([*enumerate(pieces)]) if kind in (1, 4) and p}
        self.trie = DoubleArray(*(x.tolist() for x in arrays)) if arrays else DoubleArray.of(usable)
        self.score = [s for _, s, _ in pieces]
        self.unknown = min((self.score[i] for i in usable.values()), default=0.0) - UNKNOWN_PENALTY
        by_name = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte = [by_name.get(f"<0x{k:02X}>") for k in range(256)]
        self.no_bytes = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.byte_of = {i: k for k, i in enumerate(self.byte) if i is not None}
        self.plain = [
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if kind in (2, 3) else p.replace(MARKER, " ").encode()
            for i, (p, _, kind) in enumerate(pieces)
        ]
        long = [p for p in (x.decode() for x in usable) if len(p) > 1]
        # a marker after another character never lies inside a piece: words are independent
        self.by_word = not any(MARKER in p.lstrip(MARKER) for p in long)
        inside = {c for p in long for c in p}
        lone = MARKER + "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside and c != 32)
        self.runs = re.compile(f"[{lone}]| +[^ {lone}]*|[^ {lone}]+" if self.by_word else f"{MARKER}|[^{MARKER}]+")
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.arrays = [np.r_[x, np.full(256, fill, np.int32)] for x, fill in zip(self.arrays, (0, -1, -1), strict=True)]
        self.scores = np.array([*self.score, self.unknown])
        self.forget()

    def forget(self) -> None:
        """Remembered runs: their number, and by number the first place and count of their ids, and their scores."""
        self.number: dict[str, int] = {}
        self.first, self.count, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.flat = np.zeros(0, np.int32)

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids and the sum of their scores. An empty text has none."""
        ids, _, total = self.encode_all([text])
        return ids.tolist(), float(total[0])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in turn, how many each has, and the sum of the scores of each."""
        split = [self.runs.findall(" " + x) if x else [] for x in texts]
        runs = [*chain.from_iterable(split)]
        found = [*map(self.number.get, runs)]
        missing = dict.fromkeys(x for x, k in zip(runs, found, strict=True) if k is None)
        if missing:
            if len(self.number) + len(missing) > REMEMBERED:
                self.forget()
                missing = dict.fromkeys(runs)
            new = sorted(missing, key=len)
            for k in range(0, len(new), 8192):
                self.learn(new[k : k + 8192])
            found = [*map(self.number.__getitem__, runs)]
        at = np.array(found, np.int64)
        size = self.count[at]
        total = np.cumsum(size)
        ids = self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(self.first[at] - (total - size), size)]
        end = np.cumsum([len(x) for x in split], dtype=np.int64)
        bounds = np.r_[0, total][np.r_[0, end]]
        scores = np.diff(np.r_[0, np.cumsum(self.sums[at])][np.r_[0, end]])
        return ids, np.diff(bounds), np.round(scores, 3)

    def learn(self, runs: list[str]) -> None:
        """Viterbi over many runs at once. All pieces at all places are found first, depth by depth of the trie;
        then every place of a run, in order, passes its best score on along its pieces."""
        raw = [x.replace(" ", MARKER).encode() for x in runs]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(size + 1) - size - 1
        data = np.frombuffer(b"\0".join([*raw, b""]), np.uint8)
        base, check, value = self.arrays
        place = np.repeat(begin, size) + (inside := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        left = np.repeat(size, size) - inside
        lead = data[place]
        head = lead & 0xC0 != 0x80
        place, inside, left, lead = place[head], inside[head], left[head], lead[head]
        wide = np.where(lead < 128, 1, np.where(lead < 224, 2, np.where(lead < 240, 3, 4)))
        live, state, depth = np.arange(len(place)), np.zeros(len(place), np.int32), 0
        alone = np.zeros(len(place), bool)
        arcs = []
        while len(live):
            step = base[state] + data[place[live] + depth]
            depth += 1
            ok = (check[step] == state) & (step > 0)
            live, state = live[ok], step[ok]
            hit = value[state] >= 0
            mine = live[hit]
            arcs.append((mine, np.full(len(mine), depth), value[state[hit]]))
            alone[mine[wide[mine] == depth]] = True
            more = left[live] > depth
            live, state = live[more], state[more]
        lost = np.flatnonzero(~alone)
        arcs.append((lost, wide[lost], np.full(len(lost), -1, np.int32)))
        source, length, piece = map(np.concatenate, zip(*arcs, strict=True))
        order = np.argsort(inside[source], kind="stable")
        source, length, piece = source[order], length[order], piece[order]
        cuts = np.searchsorted(inside[source], np.arange(int(size.max(initial=0)) + 1))
        start = place[source]
        end, score = start + length, self.scores[piece]
        best = np.full(len(data) + 1, -np.inf)
        best[begin] = 0
        by = np.full(len(data) + 1, -1, np.int64)
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                new, to = best[start[x:y]] + score[x:y], end[x:y]
                better = np.flatnonzero(new > best[to])
                best[to[better]] = new[better]
                by[to[better]] = x + better
        at, trail = begin + size, []
        many = np.zeros(len(raw), np.int64)
        while len(rows := np.flatnonzero(at > begin)):
            arc = by[at[rows]]
            trail.append((rows, many[rows].copy(), arc))
            many[rows] += 1
            at[rows] = start[arc]
        total = np.cumsum(many)
        flat = np.zeros(total[-1], np.int32)
        for rows, back, arc in trail:
            flat[total[rows] - 1 - back] = piece[arc]
        odd = np.unique(np.repeat(np.arange(len(raw)), many)[flat < 0])
        odd = sorted({*odd.tolist(), *(k for k, x in enumerate(runs) if x == MARKER)})
        sums = best[begin + size]
        first = total - many
        if odd:
            extra = []
            for k in odd:
                ids = []
                for which, arc in sorted((int(start[a]), int(a)) for a in self._arcs(k, by, start, begin, size)):
                    ids += [int(piece[arc])] if piece[arc] >= 0 else self.bytes_of(data[which : int(end[arc])].tobytes())
                if runs[k] == MARKER:
                    ids, sums[k] = self.bytes_of(raw[k]), self.unknown
                first[k], many[k] = len(flat) + len(extra), len(ids)
                extra += ids
            flat = np.r_[flat, np.array(extra, np.int32)]
        self.number.update(zip(runs, range(len(self.first), len(self.first) + len(runs)), strict=True))
        self.first = np.r_[self.first, first + len(self.flat)]
        self.count, self.sums, self.flat = np.r_[self.count, many], np.r_[self.sums, sums], np.r_[self.flat, flat]

    @staticmethod
    def _arcs(k, by, start, begin, size):
        at = int(begin[k] + size[k])
        while at > begin[k]:
            yield by[at]
            at = int(start[by[at]])

    def bytes_of(self, raw: bytes) -> list[int]:
        return [self.no_bytes if self.byte[b] is None else self.byte[b] for b in raw]

    def decode(self, ids: list[int]) -> str:
        """Bytes of byte pieces and characters of the others, markers as spaces, without the first one."""
        data = b"".join(map(self.plain.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


_models: dict[str, Model] = {}


def load(spark, path: str):
    """A function that gives the model inside a task. The file is read by Spark, its trie built once, and both are
    broadcast: about a megabyte, whatever the corpus. A Python worker keeps one model."""
    file = spark.read.format("binaryFile").load(path if ":" in path else f"file://{path}").select("content").first()
    raw = bytes(file.content)
    pieces = read_pieces(raw)
    trie = Model(pieces).trie
    arrays = [np.array(x, np.int32) for x in (trie.base, trie.check, trie.value)]
    known = spark.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), pieces, arrays))

    def model() -> Model:
        name, found, packed = known.value
        if name not in _models:
            _models.clear()
            _models[name] = Model(found, packed)
        return _models[name]

    return model


def encode(docs: DataFrame, path: str = DEFAULT_MODEL, check: bool = False) -> DataFrame:
    """All columns of ``docs`` with ids (array<int>) and piece_score, the sum of the pieces' scores; with ``check``
    also decoded, the text of the ids as ``decode`` gives it, made in the same pass.

    A null or empty text has no ids and a score of 0; repeated rows give equal ids. One narrow pass.
    """
    model = load(docs.sparkSession, path)

    def make():
        machine = model()

        def handle(block):
            ids, many, total = machine.encode_all([x.decode("utf-8", "replace") for x in block])
            bounds = np.r_[0, np.cumsum(many)]
            found = {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), "piece_score": total}
            if check:
                found["decoded"] = [machine.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return found

        return handle

    added = "ids array<int>, piece_score double" + ", decoded string" * check
    return append_columns(docs, make, added, most=ENCODED_BYTES)


def decode(encoded: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """All columns and ``decoded``, the text of the column ids; null ids give an empty text."""
    model = load(encoded.sparkSession, path)
    encoded = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["decoded string"])
    at = encoded.columns.index("ids")

    def run(batches):
        machine = model()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [machine.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, full)


def round_trip_report(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_pieces, piece_score, ids_sha256 (of the ids, comma-joined) and whether decoding gives the text back."""
    found = encode(docs.select("doc_id", "text"), path, check=True)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "piece_score",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
