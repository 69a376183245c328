"""Personal data: base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field reads white-space words. A word without a digit or @ can only be outside (its other labels are ruled out),
and an outside word cuts the chain, so that a text falls into independent runs of candidate words; runs of equal
length are decoded together by Viterbi in numpy. A decoded span counts if it has the size and check digits of its kind and
overlaps no base span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import append_columns, fresh_name

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match starts at the first character of a run that can begin one, which is
#: where a leftmost match starts, so that long runs are read once.
EMAIL_END = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_START = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The labelled table: <kind>...</kind> marks a span. {d} stands for a digit, {w} for a word, in each copy another one.
LABELLED = (
    "please write to <email>{w}.{w}@mail{d}.example.com</email> or call <phone>+{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}</phone> today",
    "mail <email>{w}{d}@{w}.org</email>, or <email>{w}_{w}@{w}.{w}.net</email>.",
    "contact: <email>{w}@{w}.co</email> for {w} and {w}",
    "phone: <phone>({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}</phone> or fax {w}",
    "tel <phone>{d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}</phone>, ask for {w}",
    "call <phone>{d}{d}{d} {d}{d}{d} {d}{d}{d}{d}</phone> now",
    "telephone <phone>+{d}{d} {d}{d} {d}{d}{d}{d} {d}{d}{d}{d}</phone> {w} {w}",
    "mobile <phone>{d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}</phone> {w}",
    "{w} {w} <phone>+{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}</phone> {w} {w}",
    "the host <ip>{d}{d}.{d}{d}{d}.{d}.{d}{d}</ip> did not answer",
    "from <ip>{d}{d}{d}.{d}{d}.{d}{d}.{d}</ip>, port {d}{d}{d}{d}",
    "card <card>{d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d}</card> was charged",
    "paid with <card>{d}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}{d}{d}</card> {w}",
    "{w} <card>{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}</card> {w}",
    "in {d}{d}{d}{d} there were {d}{d} of {d}{d}{d} {w}",
    "version {d}.{d}.{d} of {w} came on {d}{d}{d}{d}-{d}{d}-{d}{d}",
    "at {d}{d}:{d}{d} {w} sold {d}{d}{d},{d}{d}{d} for {d}.{d}{d}",
    "order {d}{d}{d}{d}{d}{d} of {d}{d}/{d}{d}/{d}{d}{d}{d} has {d} {w}",
    "pages {d}{d}-{d}{d} and {d}{d}{d}-{d}{d}{d}, chapter {d}",
    "scored {d}{d} {d}{d} {d}{d} {d}{d} {d}{d} in {w}",
    "key {w}{d}{d}{w}{d}{w}{d}{d}{d}{w} and id {d}{d}{d}{d}{d}{d}{d}{d}",
    "follow @{w}{d} and @{w} on {w}",
    "room {d}{d}{d}, {d}{d}{d} {w} street, {d}{d}{d}{d}{d} {w}",
    "{d}{d}{d} {d}{d}{d} {d}{d}{d}{d} {w} sold and {d}{d}{d}-{d}{d}{d} {w}",
)
#: Words before a number that tell its kind.
CUES = {
    "phone": frozenset("phone tel telephone mobile fax call cell".split()),
    "card": frozenset("card visa mastercard credit paid".split()),
    "ip": frozenset("ip host address from server".split()),
    "email": frozenset("mail email e-mail write contact".split()),
}
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_SHAPE = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_RUN = re.compile(r"(x)x+|(X)X+")
_PLAIN = re.compile(r"[^a-z-]")
_WORD = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@]")


def shape(word: str) -> str:
    """Digits as d and letters as x and X, runs of letters as one; long words are cut in the middle."""
    s = _RUN.sub(lambda m: m[0][0], word.strip(",;:!?\"'").rstrip(".").translate(_SHAPE))
    return s if len(s) <= 40 else f"{s[:20]}~{s[-19:]}"


def cue(word: str) -> str:
    plain = _PLAIN.sub("", word.lower())
    return next((k for k, known in CUES.items() if plain in known), "-")


def word_features(own: str, before: str, before_cue: str, after: str) -> tuple[str, ...]:
    short = re.sub(r"d+", lambda m: f"d{min(len(m[0]), 17)}", own)
    digits = own.count("d")
    return (
        f"s={short}", f"b={before_cue}", f"n={digits if digits < 4 else digits // 3 * 3}", f"@={'@' in own}", f"+={own[:1] == '+'}",
        f"p={re.sub(r'd+', 'd', before)}|{re.sub(r'd+', 'd', own)}", f"a={re.sub(r'd+', 'd', own)}|{re.sub(r'd+', 'd', after)}", f"c={before_cue}|{short}",
    )


class Field:
    """Weights of features by label and of label pairs."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs
        self.allowed = np.array([[not (b[0] == "I" and a[2:] != b[2:]) for b in LABELS] for a in LABELS])
        self.start = np.array([0.0 if x[0] != "I" else -1e9 for x in LABELS])
        self.moves = np.where(self.allowed, pairs, -1e9)
        self.memo: dict[tuple, np.ndarray] = {}

    def emission(self, key: tuple[str, str, str, str]) -> np.ndarray:
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            found = np.zeros(len(LABELS))
            for f in word_features(*key):
                found = found + self.weights.get(f, 0.0)
            self.memo[key] = found
        return found

    def viterbi(self, score: np.ndarray) -> np.ndarray:
        """Best labels of a batch of chains of equal length: score is chains x words x labels."""
        n, length, _ = score.shape
        best = score[:, 0] + self.start
        back = np.zeros((length, n, len(LABELS)), np.int8)
        for t in range(1, length):
            way = best[:, :, None] + self.moves
            back[t] = way.argmax(1)
            best = np.take_along_axis(way, back[t][:, None, :].astype(np.int64), 1)[:, 0] + score[:, t]
        out = np.zeros((n, length), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out


def candidates(text: str) -> list[list[tuple[int, int, tuple[str, str, str, str]]]]:
    """Runs of neighbouring words with a digit or @: start, end and what the features are made of."""
    out, last = [], -2
    spans: dict[int, tuple[int, int]] = {}
    at = 0
    while found := _CANDIDATE.search(text, at):
        a = found.start()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        b = _WORD.match(text, a).end()
        spans[a] = (a, b)
        at = b
    ordered = [*spans.values()]
    shapes = [shape(text[a:b]) for a, b in ordered]
    for k, (a, b) in enumerate(ordered):
        gap = text[last:a] if last >= 0 else "?"
        joined = last >= 0 and gap.isspace() and "\n" not in gap
        if joined:
            before, name = shapes[k - 1], "-"
        else:
            left = text[max(0, a - 40) : a].split()
            before, name = "", cue(left[-1]) if left else "-"
            out.append([])
        nextgap = text[b : ordered[k + 1][0]] if k + 1 < len(ordered) else "?"
        after = shapes[k + 1] if nextgap.isspace() and "\n" not in nextgap else ""
        out[-1].append((a, b, (shapes[k], before, name, after)))
        last = b
    return out


def train(table: tuple[str, ...] = LABELLED, copies: int = 6, rounds: int = 60, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
    """Gradient ascent on the log-likelihood of the labelled table, by forward and backward sums."""
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[tuple], list[int]]] = []
    for line in table:
        for _ in range(copies):
            made = re.sub(r"\{d\}", lambda _: str(rng.integers(10)), line)
            made = re.sub(r"\{w\}", lambda _: "".join(rng.choice([*"abcdefghiklmnoprstu"], rng.integers(2, 9))), made)
            text, labels, at = "", [], 0
            for m in re.finditer(r"<(\w+)>(.*?)</\1>", made):
                text += made[at : m.start()]
                labels.append((len(text), len(text) + len(m[2]), m[1]))
                text += m[2]
                at = m.end()
            text += made[at:]
            for chain in candidates(text):
                gold = []
                for a, b, _ in chain:
                    kind = next((x for x in labels if x[0] < b and a < x[1]), None)
                    gold.append(0 if kind is None else LABELS.index(f"{'B' if a <= kind[0] else 'I'}-{kind[2]}"))
                chains.append(([word_features(*key) for _, _, key in chain], gold))
    names = {f: i for i, f in enumerate(sorted({f for words, _ in chains for w in words for f in w}))}
    n_labels = len(LABELS)
    weights, pairs = np.zeros((len(names), n_labels)), np.zeros((n_labels, n_labels))
    by_length: dict[int, list] = defaultdict(list)
    for words, gold in chains:
        by_length[len(gold)].append(([[names[f] for f in w] for w in words], gold))
    field = Field({}, pairs)
    barred = np.where(field.allowed, 0.0, -1e9)
    for step in range(rounds):
        grad_w, grad_p = -decay * len(chains) * weights, -decay * len(chains) * pairs
        for length, group in by_length.items():
            index = np.array([w for w, _ in group])
            gold = np.array([g for _, g in group])
            score = weights[index].sum(2)
            move = pairs + barred
            alpha = [score[:, 0] + field.start]
            for t in range(1, length):
                alpha.append(_logsum(alpha[-1][:, :, None] + move, 1) + score[:, t])
            beta = [np.zeros_like(alpha[0])]
            for t in range(length - 1, 0, -1):
                beta.append(_logsum(move + (score[:, t] + beta[-1])[:, None, :], 2))
            beta = beta[::-1]
            total = _logsum(alpha[-1], 1)
            for t in range(length):
                share = np.exp(alpha[t] + beta[t] - total[:, None])
                diff = np.eye(n_labels)[gold[:, t]] - share
                np.add.at(grad_w, index[:, t], diff[:, None, :])
                if t:
                    both = alpha[t - 1][:, :, None] + move + (score[:, t] + beta[t])[:, None, :] - total[:, None, None]
                    np.add.at(grad_p, (gold[:, t - 1], gold[:, t]), 1.0)
                    grad_p -= np.exp(both).sum(0)
        speed = rate * 20 / len(chains) / (1 + step / rounds)
        weights, pairs = weights + speed * grad_w, pairs + speed * grad_p
    return Field({f: weights[i] for f, i in names.items()}, pairs)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans: leftmost, non-overlapping within a kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        end = EMAIL_END.match(text, at + 1) if a < at else None
        if end:
            out.append(("email", a, end.end()))
            done = end.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


_TRIM = {"email": re.compile(r"[A-Za-z0-9].*[A-Za-z0-9]", re.S), "ip": re.compile(r"[0-9].*[0-9]", re.S), "card": re.compile(r"[0-9].*[0-9]", re.S), "phone": re.compile(r"[(+0-9].*[0-9]", re.S)}
_FORM = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "ip": re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    "card": re.compile(r"[0-9](?:[\s./-]?[0-9]){12,18}"),
    "phone": re.compile(r"\+?(?:\([0-9]+\)|[0-9]+)(?:[\s./-]{0,2}(?:\([0-9]{2,}\)|[0-9]{2,})){1,5}"),
}


#: Least and most digits of a kind.
_DIGITS = {"ip": (4, 12), "card": (13, 19), "phone": (9, 15)}


def accepted(kind: str, text: str, a: int, b: int) -> tuple[str, int, int] | None:
    """The decoded span without outer punctuation, if its form and digits suit the kind."""
    m = _TRIM[kind].search(text, a, b)
    if not m:
        return None
    digits = "".join(c for c in m[0] if c in "0123456789")
    # before the form, so that it is never tried on long runs of digits
    if kind in _DIGITS and not _DIGITS[kind][0] <= len(digits) <= _DIGITS[kind][1]:
        return None
    if not _FORM[kind].fullmatch(m[0]) or kind == "card" and not luhn(digits):
        return None
    if kind == "phone" and "-" not in m[0] and "(" not in m[0] and "+" not in m[0] and "." not in m[0] and " " not in m[0]:
        return None
    if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
        return None
    return kind, *m.span()


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find(texts: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text the base spans and all spans, both by kind and start."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = [base_spans(x) for x in texts]
    by_length: dict[int, list] = defaultdict(list)
    for k, text in enumerate(texts):
        for chain in candidates(text):
            by_length[len(chain)].append((k, chain))
    added: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
    for length, group in by_length.items():
        many = max(1, 200_000 // length)
        for x in range(0, len(group), many):
            part = group[x : x + many]
            labels = field.viterbi(np.array([[field.emission(key) for _, _, key in chain] for _, chain in part]))
            for row in np.flatnonzero(labels.any(1)).tolist():
                k, chain = part[row]
                t = 0
                while t < length:
                    name = LABELS[labels[row, t]]
                    u = t + 1
                    if name[0] == "B":
                        while u < length and LABELS[labels[row, u]] == f"I-{name[2:]}":
                            u += 1
                        if got := accepted(name[2:], texts[k], chain[t][0], chain[u - 1][1]):
                            added[k].append(got)
                    t = u
    out = []
    for k, own in enumerate(base):
        own.sort(key=lambda s: (order[s[0]], s[1]))
        more = []
        if k in added:
            taken = disjoint([(a, b) for _, a, b in own])
            ends = [b for _, b in taken]
            for s in added[k]:
                at = bisect_right(ends, s[1])  # the first that ends behind its start
                if at == len(taken) or taken[at][0] >= s[2]:
                    more.append(s)
        out.append((own, sorted(own + more, key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


FOUND = "base array<struct<kind string, start long, end long>>, spans array<struct<kind string, start long, end long>>"


def _trained(docs: DataFrame):
    field = train()
    return docs.sparkSession.sparkContext.broadcast((field.weights, field.pairs))


def personal_data(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with base and spans (base ones and those that the field adds), in code points.

    Null and empty texts have none; repeated rows give equal spans. One narrow pass; the field's weights are small.
    """
    known = _trained(docs)

    def make():
        field = Field(*known.value)

        def handle(block):
            found = find([x.decode("utf-8", "replace") for x in block], field)
            rows = lambda k: [[{"kind": a, "start": b, "end": c} for a, b, c in x[k]] for x in found]
            return {"base": rows(0), "spans": rows(1)}

        return handle

    return append_columns(docs, make, FOUND)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind, of overlapping ones the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in its text replaced by its kind in angle brackets, overlapping spans as one; of a changed
    text, n_chars (if there) is counted anew. Null texts stay null."""
    known = _trained(docs)
    names, made = docs.columns, fresh_name(docs, "masked")

    def make():
        field = Field(*known.value)

        def handle(block):
            texts = [x.decode("utf-8", "replace") for x in block]
            return {made: [mask(x, spans) if spans else None for x, (_, spans) in zip(texts, find(texts, field), strict=True)]}

        return handle

    found = append_columns(docs, make, f"`{made}` string")
    if "n_chars" in names:
        size = F.length(made).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.coalesce(size, "n_chars"))
    return found.withColumn("text", F.coalesce(made, "text")).select(*[F.col(f"`{c}`") for c in names])


def personal_data_report(docs: DataFrame) -> DataFrame:
    found = personal_data(docs.select("doc_id", "text"))
    written_as = lambda column: F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(written_as("base"), 256).alias("base_sha256"),
        written_as("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
