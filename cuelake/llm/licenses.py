"""Licence scan: a generalised suffix automaton of licence wordings, streamed over the words of each text.

The automaton holds every substring of all templates. Reading a text word by word gives its matching
statistics: the longest template substring that ends at each word. Matches that cannot be extended to the right
are chained, template by template, into covered spans; a span that covers enough of its template names a licence.
The three base phrases are templates of their own whose every place is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import map_rows, text_bytes, words

#: Phrase and label of the base rules.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Wordings of common licence notices and the label that each gives.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Shortest match in words that enters a chain, and the covered share of a template that names its licence.
MIN_MATCH, MIN_COVER = 2, 0.8

SPANS = (
    "doc_id long, n_words long, base array<struct<label string, start long>>, "
    "spans array<struct<label string, start long, end long, cover double>>"
)


class Automaton:
    """Generalised suffix automaton over word ids, with end positions and the base phrases that end in a state."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], phrases: list[tuple[str, list[bytes]]]):
        self.labels = [x for x, _ in templates]
        self.lengths = [len(w) for _, w in templates]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, (_, sequence) in enumerate([*templates, *phrases]):
            last = 0
            for pos, word in enumerate(sequence):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), ends)
                if k < len(templates):
                    ends[last].add((k, pos))
        order = sorted(range(1, len(self.len)), key=lambda s: -self.len[s])
        for s in order:
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(x) for x in ends]
        own: dict[int, list[tuple[str, int]]] = {}
        for label, sequence in phrases:
            s = 0
            for word in sequence:
                s = self.next[s][self.ids[word]]
            own.setdefault(s, []).append((label, len(sequence)))
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in self.len]
        for s in reversed(order):
            self.phrases[s] = own.get(s, []) + self.phrases[self.link[s]]

    def _extend(self, last: int, c: int, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q, ends)
        new = self._state(length[last] + 1, {}, 0, ends)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q, ends)
        return new

    def _state(self, length: int, following: dict, link: int, ends: list) -> int:
        self.next.append(following)
        self.len.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int, ends: list) -> int:
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def scan(self, sequence: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
        """Places of base phrases as (label, start), and the right-maximal matches as (end, length, state)."""
        nxt, link, length, phrases = self.next, self.link, self.len, self.phrases
        base, found = [], []
        state = size = 0
        at = -2
        for i, c in [(i, c) for i, c in enumerate(map(self.ids.get, sequence)) if c is not None]:
            if i != at + 1:
                if size >= MIN_MATCH:
                    found.append((at, size, state))
                state = size = 0
            elif c not in nxt[state]:
                if size >= MIN_MATCH:
                    found.append((at, size, state))
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
            state = nxt[state][c]
            size += 1
            at = i
            for label, n in phrases[state]:
                if size >= n:
                    base.append((label, i - n + 1))
        if size >= MIN_MATCH:
            found.append((at, size, state))
        return base, found

    def spans(self, found: list[tuple[int, int, int]]) -> list[dict]:
        """Chain matches, in text order, that move forward in the same template and lie at most a template's
        length apart; a chain that covers MIN_COVER of its template is a span."""
        open_: dict[int, list[int]] = {}
        out = []

        def close(k: int) -> None:
            start, end, _, covered = open_.pop(k)
            if covered >= MIN_COVER * self.lengths[k]:
                out.append({"label": self.labels[k], "start": start, "end": end, "cover": covered / self.lengths[k]})

        for at, size, state in found:
            best: dict[int, int] = {}
            for k, pos in self.ends[state]:
                chain = open_.get(k)
                ahead = chain is not None and pos > chain[2]
                if k not in best or ahead and not (chain is not None and best[k] > chain[2]):
                    best[k] = pos
            for k, pos in best.items():
                chain = open_.get(k)
                if chain is not None and pos > chain[2] and at - size + 1 - chain[1] <= self.lengths[k]:
                    new = min(size, pos - chain[2], at + 1 - chain[1])
                    open_[k] = [chain[0], at + 1, pos, chain[3] + new]
                else:
                    if chain is not None:
                        if chain[3] < MIN_COVER * self.lengths[k] and chain[3] > size and at < chain[1]:
                            continue
                        close(k)
                    open_[k] = [at - size + 1, at + 1, pos, size]
        for k in list(open_):
            close(k)
        return sorted(out, key=lambda x: (x["start"], x["end"], x["label"]))


def automaton(extra: tuple[tuple[str, str], ...] = ()) -> Automaton:
    return Automaton(
        [(label, words(text.encode())) for label, text in [*TEMPLATES, *extra]],
        [(label, words(text.encode())) for text, label in BASE_PHRASES.items()],
    )


def license_spans(docs: DataFrame, extra: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """One row a document: its number of words, every place of a base phrase, and the covered template spans.

    A null or empty text has no words and no spans; a null doc_id is kept; repeated rows give repeated rows;
    other columns are not read. ``extra``: further (label, wording) templates. One narrow pass, no shuffle.
    """

    def make():
        machine = automaton(extra)

        def handle(row):
            sequence = words(row["text"])
            base, found = machine.scan(sequence)
            yield {
                "doc_id": row["doc_id"],
                "n_words": len(sequence),
                "base": [{"label": label, "start": start} for label, start in base],
                "spans": machine.spans(found) if found else [],
            }

        return handle

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_bytes()), make, SPANS)


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of ``license_spans``: counts, first and last base place, labels and the best cover."""
    spans = license_spans(docs)
    names = lambda column: F.transform(column, lambda x: x["label"])
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(column)), ",")
    starts = F.transform("base", lambda x: x["start"])
    return spans.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("base")).alias("base_labels"),
        joined(F.concat(names("base"), names("spans"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0)
        .otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x["cover"])), F.lit(0.0))))
        .alias("score"),
    )
