"""Single texts on which work must stay linear, with equal results to plain versions."""

import random
import resource
import time

from cuelake.llm import decontam, htmltext, pii


class bounded:
    """Fails beyond so many seconds, or MB of memory above what the process has had so far."""

    def __init__(self, seconds=8.0, mb=400):
        self.seconds, self.mb = seconds, mb

    def __enter__(self):
        self.start, self.peak = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    def __exit__(self, *failed):
        if not failed[0]:
            assert time.perf_counter() - self.start < self.seconds
            assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - self.peak) / 1024 < self.mb


def test_pages_of_deep_nesting():
    n = 200_000
    for page in ("<div>" * n + "text", "<div>a" * n, "<div>" * n + "</section>" * n, "<section>a</p>" * n, "<p x>" * n, "<article><div class='sidebar'>" * (n // 2) + "</article>"):
        with bounded(25.0):
            htmltext.main_text(page)
    deep = "<div>" * 5000 + "<article><p>This is the one text of the page, and it is long enough to be read as the main part of it.</p></article>" + "</div>" * 5000
    assert htmltext.main_text(deep).startswith("This is the one text")


def plain_hits(doc, item):
    n = min(10, len(item))
    windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)}
    hit = set()
    for k in range(len(doc) - n + 1):
        if tuple(doc[k : k + n]) in windows:
            hit |= set(range(k, k + n))
    return hit


def test_periodic_texts_against_periodic_items():
    item = " ".join(["na", "no", "ni"][k % 3] for k in range(2000))
    doc = " ".join(["na", "no", "ni"][k % 3] for k in range(20_000))
    with bounded():
        index = decontam.Index([("i", item.encode()), ("j", b"na no ni na")])
        (n, spans, items), (_, none, _) = index.scan([doc.encode(), b"other words"])
    assert (n, spans, items, none) == (20_000, [[0, 20_000]], ["i", "j"], [])
    r = random.Random(6)
    for _ in range(30):
        make = lambda n: [r.choice("ab") if r.random() < 0.1 else "abc"[k % r.choice((1, 2, 3))] for k in range(n)]
        items, docs = [make(r.choice((3, 9, 10, 11, 40))) for _ in range(4)], [make(r.choice((0, 5, 10, 60))) for _ in range(4)]
        index = decontam.Index([(str(k), " ".join(x).encode()) for k, x in enumerate(items)])
        for text, (_, spans, found) in zip(docs, index.scan([" ".join(x).encode() for x in docs]), strict=True):
            own = [plain_hits(text, x) for x in items]
            assert {p for a, b in spans for p in range(a, b)} == set().union(*own)
            assert found == [str(k) for k, x in enumerate(own) if x]


def test_texts_of_very_many_spans():
    field = pii.train()
    text = " ".join(f"a{k}@b.example.com call 555-12{k % 10}-{1000 + k % 9000}" for k in range(50_000))
    with bounded(60.0, 900):
        (base, spans), = pii.find([text], field)
    assert len(base) >= 50_000 and len(spans) > len(base)


def test_spans_that_touch_or_overlap():
    assert pii.disjoint([(5, 9), (0, 2), (2, 3), (4, 6), (20, 30), (22, 25)]) == [(0, 2), (2, 3), (4, 9), (20, 30)]


def test_long_spans_are_kept():
    long = "x" * 400 + "@" + "y" * 50 + ".org"
    assert pii.accepted("email", f"({long})", 0, len(long) + 2) == ("email", 1, len(long) + 1)
    with bounded(2.0):
        assert pii.accepted("phone", "1" * 100_000, 0, 100_000) is None
        assert pii.accepted("card", "1 " * 100_000, 0, 200_000) is None
