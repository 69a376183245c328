"""Ranked search, phrases and archives against plain versions of themselves."""

import gzip
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.llm import lexical, phrases, warc

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def brute_search(docs, items, top=10):
    bags = [(k, Counter(TERM.findall(lowered(x)))) for k, x in docs]
    n = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = {}
    for k, x in items:
        terms.setdefault(k, set()).update(TERM.findall(lowered(x)))
    out = []
    for item, own in terms.items():
        scored = []
        for k, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in own if t in bag)
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def test_search_is_that_of_every_document(spark, monkeypatch):
    r = random.Random(4)
    names = [f"w{k}" for k in range(40)] + ["Äpfel", "ö", "x9"]
    docs = [(k, " ".join(r.choice(names) for _ in range(r.randrange(0, 30))), "e") for k in range(300)]
    docs += [(k, "W1 w2, w2", "copy") for k in range(400, 430)] + [(7, docs[3][1], "again"), (7, docs[3][1], "again")]
    docs += [(900, None, "e"), (901, "", "e"), (None, "w1 w2 w2", "e"), (902, "w5 " * 30_000, "long"), (903, "- ! é-É", "e")]
    items = [(k, " ".join(r.choice(names) for _ in range(5)), 1) for k in range(20)]
    items += [(50, None, 1), (51, "", 1), (52, "unknown words", 1), (None, "w1 w2", 1), (3, "w7 x9", 1), (3, "w7 x9", 1)]
    left = spark.createDataFrame(docs, "doc_id long, text string, m string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string, score int")
    want = brute_search([x[:2] for x in docs], [x[:2] for x in items])
    found = sorted(map(tuple, lexical.search(left, right).collect()), key=str)
    assert found == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 150)  # several passes over the documents
    assert sorted(map(tuple, lexical.search(left, right).collect()), key=str) == want
    assert lexical.search(left.limit(0), right).count() == 0
    assert lexical.search(left, right.limit(0)).count() == 0
    assert lexical.search(left, right, top=2).count() < len(want)


def test_search_compares_terms_of_one_hash():
    """Words whose polynomials agree modulo 2^64 are not the same term."""
    one, other = colliding()
    own = lexical.Vocabulary([(1, one.encode())])
    text = lexical.Words([one.encode(), other.encode()], lexical._TABLE)
    assert text.hashes()[0] == text.hashes()[1]
    assert own.found(text)[0].tolist() == [0]


def colliding():
    """Two words of equal hashes: the Thue-Morse word of 2^11 letters and its complement."""
    bits = [k.bit_count() & 1 for k in range(1 << 11)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def brute_phrases(docs, first=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = [x for x in re.split(rb"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for a in range(len(w) - k + 1):
                    f[lang, tuple(w[a : a + k])] += 1
    out = []
    for lang in n:
        own = {p: a for (x, p), a in f.items() if x == lang and a >= 10}
        kept = []
        for p, a in own.items():
            if len(p) == 1 or len(p) == 2 and any(100 * b >= 50 * a for q, b in own.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), left, right))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(kept)[:first])]
    return sorted(out)


def test_phrases_are_those_of_every_run(spark):
    r = random.Random(9)
    names = [b"w%d" % k for k in range(12)]
    docs = []
    for k in range(200):
        text = "".join(r.choice(["w0 W1 ", "w2\tw3  w4 ", "w5, ", r.choice(names).decode() + " ", "é Ünd.", "\n"]) for _ in range(r.randrange(0, 60)))
        docs.append((r.choice(["en", "de", None, "und", "fr"]), text))
    docs += [("en", None), ("en", ""), (None, ".,;"), ("long", "la le " * 20_000), ("x", "one two")] + [docs[0]] * 30
    frame = spark.createDataFrame([(k, t, lang, "x") for k, (lang, t) in enumerate(docs)], "n int, text string, lang string, rank string").repartition(5)
    found = phrases.collocations(frame).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute_phrases(docs)
    assert sorted(map(tuple, found.collect())) == want and len({x[0] for x in want}) >= 4
    few = phrases.collocations(frame, first=2).select("lang", "rank", "phrase")
    assert sorted(map(tuple, few.collect())) == [x[:3] for x in want if x[1] <= 2]
    assert phrases.collocations(frame.limit(0)).count() == 0


def chance_and_sayings(many, sayings=40, common=("the", "the", "of")):
    """Texts of words that meet by chance, of ``common`` ones, and of sayings of rare words."""
    r = random.Random(many)
    docs = []
    for _ in range(many):
        text = " ".join(r.choice([*common, f"w{r.randrange(30)}", f"w{r.randrange(30)}"]) for _ in range(r.randrange(20, 120)))
        saying = r.randrange(sayings)
        docs.append((r.choice(["en", "en", "de", "fr"]), f"{text}. the s{saying} t{saying} u{saying % 7}, s{saying} t{saying} W{saying % 5}"))
    return docs + [("tiny", "one two three. ") for _ in range(12)]


@pytest.mark.parametrize(("scores", "first"), [((300_000, 20_000), 40), ((1_000_000, 500_000, 1), 25), ((2,), 2000)])
def test_phrases_that_cannot_be_among_the_best_change_nothing(spark, monkeypatch, scores, first):
    """Whatever scores are tried, reached by no language, by some or by all."""
    monkeypatch.setattr(phrases, "FEW_WORDS", 50, raising=False)
    monkeypatch.setattr(phrases, "SCORES", scores, raising=False)
    docs = chance_and_sayings(400)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    found = phrases.collocations(frame, first=first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute_phrases(docs, first)


def test_tasks_tell_only_phrases_that_may_be_among_the_best(spark, monkeypatch):
    """Rows of phrases were phrases times tasks."""
    docs = [x for x in chance_and_sayings(1500, 3, ()) if x[0] != "tiny"]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(8)
    phrases_of_all = phrases.phrase_counts(frame)[0].where("words > 1").count()
    rows, real = [], phrases.marked_phrases
    monkeypatch.setattr(phrases, "marked_phrases", lambda *a: rows.append((x := real(*a)).where("words > 1").count()) or x)
    monkeypatch.setattr(phrases, "FEW_WORDS", 50, raising=False)
    monkeypatch.setattr(phrases, "SCORES", (20_000,), raising=False)
    found = phrases.collocations(frame, first=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute_phrases(docs, 3)
    assert sum(rows) < phrases_of_all


def test_lower_bounds_are_those_of_the_smallest_count(spark):
    import numpy as np

    words = [(f"w{k}", 10 + k * k * k) for k in range(3000)]
    table = phrases.low_counts(spark.createDataFrame([("en", w, n) for w, n in words], "lang string, phrase string, f long").repartition(3))
    values, _ = phrases.Runs([w.encode() for w, _ in words], ["en"] * len(words)).of(1)
    low = 2.0 ** (np.max([table[x] for x in phrases.slots(values)], axis=0) / 4)
    many = np.array([n for _, n in words])
    assert (low <= many * (1 + 1e-12)).all() and (low * 1.2 > many).mean() > 0.99


def test_phrases_of_equal_fingerprints_come_apart(spark):
    one, other = colliding()
    docs = [("en", f"{one} x. {other} x")] * 12 + [("en", f"{other} x")] * 3 + [("en", f"{one} x {one}")] * 2
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    found = phrases.collocations(frame).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute_phrases(docs)
    assert {x["a"] for x in found.collect()} == {14, 15}


def test_words_of_equal_hashes_have_other_numbers():
    one, other = colliding()
    text = phrases.Words([f"{one} b {other}".encode(), f"{other} b".encode()], phrases.PIECE_BYTES)
    hashes = text.hashes()
    assert hashes[0] == hashes[2] == hashes[3]
    found = phrases.Numbers().of(text, hashes).tolist()
    assert found[0] != found[2] == found[3] != found[1] == found[4]


def test_groups_of_one_fingerprint_are_split():
    import numpy as np

    key, ids = np.array([5, 3, 5, 5, 3], np.uint64), np.array([[1, 2], [0, 0], [1, 3], [1, 2], [0, 0]], np.int32)
    order, start = phrases.grouped(key, ids)
    groups = [sorted(x.tolist()) for x in np.split(order, start[1:])]
    assert sorted(groups) == [[0, 3], [1, 4], [2]]
    assert [len(x) for x in phrases.grouped(key[:0], ids[:0])] == [0, 0]


LONG = "<p>" + "é" * 600 + "</p>"


def test_archives_give_pages_back(spark, tmp_path):
    odd = "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 60
    pages = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, LONG), (None, "http://a/n", LONG), (4, "u", "short"), (5, "u", "short"), (6, "u\r\nX: y", odd), (7, "u", odd)]
    pages += [(8, "u", None), (9, "u", ""), (3, None, LONG), (10, "u", "x" * 3_000_000), (-11, "ü", LONG[:-1] + "\r\n\r\n")]
    frame = spark.createDataFrame([(*x, "z", 1) for x in pages], "page_id long, url string, html string, revisit string, bytes int").repartition(3)
    found = sorted(map(tuple, warc.archive_report(frame).collect()), key=str)
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None]
        again = len(data) >= 1000 and page != max(same)
        import hashlib

        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert found == sorted(want, key=str)
    assert warc.archive_report(frame.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "a", LONG), (None, "b", LONG)], "page_id long, url string, html string")
    assert [x["record_type"] for x in warc.archive_report(nameless).collect()] == ["response"] * 2
    for compression in ("none", "gzip"):
        folder, second = f"file://{tmp_path}/{compression}", f"file://{tmp_path}/{compression}2"
        warc.write_archives(warc.deduplicated(warc.captures(frame)), folder, "2020-01-01T00:00:00Z", compression, archive_bytes=20_000)
        read = warc.read_archives(spark, folder)
        assert read.where("type = 'response' and declared_digest <> payload_digest").count() == 0
        whole = warc.resolved(read)
        texts = sorted(((x["page_id"], bytes(x["payload"])) for x in whole.collect()), key=str)
        assert texts == sorted(((p, (h or "").encode()) for p, _, h in pages), key=str)
        warc.rewrite(spark, folder, second)
        again = warc.resolved(warc.read_archives(spark, second))
        assert sorted(((x["page_id"], bytes(x["payload"])) for x in again.collect()), key=str) == texts
        assert again.where("type = 'revisit'").count() == sum(x[3] == "revisit" for x in want)
    headers = {x["target_uri"] for x in read.collect()}
    assert "u%0D%0AX: y" in headers and None in headers


def test_archives_of_others(spark, tmp_path):
    """Base-32 digests, other types of records, members of gzip, revisits by digest alone, and what is no record."""
    import base64
    import hashlib

    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    head = "WARC/1.0\r\nWARC-Type: {}\r\nWARC-Payload-Digest: sha1:{}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    block = "HTTP/1.1 200 OK\r\n\r\nbody"
    records = ["WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n", head.format("response", digest, len(block), block)]
    records += [head.format("revisit", digest, 19, "HTTP/1.1 200 OK\r\n\r\n"), head.format("revisit", "A" * 32, 0, ""), head.format("revisit", "x", 0, "")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in records))
    found = warc.resolved(warc.read_archives(spark, str(tmp_path / "a.warc.gz")))
    rows = [(x["type"], bytes(x["payload"]) if x["payload"] is not None else None) for x in found.collect()]
    assert Counter(rows) == Counter([("warcinfo", b"a: b"), ("response", b"body"), ("revisit", b"body"), ("revisit", None), ("revisit", None)])
    for bad in (b"no archive", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", b"WARC/1.1\r\nA: b\r\n\r\n"):
        with pytest.raises(ValueError, match="record at byte 0|no record at byte 0"):
            list(warc.parsed_records(bad))
    assert list(warc.parsed_records(b"")) == []


def test_repeated_payloads_of_many_copies(spark):
    """A third of all rows is one payload."""
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(LONG)).otherwise(F.concat(F.lit(LONG), F.col("id").cast("string"))).alias("html"))
    found = warc.archive_report(rows)
    assert found.where("record_type = 'revisit'").select("refers_to").distinct().collect() == [(2997,)]
    assert found.where("record_type = 'revisit'").count() == 999
