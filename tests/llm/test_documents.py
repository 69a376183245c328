"""Every operator on documents: brute force on small fixtures, and nulls, empty, long, equal and extra-column rows."""

import hashlib
import math
import random
import re

import pytest
import xxhash

from cuelake.llm import decontam, language, licenses, pii, quality, repeats, simhash, unigram
from cuelake.llm.common import components

WORDS = "the of thand erly ont né wh in ing license cc by general public all rights reserved".split()
LOWER = {i: i + 32 for i in range(65, 91)}
RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    made = [line(r.randint(1, 60)) for _ in range(25)]
    made += ["", None, " \n\t ", "x" * 5000, line(9000), "Released under the MIT License.", "CC BY-NC 4.0 CC by", "GNU General Public License", made[3], made[3]]
    made += ["mail a.b@c.de +1 (555) 123-4567 at 10.0.0.1 or 4111 1111 1111 1111", "١٢٣ ünï ▁▁ \u0000 🙂", "12345 !!"]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, x, "en", k, 9.5, "clash") for k, x in enumerate(texts())]
    rows += [(None, "no id", None, None, None, None), (7, texts()[7], "en", 7, 9.5, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, score double, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_license_places_are_those_of_a_plain_scan(docs, empty):
    found = {r["doc_id"]: r for r in licenses.license_report(docs).collect() if r["doc_id"] is not None}
    for k, text in enumerate(texts()):
        words = RULE.findall((text or "").translate(LOWER))
        places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        row = found[k]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert row["first_word"] == min((i for i, _ in places), default=None)
        assert row["last_word"] == max((i for i, _ in places), default=None)
        assert row["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1
    mit = next(k for k, x in enumerate(texts()) if x and "MIT" in x)
    assert found[mit]["labels"] == "mit"
    assert licenses.license_report(empty).count() == 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    return [find(x) for x in range(len(prints))]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_are_those_of_all_pairs(spark, docs, empty):
    r = random.Random(1)
    base = " ".join(f"w{r.randint(0, 400)}" for _ in range(700)).split()
    near = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(0, 600, 20)]
    all_texts = texts() + near
    rows = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string").repartition(3)
    found = {x["doc_id"]: x for x in simhash.near_duplicate_report(rows).collect()}
    prints = [plain_fingerprint(x) for x in all_texts]
    assert [int(found[k]["fingerprint"], 16) for k in range(len(prints))] == prints
    root = brute_components(prints)
    for k, x in enumerate(root):
        assert found[k]["component_id"] == min(i for i, y in enumerate(root) if y == x)
    assert simhash.near_duplicate_report(docs).count() == docs.count()
    assert simhash.near_duplicate_report(empty).count() == 0


def test_every_link_shares_a_key(spark):
    r = random.Random(9)
    prints = []
    for _ in range(60):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), r.randint(1, 4)):
            y ^= 1 << bit
        prints += [x, y]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {tuple(sorted((a, b))) for a, b in simhash.links(fps).select("a", "b").collect()}
    assert {tuple(sorted(map(signed, prints[k : k + 2]))) for k in range(0, len(prints), 2)} <= found


@pytest.mark.parametrize("most", [1, 3, simhash.HOT_KEY])
def test_hot_keys_are_linked_by_midpoints(spark, most):
    r = random.Random(2)
    centre = r.getrandbits(63)
    prints = {centre}
    for _ in range(150):
        x = centre
        for bit in r.sample(range(62), r.randint(1, 5)):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    fps = spark.createDataFrame([(x,) for x in prints], "fp long").repartition(3)
    tree = {x["node"]: x["root"] for x in components(simhash.links(fps, most)).collect()}
    root = brute_components(prints)
    for k, x in enumerate(root):
        same = [i for i, y in enumerate(root) if y == x]
        assert tree.get(prints[k], prints[k]) == prints[min(same)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901)], "a long, b long")
    found = dict(components(edges).collect())
    assert {found[k] for k in range(1, 201)} == {0} and found[901] == 900
    assert components(edges.limit(0)).count() == 0


def test_very_many_languages_keep_what_goes_to_tasks_small():
    """Landmarks stay bounded, both forms of a kernel give equal values, and languages are told apart."""
    import numpy as np

    from cuelake.llm import language

    r = random.Random(8)
    many = 700
    own = {f"l{k}": "".join(chr(r.randrange(0x100, 0x3000)) for _ in range(60)) for k in range(many)}
    labels, texts = [], []
    for name, letters in own.items():
        for _ in range(4):
            labels.append(name)
            texts.append("".join(r.choice(letters) for _ in range(120)).encode())
    order = list(range(len(labels)))
    r.shuffle(order)
    rows = np.zeros((len(texts), language.SLOTS), np.uint8)
    for n, k in enumerate(order):
        language.presence(texts[k], rows[n])
    packed, labels = np.packbits(rows, axis=1), [labels[k] for k in order]
    model = language.Kernel.fit(packed, labels)
    assert model.marks.shape == (language.ALL_LANDMARKS, language.SLOTS // 8) and model.matrix.shape == (language.ALL_LANDMARKS, many)
    best, share = model.predict(rows[:200].astype(np.float32))
    assert np.mean([model.languages[b] == x for b, x in zip(best, labels, strict=False)]) > 0.7 and (share <= 1).all()
    whole = language.Kernel(model.languages, (language.unit(model.marks).T @ model.matrix).astype(np.float32))
    assert (whole.predict(rows[:50].astype(np.float32))[0] == best[:50]).mean() > 0.95


@pytest.mark.parametrize(("hot", "whole"), [(32, False), (2, False), (32, True)])
def test_near_copies_are_those_of_all_shingle_sets(spark, monkeypatch, hot, whole):
    from cuelake.llm import neardup

    monkeypatch.setattr(neardup, "HOT_KEY", hot)
    monkeypatch.setattr(neardup, "BLOCK", 2 if hot == 2 else 512)
    if whole:  # as if a set had too few shingles in its part
        monkeypatch.setattr(neardup, "lacking", lambda prints: prints)
    r = random.Random(12)
    line = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    made, shared = [], line(60)
    for k in range(18):
        base = line(r.choice((40, 150, 400, 262, 520))) + (shared if k % 2 else [])
        for _ in range(5):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(0, max(1, len(copy) // 25))):
                copy[at] = f"z{r.randint(0, 9)}"
            made.append(" ".join(copy))
    made += ["", None, " \n", "A b c", "a  b c", "a b d", "x", made[0], made[0].upper()]
    sets = []
    for x in made:
        w = (x or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                root = [root[b] if x == root[a] else x for x in root]
    want = sorted(min(i for i, y in enumerate(root) if y == x) for x in set(root))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in neardup.one_of_each(rows).collect()) == want
    fps = [plain_fingerprint(x) for x in made]
    assert any((fps[a] ^ fps[b]).bit_count() > 4 and 9 * len(sets[a] & sets[b]) >= 4 * len(sets[a]) + 4 * len(sets[b]) for a in range(70) for b in range(a))


def test_sets_that_lack_shingles_in_their_part(spark):
    from cuelake.llm import neardup

    rows = [(1, 300, 150, 0), (2, 300, 60, 0), (3, 300, 61, 0), (4, 300, 150, 60), (5, 10, 10, 0), (6, 0, 0, 0), (7, 1, 1, 0)]
    frame = spark.createDataFrame(rows, "id long, size long, own long, below long")
    assert sorted(x["id"] for x in neardup.lacking(frame).collect()) == [2, 4]
    assert neardup.needed(300) == 61 and neardup.bounds(300, True) == (2**64, 0)


def test_squares_hold_every_pair_once(spark):
    from cuelake.llm import neardup

    r = random.Random(3)
    rows = [(k, i, 40 << 32, r.choice([1, 2, i])) for k in range(3) for i in r.sample(range(200), 50)]
    frame = spark.createDataFrame(rows + rows[:5], "key long, id long, at long, root long").repartition(3)
    near = spark.createDataFrame([(i, bytes(8) if i < 180 else b"\xff" * 8) for i in range(200)], "id long, parity binary")
    want = set()
    for k, i, _, x in rows:
        want |= {(min(i, j), max(i, j)) for n, j, _, y in rows if n == k and x != y and i != j and (i < 180) == (j < 180)}
    for block in (4, 16, 512):
        found = neardup.squares(frame, near, block).collect()
        assert {(min(x), max(x)) for x in map(tuple, found)} == want


def test_parities_never_differ_by_more_than_the_sets():
    import numpy as np

    from cuelake.llm import neardup

    r = np.random.default_rng(2)
    for n in (0, 1, 5, 31, 32, 33, 100, 700):
        for m in (0, 1, 8, 40, 90, 900):
            x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.r_[x[: min(n, m) // 2], r.integers(0, 1 << 63, m).astype(np.uint64)])
            assert neardup.apart(neardup.parity(x), neardup.parity(y)) <= len(np.setxor1d(x, y))
            assert neardup.apart(neardup.parity(x), neardup.parity(x)) == 0


def plain_hits(text, items):
    words = RULE.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, wanted in items:
        own = RULE.findall((wanted or "").translate(LOWER))
        n = min(10, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_contamination_is_that_of_all_windows(spark, docs, limit):
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(30)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(r.choice((3, 9, 10, 25))))) for k in range(12)] + [(12, None), (13, "!!"), (14, "v1"), (115, "v2 v3 V4")]
    made = [" ".join(line(30) + items[k % 12][1].split()[: r.randint(5, 25)] + line(20)) for k in range(30)] + ["", None, "v1", "v2, v3; v4!"]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(rows, bench, limit)
    for x in found.collect():
        hit = sum(s["end"] - s["start"] for s in x["spans"])
        ids = hashlib.sha256(",".join(x["items"]).encode()).hexdigest()
        assert (x["n_words"], hit, len(x["items"]), ids) == plain_hits(made[x["doc_id"]], items), x["doc_id"]
    assert decontam.contamination(docs, bench, limit).count() == docs.count()
    assert decontam.contamination(docs, bench.limit(0), limit).where("size(spans) > 0").count() == 0


def test_both_ways_of_contamination_agree_in_all_columns(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (2, "né wh in"), (None, "thand"), (3, texts()[4])], "item_id long, text string")
    names = "text_key", "_text_key", "known_words", "found_spans", "fp", "Items"
    rows = docs.selectExpr("*", *[f"'{n}' {n}" for n in names])
    ways = [decontam.contamination(rows, bench, limit) for limit in (decontam.BROADCAST_BYTES, 0)]
    assert ways[0].columns == ways[1].columns
    shown = [sorted(str(x.asDict(True)) for x in way.collect()) for way in ways]
    assert shown[0] == shown[1] and any("start" in x for x in shown[0])


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_contamination_of_periodic_texts_and_null_items(spark, limit):
    r = random.Random(7)
    cycle = lambda k, n: " ".join(f"p{k}w{j % k}" for j in range(n))
    lines = [" ".join(f"u{r.randint(0, 99)}" for _ in range(n)) for n in (10, 14, 30)]
    items = [(k, cycle(k, 10 + 3 * k)) for k in range(1, 7)] + [(20, "na " * 10), (None, lines[0]), (None, lines[1]), (21, lines[1]), (22, lines[2])]
    made = [x for k in range(1, 7) for x in [cycle(k, 100)] * 2 + [cycle(k, 9), "a b " + cycle(k, 40) + " c " + cycle(k, 11)]]
    made += ["na " * 100, "na " * 100, "na " * 9, lines[0], f"x {lines[1]} y", "na " * 30 + lines[2], lines[2] + " na" * 12, None]
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(rows, bench, limit).collect()
    assert len(found) == len(made)
    for x in found:
        hit = sum(s["end"] - s["start"] for s in x["spans"])
        ids = hashlib.sha256(",".join(str(i) for i in x["items"]).encode()).hexdigest()
        assert (x["n_words"], hit, len(x["items"]), ids) == plain_hits(made[x["doc_id"]], items), x["doc_id"]


def test_quality_learns_and_scores_every_row(spark, docs, empty):
    r = random.Random(4)
    good = [" ".join(r.choice(WORDS) for _ in range(80)) + "." for _ in range(60)]
    bad = [" ".join(f"{r.choice(WORDS)}&&&" for _ in range(80)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    found = quality.quality_report(rows, labels).collect()
    held = [x for x in found if x["held_out"]]
    assert len(found) == 120 and held
    assert sum((x["predicted"] == 1) == (x["doc_id"] < 60) for x in held) >= 0.9 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in found)
    assert quality.quality_report(docs, labels).count() == docs.count()
    assert quality.quality_report(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert quality.quality_report(empty, labels).count() == 0


def test_factorisation_machine_equals_the_sum_over_pairs():
    import numpy as np

    machine = quality.Machine()
    machine.weights[:] = np.random.default_rng(0).normal(0, 0.1, machine.weights.shape)
    slots, values = quality.features(b"some words, and some more WORDS.\nanother line")
    w, v = machine.weights[slots, 0], machine.weights[slots, 1:]
    total = machine.bias + (w * values).sum() + sum(v[a] @ v[b] * values[a] * values[b] for a in range(len(slots)) for b in range(a))
    assert np.isclose(machine.score(slots, values, np.array([0]))[0], 1 / (1 + np.exp(-total)))


def test_language_of_held_out_texts(spark, docs, empty):
    r = random.Random(6)
    kinds = {"en": ("the", "thing", "with", "here"), "de": ("der", "nicht", "über", "schön"), "fr": ("être", "avec", "où", "déjà")}
    rows = [(k, " ".join(r.choice(kinds[x]) for _ in range(30)), x) for k, x in enumerate([*kinds] * 40)]
    frame = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "", "en"), (1002, "12 34!", "de"), (1003, "der nicht", None)], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language.language_report(frame).collect()}
    held = [(k, x) for k, _, x in rows if found[k]["held_out"]]
    assert held and sum(found[k]["lang_pred"] == x for k, x in held) >= 0.95 * len(held)
    assert {found[k]["lang_pred"] for k in (1000, 1001, 1002)} == {"und"}
    assert language.language_report(docs).count() == docs.count()
    assert language.language_report(empty).count() == 0
    assert {x["lang_pred"] for x in language.language_report(frame.where("doc_id >= 1002").drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    r = random.Random(8)
    kinds = {f"l{k:02}": [f"{chr(97 + k % 26)}{chr(97 + k // 4)}{x}" for x in ("a", "ob", "uc", "ed", "if")] for k in range(80)}
    rows = [(n, " ".join(r.choice(kinds[x]) for _ in range(40)), x) for n, x in enumerate([*kinds] * 12)]
    rows += [(5, rows[5][1], rows[5][2])] * 50 + [(k, "q q q", "rare") for k in range(5000, 5003)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {x["doc_id"]: x for x in language.language_report(frame).collect()}
    assert len({x["lang_pred"] for x in found.values()} & {*kinds}) == 80
    held = [(k, x) for k, _, x in rows if x != "rare" and found[k]["held_out"]]
    assert sum(found[k]["lang_pred"] == x for k, x in held) >= 0.95 * len(held)


def test_kernel_is_nystrom_and_ridge_in_plain_terms():
    import numpy as np

    r = np.random.default_rng(3)
    rows = (r.random((40, language.SLOTS)) < 0.01 * (1 + np.arange(40)[:, None] % 2)).astype(np.float32)
    labels = ["ab"[k % 2] for k in range(40)]
    model = language.Kernel.fit(np.packbits(rows.astype(np.uint8), axis=1), labels)

    def kernel(x, y):
        return (x * y).sum() / math.sqrt(max(1, x.sum()) * max(1, y.sum()))

    per = language.share(2, language.LANDMARKS, language.ALL_LANDMARKS)
    marks = [k for c in "ab" for k in [i for i, x in enumerate(labels) if x == c][:per]]
    inner = np.array([[kernel(rows[i], rows[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(values**-0.5) @ vectors.T
    maps = np.array([[kernel(x, rows[j]) for j in marks] for x in rows]) @ root
    target = np.array([[1.0 if x == c else -1.0 for c in "ab"] for x in labels])
    weight = np.diag([1 / labels.count(x) for x in labels])
    ridge = np.linalg.solve(maps.T @ weight @ maps + language.RIDGE * np.eye(len(marks)), maps.T @ weight @ target)
    want = maps @ ridge
    size = np.sqrt(np.maximum(1, rows.sum(1)))[:, None]
    assert np.allclose(rows @ model.matrix / size, want, atol=1e-3)


def test_training_takes_one_row_of_a_repeated_document(spark):
    rows = [(1, f"good words of all kinds {k}") for k in range(300)] + [(2, "&&& ### $$$"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (1, None), (None, 1)], "doc_id long, quality int")
    machine = quality.train(docs, labels, rows=5)
    assert [tuple(x) for x in quality.scored(docs, machine).where("doc_id > 1").select("doc_id", "predicted").orderBy("doc_id").collect()]
    once = quality.train(docs.groupBy("doc_id").agg({"text": "min"}).withColumnRenamed("min(text)", "text"), labels, rows=5)
    assert (machine.weights == once.weights).all()


def plain_spans(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_plain_patterns(spark, docs, empty):
    r = random.Random(8)
    for _ in range(4000):
        x = "".join(r.choice("01 -.+@a(5\n)") for _ in range(r.randint(0, 40)))
        assert sorted(pii.base_spans(x)) == sorted(plain_spans(x))
    found = {x["doc_id"]: x for x in pii.personal_data_report(docs).collect() if x["doc_id"] is not None}
    for k, text in enumerate(texts()):
        want = plain_spans(text)
        shown = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert found[k]["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert set(filter(None, shown.split(","))) <= set(found[k]["spans"].split(","))
        assert [found[k][f"n_{kind}"] for kind in pii.KINDS] == [sum(x[0] == kind for x in want) for kind in pii.KINDS]
    assert pii.personal_data_report(empty).count() == 0


def test_the_field_adds_spans_and_masks_them(spark):
    field = pii.train()
    for text, span in (("call 555-123-4567 now", ("phone", 5, 17)), ("tel (743) 555-3824, ok", ("phone", 4, 18))):
        base, every = pii.find([text], field)[0]
        assert base == [] and every == [span]
    for clean in ("in 2024 there were 12 of 300", "version 1.2.3 of 2023-11-04", "1 2 3 4 5 6 7 8 9 10 11", "9" * 3000, "@" * 3000):
        assert pii.find([clean], field)[0][1] == []
    rows = spark.createDataFrame([(1, "a b@c.de x", 10), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(x) for x in pii.masked(rows).orderBy("doc_id").collect()] == [(1, "a <email> x", 11), (2, None, 0), (3, "clean", 5)]


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    import numpy as np

    field = pii.train()
    score = np.random.default_rng(1).normal(0, 2, (3, 4, len(pii.LABELS)))
    found = field.viterbi(score)
    for row in range(3):
        best = max(
            itertools.product(range(len(pii.LABELS)), repeat=4),
            key=lambda y: field.start[y[0]] + sum(score[row, t, y[t]] for t in range(4)) + sum(field.moves[a, b] for a, b in itertools.pairwise(y)),
        )
        assert tuple(found[row]) == best


def plain_removal(all_texts, keep_first=False):
    raw = [(x or "").encode() for x in all_texts]
    seen = {}
    for k, x in enumerate(raw):
        for i in range(len(x) - 399):
            seen.setdefault(x[i : i + 400], []).append((k, i))
    out = []
    for k, x in enumerate(raw):
        gone = bytearray(len(x))
        for i in range(len(x) - 399):
            places = seen[x[i : i + 400]]
            if len(places) > 1 and not (keep_first and places[0] == (k, i)):
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, y in zip(x, gone, strict=True) if not y)
        out.append((len(x), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repetitive(spark):
    r = random.Random(4)
    line = lambda n: " ".join(f"{r.choice(WORDS)}{r.randint(0, 99)}" for _ in range(n))
    passages = [line(120) for _ in range(4)]
    made = [line(60) + passages[k % 4][r.randint(0, 200) :] + line(40) for k in range(30)]
    made += ["a" * 1000, "ab" * 300, "", None, passages[0], passages[0], "line of text\n" * 80, line(30) + "line of text\n" * 50, "a" * 399, "b" * 400, "b" * 400]
    made += [passages[1][:500] + line(40) for _ in range(6)] + [line(40) + passages[2][-450:] for _ in range(6)]
    return made


@pytest.mark.parametrize(("hot", "keep_first"), [(repeats.HOT_RUNS, False), (2, False), (3, True), (repeats.HOT_RUNS, True)])
def test_repeats_are_those_of_all_strings(spark, docs, empty, repetitive, hot, keep_first):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(repetitive)), "doc_id long, text string").repartition(4)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    found = repeats.without_repeats(rows, hot, keep_first).select("doc_id", "n_bytes", size, F.size("spans"), F.sha2("kept", 256)).collect()
    want = plain_removal(repetitive, keep_first)
    assert {x[0]: tuple(x)[1:] for x in found} == dict(enumerate(want))
    assert repeats.repeat_report(docs).count() == docs.count()
    assert repeats.repeat_report(empty).count() == 0
    clash = rows.selectExpr("*", "1 Spans", "'x' kept", "2 key", "3 _key", "4 place", "5 n_bytes")
    own = repeats.without_repeats(clash.where("doc_id < 3"))
    assert own.columns == ["doc_id", "text", "key", "_key", "place", "n_bytes", "spans", "kept"]
    assert {tuple(x) for x in own.select("key", "_key", "place").collect()} == {(2, 3, 4)}


def test_runs_of_a_long_text_do_not_hang_on_its_pieces(monkeypatch):
    text = " ".join(f"w{random.Random(k).randint(0, 999)}" for k in range(3000)).encode()

    def strings():
        anchor, _, first, last, shift = repeats.runs(text)
        return {(i, int(a)): int(f + s - i) for a, f, z, s in zip(anchor, first, last, shift, strict=True) for i in range(f, z + 1)}

    whole = strings()
    monkeypatch.setattr(repeats, "PIECE", 1000)
    assert strings() == whole and len(whole) == len(text) - 399


def test_many_strings_are_sorted_by_distance(monkeypatch):
    r = random.Random(3)
    shared = bytes(r.choice(b"abcd") for _ in range(600))
    rows = [(1, k, b"k%d" % k, 0, 300 + k, shared[: 560 + k] + bytes(r.choice(b"xyz") for _ in range(100))) for k in range(9)]
    rows = [(a, p, k, f, 100, b"".join([x])) for a, p, k, f, _, x in rows]
    import pyarrow as pa

    names = ["anchor", "place", "key", "first", "shift", "part"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=names)
    together = pa.Table.from_batches(list(repeats.compared()([batch]))).to_pylist()
    monkeypatch.setattr(repeats, "SORTED", 10)
    split = pa.Table.from_batches(list(repeats.compared()([batch]))).to_pylist()
    starts = lambda found: {(x["key"], i) for x in found for i in range(x["first"], x["last"] + 1)}
    assert starts(together) == starts(split) and starts(split)


def test_longest_factors_are_those_of_all_pairs(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "LENGTH", 6)
    r = random.Random(1)
    text = bytes(r.choice(b"ab") for _ in range(300))
    data, start = np.frombuffer(text, np.uint8), np.arange(295)

    def common(i, j):
        return next((k for k in range(6) if text[i + k] != text[j + k]), 6)

    assert repeats.previous_factors(data, start).tolist() == [max((common(i, j) for j in range(i)), default=0) for i in start]
    assert repeats.repeated_strings(data, start, True).tolist() == [any(common(i, j) == 6 for j in range(i)) for i in start]
    assert repeats.repeated_strings(data, start).tolist() == [any(common(i, j) == 6 for j in range(295) if j != i) for i in start]


def test_pieces_round_trip_and_match_a_plain_search(spark, docs, empty):
    raw = open(unigram.DEFAULT_MODEL, "rb").read()
    model = unigram.Model(unigram.read_pieces(raw))
    ids = {p: k for k, (p, _, kind) in reversed([*enumerate(model.pieces)]) if kind == 1}

    def plain(text):
        run = (" " + text).replace(" ", "▁")
        best = [(0.0, [])] + [(float("-inf"), None)] * len(run)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - 18), end):
                piece = run[start:end]
                if piece in ids and best[start][1] is not None:
                    new = (best[start][0] + model.score[ids[piece]], [*best[start][1], ids[piece]])
                elif end - start == 1:
                    new = (best[start][0] + model.unknown, [*best[start][1], *model.bytes_of(piece.encode())])
                else:
                    continue
                if new[0] > best[end][0]:
                    best[end] = new
        return best[-1][1]

    for text in ("hello world", "  two  spaces ", "tab\tand\nline", "日本語 ゼ 梦", "12.5% &&& x", "é" * 4):
        assert model.encode(text)[0] == plain(text)
    for text in [x for x in texts() if x]:
        assert model.decode(model.encode(text)[0]) == text
    found = unigram.round_trip_report(docs)
    assert found.count() == docs.count() and found.where("not round_trip").count() == 0
    again = unigram.decode(unigram.encode(docs))
    assert again.where("decoded <> coalesce(text, '')").count() == 0
    assert unigram.round_trip_report(empty).count() == 0


def test_double_array_holds_exactly_its_keys():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, "ü".encode(): 4, b"abd": 5, b"zz": 6}
    trie = unigram.DoubleArray.of(keys)

    def find(key):
        state = 0
        for c in key:
            step = trie.base[state] + c
            if step >= len(trie.check) or trie.check[step] != state:
                return -1
            state = step
        return trie.value[state]

    assert all(find(k) == v for k, v in keys.items())
    assert [find(k) for k in (b"z", b"abe", b"c", b"aba")] == [-1] * 4
