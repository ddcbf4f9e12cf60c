"""Personal data: base spans against plain patterns, bootstrapping against a plain version on small corpora."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

from lectern.llm import personal
from lectern.llm.common import documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, slots string, value string, kind string, added string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(d[::-1])]
        return 14 <= len(d) <= 19 and sum(x if x < 10 else x - 9 for x in twice) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_by_hand(text):
    names = list(PATTERNS)
    return sorted((m.start(), names.index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0]))


def card(i):
    """A number of 16 digits that passes the checksum."""
    head = f"{4000_0000_0000_000 + i * 7919}"
    return next(head + str(c) for c in range(10) if passes("card", head + str(c)))


def test_base_spans():
    rng = random.Random(3)
    parts = ["a@b.c", "x.y-z@q.example.com.", "@", "a@b", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "9.9.9", "+1 (487) 555-7209", "+", "+4", "++43 1 234", "4111111111111111", "4111 1111-1111 1111", "4111111111111112", "0" * 13, "12", " ", "  ", "-", ".", "é@é.é", "é", "٣٣", "a", "\n", "(", "@@", "%"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert personal.base_spans(text) == base_by_hand(text), text
    for i in range(50):
        assert personal.base_spans(f"n {card(i)}!") == [(2, 2, 18)]


def test_base_spans_of_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = personal.personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = base_by_hand(texts[r.doc_id])
        line = ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def spans_by_hand(texts):
    """The whole method over a list of texts, in dictionaries."""
    slots = []
    for row, t in enumerate(texts):
        base = base_by_hand(t)
        for s, k, e in base + [(s, None, e) for s, e in personal.candidates(t, base)]:
            slots.append((row, s, e, k, t[s:e].lower(), personal.patterns_at(t, s, e)))
    edges = {(p, v, k) for _, _, _, k, v, ps in slots for p in ps}
    known = {}
    for _ in range(personal.ROUNDS):
        n, sums = defaultdict(int), defaultdict(float)
        for p, v, k in edges:
            n[p] += 1
            if k is not None:
                sums[p, k] += 1
            elif v in known:
                sums[p, known[v][1]] += known[v][0]
        good = defaultdict(list)
        for (p, k), s in sums.items():
            share, m, z = s / n[p], n[p], 1.96
            low = (share + z * z / 2 / m - z * math.sqrt((share * (1 - share) + z * z / 4 / m) / m)) / (1 + z * z / m)
            if low >= 0.5:
                good[p].append((k, low))
        miss = defaultdict(lambda: 1.0)
        for p, v, k in edges:
            if k is None:
                for kind, low in good[p]:
                    miss[v, kind] *= 1 - min(low, 0.999999)
        size = len(known)
        for (v, k), x in miss.items():
            if 1 - x >= 0.5:
                old = known.get(v, (0, 0))
                known[v] = max(old, (1 - x, k), key=lambda y: (y[0], -y[1]))
        if len(known) == size:
            break
    names = list(PATTERNS)
    out = []
    for row, _ in enumerate(texts):
        own = [(s, k if k is not None else known[v][1], e) for r, s, e, k, v, _ in slots if r == row and (k is not None or v in known)]
        out.append(",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(own)))
    return out


def corpus():
    rng = random.Random(4)
    words = "der die das wert ist hier nun von mit bei haus tag".split()
    fill = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    texts = [f"{fill()} Karte: {card(i)} {fill()}" for i in range(20)]
    texts += [f"{fill()} Karte: {card(i)[:-1]}x{i} {fill()}" for i in range(5)]  # no checksum, same context
    texts += [f"{fill()} Kennung {card(i)[:-1]}x{i} gilt {fill()}" for i in range(5)]  # found identifiers in a new context
    texts += [f"{fill()} Kennung {card(30 + i)} gilt {fill()}" for i in range(8)]
    texts += [f"{fill()} Kennung 777{i}88 gilt {fill()}" for i in range(1)]  # found in a later round
    texts += [f"{fill()} Tel. +43 1 58801{i:03d} {fill()}" for i in range(9)] + [f"ruf Tel. 0664 123 45 6{i}, {fill()}" for i in range(2)]
    texts += [f"{fill()} mail an: u{i}@h.example {fill()}" for i in range(9)] + ["mail an: udo(at)h.example"]
    texts += [f"{fill()} {rng.randrange(10**5, 10**8)} {fill()} 10.0.0.{rng.randrange(250)} {fill()}" for _ in range(60)]
    texts += [f"{fill()} Nummer {card(99)} {fill()}"] * 20 + ["Nummer 123456"]  # one identifier in copies is no evidence
    return texts


def test_bootstrapping(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "s", "v", "k", "a") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    made = personal.Extraction(docs)
    got = {r.doc_id: r.spans for r in made.documents().collect()}
    want = spans_by_hand(texts)
    assert got == dict(enumerate(want))
    found = {r.value: personal.KINDS[r.kind] for r in made.values.collect()}
    assert {v for v, k in found.items() if k == "phone"} == {"0664 123 45 60", "0664 123 45 61"}
    assert "udo(at)h.example" in found and "777088" in found and "123456" not in found
    assert sum(k == "card" for k in found.values()) == 6 and len(found) == 9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a@b.cd"), (4, "a@b.cd"), (4, "+1 (487) 555-7209"), (None, "1.2.3.4"), (5, "ä " * 200_000 + "1.2.3.4"), (6, "1" * 5000), (7, "0" * 6000 + ".1.1.1")]
    docs = spark.createDataFrame([(d, t, None, None, None, 1, "s", "v", "k", "a") for d, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.spans) for r in personal.personal_data(docs).collect())
    assert got == [(0, "ip:0:7"), (1, ""), (2, ""), (3, ""), (4, "email:0:6"), (4, "email:0:6"), (4, "phone:0:17"), (5, "ip:400000:400007"), (6, ""), (7, "ip:0:6006")]
    assert personal.personal_data(docs.where("false")).collect() == []


def test_scan_takes_time_in_proportion():
    for text in ("a" * 400_000, "a@" * 200_000, "1." * 200_000, "1 " * 200_000, "+1(" * 130_000, "+" * 400_000, "a1" * 200_000, "x@y " * 100_000, "9-" * 200_000):
        began = time.process_time()
        base = personal.base_spans(text)
        for s, e in personal.candidates(text, base)[:1000]:
            personal.patterns_at(text, s, e)
        assert time.process_time() - began < 5, text[:6]
