"""Classifiers, roles and images against plain versions written out by hand."""

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, media, quality, toxicity
from lectern.llm.common import documents, fresh_path, table
from lectern.llm.features import SPACE, NGrams

TEXTS = [f"gutes Wort {i % 5} und mehr davon, sagt {i % 3}." if i % 2 else f"SPAM!!! kauf {i % 5} jetzt &&& {i % 7}" for i in range(40)]


def margins_by_hand(texts, y):
    """Naive-Bayes support vectors with plain loops: log-count ratios, scaled rows, dual coordinate descent."""
    rows = [NGrams().of(t).tolist() for t in texts]
    p, q, seen = Counter(), Counter(), Counter()
    for r, label in zip(rows, y, strict=True):
        for x in r:
            seen[x] += 1
            (p if label else q)[x] += 1
    n1, n0 = sum(y), len(y) - sum(y)
    ratio = {x: max(-8.0, min(8.0, math.log(((p[x] + 1) / (1 + n1)) / ((q[x] + 1) / (1 + n0))))) if seen[x] >= 3 else 0.0 for x in seen}
    size = [math.sqrt(sum(ratio[x] ** 2 for x in r)) for r in rows]
    scaled = [{x: ratio[x] / s for x in r if ratio[x]} if s else {} for r, s in zip(rows, size, strict=True)]
    share = min(0.999, max(0.001, n1 / len(y)))
    cost = [0.5 / share if label else 0.5 / (1 - share) for label in y]
    alpha, w, bias = [0.0] * len(y), Counter(), 0.0
    rng = np.random.default_rng(7)
    for _ in range(12):
        for i in rng.permutation(len(y)).tolist():
            sign = 1 if y[i] else -1
            slope = sign * (sum(w[x] * v for x, v in scaled[i].items()) + bias) - 1
            new = min(max(alpha[i] - slope / (sum(v * v for v in scaled[i].values()) + 1), 0.0), cost[i])
            step, alpha[i] = (new - alpha[i]) * sign, new
            for x, v in scaled[i].items():
                w[x] += step * v
            bias += step
    return [sum(w[x] * v for x, v in s.items()) + bias for s in scaled]


def test_quality_margins():
    y = np.array([i % 2 if i % 11 else 1 - i % 2 for i in range(40)])
    rows = [NGrams().of(t) for t in TEXTS]
    model = quality.fit(rows, y)
    assert [model.margin(r) for r in rows] == pytest.approx(margins_by_hand(TEXTS, y.tolist()), abs=1e-4)
    assert [model.score(r) for r in rows] == pytest.approx([1 / (1 + math.exp(-(model.curve[0] * m + model.curve[1]))) for m in margins_by_hand(TEXTS, y.tolist())], abs=1e-4)


def test_noisy_or():
    weight = np.zeros(SPACE)
    weight[toxicity.bag("idiot")[0][0][0]] = 4.0
    model = toxicity.Model(weight, -3.0, (1.3, 0.2))
    text = "Ein Satz. Du Idiot! Noch ein Satz. Idiot, sagt er."
    places, spans = toxicity.bag(text)
    assert [text[a:b].strip() for a, b in spans] == ["Ein Satz.", "Du Idiot!", "Noch ein Satz.", "Idiot, sagt er."]
    each = [1 / (1 + math.exp(-(-3.0 + 4.0 * ("idiot" in text[a:b].lower())))) for a, b in spans]
    got = model.sentences(places)
    assert got.tolist() == pytest.approx(each)
    either = 1 - math.prod(1 - p for p in each)
    assert model.document(got) == pytest.approx(1 / (1 + math.exp(-(1.3 * math.log(either / (1 - either)) + 0.2))))


def test_noisy_or_is_learned_from_documents():
    """One bad sentence among good ones marks a document; the word in it is found from document labels alone."""
    rng = np.random.default_rng(3)
    word = lambda: f"wort{''.join(chr(97 + c) for c in rng.integers(0, 26, 4))}"
    some = [f"satz{c}" for c in "abcdefghij"]
    sentence = lambda bad: " ".join([*rng.choice(some, 4), word(), *(["schlimm"] if bad else [])]) + "."
    y = np.array([i % 3 == 0 for i in range(150)], int)
    texts = [" ".join(sentence(label and j == 2) for j in range(6)) for label in y]
    model = toxicity.fit([np.frombuffer(toxicity._packed(t), np.int32) for t in texts], y)
    for t, label in zip(texts, y, strict=True):
        places, spans = toxicity.bag(t)
        p = model.sentences(places)
        assert (model.document(p) >= 0.5) == label
        assert ["schlimm" in t[a:b] for a, b in spans] == (p >= toxicity.LOCATE).tolist()


@pytest.mark.parametrize(("module", "label", "fold", "held"), [(quality, "quality", 3, lambda r: r == 1), (toxicity, "toxic", 5, lambda r: r == 0)])
def test_held_out_labels_are_not_read(spark, sf_dir, module, label, fold, held):
    """Turning round all held-out labels, repeating rows and adding labels that contradict themselves changes no score."""
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    remainder = F.crc32(F.col("doc_id").cast("string")) % fold
    out = remainder == (1 if fold == 3 else 0)
    turned = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
    twice = turned.unionByName(turned)
    strange = spark.createDataFrame([(10**9, 0, 0), (10**9, 1, 1)], labels.schema)
    want = {r.doc_id: r.score for r in module.score_documents(docs, module.trained(docs, labels)).collect()}
    got = module.score_documents(docs, module.trained(docs, twice.unionByName(strange))).collect()
    assert {r.doc_id: r.score for r in got} == want
    assert all(r.held_out == held(zlib.crc32(str(r.doc_id).encode()) % fold) for r in got)


def test_roles_are_the_likeliest(spark, sf_dir):
    """Every path of roles is tried for short conversations; the counts are made anew."""
    conv = table(spark, sf_dir, "conversations")
    messages = sorted((r.conv_id, r.turn, r.text or "", r.role) for r in conv.collect())
    wide, n = sum(chat.SIZES), len(chat.ROLES)
    first, after, seen = np.zeros(n), np.zeros((n, n)), np.zeros((n, wide))
    for _, group in itertools.groupby(messages, key=lambda m: m[0]):
        before = None
        for _, _, text, role in group:
            r = chat.ROLES.index(role)
            seen[r] += chat.observed(text)
            if before is None:
                first[r] += 1
            else:
                after[before, r] += 1
            before = r
    model, learned = chat.Model(first, after, seen), chat._counted(chat._sorted(conv))
    for a, b in ((model.first, learned.first), (model.after, learned.after), (model.seen, learned.seen)):
        assert np.allclose(a, b)
    got = {(r.conv_id, r.turn): r.role for r in chat.recovered_turns(conv).collect()}
    tried = 0
    for conv_id, group in itertools.groupby(messages, key=lambda m: m[0]):
        own = list(group)
        if len(own) > 7:
            continue
        e = model.emitted([m[2] for m in own])
        chance = lambda path, e=e: model.first[path[0]] + sum(model.after[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[i, s] for i, s in enumerate(path))
        best = max(itertools.product(range(n), repeat=len(own)), key=chance)
        assert chance([chat.ROLES.index(got[conv_id, m[1]]) for m in own]) == pytest.approx(chance(best))
        tried += 1
    assert tried > 3


def test_roles_of_a_long_conversation(spark):
    """More messages than a task holds at a time: several segments in one partition and the next."""
    rng = np.random.default_rng(19)
    rows = [(1, i, ("user", "assistant")[i % 2], ("User: was nun" if rng.random() < 0.6 else "und") if i % 2 == 0 else ("Assistant: das. " * 6 if rng.random() < 0.6 else "ja.")) for i in range(2 * chat.STEP + 500)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r.role for r in chat.recovered_turns(conv).orderBy("turn").collect()]
    model = chat._counted(chat._sorted(conv))
    assert got == [chat.ROLES[s] for s in model.path(model.emitted([r[3] for r in rows]), None, None)]


def image_by_hand(raw):
    """Samples of an 8-bit RGB image without line filters, read chunk by chunk."""
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(raw[at + 8 + n : at + 12 + n], "big")
        if kind == b"IHDR":
            wide, high, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (wide, depth, colour) == (64, 8, 2)
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    lines = zlib.decompress(data)
    assert len(lines) == high * 193 and not any(lines[i * 193] for i in range(high))
    return b"".join(lines[i * 193 + 1 : (i + 1) * 193] for i in range(high))


def test_images(spark, sf_dir):
    texts = ["", "a", "ä" * 96, "x" * 193, "Zeile\n" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, "a")], "doc_id long, text string")
    path = fresh_path(spark, "m")
    media.write_archives(docs, path)
    stored = {r.doc_id: bytes(r.image) for r in spark.read.format("archive").load(path).collect()}
    for r in media.read_features(spark, path).collect():
        image = stored[r.doc_id]
        samples = image_by_hand(image)
        raw = ({**dict(enumerate(texts)), 9: "a"}[r.doc_id]).encode()
        assert samples == raw + b" " * (r.payload_bytes - len(raw)) and r.payload_bytes % 192 == 0 < r.payload_bytes
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        n = len(samples)
        mean = sum(samples) / n
        spread = math.sqrt(sum(x * x for x in samples) / n - mean * mean)
        parts = [samples[i * n // 65 : (i + 1) * n // 65] for i in range(65)]
        bright = [sum(p) / max(1, len(p)) for p in parts]
        bits = int("".join("1" if b > a else "0" for a, b in zip(bright, bright[1:], strict=False)), 2)
        assert r.feature == f"mean={mean:.4f};spread={spread:.4f};hash={bits:016x}"
    assert stored[1] == stored[9]


def test_near_copies_of_items_of_every_size():
    """Whatever has a similarity of 0.8 or more is within the radius, small items too: none of more than a thousand is missed."""
    from lectern.llm import decontaminate as D

    rng = np.random.default_rng(23)
    word = lambda: f"i{rng.integers(10**9)}"
    items = [[word() for _ in range(n)] for n in (1, 3, 5, 6, 9, 14, 20, 30, 45, 60, 90, 150) for _ in range(6)]
    index = D.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    asked = 0
    for i, own in enumerate(items):
        for _ in range(40):
            w = list(own)
            for _ in range(int(rng.integers(0, max(1, len(w) // 25) + 1))):
                w[int(rng.integers(len(w)))] = word()
            a, b = (Counter(tuple(x[j : j + 5]) for j in range(max(1, len(x) - 4))) for x in (own, w))
            both = (a & b).total()
            similar = both / (a.total() + b.total() - both) >= 0.8
            found = {x[0] for x in index.search(" ".join([word() for _ in range(8)] + w + [word() for _ in range(8)]))}
            assert found <= {i} and (i in found or not similar)
            asked += similar
    assert asked > 1000
