"""The corpus operators against brute force, round trips and held-out labels, and on odd rows."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, components, decontaminate, jaccard, media, quality, secrets, suffixes, tokenfiles, toxicity
from lectern.llm.common import bitmap_of, documents, fresh_path, in_bitmap, table
from lectern.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, rep string, key string, score string, ids string, start int, segment string"
LONG = " ".join(f"wort{i % 977} mit{i % 13}" for i in range(60_000))
BASE = " ".join(f"w{i}" for i in range(120))


def odd_rows():
    """Null and empty texts, null ids, a very long text, ties, repeated rows, clashing names."""
    texts = [(1, BASE), (2, BASE), (2, BASE), (3, BASE + " ende"), (4, None), (5, ""), (6, " \n\t "), (7, LONG), (8, "kurz"), (8, "anders kurz"), (None, BASE), (None, None), (9, "a b"), (10, "A  b"), (11, "ü" * 3000)]
    return [(d, t, None, "q", None if t is None else len(t), 1, "x", None, "s", "i", 2, "g") for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return documents(spark, sf_dir)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# components


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    want = dict(zip(*(x.tolist() for x in components.roots(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))), strict=True))
    for most in (components.TASK_EDGES, 10):
        monkeypatch.setattr(components, "TASK_EDGES", most)
        got = {r.node: r.component for r in components.connected_components(edges).collect()}
        assert got == {n: r for n, r in want.items() if n != r}
    assert components.connected_components(edges.where("false")).count() == 0


def test_bitmap(spark):
    some = spark.range(1000).select(F.xxhash64("id").alias("h"))
    every = np.array([r.h for r in spark.range(5000).select(F.xxhash64("id").alias("h")).collect()])
    kept = in_bitmap(bitmap_of(some), every)
    assert kept[:1000].all() and kept[1000:].mean() < 0.2


# 1


def windows_by_hand(docs, items):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for d, t in docs:
        s = shingles(words(t))
        for i, u in items:
            b = Counter(shingles(words(u)))
            if not b or not set(s) & set(b):
                continue
            n = b.total()
            for at in range(len(s)):
                a = Counter(s[at : at + n])
                both = (a & b).total()
                if both / (a.total() + n - both) >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), both / (a.total() + n - both))
    return out


def test_leaks(spark, sf_dir, docs):
    bench = table(spark, sf_dir, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    changed = items[0][1].split()
    near = " ".join(["davor"] * 9 + changed[:-1] + ["anders"] + ["danach"] * 9)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, near), (-2, None), (-3, items[1][1])], "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(more, bench).collect()}
    assert got == pytest.approx(windows_by_hand(texts_of(more), items))
    assert (-1, items[0][0]) in got and (-3, items[1][0]) in got
    kept = {r.doc_id for r in decontaminate.without_leaks(more, bench).collect()}
    assert kept == {d for d, _ in texts_of(more)} - {d for d, _ in got}


def test_leaks_on_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(1, BASE), (2, None), (3, ""), (4, "kurz"), (5, "nie da gewesen")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.find_leaks(odd, bench).collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (8, 4), (8, 4)]
    assert decontaminate.without_leaks(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(none, bench).count() == 0 == decontaminate.find_leaks(odd, bench.where("false")).count()


# 2


def test_bpe_is_the_librarys(docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.TrieBpe(path)
    texts = [t for _, t in texts_of(docs)] + ["", "it's <|endoftext|> x<|startoftext|>Y", "ΑΣ ΣΑΣ İx ﬁ é ", "a" * 5000, "日本語 😀😀 123", "word</w> </w>", "a\x1cb\x1f c \x85 d​x", "\x00 \x7f", "a\x1c", "\x1dx\x1e", "\x1f", " \x1c \x1e a\x1f\n"]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_bpe_on_odd_rows(odd, none):
    rows = bpe.encode_documents(odd, tokenizer("word_bpe_49k.json"), keep_ids=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encode_documents(none, tokenizer("word_bpe_49k.json")).count() == 0


# 3 and 5


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    y = np.array(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_held_out_labels(spark, sf_dir, module, label, least):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = documents(spark, where), table(spark, where, "labels")
    scored = module.score_documents(docs, module.trained(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 30 and auc([r[label] for r in rows], [r.score for r in rows]) >= least


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_on_odd_rows(spark, odd, none, module, label):
    for rows in ([], [(1, 1, 1)], [(1, 1, 1), (3, 0, 0), (7, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (10, 0, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = module.score_documents(odd, module.trained(odd, labels)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score_documents(none, module.trained(odd, labels)).count() == 0


def test_offending_sentence(spark, sf_dir):
    where = sf_dir.replace("sf0.001", "sf0.01")
    docs = documents(spark, where)
    rows = toxicity.score_documents(docs, toxicity.trained(docs, table(spark, where, "labels"))).join(docs.select("doc_id", "text"), "doc_id").where("predicted = 1 and size(offending) > 0").collect()
    assert rows
    hits = [r.text[o.start : o.end].lower() for r in rows for o in r.offending]
    assert np.mean([any(w in h for w in ("idiot", "moron", "stupid", "clown", "loser", "pathetic", "worthless", "disgusting", "scum")) for h in hits]) > 0.8


def test_capitals_beside_a_letter_that_grows():
    places, spans = toxicity.bag("\u0130zmir ist weit. You IDIOT.")
    assert places[-1] == toxicity.bag("you idiot.")[0][0] and spans[-1][1] == len("\u0130zmir ist weit. You IDIOT.")


# 4


def repeats_by_hand(rows, least=50):
    seen = defaultdict(set)
    words = [(d, (t or "").encode().split()) for d, t in rows if d is not None]
    for d, w in words:
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].add(d)
    out = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1:
                out[d] |= set(range(i, i + least))
    return out


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        assert r.n_words >= 50 and r.other_doc_id != r.doc_id
        out[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    return out


def test_repeats(docs):
    want, got = repeats_by_hand(texts_of(docs)), covered(suffixes.repeated_passages(docs))
    assert got == want


def test_repeats_of_every_length(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"x{rng.integers(10**9)}"
    rows, shared = [], {}
    for n in range(45, 60):
        passage = [word() for _ in range(n)]
        for j in range(2):
            rows.append((2 * n + j, " ".join([word() for _ in range(int(rng.integers(0, 70)))] + passage + [word() for _ in range(int(rng.integers(0, 70)))])))
        shared[2 * n] = n
    # many documents with one start that go on differently: the match is far away in the order
    start = [word() for _ in range(30)]
    for i in range(40):
        rows.append((1000 + i, " ".join([word() for _ in range(5)] + start + [word() for _ in range(40)])))
    tail = rows[-1][1].split()[-70:]
    rows.append((2000, " ".join([word(), *tail])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert covered(suffixes.repeated_passages(df)) == repeats_by_hand(rows)


def test_repeats_with_other_extents(spark):
    rng = np.random.default_rng(7)
    some = lambda n: [f"y{rng.integers(10**9)}" for _ in range(n)]
    rows = []
    # X begins like Y and, from its word 19 on, goes on like Z for longer
    for i in range(12):
        x = some(100)
        rows += [(10 * i, x), (10 * i + 1, some(5) + x[:50] + some(20)), (10 * i + 2, some(5) + x[19:] + some(20))]
    # a passage that many documents share, the words before it in pairs
    passage = some(50)
    for i in range(20):
        before = some(11)
        rows += [(1000 + 2 * i + j, some(20) + before + passage + some(60)) for j in range(2)]
    rows = [(d, " ".join(w)) for d, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert covered(suffixes.repeated_passages(df)) == repeats_by_hand(rows)


def runs_in_others(rows, df, least=50):
    """Every run of a row's passage is in the document that the row names."""
    words = {d: t.split() for d, t in rows}
    runs = {d: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)} for d, w in words.items()}
    for r in df.collect():
        own = words[r.doc_id][r.first_word : r.first_word + r.n_words]
        assert all(tuple(own[i : i + least]) in runs[r.other_doc_id] for i in range(len(own) - least + 1))


def test_repeats_and_their_documents(spark, monkeypatch):
    rng = np.random.default_rng(11)
    some = lambda n: [f"z{rng.integers(10**9)}" for _ in range(n)]
    rows = []
    # P + Q in one document, P in a second, Q in a third
    p, q = some(60), some(60)
    rows += [(1, p + q), (2, some(9) + p + some(9)), (3, some(9) + q + some(9))]
    # two documents share 31 words, a gram and 26 words more; ten each go on like one of them
    for case in range(6):
        left, gram, right, a, c = some(31), some(19), some(26), some(60), some(60)
        base = 100 * (case + 1)
        rows += [(base, left + gram + right + a), (base + 1, left + gram + right + c)]
        rows += [(base + 2 + i, some(40) + gram + right + (a, c)[i % 2]) for i in range(20)]
    # a passage that very many documents have
    often = some(70)
    rows += [(2000 + i, some(3 + i % 7) + often[i % 3 :] + some(5)) for i in range(150)]
    rows = [(d, " ".join(w)) for d, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = repeats_by_hand(rows)
    for most, fits in ((suffixes.HOT, True), (20, True), (20, False)):  # runs salted or not, joined where a bitmap is too small
        monkeypatch.setattr(suffixes, "HOT", most)
        monkeypatch.setattr(suffixes, "fits_bitmap", lambda n, fits=fits: fits)
        out = suffixes.repeated_passages(df)
        assert covered(out) == want
        runs_in_others(rows, out)
    assert {(r.first_word, r.n_words, r.other_doc_id) for r in out.where("doc_id = 1").collect()} == {(0, 60, 2), (60, 60, 3)}


def test_repeats_of_periodic_text(spark):
    rng = np.random.default_rng(13)
    some = lambda n: [f"p{rng.integers(10**9)}" for _ in range(n)]
    rows = []
    for period in (1, 2, 3, 5, 8, 13, 31, 40):
        root = some(period)
        for j, n in enumerate((49, 50, 51, 57, 64, 90, 200, 1000)):
            turned = root[j % period :] + root[: j % period]
            stretch = (turned * (n // period + 1))[:n]
            rows.append((1000 * period + 2 * j, some(int(rng.integers(0, 40))) + stretch + some(int(rng.integers(0, 40)))))
            rows.append((1000 * period + 2 * j + 1, stretch + stretch[:7] + some(3) + stretch))
    rows = [(d, " ".join(w)) for d, w in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffixes.repeated_passages(df)
    assert covered(out) == repeats_by_hand(rows)
    # what repeats itself is few rows, however long
    assert len(suffixes.Suffixes("la " * 100_000).start) < 200


def test_repeats_on_odd_rows(odd, none):
    got = covered(suffixes.repeated_passages(odd))
    assert {d: len(w) for d, w in got.items()} == {1: 120, 2: 120, 3: 120}
    assert suffixes.repeated_passages(none).count() == 0


# 6


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    path, lib = fresh_path(spark, "t"), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "a  b\n\n c "), (-2, "<|endoftext|> x"), (-3, None), (-4, "日本 ʼn"), (-5, "")], "doc_id long, text string"))
    tokenfiles.write_token_files(more, tokenizer("byte_bpe_50k.json"), path)
    got = {r.doc_id: r for r in tokenfiles.read_token_files(spark, path, keep_ids=True).collect()}
    at = 0
    for d, t in sorted(texts_of(more)):
        want = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[d].start, got[d].n_tokens, got[d].ids) == (at, len(want), want)
        assert got[d].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)


@pytest.mark.parametrize(("n", "limit"), [(1, 18), (2, 18), (3, 18), (40, 6), (3000, 12), (60_000, 18)])
def test_codes(n, limit):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.5, n) * 10 + 1).astype(np.int64)
    bits = tokenfiles.code_lengths(counts, limit)
    assert bits.max() <= max(limit, 1) and (n == 1 or (2.0 ** -bits).sum() == 1)
    lengths = np.array([1, 127, 128, 129, 0, 1000])
    ids = rng.integers(0, n, lengths.sum())
    streams, marks = tokenfiles.pack(ids, lengths, tokenfiles.canonical(bits), bits)
    begin = np.cumsum([0, *map(len, streams)])
    places = np.concatenate([np.frombuffer(m, "<u4") + 8 * b for m, b in zip(marks, begin, strict=False)])
    assert np.array_equal(tokenfiles.Table(bits).unpack(b"".join(streams), places, lengths), ids)


def test_token_files_of_odd_rows(spark, odd, none):
    for df in (odd, none):
        path = fresh_path(spark, "t")
        tokenfiles.write_token_files(df, tokenizer("byte_bpe_50k.json"), path)
        rows = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
        assert len(rows) == df.count()
        assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1]) if rows else True


# 7


def test_media(spark, odd, none, docs):
    for df in (docs, odd, none):
        path = fresh_path(spark, "m")
        media.write_archives(df, path)
        rows = media.read_features(spark, path).collect()
        want = Counter()
        for d, t in texts_of(df):
            raw = (t or "").encode()
            full = raw + b" " * (-len(raw) % 192 if raw else 192)
            want[d, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want


def test_archive_ranges_and_retries(spark, docs, monkeypatch):
    path = fresh_path(spark, "m")
    media.write_archives(docs, path)
    whole = Counter(r.image for r in spark.read.format("archive").load(path).collect())
    small = spark.read.format("archive").option("range_bytes", "4096").load(path)
    assert small.rdd.getNumPartitions() > 20 and Counter(r.image for r in small.collect()) == whole
    reader = media.ArchiveReader(path, 1 << 30)
    part = reader.partitions()[0]
    files, name = media._opened(part.path)
    by_header = list(media._members(files, name, part.start, part.end))
    tries = []

    class Shaky:
        def open_input_file(self, n):
            tries.append(n)
            if len(tries) < 3:
                raise OSError("lost")
            return files.open_input_file(n)

    monkeypatch.setattr(media, "PAUSE", 0)
    assert media.samples_of(media.read_member(Shaky(), name, *by_header[0][:2])) and len(tries) == 3


# 8


def spans_by_hand(t):
    assign = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(assign + access + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def test_base_spans(docs, odd, none):
    for df in (docs, odd, none):
        rows = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_documents(df).collect())
        want = Counter()
        for d, t in texts_of(df):
            s = spans_by_hand(t or "")
            want[d, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(secrets.shown(s).encode()).hexdigest()] += 1
        assert rows == want


def test_layers():
    secret = 'password = "abcdefghijklmnop12"'
    b64 = base64.b64encode(secret.encode()).decode()
    twice = base64.b64encode(b64.encode()).decode()
    packed = base64.b64encode(zlib.compress(b"secret: ABCDEFGHIJKLMNOPQ " * 5)).decode()
    url = "token%3D%22abcdefghijklmn%22"
    uni = "".join(f"\\u{ord(c):04x}" for c in "passwd:abcdefghijkl")
    for wrapped in (b64, twice, packed, url, uni, url.replace("%", "%25")):
        text = f"davor {wrapped} danach"
        base, every = secrets.scan(text)
        assert not [s for s in base if s[1] == 0] and [s for s in every if s[1] == 0], wrapped
        assert all(6 <= s < e <= 6 + len(wrapped) for s, _, e in every)
        assert not [s for s in secrets.scan(secrets.redact(text))[1] if s[1] == 0]
    assert secrets.scan(secret)[0] == [(0, 0, len(secret) - 1)]
    assert secrets.scan("%41%" * 50 + "\\u00zz") == ([], [])


def test_layers_are_unfolded_whole(monkeypatch):
    secret = b'password = "abcdefghijklmnop12"'
    b64 = lambda raw: base64.b64encode(raw).decode()
    twice, members = gzip.compress(gzip.compress(secret)), gzip.compress(b"nichts, ") + gzip.compress(secret)
    apart = r"\u0022password\u0022: \u0022abcdef123456\u0022"
    for wrapped in ("password%3D hunter2hunter2", apart, b64(twice), b64(members), *(b64(x.encode() + b" " + secret) for x in ("\u00a0", "\0", "\f")), b64(b"\xff " + secret)):
        text = f"davor {wrapped} danach"
        every = [x for x in secrets.scan(text)[1] if x[1] == 0]
        assert every and all(6 <= s < e <= 6 + len(wrapped) for s, _, e in every), wrapped
        assert "hunter2" not in secrets.redact(text) and not [x for x in secrets.scan(secrets.redact(text))[1] if x[1] == 0]
    monkeypatch.setattr(secrets, "UNFOLD", 1000)
    for n in range(900, 1100, 7):  # over a limit, wherever the secret lies
        assert [x for x in secrets.scan(b64(zlib.compress(b"zu lang\n" * (n // 8) + b"." * (n % 8) + b"\n" + secret + b"\nund weiter" * 300)))[1] if x[1] == 0]


def wrappers(rng):
    b64 = lambda raw: base64.b64encode(raw).decode()
    return {
        "url": lambda t: "".join(f"%{b:02x}" if rng.random() < 0.5 or b in b"%= " else chr(b) for b in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04X}" for c in t),
        "base64": lambda t: b64(t.encode()),
        "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="),
        "lines": lambda t: "\n".join(b64(t.encode())[i : i + 24] for i in range(0, len(b64(t.encode())), 24)),
        **{n: lambda t, f=f: b64(f(t.encode())) for n, f in {"zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}.items()},
        "twice": lambda t: b64(gzip.compress(zlib.compress(t.encode()))),
    }


def test_nested_layers(spark):
    """Whatever wraps a secret, up to three layers deep, its span lies in the outermost code; what goes before the code does not hide it."""
    rng = np.random.default_rng(17)
    ways = wrappers(rng)
    for _ in range(300):
        text, names = f"x password = \"{''.join(rng.choice(list('abcdefghij123')) for _ in range(16))}\" y", []
        for n in rng.choice(list(ways), int(rng.integers(1, 4))):
            text = ways[n](text)
            names.append(str(n))
        before = str(rng.choice(["", "davor ", "x/", "id_", "abc+", "q"])) if names[-1] not in ("url", "unicode", "lines") else "davor\n"
        whole = f"{before}{text} danach"
        base, every = secrets.scan(whole)
        found = [x for x in every if x[1] == 0]
        assert found, (names, before)
        assert set(base) <= set(every) and any(len(before) - 4 < s and e <= len(before) + len(text) for s, _, e in found), (names, before)
        assert not [x for x in secrets.scan(secrets.redact(whole))[1] if x[1] == 0]


def unwrapped_by_hand(text, spans, depth=0):
    """Spans of secrets in a text and in all that it unwraps to, without any memory: URL, Unicode and base64 layers."""
    names = ("assign", "access", "hex")
    found = {(spans[m.start()][0], names.index(k), spans[m.end() - 1][1]) for k, m in hits_by_hand(text)}
    for pattern, decode in ((r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")), (r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}", lambda m: chr(int(m[0][2:], 16)))):
        out, at, done = "", [], 0
        for m in re.finditer(pattern, text):
            got = decode(m)
            out += text[done : m.start()] + got
            at += spans[done : m.start()] + [(spans[m.start()][0], spans[m.end() - 1][1])] * len(got)
            done = m.end()
        if done:
            found |= unwrapped_by_hand(out + text[done:], at + spans[done:], depth + 1)
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text):
        for first in range(4):
            code = m[0][first:].replace("-", "+").replace("_", "/")
            code = code[: len(code) - (len(code) % 4 == 1)]
            if len(code) < 12:
                continue
            raw, at, out = base64.b64decode(code + "=" * (-len(code) % 4)), [], raw_text(base64.b64decode(code + "=" * (-len(code) % 4)))
            n, begin = 0, m.start() + first
            for c in out:
                size = len(c.encode("utf-8", "surrogateescape"))
                lo, hi = n // 3 * 4, min(len(code), (n + size - 1) // 3 * 4 + 4)
                at.append((spans[begin + lo][0], spans[begin + hi - 1][1]))
                n += size
            assert n == len(raw)
            found |= unwrapped_by_hand(out, at, depth + 1)
    return found


def raw_text(raw):
    return raw.decode("utf-8", "surrogateescape")


def hits_by_hand(text):
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 12:
            yield "assign", m
    yield from (("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18)
    yield from (("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16)


def test_spans_of_layers():
    rng = np.random.default_rng(23)
    ways = {k: v for k, v in wrappers(rng).items() if k in ("url", "unicode", "base64", "urlsafe")}
    for i in range(250):
        text = f"x {rng.choice(['password = ', 'token:', 'AKIA', '', 'é '])}{''.join(rng.choice(list('abcdef0123XZ%'), 18))} y"
        for n in rng.choice(list(ways), int(rng.integers(1, secrets.DEEP))):
            text = f"{rng.choice(['', 'vor ', 'é', 'x=%20'])}{ways[n](text)}{rng.choice(['', ' nach', '%41'])}"
        assert set(secrets.scan(text)[1]) == unwrapped_by_hand(text, [(j, j + 1) for j in range(len(text))]), text


def test_deep_escapes_are_decoded_to_the_end():
    for wrap in (lambda n: "%" + "25" * n + "41", lambda n: "\\" + "u005c" * n + "u0041", lambda n: "%5Cu0025" + "5Cu0025" * n + "41"):
        for n in (0, 1, secrets.DEEP, 40, 5000):
            inner = "".join(wrap(n) if c == "A" else c for c in "password%3DhunterA2hunterA2")
            text = f"vor {inner} nach"
            assert (4, 0, 4 + len(inner)) in secrets.scan(text)[1], n
            assert "hunter" not in secrets.redact(text)


def test_heads_of_streams():
    body = zlib.compress(b"token = abcdefghijkl0123")
    named = b"\x1f\x8b\x08\x1c\0\0\0\0\0\x03" + b"\x04\0abcd" + b"name\0" + b"word\0" + body[2:-4]
    for raw in (named, gzip.compress(b"token = abcdefghijkl0123"), bz2.compress(b"token = abcdefghijkl0123"), lzma.compress(b"token = abcdefghijkl0123"), body):
        assert next(iter(secrets._heads(b"vor" + raw + b"nach"))) == 3
    assert list(secrets._heads(b"\x1f\x8b\x08\x08" * 1000)) == [] and len(list(secrets._heads(b"\x1f\x8b\x08\x08" * 1000 + b"\0" * 30))) <= 4
    assert list(secrets._heads(b"")) == [] and list(secrets._heads(b"\x1f\x8b\x08")) == [] and list(secrets._heads(b"x\x9c")) == []


def test_scan_takes_time_in_proportion():
    b64 = lambda b: base64.b64encode(b).decode()
    for text in ("%" + "25" * 400_000 + "41", "\\" + "u005c" * 60_000 + "u0041", b64(b"\x1f\x8b\x08\x08" * 180_000), b64(b"\x1f\x8b\x08\x08" * 90_000 + b"\0" * 99)):
        begin = time.process_time()
        secrets.scan(text)
        assert time.process_time() - begin < 8, text[:8]
    for text in ("a" * 1_000_000 + "% x", "\u4e2d" * 1_000_000 + "50%", "a" * 1_000_000 + "\\", "%41" * 300_000, "ab/" * 300_000, "YWFh" * 250_000 + "\nb"):
        begin = time.process_time()
        secrets.scan(text)
        assert time.process_time() - begin < 5


# 9


def links_by_hand(rows, k, num, den):
    sets, count = {}, Counter()
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        count[d] += 1
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    n = Counter({d: count[d] - 1 for d in sets if sets[d]})
    for d, s in sets.items():
        both = Counter(o for x in s for o in by[x] if o > d)
        for o, c in both.items():
            if den * c >= num * (len(s) + len(sets[o]) - c):
                n[d] += count[o]
                n[o] += count[d]
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(s), find(d), n[d]) for d, s in sets.items()}


def copies(rng, n, size, edits):
    base = [f"g{rng.integers(10**9)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(len(w)))] = f"e{rng.integers(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_links(spark, docs, k, num, monkeypatch):
    rng = np.random.default_rng(k)
    planted = [t for size in (3, 9, 12, 25, 80, 300) for t in copies(rng, 30, size, max(1, size // 40))]
    line = "eine sehr häufige Zeile mit genau elf Worten steht hier überall "
    planted += [line * int(rng.integers(1, 4)) + t for t in planted[::3]] + ["ein wort", "Ein WORT", "", " "]
    rows = texts_of(docs) + [(10_000 + i, t) for i, t in enumerate(planted)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = links_by_hand(rows, k, num, 100)
    for blocks in (jaccard.BLOCK_DOCS, 7):  # in one block, and in pairs of blocks
        monkeypatch.setattr(jaccard, "BLOCK_DOCS", blocks)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(df, k, num, 100).collect()}
        assert got == want
    kept = jaccard.one_of_each_group(df, k, num, 100)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want.values()})


def test_links_on_odd_rows(odd, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in jaccard.similar_documents(odd).collect())
    long = max(r[1] for r in got)
    assert got == sorted([(1, 118, 1, 4), (2, 118, 1, 4), (2, 118, 1, 4), (3, 119, 1, 4), (4, 0, 4, 0), (5, 0, 5, 0), (6, 0, 6, 0), (7, long, 7, 0), (8, 1, 8, 0), (8, 1, 8, 0), (-1, 118, 1, 4), (-1, 0, -1, 0), (9, 1, 9, 1), (10, 1, 9, 1), (11, 1, 11, 0)])
    kept = jaccard.one_of_each_group(odd)
    # two unlike texts of one doc_id are no group
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 8, 8, 9, 11]
    assert jaccard.similar_documents(none).count() == 0


def test_rows_of_one_document_are_judged_by_their_texts(spark):
    some = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    near = some("a").replace("a30", "anders")
    rows = [(8, "kurz"), (8, some("b")), (8, near), (8, some("b")), (3, some("a")), (9, some("b") + " mehr"), (7, some("c")), (7, some("c").upper()), (5, None), (5, ""), (5, None), (None, some("a")), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kept_doc int, kept_text string").repartition(3)
    kept = jaccard.one_of_each_group(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == Counter({(8, "kurz"): 1, (8, some("b")): 1, (3, some("a")): 1, (7, some("c")): 1, (5, ""): 2, (None, some("a")): 1, (None, ""): 1})


# 10


def test_roles(spark, sf_dir):
    conv = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "conversations")
    rows = chat.recovered_turns(conv).collect()
    assert len(rows) == conv.count() and np.mean([r.role == r.recorded for r in rows]) > 0.95


def test_segments_make_no_difference(spark, sf_dir, monkeypatch):
    conv = table(spark, sf_dir, "conversations").withColumn("conv_id", F.col("conv_id") % 2).withColumn("turn", F.col("turn") + 10 * (F.xxhash64("text") % 1000))
    messages = [(r.conv_id, r.turn, r.text, r.role) for r in conv.collect()]
    want = sorted((r.conv_id, r.turn, r.role, r.piece_sha256) for r in chat.recovered_turns(conv).collect())
    model = chat._counted(chat._sorted(conv))
    for c in (0, 1):
        own = sorted(m for m in messages if m[0] == c)
        path = [chat.ROLES[i] for i in model.path(model.emitted([m[2] for m in own]), None, None)]
        assert [(m[0], m[1], p) for m, p in zip(own, path, strict=True)] == [w[:3] for w in sorted(want) if w[0] == c]


def test_render_and_parse():
    model = chat.Model(np.array([1.0, 9, 1]), np.array([[1.0, 9, 1], [0, 1, 9], [0, 9, 1]]), np.ones((3, sum(chat.SIZES))))
    model.seen[1, 2] += 3  # user markers in users' lines
    model.seen[2, 3] += 3
    text = "User: Hallo\nwie geht es?\n\nAssistant: Gut.\n\nUser: Schön"
    found = chat.parse_transcript(text, model)
    assert [r for r, _ in found] == ["user", "assistant", "user"]
    assert chat.render(found) == "<|user|>\nHallo\nwie geht es?\n<|end|>\n<|assistant|>\nGut.\n<|end|>\n<|user|>\nSchön\n<|end|>\n"
    assert chat.parse_transcript(" \n", model) == [] and chat.render([]) == ""


def test_words_with_hyphens_are_no_markers():
    for text in ("AI-generated pictures", "A-level exams", "User-friendly tools"):
        assert chat.render([("user", text)]) == f"<|user|>\n{text}\n<|end|>\n" and chat.observed(text)[0] == 1
    assert chat.render([("user", "User - Hallo")]) == "<|user|>\nHallo\n<|end|>\n"


def test_roles_on_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (None, 0, "x", ""), (2, 0, None, "Q: was?\nA: das")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    assert chat.recovered_turns(df).count() == len(rows)
    assert chat.recovered_turns(df.where("false")).count() == 0
