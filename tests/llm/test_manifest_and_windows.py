"""The Merkle manifest and the rolling features against plain versions and SQL, and on odd rows."""

import hashlib
import math
import zlib
from bisect import bisect_left
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lectern.llm import merkle, queries, rolling
from lectern.llm.common import group_ids, whole_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, h string, block int, event_s string"
LONG = "Ä b " * 100_000


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def odd_rows():
    rows = [(1, "Abc", "en", "q"), (2, "Abc", "en", "q"), (2, "Abc", "en", "q"), (2, "x", None, "q"), (3, None, "de", None), (None, "t", "en", None), (None, "t", "en", "q"), (4, "", "de", "é"), (5, LONG, "fr", "Z"), (6, "ß", "en", "")]
    return [(d, t, la, s, None if t is None else len(t), "k", 1, "h", 2, "e") for d, t, la, s in rows]


def many_rows():
    """Sources of 1, 16, 17, 256, 257 and 9000 rows."""
    sizes = {"one": 1, "run": 16, "more": 17, None: 256, "c": 257, "big": 9000}
    out, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((i * 7 % 20011, f"Text {i % 50}", "en" if i % 3 else None, s, i % 9 or None, "k", 1, "h", 2, "e"))
            i += 1
    return out


def manifest_by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest("".join(map(field, (r[0], r[3], r[2], r[4], t))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            lo = i // 16 * 16
            out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
            i //= 16
        return out

    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        by[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lowered) if hit else None))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    outer = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (known, d, h, t) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            sides, f = path(trees[k], i) + path(outer, k), t or h
            for a, b in sides:
                f = digest(a + f + b)
            root = outer[-1][0]
            out.append((d if known else None, h, trees[k][-1][0], root, digest("".join(a + b for a, b in sides)), f, f == root))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("make", [odd_rows, many_rows])
def test_manifest(spark, make):
    got = merkle.verified_documents(spark.createDataFrame(make(), SCHEMA).repartition(5)).collect()
    want = manifest_by_hand(make())
    assert sorted_rows(got) == sorted_rows(want)
    assert len({r[3] for r in want}) == 1 and {r[6] for r in want} == ({True} if make is odd_rows else {True, False})


def test_sources_of_a_manifest(spark):
    made = merkle.manifest(spark.createDataFrame(many_rows(), SCHEMA))
    want = {(r[2], r[3]) for r in manifest_by_hand(many_rows())}
    got = made.sources().collect()
    assert len(got) == 6 and {(r.subroot, r.root) for r in got} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_documents(none).collect() == [] and rolling.rolling_features(none).collect() == []


def windows_by_hand(rows):
    time = [None if r[0] is None else 60 * math.floor((r[0] + zlib.crc32(str(r[0]).encode()) % 1000) / 6) for r in rows]
    by = defaultdict(list)
    for r, t in zip(rows, time, strict=True):
        if t is not None:
            by[r[3]].append((t, r[2] or "", r[2], None if r[1] is None else len(r[1])))
    for v in by.values():
        v.sort(key=lambda x: x[:2])
    out = []
    for r, t in zip(rows, time, strict=True):
        for w in (1800, 86400):
            seen = [] if t is None else by[r[3]][bisect_left(by[r[3]], (t - w,)) : bisect_left(by[r[3]], (t,))]
            some = sorted(x[3] for x in seen if x[3] is not None)
            m = len(some)
            out.append((r[0], w, t, len(seen), sum(some), len({x[2] for x in seen} - {None}), some[-(-m // 2) - 1] if m else None, some[-(-99 * m // 100) - 1] if m else None))
    return out


def test_windows(spark):
    rng = np.random.default_rng(5)
    rows = odd_rows() + [(int(d) - 500, None if k == 0 else "é" * int(k), [None, "a", "b", "c"][int(x)], [None, "hot", "hot", "s"][int(s)], 0, "k", 1, "h", 2, "e") for d, k, x, s in rng.integers(0, (4000, 40, 4, 4), (900, 4))]
    rows += rows[:200] + [(77, "x" * i, "a", "hot", 0, "k", 1, "h", 2, "e") for i in range(300)]
    got = rolling.rolling_features(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted_rows(got) == sorted_rows(windows_by_hand(rows))


def test_tasks_take_several_groups_of_both_widths(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    got = rolling.rolling_features(docs.coalesce(1)).collect()
    assert sorted_rows(got) == sorted_rows(windows_by_hand(rows))


def test_selection_from_two_trees():
    rng = np.random.default_rng(2)
    value, weight = rng.integers(0, 13, 60), rng.integers(1, 4, 60)
    a, b = (rolling.Forest(np.zeros(30, np.int64), value[s], weight[s], 4) for s in (slice(0, 30), slice(30, 60)))
    for i, j in ((0, 0), (29, 3), (12, 29), (-1, 8), (20, -1)):
        both = np.sort(np.concatenate([np.repeat(value[: i + 1], weight[: i + 1]), np.repeat(value[30 : 31 + j], weight[30 : 31 + j])]))
        k = np.arange(1, len(both) + 1)
        assert (rolling.select(a, b, np.full(len(k), i), np.full(len(k), j), k) == both).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted_rows(df.select(*names).collect()) == sorted_rows(cursor.fetchall())


def test_whole_groups():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a, b = np.sort(rng.integers(0, 30, 500)), None
    b = [None if x % 4 == 0 else f"{x % 4}" for x in a]
    t = pa.table({"a": a, "b": pa.array(b)})
    parts = list(whole_groups(iter(t.to_batches(max_chunksize=7)), ["a", "b"], 50))
    assert pa.concat_tables(parts).equals(t.combine_chunks()) or pa.concat_tables(parts).to_pylist() == t.to_pylist()
    ends = [set(p.column("a").to_pylist()) for p in parts]
    assert all(not x & y for x, y in zip(ends, ends[1:], strict=False)) and max(p.num_rows for p in parts) < 130
    assert group_ids(t, ["a", "b"])[-1] == len(set(a.tolist())) - 1
