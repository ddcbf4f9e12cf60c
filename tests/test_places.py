"""Places of rows within keys, found without a window over a key."""

from collections import defaultdict

from lectern.operators.places import placed


def test_places(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3 // 2}", i * 37 % 101, i) for i in range(500)]
    got = placed(spark.createDataFrame(rows, "key string, a int, b int").repartition(6), ["key"], ["a", "b"], "pos", "n").collect()
    want = defaultdict(list)
    for k, a, b in rows:
        want[k].append((a, b))
    assert {(r.key, r.a, r.b, r.pos, r.n) for r in got} == {(k, *x, i, len(v)) for k, v in want.items() for i, x in enumerate(sorted(v))}
