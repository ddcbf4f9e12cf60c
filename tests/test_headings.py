"""Headings and breadcrumbs against a plain stack, chunks under their headings, and long documents."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern.operators import chunking as C


def crumbs_by_hand(text):
    out, stack, off = [], [], 0
    for line in text.split("\n"):
        if m := re.match(r"(#{1,6})[^\S\n]+(\S.*?)\s*$", line):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            out.append((off, len(m[1]), m[2], " > ".join(t for _, t in stack[:3])))
        off += len(line) + 1
    return out


def test_breadcrumbs(spark):
    rng = random.Random(1)
    texts = ["", "# a", "\n# a\n", "#a\n# \n####### sieben\n ## eingerückt", "vor\n## b  \r\n# ä ö # x\ntext # kein"]
    texts += ["\n".join(rng.choice(["#" * rng.randrange(1, 8) + rng.choice([" ", "  ", "", "\t"]) + rng.choice(["T", "ü x", "", "y#"]) + str(i), "Text", "", "a # b"]) for i in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc int, text string")
    rows = C.breadcrumbs(C.heading_rows(df, "doc").withColumn("kind", F.lit(0)), "doc").where("level > 0").orderBy("doc", "off").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc, []).append((r.off, r.level, r.title, r.breadcrumb))
    assert got == {i: c for i, t in enumerate(texts) if (c := crumbs_by_hand(t))}


def test_chunks_look_up_their_headings(spark):
    rng = random.Random(4)
    text = "\n\n".join("#" * rng.randrange(1, 5) + f" Titel {i}\n\n" + f"Satz Nummer {i} steht hier mit genug Worten. " * rng.randrange(0, 30) for i in range(80))
    rows = C.chunked(spark.createDataFrame([(1, text), (2, "Kein Titel, aber ein Satz mit genug Worten darin.")], "doc int, text string"), "doc", F.concat(F.lit("f"), F.col("doc").cast("string"))).collect()
    heads = crumbs_by_hand(text)
    for r in rows:
        body = r.text.split("]\n\n", 1)[1]
        if r.doc == 2:
            assert r.text.startswith("[f2]\n\n") and r.breadcrumb == ""
            continue
        places = [m.start() for m in re.finditer(re.escape(body), text)]
        assert places and any(r.breadcrumb == ([""] + [h[3] for h in heads if h[0] <= at])[-1] for at in places)
        assert r.text == f"[f1 | {r.breadcrumb}]\n\n{body}" or r.breadcrumb == ""


def test_many_headings_take_time_in_proportion(spark):
    text = "\n".join(f"{'#' * (i % 6 + 1)} Titel {i}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc int, text string")
    C.breadcrumbs(C.heading_rows(df.limit(0), "doc").withColumn("kind", F.lit(0)), "doc").count()
    began = time.time()
    made = C.breadcrumbs(C.heading_rows(df, "doc").withColumn("kind", F.lit(0)), "doc").where("level > 0")
    assert made.agg(F.count("*"), F.max("off")).first()[0] == 100_000 and time.time() - began < 20
