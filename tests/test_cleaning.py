"""Options of a cleaning request, row by row."""

from pyspark.sql import functions as F

from lectern.operators.cleaning import cleaned_documents, options


def test_options(spark):
    rows = [("{}", (True, False, "")), (None, (True, False, "")), ('{"pii_removal": true}', (True, True, "")), ('{"extract_images": false, "use_case": "x"}', (False, False, "x")), ("kein json", (True, False, ""))]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(rows)], "i int, c string")
    got = {r.i: tuple(r.o) for r in df.select("i", options(F.col("c")).alias("o")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_cleaned_documents(spark):
    page = [(1, "Mail an a@b.at bitte"), (2, "zweite")]
    rows = [(i, "Mail an a@b.at", page, [(1, "x.png"), (7, "y.png"), (None, "z.png")], c) for i, c in enumerate(("{}", '{"pii_removal": true}', '{"extract_images": false}'))]
    df = spark.createDataFrame(rows + [(3, "leer", [], [], None)], "i int, markdown string, pages array<struct<page:bigint,text:string>>, images array<struct<page:bigint,name:string>>, config string")
    got = {r.i: r for r in cleaned_documents(df, describe=lambda c: F.when(c != "", F.concat(F.lit("Alt: "), c)).otherwise("")).collect()}
    assert got[0].markdown == "Mail an a@b.at\n\n<!-- image page:1 -->\n[Bild S.1]: Alt: Mail an a@b.at bitte"
    assert got[1].markdown == "Mail an [EMAIL_REMOVED]\n\n<!-- image page:1 -->\n[Bild S.1]: Alt: Mail an [EMAIL_REMOVED] bitte" and got[1].pages[0].text == "Mail an [EMAIL_REMOVED] bitte"
    assert got[2].markdown == "Mail an a@b.at" and got[2].images == [] and got[0].images[1].alt == ""
    assert got[3].markdown == "leer" and got[3].pages == [] and got[3].images == []
