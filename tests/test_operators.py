"""Cases of single operators, edge cases among them."""

import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import providers
from lectern.functions import text as T
from lectern.operators import agents, chunking, enrich, pages, ranking, vectors
from lectern.operators import tables as tab
from lectern.sources import files, office


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "label"),
    [("Kontakt: max.mustermann@firma.at für Infos", "[EMAIL_REMOVED]"), ("Tel: +43 1 234567", "[PHONE_REMOVED]"), ("Fax: 0043 664 1234567", "[PHONE_REMOVED]"), ("Ruf: 0664 1234567", "[PHONE_REMOVED]"), ("Server: 192.168.1.100 ist erreichbar", "[IP_REMOVED]")],
)
def test_pii(spark, text, label):
    assert label in one(spark, T.redact_pii, text)


def test_pii_leaves_other_text(spark):
    assert one(spark, T.redact_pii, "Hydraulikdruck zu hoch, Alarm 47") == "Hydraulikdruck zu hoch, Alarm 47"
    assert one(spark, T.redact_pii, None) is None


@pytest.mark.parametrize(("text", "area"), [("Hydraulikdruck zu hoch", "hydraulik"), ("Spannung am Motor prüfen", "elektrik"), ("Lager austauschen", "mechanik"), ("Allgemeine Information", "allgemein")])
def test_area(spark, text, area):
    assert one(spark, lambda c: enrich.first_label(c, enrich.AREAS), text) == area


@pytest.mark.parametrize(
    ("text", "collection", "operation"),
    [("N10 G01 X100 F0.3 S1200", "gw_cnc_steps", "Linearfraesen"), ("N20 G02 X50 Y50 S800", "gw_cnc_steps", "Kreisinterpolation"), ("N30 G81 X10 Z-5 S600", "gw_cnc_steps", "Bohren"), ("Fräskopf Typ A wechseln", "gw_ruest_data", "unbekannt"), ("Materialangabe Stahl", "gw_material_info", "unbekannt")],
)
def test_cnc(spark, text, collection, operation):
    assert one(spark, enrich.cnc_collection, text) == collection
    assert one(spark, enrich.operation, text) == operation


def test_speed_and_law(spark):
    assert one(spark, enrich.cutting_speed, "N10 G01 X100 F0.3 S1200") == 1200
    assert one(spark, enrich.cutting_speed, "ohne") is None
    assert "§ 34" in one(spark, enrich.law_ref, "Gemäß § 34 Abs. 2 EisbG ist die Verordnung bindend.")


@pytest.mark.parametrize(("text", "n"), [("Wort " * 250, 2), ("Wort " * 450, 3), ("Wort " * 450 + "§ 34 Abs. 2 EisbG Nennspannung", 5)])
def test_difficulty(spark, text, n):
    assert one(spark, enrich.difficulty, text) == n


def test_unknown_plugin():
    with pytest.raises(ValueError, match="unknown use case"):
        enrich.plugin("fehlt")


@pytest.mark.parametrize("name", ["chunk-1", "Straße ü", "", "6BA7B810-9dad-11d1-80b4-00c04fd430c8"])
def test_point_id(spark, name):
    want = name.lower() if name.count("-") == 4 else str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, vectors.point_id, name) == want


def test_top_k_ties_and_filters(spark):
    points = spark.createDataFrame([(i, [(i + 1) * 0.1] * 4, "M-1" if i < 5 else "M-2") for i in range(6)], "vec_id long, embedding array<double>, machine string")
    assert [r.vec_id for r in vectors.top_k(points, [1.0] * 4, 3).collect()] == [0, 1, 2]
    assert vectors.top_k(points, [1.0] * 4, 10, filters={"machine": "M-1"}).count() == 5
    q = spark.createDataFrame([(1, [1.0] * 4), (2, [0.0] * 4)], "query_id int, qv array<double>")
    rows = vectors.top_k_batch(points, q, 2, "query_id", "qv").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in rows] == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.0)]
    assert vectors.top_k_batch(points, q.where("false"), 2, "query_id", "qv").count() == 0


def test_pages(spark):
    md = spark.createDataFrame([(1, "Titel\n<!-- Page 3 -->\neins<!-- page:4 -->  <!--page 5-->fünf"), (2, "ohne"), (3, "")], "doc int, text string")
    got = {(r.doc, r.page, r.text.strip()) for r in pages.split_pages(md, "doc").collect()}
    assert got == {(1, None, "Titel"), (1, 3, "eins"), (1, 5, "fünf"), (2, None, "ohne"), (3, None, "")}


def test_repeating_lines_need_three_pages(spark):
    rows = [(1, p, f"Kopf Seite {p}\nText {chr(97 + p) * 5}") for p in range(3)] + [(2, p, "Kopf Seite 1") for p in range(2)]
    df = spark.createDataFrame(rows, "doc int, page int, text string")
    assert [(r.doc, r.k) for r in pages.repeating_lines(df, "doc", "page").collect()] == [(1, "Kopf Seite #")]
    assert all("Kopf" not in r.text for r in pages.strip_repeating(df, "doc", "page").where("doc = 1").collect())


def test_boilerplate(spark):
    table = "| Fa 20 | Signal eins | Ersatz |\n| Fa 21 | Signal zwei | Ersatzsignal am Pult |"
    for text, want in (("Some content.", True), (table, False), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", True), ("Kapitel eins zwei drei" + "." * 60, True), ("Ein ganz normaler Satz mit Inhalt, der bleibt.", False)):
        assert one(spark, chunking.boilerplate, text) is want


def test_packing():
    text = " ".join(f"Satz {i} hat einige Worte mehr." for i in range(200)) + "\n\n" + "x " * 700
    made = chunking.packed(text)
    assert all(n <= chunking.CHUNK_TOKENS for _, _, n in made)
    assert all(text[at:].startswith(c) for at, c, _ in made)
    covered = set()
    for at, c, _ in made:
        covered |= set(range(at, at + len(c)))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert chunking.packed("") == []


def test_chunks_have_their_own_headings(spark):
    same = "Dieser Satz steht auf zwei Seiten gleich."
    md = f"# T\n<!-- page:1 -->\n## eins\n\n{same}\n<!-- page:2 -->\n{'Vor. ' * 300}\n\n## zwei\n\n{same}\n<!-- page:3 -->\n{same}"
    rows = chunking.chunked(spark.createDataFrame([(1, md)], "doc int, text string"), "doc", F.lit("f")).collect()
    assert {(r.page, r.breadcrumb) for r in rows if r.text.endswith(f"]\n\n{same}")} == {(3, "T > zwei")}


def test_whole_documents_are_chunked(spark, tmp_path):
    from lectern.plans.chunks import chk_pipeline

    spark.createDataFrame([(0, "Ein Satz mit einigen Worten. " * 400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r.tokens for r in chk_pipeline(spark, str(tmp_path)).collect()) >= 400 * 6


def test_agent_text(spark):
    r = one(spark, agents.parse_action, 'THOUGHT: …\nACTION: SEARCH({"query": "Hydraulik", "collection": "neumann_machines"})')
    assert (r.action, r.args) == ("SEARCH", '{"query": "Hydraulik", "collection": "neumann_machines"}')
    assert one(spark, agents.parse_action, "Einfach eine Antwort ohne Format.").action == "FINAL_ANSWER"
    assert one(spark, lambda c: agents.balanced_json(c, F.lit(1)), '{"a": "offen"') is None
    assert one(spark, agents.no_info, "  ") and not one(spark, agents.no_info, "Der Druck beträgt 3 bar.")


def test_ranking(spark):
    hits = spark.createDataFrame([(1, 0.8), (1, 0.6), (1, 0.7), (2, 0.8), (2, 0.3), (3, 0.5), (3, 0.5)], "q int, score double")
    got = {r.q: (r.sufficient, r.reason) for r in ranking.sufficiency(hits, "q").collect()}
    assert got[1][0] and got[3][0] and not got[2][0] and "1 Chunk " in got[2][1] and "mindestens 2" in got[2][1]
    assert [one(spark, ranking.relevance, x, "double") for x in (5.0, 1.0, -1.0, -5.0)] == ["highly_relevant", "relevant", "marginally_relevant", "not_relevant"]
    assert one(spark, ranking.citation_refs, "Erst [2], dann [01] und [2].") == [2, 1]


def test_tables(spark):
    df = spark.createDataFrame([(0, "a@b.at und A@b.at"), (1, None)], "n int, c string")
    found = tab.cells(df, ["c"], "n")
    assert [r.text for r in tab.rewritten(found, tab.detections(found)).orderBy("row_idx").collect()] == ["[EMAIL_1] und [EMAIL_1]", ""]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"gut \xff schlecht")
    assert files.read_text(spark, f"file://{tmp_path}").first().text == "gut � schlecht"
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Absatz</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "o").mkdir()
    with zipfile.ZipFile(tmp_path / "o" / "b.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "o" / "c.docx").write_bytes(b"kein zip")
    got = {r.file_name: r for r in office.read_office(spark, f"file://{tmp_path}/o").collect()}
    assert got["b.docx"].text == "Absatz\n\n| a |\n| --- |" and got["b.docx"].error is None and got["c.docx"].error


def test_providers(spark):
    assert sum(one(spark, providers.hash_embed, "drei Worte hier")) == 3
    assert sum(one(spark, providers.hash_embed, "")) == 0
    with pytest.raises(ValueError, match="no provider"):
        providers.provider("fehlt")


def test_retries_of_a_service(spark):
    from lectern.sources import parsers

    slept, left = [], [2]

    def flaky():
        if left[0]:
            left[0] -= 1
            raise TimeoutError("weg")
        return "da"

    assert parsers.waits() == [5, 10] and parsers.with_retries(flaky, sleep=slept.append) == "da" and slept == [5, 10]
    left[0] = 9
    with pytest.raises(RuntimeError, match="after 3 attempts"):
        parsers.with_retries(flaky, sleep=slept.append)
    with pytest.raises(ValueError):
        parsers.with_retries(lambda: int("x"), sleep=slept.append)
    files = spark.createDataFrame([("a.pdf", bytearray(b"eins\f\fdrei")), ("b.pdf", bytearray(b"x"))], "file_name string, content binary")

    def call(name, content):
        if name == "b.pdf":
            raise KeyError("kaputt")
        return f"{name}: {len(content)}"

    assert [(r.file_name, r.answer, r.error is None) for r in parsers.ocr_answers(files, call).orderBy("file_name").collect()] == [("a.pdf", "a.pdf: 10", True), ("b.pdf", None, False)]
    pages = parsers.parsed_pages(files, lambda c: c.decode().split("\f"))
    from lectern.operators.pages import assemble_pages

    made = {r.file_name: (r.total_pages, r.text) for r in assemble_pages(pages, "file_name", "page").collect()}
    assert made == {"a.pdf": (3, "<!-- page:1 -->\neins\n\n<!-- page:3 -->\ndrei"), "b.pdf": (1, "<!-- page:1 -->\nx")}


def test_logs_grow(spark, tmp_path):
    from lectern.operators import records as R

    for text in ("a", "b"):
        R.append_lines(spark.createDataFrame([(text,)], "value string"), f"file://{tmp_path}/log")
        R.append_rows(spark.createDataFrame([(text, True)], "id string, sufficient boolean"), "queries", f"file://{tmp_path}/queries")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/log").collect()) == ["a", "b"]
    assert sorted((r.id, r.sufficient, r.role) for r in spark.read.parquet(f"file://{tmp_path}/queries").collect()) == [("a", True, None), ("b", True, None)]
    with pytest.raises(ValueError, match="no column x"):
        R.append_rows(spark.createDataFrame([(1,)], "x int"), "queries", f"file://{tmp_path}/queries")


def test_settings_and_kept_values(spark):
    from lectern.operators import records as R

    raw = [None, "", "12", " -3 ", "1_000", "5.0", "5d", "abc", "1e3", ".5", "inf"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert [r[0] for r in df.select(R.whole_number(df.raw, 7)).collect()] == [7, 7, 12, -3, 1000, 7, 7, 7, 7, 7, 7]
    assert [r[0] for r in df.select(R.real_number(df.raw, 0.25)).collect()] == [0.25, 0.25, 12, -3, 1000, 5, 0.25, 0.25, 1000, 0.5, float("inf")]
    now, reads = [0.0], []
    kept = R.Kept(lambda: reads.append(1) or len(reads), 60, lambda: now[0])
    assert [kept.get(), kept.get()] == [1, 1]
    now[0] = 60
    assert kept.get() == 2
    kept.forget()
    assert kept.get() == 3


def test_points_are_written_and_removed(spark):
    from lectern.operators import vectors as V

    batch = lambda rows: spark.createDataFrame(rows, "chunk_id string, vector array<double>, metadata map<string,string>, seq long")
    first = V.upserted(None, batch([("a", [1.0], {"x": "1", "_embed_model": "alt", "chunk_id": "falsch"}, 9), ("b", [2.0], None, 1)]), "wl_x", "m1")
    then = V.upserted(first, batch([("a", [3.0], {"x": "2"}, 1)]), "wl_x")
    got = {r.chunk_id: (r.vector, r.payload) for r in then.collect()}
    assert got == {"a": ([3.0], {"x": "2", "chunk_id": "a"}), "b": ([2.0], {"_embed_model": "m1", "chunk_id": "b"})}
    assert first.where("chunk_id = 'a'").first().payload == {"x": "1", "_embed_model": "m1", "chunk_id": "a"}
    assert V.upserted(then, batch([]), "wl_x").count() == 2
    assert V.without_collection(then, "wl_x").count() == 0
    with pytest.raises(ValueError, match="not found"):
        V.without_collection(then, "fehlt")


def test_error_events_end_the_stream(spark):
    from lectern.streaming import trace as Z

    lines = spark.createDataFrame([('{"request_id": "r", "type": "step", "seq": 1}',), ("kein json",), ('{"request_id": "r", "type": "error", "text": "vorbei"}',)], "value string")
    events = Z.parsed(lines)
    assert Z.checked(events.where("type <> 'error'")).count() == 1
    with pytest.raises(Exception, match="vorbei"):
        Z.checked(events).collect()
