"""CSV files, workbooks and parsed pages: whole files, odd ones, and errors that stop no other; nested protocols."""

import csv
import io
import json
import zipfile

from pyspark.sql import functions as F

from lectern.operators.protocol import cleaned, protocol
from lectern.providers import batch_report, embedded_batch
from lectern.sources import files, office, parsers


def test_csv_files(spark, tmp_path):
    table = [["id", "name", "note"], ["1", 'sagt "ja"', "a,b"], ["2", "zwei\r\nZeilen", ""], ["3", 'mitten " drin', "ü"], [], ["4", "kurz"]]
    text = io.StringIO(newline="")
    csv.writer(text).writerows(table)
    made = {
        "gut.csv": text.getvalue().encode(), "marke.csv": b"\xef\xbb\xbfa,b\n1,2\n", "leer.csv": b"\xef\xbb\xbf", "nur.csv": b"\xef\xbb\xbfa;b,c\r\n", "bytes.csv": b"a,b\n\xff\xfe,1\n",
        "lang.csv": b"x,y\n" + b"".join(b"%d,z\n" % i for i in range(12_000)), "riesig.csv": b'a\n"' + b"x" * 140_000 + b'"\n', "offen.csv": b'a,b\n1,"nie zu\n2,3\n',
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "ohne.csv").write_bytes(b"")
    rows = {}
    for r in files.read_csv_files(spark, f"file://{tmp_path}/*.csv").collect():
        rows.setdefault(r.file_name, []).append(r)
    assert set(rows) == set(made)
    for name, content in made.items():
        got = sorted(rows[name], key=lambda r: r.page)
        try:
            want = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
        except (UnicodeDecodeError, csv.Error) as e:
            assert len(got) == 1 and got[0].page == 0 and got[0].error == f"{type(e).__name__}: {e}" and name in ("bytes.csv", "riesig.csv")
            continue
        assert [r.page for r in got] == list(range(len(want) + 1)) and [r.text for r in got[1:]] == [" | ".join(r) for r in want]
        assert got[0].row_count == max(0, len(want) - 1) and got[0].columns == (want[0] if want else []) and got[0].error is None
    assert len(rows["lang.csv"]) == 12_002 and len(rows["leer.csv"]) == 1


def workbook(rows, sheets=1):
    """A workbook with shared strings, numbers, booleans and inline texts."""
    strings, cells = [], []
    for i, row in enumerate(rows, 1):
        line = ""
        for j, x in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if isinstance(x, bool):
                line += f'<c r="{at}" t="b"><v>{int(x)}</v></c>'
            elif isinstance(x, (int, float)):
                line += f'<c r="{at}"><v>{x}</v></c>'
            elif isinstance(x, str) and x.startswith("="):
                line += f'<c r="{at}" t="str"><f>A1</f><v>{x[1:]}</v></c>'
            elif isinstance(x, str) and len(x) % 2:
                line += f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
            elif isinstance(x, str):
                strings.append(x)
                line += f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>'
        cells.append(f'<row r="{i}">{line}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {space}><sheets>" + "".join(f'<sheet name="Blatt {n}"/>' for n in range(sheets)) + "</sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        for n in range(sheets):
            z.writestr(f"xl/worksheets/sheet{n + 1}.xml", f"<worksheet {space}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, sf_dir, tmp_path):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    table = [["n_nationkey", "n_name", None, "odd"]] + [[r.n_nationkey, r.n_name, None, r.n_nationkey % 2 == 1] for r in nation]
    (tmp_path / "nation.xlsx").write_bytes(workbook(table))
    (tmp_path / "art.XLSX").write_bytes(workbook([[], ["a", "b"], [1.5, "=formel"], ["zu", "viel", "hier"], [None, None], [False]]))
    (tmp_path / "zwei.xlsx").write_bytes(workbook([["a"]], sheets=2))
    (tmp_path / "leer.xlsx").write_bytes(workbook([]))
    (tmp_path / "kaputt.xlsx").write_bytes(b"PK kein zip")
    (tmp_path / "alt.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    rows = {}
    for r in office.read_workbooks(spark, f"file://{tmp_path}/*", at_a_time=7).collect():
        rows.setdefault(r.file_name, []).append(r)
    plain = lambda c: c.text if c.text is not None else c.number if c.number is not None else c.flag
    got = sorted(rows["nation.xlsx"], key=lambda r: r.row)
    assert got[0].headers == ["n_nationkey", "n_name", "Spalte 3", "odd"] and got[0].sheet == "Blatt 0"
    assert [[plain(c) for c in r.cells] for r in got[1:]] == [[float(k), n, None, o] for k, n, _, o in table[1:]]
    assert all(isinstance(plain(r.cells[0]), float) and isinstance(plain(r.cells[3]), bool) for r in got[1:])
    assert [[plain(c) for c in r.cells] for r in sorted(rows["art.XLSX"], key=lambda r: r.row)[1:]] == [[1.5, "formel"], ["zu", "viel"], [False, None]]
    for name, part in {"zwei.xlsx": "one sheet, not 2", "leer.xlsx": "no rows", "kaputt.xlsx": "BadZipFile", "alt.xls": "only .xlsx"}.items():
        assert len(rows[name]) == 1 and part in rows[name][0].error


def test_one_file_fails_alone(spark):
    f = spark.createDataFrame([("a", b"x\fy"), ("b", b"!"), ("c", b"")], "file_name string, content binary")

    def parse(content):
        if content == b"!":
            raise ValueError("kein PDF")
        return content.decode().split("\f")

    got = {(r.file_name, r.page, r.text, r.error) for r in parsers.parsed_pages(f, parse).collect()}
    assert got == {("a", 1, "x", None), ("a", 2, "y", None), ("b", None, None, "ValueError: kein PDF"), ("c", 1, "", None)}


def clean_by_hand(v):
    """What stays of a record's value; null if nothing does."""
    if isinstance(v, list):
        return [clean_inside(x) for x in v] or None
    if isinstance(v, dict):
        return {k: c for k, x in v.items() if (c := clean_by_hand(x)) is not None} or None
    return v


def clean_inside(v):
    return [clean_inside(x) for x in v] if isinstance(v, list) else {k: c for k, x in v.items() if (c := clean_by_hand(x)) is not None} if isinstance(v, dict) else v


def test_cleaned(spark):
    kind = "a int, b array<int>, c struct<d:string,e:array<struct<f:int,g:array<string>>>>, h map<string,string>, i array<array<int>>, j struct<k:struct<l:int>>, m map<string,array<int>>"
    values = [
        {"a": None, "b": [], "c": {"d": None, "e": [{"f": None, "g": []}, {"f": 1, "g": [None, ""]}]}, "h": {"x": None, "y": ""}, "i": [[], [1, None]], "j": {"k": {"l": None}}, "m": {"x": [], "y": [1]}},
        {"a": 0, "b": [None], "c": {"d": "", "e": []}, "h": {}, "i": [], "j": {"k": {"l": 2}}, "m": {}},
        {"a": None, "b": None, "c": None, "h": None, "i": None, "j": None, "m": None},
    ]
    df = spark.read.schema(f"v struct<{kind.replace(' ', ':').replace(',:', ',')}>").json(spark.sparkContext.parallelize([json.dumps({"v": v}) for v in values]))
    got = [json.loads(r.j) if r.j else None for r in df.select(F.to_json(cleaned(F.col("v"), df.schema["v"].dataType)).alias("j")).collect()]
    assert got == [clean_by_hand(v) for v in values]


def test_protocol(spark):
    step = {"step": 1, "thought": "", "action": "SEARCH", "args": {"q": "x"}, "observation": None, "chunks": [{"t": "c"}], "llm_response": "roh", "subagent_id": "s", "subagent_role": None}
    rows = [
        {"k": 1, "index": 0, "role": "user", "text": "f", "duration_ms": 5, "enriched_query": "f", "agent_steps": [], "sub_agents": [], "error": None, "sufficient": None, "citations": []},
        {"k": 1, "index": 1, "role": "assistant", "text": "a", "duration_ms": 5, "enriched_query": "anders", "agent_steps": [step], "sub_agents": [{"subagent_id": "s", "role": "facts", "error": None, "chunks": [{"t": "c"}], "agent_steps": [step]}], "error": "x", "sufficient": False, "citations": [{"ref": "[1]", "page": None}]},
        {"k": 2, "index": 0, "role": "assistant", "text": "", "duration_ms": None, "enriched_query": None, "agent_steps": [step], "sub_agents": None, "error": "", "sufficient": True, "citations": None},
    ]
    s = "struct<step:int,thought:string,action:string,args:map<string,string>,observation:string,chunks:array<struct<t:string>>,llm_response:string,subagent_id:string,subagent_role:string>"
    schema = f"k int, index int, role string, text string, duration_ms long, enriched_query string, agent_steps array<{s}>, sub_agents array<struct<subagent_id:string,role:string,error:string,chunks:array<struct<t:string>>,agent_steps:array<{s}>>>, error string, sufficient boolean, citations array<struct<ref:string,page:int>>"
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = {r.k: json.loads(r.document) for r in protocol(df, "k", {"v": F.lit(1), "none": F.lit(None).cast("string")}).collect()}
    inner = {"step": 1, "thought": "", "action": "SEARCH", "args": {"q": "x"}, "chunks": [{"t": "c"}]}
    assert got[1] == {"v": 1, "message_count": 2, "messages": [{"index": 0, "role": "user", "text": "f"}, {"index": 1, "role": "assistant", "text": "a", "duration_ms": 5, "enriched_query": "anders", "citations": [{"ref": "[1]"}], "sub_agents": [{"subagent_id": "s", "role": "facts", "agent_steps": [inner]}], "sufficient": False, "error": True}]}
    assert got[2]["messages"] == [{"index": 0, "role": "assistant", "text": "", "agent_steps": [inner | {"subagent_id": "s"}], "sufficient": True}]


def test_batches_of_any_order(spark):
    df = spark.createDataFrame([(900 - i, "b" if i == 70 else f"t{i}", f"id{i}" if i % 2 else None) for i in range(130)], "n long, text string, own string").repartition(6)

    def call(items):
        if "b" in items:
            raise ValueError("nicht b")
        return [[float(len(x)), 1.0] for x in items]

    made = embedded_batch(df, call, ["n"], F.col("own"))
    rows = sorted(made.collect(), key=lambda r: r.i)
    assert [r.n for r in rows] == sorted(900 - i for i in range(130)) and [r.batch_id for r in rows] == [i // 50 for i in range(130)]
    assert all(r.chunk_id == (r.own or f"chunk_{r.i}") and (r.error is None) == (r.text != "b") and (r.dimension == 2 or r.text == "b") for r in rows)
    report = {r.batch_id: (r.total, r.success, r.failed, r.errors) for r in batch_report(made).collect()}
    assert report == {0: (50, 50, 0, []), 1: (50, 49, 1, ["Missing vector for chunk chunk_59: nicht b"]), 2: (30, 30, 0, [])}
