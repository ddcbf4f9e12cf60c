"""Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and proofs for each row.

Every row is a leaf: the digest of its five columns, written with their lengths. The
leaves of a source are put in order by a range sort (``placed``), and aligned blocks of
4096 of them, three levels of runs of 16, go to tasks as Arrow batches, in which DuckDB
runs the levels: an ordered string_agg for each run, its sha256, the next level. What a
block leaves is one node, and the same step on the blocks' nodes, 4096 times fewer each
round, ends with one node for each source; the sources' nodes, in order, make the outer
tree in the same way. Proofs go the way back: the siblings above a block are joined to
it once, not to each of its rows, and DuckDB folds every row's leaf with its siblings in
the block and with those above it up to the root.

No task holds more than a few blocks; nothing is collected but the largest count of a
round, which says whether another follows.

Rows: null columns are a mark of their own, an empty text has its length 0; long texts are
hashed whole; rows equal in source and doc_id are ordered by their leaf, and repeated rows
are leaves side by side, each with its own proof; rows without a doc_id come first in their
source, and those without a source are a source, the first; an empty table gives no rows;
other columns, whatever their names, are left alone and not hashed.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.places import joined, placed

from .common import group_ids, kept, whole_groups, written

#: Nodes of a run, levels that a block has, hexadecimal digits of a digest; the columns of a leaf.
FAN, LEVELS, DIGITS = 16, 3, 64
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows that DuckDB gets at a time (whole blocks), and its memory.
ROWS, MEMORY = 8192, "400MB"
PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """A column as a part of a leaf: its length in bytes and its value, or the mark of null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The leaf digest of a row, of its own text or of another."""
    return F.sha2(F.concat(*[field(text if c == "text" and text is not None else F.col(c)) for c in COLUMNS]), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case in a fifth of the rows, by the checksum of doc_id; null in all others."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER))


def _levels(first: str, last: int = LEVELS) -> str:
    """CTEs r1.. (runs: g, pos, s) and n1.. (their digests) over ``first`` (g, lv, pos, h)."""
    out = [f"n0 as (select g, lv, pos, h from {first})"]
    for k in range(1, last + 1):
        out.append(f"r{k} as materialized (select g, lv, pos // {FAN} as pos, string_agg(h, '' order by pos) as s from n{k - 1} where lv >= {k} group by all)")
        out.append(f"n{k} as (select g, lv, pos, sha256(s) as h from r{k})")
    return ",\n".join(out)


def _beside(k: int) -> tuple[str, str]:
    """SQL of the siblings before and after a row's node of level k - 1 in its run."""
    at = f"n.pos // {FAN ** (k - 1)} % {FAN}"
    return f"coalesce(substr(r{k}.s, 1, {DIGITS} * ({at})), '')", f"coalesce(substr(r{k}.s, {DIGITS} * ({at} + 1) + 1), '')"


RUNS = "\n".join(f"left join r{k} on r{k}.g = n.g and r{k}.pos = n.pos // {FAN**k}" for k in range(1, LEVELS + 1))
TOPS = " union all ".join(f"select g, h from n{k} where lv = {k}" for k in range(LEVELS + 1))


def _engine() -> duckdb.DuckDBPyConnection:
    def make() -> duckdb.DuckDBPyConnection:
        con = duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        con.execute("set preserve_insertion_order = false")
        return con

    return kept(("merkle",), make)


def _run(sql: str, **tables: pa.Table) -> list[pa.RecordBatch]:
    con = _engine()
    for name, t in tables.items():
        con.register(name, t)
    out = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return out.combine_chunks().to_batches()


#: Levels that a block of a tree of n leaves has: all three, or fewer where the tree ends sooner.
def _height(n: str) -> str:
    return " + ".join(f"({n} > {FAN**k})::int" for k in range(LEVELS))


def _numbered(table: pa.Table) -> pa.Table:
    return table.append_column("g", pa.array(group_ids(table, ["key", "block"]), pa.int64()))


def block_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one node that each block leaves, from rows (key, block, n, pos, h) of whole blocks."""
    sql = f"""with t as (select *, {_height('n')} as lv from node), {_levels('t')}, tops as ({TOPS}),
        b as (select g, any_value(key) as key, any_value(block) as block, any_value(n) as n from t group by g)
        select key, block as pos, (n + {BLOCK - 1}) // {BLOCK} as n, h from b join tops using (g)"""
    for table in whole_groups(batches, ["key", "block"], ROWS):
        yield from _cast(_run(sql, node=_numbered(table)), NODE)


def block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with its siblings, level by level, inside its block, and the block's node."""
    siblings = ", ".join(f"case when n.lv >= {k} then {{'before': {_beside(k)[0]}, 'after': {_beside(k)[1]}}} end" for k in range(1, LEVELS + 1))
    sql = f"""with t as (select *, {_height('n')} as lv from node), {_levels('t')}, tops as ({TOPS})
        select n.key, n.block, n.pos, n.n, n.h, list_filter([{siblings}], lambda x: x is not null) as path, tops.h as top from t n {RUNS} join tops on tops.g = n.g"""
    for table in whole_groups(batches, ["key", "block"], ROWS // 8):
        yield from _cast(_run(sql, node=_numbered(table)), PATHS)


def block_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs and folded roots of the leaves of whole blocks; each block begins with a row of what lies above it."""
    for table in whole_groups(batches, ["key", "block"], ROWS):
        table = _numbered(table)
        deep = max((len(p) for p in table.column("path").to_pylist() if p), default=0)
        steps, now = [], "coalesce(t, h)"
        for k in range(1, LEVELS + 1):
            steps.append(f"f{k} as (select * exclude (f), case when lv >= {k} then sha256(b{k} || f || a{k}) else f end as f from {f'f{k - 1}' if k > 1 else 'sided'})")
        for i in range(1, deep + 1):
            steps.append(f"f{LEVELS + i} as (select * exclude (f), case when len(path) >= {i} then sha256(path[{i}].before || f || path[{i}].after) else f end as f from f{LEVELS + i - 1})")
        sides = ", ".join(f"{_beside(k)[0]} as b{k}, {_beside(k)[1]} as a{k}" for k in range(1, LEVELS + 1))
        joined = " || ".join(f"b{k} || a{k}" for k in range(1, LEVELS + 1))
        sql = f"""with t as (select *, {_height('n')} as lv from node where not above), {_levels('t')},
            o as materialized (select g, subroot, root, path, coalesce(array_to_string(list_transform(path, lambda p: p.before || p.after), ''), '') as outside from node where above),
            sided as (select n.doc_id, n.h, n.lv, {now} as f, {sides}, o.path, o.outside, o.subroot, o.root from t n {RUNS} join o on o.g = n.g),
            {', '.join(steps)}
            select doc_id, h as leaf, subroot, root, sha256({joined} || outside) as proof_sha256, f as folded_root, f = root as verified from f{LEVELS + deep}"""
        yield from _cast(_run(sql, node=table), PROOF)


_SIDES = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
NODE = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())])
PATHS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string()), ("path", _SIDES), ("top", pa.string())])
PROOF = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
PROOF_SQL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _cast(batches: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.cast(schema)


def _by_block(nodes: DataFrame, *first: str) -> DataFrame:
    """Nodes as whole blocks in the partitions, each block in order."""
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).repartition("key", "block").sortWithinPartitions("key", "block", *first, "pos")


def climbed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, h): the node on top of each key's tree; (key, pos, path): each node's siblings up to there.

    ``nodes`` (key, pos, n, h) are those of n consecutive places of a key. Each round
    takes 4096 nodes together, so there are as many rounds as levels of that width.
    """
    now, rounds = nodes, []
    while (now.agg(F.max("n")).first()[0] or 0) > 1:
        step, _ = written(_by_block(now.select("key", "pos", "n", "h")).select("key", "block", "pos", "n", "h").mapInArrow(block_paths, f"key string, block long, pos long, n long, h string, path {PATH}, top string"), "merkle")
        rounds.append(step)
        now = step.groupBy("key", F.col("block").alias("pos")).agg(F.expr(f"(any_value(n) + {BLOCK - 1}) div {BLOCK}").alias("n"), F.any_value("top").alias("h"))
    above = now.select("key", "pos", F.expr(f"cast(array() as {PATH})").alias("path"))
    for step in reversed(rounds):
        up = above.select(F.col("key"), F.col("pos").alias("block"), F.col("path").alias("up"))
        above = joined(step, up, ["key", "block"]).select("key", "pos", F.concat("path", "up").alias("path"))
    return now.select("key", "h"), above


class Manifest:
    """The tree of a dataset: ``leaves`` (key, pos, n, doc_id, h, t) in order, ``blocks`` (key, block, path, subroot, root)."""

    def __init__(self, leaves: DataFrame, blocks: DataFrame):
        self.leaves, self.blocks = leaves, blocks

    def sources(self) -> DataFrame:
        """source, subroot, root: one row for each source."""
        return self.blocks.where("block = 0").select(F.col("key").alias("source"), "subroot", "root")


def manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``tampered`` gives other texts for some rows, whose leaves are kept beside the right ones."""
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf(tampered))
    hashed, _ = written(docs.select(F.col("source").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("h"), other.alias("t")).withColumn("tie", F.monotonically_increasing_id()), "leaves")
    leaves, _ = written(placed(hashed, ["key"], ["doc_id", "h", "tie"], "pos", "n").drop("tie"), "leaves")
    tops = _by_block(leaves.select("key", "pos", "n", "h")).select("key", "block", "n", "pos", "h").mapInArrow(block_tops, "key string, pos long, n long, h string")
    blocks, _ = written(tops, "blocks")
    subroots, inner = climbed(blocks)
    # the outer tree: the sources in order are the places of one key
    named, _ = written(placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("source"), "h"), ["key"], ["source"], "pos", "n"), "subroots")
    root, outer = climbed(named.select("key", "pos", "n", "h"))
    ends = outer.join(root.select(F.col("h").alias("root"), F.col("key").alias("all")), F.col("key") == F.col("all")).select("pos", F.col("path").alias("outer"), "root")
    of = named.join(ends, "pos").select(F.col("source").alias("key"), F.col("h").alias("subroot"), "outer", "root")
    whole = joined(inner, of, ["key"]).select("key", F.col("pos").alias("block"), F.concat("path", "outer").alias("path"), "subroot", "root")
    return Manifest(leaves, written(whole, "blocks")[0])


def proofs(of: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row; tampered rows are folded from their other leaf."""
    blocks = of.blocks.select("key", "block", F.lit(True).alias("above"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("t"), "path", "subroot", "root")
    none = F.lit(None)
    rows = of.leaves.select("key", F.expr(f"pos div {BLOCK}").alias("block"), F.lit(False).alias("above"), F.expr(f"pos % {BLOCK}").alias("pos"), "n", "doc_id", "h", "t", none.cast(PATH).alias("path"), none.cast("string").alias("subroot"), none.cast("string").alias("root"))
    lined = rows.unionByName(blocks).repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return lined.mapInArrow(block_folds, PROOF_SQL)


def verified_documents(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, a fifth of which are checked against a tampered text."""
    return proofs(manifest(docs, tampered_text()))
