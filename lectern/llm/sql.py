"""DuckDB SQL for the rows of those corpus operators that SQL can express."""

from __future__ import annotations

#: The CRC-32 of a string of ASCII characters, without a table of constants: eight shifts for each byte.
_SHIFT = "case when {x} & 1 = 1 then xor({x} >> 1, 3988292384) else {x} >> 1 end"


def crc32(text: str) -> str:
    """SQL of the unsigned checksum; needs ``CRC_TABLE`` among the CTEs and ``crc_table c`` among the tables."""
    step = "xor(a >> 8, c.t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)), lambda a, b: {step}), 4294967295::bigint)"


_TABLE = "range(256)"
for _ in range(8):
    _TABLE = f"list_transform({_TABLE}, lambda x: {_SHIFT.format(x='x')})"
CRC_TABLE = f"crc_table as (select {_TABLE}::bigint[] as t)"

# op11: as many levels as trees of 16 ** 6 leaves have, each applied where the tree is that high
_HIGH = 6


def _tree(first: str, name: str) -> str:
    """CTEs of a tree over ``first`` (key, pos, n, h): {name}r1.. are runs, {name}n1.. their digests, {name}top the roots."""
    out = [f"{name}n0 as (select key, pos, n, h from {first})"]
    for k in range(1, _HIGH + 1):
        out.append(f"{name}r{k} as (select key, pos // 16 as pos, any_value(n) as n, string_agg(h, '' order by pos) as s from {name}n{k - 1} where n > {16 ** (k - 1)} group by key, pos // 16)")
        out.append(f"{name}n{k} as (select key, pos, n, sha256(s) as h from {name}r{k})")
    tops = " union all ".join(f"select key, h from {name}n{k} where n <= {16**k}" + (f" and n > {16 ** (k - 1)}" if k else "") for k in range(_HIGH + 1))
    return ", ".join([*out, f"{name}top as ({tops})"])


def _folds(first: str, name: str) -> str:
    """CTEs {name}f1..: rows of ``first`` (key, pos, f, sib) folded level by level through the tree."""
    out, before = [], first
    for k in range(1, _HIGH + 1):
        at = f"x.pos // {16 ** (k - 1)} % 16"
        a, b = f"substr(r.s, 1, 64 * ({at}))", f"substr(r.s, 64 * ({at} + 1) + 1)"
        out.append(f"{name}f{k} as (select x.* replace (case when r.s is null then x.f else sha256({a} || x.f || {b}) end as f, x.sib || coalesce({a} || {b}, '') as sib) from {before} x left join {name}r{k} r on r.key is not distinct from x.key and r.pos = x.pos // {16**k})")
        before = f"{name}f{k}"
    return ", ".join(out)


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11 = f"""with {CRC_TABLE},
    d as (select doc_id, source as key, {_leaf('text')} as h, case when {crc32('doc_id::varchar')} % 5 = 0 and text is not null then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as t from documents, crc_table c),
    l as (select *, row_number() over (partition by key order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by key) as n from d),
    {_tree('l', 'i')},
    u as (select 0 as key, key as source, h, row_number() over (order by key nulls first) - 1 as pos, count(*) over () as n from itop),
    {_tree('u', 'o')},
    x as (select l.doc_id, l.key, l.pos, l.h as leaf, coalesce(l.t, l.h) as f, '' as sib from l),
    {_folds('x', 'i')},
    y as (select f.doc_id, f.leaf, u.h as subroot, u.key, u.pos, f.f, f.sib from if{_HIGH} f join u on u.source is not distinct from f.key),
    {_folds('y', 'o')}
    select doc_id, leaf, subroot, otop.h as root, sha256(sib) as proof_sha256, f as folded_root, f = otop.h as verified from of{_HIGH}, otop"""


# op13: a self-join of each source's rows by time, which a small table bears
OP13 = f"""with {CRC_TABLE},
    d as (select row_number() over () as row, doc_id, source, lang, length(text) as chars, 60 * floor((doc_id + {crc32('doc_id::varchar')} % 1000) / 6)::bigint as event_s from documents, crc_table c),
    w as (select unnest([1800, 86400])::bigint as window_s),
    j as (select d.row, w.window_s, x.chars, x.lang, x.row is not null as hit from d cross join w left join d x on x.source is not distinct from d.source and x.event_s < d.event_s and x.event_s >= d.event_s - w.window_s),
    a as (select row, window_s, count(*) filter (hit) as n_events, coalesce(sum(chars), 0)::bigint as sum_chars, count(distinct lang) as n_langs, list_sort(list(chars) filter (chars is not null)) as l from j group by all)
    select d.doc_id, a.window_s, d.event_s, n_events, sum_chars, n_langs, l[((len(l) + 1) // 2)::int]::bigint as median_chars, l[((99 * len(l) + 99) // 100)::int]::bigint as high_chars from a join d using (row)"""
