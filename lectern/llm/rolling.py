"""Rolling window features: counts, sums, distinct languages, exact medians and 99th percentiles of the time before each row.

Time is cut into blocks as wide as the window, so the window before a time t of block b is
a suffix of block b - 1 and a prefix of block b. Rows are counted first into cells (source,
time, language, length), before they are shuffled; a block's cells go to two tasks' groups,
as the prefix side of their own block and as the suffix side of the next one. In a group
both sides grow persistent sorted trees over the lengths: every cell adds one version that
shares all but one path with the version before, times ascending on the prefix side and
descending on the suffix side. A window is one version of each, and the k-th smallest
length is found by going down both trees at once, choosing the side by the sum of both left
counts. Sums and counts are kept by version; distinct languages are those of the suffix,
plus those of the prefix, less those of both, which are intervals of t.

Trees of many groups are built together, level by level, in arrays: a node of a level is
the cell that made it. Answers are made once for each source and time and joined to the rows
of that time, so rows that share a time cost nothing more. A group holds the cells of one
source over two blocks, whatever number of rows they stand for.

Rows: a null text has no length and counts in n_events and n_langs alone, an empty one has
length 0; long texts count by their code points; null sources are one source, null languages
none; rows of one time (ties) are in no window of each other, and repeated rows count as
often as they occur; a row without a doc_id has no time, is in no window and gets no events
and null values; an empty table gives no rows; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.places import joined

from .common import group_ids, whole_groups

#: The windows in seconds, and the quantiles as fractions.
WINDOWS = (1800, 86400)
HALF, HIGH = (1, 2), (99, 100)

#: Cells that a task builds trees for at a time (whole groups).
CELLS = 40_000


def event_time() -> Column:
    """Seconds of a row's event, from its doc_id: 60 * floor(x / 6), in whole numbers."""
    x = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 1000
    return (10 * (x - F.pmod(x, F.lit(6)))).cast("long")


class Forest:
    """Persistent sorted trees over values below 2 ** depth, one chain of versions for each group.

    Cells come in the order of their insertion, group by group. The tree after cell i is
    version i; on each level it has one node of its own, so node numbers are cell numbers
    and -1 is the empty tree. ``count[l][i]`` counts what the node of level l of version i
    holds, ``left[l][i]`` and ``right[l][i]`` are its children on level l + 1.
    """

    def __init__(self, group: np.ndarray, value: np.ndarray, weight: np.ndarray, depth: int):
        n = len(value)
        self.depth, self.left, self.right, self.count = depth, [], [], []
        at = np.arange(n)
        for level in range(depth + 1):
            prefix = (group << depth | value) >> (depth - level)
            order = np.argsort(prefix, kind="stable")
            p = prefix[order]
            first = np.ones(n, bool)
            first[1:] = p[1:] != p[:-1]
            start = np.maximum.accumulate(np.where(first, at, 0))
            total = np.cumsum(weight[order])
            count = np.empty(n, np.int64)
            count[order] = total - np.where(start > 0, total[start - 1], 0)
            self.count.append(count)
            if level < depth:
                bit = (value[order] >> (depth - level - 1)) & 1
                for side, kept in ((0, self.left), (1, self.right)):
                    # the latest version of this node up to now that went to that side
                    latest = np.maximum.accumulate(np.where(bit == side, at, -1))
                    child = np.full(n, -1)
                    child[order] = np.where(latest >= start, order[latest], -1)
                    kept.append(child)


def _of(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at places, 0 for place -1."""
    return np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at), np.int64)


def _child(side: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, side[at], -1) if len(side) else at


def select(a: Forest, b: Forest, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest value (from 1) of versions i of ``a`` and j of ``b`` together, both trees gone down at once."""
    value = np.zeros(len(k), np.int64)
    for level in range(a.depth):
        la, lb = _child(a.left[level], i), _child(b.left[level], j)
        under = _of(a.count[level + 1], la) + _of(b.count[level + 1], lb)
        right = k > under
        i = np.where(right, _child(a.right[level], i), la)
        j = np.where(right, _child(b.right[level], j), lb)
        k = k - np.where(right, under, 0)
        value = value << 1 | right
    return value


#: Above any time within a group; group numbers stand above it.
STEP = np.int64(1) << 40


class Side:
    """One side of all groups of a batch: cells in the order of insertion, with running sums and trees of their lengths."""

    def __init__(self, own: np.ndarray, cells: dict[str, np.ndarray], groups: int, depth: int, sign: int):
        group, time, length, number, rank = (cells[c][own] for c in ("group", "time", "length", "number", "rank"))
        order = np.lexsort((sign * time, group))
        group, length, number = group[order], length[order], number[order]
        self.sign, self.key = sign, group * STEP + sign * time[order]
        self.starts = np.searchsorted(group, np.arange(groups))
        known = length >= 0
        running = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.events, self.chars = running(number), running(np.where(known, length, 0) * number)
        # cells without a length make no version: before each cell there are ``known`` versions
        self.known, self.lengths = running(known), running(number[known])
        self.trees = Forest(group[known], rank[order][known], number[known], depth)

    def upto(self, group: np.ndarray, time: np.ndarray, also: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places [from, to) of the cells of each group that are inserted before a time, or at it too."""
        return self.starts[group], np.searchsorted(self.key, group * STEP + self.sign * time, "right" if also else "left")


def languages(cells: dict[str, np.ndarray], ask_group: np.ndarray, ask_time: np.ndarray, width: int, groups: int) -> np.ndarray:
    """Distinct languages of the windows before the asked times."""
    langs = int(cells["lang"].max(initial=0)) + 1
    known = cells["lang"] >= 0

    def extreme(own: np.ndarray, pick: np.ufunc, start: np.int64) -> tuple[np.ndarray, np.ndarray]:
        own = own & known
        key, place = np.unique(cells["group"][own] * langs + cells["lang"][own], return_inverse=True)
        t = np.full(len(key), start)
        pick.at(t, place, cells["time"][own])
        return key, t

    def before(key: np.ndarray, time: np.ndarray) -> np.ndarray:
        """For each question how many times of its group lie before its own."""
        line = np.sort(key // langs * STEP + time)
        return np.searchsorted(line, ask_group * STEP + ask_time) - np.searchsorted(line, ask_group * STEP - STEP // 2)

    old, last = extreme(~cells["prefix"], np.maximum, -STEP)
    new, first = extreme(cells["prefix"], np.minimum, STEP)
    out = np.bincount(old // langs, minlength=groups)[ask_group] - before(old, last + width) + before(new, first)
    # a language of both sides was counted twice for first < t <= last + width
    _, a, b = np.intersect1d(old, new, assume_unique=True, return_indices=True)
    come, gone = first[b], last[a] + width
    real = come < gone
    return out - before(old[a][real], come[real]) + before(old[a][real], gone[real])


KEYS = ["window_s", "source", "block"]
FEATURES = pa.schema([("source", pa.string()), ("event_s", pa.int64()), ("window_s", pa.int64()), ("n_events", pa.int64()), ("sum_chars", pa.int64()), ("n_langs", pa.int64()), ("median_chars", pa.int64()), ("high_chars", pa.int64())])


def window_features(table: pa.Table) -> pa.RecordBatch:
    """One row for each time of the prefix sides, from whole groups of one window width."""
    of = lambda c: table.column(c).to_numpy()
    width = int(table.column("window_s")[0].as_py())
    block, prefix = of("block"), table.column("prefix").to_numpy()
    length = table.column("length").fill_null(-1).to_numpy().astype(np.int64)
    values, rank = np.unique(length, return_inverse=True)
    cells = {
        "group": group_ids(table, KEYS).astype(np.int64), "prefix": prefix, "number": of("number"), "length": length, "rank": rank.astype(np.int64),
        "time": of("event_s") - (block - 1) * width,  # from the start of the block before
        "lang": table.column("lang").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64),
    }
    groups, depth = int(cells["group"][-1]) + 1, max(1, len(values).bit_length())
    old, new = Side(~prefix, cells, groups, depth, -1), Side(prefix, cells, groups, depth, 1)
    asked = np.unique(cells["group"][prefix] * STEP + cells["time"][prefix])
    group, time = asked // STEP, asked % STEP
    (a0, a1), (b0, b1) = old.upto(group, time - width, True), new.upto(group, time, False)
    total = lambda name: getattr(old, name)[a1] - getattr(old, name)[a0] + getattr(new, name)[b1] - getattr(new, name)[b0]
    (ka0, ka1), (kb0, kb1) = (old.known[a0], old.known[a1]), (new.known[b0], new.known[b1])
    m = old.lengths[ka1] - old.lengths[ka0] + new.lengths[kb1] - new.lengths[kb0]
    versions = np.where(ka1 > ka0, ka1 - 1, -1), np.where(kb1 > kb0, kb1 - 1, -1)

    def quantile(num: int, den: int) -> pa.Array:
        at = select(old.trees, new.trees, *versions, np.maximum(1, -(-m * num // den)))
        return pa.array(values[np.minimum(at, len(values) - 1)], pa.int64(), mask=m == 0)

    row = np.searchsorted(cells["group"], group)
    made = [table.column("source").combine_chunks().take(pa.array(row)), time + (block[row] - 1) * width, np.full(len(row), width), total("events"), total("chars"), languages(cells, group, time, width, groups), quantile(*HALF), quantile(*HIGH)]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in made], schema=FEATURES)


def all_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features from the sorted cells of a partition."""
    for table in whole_groups(batches, KEYS, CELLS):
        width = table.column("window_s").to_numpy()
        # sorted by window width first, so each width is one slice
        for w in np.unique(width):
            lo, hi = np.searchsorted(width, w), np.searchsorted(width, w, "right")
            part = window_features(table.slice(lo, hi - lo))
            if part.num_rows:
                yield part


def rolling_features(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, time: Column | None = None) -> DataFrame:
    """doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars: a row for each row and window width."""
    time = event_time() if time is None else time
    timed = docs.select("source", time.alias("event_s"), "lang", F.char_length("text").cast("long").alias("length")).where("event_s is not null")
    cells = timed.groupBy("source", "event_s", "lang", "length").agg(F.count("*").alias("number"))
    side = lambda w, later: F.struct(F.lit(w).cast("long").alias("window_s"), F.expr(f"(event_s - pmod(event_s, {w}L)) div {w} + {later}").alias("block"), F.lit(not later).alias("prefix"))
    sides = cells.select("*", F.inline(F.array(*[side(w, later) for w in windows for later in (0, 1)])))
    lined = sides.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = lined.mapInArrow(all_features, "source string, event_s long, window_s long, n_events long, sum_chars long, n_langs long, median_chars long, high_chars long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", time.alias("event_s"))
    none = rows.where("event_s is null").select("doc_id", F.explode(F.array(*[F.lit(w).cast("long") for w in windows])).alias("window_s"), "event_s", *[F.lit(0).cast("long").alias(c) for c in ("n_events", "sum_chars", "n_langs")], *[F.lit(None).cast("long").alias(c) for c in ("median_chars", "high_chars")])
    return joined(rows.where("event_s is not null"), found, ["source", "event_s"]).select(*none.columns).unionByName(none)
