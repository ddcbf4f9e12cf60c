"""Set-similarity join on word shingles with signature trees.

Which documents can be linked at all is found without loss by partition signatures:
two sets of Jaccard similarity t or more differ in at most D = s(1-t)/t tokens, s being
the smaller size.  Tokens are dealt by hash into D + 1 parts and some spare ones, so
one more part than there are spare ones is equal in both; equal non-empty parts give
equal keys.  A set with more empty parts than spare ones gets a key for that.  Sizes are cut into ranges, and a set gives
keys for every range in which a possible partner could be the smaller one.  Shingles
that very many documents share are left out of the parts (taking the same tokens from
two sets cannot make them differ more), so that a common line does not tie documents
together; a set that is left with too many empty parts gets the keys of all of it too.  Documents that share keys form clusters.

Inside a cluster, signature trees do the join: documents sorted by size are leaves,
nodes hold OR-combined token bitmaps and size ranges, and a dual traversal from the
roots drops node pairs whose largest possible overlap is too small.  What is left is
compared exactly.  Large clusters are cut into blocks, and each pair of blocks is a
task's tree pair of its own, so no task holds more than two blocks.

Equal sets are one class before all this; copies cost one row each.

Rows: null and empty texts have no shingles and are linked with nothing; ties have no
meaning (links are decided exactly); repeated rows are copies, each returned; rows of
one doc_id with different texts are one document with several sets; a row whose doc_id
is null gets the component of equal sets that have an id, else null; long texts are
worked off by themselves; an empty table gives no rows.  Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, bounded, free_name, in_bitmap, lower_words, mixed, partitions, removed, shingle_hashes, slices, word_hashes, written
from .components import connected_components, roots

#: Parts beyond those that a difference can touch; more are added where many parts of a set are empty by chance.
SPARE = 2
#: Steps of the size ranges.
STEP = 1.25
#: A shingle is common if in a slice of documents at least this share, and number, of distinct sets has it ...
COMMON_SLICE, COMMON_SHARE, COMMON_LEAST = 10_000, 0.0008, 8
#: Tokens of a slice, at most (8 bytes each, sorted once).
COMMON_TOKENS = 2_000_000
#: ... and if it is among so many with the highest counts. The choice affects cost alone.
COMMON_MOST = 200_000
#: Documents, and tokens, in a block of a cluster.
BLOCK_DOCS, BLOCK_TOKENS = 256, 1_000_000
#: Keys, and edges, that a task holds before it sends them on or shrinks them to a forest.
HELD_KEYS, HELD_EDGES = 600_000, 400_000
#: Bytes of token sets in a batch that goes on to the shuffle, beyond one set.
SHIP_BYTES = 4 << 20
#: Bits of a node's bitmap, and children of a node.
BITS, FAN = 1024, 8


def token_set(text: str, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(lower_words(text)), k))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@lru_cache(1)
def size_steps() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * STEP)))
    return out


def ranges_of(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(range, greatest difference in tokens, spare parts) for each size range that holds a possible smaller partner of a set of n."""
    steps, least, out = size_steps(), -(-n * num // den), []
    i = int(np.searchsorted(steps, n, "right")) - 1
    while i >= 0 and steps[i + 1] - 1 >= least:
        differ = (steps[i + 1] - 1) * (den - num) // num
        # twice as many as are empty in the mean, for the smallest sets of the range
        out.append((i, differ, SPARE + int(np.ceil(2 * differ * np.exp(-steps[i] / differ))) if differ else SPARE))
        i -= 1
    return out


def keys_of(tokens: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Partition-signature keys of a token set.

    A range in which more than its spare parts of the set without its common shingles
    are empty gets the keys of the whole set besides: if the equal parts of two sets
    are all empty, that is so for both.
    """
    rest = tokens
    if len(common) and len(tokens):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rest = tokens[common[at] != tokens]
    out = []
    for i, differ, spare in ranges_of(len(tokens), num, den):
        if not differ:
            continue  # only equal sets are this similar
        for scheme, of in enumerate((rest, tokens)):
            seed = np.uint64((2 * i + scheme) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            found, empty = _part_keys(of, differ + 1 + spare, seed)
            out.append(found)
            if empty <= spare:
                break
        else:
            out.append(mixed(np.array([seed ^ np.uint64(0x5DEECE66D)])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _part_keys(tokens: np.ndarray, parts: int, seed: np.uint64) -> tuple[np.ndarray, int]:
    """Keys of the parts that tokens are dealt into, and how many parts are empty."""
    with np.errstate(over="ignore"):
        h = mixed(tokens ^ seed)
        part = (h % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part, mixed(h))
        full = np.flatnonzero(np.bincount(part, minlength=parts))
        return mixed(total[full] + mixed(full.astype(np.uint64) + seed)), parts - len(full)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many documents have, counted over all documents; at most COMMON_MOST of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            keep = n >= max(COMMON_LEAST, len(held) * COMMON_SHARE)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                for t in part.column(0).to_pylist():
                    s = token_set(t or "", k)
                    held[digest(s)] = s
                    size += len(s)
                    if len(held) >= COMMON_SLICE or size >= COMMON_TOKENS:
                        yield counted()
                        held, size = {}, 0
        if held:
            yield counted()

    got = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON_MOST).select("token").toArrow()
    return np.sort(got.column(0).to_numpy().view(np.uint64))


SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.binary())])


def _signed(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """doc_id, a hash of the text, n, the two halves of the set's digest, keys."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for t in part.column(2).to_pylist():
                    s = token_set(t or "", k)
                    rows.append((len(s), *digest(s), keys_of(s, shared.value, num, den).tobytes()))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(SIGNED)[2:], strict=True))], schema=SIGNED)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, keys binary")


KEYED = pa.schema([("key", pa.int64()), ("node", pa.int64())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) rows; a key that a task has met before is not sent again, but an edge as a key of its own is."""
    keys: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    size = 0

    def flushed() -> pa.RecordBatch:
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(~first)
        pairs = np.unique(np.stack([node[at - 1], node[at]], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        with np.errstate(over="ignore"):
            own = mixed(mixed(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)).view(np.int64) if len(at) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[first].view(np.int64), own, own])), pa.array(np.concatenate([node[first], pairs[:, 0], pairs[:, 1]]))], schema=KEYED)

    for batch in batches:
        for raw, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if raw:
                keys.append(np.frombuffer(raw, np.uint64))
                nodes.append(np.full(len(raw) // 8, node, np.int64))
                size += len(raw) // 8
        if size > HELD_KEYS:
            yield flushed()
            keys, nodes, size = [], [], 0
    if size:
        yield flushed()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: neighbours with the same key are an edge; each partition gives a spanning forest."""
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    size, most = 0, HELD_EDGES
    carry: tuple[int, int] | None = None

    def forest() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return nodes[nodes != root], root[nodes != root]

    for batch in batches:
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if carry is not None:
            key, node = np.concatenate([[carry[0]], key]), np.concatenate([[carry[1]], node])
        same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
        held.append((node[same], node[same + 1]))
        size += len(same)
        if len(key):
            carry = int(key[-1]), int(node[-1])
        if size > most:
            held = [forest()]
            size = len(held[0][0])
            most = max(HELD_EDGES, 2 * size)  # a forest that stays large is not shrunk again for each batch
    a, b = forest()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _in_some_cluster(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(in_bitmap(shared.value, batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(keep), batch.column(2).filter(keep)], names=["rep", "text"])

    return docs.mapInArrow(run, "rep long, text string")


class Tree:
    """Levels of nodes over documents in the given order; level 0 is the documents themselves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, slack: np.ndarray):
        self.levels = [(bits, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, s = self.levels[-1]
            cuts = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(s, cuts)))


def bitmaps(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of token sets given as places in a vocabulary, and the tokens that bits do not tell apart."""
    out = np.zeros((len(members), BITS // 64), np.uint64)
    for i, m in enumerate(members):
        bit = m % BITS
        np.bitwise_or.at(out[i], bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return out, np.array([len(m) for m in members], np.int64) - np.bitwise_count(out).sum(1, dtype=np.int64)


def candidate_pairs(left: Tree, right: Tree, num: int, den: int) -> np.ndarray:
    """Pairs of documents that the dual traversal leaves."""
    level = max(len(left.levels), len(right.levels)) - 1
    pairs = np.zeros((1, 2), np.int64)
    at = [min(level, len(t.levels) - 1) for t in (left, right)]
    while True:
        (lb, llow, lhigh, ls), (rb, rlow, rhigh, rs) = left.levels[at[0]], right.levels[at[1]]
        keep = []
        for lo in range(0, len(pairs), 65536):
            x, y = pairs[lo : lo + 65536, 0], pairs[lo : lo + 65536, 1]
            most = np.bitwise_count(lb[x] & rb[y]).sum(1, dtype=np.int64) + np.minimum(ls[x], rs[y])
            most = np.minimum(most, np.minimum(lhigh[x], rhigh[y]))
            ok = (den + num) * most >= num * (llow[x] + rlow[y])
            ok &= (den * lhigh[x] >= num * rlow[y]) & (den * rhigh[y] >= num * llow[x])
            keep.append(pairs[lo : lo + 65536][ok])
        pairs = np.concatenate(keep)
        if at == [0, 0] or not len(pairs):
            return pairs
        down = [a > 0 and a >= max(at) for a in at]
        for side, tree in ((0, left), (1, right)):
            if down[side]:
                at[side] -= 1
                n = len(tree.levels[at[side]][0])
                first = pairs[:, side] * FAN
                child = (first[:, None] + np.arange(FAN)).ravel()
                pairs = np.repeat(pairs, FAN, 0)
                pairs[:, side] = child
                pairs = pairs[child < n]


def linked_pairs(sets: list[np.ndarray], blocks: np.ndarray | None, num: int, den: int) -> np.ndarray:
    """Pairs (x, y) of linked sets; with blocks (0 or 1 for each set) only pairs across them, else x < y."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 4 and blocks is None:  # a tree of one node: its children are compared at once
        return np.array([(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if _similar(sets[x], sets[y], num, den)], np.int64).reshape(-1, 2)
    vocabulary, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    code = np.cumsum(shared) - 1
    cuts = np.cumsum(sizes)[:-1]
    members = [code[p[shared[p]]] for p in np.split(place, cuts)]
    order = np.argsort(sizes, kind="stable")
    bits, slack = bitmaps(members)
    if blocks is None:
        left = right = order
    else:
        left, right = order[blocks[order] == 0], order[blocks[order] == 1]
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    trees = [Tree(bits[o], sizes[o], slack[o]) for o in (left, right)]
    pairs = candidate_pairs(*trees, num, den)
    pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], 1)
    if blocks is None:
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    if not len(pairs):
        return pairs
    overlap = np.zeros(len(pairs), np.int64)
    if len(pairs) <= 2 * len(sets):
        for i, (x, y) in enumerate(pairs):
            overlap[i] = len(np.intersect1d(members[x], members[y], assume_unique=True))
    else:
        used, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        wide = max(1, 4_000_000 // len(used))
        total = np.zeros((len(used), len(used)), np.float32)  # counts below 2**24 are exact
        for lo in range(0, int(shared.sum()), wide):
            dense = np.zeros((len(used), wide), np.float32)
            for i, m in enumerate(used):
                c = members[m]
                dense[i, c[(c >= lo) & (c < lo + wide)] - lo] = 1
            total += dense @ dense.T
        overlap = total[at[:, 0], at[:, 1]].astype(np.int64)
    union = sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - overlap
    return pairs[den * overlap >= num * union]


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


SHIPPED = pa.schema([("cluster", pa.int64()), ("bi", pa.int64()), ("bj", pa.int64()), ("block", pa.int64()), ("node", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("copies", pa.int64()), ("tokens", pa.binary())])
JOINED = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _shipper(k: int):
    """Members of clusters with their token sets, once for each pair of blocks that they are in.

    A member goes to as many pairs as its cluster has blocks, so batches are cut by what is made of the members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SHIPPED, strict=True)], schema=SHIPPED)

        for batch in batches:
            for part in slices(batch, "text", 200):
                for r in part.to_pylist():
                    s = token_set(r["text"] or "", k)
                    if digest(s) != (r["s1"], r["s2"]):
                        continue  # another row with this doc_id
                    raw = s.tobytes()
                    for j in range(r["blocks"]):
                        if rows and size + len(raw) > SHIP_BYTES:
                            yield made()
                            rows, size = [], 0
                        rows.append((r["cluster"], min(r["block"], j), max(r["block"], j), r["block"], r["node"], r["s1"], r["s2"], r["copies"], raw))
                        size += len(raw) + 64  # the other columns
        if rows:
            yield made()

    return run


def _joiner(num: int, den: int):
    """Rows sorted by cluster and pair of blocks; each such group is joined when it is complete, its sets held once."""

    def joined(rows: list[tuple]) -> list[tuple[int, int, int]]:
        own = rows[0][1] == rows[0][2]
        sets = [np.frombuffer(r[8], np.uint64) for r in rows]
        blocks = None if own else np.array([int(r[3] == r[2]) for r in rows])
        pairs = linked_pairs(sets, blocks, num, den)
        if not len(pairs):
            return []
        x, y = pairs[:, 0], pairs[:, 1]
        copies = np.array([r[7] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        node = np.array([r[4] for r in rows], np.int64)
        nodes, root = roots(node[x], node[y])
        of = dict(zip(nodes.tolist(), root.tolist(), strict=True))
        return [(r[4], of[r[4]], int(n)) for r, n in zip(rows, links, strict=True) if r[4] in of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, int], tuple] = {}
        last: tuple | None = None
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:8]]
            for row, raw in zip(zip(*columns, strict=True), batch.column(8), strict=True):
                if last != row[:3]:
                    out += joined(list(group.values())) if group else []
                    group, last = {}, row[:3]
                if row[5:7] not in group:
                    group[row[5:7]] = *row, raw.as_py()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), JOINED, strict=True)], schema=JOINED)
                out = []
        if group:
            out += joined(list(group.values()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), JOINED, strict=True)], schema=JOINED)

    return run


def _linked(docs: DataFrame, k: int, num: int, den: int, apart: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, classes of equal sets, and (node, component, links) of the classes that are linked with others.

    A class is a node of the graph: the smallest doc_id that has the set.  With ``apart``, a doc_id that is
    the smallest of several classes (rows of one doc_id with different texts) does not tie these together:
    each gets a node of its own, a negative hash of what it is.
    """
    spark = docs.sparkSession
    bounded(spark)
    wide = partitions(spark)
    signed, signed_path = written(_signed(docs, k, num, den, common_shingles(docs, k)), "signed")
    edges, edges_path = written(signed.select("keys", "s1").mapInArrow(_keyed, "key long, node long").repartition(wide, "key").sortWithinPartitions("key", "node").mapInArrow(_chained, "a long, b long"), "chained")
    coarse = connected_components(edges)
    removed(spark, edges_path)
    # both ends of a contracted edge belong to the cluster of the smaller
    cluster = coarse.select("node", F.col("component").alias("cluster")).unionByName(coarse.select(F.col("component").alias("node"), F.col("component").alias("cluster")).distinct()).withColumnRenamed("node", "s1")
    classes = signed.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    node = F.col("rep")
    if apart:
        several = classes.where("rep is not null and n > 0").groupBy("rep").agg(F.count("*").alias("sets")).where("sets > 1")
        classes = classes.join(several, "rep", "left")
        node = F.when(F.col("sets").isNull(), node).otherwise(F.xxhash64("rep", "s1", "s2").bitwiseOR(F.lit(-(1 << 63))))
    classes, _ = written(classes.select("s1", "s2", "n", "rep", "copies", node.alias("node")), "classes")
    member, member_path = written(classes.where("rep is not null").join(cluster, "s1"), "members")
    counted = member.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).where("docs > 1")
    counted = counted.select("cluster", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)).cast("long").alias("blocks"))
    placed = member.join(counted, "cluster").select("rep", "node", "s1", "s2", "copies", "cluster", "blocks", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).alias("block"))
    # texts of other documents are not shuffled; both sides grow with the data, so neither is broadcast
    some = _in_some_cluster(docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("rep"), "text"), bitmap_of(member.select(F.xxhash64("rep"))))
    shipped = some.join(placed.hint("merge"), "rep").mapInArrow(_shipper(k), "cluster long, bi long, bj long, block long, node long, s1 long, s2 long, copies long, tokens binary")
    links, _ = written(shipped.repartition(wide, "cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj").mapInArrow(_joiner(num, den), "node long, root long, links long"), "links")
    component = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    removed(spark, member_path)
    return signed, classes, links.groupBy("node").agg(F.sum("links").alias("links")).join(component, "node", "left")


def similar_documents(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs``.

    Two documents are linked if den * |both| >= num * |either| for their sets of k-word
    shingles; component_id is the smallest doc_id reachable over links.
    """
    signed, classes, linked = _linked(docs, k, num, den, apart=False)
    known = classes.join(linked, "node", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    some = F.col("n") > 0
    return (
        signed.select("doc_id", "n", "s1", "s2")
        .join(known, ["s1", "s2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"))
    )


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id (of those, the smallest hash of the text); columns as they were.

    Groups are of texts: rows of one doc_id with unlike texts are judged apart, so a text like no other always
    stays. Rows that are equal in doc_id and text stay once. Rows without a doc_id are not judged and stay, null
    and empty texts are like nothing. An empty table gives no rows; other columns may have any names.
    """
    signed, classes, linked = _linked(docs, k, num, den, apart=True)
    group = classes.where("rep is not null and n > 0").join(linked, "node", "left").select("s1", "s2", "n", "rep", F.coalesce("component", "node").alias("group"))
    # of each group the least document, of its texts there the least hash; hashes are longs, so both fold before they are shuffled
    least = group.groupBy("group").agg(F.min("rep").alias("doc_id"))
    chosen = group.join(least, "group").where("rep = doc_id").select("s1", "s2", "n", "group", "doc_id")
    keep = signed.join(chosen, ["s1", "s2", "n", "doc_id"]).groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).drop("group")
    keep = keep.unionByName(signed.where("doc_id is not null and n = 0").select("doc_id", "text_hash").distinct())
    doc, text = free_name(docs, "kept_doc"), free_name(docs, "kept_text")
    keep = keep.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text))
    stay = docs.join(keep, (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(text)))
    return stay.dropDuplicates([doc, text]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
