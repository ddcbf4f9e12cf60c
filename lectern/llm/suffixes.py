"""Repeated passages across documents by a sparse suffix array.

Words are hashed.  Of every WINDOW consecutive KGRAM-word grams the leftmost smallest
hash is kept (a minimiser), so each run of LEAST words has one minimiser of its own, which
its words alone decide, and equal runs have equal ones.  The suffix array is sparse: it has
the suffixes that start at minimisers, each with the words before it.  In stretches that
repeat themselves every few words, neighbouring minimisers with the same words all around
are one row with the first and the last position.  Suffixes whose first KGRAM words
occur once have no neighbour to match and are left out.

Suffixes are sorted by their words, then by the words before them in reverse, over
range partitions, so equal suffixes may fill any number of partitions.  Each is compared
with REACH neighbours on either side, and matches are extended right and left.  A suffix
whose start reaches further than its neighbours, or that lies at the edge of a partition,
may have other matches further away, unless its matches cover all runs of LEAST words that
have it as their minimiser.  For the starts of such suffixes these runs are compared by
hash, which leaves no case out; runs of a start that very many suffixes have are salted by
document, so that a passage found everywhere is dealt over all tasks.

Links: a row is a passage and another document that has every run of LEAST words of it; where
that document has two overlapping cuts of it in two places, in none of these all of it.  Of a start with few
suffixes every other document is named; of one with many, the neighbours that
match furthest, and where runs were compared the smallest doc_id that has the run (for
that document itself, the largest), which is the representative of the run's class.

Rows: null, empty and short texts have no passages; a passage that repeats inside one
document alone does not count; repeated rows (one doc_id) are one document; ties in the
order of suffixes are settled by doc_id and position; long texts are worked off by
themselves; rows without doc_id are not read; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, fits_bitmap, in_bitmap, mixed, partitions, removed, shingle_hashes, slices, word_hashes, written

#: Words of a passage, of a gram, and grams in a window: LEAST = WINDOW + KGRAM - 1.
LEAST, KGRAM = 50, 19
WINDOW = LEAST - KGRAM + 1
#: Words kept before a minimiser and from it on: as many as any decision needs.
BEFORE, AFTER = WINDOW - 1, LEAST
#: Neighbours on either side that a suffix is compared with.
REACH = 4
#: Suffixes of a start from which on its runs are salted by document.
HOT = 1000


def minimisers(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept positions, ascending, and the first and last window that each is the minimiser of."""
    n = len(grams)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none
    # leftmost minima of all windows, by doubling; they never move back from a window to the next
    best, span = np.arange(n), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return best[first], first, np.append(first[1:], len(best)) - 1


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class Suffixes:
    """The kept suffixes of a text: start hashes, first and last position, and how many words before and from
    the position on the runs have that the suffix is the minimiser of."""

    def __init__(self, text: str):
        self.words = word_hashes(split_words(text))
        grams = shingle_hashes(self.words, KGRAM) if len(self.words) >= LEAST else np.zeros(0, np.uint64)
        at, first, last = minimisers(grams)
        alone = ~self._repeated(grams, at)
        lead = np.flatnonzero(alone)
        self.start, self.at, self.back, self.ahead = grams[at][lead], at[lead], (at - first)[lead], (last + LEAST - at)[lead]
        self.reach = at[np.append(lead[1:], len(at)) - 1] if len(lead) else at

    def _repeated(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a position has the same gram as the one before it, within LEAST words, and the same words around."""
        out = np.zeros(len(at), bool)
        gap = np.diff(at)
        maybe = np.flatnonzero((gap <= LEAST) & (grams[at[1:]] == grams[at[:-1]])) if len(at) > 1 else gap
        for g in np.unique(gap[maybe]).tolist():
            of = maybe[gap[maybe] == g]
            same = np.concatenate([[0], np.cumsum(self.words[:-g] == self.words[g:])])
            lo, hi = at[of] - BEFORE, at[of] + AFTER
            inside = (lo >= 0) & (hi < len(same))
            of, lo, hi = of[inside], lo[inside], hi[inside]
            out[of[same[hi] - same[lo] == BEFORE + AFTER] + 1] = True
        return out


def _context(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words around positions, 32 bits each; 0 stands for what lies outside the text."""
    place = at[:, None] + np.arange(-BEFORE, AFTER)
    inside = (place >= 0) & (place < len(words))
    return np.where(inside, np.maximum(words[np.where(inside, place, 0)] & np.uint64(0xFFFFFFFF), 1), 0).astype(np.uint32)


def _starts(docs: DataFrame) -> DataFrame:
    """Start hashes that occur again, and how often; counted by slice of documents before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 2000):
                found = [Suffixes(t or "").start for t in part.column(0).to_pylist()]
                start, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(start.view(np.int64)), pa.array(n)], names=["start", "n"])

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "start long, n long").groupBy("start").agg(F.sum("n").alias("n")).where("n > 1")


SUFFIX = "start long, right binary, left binary, doc_id long, pos long, reach long, back long, ahead long"
MATCH = "start long, doc_id long, first long, last long, other long"


def _rows(values: np.ndarray) -> pa.Array:
    """A binary value for each row, so that comparing bytes compares words."""
    n, size = len(values), values.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(values.astype(">u4").tobytes())])


def _array(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """The suffixes whose starts occur again, with their words and, in reverse, the words before.

    A bitmap of the starts leaves nearly all others out at the source; more starts than it can tell apart are joined.
    """
    few = fits_bitmap(starts.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(starts.select("start")) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 200):
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = Suffixes(t or "")
                    keep = np.ones(len(s.start), bool) if shared.value is None else in_bitmap(shared.value, s.start)
                    if keep.any():
                        around = _context(s.words, s.at[keep])
                        own = [pa.array(x[keep].astype(np.int64)) for x in (s.at, s.reach, s.back, s.ahead)]
                        yield pa.RecordBatch.from_arrays([pa.array(s.start[keep].view(np.int64)), _rows(around[:, BEFORE:]), _rows(around[:, :BEFORE][:, ::-1]), pa.array(np.full(keep.sum(), doc, np.int64)), *own], names=[x.split()[0] for x in SUFFIX.split(", ")])

    out = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SUFFIX)
    return out if few else out.join(starts.select("start").hint("merge"), "start", "left_semi")


def _words_of(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, size)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words rows share from their start; nothing is shared outside a text."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of sorted suffixes; rows with a start and no place tell that this start may have more than those."""
    held: dict[str, np.ndarray] | None = None
    edge = True  # no row has been given out yet
    names = [x.split()[0] for x in MATCH.split(", ")]

    def rows(h: dict[str, np.ndarray], lo: int, hi: int) -> pa.RecordBatch:
        h = {k: v[lo:hi] for k, v in h.items()}
        far, found, l, r = h["far"], h["found"], h["l"].astype(np.int64), h["r"].astype(np.int64)
        # all matches hold the start, so what they cover has no gaps
        whole = (l.max(1, initial=0) >= h["back"]) & (r.max(1, initial=0) >= h["ahead"])
        open_ = h["start"][far & ~whole]
        # of few suffixes all matches, of many those that reach furthest to the left and to the right
        best = np.zeros(found.shape, bool)
        n = np.arange(len(far))
        best[n, np.where(found, l * 64 + r, -1).argmax(1)] = True
        best[n, np.where(found, r * 64 + l, -1).argmax(1)] = True
        i, j = np.nonzero(found & (best | ~far[:, None]))
        cols = [h["doc"][i], h["pos"][i] - l[i, j], h["reach"][i] + r[i, j], h["other"][i, j]]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(open_, pa.int64())]), *(pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(len(open_), pa.int64())]) for c in cols)], names=names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        slots = (n, 2 * REACH)
        new = {k: batch.column(k2).to_numpy() for k, k2 in (("start", "start"), ("doc", "doc_id"), ("pos", "pos"), ("reach", "reach"), ("back", "back"), ("ahead", "ahead"))}
        new |= {"right": _words_of(batch.column("right"), AFTER), "left": _words_of(batch.column("left"), BEFORE), "far": np.zeros(n, bool)}
        new |= {"found": np.zeros(slots, bool), "l": np.zeros(slots, np.int8), "r": np.zeros(slots, np.int8), "other": np.zeros(slots, np.int64)}
        fresh = 0 if held is None else len(held["start"])
        h = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in new}
        for lag in range(1, min(REACH, len(h["start"]) - 1) + 1):
            y = np.arange(max(fresh, lag), len(h["start"]))
            x = y - lag
            same = h["start"][x] == h["start"][y]
            x, y = x[same], y[same]
            if lag == REACH:
                h["far"][x] = h["far"][y] = True
            other = h["doc"][x] != h["doc"][y]
            x, y = x[other], y[other]
            r, l = _common(h["right"][x], h["right"][y]), _common(h["left"][x], h["left"][y])
            long = r + l >= LEAST
            x, y, r, l = x[long], y[long], r[long], l[long]
            for a, b, slot in ((x, y, REACH + lag - 1), (y, x, lag - 1)):
                h["found"][a, slot], h["l"][a, slot], h["r"][a, slot], h["other"][a, slot] = True, l, r, h["doc"][b]
        if edge:
            h["far"][:REACH] = True
            edge = False
        done = max(0, len(h["start"]) - REACH)
        yield rows(h, 0, done)
        held = {k: v[done:].copy() for k, v in h.items()}
    if held is not None:
        held["far"][:] = True
        yield rows(held, 0, len(held["start"]))


RUN = "window long, salt int, doc_id long, first long, last long"


def _windows(suffixes: DataFrame, open_: DataFrame, hot: np.ndarray, salts: int) -> DataFrame:
    """Hashes and places of the runs of LEAST words whose minimisers' starts are open; salted (else -1) if the start is hot."""
    few = fits_bitmap(open_.count())
    if not few:
        suffixes = suffixes.join(open_.hint("merge"), "start", "left_semi")
    shared = suffixes.sparkSession.sparkContext.broadcast((bitmap_of(open_) if few else None, hot))
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, hot = shared.value
            part = batch if keep is None else batch.filter(pa.array(in_bitmap(keep, batch.column("start").to_numpy())))
            if not part.num_rows:
                continue
            words = np.concatenate([_words_of(part.column("left"), BEFORE)[:, ::-1], _words_of(part.column("right"), AFTER)], 1).astype(np.uint64)
            doc, pos, reach, back, ahead = (part.column(c).to_numpy() for c in ("doc_id", "pos", "reach", "back", "ahead"))
            salt = np.where(in_bitmap(hot, part.column("start").to_numpy()), (mixed(doc.view(np.uint64)) % np.uint64(salts)).astype(np.int32), np.int32(-1))
            out = []
            with np.errstate(over="ignore"):
                base = np.uint64(0x9E3779B97F4A7C15)
                head = np.zeros((len(words), words.shape[1] + 1), np.uint64)
                for i in range(words.shape[1]):
                    head[:, i + 1] = head[:, i] * base + mixed(words[:, i])
                power = np.uint64(pow(int(base), LEAST, 1 << 64))
                for a in range(BEFORE + 1):
                    ok = np.flatnonzero((BEFORE - a <= back) & (a + LEAST - BEFORE <= ahead))
                    if len(ok):
                        out.append((mixed(head[ok, a + LEAST] - head[ok, a] * power).view(np.int64), salt[ok], doc[ok], pos[ok] - BEFORE + a, reach[ok] - BEFORE + a + LEAST))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return suffixes.mapInArrow(run, RUN)


def _shared_runs(runs: DataFrame, wide: int) -> DataFrame:
    """doc_id, first, last of the runs that another document has too, and the representative of their class.

    Only salted runs need a second step over the documents of a run; it sees a row for each salt.
    """
    dealt = runs.repartition(wide, "window", "salt")
    part = dealt.groupBy("window", "salt").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    hot = part.where("salt >= 0").groupBy("window").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_list("salt").alias("salts")).select("window", F.explode("salts").alias("salt"), "a", "b")
    shared = part.where("salt < 0").unionByName(hot).where("a <> b")
    other = F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return dealt.join(shared.hint("merge"), ["window", "salt"]).select("doc_id", "first", "last", other.alias("other"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by document, other document and place, overlapping ones joined."""
    now: list | None = None
    out: list[tuple] = []

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "first_word", "n_words", "other_doc_id"])

    for batch in batches:
        for doc, other, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            # runs that begin at every word of a passage overlap by all but one word; less than LEAST - 1 words may be two passages
            if now is not None and now[0] == doc and now[3] == other and first <= now[2] - LEAST + 1:
                now[2] = max(now[2], last)
                continue
            if now is not None:
                out.append((now[0], now[1], now[2] - now[1], now[3]))
            now = [doc, first, last, other]
        if len(out) > 10_000:
            yield given()
            out = []
    if now is not None:
        out.append((now[0], now[1], now[2] - now[1], now[3]))
    if out:
        yield given()


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, first_word, n_words of the passages of LEAST words or more that another document has too, and that document: it has every run of LEAST words of the passage, though not always in one piece."""
    spark = docs.sparkSession
    wide = partitions(spark)
    starts, starts_path = written(_starts(docs), "starts")
    suffixes, suffixes_path = written(_array(docs, starts), "suffixes")
    hot = bitmap_of(starts.where(F.col("n") >= HOT).select("start"))
    removed(spark, starts_path)
    order = ["start", "right", "left", "doc_id", "pos"]
    matches, _ = written(suffixes.repartitionByRange(wide, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, MATCH), "matches")
    open_ = matches.where("start is not null").select("start").distinct()
    exact, _ = written(_shared_runs(_windows(suffixes, open_, hot, wide), wide), "shared")
    removed(spark, suffixes_path)
    found = matches.where("first is not null").select("doc_id", "other", "first", "last").unionByName(exact)
    return found.repartition(wide, "doc_id").sortWithinPartitions("doc_id", "other", "first", "last").mapInArrow(_merged, "doc_id long, first_word long, n_words long, other_doc_id long")
