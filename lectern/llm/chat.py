"""Chat formatting: roles of messages by a hidden Markov model, then canonical turns.

States are roles.  A line is observed through its speaker marker, its length and how it
ends, a message also through its number of lines.  Probabilities are counted over all
messages with a recorded role; Viterbi then recovers the likeliest roles from text and
order alone.  Adjacent messages of one role become one canonical turn.

Messages are sorted by conversation and turn over range partitions.  What a partition
holds of a conversation is a segment; a segment is summed up by its max-plus matrix
(best log probability from the state before it to its last state), segments are linked
by these matrices, and each is then decoded between known end states.  So a
conversation of any length is spread over partitions, and the result is that of one
Viterbi run over all of it.

Rows: a null or empty text is a message without lines; null roles are recovered like
others but not learned from; messages with the same turn are ordered by their text;
repeated rows are messages each; rows with a null conv_id are one conversation; a null
turn comes first; without any recorded role all are "user"; a long text is its lines, a
long conversation is spread over segments; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import partitions, written

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker at the start of a line.
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
}
MARKER = re.compile(r"^\s*[\[<(*#]*\s*(?:<\|)?(" + "|".join(sorted((w for m in MARKERS.values() for w in m), key=len, reverse=True)) + r")(?:\|>)?\s*[\])>*]*(?:\s*[:>]|\s*-(?!\S))\s*", re.I)
KIND = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r]}
#: Values of each feature: marker, length, end of a line; lines of a message.
SIZES = (4, 16, 5, 8)
SMOOTH = 0.5
BEGIN, END = "<|{}|>\n", "\n<|end|>\n"


def observed(text: str) -> np.ndarray:
    """Counts of the feature values of a message, one after the other."""
    out = np.zeros(sum(SIZES), np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    for line in lines:
        m = MARKER.match(line)
        out[KIND[m[1].lower()] if m else 0] += 1
        out[4 + min(15, len(line).bit_length())] += 1
        last = line.rstrip()[-1]
        out[20 + ("?!.:".index(last) + 1 if last in "?!.:" else 0)] += 1
    out[25 + min(7, len(lines))] += 1
    return out


class Model:
    """Log probabilities: first role, role after role, feature value in role."""

    def __init__(self, first: np.ndarray, after: np.ndarray, seen: np.ndarray):
        self.first = np.log((first + SMOOTH) / (first + SMOOTH).sum())
        self.after = np.log((after + SMOOTH) / (after + SMOOTH).sum(1, keepdims=True))
        parts, lo = [], 0
        for n in SIZES:
            part = seen[:, lo : lo + n] + SMOOTH
            parts.append(np.log(part / part.sum(1, keepdims=True)))
            lo += n
        self.seen = np.concatenate(parts, 1)

    def emitted(self, texts: list[str]) -> np.ndarray:
        return np.array([self.seen @ observed(t) for t in texts]).reshape(-1, len(ROLES))

    def summary(self, emitted: np.ndarray) -> np.ndarray:
        """Max-plus matrix of a segment that follows another: from the state before it to its last state."""
        best = self.after + emitted[0]
        for e in emitted[1:]:
            best = (best[:, :, None] + self.after).max(1) + e
        return best

    def begun(self, emitted: np.ndarray) -> np.ndarray:
        """Best log probabilities of the last states of a segment that begins a conversation."""
        score = self.first + emitted[0]
        for e in emitted[1:]:
            score = (score[:, None] + self.after).max(0) + e
        return score

    def path(self, emitted: np.ndarray, entry: int | None, leave: int | None) -> list[int]:
        """Viterbi between the state before (None: the conversation begins) and a last state (None: any)."""
        score = emitted[0] + (self.first if entry is None else self.after[entry])
        back = []
        for e in emitted[1:]:
            ways = score[:, None] + self.after
            back.append(ways.argmax(0))
            score = ways.max(0) + e
        state = int(score.argmax()) if leave is None else leave
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def render(messages: list[tuple[str, str]]) -> str:
    """Canonical turns: adjacent messages of a role are one turn, speaker markers are cut off."""
    out, last = [], None
    for role, text in messages:
        body = MARKER.sub("", text, count=1).strip()
        if role == last:
            out.append("\n" + body)
        else:
            out += [END if last else "", BEGIN.format(role), body]
        last = role
    return "".join(out) + (END if last else "")


def parse_transcript(text: str, model: Model) -> list[tuple[str, str]]:
    """(role, text) of the messages of a raw transcript: a message begins at a marker or after an empty line."""
    messages: list[list[str]] = []
    fresh = True
    for line in text.split("\n"):
        if not line.strip():
            fresh = True
        elif fresh or MARKER.match(line):
            messages.append([line])
            fresh = False
        else:
            messages[-1].append(line)
    texts = ["\n".join(m) for m in messages]
    return list(zip([ROLES[i] for i in model.path(model.emitted(texts), None, None)], texts, strict=True)) if texts else []


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, rows) of the runs of a sorted partition, long runs in pieces of STEP rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (held[-1][0] != row[0] or len(held) >= STEP):
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


#: Messages that a task holds at a time.
STEP = 4096


def _sorted(conversations: DataFrame) -> DataFrame:
    """Messages with the number of their segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, (_, rows) in enumerate(segments(batches)):
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["segment", "conv_id", "turn", "role", "text"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "text"]
    return rows.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "segment long, conv_id long, turn long, role string, text string")


def _counted(messages: DataFrame) -> Model:
    """The model, from counts over all messages; pairs across segments count as well."""
    wide = sum(SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ROLES), len(ROLES) + wide), np.int64)
        ends: dict[int, list] = {}
        for batch in batches:
            for segment, conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = ROLES.index(role) if role in ROLES else -1
                if segment in ends:
                    if ends[segment][2] >= 0 and r >= 0:
                        n[ends[segment][2], r] += 1
                    ends[segment][2] = r
                else:
                    ends[segment] = [conv, r, r]
                if r >= 0:
                    n[r, len(ROLES) :] += observed(text)
        kind = [0] * n.size + [1] * len(ends)
        a = [*range(n.size), *ends]
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array([*n.ravel().tolist(), *[0] * len(ends)], pa.int64()), pa.array([None] * n.size + [e[0] for e in ends.values()], pa.int64()), pa.array([None] * n.size + [e[1] for e in ends.values()], pa.int32()), pa.array([None] * n.size + [e[2] for e in ends.values()], pa.int32())], names=["kind", "a", "n", "conv_id", "first", "last"])

    found, _ = written(messages.mapInArrow(run, "kind int, a long, n long, conv_id long, first int, last int"), "counts")
    counts = np.zeros((len(ROLES), len(ROLES) + wide))
    for a, n in found.where("kind = 0").groupBy("a").agg(F.sum("n")).collect():
        counts.flat[a] = n
    before = F.lag("last").over(W.Window.partitionBy("conv_id").orderBy("a"))
    number = F.row_number().over(W.Window.partitionBy("conv_id").orderBy("a"))
    links = found.where("kind = 1").select("first", before.alias("before"), number.alias("number")).where("first >= 0")
    first = np.zeros(len(ROLES))
    for b, f, begins, n in links.groupBy("before", "first", (F.col("number") == 1).alias("begins")).count().collect():
        if begins:
            first[f] += n
        elif b is not None and b >= 0:
            counts[b, f] += n
    return Model(first, counts[:, : len(ROLES)], counts[:, len(ROLES) :])


def recovered_turns(conversations: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, recorded and recovered role, whether it begins a canonical turn,
    and its piece of the canonical text (in order, the pieces of a conversation join to what render() gives)."""
    spark = conversations.sparkSession
    messages, _ = written(_sorted(conversations), "messages")
    shared = spark.sparkContext.broadcast(_counted(messages))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for segment, held in segments(batches):
            e = shared.value.emitted([r[4] for r in held])
            rows.append((segment, held[0][1], shared.value.summary(e).ravel().tolist(), shared.value.begun(e).tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment", "conv_id", "through", "begun"])

    # a few numbers for each STEP messages of a conversation
    linked = messages.mapInArrow(summed, "segment long, conv_id long, through array<double>, begun array<double>").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "through", "begun"))).alias("parts"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                score, back = np.array(parts[0]["begun"]), []
                for p in parts[1:]:
                    ways = score[:, None] + np.array(p["through"]).reshape(len(ROLES), -1)
                    back.append(ways.argmax(0))
                    score = ways.max(0)
                leave = [int(score.argmax())]
                for b in reversed(back):
                    leave.append(int(b[leave[-1]]))
                leave.reverse()
                out += [(p["segment"], leave[i - 1] if i else None, leave[i], i + 1 == len(parts)) for i, p in enumerate(parts)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["segment", "entry", "leave", "final"])

    ends = linked.select("parts").mapInArrow(link, "segment long, entry int, leave int, final boolean")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in segments(batches):
            entry, leave, final = held[0][5:]
            path = shared.value.path(shared.value.emitted([r[4] for r in held]), entry, leave)
            rows = []
            for i, (r, state) in enumerate(zip(held, path, strict=True)):
                before = path[i - 1] if i else entry
                lead = "\n" if before == state else ("" if before is None else END) + BEGIN.format(ROLES[state])
                piece = lead + MARKER.sub("", r[4], count=1).strip() + (END if final and i + 1 == len(path) else "")
                rows.append((r[1], r[2], r[3], ROLES[state], before != state, piece, hashlib.sha256(piece.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "recorded", "role", "begins", "piece", "piece_sha256"])

    out = messages.join(ends, "segment").select("segment", "conv_id", "turn", "role", "text", "entry", "leave", "final")
    out = out.repartition(partitions(spark), "segment").sortWithinPartitions("segment", "turn", "text")
    return out.mapInArrow(decoded, "conv_id long, turn long, recorded string, role string, begins boolean, piece string, piece_sha256 string")
