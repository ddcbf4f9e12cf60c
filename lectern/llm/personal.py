"""Personal data by bootstrapped contextual extraction.

Four kinds have patterns of their own (email, ip, card, phone); what these find are the
seeds. Every text is read once: its base spans, and its slots, which are the seeds and
whatever else looks like an identifier (five digits or more, or an at sign), each with the
lexical patterns that it stands in: the word before, the two words before, the words on
either side. The rest are Spark tables. Distinct pairs (pattern, identifier) are a graph. In
each round a pattern's confidence for a kind is the lower bound (Wilson, 95 %) of the share
of the kind's known identifiers, by their scores, among all that it holds; an identifier's
score is the noisy-or of the patterns of that kind whose confidence is high enough, and a
known one stays known. New ones count for their patterns in the next round, until a round
finds none. Wherever a discovered identifier stands, its span is added.

Copies of a document give the same pairs and no confidence: only different identifiers do.
Pairs are counted before they are shuffled, so a passage of a third of all rows is a few
rows for each task.

Rows: null and empty texts have no spans; long texts are scanned whole, by themselves; equal
texts have equal spans, and repeated rows are rows of their own; of spans that start at one
place (ties) the kinds' order decides, and an identifier that two kinds claim equally well is
of the first; an empty table gives no rows; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, written

#: Kinds in order, their patterns, and what a match has to be. A match of ip, card or email that starts in
#: the middle of a run is no other than one from its first character, so runs are entered at their start alone.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, PART = (14, 19), (10, 15), 255

#: A word with a digit or at sign, with the words of digits behind it; what of it is an identifier.
SLOT = re.compile(r"(?<!\S)(?=\S*?[0-9@]|\S*?[(\[]at[)\]])\S++(?:\x20[0-9()./-]*[0-9][0-9()./-]*(?=[\s,;:!?]|\Z))*")
AROUND = ".,;:!?\"'|*#$%&<>{}"
LEAST_DIGITS, AT = 5, re.compile(r"@|[(\[]at[)\]]", re.I)
#: Characters on either side in which the words of a context are looked for.
NEAR = 120

#: Parameters: standard deviations of the bound, the confidence of a pattern and the score of an identifier, rounds at most.
Z, CONFIDENCE, SCORE, ROUNDS = 1.96, 0.5, 0.5, 5

Span = tuple[int, int, int]  # start, place of the kind, end


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From at sign to at sign, so that a long run without one costs nothing."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, leftmost and non-overlapping for each kind."""
    out = emails(text) if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(n := x.lstrip("0")) <= 3 and int(n or 0) <= PART for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0] and CARD_DIGITS[0] <= len(n := digits(m[0])) <= CARD_DIGITS[1] and luhn(n):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(out)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Places of what looks like an identifier and touches no base span."""
    out: list[tuple[int, int]] = []
    busy = sorted((s, e) for s, _, e in taken)
    at = 0
    for m in SLOT.finditer(text):
        start, end = m.start(), m.end()
        while start < end and text[start] in AROUND:
            start += 1
        while end > start and text[end - 1] in AROUND:
            end -= 1
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if at < len(busy) and busy[at][0] < end:
            continue
        if len(digits(word := text[start:end])) >= LEAST_DIGITS or AT.search(word):
            out.append((start, end))
    return out


def patterns_at(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a slot: its place is an underscore, digits are all alike."""
    before = [re.sub("[0-9]", "0", w) for w in text[max(0, start - NEAR) : start].lower().split()[-2:]]
    after = [re.sub("[0-9]", "0", w) for w in text[end : end + NEAR].lower().split()[:1]]
    out = [f"{before[-1]} _"] if before else []
    if len(before) == 2:
        out.append(f"{' '.join(before)} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


SLOTS = "array<struct<start:int,end:int,kind:int,value:string,patterns:array<string>>>"
_SLOT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id and the slots of each text; ``kind`` is the kind of a base span and null for a candidate."""

    def make(texts: list[str]) -> dict[str, list]:
        slots = []
        for t in texts:
            base = base_spans(t)
            found = [(s, e, k) for s, k, e in base] + [(s, e, None) for s, e in candidates(t, base)]
            slots.append([{"start": s, "end": e, "kind": k, "value": t[s:e].lower(), "patterns": patterns_at(t, s, e)} for s, e, k in found])
        return {"slots": slots}

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("slots", pa.list_(_SLOT))])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(by_text(make, schema), f"row long, doc_id long, slots {SLOTS}")


def graph(slots: DataFrame) -> DataFrame:
    """Distinct (pattern, value, kind): the kind is null for what no base pattern finds. ``slots`` is the result of ``scanned``."""
    one = slots.select(F.explode("slots").alias("s")).select("s.value", "s.kind", F.explode("s.patterns").alias("pattern"))
    return one.distinct().select("pattern", "value", "kind")


def wilson(good: Column, n: Column) -> Column:
    """Lower bound of a share."""
    p, z2 = good / n, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def confident_patterns(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that pass; ``known`` (value, kind, score) are the identifiers found so far."""
    if known is None:
        kind, score = F.col("kind"), F.lit(1.0)
        now = edges
    else:
        now = edges.join(known.withColumnsRenamed({"kind": "new"}), "value", "left")
        kind, score = F.coalesce("kind", "new"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("score"))
    sums = [F.coalesce(F.sum(F.when(kind == k, score)), F.lit(0.0)).alias(f"s{k}") for k in range(len(KINDS))]
    counted = now.groupBy("pattern").agg(F.count("*").alias("n"), *sums)
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), wilson(F.col(f"s{k}"), F.col("n")).alias("confidence")) for k in range(len(KINDS))]))
    return counted.select("pattern", each).where(F.col("confidence") >= CONFIDENCE)


def scored_values(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the identifiers that the patterns discover, each of its best kind."""
    hits = edges.where("kind is null").select("pattern", "value").join(patterns, "pattern")
    scores = hits.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999999)))))).alias("score"))
    best = scores.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select("value", (-F.col("b.k")).alias("kind"), "b.score").where(F.col("score") >= SCORE)


def bootstrapped(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and identifiers after the last round: (pattern, kind, confidence) and (value, kind, score)."""
    known, count = None, 0
    for _ in range(ROUNDS):
        patterns, _ = written(confident_patterns(edges, known), "patterns")
        found = scored_values(edges, patterns)
        if known is not None:
            # one that is known stays, with the better score
            both = known.unionByName(found).groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
            found = both.select("value", (-F.col("b.k")).alias("kind"), "b.score")
        known, _ = written(found, "identifiers")
        before, count = count, known.count()
        if count == before:
            break
    return patterns, known


class Extraction:
    """What a corpus gave: ``slots`` of each row, ``patterns`` and discovered ``values``."""

    def __init__(self, docs: DataFrame):
        self.slots, _ = written(scanned(docs), "slots")
        self.edges, _ = written(graph(self.slots), "edges")
        self.patterns, self.values = bootstrapped(self.edges)

    def added(self) -> DataFrame:
        """row and the spans that the method adds to it."""
        some = self.slots.select("row", F.explode("slots").alias("s")).where("s.kind is null").select("row", "s.start", "s.end", "s.value")
        hits = some.join(self.values.select("value", "kind"), "value")
        return hits.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))

    def documents(self) -> DataFrame:
        """doc_id, counts of base spans, base_sha256, spans, n_found: one row for each row of the corpus."""
        base = F.transform(F.filter("slots", lambda s: s.kind.isNotNull()), lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
        rows = self.slots.select("row", "doc_id", base.alias("base")).join(self.added(), "row", "left").withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
        of = lambda k: F.filter("base", lambda s: s.kind == k)
        n = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
        return rows.select("doc_id", *n, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_found"))


def shown(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = lambda k: reduce(lambda out, i: out.when(k == i, KINDS[i]), range(1, len(KINDS)), F.when(k == 0, KINDS[0]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names(s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    return Extraction(docs).documents()
