"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secret.  Its URL escapes and its Unicode escapes
are decoded over the whole of it, and runs that look base64-coded, compressed (zlib, gzip,
bz2, xz) or not, are unwrapped, into layers; every layer is scanned and searched for
further ones until nothing new turns up, and compressed bytes unfold until they are so no
more.  A run is decoded from each of its first four characters on, since what stands
before the code may be of its alphabet too, and runs on adjacent lines are decoded as one
besides.  Each character of a layer knows the span of the original text that it came from,
so hits in a layer are reported as spans of the original.  A layer seen before over the
same span is not entered again, which ends cycles.  Escapes of escapes are layers of their
own four deep; deeper chains are decoded to the end in one layer, and of stream heads that
lead to the same data the first counts, so that time follows the text's length.

Rows: null and empty texts have no hits; texts are scanned whole, long ones by themselves;
equal texts and repeated rows have equal hits, each row its own; of hits that start at one
place (ties) the kinds' order decides; an empty table gives no rows; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_text, slices

#: Kinds in order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run that is long enough is the same as a whole run that passes: runs are maximal.
HEX = re.compile(r"[0-9a-f]{16,}")

URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_UNIT = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Such runs on lines one after the other, the last one of any length.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,}+)*+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]++)?")
BREAK = re.compile(r"[^A-Za-z0-9+/_-]+")
#: Bytes that one compressed run may unfold to at once, more come in blocks; a parameter against decompression bombs.
UNFOLD = 1 << 24
#: No secret, run or escape holds such a byte, so blocks are cut there; a block without any shares LAP bytes with the next.
CUT = re.compile(rb"""[^A-Za-z0-9+/_.=%\\"':\x20-](?=[A-Za-z0-9+/_.=%\\"':\x20-]*\Z)""")
LAP = 1 << 16

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def hits(text: str) -> list[Span]:
    """Spans of the three kinds in this very text, leftmost and non-overlapping for each kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """Decoded text; ``at`` gives for each character the (start, end) in the original, ``escapes`` in how many escapes it lay."""

    __slots__ = ("text", "at", "escapes")

    def __init__(self, text: str, at: Callable[[int], tuple[int, int]], escapes: int = 0):
        self.text, self.at, self.escapes = text, at, escapes


def _decode_units(text: str, at, unit: re.Pattern, raw) -> Layer | None:
    """The text with all its escapes decoded, if it has any."""
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    done = 0
    for m in unit.finditer(text):
        chars.append(text[done : m.start()])
        spans += [at(i) for i in range(done, m.start())]
        got = raw(m)
        chars.append(got)
        spans += [(at(m.start())[0], at(m.end() - 1)[1])] * len(got)
        done = m.end()
    if not done:
        return None
    chars.append(text[done:])
    spans += [at(i) for i in range(done, len(text))]
    return Layer("".join(chars), spans.__getitem__)


#: An escape of an escape character, and what it takes to be one again; a chain of them is as long as it is deep.
CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})|\\\\(?:u005[Cc]|x5[Cc])+(?=u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})")
#: Layers of escapes inside each other that are decoded one by one; what lies deeper is decoded to the end at once.
DEEP = 4
ESCAPE = re.compile(r"%([0-7][0-9A-Fa-f])|\\u(00[0-7][0-9A-Fa-f])|\\x([0-7][0-9A-Fa-f])")


def _to_the_end(text: str, at) -> Layer | None:
    """The text with its escapes of ASCII characters decoded until none is left, in one pass; other escapes stay.

    A decoded percent sign or backslash stands before the text that follows, and may begin
    an escape again.
    """
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    i, size, changed = 0, len(text), False
    while i < size:
        c = text[i]
        if c not in "%\\":
            j = i + 1
            while j < size and text[j] not in "%\\":
                j += 1
            chars.append(text[i:j])
            spans += [at(k) for k in range(i, j)]
            i = j
            continue
        start, i = i, i + 1
        while c in "%\\":
            m = ESCAPE.match(c + text[i : i + 5])
            if not m:
                break
            c, i, changed = chr(int(m[1] or m[2] or m[3], 16)), i + m.end() - 1, True
        chars.append(c)
        spans.append((at(start)[0], at(i - 1)[1]))
    return Layer("".join(chars), spans.__getitem__) if changed else None


def _from_url(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")


def _from_unicode(m: re.Match) -> str:
    return chr(int(m[1] or m[2], 16))


def _plain(raw: bytes) -> str:
    """Bytes as text; those that are no text are a character each, which no secret holds."""
    return raw.decode("utf-8", "surrogateescape")


#: How compressed streams begin, wherever in decoded bytes they do: zlib, gzip, bz2, xz.
HEADS = re.compile(rb"\x78[\x01\x5e\x9c\xda]|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0")


#: What follows a head of bz2, and the length of a gzip head without its optional parts.
BZ2_BLOCKS, GZIP_HEAD = (b"1AY&SY", b"\x17rE8P\x90"), 10


def _heads(raw: bytes) -> Iterator[int]:
    """Places where a compressed stream may begin: its head is whole, and its data do not begin where others' that came before do."""
    seen: set[int] = set()
    nul = -1
    for m in HEADS.finditer(raw):
        at = m.start()
        kind = raw[at]
        if kind == 0x1F:
            if len(raw) < at + GZIP_HEAD or raw[at + 3] & 0xE0:
                continue
            flags, data = raw[at + 3], at + GZIP_HEAD
            if flags & 4:
                data += 2 + int.from_bytes(raw[data : data + 2], "little")
            for part in (8, 16):
                # a name ends with a zero byte; one that lies behind many heads is looked for once
                if flags & part and data >= 0:
                    if nul < data:
                        nul = raw.find(b"\0", data)
                        nul = len(raw) if nul < 0 else nul
                    data = nul + 1 if nul < len(raw) else -1
            if data < 0:
                continue
            data += 2 * bool(flags & 2)
        elif kind == 0x78:
            data = at + 2
        elif kind == 0x42:
            if not raw.startswith(BZ2_BLOCKS, at + 4):
                continue
            data = at
        else:
            data = at
        # a deflate block has no fourth type
        if data >= len(raw) or (kind in (0x78, 0x1F) and raw[data] >> 1 & 3 == 3) or data in seen:
            continue
        seen.add(data)
        yield at


def _decompressor(head: bytes):
    if head[:1] in (b"\x78", b"\x1f"):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor()


class Damaged(Exception):
    """Bytes that are no such stream, or one that is cut off."""


def _inflated(raw: bytes | memoryview, bare: bool) -> Iterator[bytes]:
    """What a stream and those right behind it unfold to, in pieces of UNFOLD bytes at most."""
    while len(raw):
        d = zlib.decompressobj(-15) if bare else _decompressor(bytes(raw[:2]))
        try:
            while not d.eof:
                out = d.decompress(raw, UNFOLD)
                # zlib gives back what it has not read, the others keep it
                raw = getattr(d, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not raw and not d.eof and getattr(d, "needs_input", True):
                    raise Damaged
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError) as e:
            raise Damaged from e
        raw = d.unused_data.lstrip(b"\0")
        if bare or not HEADS.match(raw):
            return


def _unfolded(raw: bytes) -> Iterator[tuple[int, str]]:
    """Texts of what compressed streams in these bytes unfold to, and of what that unfolds to, with the place of the outermost stream."""
    work, seen = [(None, raw)], {hashlib.sha256(raw).digest()}
    while work:
        outer, raw = work.pop()
        view = memoryview(raw)
        # a bare stream has no head to be found by, so it is one only from the first byte on
        for bare, at in [*((False, at) for at in _heads(raw)), (True, 0)]:
            place, held, over = at if outer is None else outer, b"", False
            try:
                for piece in _inflated(view[at:], bare):
                    held += piece
                    if len(held) > UNFOLD:
                        over = True
                        m = CUT.search(held)
                        cut = m.end() if m else len(held)
                        yield place, _plain(held[:cut])
                        held = held[cut:] if m else held[-LAP:]
            except Damaged:
                if bare and not over:
                    continue  # other bytes often begin like a bare stream; one with a head is read as far as it goes
            if held:
                yield place, _plain(held)
                if not over and (key := hashlib.sha256(held).digest()) not in seen:
                    seen.add(key)
                    work.append((place, held))


def _at_bytes(plain: str, size: int, first: int, final: int, at) -> Callable[[int], tuple[int, int]]:
    """Spans of the characters of base64 code from ``first`` to ``final``: those of the groups of four that hold their bytes."""
    begin = None if len(plain) == size else list(accumulate((len(c.encode("utf-8", "surrogateescape")) for c in plain), initial=0))

    def span(i: int) -> tuple[int, int]:
        lo, hi = (i, i + 1) if begin is None else (begin[i], begin[i + 1])
        return at(first + lo // 3 * 4)[0], at(min(final, first + (hi - 1) // 3 * 4 + 4) - 1)[1]

    return span


def _from_base64(code: str, at) -> Iterator[Layer]:
    """The layers of a run of base64 characters, read from each of the first four on."""
    plain_code = code.replace("-", "+").replace("_", "/")
    for first in range(4):
        # one character left over holds no whole byte
        final = len(code) - ((len(code) - first) % 4 == 1)
        if final - first < 12:
            return
        try:
            raw = base64.b64decode(plain_code[first:final] + "=" * (-(final - first) % 4))
        except (binascii.Error, ValueError):
            continue
        plain = _plain(raw)
        yield Layer(plain, _at_bytes(plain, len(raw), first, final, at))
        for place, plain in _unfolded(raw):
            whole = at(first + place // 3 * 4)[0], at(final - 1)[1]
            yield Layer(plain, lambda i, whole=whole: whole)


def unwrapped(text: str, at, escapes: int = 0) -> Iterator[Layer]:
    """The layers directly inside this text."""
    if escapes >= DEEP and ("%" in text or "\\" in text) and (x := _to_the_end(text, at)):
        yield x
    elif escapes < DEEP:
        if "%" in text and (x := _decode_units(text, at, URL_UNIT, _from_url)):
            x.escapes = escapes + 1
            yield x
        if ("\\u" in text or "\\x" in text) and (x := _decode_units(text, at, UNICODE_UNIT, _from_unicode)):
            x.escapes = escapes + 1
            yield x
    for m in BASE64_RUN.finditer(text):
        yield from _from_base64(m[0], lambda i, start=m.start(): at(start + i))
    if "\n" in text:
        for m in BASE64_LINES.finditer(text):
            if "\n" in m[0]:
                place = [m.start() + i for i, c in enumerate(m[0]) if not BREAK.match(c)]
                yield from _from_base64(BREAK.sub("", m[0]), lambda i, place=place: at(place[i]))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those of decoded layers are added, each as a span of the original."""
    base = sorted(hits(text))
    found = set(base)
    work = [unwrapped(text, lambda i: (i, i + 1))]
    seen: set[tuple] = set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        at, last = layer.at, len(layer.text) - 1
        same = layer.text if last < 1000 else hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest()
        key = at(0)[0], at(last)[1], same
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in hits(layer.text):
            found.add((at(start)[0], kind, at(end - 1)[1]))
        work.append(unwrapped(layer.text, at, layer.escapes))
    return base, sorted(found)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of the plain text; spans with those of all layers."""

    def make(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for t in texts:
            base, found = scan(t)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(shown(base).encode()).hexdigest())
            out["spans"].append(shown(found))
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    return docs.select("doc_id", "text").mapInArrow(by_text(make, schema), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with all found spans, decoded ones too, replaced; overlapping spans are one."""
    out, done = [], 0
    for start, _, end in sorted(scan(text)[1]):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in ``text`` are replaced and ``n_chars``, if it is there, follows. Null stays null."""
    from pyspark.sql import functions as F

    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                texts = [None if t is None else redact(t) for t in part.column("text").to_pylist()]
                cols = [pa.array(texts, f.type) if f.name == "text" else part.column(i) for i, f in enumerate(part.schema)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
