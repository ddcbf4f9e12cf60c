"""BPE encoding and decoding over a prefix-sharing trie.

The distinct words of a batch go into a trie of symbols.  A depth-first walk gives
every node the *last token* of the encoding of the prefix that the node stands for:
the one token t that ends there, follows the last token of the prefix before t, and
forms with it a pair that byte-pair merging leaves apart.  The encoding of a word is
read back along these last tokens, so what words share as prefixes is worked out once.

Rows: null and empty texts have no ids; long texts and long words are linear in their
length, and a long text is worked off by itself; an empty table gives no rows; repeated
rows give equal results, each its own; there are no ties (a pair's rank is its own);
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import array
import gc
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_text, kept

#: Chunks of a generation of the word cache; a Python worker keeps two, the older one goes when the newer is full.
CACHE_WORDS = 180_000
#: Entries of the memo of token pairs, which starts anew when it is full.
CACHE_PAIRS = 300_000
#: Words of a trie: sorted words come in tries of so many, which bounds memory and splits few prefixes.
TRIE_WORDS = 8192


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


class TrieBpe:
    """Word-level BPE with an end-of-word suffix, from a tokenizers JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            pair = self.vocab[a], self.vocab[b]
            self.rank.setdefault(pair, i)
            self.parts.setdefault(self.vocab[a + b], pair)
        self.order = {t: self.rank[p] for t, p in self.parts.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in {**self.vocab, **self.special}.items()}
        if not self.suffix or len(self.names) >= 1 << 20:
            raise ValueError("a vocabulary with a suffix at the end of words, of under 2**20 ids, is needed")
        self.final = {s.removesuffix(self.suffix): i for s, i in self.vocab.items() if s.endswith(self.suffix) and s != self.suffix}
        self.inner = {s: i for s, i in self.vocab.items() if not s.endswith(self.suffix)}
        top = max(self.names) + 1
        self.shown = [str(i) for i in range(top)]
        self.listed = [self.names.get(i, "") for i in range(top)]
        self.code = "H" if top <= 1 << 16 else "I"
        # how long the tokens are that end in three given symbols, longest first, and what the walk has asked for
        self.inner_ends, self.final_ends = self.endings(self.inner), self.endings(self.final)
        self.inner_asked: dict[str, tuple[int, ...]] = {}
        self.final_asked: dict[str, tuple[int, ...]] = {}
        self.bytes = byte_symbols()
        self.odd = regex.compile(r"[^!-~]").search  # no byte symbols of their own: control characters and the like
        self.separators = regex.compile(r"[\x1c-\x1f]").search
        self.spaces = regex.compile(r"\s+")
        self.decoder = spec.get("decoder")
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        # generations of the cache: chunk to its ids as bytes
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters_whole = self.cut.findall("abcé日") == ["abcé日"]

    # text to words

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        # lower case is per character: a final sigma has no form of its own here
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def split(self, text: str) -> list[str]:
        """Chunks in order: what lies between white space, where no word crosses; special tokens are chunks."""
        if self.apart is None or "<|" not in text:
            return self.chunks(self.normal(text))
        out: list[str] = []
        for piece in self.apart.split(text):
            out += [piece] if piece in self.special else self.chunks(self.normal(piece))
        return out

    def chunks(self, text: str) -> list[str]:
        # str.split() and str.strip() also take the four separators, which are no white space to the pattern
        return text.split() if not self.separators(text) else [c for c in self.spaces.split(text) if c]

    # words to ids

    @staticmethod
    def endings(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        found: dict[str, set[int]] = {}
        for t in tokens:
            if len(t) >= 3:
                found.setdefault(t[-3:], set()).add(len(t))
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    def lengths(self, end: str, tokens: dict[str, int], long: dict[str, tuple[int, ...]], asked: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
        """Lengths, longest first, of the tokens that may end where the last (up to three) symbols are ``end``."""
        if len(asked) >= CACHE_PAIRS:
            asked.clear()
        short = tuple(n for n in (2, 1) if len(end) >= n and end[-n:] in tokens)
        asked[end] = got = (long.get(end, ()) if len(end) == 3 else ()) + short
        return got

    def stays_apart(self, a: int, b: int, key: int) -> bool:
        """Whether merging the symbols of token a and token b ends with just (a, b).

        Both are peeled along their last merges, the later merge first; the pair is not
        valid if some inner neighbours would have merged before the merge that was peeled.
        """
        order, rank, parts = self.order, self.rank, self.parts
        top = len(rank) + 1
        # what happens at the seam: the right edge of a and the left edge of b over time
        left, x = [(top, a)], a
        while x in parts:
            left.append((order[x], parts[x][1]))
            x = parts[x][1]
        right, y = [(top, b)], b
        while y in parts:
            right.append((order[y], parts[y][0]))
            y = parts[y][0]
        # left[i] is the token at the seam before merge left[i][0] and from merge left[i+1][0] on
        i, j, ok = len(left) - 1, len(right) - 1, True
        while True:
            ends = min(left[i][0], right[j][0])
            r = rank.get((left[i][1], right[j][1]))
            # equal ranks: the same merge on both sides; of overlapping places the left one is merged first
            if r is not None and (r < ends or r == ends and left[i][0] > ends):
                ok = False
                break
            if not i and not j:
                break
            if left[i][0] == ends and i:
                i -= 1
                continue
            if right[j][0] == ends and j:
                j -= 1
        self.pairs[key] = ok
        return ok

    def trie(self, words: list[str]) -> dict:
        """Nested dicts by symbol; the last symbol of a word, which has the suffix, is an edge that holds the word."""
        root: dict = {}
        for w in words:
            node = root
            s = w
            if self.odd(w):
                s = "".join([self.bytes[b] for b in w.encode("utf-8", "surrogatepass")])
            for c in s[:-1]:
                child = node.get(c)
                if child is None:
                    child = node[c] = {}
                node = child
            node.setdefault("", []).append((s[-1], w))
        return root

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct non-empty words, by a depth-first walk of their trie."""
        out: dict[str, list[int]] = {}
        inner, final, pairs, apart = self.inner.get, self.final.get, self.pairs, self.stays_apart
        inner_asked, final_asked = self.inner_asked.get, self.final_asked.get
        last: list[int] = []  # the last token at each depth of the walk, and where it starts
        start: list[int] = []
        stack: list[tuple[str, dict]] = [("", self.trie(words))]
        while stack:
            s, node = stack.pop()
            depth = len(s)
            if depth:
                del last[depth - 1 :], start[depth - 1 :]
                ways = inner_asked(s[-3:])
                if ways is None:
                    ways = self.lengths(s[-3:], self.inner, self.inner_ends, self.inner_asked)
                for n in ways:
                    at = depth - n
                    if at < 0:
                        continue
                    t = inner(s[at:])
                    if t is not None:
                        if not at:
                            break
                        key = last[at - 1] << 20 | t
                        ok = pairs.get(key)
                        if apart(last[at - 1], t, key) if ok is None else ok:
                            break
                else:
                    raise ValueError(f"no token ends {s!r}")
                last.append(t)
                start.append(at)
            for c, child in node.items():
                if c:
                    stack.append((s + c, child))
                    continue
                for end, word in child:  # the end of a word: its last symbol has the suffix
                    whole = s + end
                    ways = final_asked(whole[-3:])
                    if ways is None:
                        ways = self.lengths(whole[-3:], self.final, self.final_ends, self.final_asked)
                    for n in ways:
                        at = depth + 1 - n
                        if at < 0:
                            continue
                        t = final(whole[at:])
                        if t is not None:
                            if not at:
                                break
                            key = last[at - 1] << 20 | t
                            ok = pairs.get(key)
                            if apart(last[at - 1], t, key) if ok is None else ok:
                                break
                    else:
                        raise ValueError(f"no token ends {whole!r}")
                    ids = [t]
                    at -= 1
                    while at >= 0:
                        ids.append(last[at])
                        at = start[at] - 1
                    ids.reverse()
                    out[word] = ids
            if len(pairs) >= CACHE_PAIRS:
                pairs.clear()
        return out

    def known(self, texts: list[list[str]]) -> dict[str, bytes]:
        """For all chunks of these split texts: their ids."""
        out: dict[str, bytes] = {}
        fresh = []
        new, old = self.new, self.old
        for w in set().union(*texts):
            got = new.get(w)
            if got is None:
                got = old.get(w)
                if got is None:
                    fresh.append(w)
                    continue
                new[w] = got
            out[w] = got
        special, code = self.special, self.code
        made = {s: array.array(code, [i]).tobytes() for s, i in special.items()}
        cut = {w: self.cut.findall(w) for w in fresh if not (self.letters_whole and w.isalpha()) and w not in special}
        pieces = sorted({x for w in fresh for x in cut.get(w, (w,)) if x not in special})
        running = gc.isenabled()
        gc.disable()  # a trie is many small dicts without cycles
        try:
            for lo in range(0, len(pieces), TRIE_WORDS):
                for w, ids in self.encode_words(pieces[lo : lo + TRIE_WORDS]).items():
                    made[w] = array.array(code, ids).tobytes()
        finally:
            if running:
                gc.enable()
        for w in fresh:
            xs = cut.get(w)
            out[w] = new[w] = made[w] if xs is None else b"".join([made[x] for x in xs])
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}
        return out

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        known = self.known([words])
        return array.array(self.code, b"".join(map(known.__getitem__, words))).tolist()

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space; ids unknown to it are left out."""
        if self.decoder is not None:
            raise NotImplementedError("only files without a decoder")
        return " ".join(self.names[i] for i in ids if i in self.names)


def coder(path: str) -> TrieBpe:
    """One coder per worker process and file."""
    return kept(("bpe", path), lambda: TrieBpe(path))


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and the ids themselves) of every whole text."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))

    def make(texts: list[str]) -> dict[str, list]:
        tok = coder(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        split = [tok.split(t) for t in texts]
        known = tok.known(split).__getitem__
        shown, names = tok.shown.__getitem__, tok.listed.__getitem__
        for words in split:
            ids = array.array(tok.code, b"".join(map(known, words)))
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(shown, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(" ".join(map(names, ids)).encode("utf-8", "surrogatepass")).hexdigest())
            out["ids"].append(np.array(ids, np.int32) if keep_ids else None)
        return out

    schema = pa.schema(fields)
    kinds = {"int64": "long", "string": "string"}
    ddl = ", ".join(f"{n} {kinds.get(str(t), 'array<int>')}" for n, t in fields)
    return docs.select("doc_id", "text").mapInArrow(by_text(make, schema), ddl)
