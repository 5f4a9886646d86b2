"""Byte-pair encoding of words by depth-first traversal of a prefix trie.

The encoder reads a ``tokenizer.json`` whose model is BPE with an end-of-word
suffix.  Texts are cut at ASCII white space into *chunks*; no rule of the
normaliser or the pre-tokeniser reaches across such a cut, so a chunk's ids do
not depend on its neighbours.  A chunk is normalised and cut into words, and
all words new to a group of texts are inserted into one trie.  Walking the
trie depth first, every node keeps the last token of the encoding of its
prefix: the one vocabulary entry that ends there and may stand after the last
token of the prefix before it.  Words that share a prefix share that work.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: ASCII and the Latin-1 letters: here lower-casing is one to one and normalisation changes nothing.
_PLAIN = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ \t-\ra-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
_NEVER = 1 << 30
#: ASCII white space; what the pre-tokeniser drops wherever it stands.
_SPACES = "\n\t\r\x0b\x0c"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def chunks(text: str) -> list[str]:
    """The text cut at ASCII white space; may hold empty strings."""
    for c in _SPACES:
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


class WordBpe:
    """Exact re-implementation of the library's ids for one word-level BPE file."""

    def __init__(self, path: str, cached_chunks: int = 200_000, cached_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.texts: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts |= {i: t for t, i in self.special.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._path, self._library = path, None
        self.cached_chunks, self.cached_words = cached_chunks, cached_words
        self._chunk_ids: dict[str, bytes] = {"": b""}
        self._word_ids: dict[bytes, bytes] = {}

        back = {c: b for b, c in byte_letters().items()}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        n = max(model["vocab"].values()) + 1
        self.born, self.parts = [-1] * n, [None] * n
        vocab, end = model["vocab"], len(self.suffix)
        for t, i in vocab.items():
            if end and t.endswith(self.suffix):
                self.final[bytes(map(back.__getitem__, t[:-end]))] = i
            else:
                self.inner[bytes(map(back.__getitem__, t))] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            made = vocab[a + b]
            self.made.append(made)
            if self.parts[made] is None:
                self.born[made], self.parts[made] = r, (left, right)
        self.longest = max(map(len, [*self.inner, *self.final]))
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.table = [self.texts.get(i) for i in range(max(self.texts) + 1)]
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.texts) + 1)]

    # -- words ---------------------------------------------------------------

    def words(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a chunk without special tokens, as UTF-8."""
        if chunk.isascii() or _PLAIN.fullmatch(chunk):
            low = chunk.lower()
            return [low.encode()] if low.isalpha() else [w.encode() for w in _PLAIN_WORD.findall(low)]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
            self._back = {c: b for b, c in byte_letters().items()}
        text = self._library.normalizer.normalize_str(chunk)
        return [bytes(map(self._back.__getitem__, w)) for w, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, chunk: str) -> list[bytes | int]:
        """Words of a chunk in order; an id where it holds a special token."""
        if self._split is None or "<" not in chunk:
            return self.words(chunk)
        out: list[bytes | int] = []
        for part in self._split.split(chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words(part)
        return out

    # -- the trie ------------------------------------------------------------

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves two adjacent tokens as they are.

        The symbols that touch the border live from their own merge to the
        merge that swallows them.  A merge across the border happens if its
        rank comes before the end of both; of equal ranks the leftmost goes
        first, which is the inner one on the left side and the border's on the
        right side.
        """
        a, b, a_end, b_end = left, right, _NEVER, _NEVER
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < a_end and r <= b_end:
                return False
            if self.born[a] < 0 and self.born[b] < 0:
                return True
            # Step back in time over the later of the two births; on a tie the left one is earlier.
            if self.born[a] > self.born[b]:
                a_end, a = self.born[a], self.parts[a][1]
            else:
                b_end, b = self.born[b], self.parts[b][0]

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        known = self._whole.get(token)
        if known is None:
            p = self.parts[token]
            known = p is None or self.whole(p[0]) and self.whole(p[1]) and self._joins(token)
            self._whole[token] = known
        return known

    def _joins(self, token: int) -> bool:
        ids = self._symbols(token)
        return self.merge(ids) == [token]

    def _symbols(self, token: int) -> list[int]:
        p = self.parts[token]
        return [token] if p is None else self._symbols(p[0]) + self._symbols(p[1])

    def merge(self, ids: list[int]) -> list[int]:
        """Plain BPE: the lowest rank first, leftmost among equals."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: (self.rank.get((ids[i], ids[i + 1]), _NEVER), i))
            if (pair := (ids[best], ids[best + 1])) not in self.rank:
                break
            ids[best : best + 2] = [self.made[self.rank[pair]]]
        return ids

    def traverse(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of every distinct word, as little-endian unsigned 32-bit integers.

        Sorted order is the depth-first order of the trie's leaves; the lists
        ``last`` and ``done`` are the path from the root to the current node.
        """
        out: dict[bytes, bytes] = {}
        inner, final, packed, known = self.inner.get, self.final.get, self.packed, self._fits
        last: list[int] = [-1]  # the last token at each depth of the path
        begin: list[int] = [0]  # where that token begins
        done: list[bytes] = [b""]  # the packed ids up to there
        before = b""
        for w in sorted(words):
            n = len(w)
            if not n:
                out[w] = b""
                continue
            shared, most = 0, min(len(last) - 1, n - 1)
            if before[:most] == w[:most]:
                shared = most
            else:
                while before[shared] == w[shared]:
                    shared += 1
            del last[shared + 1 :], begin[shared + 1 :], done[shared + 1 :]
            before = w
            # The likely one goes first: the token before, grown by a byte.
            start = begin[shared]
            for i in range(shared + 1, n):
                t = inner(w[start:i])
                if t is None or not ((ok := known.get(last[start] << 20 | t)) or ok is None and self.follows(last[start], t)):
                    start, t = self._other(inner, w, i, start, last)
                last.append(t)
                begin.append(start)
                done.append(done[start] + packed[t])
            t = final(w[start:])
            if t is None or not self.follows(last[start], t):
                start, t = self._other(final, w, n, start, last)
            out[w] = done[start] + packed[t]
        return out

    def follows(self, left: int, token: int) -> bool:
        """Whether the token may stand after ``left``; -1 is the start of a word."""
        key = left << 20 | token
        ok = self._fits.get(key)
        if ok is None:
            ok = self._fits[key] = (left < 0 or self.fits(left, token)) and self.whole(token)
        return ok

    def _other(self, entry, w: bytes, end: int, tried: int, last: list[int]) -> tuple[int, int]:
        """Where the token that ends at ``end`` begins, and the token; at most one can end there."""
        for start in (end - 1, *range(max(0, end - self.longest), end - 1)):
            if start != tried and (t := entry(w[start:end])) is not None and self.follows(last[start], t):
                return start, t
        raise ValueError(f"no encoding of {w!r}: the vocabulary lacks a byte")

    # -- texts ---------------------------------------------------------------

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; one trie for all words that the group brings.

        Chunks are numbered by Arrow, so Python meets each distinct one once a
        group; the texts' ids are gathered by number.  Words and chunks seen
        early are kept for later groups, up to a bound; beyond it a group's own
        are forgotten with the group.
        """
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        found = self._ids_of_chunks(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        each = size[codes]
        ends = np.cumsum(each)
        at = np.repeat(begin[codes] - ends + each, each)
        at += np.arange(len(at))
        last = np.cumsum(counts)
        total = np.concatenate([[0], ends])[np.stack([last - counts, last])]
        return pool[at], total[1] - total[0]

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode_flat(pa.array(texts, pa.large_string()))
        ends = np.cumsum(counts)
        return [ids[e - n : e].tobytes() for n, e in zip(counts.tolist(), ends.tolist())]

    def _ids_of_chunks(self, distinct: list[str]) -> list[bytes]:
        """Ids of distinct chunks, in their order."""
        known, kept = self._chunk_ids, self._word_ids
        out = list(map(known.get, distinct))
        fresh = [k for k, ids in enumerate(out) if ids is None]
        pieces = [self.pieces(distinct[k]) for k in fresh]
        words = {w for ws in pieces for w in ws if w.__class__ is bytes}
        new = words.difference(kept)
        ids_of = self.traverse(new)
        kept.update(itertools.islice(ids_of.items(), max(0, self.cached_words - len(kept))))
        if len(new) < len(words):
            ids_of.update((w, kept[w]) for w in words.difference(new))
        for k, ws in zip(fresh, pieces):
            out[k] = ids_of[ws[0]] if len(ws) == 1 and ws[0].__class__ is bytes else b"".join([ids_of[w] if w.__class__ is bytes else self.packed[w] for w in ws])
        room = max(0, self.cached_chunks - len(known))
        known.update((distinct[k], out[k]) for k in fresh[:room])
        if len(self._fits) > 300_000:
            self._fits.clear()
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's text of ids where the file names no decoder: pieces joined by a space."""
        try:
            return " ".join(map(self.table.__getitem__, ids))
        except (IndexError, TypeError):  # ids outside the vocabulary have no text
            return " ".join([t for t in map(self.texts.get, ids) if t is not None])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder for each file and Python worker."""
    common.claim(_loaded.clear)
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
