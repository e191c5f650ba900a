"""Token ids of whole texts, with a tokenizer file of the tokenizers library (byte-level BPE).

A text is cut at single blanks and line ends between characters that aren't white space, and where an ASCII letter or digit (or
an accented letter of Latin-1) meets ASCII of another kind; a byte-level BPE never merges over such a place, so the pieces' ids put together are the text's ids. Places are
found in the bytes of a whole column, where a blank beside a character that might be white space beyond ASCII counts as none. Arrow numbers the distinct pieces of some texts at a time;
each worker keeps the ids of those it has met, asks the library for new ones only, and the ids of all pieces are then gathered
by offsets. When it has ``CACHE`` pieces it starts afresh, and looks through those of before once more.

A text longer than ``CHUNK`` bytes is worked through some bytes at a time, so memory follows its ids and not its pieces.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from itertools import compress, islice, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from weftline.llm import words as W

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CACHE = 200_000
CHUNK = 1 << 21
#: Longer pieces are not kept.
KEPT_BYTES = 64

#: Fixed value: the public pattern that splits a text before the merges.
_PIECES = regex.compile(public_tokenizers.PATTERN)

#: ASCII that isn't white space to a Unicode pattern, and the first bytes in UTF-8 of all white space beyond ASCII.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x80] = True
_PERHAPS = np.zeros(256, bool)
_PERHAPS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Kinds of ASCII: 1 letters, 2 digits, 4 the rest that isn't white space; 0 anything else.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 4
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
#: A letter or digit before another kind ends a match of the pattern; a sign before a digit too, before a letter it may not ("'s").
_ENDS = np.zeros(64, bool)
_ENDS[[1 << 3 | 2, 1 << 3 | 4, 2 << 3 | 1, 2 << 3 | 4, 4 << 3 | 2]] = True


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def _places(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut, ascending."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, behind = data[at - 1], data[at + 1]
    good = _PLAIN[before] & _PLAIN[behind]
    wide = np.flatnonzero(~good & (_PLAIN[before] | (before >= 0x80)) & (_PLAIN[behind] | (behind >= 0x80)))
    if len(wide):
        p = at[wide]
        odd = _PERHAPS[data[p + 1]] | ((data[p - 1] >= 0x80) & (_PERHAPS[data[np.maximum(p - 2, 0)]] | _PERHAPS[data[np.maximum(p - 3, 0)]]))
        good[wide[~odd]] = True
    kind = _KIND[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1
    kind[accented[(data[accented] != 0x97) & (data[accented] != 0xB7)]] = 1
    cut = np.zeros(len(data), bool)
    cut[at[good]] = True
    cut[1:] |= _ENDS[kind[:-1] << 3 | kind[1:]]
    line = np.flatnonzero(data == 0x0A)
    line = line[(line > 0) & (line < len(data) - 1)]
    line = line[_PLAIN[data[line - 1]] & _PLAIN[data[line + 1]]]
    cut[line] = cut[line + 1] = True
    return np.flatnonzero(cut)


class Encoder:
    """``encode_column(column)`` for whole columns, ``encode(text)`` for one text: ids as unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers.models import BPE

        self.path = path
        with open(path) as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.model = BPE(spec["model"]["vocab"], merges, cache_capacity=0)  # pieces that come again are kept here
        self.shown = "".join(_byte_characters())
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(len(spec["model"]["vocab"]) + len(self.special))]
        self.whole = None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _by_library(self, piece: bytes) -> bytes:
        """A piece with a special token's name in it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _shown(self, raw: bytes) -> str:
        return codecs.charmap_decode(raw, "strict", self.shown)[0]

    def _odd(self, piece: bytes) -> bytes:
        """A piece with more than ASCII letters behind its blank."""
        text, id_bytes, tokenize = piece.decode(), self.id_bytes, self.model.tokenize
        if (text[1:] if text[:1] == " " else text).isalpha():
            return b"".join([id_bytes[t.id] for t in tokenize(self._shown(piece))])
        if any(s in piece for s in self.special):
            return self._by_library(piece)
        return b"".join([id_bytes[t.id] for w in _PIECES.findall(text) for t in tokenize(self._shown(w.encode()))])

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces not met before. Those of ASCII letters are one match of the pattern each, and mapped together."""
        id_bytes, tokenize = self.id_bytes, self.model.tokenize
        plain = [(p[1:] if p[:1] == b" " else p).isalpha() for p in pieces]
        words = self._shown(b"\n".join(compress(pieces, plain))).split(self.shown[10])
        ids = iter([b"".join([id_bytes[t.id] for t in tokenize(w)]) for w in words])
        return [next(ids) if x else self._odd(p) for p, x in zip(pieces, plain)]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces that aren't in ``known``; they are then, unless long."""
        found = list(map(self.before.get, pieces))
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self._new([pieces[k] for k in new])):
            found[k] = x
        short = [len(p) <= KEPT_BYTES for p in pieces]
        kept, left = zip(compress(pieces, short), compress(found, short)), sum(short)
        while left > 0:
            if len(self.known) >= CACHE:
                self.before, self.known = self.known, {}
            room = CACHE - len(self.known)
            self.known.update(islice(kept, room))
            left -= room
        return found

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Places to cut, none within a special token's name."""
        cuts = _places(data)
        raw = data.tobytes()
        for s in self.special:
            found = np.array([m.start() for m in re.finditer(re.escape(s), raw)], np.int64)
            if len(found):
                ahead = found[np.maximum(np.searchsorted(found, cuts, "left") - 1, 0)]
                cuts = cuts[(cuts <= ahead) | (cuts >= ahead + len(s))]
        return cuts

    def _encoded(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between ``cuts`` (from 0 to the end of the data), and where each piece's begin."""
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        raw, ends = W.utf8(pieces.dictionary)
        raw, ends = raw.tobytes(), ends.tolist()
        distinct = [raw[x:y] for x, y in pairwise(ends)]
        found = list(map(self.known.get, distinct))
        new = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(new, self._ids_of([distinct[k] for k in new])):
            found[k] = x
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        held = np.frombuffer(b"".join(found), "<u4")
        code = pieces.indices.to_numpy()
        n = size[code]
        at = np.cumsum(np.r_[0, n])
        return held[np.arange(at[-1]) + np.repeat((np.cumsum(size) - size)[code] - at[:-1], n)], at

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text, worked through up to its last place within so many bytes, more where there is none."""
        out, a, step = [], 0, CHUNK
        while a < len(data):
            block = data[a : a + step]
            cuts = self._cuts(block)
            last = a + step >= len(data)
            if not last:
                cuts = cuts[cuts < len(block) - 64]  # what follows a place decides on it, as for a special token's name
                if not len(cuts):
                    step *= 2
                    continue
                block, cuts = block[: cuts[-1]], cuts[:-1]
            out.append(self._encoded(block, np.r_[0, cuts, len(block)])[0])
            a, step = a + len(block), CHUNK
        return np.concatenate(out)

    def encode_column(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row, row behind the last, their ids with ``end_id`` behind each row's, and where each row's begin (one more for
        the end), for some rows at a time. Nulls are empty."""
        for a, b, data, starts in W.chunks(column, CHUNK):
            if len(data) > CHUNK:
                ids, at = self._long(data), np.array([0, 0])
                at[1] = len(ids)
            elif len(data):
                cuts = np.sort(np.r_[self._cuts(data), starts])
                cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
                ids, own = self._encoded(data, cuts)
                at = own[np.searchsorted(cuts, starts)]
            else:
                ids, at = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
            yield a, b, np.insert(ids, at[1:], end_id).astype("<u4", copy=False), at + np.arange(len(at))

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian bytes."""
        for _, _, ids, _ in self.encode_column(pa.array([text], pa.string()), 0):
            return ids[:-1].tobytes()
        return b""


def encoder(path: str) -> Encoder:
    """The worker's own encoder of that file. It lives on the library's module: this package travels by value to each task."""
    import tokenizers

    made = tokenizers.__dict__.setdefault("_encoders", {})
    if path not in made:
        made[path] = Encoder(path)
    return made[path]


def forget() -> None:
    """Frees what a worker keeps of its encoders: steps that need none run in the same workers."""
    import sys

    made = getattr(sys.modules.get("tokenizers"), "_encoders", None)
    if made:
        made.clear()
        W.free_memory()


def id_blobs(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each row's ids as a binary value."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
