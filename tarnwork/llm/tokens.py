"""Exact, cached text-to-id encoding with the ``tokenizers`` library, vectorised and bounded in memory.

Whole texts are cut at places where the tokenizer's own pre-tokenizer must cut too (before a run of
ASCII blanks), so that ids(text) = ids(piece 1) + ids(piece 2) + ...  A batch's pieces become an Arrow
dictionary, and their ids are gathered by numpy; each distinct piece is encoded once per worker and
remembered.
Texts for which the cutting argument has not been made - those with white space other than the ASCII
blanks, with control characters that libraries class differently, or with what may be an added token of
the vocabulary (added tokens are matched in whole texts) - go through the tokenizer whole.

Cases: a null text has no ids, like an empty one; very long texts are cut like others and make a batch
of their own; nothing but the text is read, so ids, ties and repeated rows play no part.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import buffers, chunks

# The published pre-tokenizer patterns of the two vocabularies, and the blanks and controls
# beyond ASCII white space at which a text is not cut.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD = r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

_PLAIN = re.compile("[ \\t\\n\\r!-~¡-¬®-ɏ]*").fullmatch
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of a piece that is remembered; bytes of a text looked at together.
KEPT, CHUNK = 100, 4 << 20


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's visible stand-in for each byte, as a str.translate table over Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return table


class Words(dict):
    """ids of words that the pre-tokenizer leaves in one piece; starts anew beyond ``limit`` words."""

    def __init__(self, model, limit: int):
        super().__init__()
        self.tokenize, self.limit, self.letters = model.tokenize, limit, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        spelled = word
        if not (word.isascii() and word.isalpha()):
            spelled = word.encode().decode("latin-1").translate(self.letters)
        out = self[word] = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        return out


class PieceEncoder:
    """Encodes batches of texts; remembers two generations of ``limit`` pieces."""

    def __init__(self, path: str, limit: int = 320_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        with open(path) as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        self.kind = "whole"
        if norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.kind, pattern = "byte", BYTE_PATTERN
        elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence":
            if pre["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}:
                self.kind, pattern = "word", WORD_PATTERN
        # what an added token begins with marks a text; letters could be normalised into it
        marks = {t["content"][:2] for t in spec.get("added_tokens") or []}
        if any(len(m) < 2 or not m.isascii() or any(c.isalnum() or c.isspace() for c in m) for m in marks):
            self.kind = "whole"
        self.odd = "|".join([ODD, *map(re.escape, sorted(marks))])
        if self.kind != "whole":
            self.cut = regex.compile(pattern).findall
            self.words = Words(self.tokenizer.model, limit)

    def _ids(self, piece: bytes) -> bytes:
        if self.kind == "word":
            piece = piece.strip()
        if (piece[1:] if piece[:1] == b" " else piece).isalpha():  # one word of ASCII letters
            return self.words[piece.lower().decode() if self.kind == "word" else piece.decode()]
        text = piece.decode()
        if not _PLAIN(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        low = text.lower() if self.kind == "word" else text
        if (low[1:] if low[:1] == " " else low).isalpha():
            return self.words[low]
        return b"".join([self.words[w] for w in self.cut(low)])

    def whole(self, text: str) -> np.ndarray:
        """ids of a text by the tokenizer alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _remembered(self, pieces: list[bytes]) -> list[bytes]:
        """ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        for i, f in enumerate(found):
            if f is None:
                piece = pieces[i]
                f = self.older.get(piece)
                if f is None:
                    f = self._ids(piece)
                found[i] = f
                if len(piece) <= KEPT:
                    if len(self.known) >= self.limit:  # the younger generation is full: it becomes the older one
                        self.known, self.older = {}, self.known
                    self.known[piece] = f
        return found

    def _chunk(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the rows [at[i], at[i+1]) of the bytes, and the rows' offsets in them."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        # a piece is a run of blanks and the word behind it; rows begin pieces
        blank = _BLANK[raw]
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(first)
        rows = np.searchsorted(starts, at, "left")
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        which, found = pieces.indices.to_numpy(), self._remembered(pieces.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        count = np.array([len(f) for f in found], np.int64) // 4
        begin, n = (np.cumsum(count) - count)[which], count[which]
        done = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(begin - done[:-1], n) + np.arange(int(done[-1]))], done[rows]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of the rows in ids) for one run of rows after another."""
        data, offsets = buffers(column)
        odd = np.zeros(len(column), bool)
        if self.kind == "whole":
            odd[:] = True
        elif len(column):
            odd = pc.fill_null(pc.match_substring_regex(column, self.odd), False).to_numpy(zero_copy_only=False)
        for a, b in chunks(offsets, CHUNK):
            part = odd[a:b]
            if not part.any():
                yield (a, *self._chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                continue
            out = []
            for x in range(a, b):
                raw = data[offsets[x] : offsets[x + 1]]
                out.append(self.whole(raw.tobytes().decode()) if odd[x] else self._chunk(raw, np.array([0, len(raw)]))[0])
            yield a, np.concatenate(out), np.concatenate([[0], np.cumsum([len(o) for o in out])])

    def encode_ended(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As ``encode``, with ``end_id`` after each row's ids."""
        for a, ids, at in self.encode(column):
            yield a, np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
