"""Exact tokenisation with the tokenizers library, spending its time on distinct pieces only.

Byte-level vocabularies: the text is cut into the vocabulary's own pre-tokens and each distinct
one goes through the library's model once. Texts that hold a special string, and vocabularies
with other pre-tokenisers, go through the whole library: there a text is cut only at a single
space between two visible characters, and the lower-case vocabulary's plain ASCII pieces go by
their words. The caches of a Python worker are bounded by CACHE entries of LONG characters each.

Arrow arrays of texts are cut at once by the kinds of their bytes, and a distinct pre-token of an
array is looked up once. What was looked up is kept in two generations: a full one becomes the
older, out of which pre-tokens come back as they are met again.
"""

from __future__ import annotations

import codecs
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

assert array("I").itemsize == 4 and sys.byteorder == "little"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE = 900_000
LONG = 48
SLICE = 4_000_000
_UNSAFE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where Python's own classes agree with the pattern's \p{L}, \p{N} and \s.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_loaded: dict[str, "PieceEncoder"] = {}
#: Kinds of characters in the byte-level pattern; 0: not looked at so far.
_LETTER, _NUMBER, _WHITE, _OTHER = 1, 2, 3, 4


def pieces(text: str) -> list[str]:
    """The text cut before single inner spaces; "".join gives the text back."""
    if not text:
        return []
    if _doubled(text) or text[0].isspace() or text[-1].isspace():
        parts = _CUT.split(text)
    else:
        parts = text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]]


def _doubled(text: str) -> bool:
    """Whether a space may stand beside other white space."""
    if not text.isascii():
        return bool(_UNSAFE.search(text))
    return "  " in text or " \n" in text or "\n " in text or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


#: The lower-case vocabulary's own pattern, and what it is on ASCII text without apostrophes.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ODD_ASCII = re.compile(r"[\x00-\x08\x0b-\x1f\x7f']")
_ASCII = re.compile(r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def _is_lower_case_words(spec: dict) -> bool:
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return kinds == ["NFC", "Replace", "Lowercase"] and bool(cuts) and cuts[0].get("pattern", {}).get("Regex") == _WORDS


class _Learned(dict):
    """Piece -> ids; a piece not met before is encoded on the way. Long pieces are not kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= LONG:
            self[piece] = ids
        return ids


class PieceEncoder:
    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.lower = _is_lower_case_words(spec)
        self.cache = _Learned(self._model if self.plain else self._lower if self.lower else self._whole)
        self.words = _Learned(lambda word: array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes())
        if self.plain:
            import public_tokenizers
            import regex

            self.pattern = regex.compile(public_tokenizers.PATTERN)
            self.kind = [(regex.compile(p), k) for p, k in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _WHITE))]
            self.kinds = np.zeros(0x110000, np.uint8)
            self.ascii = np.append(self._kinds(np.arange(128)), np.zeros(128, np.uint8))
            self.alphabet = "".join(chr(self.letters[b]) for b in range(256))
            self.known: dict[bytes, bytes] = {}
            self.older: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, piece: str) -> bytes:
        """One pre-token through the library's model, in the byte-level alphabet."""
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalpha():
            seen = chr(self.letters[32]) + word if piece[0] == " " else piece
        else:
            seen = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def _lower(self, piece: str) -> bytes:
        """A piece for the lower-case vocabulary: plain ASCII ones by their words, through the library's model."""
        if not piece.isascii() or _ODD_ASCII.search(piece) or any(s in piece for s in self.special):
            return self._whole(piece)
        return b"".join(map(self.words.__getitem__, _ASCII.findall(piece.lower())))

    def _cuts(self, text: str) -> bytes:
        """A text by its pre-tokens (or pieces)."""
        cut = (self.pattern if _ODD.search(text) else _PRE).findall(text) if self.plain else pieces(text)
        return b"".join(map(self.cache.__getitem__, cut))

    def _text(self, text: str) -> bytes:
        return self._whole(text) if any(s in text for s in self.special) else self._cuts(text)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """The kinds of code points; each one is tried with the pattern's classes once."""
        found = self.kinds[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                self.kinds[p] = next((k for kind, k in self.kind if kind.match(chr(p))), _OTHER)
            found = self.kinds[points]
        return found

    def _starts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start in the bytes of texts that begin and end at `at`, and where white space beyond ASCII is."""
        n, kind, odd = len(data), self.ascii[data], np.zeros(0, np.int64)
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
            point = data[lead] & (0x7F >> size)
            point = point.astype(np.int64)
            for j in range(1, 4):
                k = size > j
                point[k] = point[k] << 6 | data[lead[k] + j] & 0x3F
            kinds = self._kinds(point)
            for j in range(4):
                kind[lead[size > j] + j] = kinds[size > j]
            odd = lead[kinds == _WHITE]
        starts = np.zeros(n + 4, bool)
        # a space belongs to what follows it
        starts[1:n] = (kind[1:] != kind[:-1]) & (data[:-1] != 32)
        # the last of several white characters stands apart from the others, unless it ends the text
        white = kind == _WHITE
        more = np.flatnonzero(white[:-1] & white[1:]) + 1
        if len(more):
            ends = np.zeros(n + 1, bool)
            ends[at] = True
            more = more[~ends[more + 1]]
            starts[more[~white[more + 1]]] = True
        starts[at] = True
        # 's, 't, 're, 've, 'm, 'll, 'd where an apostrophe starts
        mark = np.flatnonzero(data == 39)
        mark = mark[starts[mark]]
        if len(mark):
            end = at[np.searchsorted(at, mark, "right")]
            a, b = (np.where(mark + j < end, data[np.minimum(mark + j, n - 1)], 0) for j in (1, 2))
            two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            for k, size in ((mark[np.isin(a, list(b"stmd"))], 2), (mark[two], 3)):
                starts[k + 1] = False
                starts[k + size] = True
        return np.flatnonzero(starts[:n]), odd

    def _looked_up(self, cut: list[bytes]) -> list[bytes]:
        """The ids of distinct pre-tokens; those not met before go through the library's model."""
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {}
        found, new = list(map(self.known.get, cut)), []
        for k in [k for k, x in enumerate(found) if x is None]:
            if (x := self.older.get(cut[k])) is None:
                new.append(k)
            else:
                found[k] = self.known[cut[k]] = x
        # byte 255 is in no text, so it parts the pre-tokens while they are put in the byte-level alphabet
        seen = codecs.charmap_decode(b"\xff".join([cut[k] for k in new]), "strict", self.alphabet)[0].split(self.alphabet[255])
        tokenize = self.tokenizer.model.tokenize
        for k, piece in zip(new, seen):
            found[k] = x = array("I", [t.id for t in tokenize(piece)]).tobytes()
            if len(cut[k]) <= LONG:
                self.known[cut[k]] = x
        return found

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in a row, and where each text's ids begin and the last ones end."""
        texts = texts.cast(pa.large_binary())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not self.plain or not len(at) or at[0] == at[-1]:
            each = self.encode([t.decode() for t in texts.to_pylist()])
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([0, *[len(x) // 4 for x in each]])
        data, at = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
        starts, odd = self._starts(data, at)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        known = self._looked_up(cut.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = cut.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat((np.cumsum(size) - size)[which] - end + n, n) + np.arange(end[-1])]
        first = np.append(0, end)[np.searchsorted(starts, at)]
        whole = set((np.searchsorted(at, odd, "right") - 1).tolist())
        for s in self.special:
            whole.update(np.flatnonzero(pc.match_substring(texts, s).to_numpy(zero_copy_only=False)).tolist())
        if whole:
            each = [np.frombuffer(self._text(texts[k].as_py().decode()), "<u4") if k in whole else ids[first[k] : first[k + 1]] for k in range(len(texts))]
            return np.concatenate(each), np.cumsum([0, *map(len, each)])
        return ids, first

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        for cache in (self.cache, self.words):
            if len(cache) > CACHE:
                cache.clear()
        return [self._text(t) if self.plain else self._cuts(t) for t in texts]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch by rows that hold about `size` bytes of a column, one row at least."""
    ends, first = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)), 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield batch.slice(first, end - first)
        first = end


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
