"""Byte-level BPE ids with the tokenizers library, batched by distinct piece.

The tokenizer's own pre-tokenizer cuts a text into pieces and merges never
cross a piece, so ids are a function of the piece. Here numpy finds the piece
boundaries of a whole slice of texts, Arrow deduplicates the pieces, and the
tokenizers library encodes only those pieces it has not met in this worker.
Texts with a character whose class may depend on the Unicode version go
through the library whole, so ids are the library's in every case.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from lodestone.llm.textbuf import TextSlice

VOCAB_FILE = "byte_bpe_50k.json"
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSAFE = 0, 1, 2, 3, 4

#: Byte-level vocabularies write each byte as one printable character: printable Latin-1 as itself, the rest from U+0100 on.
_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = [chr(b) for b in _BYTES] + [chr(256 + k) for k in range(256 - len(_BYTES))]
_BYTES += [b for b in range(256) if b not in set(_BYTES)]


def vocab_path(name: str = VOCAB_FILE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _classes(limit: int = 0x3000) -> np.ndarray:
    """Class of each code point below ``limit``; unsafe unless it is the same in Unicode 3.2 and now."""
    out = np.full(limit + 1, _UNSAFE, np.uint8)
    for cp in range(limit):
        new, old = unicodedata.category(chr(cp)), unicodedata.ucd_3_2_0.category(chr(cp))
        if new[0] == old[0] and new[0] not in "ZC":
            out[cp] = {"L": _LETTER, "N": _NUMBER}.get(new[0], _OTHER)
    out[:32], out[127] = _OTHER, _OTHER
    out[[9, 10, 11, 12, 13, 32]] = _SPACE
    out[28:32] = _UNSAFE
    return out


class PieceEncoder:
    """Encodes slices of texts; one per Python worker."""

    def __init__(self, path: str | None = None, max_pieces: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or vocab_path())
        self.tok.encode_special_tokens = True
        self.classes, self.max_pieces = _classes(), max_pieces
        plain = {c: b for b, c in zip(_BYTES, _BYTE_CHARS, strict=True)}
        self.vocab_size = max(self.tok.get_vocab().values(), default=-1) + 1
        self.id_bytes = np.zeros(self.vocab_size, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.id_bytes[i] = sum(c in plain for c in token) if all(c in plain for c in token) else len(token.encode())
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _joined(self, pieces: list[str], sep: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and their number by piece, from texts that the pre-tokenizer cuts at every ``sep``."""
        lens = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)) + len(sep)
        step, parts = 512, []
        for e in self.tok.encode_batch_fast([sep + sep.join(pieces[i : i + step]) for i in range(0, len(pieces), step)], add_special_tokens=False):
            parts.append(np.asarray(e.ids, np.int32))
        ids = np.concatenate(parts)
        ends = np.cumsum(self.id_bytes[ids])
        if sep:
            keep = np.ones(len(ids), bool)
            keep[np.searchsorted(ends, np.cumsum(lens) - lens, "right")] = False
        cut = np.searchsorted(ends, np.cumsum(lens), "left") + 1
        if ends[-1] != lens.sum() or (ends[cut - 1] != np.cumsum(lens)).any():
            raise ValueError("the vocabulary does not cover every byte")
        sizes = np.diff(cut, prepend=0) - len(sep)
        return (ids[keep] if sep else ids), sizes

    def _learn(self, pieces: list[str]) -> None:
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[-1].isspace()]
        white = [p for p in pieces if p.isspace()]
        plain = [p for p in pieces if not p.isspace() and (p[0] != " " or p[-1].isspace())]
        for group, sep in ((spaced, ""), (plain, "\n")):
            if group:
                self._store(group, *self._joined(group, sep))
        for p in white:
            ids = np.asarray(self.tok.encode(p, add_special_tokens=False).ids, np.int32)
            self._store([p], ids, np.array([len(ids)]))

    def _store(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.known), len(pieces)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + n > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.len[first : first + n] = sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, first + n), strict=True))

    def _boundaries(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece starts, and which rows have an unsafe character."""
        n = len(data)
        cls = self.classes[np.minimum(data, 127)]
        for lead, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
            at = np.flatnonzero((data >= lead) & (data < lead + mask + 1))
            if not len(at):
                continue
            cp = (data[at] & mask).astype(np.int64)
            for k in range(1, size):
                cp = cp << 6 | (data[at + k] & 0x3F)
            kind = self.classes[np.minimum(cp, len(self.classes) - 1)]
            for k in range(size):
                cls[at + k] = kind
        unsafe = np.zeros(len(offs) - 1, bool)
        if len(bad := np.flatnonzero(cls == _UNSAFE)):
            unsafe[np.searchsorted(offs, bad, "right") - 1] = True
        new = np.empty(n, bool)
        new[0], new[1:] = True, cls[1:] != cls[:-1]
        row_start = np.zeros(n + 1, bool)
        row_start[offs] = True
        new |= row_start[:n]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        space = cls[starts] == _SPACE
        followed = space & ~row_start[ends]
        joins = followed & (data[ends - 1] == 32)
        new[ends[joins]] = False  # the next run starts at its space
        new[ends[followed] - 1] = True
        quote = (ends - starts == 1) & (data[starts] == 39) & ~row_start[ends]
        quote[1:] &= ~joins[:-1]
        for p in starts[quote & np.append(cls[starts][1:] == _LETTER, False)]:
            two, row_end = data[p + 1 : p + 3].tobytes(), offs[np.searchsorted(offs, p, "right")]
            size = 2 if two[:1] in (b"s", b"t", b"m", b"d") else 3 if two in (b"re", b"ve", b"ll") and p + 3 <= row_end else 0
            if size:
                new[p + 1] = False
                if p + size < n:
                    new[p + size] = True
        return np.flatnonzero(new), unsafe

    def encode(self, s: TextSlice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and the id offsets of its rows."""
        data, offs = s.data, s.offs
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(s.n + 1, np.int64)
        starts, unsafe = self._boundaries(data, offs)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.max_pieces:
            self._reset()
        found = list(map(self.known.get, distinct))
        if None in found:
            self._learn([p for p, k in zip(distinct, found, strict=True) if k is None])
            found = list(map(self.known.__getitem__, distinct))
        slot = np.array(found, np.int64)[coded.indices.to_numpy()]
        sizes, at = self.len[slot], self.at[slot]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(at - (ends - sizes), sizes) + np.arange(ends[-1])]
        row = np.append(0, ends)[np.searchsorted(starts, offs)]
        if unsafe.any():
            parts, size = [], np.diff(row)
            for i in range(s.n):
                part = np.asarray(self.tok.encode(s.text(i).decode(), add_special_tokens=False).ids, np.int32) if unsafe[i] else ids[row[i] : row[i + 1]]
                size[i] = len(part)
                parts.append(part)
            ids, row = np.concatenate(parts), np.append(0, np.cumsum(size))
        return ids, row


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """This worker's encoder for a vocabulary file."""
    path = path or vocab_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
