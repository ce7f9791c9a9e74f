"""Tokenizing whole texts chunk by chunk inside Arrow functions.

A vocabulary's pre-tokenizer never joins text across certain places (``_chunks``). A block of texts is cut there by
numpy, Arrow's dictionary encoding finds its distinct chunks, and only those not seen lately go to the library. Ids and
counts equal those of the library on the whole text. Chunks of plain characters are cut further, into pre-tokens.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import held, text_blocks

_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE_BYTES = 16 << 20  # texts longer than this are cut at safe places before their chunks are listed
WINDOW = 1 << 16  # looked at together for such a place
BATCH_BYTES = 4 << 20  # encoded together; long and short texts even out
MEMO_ENTRIES = 500_000
_LEAD = 4  # bytes of a character at most

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
# First bytes of characters that are certainly no white space: printable ASCII, two-byte characters from U+00C0 on, four-byte ones.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(33, 127), *range(0xC3, 0xE0), *range(0xF0, 0xF5)]] = True
# Letters (also the bytes of U+00C0 to U+017F), digits, and others of which a run of characters is plain: no special
# token begins there, no contraction, and lower-casing or normalising changes no borders. Zero: not plain.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[33:127] = _OTHER
_PLAIN[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_PLAIN[48:58] = _DIGIT
_PLAIN[list(b"'<")] = 0
_NO_LETTERS = ((0xC3, (0x97, 0xB7)), (0xC4, (0xB0,)))  # the signs of multiplication and division; a letter that becomes two
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# One pre-token of plain characters, which the vocabulary's merges alone decide.
_ONE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])+|[0-9]+|[!-&(-/:;=-@\[-`{-~]+)")


def resolved(path: str) -> str:
    """path itself, or where this machine keeps the public vocabulary of that name."""
    if os.path.sep in path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


def kind_of(path: str) -> str:
    """'byte', 'word' or 'whole' (no safe place known: texts are encoded whole)."""
    if not path.endswith(".json"):
        return "whole"
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, norm = said.get("pre_tokenizer") or {}, said.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or []
    first = steps[0] if steps else {}
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return "whole"
    return "word" if first["pattern"].get("Regex") == _WORD_PATTERN and said["model"].get("end_of_word_suffix") == "</w>" else "whole"


def _byte_letters() -> dict[int, str]:
    """The published letters that stand for bytes in these vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _edges(n: int, offsets: np.ndarray) -> np.ndarray:
    """Whether a text begins (or the last one ends) at each place."""
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    return edge


def _between_spaces(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the lower-casing kind, whose pre-tokens hold no white space: (begins, solid), both for every byte."""
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    return begin, solid


def _before_spaces(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the byte-level kind, whose pre-tokens hold one leading space at most: a single space between two other characters begins one."""
    solid = _SOLID[data]
    first, inner = solid.copy(), (data & 0xC0) == 0x80
    for _ in range(_LEAD - 1):  # the other bytes of a character are as its first
        solid[1:] |= inner[1:] & solid[:-1]
    begin = edge[:-1].copy()
    begin[1:-1] |= (data[1:-1] == 32) & solid[:-2] & first[2:] & ~edge[2:-1]
    return begin, np.ones(len(data), bool)


_CHUNKS: dict[str, Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]] = {"word": _between_spaces, "byte": _before_spaces}


def _pre_tokens(data: np.ndarray, edge: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, bytes): the chunks, those of plain characters alone cut on into pre-tokens. bytes leaves out what lies between."""
    begin, solid = _CHUNKS[kind](data, edge)
    kinds = _PLAIN[data]
    odd = kinds == 0
    for first, seconds in _NO_LETTERS:
        at = np.flatnonzero(data[:-1] == first)
        odd[at] |= np.isin(data[at + 1], seconds)
    change = np.zeros(len(data), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    if kind == "word":
        change |= kinds == _DIGIT
    else:
        lead = begin & (data == 32)
        odd &= ~lead
        change[1:] &= ~lead[:-1]
    starts, odd = np.flatnonzero(begin), np.flatnonzero(odd & solid)
    plain = np.ones(len(starts) + 1, bool)
    plain[np.searchsorted(starts, odd, "right")] = False  # [k + 1] is chunk k
    inner = np.flatnonzero(change & solid & ~begin)
    begin[inner[plain[np.searchsorted(starts, inner, "right")]]] = True
    final = solid.copy()  # whether a byte is the last of its chunk
    final[:-1] &= begin[1:] | ~solid[1:]
    if kind == "word":
        low = _LOWER[data]
        borders = np.append(starts, len(data))
        for k in np.flatnonzero(~plain[1:]).tolist():  # a special token could come of these
            low[borders[k] : borders[k + 1]] = data[borders[k] : borders[k + 1]]
        data = low[solid]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(final) + 1 - starts, data


def _listed(values: pa.Array) -> list[bytes]:
    """A binary array without nulls as a list."""
    borders = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).tolist()
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in itertools.pairwise(borders)]


class Encoder:
    """Ids (little-endian unsigned 32-bit) or counts of whole texts by one vocabulary file."""

    def __init__(self, path: str, count_only: bool):
        path = resolved(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        self.count_only, self.kind = count_only, kind_of(path)
        self.memo: dict[bytes, int | bytes] = {}
        self.old: dict[bytes, int | bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: pieces.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.encode = lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            self.model, self.letters = library.model, _byte_letters()

    def _kept(self, ids: list[int]) -> int | bytes:
        return len(ids) if self.count_only else struct.pack(f"<{len(ids)}I", *ids)

    def _pre_token(self, chunk: bytes) -> list[int]:
        word = chunk.decode()
        word = word.lower() if self.kind == "word" else word
        return [t.id for t in self.model.tokenize(word if word.isascii() and word[0] != " " else word.encode().decode("latin-1").translate(self.letters))]

    def _known(self, chunks: list[bytes]) -> list[int | bytes]:
        """What each distinct chunk gives; when the memo is full, a new generation begins and the one before the last goes."""
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo, self.old = {}, self.memo
        got = list(map(self.memo.get, chunks))
        unknown = [i for i, x in enumerate(got) if x is None]
        ask = []
        for i in unknown:
            c = chunks[i]
            if (had := self.old.get(c)) is not None:
                self.memo[c] = had
            elif c.isalpha() or _ONE.fullmatch(c):  # ASCII letters are most of them
                self.memo[c] = self._kept(self._pre_token(c))
            else:
                ask.append(c)
        for at in range(0, len(ask), 4096):
            some = ask[at : at + 4096]
            self.memo.update(zip(some, map(self._kept, self.encode([c.decode() for c in some])), strict=True))
        for i in unknown:
            got[i] = self.memo[chunks[i]]
        return got

    def _long(self, data: np.ndarray) -> list[np.ndarray]:
        """One text, cut at safe places every PIECE_BYTES or so."""
        out, at = [], 0
        while len(data) - at > PIECE_BYTES:
            lo, cut = at + PIECE_BYTES, None
            while cut is None and lo < len(data):
                window = data[lo - _LEAD : lo + WINDOW]
                starts = np.flatnonzero(_CHUNKS[self.kind](window, _edges(len(window), np.array([0, len(window)])))[0])
                cut = next((lo - _LEAD + int(s) for s in starts if s > _LEAD), None)
                lo += WINDOW - _LEAD
            if cut is None:
                break
            out.append(data[at:cut])
            at = cut
        return [*out, data[at:]]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given as bytes and borders: how many ids each has, and all ids in a row (none, if only counting)."""
        none = np.zeros(0, np.uint32)
        if self.kind == "whole":
            got = [self._kept(i) for i in self.encode([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])]
            if self.count_only:
                return np.array(got, np.int64), none
            return np.array([len(x) // 4 for x in got], np.int64), np.frombuffer(b"".join(got), "<u4")
        if len(offsets) == 2 and len(data) > PIECE_BYTES and len(parts := self._long(data)) > 1:
            counts, ids = zip(*(self.block(p, np.array([0, len(p)])) for p in parts), strict=True)
            return sum(counts), np.concatenate(ids)
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64), none
        starts, sizes, solid = _pre_tokens(data, _edges(len(data), offsets), self.kind)
        borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(solid))]).dictionary_encode()
        which, got = coded.indices.to_numpy(), self._known(_listed(coded.dictionary))
        sizes = np.array(got, np.int64) if self.count_only else np.fromiter(map(len, got), np.int64, len(got)) // 4
        upto = np.concatenate([[0], np.cumsum(sizes[which])])
        of_text = np.searchsorted(starts, offsets)
        counts = upto[of_text[1:]] - upto[of_text[:-1]]
        if self.count_only:
            return counts, none
        table, first = np.frombuffer(b"".join(got), "<u4"), np.cumsum(sizes) - sizes
        return counts, table[np.repeat(first[which] - upto[:-1], sizes[which]) + np.arange(upto[-1])]

    def texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """block() of the array's texts, BATCH_BYTES or so at a time; null counts as empty."""
        for data, offsets in text_blocks(texts, BATCH_BYTES):
            yield self.block(data, offsets)


def encoder(path: str, count_only: bool) -> Encoder:
    """Made once in each Python worker."""
    return held((path, count_only), lambda: Encoder(path, count_only))


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """block()'s result with end_id (if any) after each text's ids."""
    if end_id is None:
        return counts, ids
    counts = counts + 1
    out = np.empty(int(counts.sum()), np.uint32)
    last = np.zeros(len(out), bool)
    last[np.cumsum(counts) - 1] = True
    out[last], out[~last] = end_id, ids
    return counts, out
