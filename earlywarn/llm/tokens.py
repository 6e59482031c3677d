"""Byte-pair encoding of whole texts with a public tokenizer, chunk by chunk.

A merge never crosses a gap between two words, so a text is cut at such gaps,
every distinct chunk is encoded once, and the ids of a text are put together
from those of its chunks.  The ids equal those of encoding the whole text
(the tests compare random Unicode strings); natural text repeats its words,
which makes this several times cheaper.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from earlywarn.llm import textwords as tw

CACHE_CHUNKS = 700_000  # chunks remembered by one worker (a memory bound only)
STORE_IDS = 8_000_000  # ids remembered by one worker (a memory bound only)
LONG_WORD = 64  # longer pre-tokens (in characters) are not remembered

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Chunks of these characters only are cut into pre-tokens here, by the
# tokenizer's published pattern; any other chunk goes through its own code.
_PLAIN = re.compile(rf"[\x20-\x7e{_LETTERS}]*")
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS_LEADING = re.compile(rf"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_WORDS_BARE = re.compile(rf"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def _byte_letters() -> list[str]:
    """The public byte alphabet of byte-level vocabularies: visible Latin-1
    characters stand for themselves, the other bytes for 256, 257, ..."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


NEWLINE, SPACE = 0x0A, 0x20
_SEEN = tw.byte_set((0x21, 0x7E), (0x80, 0xFF))
_BARE_GAPS = tw.byte_set((SPACE, SPACE), (NEWLINE, NEWLINE))
_ASCII_LETTERS = tw.byte_set((0x41, 0x5A), (0x61, 0x7A))
_MARKS = tw.byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_LATIN1 = tw.byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # second bytes of the letters from U+00C0 on
# first bytes of the characters among which Unicode has white space
_DOUBTFUL2, _DOUBTFUL3 = tw.byte_set((0xC2, 0xC2)), tw.byte_set((0xE1, 0xE3))


def _leading_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks of a byte-level vocabulary, whose words carry the blank
    before them, begin: at texts, at single blanks and around single line
    feeds between two visible characters.  A character that may be Unicode
    white space is not taken for visible; the chunk is then longer."""
    at = np.flatnonzero((data == SPACE) | (data == NEWLINE))
    inner = np.ones(len(data) + 1, dtype=bool)
    inner[offsets] = False
    at = at[inner[at] & inner[at + 1]]
    after = data[np.minimum(at + 1, len(data) - 1)]
    doubtful = _DOUBTFUL2[after] | _DOUBTFUL3[after]
    before = data[at - 1] if len(at) else after
    doubtful |= (before >= 0x80) & (_DOUBTFUL2[data[at - 2]] | _DOUBTFUL3[data[at - 3]])
    at = at[_SEEN[before] & _SEEN[after] & ~doubtful]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    begins[at] = True
    begins[at[data[at] == NEWLINE] + 1] = True
    begins[_word_ends(data)] = True
    return np.flatnonzero(begins[:-1])


def _word_ends(data: np.ndarray) -> np.ndarray:
    """Where ASCII punctuation follows a Latin letter: no pre-token spans that place."""
    at = np.flatnonzero(_MARKS[data])
    at = at[at > 0]
    before = data[at - 1]
    accented = (data[at - 2] == 0xC3) & _LATIN1[before]
    return at[_ASCII_LETTERS[before] | accented]


def chunks(column: pa.Array, leading: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts as one binary column, and the first chunk of each text."""
    if not leading:  # a lower-case vocabulary that drops white space
        w = tw.split(column, _BARE_GAPS, lower=True)
        if not len(w.start):
            return w.array(), w.first
        offsets = np.append(w.start, len(w.data))[w.first]  # a text begins no later than its first word
        at = _word_ends(w.data)
        inside = np.searchsorted(w.start, at, side="right") - 1
        at = at[(inside >= 0) & (w.start[inside] < at) & (at < w.end[inside])]
        start, end = np.sort(np.concatenate([w.start, at])), np.sort(np.concatenate([w.end, at]))
        cut = tw.Words(w.data, start, end, w.doc, np.searchsorted(start, offsets))
        return cut.array(), cut.first
    data, offsets = tw.text_bytes(column)
    cuts = _leading_cuts(data, offsets) if len(data) else np.zeros(0, dtype=np.int64)
    edges = np.append(cuts, len(data)).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(data))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(edges), body]), np.searchsorted(cuts, offsets)


class ChunkEncoder:
    """Encodes texts by a tokenizer file of the ``tokenizers`` library, with
    the ids of ``encode(text, add_special_tokens=False)``.

    ``leading``: the vocabulary's words carry the blank before them.  The few
    texts that hold the string of an added token go to the library whole.
    """

    def __init__(self, path: str, leading: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tok.get_added_tokens_decoder().values()})
        self.normalizer, self.pre_tokenizer, self.model = self.tok.normalizer, self.tok.pre_tokenizer, self.tok.model
        self.leading = leading
        self.letters = _byte_letters()
        self.blank = self.letters[ord(" ")]
        self.known: dict[str, tuple[int, ...]] = {}
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.store = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.length = np.zeros(1 << 14, dtype=np.int64)

    def _word_ids(self, word: str) -> tuple[int, ...]:
        letters = self.letters
        if word.isascii():  # the blank is the only one of these characters with another spelling
            spelled = word.replace(" ", self.blank)
        else:
            spelled = "".join([letters[b] for b in word.encode()])
        ids = tuple([t.id for t in self.model.tokenize(spelled)])
        if len(word) <= LONG_WORD:
            self.known[word] = ids
        return ids

    def _chunk_ids(self, chunk: str) -> Sequence[int]:
        if (chunk.isascii() and chunk.isprintable()) or _PLAIN.fullmatch(chunk):
            known = self.known
            if not self.leading:
                chunk = chunk.lower()
            if (chunk[1:] if chunk[:1] == " " else chunk).isalpha():
                return known.get(chunk) or self._word_ids(chunk)
            words = (_WORDS_LEADING if self.leading else _WORDS_BARE).findall(chunk)
            return [i for w in words for i in known.get(w) or self._word_ids(w)]
        if self.normalizer is not None:
            chunk = self.normalizer.normalize_str(chunk)
        return [t.id for w, _ in self.pre_tokenizer.pre_tokenize_str(chunk) for t in self.model.tokenize(w)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Encode chunks that are not known yet."""
        tokenize, blank = self.model.tokenize, self.blank
        ids: list = []
        for c in chunks:
            word = c.lstrip(b" ") if self.leading else c
            if word.isalpha() and len(c) - len(word) < 2:  # ASCII letters: one pre-token
                spelled = word.decode() if len(word) == len(c) else blank + word.decode()
                ids.append([t.id for t in tokenize(spelled)])
            else:
                ids.append(self._chunk_ids(c.decode()))
        lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lens.sum()))
        n0, n1 = len(self.index), len(self.index) + len(chunks)
        while n1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(flat)] = flat
        self.length[n0:n1] = lens
        self.start[n0:n1] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.index.update(zip(chunks, range(n0, n1)))

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE_CHUNKS or self.used > STORE_IDS:
            self.clear()
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        pieces, first = chunks(column, self.leading)
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.index.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([distinct[i] for i in new])
            at[new] = [self.index[distinct[i]] for i in new]
        at = at[coded.indices.to_numpy()] if len(distinct) else at
        lens = self.length[at]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.start[at] - (ends - lens), lens) + np.arange(total)]
        edge = np.concatenate([[0], ends]).astype(np.int64)[first]
        return ids, np.diff(edge)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) of a string column in a row and the count of each
        text; null and empty texts have none."""
        column = pc.fill_null(column, "")
        odd = np.zeros(len(column), dtype=bool)
        for name in self.added:
            odd |= pc.match_substring(column, name).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(column)
        ids, counts = self._encode(pc.if_else(pa.array(odd), "", column))
        whole = [np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype=np.int32) for t in column.filter(pa.array(odd)).to_pylist()]
        edge = np.concatenate([[0], np.cumsum(counts)])
        own = iter(whole)
        parts = [next(own) if odd[i] else ids[edge[i] : edge[i + 1]] for i in range(len(column))]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` of a list of texts."""
        return self.encode_column(pa.array(texts, pa.string()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, leading: bool) -> ChunkEncoder:
    """One encoder for each worker process."""
    return ChunkEncoder(path, leading)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """(begin, end, texts) of slices of a string column of at most ``limit``
    bytes (one text at least), so that few texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    done = np.cumsum(sizes)
    begin = 0
    while begin < len(column):
        past = int(done[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(done, past + limit, side="right")))
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end
