"""Whole-text tokenisation with the public tokenizer files, memoised by white-space chunk.

Byte-pair merging is the expensive step, and words repeat. A text is cut where a token can never cross
(before a single space, and before a line feed that follows no white space); the distinct chunks of a batch of
texts are looked up once, new words are merged together in one call, and the texts' ids are gathered from the
chunks' ids. Texts or chunks outside the simple cases, and texts that hold an added token, go to the library
whole, so ids always equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Chunks that one worker remembers; the memory is emptied beyond it (about 200 MB).
CACHE_CHUNKS = 1_000_000
#: Characters of text whose chunks are looked up together.
BATCH_CHARS = 8_000_000
#: Words that one call merges.
TOGETHER = 1000
#: A word of Latin-1 letters, after a line feed or not, with marks (but no apostrophe) behind it or not.
_simple = re.compile("(\\n?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]{0,8})")
_feed = re.compile(r"(?<=\S)\n")
# How the two public vocabularies cut text into pieces.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, int]:
    """Byte value -> the printable letter that byte-level vocabularies use for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class ChunkIds:
    """The ids of chunks, one after the other in ``pool``. In byte vocabularies a chunk that begins with a line
    feed stands for itself, any other for a space and itself."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.words_only = self.tokenizer.normalizer is not None
        self.pieces = regex.compile(WORD_PIECES if self.words_only else BYTE_PIECES)
        self.letters = _byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts that hold one of these go to the library whole; all do if a token is looked for in normalised text.
        self.added = [""] if any(t.normalized for t in added) else [t.content for t in added]
        vocabulary = self.tokenizer.get_vocab()
        used = set("".join(t for t in vocabulary if len(t) > 1))
        #: Merges one long string without cutting it; a letter that no merge uses keeps the words apart.
        self.bare = Tokenizer(self.model)
        self.gap = next((x for x in map(chr, self.letters.values()) if x in vocabulary and x not in used), None)
        self.gap_id = vocabulary.get(self.gap)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}  # chunk -> its number
        self.marks: dict[str, list[int]] = {}
        self.n, self.size = 0, 0
        self.pool, self.starts, self.lengths = np.zeros(1 << 16, self.dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Add chunks; the number of the first."""
        first, n, size = self.n, self.n + len(lengths), self.size + len(ids)
        if n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.starts, self.lengths))
        if size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(size, self.dtype)])
        self.pool[self.size : size] = ids
        self.lengths[first:n] = lengths
        self.starts[first:n] = self.size + np.cumsum(lengths) - lengths
        self.n, self.size = n, size
        return first

    def _put_all(self, lists: list[list[int]]) -> int:
        return self._put(np.array([i for x in lists for i in x], self.dtype), np.array([len(x) for x in lists], np.int64))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _mapped(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _merge(self, piece: str) -> list[int]:
        """Ids of one piece, as the library's pre-tokeniser would cut it."""
        return [t.id for t in self.model.tokenize(self._mapped(piece))]

    def _mark(self, mark: str) -> list[int]:
        if mark not in self.marks:
            self.marks[mark] = self._merge(mark)
        return self.marks[mark]

    def chunk(self, chunk: str) -> list[int]:
        # Case folding and character classes beyond Latin-1 are left to the library.
        if chunk and max(chunk) >= "\u0100":
            return self.whole(chunk)
        if self.words_only:
            chunk = chunk.lower()
        return [i for x in self.pieces.findall(chunk) for i in (self._merge(x) if len(x) > 1 else self._mark(x))]

    def _learn_words(self, words: list[str]) -> None:
        """Merge words, each after a space or a line feed, together."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            text = "\0".join(w[1:] if w[0] == "\n" else " " + w for w in some)
            text = self.gap.join(["", *self._mapped(text).split(chr(self.letters[0]))])
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            gaps = np.flatnonzero(ids == self.gap_id)
            lengths = np.diff(gaps, append=len(ids)) - 1
            feeds = np.array([w[0] == "\n" for w in some])
            if feeds.any():  # the gap's own place holds the line feed
                (feed,) = self._mark("\n")
                ids[gaps[feeds]] = feed
                lengths += feeds
            first = self._put(np.delete(ids, gaps[~feeds]), lengths)
            self.place.update(zip(some, range(first, first + len(some))))

    def learn(self, new: list[str]) -> None:
        """Number and remember ``new`` chunks."""
        if self.gap is None or self.words_only:
            others, marked = new, []
        else:
            bases, marked, others = set(), [], []
            for chunk in new:
                if chunk.isascii() and chunk.isalpha():
                    bases.add(chunk)
                elif len(chunk) < 64 and (m := _simple.fullmatch(chunk)):
                    base, marks = m.groups()
                    if base not in self.place:
                        bases.add(base)
                    if marks:
                        marked.append((chunk, base, self._mark(marks)))
                else:
                    others.append(chunk)
            self._learn_words(list(bases))
        lists = [self.chunk(x if self.words_only or x[:1] == "\n" else " " + x) for x in others]
        for _, base, marks in marked:
            k = self.place[base]
            start = self.starts[k]
            lists.append([*self.pool[start : start + self.lengths[k]].tolist(), *marks])
        names = others + [x[0] for x in marked]
        first = self._put_all(lists)
        self.place.update(zip(names, range(first, first + len(names))))

    def cut(self, text: str) -> str | None:
        """The text with a space before each chunk; None if it is for the library."""
        if any(x in text for x in self.added):
            return None
        if self.words_only:
            return text.replace("\n", " ")
        if "  " in text or " \n" in text:
            return None
        if "\n" in text:
            lines = text.split("\n")
            lines.pop()
            text = text.replace("\n", " \n") if all(x and not x[-1].isspace() for x in lines) else _feed.sub(" \n", text)
        return text

    def encode_all(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with ``end_id`` behind it, and the texts' bounds in them."""
        if self.n >= CACHE_CHUNKS:
            self.clear()
        cut = [self.cut(x) for x in texts]
        chunks = pc.split_pattern(pa.array(["" if x is None else x for x in cut], pa.large_string()), " ")
        bounds = chunks.offsets.to_numpy()
        coded = chunks.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.place.get, distinct)]
        if None in found:
            new = [i for i, k in enumerate(found) if k is None]
            self.learn([distinct[i] for i in new])
            for i in new:
                found[i] = self.place[distinct[i]]
        numbers = np.array(found, np.int64)[coded.indices.to_numpy()]
        # the first chunk has no space before it; a text for the library is one chunk; these are forgotten again
        n, size = self.n, self.size
        first = self._put_all([self.whole(t) if c is None else [] if self.words_only else self.chunk(c.split(" ", 1)[0]) for t, c in zip(texts, cut)])
        own = np.arange(first, first + len(texts))
        if self.words_only:
            own = np.where([c is None for c in cut], own, numbers[bounds[:-1]])
        numbers[bounds[:-1]] = own
        if end_id is not None:
            numbers = np.insert(numbers, bounds[1:], self._put_all([[end_id]]))
            bounds = bounds + np.arange(len(bounds))
        lengths = self.lengths[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[numbers] - ends[:-1], lengths) + np.arange(ends[-1])]
        self.n, self.size = n, size
        return ids, ends[bounds]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_CHARS of that column, or of single rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        low = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, low + BATCH_CHARS)) - at)
        yield batch.slice(at, n)
        at += n


_loaded: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = ChunkIds(path)
    return _loaded[path]
