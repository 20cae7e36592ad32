"""Token counts by a finite-state transducer that is compiled from a public vocabulary of words (BPE with word ends).

Piece by piece, byte-pair merging is a finite-state job: the last token of a prefix is the token that ends there and may
stand behind the last token of what is before it, so a state only has to hold the longest part of a token that is open
(a node of the vocabulary's trie with failure links) and, at each place where a token may still begin, the last
token and how many there are. A transition is annotated with the tokens that it emits: the change of the count, below 0
where tokens grow together; the end of a piece adds what its last byte as a word end adds. How texts are cut into
pieces (runs of letters, single numbers, runs of other marks, English endings after an apostrophe) is part of the
states. The transducer is deterministic, its alphabet bytes with the class of the character that they begin; it is
compiled where texts first need a transition, and stays in the worker's tables.

Texts of a batch stand one behind the other, cut into chunks anywhere. All chunks run in step with each other, from the
first state. A chunk's map sends the state before it to the state behind it and to its emissions. It is known at
two states: the first, and the one that the chunk before leaves. From the second, a chunk runs until it meets its first
run, mostly at the next white space: then its map is constant and takes over whatever is composed before it. So maps
compose in a prefix scan in which one step settles all chunks but those whose maps aren't constant (one piece
longer than a chunk); these are carried on from chunk to chunk.

Defined results: a null text is empty and has no tokens; rows stay as they are, with null or repeated ids;
special strings in a text are one token each, as the library has them. No rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from .common import slices
from .tokens import WORD_PIECES

#: Cells of the table that a worker keeps, 4 bytes each; it is emptied between batches beyond it.
TABLE_CELLS = 1 << 26
#: A cell is the next state, shifted by 8 bits, and the emission plus 128 (less than the bytes of the longest token).
ZERO = 128
#: Longest chunk, and bytes of text that run together.
CHUNK, BATCH_BYTES = 512, 2_000_000
#: Fewer chunks than this are carried on one by one.
FEW = 16
#: Classes of a byte: white space, first byte of a letter, a number, a mark, and any later byte.
SPACE, LETTER, NUMBER, MARK, MORE = range(5)
#: Open pieces: none, letters, a number, marks, an apostrophe that begins a piece, and r, v or l behind one.
NONE, LETTERS, ONE, MARKS, APOSTROPHE, AFTER = range(6)
BETWEEN = 0x20
_marks = re.compile("[\u0300-\U0010ffff]")


class Pieces:
    """States and counts within a piece. A state is (node, places, end): ``places`` holds (bytes back, last token, count)
    where a token may begin, counts relative to now; ``end`` is what the count changes by if the piece ends here."""

    def __init__(self, model: models.BPE, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.final = model
        self.inner = models.BPE(vocab=vocabulary, merges=merges)  # no byte of its pieces is a word end
        self.ending = "</w>"
        self.bytes_of = {i: t.removesuffix(self.ending) for t, i in vocabulary.items()}
        self.child: list[dict[str, int]] = [{}]
        self.depth, self.inside, self.at_end, self.fail = [0], [-1], [-1], [0]
        for token, i in vocabulary.items():
            node = 0
            for letter in self.bytes_of[i]:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.inside.append(-1), self.at_end.append(-1), self.fail.append(0)
                node = self.child[node][letter]
            (self.at_end if token.endswith(self.ending) else self.inside)[node] = i
        queue = deque(self.child[0].values())
        while queue:
            node = queue.popleft()
            for letter, below in self.child[node].items():
                self.fail[below] = self._goto(self.fail[node], letter)
                queue.append(below)
        self.fits: dict[tuple[int, int, bool], bool] = {}
        self.empty = (0, ((0, -1, 0),), 0)

    def _goto(self, node: int, letter: str) -> int:
        while node and letter not in self.child[node]:
            node = self.fail[node]
        return self.child[node].get(letter, 0)

    def _follows(self, before: int, token: int, ends: bool) -> bool:
        """Whether merging leaves a border between the two tokens."""
        known = self.fits.get((before, token, ends))
        if known is None:
            found = (self.final if ends else self.inner).tokenize(self.bytes_of[before] + self.bytes_of[token])
            known = self.fits[before, token, ends] = [t.id for t in found] == [before, token]
        return known

    def step(self, state: tuple, letter: str) -> tuple[tuple, int]:
        """The state after one more byte, and the change of the count."""
        node, places, _ = state
        begin = {back: (last, n) for back, last, n in places}
        node = self._goto(node, letter)
        chain = []
        while node:
            chain.append(node)
            node = self.fail[node]

        def last(tokens: list[int], ends: bool) -> tuple[int, int]:
            for node in chain:
                if (token := tokens[node]) >= 0:
                    before, n = begin[self.depth[node] - 1]
                    if before < 0 or self._follows(before, token, ends):
                        return token, n + 1
            raise ValueError("the vocabulary has no token for a byte")

        token, change = last(self.inside, False)
        _, ended = last(self.at_end, True)
        open_ = [node for node in chain if self.child[node]]
        places = [(0, token, 0)]
        for node in open_:
            before, n = begin[self.depth[node] - 1]
            places.append((self.depth[node], before, n - change))
        return (open_[0] if open_ else 0, tuple(places), ended - change), change


class Transducer:
    """A table of next states and emissions; -1 where nothing is compiled yet. State 0 has no open piece."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        steps = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
        cut = (data["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        model = data["model"]
        if model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"] or cut != WORD_PIECES:
            raise ValueError("not a lower-case vocabulary of words with word ends")
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("special strings must be looked for as they are")
        self.special = [t.content for t in added]
        self.pieces = Pieces(self.tokenizer.model, model["vocab"], [tuple(m) for m in model["merges"]])
        self.letter = self._byte_letters()
        self.nfc, self.lower = normalizers.NFC(), normalizers.Lowercase()
        # by code point, filled by blocks of 256 where texts need them
        self.lowered, self.classes = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        self.known_block = np.zeros(0x1100, bool)
        self.clear()

    def _byte_letters(self) -> list[str]:
        """The letter that stands for each byte: itself where it is a visible one of Latin-1, else the next from 256 on."""
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        rest = iter(range(256, 512))
        return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]

    def clear(self) -> None:
        self.states = [(NONE, self.pieces.empty, "")]
        self.numbers = {self.states[0]: 0}
        self.column = np.full(5 * 256, -1, np.int32)  # (class, byte) -> column of the table
        self.columns: list[tuple[int, int]] = []
        self.width = 64
        self.table = np.full((1 << 10, self.width), -1, np.int32)

    # compilation

    def _number(self, state: tuple) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return n

    def _open(self, kind: int, byte: int, emitted: int) -> tuple[tuple, int]:
        """A new piece that begins with ``byte``, after ``emitted`` tokens of the ones before."""
        state, change = self.pieces.step(self.pieces.empty, self.letter[byte])
        mode = {LETTER: LETTERS, NUMBER: ONE, MARK: APOSTROPHE if byte == 0x27 else MARKS}[kind]
        return (mode, state, ""), emitted + change

    def _step(self, state: tuple, kind: int, byte: int) -> tuple[tuple, int]:
        mode, piece, held = state
        end = piece[2]
        if mode == AFTER:
            both, n = self.pieces.step(piece, self.letter[ord(held)])
            if kind == LETTER and byte == ord({"r": "e", "v": "e", "l": "l"}[held]):
                both, more = self.pieces.step(both, self.letter[byte])
                return self.states[0], n + more + both[2]
            # the apostrophe was a piece of its own, the letter begins one
            letters, n = self._open(LETTER, ord(held), end)
            after, more = self._step(letters, kind, byte)
            return after, n + more
        if mode == APOSTROPHE and kind == LETTER and byte < 128:
            if chr(byte) in "rvl":
                return (AFTER, piece, chr(byte)), 0
            if chr(byte) in "stmd":
                both, n = self.pieces.step(piece, self.letter[byte])
                return self.states[0], n + both[2]
        if kind == SPACE:
            return self.states[0], end
        if kind == MORE or (kind, mode) == (LETTER, LETTERS) or kind == MARK and mode in (MARKS, APOSTROPHE):
            piece, n = self.pieces.step(piece, self.letter[byte])
            return (MARKS if mode == APOSTROPHE else mode, piece, ""), n
        return self._open(kind, byte, end)

    def _compile(self, state: int, column: int) -> None:
        after, n = self._step(self.states[state], *self.columns[column])
        number = self._number(after)  # the table may grow here
        if not -ZERO <= n < ZERO:
            raise ValueError("a token has too many bytes")
        self.table[state, column] = number << 8 | n + ZERO

    def _columns(self, symbols: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(np.bincount(symbols, minlength=len(self.column)))
        new = used[self.column[used] < 0]
        self.column[new] = np.arange(len(self.columns), len(self.columns) + len(new))
        self.columns += [(int(s) >> 8, int(s) & 255) for s in new]
        while self.width < len(self.columns):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
            self.width *= 2
        return self.column[symbols]

    # texts to symbols

    def _learn_blocks(self, points: np.ndarray) -> None:
        """Case and class of the code points of new blocks, as the library has them."""
        for block in np.flatnonzero(np.bincount(points >> 8)):
            if self.known_block[block]:
                continue
            self.known_block[block] = True
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for point in range(block << 8, (block + 1) << 8):
                if 0xD800 <= point < 0xE000:
                    continue
                lower = self.lower.normalize_str(chr(point))
                if len(lower) == 1:
                    self.lowered[point] = ord(lower)
                twice = len(cut(chr(point) * 2))
                self.classes[point] = SPACE if twice == 0 else NUMBER if twice == 2 else LETTER if len(cut("a" + chr(point))) == 1 else MARK

    def _plain(self, text: str) -> tuple[str, int]:
        """The text in composed form and without special strings, and how many of these it had. Characters before U+0300
        are composed."""
        n = 0
        if "<|" in text:
            for special in self.special:
                n += text.count(special)
                text = text.replace(special, " ")
        if _marks.search(text):
            text = self.nfc.normalize_str(text)
        if "İ" in text:  # the only letter whose lower case is two
            text = text.replace("İ", self.lower.normalize_str("İ"))
        return text, n

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes and bytes of all texts, white space behind each, and the number of symbols up to each text's end."""
        points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(x) + 1 for x in texts])
        self._learn_blocks(points)
        points = self.lowered[points]
        self._learn_blocks(points)
        classes = self.classes[points]
        points = np.where(classes == SPACE, np.uint32(BETWEEN), points)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        kinds = np.full(len(data), MORE, np.int32)
        after = np.cumsum(sizes)
        kinds[after - sizes] = classes
        return (kinds << 8) | data, after[ends - 1]

    # runs

    def _run(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition of each of ``states``: where it leads and what it emits."""
        places = states * np.int64(self.width) + symbols
        cells = self.table.ravel().take(places)
        if cells.min() < 0:
            for place in np.unique(places[cells < 0]).tolist():
                self._compile(*divmod(place, self.width))
            cells = self.table.ravel().take(places)
        return cells >> 8, (cells & 255) - ZERO

    def _run_one(self, state: int, symbols: np.ndarray, path: np.ndarray, emitted: np.ndarray) -> None:
        """A run over one chunk's symbols until it meets the chunk's ``path``; both arrays are overwritten up to there."""
        cells = self.table.ravel()
        for t, symbol in enumerate(symbols.tolist()):
            cell = cells.item(state * self.width + symbol)
            if cell < 0:
                self._compile(state, symbol)
                cells = self.table.ravel()
                cell = cells.item(state * self.width + symbol)
            state, emitted[t] = cell >> 8, (cell & 255) - ZERO
            if state == path[t]:
                return
            path[t] = state

    def emissions(self, symbols: np.ndarray, chunk: int) -> np.ndarray:
        """What each symbol emits, in one run from the first state over all of them."""
        columns = self._columns(symbols)
        n = -(-len(columns) // chunk)
        padded = np.concatenate([columns, np.full(n * chunk - len(columns), self._columns(np.array([BETWEEN]))[0], np.int32)])
        steps = padded.reshape(n, chunk).T.copy()
        path, emitted = np.empty((chunk, n), np.int32), np.empty((chunk, n), np.int16)
        state = np.zeros(n, np.int32)
        for t in range(chunk):
            state, emitted[t] = self._run(state, steps[t])
            path[t] = state
        entered, first_round = np.zeros(n, np.int32), True
        while True:
            # the maps of chunks at the states that the chunks before them leave; after the first round, where several
            # chunks in a row were entered with another state, the first of them goes first
            before = np.concatenate([[np.int32(0)], path[-1, :-1]])
            wrong = before != entered
            lanes = np.flatnonzero(wrong if first_round else wrong & ~np.concatenate([[False], wrong[:-1]]))
            if not len(lanes):
                return emitted.T.ravel()[: len(columns)]
            first_round = False
            entered[lanes] = state = before[lanes]
            if len(lanes) < FEW:
                for lane, s in zip(lanes.tolist(), state.tolist()):
                    self._run_one(s, steps[:, lane], path[:, lane], emitted[:, lane])
                continue
            for t in range(chunk):
                state, emitted[t, lanes] = self._run(state, steps[t, lanes])
                apart = state != path[t, lanes]
                lanes, state = lanes[apart], state[apart]
                if not len(lanes):
                    break
                path[t, lanes] = state

    def counts(self, texts: list[str], chunk: int | None = None) -> np.ndarray:
        if len(self.states) * self.width > TABLE_CELLS:
            self.clear()
        plain = [self._plain(x) for x in texts]
        if not texts:
            return np.zeros(0, np.int64)
        symbols, ends = self._symbols([x for x, _ in plain])
        emitted = self.emissions(symbols, chunk or max(32, min(CHUNK, isqrt(len(symbols)))))
        total = np.cumsum(emitted, dtype=np.int64)[ends - 1]
        return np.diff(total, prepend=0) + [n for _, n in plain]


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(path)
        for batch in batches:
            for part in slices(batch, 1, BATCH_BYTES):
                n = compiled.counts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
