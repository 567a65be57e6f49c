"""Token counts of a byte-level BPE vocabulary by two compiled finite-state transducers.

The first transducer reads classes of characters and emits the borders of pieces; each chunk of the
text becomes a map from entry state to exit state, and a parallel prefix scan over these maps gives
every chunk its true entry state. The second reads the bytes of a piece. Its states are the suffixes
of the read bytes on which a later token can start, each with the token that ends there; a transition
carries the change in the number of tokens, so a piece's count is the sum along its path. That automaton
is compiled on demand, one transition at a time, and stays with the worker process.

Null and empty texts have no tokens. Repeated rows and ids are counted row by row; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratelake.llm.arrow_text import slices

# Classes of characters. LETTER to LOW_L are letters; those with a name of their own matter in contractions.
LETTER, LOW_STMD, LOW_R, LOW_V, LOW_L, LOW_E, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK, END = range(12)
# States of the border transducer.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, MORE_SPACE, ONE_BLANK, MORE_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CLOSED = range(13)
#: What a transition emits: a border before the character just read, before the one ahead of it, or both.
HERE, BACK = 1, 2
N_STATES, CHUNK = 13, 512
SPREAD = 0x9E3779B97F4A7C15


def border_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Tables (next state, emission), indexed by class * 16 + state."""
    letters = (LETTER, LOW_STMD, LOW_R, LOW_V, LOW_L, LOW_E)
    opens = {c: IN_LETTERS for c in letters} | {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: START}
    joins_space = opens | {APOSTROPHE: IN_OTHERS}

    def step(state: int, c: int) -> tuple[int, int]:
        white = c in (SPACE, BLANK)
        if state == IN_LETTERS and c in letters:
            return IN_LETTERS, 0
        if state == IN_NUMBERS and c == NUMBER:
            return IN_NUMBERS, 0
        if state in (IN_OTHERS, QUOTE) and c in (OTHER, APOSTROPHE):
            return IN_OTHERS, 0
        if state in (ONE_SPACE, MORE_SPACE, ONE_BLANK, MORE_BLANK):
            if white:
                return (MORE_SPACE if c == SPACE else MORE_BLANK), 0
            if c == END or state == ONE_BLANK:
                return opens[c], HERE
            return (joins_space[c], 0 if state == ONE_SPACE else BACK) if state != MORE_BLANK else (opens[c], HERE | BACK)
        if state == QUOTE and c in (LOW_STMD, LOW_R, LOW_V, LOW_L):
            return {LOW_STMD: CLOSED, LOW_R: QUOTE_R, LOW_V: QUOTE_V, LOW_L: QUOTE_L}[c], 0
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            if c == (LOW_L if state == QUOTE_L else LOW_E):
                return CLOSED, 0
            after, out = step(IN_LETTERS, c)
            return after, out | BACK
        return opens[c], HERE

    goes, emits = np.zeros(16 * 16, np.uint8), np.zeros(16 * 16, np.uint8)
    for c in range(12):
        for s in range(N_STATES):
            goes[c * 16 + s], emits[c * 16 + s] = step(s, c)
    return goes, emits


def character_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for run in regex.findall(pattern, everything):
            classes[np.fromiter(map(ord, run), np.int64)] = c
    for c, chars in ((LOW_STMD, "stmd"), (LOW_R, "r"), (LOW_V, "v"), (LOW_L, "l"), (LOW_E, "e"), (APOSTROPHE, "'"), (SPACE, " ")):
        classes[[ord(x) for x in chars]] = c
    return classes


def borders(classes: np.ndarray, goes: np.ndarray, emits: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, in a sequence of classes that ends with END."""
    n = len(classes)
    wide = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    wide[:n] = classes
    columns = np.ascontiguousarray(wide.reshape(-1, CHUNK).T) * np.uint8(16)
    # Each chunk as a map of states, computed in lockstep.
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (columns.shape[1], N_STATES)).copy()
    for column in columns:
        maps = goes[maps + column[:, None]]
    # Parallel prefix scan: after round k a map covers the 2**k chunks that end with its own.
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], 1)
        reach *= 2
    state = np.full(len(maps), START, np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty_like(columns)
    for j, column in enumerate(columns):
        at = state + column
        state, out[j] = goes[at], emits[at]
    flat = out.T.reshape(-1)[:n]
    begins = (flat & HERE) > 0
    begins[:-1] |= (flat[1:] & BACK) > 0
    return np.flatnonzero(begins)


class PieceTransducer:
    """Counts the tokens of pieces. ``max_states`` bounds its memory: beyond it the compiled part is dropped and built anew."""

    def __init__(self, vocabulary: dict[str, int], merges: list, max_states: int = 400_000):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if all(c in byte_of for c in token)}
        self.single = [vocabulary[c] for c in sorted(byte_of, key=byte_of.get)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        made = {*self.single, *(new for _, new in self.merge.values())}
        nodes = 1
        for token in made:
            node = 0
            for b in self.bytes_of[token]:
                after = self.child.get(node << 8 | b)
                if after is None:
                    after = self.child[node << 8 | b] = nodes
                    nodes += 1
                node = after
            self.token_at[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        first = ((0, -1, 0),)
        self.ids, self.states = {first: 0}, [first]
        self._room(1 << 16)

    def _room(self, size: int) -> None:
        """A hash table with open addressing from state * 256 + byte to next state * 256 + change + 128."""
        self.keys, self.values, self.shift, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.uint64(65 - size.bit_length()), 0

    def _put(self, key: int, value: int) -> None:
        if 2 * self.filled > len(self.keys):
            keys, values = self.keys, self.values
            self._room(2 * len(keys))
            for i in np.flatnonzero(keys >= 0).tolist():
                self._put(int(keys[i]), int(values[i]))
        slot = (key * SPREAD & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (len(self.keys) - 1)
        self.keys[slot], self.values[slot] = key, value
        self.filled += 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of these keys, -1 where not compiled yet."""
        slot = ((keys.view(np.uint64) * np.uint64(SPREAD)) >> self.shift).view(np.int64)
        out, there = self.values[slot], self.keys[slot]
        rest = np.flatnonzero(there != keys)
        while len(rest):
            absent = there[rest] < 0
            out[rest[absent]] = -1
            rest = rest[~absent]
            slot[rest] = (slot[rest] + 1) & (len(self.keys) - 1)
            there[rest], out[rest] = self.keys[slot[rest]], self.values[slot[rest]]
            rest = rest[there[rest] != keys[rest]]
        return out

    def _merged(self, data: bytes) -> list[int]:
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            best = min((self.merge.get(p, (1 << 30, 0)) + (i,) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            parts[best[2] : best[2] + 2] = [best[1]]
        return parts

    def _follows(self, last: int, token: int) -> bool:
        """Whether the merges leave these two tokens apart, so that they can be neighbours."""
        if last < 0:
            return True
        found = self.fits.get((last, token))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[last, token] = self._merged(self.bytes_of[last] + self.bytes_of[token]) == [last, token]
        return found

    def _compile(self, at: int) -> int:
        """Fill one transition: of the tokens that end with this byte, exactly one fits what stands before it."""
        state, b = divmod(at, 256)
        deeper, last, change = [], -1, 0
        for node, before, relative in self.states[state]:
            after = self.child.get(node << 8 | b)
            if after is not None:
                deeper.append((after, before, relative))
                token = self.token_at.get(after)
                if token is not None and last < 0 and self._follows(before, token):
                    last, change = token, relative + 1
        key = (*((n, t, r - change) for n, t, r in deeper), (0, last, 0))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
        self._put(at, to << 8 | change + 128)
        return to << 8 | change + 128

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if len(self.states) > self.max_states:
            self._reset()
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for j, m in enumerate(alive.tolist()):
            if m < 4:
                break
            where = state[:m] * 256 + data[at[:m] + j]
            found = self._find(where)
            if found.min() < 0:
                absent = np.flatnonzero(found < 0)
                new, which = np.unique(where[absent], return_inverse=True)
                found[absent] = np.array([self._compile(x) for x in new.tolist()])[which]
            total[:m] += (found & 255) - 128
            state[:m] = found >> 8
        else:
            j, m = 0, 0
        for i in range(m):  # the few longest pieces, one by one
            s, n = int(state[i]), int(total[i])
            for b in data[at[i] + j : at[i] + size[i]].tolist():
                found = int(self._find(np.array([s * 256 + b]))[0])
                found = found if found >= 0 else self._compile(s * 256 + b)
                s, n = found >> 8, n + (found & 255) - 128
            total[i] = n
        out = np.empty(len(at), np.int64)
        out[order] = total
        return out


class Counter:
    """Both transducers of one vocabulary file, with the special strings that the file adds."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        self.pieces = PieceTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.classes, (self.goes, self.emits) = character_classes(), border_transducer()

    def _symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and first byte of each character."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = data[lead].astype(np.int32)
        wide = np.flatnonzero(point >= 0x80)
        if len(wide):
            at = lead[wide]
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            a, b, c, d = (padded[at + k] for k in range(4))
            b, c, d = b & 0x3F, c & 0x3F, d & 0x3F
            point[wide] = np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0x0F) << 12 | b << 6 | c, (a & 0x07) << 18 | b << 12 | c << 6 | d))
        return self.classes[np.minimum(point, 0x10FFFF)], lead

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; text i is data[offsets[i]:offsets[i+1]]."""
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return counts
        classes, lead = self._symbols(data)
        raw = data.tobytes()
        for special in self.special:
            at = raw.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(special) <= offsets[row + 1]:
                    counts[row] += 1
                    classes[np.searchsorted(lead, at) : np.searchsorted(lead, at + len(special))] = END
                    at = raw.find(special, at + len(special))
                else:
                    at = raw.find(special, at + 1)
        ends = np.searchsorted(lead, offsets[1:])
        classes, first = np.insert(classes, ends, END), np.insert(lead, ends, offsets[1:])
        begins = borders(classes, self.goes, self.emits)
        starts, stops = first[begins], np.append(first[begins[1:]], len(data))
        real = classes[begins] != END
        starts, stops = starts[real], stops[real]
        rows = np.searchsorted(offsets, starts, "right") - 1
        return counts + np.bincount(rows, self.pieces.counts(data, starts, stops - starts), len(counts)).astype(np.int64)


_counters: dict[int, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_file: str, max_tokens: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > max_tokens) of every text.

    ``tokenizer_file`` is read on the driver and its text, of that file's fixed size, sent to the tasks once.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hash(definition.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(definition.value)
        for part, data, offsets in slices(batches):
            tokens = _counters[key].count(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)
