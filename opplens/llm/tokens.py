"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers are chained.

1. The splitter reads characters (as classes) and marks where pre-tokens start; it is the pattern
   's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ as eleven states. A text is cut into equal chunks; each
   chunk is run from every state at once, which gives its state map; the maps compose by a parallel prefix scan to the state in
   which each chunk begins; a second run from there writes the marks.
2. The counter reads the bytes of a pre-token. Its state is what BPE can still depend on: the unfinished token prefixes that end
   here, with the last token before each and the tokens counted up to there. Each transition is annotated with the change in the
   number of emitted tokens, so the sum along a path is the count. States and transitions are compiled when first needed and
   then only looked up, for all pre-tokens of a block at once. Beyond `max_states` the compiled states are dropped and compiled
   anew, so memory is bounded and results are not touched.

BPE is exact here because the encoding of a prefix ends in exactly one token that is compatible with the encoding before it
(two tokens are compatible if merging their bytes gives back the two).

Null and empty texts have no tokens. Texts are never truncated. Equal texts have equal counts, repeated rows all stay, an empty table gives
no rows; added columns replace input columns of their names, all others pass through.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text

END, SP, WS, NUM, OTHER, APOS, LETTER, STMD, R, V, E, L = range(12)
#: States of the splitter: fresh, in letters, in numbers, in others, one space, one other white space, more white space that
#: ends in a space, or in another, an apostrophe that starts a token, 'r or 'v after it, 'l after it.
B_, L_, N_, O_, S1, W1, S2, W2, A_, RV_, LL_ = range(11)
STATES, SYMBOLS = 11, 12
CHUNK = 256


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state * 16 + symbol; marks: 1 a token starts here, 2 one started at the character before."""
    nxt, out = np.zeros(STATES * 16, np.uint8), np.zeros(STATES * 16, np.uint8)
    fresh = {END: B_, SP: S1, WS: W1, NUM: N_, OTHER: O_, APOS: A_} | dict.fromkeys((LETTER, STMD, R, V, E, L), L_)
    for s in range(STATES):
        for c in range(SYMBOLS):
            letter = c >= LETTER
            to, mark = fresh[c], 1
            if s == L_ and letter or s == N_ and c == NUM:
                to, mark = s, 0
            elif s == O_ and c in (OTHER, APOS):
                to, mark = O_, 0
            elif s in (S1, W1, S2, W2) and c in (SP, WS):
                to, mark = (S2 if c == SP else W2), 0
            elif s in (S1, S2) and c != END:  # the space belongs to what follows
                to, mark = (O_ if c == APOS else fresh[c]), (0 if s == S1 else 2)
            elif s == W2 and c != END:
                mark = 3
            elif s == A_:
                if c == STMD:
                    to, mark = B_, 0
                elif c in (R, V):
                    to, mark = RV_, 0
                elif c == L:
                    to, mark = LL_, 0
                elif c in (OTHER, APOS):
                    to, mark = O_, 0
            elif s == RV_ and c == E or s == LL_ and c == L:
                to, mark = B_, 0
            elif s in (RV_, LL_):  # no contraction: the letter before started a run of letters
                to, mark = (L_ if letter else fresh[c]), (2 if letter else 3)
            nxt[s * 16 + c], out[s * 16 + c] = to, mark
    return nxt, out


NEXT, MARK = _splitter()
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The splitter's symbol of each code point."""
    if not _classes:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                table[c] = LETTER
            elif kind == "N":
                table[c] = NUM
        for c in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[c] = WS
        for c, symbol in ((" ", SP), ("'", APOS), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
            table[ord(c)] = symbol
        _classes.append(table)
    return _classes[0]


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """The state map of each chunk (a row of symbols): the state it ends in for each state it may begin in."""
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], symbols.shape[1], 1)
    for j in range(symbols.shape[0]):
        state = NEXT[(state << 4) + symbols[j]]
        if len(state) > 1 and j % 4 == 3 and (state == state[:1]).all():
            state = state[:1]  # every chunk has synchronised
    return np.repeat(state, STATES, 0) if len(state) == 1 else state


def scan_maps(maps: np.ndarray, start: int) -> np.ndarray:
    """The state in which each chunk begins, by a prefix scan that composes the chunks' maps."""
    done, step = maps.copy(), 1
    while step < done.shape[1]:
        done[:, step:] = np.take_along_axis(done[:, step:], done[:, :-step].astype(np.intp), 0)
        step *= 2
    return np.concatenate([[start], done[start, :-1]]).astype(np.uint8)


def pretoken_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in a string of symbols; an END symbol is a pre-token of its own."""
    n = len(symbols)
    width = max(1, -(-n // CHUNK))
    lanes = np.zeros(width * CHUNK, np.uint8)
    lanes[:n] = symbols
    lanes = np.ascontiguousarray(lanes.reshape(width, CHUNK).T)
    state = scan_maps(chunk_maps(lanes), B_)
    marks = np.empty_like(lanes)
    for j in range(CHUNK):
        at = (state << 4) + lanes[j]
        marks[j] = MARK[at]
        state = NEXT[at]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2) > 0
    return np.flatnonzero(begins)


class Counter:
    """The compiled transducer of one vocabulary."""

    def __init__(self, path: str, max_states: int = 100_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normaliser are compiled")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        to_byte = {chr(b): b for b in printable} | {chr(next(rest)): b for b in range(256) if b not in set(printable)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]  # the two halves of each token, in merge order
        ids = {bytes([b]): b for b in range(256)}
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = (bytes(to_byte[c] for c in x) for x in (a, b))
            new = len(self.parts)
            self.pairs[ids[a], ids[b]] = new
            self.parts.append((ids[a], ids[b]))
            ids.setdefault(a + b, new)
        #: Trie of the tokens: children by node * 256 + byte, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        for word, token in ids.items():
            node = 0
            for b in word:
                at = node << 8 | b
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.token.append(-1)
                node = self.child[at]
            self.token[node] = token
        self.inner = {at >> 8 for at in self.child}
        self.fits: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.index = {self.states[0]: 0}
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.next = np.full((1024, 64), -1, np.int32)
        self.delta = np.zeros((1024, 64), np.int16)

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens.

        Both are taken apart again, the later merge first; a pair at the border that merges earlier than what was undone last
        would have been merged instead.
        """
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            a, b, bound = left, right, len(self.parts)
            while True:
                if self.pairs.get((a, b), bound) < bound:
                    known = False
                    break
                if a < 256 and b < 256:
                    known = True
                    break
                # undo the merge of higher rank; of equal ones the right one, which was made later
                if a > b:
                    bound, a = a, self.parts[a][1]
                else:
                    bound, b = b + 1, self.parts[b][0]
            self.fits[key] = known
        return known

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The state after a byte, and the change in the number of tokens."""
        last, emitted, alive = -1, 0, []
        for node, before, count in state:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            token = self.token[to]
            if token >= 0 and last < 0 and (before < 0 or self.compatible(before, token)):
                last, emitted = token, count + 1
            if to in self.inner:
                alive.append((to, before, count))
        return (*[(n, b, c - emitted) for n, b, c in alive], (0, last, 0)), emitted

    def _compile(self, at: np.ndarray, byte: np.ndarray) -> None:
        for b in np.unique(byte[self.column[byte] < 0]).tolist():
            if self.columns == self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], 1)
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], 1)
            self.column[b] = self.columns
            self.columns += 1
        wanted = np.unique(at.astype(np.int64) << 8 | byte)
        for x in wanted.tolist():
            s, b = x >> 8, x & 255
            if self.next[s, self.column[b]] >= 0:
                continue
            state, emitted = self.step(self.states[s], b)
            to = self.index.get(state)
            if to is None:
                to = self.index[state] = len(self.states)
                self.states.append(state)
                if to == len(self.next):
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                    self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
            self.next[s, self.column[b]] = to
            self.delta[s, self.column[b]] = emitted

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start:end]; all of them step together, the longest first so that the rest can stop."""
        if len(self.states) > self.max_states:
            self._reset()
        order = np.argsort(starts - ends, kind="stable")
        at, left = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        live = len(at)
        steps = int(left[0]) if live else 0
        going = np.searchsorted(-left, -np.arange(1, steps + 1), side="right")
        for j in range(steps):
            live = int(going[j])
            now, byte = state[:live], data[at[:live] + j]
            col = self.column[byte]
            to = np.where(col >= 0, self.next[now, col], -1)
            new = np.flatnonzero(to < 0)
            if len(new):
                self._compile(now[new], byte[new])
                col = self.column[byte]
                to = self.next[now, col]
            total[:live] += self.delta[now, col]
            state[:live] = to
        out = np.empty_like(total)
        out[order] = total
        return out


_counters: dict[str, Counter] = {}


def count_block(texts: list[bytes], path: str) -> np.ndarray:
    """Tokens of each text; strings of special tokens inside a text are one token each, as the library has it by default."""
    counter = _counters.get(path)
    if counter is None:
        counter = _counters[path] = Counter(path)
    pieces: list[str] = []
    owner: list[int] = []
    specials = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        text = raw.decode("utf-8", "replace")
        parts = [text]
        for s in counter.special:
            if s in text:
                parts = [q for p in parts for q in p.split(s)]
                specials[i] += text.count(s)
        pieces += parts
        owner += [i] * len(parts)
    joined = "\0".join(pieces) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbols = char_classes()[points]
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    gaps = np.cumsum(lengths + 1) - 1
    symbols[gaps] = END
    data = np.frombuffer(joined.encode(), np.uint8)
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    starts = pretoken_starts(symbols)
    ends = np.append(starts[1:], len(points))
    real = symbols[starts] != END
    starts, ends = starts[real], ends[real]
    tokens = counter.count(data, offset[starts], offset[ends])
    piece_of = np.searchsorted(gaps, starts)
    return specials + np.bincount(np.asarray(owner)[piece_of], tokens, len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; vocabulary: the path of a byte-level BPE .json, the same on all executors."""
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def work(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array(count_block(texts, vocabulary), pa.int64())]

    return map_text(docs, text_col, added, work).withColumn("over_limit", F.col("n_tokens") > limit)
