"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers stand for a byte-level BPE tokenizer:

* the *splitter* walks character classes. Its transitions carry 1 where a
  pre-token begins. A batch of texts is cut into chunks of equal length; each
  chunk's transition function is a vector state -> state, the vectors compose
  in a parallel prefix scan, and only then every chunk runs from its own entry
  state. Long texts so split across lanes like short ones.
* the *merger* walks the bytes of a pre-token. Its state holds what later bytes
  can still change: the longest suffix that begins some token, and for each
  position in it the last token and the (relative) number of tokens up to
  there. A transition carries the change in the number of emitted tokens,
  which is negative when a byte makes earlier tokens merge. States and
  transitions are determinised on demand and kept in a bounded table.

Equal pre-tokens of a batch (equal byte by byte) run through the merger once.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from quarry.llm.common import pieces, stretches, text_buffers

#: Symbols of the splitter.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK_LAST, SPACE_LAST, BLANK_RUN = range(8)
#: States: nothing pending, in letters, in numbers, in others, one or two more characters of a
#: contraction, contraction over, a space that the next run takes in, in a run of blanks.
FREE, IN_L, IN_N, IN_O, REST1, REST2, OVER, JOIN, IN_B = range(9)
STATES, RESET = 9, 8

#: Code points with the White_Space property.
WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 256


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK_RUN (any blank) by code point.

    Letters younger than Python's own tables are asked of the library: its Unicode version decides.
    """
    asked = pre_tokenizers.ByteLevel(add_prefix_space=False)
    alike = lambda c, mark: len(asked.pre_tokenize_str(mark + c)) == 1
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for name, of, mark in (("L", LETTER, "a"), ("N", NUMBER, "1")):
        found = "".join(c for c in regex.findall(rf"\p{{{name}}}", every) if unicodedata.category(c)[0] == name or alike(c, mark))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = of
    out[WHITE] = BLANK_RUN
    return out


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, at symbol * STATES + state; symbols + RESET begin a text."""
    go, new = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), np.uint8)
    goal = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: REST1, LONG: REST2, BLANK_LAST: FREE, SPACE_LAST: JOIN, BLANK_RUN: IN_B}
    for symbol, state in goal.items():
        go[symbol] = go[symbol + RESET] = state
    for symbol, held in ((LETTER, (IN_L, JOIN)), (NUMBER, (IN_N, JOIN)), (OTHER, (IN_O, JOIN)), (BLANK_RUN, (IN_B,))):
        new[symbol, held] = 0
    for symbol in (SHORT, LONG):
        go[symbol, [IN_O, JOIN]], new[symbol, [IN_O, JOIN]] = IN_O, 0
    go[:RESET, REST2], go[:RESET, REST1] = REST1, OVER
    new[:RESET, [REST1, REST2]] = 0
    return go.ravel(), new.ravel()


def begins(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in code points laid end to end; starts: True at each text's first point."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    symbol = kind.copy()
    ends = np.r_[starts[1:], True]
    blank = kind == BLANK_RUN
    last = blank & ~ends & ~np.r_[blank[1:], True]
    symbol[last] = BLANK_LAST
    symbol[last & (points == 32)] = SPACE_LAST
    at = np.flatnonzero((points == 39) & ~ends)
    if len(at):
        one = points[at + 1]
        two = np.where(ends[at + 1], 0, points[np.minimum(at + 2, n - 1)])
        symbol[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbol[at[long]] = LONG
    symbol[starts] += RESET
    go, new = splitter()
    rows = -(-n // CHUNK)
    lanes = np.full(rows * CHUNK, RESET, np.uint8)
    lanes[:n] = symbol
    lanes = np.ascontiguousarray(lanes.reshape(rows, CHUNK).T) * np.uint8(STATES)
    # chunk maps; most soon send every state to one, so that one lane goes on for all nine
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for step in lanes[:8]:
        maps = go[step[:, None] + maps]
    met = (maps == maps[:, :1]).all(1)
    lone, rest = maps[met, 0], maps[~met]
    for step in lanes[8:]:
        lone, rest = go[step[met] + lone], go[step[~met][:, None] + rest]
    maps[met], maps[~met] = lone[:, None], rest
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy().astype(np.int64), 1)
        reach *= 2
    state = np.r_[np.uint8(FREE), maps[:-1, FREE]]
    out = np.empty((CHUNK, rows), np.uint8)
    for k, step in enumerate(lanes):
        at = step + state
        out[k] = new[at]
        state = go[at]
    return out.T.ravel()[:n].astype(bool)


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merger:
    """The transducer over a pre-token's bytes, built on demand from the merge list."""

    def __init__(self, path: str, most: int = 1_500_000):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.token = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = {i: s for s, i in self.token.items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        self.merge = {(self.token[raw(a)], self.token[raw(b)]): k for k, (a, b) in enumerate(pairs)}
        self.made = {i: (-1, i, i) for s, i in self.token.items() if len(s) == 1}  # by which merge, of what
        for (a, b), k in self.merge.items():
            self.made.setdefault(self.token[self.bytes[a] + self.bytes[b]], (k, a, b))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.opening = {s[:k] for s in self.token for k in range(1, len(s))}
        self.pair: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.most = most
        self.clear()

    def clear(self) -> None:
        start = (b"", (-1,), (0,))
        self.states, self.number, self.go, self.words = [start], {start: 0}, {}, {}

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can stand after ``left`` in a merged sequence.

        Undoes the later of the merges that made the two, again and again: no pair met on
        the border may have an earlier merge of its own. Of equal ranks the leftmost goes first.
        """
        key = left << 20 | right
        if (found := self.pair.get(key)) is None:
            if len(self.pair) > self.most:
                self.pair.clear()
            merge, made, limit, found = self.merge, self.made, 1 << 60, True
            while True:
                if merge.get((left, right), limit) < limit:
                    found = False
                    break
                (a, _, x), (b, y, _) = made[left], made[right]
                if a < 0 and b < 0:
                    break
                if a > b:
                    left, limit = x, a
                else:
                    right, limit = y, b + 1
            self.pair[key] = found
        return found

    def alone(self, token: int) -> bool:
        """Whether merging the token's own bytes gives it back."""
        if (found := self.whole.get(token)) is None:
            found = self.whole[token] = self.merged(self.bytes[token]) == [token]
        return found

    def merged(self, word: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for the bytes of one token."""
        out = [self.token[word[k : k + 1]] for k in range(len(word))]
        while len(out) > 1:
            rank, k = min((self.merge.get(p, 1 << 60), k) for k, p in enumerate(zip(out, out[1:])))
            if rank == 1 << 60:
                break
            out[k : k + 2] = [self.token[self.bytes[out[k]] + self.bytes[out[k + 1]]]]
        return out

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's goal and its change of the token count."""
        held, tokens, counts = self.states[state]
        text = held + bytes([byte])
        for k in range(len(text)):
            piece = self.token.get(text[k:])
            if piece is not None and (self.follows(tokens[k], piece) if tokens[k] >= 0 else self.alone(piece)):
                change = counts[k] + 1
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        size, opening = len(text), self.opening
        live = [k for k in range(size) if text[k:] in opening]
        keep = live[0] if live else size
        after, behind = [-2] * (size - keep) + [piece], [0] * (size - keep + 1)
        for k in live:  # elsewhere no token can begin any more
            after[k - keep], behind[k - keep] = tokens[k], counts[k] - change
        goal = (text[keep:], tuple(after), tuple(behind))
        if (to := self.number.get(goal)) is None:
            to = self.number[goal] = len(self.states)
            self.states.append(goal)
        self.go[state << 8 | byte] = (to, change)
        return to, change

    def count(self, word: bytes) -> int:
        if (n := self.words.get(word)) is not None:
            return n
        if len(self.go) > self.most:
            self.clear()
        if len(self.words) > self.most // 8:
            self.words.clear()
        state, n, go = 0, 0, self.go
        for byte in word:
            state, change = go.get(state << 8 | byte) or self.step(state, byte)
            n += change
        if len(word) <= 64:
            self.words[word] = n
        return n


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def counted(raw: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text; texts are given as UTF-8 bytes laid end to end with n + 1 offsets."""
    model = merger(path)
    texts = len(offsets) - 1
    n = np.zeros(texts, np.int64)
    if not len(raw):
        return n
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    drop = None
    whole = raw.tobytes()
    for special in model.special:
        mark, at = special.encode(), whole.find(special.encode())
        while at >= 0:
            text = np.searchsorted(offsets, at, "right") - 1
            if at + len(mark) <= offsets[text + 1]:
                drop = np.zeros(len(raw), bool) if drop is None else drop
                drop[at : at + len(mark)] = True
                first[[at, at + len(mark)]] = True
                n[text] += 1
                at += len(mark) - 1
            at = whole.find(mark, at + 1)
    lead = (raw & 0xC0) != 0x80
    points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero(lead)
    at = place[begins(points, first[:-1][place])]
    number, words = stretches(raw, np.r_[at, len(raw)])
    if drop is not None:
        at, number = at[~drop[at]], number[~drop[at]]
    used = np.zeros(len(words), bool)
    used[number] = True
    tokens = np.fromiter((model.count(w) if u else 0 for w, u in zip(words, used.tolist())), np.int64, len(words))[number]
    return n + np.bincount(np.searchsorted(offsets, at, "right") - 1, tokens, texts).astype(np.int64)


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: its id, n_bytes and n_tokens of the whole text.

    vocabulary: path of a byte-level BPE file on every executor. Its added
    tokens count as one where they stand in a text.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids stay null, repeated
    rows stay repeated, an empty table gives none, other columns are not read
    (so none can clash), and a text of any length is one row's work: memory is
    a small multiple of the longest text.
    """

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            raw, offsets = text_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counted(raw, offsets, vocabulary))], ["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_column].dataType.simpleString()
    picked = df.select(df[id_column].alias("id"), df[text].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)
