"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is what the merges make of a text exactly if each token is what they make of its own
bytes and each two neighbours are what they make of theirs: a merge across a border would already happen
with these two alone. So the merges compile to a nondeterministic transducer: its states are a token just
finished and a path in the trie of tokens; a path that ends in a token with an allowed neighbour may
finish it. The deterministic transducer's states are sets of those, made when first met. Of the paths in a
state, the tokens they share are emitted at once; what they differ in waits, for as many bytes as the
longest token has at most.

Matches of the pattern that were coded before are looked up in a bounded table of the transducer's
results. All tables are bounded and are cleared when full, which changes nothing but time.

Defined results: a null text is empty and has no token; repeated rows give repeated results; an empty
table gives an empty table; other columns are not read. Each text is one task's work, with memory in
proportion to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, per_process

STATES, MEMO, PAIRS = 400_000, 1_000_000, 1_000_000
#: Characters of a match that is kept at most, and of all that are: longer ones are coded anew each time.
KEPT, HELD = 128, 16_000_000
NEVER = 1 << 62
SHIFT, NODE, SEARCHED, HEAD = 20, (1 << 20) - 1, 64, 6


def ranks(name: str) -> dict[bytes, int]:
    with open(name, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compiled_pattern() -> re.Pattern:
    r"""The pattern '(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ for the module re.

    That module has no \p: its \w holds letters, numbers and _, and its \d only decimal numbers, so the
    other numbers are listed, by the character database.
    """
    odd = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs = []
    for c in odd:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    odd = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in runs)
    space = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    # words of Latin letters, most of all, are found first by a small class
    latin = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    return re.compile(rf" ?[{latin}]++(?!\w)| ?[^\W\d_{odd}]+|'(?:[stmd]|re|ve|ll)| ?[\d{odd}]+| ?(?:[^{space}\w{odd}]|_)+|[{space}]+(?![^{space}])|[{space}]+")


def merged(table: dict[bytes, int], piece: bytes) -> list[int]:
    """The merges by their definition: always the pair of least rank, the leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: table.get(parts[i] + parts[i + 1], 1 << 62))
        if parts[best] + parts[best + 1] not in table:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [table[p] for p in parts]


def history(table: dict[bytes, int], word: bytes) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
    """Whether the merges make one token of ``word``; before each merge and at the end: its rank, the first part, the last part."""
    parts, out = [word[i : i + 1] for i in range(len(word))], []
    while True:
        ranked = [table.get(a + b, NEVER) for a, b in pairwise(parts)]
        rank = min(ranked, default=NEVER)
        out.append((rank, parts[0], parts[-1]))
        if rank == NEVER:
            return len(parts) == 1, out
        at = ranked.index(rank)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """Bytes in, token ids out.

    A path is a number: what it has read, ``history << SHIFT | node`` of the trie. A history is the tokens
    that wait to be emitted and the last token, which stays known when it has been emitted.
    """

    def __init__(self, table: dict[bytes, int]):
        self.table, self.bytes = table, {v: k for k, v in table.items()}
        self.next: list[dict[int, int]] = [{}]  # the trie: byte to node
        self.token = [-1]  # the token that ends at a node
        for word, rank in table.items():
            node = 0
            for b in word:
                to = self.next[node].get(b)
                if to is None:
                    to = self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = rank
        self.histories: dict[int, tuple[bool, list]] = {}
        self.allowed: dict[int, bool] = {}  # by last token << SHIFT | token
        self.alive: dict[int, bool] = {}  # by last token << SHIFT | node
        self.clear()

    def clear(self) -> None:
        self.waits, self.named = [((), -1)], {((), -1): 0}  # histories
        self.paths: list[tuple[int, ...]] = []  # a state's paths, the oldest first
        self.moves: dict[int, int] = {}  # state and byte to twice the next state, odd if tokens are emitted
        self.emits: dict[int, tuple] = {}
        self.known: dict[tuple, int] = {}
        self.heads: dict[bytes, tuple[int, list[int]]] = {}  # states and emitted tokens behind the first bytes
        self.start = self._state((0,))

    def _state(self, paths: tuple) -> int:
        at = self.known.get(paths)
        if at is None:
            at = self.known[paths] = len(self.paths)
            self.paths.append(paths)
        return at

    def _named(self, history: tuple) -> int:
        at = self.named.get(history)
        if at is None:
            at = self.named[history] = len(self.waits)
            self.waits.append(history)
        return at

    def _history(self, token: int):
        out = self.histories.get(token)
        if out is None:
            out = self.histories[token] = history(self.table, self.bytes[token])
        return out

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` is what the merges make of its bytes, and no merge crosses from ``last`` into it."""
        if last < 0:
            return self._history(token)[0]
        key = last << SHIFT | token
        ok = self.allowed.get(key)
        if ok is None:
            if len(self.allowed) >= PAIRS:
                self.allowed.clear()
            ok = self.allowed[key] = self._history(token)[0] and self._apart(last, token)
        return ok

    def _apart(self, last: int, token: int) -> bool:
        left, right, table = self._history(last)[1], self._history(token)[1], self.table
        i = j = 0
        while True:
            a, _, tail = left[i]
            b, head, _ = right[j]
            across = table.get(tail + head, NEVER)
            if across < a and across <= b:  # of equal ranks, the leftmost merges first
                return False
            if a == b == NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1

    def _lives(self, last: int, node: int) -> bool:
        """Whether some token below a node may follow ``last``; not searched where many are below."""
        key = last << SHIFT | node
        ok = self.alive.get(key)
        if ok is None:
            if len(self.alive) >= PAIRS:
                self.alive.clear()
            ok, todo, seen = False, list(self.next[node].values()), 0
            while todo and not ok:
                to = todo.pop()
                token = self.token[to]
                seen += 1
                ok = seen > SEARCHED or (token >= 0 and self.fits(last, token))
                todo += self.next[to].values()
            self.alive[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        paths, done = [], None
        following, token_at, waits, alive = self.next, self.token, self.waits, self.alive
        for path in self.paths[state]:
            history, node = path >> SHIFT, path & NODE
            to = following[node].get(byte)
            if to is None:
                continue
            wait, last = waits[history]
            if following[to]:
                ok = alive.get(last << SHIFT | to)
                if self._lives(last, to) if ok is None else ok:
                    paths.append(history << SHIFT | to)
            token = token_at[to]
            # a text has one coding, so at most one path may finish a token here
            if token >= 0 and done is None and self.fits(last, token):
                done = (*wait, token), token
        if done:
            paths.append(self._named(done) << SHIFT)
        first, shared = waits[paths[0] >> SHIFT][0], 0
        if first:
            all_waits = [waits[p >> SHIFT][0] for p in paths]
            while shared < len(first) and all(len(w) > shared and w[shared] == first[shared] for w in all_waits):
                shared += 1
            if shared:
                paths = [self._named((w[shared:], waits[p >> SHIFT][1])) << SHIFT | p & NODE for w, p in zip(all_waits, paths)]
        to = self._state(tuple(paths)) << 1
        key = state << 8 | byte
        if shared:
            self.emits[key] = first[:shared]
            to += 1
        self.moves[key] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern; a match that is a token itself is that token."""
        whole = self.table.get(piece)
        if whole is not None:
            return [whole]
        if len(self.paths) > STATES:
            self.clear()
        head = self.heads.get(piece[:HEAD])
        if head is None:
            state, out = self._run(self.start, piece[:HEAD])
            if len(self.heads) >= PAIRS:
                self.heads.clear()
            self.heads[piece[:HEAD]] = state, out
        else:
            state, out = head
        if len(piece) > HEAD:
            state, more = self._run(state, piece[HEAD:])
            out = out + more
        path = self.paths[state][-1]
        if path & NODE == 0:
            return [*out, *self.waits[path >> SHIFT][0]]
        raise ValueError("a byte is not in the vocabulary")

    def _run(self, state: int, part: bytes) -> tuple[int, list[int]]:
        move, emits, out = self.moves.get, self.emits, []
        for b in part:
            key = state << 8 | b
            to = move(key)
            if to is None:
                to = self._move(state, b)
                if len(self.paths) > 2 * STATES:  # a long match made them: go on from this state alone
                    if to & 1:
                        out += emits[key]
                    held = [(self.waits[p >> SHIFT], p & NODE) for p in self.paths[to >> 1]]
                    self.clear()
                    move, emits = self.moves.get, self.emits
                    to = self._state(tuple(self._named(h) << SHIFT | n for h, n in held)) << 1
            if to & 1:
                out += emits[key]
            state = to >> 1
        return state, out


class Encoder:
    def __init__(self, table: dict[bytes, int]):
        self.transducer, self.split, self.memo, self.held = Transducer(table), compiled_pattern().findall, {}, 0

    def encode(self, text: str) -> list[int]:
        memo, pieces = self.memo, self.split(text)
        found = list(map(memo.get, pieces))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    piece = pieces[i]
                    ids = memo.get(piece)
                    if ids is None:
                        ids = tuple(self.transducer.encode(piece.encode()))
                        if len(piece) <= KEPT:
                            if len(memo) >= MEMO or self.held >= HELD:
                                memo.clear()
                                self.held = 0
                            memo[piece] = ids
                            self.held += len(piece)
                    found[i] = ids
        return list(chain.from_iterable(found))


def _utf8_moves() -> list[list[int]]:
    """The machine of well-formed UTF-8, made from its ranges. State 0 is between characters, -1 is none."""
    moves = [[-1] * 256 for _ in range(8)]

    def put(state, lo, hi, to):
        for b in range(lo, hi + 1):
            moves[state][b] = to

    tail1, tail2, tail3, after_e0, after_ed, after_f0, after_f4 = range(1, 8)
    for lo, hi, to in ((0, 0x7F, 0), (0xC2, 0xDF, tail1), (0xE1, 0xEC, tail2), (0xEE, 0xEF, tail2), (0xE0, 0xE0, after_e0), (0xED, 0xED, after_ed), (0xF1, 0xF3, tail3), (0xF0, 0xF0, after_f0), (0xF4, 0xF4, after_f4)):
        put(0, lo, hi, to)
    put(tail1, 0x80, 0xBF, 0)
    put(tail2, 0x80, 0xBF, tail1)
    put(tail3, 0x80, 0xBF, tail2)
    put(after_e0, 0xA0, 0xBF, tail1)
    put(after_ed, 0x80, 0x9F, tail1)
    put(after_f0, 0x90, 0xBF, tail2)
    put(after_f4, 0x80, 0x8F, tail2)
    return moves


UTF8 = _utf8_moves()


class Decoder:
    """Ids in, whole characters out: the machine's state is carried from piece to piece."""

    def __init__(self, table: dict[bytes, int]):
        self.bytes = [b""] * (max(table.values()) + 1)
        for word, rank in table.items():
            self.bytes[rank] = word
        self.moves: list[dict[int, int]] = [{} for _ in UTF8]  # of whole tokens, made when first met

    def _step(self, state: int, token: int) -> int:
        at = state
        for b in self.bytes[token]:
            at = UTF8[at][b]
            if at < 0:
                raise ValueError("the ids are not those of a text")
        self.moves[state][token] = at
        return at

    def stream(self, ids: Iterable[int], piece: int = 8192) -> Iterator[bytes]:
        """Bytes that end between characters, of about ``piece`` tokens each."""
        state, held, words, moves = 0, [], self.bytes, self.moves
        for token in ids:
            to = moves[state].get(token)
            state = self._step(state, token) if to is None else to
            held.append(words[token])
            if state == 0 and len(held) >= piece:
                yield b"".join(held)
                held = []
        if state:
            raise ValueError("the ids end inside a character")
        if held:
            yield b"".join(held)


def coded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for. ``tokenizer``: a rank file."""

    def start():
        def make():
            table = ranks(tokenizer)
            return Encoder(table), Decoder(table)

        encoder, decoder = per_process(("bpe", tokenizer), make)

        def step(docs, texts):
            rows = []
            for i, t in zip(docs, texts):
                ids = encoder.encode(t or "")
                digest = hashlib.sha256()
                for part in decoder.stream(ids):
                    digest.update(part)
                rows.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), digest.hexdigest(), *([ids] if with_ids else [])))
            return list(zip(*rows))

        return step

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(df, [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")], start, schema)
