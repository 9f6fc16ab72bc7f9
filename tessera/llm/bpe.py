"""Byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

Merges applied in rank order give, for any two tokens, a fixed answer to "can the second follow
the first?": it can when merging the bytes of both gives just these two tokens again. A token
sequence whose neighbours all pass this test is the one BPE result of its bytes (Berglund and van
der Merwe, "Formalizing BPE Tokenization"). This makes a nondeterministic transducer: a state is
the last token and the bytes read of the next one, and a token is emitted when its bytes are
complete. :class:`Transducer` determinises it lazily. A deterministic state holds all live
hypotheses with the tokens on which they still differ; what all agree on is emitted, so output
lags by a bounded number of bytes. Known transitions are sorted arrays, and many pieces of text walk them
side by side, a byte a step; what the arrays lack is worked out on the hypotheses and kept. Full tables are
emptied, so memory doesn't grow with the corpus.

Texts: null counts as empty; an empty text has no tokens. Row order, repeated rows and extra columns
don't matter: only the text column is read and every input row gives one output row. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import kept_in_worker, small_batches, with_fields

#: Entries of the tables that a worker keeps; what they lack is computed, so their sizes change no result.
MAX_STATES = 200_000
MAX_PAIRS = 100_000
MAX_PIECES = 150_000
#: New transitions from which on they join the large table.
RECENT = 16_000
#: Bytes up to which a piece walks with others and is kept; longer ones are read as a stream, with memory for the lag only.
MAX_PIECE = 1 << 12
#: Pieces whose ids are written out at once.
CHUNK = 100_000
_NEVER = float("inf")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file (a vocabulary: bounded, read by the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``pool[start : start + length]``, one after the other."""
    kind = np.int32 if len(pool) < 1 << 30 and length.sum() < 1 << 30 else np.int64
    at = np.repeat((start - (np.cumsum(length) - length)).astype(kind), length)
    at += np.arange(len(at), dtype=kind)
    return pool[at]


class Transducer:
    """Bytes to token ids by lazily built deterministic states."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.head: dict[int, list[tuple[bytes, float]]] = {}
        self.tail: dict[int, list[tuple[bytes, float]]] = {}
        # A trie: (node, byte) -> node, the token that ends in a node, and whether a node has others below.
        self.child: dict[int, int] = {}
        self.token_at, self.inner = array("i", [-1]), bytearray(1)
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                below = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if below == len(self.token_at):
                    self.token_at.append(-1)
                    self.inner.append(0)
                node = below
            # A token that merging can't make (it never arises as a whole) is never emitted.
            if self._grown(token, rank):
                self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is its hypotheses, by the place where their next token begins, in packed form.
        start = self._packed([((), -1, 0)])
        self.states, self.number = [start], {start: 0}
        # Emitted runs of tokens; run 0 is empty.
        self.runs, self.run_number = [()], {(): 0}
        # Transitions, sorted by state << 8 | byte: the next state and the run emitted; and the run that ends each state.
        # New ones gather in a small table of the same form beside the large one, so that few insertions move much.
        self.large, self.recent = ((np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in range(2))
        self.ends: dict[int, int] = {}

    @staticmethod
    def _packed(live: list[tuple]) -> bytes:
        return array("i", [x for pending, last, node in live for x in (len(pending), *pending, last, node)]).tobytes()

    def hypotheses(self, state: int) -> list[tuple]:
        """(pending tokens, last token, node) of each hypothesis of a state."""
        flat, at, live = array("i", self.states[state]), 0, []
        while at < len(flat):
            end = at + 1 + flat[at]
            live.append((tuple(flat[at + 1 : end]), flat[end], flat[end + 1]))
            at = end + 2
        return live

    def _grown(self, token: bytes, rank: int) -> bool:
        """Whether merging makes the whole token of its bytes, the pair of least rank first.

        Keeps what its first and last parts were on the way, each with the rank of the merge that
        took it up (the whole token: infinity).
        """
        parts = [token[i : i + 1] for i in range(len(token))]
        head, tail = [], []
        while len(parts) > 1:
            least, best = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if least == _NEVER:
                return False
            if best == 0:
                head.append((parts[0], least))
            if best == len(parts) - 2:
                tail.append((parts[-1], least))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        self.head[rank], self.tail[rank] = [*head, (token, _NEVER)], [*tail, (token, _NEVER)]
        return True

    def follows(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two neighbouring tokens.

        Ranks of merges rise while a token grows, so each part at the border lives until its own
        merge; a crossing merge happens when its rank comes before both. Of equal ranks the left
        merge is done first.
        """
        if left < 0:
            return True
        known = self.pairs.get(left << 32 | right)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            tail, head, i, j = self.tail[left], self.head[right], 0, 0
            while True:
                (a, until_a), (b, until_b) = tail[i], head[j]
                crossing = self.ranks.get(a + b, _NEVER)
                if crossing < until_a and crossing <= until_b and crossing != _NEVER:
                    known = False
                    break
                if until_a == until_b == _NEVER:
                    known = True
                    break
                if until_a <= until_b:
                    i += 1
                else:
                    j += 1
            self.pairs[left << 32 | right] = known
        return known

    def moved(self, hypotheses: Iterable[tuple], byte: int) -> list[tuple]:
        """The hypotheses that live after one more byte; the one of whole tokens comes last."""
        live, whole = [], None
        for pending, last, node in hypotheses:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and whole is None and self.follows(last, token):
                whole = (*pending, token), token, 0
            if self.inner[node]:
                live.append((pending, last, node))
        if whole is not None:
            live.append(whole)
        return live

    @staticmethod
    def agreed(live: list[tuple]) -> int:
        """The number of first pending tokens that all hypotheses have."""
        first = live[0][0]
        n = min(len(h[0]) for h in live)
        return next((i for i in range(n) if any(h[0][i] != first[i] for h in live)), n)

    def encode(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks; ids leave as soon as they are certain."""
        live: list[tuple] = [((), -1, 0)]
        for chunk in chunks:
            for byte in chunk:
                live = self.moved(live, byte)
                certain = self.agreed(live)
                if certain:
                    yield from live[0][0][:certain]
                    live = [(pending[certain:], last, node) for pending, last, node in live]
        for pending, _, node in live:
            if node == 0:  # the one hypothesis that ends with a whole token
                yield from pending

    def _run(self, tokens: tuple[int, ...]) -> int:
        number = self.run_number.setdefault(tokens, len(self.runs))
        if number == len(self.runs):
            self.runs.append(tokens)
        return number

    def _learn(self, wanted: np.ndarray) -> None:
        """Work out transitions (sorted, none of them known)."""
        to, run = np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int32)
        state, hypotheses = -1, []
        for i, key in enumerate(wanted.tolist()):
            if key >> 8 != state:
                state = key >> 8
                hypotheses = self.hypotheses(state)
            live = self.moved(hypotheses, key & 255)
            certain = self.agreed(live)
            found = self._packed([(pending[certain:], last, node) for pending, last, node in live])
            number = self.number.setdefault(found, len(self.states))
            if number == len(self.states):
                self.states.append(found)
            to[i], run[i] = number, self._run(live[0][0][:certain])
        self.recent = self._merged(self.recent, (wanted, to, run))

    @staticmethod
    def _merged(table: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.searchsorted(table[0], more[0])
        return tuple(np.insert(old, at, new) for old, new in zip(table, more, strict=True))

    def _moves(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the run emitted for each state << 8 | byte."""
        to, run, left = np.zeros(len(asked), np.int32), np.zeros(len(asked), np.int32), np.arange(len(asked))
        for last in (False, True):
            known, states, runs = self.recent if last else self.large
            wanted = asked[left]
            at = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
            here = known[at] == wanted if len(known) else np.zeros(len(left), bool)
            if last and not here.all():
                self._learn(np.unique(wanted[~here]))
                known, states, runs = self.recent
                at, here = np.searchsorted(known, wanted), np.ones(len(left), bool)
            to[left[here]], run[left[here]] = states[at[here]], runs[at[here]]
            left = left[~here]
            if not len(left):
                break
        return to, run

    def _end(self, state: int) -> int:
        """The run of a state's hypothesis that ends with a whole token."""
        if state not in self.ends:
            self.ends[state] = self._run(next((pending for pending, _, node in self.hypotheses(state) if node == 0), ()))
        return self.ends[state]

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one piece after the other, and their number for each piece."""
        if len(self.states) > MAX_STATES:
            self._reset()
        elif len(self.recent[0]) > RECENT:
            self.large, self.recent = self._merged(self.large, self.recent), tuple(x[:0] for x in self.recent)
        length = np.array([len(p) for p in pieces], np.int64)
        data, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length
        order = np.argsort(-length, kind="stable")
        state, done = np.zeros(len(pieces), np.int64), []
        live = int((length > 0).sum())
        for step in range(int(length.max(initial=0))):
            while live and length[order[live - 1]] <= step:
                live = int(np.searchsorted(-length[order], -step, side="left"))
            now = order[:live]
            state[now], run = self._moves(state[now] << 8 | data[begin[now] + step])
            told = np.flatnonzero(run)
            done.append((now[told], run[told]))
        ends, which = np.unique(state, return_inverse=True)
        done.append((np.arange(len(pieces)), np.array([self._end(s) for s in ends.tolist()], np.int32)[which]))
        piece, run = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        by = np.argsort(piece, kind="stable")
        piece, run = piece[by], run[by]
        used, run = np.unique(run, return_inverse=True)
        tokens = [self.runs[r] for r in used.tolist()]
        n = np.array([len(t) for t in tokens], np.int64)
        pool = np.array([i for t in tokens for i in t], np.int32)
        return gathered(pool, (np.cumsum(n) - n)[run], n[run]), np.bincount(piece, n[run], minlength=len(pieces)).astype(np.int64)


class Pieces(dict):
    """Piece of text -> its number, and the ids of each number; filled by the transducer, many pieces at a time."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __missing__(self, piece: str) -> int:
        data = piece.encode()
        number = self[piece] = len(self.start) + len(self.new)
        self.new.append(data)
        return number

    def numbers(self, part: list[str]) -> np.ndarray:
        """The numbers of some pieces; new ones have ids after :meth:`fill`."""
        return np.fromiter(map(self.__getitem__, part), np.int64, len(part))

    def fill(self) -> None:
        """Encode the new pieces."""
        if not self.new:
            return
        short = [p for p in self.new if len(p) <= MAX_PIECE]
        ids, n = self.transducer.encode_all(short)
        if len(short) < len(self.new):
            cut = np.split(ids, np.cumsum(n)[:-1]) if len(short) else []
            part = iter(cut)
            every = [next(part) if len(p) <= MAX_PIECE else np.fromiter(self.transducer.encode([p]), np.int32) for p in self.new]
            ids, n = np.concatenate(every), np.array([len(x) for x in every], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.length, self.ids, self.new = np.concatenate([self.length, n]), np.concatenate([self.ids, ids]), []


#: Well-formed UTF-8 as an automaton: state -> (first byte, last byte, next state). State 0 is "whole".
UTF8 = {
    0: ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 2), (0xE1, 0xEC, 3), (0xED, 0xED, 4), (0xEE, 0xEF, 3), (0xF0, 0xF0, 5), (0xF1, 0xF3, 6), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),),
    2: ((0xA0, 0xBF, 1),),
    3: ((0x80, 0xBF, 1),),
    4: ((0x80, 0x9F, 1),),
    5: ((0x90, 0xBF, 3),),
    6: ((0x80, 0xBF, 3),),
    7: ((0x80, 0x8F, 3),),
}
_NEXT = [[next((to for low, high, to in UTF8[state] if low <= byte <= high), -1) for byte in range(256)] for state in range(8)]


class Utf8Stream:
    """Bytes in, whole characters out; at most three bytes wait. Ill-formed bytes give U+FFFD."""

    def __init__(self) -> None:
        self.state, self.held = 0, b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        # Only the last three bytes can be an unfinished character.
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            if data[cut - back] >= 0xC0:
                state = 0
                for byte in data[cut - back :]:
                    state = _NEXT[state][byte] if state >= 0 else -1
                if state > 0:
                    cut -= back
                break
        self.held, whole = data[cut:], data[:cut]
        try:
            return whole.decode("utf-8")
        except UnicodeDecodeError:
            return self._repaired(whole)

    @staticmethod
    def _repaired(data: bytes) -> str:
        out, start, state, i = [], 0, 0, 0
        while i < len(data):
            to = _NEXT[state][data[i]]
            if to < 0:
                out.append("�")
                i += state == 0  # a byte that breaks a sequence may begin the next one
                state, start = 0, i
                continue
            i, state = i + 1, to
            if state == 0:
                out.append(data[start:i].decode("utf-8"))
                start = i
        return "".join(out) + "�" * (state > 0)

    def end(self) -> str:
        left, self.held = self.held, b""
        return "�" if left else ""


def decode_stream(ids: Iterable[int], tokens: dict[int, bytes], block: int = 4096) -> Iterator[str]:
    """Text of an id sequence, in blocks of ids, so that a text of any length needs little memory."""
    stream, held = Utf8Stream(), []
    for i in ids:
        held.append(tokens[i])
        if len(held) == block:
            yield stream.feed(b"".join(held))
            held = []
    yield stream.feed(b"".join(held))
    yield stream.end()


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings one after the other, where each starts, and its length."""
    n = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(n) - n, n


@dataclass
class Part:
    """A stretch of one text: its number in the batch, its token ids, these in decimal after a blank each, and what they decode to."""

    text: int
    ids: np.ndarray
    decimals: memoryview
    decoded: memoryview


#: A text is cut into stretches of about this many characters, at the ends of pieces.
STRETCH = 1 << 20


def _stretches(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The pieces of a text: of a long one, in lists of bounded size."""
    if len(text) <= STRETCH:
        yield pattern.findall(text)
        return
    held = []
    for match in pattern.finditer(text):
        held.append(match[0])
        if len(held) == STRETCH // 4:
            yield held
            held = []
    yield held


class Worker:
    """A worker's tables: pieces with their ids, and for each token its bytes and its id in decimal after a blank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces, self.split = Pieces(Transducer(ranks)), regex.compile(pattern)
        tokens = {i: t for t, i in ranks.items()}
        self.tokens = _pool([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        self.decimals = _pool([b" %d" % i for i in range(max(tokens) + 1)])

    def parts(self, texts: list[str | None]) -> Iterator[Part]:
        """All texts in order, in stretches of bounded size; a text without tokens has none."""
        held, count = [], 0
        for i, text in enumerate(texts):
            for part in _stretches(text or "", self.split):
                if part:
                    held.append((i, self.pieces.numbers(part)))
                    count += len(part)
                if count >= CHUNK:
                    yield from self._written(held)
                    held, count = [], 0
        if held:
            yield from self._written(held)

    def _written(self, held: list[tuple[int, np.ndarray]]) -> Iterator[Part]:
        pieces = self.pieces
        pieces.fill()
        number = np.concatenate([x[1] for x in held])
        length = pieces.length[number]
        ids = gathered(pieces.ids, pieces.start[number], length)
        if len(pieces) > MAX_PIECES:
            pieces.forget()
        cut = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *(len(x[1]) for x in held)])]
        views, cuts = [], []
        for pool, start, n in (self.decimals, self.tokens):
            views.append(memoryview(gathered(pool, start[ids], n[ids])))
            cuts.append(np.concatenate([[0], np.cumsum(n[ids])])[cut].tolist())
        cut = cut.tolist()
        for j, (text, _) in enumerate(held):
            yield Part(text, ids[cut[j] : cut[j + 1]], *(view[c[j] : c[j + 1]] for view, c in zip(views, cuts, strict=True)))

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """For each text the number of its tokens, and SHA-256 of its ids and of what these decode to."""
        count = [0] * len(texts)
        ids_hash, text_hash, stream = ([make() for _ in texts] for make in (hashlib.sha256, hashlib.sha256, Utf8Stream))
        for part in self.parts(texts):
            i = part.text
            ids_hash[i].update(part.decimals[count[i] == 0 :])
            text_hash[i].update(stream[i].feed(bytes(part.decoded)).encode())
            count[i] += len(part.ids)
        for h, s in zip(text_hash, stream, strict=True):
            h.update(s.end().encode())
        return count, [h.hexdigest() for h in ids_hash], [h.hexdigest() for h in text_hash]

    def encoded(self, texts: list[str | None]) -> tuple[pa.ListArray, list[bool]]:
        """The ids of each text, and whether they decode to it; stretches are compared as they leave the decoder."""
        count, at, ok = [0] * len(texts), [0] * len(texts), [True] * len(texts)
        stream, values = [Utf8Stream() for _ in texts], []
        for part in self.parts(texts):
            i = part.text
            back = stream[i].feed(bytes(part.decoded))
            ok[i] = ok[i] and texts[i].startswith(back, at[i])
            at[i] += len(back)
            count[i] += len(part.ids)
            values.append(part.ids)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        whole = [x and y == len(t or "") and not s.end() for x, y, t, s in zip(ok, at, texts, stream, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]))), whole


def _worker(ranks: Broadcast, pattern: str) -> Worker:
    """A worker's tables, built once and used by all tasks until another operator's begins."""
    return kept_in_worker("bpe", (ranks.value["key"], pattern), lambda: Worker(ranks.value["ranks"], pattern))


class Coder:
    """Encodes and decodes texts with one vocabulary (``ranks`` broadcast: bounded by the vocabulary)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = read_ranks(path)
        small_batches(spark)
        self.ranks = spark.sparkContext.broadcast({"ranks": ranks, "key": hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()})
        self.pattern = pattern

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with a column of token ids for each text; no shuffle."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("array<int>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                yield _worker(ranks, pattern).encoded(texts.to_pylist())[0]

        return docs.withColumn(ids, encoded(F.col(text)))

    def encode_checked(self, docs: DataFrame, text: str = "text", ids: str = "ids", ok: str = "decoded_ok") -> DataFrame:
        """``docs`` with the token ids of each text and whether decoding them gives it again, in one pass of one worker."""
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("ids array<int>, ok boolean")
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                found, whole = _worker(ranks, pattern).encoded(texts.to_pylist())
                yield pa.StructArray.from_arrays([found, pa.array(whole, pa.bool_())], ["ids", "ok"])

        return with_fields(docs, coded(F.col(text)), {ids: "ids", ok: "ok"})

    def decode(self, docs: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """``docs`` with the text of each id column (null ids: empty); ill-formed bytes give U+FFFD."""
        ranks = self.ranks

        @F.arrow_udf("string")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = {i: t for t, i in ranks.value["ranks"].items()}
            for column in batches:
                yield pa.array(["".join(decode_stream(x if x is not None else (), tokens)) for x in column.to_pylist()], pa.string())

        return docs.withColumn(text, decoded(F.col(ids)))

    def round_trip(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with n_tokens, ids_sha256 and decoded_sha256, by one pass over each text.

        The ids themselves don't leave the worker: they are hashed, decoded and dropped in stretches.
        """
        ranks, pattern = self.ranks, self.pattern

        @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in batches:
                n, ids, back = _worker(ranks, pattern).digests(texts.to_pylist())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return with_fields(docs, coded(F.col(text)), {c: c for c in ("n_tokens", "ids_sha256", "decoded_sha256")})
