"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decode.

The merges are read as an acceptor of token paths: a path of tokens is the BPE encoding of
its bytes exactly when each token, and each two neighbours, encode to themselves. Reading a
byte moves a set of trie nodes, one for each place where a token may have begun, and puts out
the token that ends there: the last one of the encoding of all bytes so far, whose other tokens
are the encoding of what stands before it. Read back from the end of a piece, these are its
tokens. Sets are interned as states and their transitions remembered with the tokens that may
end, as are the pairs of tokens that may be neighbours; so the transducer becomes deterministic
as far as texts have needed it.

Decoding runs an explicit UTF-8 automaton over the token stream; a token may end inside a
character.

Defined results: null text is the empty text (0 tokens); empty tables give empty results;
repeated rows are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.worker import kept, no_collection

#: The public splitting pattern with its white space written out, since \s differs between engines.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: The same pattern for texts below U+0100, where the letters and numbers are these.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _State(dict):
    """Steps known so far by their byte: (state, tokens that may end there: where each begins, counted back, and what may stand before it)."""

    __slots__ = ("nodes", "transducer")

    def __missing__(self, byte: int) -> tuple[_State, tuple]:
        return self.transducer.advance(self, byte)


class _After(dict):
    """Of a token, by the token before it, raised by 1 (0: the start, -1: none ends there): the token raised by 1 where it stands there, else 0."""

    __slots__ = ("token", "transducer")

    def __missing__(self, left: int) -> int:
        return self.transducer.pair(self, left)


class Transducer:
    """Merges compiled to a transducer whose states are built when a text first reaches them.

    A state is a set of trie nodes, one for each place where a token may have begun. A step puts
    out the token that ends there, of those that may end the one that stands after the token put
    out where it begins. As that token isn't part of the state, states are no more than nodes.

    ``max_bytes`` bounds what the tables take, a half states and a half pairs of tokens: a full
    half is emptied and rebuilt on demand, which changes time and never results.
    """

    #: Bytes of a state with its set, of a transition, and of a remembered pair, rather more than measured (60 for a pair).
    STATE, MOVE, PAIR = 450, 250, 110

    def __init__(self, ranks: dict[bytes, int], max_bytes: int = 64 << 20):
        self.ranks, self.max_bytes = ranks, max_bytes
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [False]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                step = node << 8 | b
                nxt = self.child.get(step)
                if nxt is None:
                    nxt = self.child[step] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token_at[node] = rank
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.after: dict[int, _After] = {}
        self.pairs = 0
        self.sets: dict[tuple[int, ...], _State] = {}
        self.reset()

    def reset(self) -> None:
        for state in self.sets.values():
            state.clear()
        self.sets.clear()
        self.moves = 0
        self.start = self._state((0,))
        self.path: tuple[bytes, list[int], list[_State]] = (b"", [0], [self.start])

    def full(self) -> bool:
        return self.STATE * len(self.sets) + self.MOVE * self.moves > self.max_bytes // 2

    def halves(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes a token; None for single bytes and tokens that merging can't reach."""
        if token not in self.split_of:
            piece = self.bytes_of[token]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.split_of[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split_of[token]

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at a token's left (0) or right (1) end while it is merged, each with the rank at which it goes."""
        found = self.edges[side].get(token)
        if found is None:
            found, goes, at = [], 1 << 60, token
            while True:
                found.append((self.bytes_of[at], goes))
                half = self.halves(at)
                if half is None:
                    break
                goes, at = at, half[side]
            self.edges[side][token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start) in an encoding.

        It may, unless a merge across the border comes before both of its parts are gone;
        of two merges of equal rank the left one comes first.
        """
        if len(self.bytes_of[right]) > 1 and self.halves(right) is None:
            return False
        if left >= 0:
            rank_of = self.ranks.get
            for x, x_goes in self.edge(left, 1):
                for y, y_goes in self.edge(right, 0):
                    rank = rank_of(x + y)
                    if rank is not None and rank < x_goes and rank <= y_goes:
                        return False
        return True

    def pair(self, after: _After, left: int) -> int:
        if self.PAIR * self.pairs > self.max_bytes // 2:
            for known in self.after.values():
                known.clear()
            self.pairs = 0
        self.pairs += 1
        out = after[left] = after.token + 1 if left >= 0 and self.stands(left - 1, after.token) else 0
        return out

    def _after(self, token: int) -> _After:
        after = self.after.get(token)
        if after is None:
            after = self.after[token] = _After()
            after.token, after.transducer = token, self
        return after

    def _state(self, nodes: tuple[int, ...]) -> _State:
        state = self.sets.get(nodes)
        if state is None:
            state = self.sets[nodes] = _State()
            state.nodes, state.transducer = nodes, self
        return state

    def advance(self, state: _State, byte: int) -> tuple[_State, tuple]:
        nodes = state.nodes
        if self.full():
            self.reset()
            state = self._state(nodes)
        stays, ending = [], []
        for node in nodes:  # the longest first
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            if self.inner[nxt]:
                stays.append(nxt)
            token = self.token_at[nxt]
            if token >= 0 and (self.length[token] == 1 or self.halves(token) is not None):
                ending.append((-self.length[token], self._after(token)))
        self.moves += 1
        out = state[byte] = (self._state((*stays, 0)), tuple(ending))
        return out

    def _read(self, state: _State, part: bytes, ends: list[int] | array, keep: Callable[[_State], None]) -> None:
        add = ends.append
        for byte in part:
            state, ending = state[byte]
            keep(state)
            for begin, after in ending:
                token = after[ends[begin]]
                if token:
                    add(token)
                    break
            else:
                add(-1)

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of a piece. What the piece before it begins with as well isn't read again."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= 4096:
            (last, ends, states), same = self.path, 0
            for a, b in zip(last, piece):
                if a != b:
                    break
                same += 1
            del ends[same + 1 :], states[same + 1 :]
            self.path = last[:same], ends, states
            self._read(states[same], piece[same:] if same else piece, ends, states.append)
            self.path = piece, ends, states
        else:
            ends = array("i", [0])
            self._read(self.start, piece, ends, deque(maxlen=0).append)
        out: list[int] = []
        at, length = len(piece), self.length
        while at:
            token = ends[at] - 1
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            out.append(token)
            at -= length[token]
        out.reverse()
        return out


#: Lead-byte ranges of well-formed UTF-8 as (first, last, continuation bytes, least and greatest second byte).
UTF8_LEADS = (
    (0x00, 0x7F, 0, 0, 0),
    (0xC2, 0xDF, 1, 0x80, 0xBF),
    (0xE0, 0xE0, 2, 0xA0, 0xBF),
    (0xE1, 0xEC, 2, 0x80, 0xBF),
    (0xED, 0xED, 2, 0x80, 0x9F),
    (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF),
    (0xF1, 0xF3, 3, 0x80, 0xBF),
    (0xF4, 0xF4, 3, 0x80, 0x8F),
)
_LEAD = {b: (n, lo, hi) for first, last, n, lo, hi in UTF8_LEADS for b in range(first, last + 1)}


class StreamDecoder:
    """Token ids to text, a chunk at a time. The state is the unfinished character's bytes; ill-formed parts become U+FFFD."""

    def __init__(self, bytes_of: dict[int, bytes], max_moves: int = 200_000):
        self.bytes_of, self.max_moves = bytes_of, max_moves
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.clean: dict[int, str | None] = {}
        self.pending = b""

    @staticmethod
    def _run(pending: bytes, data: bytes) -> tuple[str, bytes]:
        out: list[str] = []
        need, lo, hi = 0, 0x80, 0xBF
        held = bytearray()

        def lead(b: int) -> None:
            nonlocal need, lo, hi
            found = _LEAD.get(b)
            if found is None:
                out.append("�")
            elif found[0] == 0:
                out.append(chr(b))
            else:
                need, lo, hi = found
                held.append(b)

        for b in pending + data:
            if not need:
                lead(b)
            elif lo <= b <= hi:
                held.append(b)
                need, lo, hi = need - 1, 0x80, 0xBF
                if not need:
                    out.append(held.decode())
                    held.clear()
            else:
                out.append("�")
                held.clear()
                need = 0
                lead(b)
        return "".join(out), bytes(held)

    def feed(self, ids: list[int]) -> str:
        if not self.pending:  # most runs of tokens hold whole characters only
            try:
                return "".join(map(self.clean.__getitem__, ids))
            except (KeyError, TypeError):
                pass
        out = []
        pending, moves, clean = self.pending, self.moves, self.clean
        for i in ids:
            if not pending and (text := clean.get(i)) is not None:
                out.append(text)
                continue
            step = moves.get((pending, i))
            if step is None:
                if len(moves) >= self.max_moves:
                    moves.clear()
                step = moves[pending, i] = self._run(pending, self.bytes_of[i])
                if not pending:
                    clean[i] = None if step[1] else step[0]
            out.append(step[0])
            pending = step[1]
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending = "�" if self.pending else "", b""
        return rest


class _Known(dict):
    """Pieces by their numbers, which say where their ids stand among ``ids``.

    A piece asked for first gets a number at once, and its ids with all ``new`` ones. Pieces of
    more than 64 characters are held in ``long``, under negative numbers, and not known later.
    """

    def __init__(self):
        super().__init__()
        self.ids, self.begins = array("i"), array("q", [0])
        self.new: list[str] = []
        self.long: list[str] = []

    def __missing__(self, piece: str) -> int:
        if len(piece) > 64:
            self.long.append(piece)
            return -len(self.long)
        self.new.append(piece)
        out = self[piece] = len(self)
        return out

    def of(self, piece: str) -> array | None:
        at = self.get(piece)
        return None if at is None else self.ids[self.begins[at] : self.begins[at + 1]]

    def append(self, ids: Iterable[int]) -> None:
        self.ids.extend(ids)
        self.begins.append(len(self.ids))


class _Pieces:
    """Encodings of pieces met so far; their ids stand in one array.

    When half of ``max_bytes`` are reached, what is held becomes the older half before the next
    texts, and the half that was older goes; pieces met again come back from there.
    """

    #: Bytes of an entry and of each of its tokens, more than measured (some 170 with 6 tokens).
    ENTRY, TOKEN = 250, 5

    def __init__(self, transducer: Transducer, max_bytes: int = 80 << 20):
        self.transducer, self.max_bytes, self.bytes = transducer, max_bytes, 0
        self.known, self.older = _Known(), _Known()

    def _settle(self) -> None:
        """The ids of new pieces. Those that no half knows are encoded in their order, so that many begin as the one before."""
        known, encode = self.known, self.transducer.encode_piece
        made = {piece: self.older.of(piece) for piece in known.new}
        for piece in sorted(piece for piece, ids in made.items() if ids is None):
            made[piece] = encode(piece.encode())
        for ids in made.values():
            known.append(ids)
            self.bytes += self.ENTRY + self.TOKEN * len(ids)
        for piece in known.long:
            known.append(encode(piece.encode()))
        known.new, known.long = [], []

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts given as their pieces, the ids of all, and where each text's begin, with the end of the last."""
        if self.bytes > self.max_bytes // 2:
            self.known, self.older, self.bytes = _Known(), self.known, 0
        known, sizes = self.known, list(map(len, texts))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        np.subtract(len(known) - 1, at, out=at, where=at < 0)  # long pieces come after all others
        try:
            self._settle()
        except ValueError:
            self.known, self.bytes = _Known(), 0
            raise
        begins = np.frombuffer(known.begins, np.int64)
        counts = begins[at + 1] - begins[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        every = np.repeat(begins[at] - ends[:-1], counts) + np.arange(ends[-1])
        out = np.frombuffer(known.ids, np.int32)[every] if len(every) else np.zeros(0, np.int32)
        del begins  # arrays that are looked into can't shrink or grow
        del known.ids[known.begins[len(known)] :], known.begins[len(known) + 1 :]
        return out, ends[np.cumsum([0, *sizes])]


class Codec:
    """Encode and decode texts with the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN):
        import regex

        self.any = regex.compile(pattern).findall
        self.latin = re.compile(LATIN_PATTERN).findall if pattern == SPLIT_PATTERN else None
        self.pieces = _Pieces(Transducer(ranks))
        self.decoder = StreamDecoder(self.pieces.transducer.bytes_of)
        self.decimals: pa.Array | None = None

    def split(self, text: str) -> list[str]:
        if self.latin:
            try:
                text.encode("latin-1")
                return self.latin(text)
            except UnicodeEncodeError:
                pass
        return self.any(text)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin, with the end of the last."""
        return self.pieces.encode(list(map(self.split, texts)))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def listed(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[memoryview | bytes]:
        """Of each text the ids as decimal text, joined by commas."""
        if self.decimals is None:
            self.decimals = pa.array([b"%d," % i for i in range(max(self.pieces.transducer.bytes_of) + 1)], pa.large_binary())
        made = self.decimals.take(pa.array(ids))
        at = np.frombuffer(made.buffers()[1], np.int64)[: len(ids) + 1][begins].tolist()
        data = memoryview(made.buffers()[2] or b"")
        return (data[a : max(a, b - 1)] for a, b in pairwise(at))

    def decode(self, ids: Iterable[int], chunk: int = 4096) -> str:
        ids = ids if isinstance(ids, list) else list(ids)
        out = [self.decoder.feed(ids[i : i + chunk]) for i in range(0, len(ids), chunk)]
        return "".join([*out, self.decoder.finish()])

    def decode_all(self, ids: np.ndarray, begins: np.ndarray) -> Iterator[str]:
        return (self.decode(ids[a:b].tolist()) for a, b in pairwise(begins.tolist()))


#: What is encoded at once, in texts and in their code points.
TEXTS, POINTS = 256, 1 << 20


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in parts, each with the place where it begins; null is empty."""
    part, points, begin = [], 0, 0
    for i, value in enumerate(column):
        part.append(value.as_py() or "")
        points += len(part[-1])
        if len(part) == TEXTS or points >= POINTS:
            yield begin, part
            part, points, begin = [], 0, i + 1
    if part:
        yield begin, part


def _codec(shared) -> Codec:
    """One codec for each worker process and broadcast vocabulary."""
    return kept(("bpe", shared.id), lambda: Codec(shared.ranks.value))


class _Shared:
    def __init__(self, spark, ranks: dict[bytes, int]):
        self.ranks = spark.sparkContext.broadcast(ranks)  # a fixed vocabulary: it doesn't grow with the data
        self.id = self.ranks._jbroadcast.id()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """Rows ``(id, *keep, n_tokens, token_ids ARRAY<INT>[, decoded STRING])`` for each row of ``docs``.

    With ``check``, every row's ids are decoded where they are made, and ids that don't give
    the text back are an error.
    """
    shared = _Shared(docs.sparkSession, load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at, texts in _parts(batch.column(0)):  # bounds what is held decoded and encoded at once
                with no_collection():
                    ids, begins = codec.encode_all(texts)
                    decoded = list(codec.decode_all(ids, begins)) if decode or check else []
                if check and decoded != texts:
                    raise ValueError("a text's ids don't decode to it under this vocabulary")
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))
                made = [pa.array(np.diff(begins), pa.int64()), lists, *([pa.array(decoded, pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[1:], *made], names)

    own = [docs.schema[c] for c in (id_col, *keep)]
    names = [*(f"c{i}" for i in range(len(own))), "n_tokens", "token_ids", *(["decoded"] if decode else [])]
    kinds = [*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(own)), "n_tokens long", "token_ids array<int>", *(["decoded string"] if decode else [])]
    out = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)]).mapInArrow(run, ", ".join(kinds))
    return out.withColumnsRenamed({f"c{i}": f.name for i, f in enumerate(own)})


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: the encoding and its decoding, digested where they are made."""
    shared = _Shared(docs.sparkSession, load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            n, a, b = [], [], []
            with no_collection():
                for _, texts in _parts(batch.column(1)):
                    ids, begins = codec.encode_all(texts)
                    n += np.diff(begins).tolist()
                    a += [hashlib.sha256(x).hexdigest() for x in codec.listed(ids, begins)]
                    b += [hashlib.sha256(x.encode()).hexdigest() for x in codec.decode_all(ids, begins)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
