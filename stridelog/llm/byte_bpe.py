"""Byte-level BPE as a lazily determinised transducer, and decoding as a UTF-8 state machine.

A sequence of tokens is the BPE encoding of its bytes exactly when the encoding of every two
neighbours together is those two tokens. That makes encoding a walk through a non-deterministic
transducer: a hypothesis is (trie node of the token being read, token before it, tokens that
wait to be emitted); reading a byte moves every hypothesis down the trie, and the one that
reaches a token which may follow the token before it starts the next token there. One
deterministic state is a set of hypotheses; what all of them have in common is emitted at once.
States and moves are built when a text first needs them. A token is emitted as soon as no
hypothesis can undo it, at most one longest token after its end.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, texts

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
Hypothesis = tuple[int, int, tuple[int, ...]]
State = tuple[Hypothesis, ...]
ROOT, NONE = 0, -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    """Encodes one pre-split piece at a time; ``max_states`` bounds the memory only.

    When that many states are known, further ones are walked through without being kept; after
    ``PASSING`` times as many such moves the known ones are dropped, in case the text has changed.
    """

    PASSING = 20

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000):
        self._ranks = ranks
        self._bytes = {i: t for t, i in ranks.items()}
        self._children: list[dict[int, int]] = [{}]
        self._token_at: list[int] = [NONE]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                if byte not in self._children[node]:
                    self._children[node][byte] = len(self._children)
                    self._children.append({})
                    self._token_at.append(NONE)
                node = self._children[node][byte]
            self._token_at[node] = rank
        self._max_states = max_states
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._reset()

    def encode(self, piece: bytes) -> list[int]:
        whole = self._ranks.get(piece)
        if whole is not None:
            return [whole]
        if self._passing > self.PASSING * self._max_states:
            self._reset()
        out: list[int] = []
        state, moves = 0, self._moves
        for byte in piece:
            if type(state) is int:
                move = moves[state].get(byte)
                if move is None:
                    move = self._move(self._states[state], byte)
                    if type(move[0]) is int:
                        moves[state][byte] = move
            else:
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return out + self._rest(self._states[state] if type(state) is int else state)

    def _reset(self) -> None:
        self._states: list[tuple[Hypothesis, ...]] = []
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self._number: dict[tuple[Hypothesis, ...], int] = {}
        self._passing = 0
        self._intern(((ROOT, NONE, ()),))

    def _intern(self, state: State) -> int | State:
        """The number of a state; the state itself if there is no room for one more."""
        number = self._number.get(state)
        if number is not None:
            return number
        if len(self._states) >= self._max_states:
            self._passing += 1
            return state
        number = self._number[state] = len(self._states)
        self._states.append(state)
        self._moves.append({})
        return number

    def _move(self, state: State, byte: int) -> tuple[int | State, tuple[int, ...]]:
        reached: list[Hypothesis] = []
        for node, before, waiting in state:
            child = self._children[node].get(byte)
            if child is None:
                continue
            if self._children[child]:
                reached.append((child, before, waiting))
            token = self._token_at[child]
            if token != NONE and self._follows(before, token):
                reached.append((ROOT, token, (*waiting, token)))
        shared = 0
        paths = [h[2] for h in reached]
        for column in zip(*paths):
            if any(t != column[0] for t in column):
                break
            shared += 1
        after = tuple(sorted((n, b, w[shared:]) for n, b, w in reached))
        return self._intern(after), paths[0][:shared]

    @staticmethod
    def _rest(state: State) -> list[int]:
        for node, _, waiting in state:
            if node == ROOT:
                return list(waiting)
        raise ValueError("every byte must be a token")

    def _follows(self, before: int, token: int) -> bool:
        key = (before, token)
        known = self._may_follow.get(key)
        if known is None:
            left = b"" if before == NONE else self._bytes[before]
            expected = [token] if before == NONE else [before, token]
            known = merged(left + self._bytes[token], self._ranks) == expected
            if len(self._may_follow) > 5 * self._max_states:
                self._may_follow.clear()
            self._may_follow[key] = known
        return known


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by definition: join the neighbours of lowest rank, leftmost first, until none is left.

    Used for pairs of tokens only, which are short.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Utf8Stream:
    """Incremental UTF-8 decoding: the state is the started character, at most three bytes.

    Bytes that cannot be part of a character become U+FFFD.
    """

    def __init__(self) -> None:
        self._started = b""

    def feed(self, data: bytes) -> str:
        data = self._started + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:  # a first byte: of a character of two, three or four bytes
                keep = back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else 0
                break
            if byte < 0x80:
                break
        self._started = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._started = self._started, b""
        return rest.decode("utf-8", "replace")


class ByteBPE:
    """Whole texts: split by ``pattern``, encode each piece separately, decode as a stream.

    A memo saves repeated walks. It has two halves of at most ``memo_bytes``: when one is full it
    takes the place of the older one, so pieces in use are not lost.
    """

    def __init__(self, path: str, pattern: str, memo_bytes: int = 60_000_000):
        ranks = load_ranks(path)
        self._split = regex.compile(pattern).findall
        self._transducer = Transducer(ranks)
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._memo_bytes, self._held = memo_bytes, 0
        self._tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self._tokens[rank] = token

    def encode(self, text: str | None) -> np.ndarray:
        pieces = self._split(text or "")
        if self._held > self._memo_bytes:
            self._older, self._memo, self._held = self._memo, {}, 0
        memo = self._memo
        for piece in set(pieces).difference(memo):
            ids = self._older.get(piece)
            if ids is None:
                ids = array("I", self._transducer.encode(piece.encode())).tobytes()
            memo[piece] = ids
            self._held += len(piece) + len(ids) + 150  # two objects and their place in the table
        return np.frombuffer(b"".join(map(memo.__getitem__, pieces)), "<u4")

    def decode_bytes(self, ids: np.ndarray, at_once: int = 1 << 16) -> Iterator[bytes]:
        for i in range(0, len(ids), at_once):
            yield b"".join(map(self._tokens.__getitem__, ids[i : i + at_once].tolist()))

    def decode(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text as soon as its characters are complete, whatever the chunks of ids are."""
        stream = Utf8Stream()
        for ids in chunks:
            for data in self.decode_bytes(ids):
                yield stream.feed(data)
        yield stream.close()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder for all tasks of a worker process."""
    return ByteBPE(path, pattern)


def encode_and_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: number and digest of its ids, digest of the text decoded from them.

    NULL and empty texts have no ids. Ids may be NULL or repeated: rows are independent. Texts
    of any length are encoded whole. Other columns of ``docs`` are not read.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                back = hashlib.sha256()
                for part in bpe.decode([ids]):
                    back.update(part.encode())
                counts.append(len(ids))
                encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(encoded, pa.string()),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(digests, SCHEMA)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_and_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
