"""Byte-level BPE encoding and decoding.

Encoding compiles the merge ranks into a transducer that is made deterministic lazily. BPE has two properties
that allow it: the encoding of a prefix ends in one token that depends on the prefix alone, and a list of
tokens is an encoding exactly if each two neighbours are (the pair's bytes encode to the pair).
So after a prefix it is enough to know, for each start of a token that may still be growing, the vocabulary's
trie node of the bytes since, and the tokens up to there that aren't out yet. That is a state; it
takes a byte to the next state, and emits the tokens that all its starts agree on. A start lives as
long as its bytes are a prefix of some token, so the lookahead is bounded by the longest token. States and
transitions are made when a text first needs them and kept, up to a limit; then the transducer starts anew, with
the state it is in, in the middle of a text too.

Decoding is a stream: ids become bytes, and an incremental UTF-8 state machine lets out whole characters only; a
character that a token leaves open is finished by later ones, and what can't be UTF-8 becomes U+FFFD.

Defined results: a null text is empty and has no ids; strings of special tokens are ordinary text; an id
outside the vocabulary is a KeyError. Rows are judged each by itself; ties can't occur.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import frugal
from tidemark.llm.pretokens import Memo, gather

MOST_STATES = 250_000
#: Pre-tokens whose ids a worker holds, at some 60 bytes each.
MEMO = 1_000_000


def multi_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


def merge_naively(ranks: dict[bytes, int], data: bytes) -> list[bytes]:
    """The definition: of all neighbours whose union is a token, merge the lowest rank, leftmost, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Transducer:
    """Maps the bytes of one pre-token to ids, in one pass from left to right."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        self.ranks, self.most = ranks, most_states
        self.token = {rank: data for data, rank in ranks.items()}
        # trie: node -> {byte: node}; the token that ends in a node
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for data, rank in ranks.items():
            node = 0
            for byte in data:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = child
            self.ends[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state is a tuple of starts (trie node, last token before it or -1, tokens before it not emitted), the youngest last
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.flush: list[tuple[int, ...]] = []
        self._state(((0, -1, ()),))

    def _state(self, key: tuple) -> int:
        """The number of a state, a new one if need be."""
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.flush.append(key[-1][2])
        return number

    def joins(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: together they encode to themselves."""
        if left < 0:
            known = self.reachable.get(right)
            if known is None:
                data = self.token[right]
                known = self.reachable[right] = merge_naively(self.ranks, data) == [data]
            return known
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.token[left], self.token[right]
            if len(self.pairs) > 4 * self.most:
                self.pairs.clear()
            known = self.pairs[left, right] = merge_naively(self.ranks, a + b) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state by a byte."""
        live, here = [], None
        for node, before, pending in self.states[state]:
            child = self.next[node].get(byte)
            if child is None:
                continue
            token = self.ends[child]
            if token >= 0 and here is None and self.joins(before, token):
                here = (token, (*pending, token))
            if self.next[child]:
                live.append((child, before, pending))
        assert here is not None, "every byte is a token"
        live.append((0, here[0], here[1]))
        # what all starts agree on goes out; most often the oldest one holds nothing back
        common, first = 0, live[0][2]
        if first:
            common = min([len(p) for _, _, p in live])
            while common and any([p[:common] != first[:common] for _, _, p in live]):
                common -= 1
        key = tuple([(node, before, pending[common:]) for node, before, pending in live]) if common else tuple(live)
        if len(self.states) >= self.most:
            self.reset()
            return self._state(key), first[:common]
        move = self.moves[state][byte] = (self._state(key), first[:common])
        return move

    def encode(self, data: bytes) -> list[int]:
        state, out, moves = 0, [], self.moves
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                move = self._step(state, byte)
                moves = self.moves  # other ones if it started anew
            state = move[0]
            if move[1]:
                out += move[1]
        out.extend(self.flush[state])
        return out


class Decoder:
    """Ids in, whole characters out: an incremental UTF-8 state machine over the bytes of the tokens.

    The state is how many continuation bytes the open character still needs and the range its next byte must be in.
    """

    def __init__(self, token: dict[int, bytes] | list[bytes]):
        self.token = token
        self.open = bytearray()
        self.need, self.low, self.high = 0, 0x80, 0xBF

    def _lead(self, byte: int) -> bool:
        """Take a first byte; False if no character starts so."""
        self.low, self.high = 0x80, 0xBF
        if byte < 0x80:
            self.need = 0
        elif 0xC2 <= byte <= 0xDF:
            self.need = 1
        elif 0xE0 <= byte <= 0xEF:
            self.need = 2
            self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
        elif 0xF0 <= byte <= 0xF4:
            self.need = 3
            self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
        else:
            return False
        return True

    def _byte(self, byte: int, out: list[str]) -> None:
        if self.need and self.low <= byte <= self.high:
            self.open.append(byte)
            self.need -= 1
            self.low, self.high = 0x80, 0xBF
        else:
            if self.need:
                out.append("�")
                self.open.clear()
                self.need = 0
            if not self._lead(byte):
                out.append("�")
                return
            self.open.append(byte)
        if not self.need:
            out.append(self.open.decode())
            self.open.clear()

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that these ids finish."""
        data = b"".join([self.token[i] for i in ids])
        out: list[str] = []
        at = 0
        while at < len(data) and self.need:
            self._byte(data[at], out)
            at += 1
        # nothing is open: what is whole can go at once, up to a last character that may be cut
        last = len(data)
        for back in range(1, min(3, len(data) - at) + 1):
            if data[-back] >= 0xC0:
                last -= back
                break
            if data[-back] < 0x80:
                break
        try:
            out.append(data[at:last].decode())
        except UnicodeDecodeError:
            last = at
        for byte in data[last:]:
            self._byte(byte, out)
        return "".join(out)

    def close(self) -> str:
        """What is left is no whole character."""
        left = "�" if self.need else ""
        self.open.clear()
        self.need = 0
        return left


@cache
def _tools(path: str) -> tuple[Memo, list[bytes], np.ndarray, np.ndarray]:
    """The encoder of a vocabulary, its tokens, and the decimal form of the ids, one after the other."""
    ranks = read_ranks(path)
    transducer = Transducer(ranks)
    token = [b""] * (max(ranks.values()) + 1)
    for data, rank in ranks.items():
        token[rank] = data
    text = [b"%d," % i for i in range(len(token))]
    first = np.concatenate(([0], np.cumsum([len(t) for t in text])))
    return Memo(lambda pieces: [transducer.encode(p) for p in pieces], most=MEMO), token, np.frombuffer(b"".join(text), np.uint8), first


def joined(ids: np.ndarray, flat: np.ndarray, first: np.ndarray) -> bytes:
    """The ids in decimal, with commas between."""
    ids = ids.astype(np.int64)
    return flat[gather(first[ids], first[ids + 1] - first[ids])].tobytes()[:-1]


def encode(docs: DataFrame, *, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: the token ids of every text."""
    path = path or multi_vocabulary()

    def of(batches):
        memo = _tools(path)[0]
        for batch in batches:
            ids = [x.astype(np.int64) for x in memo.encode_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(frugal(of), "doc_id long, ids array<long>")


def decode_text(ids: np.ndarray, token: list[bytes], step: int = 4096) -> str:
    """The text of a list of ids, decoded as a stream of ``step`` ids at a time."""
    decoder = Decoder(token)
    out = [decoder.feed(ids[at : at + step].tolist()) for at in range(0, len(ids), step)]
    return "".join(out) + decoder.close()


def decode(coded: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of a table of ``doc_id, ids``; null ids are an empty text."""
    path = path or multi_vocabulary()

    def of(batches):
        token = _tools(path)[1]
        for batch in batches:
            texts = [decode_text(np.array(ids or [], np.int64), token) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(frugal(of), "doc_id long, text string")


def round_trip(docs: DataFrame, *, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, without moving the ids."""
    path = path or multi_vocabulary()

    def of(batches):
        memo, token, flat, first = _tools(path)
        for batch in batches:
            n, coded, decoded = [], [], []
            for ids in memo.encode_column(batch.column(1)):
                n.append(len(ids))
                coded.append(hashlib.sha256(joined(ids, flat, first)).hexdigest())
                decoded.append(hashlib.sha256(decode_text(ids, token).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(frugal(of), schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of all documents."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
