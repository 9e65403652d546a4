"""Byte-level BPE as a lazily determinised finite-state transducer, and its streaming inverse.

Encoding.  Every prefix of a byte string has exactly one last token in its BPE encoding, and a chain of tokens
is an encoding exactly if each neighbouring pair is one by itself.  So the encodings of all prefixes form a tree,
in which the transducer grows one node for each byte.  A later byte can only attach to nodes whose remaining bytes
begin some token; what lies above the lowest common ancestor of those nodes can no longer change, and is emitted.
The lookahead is thus bounded by the longest token.  A state is (last emitted token, bytes not yet emitted); states
and their moves are made when first needed, and forgotten together when there are too many.

Decoding.  Tokens become bytes; an incremental UTF-8 machine hands out whole characters and holds at most three
bytes of an unfinished one.  Its moves by (held bytes, token) are remembered in the same way.

Nulls: a null text is the empty text (no ids; digests of the empty string).  A text of any length is one stream.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import batched, read, rows, with_key

MAX_STATES = 120_000
MAX_CACHED = 200_000
#: Longer parts of a text are not remembered.
LONGEST_CACHED = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    """`lasts[j - 1]` is the last token of the encoding that ends after j held bytes, `firsts[j - 1]` where that encoding's first token ends."""

    __slots__ = ("prev", "held", "lasts", "firsts", "moves")

    def __init__(self, prev: int, held: bytes, lasts: tuple[int, ...], firsts: tuple[int, ...]):
        self.prev, self.held, self.lasts, self.firsts, self.moves = prev, held, lasts, firsts, {}


class Transducer:
    """Encodes one byte string after another; `stream` hands out each token as soon as it is settled."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.pieces = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.max_states = max_states
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._arcs: dict[int, dict[int, tuple[tuple[int, int], ...]]] = {}
        self._n_arcs = 0
        self._reset()

    def _reset(self) -> None:
        self.start = _State(-1, b"", (), ())
        self._states = {(-1, b""): self.start}

    def _merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The plain rule, lowest rank first, until nothing merges or `stop` parts are left; compiles single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > stop:
            best, at = min(((get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; (-1, -1) for a single byte; None if the merges never make it."""
        if token not in self._halves:
            piece = self.pieces[token]
            parts = self._merged(piece, 2)
            made = len(piece) == 1 or len(parts) == 2 and self._merged(piece) == [token]
            self._halves[token] = ((-1, -1) if len(piece) == 1 else tuple(parts)) if made else None
        return self._halves[token]

    def _stays(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens.  The merges are undone from the last on; no pair that met at the border may have merged before."""
        key = (a, b)
        known = self._pairs.get(key)
        if known is not None:
            return known
        if len(self._pairs) > 4 * self.max_states:
            self._pairs.clear()
        pieces, get = self.pieces, self.ranks.get
        known = self._split(b) is not None and (a < 0 or self._split(a) is not None)
        before = 1 << 60
        while known and a >= 0:
            if get(pieces[a] + pieces[b], before) < before:
                known = False
                break
            left, right = (self._split(a) if self.lengths[a] > 1 else None), (self._split(b) if self.lengths[b] > 1 else None)
            if left is None and right is None:
                break
            if right is None or left is not None and a > b:
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]  # at equal rank the border pair, further left, merges first
        self._pairs[key] = known
        return known

    def _move(self, state: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        held = state.held + bytes((byte,))
        n, lasts, firsts = len(held), state.lasts, state.firsts
        get, stays = self.ranks.get, self._stays
        for k in range(max(0, n - self.longest), n):
            token = get(held[k:])
            if token is not None and stays(lasts[k - 1] if k else state.prev, token):
                break
        else:
            raise ValueError("the vocabulary lacks a single-byte token")
        lasts += (token,)
        firsts += (firsts[k - 1] if k else n,)
        out: tuple[int, ...] = ()
        prev, prefixes = state.prev, self.prefixes
        while held and held not in prefixes:
            first = firsts[-1]
            if any(firsts[j - 1] != first and held[j:] in prefixes for j in range(1, len(held))):
                break
            # every encoding that can go on begins with this token
            prev = lasts[first - 1]
            out += (prev,)
            held, lasts, moved = held[first:], lasts[first:], []
            for j, last in enumerate(lasts, 1):
                at = j - self.lengths[last]
                moved.append(j if at == 0 else moved[at - 1] if at > 0 else 0)
            firsts = tuple(moved)
        key = (prev, held)
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = _State(prev, held, lasts, firsts)
        state.moves[byte] = move = (out, found)
        return move

    def _arcs_for(self, prev: int, match: int) -> tuple[tuple[int, int], ...]:
        """From state `prev`, with `match` the longest token ahead: the tokens that may follow, longest first, with their lengths."""
        piece, found = self.pieces[match], []
        for k in range(len(piece), 0, -1):
            token = self.ranks.get(piece[:k])
            if token is not None and self._stays(prev, token):
                found.append((token, k))
        return tuple(found)

    def encode(self, data: bytes) -> list[int]:
        """The tokens of one pre-token that is at hand as a whole.

        States are last tokens, arcs are made when first needed.  A wrong arc leads, within the lookahead, to a node
        from which no arc leaves; such nodes are marked, so that each byte position is tried once.
        """
        get, arcs_of, n = self.ranks.get, self._arcs, len(data)
        if (whole := get(data)) is not None and self._stays(-1, whole):
            return [whole]
        if self._n_arcs > 4 * self.max_states:
            arcs_of.clear()
            self._n_arcs = 0
        out: list[int] = []
        at, prev, dead = 0, -1, None
        while at < n:
            end = at + 7
            if end < n and data[at:end] in self.prefixes:
                end = min(n, at + self.longest)
            while (match := get(data[at:end])) is None:
                end = (end if end < n else n) - 1
            known = arcs_of.get(prev)
            if known is None:
                known = arcs_of[prev] = {}
            arcs = known.get(match)
            if arcs is None:
                arcs = known[match] = self._arcs_for(prev, match)
                self._n_arcs += 1
            for token, k in arcs:
                if dead is None or at + k not in dead:
                    out.append(token)
                    at += k
                    prev = token
                    break
            else:
                dead = dead or set()
                dead.add(at)
                at -= self.lengths[out.pop()]
                prev = out[-1] if out else -1
        return out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The same, token by token, as soon as each can no longer change."""
        if len(self._states) > self.max_states:
            self._reset()
        state = self.start
        for byte in data:
            move = state.moves.get(byte)
            emitted, state = self._move(state, byte) if move is None else move
            yield from emitted
        yield from self.finish(state)

    def finish(self, state: _State) -> list[int]:
        out, node = [], len(state.held)
        while node:
            out.append(state.lasts[node - 1])
            node -= self.lengths[out[-1]]
        return out[::-1]


class _Cache(dict):
    """A bounded dictionary that computes what it lacks; the last full generation is kept beside the growing one."""

    def __init__(self, make, limit: int = MAX_CACHED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if isinstance(key, str) and len(key) > LONGEST_CACHED:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: A space before white space or at the end: only then does a text's cut at spaces differ from the pattern's.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


class Encoder:
    """Whole texts: split by the pattern, each match through the transducer, results of matches remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.match_ids = _Cache(lambda m: array("I", self.transducer.encode(m.encode("utf-8"))).tobytes(), 2 * MAX_CACHED)
        self.spaced_ids = _Cache(self._spaced)

    def _spaced(self, part: str) -> bytes:
        """A space and what follows it up to the next one; most are a word with a mark behind it, for which the pattern is not needed."""
        known = self.match_ids
        if part.isascii():
            if part.isalpha():
                return known[" " + part]
            if part[-1] in ",.!?" and part[:-1].isalpha():
                return known[" " + part[:-1]] + known[part[-1]]
        return self._ids(" " + part)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.match_ids.__getitem__, self.find(text)))

    def ids(self, text: str) -> array:
        """The pattern always begins a match at a single space before a visible character, so parts between such spaces are split alone."""
        out = array("I")
        if _ODD_SPACE.search(text):
            out.frombytes(self._ids(text))
            return out
        first, *rest = text.split(" ")
        out.frombytes(self._ids(first) + b"".join(map(self.spaced_ids.__getitem__, rest)))
        return out


def _lead(byte: int) -> tuple[int, int, int]:
    """Of a first byte: how many bytes follow (-1: none can begin with it), and the least and greatest second one."""
    if byte < 0x80:
        return 0, 0, 0
    if not 0xC2 <= byte <= 0xF4:
        return -1, 0, 0
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
    return (1 if byte < 0xE0 else 2 if byte < 0xF0 else 3), low, high


_LEADS = [_lead(b) for b in range(256)]


class Decoder:
    """Ids to text as they come: whole characters only, the rest is held until its bytes are there."""

    def __init__(self, pieces: dict[int, bytes], limit: int = MAX_CACHED):
        self.pieces = pieces
        self.limit = limit
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.held = b""

    def _move(self, held: bytes, token: int) -> tuple[str, bytes]:
        """A lead byte says how many more bytes its character has, and in which range the first of them lies; what can't go on is one replacement character."""
        data, out, i = held + self.pieces[token], [], 0
        while i < len(data):
            need, low, high = _LEADS[data[i]]
            j = i + 1
            while j - i <= need and j < len(data) and low <= data[j] <= high:
                j, low, high = j + 1, 0x80, 0xBF
            if j - i == need + 1 and need >= 0:
                out.append(data[i:j].decode("utf-8"))
            elif need > 0 and j == len(data):
                return "".join(out), data[i:]
            else:
                out.append("\ufffd")
            i = j
        return "".join(out), b""

    def feed(self, ids: Iterable[int]) -> str:
        out, held, moves = [], self.held, self.moves
        for token in ids:
            key = (held, token)
            move = moves.get(key)
            if move is None:
                if len(moves) > self.limit:
                    moves.clear()
                move = moves[key] = self._move(held, token)
            text, held = move
            out.append(text)
        self.held = held
        return "".join(out)

    def finish(self) -> str:
        held, self.held = self.held, b""
        return "\ufffd" if held else ""


_LOADED: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _tools(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair for each worker process."""
    if (path, pattern) not in _LOADED:
        encoder = Encoder(load_ranks(path), pattern)
        _LOADED[path, pattern] = encoder, Decoder(encoder.transducer.pieces)
    return _LOADED[path, pattern]


ENCODED = pa.schema([("__key", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, `ids` (array of int) and `decoded`, the text that the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(path, pattern)

        def each():
            for k, t in rows(batches, "__key", "__text"):
                ids = encoder.ids(t or "")
                yield k, list(ids), decoder.feed(ids) + decoder.finish()

        return batched(each(), ENCODED, size=200)

    return with_key(docs, key, text).mapInArrow(run, "__key long, ids array<int>, decoded string").withColumnRenamed("__key", key)


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encode_documents`, of which only digests leave the worker: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _tools(path, pattern)
        decimal = _Cache(lambda i: str(i).encode(), 1 << 30)

        def each():
            for k, t in rows(batches, "__key", "__text"):
                ids = encoder.ids(t or "")
                back = decoder.feed(ids) + decoder.finish()
                yield k, len(ids), hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()

        return batched(each(), DIGESTS)

    return with_key(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
