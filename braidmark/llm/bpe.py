"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern is not run as a regular expression. A batch's text becomes an array of code points,
each mapped to a class; with one or two code points of look-ahead that gives a symbol. A small
automaton reads symbols and says where pre-tokens begin. Its transition functions (state to
state) compose associatively, so the array is cut into blocks, each block's function is composed
for all blocks side by side, the blocks' start states follow by a scan over the blocks, and a
last pass marks the beginnings. Every text starts with a reset symbol.

The pre-tokens' byte slices are merged once each and kept in a bounded cache; a slice's ids are
joined with its offsets, from which the bytes are decoded again.

Defined results: a null or empty text has no tokens (and the hashes of the empty string);
repeated rows are encoded row by row; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from braidmark.llm.store import bound_batches
from braidmark.llm.words import bytes_and_offsets, pieces

# classes of code points
LETTER, NUMBER, OTHER, BLANK, SPACE = range(5)
# symbols: classes with look-ahead; a run of white space before something else ends in LAST_*
S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_LAST_SPACE, S_LAST_BLANK, S_CUT1, S_CUT2, S_RESET = range(9)
# states: what the code point before belongs to
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, TAKE1, TAKE2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state], begins[symbol, state]."""
    to, begin = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS)):
        to[symbol] = state
        begin[symbol, [state, AFTER_SPACE]] = False
    to[S_LETTER, TAKE1], to[S_LETTER, TAKE2] = FRESH, TAKE1
    begin[S_LETTER, [TAKE1, TAKE2]] = False
    to[S_RUN] = IN_BLANKS
    begin[S_RUN, IN_BLANKS] = False
    to[S_LAST_SPACE], to[S_LAST_BLANK] = AFTER_SPACE, FRESH
    for symbol, state in ((S_CUT1, TAKE1), (S_CUT2, TAKE2)):
        to[symbol] = state
        # inside a run of others, or after the space that opens it, an apostrophe is one of them
        to[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begin[symbol, [IN_OTHERS, AFTER_SPACE]] = False
    to[S_RESET] = FRESH
    return to, begin


_TO, _BEGIN = _automaton()
#: Every symbol takes all states of a kind to the same state, so a function is known by its values at one of each.
_KINDS = np.array([FRESH, IN_OTHERS, TAKE1, TAKE2], np.uint8)
_KIND_OF = [0, 0, 0, 1, 0, 1, 2, 3]


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, surrogates left as OTHER."""
    out = np.full(0x110000, OTHER, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, whole):
            out[shift(m.start()) : shift(m.end() - 1) + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x20] = SPACE
    return out


def _scan(symbols: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each symbol; the first must be a reset."""
    n = len(symbols)
    width = max(1, int(n**0.5) // 2)
    blocks = -(-n // width)
    grid = np.full((blocks, width), S_RESET, np.uint8)
    grid.ravel()[:n] = symbols
    grid = np.ascontiguousarray(grid.T)
    whole = np.tile(_KINDS, (blocks, 1))
    grid8 = grid * np.uint8(8)
    to, begin = _TO.ravel(), _BEGIN.ravel()
    for column in grid8:
        whole = to[column[:, None] + whole]
    state = np.empty(blocks, np.uint8)
    at = 0
    for i, f in enumerate(whole.tolist()):
        state[i] = at
        at = f[_KIND_OF[at]]
    begins = np.empty(grid.shape, bool)
    for i, column in enumerate(grid8):
        place = column + state
        begins[i] = begin[place]
        state = to[place]
    return np.ascontiguousarray(begins.T).ravel()[:n]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all pre-tokens of the texts, and the number of them before each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.empty(0, np.int64), np.zeros(n_texts + 1, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    ends = np.zeros(len(points), bool)  # last code point of its text
    cut = np.searchsorted(lead, offsets[1:]) - 1
    ends[cut[cut >= 0]] = True
    blank = kind >= BLANK
    symbol = kind.copy()
    after_blank = np.empty(len(points), bool)
    after_blank[:-1] = blank[1:]
    after_blank[-1] = True
    inside = blank & ~(after_blank | ends)
    symbol[blank] = S_RUN
    symbol[inside] = np.where(kind[inside] == SPACE, S_LAST_SPACE, S_LAST_BLANK)
    for p in np.flatnonzero(points == 0x27).tolist():
        if ends[p]:
            continue
        one = points[p + 1]
        if one in (0x73, 0x74, 0x6D, 0x64):
            symbol[p] = S_CUT1
        elif not ends[p + 1] and (one, points[p + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):
            symbol[p] = S_CUT2
    # a reset before each text, dropped again from the answer
    first = np.searchsorted(lead, offsets[:-1])
    marked = _scan(np.insert(symbol, first, S_RESET))
    keep = np.ones(len(marked), bool)
    keep[first + np.arange(n_texts)] = False
    starts = lead[marked[keep]]
    return starts, np.searchsorted(starts, offsets)


class _Cache(dict):
    """Ids of pre-tokens of up to 256 bytes, merged at their first look-up."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: bytes) -> list[int]:
        ids = self.vocabulary.merge(piece)
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class Vocabulary:
    """Ranks of byte strings, and a bounded cache of merged pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], most_cached: int = 400_000):
        self.ranks, self.most = ranks, most_cached
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.names = [str(i) for i in range(len(self.pieces))]
        self.cache = _Cache(self)

    def merge(self, piece: bytes) -> list[int]:
        """The pair of least rank is merged first, the leftmost of equals; a heap keeps it fast for long pieces."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        if len(piece) <= 64:
            return self._merge_short(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else len(parts)
            if j >= len(parts) or len(parts[i]) + len(parts[j]) != size or not parts[i]:
                continue
            parts[i] += parts[j]
            parts[j] = b""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [ranks[p] for p in parts if p]

    def _merge_short(self, piece: bytes) -> list[int]:
        """The same order of merges, by scans of a short list."""
        ranks, none = self.ranks.get, len(self.pieces)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def encode(self, slices: list[bytes]) -> list[list[int]]:
        """The ids of each slice."""
        if len(self.cache) > self.most:
            self.cache.clear()
        return list(map(self.cache.__getitem__, slices))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(4)
def load_ranks(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def encode_batch(texts: pa.Array, vocabulary: Vocabulary):
    """For each text: its ids and the first byte of each pre-token with the number of its ids."""
    data, offsets = bytes_and_offsets(texts)
    starts, before = boundaries(data, offsets)
    raw = data.tobytes()
    ends = np.append(starts[1:], len(raw)).tolist()
    starts = starts.tolist()
    for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        slices = [raw[x:y] for x, y in zip(starts[a:b], ends[a:b], strict=True)]
        yield int(offsets[i]), starts[a:b], vocabulary.encode(slices)


def _digests(path: str, doc_id: str, text: str):
    def run(batches):
        vocabulary = load_ranks(path)
        for batch in pieces(batches, text):
            ids_of, rows = batch.column(batch.schema.get_field_index(doc_id)), []
            for _, _, parts in encode_batch(batch.column(batch.schema.get_field_index(text)), vocabulary):
                ids = list(chain.from_iterable(parts))
                spelled = " ".join(map(vocabulary.names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(vocabulary.decode(ids)).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids_of, *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    bound_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(_digests(path, doc_id, text), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str, doc_id: str, text: str):
    def run(batches):
        vocabulary = load_ranks(path)
        for batch in pieces(batches, text):
            ids_of, rows = batch.column(batch.schema.get_field_index(doc_id)), []
            for base, starts, parts in encode_batch(batch.column(batch.schema.get_field_index(text)), vocabulary):
                rows.append((list(chain.from_iterable(parts)), [s - base for s in starts], [len(p) for p in parts]))
            cols = [pa.array(c, pa.list_(t)) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([ids_of, *cols], names=["doc_id", "ids", "starts", "sizes"])

    return run


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, and per pre-token its first byte (starts) and number of ids (sizes)."""
    bound_batches(docs.sparkSession)
    return docs.select(doc_id, text).mapInArrow(_encoded(path, doc_id, text), "doc_id long, ids array<int>, starts array<int>, sizes array<int>")


def _decoded(path: str):
    def run(batches):
        vocabulary = load_ranks(path)
        for batch in batches:
            texts = [vocabulary.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the texts of encode_documents' rows."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")
