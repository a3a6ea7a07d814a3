"""Operator 7, byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The split pattern's language is regular once a character's next two are known, so a
finite automaton over codepoint classes finds the boundaries. Each character is a
transition function (a row of next states); functions compose associatively, so whole
buffers of text are scanned at once: functions are composed along the columns of a
matrix of characters, block results by a doubling scan, and a second sweep reads off the
states. No regular expression runs. The slices feed pair merging through a cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltarule.llm.common import small_batches, steps, table

# Codepoint classes.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE = range(6)
# Symbols of the automaton: a character with what follows it. GAP: a space before a
# non-space; TAIL: other white space before a non-space; WHITE: white space before white
# space or the end; SHORT, LONG: a quote before a contraction of one or two letters.
S_OTHER, S_LETTER, S_NUMBER, S_GAP, S_TAIL, S_WHITE, S_SHORT, S_LONG = range(8)
# States: what the last token is made of; FRESH: whatever comes begins a token.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_GAP, NEED_ONE, NEED_TWO = range(8)
_STATES, _BLOCK = 8, 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a token begins, by symbol and state."""
    after = np.zeros((16, _STATES), np.uint8)
    begins = np.ones((16, _STATES), bool)
    for symbol, state in ((S_OTHER, IN_OTHER), (S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_GAP, AFTER_GAP), (S_TAIL, FRESH), (S_WHITE, IN_WHITE), (S_SHORT, NEED_ONE), (S_LONG, NEED_TWO)):
        after[symbol] = state
    for symbol, states in ((S_LETTER, (IN_LETTERS, AFTER_GAP)), (S_NUMBER, (IN_NUMBERS, AFTER_GAP)), (S_OTHER, (IN_OTHER, AFTER_GAP)), (S_WHITE, (IN_WHITE,))):
        begins[symbol, list(states)] = False
    for symbol in (S_SHORT, S_LONG):  # a quote inside other signs, or after a space, is one of them
        begins[symbol, [IN_OTHER, AFTER_GAP]] = False
        after[symbol, [IN_OTHER, AFTER_GAP]] = IN_OTHER
    after[S_LETTER, [NEED_ONE, NEED_TWO]] = FRESH, NEED_ONE
    begins[S_LETTER, [NEED_ONE, NEED_TWO]] = False
    after[8:] = after[:8, FRESH][:, None]  # the same symbols as first characters of a text
    return after, begins


_AFTER, _BEGINS = _automaton()


def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            out[i] = LETTER if kind == "L" else NUMBER
    # The property White_Space, fixed by the Unicode standard.
    out[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def classes(_made: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006  once a process
    if not _made:
        _made.append(_classes())
    return _made[0]


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from transition functions composed associatively."""
    n = len(symbols)
    rows = -(-n // _BLOCK)
    flat = np.zeros(rows * _BLOCK, np.uint8)
    flat[:n] = symbols
    grid = np.ascontiguousarray(flat.reshape(rows, _BLOCK).T)
    table = _AFTER.reshape(-1)
    whole = np.repeat(np.arange(_STATES, dtype=np.uint8)[None], rows, 0)
    for column in grid:  # the function of each block
        whole = table[(column.astype(np.int32) * _STATES)[:, None] + whole]
    reach = 1
    while reach < rows:  # prefix composition: block i after block i - reach
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], axis=1)
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty_like(grid)
    for k, column in enumerate(grid):
        out[k] = state
        state = table[column.astype(np.int32) * _STATES + state]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks characters that begin a token. points: code points; first: places where texts begin."""
    n = len(points)
    kind = classes()[np.minimum(points, 0x10FFFF)]
    last = np.zeros(n, bool)
    last[first[first > 0] - 1] = True
    last[n - 1 :] = True
    white = (kind == BLANK) | (kind == SPACE)
    next_white = np.ones(n, bool)
    next_white[:-1] = white[1:]
    next_white |= last
    symbol = np.where(kind == QUOTE, np.uint8(S_OTHER), kind)  # OTHER, LETTER and NUMBER are their own symbols
    symbol[white] = np.where(next_white[white], S_WHITE, np.where(kind[white] == SPACE, S_GAP, S_TAIL))
    quotes = np.flatnonzero((kind == QUOTE) & ~last)
    if len(quotes):
        one = points[quotes + 1]
        two = points[np.minimum(quotes + 2, n - 1)]
        two = np.where(last[quotes + 1], 0, two)
        symbol[quotes[np.isin(one, [ord(x) for x in "stmd"])]] = S_SHORT
        for a, b in ("re", "ve", "ll"):
            symbol[quotes[(one == ord(a)) & (two == ord(b))]] = S_LONG
    symbol[first[first < n]] += 8
    before = scan(symbol)
    return _BEGINS.reshape(-1)[symbol.astype(np.int32) * _STATES + before] | (symbol >= 8)


def readable(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a step, with U+FFFD where bytes are not UTF-8."""
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all tokens' slices, and len+1 offsets of the texts into them."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cuts = leads[boundaries(points, np.unique(np.searchsorted(leads, offsets[:-1])))] if len(points) else leads
    return np.append(cuts, len(data)), np.searchsorted(cuts, offsets)


class BytePairs:
    """Merges the byte pairs of a slice by rank, cached; decodes ids."""

    def __init__(self, ranks: dict[bytes, int], cached: int = 300_000):
        self.ranks, self.cached = ranks, cached
        self.values = {v: k for k, v in ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, content: str | bytes) -> BytePairs:
        """From the content of a rank file: a line each of base64 bytes and a rank."""
        content = content.encode() if isinstance(content, str) else content
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x)})

    def packed(self, piece: bytes) -> bytes:
        """The ids of a slice as little-endian unsigned 32-bit integers."""
        found = self.cache.get(piece)
        if found is None:
            found = np.array(self.merge(piece), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.cache) >= self.cached:
                    self.cache.clear()  # frequent slices come back at once
                self.cache[piece] = found
        return found

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 100:
            return self._merge_long(piece)
        none = 1 << 40
        cuts = list(range(len(piece) + 1))
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], none)
            if i < len(pairs):
                pairs[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], none)
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap of pairs over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: merged away
        prev = list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.values.__getitem__, ids.tolist()))


def default_ranks() -> bytes:
    """The content of the rank file, read where the query is planned: executors get its bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks: bytes, digest: bool = False) -> DataFrame:
    """Token ids of every text, within partitions.

    docs: any frame with doc_id and text; other columns are ignored, repeated rows give
    repeated results; null reads as empty, which has no tokens. Special tokens are text.
    Bytes that are not UTF-8 read as U+FFFD. Returns doc_id, n_tokens, ids (array), offsets
    (byte at which each token begins) and restored, whether the ids decode to the text again;
    with digest hashes of the ids and of the bytes that they decode to.
    """
    small_batches(docs.sparkSession)
    out = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<long>, offsets array<long>, restored boolean")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(ranks)
        for rows, data, offsets in steps(batches):
            data, offsets = readable(data, offsets)
            cuts, bounds = slices(data, offsets)
            raw, places = data.tobytes(), cuts.tolist()
            counts, left, right, restored = [], [], [], []
            for i in range(rows.num_rows):
                own = places[bounds[i] : bounds[i + 1]]
                packed = b"".join([pairs.packed(raw[a:b]) for a, b in zip(own, [*own[1:], int(offsets[i + 1])])])
                ids = np.frombuffer(packed, "<u4")
                counts.append(len(ids))
                if digest:
                    left.append(hashlib.sha256(packed).hexdigest())
                    right.append(hashlib.sha256(pairs.decode(ids)).hexdigest())
                else:
                    left.append(ids.astype(np.int64))
                    lengths = np.array([len(pairs.values[x]) for x in ids.tolist()], np.int64)
                    right.append(np.cumsum(lengths) - lengths)
                    restored.append(pairs.decode(ids) == raw[offsets[i] : offsets[i + 1]])
            kind = pa.string() if digest else pa.list_(pa.int64())
            more = [] if digest else [pa.array(restored, pa.bool_())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(left, kind), pa.array(right, kind), *more], [x.split()[0] for x in out.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(of, out)


def _pairs(ranks: bytes, _made: dict[int, BytePairs] = {}) -> BytePairs:  # noqa: B006  once a process
    key = hash(ranks)
    if key not in _made:
        _made.clear()
        _made[key] = BytePairs.load(ranks)
    return _made[key]


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; a null list decodes to an empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(ranks)
        for rows in batches:
            texts = [pairs.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(of, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_ranks(), digest=True)
