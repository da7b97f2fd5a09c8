"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are concatenated and indexed by a suffix
array (sorted as deep as the longest piece).  Every piece of the vocabulary is
binary-searched for its range of occurrences; the resulting edges are put in order of
position and length (into a table with a row for each position), and relaxed as the
model's merge order demands, which is not that of a shortest path: in rounds, each
word takes its edge of best score that spans two adjacent symbols.  Characters
without a piece fall back to bytes.  Decoding joins the bytes of the pieces.

The model file is read on the driver and its pieces (a fixed vocabulary) go along
with the tasks.  Supported are merge-order (BPE) models with identity
normalisation, a prefix space and byte fallback; others are refused.

Defined cases: null and empty texts have no tokens, and decode to null and empty;
a text's own U+2581 decodes to a space, as the format has it (its round trip is
told false); repeated rows are encoded each; an empty table gives an empty one; other
columns stay, but for token_ids, n_tokens and round_trip (text in ``detokenized``),
which are replaced.  Texts are taken in pieces of a few MB; a longer text is taken
whole, and so is a word, at about 250 bytes of memory a character.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from pagemill.llm.common import mixed, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
CHUNK = 1 << 19  #: characters of distinct words that are indexed together


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    def __init__(self, raw: bytes):
        pieces, trainer, normal = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(1) != b"identity" or normal.get(3, 1) != 1 or normal.get(4, 1) != 0:
            raise ValueError("not a byte-fallback merge-order model with identity normalisation, a prefix space and kept spaces")
        self.bytes = [t.replace(chr(SPACE), " ").encode() if kind == 1 else bytes([int(t[3:5], 16)]) if kind == 6 else b"" for t, _, kind in pieces]
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (t, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(t[3:5], 16)] = i
        own = [(t, s, i) for i, (t, s, kind) in enumerate(pieces) if kind == 1]
        self.size = np.array([len(t) for t, _, _ in own], np.int64)
        self.longest = int(self.size.max())
        self.codes = np.zeros((len(own), self.longest), np.uint32)
        for k, (t, _, _) in enumerate(own):
            self.codes[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        self.ids = np.array([i for _, _, i in own], np.int32)
        score = np.array([s for _, s, _ in own])
        # Ranks: 0 is the best score.  Equal scores are equal ranks, whose merges go strictly from the left.
        _, rank, often = np.unique(-score, return_inverse=True, return_counts=True)
        self.rank, self.tied = rank.astype(np.int32), often > 1

    @staticmethod
    def read(path: str = MODEL) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary(f.read())


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions in the order of the text from there on, as far as depth characters tell."""
    _, rank = np.unique(text, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    while k < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-k] = rank[k:]
        _, rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)
        rank, k = rank.astype(np.int64) + 1, 2 * k
    return np.argsort(rank, kind="stable")


def ranges(text: np.ndarray, order: np.ndarray, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the range of the suffix array whose suffixes begin with it: all pieces are bisected at once."""
    depth = codes.shape[1]
    padded = np.concatenate([text, np.zeros(depth, text.dtype)])
    inside = np.arange(depth)[None, :] < size[:, None]
    found = []
    for above in (False, True):
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), len(text), np.int64)
        todo = np.arange(len(codes))
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            seen = padded[order[mid][:, None] + np.arange(depth)[None, :]]
            differs = (seen != codes[todo]) & inside[todo]
            at = differs.argmax(1)
            less = np.where(differs.any(1), seen[np.arange(len(at)), at] < codes[todo, at], above)
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        found.append(lo)
    return found[0], found[1]


def encode_words(v: Vocabulary, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and their n+1 offsets; first: n+1 offsets of the words in text."""
    n = len(text)
    order = suffixes(text, v.longest)
    lo, hi = ranges(text, order, v.codes, v.size)
    # Edges, each at its position: the piece that begins there with so many characters.
    piece = np.repeat(np.arange(len(lo)), hi - lo)
    at = order[np.arange(len(piece)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
    edges = np.full((n + 1, v.longest + 1), -1, np.int32)
    edges[at, v.size[piece]] = piece
    pos = np.arange(n)
    size = np.ones(n, np.int64)
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    none = np.int32(2**31 - 1)
    done = []
    while len(pos):
        pair = np.full(len(pos), -1, np.int32)
        if len(pos) > 1:
            long = size[:-1] + size[1:]
            ok = np.flatnonzero((word[:-1] == word[1:]) & (long <= v.longest))
            pair[ok] = edges[pos[ok], long[ok]]
        rank = np.where(pair >= 0, v.rank[pair], none)
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(rank, start)
        count = np.diff(np.append(start, len(pos)))
        over = np.repeat(best == none, count)
        if over.any():
            done.append((pos[over], size[over]))
            keep = ~over
            pos, size, word, rank, best, count = pos[keep], size[keep], word[keep], rank[keep], best[best != none], count[best != none]
            if not len(pos):
                break
        take = rank == np.repeat(best, count)
        # Of pairs that overlap, every other one from the left; of tied scores only the leftmost of a word.
        hit = np.flatnonzero(take)
        run = np.cumsum(np.append(True, np.diff(hit) != 1)) - 1
        begin = np.flatnonzero(np.append(True, np.diff(hit) != 1))
        take[hit] = (np.arange(len(hit)) - begin[run]) % 2 == 0
        hit = np.flatnonzero(take)
        again = np.append(False, word[hit][1:] == word[hit][:-1]) & v.tied[rank[hit]]
        hit = hit[~again]
        size[hit] += size[hit + 1]
        keep = np.ones(len(pos), bool)
        keep[hit + 1] = False
        pos, size, word = pos[keep], size[keep], word[keep]
    if not done:
        return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
    pos, size = np.concatenate([p for p, _ in done]), np.concatenate([s for _, s in done])
    by = np.argsort(pos)
    pos, size = pos[by], size[by]
    piece = edges[pos, size]
    many = np.ones(len(pos), np.int64)
    lost = np.flatnonzero(piece < 0)
    code = text[pos[lost]].astype(np.int64)
    many[lost] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    to = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.int32)
    out[to] = np.where(piece >= 0, v.ids[piece], 0)
    for c in np.unique(code):
        ids = v.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)]
        where = to[lost[code == c]]
        out[where[:, None] + np.arange(len(ids))] = ids
    return out, np.append(to, len(out))[np.searchsorted(pos, first)]


def _span_index(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The members of all spans, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def encode(v: Vocabulary, texts: list[str | None], piece_bytes: int = 1 << 21) -> list[np.ndarray]:
    """Token ids of each text."""
    parts, at = [], 0
    while at < len(texts):  # pieces of the batch bound the memory for splitting; a longer text is a piece of its own
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to] or "") <= piece_bytes):
            held += len(texts[to] or "")
            to += 1
        own = [chr(SPACE) + t.replace(" ", chr(SPACE)) if t else "" for t in texts[at:to]]
        text = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *map(len, own)])
        space = text == SPACE
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[bounds[:-1][bounds[:-1] < len(text)]] = True
        first = np.append(np.flatnonzero(begin), len(text))
        size = np.diff(first)
        value = mixed(text.astype(np.uint64) + np.uint64(1)) * powers(int(size.max()) if len(size) else 1)[np.arange(len(text)) - np.repeat(first[:-1], size)]
        hashes = mixed(np.add.reduceat(value, first[:-1])) if len(size) else np.zeros(0, np.uint64)
        known, where, token = np.unique(hashes, return_index=True, return_inverse=True)
        parts.append((known, text[_span_index(first[where], size[where])], size[where], token, np.searchsorted(first[:-1], bounds)))
        at = to
    known, where = np.unique(np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64), return_index=True)
    text = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
    size = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
    start = (np.cumsum(size) - size)[where]
    size = size[where]
    ids, length, k = [], [], 0
    total = np.cumsum(size)
    while k < len(known):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CHUNK, "right")))
        got, first = encode_words(v, text[_span_index(start[k:to], size[k:to])], np.cumsum(np.append(0, size[k:to])))
        ids.append(got)
        length.append(np.diff(first))
        k = to
    flat, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, length))
    begin = np.cumsum(length) - length
    out = []
    for own, _, _, token, first in parts:
        token = np.searchsorted(known, own)[token]
        tokens = flat[_span_index(begin[token], length[token])].astype(np.int32)
        cut = np.append(0, np.cumsum(length[token]))[first]
        out += [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    return out


def decode(v: Vocabulary, ids) -> str:
    raw = b"".join([v.bytes[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def tokenized(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (whether decoding gives the text)."""
    v = Vocabulary.read(model)
    names = ("token_ids", "n_tokens", "round_trip")
    fields = [f for f in docs.schema.fields if f.name not in names]
    kept = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(v)  # the model's fixed vocabulary

    def run(batches):
        for b in batches:
            v = shared.value
            texts = b.column(text).to_pylist()
            ids = encode(v, texts)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            same = [decode(v, i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), tokens, pa.array(np.diff(offsets), pa.int32()), pa.array(same, pa.bool_())], [*kept, *names])

    return docs.mapInArrow(run, StructType([*fields, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("round_trip", BooleanType())]))


def detokenized(tokens: DataFrame, ids: str = "token_ids", name: str = "text", model: str = MODEL) -> DataFrame:
    """tokens with the text that each row's ids decode to; null ids give null."""
    v = Vocabulary.read(model)
    fields = [f for f in tokens.schema.fields if f.name != name]
    kept = [f.name for f in fields]
    shared = tokens.sparkSession.sparkContext.broadcast(v)  # the model's fixed vocabulary

    def run(batches):
        for b in batches:
            texts = [None if x is None else decode(shared.value, x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, name])

    return tokens.mapInArrow(run, StructType([*fields, StructField(name, StringType())]))
