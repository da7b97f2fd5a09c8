"""BPE with word ends by a minimal acyclic transducer of frequent words.

The words of all texts are counted; the frequent ones are merged once, in order, and
compiled into a transducer: an automaton over their bytes whose arcs and final states
put out token ids, as early as they are certain, and whose equal states are shared.
It lies in one file of 32-bit numbers (a double array of arcs), which Spark brings to
each executor once and which all its Python workers map into memory.  The tokens of a
batch run through it side by side, a byte at a time; words that it does not hold are
merged exactly, as the model's ranks demand.

A model is a file of the tokenizers library: BPE with a suffix at word ends, NFC, white
space dropped, lower case, and bytes as letters; others are refused.  Texts with
characters on which Python's tables and the library's may differ, as they are newer than
one of them, are split by the file's own normalizer and splitter.

Defined cases: null and empty texts have no tokens, and decode to null and empty; the
strings of special tokens in a text are these tokens; repeated rows are encoded each; an
empty table gives an empty one; other columns stay, but for token_ids, n_tokens and
decoded, which are replaced; equally frequent words enter the lexicon in byte order,
which no result depends on.  Texts are taken in slices of about a MB, a longer text as
a whole, at about 150 bytes of memory a byte of text.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagemill.llm.common import shared_dir, slices, written

LEXICON_WORDS = 1 << 16  #: words in the transducer at most
RARE = 1 << 20  #: words that make up less than such a part of all are not frequent
WORD_BYTES = 32  #: longer words are merged, not looked up
LONG = 256  #: symbols above which a word is merged with a heap
#: White space of the splitter (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Steps of the supported models (fixed values).
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
GAP, LETTER, NUMBER, OTHER, NEW = range(5)


def _span_index(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself if it can be printed, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Model:
    """Ids, merges and texts of a vocabulary, as arrays."""

    def __init__(self, raw: str):
        f = json.loads(raw)
        m, steps = f["model"], f["normalizer"]["normalizers"]
        split, letters = f["pre_tokenizer"]["pretokenizers"]
        known = (
            m["type"] == "BPE" and not m.get("dropout") and not m.get("ignore_merges") and not m.get("continuing_subword_prefix") and m.get("end_of_word_suffix")
            and [s["type"] for s in steps] == NORMAL and split["pattern"] == {"Regex": SPLIT} and split["invert"] and split["behavior"] == "Removed"
            and letters["type"] == "ByteLevel" and not letters["add_prefix_space"] and not letters["use_regex"] and f.get("decoder") is None and f.get("post_processor") is None
        )
        if not known:
            raise ValueError("not a byte-level BPE model with word ends, lower case and dropped white space")
        self.raw, vocab, end = raw, m["vocab"], m["end_of_word_suffix"]
        letter = byte_letters()
        self.inner = np.array([vocab[c] for c in letter], np.int32)
        self.last = np.array([vocab[c + end] for c in letter], np.int32)
        self.special = {t["content"]: t["id"] for t in f["added_tokens"] if not t["normalized"]}
        if len(self.special) != len(f["added_tokens"]):
            raise ValueError("added tokens of normalized text are not supported")
        pairs = [p if isinstance(p, list) else p.split(" ") for p in m["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks = (left << 32 | right)[order], order.astype(np.int32)
        # Where what a merge makes takes part in one of a better rank, merges of equal rank go one at a time.
        first = np.full(max(max(vocab.values()), *self.special.values(), 0) + 1, len(pairs), np.int64)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.single = first[self.made] < np.arange(len(pairs))
        words = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.texts = [words.get(i, "").encode() for i in range(len(first))]

        self.pairs: dict[int, int] = {}
        self.own: Splitter | None = None

    @staticmethod
    def read(path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return Model(f.read())

    def by_pair(self) -> dict[int, int]:
        """Ranks by left << 32 | right."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self.pairs

    def splitter(self) -> Splitter:
        """Made once in each process that asks."""
        if self.own is None:
            self.own = Splitter(self)
        return self.own

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of a and b, -1 where there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


# ---------------------------------------------------------------- exact merging


def merged_with_heap(m: Model, ids: np.ndarray) -> np.ndarray:
    """The symbols of one long word, merged by rank and then from the left."""
    ids, n, ranks = ids.tolist(), len(ids), m.by_pair()
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    rank = m.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(rank.tolist()) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j < 0 or ids[i] != a or ids[j] != b:
            continue
        ids[i], ids[j] = int(m.made[r]), -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0:
                r = ranks.get((ids[x] << 32) | ids[y])
                if r is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return np.array([i for i in ids if i >= 0], np.int32)


def merge(m: Model, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words (none of them empty), one after the other, and their n+1 offsets."""
    size = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sym = m.inner[raw]
    end = np.cumsum(size)
    sym[end - 1] = m.last[raw[end - 1]]
    word = np.repeat(np.arange(len(words)), size)
    done = []
    for k in np.flatnonzero(size > LONG).tolist():
        got = merged_with_heap(m, sym[end[k] - size[k] : end[k]])
        done.append((np.full(len(got), k), got))
    short = np.repeat(size <= LONG, size)
    sym, word = sym[short], word[short]
    none = np.int32(2**31 - 1)
    while len(sym):
        rank = np.full(len(sym), none, np.int32)
        got = m.rank_of(sym[:-1], sym[1:])
        ok = np.flatnonzero((word[:-1] == word[1:]) & (got >= 0))
        rank[ok] = got[ok]
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(start, len(sym)))
        best = np.repeat(np.minimum.reduceat(rank, start), count)
        over = best == none
        if over.any():
            done.append((word[over], sym[over]))
            sym, word, rank, best = sym[~over], word[~over], rank[~over], best[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == best)
        # Of pairs that overlap, every other one from the left.
        run = np.append(True, np.diff(hit) != 1)
        begin = np.flatnonzero(run)
        hit = hit[(np.arange(len(hit)) - begin[np.cumsum(run) - 1]) % 2 == 0]
        again = np.append(False, word[hit][1:] == word[hit][:-1]) & m.single[rank[hit]]
        hit = hit[~again]
        sym[hit] = m.made[rank[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, word = sym[keep], word[keep]
    if not done:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
    by = np.argsort(word, kind="stable")
    return ids[by].astype(np.int32), np.searchsorted(word[by], np.arange(len(words) + 1))


# ---------------------------------------------------------------- the transducer


def compiled(entries: list[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """The minimal transducer of sorted distinct (word, ids) as one array of 32-bit numbers.

    Words come in order, so only the states along the last word can still change: a new
    word freezes those beyond what it shares with the last one, each replaced by an equal
    frozen one if there is one.  Along the shared part, ids that both words do not begin
    with move on to the states behind.
    """
    known: dict[tuple, int] = {}
    frozen: list[tuple] = []
    path: list[dict] = [{"arcs": {}, "final": None}]  # arcs: byte -> [target, ids]; the target of the last one is open
    last = b""

    def freeze(state: dict) -> int:
        form = (state["final"], tuple((b, to, ids) for b, (to, ids) in state["arcs"].items()))
        if form not in known:
            known[form] = len(frozen)
            frozen.append(form)
        return known[form]

    def close(down_to: int):
        while len(path) > down_to + 1:
            at = freeze(path.pop())
            path[-1]["arcs"][last[len(path) - 1]][0] = at

    for word, ids in entries:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        close(same)
        for k in range(same):
            arc = path[k]["arcs"][word[k]]
            n = 0
            while n < min(len(arc[1]), len(ids)) and arc[1][n] == ids[n]:
                n += 1
            back, arc[1], ids = arc[1][n:], arc[1][:n], ids[n:]
            if back:
                for other in path[k + 1]["arcs"].values():
                    other[1] = back + other[1]
                if path[k + 1]["final"] is not None:
                    path[k + 1]["final"] = back + path[k + 1]["final"]
        for k in range(same, len(word)):
            path[k]["arcs"][word[k]] = [-1, ids]
            ids = ()
            path.append({"arcs": {}, "final": None})
        path[-1]["final"] = ids  # of a word that ends where the last one's states are closed, what is left of its ids
        last = word
    close(0)
    root = freeze(path[0])
    return packed(frozen, root)


def packed(states: list[tuple], root: int) -> np.ndarray:
    """States in a double array: the arc of state s with byte b lies at base[s] + b, where owner tells s."""
    pool: list[int] = []
    placed: dict[tuple, int] = {}

    def put(ids: tuple) -> int:
        if ids not in placed:
            placed[ids] = len(pool)
            pool.extend(ids)
        return placed[ids]

    base = np.zeros(len(states), np.int32)
    room = 1024 + 2 * sum(len(arcs) for _, arcs in states)
    used = np.zeros(room, bool)
    owner, target, out_at, out_n = (np.full(room, -1, np.int32) for _ in range(4))
    final_at, final_n = np.full(len(states), -1, np.int32), np.full(len(states), -1, np.int32)
    low = 256  # all slots below are taken, or never are
    for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
        final, arcs = states[s]
        if final is not None:
            final_at[s], final_n[s] = put(final), len(final)
        if not arcs:
            continue
        labels = np.array([b for b, _, _ in arcs])
        while used[low]:
            low += 1
        # The first place where all of the state's arcs are free, in windows of slots.
        window, at = low, -1
        while at < 0:
            if window + 2048 >= len(used):
                grow = np.full(len(used) + 2048, -1, np.int32)
                used = np.append(used, np.zeros(len(grow), bool))
                owner, target, out_at, out_n = (np.append(x, grow) for x in (owner, target, out_at, out_n))
            free = window + np.flatnonzero(~used[window : window + 1024]) - labels[0]
            fits = free[~used[free[:, None] + labels].any(1)]
            at, window = int(fits[0]) if len(fits) else -1, window + 1024
        base[s] = at
        used[at + labels] = True
        for b, to, ids in arcs:
            owner[at + b], target[at + b], out_at[at + b], out_n[at + b] = s, to, put(ids), len(ids)
    room = int(np.flatnonzero(used).max()) + 257 if used.any() else 256  # every base + byte lies within
    head = np.array([root, len(states), room, len(pool)], np.int32)
    return np.concatenate([head, base, final_at, final_n, owner[:room], target[:room], out_at[:room], out_n[:room], np.array(pool, np.int32)])


class Lexicon:
    """A transducer mapped from its file."""

    def __init__(self, data: np.ndarray):
        self.root, states, room, pool = data[:4].tolist()
        cuts = np.cumsum([4, states, states, states, room, room, room, room, pool])
        self.base, self.final_at, self.final_n, self.owner, self.target, self.out_at, self.out_n, self.pool = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.states = states

    @staticmethod
    def mapped(path: str) -> Lexicon:
        return Lexicon(np.memmap(path, np.int32, "r"))

    def look_up(self, buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words buf[start : start + size] at once: which are held, and the spans (word, at, n) of their ids in pool, in order."""
        held = np.zeros(len(starts), bool)
        order = np.argsort(-size, kind="stable")  # the words still running stand in front
        running = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), "left")
        state = np.full(len(starts), self.root, np.int32)
        begin = starts[order]
        alive = np.ones(len(starts), bool)
        found = []
        for k, n in enumerate(running.tolist()):
            go = np.flatnonzero(alive[:n])
            slot = self.base[state[go]] + buf[begin[go] + k]
            ok = self.owner[slot] == state[go]
            alive[go[~ok]] = False
            go, slot = go[ok], slot[ok]
            state[go] = self.target[slot]
            says = self.out_n[slot] > 0
            found.append((go[says], self.out_at[slot[says]], self.out_n[slot[says]]))
        end = np.flatnonzero(alive)
        end = end[self.final_n[state[end]] >= 0]
        held[order[end]] = True
        found.append((end, self.final_at[state[end]], self.final_n[state[end]]))
        word, at, n = (np.concatenate([f[k] for f in found]) for k in range(3))
        word = order[word]
        keep = held[word] & (n > 0)
        word, at, n = word[keep], at[keep], n[keep]
        by = np.argsort(word, kind="stable")
        return held, word[by], at[by], n[by]


# ---------------------------------------------------------------- texts to words


class Splitter:
    """Texts to the bytes of their words, as the model's normalizer and splitter have them."""

    def __init__(self, m: Model):
        code = np.arange(0x110000)
        kind = np.full(len(code), OTHER, np.uint8)
        first = {"L": LETTER, "N": NUMBER}
        old = unicodedata.ucd_3_2_0
        for c in code.tolist():
            char = chr(c)
            category = unicodedata.category(char)
            kind[c] = first.get(category[0], OTHER)
            # What joins or moves in NFC has to be old, as the library's tables of that are older than its other ones.
            if category == "Cn" or c > 0xFF and (unicodedata.combining(char) or unicodedata.decomposition(char)) and old.category(char) == "Cn":
                kind[c] = NEW
        kind[WHITE] = GAP
        self.kind = kind
        self.lower = code.astype(np.uint32)
        for c in np.flatnonzero(kind == LETTER).tolist() + list(range(0x2160, 0x2180)) + list(range(0x24B6, 0x24EA)):
            low = chr(c).lower()
            if len(low) == 1:
                self.lower[c] = ord(low)
        self.special = re.compile("|".join(re.escape(t) for t in sorted(m.special, key=len, reverse=True))) if m.special else None
        self.ids, self.raw, self.own = m.special, m.raw, None

    def newer(self, text: str) -> list[bytes]:
        """Words of a text by the library's own tables."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_str(self.raw)
        letter = {c: b for b, c in enumerate(byte_letters())}
        words = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
        return [bytes(letter[c] for c in w) for w, _ in words]

    def split(self, texts: list[str]):
        """Bytes of the texts, start and size of each word, and the word's text; a special token is a word of size 0 with its id."""
        parts, of, specials = [], [], []  # a text without special tokens is one part
        for k, t in enumerate(texts):
            at = 0
            for hit in self.special.finditer(t) if self.special is not None and "<" in t else ():
                parts.append(t[at : hit.start()])
                of.append(k)
                specials.append((len(parts) - 1, self.ids[hit.group()]))
                at = hit.end()
            parts.append(t[at:] if at else t)
            of.append(k)
        given = parts
        parts = [p if p.isascii() else unicodedata.normalize("NFC", p).replace("\u0130", "i\u0307") for p in parts]
        code = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        new = np.unique(np.searchsorted(bounds, np.flatnonzero(self.kind[code] == NEW), "right") - 1).tolist()
        extra = []  # words of parts with newer characters, as the library splits them; the part itself is left out
        if new:
            code = code.copy()
            for p in new:
                code[bounds[p] : bounds[p + 1]] = 0x0A
                extra += [(p, w) for w in self.newer(given[p])]
        code = self.lower[code]
        kind = self.kind[code]
        before = np.append(GAP, kind[:-1])
        begins = (kind != GAP) & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((code == 0x27) & (before != OTHER))
        one, two = code[np.minimum(quote + 1, len(code) - 1)], code[np.minimum(quote + 2, len(code) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for where, n in ((quote[short], 2), (quote[long], 3)):
            begins[where + 1] = False
            begins[where + n] = kind[where + n] != GAP
        width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)
        byte_at = np.append(0, np.cumsum(width))
        buf = np.frombuffer(code.tobytes().decode("utf-32-le").encode(), np.uint8)
        start = np.flatnonzero(begins)
        # A word ends where the next one begins or a gap does.
        stops = np.flatnonzero(begins | ((kind == GAP) & (before != GAP)))
        end = np.append(stops, len(code))[np.searchsorted(stops, start, "right")]
        part = np.searchsorted(bounds, start, "right") - 1
        start, size = byte_at[start], byte_at[end] - byte_at[start]
        ids = np.full(len(start), -1, np.int32)
        if extra or specials:
            buf = np.concatenate([buf, np.frombuffer(b"".join(w for _, w in extra), np.uint8)]) if extra else buf
            more = np.array([len(w) for _, w in extra], np.int64)
            start = np.concatenate([start, byte_at[-1] + np.cumsum(more) - more, np.zeros(len(specials), np.int64)])
            size = np.concatenate([size, more, np.zeros(len(specials), np.int64)])
            ids = np.concatenate([ids, np.full(len(extra), -1, np.int32), np.array([i for _, i in specials], np.int32)])
            part = np.concatenate([part, np.array([p for p, _ in extra], np.int64), np.array([p for p, _ in specials], np.int64)])
            by = np.argsort(part, kind="stable")  # a special token comes after its part's words
            start, size, ids, part = start[by], size[by], ids[by], part[by]
        return buf, start, size, ids, np.array(of, np.int64)[part] if len(part) else part


# ---------------------------------------------------------------- encoding and decoding


def encode(m: Model, splitter: Splitter, lexicon: Lexicon | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after the other, and their n+1 offsets."""
    buf, start, size, special, text = splitter.split(texts)
    words = np.flatnonzero(special < 0)
    spans = [(np.flatnonzero(special >= 0), special[special >= 0])]
    short = words[size[words] <= WORD_BYTES] if lexicon is not None else words[:0]
    if len(short):
        held, word, at, n = lexicon.look_up(buf, start[short], size[short])
        spans.append((np.repeat(short[word], n), lexicon.pool[_span_index(at, n)]))
        rest = np.ones(len(start), bool)
        rest[short[held]] = False
        words = words[rest[words]]
    if len(words):
        raw = buf.tobytes()
        index: dict[bytes, int] = {}
        own = np.array([index.setdefault(raw[a : a + s], len(index)) for a, s in zip(start[words].tolist(), size[words].tolist(), strict=True)], np.int64)
        ids, first = merge(m, list(index))
        n = np.diff(first)[own]
        spans.append((np.repeat(words, n), ids[_span_index(first[own], n)]))
    word, ids = (np.concatenate([s[k] for s in spans]) for k in (0, 1))
    by = np.argsort(word, kind="stable")
    return ids[by].astype(np.int32), np.searchsorted(text[word[by]], np.arange(len(texts) + 1))


def decode(m: Model, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """The texts of ids[first[i] : first[i + 1]]: the tokens' own strings, spaces between."""
    size = np.array([len(t) + 1 for t in m.texts], np.int64)
    pool = np.frombuffer(b"".join(t + b" " for t in m.texts), np.uint8)
    length = size[ids]
    full = np.flatnonzero(np.diff(first))
    length[first[full + 1] - 1] -= 1
    flat = pool[_span_index((np.cumsum(size) - size)[ids], length)]
    bounds = np.append(0, np.cumsum(length))[first]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat))


def counted_words(docs: DataFrame, m: Model, text: str) -> DataFrame:
    """(word, n): how often each word of the texts occurs, as bytes; without those too long for the lexicon."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def count(batches):
        splitter = shared.value.splitter()
        for whole in batches:
            for b in slices(whole, text, 1 << 22):
                buf, start, size, special, _ = splitter.split([t or "" for t in b.column(text).to_pylist()])
                fits = (special < 0) & (size <= WORD_BYTES)
                start, size = start[fits], size[fits]
                flat = buf[_span_index(start, size)]
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int64)), pa.py_buffer(flat)])
                got = words.value_counts()
                yield pa.RecordBatch.from_arrays([got.field(0).cast(pa.binary()), got.field(1)], ["word", "n"])

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def placed(spark: SparkSession, data: np.ndarray) -> str:
    """The name under which each executor finds data as a file: written to the shared folder, brought by Spark when a task needs it."""
    name = f"lexicon-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data.tobytes()))
    out.close()
    spark.sparkContext.addFile(where.toString())
    return name


def lexicon_of(docs: DataFrame, m: Model, text: str = "text", most: int = LEXICON_WORDS) -> np.ndarray | None:
    """The transducer of the texts' frequent words: those of a share of 1/RARE or more, at most so many."""
    counts = written(counted_words(docs, m, text), "words")
    total = counts.agg(F.sum("n")).first()[0]
    # At most RARE words have such a share, so few rows are put in order.
    often = counts.where(F.col("n") * RARE >= F.lit(total or 0)).orderBy(F.desc("n"), "word").limit(most).select("word").toArrow()
    words = sorted(often["word"].to_pylist())
    if not words:
        return None
    ids, first = merge(m, words)
    ids = ids.tolist()
    return compiled([(w, tuple(ids[a:b])) for w, a, b in zip(words, first[:-1].tolist(), first[1:].tolist(), strict=True)])


def tokenized(docs: DataFrame, model: str, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """docs with token_ids, n_tokens and decoded (what decoding the ids gives)."""
    spark = docs.sparkSession
    m = Model.read(model)
    shared = spark.sparkContext.broadcast(m)  # the model's fixed vocabulary
    data = lexicon_of(docs, m, text, most)
    file = placed(spark, data) if data is not None else None
    added = ("token_ids", "n_tokens", "decoded")
    fields = [f for f in docs.schema.fields if f.name not in added]
    kept = [f.name for f in fields]

    def run(batches):
        m = shared.value
        splitter, lexicon = m.splitter(), Lexicon.mapped(SparkFiles.get(file)) if file else None
        for whole in batches:
            for b in slices(whole, text):
                texts = b.column(text)
                ids, first = encode(m, splitter, lexicon, [t or "" for t in texts.to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                decoded = decode(m, ids, first).cast(pa.string())
                if texts.null_count:
                    decoded = pa.compute.if_else(texts.is_null(), pa.scalar(None, pa.string()), decoded)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists, pa.array(np.diff(first).astype(np.int32)), decoded], [*kept, *added])

    schema = StructType([*fields, StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("decoded", StringType())])
    return docs.mapInArrow(run, schema)
