"""Word BPE against the tokenizers library: texts, single characters, long words, the transducer itself."""

import hashlib
import random

import numpy as np
import pytest

from pagemill.llm import queries, wordbpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"aAbB'sStTdmrelvLIİıſΣς 0129²½ \n\t\x85\xa0.,!?<>|\"éÉé中文字한글가ǅ𝄞", "Ᲊ", "Ɤ", "\U000105c0", "࢙࢘", "é", "<|endoftext|>", "<|startoftext|>", "<|other|>", "'re", "'ve", "'ll", "'D", "the ", "The", "don't"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return wordbpe.Model.read(PATH)


def lexicon(model, words):
    ids, first = wordbpe.merge(model, words)
    return wordbpe.Lexicon(wordbpe.compiled([(w, tuple(ids[a:b].tolist())) for w, a, b in zip(words, first[:-1], first[1:], strict=True)]))


def same(model, library, texts, words=None):
    got, first = wordbpe.encode(model, model.splitter(), lexicon(model, words) if words else None, texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for k, t in enumerate(texts):
        assert got[first[k] : first[k + 1]].tolist() == want[k], ascii(t[:200])
    assert wordbpe.decode(model, got, first).to_pylist() == library.decode_batch(want, skip_special_tokens=False)


def test_random_texts(model, library):
    rng = random.Random(9)
    same(model, library, ["".join(rng.choices(PARTS, k=rng.randrange(50))) for _ in range(3000)], sorted({b"the", b"don", b"then", b"a", b"aab", "é".encode()}))


def test_every_character(model, library):
    code = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    same(model, library, [chr(c) for c in code if c % 3 == 0] + ["".join(map(chr, code[k : k + 100])) for k in range(0, len(code), 100)])


def test_long_words(model, library):
    rng = random.Random(1)
    same(model, library, ["w" * 5000, "abc" * 3000, "x" * 256, "x" * 257, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "", "é" * 300])


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_transducer(model, n):
    rng = random.Random(n)
    words = sorted({bytes(rng.choices(b"abcde\x00\xff", k=rng.randrange(1, 9))) for _ in range(n)})
    held = lexicon(model, words)
    ids, first = wordbpe.merge(model, words)
    others = [bytes(rng.choices(b"abcdef\x00\xff", k=rng.randrange(1, 10))) for _ in range(500)]
    asked = words + others
    size = np.array([len(w) for w in asked])
    got, word, at, many = held.look_up(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [w in set(words) for w in asked]
    for k in range(len(words)):
        mine = [held.pool[a : a + m].tolist() for a, m in zip(at[word == k], many[word == k], strict=True)]
        assert sum(mine, []) == ids[first[k] : first[k + 1]].tolist()


def test_transducer_is_minimal(model):
    """Words with the same endings share their states: far fewer than letters."""
    words = sorted(f"{a}{b}ation".encode() for a in "bcdfgh" for b in "klmnp")
    one = wordbpe.compiled([(w, (7,)) for w in words])
    # The root, one state behind all first letters, and one for each letter of the ending, the last one included.
    assert wordbpe.Lexicon(one).states == 1 + 1 + len("ation") + 1


def test_query(spark, sf_dir, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_word_bpe(spark, sf_dir).collect()}
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert got[d.doc_id] == (len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)


def test_odd(spark, library):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "The the THE"), (5, "The the THE"), (6, "é𝄞 " * 50), (7, "w" * 50_000), (8, "x <|endoftext|> y"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "old", 9) for i, t in rows], "doc_id long, text string, decoded string, words int")
    for most in (0, 2, wordbpe.LEXICON_WORDS):
        got = wordbpe.tokenized(df, PATH, most=most)
        assert got.columns == ["doc_id", "text", "words", "token_ids", "n_tokens", "decoded"]
        for r in got.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == (None if r.text is None else library.decode(ids, skip_special_tokens=False))
        assert got.count() == len(rows)
    assert wordbpe.tokenized(df.where("false"), PATH).count() == 0


def test_other_models_are_refused():
    raw = open(PATH, encoding="utf-8").read()
    with pytest.raises(ValueError, match="not a byte-level"):
        wordbpe.Model(raw.replace('"Lowercase"', '"Uppercase"', 1))
