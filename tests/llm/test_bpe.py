"""The transducer against the tokenizers library and against itself in pieces of any size."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from allelio.llm import bpe

PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "1", "é", "<|endoftext|>", "<|endo", "!", "aaaaaaaaaa", "the", "tion", " \t", "　", "中", "\x1c", "👍"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def texts(n, longest=60):
    rnd = random.Random(5)
    for _ in range(n):
        some = [rnd.choice(PARTS) for _ in range(rnd.randint(2, 8))]
        yield "".join(rnd.choice(some) for _ in range(rnd.randint(0, longest)))


def in_pieces(vocabulary, text, limit, size):
    encoder = bpe.Encoder(vocabulary, limit=limit)
    packed = [x for at in range(0, len(text), size) for x in encoder.feed(text[at : at + size])]
    return np.frombuffer(b"".join([*packed, *encoder.finish()]), "<u4").tolist()


def test_equals_the_library(vocabulary, library):
    for text in texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(vocabulary, text).tolist() == want, text
        for limit, size in ((16, 1), (16, 7), (64, 1000)):
            assert in_pieces(vocabulary, text, limit, size) == want, (text, limit, size)
        assert "".join(bpe.decode(vocabulary, np.array(want, "<u4"), step=2)) == text


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 90_000 + "x", "!?" * 20_000, "\n" * 80_001, "x" * 70_000 + "   " + "'s" * 40_000, "é" * 70_000])
def test_long_words_keep_a_small_window(vocabulary, library, text):
    assert bpe.encode(vocabulary, text).tolist() == library.encode(text, add_special_tokens=False).ids
    stream = bpe.WordStream(vocabulary)
    for at in range(0, len(text), 5000):
        list(stream.feed(text[at : at + 5000].encode()))
        assert len(stream.held) <= 4 * vocabulary.lookahead + 64


def test_words_together_and_alone(vocabulary):
    rnd = random.Random(8)
    words = [bytes(rnd.choice(b"aab ethionsg\xc3\xa9") for _ in range(rnd.randint(1, 60))) for _ in range(4000)] + [b"a" * n for n in range(1, 64)]
    assert [np.frombuffer(p, "<u4").tolist() for p in vocabulary.encode_words(words)] == [vocabulary.encode_word(w) for w in words]
    assert vocabulary.encode_words([]) == []
    some = [*texts(600), "", "plain words, joined. by single spaces\nand lines", "a " + "long" * 40 + " word", "x"]
    known = bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path()))
    assert [i.tolist() for i in known.encode_texts(some)] == [bpe.encode(vocabulary, t).tolist() for t in some]


def test_chunks_met_again_stay(vocabulary, monkeypatch):
    known = bpe.Vocabulary(bpe.vocabulary_text(bpe.default_path()))
    monkeypatch.setattr(bpe, "TABLE", 50)
    encoded, plain = [], known.encode_chunks
    monkeypatch.setattr(known, "encode_chunks", lambda names: encoded.append(names) or plain(names))
    for turn in range(30):
        some = [f"the cat sat on mat, {turn}. " + " ".join(f"w{turn}x{i}" for i in range(10)), "x " + "y" * 70 + f" é{turn} -- " + "z" * 200 + ". end"]
        assert [i.tolist() for i in known.encode_texts(some)] == [bpe.encode(vocabulary, t).tolist() for t in some]
    assert sum("cat" in names for names in encoded) == 1 and len(encoded) == 30
    assert len(known.table.sizes) < 100 and set(known.table.places.values()) <= set(range(len(known.table.sizes)))
    monkeypatch.setattr(bpe, "TABLE", 4)  # more are met again than may stay
    for _ in range(3):
        assert [i.tolist() for i in known.encode_texts(some)] == [bpe.encode(vocabulary, t).tolist() for t in some]


def test_lookahead_is_sufficient_and_counts_chains():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    # bc, then ab only if no bc, then za only if no ab: the end decides three tokens back.
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b"), (b"z", b"a")]) == 3
    assert bpe.sufficient_lookahead([(b"z", b"a"), (b"a", b"b"), (b"b", b"c")]) == 1


def test_lookahead_on_random_lists():
    rnd = random.Random(3)
    for _ in range(60):
        pieces, rules = [b"a", b"b", b"c"], []
        for _ in range(12):
            pair = (rnd.choice(pieces), rnd.choice(pieces))
            if pair[0] + pair[1] not in pieces:
                rules.append(pair)
                pieces.append(pair[0] + pair[1])
        alphabet = {b: c for c, b in bpe.byte_alphabet().items()}
        show = lambda p: "".join(alphabet[b] for b in p)
        every = [*[bytes([b]) for b in range(256)], *[p for p in pieces if len(p) > 1]]
        import json

        vocabulary = bpe.Vocabulary(json.dumps({"model": {"vocab": {show(p): i for i, p in enumerate(every)}, "merges": [[show(a), show(b)] for a, b in rules]}}))
        for _ in range(40):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 300)))
            stream = bpe.WordStream(vocabulary)
            packed = [x for at in range(0, len(word), 9) for x in stream.feed(word[at : at + 9])]
            assert np.frombuffer(b"".join([*packed, *stream.finish()]), "<u4").tolist() == vocabulary.encode_word(word)


def test_a_list_out_of_order_is_refused():
    alphabet = {b: c for c, b in bpe.byte_alphabet().items()}
    import json

    vocab = {alphabet[b]: b for b in range(256)} | {"ab": 256, "abc": 257}
    with pytest.raises(ValueError, match="earlier"):
        bpe.Vocabulary(json.dumps({"model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]]}}))


def test_broken_bytes_become_replacements(vocabulary):
    ids = [vocabulary.first[b] for b in b"a\xe4\xb8"]
    assert "".join(bpe.decode(vocabulary, np.array(ids))) == "a�"


def test_round_trip_rows(spark, library):
    rows = [(1, "Hello world <|endoftext|> x"), (2, None), (3, ""), (1, "Hello world <|endoftext|> x"), (None, "é" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("x"))
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0)).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(docs)).select("text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)
