import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe

SCHEMA = "doc_id long, text string"
ODD = ["", " ", "a", "aaaa" * 50, "Hello, world! don't we'll I'M", "  two  spaces \n\n tab\t end ", "éàü ß 漢字 🙂🙂 ñ", "12345 6.7e8", "<|endoftext|> x", "x" * 5000, "ab" * 3000 + " tail", "  mixed ", "a\r\nb"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def oracle(ranks):
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merges_are_the_tokenizer_s(ranks, oracle):
    r = random.Random(3)
    for n in (1, 2, 3, 10, 63, 64, 65, 66, 200, 900):
        for alphabet in ("ab", "abcdefgh ", "eé", "thenrsai"):
            w = "".join(r.choice(alphabet) for _ in range(n))
            assert bpe.merge(w.encode(), ranks) == bpe._merge_long(w.encode(), ranks) == oracle.encode_single_piece(w.encode()) if hasattr(oracle, "encode_single_piece") else True
            assert bpe.merge(w.encode(), ranks) == bpe._merge_long(w.encode(), ranks) == oracle._core_bpe.encode_single_piece(w.encode())


def test_encoder_equals_tokenizer_with_any_lexicon(ranks, oracle):
    words = [w for t in ODD for w in bpe._splitter()(t)]
    for some in ([], words[::2], words):
        lexicon = bpe.Lexicon.build({w.encode(): bpe.merge(w.encode(), ranks) for w in some if len(w.encode()) <= bpe.WORD_BYTES}) if some else None
        ids, at = bpe.Encoder(ranks, lexicon).encode(ODD)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [oracle.encode_ordinary(t) for t in ODD]


def test_lexicon_is_minimal_and_exact(tmp_path):
    r = random.Random(5)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode() for _ in range(400)})
    entries = {w: [i, i + 1] for i, w in enumerate(words)}
    (tmp_path / "l").write_bytes(bpe.Lexicon.build(entries).dump())
    lex = bpe.Lexicon.mapped(str(tmp_path / "l"))
    probes = words + [b"zzz", b"a" * 60, b"abcabcab", b""]
    offsets = np.r_[0, np.cumsum([len(p) for p in probes])]
    got = lex.find(np.frombuffer(b"".join(probes), np.uint8), offsets)
    want = [words.index(p) if p in entries else -1 for p in probes]
    assert got.tolist() == want
    assert lex.ids[lex.offsets[3] : lex.offsets[4]].tolist() == [3, 4]
    # states of a minimal automaton: distinct sets of endings
    ends = {}
    for w in words:
        for i in range(len(w) + 1):
            ends.setdefault(w[:i], set()).add(w[i:])
    assert len(lex.final) == len({frozenset(x) for x in ends.values()})


def test_table_round_trip(spark, oracle):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, ODD[4]), (None, "no id"), (99, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("token_ids", F.lit("clash"))
    out = bpe.encoded(docs)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((i, 0, None, None) if t is None else (i, len(x := oracle.encode_ordinary(t)), x, True) for i, t in rows), key=repr)
    assert got == want
    assert sorted((tuple(r) for r in bpe.decoded(out).collect()), key=repr) == sorted(rows, key=repr)


def test_decoding_odd_ids(spark):
    t = spark.createDataFrame([(1, [10**6, -1, None]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert sorted(tuple(r) for r in bpe.decoded(t).collect()) == [(1, ""), (2, None), (3, "")]


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bpe.decoded(spark.createDataFrame([], "doc_id long, token_ids array<int>")).count() == 0


def test_frequent_words_counts_every_text(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "b"), (3, None), (4, "a")], SCHEMA)
    assert {r["word"]: r["n"] for r in bpe.word_counts(docs).collect()} == {"b": 2, " a": 1, " b": 1, "a": 1}
    more = spark.createDataFrame([(i, "x y" * (1 + i % 3) + " often" * i) for i in range(200)], SCHEMA)
    counts = {r["word"]: r["n"] for r in bpe.word_counts(more).collect()}
    for most in (0, 1, 2, 4, 100):
        got = bpe.frequent_words(more, most)
        assert len(got) <= most and got == sorted(got)
        assert not got or min(counts[w] for w in got) >= max([n for w, n in counts.items() if w not in got and n > 1], default=0)
    assert bpe.frequent_words(more, 1) == [" often"] and set(bpe.frequent_words(more, 100)) == {w for w, n in counts.items() if n > 1}


def test_a_long_text(spark, oracle):
    text = "word and " * 60_000 + "z" * 40_000
    got = bpe.encoded(spark.createDataFrame([(1, text), (2, "z" * 40_000)], SCHEMA)).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == {1: oracle.encode_ordinary(text), 2: oracle.encode_ordinary("z" * 40_000)} and all(r["exact"] for r in got)
