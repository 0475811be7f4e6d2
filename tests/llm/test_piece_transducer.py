import itertools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from etlvault.llm.piece_transducer import BYTE, MERGES, MODEL_PATH, NORMAL, UNIGRAM, UNKNOWN, PieceTransducer, decode, encode, load_model

needs_model = pytest.mark.skipif(not os.path.exists(MODEL_PATH), reason="no model file")


@pytest.fixture(scope="module")
def fst():
    return PieceTransducer.from_model(load_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


@needs_model
@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("abé ▁.,²m\n\t01<s>", max_size=60))
def test_same_ids_as_the_library(fst, library, text):
    assert fst.encode(text) == library.encode(text)
    assert fst.decode(fst.encode(text)) == library.decode(library.encode(text))


@needs_model
def test_long_texts(fst, library):
    rng = random.Random(5)
    for alphabet in ("abcdefgh", "the quick brown fox, ", "aA ", "日本語éö "):
        text = "".join(rng.choice(alphabet) for _ in range(4000))
        assert fst.encode(text) == library.encode(text)
        assert fst.decode(fst.encode(text)) == text


def test_unigram_path_is_the_cheapest():
    pieces = [("<unk>", 0.0, UNKNOWN), *((f"<0x{b:02X}>", -20.0, BYTE) for b in range(256)),
              ("a", -2.0, NORMAL), ("b", -2.5, NORMAL), ("ab", -3.9, NORMAL), ("ba", -3.0, NORMAL), ("aba", -5.0, NORMAL), ("bb", -4.0, NORMAL)]
    fst = PieceTransducer(pieces, UNIGRAM, dummy_prefix=False)
    costs = {t: -s for t, s, k in pieces if k == NORMAL}

    def brute(text):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[last:i])
                    last = i
            parts.append(text[last:])
            if all(p in costs for p in parts):
                cost = sum(costs[p] for p in parts)
                best = cost if best is None else min(best, cost)
        return best

    for text in ("".join(t) for n in range(1, 8) for t in itertools.product("ab", repeat=n)):
        assert abs(sum(costs[p] for p in fst.shortest_path(text)) - brute(text)) < 1e-9
    assert fst.decode(fst.encode("azb")) == "azb"


def test_merges_of_a_small_model():
    pieces = [("<unk>", 0.0, UNKNOWN), ("a", -9.0, NORMAL), ("b", -9.0, NORMAL), ("ab", -1.0, NORMAL), ("ba", -2.0, NORMAL), ("aba", -3.0, NORMAL), ("bab", -4.0, NORMAL), ("aab", -5.0, NORMAL)]
    fst = PieceTransducer(pieces, MERGES, dummy_prefix=False)
    for text in ("".join(t) for n in range(1, 11) for t in itertools.product("ab", repeat=n)):
        assert fst.shortest_path(text) == fst._merged(text)


@needs_model
def test_columns(spark, library):
    texts = ["Hello  world", "", None, "x\ny", "é𝄞 ", "word " * 30_000, "x\ny"]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_ids int")
    got = {r.doc_id: r for r in decode(encode(docs, load_model()), load_model()).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert (r.ids, r.n_ids, r.lossless, r.decoded) == (None, 0, True, None)
        else:
            assert (r.ids, r.n_ids, r.lossless, r.decoded) == (library.encode(t), len(library.encode(t)), True, t)
    assert encode(docs.limit(0), load_model()).count() == 0
