"""Piece encoding against the library and against plain dynamic programming; decoding as a round trip."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gravelbed.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def ids_of(model, texts):
    ids, sizes = pieces.Encoder(model).encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_are_the_librarys_on_the_whole_table(spark, sf_dir, library):
    rows = pieces.op9_pieces(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    assert {r["doc_id"]: r["tokens"] for r in rows} == {i: library.encode(t) for i, t in texts.items()}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinrst▁ \nTh.ĥ漢🙂1", max_size=40))
def test_random_words_are_the_librarys(model, library, text):
    assert ids_of(model, [text]) == [library.encode(text)]
    assert pieces.decode(model, library.encode(text)) == text.replace("▁", " ")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.floats(-9, -0.5), min_size=1))
def test_unigram_scores_give_the_best_path(text, scores):
    words = list(scores)
    codes = np.zeros((len(words), 4), np.uint32)
    for row, w in zip(codes, words, strict=True):
        row[: len(w)] = [*map(ord, w)]
    keys = np.array([pieces._prefix_hashes(np.array([[*map(ord, w)]], np.uint32))[0, -1] for w in words], np.uint64)
    order = np.argsort(keys)
    p = pieces.Pieces(keys[order], pieces._sieve(keys[order]), order, codes, np.arange(len(words), dtype=np.int32), np.array([scores[w] for w in words]), 4, -20.0, [], [], False, True, None)
    got, n = pieces.viterbi(p, np.array([[*map(ord, text)]] * 2, np.uint32))
    assert n[0] == n[1] and got[: n[0]].tolist() == got[n[0] :].tolist()
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[end - k] + scores[text[end - k : end]] for k in range(1, min(4, end) + 1) if text[end - k : end] in scores]
        best.append(max([*ways, best[end - 1] - 20.0] if text[end - 1] not in scores else ways))
    assert sum(scores[words[i]] if i >= 0 else -20.0 for i in got[: n[0]].tolist()) == pytest.approx(best[-1])


def test_long_words_and_blocks_of_positions(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "POSITIONS", 64)
    texts = ["thereisnospaceinhere" * 200, " " * 70 + "x" + " " * 33, "", "漢" * 100, "ab\n\ncd"]
    assert ids_of(model, texts) == [library.encode(t) for t in texts]


def test_nulls_and_clashing_names(spark, model):
    rows = spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3), (2, None, None, None), (None, "", "y", 0)], "doc_id long, text string, tokens string, n_tokens int")
    got = pieces.encoded(rows, model).collect()
    assert got[0] == got[1] and [r["n_tokens"] for r in got] == [2, 2, 0, 0] and got[2]["tokens"] == []
    assert [r["decoded"] for r in pieces.decoded(pieces.encoded(rows, model), model).collect()] == ["a b", "a b", "", ""]
    assert pieces.encoded(rows.limit(0), model).count() == 0


def test_pairs_met_before_are_not_undone_again(model, library, monkeypatch):
    asked = []
    monkeypatch.setattr(pieces, "stays_apart", lambda m, one, two, f=pieces.stays_apart: asked.append(len(one)) or f(m, one, two))
    encoder, texts = pieces.Encoder(model), [[f"{a}{b}{c}" for a in part for b in "aeiou" for c in ("ring", "rings", "red")] for part in ("bcdfg", "hklmn")]
    for i in range(2):
        ids, sizes = encoder.encode([f"re{t}able" for t in texts[i]] + [f"un{t}ness" for t in texts[i]])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(x.format(t)) for x in ("re{}able", "un{}ness") for t in texts[i]]
    before = sum(asked)
    encoder._reset()
    encoder.encode([f"re{t}able" for t in texts[0] + texts[1]])
    assert sum(asked) - before < before / 10


def test_keys_that_share_a_place_are_told_apart():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 200_000).astype(np.uint64))
    sieve = pieces._sieve(keys)
    assert (sieve.after >= 0).sum() > 1000
    which, row = pieces._found(keys, sieve, np.concatenate([keys[::-1], keys + np.uint64(1)]))
    assert np.array_equal(which[: len(keys)], np.arange(len(keys))) and np.array_equal(row[: len(keys)], np.arange(len(keys))[::-1])
    assert np.isin(keys[row[len(keys) :]], keys + np.uint64(1)).all()


def test_a_worker_holds_a_bounded_number_of_words(model):
    encoder = pieces.Encoder(model)
    for i in range(0, 400_000, 20_000):
        encoder.encode([" ".join(map(str, range(1_000_000 + i, 1_020_000 + i)))])
        assert len(encoder.index) == len(encoder.sizes) <= 120_000
