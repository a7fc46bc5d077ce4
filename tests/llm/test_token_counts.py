import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import shingles
from panelweave.llm.token_counts import count_ids, resynchronised_ids, token_counts
from panelweave.llm.tokens import Encoder, encoder, load

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = load(PATH)
ODD = "a é é ̈x Σς ΣΑΣ <|endoftext|>b don't I'LL 12\t3\x0b4  z \x1cq 中文 🙂🙂 ,.! ".split(" ") + [" ", "\n", "  ", "\t"]


def test_known_word_pattern_is_recognised():
    assert encoder(PATH).plain and not encoder(BYTES).plain


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.sampled_from("abenß éÀ×÷ªµ²")), max_size=40))
def test_western_pieces(text):
    assert np.frombuffer(encoder(PATH).encode([text])[0], dtype="<u4").tolist() == plain(text)


def test_each_letter_at_every_place_of_a_word():
    text = " ".join(f"a{c}b {c} en{c} {c}er" for c in map(chr, range(0x21, 0x500)))
    assert np.frombuffer(encoder(PATH).encode([text])[0], dtype="<u4").tolist() == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["don't", "I'LL", "'s", "''re", "a'b", "’tis", "<b>", "x<|y", "ÀÉ'd", "5'6", "word,", "\t", " ", "\n", "e\u0301", "é"]), max_size=12))
def test_plain_stretches_beside_odd_pieces(parts):
    for text in (" ".join(parts), "".join(parts)):
        assert np.frombuffer(encoder(PATH).encode([text])[0], dtype="<u4").tolist() == plain(text)


def test_plain_text_is_learned_by_its_runs_and_only_odd_pieces_by_the_whole_chain():
    enc = Encoder(PATH)
    text = "word, Word. word! ’word don't word\n"
    assert np.frombuffer(enc.encode([text])[0], dtype="<u4").tolist() == plain(text)
    assert set(enc.memo) == {"’word"} and set(enc.runs) == {"word", ",", ".", "!", "don", "'t"}


def plain(text, tokenizer=PLAIN):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=6)), max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder(PATH).encode([text])[0], dtype="<u4").tolist() == plain(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([w + s for w in ODD + ["word", "more"] for s in ("", " ", "\n")]), max_size=120), st.sampled_from([7, 20, 64]), st.sampled_from([2, 6]))
def test_chunks_give_the_ids_of_the_whole_text(parts, chunk, overlap):
    text = "".join(parts)
    for tokenizer in (PLAIN, encoder(BYTES).tokenizer):
        got = np.concatenate(list(resynchronised_ids(tokenizer, text, chunk, overlap))).tolist()
        assert got == plain(text, tokenizer)


@pytest.mark.parametrize("overlap", [2, 6])
def test_a_special_string_longer_than_a_chunk(overlap):
    for k in range(20):
        text = "a" * k + "é 12\t3\x0b4\xa0 z\n\n<|endoftext|>b"
        for tokenizer in (PLAIN, encoder(BYTES).tokenizer):
            got = np.concatenate(list(resynchronised_ids(tokenizer, text, 7, overlap))).tolist()
            assert got == plain(text, tokenizer)


def test_text_without_spaces_widens_to_the_whole():
    text = "x" * 5000
    assert np.concatenate(list(resynchronised_ids(PLAIN, text, 64, 8))).tolist() == plain(text)


@pytest.mark.parametrize("path", [BYTES, public_tokenizers.path("piece_bpe_32k.model")])
def test_other_tokenizers(path):
    text = "Some words, and  more.\n" * 3
    if path.endswith(".model"):
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    else:
        want = len(plain(text, load(path)))
    assert count_ids(path, [text, ""], huge=20, chunk=16, overlap=4) == [want, 0]


def test_edge_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "word " * 3000, 7), (3, "word " * 3000, 7), (None, "é", 7)]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH, huge=1000, chunk=300, overlap=40)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 15000, 3000, True), (3, 15000, 3000, True), (None, 2, len(plain("é")), False)], key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_a_worker_frees_its_word_hashes_for_the_encoder():
    shingles.shingle_set("hashes of words")
    assert shingles._MEMO
    encoder(PATH)
    assert not shingles._MEMO
