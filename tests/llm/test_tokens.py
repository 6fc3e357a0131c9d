"""Encoding, counts and files against the public libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm.bpe import digests, encode_decode, load
from shelfspark.llm.token_counts import load as load_counter
from shelfspark.llm.token_counts import token_counts
from shelfspark.llm.token_files import Encoder, read_token_files, write_token_files
from tests.llm.tables import empty_table, hard_cases, hard_table

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def odd_texts(n=1500):
    pick = random.Random(7)
    letters = list("aAbB'sdtvelmrΣσςİıſKﬁé̈é한 \t\n\r\x1c\x85\xa0 　​12²½٣_▁ !?.😀\x00ǅ")
    letters += ["<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<0x0A>", "'re", "  "]
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 25))) for _ in range(n)]


def test_encoder_is_the_library(library):
    own, files = load(WORD), Encoder(WORD)
    texts = odd_texts()
    for text, flat in zip(texts, files.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert np.frombuffer(flat, files.type).tolist() == want


def test_latin_texts_have_few_runs(library):
    """Case and marks behind letters make no runs of their own, and ids are the library's."""
    files = Encoder(WORD)
    (flat,) = files.encode(["Étude étude, ÉTUDE. étude! (étude"])
    assert set(files.known) == {"étude", ",", ".", "!", "(étude"}
    pick = random.Random(9)
    letters = [*map(chr, range(256)), *".,!?%$&*#|<'œ€İΣ", "<|ENDOFTEXT|>", "<|endoftext|>", "Word", "'re", "###"]
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    for text, flat in zip(texts, files.encode(texts)):
        assert np.frombuffer(flat, files.type).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_any_text_is_counted_right(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert load_counter(PIECE).count([text]) == [len(model.encode(text))]


def test_counts_are_the_library(pieces):
    texts = odd_texts()
    assert load_counter(PIECE).count(texts) == [len(x) for x in pieces.encode(texts)]


def test_digests_of_hard_cases(spark, library):
    got = digests(encode_decode(hard_table(spark), WORD)).collect()
    want = []
    for doc_id, text, *_ in hard_cases():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_counts_of_hard_cases(spark, pieces):
    got = token_counts(hard_table(spark), PIECE, limit=5).collect()
    want = []
    for doc_id, text, *_ in hard_cases():
        n = len(pieces.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 5))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_files_round_trip(spark, library, tmp_path):
    manifest = write_token_files(hard_table(spark).repartition(3), WORD, f"file:{tmp_path}", end_id=2)
    got = read_token_files(manifest, f"file:{tmp_path}").collect()
    by_place = sorted(got, key=lambda r: r.start)
    ids = [r.doc_id for r in by_place]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in by_place] == [sum(r.n_tokens for r in by_place[:i]) for i in range(len(by_place))]
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in hard_cases()]
    assert sorted(str((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in got) == sorted(map(str, want))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got)
    assert not [p for p in tmp_path.iterdir() if p.suffix not in (".ids", ".offsets", ".docs")]


def test_empty(spark, tmp_path):
    assert encode_decode(empty_table(spark), WORD).collect() == []
    assert token_counts(empty_table(spark), PIECE).collect() == []
    manifest = write_token_files(empty_table(spark), WORD, f"file:{tmp_path}")
    assert read_token_files(manifest, f"file:{tmp_path}").collect() == []
