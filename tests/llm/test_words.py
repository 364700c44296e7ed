"""Tokenizing by words: short ways give the plain tokenizer's ids."""

import random

import numpy as np
import pytest

from dataheal.llm import packing


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_marks_after_a_word_are_not_new_words(path):
    encoder = packing.Encoder(path)
    encoder.encode([b"house house. house, house: house; HOUSE! house?"])
    assert b"house" in encoder.ids and not any(w.startswith(b"house") and w != b"house" for w in encoder.ids)


def test_ids_are_the_plain_tokenizers(path):
    from tokenizers import Tokenizer

    r, letters = random.Random(5), "abAB.,;:!?'’ éÉßẞ̸́<>|3½_-\n\t\xa0　İıſµ漢"
    texts = ["", "don't. o's, 'S.", "a.b.,; c", "<|endoftext|>. x", "á. ½; 12:30;", "x.̸ x!̸", "ÿŸ. Å; ŉ."]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    plain = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    assert packing.Encoder(path).encode([t.encode() for t in texts]) == [np.array(e.ids, "<u4").tobytes() for e in plain]


def test_a_full_cache_still_gives_ids(path, monkeypatch):
    texts = [b"one two. three, one", b"four five. two, one."]
    whole = packing.Encoder(path).encode(texts)
    monkeypatch.setattr(packing, "HELD", 3)
    small = packing.Encoder(path)
    assert [small.encode([t])[0] for t in texts] == whole and len(small.ids) <= 3


def test_marks_of_all_kinds_after_letters_of_all_kinds_are_not_new_words(path):
    encoder = packing.Encoder(path)
    encoder.encode(["café, café. CAFÉ! maison%%% maison### 12) maison&&&, ü* <|endoftext|> <|endoftext|>, a|>".encode()])
    held = {w.decode().lower() for w in encoder.ids}
    assert {"café", "maison", "12", "ü", "%%%"} <= held and not any(w[0].isalnum() and w.rstrip(",.!%#)&*") != w for w in held)


def test_letter_words_are_spelled_many_in_a_call(path, monkeypatch):
    from tokenizers import Tokenizer

    r, letters, calls = random.Random(6), "abcéÉßxyzÿAZ0<|>#*%&$\"'()[]{}@/\\^`~!?.,;:-_ ̸", []
    words = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(5000)] + ["<|endoftext|>", "<|endoftext|>)", "a'", "'s", "Ÿ"]
    plain = Tokenizer.from_file(path).encode_batch_fast(words, add_special_tokens=False)
    encoder = packing.Encoder(path)
    inner = encoder.tokenizer
    encoder.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, texts, **k: (calls.extend(texts), inner.encode_batch_fast(texts, **k))[1]})()
    assert encoder.encode([w.encode() for w in words]) == [np.array(e.ids, "<u4").tobytes() for e in plain]
    assert not any(packing.LETTERS.fullmatch(w.encode()) for w in calls)


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


def test_marks_and_digits_beside_letters_are_not_new_words(path):
    encoder = packing.Encoder(path)
    texts = ["house (house house-house house,house 12house house348 [house]", "ÉTÉ/été (ÉTÉ)"]
    assert encoder.encode([t.encode() for t in texts]) == plain_ids(path, texts)
    assert {w.decode() for w in encoder.ids if any(map(str.isalpha, w.decode()))} == {"house", "ÉtÉ", "été"}


def test_parts_of_a_text_give_the_plain_tokenizers_ids(path):
    r = random.Random(7)
    atoms = ["'s", "'T", "'re", "'", "''", "!'s", "a's", "1's", "ab", "É", "e\u0301", "<\u0338", "=\u0338", ".", "\u0338", "(", ")", "-", "12", "3\u20e3", "½", "×", "÷", "\u00c3",
             "漢", "İ", "Å", "K", "ſ", "_", "|", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\u2019s", "\x00", "\x1c", "\x85", "\xa0", "\u2028", " ", "\n", "\t", "\x0b", "  ", "Ω\u0345", "e", "🙂"]
    texts = ["".join(r.choices(atoms, k=r.randrange(12))) for _ in range(20000)] + ["", " ", "\n\n"]
    assert packing.Encoder(path).encode([t.encode() for t in texts]) == plain_ids(path, texts)
    assert packing.Encoder(path).encode([]) == [] and packing.Encoder(path).encode([b""]) == [b""]


def test_long_words_are_not_held(path):
    encoder, texts = packing.Encoder(path), ["漢" * 500 + " a " + "b" * 500, "a " + "漢" * 500]
    assert [encoder.encode([t.encode()])[0] for t in texts + texts] == plain_ids(path, texts + texts)
    assert set(encoder.ids) == {b"a"}


def test_long_texts_are_cut_at_white_space(path, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", 40)
    r, seen = random.Random(8), []
    texts = ["", "don't " * 200, "a" * 300, " " * 100, "one. two", "".join(r.choices("ab'st.1é \n\u0338", k=3000))]
    encoder = packing.Encoder(path)
    together = encoder.together
    encoder.together = lambda some: (seen.extend(some), together(some))[1]
    assert encoder.encode([t.encode() for t in texts]) == plain_ids(path, texts)
    assert b"".join(packing.slices(texts[-1].encode())) == texts[-1].encode() and max(len(t) for t in seen if b" " in t) < 120
