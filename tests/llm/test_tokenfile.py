"""Ids of many texts at once against the library, text by text."""

import random

import public_tokenizers
import pyarrow as pa

from tessera.llm import tokenfile

ODD = ["", None, "a", " a", "a ", "a  b", "a\tb", "a\n\nb", "<|endoftext|> x", "x <|endoftext|>y", "é ü\nß", "x​y 　", "\0", "漢字 kana", "a\u0085b c", " a", "%%%", "'s", " 's", "á Ω1²½ a²b", "\x01a \x7fb",
    "don't rock'n'roll 'tis x's!'s !'ll 12's 3rd b4 '' 'd a-b_c... é's ñ9! 9ñ $5.00 I'LL", "a\nb's\n12,5\n...", "word%%% é%%% ée"]


def test_ids_of_many_texts_are_the_librarys(monkeypatch):
    rng = random.Random(5)
    signs = " \n'abtsrevmld10.,!%_-éß漢²́ "
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    coder = tokenfile.Tokens(public_tokenizers.path(tokenfile.VOCABULARY))
    monkeypatch.setattr(tokenfile, "SLICE", 1000)
    for column in (pa.array(texts), pa.array(texts, pa.large_string()).slice(7, 40), pa.array(["", ""]), pa.array([], pa.string()), pa.array([None], pa.string())):
        got = coder.ids_of(column)
        assert [x.tolist() for x in got] == [coder.library.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]


def test_signs_at_a_words_end_are_no_new_word():
    coder = tokenfile.Tokens(public_tokenizers.path(tokenfile.VOCABULARY))
    asked = []
    encode = coder.memo.encode
    coder.memo.encode = lambda pieces: asked.extend(pieces) or encode(pieces)
    coder.ids_of(pa.array(["one two. one, two! one two? two;", "two%%% one."]))
    assert sorted(asked) == sorted(["one", " two", ".", " one", ",", "!", "?", ";", "two", "%%%"])
