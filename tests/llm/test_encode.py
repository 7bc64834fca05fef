"""The encoder against the tokenizer files as they are."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillfold.llm.encode import Encoder, tokenizer_path

#: Letters whose lower case is another number of characters, combining marks, white space of all kinds, special strings.
PARTS = [
    *"abcdeABCstmlvrd''..,,;!?%*$#&()[]\"/@+=<>-|_^`{}~\\0123  \n\t",
    "İ", "VALİLİĞİ, ", "ı", "É", "é", "ß", "ẞ", "Σ", "ς", "é", "́", "̸", "ǅ", "ŉ", "ñ", "中", "文", "🙂", "‍", "️", "ﬁ",
    " ", " ", "　", "\x0b", "\x1c", "\x85", "\x00", "½", "²", "ⅷ", "Å", "Å", "K", "Ω", "й", "И", "ͅ", "ᾳ",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " <|endoftext|> ", "'s", "'LL", "n't",
]
FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("name, keep_space", FILES)
@pytest.mark.parametrize("memo", [100_000, 5, 0])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_encodes_as_the_file_does(name, keep_space, memo, special_as_text):
    rng = random.Random(f"{name}{memo}{special_as_text}")
    plain = Tokenizer.from_file(tokenizer_path(name))
    plain.encode_special_tokens = special_as_text
    ours = Encoder(tokenizer_path(name), keep_space, memo, special_as_text)
    for _ in range(12):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(100)]
        texts += [" ".join("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 8))) for _ in range(30)) for _ in range(20)]
        for text, got in zip(texts, ours.encode(texts)):
            assert ids(got) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_strings_of_the_verdict():
    ours = Encoder(tokenizer_path("word_bpe_49k.json"), False)
    assert ids(ours.encode(["İ,"])[0]) == [328, 136, 229, 267]
    ours = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    assert 50256 in ids(ours.encode(["a <|endoftext|> b"])[0])
    assert [ids(x) for x in ours.encode([None, ""])] == [[], []] and ours.encode([]) == []


@pytest.mark.parametrize("name, keep_space", FILES)
def test_whole_documents_and_a_very_long_text(spark, sf, name, keep_space):
    plain, ours = Tokenizer.from_file(tokenizer_path(name)), Encoder(tokenizer_path(name), keep_space, 2000)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts.append("Ab,cd é\n" * 200_000)
    for text, got in zip(texts, ours.encode(texts)):
        assert ids(got) == plain.encode(text or "", add_special_tokens=False).ids
