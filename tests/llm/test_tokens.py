import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 5000)
    rng = random.Random(3)
    letters = [*"ab cD'sltv1 2  \n\n\t.,-_éßÉİ½ \xa0x́’中", "'ll", "\n", " \n", "<|endoftext|>"]
    made = ["".join(rng.choice(letters[:k]) for _ in range(rng.randint(0, 14))) for k in (16, len(letters)) for _ in range(8000)]
    encoder, library = tokens.PieceEncoder(public_tokenizers.path(name), "<u2"), Tokenizer.from_file(public_tokenizers.path(name))
    for column in (made, [], [None], ["", None, "a b"], ["long one " * 100_000]):
        ids, n = encoder.encode(pa.array(["before", *column, "after"], pa.string()).slice(1, len(column)))
        parts = np.split(ids, np.cumsum(n)[:-1]) if len(n) else []
        assert len(parts) == len(column)
        for text, part in zip(column, parts, strict=True):
            assert library.encode(text or "", add_special_tokens=False).ids == part.tolist(), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(name):
    """Their strings alone, twice, at both ends, inside words, beside white space, and nearly theirs."""
    library = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = tokens.PieceEncoder(public_tokenizers.path(name))
    found = [t.content for t in library.get_added_tokens_decoder().values()]
    assert found
    for t in found:
        texts = [t, t + t, f"{t} a b", f"a b {t}", f"a{t}b", f"a {t} b", f" {t}\n{t} ", t.upper(), t[:-1], t[1:], f"<{t}>", f"it's 12 {t}, ok"]
        ids, n = encoder.encode(pa.array(texts))
        for text, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert library.encode(text, add_special_tokens=False).ids == part.tolist(), text


def test_ended_and_blobs():
    ids, n = tokens.ended(np.array([5, 6, 7], "<u4"), np.array([0, 2, 1]), 9)
    assert ids.tolist() == [9, 5, 6, 9, 7, 9] and n.tolist() == [1, 3, 2]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.blobs(ids, n).to_pylist()] == [[9], [5, 6, 9], [7, 9]]
    assert tokens.blobs(ids[:0], n[:0]).to_pylist() == []
