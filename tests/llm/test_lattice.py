"""The lattice of pieces against the library, and transfer matrices against paths."""

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path as tokenizer_path

from gridspark.llm import sentencepiece_codec as sc

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return sc.Codec(MODEL)


@pytest.mark.parametrize("letters", ["etaoin", "ab", "thequickbrownfox", "éü日本ß", "a1!-", "\U0001f600x"])
def test_units_through_the_lattice_are_the_librarys(codec, letters):
    rng = np.random.default_rng(len(letters))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(rng.choice(list(letters), rng.integers(1, 40))) for _ in range(300)]
    ids, sizes = codec.encode_units([sc.SPACE + t for t in texts], paths=True)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t) for t in texts]


def test_products_of_chunks_are_the_matrix_of_the_whole(codec):
    """Matrices are associative, and equal those of the text taken as one chunk; with and without safe places."""
    rng = np.random.default_rng(3)
    for letters in ("theinga", "theinga   "):
        text = codec.normalise("".join(rng.choice(list(letters), 400)))
        margin, cuts = codec.longest, [0, 130, 260, 401]
        parts = [codec.transfer(text[max(0, a - margin) : a], text[a:b], text[b : b + margin]) for a, b in zip(cuts, cuts[1:])]
        left = sc.product(sc.product(parts[0], parts[1]), parts[2])
        right = sc.product(parts[0], sc.product(parts[1], parts[2]))
        assert (left == right).all() and (left == codec.transfer("", text, "")).all() and (left == 0).any()
        assert len(sc.scan(parts)) == 3 and (sc.scan(parts)[2] == left).all()
