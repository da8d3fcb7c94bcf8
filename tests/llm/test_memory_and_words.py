import random
import tracemalloc

import numpy as np

from fleetledger.llm import packing, quality_classifier


def test_words_with_every_white_space_have_the_tokenizers_ids():
    """op5: words are kept without the space before them; spaces beside other white space, at an end, and special tokens are told apart."""
    coder = packing.WordTokenizer(*packing.default_tokenizer())
    rng, parts = random.Random(5), ["a", "bc", " ", "  ", "\n", " \n", "\t", " ", "　", "x ", "é", "漢", ".", "1", *coder.special]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert coder.ids(text) == (coder._whole([text])[0] if text else b"")
    assert all(packing._plain(w) for w in coder.kept)


def test_eigenvectors_take_little_memory_of_the_driver():
    """pipeline: those of the classifier, of a matrix as large as it may become, in less than the matrix; equal to a whole decomposition's."""
    rng = np.random.default_rng(1)
    m = rng.standard_normal((2000, 100)) * 0.9 ** np.arange(100)
    gram = m @ m.T
    tracemalloc.start()
    values, vectors = quality_classifier.largest(gram, 24)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < gram.nbytes
    want, all_vectors = np.linalg.eigh(gram)
    assert np.allclose(np.sort(values), want[-24:], rtol=1e-9)
    assert np.allclose(np.abs(np.linalg.det(vectors.T @ all_vectors[:, -24:])), 1, atol=1e-7)
    assert quality_classifier.largest(np.eye(5), 24)[0].shape == (5,)
