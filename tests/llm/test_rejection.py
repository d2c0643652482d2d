import random

import pyarrow as pa
import pytest

from plethora.llm import language_id


def _texts(letters, n, seed):
    r = random.Random(letters)
    words = ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(60)]
    r = random.Random(seed)
    return [" ".join(r.choices(words, k=80)) for _ in range(n)]


@pytest.mark.parametrize("n", [20, 200])
def test_unlearned_languages_and_gibberish_are_rejected(n):
    """Two languages learned, so that a softmax alone is always sure of half at least."""
    model = language_id.train(_texts("aeiounrt", n, 1) + _texts("bcdfaeio", n, 1), ["a"] * n + ["b"] * n)
    r = random.Random(4)
    odd = pa.array(_texts("ghjkuyxw", 20, 2) + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400)) for _ in range(20)])
    clean = pa.array(_texts("aeiounrt", 100, 3) + _texts("bcdfaeio", 100, 3))
    assert model.rejects(odd, model.predict(odd)[1]).all()
    assert model.rejects(clean, model.predict(clean)[1]).mean() <= 0.02


def test_every_language_is_learned():
    model = language_id.train(_texts("aeiounrt", 100, 1) + _texts("bcdfaeio", 1, 1), ["a"] * 100 + ["b"])
    best, _ = model.predict(pa.array(_texts("bcdfaeio", 5, 1)))
    assert [model.languages[k] for k in best] == ["b"] * 5
