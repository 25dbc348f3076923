"""Long texts are worked on in parts: the parts' size changes nothing."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wayhex.llm import language, repeats, textops, tokenizing
from wayhex.llm.queries import vocabulary


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcé1'", k=r.randint(1, 12)))
    return [*(" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(20)), None, "", "x" * 200, " \n", "ab" * 150 + " end", "don't stop"]


@pytest.mark.parametrize("chunk", [1, 7, 64, 300])
def test_words_and_shingles_in_chunks(chunk):
    col = pa.array(texts(1))
    for f in (textops.words, textops.shingles):
        one, at = f(col)
        two, also = f(col, chunk)
        assert (one == two).all() and (at == also).all()


@pytest.mark.parametrize("chunk", [1, 5, 100])
def test_grams_in_windows(chunk):
    col = pa.array(texts(2))
    code, at = language.grams(col)
    want = [sorted(code[i:j].tolist()) for i, j in zip(at, at[1:])]
    found = [[] for _ in want]
    for part, places in language.gram_windows(col, chunk):
        for i, (x, y) in enumerate(zip(places, places[1:])):
            found[i] += part[x:y].tolist()
    assert [sorted(f) for f in found] == want


@pytest.mark.parametrize("chunk", [1, 13, 200])
def test_tokens_in_windows(chunk):
    encoder = tokenizing.WordEncoder(vocabulary("word_bpe_49k.json"))
    col = pa.array([t or "" for t in texts(3)], pa.large_string())
    one, at = encoder._plain(col)
    two, also = encoder._plain(col, chunk)
    assert (one == two).all() and (at == also).all()
    assert [one[i:j].tolist() for i, j in zip(at, at[1:])] == [encoder.whole.encode(t, add_special_tokens=False).ids for t in col.to_pylist()]


@pytest.mark.parametrize("chunk", [50, 171, 1000])
def test_anchors_in_windows(chunk):
    r = random.Random(4)
    rows = [bytes(r.choices(b"abc ", k=n)) for n in (0, 30, 40, 41, 700, 2500)] + [b"ab" * 900, b"z" * 500]
    data, at = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
    want = sorted(zip(*(x.tolist() for x in repeats.anchors(data, at, 40, 8)[:6])))
    found = [zip(*(x.tolist() for x in part)) for part in repeats.anchors_in_windows(data, at, 40, 8, chunk)]
    assert sorted(x for part in found for x in part) == want and len(want) > 50
