import random
import re

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import textkit


@pytest.mark.parametrize("piece", [1, 3, 16, 1 << 20])
@pytest.mark.parametrize("kept, pattern", [(textkit.SPACED, rb"[^\x20\x09-\x0D]+"), (textkit.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_as_by_pattern(monkeypatch, piece, kept, pattern):
    monkeypatch.setattr(textkit, "PIECE", piece)
    r = random.Random(2)
    texts = ["".join(r.choices("aB9 \n.é\x1c\x0b\U0001f600|", k=r.randint(0, 60))) for _ in range(80)] + [None, "", "A" * 100, " "]
    for column in (pa.array(texts), pa.array([*texts, "x", "y"]).slice(3, len(texts) - 3), pa.array(texts, pa.large_string())):
        hashes, at = textkit.words(column, kept)
        seen = {}
        for i, t in enumerate(column.to_pylist()):
            words = re.findall(pattern, (t or "").encode().lower())
            own = hashes[at[i] : at[i + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_grams():
    x = np.arange(10, dtype=np.uint64)
    assert len(textkit.grams(x, 4)) == 7 and len(textkit.grams(x, 11)) == 0
    assert textkit.grams(x, 3)[2] == textkit.grams(x[2:5], 3)[0] != textkit.grams(x[2:5], 3, 1)[0]
