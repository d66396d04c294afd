import random

import pytest

from keyloom.llm import textkit, token_counts
from keyloom.llm.token_counts import VOCABULARY, Automaton, count_tokens, tiktoken_pieces


def greedy(word, pieces, lead=b" "):
    word, n, at = lead + word, 0, 0
    longest = max(map(len, pieces))
    while at < len(word):
        for stop in range(min(len(word), at + longest), at, -1):
            if word[at:stop] in pieces:
                break
        else:
            return None
        at, n = stop, n + 1
    return n


def texts(seed):
    r = random.Random(seed)
    out = ["".join(r.choices("abcx \n\té\U0001f600", [5, 5, 5, 0.2, 2, 0.5, 0.5, 0.3, 0.2], k=r.randint(0, 200))) for _ in range(60)]
    return [*out, None, "", " ", "abc" * 900, "ab " * 900 + "c"]


@pytest.mark.parametrize("all_bytes", [True, False])
def test_as_greedy(spark, monkeypatch, all_bytes):
    monkeypatch.setattr(textkit, "PIECE", 64)
    pieces = [b"a", b"b", b"c", b" a", b" ", b"ab", b"abc", b" abca", b"bcab", b"cabcabx", b"bca", " é".encode()]
    pieces += [bytes([i]) for i in range(256)] if all_bytes else []
    data = list(enumerate(texts(5)))
    got = count_tokens(spark.createDataFrame([(*d, 3) for d in data], "doc_id long, text string, n_tokens int"), pieces).collect()
    assert len(got) == len(data)
    for r in got:
        each = [greedy(w, set(pieces)) for w in (data[r.doc_id][1] or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(1 if x is None else x for x in each), each.count(None))


def test_real_vocabulary():
    pieces = tiktoken_pieces(VOCABULARY)
    auto, known = Automaton.of(pieces), set(pieces)
    words = "the quick internationalization antidisestablishmentarianism Straße naïve éàü 123456789 http://example.com/a?b=c ...".encode().split()
    data = token_counts.np.frombuffer(b" ".join(words), token_counts.np.uint8)
    ends = token_counts.np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    assert auto.count(data, starts, ends).tolist() == [greedy(w, known) for w in words]


def test_empty(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), [b"a"]).count() == 0
