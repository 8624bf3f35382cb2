"""The automaton of op6 tells one token a character, and what is remembered of pairs holds whole chains of prefixes."""

import random

import sentencepiece

from surveyloom.llm import pieces


def test_one_longest_token_a_character():
    tokens = {"a", "b", "ab", "ba", "abb", "bba", "aab", "é"}
    start = pieces._automaton(tokens)
    for seed in range(200):
        text = "".join(random.Random(seed).choices("abéz", k=30))
        state, got = start, []
        for c in reversed(text):
            state = state.get(c) or pieces._next(state, c)
            got.append(state[pieces.LONGEST])
        want = [max((t for t in tokens if text.startswith(t, i)), key=len, default=None) for i in range(len(text))]
        assert got[::-1] == want


def test_chains_are_remembered_and_bounded(monkeypatch):
    data = open(pieces.default_model(), "rb").read()
    model, library = pieces.PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(3)
    texts = ["".join(rng.choices("aabeethinŋ中😀é##", k=rng.randint(1, 40))) for _ in range(400)]
    want = [library.encode(t) for t in texts]
    assert [model.encode(t) for t in texts] == want
    model.words.clear()
    monkeypatch.setattr(model, "compatible", lambda a, b: 1 / 0)  # every chain is known by now
    assert [model.encode(t) for t in texts] == want
    monkeypatch.undo()
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    model.words.clear()
    model.fits.clear()
    model.n_fits = 0
    assert [model.encode(t) for t in texts] == want and sum(map(len, model.fits.values())) <= 3
