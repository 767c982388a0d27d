"""The word encoder asks for what it misses only, and the collector rests while it learns."""

import gc

import pyarrow as pa
import pytest

from haystrata.llm import token_output

P = pytest.importorskip("public_tokenizers")


def test_only_missing_words_are_looked_up_again(monkeypatch):
    encoder = token_output.WordEncoder(P.path("word_bpe_49k.json"), True)
    first = pa.array([" ".join(f"word{i}" for i in range(1000))])
    want = encoder.encode(first)[0].tolist()
    looked, resting = [], []
    plain, learn = encoder.words.places, encoder._learn
    monkeypatch.setattr(encoder.words, "places", lambda keys: looked.append(len(keys)) or plain(keys))
    monkeypatch.setattr(encoder, "_learn", lambda new: resting.append(gc.isenabled()) or learn(new))
    ids, sizes = encoder.encode(pa.array([first[0].as_py() + " novel"]))
    assert looked == [1001, 1] and resting == [False] and gc.isenabled()  # before: 1,001 twice
    assert ids.tolist()[: len(want)] == want and sizes.tolist() == [len(ids)]
