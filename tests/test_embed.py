import numpy as np


def test_hash_embedder_keeps_a_bounded_vocabulary(monkeypatch):
    from sparqa.operators import embed as e
    monkeypatch.setattr(e, "_VOCABULARY_MAX", 50)
    monkeypatch.setattr(e, "_TEXTS_AT_ONCE", 4)
    texts = [" ".join(f"Tok{i * 7 + j}é x" for j in range(i % 5)) for i in range(90)] + ["", "...", None, "a_b ²"]
    want = [sum((e.py_token_vector(t) for t in e.py_tokens(x)), np.zeros(16)) for x in texts]
    for _ in range(2):
        assert np.array_equal(e.hash_embedder(texts), np.array(want))
        assert len(e._vocabulary) <= 50 + 4 * 8
    assert e.py_tokens("a_b ² É") == ["a", "b", "²", "é"]
