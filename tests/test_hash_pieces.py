"""Long texts are hashed a few at a time, so a batch of them takes no more memory than its longest text needs."""

from loreweave.functions import vectors as V


def test_a_batch_of_long_texts_is_taken_in_pieces(monkeypatch):
    texts = ["ab " * 400, None, "c d" * 500, "", "e" * 3000, *["x y z"] * 20]
    whole = V._cells(texts, 64)
    monkeypatch.setattr(V, "HELD", 2000)
    taken, sums = [], V._sums
    monkeypatch.setattr(V, "_sums", lambda t, d: taken.append(t) or sums(t, d))
    assert all(map(lambda a, b: a.tolist() == b.tolist(), whole, V._cells(texts, 64)))
    assert sum(taken, []) == texts and all(len(t) == 1 or sum(len(x or "") for x in t) <= 2000 for t in taken) and max(map(len, taken)) <= 2000 // 64
