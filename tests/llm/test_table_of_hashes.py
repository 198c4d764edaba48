import numpy as np

from lantern.llm import neardup


def test_the_table_grows_while_a_text_is_read(monkeypatch):
    monkeypatch.setattr(neardup, "_KNOWN", {})
    monkeypatch.setattr(neardup, "_TABLE", np.zeros(4, np.uint64))
    found = neardup.word_hashes(" ".join(str(k % 100) for k in range(300)))
    assert len(np.unique(found)) == 100 and (found[:100] == found[200:]).all()
