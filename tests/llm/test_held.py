"""What a Python worker holds between tasks: an idle one counts against its executor."""

import numpy as np
import pyarrow as pa
import pytest

from meterlake.llm import textkit as tk
from meterlake.llm import units
from meterlake.llm.queries import tokenizer_file


def spans(texts):
    data, offsets = tk.buffer(pa.array(texts))
    start, end = units.spaced_units(data, offsets)
    return tk.Words(data, offsets, start, end, np.searchsorted(start, offsets))


def held():
    return sum(a.nbytes for pair in tk._powers.values() for a in pair)


@pytest.fixture(scope="module")
def words():
    r = np.random.default_rng(3)
    letters = r.integers(97, 123, (600_000, 7), np.uint8)
    letters[:, 6] = 32
    return letters.tobytes().decode()


def test_tables_of_powers_stay_small(words):
    w = spans([words])
    tk.word_hashes(w, 0), tk.word_hashes(w, 1)
    tk.word_hashes(spans(["x" * (3 << 20)]), 0)
    assert held() <= 64 << 20


def test_hashes_do_not_depend_on_pieces(words, monkeypatch):
    texts = ["ab cd", "", "y" * 5000 + " ab", None, words[:20_000], "cd. ab, é ab"]
    whole = [tk.word_hashes(spans(texts), way) for way in (0, 1)]
    for piece in (1, 7, 64, 4999, 5000):
        monkeypatch.setattr(tk, "PIECE", piece)
        for way in (0, 1):
            assert (tk.word_hashes(spans(texts), way) == whole[way]).all()


def test_memo_is_bounded_and_ids_stay(words, monkeypatch):
    monkeypatch.setattr(units, "MEMO", 500)
    e = units.Encoder(tokenizer_file("word_bpe_49k.json"))
    texts = [words[i : i + 1400] for i in (0, 1400, 0, 70, 2800, 0)] + [words[:7000], words[:1400], "12 a . \x07"]
    for text in texts:
        w = spans([text])
        ids, borders = e.encode(w.data, w.start, w.end)
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert borders[-1] == len(ids) and len(borders) == len(w.start) + 1
        assert len(e.memo) <= 500 and len(e.older) <= 500


def test_blocks_encoded_together_are_small(words):
    docs = pa.RecordBatch.from_pydict({"text": [words[:9000]] * 460})
    got = list(units.gathered(iter([docs])))
    assert sum(b.num_rows for b in got) == 460
    assert max(b.nbytes for b in got) <= 2 << 20
