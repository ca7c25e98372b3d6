import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tests.conftest import SF
from treeline.llm import language_id


def labelled():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pylist()
    return [r for r in t if r["text"] and r["lang"]]


def test_short_texts_of_no_language_are_rejected():
    rows = labelled()
    model = language_id.Model([r["text"] for r in rows], [r["lang"] for r in rows])
    rng = np.random.default_rng(4)
    # 1 to 10 characters of three bytes each.
    foreign = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 1 + k % 10)) for k in range(400)]
    _, _, accepted = model.predict(pa.array(foreign))
    assert accepted.mean() < 0.15
    assert not model.predict(pa.array(["\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb"]))[2][0]


def test_clean_short_texts_stay():
    rows = labelled()
    train, held = rows[::2], rows[1::2]
    model = language_id.Model([r["text"] for r in train], [r["lang"] for r in train])
    for words in (2, 3, 5):
        short = [" ".join(r["text"].split()[:words]) for r in held if len(r["text"].split()) > 20]
        _, _, accepted = model.predict(pa.array(short))
        assert accepted.mean() > 0.97, words
