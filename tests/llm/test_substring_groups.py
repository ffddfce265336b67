"""Texts are hashed in groups; a group's phrases, spellings and segments are those of its texts alone."""

import random

import numpy as np
import pyarrow as pa

from weftline.llm import substring


def _texts():
    rng = random.Random(11)
    words = [rng.choice(["a", "bb", "é", "dd d", "中文"]) for _ in range(400)]
    texts = ["", " \t", "one", " ".join(words[:19]), " ".join(words[:20]), "\n".join(words[5:60]) + "\x0b ", " ".join(words), "x " * 70, " ".join(words[200:300])]
    return [t.encode() for t in texts] * 2


def _rows(texts):
    bucket, kind, n = pa.array([0] * len(texts), pa.int32()), pa.array([1] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64())
    rows = pa.RecordBatch.from_arrays([bucket, kind, pa.array(texts, pa.binary()), n, n], ["bucket", "kind", "text", "d", "variant"])
    return next(substring._pack(iter([rows])))


def _segments(batches, phrases):
    needles = pa.RecordBatch.from_arrays([pa.array([0] * len(phrases), pa.int32()), pa.array([0] * len(phrases), pa.int32()), pa.array(phrases, pa.binary())], ["bucket", "kind", "phrase"])
    return [tuple(map(str, r.values())) for out in substring._located(iter([needles, *batches])) for r in out.to_pylist()]


def test_groups_give_what_single_texts_give(monkeypatch):
    texts = _texts()
    together, apart = [], []
    made = []
    monkeypatch.setattr(substring, "Group", lambda t, h, real=substring.Group: (made.append(len(t)), real(t, h))[1])
    for size, found in ((1 << 18, together), (1, apart)):
        monkeypatch.setattr(substring, "GROUP", size)
        rows = _rows(texts)
        (phrases,) = substring._phrases(iter([rows]))
        needles = pa.RecordBatch.from_arrays([pa.array([0] * len(phrases), pa.int32()), pa.array([0] * len(phrases), pa.int32()), phrases.column("h")], ["bucket", "kind", "h"])
        (spelled,) = substring._spelled(iter([needles, rows]))
        some = sorted(spelled.column("phrase").to_pylist())
        found += [phrases.to_pydict(), sorted(zip(*spelled.select(["phrase", "n"]).to_pydict().values(), strict=True)), sorted(_segments([rows], some))]
    assert made[:3] == [len(texts)] * 3  # one group a step, not one text a time
    assert together == apart and together[2]
    words = [t.split() for t in texts]
    joined = {b" ".join(w[k : k + substring.PHRASE]) for w in words for k in range(len(w))}
    assert {p for p, _ in together[1]} <= joined


def test_powers_grow_by_doubling():
    rolling = substring.Rolling(substring.BASE)
    for n in (40_000, 40_001, 50_000):
        rolling.prefix(np.ones(n, np.uint64))
        assert len(rolling.powers) == 1 << 16
