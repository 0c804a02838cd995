"""Words and batches, however they are sliced."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cedrela.llm import common


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 18])
def test_word_hashes_do_not_depend_on_slices(size, monkeypatch):
    rng = random.Random(size)
    values = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["x" * 90, "", ""]
    data, starts = common.joined(x.encode() for x in values)
    monkeypatch.setattr(common, "SLICE", size)
    hashes, text, first, last = common.word_hashes(data, starts)
    want = [(i, w.encode()) for i, x in enumerate(values) for w in re.findall(r"[^\x20\x09-\x0d]+", x)]
    assert [(int(t), data[a:b].tobytes()) for t, a, b in zip(text, first, last)] == want
    assert len({(w, int(h)) for (_, w), h in zip(want, hashes)}) == len({w for _, w in want}) == len(set(hashes.tolist()))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string(), pa.binary()])
def test_bytes_of_a_slice(kind):
    values = ["ab", None, "", "é", "xyz"]
    batch = pa.record_batch([pa.array([None if x is None else x.encode() for x in values], pa.binary()).cast(kind)], ["text"]).slice(1, 4)
    data, starts = common.utf8(batch)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, starts[1:])] == ["", "", "é", "xyz"]
    assert [b.num_rows for b in common.chunks([batch, batch.slice(0, 0)], "text", 2)] == [3, 1]
    assert np.array_equal(common.utf8(batch.slice(0, 0))[1], [0])


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_runs_do_not_depend_on_slices(size, monkeypatch):
    monkeypatch.setattr(common, "RUNS", size)
    table = common.kept_bytes(b"abcdefghijklmnopqrstuvwxyz")
    for text in ["", " ", "Ab9cÉé\n\x0b~ü", "x" * 50 + " Y", "\x00a\x7fb@C[`"]:
        want = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert [w.decode() for words in common.runs(text.encode(), table) for w in words] == want
