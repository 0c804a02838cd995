"""Words of a text that stand in it twice are cut once."""

from cedrela.functions import repair


def test_a_repeated_word_is_cut_once(monkeypatch):
    """Before, each time that it stood there."""
    seen, cut = [], repair.split_glued
    monkeypatch.setattr(repair, "split_glued", lambda word, *more: seen.append(word) or cut(word, *more))
    import pandas as pd
    from pyspark.sql import functions as F

    made = []
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: lambda x: made.append(f))
    repair.segmented(None)
    out = made[0](pd.Series(["terminofijo y terminofijo", None]))
    assert out.values.tolist() == [["termino fijo y termino fijo", 2], [None, 0]] and seen == ["terminofijo"]
