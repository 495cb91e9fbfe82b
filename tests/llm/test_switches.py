"""Beyond the size up to which a side is broadcast, the results are the same."""

from conftest import SF001

from chatlake.llm import decontaminate, line_dedup, queries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    near = rows(queries.op7_decontaminate(spark, SF001))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows(queries.op7_decontaminate(spark, SF001)) == near and near


def test_lines_beyond_the_broadcast_bound(spark, monkeypatch):
    near = rows(queries.op4_lines(spark, SF001))
    monkeypatch.setattr(line_dedup, "FEW_LINES", 0)
    assert rows(queries.op4_lines(spark, SF001)) == near and near
