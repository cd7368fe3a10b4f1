import random

import pytest

from sourcelake.functions import segments as module
from sourcelake.functions.parse import parse
from sourcelake.functions.segments import FILE, pieces, segments
from sourcelake.operators.snapshot import structural_chunks

CODE = "import a\n\nclass C:\n    x = 1\n\n    def m(self):\n        return 1\n\n    y = 2\n\ndef m():\n    pass\n\ndef m():\n    pass\n"


def test_segments_follow_symbols():
    found, code = segments(CODE.encode(), parse("python", CODE)["symbols"], 1000)
    assert code is None and "".join(CODE[s.start_byte : s.end_byte] for s in found) == CODE
    shown = [(s.owner.kind, s.owner.qualified_name, s.owner.occurrence, s.part_index) for s in found]
    assert shown == [("file", None, 0, 0), ("class", "C", 0, 0), ("method", "C.m", 0, 0), ("class", "C", 0, 1), ("file", None, 0, 1), ("function", "m", 0, 0), ("file", None, 0, 2), ("function", "m", 1, 0)]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_cover_all_bytes_and_no_character_is_cut(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "\n", "é", "字", "😀", "\r"]) for _ in range(300))
    data, limit = text.encode(), rng.randint(4, 40)
    out = pieces(data, 0, len(data), limit)
    assert b"".join(data[a:b] for a, b in out) == data and all(0 < b - a <= limit for a, b in out)
    assert "".join(data[a:b].decode() for a, b in out) == text


def test_bounds(monkeypatch):
    monkeypatch.setattr(module, "MAX_SEGMENTS", 3)
    found, code = segments(CODE.encode(), parse("python", CODE)["symbols"], 1000)
    assert code == "index_structure_budget" and [s.owner for s in found] == [FILE]
    monkeypatch.setattr(module, "MAX_RECORDS", 3)
    assert segments(CODE.encode(), [], 10) == ([], "index_record_budget")
    monkeypatch.setattr(module, "MAX_INPUT", 3)
    assert segments(CODE.encode(), [], 10) == ([], "index_input_limit") and segments(b"", [], 10) == ([], None)


def test_chunks_never_show_a_secret(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    text = f"def f():\n    k = '{key}'\n"
    rows = spark.createDataFrame([("a.py", "python", text), ("b", None, None), ("c", "unknown", "")], "relative_path string, language string, content string")
    out = structural_chunks(rows, 8).orderBy("start_byte").collect()
    assert "".join(r.content for r in out) == text.replace(key, "*" * 20) and sum(r.redaction_count > 0 for r in out) >= 3
    assert structural_chunks(rows.limit(0)).count() == 0
