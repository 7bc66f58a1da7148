import random

import pyarrow as pa
import pytest

from glyphmill.operators.packed import explode_packed, split_packed, split_scalar

CASES = ['["a", "b,c"]', 'x|"y ""z"" w"|“p|q”| |', "", None, "a;b , c", '"odd', 'a "b" c|d', '"a"b|c', "[x] y [z]", "[a|b]", ' 1|m 2|n  "3|o p", 4|q / |z ', "a\tb\nc", "   ", "“open|x", "[", "a · b"]


@pytest.mark.parametrize("blanks", [False, True])
def test_scan_equals_scalar(blanks):
    rng = random.Random(7)
    alphabet = ["a", "ꜥ", "𓀀", " ", "|", ";", ",", "/", '"', '""', "“", "”", "[", "]", "\t", "·", " ", "xy"]
    texts = CASES + ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(4000)]
    assert split_packed(pa.array(texts, pa.string()), blanks).to_pylist() == [split_scalar(t, blanks) for t in texts]


def test_known_values():
    assert split_scalar('["a", "b,c"]') == ["a", "b,c"]
    assert split_scalar('x|"y ""z"" w"|“p|q”| |') == ["x", 'y "z" w', "p|q"]
    assert split_scalar('1|m 2|n "3|o p"; |q', True) == ["1|m", "2|n", "3|o p", "|q"]
    assert split_scalar("psn wr, t ḥḏy") == ["psn wr", "t ḥḏy"]


def test_slices_and_long_texts():
    column = pa.array(["skip|me", "a|b", None, "c|" * 50_000])
    assert [len(x) for x in split_packed(column.slice(1)).to_pylist()] == [2, 0, 50_000]


def test_explode(spark):
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "x"), (None, "c", "y"), (2, None, "z"), (3, "", "w")], "id long, v string, pos string")
    got = sorted(((r.row_key or "", r.pos, r.item) for r in explode_packed(df, "id", "v").collect()))
    assert got == [("", 1, "c"), ("1", 1, "a"), ("1", 1, "a"), ("1", 2, "b"), ("1", 2, "b")]
    assert explode_packed(df.limit(0), "id", "v").count() == 0
