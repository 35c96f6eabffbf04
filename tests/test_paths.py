import os

import pytest
from hypothesis import given
from hypothesis import strategies as st

from framestride.errors import DatasetError
from framestride.sources import paths


@pytest.mark.parametrize("name", ["", ".", "..", "a.", "a ", "a/b", "a\\b", "a:b", "a*", "a?", 'a"', "<a", "a>", "a|b", "[a", "a]", "a%2f", "a#", "a\x00", "a\x1f", "a\x7f", "con", "PRN", "aux.txt", "nul .parquet", "CONIN$", "conout$.x", "com1", "LPT9.a", "com¹", "lpt³"])
def test_names_that_are_not_portable(name):
    assert not paths.portable(name)
    with pytest.raises(DatasetError, match="portable path component"):
        paths.feature_name(name)


@pytest.mark.parametrize("name", ["CONSOLE", "NUL-safe", "COM0", "COM10", "LPT0", "LPT10", "COM¹suffix", ".NUL", "état d'été", "a b"])
def test_names_that_are_portable(name):
    assert paths.feature_name(name) == name


@given(st.integers(0, 10**12), st.integers(0, 10**12), st.integers(0, 30), st.booleans())
def test_template_numbers_are_padded_as_python_does(chunk, file, width, zero):
    spec = f"{'0' if zero else ''}{width or ''}d"
    fill = "0" if zero else " "
    want = str(chunk).rjust(width, fill) + "-" + str(file)
    assert paths.expand("{chunk_index:%s}-{file_index}" % spec, chunk, file) == want


@given(st.text(alphabet="ab{}", max_size=8))
def test_templates_fail_or_unescape(text):
    try:
        out = paths.expand(text, 0, 0)
    except DatasetError:
        return
    assert out == text.replace("{{", "{").replace("}}", "}")


@pytest.mark.parametrize("template", ["{chunk_index", "a}", "{other}", "{chunk_index:x}", "{chunk_index:03f}", "{file_index:2000d}", "{video_key}"])
def test_bad_templates(template):
    with pytest.raises(DatasetError):
        paths.expand(template, 0, 0)


def test_video_key_takes_no_format():
    assert paths.expand("{video_key}/{file_index:02d}", 0, 3, "front") == "front/03"
    with pytest.raises(DatasetError):
        paths.expand("{video_key:d}", 0, 0, "front")


def test_paths_stay_below_the_root():
    assert paths.locate("/r", "état/c {chunk_index}/it's", 1, 2) == "/r/état/c 1/it's"
    for bad in ("../x", "/x", "a//b", "a/./b", "com{file_index}", "a\\b"):
        with pytest.raises(DatasetError, match="relative to the dataset root"):
            paths.locate("/r", bad, 1, 2)
    with pytest.raises(DatasetError, match="non-negative"):
        paths.locate("/r", "{chunk_index}", -1, 0)


def test_roots(tmp_path, monkeypatch):
    assert paths.normal_root(" \t/a/b// \n") == "/a/b"
    assert paths.normal_root(" /a") == " /a"
    for bad in (None, "", " \n"):
        with pytest.raises(DatasetError):
            paths.normal_root(bad)
    monkeypatch.chdir(tmp_path)
    for place in ("one", "two"):
        os.makedirs(tmp_path / place / "data" / "meta")
        (tmp_path / place / "data" / "meta" / "info.json").write_text("{}")
    assert paths.resolve_root("data", [str(tmp_path / "one")]) == str(tmp_path / "one" / "data")
    with pytest.raises(DatasetError, match="multiple datasets"):
        paths.resolve_root("data", f"{tmp_path / 'one'},{tmp_path / 'two'}")
    assert paths.resolve_root("data") == str(tmp_path / "data")
    assert paths.resolve_root("s3://b/k", ["/x"]) == "s3://b/k"
    os.makedirs(tmp_path / "data" / "meta")
    (tmp_path / "data" / "meta" / "info.json").write_text("{}")
    assert paths.resolve_root("data", [str(tmp_path / "one"), str(tmp_path / "two")]) == str(tmp_path / "data")


def test_templates_as_columns(spark):
    rows = spark.createDataFrame([(1, 2, "front"), (1234, 56, "a b")], "c bigint, f bigint, k string")
    template = "{{x}}{video_key}/{chunk_index:03d}-{file_index:4d}|{file_index}"
    got = [r[0] for r in rows.select(paths.expand_column(template, rows["c"], rows["f"], rows["k"])).collect()]
    assert got == [paths.expand(template, c, f, k) for c, f, k in ((1, 2, "front"), (1234, 56, "a b"))]
