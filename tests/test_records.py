"""The record data source: splits, pushed conditions, equal to the plain readers."""

import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith
from test_readers import BLOCKS, PLOT

from legnet.sources import readers as S
from legnet.sources import records as R


def whole(data: bytes, mark: bytes):
    """Records of a file read at once."""
    out, low = [], 0
    while (hit := data.find(mark, low)) >= 0:
        out.append((low, data[low:hit]))
        low = hit + 1
    return [*out, (low, data[low:])] if low < len(data) else out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aN\n\f"), max_size=60), st.integers(1, 70), st.integers(1, 9))
def test_splits_own_each_record_once(text, step, piece):
    data = text.encode()
    before, R.READ_BYTES = R.READ_BYTES, piece
    try:
        for mark, _ in R.KINDS.values():
            got = [
                x for a in range(0, len(data), step) for x in R.records(io.BytesIO(data), a, a + step, mark)
            ]
            assert got == whole(data, mark)
    finally:
        R.READ_BYTES = before


LISTING = "( Easting, Northing, Altitude )\r\n" + "".join(
    f"({i}.25, {-i}.50, {i * 3}.00 ) {'ab'[i % 2]}{i % 3}.s{i}\r\n" for i in range(300)
) + "(1.00, 2.00, 3.00 )\n(x, 2.00, 3.00 ) a0.bad\nno station\n(7.00, 8.00, 9.00 ) \\a0.é\n"


def rows(df, drop=("file", "seq", "line_no", "block", "row")):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.fixture()
def put(tmp_path):
    def write(text, name="in/f.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
        return str(path)

    return write


def test_equal_to_the_readers(spark, put):
    path = put(LISTING)
    for survey in ("", "a0"):
        assert rows(R.positions(spark, path, survey, split_bytes=1999)) == rows(S.read_pos(spark, path, survey))
    assert rows(R.positions(spark, path, bad=True)) == rows(S.read_pos(spark, path, bad=True))
    path = put(BLOCKS, "in2/blocks.txt")
    for survey in ("", "ADIT"):
        want = rows(S.read_survey_blocks(spark, path, survey=survey))
        assert rows(R.survey_blocks(spark, path, survey=survey, split_bytes=200)) == want
    path = put(PLOT, "in3/plot.txt")
    for survey in ("", "DEN"):
        want = rows(S.read_plot_lines(spark, path, survey=survey))
        assert rows(R.plot_lines(spark, path, survey, split_bytes=100)) == want


def test_order_folders_and_packed_files(spark, put, tmp_path):
    path = put(LISTING)
    put("ignored", "in/_SUCCESS")
    put("", "in/empty.txt")
    (tmp_path / "in" / "g.txt.gz").write_bytes(gzip.compress(LISTING.encode()))
    got = R.positions(spark, str(tmp_path / "in"), split_bytes=2000).collect()
    assert len(got) == 2 * S.read_pos(spark, path).count()
    seen = R.positions(spark, path, split_bytes=2000).orderBy("seq").collect()
    assert [r.name for r in seen if r.name.startswith("b")] == [f"b{i % 3}.s{i}" for i in range(1, 300, 2)]
    (tmp_path / "none").mkdir()
    assert R.positions(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="kind must be one of"):
        R.read_records(spark, path, "other").count()


def test_conditions_reach_the_reader(spark, put, capsys):
    path = put(LISTING)
    later = R.positions(spark, path).where(F.col("name").startswith("a1.") & (F.col("x") > 9))
    assert later.count() == S.read_pos(spark, path).where("name LIKE 'a1.%' AND x > 9").count()
    for df in (later, R.positions(spark, path, survey="a1")):
        df.explain("formatted")
        plan = capsys.readouterr().out
        assert "StringStartsWith" in plan and "a1." in plan, plan
        # What is pushed is not tested again above the scan.
        assert "StartsWith(key" not in plan.replace("StringStartsWith(key", ""), plan


def test_only_wanted_records_leave_the_reader(put):
    path = put(LISTING)

    def read(*conditions):
        reader = R.SurveyRecords({"path": path, "kind": "positions", "splitBytes": "500"}).reader(None)
        left = list(reader.pushFilters(list(conditions)))
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p)), left

    total = len(LISTING.splitlines())
    assert read() == (total, [])
    assert read(StringStartsWith(("key",), "a1."))[0] == 50
    assert read(EqualTo(("key",), "b1.s1"))[0] == 1
    assert read(In(("key",), ("b1.s1", "a2.s2", "zz")))[0] == 2
    other = GreaterThan(("start",), 5)
    assert read(other) == (total, [other])
