"""Pages of a scan share files: a folder a page made the driver list as many folders as there are pages."""

import os

import pytest

from ranklake.plans import rule_queries
from ranklake.sources import readers

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["src10_pages", "src11_durable_calendar"])
def test_a_scan_makes_no_folder_a_page(spark, monkeypatch, name):
    paths = []
    lines = rule_queries._lines
    monkeypatch.setattr(rule_queries, "_lines", lambda *a: paths.append(lines(*a)) or paths[-1])
    rule_queries.QUERIES[name](spark, SF)
    (path,) = paths
    held = os.listdir(path.removeprefix("file:"))
    assert [x for x in held if x.startswith("part-")] and not [x for x in held if x.startswith("page=")]


def test_pages_in_folders_equal_pages_in_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", i // 3 + 1, i % 3, 3) for i in range(8)], "id long, title string, page int, at int, last_page int")
    rows.write.json(str(tmp_path / "rows"))
    rows.write.partitionBy("page").json(str(tmp_path / "folders"))
    one, other = (sorted(map(tuple, readers.stored_pages(spark, str(tmp_path / x), "id long, title string").collect())) for x in ("rows", "folders"))
    assert one == other == [(i, f"t{i}", (i // 3 + 1) * (1 << 32) + i % 3) for i in range(8)]
    rows.filter("page <> 2").write.json(str(tmp_path / "gap"))
    with pytest.raises(ValueError, match="2 pages of 3"):
        readers.stored_pages(spark, str(tmp_path / "gap"), "id long, title string")
