import pytest

from changelens.sources import smallfiles as sf


@pytest.fixture
def tree(spark, tmp_path):
    rows = [(f"r{i % 3}", i % 2, f"d{i % 4}/f {i}.go", f"text é {i}\n" * (1 + i % 5)) for i in range(40)] + [("r0", 0, "empty.py", "")]
    root, listing = str(tmp_path / "tree"), str(tmp_path / "listing")
    sf.write_small_files(spark.createDataFrame(rows, sf.READ), root)
    (tmp_path / "tree" / "r1" / "no-number").mkdir()
    (tmp_path / "tree" / "r1" / "no-number" / "x").write_text("left out")
    sf.write_listing(spark, root, listing)
    return rows, listing, tmp_path


def test_files_come_back(spark, rows, tree):
    written, listing, _ = tree
    assert rows(sf.read_small_files(spark, listing)) == sorted(written)


def test_partitions_by_bytes(tree):
    written, listing, _ = tree
    total = sum(len(c.encode()) for *_, c in written)
    for target in (50, 200, 10**9):
        parts = sf.SmallFilesReader({"listing": listing, "target": str(target)}).partitions()
        assert sum(p.stop - p.start for p in parts) == len(written)
        assert len(parts) <= 2 * total / target + len({(p.listing, p.group) for p in parts})


def test_conditions_are_pushed_down(spark, rows, tree):
    written, listing, _ = tree
    found = sf.read_small_files(spark, listing).where("repo = 'r2' and pr_id in (1, 5) and path like '%f 5%'")
    assert rows(found) == sorted(r for r in written if r[0] == "r2" and r[1] == 1 and "f 5" in r[2])
    reader = sf.SmallFilesReader({"listing": listing})
    left = list(reader.pushFilters([sf.EqualTo(("repo",), "none"), sf.EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)]
    assert [p.stop for p in reader.partitions()] == [0]  # no row group can hold it


def test_a_file_that_is_no_text_is_named(spark, tree):
    _, listing, folder = tree
    (folder / "tree" / "r0" / "0" / "empty.py").write_bytes(b"\xff")
    with pytest.raises(Exception, match="empty.py is not UTF-8"):
        sf.read_small_files(spark, listing).collect()
