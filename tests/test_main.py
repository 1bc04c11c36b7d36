import pytest

from tensorloom.__main__ import run
from tensorloom.sources import text
from tensorloom.timing import Timer


@pytest.fixture
def files(tmp_path):
    (tmp_path / "x.tns").write_text("3\n2 2 2\n" + "".join(f"{i + 1} {j + 1} {k + 1} {4 * i + 2 * j + k + 1}\n" for i in range(2) for j in range(2) for k in range(2)))
    (tmp_path / "y.tns").write_text("3\n2 2 2\n1 1 1 1\n2 2 2 2\n")
    (tmp_path / "u.txt").write_text("2 2 2\n1 2\n3 4\n")
    (tmp_path / "maps.txt").write_text("2 1 1 2 1 2\n")
    return tmp_path


@pytest.mark.parametrize("name,values", [("add", [2, 2, 3, 4, 5, 6, 7, 10]), ("sub", [2, 3, 4, 5, 6, 7, 6]), ("dmul", [1, 16]), ("ddiv", [1, 4]), ("khatri-rao", None), ("kronecker", None)])
def test_pairs(spark, files, name, values):
    run(spark, [name, f"{files}/x.tns", f"{files}/y.tns", "-o", f"{files}/out"])
    got = [r[-1] for r in text.read_tns(spark, f"{files}/out").entries()]
    assert got == values if values else len(got) in (8, 16)


def test_ttm(spark, files):
    for name in ("ttm", "sttm"):
        assert "s a run of 2" in run(spark, [name, f"{files}/x.tns", "--matrix", f"{files}/u.txt", "--runs", "2", "-o", f"{files}/{name}"])
        assert [r[-1] for r in text.read_tns(spark, f"{files}/{name}").entries()] == [11, 14, 17, 20, 23, 30, 37, 44]


@pytest.mark.parametrize("more", [[], ["--blocks", "1", "2"], ["--sort", "morton"], ["--sort", "best"], ["--sort", "shuffle"], ["--renumber", "lexi"]])
def test_mttkrp(spark, files, more):
    run(spark, ["mttkrp", f"{files}/x.tns", "-r", "3", *more, "-o", f"{files}/out"])
    assert spark.read.text(f"{files}/out").count() == 3


def test_the_rest(spark, files):
    assert "NNZ=8" in run(spark, ["status", f"{files}/x.tns"]) and run(spark, ["nth", f"{files}/x.tns", "2"]) == "(0, 1, 0, 3.0)\n"
    assert "nb: 1" in run(spark, ["convert", f"{files}/x.tns", "--blocks", "1", "2", "-o", f"{files}/h"])
    for k, argv in enumerate((["loadstore"], ["convert", "-m", "1"], ["reindex"], ["reorder", "--maps", f"{files}/maps.txt"], ["reorder", "--how", "bfs"], ["crop"])):
        run(spark, [argv[0], f"{files}/x.tns", *argv[1:], *([":", "1", ":"] if argv == ["crop"] else []), "-o", f"{files}/o{k}"])
        assert text.read_tns(spark, f"{files}/o{k}").nnz == (4 if argv == ["crop"] else 8)
    assert run(spark, ["cpd", f"{files}/x.tns", "-r", "2", "-n", "5", "-o", f"{files}/cpd"]).startswith("fit: 0.9")
    run(spark, ["generate", f"{files}/g", "20%10", "10"])
    run(spark, ["diagonal", f"{files}/d", "8"])
    assert text.read_tns(spark, f"{files}/d").nnz == 8 + 4 * 6
    t = Timer()
    with t:
        pass
    assert t.runs == 1 and "a run of 1" in t.average("x") and t.report("x").startswith("[x]") and t.elapsed() >= 0
