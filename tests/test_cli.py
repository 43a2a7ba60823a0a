from tessel.__main__ import main


def test_conforming_input(capsys):
    assert main(["--expression", ".[] | . + 1", "--input", "[1, 2]"]) == 0
    assert capsys.readouterr().out.splitlines() == ["2", "3", "well typed, and the document fits"]


def test_mismatch_is_reported_with_its_place(capsys, tmp_path):
    (tmp_path / "p").write_text(".[] | .price, .tag | {v: .net} # comment\n")
    (tmp_path / "d").write_text('[{"tag": "new", "price": 12.5}]')
    for method in ("direct", "constraint"):
        assert main(["--path", str(tmp_path / "p"), "--input-path", str(tmp_path / "d"), "--inference", method]) == 1
        out = capsys.readouterr().out
        assert "Cannot index 12.5" in out and "at [0].price, expected {net: <>}, got 12.5" in out


def test_faults(capsys):
    assert main(["--expression", "(", "--input", "1"]) == 2
    assert main(["--expression", ".", "--input", "{"]) == 2
    assert main(["--expression", '"a" | floor', "--input", "1", "--verbose"]) == 1
    assert "ill typed" in capsys.readouterr().out
