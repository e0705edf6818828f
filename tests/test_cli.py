from __future__ import annotations

import pytest

from corpusloom import cli


@pytest.mark.parametrize("argv", [[], ["fly"], ["run", "q", "--tables", "a"], ["run", "--tables", "a", "--out", "b"], ["run", "q", "--tables", "a", "--tables", "b", "--out", "c"], ["list", "--tables", "a"], ["encode", "x", "--tables", "a", "--out", "b"], ["explain", "q", "--tables"]])
def test_bad_options(argv):
    with pytest.raises(ValueError):
        cli.parse(argv)


def test_checks_before_work(tmp_path):
    o = cli.parse(["run", "q", "--tables", str(tmp_path / "none"), "--out", str(tmp_path / "o")])
    with pytest.raises(FileNotFoundError):
        cli.validate(o)
    with pytest.raises(FileExistsError):
        cli.validate(cli.parse(["run", "q", "--tables", str(tmp_path), "--out", str(tmp_path)]))
    assert cli.parse(["run", "q", "--tables", "hdfs://x", "--out", "y", "--partition", "lang"]).values["partition"] == "lang"


def test_run_and_codec_round_trip(spark, sf_dir, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "codec_roundtrip" in capsys.readouterr().out
    cli.main(["run", "run_state", "--tables", sf_dir, "--out", str(tmp_path / "r")])
    assert spark.read.parquet(str(tmp_path / "r")).count() > 0
    small = tmp_path / "t"
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 300").write.parquet(str(small / "documents.parquet"))
    cli.main(["encode", "--tables", str(small), "--out", str(tmp_path / "c")])
    cli.main(["decode", "--coded", str(tmp_path / "c"), "--out", str(tmp_path / "d")])
    want = {r.doc_id: r.text for r in spark.read.parquet(str(small / "documents.parquet")).collect()}
    assert {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "d")).collect()} == want
    with pytest.raises(ValueError):
        cli.main(["explain", "no_such_query", "--tables", sf_dir])
