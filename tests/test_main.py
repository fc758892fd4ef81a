import json

import pytest

from tests.test_stages import tree
from weftline.__main__ import main


def test_writes_a_query_and_refuses_to_overwrite(spark, sf, tmp_path):
    out = str(tmp_path / "out")
    assert main(["run", "status_counts", sf, out]) == 0
    assert spark.read.parquet(out).count() > 0
    with pytest.raises(Exception, match="already exists"):
        main(["run", "status_counts", sf, out])
    assert main(["run", "no_such_query", sf]) == main(["no such command"]) == main([]) == main(["balance"]) == 2


def test_fits_vocabularies_and_tells_the_balance(spark, tmp_path, capsys):
    texts = f"file://{tmp_path}/texts"
    spark.createDataFrame([("en", "the then the then"), ("es", "la niña la niña")], "language string, text string").write.parquet(texts)
    for command in ("fit-merges", "fit-lattice"):
        assert main([command, texts, f"file://{tmp_path}/{command}", "270" if command == "fit-merges" else "20"]) == 0
        assert json.loads((tmp_path / command / "training_metadata.json").read_text())["vocab_size"] > 5
    assert main(["balance", texts, f"file://{tmp_path}/fit-merges"]) == 0 and "token_share" in capsys.readouterr().out
    assert main(["balance", texts, f"file://{tmp_path}/fit-lattice"]) == 2


def test_prints_an_analysis_and_keeps_a_record(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(tree()))
    assert main(["analyze", f"file://{tmp_path}/r.json", "merges", "candidates", "1", "2"]) == 0
    assert "| org/a / accuracy |" in capsys.readouterr().out
    assert main(["record", str(tmp_path / "e.json"), f"results={tmp_path}/r.json", f"plan={tmp_path}/none"]) == 0
    assert json.loads((tmp_path / "e.json").read_text())["missing"] == ["plan"]
