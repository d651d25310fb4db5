from __future__ import annotations

import json

from tessera.__main__ import _parser, main, run
from tessera.sources.sinks import mock_panel


def test_parse_command(capsys):
    main(["parse", "--formula", "a=Add($close, $open)"])
    assert json.loads(capsys.readouterr().out)["canonical"] == "Add($close, $open)"


def test_panel_commands(spark, tmp_path):
    mock_panel(spark, 12, 40).write.parquet(str(tmp_path / "p"))
    go = lambda *a: run(_parser().parse_args([a[0], str(tmp_path / "p"), *a[1:]]), spark)
    assert go("validate-data").first().n_assets == 12
    assert go("resample-data", "--rule", "1 hour").count() < 12 * 40
    stats = go("evaluate", "--formula", "m=CsRank($volume)", "--formula", "r=Neg(Delta($close, 1))").collect()
    assert {r.factor for r in stats} == {"m", "r"}
    assert go("backtest", "--formula", "CsRank($close)").count() == 40
    assert go("combine", "--formula", "$close", "--formula", "$volume").count() == 480
