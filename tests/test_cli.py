"""The command line on one note."""

import json

import pytest

from weftline.cli import main


def test_note_to_json(spark, tmp_path):
    (tmp_path / "n.txt").write_text("Reach ida@berg.no or +1 202 555 0142.", encoding="utf-8")
    shape = {"fields": [{"name": "mails", "path": "emails", "type": "array"}, {"name": "id", "path": "candidate_id", "type": "string", "on_missing": "error"}]}
    (tmp_path / "c.json").write_text(json.dumps(shape))
    assert main(["--notes", str(tmp_path / "n.txt"), "--config", str(tmp_path / "c.json"), "--output", str(tmp_path / "o.json")], spark) == 0
    out = json.loads((tmp_path / "o.json").read_text())
    assert out["mails"] == ["ida@berg.no"] and out["id"].startswith("cand_")


def test_missing_file(spark, tmp_path):
    with pytest.raises(SystemExit):
        main(["--csv", str(tmp_path / "none.csv")], spark)
