"""The command line on small files."""

import json

import pytest

from tests.test_operators import LOG
from trackframe.__main__ import main
from trackframe.sources import generators, sessions


def test_session_commands(spark, tmp_path, capsys):
    log = tmp_path / "s.jsonl"
    log.write_text("\n".join(json.dumps(x) for x in LOG))
    assert main(["report", str(log), "--json", str(tmp_path / "r.json")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text())["fps_avg"] == 25.0
    assert main(["csv", str(log), str(tmp_path / "csv")], spark) == 0
    assert capsys.readouterr().out.strip().endswith("2")


def test_track_and_analyze(spark, tmp_path, capsys):
    generators.synthetic_frames(spark, 20).write.parquet(str(tmp_path / "frames"))
    generators.synthetic_detections(spark, 20, 4).write.parquet(str(tmp_path / "det"))
    for kind in ("full", "lite"):
        assert main(["track", str(tmp_path / "frames"), str(tmp_path / "det"), str(tmp_path / kind), "--tracker", kind], spark) == 0
        assert spark.read.parquet(str(tmp_path / kind)).select("track_id").distinct().count() == 4
    assert main(["analyze", str(tmp_path / "frames"), str(tmp_path / "det"), str(tmp_path / "out")], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"tracklets": 0, "entities": 0, "edges": 0}
    assert (tmp_path / "out" / "graph.html").exists()


def test_track_with_a_preset_and_a_log(spark, tmp_path):
    generators.synthetic_frames(spark, 20).write.parquet(str(tmp_path / "frames"))
    generators.synthetic_detections(spark, 20, 4).write.parquet(str(tmp_path / "det"))
    (tmp_path / "c.json").write_text('{"max_frames": 12, "classes": "class_0,class_1"}')
    flags = ["--preset", "cpu-safe", "--config", str(tmp_path / "c.json"), "--session-log", str(tmp_path / "log"), "--conf", "0.3", "--iou", "0.9", "--max-frames", "13"]
    assert main(["track", str(tmp_path / "frames"), str(tmp_path / "det"), str(tmp_path / "out"), *flags], spark) == 0
    states = spark.read.parquet(str(tmp_path / "out"))
    # every third frame is detected, the command line's number of frames wins over the file's, two classes of three stay
    assert [r.frame for r in states.select("frame").distinct().orderBy("frame").collect()] == list(range(1, 14))
    assert {r.class_id for r in states.select("class_id").distinct().collect()} == {0, 1}
    rows = sessions.read_sessions(spark, str(tmp_path / "log"))
    assert [r["count"] for r in rows.groupBy("type").count().orderBy("type").collect()] == [1, 13, 1]
    assert rows.orderBy("line").first().type == "header"
    with pytest.raises(ValueError):
        main(["track", str(tmp_path / "frames"), str(tmp_path / "det"), str(tmp_path / "no"), "--view", "thermal"], spark)


def test_small_commands(spark, tmp_path, capsys):
    (tmp_path / "a.mp4").write_bytes(b"abc")
    assert main(["videos", str(tmp_path)], spark) == 0 and "a.mp4" in capsys.readouterr().out
    assert main(["hash", str(tmp_path)], spark) == 0 and "ba7816bf" in capsys.readouterr().out
    cal = tmp_path / "c.json"
    assert main(["fov", "--object-px", "100", "--frame-px", "200", "--distance", "1", "--size", "1", "--save", str(cal), "--width", "200", "--height", "100"], spark) == 0
    assert capsys.readouterr().out.strip() == "90.000" and json.loads(cal.read_text())["width"] == 200
    (tmp_path / "p.json").write_text('{"profile": "speed"}')
    assert main(["check-config", str(tmp_path / "p.json")]) == 0
    assert main(["benchmark", "--frames", "60", "--targets", "4", "--least-fps", "0.1"], spark) == 0
    with pytest.raises(SystemExit):
        main(["track", "--prof", "lite"])
