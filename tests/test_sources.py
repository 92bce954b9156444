import json

import pytest

from pagewright.operators import layout_stats
from pagewright.plans import jobs
from pagewright.sources import configs, records, sinks
from pagewright.streaming import scoring as streaming


def layout(path, texts):
    return {"layout_dets": [{"text": t, "order": i} for i, t in enumerate(texts)], "page_info": {"image_path": path}}


def test_truth_and_predictions(spark, tmp_path):
    gt = tmp_path / "gt.json"
    gt.write_text(json.dumps([layout("a/p1.png", ["x", "ignored"]), layout("b/p1.png", ["y"]), layout("p2.png", [""]), layout("", ["z"]), layout("p3.png", [])]))
    assert [tuple(r) for r in records.ground_truth(spark, str(gt)).collect()] == [("p1", "y")]
    folder = tmp_path / "pred"
    (folder / "below").mkdir(parents=True)
    (folder / "p1.md").write_text("y\n")
    (folder / "p9.md").write_text("q")
    (folder / "note.txt").write_text("no")
    assert sorted(tuple(r) for r in records.predictions(spark, str(folder)).collect()) == [("p1", "y\n"), ("p9", "q")]
    pages, summary, lacking = jobs.evaluate(spark, str(gt), str(folder), str(tmp_path / "out"))
    assert summary.first()["cer_mean"] == 0 and [tuple(r) for r in lacking.collect()] == [("p9", "truth")]
    assert "cer_mean: 0.0000" in sinks.printed(summary)
    with pytest.raises(FileNotFoundError):
        records.predictions(spark, str(tmp_path / "none"))


def test_lines_and_lists(spark, tmp_path):
    f = tmp_path / "l.jsonl"
    f.write_text('{"unique_id":"a","image_paths":["i/a_page_001.png"],"bboxes":[[[1,2,3,4,"t"]]]}\n\nbroken\n{"unique_id":"b","image_paths":null,"bboxes":null}\n')
    rows = records.line_boxes(spark, str(f))
    assert rows.where("unique_id = 'a'").first()["bboxes"][0][0]["text"] == "t"
    assert layout_stats.totals(rows).first()["boxes"] == 1
    from pagewright import schemas

    read = records.json_lines(spark, str(f), schemas.LINE_BOX, report=True).collect()
    assert [r["_corrupt_record"] for r in read if r["_corrupt_record"]] == ["broken"]
    ids = tmp_path / "ids.txt"
    ids.write_text(" a \n\nb\na\n")
    assert sorted(r["id"] for r in records.id_list(spark, str(ids)).collect()) == ["a", "b"]
    assert records.id_list(spark, None).count() == 0
    with pytest.raises(FileNotFoundError):
        records.id_list(spark, str(tmp_path / "no"), must_exist=True)
    out = str(tmp_path / "list")
    sinks.id_file(spark.createDataFrame([("c",)], "id string"), out)
    sinks.id_file(spark.createDataFrame([("a",)], "id string"), out)
    assert [r["value"] for r in spark.read.text(out).collect()] == ["a", "c"]
    sinks.id_file(spark.createDataFrame([("z",)], "id string"), out, union=False)
    assert [r["value"] for r in spark.read.text(out).collect()] == ["z"]


def test_images(spark, tmp_path):
    for s, n in (("clean", "a_page_001.png"), ("adv_x", "b.JPG"), ("adv_x", "c.txt")):
        (tmp_path / s / "images").mkdir(parents=True, exist_ok=True)
        (tmp_path / s / "images" / n).write_bytes(b"1")
    files = records.images(spark, str(tmp_path), recursive=True)
    assert sorted(r["name"] for r in files.collect()) == ["a_page_001.png", "b.JPG"]
    assert sorted(r["split"] for r in records.splits(files).collect()) == ["adv_x", "clean"]


def test_configs(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({**configs.DEFAULTS, "font-path": "x.ttf", "page-size": "595,842", "alignment": "odd", "font-color": "#ABCDEF"}))
    c = configs.render_config(str(f))
    assert (c["page-size"], c["alignment"], c["font-color"]) == ((595.0, 842.0), "JUSTIFY", "#abcdef")
    with pytest.raises(ValueError, match="missing"):
        configs.validated({})
    with pytest.raises(ValueError, match="not a number"):
        configs.validated({**c, "dpi": "x"})
    f.write_text(json.dumps({"model_name": "m", "max_tokens": 1}))
    assert configs.model_config(str(f))["model_name"] == "m"
    with pytest.raises(ValueError, match="prompt"):
        configs.model_config(str(f), need_prompt=True)


def test_stream(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    gt = spark.createDataFrame([("p1", "abc"), ("p2", "x")], "page_id string, text string")

    def run():
        streaming.write_scores(streaming.score_stream(streaming.prediction_stream(spark, folder), gt), out, mark, once=True).awaitTermination()
        return sorted((r["page_id"], r["cer"]) for r in spark.read.parquet(out).collect())

    (tmp_path / "in" / "p1.md").write_text("abc")
    assert run() == [("p1", 0.0)]
    (tmp_path / "in" / "p2.md").write_text("y")
    assert run() == [("p1", 0.0), ("p2", 100.0)]


def test_page_files_are_written_read_and_scored(spark, tmp_path):
    pages = spark.createDataFrame([("a_page_001", "one\ntwo"), ("b", ""), ("c", None)], "page_id string, text string")
    out = str(tmp_path / "md")
    assert sinks.page_files(pages, out) == 3 and sinks.page_files(pages, out) == 3
    assert sorted(p.name for p in (tmp_path / "md").iterdir()) == ["a_page_001.md", "b.md", "c.md"]
    read = records.predictions(spark, out)
    assert sorted(tuple(r) for r in read.collect()) == [("a_page_001", "one\ntwo\n"), ("b", "\n"), ("c", "\n")]
    gt = tmp_path / "gt.json"
    gt.write_text(json.dumps([layout("x/a_page_001.png", ["one two"]), layout("b.png", ["z"])]))
    pages, summary, lacking = jobs.evaluate(spark, str(gt), out)
    assert sorted((r["page_id"], r["cer"]) for r in pages.collect()) == [("a_page_001", 0.0), ("b", 100.0)] and lacking.count() == 1
    with pytest.raises(Exception, match="not a file name"):
        sinks.page_files(spark.createDataFrame([("a/b", "x")], "page_id string, text string"), out)


def test_overlays_leave_what_is_there(spark, tmp_path):
    import numpy as np

    from pagewright.functions import png

    (tmp_path / "in").mkdir()
    for n in ("a_page_001.png", "b_page_001.png"):
        (tmp_path / "in" / n).write_bytes(png.encode(np.full((20, 30), 255, np.uint8)))
    images = records.images(spark, str(tmp_path / "in"))
    boxes = spark.sql("SELECT 'a_page_001.png' AS name, array(named_struct('x0', 1, 'y0', 1, 'x1', 9, 'y1', 9, 'text', 't')) AS boxes UNION ALL SELECT 'b_page_001.png', array()")
    out = str(tmp_path / "viz")
    assert sinks.overlays(images, boxes, out) == 2
    seen = png.decode((tmp_path / "viz" / "a_page_001.png").read_bytes())
    assert seen.shape == (20, 30, 3) and seen[1, 5].tolist() == [0, 0, 0] and seen[15, 25].tolist() == [255] * 3
    assert sinks.overlays(images, boxes, out) == 0 and sinks.overlays(images, boxes, out, overwrite=True) == 2
