"""OCR results, image links, fallback chains and the command line."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.sources import images, ocr, readers


def test_ocr_results(spark):
    result = {"pages": [{"lines": [{"text": "First line", "confidence": 0.5}, {"text": "First line"}, {"content": "Second"}]}, {"lines": []}, {"blocks": [{"label": "Table", "html": "<p>cell</p>", "score": 1.0}]}]}
    by_name = {"one": {"text": "a"}, "two": {"text": "b"}}
    rows = [json.dumps(result), json.dumps(by_name), json.dumps([{"markdown": "m"}]), json.dumps({"x": [{"text": "p"}], "y": [{"text": "q"}]}), "no json", None, "{}"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, r string").orderBy("i").select(ocr.read_result("r")).collect()]
    assert got[0].text == "<!-- page 1 -->\n\nFirst line\nSecond\n\n<!-- page 3 -->\n\ncell"
    assert (got[0].n_pages, got[0].n_blocks, got[0].n_table_blocks, got[0].mean_confidence) == (3, 4, 1, 0.75)
    assert [got[k].text for k in (1, 2, 3)] == ["<!-- page 1 -->\n\na\n\n<!-- page 2 -->\n\nb", "<!-- page 1 -->\n\nm", "<!-- page 1 -->\n\np\n\n<!-- page 2 -->\n\nq"]
    assert got[4].text is None and got[5].text is None and (got[6].text, got[6].n_pages) == ("", None)


def test_image_links(spark):
    text = '![a](img/x.png "t") ![b](<../y z.png>) ![c](http://h/x.png) ![d](data:image/png;base64,AA==) ![e](img/x.png) ![f](gone.png)'
    texts = spark.createDataFrame([(1, text, "file:/d/s/doc.md"), (2, "none", "file:/d/s/b.md")], "id int, text string, path string")
    files = spark.createDataFrame([("file:/d/s/img/x.png", b"X"), ("file:/d/y z.png", b"Y")], "path string, content binary")
    got = {r.target: r.url for r in images.data_urls(texts, files, ["id"], "text", "path").collect()}
    assert got == {"img/x.png": "data:image/png;base64," + base64.b64encode(b"X").decode(), "../y z.png": "data:image/png;base64," + base64.b64encode(b"Y").decode(), "data:image/png;base64,AA==": "data:image/png;base64,AA=="}


def test_fallback_chain(spark):
    def broken(raw, suffix):
        raise ValueError("bad file")

    registry = readers.Registry()
    registry.register("opendataloader-pdf", broken)
    registry.register("text-fallback", lambda raw, suffix: readers.Parsed(raw.decode(), raw.decode()) if raw else None)
    files = spark.createDataFrame([("a.pdf", b"words"), ("b.pdf", b""), ("c.txt", b"plain")], "path string, content binary")
    got = {r.path: r for r in readers.parse_with_fallback(files, registry).collect()}
    assert (got["a.pdf"].parser_name, got["a.pdf"].content) == ("text-fallback", "words")
    assert got["a.pdf"].errors == ["opendataloader-pdf: ValueError: bad file", "layout-first-pdf: not_registered"]
    assert got["b.pdf"].parser_name is None and got["b.pdf"].errors[-1] == "text-fallback: no_candidates_produced"
    assert (got["c.txt"].parser_name, list(got["c.txt"].errors)) == ("text-fallback", [])
    with pytest.raises(ValueError, match="unknown parsers: nope"):
        registry.validate(["text-fallback", "nope"])


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "data" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# Title\n\n\n\nSome words here.\n\nSome words here.")
    (folder / "b.csv").write_text("x,y\n1,2\n")
    (folder / "c.pdf").write_bytes(b" ")
    assert cli.main([str(tmp_path / "data"), f"file://{tmp_path}/out", "--rounds", "1"]) == 0
    assert "2 of 3 files" in capsys.readouterr().out
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert rows["a.md"].folder.endswith("/out/sub/a") and "# Title" in rows["a.md"].text and rows["c.pdf"].text is None
    assert cli.main(["x", "y", "--graph"]) == 0 and "parse_document --> evaluate_candidate" in capsys.readouterr().out


def test_windows_are_appended_once_they_are_closed(spark, tmp_path):
    from quillspark.streaming import usage

    source, out = tmp_path / "calls", f"file://{tmp_path}/usage"
    source.mkdir()
    schema = "ts timestamp, stage string, duration_ms long"

    def arrive(name: str, *rows: tuple) -> None:
        (source / name).write_text("".join(json.dumps({"ts": t, "stage": s, "duration_ms": d}) + "\n" for t, s, d in rows))
        stream = spark.readStream.schema(schema).json(f"file://{source}")
        usage.write(stream, out).trigger(availableNow=True).start().awaitTermination()

    arrive("1.json", ("2024-01-01T00:10:00", "judge", 5), ("2024-01-01T00:20:00", "judge", 7), ("2024-01-01T01:00:00", "parse", 1))
    assert spark.read.parquet(f"{out}/windows").count() == 0 if list((tmp_path / "usage" / "windows").glob("*.parquet")) else True
    arrive("2.json", ("2024-01-01T09:00:00", "parse", 2))
    arrive("3.json", ("2024-01-01T00:30:00", "judge", 99), ("2024-01-01T09:10:00", "parse", 3))  # the first is too late
    got = {(str(r.window_start), r.stage): (r.calls, r.duration_ms) for r in spark.read.parquet(f"{out}/windows").collect()}
    assert got == {("2024-01-01 00:00:00", "judge"): (2, 12), ("2024-01-01 01:00:00", "parse"): (1, 1)}
