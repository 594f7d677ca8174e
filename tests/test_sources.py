"""Checkpoints, the model connector, streaming rates and reports."""

import json

import pytest

from verdictspark.operators import origins
from verdictspark.plans import reports
from verdictspark.sources import checkpoints, models
from verdictspark.streaming import cells
from verdictspark.streaming.verdicts import windowed_rates


def _record(condition, probs, **more):
    return {"auditor": "m", "condition": condition, "family": "F1", "item_ids": ["a", "b"], "per_item_probs": probs} | more


def test_cells_round_trip(spark, tmp_path):
    (tmp_path / "m__R0__F1.json").write_text(json.dumps(_record("R0", [0.5, float("nan")]), indent=1))
    (tmp_path / "m__R1__F1.json").write_text(json.dumps(_record("R1", [1.0, 0.25], episode_ids=["x", "y"]), indent=1))
    cells = checkpoints.read_cells(spark, str(tmp_path))
    rows = checkpoints.item_rows(cells)
    assert {(r["condition"], r["item_id"]): (r["p"], r["episode_id"]) for r in rows.collect()} == {("R0", "a"): (0.5, None), ("R0", "b"): (None, None), ("R1", "a"): (1.0, "x"), ("R1", "b"): (0.25, "y")}
    back = {r["condition"]: r for r in checkpoints.cell_records(rows).collect()}
    assert back["R0"]["far"] == 0.5 and back["R1"]["item_ids"] == ["a", "b"]
    checkpoints.require_same_items(rows, "R0")
    with pytest.raises(ValueError, match="items differ"):
        checkpoints.require_same_items(rows.where("not (condition = 'R1' and item_id = 'a')"), "R0")
    out = str(tmp_path / "table")
    checkpoints.write_partitioned(rows.where("condition = 'R0'"), out)
    checkpoints.write_partitioned(rows.where("condition = 'R1'"), out)
    done = spark.read.parquet(out)
    assert done.count() == 4
    work = spark.createDataFrame([("R0",), ("R2",)], "condition string")
    assert [r[0] for r in checkpoints.outstanding(work, done, ["condition"]).collect()] == ["R2"]
    with pytest.raises(ValueError, match="missing"):
        checkpoints.require_all(work, done, "condition")


def test_unequal_arrays_are_refused(spark, tmp_path):
    (tmp_path / "m__R0__F1.json").write_text(json.dumps(_record("R0", [0.5])))
    with pytest.raises(Exception, match="lengths differ"):
        checkpoints.item_rows(checkpoints.read_cells(spark, str(tmp_path))).collect()


def test_conditions_from_three_folders(spark, tmp_path):
    """The first listing of a condition counts, and its baseline is its own folder's."""
    for folder, cells in (("ladder", {"R0": [0.5, 0.25], "R1": [1.0, 0.5]}), ("r4", {"R0": [0.0, 1.0], "R1": [0.1, 0.2], "AS": [0.75, None]}), ("more", {"AX": [1.0, 1.0], "AS": [0.0, 0.0]})):
        (tmp_path / folder).mkdir()
        for c, p in cells.items():
            (tmp_path / folder / f"m__{c}__F1.json").write_text(json.dumps(_record(c, [float("nan") if x is None else x for x in p])))
    folders = [f"{tmp_path}/{f}" for f in ("ladder", "r4", "more")]
    rows = checkpoints.item_rows(checkpoints.read_origins(spark, folders))
    got = {(r["condition"], r["item_id"]): (r["place"], r["p"], r["p0"]) for r in origins.against_own_baseline(rows, ["auditor"]).collect()}
    assert got == {("R1", "a"): (0, 1.0, 0.5), ("R1", "b"): (0, 0.5, 0.25), ("AS", "a"): (1, 0.75, 0.0), ("AS", "b"): (1, None, 1.0)}
    again = {(r["condition"], r["place"]) for r in origins.first_listed(checkpoints.item_rows(checkpoints.read_origins(spark, folders[::-1])), ["auditor"]).collect()}
    assert again == {("AX", 0), ("AS", 0), ("R0", 1), ("R1", 1)}
    assert origins.require_same_items(rows, ["auditor"]).count() == 14
    with pytest.raises(Exception, match="m/R1 has 1 items, its baseline 2"):
        origins.require_same_items(rows.where("not (condition = 'R1' and place = 0 and item_id = 'a')"), ["auditor"]).count()


def test_endpoints():
    assert models.Endpoint.parse("a=b@http://h:1/v1") == models.Endpoint("a", "b", "http://h:1/v1")
    for bad in ("a", "a=b", "=b@u", "a=@u"):
        with pytest.raises(ValueError):
            models.Endpoint.parse(bad)


def test_generation_pads_short_replies_and_fails_without_answer(spark):
    kind = "item_id long, messages array<struct<role: string, content: string>>"

    def answer(endpoint, turns, n):
        if turns[0]["content"] == "down":
            raise OSError("no route")
        return [f"{endpoint.label}:{turns[0]['content']}"]

    endpoint = models.Endpoint("m", "x", "u")
    got = models.generate(spark.createDataFrame([(1, [("user", "q")])], kind), answer, endpoint, 2, pause=0.0).collect()
    assert [(r["item_id"], r["sample"], r["raw"]) for r in got] == [(1, 0, "m:q"), (1, 1, None)]
    with pytest.raises(Exception, match="m gave no answer in 3 attempts; the last failed with OSError: no route"):
        models.generate(spark.createDataFrame([(2, [("user", "down")])], kind), answer, endpoint, 2, pause=0.0).collect()


def test_streaming_rates(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "m", "R0", 1, True), ("2024-01-01 00:20:00", "m", "R0", 0, False), ("2024-01-01 05:00:00", "m", "R0", 0, True)]
    df = spark.createDataFrame(rows, "ts string, auditor string, condition string, flag int, parsed boolean").selectExpr("cast(ts as timestamp) ts", "auditor", "condition", "flag", "parsed")
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates_test").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from rates_test").collect()
    assert [(r["report_rate"], r["parse_ok_rate"], r["n"]) for r in got] == [(1.0, 0.5, 2)]


def test_reports(spark):
    x = spark.createDataFrame([("a", "+1.00*"), ("b", None)], "auditor string, effect string")
    assert "| a | +1.00* |" in reports.to_markdown(x)
    assert r"\midrule" in reports.to_latex(x, "auditor", "c", "tab:x")


def test_commands(capsys):
    from verdictspark import catalog, cli

    assert cli.main(["nothing"]) == 2
    assert all(q in catalog.QUERIES for qs in cli.COMMANDS.values() for q in qs)


def test_cells_that_arrive_late(spark, tmp_path):
    """A stream over a folder ends in what a scan of it gives, in whatever order files come."""
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def put(name, condition, probs):
        (folder / name).write_text(json.dumps(_record(condition, probs)))

    def caught_up():
        cells.follow(cells.cell_stream(spark, str(folder)), out, check).awaitTermination()
        got = {(r["condition"], r["item_id"], r["p"]) for r in spark.read.parquet(out).collect()}
        assert got == {(r["condition"], r["item_id"], r["p"]) for r in checkpoints.item_rows(checkpoints.read_cells(spark, str(folder))).collect()}
        return got

    put("m__R0__F1_b.json", "R0", [0.5, 0.25])
    put("m__R1__F1.json", "R1", [1.0, float("nan")])
    assert len(caught_up()) == 4
    put("m__R0__F1_a.json", "R0", [0.0, 0.0])
    assert ("R0", "a", 0.5) in caught_up()
    put("m__R0__F1_c.json", "R0", [0.75, 0.125])
    put("m__AS__F1.json", "AS", [0.2, 0.3])
    assert {("R0", "a", 0.75), ("AS", "b", 0.3), ("R1", "a", 1.0)} <= caught_up()


def test_every_samples_evidence_is_kept(spark, tmp_path):
    rows = [("m", "F1", c, "i", s, raw) for c in ("R0", "R1") for s, raw in enumerate(('{"verdict": "correct"}', None))]
    seen = spark.createDataFrame(rows, "auditor string, family string, condition string, item_id string, sample int, raw string")
    out = str(tmp_path / "evidence")
    checkpoints.write_evidence(seen, out)
    checkpoints.write_evidence(seen.where("condition = 'R1' and sample = 1"), out)
    got = spark.read.parquet(out)
    assert sorted((r["condition"], r["sample"]) for r in got.collect()) == [("R0", 0), ("R0", 1), ("R1", 1)] and got.where("raw is null").count() == 2
