"""Generation over recorded answers: requests, attempts, pools, refusals, the chat client."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictspark import cli
from verdictspark.functions import audits, prompts
from verdictspark.operators import generation, simulation
from verdictspark.plans import reports
from verdictspark.sources import checkpoints, models

STEPS = ["We have 3 apples.", "So 3 + 4 = 7.", "Then 7 * 2 = 14.", "The answer is 14."]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_injection_request(spark):
    got = one(spark, prompts.injection_messages(F.col("steps"), F.col("k"), F.col("family")), steps=STEPS, k=2, family="local")
    assert [m["role"] for m in got] == ["system", "user"] and got[0]["content"] == prompts.FAULT_SYSTEM
    numbered = "\n".join(f"Step {i}: {s}" for i, s in enumerate(STEPS, 1))
    assert got[1]["content"] == (
        f"Correct solution:\n{numbered}\n\nTARGET STEP: 2\n\nThe target step asserts: {(3.0, 4.0)} joined by {('+',)} equals 7.\n\n{prompts.FAULT_BRIEFS['local']}\n\n"
        "Return exactly 3 steps: the rewritten Step 2 through Step 4, separated by ---STEP---, propagating the consequences so no later step is inconsistent."
    )
    last = one(spark, prompts.injection_messages(F.col("steps"), F.col("k"), F.col("family")), steps=STEPS, k=4, family="structural")
    assert "TARGET STEP: 4\n\n\n" in last[1]["content"] and "Return exactly 1 steps" in last[1]["content"]
    for k, family in ((1, "local"), (5, "local"), (2, "other")):
        with pytest.raises(Exception, match="a fault needs"):
            one(spark, prompts.injection_messages(F.col("steps"), F.col("k"), F.col("family")), steps=STEPS, k=k, family=family)


@pytest.mark.parametrize("value", [7.0, -3.0, 0.5, 12.25, 1234567.0, 0.00001234, 100000.0, 999999.5, 3.14159265, 2.50001, 1e15])
def test_short_numbers_are_printed_as_g(spark, value):
    assert spark.range(1).select(prompts.short_number(F.lit(value)).alias("x")).first()["x"] == f"{value:g}"


def test_first_accepted_attempt(spark):
    good = "So 3 + 4 = 8.\n---STEP---\nThen 8 * 2 = 16.\n---STEP---\nThe answer is 16."
    stale = "So 3 + 4 = 8.\n---STEP---\nThen 7 * 2 = 14.\n---STEP---\nThe answer is 14."
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, good), ("b", 1, stale), ("b", 2, None), ("c", 1, good), ("c", 2, stale)]
    tries = spark.createDataFrame(rows, "id string, attempt int, raw string").withColumn("steps", F.array(*[F.lit(s) for s in STEPS])).withColumn("k", F.lit(2))
    got = {r["id"]: r for r in generation.first_accepted(tries, ["id"]).collect()}
    assert (got["a"]["attempt"], got["a"]["tried"], got["a"]["reasons"]) == (3, 3, ["no generation", "step count mismatch in suffix"])
    assert got["a"]["injected"][1:] == ["So 3 + 4 = 8.", "Then 8 * 2 = 16.", "The answer is 16."]
    assert not got["b"]["accepted"] and got["b"]["tried"] == 2 and "no generation" in got["b"]["reasons"] and len(got["b"]["reasons"]) > 2
    assert (got["c"]["attempt"], got["c"]["reasons"]) == (1, [])
    pairs = spark.createDataFrame([("x", 0, True), ("x", 1, True), ("y", 0, True), ("y", 1, False), ("z", 0, True)], "id string, family int, accepted boolean")
    assert {r["id"]: r["complete"] for r in generation.complete_pairs(pairs, ["id"], 2).collect()} == {"x": True, "y": False, "z": False}


def test_pools_and_refusals(spark):
    audit = lambda v: json.dumps({"verdict": v, "confidence": 0.5, "first_error_step": 2, "evidence": "e"})
    rows = [(3, "c", audit("incorrect"), "r"), (1, "a", f" {audit('correct')}\n", " fixed "), (2, "b", "no json", "r"), (4, "d", audit("correct"), None), (5, "e", None, "r")]
    pool = generation.episodes(spark.createDataFrame(rows, "pos long, item_id string, audit_raw string, repair_raw string"), F.lit(4))
    got = pool.orderBy("pos").collect()
    assert [(r["pos"], r["item_id"], r["reported_error"], r["repair"]) for r in got] == [(0, "a", False, "fixed"), (1, "c", True, "r")]
    assert generation.require_all_incorrect(pool.where("reported_error")).count() == 1
    with pytest.raises(Exception, match="an audit reports no error: a"):
        generation.require_all_incorrect(pool).collect()
    behind = generation.items_behind(
        spark.createDataFrame([(0, "t", None), (1, "u", ["i"]), (2, "v", None)], "pos int, trace string, inline array<string>"), spark.createDataFrame([("t", ["s"]), ("u", ["no"])], "trace string, steps array<string>"), "trace"
    )
    assert {r["pos"]: (r["steps"], r["source"]) for r in behind.collect()} == {0: (["s"], "lookup"), 1: (["i"], "inline"), 2: (None, "refused")}
    with pytest.raises(Exception, match="episode without steps: 2"):
        generation.require_items(behind).collect()
    assert generation.cells_to_run(" AN ,R0", ("R0", "AS", "AN")) == ("R0", "AN") and generation.cells_to_run(" ", ("R0",)) == ("R0",)
    for asked, said in (("XX", "no such cell"), ("AF", "inputs not given")):
        with pytest.raises(ValueError, match=said):
            generation.cells_to_run(asked, ("R0", "AS"))
    with pytest.raises(ValueError, match="unknown conditions"):
        generation.require_conditions(["R0", "R9"], tuple(prompts.CONDITIONS))
    cells = spark.createDataFrame([(0.4, 3, 10), (0.4, 0, 10), (0.6, 3, 10)], "ok double, cut long, n long").select("ok", "cut", generation.guard(F.col("ok"), F.col("cut"), F.col("n")).alias("why")).collect()
    assert [r["why"] for r in cells] == [generation.refusal(0.4, 3, 10), generation.refusal(0.4, 0, 10), None]
    assert cells[0]["why"].startswith("too few answers parsed (40.0%): 3 of 10") and "none was cut off" in cells[1]["why"]


def test_the_last_of_repeated_keys_counts(spark):
    raw = '{"verdict": "correct", "verdict": "incorrect", "confidence": 2, "confidence": 0.25, "first_error_step": 1, "evidence": "x"}'
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    try:
        got = one(spark, audits.parse_audit(F.col("raw"), F.lit(3)), raw=raw)
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    assert (got["verdict"], got["confidence"], got["first_error_step"]) == ("incorrect", 0.25, 1)


class _Server(http.server.BaseHTTPRequestHandler):
    seen: list[dict] = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append(body)
        text = body["messages"][-1]["content"]
        reply = {"choices": [{"message": {"content": f"{text}{i}"}, "finish_reason": "stop"} for i in range(body["n"] - 1)], "usage": {"prompt_tokens": 3, "completion_tokens": 8}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(reply).encode())

    def log_message(self, *args):
        pass


def test_chat_requests(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        endpoint = models.Endpoint("a", "m", f"http://127.0.0.1:{server.server_port}/v1/")
        asked = spark.createDataFrame([(1, [("user", "x")]), (2, [("user", "y")])], "item_id int, messages array<struct<role: string, content: string>>")
        got = models.generate(asked, models.chat(0.7, 64, {"type": "object"}, 5, False), endpoint, 3).collect()
        assert sorted((r["item_id"], r["sample"], r["raw"]) for r in got if r["raw"]) == [(1, 0, "x0"), (1, 1, "x1"), (2, 0, "y0"), (2, 1, "y1")]
        assert sum(r["kind"] == "sample" and r["raw"] is None for r in got) == 2
        assert {(r["item_id"], r["completion_tokens"], r["n"], tuple(r["finish_reasons"])) for r in got if r["kind"] == "usage"} == {(1, 8, 3, ("stop", "stop")), (2, 8, 3, ("stop", "stop"))}
        used = models.chat(0.0, 8)(models.Endpoint("a", "m", f"http://127.0.0.1:{server.server_port}"), [{"role": "user", "content": "z"}], 2).usage
    finally:
        server.shutdown()
    assert used == {"prompt_tokens": 3, "completion_tokens": 8, "n": 2, "finish_reasons": ["stop"]}
    full = models.payload(endpoint, [], 2, 0.5, 9, {"a": 1}, 0, True)
    assert full["seed"] == 0 and full["chat_template_kwargs"] == {"enable_thinking": True} and full["response_format"]["json_schema"] == {"name": "audit", "schema": {"a": 1}, "strict": True}
    assert set(models.payload(endpoint, [], 1, 0.0, 9)) == {"model", "messages", "n", "temperature", "max_tokens"}


def test_artefacts_by_wording_and_records(spark, tmp_path):
    for name, value in (("scored.json", 1), ("scored_F3.json", 3), ("other_F2.json", 9)):
        (tmp_path / name).write_text(json.dumps({"auditor": "m", "value": value}))
    got = checkpoints.read_wordings(spark, str(tmp_path), "scored", "auditor string, value int")
    assert {(r["wording"], r["value"]) for r in got.collect()} == {("F1", 1), ("F3", 3)}
    cells = spark.createDataFrame([("m", "R0", "F1", [0.5, None], False, 512), ("m", "R1", "F1", [1.0, 0.0], True, 512)], "auditor string, condition string, family string, per_item_probs array<double>, thinking boolean, max_tokens int")
    out = str(tmp_path / "records")
    checkpoints.write_records(cells, out)
    back = spark.read.json(out)
    assert {(r["condition"], tuple(r["per_item_probs"])) for r in back.collect()} == {("R0", (0.5, None)), ("R1", (1.0, 0.0))}
    with pytest.raises(ValueError, match="differ in thinking"):
        checkpoints.require_same_budget(cells)
    checkpoints.require_same_budget(cells.where("condition = 'R0'"))


def test_commands(spark, sf_dir, tmp_path, capsys):
    from verdictspark import catalog

    assert len(cli.COMMANDS) == 23 and all(set(names) <= set(catalog.QUERIES) for names in cli.COMMANDS.values())
    assert cli.main(["nothing", sf_dir]) == 2 and cli.main(["allocate"]) == 2
    assert cli.main(["determinism_probe", sf_dir, "--out", str(tmp_path)]) == 0 and "| auditor |" in capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/determinism_probe").count() == 3
    assert cli.main(["greedy_pass", sf_dir, "--format", "latex"]) == 0 and r"\begin{tabular}" in capsys.readouterr().out


def test_panel_letters():
    assert [reports.panel_letter(("p", "q"), x) for x in ("p", "q")] == ["a", "b"]


def test_two_stages_cover_more_and_concentration_is_found(spark):
    rng = np.random.default_rng(2)
    effects = rng.normal(0, 1, 30)
    cluster = np.repeat(np.arange(30), 9)
    values = effects[cluster] + rng.normal(0, 1, len(cluster))
    two = simulation.two_stage_bootstrap(values, cluster, 400, rng)
    means = np.array([values[np.concatenate([np.flatnonzero(cluster == c) for c in rng.integers(0, 30, 30)])].mean() for _ in range(400)])
    assert two.std() > means.std() and abs(two.mean() - values.mean()) < 0.1
    p = simulation.observe(rng, simulation.propensities(rng, 0.3, 5.0, 20_000), 8)
    assert simulation.fit_concentration(p, 8) == pytest.approx(5.0, rel=0.15)
    exact = simulation.power(spark, [(0.1, 0.2, "logit", 200)], reps=60, exact=True).first()
    normal = simulation.power(spark, [(0.1, 0.2, "logit", 200)], reps=60).first()
    assert exact["studies"] == 60 and abs(exact["power"] - normal["power"]) < 0.15
