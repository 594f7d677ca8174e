"""Runs on a recorded server: chains of requests, commits, resuming, refusals, pools."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle

from verdictspark.functions import prompts
from verdictspark.operators import served
from verdictspark.sources import checkpoints, models
from verdictspark.sources.runs import Run

# Workers don't know this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
ENDPOINT = models.Endpoint("m", "x", "http://none")
ITEM = "item_id string, problem string, steps array<string>, pos long"


def audit(verdict):
    return json.dumps({"verdict": verdict, "first_error_step": 1 if verdict == "incorrect" else None, "confidence": 0.5, "error_type": None, "evidence": "e"})


class Recorded:
    """Answers by the number in the problem, and keeps what was asked in a file that tasks share."""

    def __init__(self, log, fails_after=None):
        self.log, self.fails_after = str(log), fails_after

    def __call__(self, **how):
        def answer(endpoint, turns, samples):
            if self.fails_after is not None and len(self.asked()) >= self.fails_after:
                raise OSError("gone")
            n = int(re.search(r"problem (\d+)", turns[1]["content"] if len(turns) > 1 else turns[0]["content"])[1])
            last = turns[-1]["content"]
            with open(self.log, "a") as log:
                log.write(json.dumps([n, how["temperature"], len(turns)]) + "\n")
            if last == prompts.REPAIR_REQUEST:
                assert turns[-2] == {"role": "assistant", "content": "no json" if n == 6 else audit("incorrect" if n % 2 else "correct")}
                return models.Reply([None if n % 5 == 3 else f"\n repaired {n}"], None)
            if last.startswith(prompts.NEUTRAL_REQUEST):
                return [f"as said {n}"]
            if len(turns) == 1:
                return [f"filler {n}"]
            text = None if n == 4 else "no json" if n == 6 else f" {audit('incorrect' if n % 2 else 'correct')}\n"
            return models.Reply([text] * samples, {"prompt_tokens": 9, "completion_tokens": 10 * samples, "finish_reasons": ["length" if text is None else "stop"] * samples})

        return answer

    def asked(self):
        with open(self.log, "a+") as log:
            log.seek(0)
            return [tuple(json.loads(line)) for line in log]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(f"i{n:02}", f"problem {n}", ["one", "two"], n) for n in range(12)], ITEM)


@pytest.fixture(autouse=True)
def repeated_keys(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    yield
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def test_episodes_carry_the_audit_into_the_second_request(spark, tmp_path, items):
    run, server = Run(spark, str(tmp_path / "run"), 3), Recorded(tmp_path / "log")
    found = served.episodes_from(run, "pool", items, server, ENDPOINT, pause=0.0)
    got = {r["pos"]: r for r in found.collect()}
    assert {n: r["refusal"] for n, r in got.items() if r["refusal"]} == {3: "no repair", 4: "no audit", 6: "audit not parsed", 8: "no repair"}
    assert got[5]["repair"] == "repaired 5" and got[5]["reported_error"] and not got[2]["reported_error"]
    assert len(server.asked()) == 12 + 10
    served.episodes_from(run, "pool", items, server, ENDPOINT, pause=0.0).collect()
    assert len(server.asked()) == 22

    pool = served.pool_of(found, require_error=True, size=4)
    assert [r["pos"] for r in pool.orderBy("pos").collect()] == [1, 5, 7, 9]
    stored = str(tmp_path / "stored")
    checkpoints.write_pool(pool.drop("refusal"), stored, "m", "x", "F1")
    kind = f"{ITEM}, audit string, reported_error boolean, repair string"
    with pytest.raises(ValueError, match="belongs to m"):
        checkpoints.read_pool(spark, stored, "other", kind)
    again = checkpoints.read_pool(spark, stored, "m", kind)
    made = served.neutrals_for(run, "pool", again, server, ENDPOINT, pause=0.0)
    assert {(r["item_id"], r["neutral"]) for r in made.collect()} == {(f"i{n:02}", f"as said {n}") for n in (1, 5, 7, 9)}
    assert checkpoints.require_cover(again, made, "AN").count() == 4
    with pytest.raises(Exception, match="counterparts for AN: none for i05"):
        checkpoints.require_cover(again, made.where("item_id <> 'i05'"), "AN").collect()
    fill = served.fillers_for(run, "pool", again, server, ENDPOINT, pause=0.0)
    assert {r["response"] for r in fill.collect()} == {f"filler {n}" for n in (1, 5, 7, 9)}
    # Derived sets leave the frozen episodes alone.
    assert len(server.asked()) == 22 + 8


def test_a_ladder_killed_and_resumed_asks_nothing_twice(spark, tmp_path, items):
    folder, log = str(tmp_path / "run"), tmp_path / "log"
    run = Run(spark, folder, 1)
    conditions = ["R0", "R1", "R2"]
    with pytest.raises(Exception, match="gave no answer"):
        served.run_ladder(run, items, Recorded(log, fails_after=17), ENDPOINT, conditions, samples=2, greedy=False, fulfil=True, attempts=1, pause=0.0, under_way=1)
    assert run.done("m__R0__F1") and not run.done("m__R1__F1")
    kept = {c: {r["item_id"] for r in run.answers(f"m__{c}__F1", "samples").collect()} for c in conditions}
    assert len(kept["R0"]) == 12 and 1 <= len(kept["R1"]) <= 5 and not kept["R2"]
    before = len(Recorded(log).asked())
    made = served.run_ladder(run, items, Recorded(log), ENDPOINT, conditions, samples=2, greedy=False, fulfil=True, attempts=1, pause=0.0)
    assert made == ["m__R1__F1", "m__R2__F1"]
    # What was staged isn't asked again; R2 asks for its audits and, where one came, for the repairs that it announced.
    assert len(Recorded(log).asked()) - before == 12 - len(kept["R1"]) + 12 + 12 + 11
    assert served.run_ladder(run, items, Recorded(log, 0), ENDPOINT, conditions, samples=2) == []
    records = {r["condition"]: r for r in run.records(served.RECORD).collect()}
    assert records["R2"]["promise"]["mode"] == "separate-request" and records["R2"]["promise"]["n_performed"] == 9
    assert records["R1"]["promise"]["mode"] == "delegated" and records["R0"]["promise"] is None
    assert records["R0"]["far"] == 0.6 and records["R0"]["parse_ok_rate"] == pytest.approx(10 / 12) and records["R0"]["n_items_all_unparsed"] == 2 and records["R0"]["localizable_samples"] == 12
    tokens = records["R0"]["completion_tokens"]
    assert (tokens["mean_per_choice"], tokens["truncated_choices"], tokens["n_choices"], tokens["n_requests"]) == (10.0, 2, 24, 12)
    with pytest.raises(FileExistsError):
        run.commit("m__R0__F1", {})


def test_a_refused_cell_is_stored_first(spark, tmp_path, items):
    run = Run(spark, str(tmp_path / "run"))
    few = items.where("pos in (4, 6, 1)")
    with pytest.raises(ValueError, match=r"too few answers parsed \(33.3%\): 1 of 3 answers were cut off"):
        served.run_ladder(run, few, Recorded(tmp_path / "log"), ENDPOINT, ["R0"], samples=1, pause=0.0)
    record = run.records(served.RECORD).first()
    assert record["condition"] == "R0" and record["greedy"]["far"] == 1.0
    with pytest.raises(ValueError, match="unknown conditions"):
        served.run_ladder(run, few, Recorded(tmp_path / "log"), ENDPOINT, ["R9"])


def test_a_key_written_by_two_tasks_counts_once(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    row = [("i1", "sample", 0, "a", None, None, None, None)]
    for _ in range(2):
        spark.createDataFrame(row, f"item_id string, {models.ANSWERS}").write.mode("append").parquet(str(tmp_path / "run/_staged/c/p"))
    assert run.answers("c", "p").count() == 1 and run.answers("c", "none").count() == 0


def test_run_commands(spark, tmp_path, items, capsys):
    from verdictspark import cli

    items.write.parquet(str(tmp_path / "items.parquet"))
    out, server = str(tmp_path / "out"), Recorded(tmp_path / "log")
    ask = [str(tmp_path / "items.parquet"), "--endpoint", "m=x@http://none", "--out", out]
    assert cli.main(["run-ladder", *ask, "--conditions", "R0", "--samples", "1", "--no-greedy"], server) == 0
    assert cli.main(["run-episodes", *ask, "--require-error", "--neutral", "--filler"], server) == 0
    said = capsys.readouterr().out
    assert "1 cells made: m__R0__F1" in said and "episodes 8" in said and "neutral 5 of 5" in said and "filler 5 of 5" in said
    frozen = f"{out}/m__episodes__F1"
    before = len(server.asked())
    assert cli.main(["run-episodes", *ask[:-1], str(tmp_path / "more"), "--episodes-in", frozen, "--neutral"], server) == 0
    assert len(server.asked()) == before + 5
    with pytest.raises(ValueError, match="belongs to m"):
        cli.main(["run-episodes", ask[0], "--endpoint", "n=x@http://none", "--out", out, "--episodes-in", frozen, "--filler"], server)
    assert cli.main(["figures", *ask], server) == 2
