"""What is asked of served models: audits and the requests that follow their answers, cells, pools.

A request that carries an earlier answer is a second pass over the first one's staged rows: its
messages are columns made from them. Each pass asks only for what is not staged yet, so that a
chain goes on where it was stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictspark.functions import audits, prompts
from verdictspark.operators import generation, rates
from verdictspark.sources import models
from verdictspark.sources.runs import Run

#: Budgets, and the schema that answers must have.
AUDIT_TOKENS, REPAIR_TOKENS = 512, 1024
AUDIT_SCHEMA = {
    "type": "object",
    "properties": {
        "verdict": {"type": "string", "enum": ["correct", "incorrect"]},
        "first_error_step": {"type": ["integer", "null"]},
        "confidence": {"type": "number", "minimum": 0.0, "maximum": 1.0},
        "error_type": {"type": ["string", "null"], "enum": [*audits.ERROR_TYPES, None]},
        "evidence": {"type": "string", "maxLength": 300},
    },
    "required": ["verdict", "first_error_step", "confidence", "error_type", "evidence"],
    "additionalProperties": False,
}
#: Conditions that announce a repair, and how it is made.
PROMISES = {"R1": "delegated", "R2": "separate-request", "R3": "same-context", "R3u": "same-context"}
RECORD = (
    "auditor string, model string, condition string, family string, samples int, temperature double, max_tokens int, n_items long, far double, instability_n1 double, parse_ok_rate double, "
    "n_items_all_unparsed long, localizable_samples long, completion_tokens struct<mean_per_choice: double, p50_per_choice: double, p95_per_choice: double, max_per_choice: double, "
    "truncated_choices: long, n_choices: long, n_requests: long>, greedy struct<far: double, parse_ok_rate: double>, promise struct<mode: string, n_performed: long>"
)

#: Gives the function that answers requests of a kind: temperature, max_tokens, and schema, seed or thinking where they matter.
Server = Callable[..., models.Answer]


def _turn(role: str, content: Column) -> Column:
    return F.array(prompts.message(role, content))


def _first(answers: DataFrame, name: str) -> DataFrame:
    """The single answers to requests at temperature 0, stripped; none for null."""
    return answers.where("kind = 'sample' and sample = 0").select("item_id", generation.stripped(F.col("raw")).alias(name))


def audit_prompts(items: DataFrame, condition: str, family: str) -> DataFrame:
    return items.withColumn("messages", prompts.audit_messages(F.col("problem"), F.col("steps"), F.lit(condition), F.lit(family)))


def followed(rows: DataFrame, request: Column) -> Column:
    """The messages of a row, its audit and a further request."""
    return F.concat("messages", _turn("assistant", F.col("audit")), _turn("user", request))


def episodes_from(run: Run, cell: str, items: DataFrame, server: Server, endpoint: models.Endpoint, family: str = "F1", **how: object) -> DataFrame:
    """items (item_id, problem, steps, pos) with audit, reported_error, repair and refusal.

    refusal says why an item gives no episode: no audit came, it couldn't be parsed, or no
    repair came; null for episodes. Only parsed audits are followed by a request for a repair.
    """
    first = audit_prompts(items, "R0", family)
    told = run.ask(cell, "audit", first, server(temperature=0.0, max_tokens=AUDIT_TOKENS, schema=AUDIT_SCHEMA), endpoint, 1, **how)
    heard = first.join(_first(told, "audit"), "item_id", "left").withColumn("_parsed", audits.parse_audit(F.col("audit"), F.size("steps")))
    second = heard.where("_parsed is not null").withColumn("messages", followed(heard, F.lit(prompts.REPAIR_REQUEST)))
    mended = run.ask(cell, "repair", second, server(temperature=0.0, max_tokens=REPAIR_TOKENS), endpoint, 1, **how)
    out = heard.join(_first(mended, "repair"), "item_id", "left")
    why = F.when(F.col("audit").isNull(), "no audit").when(F.col("_parsed").isNull(), "audit not parsed").when(F.col("repair").isNull(), "no repair")
    return out.select(*items.columns, "audit", F.col("_parsed.reported_error").alias("reported_error"), "repair", why.alias("refusal"))


def pool_of(found: DataFrame, require_error: bool = False, size: int | None = None) -> DataFrame:
    """The episodes among them, in order; with require_error those that report an error, at most `size`."""
    kept = found.where("refusal is null")
    kept = kept.where("reported_error") if require_error else kept
    return kept.orderBy("pos").limit(size) if size else kept


def fillers_for(run: Run, cell: str, pool: DataFrame, server: Server, endpoint: models.Endpoint, **how: object) -> DataFrame:
    """(item_id, request, response): exchanges without an audit, as long as each episode's audit and repair."""
    asks = pool.withColumn("request", prompts.filler_request(F.col("problem"), F.length("audit") + F.length("repair"))).withColumn("messages", _turn("user", F.col("request")))
    told = run.ask(cell, "filler", asks, server(temperature=0.0, max_tokens=REPAIR_TOKENS), endpoint, 1, **how)
    return asks.select("item_id", "request").join(_first(told, "response"), "item_id").where("response is not null")


def neutrals_for(run: Run, cell: str, pool: DataFrame, server: Server, endpoint: models.Endpoint, family: str = "F1", **how: object) -> DataFrame:
    """(item_id, neutral): continuations of each episode's own audit that repair nothing, as long as its repair."""
    asks = audit_prompts(pool, "R0", family)
    asks = asks.withColumn("messages", followed(asks, prompts.neutral_request(F.length("repair"))))
    told = run.ask(cell, "neutral", asks, server(temperature=0.0, max_tokens=REPAIR_TOKENS), endpoint, 1, **how)
    return _first(told, "neutral").where("neutral is not null")


def keep_promises(run: Run, cell: str, items: DataFrame, condition: str, server: Server, endpoint: models.Endpoint, family: str = "F1", **how: object) -> dict:
    """How the repair that a condition announces is made, and for how many items one came. Another model's isn't asked for."""
    mode = PROMISES[condition]
    if mode == "delegated":
        return {"mode": mode, "n_performed": 0}
    first = audit_prompts(items, condition, family)
    told = run.ask(cell, "promised-audit", first, server(temperature=0.0, max_tokens=AUDIT_TOKENS, schema=AUDIT_SCHEMA), endpoint, 1, **how)
    heard = first.join(_first(told, "audit"), "item_id").where("audit is not null")
    second = heard.withColumn("messages", followed(heard, F.lit(prompts.REPAIR_REQUEST)))
    mended = run.ask(cell, "promised-repair", second, server(temperature=0.0, max_tokens=REPAIR_TOKENS), endpoint, 1, **how)
    return {"mode": mode, "n_performed": generation.promises(_first(told, "audit"), _first(mended, "repair"), ["item_id"]).where("performed").count()}


def judged(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Samples parsed: parsed, flag and whether the reported step is usable."""
    rows = models.sample_rows(answers, "item_id").join(items.select("item_id", F.size("steps").alias("_n")), "item_id").withColumn("audit", audits.parse_audit(F.col("raw"), F.col("_n")))
    return rows.select("item_id", "sample", F.col("audit").isNotNull().alias("parsed"), F.col("audit.reported_error").cast("int").alias("flag"), F.coalesce("audit.localization_usable", F.lit(False)).alias("localizable"))


def summary(verdicts: DataFrame) -> dict:
    """Rates of one cell."""
    x = verdicts.withColumn("cell", F.lit(0))
    r = rates.rate_summary(rates.item_probabilities(x, ["cell"]), ["cell"]).first()
    if r is None:
        return {"far": None, "instability_n1": None, "parse_ok_rate": 0.0, "n_items_all_unparsed": 0, "n_items": 0, "localizable_samples": 0}
    near = x.agg(F.count_if("localizable")).first()[0]
    return {"far": r["far"], "instability_n1": r["n1"], "parse_ok_rate": r["parse_ok_rate"], "n_items_all_unparsed": r["unparsed_items"], "n_items": r["n_items"], "localizable_samples": near}


def token_summary(answers: DataFrame) -> dict | None:
    """Tokens a choice, truncated choices and requests of one cell; None where the server counts nothing."""
    each = models.finished_rows(models.usage_rows(answers))
    r = rates.usage_by_request(each.withColumn("cell", F.lit(0)), ["cell"]).first()
    if r is None:
        return None
    return {f"{name}_per_choice": r[f"{name}_tokens"] for name in ("mean", "p50", "p95", "max")} | {"truncated_choices": r["truncated"], "n_choices": r["choices"], "n_requests": r["requests"]}


def run_cell(run: Run, cell: str, asks: DataFrame, about: dict, server: Server, endpoint: models.Endpoint, samples: int, greedy: bool = False, promise: tuple[DataFrame, str, str] | None = None, max_tokens: int = AUDIT_TOKENS, thinking: bool | None = None, least: float = 0.5, **how: object) -> dict | None:
    """One cell: its samples, the pass at temperature 0, the promised repairs, then its record; None if it is there.

    asks has item_id, steps and messages. The guard speaks after the record is in place: a
    cell of which too few answers parsed is kept, and the run stops (ValueError).
    """
    if run.done(cell):
        return None
    told = run.ask(cell, "samples", asks, server(temperature=0.7, max_tokens=max_tokens, schema=AUDIT_SCHEMA, seed=1, thinking=thinking), endpoint, samples, **how)
    record = {"auditor": endpoint.label, "model": endpoint.model, **about, "samples": samples, "temperature": 0.7, "max_tokens": max_tokens, **summary(judged(told, asks))}
    if tokens := token_summary(told):
        record["completion_tokens"] = tokens
    if greedy:
        once = run.ask(cell, "greedy", asks, server(temperature=0.0, max_tokens=max_tokens, schema=AUDIT_SCHEMA, thinking=thinking), endpoint, 1, **how)
        record["greedy"] = {k: v for k, v in summary(judged(once, asks)).items() if k in ("far", "parse_ok_rate")}
    if promise is not None:
        items, condition, family = promise
        record["promise"] = keep_promises(run, cell, items, condition, server, endpoint, family, **how)
    run.commit(cell, record)
    use = record.get("completion_tokens") or {}
    if why := generation.refusal(record["parse_ok_rate"], use.get("truncated_choices", 0), use.get("n_choices", 0), least):
        raise ValueError(f"{endpoint.label}/{cell}: {why}")
    return record


def run_ladder(run: Run, items: DataFrame, server: Server, endpoint: models.Endpoint, conditions: list[str], family: str = "F1", samples: int = 8, greedy: bool = True, fulfil: bool = False, **how: object) -> list[str]:
    """Every condition's cell over the items; the names of those that were not there yet."""
    generation.require_conditions(conditions, tuple(prompts.CONDITIONS))
    made = []
    for condition in conditions:
        cell = f"{endpoint.label}__{condition}__{family}"
        promise = (items, condition, family) if fulfil and condition in PROMISES else None
        if run_cell(run, cell, audit_prompts(items, condition, family), {"condition": condition, "family": family}, server, endpoint, samples, greedy, promise, **how):
            made.append(cell)
    return made
