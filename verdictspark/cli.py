"""Commands: `python -m verdictspark.cli COMMAND|QUERY SF_DIR [--format markdown|latex] [--out FOLDER]`.

A command prints the rows of its queries as small tables; with --out each result is also
written as Parquet under FOLDER/QUERY. With --endpoint LABEL=MODEL@URL, run-ladder and
run-episodes ask a server about the items of SF_DIR (JSON lines or Parquet: item_id, problem,
steps, pos) and keep their run in --out; called again, they go on where they stopped.
"""

from __future__ import annotations

import argparse
import sys

#: Commands and the queries that answer them.
COMMANDS = {
    "allocate": ["allocate_arms", "arm_disjointness", "arm_filters"],
    "power-sweep": ["power_sim"],
    "kill-tests": ["kill_tests"],
    "bakeoff": ["far_by_condition", "localisation_within_one", "greedy_disagreement", "determinism_probe"],
    "screen": ["gate0_screen", "pooled_band"],
    "analyse-screen": ["gate0_screen"],
    "calibrate-gate2": ["localisation_within_one", "range_check"],
    "run-ladder": ["audit_prompts", "measured_rates", "greedy_pass", "kept_promises"],
    "run-r4": ["r4_prompts", "usage_summary", "run_guard"],
    "run-episodes": ["episode_pool", "filler_requests", "episode_items", "length_summary"],
    "run-detection": ["proportional_arm", "modal_step", "mean_confidence"],
    "inject-pilot": ["fault_pairs", "yield_table", "rejection_breakdown"],
    "inject": ["injection_prompts", "accepted_attempts", "position_pairs"],
    "inject-calibrate": ["position_gap"],
    "inject-detectability": ["position_gap"],
    "analyse-ladder": ["rung_bootstrap_by_ids", "ladder_pairwise", "gate3_verdict", "gate3_framing"],
    "analyse-r4": ["r4_bootstrap", "widest_interval", "holm_r4_claims", "screened_families", "r4_readings"],
    "analyse-templates": ["template_bootstrap", "template_robustness"],
    "analyse-detection": ["sdt_metrics", "sdt_by_origin", "sdt_bootstrap", "sdt_families", "prior_context_guard", "detection_vs_r0", "sdt_reading"],
    "figures": ["forest_rows", "wording_panels", "quadrant_points"],
    "tables": ["allcombos_report", "prose_counts", "detection_by_wording", "directional_counts"],
    "backfill-episode-ids": ["resampled_ids", "episode_pairing"],
    "dump-audit-sample": ["revalidation_counts", "audit_sample"],
}
SHOWN = 50


def _items(spark, at: str):  # noqa: ANN001, ANN202
    kind = "item_id string, problem string, steps array<string>, pos long"
    return spark.read.schema(kind).parquet(at) if at.rstrip("/").endswith(".parquet") else spark.read.schema(kind).json(at)


def serve(spark, asked: argparse.Namespace, server=None) -> None:  # noqa: ANN001
    """run-ladder and run-episodes against the named endpoints."""
    from verdictspark.operators import served
    from verdictspark.sources import checkpoints, models
    from verdictspark.sources.runs import Run

    # Of repeated keys in an answer the last counts.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    run, items, server = Run(spark, asked.out), _items(spark, asked.sf_dir), server or models.chat
    for text in asked.endpoint:
        endpoint = models.Endpoint.parse(text)
        if asked.command == "run-ladder":
            made = served.run_ladder(run, items, server, endpoint, asked.conditions.split(","), asked.family, asked.samples, not asked.no_greedy, asked.fulfil_promise, under_way=asked.concurrency)
            print(f"{endpoint.label}: {len(made)} cells made: {', '.join(made)}")
            continue
        cell, kind = f"{endpoint.label}__episodes__{asked.family}", "item_id string, problem string, steps array<string>, pos long, audit string, reported_error boolean, repair string"
        if asked.episodes_in:
            pool = checkpoints.read_pool(spark, asked.episodes_in, endpoint.label, kind)
        else:
            found = served.episodes_from(run, cell, items, server, endpoint, asked.family, under_way=asked.concurrency)
            why = found.groupBy("refusal").count().collect()
            print(f"{endpoint.label}: " + ", ".join(sorted(f"{r['refusal'] or 'episodes'} {r['count']}" for r in why)))
            stored = f"{asked.out}/{cell}"
            checkpoints.write_pool(served.pool_of(found, asked.require_error, asked.pool_size).drop("refusal"), stored, endpoint.label, endpoint.model, asked.family)
            pool = checkpoints.read_pool(spark, stored, endpoint.label, kind)
        for wanted, make in (("neutral", served.neutrals_for), ("filler", served.fillers_for)):
            if getattr(asked, wanted):
                more = (asked.family,) if wanted == "neutral" else ()
                made = make(run, cell, pool, server, endpoint, *more, under_way=asked.concurrency)
                checkpoints.write_pool(made, f"{asked.out}/{cell}__{wanted}", endpoint.label, endpoint.model, asked.family)
                print(f"{endpoint.label}: {wanted} {made.count()} of {pool.count()}")


def main(args: list[str], server=None) -> int:  # noqa: ANN001
    from pyspark.sql import SparkSession

    from verdictspark import catalog
    from verdictspark.plans.reports import to_latex, to_markdown

    parser = argparse.ArgumentParser(prog="python -m verdictspark.cli", description=f"Commands: {', '.join(COMMANDS)}; or the name of a query.")
    parser.add_argument("command", choices=[*COMMANDS, *catalog.QUERIES], metavar="COMMAND")
    parser.add_argument("sf_dir", help="folder of the tables")
    parser.add_argument("--format", choices=("markdown", "latex"), default="markdown")
    parser.add_argument("--out", help="folder for the whole results as Parquet, or of the run")
    parser.add_argument("--endpoint", action="append", default=[], metavar="LABEL=MODEL@URL")
    parser.add_argument("--conditions", default="R0,R0p,R1,R2,R3,R3u")
    parser.add_argument("--family", default="F1")
    parser.add_argument("--samples", type=int, default=8)
    parser.add_argument("--concurrency", type=int, default=32, help="requests that a task has under way")
    parser.add_argument("--no-greedy", action="store_true")
    parser.add_argument("--fulfil-promise", action="store_true")
    parser.add_argument("--require-error", action="store_true")
    parser.add_argument("--pool-size", type=int)
    parser.add_argument("--episodes-in", help="a stored pool that is not made anew")
    parser.add_argument("--neutral", action="store_true")
    parser.add_argument("--filler", action="store_true")
    try:
        asked = parser.parse_args(args)
    except SystemExit as stop:
        return int(stop.code or 0)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.endpoint:
        if asked.command not in ("run-ladder", "run-episodes") or not asked.out:
            print("--endpoint goes with run-ladder or run-episodes, and --out", file=sys.stderr)
            return 2
        serve(spark, asked, server)
        return 0
    for name in COMMANDS.get(asked.command, [asked.command]):
        rows = catalog.QUERIES[name](spark, asked.sf_dir)
        if asked.out:
            rows.write.mode("overwrite").parquet(f"{asked.out}/{name}")
            rows = spark.read.parquet(f"{asked.out}/{name}")
        left = rows.offset(SHOWN).count()
        text = to_markdown(rows, SHOWN) if asked.format == "markdown" else to_latex(rows, rows.columns[0], name.replace("_", " "), f"tab:{name}", SHOWN)
        print(f"\n### {name}\n\n{text}" + (f"\n{left} more rows are not shown" if left else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
