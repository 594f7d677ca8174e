"""Strict parsing of model verdicts in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error types of the verdict schema.
ERROR_TYPES = ("arithmetic", "algebraic", "logical", "misread_problem", "unjustified_step")


def parse_audit(raw: Column, n_steps: Column) -> Column:
    """A struct of the verdict's fields, or null for text that isn't one.

    The text must be one JSON object with a known verdict, a number from 0 to 1 as
    confidence and a string as evidence. A correct verdict has neither step nor type; of
    an incorrect one a step stays only if it is a whole number within the trace, a type
    only if it is known. Other keys are ignored. Of repeated keys the last counts, for
    which spark.sql.variant.allowDuplicateKeys must be set; else such texts are refused.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    one = F.try_variant_get(whole, "$[0]", "variant")
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull() & ~raw.rlike(r"\}\s*\]\s*,?\s*\[")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(one, f"$.{f}", "variant"))
    value = lambda f, t: F.try_variant_get(one, f"$.{f}", t)
    number = kind("confidence").isin("BIGINT", "DOUBLE") | kind("confidence").startswith("DECIMAL")
    verdict, confidence, step = value("verdict", "string"), value("confidence", "double"), value("first_error_step", "long")
    wrong = verdict == "incorrect"
    sound = (
        alone & F.schema_of_variant(one).startswith("OBJECT") & (kind("verdict") == "STRING") & verdict.isin("correct", "incorrect")
        & number & confidence.between(0.0, 1.0) & (kind("evidence") == "STRING")
    )
    usable = wrong & (kind("first_error_step") == "BIGINT") & step.between(F.lit(1), n_steps)
    named = wrong & (kind("error_type") == "STRING") & value("error_type", "string").isin(*ERROR_TYPES)
    fields = F.struct(
        verdict.alias("verdict"), F.when(usable, step).alias("first_error_step"), confidence.alias("confidence"),
        F.when(named, value("error_type", "string")).alias("error_type"), value("evidence", "string").alias("evidence"),
        wrong.alias("reported_error"), F.coalesce(usable, F.lit(False)).alias("localization_usable"),
    )
    return F.when(F.coalesce(sound, F.lit(False)), fields)
