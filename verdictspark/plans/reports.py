"""Small tables as markdown and LaTeX text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_markdown(frame: DataFrame, most: int = 1000) -> str:
    """The first `most` rows of a report (reports are small) as a markdown table."""
    rows = frame.limit(most).collect()
    lines = ["| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
    return "\n".join(lines + ["| " + " | ".join("---" if v is None else str(v) for v in r) + " |" for r in rows])


def to_latex(frame: DataFrame, group: str, caption: str, label: str, most: int = 1000) -> str:
    """The first `most` rows as a LaTeX table with a rule between groups."""
    body, before = [], None
    for r in frame.limit(most).collect():
        if before is not None and r[group] != before:
            body.append(r"\midrule")
        before = r[group]
        body.append(" & ".join("---" if v is None else str(v).replace("*", "$^{*}$") for v in r) + r" \\")
    head = " & ".join(c.replace("_", r"\_") for c in frame.columns) + r" \\"
    return "\n".join([r"\begin{table}[t]", r"\centering", rf"\begin{{tabular}}{{{'l' * len(frame.columns)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\end{table}"])


def panel_letter(panels: tuple[str, ...], panel: str) -> str:
    """A panel's letter by its place among those shown."""
    return chr(ord("a") + panels.index(panel))
