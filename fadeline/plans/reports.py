"""Reports and command files of experiments: texts made of small results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sinks


def selection_report(ranked: list[dict], policy: str, columns: tuple[str, ...] = ("rank", "model", "horizon", "RMSE", "MAE", "R2", "policy_ok", "tuned_markers"), limit: int = 20) -> str:
    """The chosen row, the policy that chose it, and the ranking."""
    best = next((r for r in ranked if r.get("rank") == 1 or r.get("selected")), None)
    chosen = "No candidate is left." if best is None else f"`{best['model']}` is selected by {policy}."
    return sinks.report("Model selection", [("Selected", chosen), ("Ranking", sinks.markdown_table(ranked, list(columns), limit))])


def experiment_report(title: str, plan: list[dict], results: list[dict], metrics: tuple[str, ...]) -> str:
    """How many trials were planned, done and failed, and their metrics."""
    failed = [r for r in results if r.get("status") == "failed"]
    state = f"{len(plan)} planned, {sum(r.get('status') == 'done' for r in results)} done, {len(failed)} failed."
    keys = [k for k in (plan[0] if plan else {}) if k not in metrics]
    sections = [("State", state), ("Results", sinks.markdown_table([r for r in results if r.get("status") == "done"], [*keys, *metrics]))]
    if failed:
        sections.append(("Failures", sinks.markdown_table(failed, [*keys, "reason"])))
    return sinks.report(title, sections)


def before_after_report(rows: list[dict], metric: str = "RMSE") -> str:
    """Each horizon's metric before and after a change, with the gain."""
    return sinks.report("Before and after", [(metric, sinks.markdown_table(rows, ["horizon", f"before_{metric}", f"after_{metric}", f"{metric}_gain", f"{metric}_gain_percent"]))])


def filled(template: str, config: dict, tables: dict[str, str] | None = None) -> str:
    """A report template with {name} filled from the configuration and {table:name} from texts; a name without a value stays visible."""
    values = {k: sinks.markdown_cell(v) if not isinstance(v, (list, tuple)) else ", ".join(map(sinks.markdown_cell, v)) for k, v in config.items()}
    found = values | {f"table:{k}": v.rstrip() for k, v in (tables or {}).items()}
    return re.sub(r"\{((?:table:)?\w+)\}", lambda m: found.get(m[1], m[0]), template)


def command(program: list[str], options: dict) -> list[str]:
    """Arguments of a run: --name value for each option in order, names with - for _; True is the name alone, None, False and empty texts nothing."""
    out = list(program)
    for name, value in options.items():
        flag = f"--{name.replace('_', '-')}"
        if value is True:
            out.append(flag)
        elif isinstance(value, (list, tuple)):
            out += [flag, ",".join(map(str, value))] if value else []
        elif value is not None and value is not False and value != "":
            out += [flag, str(value)]
    return out


def trial_command(program: list[str], model: str, seed: int, config: dict, run: dict) -> list[str]:
    """The command of one trial: what the run fixes, then model and seed, then the configuration; options that its split mode does not use are left out."""
    mode = run.get("split_mode")
    unused = {k for k, needed in (("split_gap", "condition-gap-within-file"), ("eval_domain", "same-domain-eval")) if mode != needed}
    kept = {k: v for k, v in run.items() if k not in unused and not (k == "max_files" and not v)}
    return command(program, {**kept, "models": model, "seed": seed, **{k: v for k, v in config.items() if k != "name"}})


def command_file(commands: list[list[str]], kind: str = "ps1") -> str:
    """Commands one per line for PowerShell, or as a JSON list."""
    return sinks.json_text(commands) if kind == "json" else "\n".join(sinks.command_text(c) for c in commands) + "\n"


def command_column(plan: DataFrame, program: list[str], options: dict[str, str]) -> Column:
    """The command line of each row of a plan, as `command` and `command_text` make it; options are names of options to columns.

    A truth value is the name alone or nothing, a list is joined by commas, null and empty texts are left out.
    """
    kinds = dict(plan.dtypes)
    parts: list[Column] = [F.lit(sinks.command_text(program))]
    for name, column in options.items():
        flag, c, kind = F.lit(f"--{name.replace('_', '-')}"), F.col(column), kinds[column]
        if kind == "boolean":
            parts.append(F.when(c, flag))
        else:
            text = F.array_join(c.cast("array<string>"), ",") if kind.startswith("array") else c.cast("string")
            parts.append(F.when(text != "", F.concat(flag, F.lit(" "), sinks.powershell_quoted_column(text))))
    return F.concat_ws(" ", *parts)


def command_lines(plan: DataFrame, program: list[str], options: dict[str, str], order: list) -> DataFrame:
    """(place, line): the commands of a plan of any number of trials, from 1 in an order without ties."""
    from ..operators.ranking import ranked_together

    return ranked_together(plan, order, "place").select("place", command_column(plan, program, options).alias("line"))


def selection_lines(ranked: DataFrame, policy: str, columns: list[str]) -> DataFrame:
    """(place, line): the lines of selection_report over any number of ranked rows (rank, model, ...)."""
    best = ranked.filter("rank = 1").agg(F.min("model").alias("model"))
    chosen = F.when(F.col("model").isNull(), "No candidate is left.").otherwise(F.concat(F.lit("`"), F.col("model"), F.lit(f"` is selected by {policy}.")))
    heads = best.select(F.inline(F.array(*(F.struct(F.lit(p).cast("long").alias("place"), line.alias("line")) for p, line in ((-9, F.lit("# Model selection")), (-8, F.lit("")), (-7, F.lit("## Selected")), (-6, F.lit("")), (-5, chosen), (-4, F.lit("")), (-3, F.lit("## Ranking")), (-2, F.lit("")))))))
    return heads.unionByName(sinks.markdown_lines(ranked, columns, [F.col("rank")]))
