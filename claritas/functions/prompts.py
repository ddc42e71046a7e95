"""System and user prompts as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritas.functions import fixed
from claritas.functions.text import marked_answer
from claritas.operators.human import lookup


@dataclass(frozen=True)
class Template:
    """`system` may hold {shots}; `user` may hold {task} and {input}."""

    system: str
    user: str = "{input}"
    mark: str | None = None


def guideline_list(guidelines: list[str] = fixed.GUIDELINES) -> str:
    return "\n".join(f"- {g}" for g in guidelines)


ZERO_SHOT = Template("\n".join([fixed.PROMPT_OPENING, fixed.PROMPT_REWRITE, guideline_list(), fixed.PROMPT_ONLY_TEXT]))
FEW_SHOT = Template(
    "\n".join(
        [
            fixed.PROMPT_OPENING,
            fixed.PROMPT_REWRITE,
            guideline_list(),
            fixed.PROMPT_SHOTS_INTRO,
            "{shots}",
            fixed.PROMPT_COMPLETE,
            fixed.PROMPT_KEEP_AND_MARK,
        ]
    ),
    "\n".join([f"{fixed.TASK_LABEL}{{task}}", f"{fixed.INPUT_LABEL}{{input}}", fixed.OUTPUT_LABEL]),
    fixed.ANSWER_MARK,
)
STEP_BY_STEP = Template(
    "\n".join(
        [
            fixed.PROMPT_OPENING,
            fixed.PROMPT_STEPS_INTRO,
            fixed.PROMPT_STEP_1,
            fixed.PROMPT_STEP_2,
            fixed.PROMPT_STEP_3,
            guideline_list(),
            fixed.PROMPT_STEP_4,
            fixed.PROMPT_STEPS_END,
        ]
    ),
    mark=fixed.ANSWER_MARK,
)


def _early(*extra: str) -> Template:
    parts = [fixed.EARLY_OPENING, guideline_list(), fixed.EARLY_SHOTS_INTRO, "{shots}", *extra]
    return Template("".join([*parts, fixed.EARLY_CLOSING, fixed.EARLY_TARGET_LABEL]), mark=fixed.ANSWER_MARK)


EARLY = _early()
EARLY_WITH_NEGATIVE = _early(fixed.EARLY_NEGATIVE_EXAMPLE)


def fill(template: str, **columns: Column) -> Column:
    """Put columns into the named places; text inside a column is never read as a place."""
    parts: list[Column] = []
    rest = template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in columns if "{" + name + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(columns[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def render_prompt(df: DataFrame, template: Template, names: dict[str, str] | None = None) -> DataFrame:
    """Add `system_prompt` and `user_prompt` to rows with `input`, `task` and, for examples, `shots`."""
    task = F.coalesce(lookup(names, "task"), F.col("task")) if names else F.col("task")
    shots = F.coalesce(F.col("shots"), F.lit("")) if "shots" in df.columns else F.lit("")
    return df.withColumns(
        {
            "system_prompt": fill(template.system, shots=shots),
            "user_prompt": fill(template.user, input=F.col("input"), task=task),
        }
    )


def answer(c: Column, template: Template) -> Column:
    return marked_answer(c, template.mark) if template.mark else c


PromptManager = Callable[[DataFrame], DataFrame]
MANAGERS: dict[str, PromptManager] = {
    "zero_shot": lambda df: render_prompt(df, ZERO_SHOT),
    "cot": lambda df: render_prompt(df, STEP_BY_STEP),
    "few_shot": lambda df: render_prompt(df, FEW_SHOT),
}


def register_manager(name: str, manager: PromptManager) -> None:
    MANAGERS[name] = manager


def with_manager(df: DataFrame, name: str) -> DataFrame:
    if name not in MANAGERS:
        raise KeyError(f"unknown prompt manager {name}; known: {sorted(MANAGERS)}")
    return MANAGERS[name](df)
