"""Dataset configurations, read on the driver.  Only data is read from them; no code is run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:
    yaml = None


@dataclass(frozen=True)
class DatasetConfig:
    name: str
    task: str
    languages: tuple[str, ...]
    source: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    few_shot_examples: int = 0
    splits: tuple[str, ...] = ("train", "val", "test")


#: Column names that tell a task, tried in order.
_SIGNS = [({"tokens", "labels"}, "token-classification"), ({"question", "context", "answers"}, "question-answering"), ({"text", "target_text"}, "text-to-text"), ({"choices"}, "multiple-choice"), ({"text", "label"}, "sequence-classification")]


def inferred_task(columns: list[str]) -> str | None:
    return next((task for signs, task in _SIGNS if signs <= set(columns)), None)


def _first_task(values: dict) -> dict:
    tasks = values.get("tasks")
    return tasks[0] if isinstance(tasks, list) and tasks and isinstance(tasks[0], dict) else {}


def _named(items: object, name: str) -> bool:
    return isinstance(items, list) and any(isinstance(x, dict) and x.get("name") == name for x in items)


def task_of_hints(values: dict) -> str | None:
    """The task that an evaluation file's solvers, scorers and fields tell."""
    first = _first_task(values)
    fields = first.get("field_spec")
    if _named(first.get("solvers"), "multiple_choice") or (isinstance(fields, dict) and "choices" in fields):
        return "multiple-choice"
    return "reference-free-qa" if _named(first.get("scorers"), "model_graded_fact") else None


def columns_of_hints(values: dict) -> dict[str, str]:
    """Columns (old to standard names) from flat keys, else from the first task's fields; a literal or a number is none."""
    fields = _first_task(values).get("field_spec")
    fields = fields if isinstance(fields, dict) else {}
    out = {}
    for key, standard in (("input", "text"), ("target", "label"), ("choices", "choices")):
        name = values.get(f"{key}_column", fields.get(key))
        if isinstance(name, str) and not name.startswith("literal:"):
            out[name] = standard
    return out


def _read(text: str) -> dict:
    """Settings from JSON, from YAML where its reader is installed, else from plain ``key: value`` lines (lists in brackets)."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    if yaml is not None:
        return yaml.safe_load(text) or {}
    values = {}
    for line in text.splitlines():
        key, mark, value = line.partition(":")
        if mark and not line.lstrip().startswith("#"):
            value = value.strip().strip("\"'")
            values[key.strip()] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value
    return values


def config_from(text: str, name: str | None = None, languages: list[str] | None = None) -> DatasetConfig:
    """A configuration; the task and columns may be told by an evaluation file's hints, and the name and the languages by
    the caller where the file has none (English if nobody tells)."""
    values = _read(text)
    own = {k: v for k, v in values.items() if k in DatasetConfig.__dataclass_fields__}
    if unknown := sorted(set(values) - set(own) - {"tasks", "input_column", "target_column", "choices_column"}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    own["name"] = own.get("name") or name
    if not own["name"]:
        raise ValueError("a configuration needs a name")
    own["columns"] = own.get("columns") or columns_of_hints(values)
    own["task"] = own.get("task") or task_of_hints(values) or inferred_task(list(own["columns"].values()))
    if not own["task"]:
        raise ValueError(f"{own['name']}: no task, and the columns tell none")
    said = own.get("languages") or languages or ["en"]
    first = _first_task(values)
    splits = tuple(own.get("splits") or ("train", "val", first.get("split", "test")))
    return DatasetConfig(**own | {"languages": tuple([said] if isinstance(said, str) else said), "labels": tuple(own.get("labels") or ()), "few_shot_examples": int(own.get("few_shot_examples") or 0), "splits": splits, "source": own.get("source") or first.get("config")})
