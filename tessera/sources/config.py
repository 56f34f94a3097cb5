"""Run configurations and settings from the environment; all on the driver."""

from __future__ import annotations

import importlib.util
import json
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .. import formats

# The fields that a run file has to have.
REQUIRED = ("experiment_name", "run_name", "dataset_version", "base_model", "seed")


def leaves(tree: Mapping[str, Any]) -> Iterator[tuple[tuple[str, ...], Any]]:
    """(path, value) of all that isn't a mapping, in the order of the file; an explicit stack, so depth doesn't matter."""
    todo = [((), iter(tree.items()))]
    while todo:
        path, entries = todo[-1]
        for name, value in entries:
            here = (*path, str(name))
            if isinstance(value, Mapping):
                todo.append((here, iter(value.items())))
                break
            yield here, value
        else:
            todo.pop()


def flatten(tree: Mapping[str, Any]) -> dict[str, str | int | float | bool]:
    """Parameters as a run's log takes them: numbers, texts and flags by their dotted path."""
    return {".".join(path): value for path, value in leaves(tree) if isinstance(value, (bool, int, float, str))}


def scalar(text: str) -> Any:
    text = re.sub(r"\s+#.*$", "", text).strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("["):
        return [scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    named = {"true": True, "false": False, "null": None, "~": None, "": None}
    if text.lower() in named:
        return named[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def simple_yaml(text: str) -> dict[str, Any]:
    """Nested mappings of scalars, as run configurations have them, where no YAML library is at hand."""
    root: dict[str, Any] = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, rest = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a mapping: {line!r}")
        depth = len(line) - len(line.lstrip())
        while stack[-1][0] >= depth:
            stack.pop()
        if rest.strip():
            stack[-1][1][key] = scalar(rest)
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def parsed(path: Path) -> Any:
    """A run file's content; JSON is told by its name, all else is read as YAML."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    yaml = importlib.import_module("yaml") if importlib.util.find_spec("yaml") else None
    return yaml.safe_load(text) if yaml else simple_yaml(text)


def load_config(path: str | Path) -> dict[str, Any]:
    """A run file that has all REQUIRED fields."""
    content = parsed(Path(path))
    lacking = list(REQUIRED) if not isinstance(content, dict) else sorted(set(REQUIRED) - content.keys(), key=REQUIRED.index)
    if lacking:
        raise ValueError(f"{path} is no run configuration: it lacks {', '.join(lacking)}")
    return content


def experiment_name(config: Mapping[str, Any], run_type: str) -> str:
    return str(config.get(f"{run_type}_experiment_name", config["experiment_name"]))


@dataclass
class Settings:
    """All budgets in one place; from_env reads TESSERA_<NAME>."""

    min_chars: int = formats.LEAST_CHUNK_CHARS
    adjacent_chars: int = formats.ADJACENT_CHARS
    page_tokens: int = formats.PAGE_TOKENS
    chars_per_token: float = formats.CHARS_PER_TOKEN
    benchmark_size: int = formats.BENCHMARK_SIZE
    selection_size: int = formats.SELECTION_SIZE
    workers: int = 6
    retries: int = 3
    timeout_s: float = 180.0
    pilot_size: int = 10
    databases: list[str] = field(default_factory=list)

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        own = cls()
        for f in fields(cls):
            if (raw := env.get(f"TESSERA_{f.name.upper()}")) is not None:
                old = getattr(own, f.name)
                setattr(own, f.name, [x.strip() for x in raw.split(",") if x.strip()] if isinstance(old, list) else type(old)(raw))
        return own


#: Where a run leaves adapters, in the order in which they are compared: patterns relative to its folder.
ADAPTER_PLACES = ("best_adapter", "adapter", "checkpoints/checkpoint-*")


def candidates(run_dir: str | Path, base_model: str, marker: str = "adapter_config.json") -> list[tuple[str, str]]:
    """(name, place) of what a run offers for comparison: its base model, then each adapter that has its marker file.

    Marker files are looked up first and ranked by the place that they lie in.
    """
    found = []
    for rank, place in enumerate(ADAPTER_PLACES):
        found += [(rank, str(file.parent), file.parent.name) for file in Path(run_dir).glob(f"{place}/{marker}") if file.is_file()]
    return [("base", base_model)] + [(name, place) for _, place, name in sorted(found)]
