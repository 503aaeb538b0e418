"""Small configuration files, read by the driver: branches, weights, bindings, evaluation questions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..model import Weights


def _yaml(path: str):
    import yaml

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_branches(path: str) -> dict:
    """{project: {branch: definition}}; a missing or blank file has none. The result is validated."""
    from ..operators.branches import Branches

    return Branches(_yaml(path) or {}).validate().projects


def save_branches(path: str, projects: dict) -> None:
    """Validate, then replace the file as a whole."""
    import yaml

    from ..operators.branches import Branches

    Branches(projects).validate()
    temporary = f"{path}.new"
    with open(temporary, "w", encoding="utf-8") as f:
        yaml.safe_dump(projects, f, sort_keys=True, allow_unicode=True)
    os.replace(temporary, path)


def load_weights(path: str) -> Weights:
    return Weights.of(_yaml(path))


def find_binding(start: str, names: tuple[str, ...] = (".quillstone/branch.yaml",)) -> dict | None:
    """The binding (repo, branch) of the nearest folder at or above ``start`` that has one."""
    folder = os.path.abspath(start)
    while True:
        for name in names:
            if (found := _yaml(os.path.join(folder, name))) is not None:
                return found
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, expect, branch) of an evaluation file."""
    data = _yaml(path) or {}
    rows = [(q["q"], list(q.get("expect", [])), q.get("branch") or data.get("branch")) for q in data.get("questions", [])]
    return spark.createDataFrame(rows, "question string, expect array<string>, branch string")
