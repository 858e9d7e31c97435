"""A task request: what a context is selected for."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

MIN_BUDGET = 96
SCHEMA = (
    "mode string, topic string, goal string, focus_points array<string>, must_include array<string>, must_exclude array<string>, known_routes array<string>, "
    "blockers array<string>, questions array<string>, avoid_directions array<string>, output_requirements array<string>, mentioned_paths array<string>, "
    "max_files int, max_bundle_tokens int, background string, require_exact_tokens boolean"
)

#: Fields of a request that make up its task state.
TASK_STATE = "topic goal focus_points questions blockers known_routes must_include must_exclude mentioned_paths output_requirements".split()


@dataclass(frozen=True)
class Request:
    mode: str
    topic: str
    goal: str
    focus_points: tuple[str, ...] = ()
    must_include: tuple[str, ...] = ()
    must_exclude: tuple[str, ...] = ()
    known_routes: tuple[str, ...] = ()
    blockers: tuple[str, ...] = ()
    questions: tuple[str, ...] = ()
    avoid_directions: tuple[str, ...] = ()
    output_requirements: tuple[str, ...] = ()
    mentioned_paths: tuple[str, ...] = ()
    max_files: int = 8
    max_bundle_tokens: int = 4096
    background: str = ""
    require_exact_tokens: bool = False

    def normalized(self) -> Request:
        """Trimmed; lists without empty and repeated entries."""
        changes = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, str):
                changes[f.name] = value.strip()
            elif isinstance(value, (list, tuple)):
                changes[f.name] = tuple(dict.fromkeys(x.strip() for x in value if x.strip()))
        return replace(self, **changes)

    def validate(self) -> Request:
        for name in ("mode", "topic", "goal"):
            if not getattr(self, name):
                raise ValueError(f"{name} must not be empty")
        if self.max_files < 1:
            raise ValueError("max_files must be 1 or more")
        if self.max_bundle_tokens < MIN_BUDGET:
            raise ValueError(f"max_bundle_tokens must be {MIN_BUDGET} or more")
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """The request as a table of one row, as the operators on tables of requests take it."""
        return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(self).values())], SCHEMA)

    def task_state(self) -> dict:
        """What the graph's anchors are found by, as a manifest records it."""
        return {name: getattr(self, name) for name in TASK_STATE}
