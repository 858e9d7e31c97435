"""Classification of items by their paths, and which of them are left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths
from lodestack.functions.text import col, estimate_tokens

# File types by suffix.
FILE_TYPES = {
    "documentation": ".md .rst .txt".split(),
    "code": ".py .js .ts .tsx .jsx .java .go .rs .c .cc .cpp".split(),
    "config": ".json .yaml .yml .toml .ini .cfg".split(),
}
# Names that make an item a contract, a workflow or selection logic.
CONTRACT_NAMES = ["skill.md", "openai.yaml", "manifest.schema.json", "final_reply.schema.md"]
CONTRACT_FOLDERS = ["schemas", "templates"]
CONTRACT_END = "config/defaults.yaml"
WORKFLOW_NAMES = ["prepare_handoff.py", "render_preview.py", "confirm_handoff.py", "workflow.py"]
SELECTION_NAMES = ["selection.py", "token_tools.py", "selector.py"]
SCHEMA_TEMPLATE_NAMES = ["reply_template.md", "manifest.schema.json", "final_reply.schema.md", "openai.yaml"]
# Priority, score and layer of each kind.
KINDS = {
    "contract": (2, 940, "stable_contract", "Defines the shape of the output or the policy."),
    "workflow": (3, 860, "evidence", "Controls how a package is made, shown or confirmed."),
    "selection_logic": (4, 800, "evidence", "Decides ranking, extraction or budgets."),
    "code_snippet": (5, 720, "evidence", "Code that grounds the discussion."),
    "supporting_context": (6, 620, "evidence", "Context that frames the task."),
}
ATTACHMENT_SCORE = 80
# Kinds that a gate lets through.
GATES = {"brief_only": [], "brief_plus_contract": ["contract", "workflow"], "full_bundle": list(KINDS)}


@dataclass(frozen=True)
class Exclusions:
    """What a corpus leaves out: whole names, suffixes, folders (a name anywhere, or a path from the top)."""

    names: tuple[str, ...] = (".DS_Store",)
    suffixes: tuple[str, ...] = (".pyc", ".lock")
    folders: tuple[str, ...] = (".git", "__pycache__", "node_modules", "data")
    runs: tuple[str, ...] = (".codex/handoffs",)


def file_type(path: Column | str) -> Column:
    end, out = F.lower(paths.suffix(path)), F.lit(None).cast("string")
    for kind, ends in FILE_TYPES.items():
        out = F.coalesce(out, F.when(end.isin(ends), kind))
    log = (end == ".log") | F.array_contains(F.transform(paths.parts(path), F.lower), "log")
    return F.coalesce(out, F.when(log, "log"), F.lit("other"))


def artifact_type(path: Column | str) -> Column:
    """contract, workflow, selection_logic, code_snippet or supporting_context: the first that fits."""
    low, own = F.lower(col(path)), F.lower(paths.name(path))
    folders = F.split(low, "/")
    contract = own.isin(CONTRACT_NAMES) | F.arrays_overlap(folders, F.array(*map(F.lit, CONTRACT_FOLDERS))) | F.endswith(low, F.lit(CONTRACT_END))
    return (
        F.when(contract, "contract").when(own.isin(WORKFLOW_NAMES), "workflow").when(own.isin(SELECTION_NAMES), "selection_logic")
        .when(file_type(path) == "code", "code_snippet").otherwise("supporting_context")
    )


def of_kind(kind: Column | str, field: int) -> Column:
    """Priority (0), score (1), layer (2) or reason (3) of a kind."""
    out = F.lit(None)
    for name, values in KINDS.items():
        out = F.coalesce(out, F.when(col(kind) == name, F.lit(values[field])))
    return F.coalesce(out, F.lit(ATTACHMENT_SCORE)) if field == 1 else out


def schema_template(path: Column | str) -> Column:
    low = F.lower(col(path))
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, CONTRACT_FOLDERS))) | F.lower(paths.name(path)).isin(SCHEMA_TEMPLATE_NAMES) | F.endswith(low, F.lit(CONTRACT_END))


def node_type(path: Column | str, kind: Column | str) -> Column:
    """The graph's node of an item besides its file node; null for kinds that have none."""
    return F.when(col(kind) == "contract", F.when(schema_template(path), "artifact_schema_template").otherwise("artifact_contract")).when(col(kind) == "workflow", "artifact_workflow")


def excluded(path: Column | str, rules: Exclusions = Exclusions()) -> Column:
    out = paths.name(path).isin(list(rules.names)) | F.lower(paths.suffix(path)).isin(list(rules.suffixes))
    above = F.slice(paths.parts(path), 1, F.greatest(F.size(paths.parts(path)) - 1, F.lit(0)))
    out |= F.arrays_overlap(above, F.array(*map(F.lit, rules.folders)))
    for run in rules.runs:
        out |= paths.has_run(path, run)
    for folder in rules.folders:
        out |= (col(path) == folder) | F.startswith(col(path), F.lit(folder + "/"))
    return out


def classified(corpus: DataFrame) -> DataFrame:
    """corpus (path, ...) with file_type, artifact_type, context_layer, base_reason and base_priority: what is said of items without their texts."""
    out = corpus.withColumns({"file_type": file_type("path"), "artifact_type": artifact_type("path")})
    return out.withColumns({"context_layer": of_kind("artifact_type", 2), "base_reason": of_kind("artifact_type", 3), "base_priority": of_kind("artifact_type", 0)})


def catalog(corpus: DataFrame) -> DataFrame:
    """corpus (path, content, ...) as classified(), with n_tokens."""
    return classified(corpus).withColumn("n_tokens", estimate_tokens("content"))


def scan_summary(corpus: DataFrame, rules: Exclusions = Exclusions()) -> DataFrame:
    """Counts of binary, excluded and candidate items; corpus may have is_text."""
    text = F.col("is_text") if "is_text" in corpus.columns else F.lit(True)
    out = excluded("path", rules)
    return corpus.agg(F.count("*").alias("n_items"), F.count_if(~text).alias("n_binary"), F.count_if(~text | out).alias("n_excluded"), F.count_if(text & ~out).alias("n_candidates"))


def graph_terms(path: Column | str) -> Column:
    """Words by which a text refers to an item: its path, name, two forms of its stem, and fixed ones of special names."""
    low, own, base = F.lower(col(path)), F.lower(paths.name(path)), F.lower(paths.stem(path))
    none = F.array().cast("array<string>")
    terms = F.array(low, own, F.translate(base, ".", "_"), F.replace(base, F.lit("."), F.lit("")))
    # More words of special names.
    for test, more in (
        (F.contains(low, F.lit("manifest.schema")), "manifest schema status paths artifacts"),
        (F.contains(low, F.lit("reply_template")), "reply reply_template template handoff_id final_reply"),
        (F.contains(low, F.lit("defaults.yaml")), "defaults token budget exclude next_actions"),
        (own == "openai.yaml", "openai metadata policy prompt"),
        (own == "skill.md", "skill handoff preview confirm"),
    ):
        terms = F.concat(terms, F.when(test, F.array(*map(F.lit, more.split()))).otherwise(none))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= 3))
