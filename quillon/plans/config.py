"""Configuration of benchmarks: reading, older keys, precedence, validation, expansion of plans."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ("models", "datasets", "prompts", "experiment_plans", "output_settings")
# Older names of sections.
OLDER = {"model_configurations": "models", "dataset_configurations": "datasets", "prompt_strategies": "prompts", "plans": "experiment_plans", "output": "output_settings"}
BACKEND_NAMES = ("vllm", "hf", "llama_cpp", "online", "stub")
DECISION_MODES = ("majority_vote", "logprob_threshold")


@dataclass(frozen=True)
class Experiment:
    name: str
    model: str
    dataset: str
    prompt: str
    options: dict = field(default_factory=dict, hash=False)


def normalised(raw: dict) -> dict:
    """Sections under their present names."""
    return {OLDER.get(k, k): v for k, v in raw.items()}


def read(path: str | Path) -> dict:
    """A single file, or a folder with a file per section; a section's file may hold it bare or under its name."""
    p = Path(path)
    if p.is_file():
        return normalised(json.loads(p.read_text(encoding="utf-8")))
    out: dict = {}
    for f in sorted(p.glob("*.json")):
        raw = normalised(json.loads(f.read_text(encoding="utf-8")))
        known = {k: v for k, v in raw.items() if k in SECTIONS}
        out |= known or {OLDER.get(f.stem, f.stem): raw}
    return out


def compose(base: dict, discovered: dict | None = None, explicit: dict | None = None) -> dict:
    """Each section from the first source that has it: explicit, discovered, base."""
    return normalised(base) | normalised(discovered or {}) | normalised(explicit or {})


def problems(config: dict) -> list[str]:
    """What is wrong with a configuration; an empty list if nothing is."""
    out = [f"section {s} is missing" for s in SECTIONS[:3] if not config.get(s)]
    for name, m in config.get("models", {}).items():
        if m.get("backend", "stub") not in BACKEND_NAMES:
            out.append(f"model {name}: unknown backend {m['backend']}")
        mode, threshold = m.get("binary_decision_mode", "majority_vote"), m.get("binary_logprob_threshold")
        if mode not in DECISION_MODES:
            out.append(f"model {name}: unknown decision mode {mode}")
        if mode == "logprob_threshold" and not (m.get("enable_logprobs") and threshold is not None and 0 <= threshold <= 1):
            out.append(f"model {name}: a threshold between 0 and 1 and log-probabilities are needed")
    for name, plan in config.get("experiment_plans", {}).items():
        for key in ("models", "datasets", "prompts"):
            out += [f"plan {name}: unknown {key[:-1]} {x}" for x in plan.get(key, []) if x not in config.get(key, {})]
    return out


def expand(config: dict, plan: str) -> list[Experiment]:
    """Every model on every dataset with every prompt, in this order."""
    p = config["experiment_plans"][plan]
    return [Experiment(f"{m}_{d}_{q}", m, d, q) for m in p["models"] for d in p["datasets"] for q in p["prompts"]]


def expanded(spark: SparkSession, config: dict, plan: str) -> DataFrame:
    """The same as a table (position, name, model, dataset, prompt)."""
    rows = [(i, e.name, e.model, e.dataset, e.prompt) for i, e in enumerate(expand(config, plan))]
    return spark.createDataFrame(rows, "position int, name string, model string, dataset string, prompt string")


def product(models: DataFrame, datasets: DataFrame, prompts: DataFrame) -> DataFrame:
    """Plan expansion of small tables (model, dataset, prompt columns) by lists in one row, without a cross join of row sets."""
    lists = lambda df, c: df.agg(F.array_sort(F.collect_set(c)).alias(c))
    one = F.lit(1).alias("_k")
    m, d, p = (lists(df, c).select(c, one) for df, c in ((models, "model"), (datasets, "dataset"), (prompts, "prompt")))
    j = m.join(d, "_k").join(p, "_k").select(F.explode("model").alias("model"), "dataset", "prompt")
    return j.select("model", F.explode("dataset").alias("dataset"), "prompt").select("model", "dataset", F.explode("prompt").alias("prompt"))
