"""The model interface inside a Spark job, and a deterministic stand-in.

A backend is opened once per partition and gets chunks of prompts. Real engines and hosted services are left to the user;
nothing here opens a connection.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "response_text string, tokens_used long, duration double, confidence double, binary_label_confidence double, _error string"


class Backend(Protocol):
    def infer_batch(self, prompts: list[tuple[str, str]]) -> list[dict]:
        """A result for each (system, user): response_text, tokens_used and, if known, confidence and binary_label_confidence."""

    def count_tokens(self, text: str) -> int: ...

    def close(self) -> None: ...


class StubBackend:
    """Answers that depend on the prompt and the seed alone."""

    def __init__(self, seed: str = "0", positive: float = 0.5):
        self.seed, self.positive = seed, positive

    def infer_batch(self, prompts: list[tuple[str, str]]) -> list[dict]:
        out = []
        for system, user in prompts:
            u = int(hashlib.md5(f"{self.seed}|{system}|{user}".encode()).hexdigest()[:8], 16) / 2**32
            label = "VULNERABLE" if u < self.positive else "SAFE"
            text = f"The code was looked at once.\n[[FINAL_ANSWER: {label}]]"
            out.append({"response_text": text, "tokens_used": self.count_tokens(user) + self.count_tokens(text), "confidence": round(0.5 + abs(u - 0.5), 6), "binary_label_confidence": round(u, 6)})
        return out

    def count_tokens(self, text: str) -> int:
        return max(1, len(text) // 4)

    def close(self) -> None:
        pass


BACKENDS: dict[str, Callable[..., Backend]] = {"stub": StubBackend}
# Beginnings of model names and who serves them.
PROVIDERS = {"gpt": "openai", "o1": "openai", "o3": "openai", "claude": "anthropic"}


def backend(name: str, **options) -> Callable[[], Backend]:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(BACKENDS)}")
    return lambda: BACKENDS[name](**options)


def provider_of(model: str) -> str | None:
    return next((p for k, p in PROVIDERS.items() if model.lower().startswith(k)), None)


def sampling_parameters(supported: set[str], **values) -> tuple[dict, list[str]]:
    """(parameters to send, names left out because the backend lacks them); unset ones are omitted."""
    given = {k: v for k, v in values.items() if v is not None}
    return {k: v for k, v in given.items() if k in supported}, sorted(k for k in given if k not in supported)


def infer(prompts: DataFrame, open_backend: Callable[[], Backend], system: str = "system", user: str = "user", chunk: int = 256) -> DataFrame:
    """``prompts`` with the answer of each: a chunk's wall time is shared equally, a failure sets ``_error`` and makes the answer ``ERROR: `` and its message.

    Write the result out before working on it: nothing behind it then runs the model again.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = open_backend()
        try:
            for pdf in it:
                for i in range(0, len(pdf), chunk):
                    part = pdf.iloc[i : i + chunk].copy()
                    began = time.perf_counter()
                    try:
                        got, error = b.infer_batch(list(zip(part[system].fillna(""), part[user].fillna(""), strict=True))), None
                    except Exception as e:  # noqa: BLE001 - a failed chunk must not fail the job
                        got, error = [{}] * len(part), f"{type(e).__name__}: {e}"
                    each = (time.perf_counter() - began) / max(1, len(part))
                    part["response_text"] = [g.get("response_text") if error is None else f"ERROR: {error}" for g in got]
                    part["tokens_used"] = [int(g.get("tokens_used") or 0) for g in got]
                    part["duration"] = each
                    part["confidence"] = pd.Series([g.get("confidence") for g in got], index=part.index, dtype="float64")
                    part["binary_label_confidence"] = pd.Series([g.get("binary_label_confidence") for g in got], index=part.index, dtype="float64")
                    part["_error"] = error
                    yield part
        finally:
            b.close()

    fields = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{fields}, {RESULT}")


def in_request_order(requests: DataFrame, results: DataFrame, key: str = "request_id", order: str = "position") -> DataFrame:
    """Each request with its result: a success before an error, a placeholder where neither came."""
    r = results.groupBy(key).agg(F.max(F.when(F.col("error").isNull(), F.col("text"))).alias("_ok"), F.max("error").alias("_bad"))
    text = F.coalesce("_ok", F.concat(F.lit("ERROR: "), F.col("_bad")), F.lit("ERROR: missing result"))
    return requests.join(r, key, "left").select(order, key, text.alias("text"), F.col("_ok").isNotNull().alias("is_success"))
