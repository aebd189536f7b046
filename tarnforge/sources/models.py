"""Text models behind an interface: prompts, a service for tasks, and the enrichment of chunks, each with its settings."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnforge.sources.providers import rendered, valid_output

Model = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Prompt:
    """A template with what it is good for; ``required`` are the members that a JSON answer must have."""

    id: str
    name: str
    template: str
    tags: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    enabled: bool = True


class Prompts:
    """Prompts by id; those that are not enabled are found only by id."""

    def __init__(self, known: Iterable[Prompt] = ()):
        self._known = {p.id: p for p in known}

    def get(self, id: str) -> Prompt | None:
        return self._known.get(id)

    def named(self, name: str) -> Prompt | None:
        return next((p for p in self._known.values() if p.enabled and p.name == name), None)

    def tagged(self, *tags: str) -> list[Prompt]:
        """Enabled prompts that have all the tags."""
        return [p for p in self._known.values() if p.enabled and set(tags) <= set(p.tags)]

    def put(self, prompt: Prompt) -> None:
        self._known[prompt.id] = prompt

    def enable(self, id: str, on: bool = True) -> None:
        self._known[id] = replace(self._known[id], enabled=on)


LIBRARY = Prompts(
    [
        Prompt("summary", "Summary", "Summarise the following {{kind}} in one sentence, as JSON {\"summary\": ...}:\n{{content}}", ("enrichment", "text"), ("summary",)),
        Prompt("keywords", "Keywords", "List the keywords of the following {{kind}}, as JSON {\"keywords\": [...]}:\n{{content}}", ("enrichment", "text"), ("keywords",)),
        Prompt("entities", "Entities", "List the functions, classes and names in the following {{kind}}, as JSON {\"entities\": [...]}:\n{{content}}", ("enrichment", "code"), ("entities",)),
        Prompt("complexity", "Complexity", "Rate the complexity of the following {{kind}} from 1 to 10, as JSON {\"complexity\": n}:\n{{content}}", ("enrichment", "code"), ("complexity",)),
        Prompt("segmentation", "Segmentation", "Say which lines of the following {{kind}} belong together, as JSON {\"suggestions\": [{\"startLine\": n, \"endLine\": n, \"type\": ...}]}:\n{{content}}", ("segmentation",), ("suggestions",)),
    ]
)


class ModelError(RuntimeError):
    """A model that is missing, disabled, late or answers too little."""


@dataclass(frozen=True)
class Service:
    """A model for the tasks of ``prompts``, with a bound on what it is sent and on how long it may take."""

    model: Model | None
    name: str = "offline"
    models: Callable[[], list[str]] = list
    prompts: Prompts = field(default_factory=lambda: LIBRARY)
    enabled: bool = True
    max_chars: int = 8000
    timeout: float = 30.0
    batch: int = 5

    def available(self) -> bool:
        """Whether there is a model and it is among those that are offered, if any are."""
        if not self.enabled or self.model is None:
            return False
        try:
            offered = self.models()
        except Exception:  # a list that cannot be had is no model
            return False
        return not offered or self.name in offered

    def _called(self, asked: list[str]) -> list[str]:
        if not self.enabled:
            raise ModelError("models are disabled")
        if self.model is None:
            raise ModelError("there is no model")
        pool = ThreadPoolExecutor(1)
        try:
            out = pool.submit(self.model, asked).result(timeout=self.timeout)
        except TimeoutError as e:
            raise ModelError(f"no answer after {self.timeout} s") from e
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if len(out) != len(asked):
            raise ModelError(f"{len(out)} answers to {len(asked)} prompts")
        return out

    def generate(self, prompt: str) -> str:
        """An answer to a prompt as it is."""
        return self._called([prompt])[0]

    def prompt(self, task: str, content: str, kind: str = "text") -> str:
        p = self.prompts.get(task)
        if p is None or not p.enabled:
            raise ModelError(f"no such task: {task}")
        if len(content) > self.max_chars:
            content = content[: self.max_chars] + " [cut]"
        return rendered(p.template, {"kind": kind, "content": content})

    def analysed(self, task: str, content: str, kind: str = "text") -> str:
        return self.generate(self.prompt(task, content, kind))

    def analysed_all(self, task: str, contents: list[tuple[str, str]]) -> list[str | None]:
        """Answers for ``(content, kind)``, some at a time; where a batch fails each is tried alone, and null is what fails then."""
        out: list[str | None] = []
        for i in range(0, len(contents), self.batch):
            asked = [self.prompt(task, c, k) for c, k in contents[i : i + self.batch]]
            try:
                out += self._called(asked)
            except Exception:
                out += [self._alone(p) for p in asked]
        return out

    def _alone(self, prompt: str) -> str | None:
        try:
            return self._called([prompt])[0]
        except Exception:  # a model's failure is a row's, not the job's
            return None


#: Least and greatest value by setting of the enricher, its providers and features (fixed values).
RANGES = {"temperature": (0, 2), "max_tokens": (1, 10_000), "timeout_ms": (1_000, 120_000), "batch_size": (1, 50), "cache_ttl_seconds": (0, 86_400)}
PROVIDERS = ("ollama", "openai", "anthropic", "fake")
FEATURES = ("summary", "keywords", "entities", "complexity", "category", "sentiment", "topics", "relations")


@dataclass(frozen=True)
class Enricher:
    """Settings of the enrichment (fixed values)."""

    enabled: bool = False
    provider: str = "fake"
    model: str = "offline"
    temperature: float = 0.1
    max_tokens: int = 1000
    timeout_ms: int = 30_000
    batch_size: int = 5
    features: tuple[str, ...] = ("summary", "keywords", "entities")
    cache_enabled: bool = True
    cache_ttl_seconds: int = 3600

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = [f"{n} must be from {a} to {b}" for n, (a, b) in RANGES.items() if not a <= getattr(self, n) <= b]
        out += [f"no such provider: {self.provider}"] * (self.provider not in PROVIDERS)
        return out + [f"no such feature: {f}" for f in self.features if f not in FEATURES]

    @classmethod
    def of(cls, **values) -> Enricher:
        """Known values; wrong ones fail, all named at once."""
        known = {f.name for f in fields(cls)}
        if odd := sorted(set(values) - known):
            raise TypeError(f"no such setting: {', '.join(odd)}")
        made = cls(**({"features": tuple(values.pop("features"))} if values.get("features") is not None else {}), **values)
        if found := made.problems():
            raise ValueError("; ".join(found))
        return made

    @classmethod
    def read(cls, prefix: str = "TARNFORGE_ENRICHER_") -> Enricher:
        """From the environment; what cannot be read as its kind is left at its default."""
        values = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            try:
                values[f.name] = raw.lower() == "true" if isinstance(f.default, bool) else tuple(raw.split(",")) if isinstance(f.default, tuple) else type(f.default)(raw)
            except ValueError:
                continue
        return cls.of(**values)

    def as_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self)})


def request_problems(request: dict) -> list[str]:
    """What is wrong with a chunk that is to be enriched."""
    rules = [("id is missing", bool(request.get("id"))), ("content is empty", bool((request.get("content") or "").strip()))]
    return [name for name, holds in rules if not holds]


def answer_problems(answer: dict, features: Iterable[str]) -> list[str]:
    """What is wrong with an enrichment: a feature that is missing or of the wrong kind."""
    kinds = {"summary": str, "category": str, "sentiment": str, "keywords": list, "entities": list, "topics": list, "relations": list, "complexity": int | float}
    return [f"{f} is missing" if f not in answer else f"{f} is of the wrong kind" for f in features if f not in answer or not isinstance(answer[f], kinds[f])]


def enriched(chunks: DataFrame, settings: Enricher, service: Service) -> DataFrame:
    """``id, answer, problems, ms, model`` for every row of ``chunks (id, kind, content)``: checked, asked, and checked again.

    Each feature is one prompt; ``answer`` is a JSON object of those that were answered well. A row that fails a check has its problems.
    Null content or id is such a failure and is not sent.
    """
    features = [f for f in settings.features if service.prompts.get(f)]
    service = replace(service, batch=settings.batch_size, timeout=settings.timeout_ms / 1000)

    def run(batches):
        for b in batches:
            rows = [{"id": i, "kind": k, "content": c} for i, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True)]
            problems = [request_problems(r) if settings.enabled else ["enrichment is disabled"] for r in rows]
            sent = [i for i, p in enumerate(problems) if not p]
            answers: list[dict] = [{} for _ in rows]
            began = time.perf_counter()
            for f in features:
                for i, text in zip(sent, service.analysed_all(f, [(rows[i]["content"], rows[i]["kind"] or "text") for i in sent]), strict=True):
                    answers[i] |= {k: v for k, v in (valid_output(text or "", [f]) or {}).items() if k == f}
            ms = 1000 * (time.perf_counter() - began) / max(len(sent), 1)
            for i in sent:
                problems[i] = answer_problems(answers[i], features)
            text, many = pa.string(), pa.list_(pa.string())
            columns = [b.column(0), pa.array([json.dumps(a, sort_keys=True) for a in answers], text), pa.array(problems, many), pa.array([ms if i in set(sent) else 0.0 for i in range(len(rows))], pa.float64()), pa.array([settings.model] * len(rows), text)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "answer", "problems", "ms", "model"])

    return chunks.select(F.col("id").cast("string").alias("id"), "kind", "content").mapInArrow(run, "id string, answer string, problems array<string>, ms double, model string")
