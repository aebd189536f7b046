"""A project's state: initialised in steps, each of which can be run again, and read back in full."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tarnforge.settings import Settings
from tarnforge.sources import files, storage
from tarnforge.workspace import normalised

#: How a project's tables are kept: none written, beside the project, or in a folder that is given (fixed values).
MODES = ("memory-only", "default", "full")
VERSION = "2"
_FOLDERS = ("config", "logs", "store", "cache")


def project_id(path: str) -> str:
    """A short name for a path, as ``functions.text.project_id`` gives it for a column."""
    h = 0
    for c in path:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    return f"{abs(h):08x}"


@dataclass
class State:
    """What is known of a project; ``initialised`` only if nothing essential is missing."""

    path: str
    initialised: bool = False
    project_id: str | None = None
    mode: str | None = None
    version: str | None = None
    tables: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


@dataclass
class Step:
    name: str
    done: bool = False
    made: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class Result:
    status: str  # initialised, already_initialised or error
    state: State
    steps: list[Step] = field(default_factory=list)


def _home(path: str) -> str:
    return f"{path.rstrip('/')}/.tarnforge"


def state(spark: SparkSession, path: str) -> State:
    """The state that a project's folder tells; a missing or broken configuration is an error in it, not an exception."""
    out = State(path)
    at = f"{_home(path)}/config/project.json"
    if not storage.exists(spark, at):
        out.errors.append("there is no configuration")
        return out
    try:
        known = json.loads(storage.read(spark, at))
        if not isinstance(known, dict):
            raise ValueError("not an object")
    except Exception as e:
        out.errors.append(f"the configuration cannot be read: {e}")
        return out
    out.project_id, out.mode, out.version = known.get("project_id"), known.get("mode"), known.get("version")
    for name, wrong in (("project_id", not out.project_id), ("mode", out.mode not in MODES), ("version", out.version != VERSION)):
        if wrong:
            (out.errors if name == "project_id" else out.warnings).append(f"{name} is {known.get(name)!r}")
    out.tables = [t for t in files.TABLES if storage.exists(spark, f"{_home(path)}/store/{t}")]
    if out.mode != "memory-only":
        out.warnings += [f"table {t} is missing" for t in files.TABLES if t not in out.tables]
    out.initialised = known.get("initialised") is True and not out.errors
    return out


def initialise(spark: SparkSession, path: str, mode: str = "default", force: bool = False, settings: Settings = Settings(), now: str = "", registry: str | None = None) -> Result:
    """Make a project ready. The first five steps must succeed; of the others a failure is a warning.

    A project that is ready already is left as it is unless ``force``. ``memory-only`` writes no tables; ``full`` also enters the
    project into ``registry``, a folder that lists all.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    before = state(spark, path)
    if before.initialised and not force:
        return Result("already_initialised", before)
    home, steps, found = _home(path), [], {}

    def resolve() -> list[str]:
        found["path"] = normalised(path) if "://" not in path else path
        found["id"] = project_id(found["path"])
        return [found["id"]]

    def folders() -> list[str]:
        made = [f for f in _FOLDERS if not storage.exists(spark, f"{home}/{f}")]
        for f in made:
            storage.make_folder(spark, f"{home}/{f}")
        return made

    def put(name: str, text: str, keep: bool) -> list[str]:
        if keep and storage.exists(spark, name):
            return []
        storage.replace(spark, name, text)
        return [name.rsplit("/", 1)[1]]

    def project_file() -> list[str]:
        known = {"initialised": True, "initialised_at": now, "project_id": found["id"], "version": VERSION, "mode": mode}
        return put(f"{home}/config/project.json", json.dumps(known, indent=1), keep=False)

    def probe() -> list[str]:
        at = f"{home}/store/probe"
        storage.replace(spark, at, "ok")
        there = storage.read(spark, at) == "ok"
        storage.delete(spark, at)
        if not there:
            raise OSError("the store cannot be read back")
        return []

    def enter() -> list[str]:
        return put(f"{registry}/{found['id']}.json", json.dumps({"path": found["path"], "mode": mode, "at": now}), keep=False) if registry and mode == "full" else []

    plan: list[tuple[str, Callable[[], list[str]], bool]] = [
        ("resolve", resolve, True),
        ("folders", folders, True),
        ("settings", lambda: put(f"{home}/config/settings.json", json.dumps(settings.as_dict(), indent=1), keep=not force), True),
        ("tables", lambda: files.init_tables(spark, f"{home}/store", force) if mode != "memory-only" else [], True),
        ("project", project_file, True),
        ("rules", lambda: put(f"{path}/{files.RULE_FILE}", "\n".join(files.BUILT_IN) + "\n", keep=True), False),
        ("probe", probe, False),
        ("registry", enter, False),
    ]
    problems = []
    for name, run, essential in plan:
        step = Step(name)
        steps.append(step)
        try:
            step.made, step.done = run(), True
        except Exception as e:
            step.error = str(e)
            if essential:
                failed = State(path, errors=[f"{name}: {e}"])
                return Result("error", failed, steps)
            problems.append(f"{name}: {e}")
    after = state(spark, path)
    after.warnings += problems
    return Result("initialised" if after.initialised else "error", after, steps)


def registered(spark: SparkSession, registry: str) -> dict[str, dict]:
    """Projects by id that a registry lists."""
    return {n.removesuffix(".json"): json.loads(storage.read(spark, f"{registry}/{n}")) for n in storage.names(spark, registry) if n.endswith(".json") and not n.startswith(".")}
