"""Jobs named in text, and the checkpoint folder that belongs to a run."""

from __future__ import annotations

import hashlib
import importlib
import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from rowmill.operators.transform import RowJob
from rowmill.sources.blocks import dataset_digest


def settings_of(text: str | None) -> dict[str, Any]:
    """A JSON object; nothing or blanks give an empty one."""
    if not text or not text.strip():
        return {}
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"job settings are not JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError("job settings must be a JSON object")
    return found


def load_job(name: str, settings: str | None = None, **defaults: Any) -> RowJob:
    """The job ``module:Class`` with JSON ``settings``, which win over ``defaults``."""
    module, colon, cls = name.partition(":")
    if not (module and colon and cls):
        raise ValueError(f"a job is named module:Class, not {name!r}")
    try:
        found = getattr(importlib.import_module(module), cls)
    except ModuleNotFoundError as e:
        if e.name != module and not module.startswith(f"{e.name}."):
            raise  # the module is there and one of its own imports is not
        raise ValueError(f"no module {module!r}") from e
    except AttributeError as e:
        raise ValueError(f"module {module!r} has no {cls!r}") from e
    if not (isinstance(found, type) and issubclass(found, RowJob) and found.transform_items is not RowJob.transform_items):
        raise TypeError(f"{name} does not write transform_items")
    return found(**(defaults | settings_of(settings)))


def checkpoint_folder(spark: SparkSession, base: str, job: RowJob, source: str, target: str, tag: str | None = None, resume: bool = True, keep: bool = True, footers: bool = False) -> str | None:
    """Where a run keeps its outputs: the same for the same job, input bytes and target, or for the same ``tag``.

    ``source`` may be a pattern; ``footers`` knows it by its files' lengths and ends (``content_digest``). ``resume=False`` names a fresh folder; ``keep=False`` keeps nothing and cannot be joined with it.
    """
    if not keep:
        if not resume:
            raise ValueError("a run that keeps no checkpoint has nothing to resume")
        return None
    tag = tag or f"{dataset_digest(spark, source, footers)}-{hashlib.sha256(target.encode()).hexdigest()[:16]}"
    return f"{base.rstrip('/')}/{type(job).__name__}_{tag}" + ("" if resume else f"_{uuid.uuid4().hex[:8]}")
