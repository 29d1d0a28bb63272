"""Driver-side configuration: limits, nested settings, and the resolution of stores and providers."""

from __future__ import annotations

import json
import os
import re
import shlex
import subprocess
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import UTC, datetime


@dataclass(frozen=True)
class Limits:
    """Tunable bounds of the engine, by verb."""

    # fixed values: the defaults
    raw_excerpt_chars: int = 50000
    max_tags: int = 8
    slug_max: int = 60
    synth_workers: int = 4
    analyze_max_module_pages: int = 80
    analyze_module_min_files: int = 3
    analyze_module_depth: int = 2
    analyze_files_per_module: int = 80
    analyze_overview_chars: int = 12000
    analyze_module_chars: int = 8000
    analyze_keyfile_chars: int = 2500
    analyze_tree_dirs: int = 50
    retrieve_max_results: int = 5
    retrieve_min_score: float = 0.05
    retrieve_min_overlap: int = 2
    retrieve_min_prompt_chars: int = 15
    boot_workspace_max_age_days: int = 14
    boot_max_chars: int = 8000
    boot_raw_tail_chars: int = 0
    workspace_source_chars: int = 500000
    workspace_max_chars: int = 8000
    reflect_max_notes: int = 30
    tidy_every_days: int = 7
    tidy_min_pages: int = 12
    garden_suggest_threshold: float = 0.3
    garden_merge_threshold: float = 0.4
    garden_merge_chars: int = 20000
    garden_semantic_threshold: float = 0.85
    llm_timeout_seconds: int = 600

    @classmethod
    def load(cls, overrides: dict | None = None) -> Limits:
        """The defaults with the known names among ``overrides``; others are ignored."""
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in (overrides or {}).items() if k in known})


def merge(base: dict, over: dict | None) -> dict:
    """Nested dictionaries merged key by key; the right side wins."""
    both = {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in (over or {}).items()}
    return {**base, **both}


def coerce(text: str):
    """A literal of the command line: booleans, null, integers, else the text."""
    words = {"true": True, "false": False, "null": None, "none": None}
    low = text.strip().lower()
    if low in words:
        return words[low]
    return int(low) if re.fullmatch(r"[+-]?[0-9]+", low) else text


def set_value(config: dict, dotted: str, value) -> dict:
    """``config`` with one value set by its dotted path; a section is never replaced by a value."""
    head, _, rest = dotted.partition(".")
    old = config.get(head)
    if rest:
        if old is not None and not isinstance(old, dict):
            raise ValueError(f"{head} is a value, not a section")
        return {**config, head: set_value(old or {}, rest, value)}
    if isinstance(old, dict):
        raise ValueError(f"{head} is a section, not a value")
    return {**config, head: value}


def extract_json(reply: str | None) -> dict | None:
    """The first balanced {...} of a model's reply, code fences removed; null if it is no JSON."""
    text = re.sub(r"```(?:json)?", "", reply or "")
    depth, start = 0, None
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            start = m.start() if depth == 0 and start is None else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                try:
                    return json.loads(text[start : m.end()])
                except ValueError:
                    return None
    return None


def resolve_store(explicit: str | None, workspace: str | None, mapped: dict[str, str] | None = None, default: str | None = None, home: str = "~/quillspark") -> str:
    """Store of a call: given, else the workspace's, else the default, else the home one."""
    return explicit or (mapped or {}).get(workspace or "") or default or home


def resolve_provider(config: dict, name: str | None = None, models: dict | None = None) -> tuple[str, dict]:
    """(name, settings) of the completion provider: the name given or the first of the order; a store's models win."""
    section = config.get("provider", {})
    name = name or (section.get("order") or ["stub"])[0]
    if name == "embeddings":
        raise ValueError("embeddings is no completion provider")
    own = {f"model_{k}": v for k, v in (models or {}).items() if k in ("propose", "merge") and v}
    return name, {**section.get(name, {}), **own}


def resolve_embeddings(config: dict, store: dict | None = None) -> tuple[str | None, dict | None]:
    """(model, settings) of the embeddings provider, or nulls while it has no model or address."""
    settings = {**config.get("provider", {}).get("embeddings", {}), **{k: v for k, v in (store or {}).items() if v is not None}}
    return (settings["model"], settings) if settings.get("model") and settings.get("base_url") else (None, None)


def resolve_key(settings: dict, env: Mapping[str, str] = os.environ) -> str | None:
    """A provider's key: the variable it names, else the output of its helper command, else the literal; null if there
    is none.  The helper runs without a shell.  Read on the driver and never part of a plan."""
    held = env.get(settings.get("api_key_env") or "", "").strip()
    if held:
        return held
    if settings.get("api_key_helper"):
        try:
            ran = subprocess.run(shlex.split(settings["api_key_helper"]), capture_output=True, text=True, timeout=settings.get("api_key_helper_timeout", 30))
        except (subprocess.TimeoutExpired, OSError, ValueError) as e:
            raise RuntimeError(f"key helper failed: {type(e).__name__}") from e
        if ran.returncode:
            raise RuntimeError(f"key helper failed with status {ran.returncode}")
        if ran.stdout.strip():
            return ran.stdout.strip()
    return settings.get("api_key") or None


def payload(text: str | None) -> dict:
    """The object of a hook's input; {} if it is empty, malformed or no object."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


# fixed values: models by the gigabytes that 65 % of the memory leave for them (exclusive upper bound, propose, merge)
MEMORY_SHARE = 0.65
LOCAL_MODELS = [
    (6.0, "llama3.2:3b", "qwen2.5:7b"),
    (10.0, "qwen2.5:7b", "phi4:14b"),
    (20.0, "qwen2.5:7b", "deepseek-r1:14b"),
    (34.0, "qwen2.5:7b", "qwen3:32b"),
    (float("inf"), "qwen2.5:7b", "llama3.3:70b"),
]


def recommend_models(memory_gb: float) -> tuple[str, str]:
    """(propose, merge) models for a machine of that memory."""
    return next((propose, merge) for below, propose, merge in LOCAL_MODELS if memory_gb * MEMORY_SHARE < below)


def today() -> str:
    """The date in UTC."""
    return datetime.now(UTC).date().isoformat()
