"""YAML configuration as small tables, and the report of what is wrong with it."""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

from tidewheel.operators.rules import Rules

LOCATOR = {"rss": "url", "youtube": "channel_id", "reddit": "subreddit", "x": "handle"}
LIVE = {"active", "degraded"}
STATES = LIVE | {"paywalled", "dead"}
SLUG = re.compile("([a-z0-9]+-)*[a-z0-9]+")
SOURCES = "source_id string, name string, kind string, url string, url_hash string, group_id string, enabled boolean, config_json string, status string, evidence string, message string, active_url string, raw_enabled boolean"
GROUPS = "group_id string, name string, category string, enabled boolean, builtin boolean"


def address(spec: dict[str, Any]) -> str:
    value = spec.get(LOCATOR.get(spec.get("kind"), ""))
    return {
        "youtube": f"https://www.youtube.com/feeds/videos.xml?channel_id={value}", "reddit": f"https://www.reddit.com/r/{value}/new.json", "x": f"https://x.com/{value}",
    }.get(spec.get("kind"), str(value))


def status_of(spec: dict[str, Any]) -> str:
    """The explicit status, or what ``enabled`` implies."""
    return spec.get("status") or ("active" if spec.get("enabled", True) else "dead")


def source_row(spec: dict[str, Any], group: str) -> dict[str, Any]:
    url, state = address(spec), status_of(spec)
    config = spec.get("config")
    return {
        "source_id": spec["id"], "name": spec.get("name") or spec["id"], "kind": spec["kind"], "url": url, "url_hash": hashlib.sha256(url.encode()).hexdigest(), "group_id": group,
        "enabled": state in LIVE, "config_json": None if config is None else json.dumps(config, separators=(",", ":"), sort_keys=True), "status": state,
        "evidence": spec.get("evidence"), "message": spec.get("message"), "active_url": spec.get("active_url"), "raw_enabled": bool(spec.get("enabled", True)),
    }


def problems(files: dict[str, dict[str, Any]], kinds: set[str] | None = None) -> list[str]:
    """Everything that is wrong with parsed group files, by file name; ``kinds`` are those that have a reader."""
    found, groups, ids, urls = [], {}, {}, {}
    for name, data in sorted(files.items()):
        group = data.get("group", "")
        if not SLUG.fullmatch(str(group)):
            found.append(f"{name}: group id {group!r} is no slug")
        if group in groups:
            found.append(f"{name}: group {group!r} is also in {groups[group]}")
        groups.setdefault(group, name)
        for spec in data.get("sources") or []:
            label = f"{name}: source {spec.get('id')!r}"
            given = {k for k in LOCATOR.values() if spec.get(k) is not None}
            if given != {LOCATOR.get(spec.get("kind"))}:
                found.append(f"{label} of kind {spec.get('kind')!r} has locators {sorted(given)}")
                continue
            state = spec.get("status")
            if state is not None and state not in STATES:
                found.append(f"{label} can't have status {state!r}")
            elif state is not None and "enabled" in spec and bool(spec["enabled"]) != (state in LIVE):
                found.append(f"{label} has status {state!r} but enabled={spec['enabled']}")
            if state == "dead" and not spec.get("evidence"):
                found.append(f"{label} is dead without evidence")
            if state == "paywalled" and not spec.get("message"):
                found.append(f"{label} is paywalled without a message")
            if spec.get("id") in ids:
                found.append(f"{label} is also in {ids[spec['id']]}")
            ids.setdefault(spec.get("id"), name)
            url = address(spec)
            if url in urls:
                found.append(f"{label} has the feed of {urls[url]!r}")
            urls.setdefault(url, spec.get("id"))
            if kinds is not None and data.get("enabled", True) and spec.get("enabled", True) and spec["kind"] not in kinds:
                found.append(f"{label} has kind {spec['kind']!r}, which no reader serves")
    return found


class Config:
    """A folder with ``groups/*.yml``, ``keywords.yml`` and ``settings.yml``; broken files raise."""

    def __init__(self, root: str) -> None:
        self.root = root
        self.files = {os.path.basename(p): self._load(p) for p in sorted(glob.glob(f"{root}/groups/*.yml"))}

    @staticmethod
    def _load(path: str) -> dict[str, Any]:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
        if not isinstance(data, dict):
            raise ValueError(f"{path}: not a mapping")
        return data

    def problems(self, kinds: set[str] | None = None) -> list[str]:
        return problems(self.files, kinds)

    def groups(self, spark: SparkSession) -> DataFrame:
        rows = [(d["group"], d.get("name") or d["group"], d.get("category") or d["group"], bool(d.get("enabled", True)), bool(d.get("builtin", False))) for d in self.files.values()]
        return spark.createDataFrame(rows, GROUPS)

    def sources(self, spark: SparkSession) -> DataFrame:
        rows = [source_row(s, d["group"]) for d in self.files.values() for s in d.get("sources") or []]
        return spark.createDataFrame(rows, SOURCES)

    def rules(self) -> Rules:
        path = f"{self.root}/keywords.yml"
        data = self._load(path) if os.path.exists(path) else {}
        return Rules(dict(data.get("aliases") or {}), tuple(data.get("mute") or ()), tuple(data.get("pin") or ()))

    def settings(self) -> dict[str, Any]:
        path = f"{self.root}/settings.yml"
        return self._load(path) if os.path.exists(path) else {}
