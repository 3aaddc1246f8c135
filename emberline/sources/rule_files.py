"""Detection rules from files: Markdown with a front matter (`---` lines), or the same fields alone.

The front matter is the small part of YAML that such files use: `key: value`, nested keys and lists by indentation, `[a, b]`, quoted
texts, comments. Files are read in the order of their names and are configuration: they come to the driver whole.
"""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".md", ".yaml", ".yml")


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ('"', "'") and text[-1:] == text[:1] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    text = re.sub(r"\s+#.*$", "", text)
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def parse_fields(text: str) -> dict[str, Any]:
    """Fields of a front matter."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def block(at: int, depth: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
                items.append(_scalar(lines[at][1][2:]))
                at += 1
            return items, at
        fields: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == depth and (m := re.match(r"([\w.-]+):(?:\s+(.*))?$", lines[at][1])):
            at += 1
            if m[2]:
                fields[m[1]] = _scalar(m[2])
            elif at < len(lines) and (lines[at][0] > depth or (lines[at][0] == depth and lines[at][1].startswith("- "))):
                fields[m[1]], at = block(at, lines[at][0])
            else:
                fields[m[1]] = None
        return fields, at

    found, at = block(0, lines[0][0]) if lines else ({}, 0)
    if at < len(lines) or not isinstance(found, dict):
        raise ValueError(f"not understood: {lines[min(at, len(lines) - 1)][1]!r}")
    return found


def parse_rule(name: str, text: str) -> dict[str, Any]:
    """A rule's fields; the text under a front matter, without its title, is the hint unless it has one."""
    if not name.endswith(".md"):
        return parse_fields(text)
    parts = text.lstrip().split("---", 2)
    if not text.lstrip().startswith("---") or len(parts) < 3:
        return {"hint": text.strip()}
    rule, body = parse_fields(parts[1]), re.sub(r"^#\s+.*\n+", "", parts[2].strip(), count=1).strip()
    return rule if rule.get("hint") or not body else {**rule, "hint": body}


def read_rules(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Rules of a folder's files, flat: id, title, level, category, hint, runbook, message_regex, levels, minutes_after_deploy."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").orderBy("name").collect()
    rules = []
    for name, text in files:
        if name.endswith(SUFFIXES):
            rule = parse_rule(name, text)
            chosen = rule.get("selection") or {}
            levels = chosen.get("level")
            rules.append({
                **{k: rule.get(k) for k in ("id", "title", "level", "category", "hint", "runbook")}, "message_regex": chosen.get("message_regex"),
                "levels": [levels] if isinstance(levels, str) else levels, "minutes_after_deploy": chosen.get("first_seen_within_minutes_after_deploy"),
            })
    return rules


def write_rules(rules: DataFrame, path: str) -> str:
    """Files of rules (name, text), one a rule; returns the folder."""

    def save(rows) -> None:  # noqa: ANN001
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for r in rows:
            with fs.open_output_stream(os.path.join(root, r["name"])) as f:
                f.write(r["text"].encode())

    rules.foreachPartition(save)
    return path
