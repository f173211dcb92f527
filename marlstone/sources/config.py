"""Dataset configurations in YAML, read once by the driver."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import SparkSession


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return text


def parse(text: str) -> dict:
    """Mappings nested by indentation, with scalars, quoted strings, lists in brackets and lists of dashes: what dataset files use of YAML."""
    root: dict = {}
    open_: list[tuple[int, object, object, object]] = [(-1, root, None, None)]
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line)
        if not line.strip():
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        dash = body.startswith("- ") or body == "-"
        while open_[-1][0] >= depth and not (dash and isinstance(open_[-1][1], list) and open_[-1][0] == depth):
            open_.pop()
        _, held, above, name = open_[-1]
        if dash:
            if not isinstance(held, list):
                if held or above is None:
                    raise ValueError(f"a list where none is expected: {body!r}")
                above[name] = held = []
                open_[-1] = (open_[-1][0], held, above, name)
            held.append(_scalar(body[1:]))
            continue
        key, mark, value = body.partition(":")
        if not mark or not isinstance(held, dict):
            raise ValueError(f"neither a mapping nor a list: {body!r}")
        key = _scalar(key)
        if value.strip():
            held[key] = _scalar(value)
        else:
            held[key] = {}
            open_.append((depth, held[key], held, key))
    return root


def dataset(spark: SparkSession, path: str) -> dict:
    """A dataset's configuration, with its `path` resolved against the folder of the file itself, wherever that lies."""
    row = spark.read.text(path, wholetext=True).first()
    found = parse(row[0] if row else "")
    root = str(found.get("path") or ".")
    if not (root.startswith("/") or re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", root)):
        found["path"] = posixpath.normpath(posixpath.join(posixpath.dirname(path), root)) if "://" not in path else posixpath.join(posixpath.dirname(path), root)
    return found


def dumped(found: dict) -> str:
    """The resolved configuration as JSON, in the order of its keys."""
    return json.dumps(found, ensure_ascii=False)
