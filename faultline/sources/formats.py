"""Log line formats: named layouts and user-supplied regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class LineFormat:
    """``regex`` is a Java pattern, ``groups`` its wanted group numbers, ``fields`` their column names."""

    name: str
    regex: str
    fields: tuple[str, ...]
    groups: tuple[int, ...]


# Unicode classes, and only \n ends a line.
_FLAGS = "(?dU)"

# The three line layouts and their field names.
_LAYOUTS = {
    "hdfs": (
        r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([^:]+):\s+(.*)$",
        ("date", "time", "pid", "level", "component", "content"),
    ),
    "bgl": (
        r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$",
        ("label", "timestamp", "date", "node", "time", "node_repeat", "type", "component", "level", "content"),
    ),
    "openstack": (
        r"^(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\w+)\s+(\S+)\s+(\[[\w\s\-\.]*\])\s+(.*)$",
        ("logrecord", "date", "time", "pid", "level", "component", "address", "content"),
    ),
    "sample": (
        r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\s+\[(\w+)\s*\]\s+\[(.*?)\s*\]\s+(.*)$",
        ("timestamp", "level", "layer", "content"),
    ),
}


def resolve(fmt: str | LineFormat) -> LineFormat:
    """A known layout by name, else ``fmt`` is a regular expression with named groups."""
    if isinstance(fmt, LineFormat):
        return fmt
    if fmt in _LAYOUTS:
        regex, fields = _LAYOUTS[fmt]
        return LineFormat(fmt, _FLAGS + regex, fields, tuple(range(1, len(fields) + 1)))
    return custom(fmt)


def custom(pattern: str) -> LineFormat:
    """Turn a Python pattern with ``(?P<name>..)`` groups into positions.

    Java group names allow no underscore, so names stay on the Python side. As with a prefix match,
    text behind the pattern is ignored.
    """
    order = re.compile(pattern).groupindex
    if not order:
        raise ValueError("the pattern needs at least one named group")
    java = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\{order[m.group(1)]}", pattern)
    java = re.sub(r"\(\?P<\w+>", "(", java)
    return LineFormat("custom", f"{_FLAGS}^(?:{java})(?s:.*)$", tuple(order), tuple(order.values()))
