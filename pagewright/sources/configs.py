"""Settings files, read on the driver."""

from __future__ import annotations

import json
from typing import Any

#: Settings of a page where none are given.
DEFAULTS: dict[str, Any] = {
    "page-size": (595, 842), "dpi": 72, "margin-x": 20, "margin-y": 20, "font-path": None, "font-size": 9, "line-height": 10,
    "font-color": "#000000", "alignment": "JUSTIFY", "horizontal-scale": 1.0, "first-line-indent": 0, "left-indent": 0,
    "right-indent": 0, "space-after": 0, "space-before": 0, "border-width": 0, "border-padding": 0, "page-bg-color": "#FFFFFF",
    "para-bg-color": "#FFFFFF", "auto-crop-width": False, "auto-crop-last-page": False, "newline-markup": "<br/>", "remove-line-breaks": False,
}
#: Settings that must be there, those that are numbers, and the alignments there are.
REQUIRED = ("font-path", "page-size", "font-size", "line-height", "margin-x", "margin-y", "font-color", "alignment", "page-bg-color", "para-bg-color")
NUMBERS = ("font-size", "line-height", "margin-x", "margin-y", "dpi")
ALIGNMENTS = ("LEFT", "CENTER", "RIGHT", "JUSTIFY")


def parsed(config: dict[str, Any]) -> dict[str, Any]:
    """Colours as #rrggbb, a known alignment (else JUSTIFY), the page size as two numbers."""
    out = dict(config)
    for key, value in config.items():
        if key.endswith("color") and isinstance(value, str):
            int(value.lstrip("#"), 16)
            out[key] = "#" + value.lstrip("#").lower()
    if isinstance(out.get("alignment"), str):
        out["alignment"] = out["alignment"] if out["alignment"] in ALIGNMENTS else "JUSTIFY"
    if isinstance(out.get("page-size"), str):
        out["page-size"] = tuple(float(x) for x in out["page-size"].split(","))
    return out


def validated(config: dict[str, Any]) -> dict[str, Any]:
    """Raises ValueError where a setting is missing or of the wrong kind."""
    for key in REQUIRED:
        if key not in config:
            raise ValueError(f"{key} is missing")
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    for key in NUMBERS:
        if key in config and not number(config[key]):
            raise ValueError(f"{key} is not a number")
    size = config["page-size"]
    if not isinstance(size, list | tuple) or len(size) != 2 or not all(map(number, size)):
        raise ValueError("page-size is not two numbers")
    return config


def merged(base: dict[str, Any], item: dict[str, Any] | None) -> dict[str, Any]:
    """The item's settings over the base's."""
    return parsed({**base, **(item or {})})


def render_config(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return validated(parsed(json.load(f)))


def model_config(path: str, need_prompt: bool = False) -> dict[str, Any]:
    """A model's settings; model_name and max_tokens must be there, prompt if asked for."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    for key in ("model_name", "max_tokens", *["prompt"] * need_prompt):
        if key not in config:
            raise ValueError(f"{key} is missing")
    return config
