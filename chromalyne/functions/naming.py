"""Names of output files."""

from __future__ import annotations

import re


def _stem(path: str) -> tuple[str, str]:
    directory, name = re.fullmatch(r"(?s)(.*[/\\])?([^/\\]*)", path).groups()
    return directory or "./", name.rpartition(".")[0] if "." in name else name


def image_output(path: str, metric_index: int | None = None) -> str:
    """directory/output_<stem>_clustered, with _<index>.png where a metric's index is given. Without a directory: ./"""
    directory, stem = _stem(path)
    base = f"{directory}output_{stem}_clustered"
    return base if metric_index is None else f"{base}_{metric_index}.png"


def video_output(path: str, extension: str = ".mp4") -> str:
    directory, stem = _stem(path)
    return f"{directory}output_{stem}_clustered{extension}"


def timing_output(kind: str, height: int, width: int, directory: str = "results") -> str:
    """results/<kind>_<shorter side>.csv; kind is baseline, video or calibration."""
    return f"{directory}/{kind}_{min(height, width)}.csv"
