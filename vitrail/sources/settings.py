"""Settings from files of key=value lines. Unknown keys and values that can't be read are ignored; numbers are kept within their range."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class IndexingSettings:
    batch_size: int = 16
    workers: int = 2


@dataclass(frozen=True)
class FaceSettings:
    enabled: bool = False
    batch_size: int = 32
    min_similarity: float = 0.45


@dataclass(frozen=True)
class DetectorSettings:
    score_threshold: float = 0.6
    nms_threshold: float = 0.3
    top_k: int = 5000


# Least and greatest of each number.
RANGES = {"batch_size": (1, 256), "workers": (1, 8), "min_similarity": (-1.0, 1.0), "score_threshold": (0.0, 1.0), "nms_threshold": (0.0, 1.0), "top_k": (1, 100_000)}


def parse(text: str, defaults):
    """``defaults`` with what the text sets."""
    out = {}
    names = {f.name: f for f in fields(defaults)}
    for line in text.splitlines():
        key, found, value = line.partition("=")
        key, value = key.strip(), value.strip()
        if not found or key not in names or key.startswith("#"):
            continue
        kind = type(getattr(defaults, key))
        try:
            parsed = value.lower() in ("1", "true", "yes", "on") if kind is bool else kind(value)
        except ValueError:
            continue
        if key in RANGES and parsed == parsed:
            parsed = min(max(parsed, RANGES[key][0]), RANGES[key][1])
        out[key] = parsed
    return replace(defaults, **out)


def load(path: str, defaults):
    """The settings of a file; the defaults if there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read(), defaults)
    except FileNotFoundError:
        return defaults


def render(settings) -> str:
    return "".join(f"{f.name}={str(v).lower() if isinstance(v := getattr(settings, f.name), bool) else v}\n" for f in fields(settings))
