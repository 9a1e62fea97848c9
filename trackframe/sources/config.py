"""Run configuration, calibration, model manifests and source names; checked on the driver."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import Any

#: The known keys and their types.
KEYS = {
    "camera_width": int,
    "camera_height": int,
    "camera_fps": float,
    "camera_backend": str,
    "reconnect_attempts": int,
    "reconnect_delay_ms": int,
    "input_size": int,
    "conf": float,
    "iou": float,
    "classes": str,
    "profile": str,
    "detect_every": int,
    "cpu": bool,
    "enhance": bool,
    "view": str,
    "stabilize": bool,
    "no_cmc": bool,
    "no_appearance": bool,
    "calibration": str,
    "session_log": str,
    "record": str,
    "headless": bool,
    "max_frames": int,
}
#: The words that some keys allow, and the keys that aren't negative.
WORDS = {
    "camera_backend": {"auto", "dshow", "msmf"},
    "profile": {"quality", "balanced", "speed"},
    "view": {"normal", "clarity", "lowlight", "edges", "pseudo-thermal"},
}
NOT_NEGATIVE = {"detect_every", "reconnect_attempts", "reconnect_delay_ms"}
#: The presets.
PRESETS = {
    "amd-balanced": {
        "camera_width": 1920,
        "camera_height": 1080,
        "camera_fps": 30,
        "camera_backend": "dshow",
        "reconnect_attempts": 4,
        "reconnect_delay_ms": 250,
        "profile": "balanced",
        "detect_every": 2,
        "enhance": False,
        "view": "normal",
        "stabilize": False,
        "no_cmc": False,
        "no_appearance": False,
    },
    "amd-quality": {
        "camera_width": 1920,
        "camera_height": 1080,
        "camera_fps": 30,
        "camera_backend": "dshow",
        "reconnect_attempts": 4,
        "reconnect_delay_ms": 250,
        "profile": "quality",
        "detect_every": 1,
        "enhance": False,
        "view": "normal",
        "stabilize": False,
        "no_cmc": False,
        "no_appearance": False,
    },
    "cpu-safe": {
        "camera_width": 1280,
        "camera_height": 720,
        "camera_fps": 30,
        "camera_backend": "dshow",
        "reconnect_attempts": 3,
        "reconnect_delay_ms": 350,
        "profile": "speed",
        "detect_every": 3,
        "cpu": True,
        "enhance": False,
        "view": "normal",
        "stabilize": False,
        "no_cmc": False,
        "no_appearance": False,
    },
}


def check_config(data: Any) -> dict[str, Any]:
    """The configuration itself, if all keys are known and all values of their type and range; else ValueError."""
    if not isinstance(data, dict):
        raise ValueError("a configuration is a JSON object")
    if unknown := sorted(set(data) - set(KEYS)):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    for key, value in data.items():
        wanted = (int, float) if KEYS[key] is float else KEYS[key]
        if isinstance(value, bool) is not (KEYS[key] is bool) or not isinstance(value, wanted):
            raise ValueError(f"{key} has the wrong type: {type(value).__name__}")
        if key in WORDS and value not in WORDS[key]:
            raise ValueError(f"{key} is none of: {', '.join(sorted(WORDS[key]))}")
        if key in NOT_NEGATIVE and value < 0:
            raise ValueError(f"{key} is negative")
    return dict(data)


def load_config(path: str) -> dict[str, Any]:
    return check_config(json.loads(Path(path).read_text(encoding="utf-8")))


def parse_source(text: str) -> int | str:
    """Digits are a camera's number, all else is a path."""
    return int(text) if text.isdigit() else text


@dataclass
class Calibration:
    width: int
    height: int
    hfov_deg: float
    vfov_deg: float | None = None
    name: str = "camera"

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0:
            raise ValueError("width and height are above 0")
        if not 1.0 <= self.hfov_deg < 179.0:
            raise ValueError("hfov_deg is within 1 and 179")
        if self.vfov_deg is None:
            self.vfov_deg = math.degrees(2 * math.atan(math.tan(math.radians(self.hfov_deg) / 2) * self.height / self.width))
        if not 1.0 <= self.vfov_deg < 179.0:
            raise ValueError("vfov_deg is within 1 and 179")

    @classmethod
    def load(cls, path: str) -> Calibration:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")


@dataclass
class Manifest:
    name: str
    sha256: str
    input_size: int = 640
    source: str = ""
    format: str = "onnx"
    notes: str = ""

    @classmethod
    def load(cls, path: str) -> Manifest:
        return cls(**json.loads(Path(path).read_text(encoding="utf-8")))

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    def verify(self, model: str) -> bool:
        with open(model, "rb") as f:
            actual = hashlib.file_digest(f, "sha256").hexdigest()
        return actual == self.sha256.strip().lower().removeprefix("sha256:")
