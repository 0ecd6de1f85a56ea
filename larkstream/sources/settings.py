"""Control plane in plain Python: device settings and which file they come from."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path


@dataclass
class DeviceSettings:
    mic: str = ""
    loopback: bool = False
    loopback_device: str = "default-output"

    @classmethod
    def load(cls, path: str) -> DeviceSettings:
        """Fields of a JSON object; those it lacks have their defaults, unknown ones are ignored."""
        held = json.loads(Path(path).read_text())
        found = cls(**{k: held[k] for k in asdict(cls()) if k in held})
        wrong = [k for k, kind in (("mic", str), ("loopback", bool), ("loopback_device", str)) if type(getattr(found, k)) is not kind]
        if wrong:
            raise ValueError(f"{path}: wrong type of {', '.join(wrong)}")
        return found

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


def settings_path(argument: str | None, env: str = "LARKSTREAM_CONFIG", default: str = "larkstream.json") -> str | None:
    """The argument, else the environment's, else the file in the working folder if it is there; empty texts are none."""
    for told in (argument, os.environ.get(env)):
        if told is not None and told.strip():
            return told.strip()
    return default if argument is None and Path(default).exists() else None


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines; comments and empty lines are skipped, one pair of quotes is taken off."""
    out = {}
    for line in Path(path).read_text().splitlines():
        name, found, value = line.strip().removeprefix("export ").partition("=")
        if found and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def environment(path: str, beside_program: bool, given: dict[str, str] | None = None) -> dict[str, str]:
    """The environment with a KEY=value file: one beside the program overrides what is set, any other only adds to it."""
    given = dict(os.environ if given is None else given)
    held = env_file(path) if Path(path).is_file() else {}
    return given | held if beside_program else held | given


def device_settings(saved: DeviceSettings | None, mic: str | None = None, loopback: bool = False, no_loopback: bool = False, loopback_device: str | None = None) -> DeviceSettings:
    """Settings by rank: told ones (even empty), then saved ones that are not empty, then defaults; no_loopback beats loopback."""
    saved = saved or DeviceSettings()
    return DeviceSettings(
        mic if mic is not None else saved.mic or "default",
        (loopback or saved.loopback) and not no_loopback,
        loopback_device if loopback_device is not None else saved.loopback_device or "default-output",
    )


def model_fault(path: str) -> str | None:
    """What is wrong with a model folder: empty, missing, no folder, no am folder or no model in it."""
    p = Path(path.strip()) if path.strip() else None
    if p is None:
        return "empty"
    if not p.exists():
        return "missing"
    if not p.is_dir():
        return "no folder"
    if not (p / "am").is_dir():
        return "no am folder"
    return None if (p / "am" / "final.mdl").is_file() else "no model"
