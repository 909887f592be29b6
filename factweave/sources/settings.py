"""Settings from an env file and the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path


def read_env_file(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines, ``export`` and matching quotes are taken off."""
    out: dict[str, str] = {}
    path = Path(path)
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and not name.lstrip().startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[name.strip()] = value[1:-1] if quoted else value
    return out


def string_list(value: str) -> list[str]:
    """A JSON list, or names parted by commas."""
    if value.lstrip().startswith("["):
        found = json.loads(value)
        if not all(isinstance(x, str) for x in found):
            raise ValueError("expected a list of strings")
    else:
        found = value.split(",")
    return [x.strip() for x in found if x.strip()]


@dataclass(frozen=True)
class Settings:
    user_agent: str = ""
    warehouse: str = "warehouse"
    filings_dir: str = "filings"
    forms: tuple[str, ...] = ("10-K", "10-Q")
    models: tuple[str, ...] = field(default=())
    model: str = ""
    api_key: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        if self.model and self.model not in self.models:
            raise ValueError(f"model {self.model!r} is not among the allowed ones")


def load_settings(env_file: str | Path = ".env", environ: dict[str, str] | None = None) -> Settings:
    """The environment wins over the file."""
    told = read_env_file(env_file) | dict(os.environ if environ is None else environ)
    names = {"user_agent": "SEC_USER_AGENT", "warehouse": "FACTS_WAREHOUSE", "filings_dir": "FILINGS_DIR", "model": "MODEL", "api_key": "MODEL_API_KEY"}
    values: dict = {k: told[v] for k, v in names.items() if v in told}
    for k, v in (("forms", "REPORT_FORMS"), ("models", "ALLOWED_MODELS")):
        if v in told:
            values[k] = tuple(string_list(told[v]))
    return Settings(**values)
