"""Local copies of filings."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path


def filing_path(base: str | Path, cik: str, accession: str, document: str) -> Path:
    """base/cik/accession/document, never outside base."""
    for name in (cik, accession, document):
        if not name or name != name.strip() or "/" in name or "\\" in name or ".." in name:
            raise ValueError(f"unsafe name in a filing path: {name!r}")
    base = Path(base).resolve()
    path = (base / cik / accession / document).resolve()
    if not path.is_relative_to(base):
        raise ValueError("filing path leaves its folder")
    return path


def download(base: str | Path, cik: str, accession: str, document: str, fetch: Callable[[], bytes]) -> tuple[Path, bool]:
    """(path, reused): what is there is used again."""
    path = filing_path(base, cik, accession, document)
    if path.is_file() and path.stat().st_size:
        return path, True
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_bytes(fetch())
    part.replace(path)
    return path, False


def remove_filings(base: str | Path, paths: list[str]) -> list[str]:
    """Delete files inside base and the folders they leave empty; problems are returned, not raised."""
    base, problems = Path(base).resolve(), []
    for name in dict.fromkeys(paths):
        path = Path(name).resolve()
        if not path.is_relative_to(base) or path == base:
            problems.append(f"{name}: outside {base}")
            continue
        try:
            shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
            parent = path.parent
            while parent != base and parent.is_dir() and not any(parent.iterdir()):
                parent.rmdir()
                parent = parent.parent
        except OSError as e:
            problems.append(f"{name}: {e}")
    return problems
