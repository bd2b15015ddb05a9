"""Checkouts of public repositories. Runs on the driver, before any Spark job; a checkout must land where executors can read it."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from pathlib import Path

from spanseek import fixed_values as fv

SLOWEST_CLONE = 20 * 60  # seconds


def parse_link(link: str) -> tuple[str, str]:
    """Owner and name out of a repository link; ValueError for anything else."""
    parts = re.match(fv.GITHUB_LINK, link.strip())
    if parts is None:
        raise ValueError(f"{link!r} does not name a GitHub repository")
    return parts[1], parts[2]


def head_commit(checkout: str | Path) -> str:
    """Commit that a folder has checked out, "unknown" for a folder without one."""
    asked = subprocess.run(["git", "rev-parse", "--verify", "--quiet", "HEAD"], cwd=checkout, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True,
                           check=False)
    return asked.stdout.strip() or "unknown"


def fetch(owner: str, name: str, folder: str | Path, url: str | None = None) -> tuple[Path, str]:
    """The present state of a repository and its commit.

    It is cloned into a folder of its own and takes the old checkout's place when it is complete, so a failed or interrupted clone leaves the old one
    as it was, and a reader never sees half of each. The caller's environment holds (home, proxies, certificates), but git asks for no password.
    """
    home = Path(folder).absolute() / owner
    home.mkdir(parents=True, exist_ok=True)
    place = home / name
    with tempfile.TemporaryDirectory(dir=home, prefix=f".{name}-") as work:
        made = Path(work, "new")
        try:
            subprocess.run(["git", "clone", "--quiet", "--depth=1", "--single-branch", "--", url or f"https://github.com/{owner}/{name}", str(made)],
                           env={**os.environ, "GIT_TERMINAL_PROMPT": "0"}, check=True, timeout=SLOWEST_CLONE, capture_output=True, text=True)
        except subprocess.CalledProcessError as error:
            raise RuntimeError(f"{owner}/{name} could not be cloned:\n{error.stderr}") from error
        if place.exists():
            place.rename(Path(work, "old"))
        made.rename(place)
    return place, head_commit(place)
