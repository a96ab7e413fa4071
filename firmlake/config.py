"""Where tables live: an explicit folder, else $FIRMLAKE_DIR, else the user's cache folder."""

from __future__ import annotations

import os


def data_root(override: str | None = None) -> str:
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return override or os.environ.get("FIRMLAKE_DIR") or os.path.join(base, "firmlake")


def corpus_path(override: str | None = None) -> str:
    return f"{data_root(override)}/corpus"


def memo_path(override: str | None = None) -> str:
    return f"{data_root(override)}/recovered"
