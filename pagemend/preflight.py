"""What a run may read and write, settled before any work.

Each path that a run names has a use (read or written). A path is in one of a few states on
this machine; a table says which states a use can't work with. Then written paths are
grouped by the file that they mean: one that is the source, or is named twice, is refused.
"""

from __future__ import annotations

import enum
import os
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


class State(enum.Enum):
    FILE = "file"
    SHUT = "a file without the permission that is needed"
    FOLDER = "a folder"
    FREE = "nothing yet, in a folder that takes new files"
    CLOSED = "nothing yet, in a folder that takes no new files"
    NOWHERE = "nothing, and the folder is missing too"


#: What is said of a state that the use can't work with.
UNREADABLE = {
    State.SHUT: "this user has no permission to read it",
    State.FOLDER: "a file is needed here, this is a folder",
    State.FREE: "there is no such file",
    State.CLOSED: "there is no such file",
    State.NOWHERE: "there is no such file",
}
UNWRITABLE = {
    State.SHUT: "this user has no permission to write it",
    State.FOLDER: "a file is needed here, this is a folder",
    State.CLOSED: "its folder doesn't take new files from this user",
    State.NOWHERE: "its folder is missing",
}


def state_of(path: str, need: int) -> State:
    """need: os.R_OK or os.W_OK."""
    p = Path(path)
    if p.is_dir():
        return State.FOLDER
    if p.exists():
        return State.FILE if os.access(p, need) else State.SHUT
    home = p.absolute().parent
    if not home.is_dir():
        return State.NOWHERE
    return State.FREE if os.access(home, os.W_OK) else State.CLOSED


def identity(path: str) -> object:
    """Equal for all spellings of one file, by its place on disk where it exists."""
    try:
        at = os.stat(path)
    except OSError:
        return str(Path(path).resolve())
    return at.st_dev, at.st_ino


@dataclass(frozen=True)
class Use:
    option: str
    path: str | None


def complaints(reads: Iterable[Use], writes: Iterable[Use], source: str | None, replace: bool) -> list[str]:
    """One sentence for each thing wrong. ``replace`` allows files that exist, but never the source."""
    out = []
    for use in reads:
        if use.path and (why := UNREADABLE.get(state_of(use.path, os.R_OK))):
            out.append(f"{use.option} {use.path!r}: {why}")
    by_file: dict[object, list[Use]] = defaultdict(list)
    for use in writes:
        if not use.path:
            continue
        state = state_of(use.path, os.W_OK)
        if why := UNWRITABLE.get(state):
            out.append(f"{use.option} {use.path!r}: {why}")
            continue
        by_file[identity(use.path)].append(use)
        if state is State.FILE and not replace and not (source and identity(use.path) == identity(source)):
            out.append(f"{use.option} {use.path!r}: the file exists, and --force wasn't given")
    for file, uses in by_file.items():
        options = ", ".join(u.option for u in uses)
        if source and file == identity(source):
            out.append(f"{options}: would replace the source {source!r}, which is never done")
        elif len(uses) > 1:
            out.append(f"{options}: all mean the one file {uses[0].path!r}")
    return out
