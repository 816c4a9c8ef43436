"""Which files an estimate is about: globs, directories, and a file's revisions in git."""

from __future__ import annotations

import glob
import subprocess
from pathlib import Path


def matching(*patterns: str) -> list[str]:
    """The files of each pattern in turn; a file that two patterns match comes twice."""
    return [p for pattern in patterns for p in sorted(glob.glob(pattern))]


def parquet_files(directory: str | Path) -> list[Path]:
    """The Parquet files of a directory by name."""
    return sorted(Path(directory).glob("*.parquet"))


def recursive(patterns: list[str], root: str | Path = ".") -> list[Path]:
    """Patterns with a star are looked for below root, others are paths."""
    return [p for x in patterns for p in (sorted(Path(root).rglob(x)) if "*" in x else [Path(x)])]


def _git(top: Path, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-C", str(top), *args], check=True, capture_output=True).stdout
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"git {' '.join(args)}: {e.stderr.decode(errors='replace').strip()}") from e


def revisions(file: str | Path, from_rev: str | None = None, until_rev: str = "HEAD") -> list[tuple[str, str]]:
    """(revision, path then) of a file's revisions after from_rev up to until_rev, newest first, renames followed, deletions left out."""
    file = Path(file).resolve()
    top = Path(_git(file.parent, "rev-parse", "--show-toplevel").decode().strip()).resolve()
    span = f"{from_rev}..{until_rev}" if from_rev else until_rev
    out, rev = [], None
    for line in _git(top, "log", "--format=@%h", "--name-only", "--follow", "--diff-filter=d", span, "--", str(file.relative_to(top))).decode().splitlines():
        if line.startswith("@"):
            rev = line[1:]
        elif line and rev:
            out.append((rev, line))
            rev = None
    return out


def checkout_revisions(file: str | Path, target: str | Path, from_rev: str | None = None, until_rev: str = "HEAD") -> list[Path]:
    """Each revision as target/stem-rev.suffix; the work tree is not touched. No revision gives no file."""
    file, target = Path(file).resolve(), Path(target)
    target.mkdir(parents=True, exist_ok=True)
    top = Path(_git(file.parent, "rev-parse", "--show-toplevel").decode().strip())
    out = []
    for rev, name in revisions(file, from_rev, until_rev):
        path = target / f"{file.stem}-{rev}{file.suffix}"
        path.write_bytes(_git(top, "show", f"{rev}:{name}"))
        out.append(path)
    return out
