"""What git knows about a work tree; runs on the driver."""

from __future__ import annotations

import subprocess


def _git(root: str, *args: str) -> str | None:
    try:
        r = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=600)
    except OSError:
        return None
    return r.stdout.strip() if r.returncode == 0 else None


def head_commit(root: str) -> str | None:
    return _git(root, "rev-parse", "HEAD")


def current_branch(root: str) -> str | None:
    """Name of the branch; ``detached`` without one, None outside a work tree."""
    name = _git(root, "rev-parse", "--abbrev-ref", "HEAD")
    return "detached" if name == "HEAD" else name


def tracked_files(root: str) -> set[str] | None:
    """Paths below ``root`` that git tracks or would track; None if git cannot say."""
    out = _git(root, "ls-files", "--cached", "--others", "--exclude-standard")
    return set(out.split("\n")) if out else None


def changed_files(root: str, since: str) -> list[str] | None:
    """Paths changed since a commit, deleted ones too; None if git cannot say."""
    out = _git(root, "diff", "--name-only", "--relative", since, "HEAD")
    return None if out is None else [x for x in out.split("\n") if x]


def merge_base(root: str, a: str, b: str) -> str | None:
    return _git(root, "merge-base", a, b)


def is_ancestor(root: str, a: str, b: str) -> bool:
    return _git(root, "merge-base", "--is-ancestor", a, b) is not None


def commit_time(root: str, commit: str) -> int:
    out = _git(root, "show", "-s", "--format=%ct", commit)
    return int(out) if out else 0


def nearest_parent(root: str, head: str, heads: dict[str, str]) -> tuple[str, str] | None:
    """(branch, merge base) of the indexed branch whose merge base with ``head`` is newest; branches git cannot compare are skipped."""
    best = None
    for branch, commit in sorted(heads.items()):
        base = merge_base(root, commit, head)
        if base:
            rank = (commit_time(root, base), branch)
            best = max(best or (rank, branch, base), (rank, branch, base))
    return best and (best[1], best[2])
