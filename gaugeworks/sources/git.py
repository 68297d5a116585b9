"""Files of a repository at a commit, through the git command on the driver.

Contents come to the driver file by file and go out as a table in batches, so this is
for repositories; large corpora are scanned (`files.scan`) or read as snapshots.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import files as S


def _git(repo: str, *args: str, stdin: bytes | None = None, ok: tuple[int, ...] = (0,)) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=stdin, capture_output=True)
    if done.returncode not in ok:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def ignored_by_git(repo: str, paths: list[str]) -> list[str]:
    """Those of the paths that the repository's ignore files name."""
    if not paths:
        return []
    out = _git(repo, "check-ignore", "--no-index", "-z", "--stdin", stdin="\0".join(paths).encode(), ok=(0, 1))
    return [p.decode() for p in out.split(b"\0") if p]


def without_ignored(spark: SparkSession, files: DataFrame, repo: str) -> DataFrame:
    """`files` (path, ...) but those that git ignores; only paths come to the driver."""
    gone = ignored_by_git(repo, [r["path"] for r in files.select("path").collect()])
    return files.join(spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_anti")


def at_ref(spark: SparkSession, repo: str, ref: str, ignore: list[str] = S.IGNORED) -> DataFrame:
    """path, content, language, snapshot of the source files of a commit."""
    listed = _git(repo, "ls-tree", "-r", "-z", "--name-only", ref).split(b"\0")
    paths = spark.createDataFrame([(p.decode(errors="replace"),) for p in listed if p], "path string")
    kept = [r["path"] for r in paths.where(S.scanned(F.col("path"), list(ignore))).collect()]
    rows = [(p, _git(repo, "show", f"{ref}:{p}").decode(errors="replace"), ref) for p in sorted(kept)]
    return spark.createDataFrame(rows, "path string, content string, snapshot string").withColumn("language", X.language(F.col("path")))


def commits(repo: str, n: int) -> list[str]:
    """The last n commits, the oldest first."""
    return _git(repo, "log", f"-n{n}", "--reverse", "--format=%H").decode().split()


def diff_lines(spark: SparkSession, repo: str, base: str, head: str) -> DataFrame:
    """diff, no, line of the unified diff without context, for `snapshots.diff_ranges`."""
    out = _git(repo, "diff", "--unified=0", base, head).decode(errors="replace").split("\n")
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(out)], "diff int, no int, line string")
