"""Git histories as frames. One task reads one repository, through the git command, line by line."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are handed on at once.
BATCH = 50_000


def _git(repo: str, *args: str) -> Iterator[str]:
    """The records of a git command's output, which end in zero bytes or line breaks as the arguments say."""
    with subprocess.Popen(["git", "-C", repo, "-c", "core.quotepath=off", *args], stdout=subprocess.PIPE, text=True, errors="replace") as p:
        yield from p.stdout
    if p.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}")


def _each(repos: DataFrame, schema: str, columns: list[str], work) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for repo, path in zip(pdf["repo"], pdf["path"]):
                rows = []
                for r in work(path):
                    rows.append((repo, *r))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                yield pd.DataFrame(rows, columns=columns)

    n = repos.sparkSession.sparkContext.defaultParallelism
    return repos.select("repo", "path").repartition(n, "repo").mapInPandas(run, schema)


def repositories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(repo, path) of repositories that all executors can reach."""
    return spark.createDataFrame([(os.path.basename(p.rstrip("/")), p) for p in paths], "repo string, path string")


def commits(repos: DataFrame, merges: bool = False, renames: bool = False) -> DataFrame:
    """(repo, sha, author, ts, file): a row for each file of each commit; author is the address, ts seconds."""

    def work(path: str):
        sha = author = ts = None
        for line in _git(path, "log", "--name-only", "--format=%x01%H%x1f%ae%x1f%at", *([] if merges else ["--no-merges"]), *([] if renames else ["--no-renames"])):
            line = line.rstrip("\n")
            if line.startswith("\x01"):
                sha, author, ts = line[1:].split("\x1f")
            elif line:
                yield sha, author, int(ts), line

    return _each(repos, "repo string, sha string, author string, ts long, file string", ["repo", "sha", "author", "ts", "file"], work)


def messages(repos: DataFrame) -> DataFrame:
    """(repo, sha, author, ts, subject, body, files) of every commit."""

    def work(path: str):
        head, body, files, inside = None, [], [], False
        for line in _git(path, "log", "--name-only", "--no-renames", "--format=%x01%H%x1f%ae%x1f%at%x1f%s%n%b%x02"):
            line = line.rstrip("\n")
            if line.startswith("\x01"):
                if head:
                    yield (*head, "\n".join(body).strip(), files)
                sha, author, ts, subject = line[1:].split("\x1f", 3)
                head, body, files, inside = (sha, author, int(ts), subject), [], [], True
            elif inside:
                inside = not line.endswith("\x02")
                body.append(line.rstrip("\x02"))
            elif line:
                files.append(line)
        if head:
            yield (*head, "\n".join(body).strip(), files)

    return _each(repos, "repo string, sha string, author string, ts long, subject string, body string, files array<string>", ["repo", "sha", "author", "ts", "subject", "body", "files"], work)


def refs_of(spec: str) -> tuple[str, str]:
    """The two revisions of a..b, a...b (still two-sided here) or one revision, which is compared with HEAD."""
    for sep in ("...", ".."):
        if sep in spec:
            a, b = spec.split(sep, 1)
            return a or "HEAD", b or "HEAD"
    return spec, "HEAD"


def changed_files(repos: DataFrame, spec: str) -> DataFrame:
    """(repo, status, file): files added, modified or deleted between two revisions."""
    a, b = refs_of(spec)

    def work(path: str):
        base = next(_git(path, "merge-base", a, b)).strip() if "..." in spec else a
        for line in _git(path, "diff", "--name-status", "--no-renames", "--diff-filter=AMD", base, b):
            status, file = line.rstrip("\n").split("\t", 1)
            yield status[0], file

    return _each(repos, "repo string, status string, file string", ["repo", "status", "file"], work)


def snapshot(repos: DataFrame, revision: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(repo, file, text): the files of a revision, with these extensions if any are given."""

    def work(path: str):
        for line in _git(path, "ls-tree", "-r", "--name-only", revision):
            file = line.rstrip("\n")
            if not extensions or file.rsplit(".", 1)[-1].lower() in extensions:
                got = subprocess.run(["git", "-C", path, "show", f"{revision}:{file}"], capture_output=True, check=False)
                if got.returncode == 0 and b"\0" not in got.stdout[:8192]:
                    yield file, got.stdout.decode("utf-8", "replace")

    return _each(repos, "repo string, file string, text string", ["repo", "file", "text"], work)


def members(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path): the folders right below root that are repositories."""
    found = [os.path.join(root, d) for d in sorted(os.listdir(root)) if os.path.exists(os.path.join(root, d, ".git"))]
    return repositories(spark, found) if found else spark.createDataFrame([], "repo string, path string")


def line_counts(files: DataFrame) -> DataFrame:
    """(repo, file, lines) of snapshot rows: what hotspots weigh churn by."""
    return files.select("repo", "file", F.size(F.split(F.regexp_replace("text", "\n$", ""), "\n")).cast("long").alias("lines"))
