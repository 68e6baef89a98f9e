"""Manifests as small frames: prefixes of imports, declared dependencies, environment variables, proxy rewrites, members.

All read files(repo, file, text); each manifest is parsed on its own, in Arrow batches.
"""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(files: DataFrame, schema: str, columns: list[str], work: Callable[[str, str], list[tuple]], pattern: str) -> DataFrame:
    """repo and what work(file, text) gives, for files whose name matches; a manifest that doesn't parse gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, file, text in zip(pdf["repo"], pdf["file"], pdf["text"]):
                try:
                    out += [(repo, *r) for r in work(file, text or "")]
                except (ValueError, ET.ParseError, AttributeError, TypeError):  # a manifest of another shape
                    continue
            yield pd.DataFrame(out, columns=["repo", *columns])

    named = files.where(F.regexp_extract("file", "([^/]*)$", 1).rlike(pattern))
    return named.select("repo", "file", "text").mapInPandas(run, "repo string, " + schema)


def _without_comments(text: str) -> str:
    """JSON as editors write it: // and /* */ comments and trailing commas taken out, strings kept."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r",(\s*[}\]])", r"\1", text)


def _prefixes(file: str, text: str) -> list[tuple]:
    here, name = posixpath.dirname(file), posixpath.basename(file)
    at = lambda d: posixpath.normpath(posixpath.join(here, d)).lstrip(".").lstrip("/")
    if name == "go.mod":
        return [("go", m[1], at(""))] if (m := re.search(r"(?m)^module\s+(\S+)", text)) else []
    if name == "tsconfig.json" or name == "jsconfig.json":
        o = json.loads(_without_comments(text)).get("compilerOptions", {})
        base = o.get("baseUrl", ".")
        return [("typescript", k.removesuffix("/*"), at(posixpath.join(base, v[0].removesuffix("/*")))) for k, v in o.get("paths", {}).items() if v]
    if name == "composer.json":
        o = json.loads(text)
        found = {**o.get("autoload", {}).get("psr-4", {}), **o.get("autoload-dev", {}).get("psr-4", {})}
        return [("php", k.rstrip("\\"), at(v[0] if isinstance(v, list) else v)) for k, v in found.items()]
    if name == "Cargo.toml":
        package = tomllib.loads(text).get("package", {})
        return [("rust", package["name"].replace("-", "_"), at("src"))] if "name" in package else []
    if name.endswith(".csproj"):
        root = ET.fromstring(text)
        space = next((e.text for e in root.iter() if e.tag.endswith("RootNamespace")), None)
        return [("csharp", space or name.removesuffix(".csproj"), at(""))]
    if name == "Package.swift":
        return [("swift", m[1], at(p[1] if (p := re.search(r'path:\s*"([^"]+)"', m[0])) else f"Sources/{m[1]}")) for m in re.finditer(r'\.(?:executableTarget|target)\(\s*name:\s*"([^"]+)"[^()]*', text)]
    if name in ("settings.gradle", "settings.gradle.kts"):
        return [("java", m[1].replace(":", "/").strip("/"), at(m[1].replace(":", "/").strip("/"))) for line in re.findall(r"include\b[^\n]*(?:\n\s+['\"][^\n]*)*", text) for m in re.finditer(r"['\"]([^'\"]+)['\"]", line)]
    if name in ("build.sbt", "build.sc"):
        return [("scala", m[1], at(m[2])) for m in re.finditer(r"lazy\s+val\s+(\w+)[^\n]*?file\(\"([^\"]+)\"\)", text)] + [("scala", m[1], at(m[1])) for m in re.finditer(r"object\s+(\w+)\s+extends\s+\w*(?:ScalaModule|SbtModule)", text)]
    if name == "compile_commands.json":
        dirs = {m for c in json.loads(text) for m in re.findall(r"(?:-I|-isystem)\s*(\S+)", c.get("command") or " ".join(c.get("arguments", [])))}
        return [("cpp", d, at(d)) for d in sorted(dirs)]
    return []


def prefixes(files: DataFrame) -> DataFrame:
    """(repo, lang, prefix, dir): what the beginning of an import stands for: go.mod, tsconfig paths, PSR-4, Cargo, csproj, SwiftPM, Gradle, sbt and Mill, compile_commands."""
    pattern = r"^(?:go\.mod|[tj]sconfig\.json|composer\.json|Cargo\.toml|.*\.csproj|Package\.swift|settings\.gradle(?:\.kts)?|build\.sbt|build\.sc|compile_commands\.json)$"
    return _rows(files, "lang string, prefix string, dir string", ["lang", "prefix", "dir"], _prefixes, pattern)


def _dependencies(file: str, text: str) -> list[tuple]:
    name = posixpath.basename(file)
    if name == "package.json":
        o = json.loads(text)
        return [(file, "npm", k, str(v)) for part in ("dependencies", "devDependencies") for k, v in (o.get(part) or {}).items()]
    text = re.sub(r"//[^\n]*", "", text)
    blocks = re.findall(r"(?ms)^require\s*\((.*?)\)", text) + re.findall(r"(?m)^require\s+([^(\n]+)$", text)
    return [(file, "go", *line.split()[:2]) for b in blocks for line in b.split("\n") if len(line.split()) >= 2]


def dependencies(files: DataFrame) -> DataFrame:
    """(repo, file, ecosystem, package, version): go.mod requires, package.json dependencies."""
    return _rows(files, "file string, ecosystem string, package string, version string", ["file", "ecosystem", "package", "version"], _dependencies, r"^(?:go\.mod|package\.json)$")


#: Files that define environment variables, the first that has one counts. Fixed values.
ENV_FILES = [".env.example", ".env.sample", ".env.template", ".env.local", ".env.development", ".env.production", ".env", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]


def _env(file: str, text: str) -> list[tuple]:
    name = posixpath.basename(file)
    pattern = r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$" if name.startswith(".env") else r"^\s*(?:-\s*)?[\"']?([A-Z][A-Z0-9_]*)\s*(?:=|:\s)\s*(.*?)\s*$"
    hits = [m for m in (re.match(pattern, line) for line in text.split("\n")) if m]
    return [(ENV_FILES.index(name), i, m[1], m[2].strip("\"'")) for i, m in enumerate(hits) if m[2]]


def env(files: DataFrame) -> DataFrame:
    """(repo, name, value): the first definition of each variable, by ENV_FILES and line."""
    found = _rows(files, "rank int, line int, name string, value string", ["rank", "line", "name", "value"], _env, "^(?:" + "|".join(re.escape(f) for f in ENV_FILES) + ")$")
    return found.groupBy("repo", "name").agg(F.min_by("value", F.struct("rank", "line", "value")).alias("value"))


def _proxy(file: str, text: str) -> list[tuple]:
    name = posixpath.basename(file)
    if name == "vercel.json":
        trim = lambda p: re.sub(r"/(?::\w+\*?|\(\.\*\)|\$\d)$", "", re.sub(r"^https?://[^/]+", "", p)) or "/"
        return [(trim(r["source"]), trim(r["destination"])) for r in json.loads(text).get("rewrites", [])]
    if name.startswith("Caddyfile"):
        return [(m[1].rstrip("*").rstrip("/") or "/", "/") for m in re.finditer(r"handle_path\s+(\S+)\s*\{[^}]*reverse_proxy", text)]
    out = []
    for m in re.finditer(r"location\s+(?:\^~\s+|=\s+)?(/\S*)\s*\{([^}]*)\}", text):
        if p := re.search(r"proxy_pass\s+https?://[^/;\s]+(/[^;\s]*)?\s*;", m[2]):
            out.append((m[1], p[1] if p[1] else m[1]))  # without a path nothing is replaced
    return out


def proxy_rewrites(files: DataFrame) -> DataFrame:
    """(repo, consumer_prefix, provider_prefix): nginx location with proxy_pass, Caddy handle_path, Vercel rewrites."""
    return _rows(files, "consumer_prefix string, provider_prefix string", ["consumer_prefix", "provider_prefix"], _proxy, r"^(?:.*\.conf|nginx.*|Caddyfile.*|vercel\.json)$")


def _names(file: str, text: str) -> list[tuple]:
    name = posixpath.basename(file)
    if name == "go.mod":
        return [(m[1],)] if (m := re.search(r"(?m)^module\s+(\S+)", text)) else []
    if name in ("package.json", "composer.json"):
        return [(n,)] if (n := json.loads(text).get("name")) else []
    o = tomllib.loads(text)
    n = o.get("package", o.get("project", o.get("tool", {}).get("poetry", {}))).get("name")
    return [(n,), (n.replace("-", "_"),)] if n and "-" in n else [(n,)] if n else []


def canonical_names(files: DataFrame) -> DataFrame:
    """(repo, canonical): the names under which others import a repository: its own, and those its manifests state."""
    found = _rows(files, "canonical string", ["canonical"], _names, r"^(?:go\.mod|package\.json|composer\.json|Cargo\.toml|pyproject\.toml)$")
    return files.select("repo", F.col("repo").alias("canonical")).unionByName(found).distinct()


def bulk_members(file: str, text: str) -> list[str]:
    """The globs of members that a workspace manifest lists: Cargo, pnpm, npm."""
    name = posixpath.basename(file)
    if name == "Cargo.toml":
        return list(tomllib.loads(text).get("workspace", {}).get("members", []))
    if name == "package.json":
        w = json.loads(text).get("workspaces", [])
        return list(w.get("packages", []) if isinstance(w, dict) else w)
    block = re.search(r"(?m)^packages:\s*\n((?:\s+-[^\n]*\n?)+)", text)
    return re.findall(r"-\s*['\"]?([^'\"\n]+?)['\"]?\s*(?:\n|$)", block[1]) if block else []
