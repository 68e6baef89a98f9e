"""Text mining over lines(file, line, text): grep, pattern scans, markers, contracts. Rules are data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.names import normalize_path


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, word: bool = False, fixed: bool = False, path: str | None = None) -> DataFrame:
    """Lines that match."""
    p = "\\Q" + pattern + "\\E" if fixed else pattern
    p = f"\\b(?:{p})\\b" if word else p
    found = lines.where(F.col("text").rlike(("(?i)" if ignore_case else "") + p))
    return found.where(F.contains("file", F.lit(path))) if path else found


def grouped(hits: DataFrame, by: str, samples: int = 3) -> DataFrame:
    """(by, n, first): hits counted, with their first lines. The samples are least rows, so each task keeps few."""
    nth = F.array_sort(F.collect_list(F.struct("file", "line")))
    key = F.coalesce(F.col(by), F.lit("<top-level>")).alias("_by")
    few = hits.select(key, "file", "line").withColumn("_salt", F.pmod(F.xxhash64("file", "line"), F.lit(32)))
    part = few.groupBy("_by", "_salt").agg(F.count("*").alias("n"), F.slice(nth, 1, samples).alias("s"))
    out = part.groupBy("_by").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, samples).alias("s"))
    return out.select(F.col("_by").alias(by), "n", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["file"], x["line"].cast("string"))), " ").alias("first"))


@dataclass(frozen=True)
class Rule:
    kind: str
    severity: str
    pattern: str
    extensions: tuple[str, ...] = ()


_DYNAMIC = ("py", "js", "ts", "tsx", "jsx", "rb", "php")
#: Security signals: what is found, how grave, what tells it, and in files of which extensions (none: of any). Fixed values.
SECURITY = [
    Rule("eval_call", "high", r"\beval\s*\(", _DYNAMIC),
    Rule("exec_call", "high", r"\bexec\s*\(", _DYNAMIC),
    Rule("pickle_loads", "high", r"pickle\.loads", ("py",)),
    Rule("subprocess_shell_true", "high", r"subprocess\..*shell\s*=\s*True", ("py",)),
    Rule("os_system", "high", r"\bos\.system", ("py", "rb")),
    Rule("hardcoded_password", "high", r"""password\s*=\s*['"]"""),
    Rule("hardcoded_secret", "high", r"""(?:api_?key|secret)\s*=\s*['"]"""),
    Rule("fstring_sql", "med", r"""f['"].*SELECT.*\{.*\}""", ("py",)),
    Rule("concat_sql", "med", r"""\.execute\(\s*['"]\s*SELECT.*\+"""),
    Rule("tls_verify_false", "med", r"verify\s*=\s*False", ("py",)),
    Rule("weak_hash", "low", r"\bmd5\b|\bsha1\b"),
]


def pattern_scan(lines: DataFrame, rules: list[Rule], extension: Column | None = None) -> DataFrame:
    """(file, line, kind, severity): a row for every rule that a line matches; one pass over the lines whatever the rules.
    Without ``extension`` every rule holds for every file."""
    hits = []
    for r in rules:
        here = F.col("text").rlike(r.pattern)
        if r.extensions and extension is not None:
            here = here & extension.isin(*r.extensions)
        hits.append(F.when(here, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"))))
    return lines.select("file", "line", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("file", "line", "h.*")


#: Markers of decisions in comments, and in commit messages. Fixed values.
MARKERS = ["DECISION", "WHY", "RATIONALE", "TRADEOFF", "ADR", "REJECTED"]
COMMIT_MARKERS = ["Why", "Decision", "Tradeoff", "Refactor for", "Rationale"]


def markers(lines: DataFrame, words: list[str] = MARKERS) -> DataFrame:
    """(file, line, marker, note): comment lines (#, //, --) that start with a marker and a colon, and say something."""
    pattern = r"(?i)^\s*(?:#|//|--)\s*(" + "|".join(words) + r"):\s*(\S.*?)\s*$"
    found = lines.where(F.col("text").rlike(pattern))
    return found.select("file", "line", F.upper(F.regexp_extract("text", pattern, 1)).alias("marker"), F.regexp_extract("text", pattern, 2).alias("note"))


def commit_markers(messages: DataFrame, words: list[str] = COMMIT_MARKERS) -> DataFrame:
    """(sha, file, marker, note) from (sha, file, message): lines of a message that start with a marker and a colon, and say
    something; the marker as ``words`` spells it. A commit without a file stands under HEAD."""
    pattern = r"(?i)^\s*(" + "|".join(words) + r"):\s*(\S.*?)\s*$"
    lines = messages.select("sha", F.coalesce("file", F.lit("HEAD")).alias("file"), F.explode(F.split("message", "\r?\n")).alias("text")).where(F.col("text").rlike(pattern))
    spelt = F.element_at(F.create_map(*(F.lit(x) for w in words for x in (w.lower(), w))), F.lower(F.regexp_extract("text", pattern, 1)))
    return lines.select("sha", "file", spelt.alias("marker"), F.regexp_extract("text", pattern, 2).alias("note"))


#: What in a file's text makes a framework call it: language, name, pattern. The first of a language that matches counts. Fixed values.
FRAMEWORKS = [
    ("python", "flask_route", r"""@\s*[A-Za-z_][A-Za-z0-9_]*\.route\(\s*['"][^'"]+['"]"""),
    ("python", "fastapi_route", r"""@\s*[A-Za-z_][A-Za-z0-9_]*\.(get|post|put|delete|patch|options|head)\(\s*['"][^'"]+['"]"""),
    ("go", "go_net_http", r"""\b[A-Za-z_][A-Za-z0-9_]*\.HandleFunc\(\s*['"`][^'"`]+['"`]"""),
    ("go", "go_chi", r"""\b[A-Za-z_][A-Za-z0-9_]*\.(Get|Post|Put|Delete|Patch|Options|Head)\(\s*['"`][^'"`]+['"`]"""),
    ("go", "go_gin_echo", r"""\b[A-Za-z_][A-Za-z0-9_]*\.(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\(\s*['"`][^'"`]+['"`]"""),
    ("javascript", "express_route", r"""\b[A-Za-z_][A-Za-z0-9_]*\.(get|post|put|delete|patch|options|head|all)\(\s*['"`][^'"`]+['"`]"""),
    ("typescript", "express_route", r"""\b[A-Za-z_][A-Za-z0-9_]*\.(get|post|put|delete|patch|options|head|all)\(\s*['"`][^'"`]+['"`]"""),
    ("typescript", "nestjs_decorator", r"@(Controller|Get|Post|Put|Delete|Patch|Options|Head|All|Module|Injectable)\b"),
    ("javascript", "nestjs_decorator", r"@(Controller|Get|Post|Put|Delete|Patch|Options|Head|All|Module|Injectable)\b"),
    ("kotlin", "ktor_route", r"""(?m)(?:^|\s|\{)(get|post|put|delete|patch|options|head)\(\s*"[^"]+\""""),
    ("kotlin", "spring_annotation", r"@(RestController|Controller|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\b"),
    ("swift", "vapor_route", r"""\b[A-Za-z_][A-Za-z0-9_]*\.(get|post|put|delete|patch|options|head)\(\s*"[^"]+\""""),
    ("scala", "akka_http_route", r"""\bpath\(\s*"[^"]+"\s*\)\s*\{"""),
    ("scala", "play_action", r"\bAction(?:\.async)?\s*(?:\([^)]*\)\s*)?\{"),
    ("php", "laravel_route", r"""\bRoute::(get|post|put|delete|patch|options|any|match|resource|view|redirect)\(\s*['"][^'"]+['"]"""),
    ("php", "symfony_route", r"""#\[\s*Route\s*\(\s*['"][^'"]+['"]"""),
]
#: Python files that a framework calls by their name. Fixed values.
FRAMEWORK_FILES = {"urls.py": "django_urls", "views.py": "django_views"}


def framework_files(files: DataFrame, language: Column) -> DataFrame:
    """(file, framework) from (file, text): files that a framework calls, told by their name or by their text."""
    name = F.regexp_extract("file", "([^/]*)$", 1)
    tags = [F.when((language == "python") & (name == n), t) for n, t in FRAMEWORK_FILES.items()]
    tags += [F.when((language == lang) & F.col("text").rlike(pattern), tag) for lang, tag, pattern in FRAMEWORKS]
    return files.select("file", F.coalesce(*tags).alias("framework")).where("framework is not null")


@dataclass(frozen=True)
class Contract:
    """A line that speaks of a service: group ``method`` and ``path`` of the pattern (0: none), or a fixed method."""

    language: str
    kind: str
    role: str
    framework: str
    pattern: str
    method: int | str = "*"
    path: int = 1


#: One row a spelling. The first rule of a language and kind that matches a line counts.
CONTRACTS = [
    Contract("python", "http", "provider", "fastapi", r"@(?:app|router|api)\.(get|post|put|delete|patch|head|options)\(\s*['\x22]([^'\x22]+)", 1, 2),
    Contract("python", "http", "provider", "flask", r"@(?:app|bp|blueprint)\.route\(\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("python", "http", "provider", "django", r"\bpath\(\s*['\x22]([^'\x22]*)['\x22]", "*", 1),
    Contract("python", "http", "consumer", "requests", r"\b(?:requests|httpx|session|client)\.(get|post|put|delete|patch)\(\s*f?['\x22]([^'\x22]+)", 1, 2),
    Contract("python", "topic", "publisher", "kafka", r"\bproducer\.send\(\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("python", "topic", "subscriber", "kafka", r"\bKafkaConsumer\(\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("python", "task", "provider", "celery", r"@(?:app|celery)\.task\(\s*name\s*=\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("javascript", "http", "consumer", "axios", r"\baxios\.(get|post|put|delete|patch)\(\s*['\x22`]([^'\x22`]+)", 1, 2),
    Contract("javascript", "http", "consumer", "fetch", r"\bfetch\(\s*['\x22`]([^'\x22`]+)", "GET", 1),
    Contract("javascript", "http", "provider", "express", r"\b(?:app|router|server)\.(get|post|put|delete|patch)\(\s*['\x22`](/[^'\x22`]*)", 1, 2),
    Contract("javascript", "event", "provider", "socket.io", r"\bsocket\.on\(\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("javascript", "event", "publisher", "socket.io", r"\b(?:socket|io)\.emit\(\s*['\x22]([^'\x22]+)", "*", 1),
    Contract("go", "http", "provider", "net/http", r"\bHandle(?:Func)?\(\s*\x22([^\x22]+)", "*", 1),
    Contract("go", "http", "provider", "gin", r"\b(?:r|router|g|e)\.(GET|POST|PUT|DELETE|PATCH)\(\s*\x22([^\x22]+)", 1, 2),
    Contract("go", "http", "consumer", "net/http", r"\bhttp\.(Get|Post)\(\s*\x22([^\x22]+)", 1, 2),
    Contract("java", "http", "provider", "spring", r"@(Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*)?\x22([^\x22]+)", 1, 2),
    Contract("java", "topic", "subscriber", "kafka", r"@KafkaListener\([^)]*topics\s*=\s*\x22([^\x22]+)", "*", 1),
    Contract("ruby", "http", "provider", "rails", r"^\s*(get|post|put|delete|patch)\s+['\x22]([^'\x22]+)", 1, 2),
    Contract("rust", "http", "provider", "axum", r"\.route\(\s*\x22([^\x22]+)\x22\s*,\s*(?:get|post|put|delete|patch)", "*", 1),
    Contract("rust", "http", "provider", "rocket", r"#\[(get|post|put|delete|patch)\(\s*\x22([^\x22]+)", 1, 2),
    Contract("php", "http", "provider", "laravel", r"Route::(get|post|put|delete|patch)\(\s*['\x22]([^'\x22]+)", 1, 2),
    Contract("csharp", "http", "provider", "aspnet", r"\[Http(Get|Post|Put|Delete|Patch)\(\s*\x22([^\x22]+)", 1, 2),
    Contract("sql", "db", "provider", "sql", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`\x22]?([A-Za-z_][\w.]*)", "*", 1),
    Contract("any", "db", "consumer", "raw-sql", r"(?i)\bselect\b.*\bfrom\s+[`\x22]?([A-Za-z_][\w.]*)", "*", 1),
    Contract("proto", "grpc", "provider", "proto", r"^\s*rpc\s+(\w+)\s*\(", "*", 1),
]


def contracts(lines: DataFrame, language: Column, rules: list[Contract] = CONTRACTS) -> DataFrame:
    """(file, line, kind, role, framework, method, path, contract_id): kind::method::path, paths in normal form."""
    out = []
    kinds = sorted({(r.kind, r.role) for r in rules})
    for kind, role in kinds:
        branch = None
        for r in (r for r in rules if (r.kind, r.role) == (kind, role)):
            here = F.col("text").rlike(r.pattern) & (F.lit(True) if r.language == "any" else language == r.language if r.language != "javascript" else language.isin("javascript", "typescript"))
            method = F.upper(F.regexp_extract("text", r.pattern, r.method)) if isinstance(r.method, int) else F.lit(r.method)
            what = F.regexp_extract("text", r.pattern, r.path)
            row = F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(r.framework).alias("framework"), method.alias("method"), (normalize_path(what) if kind == "http" else what).alias("path"))
            branch = F.when(here, row) if branch is None else branch.when(here, row)
        out.append(branch)
    rows = lines.select("file", "line", F.explode(F.array_compact(F.array(*out))).alias("c")).select("file", "line", "c.*")
    return rows.withColumn("contract_id", F.when(F.col("kind") == "http", F.concat_ws("::", "kind", "method", "path")).otherwise(F.concat_ws("::", "kind", "path")))


VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]


def contract_links(found: DataFrame) -> DataFrame:
    """(contract_id, provider_repo, consumer_repo, confidence) of contracts with a repo column: the same id in two
    repositories; a provider of any method stands for each, at less confidence. The best of each pair counts."""
    wide = F.when((F.col("kind") == "http") & (F.col("method") == "*"), F.array(*(F.lit(v) for v in VERBS))).otherwise(F.array("method"))
    sides = found.withColumn("_m", F.explode(wide)).withColumn("_id", F.when(F.col("kind") == "http", F.concat_ws("::", "kind", "_m", "path")).otherwise(F.col("contract_id")))
    sure = F.when((F.col("kind") == "http") & (F.col("method") == "*"), 0.7).otherwise(0.95)
    p = sides.where("role = 'provider'").select("_id", F.col("repo").alias("provider_repo"), sure.alias("a")).groupBy("_id", "provider_repo").agg(F.max("a").alias("a"))
    c = sides.where("role in ('consumer', 'subscriber', 'publisher')").select("_id", F.col("repo").alias("consumer_repo"), sure.alias("b")).groupBy("_id", "consumer_repo").agg(F.max("b").alias("b"))
    return p.join(c, "_id").where("provider_repo != consumer_repo").select(F.col("_id").alias("contract_id"), "provider_repo", "consumer_repo", F.least("a", "b").alias("confidence"))
