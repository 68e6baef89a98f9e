"""Sources that need a parser: JSON, YAML, TOML, Markdown blocks, single-file components, brace languages, Ruby.

Every scan is a flat-map over files(file, text) in Arrow batches: a file that doesn't parse gives no rows, and files
never meet, so the scans need no shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.config import ENTITY, REF, python_rows

#: What names an item of a list, the first one that it has. Fixed values.
IDENTITY = ["id", "key", "name", "text", "type"]


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def _entity(file: str, name: str, kind: str, start: int, end: int, parent: str | None, body: str, sig: str | None = None, **more) -> tuple:
    qualified = f"{parent}.{name}" if parent else name
    return (file, name, kind, start, end, parent, qualified, sig, _h(body), _h(sig) if sig else None, more.get("visibility"), more.get("doc"), more.get("heritage", []))


def flat_map(files: DataFrame, work: Callable[[str, str], list[tuple]], schema=ENTITY) -> DataFrame:
    """The rows that work(file, text) gives for every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for f, t in zip(pdf["file"], pdf["text"]) for r in work(f, t or "")], columns=schema.names)

    return files.select("file", "text").mapInPandas(run, schema)


def _tree(file: str, value, parent: str | None, line_of: Callable[[str, int], int], at: int, lists: bool, derived: bool, out: list[tuple]) -> None:
    """Keys of objects, and with ``lists`` items of lists, as entities below their parent. The nesting is walked with a stack."""
    todo = [(value, parent, at, derived)]
    while todo:
        node, up, near, der = todo.pop()
        if isinstance(node, dict):
            pairs = [(str(k), v) for k, v in node.items()]
        elif isinstance(node, list) and lists:
            pairs = []
            for i, v in enumerate(node):
                key = next((k for k in IDENTITY if isinstance(v, dict) and isinstance(v.get(k), (str, int))), None)
                pairs.append((str(v[key]) if key else f"[{i}]", v))
        else:
            continue
        for name, v in pairs:
            line = line_of(name, near)
            inside = der or name.startswith("_")
            kind = "derived" if inside else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "property"
            out.append(_entity(file, name, kind, line, line, up, json.dumps(v, sort_keys=True, default=str)))
            todo.append((v, f"{up}.{name}" if up else name, line, inside))


def _line_finder(text: str) -> Callable[[str, int], int]:
    """The line of the first mention of a key at or after a line; that line itself if there is none."""
    where: dict[str, list[int]] = {}
    for i, line in enumerate(text.split("\n"), 1):
        for word in set(re.findall(r"[\w$@./-]+", line)):
            where.setdefault(word, []).append(i)

    def find(name: str, near: int) -> int:
        return next((i for i in where.get(name, []) if i >= near), near)

    return find


def json_rows(file: str, text: str) -> list[tuple]:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    if len(text) > 80 and text.count("\n") < 2:  # minified: lines as if it were printed
        text = json.dumps(value, indent=2, ensure_ascii=False)
    out: list[tuple] = []
    _tree(file, value, None, _line_finder(text), 1, True, False, out)
    return out


def yaml_rows(file: str, text: str) -> list[tuple]:
    """Mappings only; lists are leaves. Without a YAML package there are no rows to give, so the import fails loudly."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, _, node: loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node))
    out: list[tuple] = []
    try:
        for value in yaml.load_all(text, Loader=Loader):
            _tree(file, value, None, _line_finder(text), 1, False, False, out)
    except (yaml.YAMLError, RecursionError, ValueError):
        return []
    return out


def toml_rows(file: str, text: str) -> list[tuple]:
    try:
        value = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return []
    out: list[tuple] = []
    _tree(file, value, None, _line_finder(text), 1, False, False, out)
    return out


def _cut(text: str, most: int = 60) -> str:
    text = " ".join(text.split())
    return text if len(text) <= most else text[: most - 1] + "…"


def markdown_rows(file: str, text: str) -> list[tuple]:
    """Front matter (its keys too), sections, fenced code, tables, lists, quotes and paragraphs; a block's parent is the section it is in."""
    lines = text.split("\n")
    out: list[tuple] = []
    stack: list[tuple[int, str, int]] = []  # level, name, line
    i = 0
    if lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(j for j in range(1, len(lines)) if lines[j].strip() == "---")
        body = "\n".join(lines[1:end])
        out.append(_entity(file, "frontmatter", "frontmatter", 1, end + 1, None, body))
        out += [(r[0], r[1], r[2], r[3] + 1, r[4] + 1, f"frontmatter.{r[5]}" if r[5] else "frontmatter", f"frontmatter.{r[6]}", *r[7:]) for r in yaml_rows(file, body)]
        i = end + 1

    def parent() -> str | None:
        return ".".join(n for _, n, _ in stack) or None

    def close(level: int, at: int) -> None:
        while stack and stack[-1][0] >= level:
            _, name, start = stack.pop()
            out.append(_entity(file, name, "section", start, at, parent(), "\n".join(lines[start - 1 : at])))

    def kind_of(line: str) -> str:
        s = line.strip()
        if s.startswith("|"):
            return "table"
        if re.match(r"(?:[-*+]|\d+[.)])\s", s):
            return "list"
        return "blockquote" if s.startswith(">") else "paragraph"

    while i < len(lines):
        s = lines[i].strip()
        heading = re.match(r"(#{1,6})\s+(\S.*?)\s*#*$", s) if lines[i][:4] != "    " else None
        fence = re.match(r"(```+|~~~+)\s*(\S*)", s)
        if not s:
            i += 1
        elif heading:
            close(len(heading[1]), i)
            stack.append((len(heading[1]), _cut(heading[2]), i + 1))
            i += 1
        elif fence:
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines) - 1)
            out.append(_entity(file, fence[2] or "code", "code_block", i + 1, end + 1, parent(), "\n".join(lines[i : end + 1])))
            i = end + 1
        else:
            kind, end = kind_of(s), i
            while end + 1 < len(lines):
                nxt = lines[end + 1]
                if not nxt.strip() or re.match(r"\s{0,3}(?:#{1,6}\s|```|~~~)", nxt):
                    break
                if kind_of(nxt) != kind and (kind != "list" or not nxt.startswith(" ")):
                    break
                end += 1
            out.append(_entity(file, _cut(s), kind, i + 1, end + 1, parent(), "\n".join(lines[i : end + 1])))
            i = end + 1
    close(0, len(lines))
    return sorted(out, key=lambda r: (r[3], -r[4], r[1]))


# --- brace languages and Ruby: definitions by a line's shape, their ends by counting braces (or by ``end``) ---

_MODS = r"(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|open|sealed|data|inline|suspend|unsafe|const|extern|virtual|partial|readonly|case|implicit|lazy|fileprivate|mutating|constexpr)\s+)*"
#: language: (kind, pattern with the groups name and, if any, bases). The first that matches a line counts.
SHAPES: dict[str, list[tuple[str, str]]] = {
    "rust": [("function", rf"^\s*{_MODS}fn\s+(?P<name>\w+)"), ("class", rf"^\s*{_MODS}struct\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODS}trait\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w:, +]+))?"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<bases>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)"), ("module", rf"^\s*{_MODS}mod\s+(?P<name>\w+)\s*\{{")],
    "go": [("method", r"^func\s+\(\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("class", r"^type\s+(?P<name>\w+)\s+struct"), ("interface", r"^type\s+(?P<name>\w+)\s+interface"), ("type", r"^type\s+(?P<name>\w+)\s")],
    "javascript": [("class", rf"^\s*{_MODS}class\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?"), ("interface", rf"^\s*{_MODS}interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w., ]+))?"), ("enum", rf"^\s*{_MODS}enum\s+(?P<name>\w+)"), ("type", rf"^\s*{_MODS}type\s+(?P<name>\w+)\s*[<=]"), ("function", rf"^\s*{_MODS}function\s*\*?\s*(?P<name>\w+)"), ("function", rf"^\s*{_MODS}(?:let\s+|var\s+)?(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>"), ("method", rf"^\s+{_MODS}(?:get\s+|set\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*\([^;]*\)\s*(?::\s*[^{{;]+)?\{{\s*$")],
    "java": [("class", rf"^\s*{_MODS}(?:class|record|object)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*\([^)]*\))?(?:[^:({{]*?(?:extends|:)\s*(?P<bases>[\w., ()]+?))?(?:\s+implements\b.*)?\s*(?:\{{|$)"), ("interface", rf"^\s*{_MODS}(?:interface|trait|protocol|@interface)\s+(?P<name>\w+)"), ("enum", rf"^\s*{_MODS}enum\s+(?:class\s+)?(?P<name>\w+)"), ("module", rf"^\s*{_MODS}(?:namespace|extension)\s+(?P<name>[\w.]+)"), ("class", rf"^\s*{_MODS}struct\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODS}(?:fun|func|def|function)\s+(?:<[^>]*>\s*)?(?:\w+\.)?&?(?P<name>\w+)"), ("function", rf"^\s*{_MODS}(?!return\b|else\b|new\b|throw\b|if\b|using\b)[\w<>\[\],.?:*&]+\s+\*?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b)[\w:~]+)\s*\([^;]*\)?[^;]*$")],
    "ruby": [("class", r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?"), ("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>[\w?!=]+)")],
}
FAMILY = {"typescript": "javascript", "kotlin": "java", "csharp": "java", "swift": "java", "scala": "java", "php": "java", "c": "java", "cpp": "java"}
EXTENSION = {"rs": "rust", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "rb": "ruby", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "scala": "scala", "php": "php", "py": "python"}
IMPORT = re.compile(r"""^\s*(?:pub\s+)?(?:(?:import|use|using|require|require_relative|include|require_once)\b[\s(]*(?:static\s+|type\s+)?(?:[^'"<;]*?\bfrom\s*)?|\#\s*include\s*|(?:const|let|var)\s+[^=]+=\s*require\()["'<]?(?P<name>[\w@$./:\\{}*, -]+)""")
CALL = re.compile(r"(?<![\w.$:>])(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)!?\s*\(")
#: Words before a bracket that call nothing. Fixed values.
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "def", "fun", "match", "when", "sizeof", "elif", "elsif", "unless", "until", "and", "or", "not", "in", "new", "throw", "await", "super"}


def _blank(text: str, hash_comments: bool) -> str:
    """The text with comments and what is in quotes as blanks, line breaks kept."""
    pattern = r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`" if not hash_comments else r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


def scan_rows(file: str, text: str, lang: str | None = None) -> tuple[list[tuple], list[tuple]]:
    """Entities and references of a source file by the shape of its lines; Python by its own parser."""
    lang = lang or EXTENSION.get(file.rsplit(".", 1)[-1].lower())
    if lang == "python":
        return python_rows(file, text)
    shapes = SHAPES.get(FAMILY.get(lang, lang) if lang else None)
    if not shapes:
        return [], []
    shapes = [(k, re.compile(p)) for k, p in shapes]
    raw, code = text.split("\n"), _blank(text, lang == "ruby").split("\n")
    entities: list[tuple] = []
    refs: list[tuple] = []
    stack: list[list] = []  # name, kind, line, depth before it, its indent, opened, attributes
    depth, doc = 0, []

    def close(at: int) -> None:
        name, kind, start, _, _, _, attrs = stack.pop()
        parent = ".".join(s[0] for s in stack) or attrs.pop("recv", None)
        attrs.pop("recv", None)
        if kind == "function" and (parent and stack and stack[-1][1] in ("class", "impl", "interface", "module")):
            kind = "method"
        if kind != "impl":
            entities.append(_entity(file, name, kind, start, at, parent, "\n".join(raw[start - 1 : at]), **attrs))

    for no, line in enumerate(code, 1):
        source = raw[no - 1]
        if re.match(r"\s*(?://|/\*|\*|#(?!\[|\s*include))", source):
            doc.append(source.strip().strip("/*#! "))
            continue
        hit = None
        if not (imported := IMPORT.match(source)):
            hit = next(((k, m) for k, p in shapes if (m := p.match(line))), None)
        caller = ".".join(filter(None, [stack[0][6].get("recv") if stack else None, *(s[0] for s in stack)])) or None
        if imported:
            name = imported["name"].strip(" {}*,")
            if name:
                refs.append((file, caller, name, "import", no, None))
        indent = len(source) - len(source.lstrip())
        if hit:
            while lang != "ruby" and stack and not stack[-1][5] and depth <= stack[-1][3]:
                close(no - 1)  # it had no body
            kind, m = hit
            g = m.groupdict()
            bases = [("extend", b.strip().split("(")[0]) for b in re.split(r"[,+]", g.get("bases") or "") if b.strip()]
            hidden = re.search(r"\b(?:private|protected|fileprivate)\b", line) or (lang == "rust" and not re.match(r"\s*pub\b", line)) or (lang == "go" and not g["name"][0].isupper())
            sig = source.strip().rstrip("{").strip()[:256]
            stack.append([g["name"], kind, no, depth, indent, False, {"sig": sig, "doc": " ".join(doc)[:1024] or None, "heritage": bases, "visibility": "private" if hidden else "public", "recv": g.get("recv")}])
            caller = ".".join(filter(None, [g.get("recv"), *(s[0] for s in stack)]))
        if not imported:
            defined = {hit[1]["name"]} if hit else set()
            refs += [(file, caller, m["name"], "call", no, None) for m in CALL.finditer(line) if m["name"].split(".")[-1] not in NOT_CALLS | defined]
        doc = []
        if lang == "ruby":
            if stack and not hit and re.match(r"\s*end\b", line) and indent <= stack[-1][4]:
                close(no)
            continue
        for c in line:
            if c == "{":
                depth += 1
                if stack:
                    stack[-1][5] = stack[-1][5] or depth == stack[-1][3] + 1
            elif c == "}":
                depth -= 1
                while stack and (depth <= stack[-1][3] if stack[-1][5] else depth < stack[-1][3]):
                    close(no if stack[-1][5] else no - 1)
        if stack and not stack[-1][5] and line.rstrip().endswith(";") and depth <= stack[-1][3]:
            close(no)  # a declaration without a body
    while stack:
        close(len(raw))
    return sorted(entities, key=lambda r: (r[3], -r[4])), refs


def component_rows(file: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """Of a page or component: the definitions and references of its script blocks at their lines, and a reference for every component tag."""
    entities, refs = [], []
    blanked = text
    for m in re.finditer(r"(?is)<script\b([^>]*)>(.*?)</script\s*>", text):
        ahead = text.count("\n", 0, m.start(2))
        e, r = scan_rows(file, m[2], "typescript" if re.search(r"lang\s*=\s*[\"']tsx?", m[1]) else "javascript")
        entities += [(*x[:3], x[3] + ahead, x[4] + ahead, *x[5:]) for x in e]
        refs += [(*x[:4], x[4] + ahead, x[5]) for x in r]
        blanked = blanked.replace(m[0], "\n" * m[0].count("\n"), 1)
    for m in re.finditer(r"<([A-Z]\w*(?:\.\w+)*|[a-z]\w*(?:-\w+)+)\b", blanked):
        refs.append((file, None, m[1], "instantiation", blanked.count("\n", 0, m.start()) + 1, None))
    return entities, refs


def scan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and refs of files(file, text) of any known kind, told by the extension."""

    def both(file: str, text: str) -> tuple[list[tuple], list[tuple]]:
        ext = file.rsplit(".", 1)[-1].lower()
        if ext in ("html", "htm", "vue", "svelte", "astro"):
            return component_rows(file, text)
        data = {"json": json_rows, "yaml": yaml_rows, "yml": yaml_rows, "toml": toml_rows, "md": markdown_rows, "mdx": markdown_rows}.get(ext)
        return (data(file, text), []) if data else scan_rows(file, text)

    return flat_map(files, lambda f, t: both(f, t)[0]), flat_map(files, lambda f, t: both(f, t)[1], REF)


def page_components(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and refs of pages(page_id, html)."""
    files = pages.select(F.concat(F.lit("page"), "page_id", F.lit(".html")).alias("file"), F.col("html").alias("text"))
    return scan(files)
