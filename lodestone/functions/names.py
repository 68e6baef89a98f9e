"""Name algebra and other scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tail_segment(name: Column) -> Column:
    """What follows the last ``:`` or ``.``."""
    return F.regexp_extract(name, "([^:.]*)$", 1)


def bare_leaf(name: Column) -> Column:
    """What follows the last ``.`` or ``::``; null for a name without either, or if nothing follows."""
    return F.nullif(F.regexp_extract(name, r"^.*(?:\.|::)(.*)$", 1), F.lit(""))


def head(name: Column, sep: str) -> Column:
    """What comes before the last ``sep``; null without one."""
    return F.when(F.contains(name, F.lit(sep)), F.array_join(F.slice(F.split(name, "\\Q" + sep + "\\E"), F.lit(1), F.size(F.split(name, "\\Q" + sep + "\\E")) - 1), sep))


def alias_keys(name: Column) -> Column:
    """All names under which a reference is found: itself, its leaf, and for either separator its head, if that has
    several segments or starts with a capital, with the head's own leaf if that starts with a capital."""
    keys = [name, bare_leaf(name)]
    for sep in ("::", "."):
        h = head(name, sep)
        wide = h.rlike(r"(::|\.)") | h.rlike("^[A-Z]")
        leaf = F.coalesce(bare_leaf(h), h)
        keys += [F.when(wide, h), F.when(leaf.rlike("^[A-Z]"), leaf)]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def caller_keys(caller: Column) -> Column:
    """Every prefix of a caller (cut at ``::`` and ``.``) and the prefix's leaf."""
    parts = F.split(F.regexp_replace(caller, r"::", "."), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return F.array_distinct(F.concat(F.array(caller), prefixes, parts))


def language(file: Column) -> Column:
    """The language of a file by its extension; null if unknown."""
    known = {"py": "python", "rs": "rust", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "kt": "kotlin", "rb": "ruby", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "swift": "swift", "scala": "scala", "php": "php", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown"}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)))


def parent_dir(file: Column) -> Column:
    """The directory of a path; empty for a file at the top."""
    return F.regexp_extract(file, "^(.*)/[^/]*$", 1)


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if some are cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, numbered from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(last - first + 1, F.lit(0))), "\n")


def normalize_path(url: Column) -> Column:
    """A request path: no host, no query, lower case, no slash at the end, and every parameter written {param}."""
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(path, r"\?.*$", "")
    for pattern in (r"\$?\{[^}/]*\}", r"<[^>/]*>", r":[A-Za-z_][A-Za-z0-9_]*", r"\[[^\]/]*\]"):
        path = F.regexp_replace(path, pattern, "{param}")
    path = F.regexp_replace(F.lower(path), "(.)/+$", "$1")
    return F.when(path == "", "/").otherwise(path)


def identifiers(text: Column) -> Column:
    """Identifier-shaped words in order of first appearance: with an underscore or capitals inside, 3 characters at least."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & (F.contains(w, F.lit("_")) | w.rlike("[a-z][A-Z]"))))


#: Folders and ends of file names that tell tests. Fixed values.
TEST_FOLDERS = ["tests", "test", "__tests__"]
TEST_ENDS = ["_test.rs", "_test.go", "_test.py", "_test.ts", "_test.js", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "Test.java", "Tests.java", "_spec.rb"]


def is_test_path(file: Column) -> Column:
    """Files below a folder of tests (__tests__ not at the root), or named like tests."""
    path = F.regexp_replace(file, r"\\\\", "/")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ends = "(?:" + "|".join(e.replace(".", r"\.") for e in TEST_ENDS) + ")$"
    return path.rlike("^tests?/|/(?:" + "|".join(TEST_FOLDERS) + ")/") | name.rlike(ends) | name.rlike(r"^test_.*\.(?:py|rs)$|^Test.*\.java$")


def is_exported(name: Column, visibility: Column, file: Column) -> Column:
    """Explicit visibility decides; without it the convention of the language, by the file's extension."""
    tail = F.regexp_extract(name, r"([^.:]*)$", 1)
    ext = F.regexp_extract(file, r"\.([^./]+)$", 1)
    by_rule = F.when(ext == "go", tail.rlike("^[A-Z]")).when(ext == "py", tail.rlike("^[^_]")).when(ext == "rs", F.lit(False)).otherwise(F.lit(True))
    return F.when(visibility.isNull(), by_rule).otherwise(visibility.isin("public", "export", "pub"))


#: Extensions of files that hold no source. Fixed values.
NON_SOURCE = ["md", "markdown", "rst", "txt", "yml", "yaml", "toml", "json", "jsonc", "ini", "cfg", "conf", "csv", "tsv", "xml"]


def is_non_source(file: Column) -> Column:
    """Files outside the code base, documents, settings and data."""
    return (file == "<external>") | file.startswith("external:") | F.lower(F.regexp_extract(file, r"\.([^./]+)$", 1)).isin(NON_SOURCE)


def normal_body(text: Column) -> Column:
    """A body without blank lines, lines that are only a comment, triple-quoted strings, and white space at line ends."""
    plain = F.regexp_replace(text, r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")
    kept = F.filter(F.split(plain, "\n"), lambda x: ~x.rlike(r"^\s*(?:$|#|//|/\*|\*|--)"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")


def sql_tables(text: Column) -> Column:
    """The tables that SQL in a text reads or writes, in order, each once, lower case; bodies of CREATE FUNCTION don't count."""
    plain = F.regexp_replace(text, r"(?is)create\s+(?:or\s+replace\s+)?function\b.*?\$(\w*)\$.*?\$\1\$", "")
    found = F.regexp_extract_all(plain, F.lit(r"(?i)\b(?:from|join|into|update|table(?:\s+if\s+(?:not\s+)?exists)?)\s+[`\x22]?([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~t.isin("select", "set", "if", "only", "lateral")))


#: How programs look an environment variable up; the first group is its name. Fixed values.
ENV_LOOKUPS = r"(?:os\.environ(?:\.get)?[\[(]|os\.getenv\(|process\.env\.|process\.env\[|import\.meta\.env\.|os\.Getenv\(|os\.LookupEnv\(|System\.getenv\(|ENV\[|ENV\.fetch\(|env::var\(|std::env::var\(|getenv\(|env\(|Environment\.GetEnvironmentVariable\()\s*['\x22]?([A-Za-z_]\w*)"


def env_names(text: Column) -> Column:
    """The environment variables that a text looks up, upper case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ENV_LOOKUPS), F.lit(1)), F.upper))


#: Words of a question that name nothing. Fixed values.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where", "which", "who", "why", "will", "with"]


def question_words(text: Column) -> Column:
    """The words of a question in lower case, 3 characters at least, without stop words, each once."""
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS)))


def glob_regex(glob: str) -> str:
    """A glob as a regular expression: ``**`` crosses slashes, ``*`` and ``?`` don't, {a,b} are alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if not c.isalnum() and c not in "_/-" else c
        i += 1
    return "^" + out + "$"
