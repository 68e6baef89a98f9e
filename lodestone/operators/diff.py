"""Diffs below the level of a definition, fuzzy renames, and reports over classified changes.

Where SQL can't say it (edit scripts), Arrow batches of rows go to Python; a row is one definition, so memory is
bounded by one definition's text.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.names import tail_segment

_TOKEN = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|\d+(?:\.\d+)?|\w+|\s+|[^\w\s]")
#: What starts a comment in the languages that are read. Fixed values.
COMMENTS = ("#", "//", "--", "/*", "*")


def name_ratio(a: str, b: str) -> float:
    """Twice the characters that match in order over the characters of both; 1 for two empty names."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def line_diff(old: str | None, new: str | None) -> list[tuple[str, int, str]]:
    """(-, line of the old text, line) and (+, line of the new text, line); what is equal is left out."""
    a, b = (old or "").split("\n") if old else [], (new or "").split("\n") if new else []
    out = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op != "equal":
            out += [("-", i + 1, a[i]) for i in range(i1, i2)] + [("+", j + 1, b[j]) for j in range(j1, j2)]
    return out


def hunks(old: str | None, new: str | None, context: int = 3) -> str:
    """The changed lines with ``context`` equal ones around them; ⋯ stands between hunks."""
    a, b = (old or "").split("\n") if old else [], (new or "").split("\n") if new else []
    parts = []
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        rows = []
        for op, i1, i2, j1, j2 in group:
            if op == "equal":
                rows += [" " + x for x in a[i1:i2]]
            else:
                rows += ["-" + x for x in a[i1:i2]] + ["+" + x for x in b[j1:j2]]
        parts.append("\n".join(rows))
    return "\n⋯\n".join(parts)


def line_similarity(a: str, b: str) -> float:
    """How many of the first line's words the second has, over the longer line's number of words; for two different single
    words the share of places with the same character, of the shorter one's bytes. Lines without words are alike."""
    wa, wb = a.split(), b.split()
    if not wa or not wb:
        return float(not wa and not wb)
    if len(wa) == len(wb) == 1 and wa != wb:
        return sum(x == y for x, y in zip(wa[0], wb[0])) / min(len(wa[0].encode()), len(wb[0].encode()))
    return sum(w in wb for w in wa) / max(len(wa), len(wb))


def _kind(old: str, new: str, inside: int) -> str:
    """What a change of tokens means."""
    o, n = old.strip(), new.strip()
    if o.startswith(COMMENTS) or n.startswith(COMMENTS):
        return "comment_changed"
    literal = re.compile(r"^(?:[\"'].*[\"']|\d+(?:\.\d+)?|true|false|null|None|True|False)$", re.DOTALL)
    if (not o or literal.match(o)) and (not n or literal.match(n)):
        return "value_changed"
    if inside:
        return "argument_changed"
    if re.fullmatch(r"\w*", o) and re.fullmatch(r"\w*", n):
        return "identifier_changed"
    return "value_changed"


def change_details(old: str | None, new: str | None, least: float = 0.5, cut: int = 80) -> list[tuple[str, str, str]]:
    """(kind, old, new): lines that were taken out are paired, each with the most similar one put in (``least`` at
    least), and the pairs compared token by token; what has no partner is a line added or removed."""
    changed = line_diff(old, new)
    out_lines, in_lines = [t for s, _, t in changed if s == "-"], [t for s, _, t in changed if s == "+"]
    free = list(range(len(in_lines)))
    found = []
    for line in out_lines:
        best = max(free, key=lambda j: (line_similarity(line, in_lines[j]), -j), default=None)
        if best is None or line_similarity(line, in_lines[best]) < least:
            if line.strip():
                found.append(("line_removed", line.strip()[:cut], ""))
            continue
        free.remove(best)
        a, b = _TOKEN.findall(line), _TOKEN.findall(in_lines[best])
        for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            was, now = "".join(a[i1:i2]), "".join(b[j1:j2])
            if op != "equal" and (was.strip() or now.strip()):
                head = "".join(a[:i1])
                comment = any(c in head for c in ("#", "//")) and "comment_changed"
                found.append((comment or _kind(was, now, head.count("(") - head.count(")")), was.strip()[:cut], now.strip()[:cut]))
    return found + [("line_added", "", in_lines[j].strip()[:cut]) for j in free if in_lines[j].strip()]


def _per_row(rows: DataFrame, keys: list[str], fields: str, columns: list[str], work) -> DataFrame:
    """The rows that work(old, new) gives for rows(keys, old, new)."""
    plain = rows.select(*keys, F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name in keys) + ", " + fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = pdf[["old", "new"]].astype(object).where(pdf[["old", "new"]].notna(), None)
            got = [work(o, n) for o, n in zip(text["old"], text["new"])]
            out = pdf[keys].loc[pdf.index.repeat([len(g) for g in got])].reset_index(drop=True)
            flat = [r for g in got for r in g]
            for i, c in enumerate(columns):
                out[c] = pd.Series([r[i] for r in flat], dtype=object)
            yield out

    return plain.mapInPandas(run, schema)


def line_diffs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sign, line, text) of rows(keys, old, new); a null text is an empty one."""
    return _per_row(rows, keys, "sign string, line long, text string", ["sign", "line", "text"], line_diff)


def token_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, was, now) of rows(keys, old, new)."""
    return _per_row(rows, keys, "change string, was string, now string", ["change", "was", "now"], change_details)


def fuzzy_renames(removed: DataFrame, added: DataFrame, least: float = 0.6) -> DataFrame:
    """(kind, file, parent, old_name, new_name, ratio): removed and added definitions (kind, file, parent, name) of one
    file, kind and parent whose names are alike, matched greedily: most alike first, ties by name. A group is what one
    commit changes in one class or file."""
    key = ["kind", "file", "parent"]
    a = removed.select(*key, "name", F.lit(0).alias("side"))
    both = a.unionByName(added.select(*key, "name", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new = sorted(pdf.loc[pdf["side"] == 0, "name"].dropna()), sorted(pdf.loc[pdf["side"] == 1, "name"].dropna())
        ranked = []
        for i, x in enumerate(old):
            m = difflib.SequenceMatcher(None, "", x, autojunk=False)
            for j, y in enumerate(new):
                m.set_seq1(y)
                # two cheap upper bounds spare most comparisons
                if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := name_ratio(x, y)) >= least:
                    ranked.append((-r, i, j))
        gone, come, out = set(), set(), []
        for r, i, j in sorted(ranked):
            if i not in gone and j not in come:
                gone.add(i)
                come.add(j)
                out.append((*(pdf[k].iloc[0] for k in key), old[i], new[j], -r))
        return pd.DataFrame(out, columns=[*key, "old_name", "new_name", "ratio"])

    return both.groupBy(*key).applyInPandas(run, "kind string, file string, parent string, old_name string, new_name string, ratio double")


def cross_file_patterns(changes: DataFrame, least: int = 2) -> DataFrame:
    """(change, tail, n, files): the same change of the same last segment in ``least`` files or more; formatting doesn't count. changes: (file, name, change)."""
    real = changes.where("change != 'formatting'").groupBy("change", tail_segment(F.col("name")).alias("tail"))
    return real.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).where(F.col("files") >= least)


def change_groups(changes: DataFrame, shown: int = 3) -> DataFrame:
    """(file, n, label): changes of a file, labelled by the first names and how many more there are. Only the least names are kept, so a file's label is bounded."""
    w = Window.partitionBy("file").orderBy("name", "change")
    ranked = changes.select("file", "name", "change").withColumn("k", F.row_number().over(w))
    out = ranked.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "name")))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: x["name"]), ", ")
    return out.select("file", "n", F.when(F.col("n") > shown, F.concat(names, F.format_string(" +%d more", F.col("n") - shown))).otherwise(names).alias("label"))


def review_impact(changes: DataFrame, rank: DataFrame, blast: DataFrame) -> DataFrame:
    """changes(file, name, parent, breaking, ...) with direct_files and impact = rank (ln(1 + direct_files) + 1), three
    times that if breaking; what has no rank or blast counts as 0. rank: (id, rank), blast: as of graph.blast_direct."""
    r = rank.select(F.col("id").alias("_file"), "rank")
    b = blast.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("parent").alias("_p"), "direct_files")
    out = changes.join(r, F.col("file") == F.col("_file"), "left").join(b, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")) & F.col("parent").eqNullSafe(F.col("_p")), "left")
    files = F.coalesce("direct_files", F.lit(0))
    score = F.coalesce("rank", F.lit(0.0)) * (F.log1p(files) + 1) * F.when(F.col("breaking"), 3.0).otherwise(1.0)
    return out.select(*changes.columns, files.alias("direct_files"), score.alias("impact"))


def external_callers(breaking: DataFrame, callers: DataFrame, touched: DataFrame, most: int = 100) -> DataFrame:
    """(name, inside, outside): the first ``most`` callers (by file and line) of each breaking name, in files that the diff touches and in others."""
    hits = breaking.select("name").distinct().join(callers.select("name", "file", "line").distinct(), "name")
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("file", "line"))).where(F.col("k") <= most)
    seen = first.join(touched.select("file").distinct().withColumn("_in", F.lit(True)), "file", "left")
    return seen.groupBy("name").agg(F.count_if("_in").alias("inside"), F.count_if(F.col("_in").isNull()).alias("outside"))


def shaped(changes: DataFrame) -> DataFrame:
    """(file, name, parent, change, breaking, from_file, confidence): classified changes as a report shows them.

    A move within one file is a modification; across files it is a move from a file, sure at 1 if signature and body are
    equal, 0.8 if the signature is, else 0.6."""
    e = F.coalesce("new", "old")
    moved = F.col("change") == "moved"
    across = moved & (F.col("old.file") != F.col("new.file"))
    sig, body = (F.col(f"old.{h}").eqNullSafe(F.col(f"new.{h}")) for h in ("sig_hash", "body_hash"))
    out = changes.select(
        e["file"].alias("file"), e["name"].alias("name"), e["parent"].alias("parent"), F.when(moved & ~across, "modified").otherwise(F.col("change")).alias("change"), "breaking",
        F.when(across, F.col("old.file")).alias("from_file"), F.when(across, F.when(sig & body, 1.0).when(sig, 0.8).otherwise(0.6)).alias("confidence"),
    )
    return out
