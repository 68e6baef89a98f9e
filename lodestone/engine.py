"""One object over a code base: point queries, reports within a budget, reviews, SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import code, diff, graph, history, resolve, text
from lodestone.sources import config, git, structured


class Engine:
    """entities and refs, and where there is one a history (commits) and lines of text."""

    def __init__(self, entities: DataFrame, refs: DataFrame, commits: DataFrame | None = None, lines: DataFrame | None = None):
        self.spark: SparkSession = entities.sparkSession
        self.entities, self.refs, self.commits, self.lines = entities, refs, commits, lines

    @classmethod
    def index(cls, files: DataFrame, commits: DataFrame | None = None) -> Engine:
        """Parses files(file, text)."""
        entities, refs = structured.scan(files)
        lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("file", (F.col("pos") + 1).cast("long").alias("line"), "text")
        return cls(entities, refs, commits, lines)

    @classmethod
    def index_again(cls, files: DataFrame, cache: DataFrame, entities: DataFrame, refs: DataFrame) -> Engine:
        """Parses only files whose hash isn't in cache(file, hash) and takes the rows of the others from before."""
        changed = config.changed_files(files, cache)
        kept = files.join(changed.select("file"), "file", "left_anti").select("file")
        e, r = structured.scan(changed)
        return cls(entities.join(kept, "file", "left_semi").unionByName(e, allowMissingColumns=True), refs.join(kept, "file", "left_semi").unionByName(r, allowMissingColumns=True))

    @classmethod
    def load(cls, spark: SparkSession, path: str, strict: bool = True) -> Engine:
        """What save() wrote."""
        return cls(config.read_entities(spark, f"{path}/entities", strict), config.read_refs(spark, f"{path}/refs", strict))

    def save(self, path: str) -> None:
        config.write_jsonl(self.entities, f"{path}/entities")
        config.write_jsonl(self.refs, f"{path}/refs")

    # point queries

    def callers(self, name: str) -> DataFrame:
        return code.callers(self.refs, name)

    def callees(self, caller: str) -> DataFrame:
        return code.callees(self.refs, caller)

    def symbols(self, file: str, kind: str | None = None, limit: int = 0) -> DataFrame:
        return code.file_symbols(self.entities, file, kind, None, limit)

    def children(self, file: str, parent: str, limit: int = 0) -> DataFrame:
        return code.file_symbols(self.entities, file, None, parent, limit)

    def search(self, words: str, kind: str | None = None, prefix: str | None = None, limit: int = 0) -> DataFrame:
        return code.search(self.entities, words, kind, prefix, limit)

    def where(self, name: str) -> DataFrame:
        return code.where_defined(self.entities, name)

    def outline(self) -> DataFrame:
        return code.outline(self.entities)

    def duplicates(self, min_lines: int = 3) -> DataFrame:
        return code.clones(self.entities, "body_hash", min_lines)

    def dead_code(self, least: float = 0.7) -> DataFrame:
        return code.dead_code(self.entities, self.refs, None, least)

    def grep(self, pattern: str, globs: Iterable[str] = (), **options) -> DataFrame:
        """Lines that match, with the definition around each."""
        hits = text.grep(self.lines, pattern, **options)
        if globs:
            hits = hits.where(F.col("file").rlike("|".join(f"(?:{names.glob_regex(g)})" for g in globs)))
        return code.enclosing(hits, self.entities)

    def resolve(self, query: str) -> DataFrame:
        """Definitions that a query means: name, parent::name, file::name or file::parent::name; by number of files that call them, then line."""
        *scope, name = query.split("::")
        found = self.entities.where(names.tail_segment(F.col("name")) == name)
        for s in scope:
            found = found.where((F.col("file") == s) | F.endswith("file", F.lit("/" + s)) | (names.tail_segment(F.col("parent")) == s))
        users = code.callers(self.refs, name).agg(F.count_distinct("file")).first()[0]
        return found.withColumn("direct_files", F.lit(users)).orderBy("line_start", "file")

    # rank and reports

    def rank(self) -> DataFrame:
        nodes = self.entities.select(F.col("file").alias("id")).unionByName(self.refs.select(F.col("file").alias("id"))).distinct()
        return graph.pagerank(nodes, graph.file_edges(self.entities, self.refs))

    def blast(self) -> DataFrame:
        return graph.blast_direct(self.entities, self.refs)

    def ranked_callers(self, name: str, rank: DataFrame) -> DataFrame:
        """(file, line, rank): each place that calls the name, those in the files of highest rank first."""
        at = self.callers(name).select("file", "line").distinct()
        return at.join(rank.select(F.col("id").alias("file"), "rank"), "file", "left").fillna(0.0, ["rank"]).orderBy(F.col("rank").desc(), "file", "line")

    def map(self, budget: int, depth: int = 10, focus: str | None = None) -> DataFrame:
        """(file, score, tokens, total): the files of highest score that fit the budget, each standing for its ``depth`` best
        definitions. A definition scores 10 ln(1 + files that call it) + callers, private ones a third, those in focus twice."""
        e = self.blast().join(self.entities.select("file", "name", "parent", "visibility").distinct(), ["file", "name"]).drop(self.entities["parent"])
        score = (F.log1p("direct_files") * 10 + F.col("direct_callers")) * F.when(F.col("visibility") == "private", 1 / 3).otherwise(1.0)
        if focus:
            score = score * F.when(F.contains("file", F.lit(focus)), 2.0).otherwise(1.0)
        best = code.map_files(e.groupBy("file", "name").agg(F.max(score).alias("score")), depth)
        files = best.groupBy("file").agg(F.sum("score").alias("score"), F.sum(names.token_estimate(F.col("name")) + 4).cast("long").alias("tokens"))
        return code.budget_prefix(files, budget)

    def subsystems(self, rank: DataFrame | None = None) -> DataFrame:
        """(community, files, representative, label): communities of files, each named by the directory that its files share."""
        c = graph.communities(graph.undirected(graph.file_edges(self.entities, self.refs))).withColumnRenamed("id", "file").where(~names.is_non_source(F.col("file")))
        r = (rank if rank is not None else self.rank()).select(F.col("id").alias("file"), "rank")
        return cluster_summary(c.join(r, "file", "left").fillna(0.0, ["rank"]))

    def context(self, query: str, budget: int = 4000) -> DataFrame:
        """(part, file, name, line, tokens): the definitions a query means, their callers, callees and ancestors, dropped
        from the end of the least important part until the rest fits: ancestors, then callees, then callers."""
        defs = self.resolve(query).limit(5)
        d = defs.select(F.lit(0).alias("p"), F.lit("definition").alias("part"), "file", "name", F.col("line_start").alias("line"))
        tail = query.split("::")[-1]
        callers_ = self.callers(tail).select(F.lit(1).alias("p"), F.lit("caller").alias("part"), "file", F.coalesce("caller", F.lit("<top-level>")).alias("name"), "line")
        callees_ = self.callees(tail).select(F.lit(2).alias("p"), F.lit("callee").alias("part"), "file", "name", "line")
        up = defs.select("file", F.explode_outer("heritage").alias("h"), "line_start").where("h is not null").select(F.lit(3).alias("p"), F.lit("ancestor").alias("part"), "file", F.col("h.target").alias("name"), F.col("line_start").alias("line"))
        rows = d.unionByName(callers_).unionByName(callees_).unionByName(up).distinct()
        rows = rows.withColumn("tokens", (names.token_estimate(F.concat("file", "name")) + 4).cast("long"))
        w = Window.orderBy("p", "file", "line", "name").rowsBetween(Window.unboundedPreceding, 0)  # one symbol's neighbours
        run = rows.withColumn("total", F.sum("tokens").over(w)).withColumn("n", F.count("*").over(w))
        return run.where((F.col("total") <= budget) | (F.col("n") == 1)).orderBy("n").select("part", "file", "name", "line", "tokens")

    def answer(self, question: str, k: int = 20) -> DataFrame:
        """(file, name, hits): definitions whose names contain most words of a question."""
        words = self.spark.range(1).select(names.question_words(F.lit(question)).alias("w")).first()["w"]
        hits = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0))
        return self.entities.groupBy("file", "name").agg(F.max(hits).alias("hits")).where("hits > 0").orderBy(F.col("hits").desc(), "file", "name").limit(k)

    def hotspots(self) -> DataFrame:
        return history.hotspots(self.commits, self.lines.groupBy("file").agg(F.max("line").alias("lines")))

    def review(self, before: Engine) -> DataFrame:
        """Changes since another state of the code base, those of most impact first."""
        changes = diff.shaped(code.classify(code.match_snapshots(before.entities, self.entities)))
        return diff.review_impact(changes, self.rank(), self.blast()).orderBy(F.col("impact").desc(), "file", "name")

    def sql(self, statement: str) -> DataFrame:
        """SQL over the views entities, refs, file_rank and blast."""
        for name, df in (("entities", self.entities), ("refs", self.refs), ("blast", self.blast())):
            df.createOrReplaceTempView(name)
        if "file_rank" in statement:  # iterates, so only if asked for
            self.rank().createOrReplaceTempView("file_rank")
        return self.spark.sql(statement)


def cluster_summary(members: DataFrame) -> DataFrame:
    """(community, files, representative, label) of members(community, file, rank): the representative has the highest
    rank, then the shortest path, then the least; the label is the directory that all files share, or the representative's."""
    best = F.max_by("file", F.struct(F.col("rank"), (-F.length("file")).alias("l"), F.transform(F.split("file", ""), lambda c: -F.ascii(c)).alias("o")))
    out = members.groupBy("community").agg(F.count("*").alias("files"), best.alias("representative"), F.min("file").alias("lo"), F.max("file").alias("hi"))
    # what the least and the greatest path share, all between share
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    alike = F.transform(F.sequence(F.lit(1), F.least(F.size(lo), F.size(hi))), lambda i: F.slice(lo, F.lit(1), i) == F.slice(hi, F.lit(1), i))
    shared = F.least(F.size(F.filter(alike, lambda x: x)), F.size(lo) - 1)
    label = F.array_join(F.slice(lo, F.lit(1), F.greatest(shared, F.lit(0))), "/")
    return out.select("community", "files", "representative", F.when(label == "", F.regexp_extract("representative", "([^/]*)$", 1)).otherwise(label).alias("label"))


class Workspace:
    """Several repositories as one code base."""

    def __init__(self, members: dict[str, Engine], disabled: Iterable[str] = ()):
        self.members, self.disabled = dict(members), set(disabled)

    def enabled(self) -> dict[str, Engine]:
        return {n: m for n, m in self.members.items() if n not in self.disabled}

    def engine(self) -> Engine:
        on = self.enabled()
        return Engine(resolve.workspace({n: m.entities for n, m in on.items()}), resolve.workspace({n: m.refs for n, m in on.items()}, "refs"))

    def cross_repo(self, canonical: DataFrame) -> DataFrame:
        """References into other members by their canonical names."""
        e = self.engine()
        wanted = e.refs.where("kind = 'import'").select("repo", "name")
        return resolve.cross_repo_symbols(wanted, e.entities.select("repo", "file", "name"), canonical)

    def contracts(self, lines: DataFrame) -> DataFrame:
        """Services that one member offers and another uses. lines: (repo, file, line, text)."""
        found = text.contracts(lines.withColumn("file", F.concat_ws("/", "repo", "file")), names.language(F.col("file")))
        return text.contract_links(found.withColumn("repo", F.substring_index("file", "/", 1)))


def diff_texts(spark: SparkSession, file: str, old: str, new: str) -> DataFrame:
    """Classified changes between two states of one file."""
    sides = [structured.scan(spark.createDataFrame([(file, t)], "file string, text string"))[0] for t in (old, new)]
    return diff.shaped(code.classify(code.match_snapshots(*sides)))


def diff_revisions(repos: DataFrame, spec: str, extensions: tuple[str, ...] = ()) -> DataFrame:
    """Classified changes between two revisions of each repository."""
    a, b = git.refs_of(spec)
    sides = [structured.scan(git.snapshot(repos, r, extensions).select(F.concat_ws("/", "repo", "file").alias("file"), "text"))[0] for r in (a, b)]
    return diff.shaped(code.classify(code.match_snapshots(*sides)))
