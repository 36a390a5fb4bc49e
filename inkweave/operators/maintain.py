"""The document graph kept in step with its files by a change log: one fold, one version, one manifest.

``apply_log`` takes the part of a log that comes after the stored watermark, folds it to what each path has become, parses
the paths that are there, and replaces their rows in every table of the graph; what depends on all files (whether a link's
target exists, projects, their hubs and entities, mentions when people change) is derived again from the tables.  The new
version becomes visible with its manifest, which also holds the watermark, so a run that breaks off changes nothing and
the next one starts where the last whole one ended.

Order inside a run: renames and deletions take rows out, people come first, then all changed files, then projects and
hubs.  A rename is a deletion of the old path and a new file at the new one, since titles and relative links depend on
where a file lies.  Links are stored as the files say them and tested against the files that exist when they are read: a
deleted target turns links into broken ones, a new one mends them, without looking at the files that link to it.  So
any split of a log gives the same tables as one run over all of it, and as a build from nothing.

Defined results: other operations than A, M, D and R do not count; of several entries with one number the greatest path
and operation last; a changed file that the corpus does not have is gone; one with a null text goes to ``quarantine`` and
to no other table; a repeated path of the corpus gives one of its texts (the greatest).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.scalars import entity_of, updated
from inkweave.operators.graph import entity_majority
from inkweave.sources import markdown
from inkweave.sources.snapshot import Snapshot

# Where files of people lie, where a project's own hub lies, and the name of a log of decisions.
PEOPLE, HUBS, LOG = "memory/people/", "memory/projects/", "decisions-log.md"


def _is_person() -> Column:
    return F.col("path").startswith(PEOPLE)


def _is_log() -> Column:
    return F.col("path").rlike(rf"(^|/){LOG}$")


def entries(log: DataFrame) -> DataFrame:
    """n, path, there (else gone) of each path that an entry of a log (n, op, path, old_path) names; an R has both paths."""
    renamed = F.when(F.col("op") == "R", F.col("old_path"))
    pairs = F.stack(F.lit(2), F.col("path"), F.col("op") != "D", renamed, F.lit(False)).alias("path", "there")
    return log.filter("op in ('A', 'M', 'D', 'R')").select("n", pairs).filter("path is not null")


def fold(log: DataFrame) -> DataFrame:
    """path, op (M: there, D: gone) of each path that a log names, after all of it.

    Two maxima instead of the greatest entry: numbers are aggregated by hash, where entries would be sorted first.
    """
    n, there = F.col("n"), F.col("there")
    last = entries(log).groupBy("path").agg(F.bool_or(there).alias("any"), F.max(F.when(there, n)).alias("m"), F.max(F.when(~there, n)).alias("d"))
    return last.select("path", F.when(F.col("any") & (F.col("d").isNull() | F.coalesce(F.col("m") >= F.col("d"), F.lit(False))), "M").otherwise("D").alias("op"))


class Graph:
    """The tables of one version, with the columns that the graph's queries take."""

    def __init__(self, version: Snapshot) -> None:
        self.version = version

    @staticmethod
    def latest(spark: SparkSession, root: str) -> Graph:
        return Graph(Snapshot.latest(spark, root))

    def __getattr__(self, name: str) -> DataFrame:
        return self.version.read(name)

    @property
    def files(self) -> DataFrame:
        """path of everything that exists."""
        return self.doc.select("path").unionByName(self.other.select("path")).unionByName(self.quarantine.select("path"))

    def _found(self, links: DataFrame, there: bool) -> DataFrame:
        return links.join(self.files.select(F.col("path").alias("resolved")).distinct(), "resolved", "left_semi" if there else "left_anti")

    @property
    def edge(self) -> DataFrame:
        row = lambda d, *c: d.select(*(x.alias(n) for x, n in zip(c, ("source_type", "source_id", "edge_type", "target_type", "target_id", "edge_subtype"), strict=True)))
        lit, col = F.lit, F.col
        out = self.own_edge.drop("path")
        out = out.unionByName(row(self._found(self.link, True).select("path", "resolved").distinct(), lit("doc"), col("path"), lit("LINKS_TO"), lit("doc"), col("resolved"), lit("")))
        out = out.unionByName(row(self.mention, lit("doc"), col("path"), lit("MENTIONS"), lit("person"), col("slug"), lit("")))
        out = out.unionByName(row(self._found(self.about, True).select("id", "resolved").distinct(), lit("decision"), col("id"), lit("ABOUT_DECISION"), lit("doc"), col("resolved"), lit("")))
        return out.unionByName(row(self.project.filter("entity is not null"), lit("project"), col("slug"), lit("MEMBER_OF_ENTITY"), lit("entity"), col("entity"), lit("")))

    @property
    def broken_link(self) -> DataFrame:
        return self._found(self.link, False).select(F.col("path").alias("source_doc"), "link_text", "link_target").distinct()


def projects(doc: DataFrame, own_edge: DataFrame) -> DataFrame:
    """slug, hub_doc, is_ghost, entity of each project that a document names.

    A hub has the tag project/<slug> and the type hub; its own place, then the smallest path, comes first.
    """
    slugs = own_edge.filter("edge_type = 'MEMBER_OF_PROJECT'").select(F.col("target_id").alias("slug")).distinct()
    tagged = own_edge.filter("edge_type = 'TAGGED' and target_id like 'project/%'").select(F.col("source_id").alias("path"), F.substring("target_id", 9, 1 << 30).alias("slug"))
    order = F.struct(F.col("path") != F.concat(F.lit(HUBS), "slug", F.lit(".md")), F.col("path"))
    hubs = tagged.join(doc.filter("doc_type = 'hub'").select("path"), "path").groupBy("slug").agg(F.min(order)["path"].alias("hub_doc"))
    entity = entity_majority(own_edge).select("slug", "entity")
    return slugs.join(hubs, "slug", "left").join(entity, "slug", "left").select("slug", "hub_doc", F.col("hub_doc").isNull().alias("is_ghost"), "entity")


def _parsed_tables(parsed: DataFrame, entities: dict[str, str]) -> dict[str, DataFrame]:
    slug = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    log = parsed.filter(_is_log())
    entity = entity_of(F.col("path"), entities)
    return {
        "doc": parsed.select("path", "title", "status", "doc_type", "word_count", F.size("links").alias("link_count"), "parse_status", "parse_notes"),
        "body": parsed.select("path", "body"),
        "own_edge": markdown.own_edges(parsed, entity).withColumn("path", F.col("source_id")),
        "link": markdown.inner_links(parsed),
        "person": parsed.filter(_is_person()).select("path", slug.alias("slug"), "display_name", "role", "aliases"),
        "decision": markdown.decisions(log).withColumn("path", F.col("log_doc")),
        "about": markdown.decision_targets(log),
    }


def apply_log(spark: SparkSession, root: str, log: DataFrame, corpus: DataFrame, entities: dict[str, str] | None = None, only: Column | None = None, buckets: int = 64) -> Graph:
    """The graph under ``root`` after the entries of log (n, op, path, old_path) beyond the stored watermark.

    corpus: path, text of the files as they are now; only touched paths are read from it, so a reader of these alone will
    do.  entities: entity by path prefix.  only: a condition on path; such a run takes in the files it holds for, deletes
    nothing, and leaves the watermark where it was.  buckets: of each table, when the first run makes it.
    """
    old = Snapshot.latest(spark, root)
    fresh = log.filter(F.col("n") > F.lit(old.facts.get("applied", -1)))
    upto = fresh.agg(F.max("n")).first()[0]
    if upto is None:
        return Graph(old)
    new = old.next()
    staged = f"{root}/staged/v={new.version}"

    def stage(name: str, df: DataFrame) -> DataFrame:
        """Written once for this run, so that every table sees the same rows."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{staged}/{name}")
        return spark.read.schema(df.schema).parquet(f"{staged}/{name}")

    final = fold(fresh)
    touched = stage("touched", final.filter(only & (F.col("op") == "M")) if only is not None else final)
    there = touched.filter("op = 'M'").select("path")
    texts = corpus.select("path", "text").join(there.filter(updated(F.col("path"))), "path", "left_semi").groupBy("path").agg(F.max("text").alias("text"))
    texts = stage("texts", texts)
    parsed = stage("parsed", markdown.parse(texts.filter("text is not null")))
    rows = _parsed_tables(parsed, entities or {}) | {
        "other": there.filter(~updated(F.col("path"))),
        "quarantine": texts.filter("text is null").select("path", F.lit("no text").alias("error")),
    }
    # Most tables are about every path; a table that can have rows of few paths is written only where these lie.
    some = {"person": _is_person(), "decision": _is_log(), "about": _is_log(), "other": ~updated(F.col("path"))}
    hit = new.touched("path", touched, {name: some.get(name, F.lit(True)) for name in (*rows, "mention")}, buckets)
    people = bool(hit["person"])
    # The tables do not depend on one another; their small jobs run side by side.
    with ThreadPoolExecutor(len(rows)) as pool:
        list(pool.map(lambda name: new.replace(name, "path", touched, rows[name], buckets, hit[name]), rows))
    # A changed person may be named in any file; otherwise only the changed files can have other mentions.
    body = new.read("body")
    found = markdown.mentions(body if people else parsed, new.read("person").select("slug", "display_name"))
    mention = body.select("path").unionByName(touched.select("path")) if people else touched
    new.replace("mention", "path", mention, found, buckets, None if people else hit["mention"])
    derived = projects(new.read("doc"), new.read("own_edge"))
    gone = new.read("project").select("slug").unionByName(derived.select("slug")) if "project" in new.tables else derived
    new.replace("project", "slug", gone, derived, buckets)
    if only is None:
        new.facts["applied"] = upto
    new.commit()
    return Graph(new)
