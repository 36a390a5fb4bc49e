"""A folder of markdown files as a DataFrame, and what its files say: front matter, tags, links, related blocks, decisions.

Only the YAML block needs Python (an Arrow-batched function); everything else is column expressions over one frame.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.scalars import display_name, normal_path, slugify, word_count

# Folders that a walk leaves out.
SKIPPED_DIRS = {".git", ".obsidian", "_archive", "node_modules", ".venv", "__pycache__"}
SKIPPED_NAME = ".projects"
# Formats of links, related blocks and decision entries.
LINK = r"""\[([^\]]+)\]\(([^\s)]+)(?:\s+"[^"]*"|\s+'[^']*')?\)"""
RELATED = r"(?m)^>\s*\*\*(Related hubs?|Siblings?|Downstream|Upstream):\*\*\s*(.+?)\s*$"
DECISION = r"(?m)^###\s+(\d{4}-\d{2}-\d{2})\s+—\s+(.+?)\s*$"
REQUIRED_FIELDS = ("Decision", "Why", "Alternatives considered", "Source / context")
RELATED_EDGES = {
    "Related hub": ("RELATED_TO", "parent_hub"),
    "Related hubs": ("RELATED_TO", "parent_hub"),
    "Sibling": ("RELATED_TO", "sibling"),
    "Siblings": ("RELATED_TO", "sibling"),
    "Downstream": ("BLOCKS", "downstream"),
    "Upstream": ("BLOCKS", "upstream"),
}


def walk(root: str) -> Iterator[str]:
    """Relative paths of the .md files under root, sorted by folder; linked folders are not followed."""
    for folder, dirs, files in os.walk(root, onerror=None, followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS and d != SKIPPED_NAME)
        for name in sorted(files):
            if name.endswith(".md"):
                yield os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """path, text of a folder that every executor can read; the listing is explicit since Spark's readers drop names with ``_``."""
    paths = spark.createDataFrame([(p,) for p in walk(root)], "path string")

    def run(batches):
        for b in batches:
            texts = []
            for p in b["path"]:
                with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield pd.DataFrame({"path": b["path"], "text": texts})

    return paths.mapInPandas(run, "path string, text string")


def _front_matter(blocks: pd.Series) -> pd.DataFrame:
    import yaml

    listed = lambda found: [str(t) for t in found if t is not None] if isinstance(found, list) else [] if found is None else [str(found)]
    plain = lambda v: None if v is None or v == "" else str(v)

    # Files of one kind begin alike: each block of a batch is read once.
    number, blocks = pd.factorize(blocks.fillna(""))
    out = []
    for block in blocks:
        data, note = {}, None
        if block:
            try:
                data = yaml.safe_load(block)
            except (yaml.YAMLError, ValueError) as e:  # a date that is none is a ValueError
                note = str(e)[:200]
        data = data if isinstance(data, dict) else {}
        out.append((listed(data.get("tags")), note, plain(data.get("display_name")) or plain(data.get("name")), plain(data.get("role")), listed(data.get("aliases"))))
    return pd.DataFrame(out, columns=["tags", "note", "name", "role", "aliases"]).iloc[number].reset_index(drop=True)


def parse(corpus: DataFrame) -> DataFrame:
    """path, title, status, doc_type, projects, tags, word_count, parse_status, parse_notes, body, links, related, and what a
    person's file says: display_name, role, aliases."""
    block = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    front = F.pandas_udf(_front_matter, "tags array<string>, note string, name string, role string, aliases array<string>")
    d = corpus.select("path", block.alias("block"), F.trim(F.regexp_replace("text", r"(?s)\A---\n.*?\n---[ \t]*(?:\n|\z)", "")).alias("body"))
    d = d.select("path", "body", front("block").alias("f")).select("path", "body", "f.*")
    axis = lambda name: F.transform(F.filter("tags", lambda t: t.startswith(f"{name}/")), lambda t: F.substring_index(F.substr(t, F.lit(len(name) + 2)), "/", 1) if name == "project" else F.substr(t, F.lit(len(name) + 2)))
    plain = F.regexp_replace("body", RELATED, "")
    pairs = lambda text: F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("target"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return d.select(
        "path",
        F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"(?m)^# (.*)$", 1)), F.lit("")), stem).alias("title"),
        F.get(axis("status"), 0).alias("status"),
        F.get(axis("type"), 0).alias("doc_type"),
        axis("project").alias("projects"),
        "tags",
        word_count(F.col("body")).alias("word_count"),
        F.when(F.col("note").isNull(), "ok").otherwise("partial").alias("parse_status"),
        F.col("note").alias("parse_notes"),
        "body",
        pairs(plain).alias("links"),
        F.arrays_zip(F.regexp_extract_all("body", F.lit(RELATED), F.lit(1)).alias("label"), F.regexp_extract_all("body", F.lit(RELATED), F.lit(2)).alias("line")).alias("related"),
        display_name(F.lit(None).cast("string"), F.col("name"), stem).alias("display_name"),
        "role",
        "aliases",
    )


def resolve(path: Column, target: Column) -> Column:
    """A link's target as a path from the root; null for external links and anchors."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    bare = F.substring_index(target, "#", 1)
    return F.when(~target.rlike(r"^(https?://|mailto:)") & (bare != ""), normal_path(F.concat(folder, bare)))


def inner_links(parsed: DataFrame) -> DataFrame:
    """path, link_text, link_target, resolved of each link that is neither external nor an anchor: what a file says, whatever exists."""
    e = parsed.select("path", F.explode("links").alias("l"))
    return e.select("path", F.col("l.text").alias("link_text"), F.col("l.target").alias("link_target"), resolve(F.col("path"), F.col("l.target")).alias("resolved")).filter("resolved is not null")


def links(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """path, link_text, link_target, resolved, broken of each inner link.  files: path of everything under the root."""
    there = files.select(F.col("path").alias("resolved"), F.lit(True).alias("there")).distinct()
    return inner_links(parsed).join(there, "resolved", "left").select("path", "link_text", "link_target", "resolved", F.col("there").isNull().alias("broken"))


def _edge(kind: Column | str, to: Column | str, target: Column, sub: Column | str = "") -> tuple[Column, ...]:
    return F.lit("doc").alias("source_type"), F.col("path").alias("source_id"), F.lit(kind).alias("edge_type"), F.lit(to).alias("target_type"), target.alias("target_id"), F.lit(sub).alias("edge_subtype")


def own_edges(parsed: DataFrame, entity: Column | None = None) -> DataFrame:
    """The edges that follow from a file alone, each once: tags, projects, related blocks and, with ``entity``, its entity."""
    one = lambda kind, to, x: F.struct(F.lit(kind).alias("kind"), F.lit(to).alias("to"), x.alias("x"))
    said = [F.transform("tags", lambda x: one("TAGGED", "tag", x)), F.transform("projects", lambda x: one("MEMBER_OF_PROJECT", "project", x))]
    if entity is not None:
        said.append(F.when(entity.isNotNull(), F.array(one("MEMBER_OF_ENTITY", "entity", entity))).otherwise(F.array()))
    # Each file is read once for all that it says.
    said = [F.coalesce(x, F.array()) for x in said]
    out = parsed.select("path", F.explode(F.concat(*said)).alias("e")).select(*_edge(F.col("e.kind"), F.col("e.to"), F.col("e.x")))
    named = parsed.select("path", F.explode("related").alias("r")).select("path", F.col("r.label").alias("label"), F.explode(F.regexp_extract_all(F.col("r.line"), F.lit(LINK), F.lit(2))).alias("t")).select("path", "label", resolve(F.col("path"), F.col("t")).alias("x")).filter("x is not null")
    means = F.create_map(*(x for label, (kind, sub) in RELATED_EDGES.items() for x in (F.lit(label), F.struct(F.lit(kind).alias("kind"), F.lit(sub).alias("sub")))))
    named = named.withColumn("m", F.try_element_at(means, F.col("label"))).filter("m is not null")
    return out.unionByName(named.select(*_edge(F.col("m.kind"), F.lit("doc"), F.col("x"), F.col("m.sub")))).distinct()


def edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """The typed edges of parsed files, each once."""
    return own_edges(parsed).unionByName(links(parsed, files).filter("not broken").select(*_edge("LINKS_TO", "doc", F.col("resolved"))).distinct())


def _entries(parsed: DataFrame) -> DataFrame:
    """path, entry, id of each decision entry; an entry ends at the next heading of its level."""
    e = parsed.select("path", F.explode(F.split("body", r"(?m)(?=^###\s)")).alias("entry")).filter(F.col("entry").rlike(DECISION))
    date, title = F.regexp_extract("entry", DECISION, 1), F.regexp_extract("entry", DECISION, 2)
    return e.select("path", "entry", F.concat_ws("-", date, slugify(title)).alias("id"), date.alias("date"), title.alias("title"))


def decisions(parsed: DataFrame) -> DataFrame:
    """id, date, title, log_doc, parse_status, missing of each decision entry."""
    named = F.regexp_extract_all("entry", F.lit(r"(?m)^\*\*([A-Z][^*]+):\*\*"), F.lit(1))
    missing = F.array_sort(F.array_except(F.array(*(F.lit(f) for f in REQUIRED_FIELDS)), named))
    return _entries(parsed).select("id", "date", "title", F.col("path").alias("log_doc"), F.when(F.size(missing) == 0, "ok").otherwise("format_drift").alias("parse_status"), missing.alias("missing"))


def decision_targets(parsed: DataFrame) -> DataFrame:
    """path, id, resolved: what the entries link to, each once, whatever exists."""
    e = _entries(parsed).select("path", "id", F.explode(F.regexp_extract_all("entry", F.lit(LINK), F.lit(2))).alias("t"))
    return e.select("path", "id", resolve(F.col("path"), F.col("t")).alias("resolved")).filter("resolved is not null").distinct()


def mentions(parsed: DataFrame, people: DataFrame) -> DataFrame:
    """path, slug, context: the people (slug, display_name) whose whole name a body has, ASCII and other case ignored, and
    the 40 characters on both sides of its last place, without line breaks, 120 characters at most.

    A name's words are looked up among the words of the bodies: words join names on the first one and carry as many
    neighbours as the longest name has, so the work follows the length of the texts, not texts times names.  What
    remains is tested for the exact name.  A name without letters and digits matches nothing.
    """
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))
    names = people.filter("display_name is not null").select("slug", "display_name", words(F.col("display_name")).alias("n")).filter("size(n) > 0").distinct()
    longest = names.agg(F.max(F.size("n"))).first()[0]
    if longest is None:
        return parsed.sparkSession.createDataFrame([], "path string, slug string, context string")
    w = parsed.select("path", words(F.col("body")).alias("w")).filter("size(w) > 0").select("path", F.explode(F.array("w")).alias("w"))
    at = w.select("path", F.explode(F.transform("w", lambda _, i: F.slice("w", i + 1, longest))).alias("next"))
    hit = at.withColumn("first", F.get("next", 0)).join(names.withColumn("first", F.get("n", 0)), "first").filter(F.slice("next", F.lit(1), F.size("n")) == F.col("n"))
    found = hit.select("path", "slug", "display_name").distinct().join(parsed.select("path", "body"), "path")
    name = F.concat(F.lit(r"\b\Q"), "display_name", F.lit(r"\E\b"))
    before = F.length(F.call_function("regexp_extract", F.col("body"), F.concat(F.lit("(?isU)^(.*)"), name), F.lit(1)))
    begin = F.greatest(before - 40, F.lit(0))
    context = F.regexp_replace(F.substring("body", begin + 1, before + F.length("display_name") + 40 - begin), "\n", " ")
    return found.filter(F.regexp_like("body", F.concat(F.lit("(?iU)"), name))).select("path", "slug", F.substring(context, 1, 120).alias("context"))
