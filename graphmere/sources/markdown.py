"""Markdown pages with front matter as rows."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from graphmere.functions import ranking as R
from graphmere.functions import text as T
from graphmere.operators.joins import spread_join
from graphmere.operators.orphans import composed
from graphmere.operators.times import epoch_seconds

# Build folders that are never indexed, and the keys of page headers.
SKIPPED = ("node_modules", "dist", "build", "vendor", "target")
SCALARS = ("title", "type", "trust", "description", "resource", "source", "authored", "created", "updated", "as_of", "superseded_by", "valid_until")
LISTS = ("tags", "aliases", "sources", "people")
FLAGS = ("volatile", "forgotten")

EDGES = "array<struct<type:string,target:string,weight:double>>"
_TEXT, _LIST = T_.StringType(), T_.ArrayType(T_.StringType())
_EDGE = T_.StructType([T_.StructField("type", _TEXT), T_.StructField("target", _TEXT), T_.StructField("weight", T_.DoubleType())])
_KINDS = [*((k, _TEXT) for k in SCALARS), *((k, _LIST) for k in LISTS), *((k, T_.BooleanType()) for k in FLAGS), ("edges", T_.ArrayType(_EDGE)), ("fine", T_.BooleanType())]
HEADER = T_.StructType([T_.StructField(k, t) for k, t in _KINDS])


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, modified): the ``.md`` files below ``folder``, without hidden, index and summary files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    path = F.substring_index(F.col("path"), root + "/", -1)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    return kept.filter(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")) & (name != "index.md") & ~name.endswith(".summary.md"))


def out_of_scope(path: Column, globs: tuple[str, ...] = ()) -> Column:
    """Whether a path lies in a build folder or matches one of the ``globs`` (* within a folder, ** across)."""
    hit = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))
    for g in globs:
        pattern = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, _escape(p)) for p in _parts(g))
        hit = hit | path.rlike(f"^{pattern}$")
    return hit


def _parts(g: str) -> list[str]:
    return re.findall(r"\*\*|\*|\?|[^*?]+", g)


def _escape(s: str) -> str:
    return re.escape(s)


def header_and_body(text: Column) -> tuple[Column, Column]:
    """The header between the fences, null if there is none, and what follows it or the whole text.

    Byte-order mark and CRLF are normalised first. A text that doesn't begin with a fence line, or has no
    closing one, is all body.
    """
    t = F.regexp_replace(F.regexp_replace(text, r"^\x{feff}", ""), r"\r\n", "\n")
    fence = r"(?s)\A---\n(?:(.*?)\n)?---(?:\n(.*))?\z"
    has = t.startswith("---\n") & t.rlike(fence)
    return F.when(has, F.regexp_extract(t, fence, 1)), F.when(has, F.regexp_extract(t, fence, 2)).otherwise(t)


def _loader():
    """A YAML 1.2 core loader: only true and false are booleans, dates are strings, keys are unique."""
    import yaml

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def check_printable(self, data):
            pass

        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, True) for k, _ in node.value]
            if len({str(k) for k in keys}) < len(keys):
                raise yaml.YAMLError("a key occurs twice")
            return super().construct_mapping(node, deep)

    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")),
        ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789.")),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    whole = lambda v: int(v, 0) if v[:2] in ("0x", "0o") else int(v)
    Core.add_constructor("tag:yaml.org,2002:int", lambda self, node: whole(self.construct_scalar(node)))
    # These separate lines only outside YAML 1.2.
    odd = {0x85: "\ue085", 0x2028: "\ue028", 0x2029: "\ue029"}
    return lambda text: yaml.load(text.translate(odd), Core), {ord(v): chr(k) for k, v in odd.items()}


def _plain(header: str) -> dict:
    """Where no YAML library is installed: scalars and inline lists without quotes, as they stand."""
    out = {}
    for line in header.split("\n"):
        key, colon, v = line.partition(":")
        v = v.strip()
        if colon and v and key == key.strip():
            out[key] = [x.strip() for x in v[1:-1].split(",")] if v[0] + v[-1] == "[]" else {"true": True, "false": False}.get(v, v)
    return out


def _said(v) -> str | None:
    """A value as text: booleans and whole numbers as they are written in JSON."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return ",".join(_said(x) or "" for x in v)
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _fields(data: dict) -> dict:
    row = {k: _said(data.get(k)) for k in SCALARS}
    row |= {k: [_said(x) or "null" for x in v] if isinstance(v := data.get(k), list) else [] for k in LISTS}
    row |= {k: data.get(k) is True for k in FLAGS}
    edges = [e for e in data.get("edges") or [] if isinstance(e, dict) and e.get("target")] if isinstance(data.get("edges"), list) else []
    number = lambda w: float(w) if isinstance(w, (int, float)) and not isinstance(w, bool) else None
    kind = lambda e: "related_to" if e.get("type") is None else _said(e["type"])
    row["edges"] = [{"type": kind(e), "target": _said(e["target"]), "weight": number(e.get("weight"))} for e in edges]
    return row


@F.pandas_udf(HEADER)
def _parsed(headers: pd.Series) -> pd.DataFrame:
    """The known keys of each header; ``fine`` is false where it is no mapping in YAML."""
    try:
        load, back = _loader()
    except ImportError:
        load, back = _plain, {}
    rows = []
    for h in headers:
        data = None if h is None else {}
        if h is not None:
            try:
                data = load(h)
                data = {} if data is None else data
            except Exception:
                data = None
        row = _fields(data if isinstance(data, dict) else {}) | {"fine": isinstance(data, dict)}
        turn = lambda v: v.translate(back) if isinstance(v, str) else [turn(x) for x in v] if isinstance(v, list) else {k: turn(x) for k, x in v.items()} if isinstance(v, dict) else v  # noqa: B023, E731
        rows.append({k: turn(v) for k, v in row.items()})
    return pd.DataFrame(rows, columns=[f.name for f in HEADER])


def front_matter(pages: DataFrame) -> DataFrame:
    """``pages`` (text, ...) with the columns of HEADER and ``body`` for ``text``.

    Only headers go through Python, in Arrow batches; bodies stay in the JVM. A header that is malformed, or no
    mapping, leaves the page without one: the whole text is its body. A text without header has no keys.
    """
    header, body = header_and_body(F.col("text"))
    rows = pages.withColumn("_h", header).withColumn("_p", F.when(F.col("_h").isNotNull(), _parsed("_h")))
    rows = rows.withColumn("body", F.when(F.coalesce(F.col("_p.fine"), F.lit(False)), body).otherwise(F.regexp_replace(F.regexp_replace("text", r"^\x{feff}", ""), r"\r\n", "\n")))
    lists = {f.name: F.coalesce(F.col(f"_p.{f.name}"), F.array().cast(f.dataType)) for f in HEADER if f.dataType.typeName() == "array"}
    flags = {k: F.coalesce(F.col(f"_p.{k}"), F.lit(False)) for k in FLAGS}
    return rows.withColumns({k: F.col(f"_p.{k}") for k in SCALARS} | lists | flags).drop("_h", "_p", "text")


def items(pages: DataFrame) -> DataFrame:
    """Rows of pages (path, text) with title, type, trust, lifecycle, provenance, edges and body; null paths are dropped.

    The title falls back to the file's name, trust to the zone: untrusted where it is incoming. ``freshness``
    is as_of, else updated; it and ``authored`` are seconds since 1970, null where they are no time.
    """
    rows = pages.filter("path is not null and text is not null").withColumn("text", F.regexp_replace("text", r"\x00", ""))
    rows = front_matter(rows).withColumn("id", F.regexp_replace("path", r"\.md$", ""))
    name = F.element_at(F.split("id", "/"), -1)
    trust = F.coalesce("trust", F.when(R.zone(F.col("path")) == "incoming", "untrusted").otherwise("trusted"))
    rows = rows.withColumns({
        "title": F.coalesce("title", name), "trust": trust, "freshness": epoch_seconds(F.coalesce("as_of", "updated")), "authored": epoch_seconds(F.col("authored")),
        "tombstoned": F.col("forgotten") | F.col("superseded_by").isNotNull(),
    })
    return with_all_edges(rows)


def with_all_edges(pages: DataFrame) -> DataFrame:
    """``pages`` with the edge list of each: explicit ``edges`` first, then ``sources`` (cites), ``people``
    (mentions) and the links in ``body``, as far as there are such columns.

    Of edges with one target and types that are the same when normalised the first stays, as it is spelled.
    """
    col = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)) if c in pages.columns else F.array().cast(kind)
    clean = lambda c: F.transform(col(c, "array<string>"), lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"\[\[([^\]|#]+)", 1)), r"\.md$", ""))
    tag = lambda k, c: F.transform(F.filter(c, lambda t: t != ""), lambda t: F.struct(F.lit(k).alias("type"), t.alias("target"), F.lit(None).cast("double").alias("weight")))
    every = F.concat(col("edges", EDGES), tag("cites", clean("sources")), tag("mentions", clean("people")), tag("related-to", T.wikilinks(F.coalesce("body", F.lit("")))))
    key = lambda e, i: F.struct(F.concat(T.relation(e.type), F.lit("\0"), e.target).alias("k"), i.alias("i"), e.alias("e"))
    # Columns of their own, so that neither the links nor the sorted list are worked out once for each edge.
    rows = pages.withColumn("_s", F.sort_array(F.transform(every, key)))
    first = F.filter("_s", lambda x, j: (j == 0) | (F.get("_s", j - 1).k != x.k))
    rows = rows.withColumn("_f", first).drop("_s")
    order = F.sort_array(F.transform("_f", lambda x: F.struct(x.i.alias("i"), x.e.alias("e"))))
    return rows.withColumn("edges", F.transform(order, lambda x: x.e)).drop("_f")


def link_edges(pages: DataFrame) -> DataFrame:
    """(id, pos, type, target, weight): the edge list of each page (id, body, ...) as rows."""
    return with_all_edges(pages).select("id", F.posexplode("edges").alias("pos", "e")).select("id", "pos", "e.type", "e.target", "e.weight")


def basename_map(pages: DataFrame) -> DataFrame:
    """(name, page): the id that ends in a name, null where several do."""
    named = pages.select(F.element_at(F.split("id", "/"), -1).alias("name"), "id").distinct()
    return named.groupBy("name").agg(F.when(F.count("*") == 1, F.min("id")).alias("page"))


def alias_map(entities: DataFrame) -> DataFrame:
    """(alias, page): the page with an alias, null where several have it; aliases with a folder don't count."""
    rows = entities.select("id", F.explode("aliases").alias("alias")).filter("alias is not null and not contains(alias, '/')").distinct()
    return rows.groupBy("alias").agg(F.when(F.count("*") == 1, F.min("id")).alias("entity"))


def resolve_targets(edges: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with ``resolved``: a target with a folder stays; a known name gives its page, or stays if it is
    ambiguous, which also blocks the aliases; else an unambiguous alias gives its page.

    Both maps become one, and only targets without a folder are looked up, spread where one is frequent.
    """
    shadowed = aliases.join(names.select(F.col("name").alias("alias")), "alias", "left_anti")
    known = names.select(F.col("name").alias("target"), "page").unionByName(shadowed.select(F.col("alias").alias("target"), F.col("entity").alias("page")))
    whole = F.coalesce(F.contains("target", F.lit("/")), F.lit(True))
    bare = spread_join(edges.filter(~whole), known.filter("page is not null"), "target")
    return edges.filter(whole).withColumn("resolved", F.col("target")).unionByName(bare.withColumn("resolved", F.coalesce("page", "target")).drop("page"))


def page_aliases(rows: DataFrame) -> DataFrame:
    """(id, aliases) of items, trimmed and without an ending .md, for :func:`alias_map`."""
    clean = F.filter(F.transform("aliases", lambda a: F.regexp_replace(F.trim(a), r"\.md$", "")), lambda a: a != "")
    return rows.select("id", clean.alias("aliases"))


def resolved_items(pages: DataFrame, globs: tuple[str, ...] = ()) -> DataFrame:
    """The items of pages (path, text) in scope with their edge targets resolved, tombstoned ones too.

    Names and aliases come from the same pages, so a target may be any of them.
    """
    rows = items(pages.filter("path is not null").filter(~out_of_scope(F.col("path"), globs)))
    every = rows.select("id", F.posexplode("edges").alias("pos", "e")).select("id", "pos", "e.*")
    found = resolve_targets(every, basename_map(rows), alias_map(page_aliases(rows)))
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", F.col("resolved").alias("target"), "weight"))).alias("l"))
    lists = lists.select("id", F.transform("l", lambda x: F.struct(x.type.alias("type"), x.target.alias("target"), x.weight.alias("weight"))).alias("edges"))
    return rows.drop("edges").join(lists, "id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(EDGES)))


def scan_first(pages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pages by path: a bounded read for a trial run, which never prunes."""
    return pages.orderBy("path").limit(most)


def newer_than(spark: SparkSession, folder: str, when) -> bool:
    """Whether a file below ``folder`` was modified after ``when``; only the listing is read, up to the first hit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return bool(files.filter(F.col("modificationTime") > F.lit(when)).select("path").take(1))


def generation_path(path: Column) -> Column:
    """A path as it takes part in fingerprints: forward slashes, no leading ./, composed Unicode."""
    return composed(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""))


def tree(pages: DataFrame, folder: str = "") -> DataFrame:
    """(kind, name, path, zone): one level below ``folder``, folders with their zone and pages, without dot names."""
    root = folder.strip("/") + "/" if folder.strip("/") else ""
    rows = pages.filter(F.col("path").startswith(root)).select(F.split(F.substring("path", len(root) + 1, 1 << 30), "/").alias("p"))
    rows = rows.filter(~F.exists("p", lambda x: x.startswith(".")) & (F.size("p") > 0))
    name = F.col("p")[0]
    kind = F.when(F.size("p") > 1, "folder").otherwise("page")
    rows = rows.select(kind.alias("kind"), name.alias("name")).filter("kind = 'folder' or name like '%.md'").distinct()
    full = F.concat(F.lit(root), "name")
    return rows.select("kind", "name", full.alias("path"), F.when(F.col("kind") == "folder", R.zone(F.concat(full, F.lit("/x")))).alias("zone"))
