"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the letters they fold to, by their Unicode decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]) and chr(code) == chr(code).lower():
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _folding()
# The patterns below for tokens, escapes, slugs and links.
TOKEN = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics on Latin letters."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[\x{300}-\x{36f}]", "")


def index_tokens(text: Column) -> Column:
    """All tokens of an indexed field; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def query_tokens(text: Column) -> Column:
    """Tokens of a query in order, with repeats; those of one character are dropped."""
    return F.filter(index_tokens(text), lambda t: F.length(t) >= 2)


def match_expression(text: Column) -> Column:
    """Quoted ASCII terms of two characters and more, joined with OR; empty if there are none."""
    terms = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def ascii_terms(text: Column) -> Column:
    """Lower-case ASCII words of two characters and more, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def any_of(text: Column) -> Column:
    """The same as an expression of a text-search engine that joins terms with |; empty if there are none."""
    return F.array_join(ascii_terms(text), " | ")


def optional_text(text: Column) -> Column:
    """Text, null if it is empty."""
    return F.nullif(text, F.lit(""))


def listed(text: Column) -> Column:
    """The parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def counted(value: Column, default: int, most: int) -> Column:
    """A positive number up to ``most``, else ``default``."""
    n = value.try_cast("double")
    return F.when(n > 0, F.least(n, F.lit(float(most)))).otherwise(float(default)).cast("int")


def sanitize(text: Column, limit: int | None = None) -> Column:
    """Terminal escapes and control characters removed, line ends unified; cut to ``limit`` characters if given."""
    s = F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*(\x07|\x1b\\)|\x1b", "")
    s = F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    s = F.regexp_replace(s, r"\r\n?", "\n")
    return s if limit is None else F.substring(s, 1, limit)


def slug(title: Column) -> Column:
    """File-name form of a title: at most 60 characters, 'item' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 60), F.lit("")), F.lit("item"))


def memory_id(title: Column, body: Column, folder: str = "out_memory", width: int = 6) -> Column:
    """Stable id of a new memory: folder, slug and the start of a content hash."""
    digest = F.substring(F.sha2(F.concat(title, F.lit("\n"), body), 256), 1, width)
    return F.concat(F.lit(folder + "/"), slug(title), F.lit("-"), digest)


def memory_ids(new: DataFrame, existing: DataFrame, folder: str = "out_memory") -> DataFrame:
    """(title, body, id) of new memories (title, body), each distinct one once; null counts as empty.

    An id ends in six digits of the content's hash, or in more, by steps of four up to all 64, as long as it is
    taken: by a memory of another content in ``existing`` (id, title, body), or by one in ``new`` whose hash is lower.
    """
    widths = [*range(6, 64, 4), 64]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = lambda: F.sha2(F.concat(text("title"), F.lit("\n"), text("body")), 256)
    rows = new.select("title", "body").withColumn("h", digest()).groupBy("h").agg(F.min(F.struct("title", "body")).alias("c")).select("h", "c.*")
    each = rows.select("h", slug(text("title")).alias("s"), F.explode(F.array(*map(F.lit, widths))).alias("w"))
    each = each.select("h", "w", F.concat(F.lit(folder + "/"), "s", F.lit("-"), F.substring("h", F.lit(1), F.col("w"))).alias("id"))
    taken = existing.select("id", digest().alias("t"))
    each = each.join(taken, "id", "left").groupBy("id", "h", "w").agg(F.max((F.col("t") != F.col("h")).cast("int")).alias("x"))
    first = each.groupBy("id").agg(F.min("h").alias("first"))
    free = each.join(first, "id").filter("coalesce(x, 0) = 0 and h = first")
    return rows.join(free.groupBy("h").agg(F.min_by("id", "w").alias("id")), "h").select("title", "body", "id")


def relation(kind: Column) -> Column:
    """Comparable spelling of a relation type."""
    return F.translate(F.lower(F.trim(kind)), "_", "-")


def preview(text: Column, limit: int = 240) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)


def label(title: Column, ident: Column, limit: int = 48) -> Column:
    return F.substring(F.coalesce(F.nullif(title, F.lit("")), ident), 1, limit)


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target#part|alias]]`` in order, with repeats, without an ending ``.md``."""
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#\n]+?)(?:[#|][^\]\n]*)?\]\]"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(F.trim(t), r"\.md$", "")), lambda t: t != "")


def round_half_up(x: Column, digits: int) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
