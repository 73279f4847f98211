"""Text that was decoded with the wrong encoding, found through the garbled forms of clean words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import log

import pandas as pd
import pyarrow
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmere.session import sized, stage, stage_table

#: Encodings of one byte a character, as written and as read. Any ordered pair is a chain.
SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "iso8859-1", "iso8859-2", "iso8859-5", "iso8859-15")
#: Encodings of several bytes a character that may have been read as one of SINGLE.
MULTI = ("utf-8", "shift_jis", "euc_jp", "gb18030", "big5", "cp949")
#: Encodings of several bytes that UTF-8 may have been read as.
READERS = ("gb18030", "shift_jis", "euc_jp", "big5", "cp949")
#: What UTF-8 is read as first and then again, in any order of two.
TWICE = ("cp1252", "iso8859-1", "cp1250", "cp1251", "mac_roman")
#: A form made by a chain of single bytes needs so many characters, and its original so many times its documents,
#: alone or together with other words of one document under the same chain.
LEAST_LENGTH, LEAST_RATIO = 3, 3
#: So many times more frequent counts an original that is written as words are where its form is not.
BETTER_WRITTEN = 30
SMALL_ROWS = 200_000

#: Bits of the filter over the corpus's words, at most 4 MB, that drops forms which can't be in the corpus.
FILTER_BITS = 25

#: From here on there are too many characters for a table of their pairs.
FIRST_CJK = "\u2e80"

#: Words: runs of ASCII letters and digits and of other characters, with at least one of the latter. Every chain
#: keeps ASCII and turns other characters into other characters, so words of garbled text are garbled words.
WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]*+[^\x00-\x7f][A-Za-z0-9\x80-\U0010ffff]*"
FRAGMENT = r"[^\x00-\x7f]+"
#: Characters of scripts without blanks, and runs of kana.
CHARS = (r"[\u0800-\ud7ff\ue000-\ufffc]", r"[\u3041-\u3093]{2,}")
#: Words of which a task keeps the pieces.
KNOWN_WORDS = 200_000


@cache
def _table(encoding: str, undefined: str) -> dict[int, str]:
    """Byte to text; bytes without a character are kept as control characters, replaced or dropped."""
    out = {}
    for b in range(256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = {"keep": chr(b), "replace": "\ufffd", "drop": ""}[undefined]
    return out


def _misread(text: str, written: str, read: str, undefined: str) -> str | None:
    """``text`` written in one encoding and read in another; null if it can't be written so."""
    try:
        return text.encode(written).decode("iso8859-1").translate(_table(read, undefined))
    except UnicodeEncodeError:
        return None


@dataclass(frozen=True)
class Chain:
    """One way to garble text, as a table from character to text; all its encodings work character by character."""

    name: str
    swap: bool
    table: dict[int, str]


def chains(charset: str, pairs: frozenset[str] | None = None) -> list[Chain]:
    """All chains over the characters of a corpus, as far as their results are characters of the corpus too.

    ``pairs`` has the corpus's pairs of neighbouring characters below FIRST_CJK: a result with another pair can't
    be in a word of the corpus.
    """
    known, out = set(charset), []

    def can_be(form: str) -> bool:
        return known.issuperset(form) and not any(x.isascii() for x in form) and (pairs is None or all(a + b in pairs or max(a, b) >= FIRST_CJK for a, b in zip(form, form[1:])))

    def add(name: str, swap: bool, garble) -> None:
        table = {ord(c): f for c in known if c > "\x7f" and (f := garble(c)) and f != c and can_be(f)}
        if table and not any(c.table == table for c in out):
            out.append(Chain(name, swap, table))

    for read in SINGLE:
        variants = ("keep", "replace", "drop") if _table(read, "keep") != _table(read, "drop") else ("keep",)
        for written in MULTI:
            for u in variants:
                # The older ones hold Latin letters too, but text is written in them for the scripts they are made for.
                add(f"{written}>{read}", False, lambda c: _misread(c, written, read, u) if written == "utf-8" or c >= "\u0800" else None)  # noqa: B023
        for first in TWICE if read in TWICE else ():
            for u in variants:
                add(f"utf-8>{first}, utf-8>{read}", False, lambda c: _misread(_misread(c, "utf-8", first, u), "utf-8", read, u))  # noqa: B023
        for written in SINGLE:
            if written != read:
                add(f"{written}>{read}", True, lambda c: _misread(c, written, read, "drop"))  # noqa: B023
    return out


def _unit_pattern() -> str:
    """What one character of three UTF-8 bytes becomes when these are read in an encoding of SINGLE."""
    alternatives, first = [], {"\u00c3"}
    for read in SINGLE:
        t = _table(read, "keep")
        first |= {t[b] for b in range(0xE2, 0xF0)}
        lead = "".join(f"\\u{ord(t[b]):04x}" for b in range(0xE2, 0xF0))
        rest = "".join(f"\\u{ord(t[b]):04x}" for b in range(0x80, 0xC0))
        alternatives.append(f"[{lead}][{rest}\ufffd]{{2}}")
    twice = r"\xc3[\xa2-\xaf](?:[\xc2\xc3\xc5\xc6\xcb][^\x00-\x7f]|\xe2[^\x00-\x7f]{2}){2}"
    # Kana of the older Japanese encodings all begin with one byte; two in a row are a unit with what follows.
    starts = {_table(read, "keep")[b] for read in ("cp1252", "iso8859-1") for b in (0x82, 0xA4)}
    kana = [f"(?:\\u{ord(c):04x}[^\\x00-\\x7f]){{2,}}" for c in sorted(starts)]
    # Most characters begin no unit: one look at them instead of one for each encoding.
    begins = "".join(f"\\u{ord(c):04x}" for c in sorted(first | starts))
    return f"(?=[{begins}])(?:" + "|".join([*kana, twice, *dict.fromkeys(alternatives)]) + ")"


def garbled_forms(word: str, kind: str, ways: list[tuple[str, bool, dict[int, str]]], masks: dict[str, int], lossy: bool, readers: tuple[str, ...] = ()) -> Iterator[tuple[str, str, bool]]:
    """(form, chain, swap) of a word under the chains that can garble each of its characters, by ``masks``.

    Swaps of single characters count only for whole words of some length: shorter ones and fragments are too
    often words themselves. A single character is no evidence either, but for the replacement character, which
    stands for what was not UTF-8.
    """
    m = -1
    for c in word:
        if c > "\x7f":
            m &= masks.get(c, 0)
    seen = set()
    while m > 0:
        low = m & -m
        m ^= low
        name, swap, table = ways[low.bit_length() - 1]
        if swap:
            if kind == "word" and len(word) >= LEAST_LENGTH:
                yield word.translate(table), name, swap
        elif len(form := word.translate(table)) > (1 if name.startswith("utf-8") else 3) and form not in seen:
            # Encodings that agree in a word's bytes give one form; the first of them names it.
            seen.add(form)
            yield form, name, swap
    if kind == "word" and readers:
        data = word.encode("utf-8", "replace")
        for read in readers:
            form = data.decode(read, "replace").rstrip("\ufffd")
            # One character of such a script is no evidence, and a form must hold more than what was kept.
            if "\ufffd" not in form and sum(c > "\u2fff" for c in form) > (1 if form[:1] > "\u2fff" and len(form) < 3 else 0):
                yield form, f"utf-8>{read}", False
    if lossy and kind != "char":
        for written in SINGLE:
            try:
                form = word.encode(written).decode("utf-8", "replace")
            except UnicodeEncodeError:
                continue
            if "\ufffd" in form and form not in seen:
                seen.add(form)
                yield form, f"{written}>utf-8", False


def _forms(shared):
    """Forms of a batch of words that may be words of the corpus, by the filter over these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        bits, ways, masks = shared.value
        mask, lossy = (1 << FILTER_BITS) - 1, "\ufffd" in masks
        # Such forms are ideographs: none can be in a corpus without.
        readers = READERS if any("\u3400" <= c <= "\u9fff" for c in masks) else ()
        for batch in batches:
            rows = []
            for word, kind, n, strange in zip(batch["word"], batch["kind"], batch["n"], batch["odd"]):
                for form, chain, swap in garbled_forms(word, kind, ways, masks, lossy, readers):
                    h = xxhash.xxh64_intdigest(form.encode("utf-8", "replace"), seed=42) & mask
                    if bits[h >> 3] >> (h & 7) & 1:
                        rows.append((form, "unit" if kind == "char" else kind, word, n, strange, chain, swap))
            rows = list(dict.fromkeys(rows))
            yield pd.DataFrame(rows, columns=["word", "kind", "original", "n_original", "odd_original", "chain", "swap"])

    return run


def character_masks(charset: str, ways: list[Chain]) -> dict[str, int]:
    """For each character of the corpus a bit for each chain that can garble it."""
    return {c: sum(1 << i for i, w in enumerate(ways) if ord(c) in w.table) for c in charset}


def _word_filter(vocabulary: DataFrame) -> bytes:
    """A bit for each hash of a word; 2 ** FILTER_BITS bits, whatever the corpus."""
    h = F.pmod(F.xxhash64("word"), F.lit(1 << FILTER_BITS)) + 1  # bucket 1 has the values 1 to 32768
    parts = vocabulary.groupBy(F.bitmap_bucket_number(h).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("m"))
    out = bytearray(1 << FILTER_BITS - 3)
    for r in parts.toLocalIterator():
        at = (r["b"] - 1) * 4096
        out[at : at + 4096] = r["m"]
    return bytes(out)


def _pieces(batches: Iterator[pyarrow.RecordBatch]) -> Iterator[pyarrow.RecordBatch]:
    """(doc, word, kind) of batches (doc, text): a text is cut into words, and a word into its pieces the first time it is met."""
    import numpy as np
    import pyarrow as pa

    words, fragments, units, char, kana = (re.compile(p) for p in (WORD, FRAGMENT, _unit_pattern(), *CHARS))
    known: dict[str, tuple[int, ...]] = {}
    codes: dict[tuple[str, str], int] = {}
    names: list[tuple[str, str]] = []

    def code(word: str, kind: str) -> int:
        if (word, kind) not in codes:
            codes[word, kind] = len(names)
            names.append((word, kind))
        return codes[word, kind]

    def cut(word: str) -> tuple[int, ...]:
        parts = fragments.findall(word)
        all_of = lambda p: [x for part in parts for x in p.findall(part)]
        kinds = {"word": [word], "fragment": parts, "unit": all_of(units), "char": all_of(char) + all_of(kana)}
        return tuple({code(x, kind) for kind, each in kinds.items() for x in each})

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            if len(known) > KNOWN_WORDS:
                known.clear(), codes.clear(), names.clear()
            docs, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text or text.isascii():
                    continue
                own: set[int] = set()
                for word in words.findall(text.decode("utf-8", "replace")):
                    if word not in known:
                        known[word] = cut(word)
                    own.update(known[word])
                docs += [i] * len(own)
                found += own
            if not found:
                continue
            used, place = np.unique(np.array(found), return_inverse=True)
            columns = [pa.array(x, pa.string()).take(pa.array(place)) for x in zip(*(names[c] for c in used.tolist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), *columns], names=["doc", "word", "kind"])


def document_words(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, word, kind), distinct in a document.

    kind: 'word'; 'fragment', a run of other than ASCII characters; 'unit', a piece of a fragment that may be
    one garbled character, for scripts without blanks; 'char', such a script's characters and runs of kana.
    Words repeat from text to text, so that each is cut into its pieces once in a task and not once in a document.
    """
    rows = documents.select(F.col(ident).alias("doc"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_pieces, f"doc {rows.schema['doc'].dataType.simpleString()}, word string, kind string")


def odd(word: Column) -> Column:
    """Whether a word is not written as words are: a capital after a small letter, a symbol between letters, or
    letters of two scripts. Quotes, dashes and other punctuation are no signs of anything."""
    scripts = [word.rlike(rf"\p{{Is{x}}}").cast("int") for x in ("Latin", "Cyrillic", "Greek")]
    return word.rlike(r"\p{Ll}\p{Lu}|\p{L}[\p{S}\p{No}]+\p{L}") | (scripts[0] + scripts[1] + scripts[2] > 1)


def swap_ratio() -> Column:
    """How many times more frequent the original of a swap is than its form; better writing counts BETTER_WRITTEN times."""
    better = F.when(F.col("odd") & ~F.col("odd_original"), float(BETTER_WRITTEN)).when(F.col("odd_original") & ~F.col("odd"), 1 / BETTER_WRITTEN)
    return F.col("n_original") / F.col("n") * better.otherwise(1.0)


def confirmed_swaps(words: DataFrame, swaps: DataFrame) -> DataFrame:
    """(word, chain): forms about as frequent as their originals that the other words of their documents confirm.

    A document is taken as garbled by a chain if it has at least two of the chain's forms and the ratios of
    originals to forms multiply to LEAST_RATIO. In clean text under the chain's inverse the ratios are the
    other way round. A form is confirmed if most of its documents are taken so. ``swaps`` should be staged and has
    ``ratio``, see :func:`swap_ratio`.
    """
    pairs = swaps.groupBy("word", "chain").agg(F.max("n").alias("n"), F.max("ratio").alias("ratio"))
    pairs = pairs.withColumn("near", (F.col("ratio") < LEAST_RATIO) & (F.col("ratio") * LEAST_RATIO > 1))
    pairs = stage(pairs.join(F.broadcast(pairs.filter("near").select("chain").distinct()), "chain", "left_semi"))
    listed = pairs.groupBy("word").agg(F.collect_list(F.struct("chain", F.log("ratio").alias("weight"), "near")).alias("c"))
    seen = words.filter("kind = 'word'").join(sized(stage(listed), SMALL_ROWS), "word").select("doc", "word", F.inline("c"))
    taken = seen.groupBy("doc", "chain").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.collect_list(F.when(F.col("near"), F.col("word"))).alias("near"))
    taken = taken.filter((F.size("near") > 0) & (F.col("n") > 1) & (F.col("weight") > log(LEAST_RATIO) - 1e-9))
    sure = taken.select("chain", F.explode("near").alias("word")).groupBy("word", "chain").agg(F.count("*").alias("taken"))
    return sure.join(pairs, ["word", "chain"]).filter(2 * F.col("taken") > F.col("n")).select("word", "chain")


def garbled_words(words: DataFrame) -> DataFrame:
    """(word, kind, original, chain, sure): the corpus's garbled words with their most frequent clean original.

    A form counts if a word of the corpus, written and read by one chain, gives it. A form that only swaps
    single characters must be LEAST_RATIO times rarer than its original, counting better writing, or confirmed by
    other words of its documents, or it may be a word in its own right.
    ``sure`` is false where several clean originals of like frequency give one form. ``words`` is from :func:`document_words`.
    """
    vocabulary = words.groupBy("word", "kind").agg(F.count("*").alias("n"))
    vocabulary = stage(vocabulary.withColumn("odd", (F.col("kind") == "word") & odd(F.col("word"))))
    # The characters of all words, and the pairs of those below FIRST_CJK, no more than Unicode has; what they may
    # become is worked out once.
    runs = vocabulary.filter("kind = 'fragment'")
    two = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))
    ends = F.filter(F.when(F.length("word") > 1, two), lambda p: (F.substring(p, 1, 1) < FIRST_CJK) & (F.substring(p, 2, 1) < FIRST_CJK))
    found = runs.select(F.explode(F.concat(F.filter(F.split("word", ""), lambda c: c != ""), F.coalesce(ends, F.array().cast("array<string>")))).alias("c")).distinct()
    letters = [r["c"] for r in found.toLocalIterator()]
    charset, pairs = "".join(sorted(c for c in letters if len(c) == 1)), frozenset(c for c in letters if len(c) == 2)
    ways = chains(charset, pairs)
    shared = words.sparkSession.sparkContext.broadcast((_word_filter(vocabulary), [(w.name, w.swap, w.table) for w in ways], character_masks(charset, ways)))
    forms = vocabulary.filter("kind != 'unit'").mapInPandas(_forms(shared), "word string, kind string, original string, n_original long, odd_original boolean, chain string, swap boolean")
    hits = stage(forms.join(vocabulary, ["word", "kind"]).withColumn("ratio", F.when(F.col("swap"), swap_ratio())))
    confirmed = confirmed_swaps(words, hits.filter("swap")).withColumn("confirmed", F.lit(True))
    hits = hits.join(sized(stage(confirmed), SMALL_ROWS), ["word", "chain"], "left")
    hits = stage(hits.filter((~F.col("swap")) | (F.col("ratio") >= LEAST_RATIO) | F.col("confirmed")).drop("n", "ratio", "confirmed", "odd", "odd_original"))
    garbled = hits.select(F.col("word").alias("original"), "kind", F.lit(1).alias("dirty")).distinct()
    hits = hits.join(garbled, ["original", "kind"], "left").withColumn("dirty", F.coalesce("dirty", F.lit(0)))
    best = F.min_by(F.struct("original", "chain"), F.struct("dirty", -F.col("n_original"), "original", "chain")).alias("best")
    clean = F.sort_array(F.collect_set(F.when(F.col("dirty") == 0, F.struct("n_original", "original"))), asc=False).alias("c")
    sure = (F.size("c") < 2) | (F.get("c", F.lit(0)).n_original >= LEAST_RATIO * F.get("c", F.lit(1)).n_original)
    return hits.groupBy("word", "kind").agg(best, clean).select("word", "kind", "best.*", sure.alias("sure"))


def find_garbled(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, chains, fixes): documents with garbled words, by a hash join of their words.

    One garbled word or fragment is enough, or a unit of more than one character, or two different ones. ``fixes`` maps garbled text to its original
    where there is just one; lost characters often leave several. Null, empty and plain ASCII texts have no words
    and are never found; repeated rows of one id count as one document; further columns are ignored; an empty
    table gives an empty result.
    """
    words = stage_table(document_words(documents, ident, text))
    garbled = sized(stage(garbled_words(words)), SMALL_ROWS)
    hits = words.filter("kind != 'char'").join(garbled, ["word", "kind"])
    fix = F.when(F.col("sure"), F.struct(F.col("word").alias("key"), F.struct("kind", "original").alias("value")))
    grouped = hits.groupBy("doc").agg(
        F.count_distinct("word").alias("words"),
        F.max(((F.col("kind") != "unit") | (F.length("word") > 3)).cast("int")).alias("plain"),
        F.sort_array(F.collect_set("chain")).alias("chains"),
        F.sort_array(F.collect_set(fix)).alias("f"),
    )
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("f", lambda x: x.key)), lambda k: F.struct(k, F.array_max(F.filter("f", lambda x: x.key == k)).value.original)))
    return grouped.filter("plain = 1 or words > 1").select(F.col("doc").alias(ident), "words", "chains", last.alias("fixes"))


@F.pandas_udf(T.StringType())
def _substitute(text: pd.Series, fixes: pd.Series) -> pd.Series:
    word, part = re.compile(r"[A-Za-z0-9]*[^\x00-\x7f][A-Za-z0-9\x80-\U0010ffff]*"), re.compile(FRAGMENT)

    def restore(t, f):
        f = dict(f)
        units = sorted((k for k in f if len(k) > 2 and f[k] > "\u07ff" and k not in f[k]), key=len, reverse=True)
        unit = re.compile("|".join(map(re.escape, units)) or r"(?!)")
        inner = lambda m: f[m[0]] if m[0] in f else unit.sub(lambda u: f[u[0]], m[0])
        return word.sub(lambda m: f[m[0]] if m[0] in f else part.sub(inner, m[0]), t)

    return pd.Series([restore(t, f) for t, f in zip(text, fixes)])


def restore_garbled(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The found documents as (doc_id, text, restored): garbled words replaced by their originals."""
    found = sized(stage(find_garbled(documents, ident, text).select(ident, "fixes")), SMALL_ROWS // 10)
    joined = documents.select(ident, text).join(found, ident)
    return joined.select(ident, text, _substitute(F.col(text), F.col("fixes")).alias("restored"))
