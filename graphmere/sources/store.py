"""Published generations of tables: written apart, checked, then switched by one atomic pointer.

A table may be cut into buckets by the hash of its owner. A generation then writes only the buckets that changed,
and its pointer names the folder of each bucket, old or new.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "generation.json"
#: Version of the tables' columns; older ones are read through DEFAULTS.
SCHEMA_VERSION = 3
#: Columns that came later, with what they hold in rows written before: (table, column) -> (type, value).
DEFAULTS = {("nodes", "description"): ("string", None), ("nodes", "source"): ("string", None), ("nodes", "authored"): ("double", None), ("nodes", "write_actor"): ("string", "unknown")}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def bucket(owner: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(n)).cast("int")


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """The published manifest; null if there is none or it is not readable."""
    fs, p = _fs(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    try:
        out = json.loads("\n".join(r[0] for r in spark.read.text(str(p.toString())).collect()))
    except ValueError:
        return None
    name = str(out.get("name", ""))
    return out if out.get("version") == 1 and name and "/" not in name and ".." not in name else None


def _switch(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write the manifest beside the pointer and rename it over the pointer, which readers see whole at any time."""
    fs, temp = _fs(spark, f"{root}/.{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.hsync()
    out.close()
    jvm = spark._jvm
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temp), fs.makeQualified(target), options)


def publish(
    spark: SparkSession, root: str, tables: dict[str, DataFrame | Callable[[dict], DataFrame]], generation: str, owners: dict[str, str] | None = None, buckets: int = 8,
    touched: Iterable[int] | None = None, check: Callable[[dict], bool] | None = None, append: bool = False, placed: Iterable[str] = (),
) -> bool:
    """Write the tables as a generation and point to it; False if it is the current one already.

    A table with an entry in ``owners`` is cut into ``buckets`` by that column. With ``touched`` only these buckets
    are written, from tables that hold just their rows, and all others stay those of the current generation. With
    ``append`` the rows are added to those of the current generation and nothing old is written again. A table may be
    a function of the manifest so far, with the tables before it; those in ``placed`` come bucket by bucket, as they
    are read from one of these, and are written without a shuffle. A generation is complete, and passes ``check`` of
    its manifest, before the pointer moves; else it is an error and the pointer stays.
    """
    now = read_pointer(spark, root)
    if now and now["generation"] == generation:
        return False
    owners, name, listed = owners or {}, f"gen-{uuid.uuid4().hex}", {}
    manifest = {"version": 1, "generation": generation, "name": name, "schema": SCHEMA_VERSION, "tables": listed}
    gone = None if touched is None else set(map(str, touched))
    for t, df in tables.items():
        df = df if isinstance(df, DataFrame) else df(manifest)
        path, old = f"{root}/{name}/{t}", {}
        if now and (append or t in owners and gone is not None):
            old = {b: list(f) for b, f in now["tables"][t]["folders"].items() if append or b not in gone}
        entry = {"schema": df.schema.jsonValue(), "folders": old}
        if t in owners:
            # Split by size where one bucket holds far more than others.
            cut = df.withColumn("_bucket", bucket(F.col(owners[t]), buckets))
            cut = cut if t in placed else cut.hint("rebalance", "_bucket")
            cut.write.mode("overwrite").partitionBy("_bucket").parquet(path)
            fs, p = _fs(spark, path)
            for b in sorted(s.getPath().getName().split("=")[1] for s in fs.listStatus(p) if s.isDirectory()):
                old.setdefault(b, []).append(f"{name}/{t}/_bucket={b}")
            entry |= {"owner": owners[t], "buckets": buckets}
        else:
            df.write.mode("overwrite").parquet(path)
            old.setdefault("", []).append(f"{name}/{t}")
        listed[t] = entry
    if check is not None and not check(manifest):
        raise RuntimeError(f"generation {generation} was not built as it was meant")
    _switch(spark, root, manifest)
    return True


def open_table(spark: SparkSession, root: str, table: str, manifest: dict | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """A table of the published generation, or of ``manifest``; of its buckets ``only`` these."""
    now = manifest or read_pointer(spark, root)
    if now is None or table not in now["tables"]:
        raise FileNotFoundError(f"{root} has no published table {table}")
    entry = now["tables"][table]
    kept = None if only is None else set(map(str, only))
    paths = [f"{root}/{f}" for b, fs in sorted(entry["folders"].items()) if kept is None or b in kept for f in fs]
    schema = T.StructType.fromJson(entry["schema"])
    out = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return migrated(out, table) if now.get("schema", 1) < SCHEMA_VERSION else out


def migrated(df: DataFrame, table: str) -> DataFrame:
    """A table of an older version with the columns that came later, and each edge once."""
    for (t, c), (kind, value) in DEFAULTS.items():
        if t == table and c not in df.columns:
            df = df.withColumn(c, F.lit(value).cast(kind))
    return df.dropDuplicates(["source", "type", "target"]) if table == "edges" else df


def generations(spark: SparkSession, root: str) -> dict[str, float]:
    """Each generation's folder with its age stamp in seconds since 1970."""
    fs, p = _fs(spark, root)
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("gen-")}


def collectable(made: dict[str, float], current: str, prior: str | None, readers: dict[str, tuple[str, float]], now: float, grace: float = 60.0, stale: float = 900.0, used: Iterable[str] = ()) -> list[str]:
    """Generations that may be deleted.

    ``made`` maps a generation to the time it was made, ``readers`` a reader to the generation it serves and the
    time it said so; readers silent for more than ``stale`` seconds are dead. The current generation stays, and
    those in ``used``, whose buckets it still names. While a living reader serves another one, the prior stays.
    While there is any living reader, none younger than ``grace`` goes.
    """
    alive = [g for g, t in readers.values() if now - t <= stale]
    blocked = any(g != current for g in alive)
    young = lambda t: bool(alive) and now - t < grace
    return sorted(n for n, t in made.items() if n != current and n not in used and not young(t) and not (n == prior and blocked))


def collect(spark: SparkSession, root: str, prior: str | None, readers: dict[str, tuple[str, float]], now: float, **limits: float) -> list[str]:
    """Delete what may be deleted; see :func:`collectable`."""
    manifest = read_pointer(spark, root)
    if manifest is None:
        return []
    used = {f.split("/")[0] for t in manifest["tables"].values() for fs in t["folders"].values() for f in fs}
    gone = collectable(generations(spark, root), manifest["name"], prior, readers, now, used=used, **limits)
    for g in gone:
        fs, p = _fs(spark, f"{root}/{g}")
        fs.delete(p, True)
    return gone


def cached(spark: SparkSession, root: str, signature: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables of ``build``, made only if those that are kept under ``root`` have another signature."""
    now = read_pointer(spark, root)
    if now is None or now["generation"] != signature:
        publish(spark, root, build(), signature)
        now = read_pointer(spark, root)
    return {t: open_table(spark, root, t, now) for t in now["tables"]}
