"""Collections: versioned Parquet tables with upsert, patch, delete, expiry and snapshots.

A version is a folder; the current one is named by a pointer row that is written last, so readers
see whole versions only and the path being read is never overwritten. All paths go through Spark.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import apply_filter, compile_filter, resolver
from ..functions.ordering import numbered

# ---- pure transformations ----------------------------------------------------------------------


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str, created: str | None = None) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys; ``created`` keeps its old value."""
    fresh = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns])
    both = old.join(fresh, F.col(key) == F.col(f"_n_{key}"), "full")

    def pick(c: str) -> Column:
        if c == created:
            return F.coalesce(c, f"_n_{c}")
        return F.when(F.col(f"_n_{key}").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c))

    return both.select(*[pick(c).alias(c) for c in old.columns])


def merge_latest(old: DataFrame, new: DataFrame, key: str, order: str, created: str | None = None) -> DataFrame:
    """Last write wins, over the stored rows too: a row of ``new`` that is older than the stored one of
    its key changes nothing. Of equally old ones, that of ``new`` counts, so a replay changes nothing."""
    fresh = last_wins(new.select(old.columns), key, order).select(*[F.col(c).alias(f"_n_{c}") for c in old.columns])
    both = old.join(fresh, F.col(key) == F.col(f"_n_{key}"), "full")
    later = F.col(f"_n_{key}").isNotNull() & (F.col(key).isNull() | F.col(order).isNull() | F.coalesce(F.col(f"_n_{order}") >= F.col(order), F.lit(False)))
    picked = [F.coalesce(c, f"_n_{c}") if c == created else F.when(later, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in old.columns]
    return both.select(*[p.alias(c) for p, c in zip(picked, old.columns, strict=True)])


def upsert_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: inserted, updated."""
    known = new.select(key).distinct().join(old.select(key).withColumn("_old", F.lit(1)), key, "left")
    return known.agg(F.count(F.when(F.col("_old").isNull(), 1)).alias("inserted"), F.count("_old").alias("updated"))


def split_by_dimension(rows: DataFrame, size: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(F.size(vector) == size, F.lit(False))
    return rows.filter(good), rows.filter(~good)


def upsert_valid(old: DataFrame, new: DataFrame, key: str, size: int, vector: str = "vector", created: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert of the rows whose vector has the right dimension, and the other rows."""
    good, bad = split_by_dimension(new, size, vector)
    return upsert(old, good, key, created), bad


def patch(old: DataFrame, patches: DataFrame, key: str, column: str, updated: str | None = None) -> DataFrame:
    """Replaces a column of the rows with the patches' keys; ``updated`` is set to now for them."""
    new = patches.select(F.col(key), F.col(column).alias("_patch"), F.lit(True).alias("_hit"))
    joined = old.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_patch")).otherwise(F.col(column)))
    if updated:
        joined = joined.withColumn(updated, F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col(updated)))
    return joined.select(old.columns)


def delete(old: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return old.join(ids.select(key), key, "left_anti")


def delete_by_filter(old: DataFrame, filter_: dict, metadata: str | None = None, everything: bool = False) -> DataFrame:
    if not filter_ and not everything:
        raise ValueError("an empty filter deletes all rows; pass everything=True")
    return old.filter(~compile_filter(filter_, resolver(old, metadata)))


def unexpired(rows: DataFrame, now: Column | None = None, expires: str = "expires_at") -> DataFrame:
    return rows.filter(F.col(expires).isNull() | (F.col(expires) >= (F.current_timestamp() if now is None else now)))


def expiry(ttl: Column, start: Column | None = None) -> Column:
    return (F.current_timestamp() if start is None else start) + F.make_dt_interval(secs=ttl)


def scroll(rows: DataFrame, limit: int = 100, offset: int = 0, order: str = "created_at", key: str = "id", filter_: dict | None = None, metadata: str | None = None) -> DataFrame:
    """A page, newest first, ties by key."""
    return apply_filter(rows, filter_, metadata).orderBy(F.desc(order), key).offset(offset).limit(limit)


def scroll_total(rows: DataFrame, filter_: dict | None = None, metadata: str | None = None) -> DataFrame:
    """One row: how many rows all pages have."""
    return apply_filter(rows, filter_, metadata).agg(F.count("*").alias("total"))


def facets(rows: DataFrame, value: Column, limit: int = 100) -> DataFrame:
    counts = rows.select(value.cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(limit)


#: Keys of a fetch that go into the filter, where the scan can skip files by them.
FEW = 1000


def fetch(rows: DataFrame, ids, key: str = "id") -> DataFrame:
    """The rows with some keys: a list, or a table of keys for any number."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    ids = list(ids)
    if len(ids) <= FEW:
        return rows.filter(F.col(key).isin(ids))
    kind = rows.schema[key].dataType.simpleString()
    return fetch(rows, rows.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {kind}"), key)


def allocate(rows: DataFrame, start: int, order: str) -> DataFrame:
    """Contiguous surrogate ids from ``start``, by ``order``; no task sorts all rows."""
    return numbered(rows, order, name="surrogate").withColumn("surrogate", F.col("surrogate") + start)


def surrogate_of(rows: DataFrame, ids, key: str = "id", surrogate: str = "surrogate") -> DataFrame:
    """(key, surrogate) of some keys."""
    return fetch(rows.select(key, surrogate), ids, key)


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: count and an order-free checksum of the content, for manifests.

    Every row's SHA-256 (of its JSON) is cut into four numbers; the checksum is the SHA-256 of their sums."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).cast("string") for p in parts]
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("checksum"))


# ---- stored collections ------------------------------------------------------------------------


LOG = "seq bigint, version bigint, at double, kind string, dimension int, metric string, description string, rows bigint, checksum string, key string, buckets int, places string, batch bigint"


class Store:
    """Named collections under one folder that Spark can reach.

    Every collection has a log of small JSON entries, numbered without gaps; the last one counts. A
    version is a folder of rows, and its number is never used again. A collection with a key and
    buckets is laid out by a hash of the key: a merge reads and writes the buckets that it touches,
    and an entry's ``places`` name the version that each bucket's rows are in.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the log

    def _log(self, name: str) -> str:
        return f"{self.root}/{name}/log"

    def _entries(self, name: str) -> list:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.json(self._log(name), schema=LOG).orderBy("seq").collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _append(self, name: str, entries: list, **entry) -> None:
        row = dict.fromkeys(c.split()[0] for c in LOG.split(", ")) | {"seq": len(entries), "at": time.time()} | entry
        self.spark.createDataFrame([tuple(row.values())], LOG).coalesce(1).write.mode("append").json(self._log(name))

    def _live(self, name: str) -> list:
        """The entries since the collection was last created; an error if there is none."""
        entries = self._entries(name)
        if not entries or entries[-1]["kind"] == "drop":
            raise KeyError(name)
        first = max(e["seq"] for e in entries if e["kind"] == "create")
        return [e for e in entries if e["seq"] >= first]

    @staticmethod
    def _rows_entry(entries: list, version: int | None = None):
        return next(e for e in reversed(entries) if e["rows"] is not None and version in (None, e["version"]))

    # -- collections

    def exists(self, name: str) -> bool:
        entries = self._entries(name)
        return bool(entries) and entries[-1]["kind"] != "drop"

    def list(self) -> list[str]:
        """Names of the collections, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()] if files.exists(path) else []
        return sorted(n for n in names if self.exists(n))

    def create(self, name: str, rows: DataFrame, dimension: int, metric: str = "cosine", description: str = "", key: str | None = None, buckets: int | None = None) -> None:
        """``key`` and ``buckets`` lay the rows out by key, for merges."""
        if self.exists(name):
            raise ValueError(f"collection exists: {name}")
        self._commit(name, rows, "create", dimension=dimension, metric=metric, description=description, key=key, buckets=buckets if key else None)

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _commit(self, name: str, rows: DataFrame, kind: str, **entry) -> int:
        """Writes all rows as a new version."""
        entries = self._entries(name)
        version = 1 + max((e["version"] or 0 for e in entries), default=0)
        path = f"{self.root}/{name}/v{version}"
        key, buckets = entry.get("key"), entry.get("buckets")
        if buckets:
            rows.withColumn("_bucket", self._bucket(key, buckets)).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(path)
            held = self.spark.read.parquet(path)
            some = [r[0] for r in held.select("_bucket").distinct().collect()]  # as many as buckets, at most
            entry["places"] = json.dumps({str(b): version for b in sorted(some)})
            held = held.drop("_bucket")
        else:
            rows.write.mode("errorifexists").parquet(path)
            held = self.spark.read.parquet(path)
        found = fingerprint(held).first()
        self._append(name, entries, version=version, kind=kind, rows=found["rows"], checksum=found["checksum"], **entry)
        return version

    def settings(self, name: str) -> dict:
        out: dict = {}
        for e in self._live(name):
            out |= {k: v for k, v in e.asDict().items() if v is not None}
        return out

    def version(self, name: str) -> int:
        return self._rows_entry(self._live(name))["version"]

    def _read(self, name: str, entry, only: list[int] | None = None) -> DataFrame:
        root = f"{self.root}/{name}"
        if entry["places"] is None:
            return self.spark.read.parquet(f"{root}/v{entry['version']}")
        places = {int(b): v for b, v in json.loads(entry["places"]).items() if only is None or int(b) in only}
        schema = self.spark.read.parquet(f"{root}/v{self._first_version(entry)}").drop("_bucket").schema
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{root}/v{v}/_bucket={b}" for b, v in sorted(places.items())])

    @staticmethod
    def _first_version(entry) -> int:
        return min(json.loads(entry["places"]).values(), default=entry["version"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, self._rows_entry(self._live(name), version))

    def write(self, name: str, rows: DataFrame, kind: str = "write") -> int:
        """A new version. ``rows`` may be computed from the current one."""
        held = self.settings(name)
        return self._commit(name, rows, kind, key=held.get("key"), buckets=held.get("buckets"))

    def merge(self, name: str, new: DataFrame, order: str, key: str | None = None, created: str | None = None, batch: int | None = None) -> int:
        """Last write wins by ``order``, a new version. With buckets, only those of ``new`` are read and
        written. A batch that the log has is left out."""
        entries = self._live(name)
        if batch is not None and any(e["batch"] == batch for e in entries):
            return self._rows_entry(entries)["version"]
        current, held = self._rows_entry(entries), self.settings(name)
        key = key or held["key"]
        if not held.get("buckets") or key != held.get("key"):
            rows = self._read(name, current)
            return self._commit(name, merge_latest(rows, new.select(rows.columns), key, order, created), "merge", key=held.get("key"), buckets=held.get("buckets"), batch=batch)
        bucket = self._bucket(key, held["buckets"])
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # as many as buckets, at most
        if not touched:
            return current["version"]
        old = self._read(name, current, touched)
        before = old.count()
        version = 1 + max(e["version"] or 0 for e in self._entries(name))
        path = f"{self.root}/{name}/v{version}"
        merged = merge_latest(old, new.select(old.columns), key, order, created)
        merged.withColumn("_bucket", bucket).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(path)
        after = self.spark.read.parquet(path).count()
        places = json.loads(current["places"]) | {str(b): version for b in touched}
        self._append(name, self._entries(name), version=version, kind="merge", rows=current["rows"] - before + after, places=json.dumps(places), batch=batch)
        return version

    def compact(self, name: str, files: int | None = None) -> int:
        """The current rows written anew, in few files (or a file for each bucket)."""
        rows = self.read(name)
        return self.write(name, rows.coalesce(files) if files else rows, "compact")

    def vacuum(self, name: str, keep: int = 1) -> list[int]:
        """Deletes the versions that neither the last ``keep`` states nor their buckets are in; their numbers."""
        entries = self._entries(name)
        states = [e for e in self._live(name) if e["rows"] is not None][-keep:]
        used = {v for e in states for v in ([e["version"]] if e["places"] is None else json.loads(e["places"]).values())}
        gone = sorted({e["version"] for e in entries if e["rows"] is not None} - used)
        for version in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v{version}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def describe(self, name: str, description: str) -> None:
        """Changes the description: an entry without rows."""
        self._live(name)
        self._append(name, self._entries(name), kind="describe", description=description)

    def drop(self, name: str) -> None:
        self._live(name)
        self._append(name, self._entries(name), kind="drop")

    # -- snapshots

    def snapshot(self, name: str, path: str) -> None:
        rows, held = self.read(name), self.settings(name)
        rows.write.mode("errorifexists").parquet(f"{path}/rows")
        manifest = fingerprint(self.spark.read.parquet(f"{path}/rows"))
        manifest.select(F.lit(name).alias("name"), F.lit(time.time()).alias("at"), F.lit(held["dimension"]).alias("dimension"), F.lit(held["metric"]).alias("metric"), "*").write.json(f"{path}/manifest")

    def snapshots(self, folder: str) -> DataFrame:
        """Manifests of the snapshots in a folder, the newest first."""
        kind = "name string, at double, dimension int, metric string, rows bigint, checksum string"
        found = self.spark.read.schema(kind).json(f"{folder.rstrip('/')}/*/manifest")
        return found.withColumn("path", F.regexp_replace(F.input_file_name(), "/manifest/[^/]*$", "")).orderBy(F.desc("at"), "path")

    def verify(self, path: str) -> bool:
        manifest = self.spark.read.json(f"{path}/manifest").first()
        found = fingerprint(self.spark.read.parquet(f"{path}/rows")).first()
        return (manifest["rows"], manifest["checksum"]) == (found["rows"], found["checksum"])

    def restore(self, path: str, name: str, dimension: int | None = None, metric: str | None = None) -> None:
        """Into an existing collection, or a new one with the manifest's settings."""
        if not self.verify(path):
            raise ValueError(f"snapshot does not match its manifest: {path}")
        rows, manifest = self.spark.read.parquet(f"{path}/rows"), self.spark.read.json(f"{path}/manifest").first()
        if self.exists(name):
            self.write(name, rows, "restore")
        else:
            self.create(name, rows, dimension or manifest["dimension"], metric or manifest["metric"])

    def stats(self, names: list[str] | None = None) -> DataFrame:
        """collection, vectors: from the logs, without reading rows."""
        rows = [(n, self._rows_entry(self._live(n))["rows"]) for n in (self.list() if names is None else names)]
        return self.spark.createDataFrame(rows, "collection string, vectors bigint")

    def total(self) -> int:
        return sum(r["vectors"] for r in self.stats().collect())
