"""Tables kept as versions under one log of commits.

A commit is a small file that names the places of all rows of all tables of a store. An attempt writes to folders of its own, which nobody reads until its commit is there, and a commit is
created only if its number is still free. So what is read is never overwritten or deleted, several tables change at once or not at all, an attempt that dies leaves the last commit
as it was, and of two attempts on one base one fails. Numbers of the attempts' folders tell which can never be committed any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import key_filters


#: A month that would have more files of ranges has larger ones, up to FULL_FILE rows each, so that files don't grow in number with small ranges.
FILES_OF_MONTH, FULL_FILE = 16, 100_000
#: Codec of a store's files. A version stays on disk beside the one that follows it.
CODEC = "zstd"


class Conflict(Exception):
    """Another attempt was committed on the same base."""


class Files:
    """The files below a root, by way of the file system that it names."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        path = self._path(f"{self.root}/{below}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def create(self, name: str, value) -> bool:
        """A small file, there as a whole or not at all. False if there is one of that name: it stays. A local link and a rename on HDFS fail if the name is taken; a store
        without such an operation can't hold a log of commits."""
        held, named = (self._path(f"{self.root}/{n}") for n in (f"{name}.{uuid.uuid4().hex}.tmp", name))
        out = self._fs.create(held, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if self._fs.getScheme() != "file":
                return bool(self._fs.rename(held, named))
            local = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                self._jvm.java.nio.file.Files.createLink(local(named), local(held))
            except Exception:
                if self._fs.exists(named):
                    return False
                raise
            return True
        finally:
            if self._fs.exists(held):
                self._fs.delete(held, False)

    def write(self, name: str, value) -> None:
        """A small file in place of one of that name."""
        self.delete(name)
        self.create(name, value)

    def read(self, name: str):
        path = self._path(f"{self.root}/{name}")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readNBytes(int(self._fs.getFileStatus(path).getLen()))).decode())
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Commit:
    """tables: name -> schema (JSON), and of each month the places of its rows, the place of its key filters, and bounds of its files if a time was named. info: what the job keeps with
    its rows, such as cursors."""

    version: int
    tables: dict[str, dict] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def months(self, table: str) -> dict[str, dict]:
        return self.tables.get(table, {}).get("months", {})


class Store:
    """Tables by month under one log of commits."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("versions") if n.isdigit())

    def last(self, version: int | None = None) -> Commit:
        """The last commit, or that of a version; version -1 if there is none yet."""
        known = self.versions() if version is None else [version]
        if not known:
            return Commit(-1)
        held = self.files.read(f"versions/{known[-1]}")
        return Commit(known[-1], held["tables"], held["info"])

    def read(self, table: str, months: list[str] | None = None, at: Commit | None = None) -> DataFrame:
        """Rows of a table as of a commit, or of some of its months."""
        at = at or self.last()
        kept = at.tables[table]
        schema = StructType.fromJson(json.loads(kept["schema"]))
        paths = [f"{self.files.root}/{p}" for m, held in sorted(kept["months"].items()) if months is None or m in months for p in held["places"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def months_that_may_hold(self, table: str, column: str, keys: DataFrame, at: Commit | None = None) -> list[str]:
        """Months of a table that have a filter of `column` which may hold one of the keys (one column of texts), and those without such a filter. No month that holds a key
        is left out."""
        months = (at or self.last()).months(table)
        unknown = [m for m, held in months.items() if column not in held.get("filtered", [])]
        filtered = {m: held["filter"] for m, held in months.items() if column in held.get("filtered", [])}
        if not filtered:
            return sorted(unknown)
        places = sorted(set(filtered.values()))
        rows = None
        for place in places:  # attempts that some month is of; each has the filters of few
            own = [m for m, p in filtered.items() if p == place]
            part = self.spark.read.parquet(f"{self.files.root}/{place}").filter((F.col("of_table") == table) & (F.col("of_column") == column) & F.col("shard_month").isin(own))
            rows = part if rows is None else rows.unionByName(part)
        return sorted({*unknown, *key_filters.months_hit(rows, keys)})

    def attempt(self, base: Commit | None = None) -> Attempt:
        return Attempt(self, base or self.last())

    def prune(self, keep: int = 2) -> None:
        """Forget all but the last commits, and delete what none of those names and no attempt can commit any more. Commits go first, so that none names what is deleted."""
        known = self.versions()
        if not known:
            return
        for v in known[:-keep]:
            self.files.delete(f"versions/{v}")
        held = [h for v in known[-keep:] for t in self.last(v).tables.values() for h in t["months"].values()]
        used = {p for h in held for p in [*h["places"], h.get("filter")]}
        for kind in ("data", "filters", "stage"):
            for own in self.files.names(kind):
                if int(own.split("-")[0]) > known[-1]:
                    continue  # its commit may still come
                if kind != "data":
                    if f"{kind}/{own}" not in used:
                        self.files.delete(f"{kind}/{own}")
                    continue
                for place in (f"data/{own}/{table}/{name}" for table in self.files.names(f"data/{own}") for name in self.files.names(f"data/{own}/{table}") if name.startswith("of_month=")):
                    if place in used:
                        continue
                    files = {f"{place}/{n}" for n in self.files.names(place)}
                    for gone in files - used if files & used else [place]:
                        self.files.delete(gone)


class Attempt:
    """Changes to a store on a base, which nobody sees before commit()."""

    def __init__(self, store: Store, base: Commit):
        self.store, self.base = store, base
        self.name = f"{base.version + 1}-{uuid.uuid4().hex[:12]}"
        self.tables = {name: {"schema": t["schema"], "months": dict(t["months"])} for name, t in base.tables.items()}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """df as files of this attempt: steps that read it several times make it once, and lost executors cost no recomputation."""
        path = f"{self.store.files.root}/stage/{self.name}/{name}"
        df.write.parquet(path, compression=CODEC)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def _write(self, table: str, df: DataFrame, month: Column | None, order: list[Column] | None = None, rows_per_file: int = 0) -> dict[str, str]:
        """Rows in a folder for each month: month -> place. order: files are ranges of a month's rows in it, of `rows_per_file` rows at most, or of
        more in a table with large months (FILES_OF_MONTH)."""
        place = f"data/{self.name}/{table}"
        rows = df.withColumn("of_month", F.coalesce(F.col("shard_month") if month is None else month, F.lit("")))
        if order:
            rows = self.stage(rows, f"{table}-unordered")  # counted, sampled and read
            most = rows.groupBy("of_month").count().agg(F.max("count")).first()[0] or 0
            rows_per_file = max(rows_per_file, min(FULL_FILE, -(-most // FILES_OF_MONTH)))
            rows = rows.repartitionByRange("of_month", *order).sortWithinPartitions("of_month", *order)
        rows.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("of_month").parquet(f"{self.store.files.root}/{place}", compression=CODEC)
        names = [n for n in self.store.files.names(place) if n.startswith("of_month=")]
        return {n.removeprefix("of_month=").replace("__HIVE_DEFAULT_PARTITION__", ""): f"{place}/{n}" for n in names}

    def replace(self, table: str, df: DataFrame, months: list[str] | None = None, keys: dict[str, Column] | None = None, time: str | None = None, rows_per_file: int = 0, same_keys: bool = False) -> None:
        """df has all rows of `months` as they are from now on, or all rows of the table if None. Months without rows go. keys: columns of texts, of which each month gets a
        filter; time: the column whose bounds each file is listed with; rows_per_file: files hold ranges of a month's rows by time and id, the newest first; see _write() for large months;
        same_keys: no month has a key that it had not before, so that a month's filters still hold and stay as they are."""
        made = self._write(table, df, None, [F.desc(time), F.desc("id")] if rows_per_file else None, rows_per_file)
        held = {m: {"places": [p]} for m, p in made.items()}
        before = self.tables.get(table, {"months": {}})["months"]
        unfiltered = set(made) if keys else set()
        if same_keys:
            for m in [m for m in unfiltered if before.get(m, {}).get("filtered") == sorted(keys)]:
                held[m] |= {k: before[m][k] for k in ("filter", "filtered")}
                unfiltered.remove(m)
        if unfiltered:
            place = f"filters/{self.name}-{table}"
            written = self.store.spark.read.schema(df.schema).parquet(*(f"{self.store.files.root}/{made[m]}" for m in sorted(unfiltered)))
            key_filters.build(written, keys).withColumn("of_table", F.lit(table)).write.parquet(f"{self.store.files.root}/{place}")
            for m in unfiltered:
                held[m] |= {"filter": place, "filtered": sorted(keys)}
        if time and made:
            bounds = self.file_bounds(df.schema, made, time)
            for m in held:
                held[m] |= {"time": time, "files": bounds.get(m, {}), "ranked": bool(rows_per_file)}
        kept = {} if months is None else {m: h for m, h in before.items() if m not in months}
        self.tables[table] = {"schema": df.schema.json(), "months": kept | held}

    def file_bounds(self, schema: StructType, made: dict[str, str], time: str) -> dict[str, dict[str, list]]:
        """month -> file -> [least time, greatest time, rows, rows without a time, greatest id of the greatest time], of the files at `made`."""
        root, out = self.store.files.root, {}
        rows = self.store.spark.read.schema(schema).parquet(*(f"{root}/{p}" for p in made.values()))
        # microseconds of the time as it is written, whatever the session's zone
        at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))
        top = F.max(F.struct(at.alias("at"), "id"))["id"] if "id" in schema.names else F.lit(None)
        listed = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(at), F.max(at), F.count("*"), F.count_if(F.col(time).isNull()), top).collect()
        for file, *bounds in listed:  # a file has many rows
            month = next(m for m, p in made.items() if f"/{p}/" in file)
            out.setdefault(month, {})[f"{made[month]}/{file.rsplit('/', 1)[1]}"] = bounds
        return out

    def append(self, table: str, df: DataFrame, month: Column) -> None:
        """More rows, to the months that `month` names."""
        kept = self.tables.setdefault(table, {"schema": df.schema.json(), "months": {}})
        for m, p in self._write(table, df, month).items():
            old = kept["months"].get(m, {"places": []})
            kept["months"][m] = {"places": [*(x for x in old["places"] if x != p), p]}

    def delete_before(self, table: str, time: str, threshold) -> dict[str, int]:
        """Rows before the threshold go; rows without a time stay. Of files with known bounds those wholly before it are left out and those wholly after it stay as they are, so
        that only those in between are read and written anew. Gives how many files were left out and rewritten, and rows deleted."""
        kept = self.tables[table]
        schema = StructType.fromJson(json.loads(kept["schema"]))
        root, at = self.store.files.root, _micros(threshold)
        counts, mixed, unknown = {"files_dropped": 0, "files_rewritten": 0, "rows_deleted": 0}, {}, []
        for month, held in kept["months"].items():
            if held.get("time") != time:
                unknown.append(month)
                continue
            files = held["files"]
            old = {f: b for f, b in files.items() if b[0] is not None and b[0] < at}
            whole = {f for f, (_, most, _, blank, *_) in old.items() if most < at and not blank}
            if old:
                counts["files_dropped"] += len(whole)
                counts["rows_deleted"] += sum(files[f][2] for f in whole)
                mixed[month] = [f for f in old if f not in whole]
                left = {f: b for f, b in files.items() if f not in old}
                kept["months"][month] = {k: v for k, v in held.items() if k != "places"} | {"places": sorted(left), "files": left}
        again = [f for files in mixed.values() for f in files] + [p for m in unknown for p in kept["months"][m]["places"]]
        if again:
            counts["files_rewritten"] = len(again)
            rows = self.store.spark.read.schema(schema).parquet(*(f"{root}/{f}" for f in again))
            seen = Observation()
            gone = F.coalesce(F.col(time) < F.lit(str(threshold)).cast("timestamp_ntz"), F.lit(False))
            made = self._write(table, rows.observe(seen, F.count_if(gone).alias("gone")).filter(~gone), None)
            counts["rows_deleted"] += seen.get["gone"]
            bounds = self.file_bounds(schema, made, time) if made else {}
            for month in unknown:
                kept["months"][month] = {"places": [], "time": time, "files": {}}
            for month in {*mixed, *unknown}:
                files = kept["months"][month]["files"] | bounds.get(month, {})
                kept["months"][month] |= {"places": sorted(files), "files": files, "ranked": False}
        for month in [m for m in {*mixed, *unknown} if not kept["months"][m]["places"]]:
            del kept["months"][month]
        return counts

    def drop(self, table: str, months: list[str]) -> None:
        self.tables[table]["months"] = {m: h for m, h in self.tables[table]["months"].items() if m not in months}

    def commit(self, info: dict | None = None) -> Commit:
        """Make it visible. Raises Conflict if the base isn't the last any more. info: new values by name; others stay."""
        made = Commit(self.base.version + 1, self.tables, self.base.info | (info or {}))
        if not self.store.files.create(f"versions/{made.version}", {"tables": made.tables, "info": made.info}):
            raise Conflict(f"version {made.version} is there already")
        self.store.files.delete(f"stage/{self.name}")
        return made


def _micros(time) -> int:
    """Microseconds of a time, as file_bounds() counts them."""
    at = time if isinstance(time, datetime) else datetime.fromisoformat(str(time))
    return (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def retried(store: Store, change: Callable[[Attempt], dict | None], times: int = 5) -> Commit:
    """Commit a change, made anew on the last commit where another was faster. change() writes to the attempt and gives its info, or None to leave all as it is."""
    for left in range(times, 0, -1):
        attempt = store.attempt()
        info = change(attempt)
        if info is None:
            return attempt.base
        try:
            return attempt.commit(info)
        except Conflict:
            if left == 1:
                raise
    raise AssertionError


class MonthTable:
    """A table by shard_month as a store of its own. A write gives new places to the months that it touches, and the others stay as they are, so what a batch rewrites doesn't grow with the
    table. Versions are numbers that follow each other; a number that is there is a Conflict."""

    ROWS = "rows"

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Column] | None = None):
        self.spark, self.store, self.keys = spark, Store(spark, root), keys

    def versions(self) -> list[int]:
        return self.store.versions()

    def months(self, version: int | None = None) -> dict[str, str]:
        """Month -> place of a version, the last if none is named."""
        return {m: held["places"][0] for m, held in self.store.last(version).months(self.ROWS).items()}

    def read(self, months: list[str] | None = None) -> DataFrame:
        """The last version, or some months of it. With none of them there, no rows."""
        return self.store.read(self.ROWS, months)

    def months_that_may_hold(self, column: str, keys: DataFrame) -> list[str]:
        return self.store.months_that_may_hold(self.ROWS, column, keys)

    def write(self, df: DataFrame, version: int, months: list[str] | None = None) -> None:
        """A new version: df has all rows of `months` as they are from now on, or all rows of the table if None. Months without rows go."""
        base = self.store.last()
        if version != base.version + 1:
            raise Conflict(f"version {version} can't follow {base.version}")
        attempt = self.store.attempt(base)
        attempt.replace(self.ROWS, df, months, self.keys)
        attempt.commit()

    def prune(self, keep: int = 2) -> None:
        self.store.prune(keep)
