"""Durable keyed tables: appended generations that are merged by key when they are read.

Files lie in folders by generation and key prefix.  A manifest lists the generations that exist;
it is written last and never overwritten, so a reader sees all of an append or nothing, and of
two writers with the same number the second takes the next one.  An append may carry a tag; a
second append with the same tag (a repeated micro-batch or increment) does nothing.  Readers open
only the prefixes they ask for.  Compaction rewrites the live generations as one; what no manifest
lists any more is removed by :meth:`KeyedLog.vacuum`, when no reader of an older manifest is left.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.sources.tables import hadoop_path, read_text

#: How often a writer tries to be the first with the next manifest.
TRIES = 40


class KeyedLog:
    """``columns`` (DDL) of the rows, ``key`` among them; more than ``most_live`` generations are compacted on append.

    Subclasses say how the rows of a key are merged, and what a key's prefix is (few values, whatever the keys).
    """

    columns: str
    key: str

    def __init__(self, spark: SparkSession, path: str, most_live: int = 8):
        self.spark, self.path, self.most_live = spark, path.rstrip("/"), most_live

    def prefix(self) -> Column:
        """Of the key column; 256 values."""
        return F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(self.key), F.lit(256))), 2, "0"))

    def merged(self, rows: DataFrame, age: Column) -> DataFrame:
        """One row a key; ``age`` orders the generations, the newest last."""
        raise NotImplementedError

    @property
    def _schema(self) -> str:
        return f"{self.columns}, generation string, prefix string"

    def _names(self) -> list[str]:
        return self.spark.createDataFrame([], self.columns).columns

    def _manifests(self) -> list[str]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def live(self) -> tuple[int, list[dict]]:
        """(number of the newest manifest, the generations that it lists, oldest first); one that is being written does not count."""
        for name in reversed(self._manifests()):
            fs, file = hadoop_path(self.spark, f"{self.path}/manifests/{name}")
            text = read_text(fs, file)
            if text.endswith("]"):
                return int(name.removesuffix(".json")), json.loads(text)
        return 0, []

    def _commit(self, number: int, generations: list[dict]) -> bool:
        """Whether this manifest is the first of its number."""
        fs, file = hadoop_path(self.spark, f"{self.path}/manifests/{number:010d}.json")
        if fs.exists(file):
            return False
        try:
            out = fs.create(file, False)
        except Py4JJavaError:
            if fs.exists(file):
                return False
            raise
        out.write(bytearray(json.dumps(generations).encode()))
        out.close()
        return True

    def _publish(self, change) -> list[dict] | None:
        """Commits ``change(live)`` until it is the first of its number; None if there is nothing to change."""
        for k in range(TRIES):
            number, live = self.live()
            new = change(live)
            if new is None:
                return None
            if self._commit(number + 1, new):
                return new
            time.sleep(0.05 * k)
        raise RuntimeError(f"a manifest above number {number} of {self.path} was left unfinished; delete it")

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.live()[0] + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows.select(*self._names(), self.prefix().alias("prefix")).hint("rebalance", "prefix").write.partitionBy("prefix").parquet(f"{self.path}/data/generation={name}")
        return name

    def append(self, rows: DataFrame, tag: str | None = None) -> bool:
        """Adds rows as the newest generation; False if the ``tag`` has been added before."""
        held = lambda live: tag is not None and any(tag in g["tags"] for g in live)
        if held(self.live()[1]):
            return False
        new = {"name": self._write(rows), "tags": [tag] if tag is not None else []}
        live = self._publish(lambda live: None if held(live) else [*live, new])
        if live is None:
            return False
        if len(live) > self.most_live:
            self.compact()
        return True

    def compact(self) -> None:
        """Makes one generation of all live ones; generations that others append meanwhile stay."""
        _, old = self.live()
        if len(old) > 1:
            self._replace(old, self._write(self._read(old)))

    def _replace(self, old: list[dict], name: str) -> None:
        one = {"name": name, "tags": [t for g in old for t in g["tags"]]}
        # if somebody else has compacted them, there is nothing left to do
        self._publish(lambda live: [one, *[g for g in live if g not in old]] if all(g in live for g in old) else None)

    def vacuum(self) -> None:
        """Deletes generations and manifests that the newest manifest has replaced."""
        number, live = self.live()
        fs, data = hadoop_path(self.spark, f"{self.path}/data")
        names = [g["name"] for g in live]
        if fs.exists(data):
            for s in fs.listStatus(data):
                if s.getPath().getName().removeprefix("generation=") not in names:
                    fs.delete(s.getPath(), True)
        for name in self._manifests():
            if int(name.removesuffix(".json")) < number:
                fs.delete(hadoop_path(self.spark, f"{self.path}/manifests/{name}")[1], False)

    def _read(self, generations: list[dict], keys: DataFrame | None = None) -> DataFrame:
        names = [g["name"] for g in generations]
        if not names:
            return self.merged(self.spark.createDataFrame([], self._schema), F.lit(0)).select(*self._names())
        rows = self.spark.read.schema(self._schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/generation={n}" for n in names])
        if keys is not None:
            found = [r["p"] for r in keys.select(self.prefix().alias("p")).distinct().collect()]  # 256 at most
            rows = rows.where(F.col("prefix").isin(found)) if found else rows.where("false")
        return self.merged(rows, F.array_position(F.lit(names), F.col("generation"))).select(*self._names())

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """A merged row of each key; of the prefixes in ``keys`` (with a column of the key's name), if given."""
        return self._read(self.live()[1], keys)


class AnswerStore(KeyedLog):
    """Answers by cache key (hexadecimal, whose first two digits are the prefix); the latest one counts."""

    columns, key = "cache_key string, response string", "cache_key"

    def prefix(self) -> Column:
        return F.left("cache_key", F.lit(2))

    def merged(self, rows: DataFrame, age: Column) -> DataFrame:
        return rows.groupBy("cache_key").agg(F.max_by("response", age).alias("response"))

    answers = KeyedLog.rows
