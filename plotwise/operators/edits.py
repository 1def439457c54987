"""Edits over files that are never changed: rows that an edit replaces are marked in bitmaps by file and row, new rows go to small files of their own.

A state of the table is a small document: the folders of data, each with its level, and the folders of bitmaps. A commit writes new folders, then the next
document, whose name must be free: of two writers one is refused. Bitmaps are Spark's own (32 768 rows each, 4 KB), joined to the rows on reading.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plotwise.operators.lake import settled_edits
from plotwise.storage import exists, write_small

#: Bitmaps are broadcast up to so many (4 KB each); beyond, Spark joins by shuffle.
BROADCAST_BITMAPS = 8_192


@dataclass(frozen=True)
class EditedTable:
    """A table at one of its states. data: (folder, level); the base has level 0 and is never rewritten."""

    spark: SparkSession
    folder: str
    key: str
    schema: StructType
    version: int
    data: tuple[tuple[str, int], ...]
    gone: tuple[str, ...]

    def rows(self) -> DataFrame:
        """The rows as they are after all edits."""
        return self._visible([path for path, _ in self.data]).select(*(F.col(f"`{c}`") for c in self.schema.names))

    def edit(self, deltas: DataFrame) -> EditedTable:
        """The table with edits: (key, columns of the table, version, deleted), settled as `lake.overlay` settles them. An edit wins over all earlier commits.

        Rows of the table are only joined by their keys; what is written is the new rows, and a bitmap for each 32 768 rows that lose one."""
        last = settled_edits(deltas, self.schema.names, self.key)
        place = f"{self.folder}/{uuid.uuid4().hex}"
        last.where("NOT deleted").select(*self.schema.names).write.parquet(f"{place}/data")
        rows = self._visible([path for path, _ in self.data]).select(self.key, "_file", "_row")
        lost = rows.join(last.select(self.key), self.key, "left_semi")
        bits = lost.groupBy("_file", F.bitmap_bucket_number("_row").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits"))
        bits.write.parquet(f"{place}/gone")
        return self._committed([*self.data, (f"{place}/data", 1)], [*self.gone, f"{place}/gone"])

    def compact(self, fan: int = 4) -> EditedTable:
        """The same rows with fewer files: where a level above the base has `fan` folders, their rows become one folder of the next level, again and again.

        Bitmaps are merged to one folder then, without those of files that are no longer read."""
        now = self
        while True:
            crowded = [level for level in sorted({level for _, level in now.data if level}) if sum(x == level for _, x in now.data) >= fan]
            if not crowded:
                return now
            level = crowded[0]
            kept, merged = [d for d in now.data if d[1] != level], [path for path, x in now.data if x == level]
            place = f"{self.folder}/{uuid.uuid4().hex}"
            now._visible(merged).select(*(F.col(f"`{c}`") for c in self.schema.names)).write.parquet(f"{place}/data")
            files = now._files([path for path, _ in kept]).select("_file").distinct()
            now._bitmaps().join(files, "_file", "left_semi").write.parquet(f"{place}/gone")
            now = now._committed([*kept, (f"{place}/data", level + 1)], [f"{place}/gone"])

    def _files(self, paths: list[str]) -> DataFrame:
        found = self.spark.read.schema(self.schema).parquet(*paths)
        return found.select("*", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.row_index") + 1).alias("_row"))

    def _bitmaps(self) -> DataFrame:
        """(_file, _bucket, bits), one row each."""
        found = self.spark.read.schema("_file string, _bucket long, bits binary").parquet(*self.gone)
        return found.groupBy("_file", "_bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def _visible(self, paths: list[str]) -> DataFrame:
        rows = self._files(paths)
        if not self.gone:
            return rows
        bitmaps = self._bitmaps()
        bitmaps = F.broadcast(bitmaps) if self.spark.read.parquet(*self.gone).count() <= BROADCAST_BITMAPS else bitmaps
        marked = rows.withColumn("_bucket", F.bitmap_bucket_number("_row")).join(bitmaps, ["_file", "_bucket"], "left")
        place = F.bitmap_bit_position("_row")
        byte = F.conv(F.hex(F.substring("bits", F.expr("int(bitmap_bit_position(_row) div 8) + 1"), F.lit(1))), 16, 10).cast("long")
        return marked.where(F.col("bits").isNull() | (F.getbit(byte, (place % 8).cast("int")) == 0)).drop("bits", "_bucket")

    def _committed(self, data: list, gone: list) -> EditedTable:
        """The next state; FileExistsError if another writer committed after this one was read. What was written for it is then not part of the table."""
        then = replace(self, version=self.version + 1, data=tuple(map(tuple, data)), gone=tuple(gone))
        name = _document(self.folder, then.version)
        if exists(self.spark, name):
            raise FileExistsError(name)
        write_small(self.spark, name, json.dumps({"key": then.key, "schema": then.schema.jsonValue(), "data": then.data, "gone": then.gone}))
        return then


def _document(folder: str, version: int) -> str:
    return f"{folder}/state-{version:08d}.json"


def create_edited(spark: SparkSession, base: str, folder: str, key: str = "id") -> EditedTable:
    """A table without edits over the parquet files at `base`."""
    schema = spark.read.parquet(base).schema
    return EditedTable(spark, folder, key, schema, -1, (), ())._committed([(base, 0)], [])


def open_edited(spark: SparkSession, folder: str, version: int | None = None) -> EditedTable:
    """The newest state, or a given one."""
    if version is None:
        version = 0
        while exists(spark, _document(folder, version + 1)):
            version += 1
    said = json.loads(spark.read.text(_document(folder, version), wholetext=True).first()[0])
    return EditedTable(spark, folder, said["key"], StructType.fromJson(said["schema"]), version, tuple((p, k) for p, k in said["data"]), tuple(said["gone"]))
