"""A table kept as snapshots in a folder: what a batch changes is written beside the old, and a pointer is swapped last."""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.operators.snapshot import upsert


class Snapshots:
    """Rows in `parts` parts, dealt by the columns `by`, at a folder that all machines share.

    A snapshot is a pointer file, numbered from 0: the folder of each part and the last batch of each source. It names files
    that are whole, and never changes, so a job that is lost on the way leaves the snapshot before as the current one, and a reader keeps
    what it has begun to read. Of two writers of the same number one fails, as the file is there.
    """

    def __init__(self, spark: SparkSession, at: str, schema: str | T.StructType, by: list[str], parts: int = 16):
        self.spark, self.at, self.by, self.parts = spark, at.rstrip("/"), by, parts
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # --- files ------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._path("pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()) if fs.exists(path) else []

    def _read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.at}/pointers/{number}", wholetext=True).first()[0])

    def pointer(self) -> dict:
        """The current one: number (-1: none yet), parts (folder of each), batches (last of each source)."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"number": -1, "parts": {}, "batches": {}}

    def _swap(self, pointer: dict) -> None:
        """The only step that others see: a new file, which fails if it is there."""
        fs, path = self._path(f"pointers/{pointer['number']}")
        out = fs.create(path, False)
        try:
            out.write(bytearray(json.dumps(pointer).encode()))
        finally:
            out.close()

    # --- rows -------------------------------------------------------------------

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.at}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        return self._rows(list(self.pointer()["parts"].values()))

    def of(self, keys: DataFrame) -> DataFrame:
        """Current rows with one of keys(by): no other part is read."""
        parts = self.pointer()["parts"]
        touched = [parts[p] for p in self._touched(keys) if p in parts]
        return self._rows(touched).join(keys.select(*self.by).distinct(), self.by, "left_semi")

    def _part(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _touched(self, rows: DataFrame) -> list[str]:
        return [str(r[0]) for r in rows.select(self._part()).distinct().collect()]

    def change(self, new: DataFrame, changed: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, source: str = "") -> bool:
        """Puts changed(old rows, new rows) in place of the parts that new rows belong to; the others stay as they are.

        A batch whose number its source has passed has no effect (False), as when a stream replays it. The new rows are read twice.
        """
        now = self.pointer()
        if batch is not None and batch <= now["batches"].get(source, -1):
            return False
        touched, name = self._touched(new), f"data/{uuid.uuid4().hex}"
        rows = changed(self._rows([now["parts"][p] for p in touched if p in now["parts"]]), new).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        if touched:
            rows.withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(f"{self.at}/{name}")
        fs, path = self._path(name)
        there = {s.getPath().getName().split("=")[1]: f"{name}/{s.getPath().getName()}" for s in fs.listStatus(path) if "=" in s.getPath().getName()} if touched else {}
        parts = {p: f for p, f in now["parts"].items() if p not in touched} | there
        self._swap({"number": now["number"] + 1, "parts": parts, "batches": now["batches"] | ({} if batch is None else {source: batch})})
        return True

    def merge(self, new: DataFrame, keys: list[str], batch: int | None = None, source: str = "", keep_if_null: tuple[str, ...] = ()) -> bool:
        """Rows of new keys are added, those of known ones replaced; keys include the columns `by`."""
        return self.change(new, lambda old, rows: upsert(old, rows, keys, keep_if_null), batch, source)

    def replace(self, new: DataFrame, group: list[str], batch: int | None = None, source: str = "") -> bool:
        """All rows of the groups that new rows have are replaced by them; a group is inside one part."""
        return self.change(new, lambda old, rows: old.join(rows.select(*group).distinct(), group, "left_anti").unionByName(rows.select(old.columns)), batch, source)

    def sink(self, keys: list[str], source: str = "", keep_if_null: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch counts once, whatever is replayed."""
        return lambda rows, number: self.merge(rows, keys, number, source, keep_if_null) and None

    def vacuum(self, keep: int = 2) -> int:
        """Deletes pointers but the last `keep`, and the parts that none of these names; returns how many folders went. Not while others write or read older snapshots."""
        numbers = self._numbers()
        held = {f for n in numbers[-keep:] for f in self._read(n)["parts"].values()}
        for n in numbers[:-keep]:
            fs, path = self._path(f"pointers/{n}")
            fs.delete(path, False)
        fs, path = self._path("data")
        gone = [s.getPath() for d in (fs.listStatus(path) if fs.exists(path) else []) for s in fs.listStatus(d.getPath()) if f"data/{d.getPath().getName()}/{s.getPath().getName()}" not in held and "=" in s.getPath().getName()]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
