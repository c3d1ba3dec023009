"""The stored table of leads: reading, appending, replacing, exporting.

Plain Parquet has no transactions, so a table is a folder of versions: each
write that replaces goes to a new version, and a numbered pointer is added by
one rename after it is complete. Readers follow the newest pointer, so they see
the old or the new version, never a mixture, and never none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators import report
from contactloom.schemas import DATA_COLUMNS, LEAD_COLUMNS, LEADS_DDL


class Leads:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return sorted(n for x in fs.listStatus(path(self.path)) if (n := x.getPath().getName()).startswith("p-"))

    def _version(self) -> str | None:
        found = self._pointers()
        return self.spark.read.text(f"{self.path}/{found[-1]}").first()[0] if found else None

    def create(self) -> None:
        """An empty table, if there is none."""
        if self._version() is None:
            self.replace(self.spark.createDataFrame([], LEADS_DDL.strip().replace("\n", " ")))

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            raise ValueError(f"no table of leads at {self.path}")
        return self.spark.read.schema(LEADS_DDL.strip().replace("\n", " ")).parquet(f"{self.path}/{version}")

    def replace(self, rows: DataFrame) -> None:
        """All rows of the table; the version before stays until ``vacuum``."""
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*LEAD_COLUMNS).write.parquet(f"{self.path}/{version}")
        # written aside, and renamed to a name that none has yet
        fs, path = self._fs()
        self.spark.createDataFrame([(version,)], "v STRING").coalesce(1).write.text(f"{self.path}/.next-{version}")
        last = self._pointers()
        number = int(last[-1][2:]) + 1 if last else 0
        name = path(f"{self.path}/p-{number:012d}")
        if fs.exists(name) or not fs.rename(path(f"{self.path}/.next-{version}"), name):
            raise RuntimeError(f"another writer replaced the table at {self.path}")

    def vacuum(self) -> None:
        fs, path = self._fs()
        keep = self._version()
        for x in fs.listStatus(path(self.path)):
            name = x.getPath().getName()
            if name.startswith("v-") and name != keep or name in self._pointers()[:-1] or name.startswith(".next-"):
                fs.delete(x.getPath(), True)

    def append(self, records: DataFrame, now: Column | None = None) -> DataFrame:
        """Records with ids, times and missing columns filled; columns of other names are left out.

        A record without scraped_from_url is an error, and nothing is written then.
        """
        now = now if now is not None else F.current_timestamp()
        types = {f.name: f.dataType for f in self.read().schema.fields}
        whole = records.select(*[(F.col(c) if c in records.columns else F.lit(None)).cast(types[c]).alias(c) for c in DATA_COLUMNS])
        if not whole.where("scraped_from_url is null").isEmpty():
            raise ValueError("scraped_from_url must not be null")
        first = self.read().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        keyed = whole.withColumn("key_", F.struct(F.coalesce("scraped_from_url", F.lit("")), F.monotonically_increasing_id()))
        rows = report.dense_numbers(keyed, "key_").select((F.col("number") + first).alias("id"), *DATA_COLUMNS, now.alias("created_at"), now.alias("updated_at"))
        rows.select(*LEAD_COLUMNS).write.mode("append").parquet(f"{self.path}/{self._version()}")
        return rows


def save_results(leads: Leads, rows: DataFrame) -> dict:
    """Upserted rows stored, or a note that there were none."""
    if rows.isEmpty():
        return {"success": False, "message": "No results to save"}
    leads.replace(rows)
    return {"success": True}


def export_csv(leads: DataFrame, path: str, limit: int | None = None, single_file: bool = False) -> bool:
    """Leads as CSV with a header, newest first; False, and no file, if there are none.

    Part files are in order; one file is for small exports.
    """
    if leads.isEmpty():
        return False
    rows = report.export_rows(leads, limit)
    (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True
