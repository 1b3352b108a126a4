"""A small table with versions that runs share: a run reads the latest version and puts the next one in its place only if nobody else has done so meanwhile.

A version is a folder of its own; what makes it the next one is a marker file with its number, which can be made once. A writer that comes second is told so, reads
again and merges again, so two writers lose nothing. Taking a name that must be free is atomic on HDFS; a local file system, as in tests, is asked first, and object stores need a
file system that makes it atomic. A writer that is killed before its marker leaves a folder that nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.session import scratch


class Versions:
    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/markers/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def latest(self) -> tuple[int, DataFrame]:
        """The number of the latest version (0: none yet) and its rows."""
        fs, folder = self._path("")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, self.spark.createDataFrame([], self.schema)
        where = self.spark.read.text(f"{self.root}/markers/{number}").first()[0]
        return number, self.spark.read.schema(self.schema).parquet(where)

    def swap(self, read: int, rows: DataFrame) -> bool:
        """Makes ``rows`` the version after ``read``; false if there is one already."""
        where = f"{self.root}/data-{scratch(self.spark, 'v').rsplit('/', 1)[1]}"
        rows.write.parquet(where)
        fs, path = self._path(str(read + 1))
        draft = path.getParent().suffix(f"-{where.rsplit('/', 1)[1]}")
        out = fs.create(draft)
        out.write(bytearray(where.encode()))
        out.close()
        fs.mkdirs(path.getParent())
        # a file with its content in it takes the name, so no reader meets an empty marker
        try:
            made = not fs.exists(path) and bool(fs.rename(draft, path))
        except Exception:  # noqa: BLE001
            made = False
        if not made:
            fs.delete(draft, False)
        return made

    def update(self, merge: Callable[[DataFrame], DataFrame], tries: int = 20) -> DataFrame:
        """Merges until the merged rows are the next version, and gives them."""
        for _ in range(tries):
            number, rows = self.latest()
            if self.swap(number, merge(rows)):
                return self.latest()[1]
        raise RuntimeError("other writers were always faster")


LABELS = "rink_id string, title_norm string, category string, source string, run long"


def unknown(titles: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (rink_id, title_norm) that no label of the rink or of all rinks (``*``) names."""
    met = titles.select("rink_id", "title_norm").where("title_norm IS NOT NULL").distinct()
    everywhere = labels.where("rink_id = '*'").select("title_norm")
    return met.join(everywhere, "title_norm", "left_anti").join(labels, ["rink_id", "title_norm"], "left_anti").select("rink_id", "title_norm")


def learn(table: Versions, titles: DataFrame, judge: Callable[[DataFrame], DataFrame], run: int) -> DataFrame:
    """One run of the loop: titles without a label are judged and their labels kept for the next run; a label that is there stays. Gives all labels.

    ``judge`` gives (rink_id, title_norm, category) for some of the titles that it is asked; a null category is none.
    """

    def merge(labels: DataFrame) -> DataFrame:
        new = judge(unknown(titles, labels)).where("category IS NOT NULL").groupBy("rink_id", "title_norm").agg(F.min("category").alias("category"))
        return labels.unionByName(new.withColumns({"source": F.lit("model"), "run": F.lit(run).cast("long")}))

    return table.update(merge)
