"""Helpers shared by the operators: tables, shared storage, word splitting, connected components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_labelproof_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for folder, _, names in os.walk(root):
                for name in (n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "labelproof.zip")
        with open(path, "wb") as out:
            out.write(packed.getvalue())
        sc.addPyFile(path)
        sc._labelproof_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, with only the columns named, so that the scan reads no others."""
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only a session on one machine may leave that unset; it
    gets a private folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = current or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(current)
        current = sc.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path for a written table under the shared folder."""
    return os.path.join(checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read again: the lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with the function applied to each batch."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def fresh(name: str, taken) -> str:
    """The name, lengthened until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for each node of the links.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes; each round is written to the shared
    folder. A node's neighbours are only reduced to their minimum, which combines before the shuffle; no group is
    gathered. Null ends are ignored, an empty table gives an empty result.
    """
    spark = edges.sparkSession
    links = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("v as u", "m as v").where("u <> v")
        links = stored(small.unionAll(low.selectExpr("u", "m as v")).distinct(), "links")
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if mark == seen:
            break
        seen = mark
    stars = links.selectExpr("u as node", "v as root")
    return stars.unionAll(stars.selectExpr("root as node", "root").distinct())


class Memo:
    """Values of different pieces (words, say), learned once while they recur: the pieces of a block join the young half; when
    that holds limit / 2 it becomes the old half, and what the old half held is forgotten. Pieces that come back stay, those
    seen once go, and the memory is bounded by the limit and the largest block."""

    def __init__(self, learn, limit: int = 400_000):
        """learn: from a list of pieces to the list of their values."""
        self.learn, self.limit, self.young, self.old = learn, limit, {}, {}

    def find(self, piece):
        """The value of a piece, None where it isn't held."""
        value = self.young.get(piece)
        return self.old.get(piece) if value is None else value

    def values(self, pieces) -> list:
        """The values of different pieces, in their order."""
        out = list(map(self.young.get, pieces))
        missing = [k for k, v in enumerate(out) if v is None]
        if missing and self.old:
            pieces = pieces if isinstance(pieces, list) else list(pieces)
            for k in missing:
                out[k] = self.old.get(pieces[k])
            missing = [k for k in missing if out[k] is None]
        if missing:
            pieces = pieces if isinstance(pieces, list) else list(pieces)
            for k, value in zip(missing, self.learn([pieces[k] for k in missing]), strict=True):
                out[k] = value
        self.young.update(zip(pieces, out, strict=True))
        if len(self.young) > self.limit // 2:
            self.young, self.old = {}, self.young
        return out

    def getter(self, pieces: set):
        """A function from each of the pieces to its value."""
        pieces = list(pieces)
        return dict(zip(pieces, self.values(pieces), strict=True)).__getitem__


def blocks(values: list, chars: int = 1 << 20):
    """Ranges of texts of about so many characters, so that a block's different pieces stay few."""
    first, held = 0, 0
    for k, text in enumerate(values):
        held += len(text)
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(values):
        yield first, len(values)
