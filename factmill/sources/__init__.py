"""Where facts come from: folders, source texts and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..facts import Facts
from . import curly, files, python_source


def _has_rows(spark, folder: str) -> bool:
    """Whether a partitioned table has a partition: an empty one has no schema to read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return any(x.isDirectory() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))


def read_project(scanned: DataFrame) -> Facts:
    """All facts of a scan (see files.scan): each file is parsed once and its rows are kept in the shared folder.

    A parse gives rows of eleven tables at once, as JSON. They are written by table in one pass over the sources, and each table is then stored with
    its own types, so that what reads one column of one table afterwards reads no more than that.
    """
    from pyspark.sql import functions as F

    from ..facts import SCHEMAS
    from ..operators.storage import shared_dir, stored

    def go(batches):
        import json

        import pandas as pd

        for pdf in batches:
            out = []
            for file, language, text in zip(pdf["file"], pdf["language"], pdf["text"], strict=True):
                rows = python_source.read(text or "", file) if language == "python" else curly.read(text or "", file, language) if language in curly.LANGUAGES else {}
                out += [(name, json.dumps(r)) for name, found in rows.items() for r in found]
            yield pd.DataFrame(out, columns=["name", "row"])

    spark = scanned.sparkSession
    folder = f"{shared_dir(spark)}/factmill-facts-{uuid.uuid4().hex}"
    scanned.select("file", "language", "text").mapInPandas(go, "name string, row string").write.partitionBy("name").parquet(folder)
    parsed = spark.read.schema("row string, name string").parquet(folder) if _has_rows(spark, folder) else spark.createDataFrame([], "row string, name string")
    tables = {}
    for name in curly.TABLES:
        schema = spark.createDataFrame([], SCHEMAS[name]).schema
        # a row is a JSON list; its items take their columns' types (try_cast: a filter on them may run before that on the name)
        items = F.from_json("row", "array<string>")
        cells = [(F.from_json(F.get(items, F.lit(i)), f.dataType.simpleString()) if f.dataType.typeName() in ("array", "struct") else F.get(items, F.lit(i)).try_cast(f.dataType)).alias(f.name) for i, f in enumerate(schema)]
        tables[name] = stored(parsed.where(F.col("name") == name).select(*cells), f"facts-{name}")
    return Facts(spark, tables | {"files": files.meta(scanned), "source_lines": files.lines(scanned), "imports": files.imports(scanned)})
