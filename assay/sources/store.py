"""Files of the driver's side: schemas, plans, controls, manifests and reports, as YAML or JSON; and normalized datasets."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
from dataclasses import asdict
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from assay.plans.model import Control, Plan, control_from, plan_from
from assay.results import dumps

from .reader import exists, read_raw
from .columns import NULL_TOKENS, ColumnSchema, spark_schema, typed


def load(path: str | os.PathLike) -> Any:
    """A YAML or JSON file, by its suffix."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def save(path: str | os.PathLike, value: Any, replace: bool = True) -> bool:
    """Write YAML or JSON; whether it was written. The file appears whole or not at all."""
    path = Path(path)
    if path.exists() and not replace:
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".json":
        text = dumps(value)
    elif path.suffix in (".yaml", ".yml"):
        import yaml

        text = yaml.safe_dump(json.loads(dumps(value)), sort_keys=False, allow_unicode=True)
    else:
        text = value
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)
    return True


def save_schema(path: str | os.PathLike, dataset: str, schema: list[ColumnSchema], replace: bool = False) -> bool:
    """A dataset's schema. One that is there stays, as it may have been edited, unless it is to be replaced."""
    return save(path, {"dataset": dataset, "columns": [asdict(c) for c in schema]}, replace)


def load_schema(path: str | os.PathLike) -> list[ColumnSchema]:
    return [ColumnSchema(c["source_name"], c["normalized_name"], c["type"], bool(c.get("nullable", True)), tuple(c["date_formats_tried"]) if c.get("date_formats_tried") else None) for c in load(path)["columns"]]


def load_plan(path: str | os.PathLike) -> Plan:
    return plan_from(load(path))


def load_control(path: str | os.PathLike) -> Control:
    return control_from(load(path))


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one on a single machine, an error on a cluster without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="assay-run-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def delete(spark: SparkSession, path: str) -> None:
    """A file or folder in any store; nothing if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Registry:
    """Datasets by id: where the raw file is, which sheet, which columns must be there. The last registration holds."""

    def __init__(self, control: Control | None = None):
        self.entries = {d.dataset_id: d for d in (control.datasets if control else ())}

    def register(self, dataset) -> None:
        self.entries[dataset.dataset_id] = dataset

    def __getitem__(self, dataset_id: str):
        if dataset_id not in self.entries:
            raise KeyError(f"dataset {dataset_id!r} is not registered")
        return self.entries[dataset_id]


def ingest(spark: SparkSession, raw: str, target: str, schema_path: str | os.PathLike, dataset: str, sheet: str | None = None, required: tuple[str, ...] = (), force: bool = False, tokens: tuple[str, ...] = NULL_TOKENS, multiline: bool | None = None) -> DataFrame:
    """Read a raw file, type it, and write it as Parquet at ``target``; what is there already is read again unless forced.

    The first run writes the schema; later ones follow the file, which may have been edited. Missing required columns are an
    error before anything is written.
    """
    if not force and Path(schema_path).exists() and exists(spark, f"{target}/_SUCCESS"):
        return spark.read.schema(spark_schema(load_schema(schema_path))).parquet(target)
    df, headers = read_raw(spark, raw, sheet, multiline)
    overrides = {c.normalized_name: c.type for c in load_schema(schema_path)} if Path(schema_path).exists() else None
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"dataset {dataset!r} lacks required columns: {', '.join(missing)}")
    df, schema = typed(df, headers, overrides, tokens)
    df.write.mode("overwrite").parquet(target)
    save_schema(schema_path, dataset, schema)
    return spark.read.schema(spark_schema(schema)).parquet(target)
