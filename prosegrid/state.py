"""Workflows and their states in a small table of JSON documents, one immutable file a version.

The folder may be of any file system that Spark writes. A change is a new file, named by the id and
the version, which must not exist yet: of two writers that start from one version the second gets
a ``Conflict``. The newest version of an id counts, so readers never see half a write.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any, Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, version long, created timestamp, updated timestamp, config string, source_state string, sink_state string, analyzer_state string, deleted boolean"
KINDS = ("source", "sink", "analyzer")


@dataclass
class Workflow:
    config: dict[str, Any] = field(default_factory=dict)
    states: dict[str, dict | None] = field(default_factory=dict)
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


def upsert(current: DataFrame, changes: DataFrame, *, key: str = "id", version: str = "version") -> DataFrame:
    """The newest version of each key of both frames."""
    both = current.unionByName(changes, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


class Conflict(RuntimeError):
    """Another writer has changed the workflow meanwhile; read it again."""


class Store(Protocol):
    """What a pipeline and its parts need of a store."""

    def get(self, workflow_id: str) -> Workflow | None: ...

    def get_state(self, workflow_id: str, kind: str) -> dict | None: ...

    def update_state(self, workflow_id: str, kind: str, state: dict | None) -> None: ...


class WorkflowStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.path)

    def _newest(self) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMA)
        return upsert(self._table(), empty).where("not deleted")

    def _write(self, row: dict) -> None:
        row["updated"] = datetime.now(timezone.utc)
        own = {k: (v.astimezone(timezone.utc).isoformat() if isinstance(v, datetime) else v) for k, v in row.items() if v is not None}
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{row['id']}-{row['version']}.json")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(at):
            raise Conflict(row["id"])
        try:
            out = files.create(at, False)  # fails if another writer was faster
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in str(error.java_exception):
                raise
            raise Conflict(row["id"]) from error
        out.write(bytearray(json.dumps(own).encode()))
        out.close()

    def _row(self, workflow_id: str) -> dict | None:
        found = self._newest().where(F.col("id") == workflow_id).take(1)
        return found[0].asDict() if found else None

    def _need(self, workflow_id: str) -> dict:
        if (row := self._row(workflow_id)) is None:
            raise KeyError(f"no workflow {workflow_id!r}")
        return row

    @staticmethod
    def _workflow(row: dict) -> Workflow:
        states = {k: json.loads(row[f"{k}_state"]) for k in KINDS if row[f"{k}_state"]}
        return Workflow(json.loads(row["config"]), states, row["id"])

    def get(self, workflow_id: str) -> Workflow | None:
        row = self._row(workflow_id)
        return self._workflow(row) if row else None

    def get_all(self) -> list[Workflow]:
        return [self._workflow(r.asDict()) for r in self._newest().orderBy("id").toLocalIterator()]

    def add_workflow(self, workflow: Workflow) -> None:
        if self._row(workflow.id) is not None:
            raise KeyError(f"workflow {workflow.id!r} exists")
        states = {f"{k}_state": json.dumps(workflow.states[k]) if workflow.states.get(k) is not None else None for k in KINDS}
        now = datetime.now(timezone.utc)
        self._write({"id": workflow.id, "version": 1, "created": now, "config": json.dumps(workflow.config), **states, "deleted": False})

    def update_workflow(self, workflow: Workflow) -> None:
        row = self._need(workflow.id)
        states = {f"{k}_state": json.dumps(v) for k, v in workflow.states.items() if v is not None}
        self._write({**row, **states, "config": json.dumps(workflow.config), "version": row["version"] + 1})

    def delete_workflow(self, workflow_id: str) -> None:
        row = self._need(workflow_id)
        self._write({**row, "deleted": True, "version": row["version"] + 1})

    def get_state(self, workflow_id: str, kind: str) -> dict | None:
        found = self.get(workflow_id)
        return found.states.get(kind) if found else None

    def update_state(self, workflow_id: str, kind: str, state: dict | None) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is not one of {KINDS}")
        row = self._need(workflow_id)
        self._write({**row, f"{kind}_state": None if state is None else json.dumps(state), "version": row["version"] + 1})

    def get_source_state(self, workflow_id: str) -> dict | None:
        return self.get_state(workflow_id, "source")

    def get_sink_state(self, workflow_id: str) -> dict | None:
        return self.get_state(workflow_id, "sink")

    def get_analyzer_state(self, workflow_id: str) -> dict | None:
        return self.get_state(workflow_id, "analyzer")


def describe(workflow: Workflow) -> str:
    return json.dumps(asdict(workflow), ensure_ascii=False)
