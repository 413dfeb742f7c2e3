"""Running source, preprocessors, analyzers and sink as one lazy plan with one action at the sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from prosegrid.scratch import remove, scope, stored
from prosegrid.sources import cursor
from prosegrid.state import Workflow, WorkflowStore

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """``source`` gives a payload frame from the workflow's cursors; ``sink`` has ``send``. Without either nothing runs."""

    source: Callable[[DataFrame | None], DataFrame] | None = None
    steps: Sequence[Step] = field(default_factory=list)
    sink: object | None = None

    def plan(self, cursors: DataFrame | None = None) -> DataFrame | None:
        if self.source is None:
            return None
        out = self.source(cursors)
        for step in self.steps:
            out = out.transform(step)
        return out

    def run(self, workflow: Workflow | None = None, store: WorkflowStore | None = None, *, progress: Callable[[DataFrame], DataFrame] | None = None) -> bool:
        """Sends what is new; the cursors move on only after the sink has taken everything (at least once).

        The source's rows are written first, and both the sink and the cursors see these rows, so
        that nothing that arrives meanwhile is marked as done. ``progress`` gives the records (key, id,
        ts) that the cursors follow, from the source's rows. Cursors are a table beside the store; the
        source state names it. A sink or step with a ``state`` method has its state kept, too.
        """
        if self.source is None or self.sink is None:
            return False
        if not (workflow and store and progress):
            self.sink.send(self.plan())
            return True
        spark = store.spark
        before = (store.get_source_state(workflow.id) or {}).get("cursors")
        cursors = spark.read.schema(cursor.CURSORS).parquet(before) if before else None
        with scope(spark):
            read = stored(self.source(cursors), "read")
            out = read
            for step in self.steps:
                out = out.transform(step)
            self.sink.send(out)
            path = f"{store.path}-cursors/{workflow.id}-{uuid.uuid4().hex}"
            cursor.advance(progress(read), cursors).write.parquet(path)
        store.update_state(workflow.id, "source", {"cursors": path})
        if before:
            remove(spark, before)
        for kind, parts in (("sink", [self.sink]), ("analyzer", self.steps)):
            states = {str(n): part.state() for n, part in enumerate(parts) if hasattr(part, "state")}
            if states:
                store.update_state(workflow.id, kind, states)
        return True
