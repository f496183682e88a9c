"""Labels for a stream of points by a fitted model; stateless, so late and repeated points need no care."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators.dense import Cells, shares
from crestline.operators.fit import GraphModel


def score(points: DataFrame, model: GraphModel, ksig: float = 7.0) -> DataFrame:
    """(id, node, r) of each point of a table or stream: its component, or -1, and that component's share (0 with none).
    The model goes along with the task's function; nothing is shuffled."""
    floor = model.alpha / model.area if model.background else 0.0
    kind = points.schema["id"].dataType.simpleString()

    def run(batches):
        cells = Cells(model.positions, model.sig, ksig)
        for batch in batches:
            own = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]], 1)
            usable = np.flatnonzero(np.isfinite(own).all(1))
            node, best = np.full(len(own), -1, np.int64), np.zeros(len(own))
            for p, k, r in shares(cells, own[usable], model.sig, model.pi, floor):
                order = np.lexsort((model.ids[k], -r, p))
                first = order[np.concatenate(([True], p[order][1:] != p[order][:-1]))]
                inside = np.bincount(p, r, len(usable))
                kept = first[(inside[p[first]] >= 0.5)] if floor > 0 else first
                node[usable[p[kept]]] = model.ids[k[kept]]
                best[usable[p[kept]]] = r[kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(best)], ["id", "node", "r"])

    return points.select("id", *[F.col(d).cast("double").alias(d) for d in model.dims]).mapInArrow(run, f"id {kind}, node bigint, r double")
