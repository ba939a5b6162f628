"""A user's own name model as a source of hits."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import HITS_TYPE
from .dictionary import FOREIGN, _hit_array

# Executors get these functions by value, so they need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A model: texts of a batch -> per text its hits as (start, end, entity_type, score); ends exclusive, in characters.
Model = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]


def model_hits(text: Column | str, load: Callable[[], Model], batch: int = 512) -> Column:
    """Hits of a model, to be passed to any operator as ``extra_hits``.

    ``load`` runs once in every task, on the worker, before its first batch: a model is never sent through the driver.
    The model gets at most ``batch`` texts at a time, null texts left out. A hit outside its text is an error.
    """
    @F.arrow_udf(HITS_TYPE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = load()
        for texts, missing in batches:
            values = texts.to_pylist()
            asked = [i for i, gone in enumerate(missing.to_pylist()) if not gone]
            out: list = [None] * len(values)
            for a in range(0, len(asked), batch):
                part = asked[a:a + batch]
                told = model([values[i] for i in part])
                if len(told) != len(part):
                    raise ValueError(f"the model answered {len(told)} of {len(part)} texts")
                for i, hits in zip(part, told):
                    out[i] = [_hit(h, values[i]) for h in sorted(hits, key=lambda h: (h[0], h[1], h[2]))]
            yield _hit_array(out)

    # the text is named twice: see variants.replaced_udf
    column = F.col(text) if isinstance(text, str) else text
    return run.asNondeterministic()(column, column.isNull())


def _hit(hit, text: str) -> dict:
    start, end, kind, score = hit
    if not 0 <= start < end <= len(text):
        raise ValueError(f"the model's hit {start} to {end} is outside of its text of {len(text)} characters")
    return {"start": int(start), "end": int(end), "entity_type": str(kind), "score": float(score), "pattern_id": FOREIGN}
