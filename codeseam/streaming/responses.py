"""Model responses that arrive in pieces: complete JSON objects as soon as they are there, one state for each stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.patterns import objects_in


def json_objects(pieces: DataFrame) -> DataFrame:
    """(stream, object) of pieces (stream, seq, piece): pieces of a batch are put together in order of seq; what doesn't
    end yet waits for the next batch. State: the text after the last object."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        found, rest = objects_in((state.get[0] if state.exists else "") + "".join(rows["piece"].fillna("")))
        state.update((rest,))
        yield pd.DataFrame({"stream": [key[0]] * len(found), "object": found})

    return pieces.groupBy("stream").applyInPandasWithState(step, "stream string, object string", "rest string", "append", GroupStateTimeout.NoTimeout)
