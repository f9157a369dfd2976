"""Enrichment of resources by results that come later: those of a content that has changed meanwhile are discarded."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "uri string, version long, content_hash string, result string, n_discarded long"
STATE = "version long, content_hash string, results string, n_discarded long"
_JOIN = "\x1e"  # between the parts of results that wait


def enriched(events: DataFrame) -> DataFrame:
    """OUT for each resource whose state changed: the content that counts, and its result or null.

    events: (uri, kind, version, content_hash, result). Those of kind `resource` say that the content is now of this hash;
    of several the greatest version counts, and of equal versions the greatest hash. Those of kind `result` bring the
    result of a content by its hash; one whose hash isn't that of the content that counts is discarded, unless the
    content has yet to be told of: results wait by their hash until a later version comes. A null content_hash says that
    the resource is gone, so nothing counts for it. A stream keeps a row a resource; the last row of each uri is what a table gives,
    in whatever order events come. Rows without a uri or kind are left out.
    """
    rows = events.filter("uri is not null and kind in ('resource', 'result')").select("uri", "kind", F.col("version").cast("long").alias("version"), "content_hash", "result")
    return _streamed(rows) if rows.isStreaming else _at_once(rows)


def _at_once(rows: DataFrame) -> DataFrame:
    told = rows.filter("kind = 'resource'").groupBy("uri").agg(F.max(F.struct(F.coalesce("version", F.lit(0)).alias("version"), F.coalesce("content_hash", F.lit("")).alias("content_hash"))).alias("r")).select("uri", "r.*")
    results = rows.filter("kind = 'result' and content_hash is not null").groupBy("uri", "content_hash").agg(F.max("result").alias("result"))
    met = results.join(told.select("uri", F.col("content_hash").alias("_now")), "uri", "left")
    lost = met.groupBy("uri").agg(F.count_if(F.coalesce("_now", F.lit("")) != F.col("content_hash")).alias("n_discarded"))
    own = told.join(results, ["uri", "content_hash"], "left").join(lost, "uri", "left")
    return own.select("uri", "version", F.nullif("content_hash", F.lit("")).alias("content_hash"), F.when(F.col("content_hash") != "", F.col("result")).alias("result"), F.coalesce("n_discarded", F.lit(0)).cast("long").alias("n_discarded"))


def _streamed(rows: DataFrame) -> DataFrame:
    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, now, kept, _ = state.get if state.exists else (None, "", "", 0)
        results = dict(x.split("\x1f", 1) for x in kept.split(_JOIN)) if kept else {}
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.kind == "resource":
                    told = (0 if pd.isna(row.version) else int(row.version), row.content_hash or "")
                    if version is None or told > (version, now):
                        version, now = told
                elif row.content_hash is not None:
                    results[row.content_hash] = max(results.get(row.content_hash, ""), row.result or "")
        lost = sum(h != now for h in results)
        state.update((version, now, _JOIN.join(f"{h}\x1f{r}" for h, r in sorted(results.items())), lost))
        if version is not None:
            yield pd.DataFrame({"uri": [key[0]], "version": [version], "content_hash": [now or None], "result": [results.get(now) if now else None], "n_discarded": [lost]})

    return rows.groupBy("uri").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
