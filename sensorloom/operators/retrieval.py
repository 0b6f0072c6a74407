"""Exact nearest-chunk retrieval and context text."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.cells import HITS, Cells, by_width, lay_out, nearest_in_batch, search, vectors_of
from sensorloom.operators.chunks import strip
from sensorloom.operators.fleet import anomalous_parameters, join_lines
from sensorloom.operators.ordered import last_rows
from sensorloom.scale import shared_root
from sensorloom.schema import RETRIEVE_K, SNIPPET_CHARS

#: most query vectors sent to every task; more are searched by cells
QUERY_BLOCK = 10_000
CHUNK_BLOCK = 50_000


def nearest(queries: DataFrame, chunks: DataFrame, k: int = RETRIEVE_K) -> DataFrame:
    """(query_id, id, distance, rank) of the ``k`` chunks nearest to each query, by brute force."""
    return _nearest(queries, chunks, k)[0]


def _nearest(queries: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, bool]:
    """The hits, and whether there are at most ``k * QUERY_BLOCK`` of them.

    Each task reduces its chunks to ``k`` per query before anything is shuffled, so neither pairs
    nor vectors move. A query set too large to send to every task is searched by cells instead. A query
    is near to the vectors of its own width only.
    """
    # a row without a vector is nearest to nothing
    vectors, asked = vectors_of(chunks, "id"), vectors_of(queries, "query_id")
    schema = HITS.format(id=dict(chunks.dtypes)["id"])
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if not few:
        return chunks.sparkSession.createDataFrame([], schema + ", rank int"), True
    if len(few) > QUERY_BLOCK:
        folder = f"{shared_root(chunks.sparkSession)}/cells-{uuid.uuid4().hex[:12]}"
        return search(queries, lay_out(chunks, folder, block_rows=CHUNK_BLOCK), k, QUERY_BLOCK), False
    given = pd.DataFrame({"query_id": [r["query_id"] for r in few], "embedding": [np.array(r["embedding"], "float64") for r in few]})
    own = {width: (part["query_id"].to_numpy(), found) for width, part, found in by_width(given)}

    def scan(batches):
        best = None
        for batch in batches:
            for width, part, found in by_width(batch):
                if width in own:
                    hits = nearest_in_batch(*own[width], part["id"].to_numpy(), found, k)
                    best = hits if best is None else _keep(pd.concat([best, hits], ignore_index=True), k)
        if best is not None:
            yield best

    hits = last_rows(vectors.mapInPandas(scan, schema), ["query_id"], k, [F.col("distance"), F.col("id")])
    return hits, True


def _keep(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    return hits.sort_values(["query_id", "distance", "id"]).groupby("query_id").head(k)


def relevance(distance: Column) -> Column:
    return F.round(1.0 / (1.0 + distance), 3)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = RETRIEVE_K, cells: Cells | None = None) -> DataFrame:
    """Hits with source, page, section (null when blank), snippet and score; none when there are no chunks.

    Pass the ``cells`` that the chunks were laid out in to read only those that can hold a hit.
    """
    hits, bounded = _nearest(queries, chunks, k) if cells is None else (search(queries, cells, k), False)
    hits = F.broadcast(hits) if bounded else hits
    described = hits.join(chunks.select("id", "source", "page", "section", "text"), "id")
    return described.select(
        "query_id", "rank", "id", F.coalesce("source", F.lit("manual")).alias("source"), "page",
        F.when(F.col("section") != "", F.col("section")).alias("section"),
        F.substring(strip(F.col("text")), 1, SNIPPET_CHARS).alias("snippet"),
        relevance(F.col("distance")).alias("score"), "distance")


def context_block() -> Column:
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" §"), "section")).otherwise("")
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(", p."), F.col("page").cast("string"))).otherwise("")
    return F.concat(F.lit("["), "source", section, page, F.lit("] "), "snippet")


def format_context(hits: DataFrame) -> DataFrame:
    """One prompt-ready text per query, blocks in rank order."""
    return join_lines(hits, ["query_id"], ["rank"], context_block(), "\n\n", "context")


def augment_query(questions: DataFrame, machines: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Question plus machine name, type and anomalous parameters.

    Questions without a machine are given the anomalous parameters of the whole fleet.
    """
    known = machines.select(F.col("id").alias("machine_id"), "name", "machine_type")
    own = anomalous_parameters(anomalies).withColumnRenamed("parameters", "_own")
    fleet = anomalous_parameters(anomalies, by=None)
    rows = questions.join(known, "machine_id", "left").join(own, "machine_id", "left")
    parameters = F.when(F.col("machine_id").isNull(), fleet.scalar()).otherwise(F.col("_own"))
    terms = F.concat_ws(" ", F.array_compact(F.concat(
        F.array("name", F.when(F.col("machine_type") != "", F.col("machine_type"))),
        F.coalesce(parameters, F.array().cast("array<string>")))))
    return rows.select(*questions.columns, F.trim(F.concat_ws(" ", "question", terms)).alias("query"))
