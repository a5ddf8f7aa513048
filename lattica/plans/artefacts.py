"""What a model run leaves behind, as views that pages of a dashboard query with parameters.

A run may lack some of its outputs.  Each one that is there becomes a view with the columns that it is known by; one
that is not becomes an empty view of the same columns, so that every page's query runs and has rows only for what there is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ARTEFACTS = {
    "scores": "entity string, score double", "scores_ci": "entity string, low double, high double",
    "steady_state": "entity string, steady_state double", "systemic_risk": "entity string, systemic_risk long",
    "coupling": "src string, dst string, w double", "pagerank": "entity string, pagerank double", "pagerank_ci": "entity string, low double, high double",
    "centrality_out": "entity string, centrality double", "centrality_in": "entity string, centrality double",
    "communities": "entity string, community int", "fiedler": "entity string, value double, side string", "embedding": "entity string, x array<double>",
    "components": "component int, eigenvalue double", "spectrum": "k int, re double, im double, magnitude double", "laplacian_values": "k int, value double",
    "alpha_ci": "low double, median double, high double", "universe": "entity string, name string, size double, size_period int",
    "metadata": "key string, value string",
}

#: Queries of the pages; names after a colon are their parameters.
PAGES = {
    "top_entities": """SELECT entity, steady_state, score, low, high, CAST(row_number() OVER (ORDER BY steady_state DESC, entity) AS INT) AS rank
        FROM steady_state LEFT JOIN scores USING (entity) LEFT JOIN scores_ci USING (entity) ORDER BY steady_state DESC, entity LIMIT :n""",
    "transmitters": """SELECT dst AS entity, sum(w) AS outgoing, count(*) AS links FROM coupling WHERE w > :least GROUP BY dst ORDER BY outgoing DESC, entity LIMIT :n""",
    "exposed": """SELECT src AS entity, max(w) AS largest, max_by(dst, struct(w, dst)) AS to FROM coupling GROUP BY src ORDER BY largest DESC, entity LIMIT :n""",
    "neighbours": """SELECT dst AS entity, w, score FROM coupling LEFT JOIN scores ON scores.entity = dst WHERE src = :entity AND w >= :least ORDER BY w DESC, dst LIMIT :n""",
    "map_layer": """SELECT entity, CASE :layer WHEN 'score' THEN score WHEN 'steady_state' THEN steady_state WHEN 'pagerank' THEN pagerank WHEN 'systemic_risk' THEN CAST(systemic_risk AS DOUBLE) END AS value
        FROM steady_state FULL JOIN scores USING (entity) FULL JOIN pagerank USING (entity) FULL JOIN systemic_risk USING (entity)""",
    "members": """SELECT community, count(*) AS n, array_join(array_sort(collect_list(entity)), ',') AS members, avg(score) AS mean_score
        FROM communities LEFT JOIN scores USING (entity) WHERE :community IS NULL OR community = :community GROUP BY community""",
    "scree": """SELECT component, eigenvalue, sum(eigenvalue) OVER (ORDER BY component) / sum(eigenvalue) OVER () AS cumulative FROM components WHERE component <= :n""",
    "overlay": """SELECT src, dst, w, a.x AS at_src, b.x AS at_dst FROM coupling JOIN embedding a ON a.entity = src JOIN embedding b ON b.entity = dst WHERE w >= :least ORDER BY w DESC, src, dst LIMIT :n""",
}


class Artefacts:
    """The outputs under ``folder``, one Parquet table each; ``present`` names those that are there and can be used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables: dict[str, DataFrame] = {}
        self.present: set[str] = set()
        for name, columns in ARTEFACTS.items():
            found = self._found(name, StructType.fromDDL(columns))
            if found is not None:
                self.present.add(name)
            self.tables[name] = spark.createDataFrame([], columns) if found is None else found

    def _found(self, name: str, schema: StructType) -> DataFrame | None:
        """The stored table with the columns that it is known by (absent ones are NULL), or None."""
        try:
            stored = self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        known = {c.lower(): c for c in stored.columns}
        return stored.select(*[(F.col(known[f.name]) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def page(self, name: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
        """A page's query; a parameter that is not given is NULL."""
        for view, df in self.tables.items():
            df.createOrReplaceTempView(view)
        text = PAGES[name]
        given = {p: None for p in ("n", "least", "entity", "layer", "community") if f":{p}" in text} | dict(parameters or {})
        return self.spark.sql(text, args=given)


def save(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write outputs under the names that ``Artefacts`` reads; unknown names are an error before anything is written."""
    unknown = set(tables) - set(ARTEFACTS)
    if unknown:
        raise KeyError(f"{sorted(unknown)} are no outputs of a model run")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
