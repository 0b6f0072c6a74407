"""The given tables in the shapes the operators take, as DataFrames and as SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.cleaning import machine_type
from sensorloom.operators.detectors import detect
from sensorloom.operators.features import features, fill_gaps
from sensorloom.scale import shared_root
from sensorloom.schema import PARAMETERS
from sensorloom.session import configure
from sensorloom.sources.store import Store

AN_THRESHOLD = 2.0
EVENT_OF = {"temperature": "view", "pressure": "click", "vibration": "purchase", "rpm": "error"}
PREFIXES = ["PUMP-", "MOTOR-", "VALVE-", "UNIT-"]
VERDICT_OF = {"1-URGENT": "URGENT_SERVICE", "2-HIGH": "SCHEDULE_SERVICE", "3-MEDIUM": "MONITOR",
              "4-NOT SPECIFIED": "SAFE", "5-LOW": "SAFE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixtures:
    """Lazily built shapes of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        configure(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def folder(self) -> str:
        """A new folder that driver and executors share, removed when the driver ends."""
        folder, context = f"{shared_root(self.spark).rstrip('/')}/checked-{uuid.uuid4().hex}", self.spark.sparkContext

        def remove() -> None:
            if context._jsc is not None and not context._jsc.sc().isStopped():
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        atexit.register(remove)
        return folder

    def store(self) -> Store:
        return Store(self.spark, f"{self.folder()}/tables")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def long_events(self) -> DataFrame:
        """One series per user, its values in event order."""
        return self.table("events").select(
            F.col("user_id").alias("machine_id"), (F.col("event_id") % 3).alias("dataset_id"),
            F.lit("value").alias("parameter"), "ts", F.col("event_id").alias("row_id"), "value")

    def wide_events(self) -> DataFrame:
        """Sparse wide readings: each event fills at most one of the four parameters."""
        return self.table("events").select(
            F.col("user_id").alias("machine_id"), (F.col("event_id") % 3).alias("dataset_id"), "ts",
            F.col("event_id").alias("row_id"),
            *[F.when(F.col("event_type") == e, F.col("value")).alias(p) for p, e in EVENT_OF.items()])

    def readings(self) -> DataFrame:
        """Wide readings after gap filling, with rolling features."""
        return features(fill_gaps(self.wide_events()))

    def machines(self) -> DataFrame:
        """One machine per user, plus two idle ones above the highest id."""
        ids = self.table("events").select("user_id").distinct()
        idle = ids.agg(F.max("user_id").alias("m")).select(F.explode(F.array(F.col("m") + 1, F.col("m") + 2)))
        every = ids.union(idle).withColumnRenamed("user_id", "id")
        prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("id") % 4 + 1).cast("int"))
        number = F.col("id").cast("string")
        padded = F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0")
        named = every.withColumn("name", F.concat(prefix, padded))
        return named.withColumn("machine_type", machine_type(F.col("name"))).withColumn(
            "location", F.concat(F.lit("Hall "), (F.col("id") % 3).cast("string")))

    def anomalies(self) -> DataFrame:
        return detect(self.long_events(), "zscore", AN_THRESHOLD)

    def wide_anomalies(self) -> DataFrame:
        return detect(self.readings(), "zscore", AN_THRESHOLD)

    def recommendations(self) -> DataFrame:
        verdict = F.element_at(F.create_map(*[F.lit(x) for kv in VERDICT_OF.items() for x in kv]),
                               F.col("o_orderpriority"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("machine_id"),
            F.col("o_custkey").cast("string").alias("session_id"),
            F.concat(F.lit("Is order class "), "o_orderpriority", F.lit(" ok?")).alias("question"),
            verdict.alias("verdict"), F.concat(F.lit("Total "), F.col("o_totalprice").cast("string")).alias("explanation"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))

    def logs(self) -> DataFrame:
        done = F.col("o_orderstatus") == "F"
        day = F.col("o_orderdate").cast("timestamp_ntz")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("recommendation_id"),
            F.col("o_custkey").alias("machine_id"), done.alias("actioned"),
            F.col("o_orderpriority").alias("notes"), F.when(done, day).alias("actioned_at"),
            day.alias("created_at"))

    def log_changes(self) -> DataFrame:
        """For every seventh log a flipped flag, then a note; every seventy-seventh is deleted."""
        logs = self.logs().filter(F.col("id") % 7 == 0)
        def change(days: int, actioned, notes, deleted):
            return F.struct((F.col("created_at") + F.expr(f"INTERVAL {days} DAYS")).alias("changed_at"),
                            actioned.alias("actioned"), notes.alias("notes"), deleted.alias("deleted"))
        steps = F.array(
            change(1, ~F.col("actioned"), F.lit(None).cast("string"), F.lit(False)),
            change(2, F.lit(None).cast("boolean"), F.concat(F.lit("seen "), "notes"), F.col("id") % 77 == 0))
        return logs.select("id", F.inline(steps))

    def pages(self) -> DataFrame:
        """Every document as one page of the manual named by its source."""
        return self.table("documents").select("source", (F.col("doc_id") + 1).alias("page"), "text")

    def chunks(self) -> DataFrame:
        """Documents that have a vector, as one-chunk manuals."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        texts = self.table("documents").select(
            F.col("doc_id").alias("id"), "source", (F.col("doc_id") % 7).cast("int").alias("page"),
            F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("section"), "text")
        return vectors.join(texts, "id")

    def centroids(self) -> DataFrame:
        """Mean vector of every label, as query vectors."""
        spread = self.table("embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
        means = spread.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
        ordered = F.sort_array(F.collect_list(F.struct("i", "v")))
        return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(
            F.transform(ordered, lambda x: x["v"]).alias("embedding"))

    def questions(self) -> DataFrame:
        """Benchmark texts as questions; every fifth is about the whole fleet."""
        item = F.col("item_id")
        return self.table("benchmark").select(
            item.alias("id"), F.when(item % 5 != 0, item).alias("machine_id"), F.col("text").alias("question"))

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("created_at"),
            "role", F.col("text").alias("content"))

    def user_turns(self) -> DataFrame:
        """User messages as questions about the machine numbered like their conversation."""
        turns = self.table("conversations").filter(F.col("role") == "user").select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("machine_id"),
            F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("question"),
            F.col("conv_id").alias("vec_id"))
        return turns.join(self.table("embeddings").select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


# ---- the same shapes as SQL -------------------------------------------------------------------

_WIDE = ", ".join(f"CASE WHEN event_type = '{e}' THEN value END AS {p}" for p, e in EVENT_OF.items())
_FORWARD = ", ".join(
    f"last_value({p} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts, row_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {p}" for p in PARAMETERS)
_BACKWARD = ", ".join(
    f"first_value({p} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts, row_id "
    f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {p}" for p in PARAMETERS)


def rolling_sql(source: str, window: int = 10) -> str:
    columns = ", ".join(
        f"avg({p}) OVER (PARTITION BY machine_id ORDER BY ts, row_id "
        f"ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS {p}_roll_avg, "
        f"coalesce({p} - lag({p}) OVER (PARTITION BY machine_id ORDER BY ts, row_id), 0.0) AS {p}_roc"
        for p in PARAMETERS)
    return f"SELECT *, {columns} FROM {source}"


def long_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT machine_id, dataset_id, '{p}' AS parameter, ts, row_id, {p} AS value FROM {source}"
        for p in PARAMETERS)


def severity_sql(score: str, high: float, medium: float) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'HIGH' WHEN {score} >= {medium} THEN 'MEDIUM' ELSE 'MONITOR' END"


def profile_sql(series: str) -> str:
    """One row per series: n, mean, std, low, high and normalised slope."""
    return f"""
      SELECT machine_id, parameter, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std,
             stddev_pop(value) AS std_pop, min(value) AS low, max(value) AS high,
             CASE WHEN count(value) >= 3 AND min(value) < max(value)
                  THEN regr_slope(value, idx) * count(value) / stddev_pop(value) ELSE 0.0 END AS trend_slope
      FROM (SELECT *, row_number() OVER (PARTITION BY machine_id, parameter ORDER BY ts, row_id) - 1 AS idx
            FROM {series} WHERE value IS NOT NULL)
      GROUP BY machine_id, parameter"""


ANOMALY_COLUMNS = ["machine_id", "dataset_id", "parameter", "ts", "row_id", "value"]


def zscore_sql(series: str, threshold: float, gate: int = 5, signed: bool = False, method: str = "zscore") -> str:
    z = "(s.value - p.mean) / p.std"
    shown = z if signed else f"abs({z})"
    columns = ", ".join(f"s.{c}" for c in ANOMALY_COLUMNS)
    severity = severity_sql(f"abs({z})", threshold * 1.5, threshold * 1.2)
    return f"""
      SELECT {columns}, {shown} AS z_score, {severity} AS severity,
             abs(p.trend_slope) >= 1.0 AS is_trending, p.trend_slope, '{method}' AS method
      FROM {series} s JOIN ({profile_sql(series)}) p USING (machine_id, parameter)
      WHERE p.n >= {gate} AND p.low < p.high AND abs({z}) >= {threshold}"""


CTES = {
    "el": "SELECT user_id AS machine_id, event_id % 3 AS dataset_id, 'value' AS parameter, ts, "
          "event_id AS row_id, value FROM events",
    "ew": f"SELECT user_id AS machine_id, event_id % 3 AS dataset_id, ts, event_id AS row_id, {_WIDE} FROM events",
    "ff": f"SELECT machine_id, dataset_id, ts, row_id, {_FORWARD} FROM ew",
    "fb": f"SELECT machine_id, dataset_id, ts, row_id, {_BACKWARD} FROM ff",
    "fw": rolling_sql("fb"),
    "fl": long_sql("fw"),
    "md": """
      SELECT id, name, CASE WHEN name LIKE 'PUMP%' THEN 'Hydraulic Pump' WHEN name LIKE 'MOTOR%' THEN 'Motor'
             WHEN name LIKE 'VALVE%' THEN 'Valve' ELSE 'Equipment' END AS machine_type,
             'Hall ' || (id % 3) AS location
      FROM (SELECT id, ['PUMP-', 'MOTOR-', 'VALVE-', 'UNIT-'][id % 4 + 1] ||
                       lpad(id::VARCHAR, greatest(4, length(id::VARCHAR))::INTEGER, '0') AS name
            FROM (SELECT DISTINCT user_id AS id FROM events
                  UNION ALL SELECT max(user_id) + 1 FROM events UNION ALL SELECT max(user_id) + 2 FROM events))""",
    "an": zscore_sql("el", AN_THRESHOLD),
    "aw": zscore_sql("fl", AN_THRESHOLD),
    "rq": "SELECT o_orderkey AS id, o_custkey AS machine_id, o_custkey::VARCHAR AS session_id, "
          "'Is order class ' || o_orderpriority || ' ok?' AS question, CASE o_orderpriority "
          + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICT_OF.items())
          + " END AS verdict, 'Total ' || o_totalprice::VARCHAR AS explanation, "
            "o_orderdate::TIMESTAMP AS created_at, o_orderstatus = 'F' AS actioned, o_orderpriority AS notes FROM orders",
    "ch": "SELECT vec_id AS id, embedding::DOUBLE[] AS embedding, source, (doc_id % 7)::INTEGER AS page, "
          "CASE WHEN lang = 'en' THEN '' ELSE lang END AS section, text "
          "FROM embeddings JOIN documents ON doc_id = vec_id",
    "qv": "SELECT label::BIGINT AS query_id, list(v ORDER BY i) AS embedding FROM (SELECT label, i, avg(v) AS v FROM "
          "(SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) "
          "GROUP BY label, i) GROUP BY label",
}
#: shapes a shape is built from
NEEDS = {"ff": ["ew"], "fb": ["ff"], "fw": ["fb"], "fl": ["fw"], "an": ["el"], "aw": ["fl"]}


def with_shapes(body: str, *shapes: str, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the shapes it names, in order of need."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        ordered.setdefault(name, CTES[name])

    for shape in shapes:
        add(shape)
    ordered |= extra or {}
    # shapes are used several times: computing each once keeps the check linear
    return "WITH RECURSIVE " + ", ".join(f"{n} AS{'' if f'FROM {n} ' in sql else ' MATERIALIZED'} ({sql})" for n, sql in ordered.items()) + " " + body
