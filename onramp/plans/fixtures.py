"""Inputs derived from the driver tables (mapping in FIXTURES.md, part B).

Everything here is computed by Spark from ``events`` (and ``customer`` / ``orders`` for
the orders-based scale form), so its size grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from .. import schema as S
from ..operators import features as FT
from ..session import materialize
from ..sources.events import TOUCH_OF_KIND, read_events

TOUCH_KINDS = list(TOUCH_OF_KIND)

# ---------------------------------------------------------------------------
# fixed values of the fixture mapping
# ---------------------------------------------------------------------------
UNKNOWN_APP = "app_x"
UNKNOWN_APP_EVERY = 50          # requests of user_id % 50 = 0 go to the unknown app
DUP_EVERY = 7                   # second feature row (later row_no, latency + 1)
BAD_TEXT = [(11, "abc"), (13, ""), (17, "NaN")]   # user_id % m = 0 -> text, first match
ECHO_MINUTES = 90               # a click after install also shows a modal k % 90 minutes later
# files present per app (app ids not listed get every file)
INVENTORY_RULE = {
    "app_1": [f for f in S.MODEL_FILES if f != "cate_model.pkl"],
    "app_2": [f for f in S.MODEL_FILES if f != "pltv_amount_model.pkl"],
    "app_x": ["d3_purchase_model.pkl"],
}
# ---------------------------------------------------------------------------


class Fixture:
    """Lazily built, shared frames for one scale-factor directory.

    ``installs``, ``features`` and ``requests`` each feed several branches of the
    queries built on them; they are checkpointed once (``materialize``) so the event
    table is scanned once per derived table, not once per branch. Set
    ``materialized=False`` to keep everything as one lazy plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, window_s: float = 24 * 3600,
                 materialized: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.window_s = window_s
        self.materialized = materialized
        self._cache: dict = {}

    def _mat(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.materialized else df

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def events(self) -> DataFrame:
        return self._get("events", lambda: read_events(self.spark, self.sf_dir))

    @property
    def installs(self) -> DataFrame:
        return self._get("installs", lambda: self._mat(FT.installs(self.events), "installs"))

    @property
    def user_table(self) -> DataFrame:
        """Features and labels of every installed user, built in one pass (materialised)."""
        def build():
            t = FT.user_table(self.events, self.window_s, P.FIXTURE_PURCHASE_H_S, P.FIXTURE_CHURN_FROM_S,
                              P.FIXTURE_CHURN_TO_S, P.FIXTURE_LTV_H_S, inst=self.installs)
            return self._mat(t, "user_table")
        return self._get("user_table", build)

    @property
    def features(self) -> DataFrame:
        """25-feature table with ``row_no`` (= install event id), one row per installed user."""
        return self.user_table.select("app_id", "airbridge_uuid", "row_no", *S.ALL_FEATURES)

    @property
    def labels(self) -> DataFrame:
        """d3_purchase, d3_churn, ltv at the fixture horizons (NULL where not mature)."""
        return self.user_table.select("app_id", "airbridge_uuid", "d3_purchase", "d3_churn", "ltv")

    @property
    def features_with_duplicates(self) -> DataFrame:
        """Feature rows plus a later copy (higher row_no, latency + 1) for user_id % 7 = 0."""
        def build():
            f = self.features
            dup = (f.where(F.pmod(F.col("airbridge_uuid").cast("bigint"), F.lit(DUP_EVERY)) == 0)
                    .withColumn("row_no", F.col("row_no") + F.lit(1 << 40))
                    .withColumn("latency", F.col("latency") + F.lit(1.0)))
            return f.unionByName(dup)
        return self._get("features_dup", build)

    @property
    def models(self) -> DataFrame:
        """Per-app bundles: documents written as JSON to the shared folder and read back."""
        def build():
            import uuid
            from ..session import ensure_checkpoint_dir
            from ..sources import models as BM
            scale = F.lit(1.0)
            for app, x in P.APP_SCALE.items():
                scale = F.when(F.col("app_id") == app, F.lit(x)).otherwise(scale)
            root = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/onramp-tables/bundles-{uuid.uuid4().hex[:12]}"
            BM.write_model_bundles(BM.bundle_documents(self.installs.select("app_id").distinct(), scale), root)
            return BM.read_model_bundles(self.spark, root)
        return self._get("models", build)

    @property
    def features_text(self) -> DataFrame:
        """String copy of the feature table with bad text planted (CSV-like input)."""
        def build():
            uid = F.col("airbridge_uuid").cast("bigint")
            cols = []
            for c in S.ALL_FEATURES:
                e = None
                for m, txt in BAD_TEXT:
                    cond = F.pmod(uid, F.lit(m)) == 0
                    e = F.when(cond, F.lit(txt)) if e is None else e.when(cond, F.lit(txt))
                cols.append(e.otherwise(F.col(c).cast("string")).alias(c))
            return self.features.select("app_id", "airbridge_uuid", "row_no", *cols)
        return self._get("features_text", build)

    @property
    def requests(self) -> DataFrame:
        """Every click after install is a scoring request; user_id % 50 = 0 asks for app_x."""
        def build():
            e = self.events.where(F.col("source_type") == "click")
            j = e.join(self.installs, ["app_id", "user_id"]).where(F.col("ts") > F.col("t0"))
            app = F.when(F.pmod(F.col("user_id").cast("bigint"), F.lit(UNKNOWN_APP_EVERY)) == 0,
                         F.lit(UNKNOWN_APP)).otherwise(F.col("app_id"))
            return self._mat(j.select(F.col("event_id").alias("request_id"), app.alias("app_id"),
                                      F.col("user_id").alias("airbridge_uuid"), F.col("ts").alias("request_ts")),
                             "requests")
        return self._get("requests", build)

    @property
    def modal_events(self) -> DataFrame:
        """entry_modal_shown (every view) / entry_modal_clicked (every click) after install;
        trigger_type = trigger k % 4 in artifact order. Each click is also a request, so it
        shows a modal k % 90 minutes later (event id negated): within and beyond the TTL."""
        def build():
            e = self.events.where(F.col("source_type").isin(*TOUCH_KINDS))
            j = e.join(self.installs, ["app_id", "user_id"]).where(F.col("ts") > F.col("t0"))
            trig = F.element_at(F.array(*[F.lit(t) for t in S.TREATMENT_TRIGGERS]),
                                (F.pmod(F.col("k"), F.lit(4)) + 1).cast("int"))
            shown, clicked = F.lit(S.EV_MODAL_SHOWN), F.lit(S.EV_MODAL_CLICKED)
            own = F.struct(F.col("event_id").alias("event_id"), F.col("ts").alias("ts"),
                           F.when(F.col("touch_type") == "impression", shown).otherwise(clicked).alias("event_type"))
            later = F.timestamp_micros(F.unix_micros("ts") + F.pmod(F.col("k"), F.lit(ECHO_MINUTES)).cast("bigint") * F.lit(60_000_000))
            echo = F.struct((-F.col("event_id")).alias("event_id"), later.alias("ts"), shown.alias("event_type"))
            rows = F.when(F.col("touch_type") == "impression", F.array(own)).otherwise(F.array(own, echo))
            return (j.select("app_id", F.col("user_id").alias("airbridge_uuid"), trig.alias("trigger_type"), F.explode(rows).alias("m"))
                    .select("m.event_id", "app_id", "airbridge_uuid", "m.ts", "m.event_type", "trigger_type"))
        return self._get("modal", build)

    @property
    def inventory(self) -> DataFrame:
        """Artifact inventory (app_id, file, length, valid) for every app seen in requests."""
        def build():
            apps = self.requests.select("app_id").distinct()
            files = self.spark.createDataFrame(
                [(i, f) for i, f in enumerate(S.MODEL_FILES)], "pos int, file string")
            rule = self.spark.createDataFrame(
                [(a, f) for a, fs in INVENTORY_RULE.items() for f in fs], "app_id string, file string")
            ruled = F.broadcast(rule.select("app_id").distinct().withColumn("_ruled", F.lit(True)))
            # 7 file names x apps; then keep what the rule lists (unlisted apps keep all)
            grid = apps.crossJoin(F.broadcast(files)).join(ruled, "app_id", "left")
            kept = grid.join(F.broadcast(rule.withColumn("_listed", F.lit(True))), ["app_id", "file"], "left") \
                       .where(F.col("_ruled").isNull() | F.col("_listed").isNotNull())
            return self._mat(kept.select("app_id", "file", ((F.col("pos") + 1) * 1024).cast("bigint").alias("length"),
                                         F.lit(True).alias("valid")), "inventory")
        return self._get("inventory", build)
