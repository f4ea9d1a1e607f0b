"""Map the generic ``events`` table onto the flat clickstream schema.

The flat schema is the one the cleaning step reads (one row per user,
timestamp and event name, with page and traffic attributes).  The driver's
``events`` table has no page or traffic columns, so they are derived
deterministically from ``user_id``, ``ts``, ``event_type``, ``value`` and the
``k`` number inside ``props``.  The same rules are written as SQL in
``wayfarer.plans.oracles`` so DuckDB can rebuild identical rows.

Fixed values of the mapping (must stay equal to the oracle text):
  event_type view, click                -> page_view
  event_type signup                     -> session_start
  event_type purchase, value >= 150     -> purchase (the goal event)
  event_type purchase, value < 150      -> small_purchase
  anything else                         -> event_type unchanged
  host                                   https://Shop.Example.com
  page titles                           'Page <k%9>' + ' | Acme' or ' - Acme Shop'
  sources / mediums                     'Google ' / 'CPC', 'newsletter' / 'email',
                                        '(direct)' / '(none)', NULL / NULL
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parameters that go with the mapped data.
GOAL_EVENT = "purchase"
CONVERSION_PAGE_PATH = ["/thank-you/"]
BRAND = ["acme"]
REMOVAL_PHRASES = ["job", "career", "careers", "apply"]

HOST = "https://Shop.Example.com"


def clickstream_from_events(events: DataFrame) -> DataFrame:
    """Flat clickstream rows (one per event) from the ``events`` table."""
    return _mapped(events).drop("_k", "_uid", "_value")


def _mapped(events: DataFrame) -> DataFrame:
    """The flat columns plus the raw ``k``, user id and value they came from."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    uid = F.col("user_id").cast("string")
    pseudo = F.concat(uid, F.lit("."), (F.col("user_id") % 7).cast("string"))
    day = F.col("ts").cast("date")
    name = (F.when(F.col("event_type").isin("view", "click"), "page_view")
            .when(F.col("event_type") == "signup", "session_start")
            .when((F.col("event_type") == "purchase") & (F.col("value") >= 150), "purchase")
            .when(F.col("event_type") == "purchase", "small_purchase")
            .otherwise(F.col("event_type")))
    kk = F.col("k")
    engaged = F.when(kk % 10 == 0, F.lit(None)).when(F.col("value") >= 10, 1).otherwise(0)
    loc = (F.when(kk % 11 == 0, F.lit(None).cast("string"))
           .when(kk % 9 == 0, F.lit(HOST))
           .when(kk % 9 == 8, F.concat(F.lit(HOST + "/Thank-You"),
                                       F.when(kk % 2 == 0, "/").otherwise("?o=1")))
           .when((kk % 9 == 7) & (F.col("user_id") % 10 == 3), F.lit(HOST + "/Careers/open"))
           .otherwise(F.concat(F.lit(HOST + "/Page-"), (kk % 9).cast("string"),
                               F.when(kk % 3 == 0, "/").when(kk % 3 == 1, "?utm=x")
                               .otherwise("#top"))))
    title = F.when(kk % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Page "), (kk % 9).cast("string"),
                 F.when(kk % 2 == 0, " | Acme").otherwise(" - Acme Shop")))
    source = (F.when(kk % 4 == 0, "Google ").when(kk % 4 == 1, "newsletter")
              .when(kk % 4 == 2, "(direct)"))
    medium = (F.when(kk % 4 == 0, "CPC").when(kk % 4 == 1, "email")
              .when(kk % 4 == 2, "(none)"))
    return e.select(
        "event_id",
        pseudo.alias("user_pseudo_id"),
        day.alias("event_date"),
        F.col("ts").alias("event_timestamp"),
        name.alias("event_name"),
        F.concat(pseudo, F.lit("."), day.cast("string")).alias("ga_session_id"),
        F.dayofmonth(day).cast("long").alias("ga_session_number"),
        engaged.cast("long").alias("session_engaged"),
        loc.alias("page_location"),
        title.alias("page_title"),
        F.lit("(not set)").alias("campaign"),
        source.alias("source"),
        medium.alias("medium"),
        F.concat(F.coalesce(source, F.lit("(direct)")), F.lit(" / "),
                 F.coalesce(medium, F.lit("(not set)"))).alias("source_medium"),
        F.lit("(not set)").alias("geo_region"),
        F.lit("(not set)").alias("geo_city"),
        F.lit("desktop").alias("device_category"),
        F.col("k").alias("_k"), F.col("user_id").alias("_uid"), F.col("value").alias("_value"),
    )


def nested_export_from_events(events: DataFrame) -> DataFrame:
    """The ``events`` table as a nested export (the shape the shard reader reads).

    Same fixed mapping as the flat adapter for names, pages and traffic, plus:
    users with ``user_id % 13 = 0`` have no pseudo id; region is empty when
    ``k % 3 = 0``; city is NULL when ``k % 4 = 0``; device is NULL when
    ``k % 6 = 0``; a collected source (facebook / social / spring) overrides the
    first-touch one when ``k % 5 = 1``; ``ga_session_id`` is missing when
    ``k % 7 = 0``; ``session_engaged`` is missing when ``k % 10 = 0``; rows with
    ``k % 17 = 0`` have no parameters at all; rows with ``event_id % 10 = 0``
    appear twice.  ``_table_suffix`` names the daily shard (the last day is
    an intraday shard for even users).
    """
    from wayfarer.functions.timeutil import epoch_ntz

    # One projection of the events (no self-join), copies made by explode.
    base = _mapped(events).withColumnRenamed("_k", "k").withColumnRenamed("_uid", "user_id") \
        .withColumnRenamed("_value", "value")
    base = base.withColumn("_copy", F.explode(
        F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0)))))
    kk, uid = F.col("k"), F.col("user_id")
    day = F.dayofmonth("event_date").cast("long")

    def param(key, s=None, i=None):
        return F.struct(F.lit(key).alias("key"), F.struct(
            (s if s is not None else F.lit(None).cast("string")).alias("string_value"),
            (i if i is not None else F.lit(None).cast("long")).alias("int_value")).alias("value"))

    params = F.array(
        param("ga_session_id", i=F.when(kk % 7 != 0, uid * 100 + day)),
        param("ga_session_number", i=day),
        param("session_engaged", s=F.when(kk % 10 != 0, F.when(F.col("value") >= 10, "1")
                                          .otherwise("0"))),
        param("page_location", s=F.col("page_location")),
        param("page_title", s=F.col("page_title")))
    params = F.filter(params, lambda p: p["value"]["string_value"].isNotNull()
                      | p["value"]["int_value"].isNotNull())
    params = F.when(kk % 17 == 0, F.array().cast(params_type())).otherwise(params)
    manual = kk % 5 == 1
    suffix = F.date_format("event_date", "yyyyMMdd")
    last_day = F.col("event_date") == F.lit("2024-01-30").cast("date")
    raw = base.select(
        "event_id",
        F.date_format("event_date", "yyyyMMdd").alias("event_date"),
        "event_name",
        F.timestamp_diff("MICROSECOND", epoch_ntz(), F.col("event_timestamp"))
        .alias("event_timestamp"),
        F.when(uid % 13 != 0, F.col("user_pseudo_id")).alias("user_pseudo_id"),
        F.struct(F.when(kk % 3 == 0, F.lit("")).otherwise(
                     F.concat(F.lit("Region "), (uid % 5).cast("string"))).alias("region"),
                 F.when(kk % 4 != 0, F.concat(F.lit("City "), (uid % 3).cast("string")))
                 .alias("city")).alias("geo"),
        F.struct(F.when(kk % 6 != 0, F.when(uid % 2 == 0, "mobile").otherwise("desktop"))
                 .alias("category")).alias("device"),
        F.struct(F.concat(F.lit("campaign_"), (uid % 4).cast("string")).alias("name"),
                 F.col("medium").alias("medium"), F.col("source").alias("source"))
        .alias("traffic_source"),
        F.struct(F.when(manual, "spring").alias("manual_campaign_name"),
                 F.when(manual, "social").alias("manual_medium"),
                 F.when(manual, "facebook").alias("manual_source"))
        .alias("collected_traffic_source"),
        params.alias("event_params"),
        F.when(last_day & (uid % 2 == 0), F.concat(F.lit("intraday_"), suffix))
        .otherwise(suffix).alias("_table_suffix"))
    return raw.drop("event_id")


def params_type() -> str:
    return ("array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>")
