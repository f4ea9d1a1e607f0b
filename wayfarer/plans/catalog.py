"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All read the driver's tables (``events`` through the clickstream adapter,
``documents``, ``pages``, ``embeddings``) so their work grows with the data.
Array results are also given in text form (`` -> `` joined) so they compare
across engines.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.text import url_path
from wayfarer.operators import attribution, users
from wayfarer.operators import density as DN
from wayfarer.operators import divergence as D
from wayfarer.operators import importance as IM
from wayfarer.operators import isolation as IS
from wayfarer.operators import patterns as P
from wayfarer.operators import reports as RP
from wayfarer.operators import sampling as SA
from wayfarer.operators import topics as TP
from wayfarer.operators import vectors as V
from wayfarer.plans import cluster_queries
from wayfarer.plans import review as RV
from wayfarer.plans import topics as TT
from wayfarer.plans.journey_plan import JourneyParams, journey_stages
from wayfarer.plans.workload import (ALL_MIN_FREQ, ALL_MIN_LEN, CLASS_MIN_FREQ, CLASS_MIN_LEN,
                                     DIVERGENCE_TOP, EXPORT_AS_OF, EXPORT_DAYS,
                                     IMPORTANCE_TOP, MEDIUM_COLUMNS, MIN_TOPIC_SIZE, REVIEW_TOP)
from wayfarer.session import materialize, read_table
from wayfarer.sources import events_adapter as A
from wayfarer.sources import ga_export as GX

PARAMS = JourneyParams(
    goal_event=A.GOAL_EVENT,
    conversion_page_path=tuple(A.CONVERSION_PAGE_PATH),
    brand=tuple(A.BRAND),
    removal_phrases=tuple(A.REMOVAL_PHRASES),
)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.clickstream_from_events(read_table(spark, sf_dir, "events"))


def stages(spark: SparkSession, sf_dir: str, **overrides):
    params = PARAMS if not overrides else JourneyParams(**{**PARAMS.__dict__, **overrides})
    return journey_stages(flat_events(spark, sf_dir), params)


JOURNEY_COLUMNS = ["user_id", "unique_days", "unique_pages", "unique_pageviews",
                   "engaged_sessions", "total_sessions", "activity_list_text",
                   "n_activities", "converted"]


def _journeys_out(st) -> DataFrame:
    from wayfarer.operators.journeys import flag_converted
    j = flag_converted(st.journeys, st.converters)
    return j.withColumn("n_activities", F.size("activity_list").cast("long")) \
        .select(*JOURNEY_COLUMNS)


def q_clickstream(spark, sf_dir):
    return flat_events(spark, sf_dir)


def q_relevant_events(spark, sf_dir):
    from wayfarer.operators.clean import relevant_events
    return relevant_events(flat_events(spark, sf_dir), PARAMS.goal_event)


def q_clean_events(spark, sf_dir):
    return stages(spark, sf_dir, write_clean=False).clean


def q_event_gaps(spark, sf_dir):
    return stages(spark, sf_dir, write_clean=False).clean.select(
        "user_id", "event_id", "event_name", "event_timestamp", "event_timestamp_diff")


def q_user_counts(spark, sf_dir):
    return stages(spark, sf_dir).counts


def q_multi_page_users(spark, sf_dir):
    return users.multi_page_users(stages(spark, sf_dir, write_clean=False).counts)


def q_converters(spark, sf_dir):
    return stages(spark, sf_dir, write_clean=False).converters


def q_removed_users(spark, sf_dir):
    st = stages(spark, sf_dir)
    return users.removed_users(st.multi, PARAMS.removal_phrases)


def q_first_conversion(spark, sf_dir):
    st = stages(spark, sf_dir)
    return users.first_conversion(st.kept, PARAMS.conversion_page_path)


def q_truncated_events(spark, sf_dir):
    return stages(spark, sf_dir).truncated


def q_labelled_events(spark, sf_dir):
    return stages(spark, sf_dir).labelled.select(
        "user_id", "event_id", "event_name", "event_timestamp", "label")


def q_journeys(spark, sf_dir):
    return _journeys_out(stages(spark, sf_dir))


def q_journeys_with_mix(spark, sf_dir):
    """Journeys plus one attribution column per medium ("first" strategy)."""
    st = stages(spark, sf_dir)
    wide = attribution.medium_mix_wide(st.mix_long, MEDIUM_COLUMNS)
    return _journeys_out(st).join(wide, "user_id", "left")


def q_journeys_by_title(spark, sf_dir):
    return _journeys_out(stages(spark, sf_dir, page_repr="page_title"))


def q_medium_counts(spark, sf_dir):
    return attribution.medium_counts(stages(spark, sf_dir, write_clean=False).clean)


def q_kept_mediums(spark, sf_dir):
    return attribution.kept_mediums(stages(spark, sf_dir).clean)


def q_medium_mix_first_by_time(spark, sf_dir):
    """First credit to the medium of the user's earliest session start."""
    return attribution.medium_mix_long(stages(spark, sf_dir).clean, "first", order_by="time")


def q_medium_mix_wide(spark, sf_dir):
    return attribution.medium_mix_wide(stages(spark, sf_dir).mix_long, MEDIUM_COLUMNS)


def q_journey_vectors(spark, sf_dir):
    """Binary label matrix in long form, all labels: nonzeros per journey."""
    j = journeys_df(spark, sf_dir)
    ones = V.label_weights(j).groupBy(F.col("id").alias("user_id")).agg(
        F.sum("w").cast("long").alias("n_features"))
    return j.select("user_id", "converted").join(ones, "user_id", "left").select(
        "user_id", F.coalesce("n_features", F.lit(0)).alias("n_features"), "converted")


def q_medium_mix_not_set(spark, sf_dir):
    """Even credit where a third of the events has no source_medium, so ``(not set)`` is a medium."""
    from dataclasses import replace

    flat = flat_events(spark, sf_dir)
    flat = flat.withColumn("source_medium", F.when(F.col("event_id") % 3 != 0, F.col("source_medium")))
    st = journey_stages(flat, replace(PARAMS, write_clean=True))
    return attribution.medium_mix_long(st.clean, "even")


def q_converted_events(spark, sf_dir):
    """The journey build's second output: labelled events with ``converted``."""
    from wayfarer.operators.journeys import flag_converted
    st = stages(spark, sf_dir)
    return flag_converted(st.labelled, st.converters).select(
        "user_id", "event_id", "event_name", "event_timestamp", "label", "converted")


def _mix(strategy):
    def q(spark, sf_dir):
        st = stages(spark, sf_dir)
        return attribution.medium_mix_long(st.clean, strategy)
    q.__name__ = f"q_medium_mix_{strategy}"
    return q


# ---- sequences and divergence -------------------------------------------------------


_JOURNEYS: dict = {}


def journeys_df(spark, sf_dir, **overrides):
    """Journeys with ``converted``, built once per session and input.

    The analyses all start from the same journeys (as one call of the journey
    build feeds every analysis); the table is a reliable checkpoint, so a lost
    executor does not send the analyses back to the raw events.
    """
    from wayfarer.operators.journeys import flag_converted
    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir), tuple(sorted(overrides.items())))
    if key not in _JOURNEYS:
        st = stages(spark, sf_dir, **overrides)
        _JOURNEYS[key] = materialize(flag_converted(st.journeys, st.converters), "journeys")
        st.close()
    return _JOURNEYS[key]


def _fingerprint(spark, sf_dir) -> tuple:
    """Files of the events table with size and time: a changed input is a new key."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(path)
    found = fs.listStatus(path) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


def forget_journeys() -> None:
    """Build the shared journeys anew at their next use."""
    _JOURNEYS.clear()


def q_frequent_sequences(spark, sf_dir):
    j = journeys_df(spark, sf_dir)
    return P.with_text(P.frequent_sequences(j, min_freq=ALL_MIN_FREQ, min_len=ALL_MIN_LEN))


def q_frequent_sequences_open(spark, sf_dir):
    j = journeys_df(spark, sf_dir)
    return P.with_text(P.frequent_sequences(j, min_freq=ALL_MIN_FREQ, min_len=1, closed=False))


def _class_patterns(spark, sf_dir):
    return D.class_patterns(journeys_df(spark, sf_dir), CLASS_MIN_FREQ, CLASS_MIN_LEN)


def q_conv_sequences(spark, sf_dir):
    return P.with_text(_class_patterns(spark, sf_dir)[0])


def q_nonconv_sequences(spark, sf_dir):
    return P.with_text(_class_patterns(spark, sf_dir)[1])


def q_conv_only_sequences(spark, sf_dir):
    conv, non = _class_patterns(spark, sf_dir)
    return P.with_text(D.split_shared(conv, non)[0])


def q_nonconv_only_sequences(spark, sf_dir):
    conv, non = _class_patterns(spark, sf_dir)
    return P.with_text(D.split_shared(conv, non)[1])


def q_shared_sequences(spark, sf_dir):
    conv, non = _class_patterns(spark, sf_dir)
    shared = D.split_shared(conv, non)[2]
    return shared.select(P.join_path("sequence").alias("sequence"),
                         F.size("sequence").cast("long").alias("length"))


def q_divergence_top(spark, sf_dir):
    return D.analyze_divergence(journeys_df(spark, sf_dir), top_n=DIVERGENCE_TOP,
                                min_freq=CLASS_MIN_FREQ, min_seq_len=CLASS_MIN_LEN)


def q_divergence_count(spark, sf_dir):
    conv, non = _class_patterns(spark, sf_dir)
    conv_only, non_only, _ = D.split_shared(conv, non)
    return D.divergence_count(non_only, conv_only)


def q_sequence_support(spark, sf_dir):
    """Support among non-converters of the converters' closed patterns."""
    j = journeys_df(spark, sf_dir)
    conv, _ = _class_patterns(spark, sf_dir)
    sup = P.sequence_support(j.filter(F.col("converted") == 0), conv)
    return sup.select(P.join_path("sequence").alias("sequence"), "support")


# ---- importance, segments, topics, pages ---------------------------------------------


def q_sequence_features(spark, sf_dir):
    j = journeys_df(spark, sf_dir)
    pats = P.frequent_sequences(j, min_freq=ALL_MIN_FREQ, min_len=ALL_MIN_LEN)
    f = IM.sequence_features(j, pats)
    return f.select("user_id", F.size("contained").cast("long").alias("n_contained"),
                    "converted")


def q_sequence_importance(spark, sf_dir):
    return IM.sequence_importance(journeys_df(spark, sf_dir), top_n=IMPORTANCE_TOP,
                                  min_freq=ALL_MIN_FREQ, min_seq_len=ALL_MIN_LEN)


def _reduced(spark, sf_dir):
    j = journeys_df(spark, sf_dir)
    return V.reduce(j.select("user_id", "activity_list", "converted"))


def q_journey_pca(spark, sf_dir):
    red = _reduced(spark, sf_dir)
    return red.select("user_id", "converted", V.as_array("pca").alias("pca"))


def q_density_clusters(spark, sf_dir):
    red = _reduced(spark, sf_dir)
    return DN.density_cluster(red).select("user_id", "converted", "cluster")


def _embedding_pca(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return materialize(V.principal_components(V.standardize(e, "v"), "scaled", 5).drop("v", "scaled"))


def q_embedding_clusters(spark, sf_dir):
    return DN.density_cluster(_embedding_pca(spark, sf_dir)).select("vec_id", "label", "cluster")


def q_isolation_scores(spark, sf_dir):
    scored = IS.isolation_scores(_embedding_pca(spark, sf_dir), "vec_id")
    return IS.flag_anomalies(scored).select("vec_id", "label", "anomaly_score", "anomaly")


def q_converter_review(spark, sf_dir):
    return RV.converter_review(journeys_df(spark, sf_dir), top_n=REVIEW_TOP, reducer="pca")


def _topics(spark, sf_dir):
    return TT.journey_topics(journeys_df(spark, sf_dir), min_topic_size=MIN_TOPIC_SIZE)


def q_journey_topics(spark, sf_dir):
    info = _topics(spark, sf_dir).info
    return info.select("topic", "count", "name", F.array_join("keywords", ", ").alias("keywords"),
                       F.array_join("representative_docs", "\n").alias("representative_docs"))


def q_topic_assignments(spark, sf_dir):
    return _topics(spark, sf_dir).assignments


def q_topic_prompts(spark, sf_dir):
    return _topics(spark, sf_dir).prompts


def q_topic_keywords(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return TP.class_tfidf(docs.select(F.col("lang").alias("topic"), "text"), "topic", "text")


def q_url_paths(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", url_path("url").alias("path"))


def q_balanced_journeys(spark, sf_dir):
    return SA.balance_classes(journeys_df(spark, sf_dir)).select(
        "user_id", "converted", P.join_path("activity_list").alias("activity_list_text"))


# ---- nested export source ------------------------------------------------------------


def _raw_export(spark, sf_dir):
    return A.nested_export_from_events(read_table(spark, sf_dir, "events"))


def q_export_dedup(spark, sf_dir):
    d = GX.dedup_raw(_raw_export(spark, sf_dir).drop("_table_suffix"))
    return d.select("user_pseudo_id", "event_name", "event_timestamp",
                    F.size("event_params").cast("long").alias("n_params"))


def q_export_events(spark, sf_dir):
    return GX.flatten_events(GX.dedup_raw(_raw_export(spark, sf_dir).drop("_table_suffix")))


def q_export_shards(spark, sf_dir):
    raw = GX.with_shard_columns(_raw_export(spark, sf_dir), F.col("_table_suffix"))
    kept = GX.prune_shards(raw, EXPORT_AS_OF, EXPORT_DAYS)
    return kept.groupBy("table_date", "is_intraday").agg(
        F.count(F.lit(1)).alias("n_events"))


def _shard_folder(spark, sf_dir) -> str:
    """The export as a folder of day shards, written under the shared checkpoint folder."""
    import uuid

    from wayfarer.session import ensure_checkpoint_dir
    from wayfarer import storage
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/shards-{uuid.uuid4().hex}"
    _raw_export(spark, sf_dir).withColumnRenamed("_table_suffix", "suffix").write.partitionBy(
        "suffix").parquet(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("suffix="):
            fs.rename(status.getPath(), path(f"{root}/events_{name[7:]}"))
    storage.keep_until_exit(root)
    return root


def q_export_scan(spark, sf_dir):
    """Shard folders inside the window, pruned by path, flattened and deduplicated."""
    return GX.load_export(spark, _shard_folder(spark, sf_dir), EXPORT_AS_OF, EXPORT_DAYS)


def q_clean_events_text_time(spark, sf_dir):
    """Cleaned events whose timestamps come as text, one in fifty of them unreadable."""
    flat = flat_events(spark, sf_dir)
    flat = flat.withColumn("event_timestamp", F.when(F.col("event_id") % 50 == 0, F.lit("no time"))
                           .otherwise(F.col("event_timestamp").cast("string")))
    from dataclasses import replace
    return journey_stages(flat, replace(PARAMS, write_clean=False)).clean


def q_export_journeys(spark, sf_dir):
    flat = GX.flatten_events(GX.dedup_raw(_raw_export(spark, sf_dir).drop("_table_suffix")))
    return _journeys_out(journey_stages(flat, PARAMS))


# ---- reports --------------------------------------------------------------------------


def q_divergence_report(spark, sf_dir):
    return RP.divergence_report(q_divergence_top(spark, sf_dir))


def q_user_counts_ranked(spark, sf_dir):
    return RP.by_pageviews(stages(spark, sf_dir).counts)


@lru_cache(maxsize=None)
def registry() -> dict:
    """Every registered query, by name."""
    return {
        # events -> journeys
        "clickstream": q_clickstream,
        "relevant_events": q_relevant_events,
        "clean_events": q_clean_events,
        "clean_events_text_time": q_clean_events_text_time,
        "event_gaps": q_event_gaps,
        "user_counts": q_user_counts,
        "user_counts_ranked": q_user_counts_ranked,
        "multi_page_users": q_multi_page_users,
        "converters": q_converters,
        "removed_users": q_removed_users,
        "first_conversion": q_first_conversion,
        "truncated_events": q_truncated_events,
        "labelled_events": q_labelled_events,
        "converted_events": q_converted_events,
        "journeys": q_journeys,
        "journeys_by_title": q_journeys_by_title,
        "journeys_with_mix": q_journeys_with_mix,
        "medium_counts": q_medium_counts,
        "kept_mediums": q_kept_mediums,
        "medium_mix_first": _mix("first"),
        "medium_mix_last": _mix("last"),
        "medium_mix_even": _mix("even"),
        "medium_mix_not_set": q_medium_mix_not_set,
        "medium_mix_wide": q_medium_mix_wide,
        "medium_mix_first_by_time": q_medium_mix_first_by_time,
        "balanced_journeys": q_balanced_journeys,
        # nested export source
        "export_dedup": q_export_dedup,
        "export_events": q_export_events,
        "export_shards": q_export_shards,
        "export_scan": q_export_scan,
        "export_journeys": q_export_journeys,
        # sequences and divergence
        "frequent_sequences": q_frequent_sequences,
        "frequent_sequences_open": q_frequent_sequences_open,
        "conv_sequences": q_conv_sequences,
        "nonconv_sequences": q_nonconv_sequences,
        "conv_only_sequences": q_conv_only_sequences,
        "nonconv_only_sequences": q_nonconv_only_sequences,
        "shared_sequences": q_shared_sequences,
        "sequence_support": q_sequence_support,
        "divergence_top": q_divergence_top,
        "divergence_count": q_divergence_count,
        "divergence_report": q_divergence_report,
        # importance, segments, topics, pages
        "sequence_features": q_sequence_features,
        "sequence_importance": q_sequence_importance,
        "journey_vectors": q_journey_vectors,
        "journey_pca": q_journey_pca,
        "density_clusters": q_density_clusters,
        "embedding_clusters": q_embedding_clusters,
        "isolation_scores": q_isolation_scores,
        "converter_review": q_converter_review,
        "journey_topics": q_journey_topics,
        "topic_assignments": q_topic_assignments,
        "topic_prompts": q_topic_prompts,
        "topic_keywords": q_topic_keywords,
        "url_paths": q_url_paths,
        **cluster_queries.QUERIES,
    }
