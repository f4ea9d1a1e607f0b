"""Journey topics: embed, reduce, cluster by density, describe each topic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import density, topics, vectors
from wayfarer.operators.hierarchy import dense_numbers
from wayfarer.session import materialize


@dataclass
class TopicResult:
    assignments: DataFrame  # user_id, topic (-1 = outlier)
    keywords: DataFrame     # topic, keyword, weight, rank
    info: DataFrame         # topic, count, name, keywords, representative_docs
    prompts: DataFrame      # topic, prompt
    labels: DataFrame       # topic, label (NULL without a labeler)


def journey_topics(journeys: DataFrame, min_topic_size: int = 100, id_col: str = "user_id",
                   text_col: str = "activity_list_text", embedder=None,
                   instruction: str = topics.INSTRUCTION, labeler=None, k: int = 5,
                   cell_size: float | None = None, n_keywords: int = 10,
                   reduce_threshold: float | None = 0.9, n_docs: int = 3,
                   diversity: float = 0.5, reduced: DataFrame | None = None) -> TopicResult:
    """Topics over journey texts; topic ids are ordered by size (0 = largest).

    ``reduce_threshold`` merges topics whose class TF-IDF weights over labels have at
    least that cosine (the automatic topic reduction); ``None`` keeps every topic.
    ``reduced`` gives the journeys with their reduced vectors (``pca``) if they are known.
    ``n_docs`` distinct texts stand for a topic in ``info`` and its prompt, chosen
    among all its texts with ``diversity`` (0 to 1) as the weight of their difference.
    """
    journeys = materialize(journeys.select(id_col, "activity_list", text_col))
    if reduced is not None:
        red = reduced
    elif embedder is None:
        red = vectors.components(journeys, topics.embed_labels(journeys, id_col=id_col), k, id_col)
    else:
        emb = topics.embed_with(journeys, embedder, instruction, id_col, text_col)
        red = materialize(vectors.standardized_components(emb, "embedding", k, "pca"))
    clustered = materialize(density.density_cluster(red, "pca", cell_size=cell_size,
                                                    min_cluster_size=min_topic_size, size_in_rows=True)
                            .withColumn("topic", F.col("cluster").cast("int")))
    if reduce_threshold is None:
        groups = clustered.filter("topic >= 0").select("topic").distinct().withColumn("merged", F.col("topic"))
    else:
        # Whole labels are the words here: those of a text share the same opening.
        first = topics.class_weights(clustered.filter("topic >= 0"), words=F.col("activity_list"))
        groups = topics.merge_similar(first, reduce_threshold)
        # A topic without a word is like no other.
        groups = clustered.filter("topic >= 0").select("topic").distinct().join(groups, "topic", "left").select(
            "topic", F.coalesce("merged", "topic").alias("merged"))
    # Sizes and ranks after merging: a distributed sort over the topics, numbered.
    sizes = clustered.groupBy("topic").agg(F.count(F.lit(1)).alias("count")).join(groups, "topic")
    order = materialize(sizes.groupBy("merged").agg(F.sum("count").alias("count")).orderBy(
        F.col("count").desc(), "merged").select("merged", F.monotonically_increasing_id().alias("m")))
    ids = groups.join(dense_numbers(order, "m"), "merged").select("topic", F.col("label").cast("int").alias("ranked"))
    assigned = materialize(clustered.join(ids, "topic", "left").withColumn(
        "topic", F.coalesce("ranked", F.lit(-1)).cast("int")).drop("ranked"))
    assignments = assigned.select(id_col, "topic")
    kw = topics.class_tfidf(assigned.select("topic", F.col(text_col).alias("text")),
                            "topic", "text", n_keywords)
    kw_list = kw.groupBy("topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))),
                    lambda x: x["keyword"]).alias("keywords"))
    # Closeness to the topic centre is measured in the reduced space (k values
    # per row), so no row's embedding is ever densified.
    reps = topics.representative_docs(assigned.select("topic", "pca",
                                                      F.col(text_col).alias("doc")),
                                      vec_col="pca", n_docs=n_docs, diversity=diversity)
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    info = (counts.join(kw_list, "topic", "left").join(reps, "topic", "left")
            .withColumn("name", F.concat_ws("_", F.col("topic").cast("string"),
                                            F.slice(F.coalesce("keywords", F.array()), 1, 4)))
            .select("topic", "count", "name", "keywords", "representative_docs"))
    prompts = topics.render_prompts(info.filter(F.col("topic") >= 0))
    labels = topics.label_topics(prompts, labeler)
    return TopicResult(assignments, kw, info, prompts, labels)
