"""Topic building blocks: embeddings, class TF-IDF keywords, representatives, prompts."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.vectors import ordered_sum
from wayfarer.session import materialize
from wayfarer.storage import Scratch

# The embedding instruction and the labelling prompt template.
INSTRUCTION = "Represent the intent of the user journey for users of a website"
PROMPT = """
I have a set of users that have the following page visit journey through our website.
The journeys are in the following format:
<Page Title A> -> <Page Title C> -> <Page Title N>

Here are the journeys:
[DOCUMENTS]

The pages visited have these keyword themes: [KEYWORDS]

Based on the information above, extract a short topic label that indicates the most likely persona (who is looking for this information) and intent of the users in the following format:
topic: <topic label>
"""

# Words of two or more letters, digits or underscores, lower-cased.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

#: Links between topics that one task unites.
IN_TASK = 100_000

Embedder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def tokens(text_col: str = "text") -> F.Column:
    return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN_PATTERN), 0),
                       lambda t: F.lower(t))


def _label_counts(df: DataFrame, seq_col: str, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.explode(seq_col).alias("label")).filter(
        F.col("label").isNotNull()).groupBy("id", "label").agg(F.count("*").alias("tf"))


def label_idf(df: DataFrame, seq_col: str = "activity_list", id_col: str = "user_id") -> DataFrame:
    """(label, idf): log((rows + 1) / (rows with the label + 1))."""
    n = df.count()
    return _label_counts(df, seq_col, id_col).groupBy("label").agg(F.log((n + 1) / (F.count("*") + 1)).alias("idf"))


def embed_labels(df: DataFrame, seq_col: str = "activity_list", id_col: str = "user_id",
                 idf: DataFrame | None = None) -> DataFrame:
    """Default embedding in long form: (id, label, w), TF-IDF over all labels, rows of length one.

    ``idf`` (label, idf) comes from the rows themselves if it is not given; labels
    that it does not know are left out.
    """
    idf = label_idf(df, seq_col, id_col) if idf is None else idf
    w = _label_counts(df, seq_col, id_col).join(idf, "label").withColumn("w", F.col("tf") * F.col("idf"))
    # Added up in the labels' order: rows of equal labels get equal vectors to the last bit.
    squares = w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("label", (F.col("w") * F.col("w")).alias("q")))).alias("t"))
    norm = squares.select("id", F.sqrt(ordered_sum("t", "q")).alias("norm"))
    return w.join(norm, "id").select("id", "label", F.when(
        F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(0.0).alias("w"))


def embed_with(df: DataFrame, embedder: Embedder, instruction: str, id_col: str,
               text_col: str, dim_hint: str = "array<float>") -> DataFrame:
    """Run a user model over (id, instruction, text) batches on the executors.

    ``embedder`` receives pandas batches with columns id (a row number), instruction,
    text and yields batches with id and ``embedding`` (a float list per row).
    """
    if not isinstance(instruction, str) or not instruction:
        raise ValueError("an embedding instruction must be given")
    # Rows are told apart by a number: ids may repeat.
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "to-embed")
    src = numbered.select(F.col("_row").alias("id"), F.lit(instruction).alias("instruction"),
                          F.col(text_col).alias("text"))
    out = src.mapInPandas(embedder, f"id long, embedding {dim_hint}")
    out = out.select(F.col("id").alias("_row"), array_to_vector(F.col("embedding")).alias("embedding"))
    return numbered.join(out, "_row").drop("_row")


def class_weights(docs: DataFrame, class_col: str = "topic", text_col: str = "text",
                  words: F.Column | None = None) -> DataFrame:
    """(class, word, weight): the class TF-IDF weight of every word of every class.

    ``words`` is an array column of words to take instead of the text's tokens.
    weight(t, c) = tf(t, c) / |c| * ln(1 + A / f(t)), where tf counts token t in
    class c, |c| is the token count of c, f(t) the count of t over all classes
    and A the whole-number mean of |c|.
    """
    words = docs.select(F.col(class_col).alias("_c"), F.explode(tokens(text_col) if words is None else words).alias(
        "word")).filter("word is not null")
    # Texts are tokenised once: the (class, word, count) table feeds every sum.
    tf = materialize(words.groupBy("_c", "word").agg(F.count(F.lit(1)).alias("tf")))
    size = tf.groupBy("_c").agg(F.sum("tf").alias("class_size"))
    ft = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    avg = size.select(F.floor(F.avg("class_size")).cast("double").alias("A"))
    a = avg.scalar()
    return tf.join(size, "_c").join(ft, "word").select(
        F.col("_c").alias(class_col), "word",
        (F.col("tf") / F.col("class_size") * F.log(F.lit(1.0) + F.lit(a) / F.col("f"))).alias("weight"))


def top_keywords(weights: DataFrame, class_col: str = "topic", top_k: int = 10) -> DataFrame:
    """(class, keyword, weight (rounded to 9 places), rank): the heaviest words of each class."""
    w = weights.select(F.col(class_col).alias("_c"), "word", F.round("weight", 9).alias("weight"))
    rank = Window.partitionBy("_c").orderBy(F.col("weight").desc(), F.col("word").asc())
    return (w.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top_k)
            .select(F.col("_c").alias(class_col), F.col("word").alias("keyword"),
                    "weight", F.col("rank").cast("int").alias("rank")))


def class_tfidf(docs: DataFrame, class_col: str = "topic", text_col: str = "text",
                top_k: int = 10) -> DataFrame:
    """Top keywords per class by class TF-IDF: class, keyword, weight, rank."""
    return top_keywords(class_weights(docs, class_col, text_col), class_col, top_k)


def similar_classes(weights: DataFrame, threshold: float = 0.9, class_col: str = "topic") -> DataFrame:
    """(a, b), a < b: classes whose weight vectors have a cosine of at least ``threshold``.

    Words are put in one order, those of the fewest classes first.  A class's prefix
    ends where the rest of its unit vector is shorter than the threshold (taken for
    all words of one spread together); two classes that are similar share a word of
    both prefixes, so an equi join of the prefixes gives all candidates, and only
    those are multiplied out.
    """
    scratch = Scratch(weights.sparkSession)
    w = scratch(weights.select(F.col(class_col).alias("c"), "word", "weight").filter("weight > 0"), "class-weights")
    norm = w.groupBy("c").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    spread = w.groupBy("word").agg(F.count("*").alias("spread"))
    unit = scratch(w.join(norm, "c").join(spread, "word").select(
        "c", "word", "spread", (F.col("weight") / F.col("norm")).alias("u")), "unit-weights")
    shared = unit.filter("spread > 1")  # a word of one class joins nothing
    rest = Window.partitionBy("c").orderBy(F.desc("spread")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tails = shared.groupBy("c", "spread").agg(F.sum(F.col("u") * F.col("u")).alias("q")).withColumn(
        "tail", F.sum("q").over(rest)).filter(F.col("tail") >= threshold * threshold * (1 - 1e-9))
    prefix = scratch(shared.join(tails.select("c", "spread"), ["c", "spread"]).select("c", "word"), "prefixes")
    pairs = prefix.select(F.col("c").alias("a"), "word").join(prefix.select(F.col("c").alias("b"), "word"), "word") \
        .filter("a < b").select("a", "b").distinct()
    left = scratch(pairs, "candidates").join(shared.select(F.col("c").alias("a"), "word", F.col("u").alias("ua")), "a")
    dots = left.join(shared.select(F.col("c").alias("b"), "word", F.col("u").alias("ub")), ["b", "word"]) \
        .groupBy("a", "b").agg(F.sum(F.col("ua") * F.col("ub")).alias("cosine"))
    out = materialize(dots.filter(F.col("cosine") >= threshold).select("a", "b"), "similar")
    scratch.close()
    return out


def merge_similar(weights: DataFrame, threshold: float = 0.9, class_col: str = "topic") -> DataFrame:
    """(class, merged): classes linked by ``similar_classes``, directly or not, take the smallest of them."""
    from wayfarer.operators.components import connected_components

    member, _ = connected_components(similar_classes(weights, threshold, class_col), IN_TASK)
    return weights.select(class_col).distinct().join(
        member.withColumnRenamed("node", class_col), class_col, "left").select(
        class_col, F.coalesce("component", class_col).alias("merged"))


def representative_docs(assigned: DataFrame, vec_col: str = "embedding", doc_col: str = "doc",
                        n_docs: int = 3, diversity: float = 0.5) -> DataFrame:
    """Per topic: ``n_docs`` distinct documents close to the centroid, chosen by MMR.

    Rows of one text are one candidate (the row closest to the topic mean stands
    for them).  Each pick is a distributed argmax over all of a topic's texts: the
    first by cosine to the mean, the next by maximal marginal relevance against
    those before.  Ties go to the closer text, then to the smaller one.
    """
    unit = Normalizer(inputCol=vec_col, outputCol="_u", p=2.0).transform(
        assigned.select("topic", F.col(doc_col).alias("doc"), vec_col))
    cen = topic_centroids(assigned, vec_col).withColumnRenamed("centroid", "_c")
    sims = (unit.join(cen, "topic")
            .select("topic", "doc", vector_to_array("_u", "float64").alias("_v"),
                    vector_to_array("_c", "float64").alias("_c")))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)

    scratch = Scratch(assigned.sparkSession)
    texts = scratch(sims.withColumn("_sim", dot(F.col("_v"), F.col("_c"))).groupBy("topic", "doc").agg(
        F.max(F.struct("_sim", "_v")).alias("_near")).select("topic", "doc", "_near.*"), "texts")

    def best(rows: DataFrame, score) -> DataFrame:
        return rows.groupBy("topic").agg(
            F.min(F.struct((-score).alias("_s"), (-F.col("_sim")).alias("_n"), "doc", "_v")).alias("_best"))

    picked = scratch(best(texts, F.col("_sim")).select(
        "topic", F.array("_best.doc").alias("docs"), F.array("_best._v").alias("vecs")), "picks")
    for _ in range(n_docs - 1):
        rest = texts.join(picked, "topic").filter(~F.exists("docs", lambda d: d.eqNullSafe(F.col("doc"))))
        closest = F.array_max(F.transform("vecs", lambda v: dot(F.col("_v"), v)))
        newer = best(rest, (1 - diversity) * F.col("_sim") - diversity * closest)
        # A topic of fewer texts keeps those it has.
        more = lambda old, new: F.when(F.col("_best").isNull(), F.col(old)).otherwise(
            F.concat(old, F.array(new))).alias(old)
        picked = scratch(picked.join(newer, "topic", "left").select(
            "topic", more("docs", "_best.doc"), more("vecs", "_best._v")), "picks")
    out = materialize(picked.select("topic", F.col("docs").alias("representative_docs")), "representatives")
    scratch.close()
    return out


def render_prompts(info: DataFrame, template: str = PROMPT) -> DataFrame:
    """One prompt per topic: documents as ``- doc`` lines, keywords comma-joined."""
    docs = F.array_join(F.transform("representative_docs", lambda d: F.concat(F.lit("- "), d)),
                        "\n")
    prompt = F.replace(F.replace(F.lit(template), F.lit("[DOCUMENTS]"), docs),
                       F.lit("[KEYWORDS]"), F.array_join("keywords", ", "))
    return info.select("topic", prompt.alias("prompt"))


def label_topics(prompts: DataFrame,
                 labeler: Callable[[pd.Series], pd.Series] | None) -> DataFrame:
    """Optional labels from a user model; replies ``topic: <label>`` are trimmed."""
    if labeler is None:
        return prompts.select("topic", F.lit(None).cast("string").alias("label"))

    def run(batches):
        for pdf in batches:
            reply = labeler(pdf["prompt"]).astype(str)
            label = reply.str.replace(r"^\s*topic:\s*", "", regex=True).str.strip()
            yield pd.DataFrame({"topic": pdf["topic"], "label": label})

    t_type = dict(prompts.dtypes)["topic"]
    return prompts.mapInPandas(run, f"topic {t_type}, label string")


def topic_centroids(assigned: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Mean unit-length embedding per topic (a vector aggregate per group)."""
    unit = Normalizer(inputCol=vec_col, outputCol="_u", p=2.0).transform(
        assigned.select("topic", vec_col))
    return unit.groupBy("topic").agg(Summarizer.mean(F.col("_u")).alias("centroid"))


def reduce_topics(centroids: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Merge topics whose centroids are nearly parallel.

    Input: (topic, centroid) with one row per topic.  Topics with cosine >=
    ``threshold`` are linked; each linked group takes its smallest id; -1
    (outliers) is never merged.  Unit centroids are binned into a grid as wide
    as the distance that the threshold allows, so partners lie in touching
    cells: an equi join on cells, never all pairs.  Meant for reduced vectors
    (the join explodes 3^k neighbour cells).  Returns (topic, merged).
    """
    from wayfarer.operators.components import connected_components

    reach = math.sqrt(max(2 - 2 * threshold, 1e-12)) + 1e-9
    unit = Normalizer(inputCol="centroid", outputCol="_u", p=2.0).transform(
        centroids.filter(F.col("topic") >= 0)).select("topic", vector_to_array("_u", "float64").alias("u"))
    binned = unit.withColumn("cell", F.transform("u", lambda x: F.floor(x / reach).cast("long")))
    width = binned.select(F.max(F.size("cell"))).head()[0] or 0
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product((-1, 0, 1), repeat=width)])
    near = binned.select("topic", "u", F.explode(F.transform(
        offsets, lambda o: F.zip_with("cell", o, lambda a, b: a + b))).alias("cell"))
    pairs = near.join(binned.select(F.col("topic").alias("other"), F.col("u").alias("v"), "cell"), "cell")
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    linked = pairs.filter((F.col("topic") > F.col("other")) & (dot >= threshold)).select("topic", "other")
    member, _ = connected_components(linked)
    return unit.select("topic").join(member.withColumnRenamed("node", "topic"), "topic", "left").select(
        "topic", F.coalesce("component", "topic").alias("merged"))
