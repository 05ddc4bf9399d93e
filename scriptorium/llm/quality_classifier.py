"""Quality classification by hierarchical empirical Bayes.

Evidence of a document: a naive Bayes log-odds over the bins of a few measures of its text.
Evidence of its site: the share of good documents among the labelled ones of its host, and of
its path on that host.  Shares of sparse sites shrink: a path's towards its host's, a host's
towards the overall one, each as a beta prior whose weight is fitted to how much the shares of
all sites differ beyond chance.  The posterior adds both in log-odds.  A labelled document's
own label is left out of the shares that judge it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import stored
from scriptorium.llm.quality_rules import STOP_WORDS, words_of

#: Least and most weight of a prior, in documents, and the one used when nothing can be fitted.
WEIGHTS = (2.0, 1000.0)
THRESHOLD = 0.5
SMOOTHING = 4.0


def bins(text: Column, words: Column) -> list[Column]:
    """Names of the bins of a text; at most about 300 in all, whatever the corpus."""
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    letters = F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    size = F.floor(F.log2(n)).cast("int")
    stops = [w for ws in STOP_WORDS.values() for w in ws.split()]
    measures = {
        "size": size,
        "symbols": F.least(F.lit(20), F.floor(40 * F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"-]")) / chars)),
        "marks": F.least(F.lit(20), F.floor(40 * F.regexp_count(text, F.lit(r"[.,;:!?'\"-]")) / chars)),
        "upper": F.floor(10 * F.regexp_count(text, F.lit(r"\p{Lu}")) / letters),
        "letters": F.floor(10 * letters / chars),
        "words": F.least(F.lit(20), F.floor(chars / n)),
        "stops": F.floor(20 * F.size(F.filter(words, lambda x: x.isin(stops))) / n),
        "distinct": F.concat_ws("/", size, F.floor(5 * F.size(F.array_distinct(words)) / n)),
    }
    again = F.filter(words, lambda x, i: x == F.get(words, i - 1))
    measures["again"] = F.floor(10 * F.size(again) / n)
    return [F.concat_ws("=", F.lit(name), value.cast("string")) for name, value in measures.items()]


def features(df: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """``doc_id``, ``host``, ``path``, ``bins``, without the text; null texts count as empty, null
    hosts and paths as one site each."""
    rows = df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[host_col].cast("string"), F.lit("")).alias("host"),
        F.coalesce(df[path_col].cast("string"), F.lit("")).alias("path"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    ).withColumn("w", words_of(F.col("text")))
    return rows.select("doc_id", "host", "path", F.array(*bins(F.col("text"), F.col("w"))).alias("bins"))


def evidence_weights(labelled: DataFrame) -> dict[str, float]:
    """Log-odds of every bin, shrunk towards none: each bin gets ``SMOOTHING`` documents more, of
    both classes as in all bins of its measure.

    ``labelled``: ``bins`` and ``label`` (0 or 1).  The driver gets one row a bin.
    """
    counts = (
        labelled.select(F.explode("bins").alias("bin"), "label")
        .groupBy("bin")
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("poor"))
        .collect()
    )
    if not counts:
        return {}
    total: dict[str, list[float]] = {}
    for r in counts:
        t = total.setdefault(r["bin"].split("=")[0], [1.0, 1.0])
        t[0] += r["good"]
        t[1] += r["poor"]

    def log_share(count: float, all_: float, other: float) -> float:
        return math.log((count + SMOOTHING * all_ / (all_ + other)) / all_)

    return {
        r["bin"]: log_share(r["good"], good, poor) - log_share(r["poor"], poor, good)
        for r in counts
        for good, poor in [total[r["bin"].split("=")[0]]]
    }


def prior_weight(sites: DataFrame, mean: Column) -> float:
    """The weight of a beta prior for shares ``good`` / ``n`` around ``mean``, by moments: the
    weighted spread of the shares, less the spread that chance alone gives."""
    stats = (
        sites.where("n > 0")
        .select("n", (F.col("good") / F.col("n")).alias("p"), mean.alias("m"))
        .agg(
            F.sum(F.col("n") * (F.col("p") - F.col("m")) ** 2).alias("spread"),
            F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("chance"),
            F.sum(F.col("m") * (1 - F.col("m"))).alias("per_site"),
        )
        .first()
    )
    low, high = WEIGHTS
    if stats["chance"] is None or stats["chance"] <= 0:
        return high
    between = stats["spread"] - stats["per_site"]  # n (p - m)^2 is m (1 - m) a site by chance
    if between <= 0:
        return high
    ratio = between / stats["chance"]  # 1 / (weight + 1) of a beta distribution
    return min(high, max(low, 1.0 / ratio - 1.0))


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``evidence`` (log-odds of the text), ``host_rate``, ``path_rate`` (shrunk shares),
    ``score`` (posterior, 0 to 1) and ``kept`` for every row.

    All labelled rows of ``labels`` (``id_col``, ``label_col`` of 0 or 1; others are ignored) are
    learned from.  Without any label every score is 0.5 and every row is kept.  Several labels
    of one id all count, and are all left out for it; repeated rows give repeated rows; null
    ids are never labelled.
    """
    every = stored(features(df, id_col, text_col, host_col, path_col), "features")
    own = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("long").alias("label"))
        .where("label in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.sum("label").alias("own_good"), F.count("*").alias("own_n"))
    )
    joined = stored(every.join(own, "doc_id", "left"), "labelled")
    labelled = joined.where("own_n > 0")
    weights = evidence_weights(
        labelled.select("bins", (F.col("own_good") / F.col("own_n")).alias("label"))
    )
    paths = labelled.groupBy("host", "path").agg(F.sum("own_good").alias("good"), F.sum("own_n").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    overall = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    if not overall["n"]:
        return joined.select(
            "doc_id", F.lit(0.0).alias("evidence"), F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"),
            F.lit(0.5).alias("score"), F.lit(True).alias("kept"),
        )
    mean = (overall["good"] + 1) / (overall["n"] + 2)
    host_weight = prior_weight(hosts.select(F.col("host_good").alias("good"), F.col("host_n").alias("n")), F.lit(mean))
    shrunk = (F.col("host_good") + host_weight * mean) / (F.col("host_n") + host_weight)
    sites = paths.join(hosts, "host")
    path_weight = prior_weight(sites.withColumn("host_mean", shrunk), F.col("host_mean"))
    placed = (
        joined.join(hosts, "host", "left")
        .join(paths.withColumnsRenamed({"good": "path_good", "n": "path_n"}), ["host", "path"], "left")
    )
    none = F.lit(0)

    def less_own(total: str, own_name: str) -> Column:
        return F.coalesce(F.col(total), none) - F.coalesce(F.col(own_name), none)

    host_rate = (less_own("host_good", "own_good") + host_weight * mean) / (less_own("host_n", "own_n") + host_weight)
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    text = F.aggregate(
        F.transform("bins", lambda b: F.coalesce(F.try_element_at(table, b), F.lit(0.0))),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    judged = placed.select("*", host_rate.alias("host_rate"), text.alias("evidence"))
    path_rate = (less_own("path_good", "own_good") + path_weight * F.col("host_rate")) / (
        less_own("path_n", "own_n") + path_weight
    )
    scored = judged.withColumn("path_rate", path_rate).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))
    )
    return scored.select(
        "doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept")
    )
