"""The model grid: every feature set x scaling x k, scored by internal and external indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import cut
from . import cluster as C, validity as V

_SCHEMA = ("feature_set string, preprocess string, k int, silhouette double, silhouette_method string, calinski_harabasz double, "
           "davies_bouldin double, cluster_size_distribution string")


def prepared(df: DataFrame, feature_set: str, method: str, id_col: str = "respondent_id") -> DataFrame:
    """(id, z) of a feature set under a scaling."""
    cols = C.FEATURE_SETS[feature_set]
    return C.vectors(C.scale_features(C.feature_matrix(df, feature_set, (id_col,)), cols, method, (id_col,)), cols, id_col)


def cluster_grid(df: DataFrame, feature_sets=("baseline", "enhanced"), methods=("zscore", "robust"), ks=(2, 3, 4),
                 id_col: str = "respondent_id", external: bool = True, silhouette: str = "micro"):
    """(metric rows, long labels).  The loop is over models, never over rows; all k of a frame share their passes."""
    spark: SparkSession = df.sparkSession
    metrics, labels = [], None
    ks = sorted(ks)
    for fs in feature_sets:
        for method in methods:
            frame = prepared(df, fs, method, id_col)
            _, labelled = C.cluster_two_stage(frame, ks, id_col)
            inner = C.ch_db_indices(labelled, len(ks))
            sil = C.silhouette(labelled, len(ks), silhouette)
            metrics += [(fs, method, k, s["silhouette"], s["silhouette_method"], i["calinski_harabasz"], i["davies_bouldin"],
                         i["cluster_size_distribution"]) for k, i, s in zip(ks, inner, sil)]
            long = labelled.select(id_col, F.posexplode("labels").alias("_m", "cluster")).select(
                id_col, F.lit(fs).alias("feature_set"), F.lit(method).alias("preprocess"),
                F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("_m") + 1).alias("k"), "cluster")
            labels = long if labels is None else labels.unionByName(long)
    table = spark.createDataFrame(metrics, _SCHEMA)
    if external:
        labels = cut(labels)
        answers = df.select(id_col, "C008", *sorted({v for _, _, _, vs in V.P.VALIDITY_LAYERS for v, _, _ in vs}))
        keys = ["feature_set", "preprocess", "k"]
        detail = V.external_validity(labels.join(answers, id_col), keys)
        table = table.join(V.overall_score(detail, keys), keys, "left")
    return table, labels


def preprocess_compare(metrics: DataFrame, labels: DataFrame, feature_set: str, ks=(2, 4), id_col: str = "respondent_id") -> DataFrame:
    """z-score against robust scaling for each k: indices, agreement of the labels, preferred scaling."""
    m = metrics.filter((F.col("feature_set") == feature_set) & F.col("k").isin(list(ks)))
    score = "stratified_external_score"
    shown = ["silhouette", score, "visited_sig_n", "unvisited_sig_n"]
    z, r = (m.filter(F.col("preprocess") == p).select("k", *[F.col(c).alias(f"{p}_{c}") for c in shown]) for p in ("zscore", "robust"))
    mine = labels.filter((F.col("feature_set") == feature_set) & F.col("k").isin(list(ks)))
    a, b = (mine.filter(F.col("preprocess") == p).select(id_col, "k", F.col("cluster").alias(n)) for p, n in (("zscore", "ref_label"), ("robust", "new_label")))
    walk = a.join(b, [id_col, "k"]).groupBy("k", "ref_label", "new_label").agg(F.count(F.lit(1)).alias("n"))
    agree = C.align_labels(walk, ["k"]).groupBy("k").agg(F.first("agreement").alias("cluster_consistency"))
    better = (F.col(f"robust_{score}") >= F.col(f"zscore_{score}")) & (F.col("robust_silhouette") >= F.col("zscore_silhouette") - 0.02)
    return z.join(r, "k").join(agree, "k").withColumns({
        "changed_share": F.lit(1.0) - F.col("cluster_consistency"), "preferred_preprocess": F.when(better, "robust").otherwise("zscore")})
