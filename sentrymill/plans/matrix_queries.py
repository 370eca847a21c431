"""Queries that harmonize, prepare and evaluate flow datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators import etl, evaluate, prepare
from sentrymill.plans.views import MEASUREMENTS
from sentrymill.sources.tables import table

FEW = ("duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "flow_iat_mean")
LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "combined_dataset")


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _parties(spark: SparkSession, d: str) -> list[DataFrame]:
    parts = []
    for i, (name, prefix) in enumerate((("customer", "c_"), ("supplier", "s_"))):
        raw = table(spark, d, name)
        raw = etl.normalized_names(raw.toDF(*[f" {c.removeprefix(prefix).title()} " for c in raw.columns]))
        raw = etl.renamed(raw, {"custkey": "party_key", "suppkey": "party_key", "absent": "x"})
        parts.append(etl.with_provenance(raw, i, name))
    return parts


def harmonize_union(spark: SparkSession, d: str) -> DataFrame:
    return etl.common_union(_parties(spark, d))


def merge_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    parts = [etl.picked(p, {"balance": ("acctbal",), "segment": ("mktsegment",)}) for p in _parties(spark, d)]
    return etl.filled_union([p if "mktsegment" in p.columns else p.withColumn("rating", F.col("party_key") % 5) for p in parts])


def universal_features(spark: SparkSession, d: str) -> DataFrame:
    out = etl.derived(_records(spark, d).select("record_id", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes"))
    return _round(out.select("record_id", "total_packets", "total_bytes", "fwd_bwd_packet_ratio", "fwd_bwd_byte_ratio", "avg_pkt_size"))


def ratio_features(spark: SparkSession, d: str) -> DataFrame:
    out = etl.training_ratios(_records(spark, d), "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "duration")
    return _round(out.select("record_id", "fwd_bwd_packet_ratio", "fwd_bwd_bytes_ratio", "bytes_per_second", "packets_per_second"))


def label_taxonomy_v1(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", *[c.alias(n) for n, c in etl.taxonomy(F.col("label_fine"), etl.BENIGN_V1, etl.FAMILIES_V1).items()])


def label_taxonomy_v2(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("record_id", *[c.alias(n) for n, c in etl.taxonomy(F.col("label_fine")).items()])


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _round(etl.distribution(_records(spark, d), "label_fine"), 9)


def family_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _round(etl.family_distribution(_records(spark, d)), 9)


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    return etl.null_counts(_records(spark, d))


def dataset_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Type, kind and values of each column."""
    return etl.kinds(_records(spark, d))


def label_integrity(spark: SparkSession, d: str) -> DataFrame:
    return etl.label_integrity(_records(spark, d))


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    return etl.top_labels(_records(spark, d).where("label_fine IS NOT NULL"), "label_fine")


def column_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.column_stats(_records(spark, d), MEASUREMENTS), 4)


def impute_median_mode(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).select("record_id", *FEW, "src_ip", "dataset_name")
    return prepare.imputed(df, FEW, ["src_ip", "dataset_name"])


def winsorize(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.winsorized(_records(spark, d).select("record_id", *FEW), FEW), 4)


def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.standard_scaled(_records(spark, d).select("record_id", *FEW), FEW))


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.minmax_scaled(_records(spark, d).select("record_id", *FEW), FEW))


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.robust_scaled(_records(spark, d).select("record_id", *FEW), FEW))


def clip_scale(spark: SparkSession, d: str) -> DataFrame:
    from sentrymill.operators.scoring import scaled

    known = {"duration": (1e6, 5e5), "fwd_packets": (10.0, 0.0)}
    cols = [F.round(scaled(F.col(c).cast("double"), *known.get(c, (None, None))), 6).alias(c) for c in ("duration", "fwd_packets", "bwd_packets")]
    return _records(spark, d).select("record_id", *cols)


def label_encode(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).select("record_id", "label_fine")
    return prepare.encoded(df, "label_fine", prepare.label_codes(df, "label_fine"), "code")


def label_encode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).select("record_id", "label_fine")
    return prepare.encoded(df, "label_fine", prepare.first_seen_codes(df, "label_fine", "record_id"), "code")


def freq_encode(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).select("record_id", "dataset_name")
    return _round(prepare.encoded(df, "dataset_name", prepare.frequency_codes(df, "dataset_name"), "frequency"), 9)


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return etl.one_hot(_records(spark, d).select("record_id", "dataset_id"), "dataset_id", range(4), "dataset_onehot_")


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = etl.feature_matrix(_records(spark, d), ("fwd_packets", "bwd_packets", "src_port"))
    return _records(spark, d).select("record_id", F.size(m).alias("n"), F.aggregate(m, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("total"))


def variance_threshold(spark: SparkSession, d: str) -> DataFrame:
    v = prepare.varying(table(spark, d, "lineitem"), LINE, 0.01)
    return v.select("column", F.round("variance", 4).alias("variance"), "kept")


def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _round(prepare.correlations(_records(spark, d), FEW))


def correlation_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = prepare.uncorrelated(_records(spark, d), FEW, 0.3)
    return spark.createDataFrame([(i, c) for i, c in enumerate(kept)], "pos int, column string")


def kfold_assign(spark: SparkSession, d: str) -> DataFrame:
    return prepare.folds(_records(spark, d).select("record_id"), [F.col("record_id")], 5)


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return prepare.train_test(_records(spark, d).select("record_id"), "record_id", 0.2)


def undersample(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).where("label_family IS NOT NULL").select("record_id", "label_family")
    return prepare.undersampled(df, "label_family", "record_id")


def oversample(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d).where("label_family IS NOT NULL").select("record_id", "label_family")
    return prepare.oversampled(df, "label_family", "record_id")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """label_binary against a simple rate of forward packets as score."""
    c = _records(spark, d)
    p = F.coalesce(F.try_divide(F.col("fwd_packets").cast("double"), F.col("fwd_packets") + F.col("bwd_packets")), F.lit(0.5))
    return c.where("label_binary IS NOT NULL").select("record_id", F.col("label_binary").cast("double").alias("y"), F.round(p, 6).alias("p"), "label_family", "label_binary", "dataset_id")


def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.confusion(_judged(spark, d), F.col("y"), F.col("p")))


def published_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a published confusion matrix."""
    return _round(evaluate.rates(spark.createDataFrame([(727461, 3133935, 36227, 20867)], "tp long, tn long, fp long, fn long")))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.roc_auc(_judged(spark, d), F.col("y"), F.col("p"), "record_id"), 9)


def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.regression(_judged(spark, d), F.col("y"), F.col("p")))


def losses(spark: SparkSession, d: str) -> DataFrame:
    df = _judged(spark, d)
    return _round(df.agg(*[c.alias(n) for n, c in evaluate.losses(F.col("y"), F.col("p")).items()]))


def impurity(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.class_impurity(_records(spark, d), ["dataset_id"], "label_family"))


def value_impurity(spark: SparkSession, d: str) -> DataFrame:
    v = evaluate.value_impurity(_records(spark, d), ["dataset_id"], "fwd_packets")
    return _round(v, 4)


def split_scores(spark: SparkSession, d: str) -> DataFrame:
    """Gini score of splitting each data set's families at p <= 0.5."""
    df = _judged(spark, d).withColumn("left_side", F.col("p") <= 0.5)
    g = evaluate.class_impurity(df, ["dataset_id", "left_side"], "label_family")
    n = lambda side: F.coalesce(F.max(F.when(F.col("left_side") == side, F.col("n"))), F.lit(0))
    i = lambda side: F.coalesce(F.max(F.when(F.col("left_side") == side, F.col("gini"))), F.lit(0.0))
    return _round(g.groupBy("dataset_id").agg(evaluate.split_score((n(True), i(True)), (n(False), i(False))).alias("score")))


def majority_class(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.majority(_records(spark, d), ["dataset_id", "split"], "label_family")


QUERIES = {
    f.__name__: f
    for f in (
        harmonize_union, merge_fill_zero, universal_features, ratio_features, label_taxonomy_v1, label_taxonomy_v2, class_distribution, family_distribution,
        dataset_profile, dataset_kinds, label_integrity, top_labels, column_stats, impute_median_mode, winsorize, standard_scale, minmax_scale, robust_scale, clip_scale,
        label_encode, label_encode_first_seen, freq_encode, one_hot, feature_matrix, variance_threshold, correlation_matrix, correlation_filter, kfold_assign,
        train_test_split, undersample, oversample, confusion_metrics, published_counts, roc_auc, regression_metrics, losses, impurity, value_impurity, split_scores,
        majority_class,
    )
}


def _likes(words) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


def _taxonomy_sql(benign, families) -> str:
    steps = " ".join(f"WHEN {_likes(w)} THEN {n}" for n, w in enumerate(families, 1))
    return f"""SELECT record_id, CASE WHEN {_likes(benign)} THEN 0 ELSE 1 END AS label_binary, CASE WHEN {_likes(benign)} THEN 0 {steps} ELSE 4 END AS label_family, f AS label_fine
FROM (SELECT record_id, trim(coalesce(label_fine, 'nan')) AS f, lower(trim(coalesce(label_fine, 'nan'))) AS l FROM combined_dataset)"""


_PARTIES = """
a AS (SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer),
b AS (SELECT s_suppkey AS party_key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier)
"""
_JUDGED = """
j AS (SELECT record_id, label_binary::DOUBLE AS y, round(coalesce(fwd_packets::DOUBLE / nullif(fwd_packets + bwd_packets, 0), 0.5), 6) AS p, label_family, dataset_id FROM combined_dataset WHERE label_binary IS NOT NULL)
"""
_SCALES = {
    "standard": "round((c.{c} - m_{c}) / CASE WHEN s_{c} < 1e-10 THEN 1 ELSE s_{c} END, 6)",
    "minmax": "round((c.{c} - a_{c}) / CASE WHEN b_{c} - a_{c} < 1e-10 THEN 1 ELSE b_{c} - a_{c} END, 6)",
    "robust": "round((c.{c} - q_{c}) / CASE WHEN h_{c} - l_{c} < 1e-10 THEN 1 ELSE h_{c} - l_{c} END, 6)",
    "winsor": "round(CASE WHEN c.{c} IS NOT NULL THEN greatest(l_{c} - 3 * (h_{c} - l_{c}), least(h_{c} + 3 * (h_{c} - l_{c}), c.{c}::DOUBLE)) END, 4)",
}


def _scaled_sql(kind: str) -> str:
    fit = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c})::DOUBLE AS a_{c}, max({c})::DOUBLE AS b_{c}, quantile_cont({c}::DOUBLE, 0.25) AS l_{c}, quantile_cont({c}::DOUBLE, 0.5) AS q_{c}, quantile_cont({c}::DOUBLE, 0.75) AS h_{c}"
        for c in FEW
    )
    return f"WITH f AS (SELECT {fit} FROM combined_dataset) SELECT record_id, " + ", ".join(f"{_SCALES[kind].format(c=c)} AS {c}" for c in FEW) + " FROM combined_dataset c, f"


def _mode_sql(c: str) -> str:
    return f"(SELECT {c} FROM combined_dataset WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


_UNDER = """
h AS (SELECT record_id, label_family, row_number() OVER (PARTITION BY label_family ORDER BY md5('42:' || record_id), record_id) AS r, count(*) OVER (PARTITION BY label_family) AS n
      FROM combined_dataset WHERE label_family IS NOT NULL)
"""

SQL = {
    "harmonize_union": f"""WITH {_PARTIES} SELECT party_key, name, nationkey, acctbal, 0 AS dataset_id, 'customer' AS dataset_name FROM a UNION ALL SELECT party_key, name, nationkey, acctbal, 1, 'supplier' FROM b""",
    "merge_fill_zero": f"""WITH {_PARTIES} SELECT party_key, name, nationkey, acctbal, mktsegment, 0 AS dataset_id, 'customer' AS dataset_name, acctbal AS balance, mktsegment AS segment, 0::BIGINT AS rating FROM a
UNION ALL SELECT party_key, name, nationkey, acctbal, NULL, 1, 'supplier', acctbal, NULL, party_key % 5 FROM b""",
    "universal_features": """SELECT record_id, (fwd_packets + bwd_packets)::DOUBLE AS total_packets, (fwd_bytes + bwd_bytes)::DOUBLE AS total_bytes, round(fwd_packets::DOUBLE / (bwd_packets + 1), 6) AS fwd_bwd_packet_ratio,
round(fwd_bytes::DOUBLE / (bwd_bytes + 1), 6) AS fwd_bwd_byte_ratio, round((fwd_bytes + bwd_bytes)::DOUBLE / (fwd_packets + bwd_packets + 1), 6) AS avg_pkt_size FROM combined_dataset""",
    "ratio_features": """SELECT record_id, round(fwd_packets::DOUBLE / (bwd_packets + 1), 6) AS fwd_bwd_packet_ratio, round(fwd_bytes::DOUBLE / (bwd_bytes + 1), 6) AS fwd_bwd_bytes_ratio,
round(fwd_bytes::DOUBLE / (duration + 1), 6) AS bytes_per_second, round(fwd_packets::DOUBLE / (duration + 1), 6) AS packets_per_second FROM combined_dataset""",
    "label_taxonomy_v1": _taxonomy_sql(etl.BENIGN_V1, etl.FAMILIES_V1),
    "label_taxonomy_v2": _taxonomy_sql(etl.BENIGN_V2, etl.FAMILIES_V2),
    "class_distribution": "SELECT label_fine, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(label_fine) FROM combined_dataset), 9) AS share FROM combined_dataset WHERE label_fine IS NOT NULL GROUP BY 1",
    "family_distribution": """SELECT f.family, f.name, count(label_family) AS n, round(count(label_family)::DOUBLE / (SELECT count(label_family) FROM combined_dataset), 9) AS share
FROM (VALUES (0, 'Benign'), (1, 'DoS'), (2, 'Probe'), (3, 'Exploit'), (4, 'Generic')) AS f(family, name) LEFT JOIN combined_dataset c ON c.label_family = f.family GROUP BY 1, 2""",
    "dataset_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM combined_dataset"
        for c in (
            "record_id", "split", "captured_at", "loaded_at", "src_ip", "src_port", "dst_port", "protocol", *MEASUREMENTS, "dataset_id", "dataset_name", "label_binary",
            "label_family", "label_fine",
        )
    ),
    "label_integrity": """SELECT *, benign_with_family + malicious_without_family + null_binary + null_family + null_fine + out_of_range = 0 AS all_hold FROM (
SELECT count(*) FILTER (label_binary = 0 AND label_family <> 0) AS benign_with_family, count(*) FILTER (label_binary = 1 AND label_family = 0) AS malicious_without_family,
count(*) FILTER (label_binary IS NULL) AS null_binary, count(*) FILTER (label_family IS NULL) AS null_family, count(*) FILTER (label_fine IS NULL) AS null_fine,
count(*) FILTER (label_binary < 0 OR label_binary > 1 OR label_family < 0 OR label_family > 4) AS out_of_range FROM combined_dataset)""",
    "top_labels": "SELECT label_fine, count(*) AS n FROM combined_dataset WHERE label_fine IS NOT NULL GROUP BY 1 ORDER BY n DESC, label_fine LIMIT 10",
    "column_stats": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c})::DOUBLE, 4) AS mean, round(stddev_pop({c})::DOUBLE, 4) AS std, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max FROM combined_dataset"
        for c in MEASUREMENTS
    ),
    "impute_median_mode": f"""SELECT record_id, {", ".join(f"coalesce({c}::DOUBLE, (SELECT median({c}::DOUBLE) FROM combined_dataset)) AS {c}" for c in FEW)},
coalesce(src_ip, {_mode_sql("src_ip")}) AS src_ip, coalesce(dataset_name, {_mode_sql("dataset_name")}) AS dataset_name FROM combined_dataset""",
    "winsorize": _scaled_sql("winsor"),
    "standard_scale": _scaled_sql("standard"),
    "minmax_scale": _scaled_sql("minmax"),
    "robust_scale": _scaled_sql("robust"),
    "clip_scale": """SELECT record_id, round(greatest(-10, least(10, (coalesce(duration, 0) - 1e6) / 5e5)), 6)::DOUBLE AS duration, round(greatest(-10, least(10, coalesce(fwd_packets, 0) - 10.0)), 6)::DOUBLE AS fwd_packets, 0.0::DOUBLE AS bwd_packets FROM combined_dataset""",
    "label_encode": """WITH c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS code FROM (SELECT DISTINCT label_fine AS v FROM combined_dataset WHERE label_fine IS NOT NULL))
SELECT record_id, label_fine, code FROM combined_dataset LEFT JOIN c ON v = label_fine""",
    "label_encode_first_seen": """WITH c AS (SELECT v, (row_number() OVER (ORDER BY o) - 1)::INT AS code FROM (SELECT label_fine AS v, min(record_id) AS o FROM combined_dataset WHERE label_fine IS NOT NULL GROUP BY 1))
SELECT record_id, label_fine, code FROM combined_dataset LEFT JOIN c ON v = label_fine""",
    "freq_encode": """SELECT record_id, dataset_name, CASE WHEN dataset_name IS NOT NULL THEN round(count(*) OVER (PARTITION BY dataset_name)::DOUBLE / count(dataset_name) OVER (), 9) END AS frequency FROM combined_dataset""",
    "one_hot": "SELECT record_id, dataset_id, " + ", ".join(f"(dataset_id = {i})::INT AS dataset_onehot_{i}" for i in range(4)) + " FROM combined_dataset",
    "feature_matrix": "SELECT record_id, 3 AS n, coalesce(fwd_packets, 0)::FLOAT::DOUBLE + coalesce(bwd_packets, 0)::FLOAT::DOUBLE + coalesce(src_port, 0)::FLOAT::DOUBLE AS total FROM combined_dataset",
    "variance_threshold": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(var_pop({c}), 4) AS variance, var_pop({c}) > 0.01 AS kept FROM lineitem" for c in LINE),
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM combined_dataset" for i, a in enumerate(FEW) for b in FEW[i:]
    ),
    "dataset_kinds": " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{t}' AS type, '{k}' AS kind, count({c}) AS values FROM combined_dataset"
        for c, t, k in (
            *[(c, "bigint", "numeric") for c in ("record_id", "duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "fwd_pkt_len_max", "bwd_pkt_len_max", "init_fwd_win_bytes")],
            *[(c, "double", "numeric") for c in ("fwd_pkt_len_std", "bwd_pkt_len_std", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "fwd_iat_mean", "bwd_iat_mean", "active_mean")],
            *[(c, "int", "numeric") for c in ("src_port", "dst_port", "protocol")], ("split", "string", "text"), ("src_ip", "string", "text"),
            ("captured_at", "timestamp_ntz", "other"), ("loaded_at", "timestamp_ntz", "other"), ("dataset_id", "int", "other"), ("dataset_name", "string", "other"),
            ("label_binary", "int", "other"), ("label_family", "int", "other"), ("label_fine", "string", "other"),
        )
    ),
    "correlation_filter": "WITH RECURSIVE c AS (" + " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, corr({FEW[i]}, {FEW[j]}) AS r FROM combined_dataset" for j in range(len(FEW)) for i in range(j)) + f"""),
g AS (SELECT 0 AS i, [0] AS kept UNION ALL
  SELECT i + 1, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.b = g.i + 1 AND list_contains(g.kept, c.a) AND abs(c.r) > 0.3) THEN kept ELSE list_append(kept, i + 1) END FROM g WHERE i + 1 < {len(FEW)}),
k AS (SELECT kept FROM g WHERE i = {len(FEW) - 1})
SELECT (unnest(range(len(kept))))::INT AS pos, list_extract({list(FEW)}, unnest(kept) + 1) AS column FROM k""",
    "kfold_assign": """SELECT record_id, least(4, i // (SELECT count(*) // 5 FROM combined_dataset))::INT AS fold FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS i FROM combined_dataset)""",
    "train_test_split": """SELECT record_id, i >= n - floor(n * 0.2)::BIGINT AS is_test FROM (SELECT record_id, row_number() OVER (ORDER BY md5('42:' || record_id), record_id) - 1 AS i, count(*) OVER () AS n FROM combined_dataset)""",
    "undersample": f"WITH {_UNDER} SELECT record_id, label_family FROM h WHERE r <= (SELECT min(n) FROM h)",
    "oversample": f"WITH {_UNDER}, m AS (SELECT *, (SELECT max(n) FROM h) AS most FROM h) SELECT record_id, label_family, unnest(range(1, (most // n + (r <= most % n)::INT + 1)::BIGINT))::INT AS copy FROM m",
    "confusion_metrics": f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (y > 0.5 AND p > 0.5) AS tp, count(*) FILTER (y <= 0.5 AND p <= 0.5) AS tn, count(*) FILTER (y <= 0.5 AND p > 0.5) AS fp, count(*) FILTER (y > 0.5 AND p <= 0.5) AS fn FROM j)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "published_counts": "SELECT 727461::BIGINT AS tp, 3133935::BIGINT AS tn, 36227::BIGINT AS fp, 20867::BIGINT AS fn, 0.98543::DOUBLE AS accuracy, round(727461 / 763688::DOUBLE, 6) AS precision, round(727461 / 748328::DOUBLE, 6) AS recall, round(1454922 / 1512016::DOUBLE, 6) AS f1",
    "roc_auc": f"""WITH {_JUDGED}, r AS (SELECT y, sum(y) OVER (ORDER BY p DESC, record_id ROWS UNBOUNDED PRECEDING) AS tp FROM j) SELECT round(sum(tp) FILTER (y = 0) / (sum(y) * sum(1 - y)), 9) AS auc FROM r""",
    "regression_metrics": f"WITH {_JUDGED} SELECT round(avg((y - p) ** 2), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2 FROM j",
    "losses": f"""WITH {_JUDGED}, k AS (SELECT y, p, greatest(1e-15, least(1 - 1e-15, p)) AS q, CASE WHEN y > 0.5 THEN 1 ELSE -1 END AS s FROM j)
SELECT round(avg((y - p) ** 2), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS binary_cross_entropy, round(avg(-y * ln(q)), 6) AS cross_entropy,
round(avg(greatest(0, 1 - s * p)), 6) AS hinge, round(avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) ** 2 ELSE abs(y - p) - 0.5 END), 6) AS huber FROM k""",
    "impurity": """SELECT dataset_id, sum(c)::BIGINT AS n, round(1 - sum((c / n) ** 2), 6) AS gini, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (
SELECT dataset_id, label_family, count(*) AS c, sum(count(*)) OVER (PARTITION BY dataset_id) AS n FROM combined_dataset WHERE label_family IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "value_impurity": """WITH m AS (SELECT dataset_id, count(fwd_packets) AS n, list_sort(list(fwd_packets::DOUBLE) FILTER (fwd_packets IS NOT NULL))[count(fwd_packets) // 2 + 1] AS med, var_pop(fwd_packets) AS v FROM combined_dataset GROUP BY 1)
SELECT m.dataset_id, m.n, round(m.med, 4) AS median, round(m.v, 4) AS mse, round(avg(abs(c.fwd_packets - m.med)), 4) AS mae FROM m JOIN combined_dataset c ON c.dataset_id = m.dataset_id AND c.fwd_packets IS NOT NULL GROUP BY 1, 2, m.med, m.v""",
    "split_scores": f"""WITH {_JUDGED}, g AS (SELECT dataset_id, p <= 0.5 AS l, label_family, count(*) AS c FROM j WHERE label_family IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT dataset_id, l, sum(c) AS n, 1 - sum(c * c) / sum(c) ** 2 AS gini FROM g GROUP BY 1, 2) SELECT dataset_id, round(sum(n * gini) / sum(n), 6) AS score FROM s GROUP BY 1""",
    "majority_class": """SELECT dataset_id, split, label_family AS label, c AS votes FROM (SELECT dataset_id, split, label_family, count(*) AS c, row_number() OVER (PARTITION BY dataset_id, split ORDER BY count(*) DESC, label_family) AS r
FROM combined_dataset WHERE label_family IS NOT NULL GROUP BY 1, 2, 3) WHERE r = 1""",
}
