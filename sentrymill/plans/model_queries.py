"""Queries over vectors, models and file round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.functions import vectors as v
from sentrymill.operators import learn, neighbours, network, prepare, scoring, trees
from sentrymill.plans import tree_sql
from sentrymill.plans.views import MEASUREMENTS
from sentrymill.sources import files
from sentrymill.sources.tables import scratch, table

PROBE = [round(0.01 * i, 2) for i in range(64)]


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e, p = F.col("embedding"), F.array(*[F.lit(x) for x in PROBE])
    return _embeddings(spark, d).select(
        "vec_id", F.round(v.norm(e), 5).alias("norm"), F.round(v.euclidean(e, p), 5).alias("euclidean"), F.round(v.manhattan(e, p), 4).alias("manhattan"), F.round(v.cosine(e, p), 5).alias("cosine")
    )


def normalize_rows(spark: SparkSession, d: str) -> DataFrame:
    n = v.normalized(F.col("embedding"))
    return _embeddings(spark, d).select("vec_id", F.posexplode(n).alias("pos", "x")).select("vec_id", "pos", F.round("x", 5).alias("x"))


def activations(spark: SparkSession, d: str) -> DataFrame:
    x = F.round((F.col("l_discount") - F.col("l_tax")) * 20, 4)
    rows = table(spark, d, "lineitem").select(x.alias("x")).distinct()
    out = {n: f(F.col("x")) for n, f in v.ACTIVATIONS.items()} | {f"d_{n}": f(F.col("x")) for n, f in v.DERIVATIVES.items()}
    return rows.select("x", *[F.round(c, 6).alias(n) for n, c in out.items()])


def softmax_scores(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feed").where("model_scores IS NOT NULL").select("feed_id", v.softmax(F.map_values("model_scores")).alias("s"))
    return f.select("feed_id", F.round(F.array_max("s"), 6).alias("most"), F.round(v.total(F.col("s")), 6).alias("total"))


def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the query rows (ids divisible by 20) to all rows."""
    e = _embeddings(spark, d)
    n = neighbours.Neighbours(e, "vec_id", "embedding").distances(e.where("vec_id % 20 = 0"))
    return n.select("query", "neighbour", F.round("distance", 5).alias("distance"))


def knn(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    n = neighbours.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return n.select("query", "neighbour", "rank", F.round("distance", 5).alias("distance"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    n = neighbours.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10, "cosine")
    return n.select("query", "neighbour", "rank", F.round("similarity", 5).alias("similarity"))


def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact neighbours the index finds by probing three quarters of its cells; these vectors have hardly any clusters."""
    e = _embeddings(spark, d)
    queries, index = e.where("vec_id % 20 = 0"), neighbours.Neighbours(e, "vec_id", "embedding")
    exact = index.nearest(queries, 10).select("query", "neighbour")
    quick = index.nearest(queries, 10, exact=False, probes=-(-3 * len(index.cells.centres) // 4)).select("query", "neighbour", F.lit(1).alias("hit"))
    return exact.join(quick, ["query", "neighbour"], "left").agg(F.count("*").alias("n"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def smote(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).withColumn("two", (F.col("label") == 0).cast("int"))
    made = neighbours.smote(e, "vec_id", "embedding", "two")
    return made.select("base", "neighbour", "n", F.posexplode("vector").alias("pos", "x")).select("base", "neighbour", "n", "pos", F.round("x", 4).alias("x"))


FIXTURE = [(i, [v, v], float(v > 4)) for i, v in enumerate((1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 5.5, 6.0, 6.5, 7.0))]
SURFACE = [(i, [a, b], y) for i, (a, b, y) in enumerate(((1.0, 1.0, 5.0), (2.0, 1.0, 7.0), (1.0, 2.0, 8.0), (3.0, 3.0, 15.0), (4.0, 2.0, 14.0), (2.0, 4.0, 16.0)))]
BOUNDED = {"max_depth": 4}
GRID, DRAWN = learn.grid(max_depth=(1, 2), min_leaf=(1, 20)), learn.drawn({"max_depth": (1, 2, 3), "min_leaf": (1, 5, 20)}, 2)


def _flows(spark: SparkSession, d: str, split: str) -> DataFrame:
    c = table(spark, d, "combined_dataset").where(F.col("split") == split)
    return c.select("record_id", "label_binary", "label_family", F.array(*[F.col(m).cast("double") for m in MEASUREMENTS]).alias("x"))


def _predicted(model, spark: SparkSession, d: str, label: str) -> DataFrame:
    rows = _flows(spark, d, "test").where(F.col(label).isNotNull())
    return rows.select("record_id", F.col(label).cast("double").alias("label"), F.round(model.column(F.col("x")), 6).alias("prediction"))


def decision_tree(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(trees.fit_classifier(_flows(spark, d, "train"), "x", "label_family", **BOUNDED), spark, d, "label_family")


def decision_tree_regressor(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(trees.fit_regressor(_flows(spark, d, "train"), "x", "label_family", **BOUNDED), spark, d, "label_family")


def random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(trees.fit_forest(_flows(spark, d, "train"), "x", "label_family", "record_id", trees=5, **BOUNDED), spark, d, "label_family")


def gradient_boosting(spark: SparkSession, d: str) -> DataFrame:
    return _predicted(trees.fit_boosted(_flows(spark, d, "train"), "x", "label_binary", rounds=4, max_depth=2), spark, d, "label_binary")


def perceptron(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).withColumn("two", (F.col("label") == 0).cast("int"))
    model = network.fit_network(e, "embedding", "two", (16,), rate=0.01, epochs=60)
    return network.probabilities(model, e, "vec_id", "embedding").select("vec_id", (F.col("probability") > 0.5).cast("double").alias("prediction"))


def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    model = trees.fit_classifier(_flows(spark, d, "train"), "x", "label_family", **BOUNDED)
    return spark.createDataFrame([(m, round(v, 6)) for m, v in zip(MEASUREMENTS, model.importances(len(MEASUREMENTS)))], "feature string, importance double")


def converted_model(spark: SparkSession, d: str) -> DataFrame:
    """A fitted tree converted to a flat ensemble, through its JSON, and predicted with."""
    tree = trees.fit_classifier(_flows(spark, d, "train"), "x", "label_family", **BOUNDED)
    flat, weights = scoring.forest_from_json(scoring.forest_to_json([tree.flattened()], [1.0]))
    rows = _flows(spark, d, "test").where("label_family IS NOT NULL")
    x = [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)) for i in range(len(MEASUREMENTS))]
    return rows.select("record_id", F.col("label_family").cast("double").alias("label"), scoring.forest_score(flat, weights, x).alias("prediction"))


def f1_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Seven models weighted by their F1 on the validation split; positive above 0.5."""
    forest = trees.fit_forest(_flows(spark, d, "train"), "x", "label_binary", "record_id", trees=7, max_depth=2)
    models = {f"m{i}": t.column(F.col("x")) for i, t in enumerate(forest.trees)}
    weights = learn.f1_weights(models, _flows(spark, d, "valid"), "label_binary")
    score = F.round(scoring.weighted_vote(models, weights), 6)
    return _flows(spark, d, "test").select("record_id", score.alias("score"), (score > 0.5).alias("malicious"))


def best_split(spark: SparkSession, d: str) -> DataFrame:
    """The best split of all training rows by the Gini impurity of label_binary: feature, threshold, rows to the left, score."""
    model = trees.fit_classifier(_flows(spark, d, "train"), "x", "label_binary", max_depth=1)
    root, left, right = model.nodes
    score = (left.n * left.impurity + right.n * right.impurity) / root.n
    return spark.createDataFrame([(MEASUREMENTS[root.feature], root.threshold, int(left.n), round(score, 9))], "feature string, threshold double, left_rows bigint, score double")


def golden_models(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of every learner on small separable rows; the regression tree gives each of its rows back."""
    two = spark.createDataFrame(FIXTURE, "i int, x array<double>, y double")
    surface = spark.createDataFrame(SURFACE, "i int, x array<double>, y double")
    x = F.col("x")
    fitted = {
        "tree": (two, trees.fit_classifier(two, "x", "y").column(x)),
        "entropy": (two, trees.fit_classifier(two, "x", "y", "entropy").column(x)),
        "forest": (two, trees.fit_forest(two, "x", "y", "i", trees=3, bootstrap=False).column(x)),
        "boosted": (two, trees.fit_boosted(two, "x", "y", rounds=3).column(x)),
        "regressor": (surface, trees.fit_regressor(surface, "x", "y").column(x)),
    }
    out = [df.select(F.lit(name).alias("model"), "i", F.round(c, 6).alias("prediction")) for name, (df, c) in fitted.items()]
    net = network.probabilities(network.fit_network(two, "x", "y", (8,), rate=0.1, epochs=60), two, "i", "x")
    out.append(net.select(F.lit("network").alias("model"), "i", (F.col("probability") > 0.5).cast("double").alias("prediction")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    _, scores = learn.searched(_flows(spark, d, "train"), "x", "label_binary", "record_id", GRID, k=2)
    return spark.createDataFrame([(p["max_depth"], p["min_leaf"], round(s, 6)) for p, s in scores], "max_depth int, min_leaf int, accuracy double")


def random_search(spark: SparkSession, d: str) -> DataFrame:
    _, scores = learn.searched(_flows(spark, d, "train"), "x", "label_binary", "record_id", DRAWN, k=2)
    return spark.createDataFrame([(p["max_depth"], p["min_leaf"], round(s, 6)) for p, s in scores], "max_depth int, min_leaf int, accuracy double")


def model_registry(spark: SparkSession, d: str) -> DataFrame:
    """Six models with a scaler and metadata, saved, loaded again and voted with."""
    train = _flows(spark, d, "train")
    forest = trees.fit_forest(train, "x", "label_binary", "record_id", trees=6, max_depth=2)
    names = ("lgbm_deep", "lgbm_wide", "lgbm_fast", "xgb_deep", "xgb_balanced", "cat_deep")
    stats = prepare.column_stats(train.select(*[F.get("x", F.lit(i)).alias(m) for i, m in enumerate(MEASUREMENTS)]), MEASUREMENTS).collect()  # one row per feature
    path = scratch(spark, "registry")
    learn.save_registry(spark, path, dict(zip(names, forest.trees)), {r["column"]: (r["mean"], r["std"]) for r in stats}, {"features": list(MEASUREMENTS)})
    models, scaler, metadata = learn.load_registry(spark, path)
    votes = [m.column(F.col("x")) for m in models.values()]
    rows = _flows(spark, d, "test")
    return rows.select("record_id", F.lit(len(scaler)).alias("scaled"), F.lit(len(metadata["features"])).alias("features"), F.size(F.array(*votes)).alias("models"), F.round(sum(votes[1:], votes[0]) / len(votes), 4).alias("vote"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """customer written as CSV and read again with its schema."""
    c = table(spark, d, "customer")
    path = scratch(spark, "csv")
    c.write.option("header", True).csv(path)
    return files.read_csv(spark, path, c.schema, skip_bad=True)


def mixed_directory(spark: SparkSession, d: str) -> DataFrame:
    """nation as Parquet and region as CSV in one folder, read together."""
    path = scratch(spark, "mixed")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.parquet(f"{path}/a.parquet")
    table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).write.option("header", True).csv(f"{path}/b.csv")
    return files.read_directory(spark, path)


def dataset_bundle(spark: SparkSession, d: str) -> DataFrame:
    """combined_dataset written as a bundle partitioned by data set; its metadata read again."""
    path = scratch(spark, "bundle")
    files.write_bundle(table(spark, d, "combined_dataset"), path, "dataset_id")
    m = spark.read.json(f"{path}/metadata")
    return m.select("n_samples", "n_features", F.array_join("feature_names", ",").alias("feature_names"))


QUERIES = {
    **{f.__name__: f for f in (vector_distances, normalize_rows, activations, softmax_scores, pairwise_distance, knn, cosine_topk, knn_recall, smote)},
    **{
        f.__name__: f
        for f in (
            decision_tree, decision_tree_regressor, random_forest, gradient_boosting, perceptron, feature_importance, converted_model, f1_ensemble, best_split, golden_models, grid_search, random_search, model_registry,
            csv_round_trip, mixed_directory, dataset_bundle,
        )
    },
}

_P = f"{PROBE}::DOUBLE[]"
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_SIG = "1 / (1 + exp(-x))"
_SP = "(ln(1 + exp(-abs(x))) + greatest(x, 0))"
_ACT = {
    "sigmoid": _SIG, "tanh": "tanh(x)", "relu": "greatest(x, 0)", "leaky_relu": "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "elu": "CASE WHEN x > 0 THEN x ELSE exp(least(x, 0)) - 1 END",
    "selu": f"{v.SELU_SCALE} * CASE WHEN x > 0 THEN x ELSE {v.SELU_ALPHA} * (exp(least(x, 0)) - 1) END", "swish": f"x * {_SIG}", "gelu": "0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x ** 3)))",
    "softplus": _SP, "mish": f"x * tanh({_SP})", "d_sigmoid": f"({_SIG}) * (1 - {_SIG})", "d_tanh": "1 - tanh(x) ** 2", "d_relu": "(x > 0)::INT", "d_leaky_relu": "CASE WHEN x > 0 THEN 1 ELSE 0.01 END",
    "d_elu": "CASE WHEN x > 0 THEN 1 ELSE exp(least(x, 0)) END",
}
_NEAR = f"""{_E},
q AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(a.v, b.v) AS dist, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.vec_id % 20 = 0)
"""

SQL = {
    "f1_ensemble": tree_sql.f1_weighted("label_binary", 7, 2),
    "converted_model": tree_sql.predicted("label_family", "gini", 4),
    "decision_tree": tree_sql.predicted("label_family", "gini", 4),
    "decision_tree_regressor": tree_sql.predicted("label_family", "mse", 4).replace("value AS prediction", "round(value, 6) AS prediction"),
    "random_forest": tree_sql.forest("label_family", 5, 4),
    "gradient_boosting": tree_sql.boosted("label_binary", 4, 2, 0.1),
    "feature_importance": tree_sql.importances("label_family", 4),
    "grid_search": tree_sql.searched("label_binary", GRID, 2),
    "random_search": tree_sql.searched("label_binary", DRAWN, 2),
    "model_registry": tree_sql.voted("label_binary", 6, 2, len(MEASUREMENTS)),
    "vector_distances": f"""WITH {_E} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 5) AS norm, round(list_distance(v, {_P}), 5) AS euclidean,
round(list_sum(list_transform(v, lambda x, i: abs(x - ({_P})[i]))), 4) AS manhattan, round(list_cosine_similarity(v, {_P}), 5) AS cosine FROM e""",
    "normalize_rows": f"WITH {_E}, n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS l, unnest(range(len(v)))::INT AS pos FROM e) SELECT vec_id, pos, round(v[pos + 1] / CASE WHEN l < 1e-10 THEN 1 ELSE l END, 5) AS x FROM n",
    "activations": "SELECT x, " + ", ".join(f"round(({e})::DOUBLE, 6) AS {n}" for n, e in _ACT.items()) + " FROM (SELECT DISTINCT round((l_discount - l_tax) * 20, 4) AS x FROM lineitem)",
    "softmax_scores": """SELECT feed_id, round(exp(list_max(s) - m) / list_sum(list_transform(s, lambda x: exp(x - m))), 6) AS most, 1.0::DOUBLE AS total FROM (
SELECT feed_id, map_values(model_scores) AS s, list_max(map_values(model_scores)) AS m FROM feed WHERE model_scores IS NOT NULL)""",
    "pairwise_distance": f"WITH {_NEAR} SELECT query, neighbour, round(dist, 5) AS distance FROM q",
    "knn": f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM q WHERE query <> neighbour) SELECT query, neighbour, rank, round(dist, 5) AS distance FROM r WHERE rank <= 5",
    "cosine_topk": f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, neighbour) AS rank FROM q WHERE query <> neighbour) SELECT query, neighbour, rank, round(sim, 5) AS similarity FROM r WHERE rank <= 10",
    "best_split": """WITH r AS (SELECT *, label_binary AS y FROM combined_dataset WHERE split = 'train' AND label_binary IS NOT NULL),
long AS ("""
    + " UNION ALL ".join(f"SELECT {i} AS f, '{m}' AS feature, coalesce({m}, 0)::DOUBLE AS v, y FROM r" for i, m in enumerate(MEASUREMENTS))
    + """),
c AS (SELECT f, feature, v, count(*) AS n, sum(y) AS p FROM long GROUP BY ALL),
u AS (SELECT f, feature, v, sum(n) OVER w AS n, sum(p) OVER w AS p FROM c WINDOW w AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING)),
t AS (SELECT count(*) AS tn, sum(y) AS tp FROM r),
s AS (SELECT *, tn - n AS m, tp - p AS q FROM u, t WHERE n < tn),
g AS (SELECT *, (n * (1 - (p / n) ** 2 - ((n - p) / n) ** 2) + m * (1 - (q / m) ** 2 - ((m - q) / m) ** 2)) / tn AS score FROM s)
SELECT feature, v AS threshold, n::BIGINT AS left_rows, round(score, 9) AS score FROM g ORDER BY round(g.score, 12), f, v LIMIT 1""",
    "golden_models": "SELECT model, i, prediction FROM (VALUES "
    + ", ".join(
        [f"('{m}', {i}, {y}::DOUBLE)" for m in ("tree", "entropy", "forest", "boosted", "network") for i, _, y in FIXTURE] + [f"('regressor', {i}, {y}::DOUBLE)" for i, _, y in SURFACE]
    )
    + ") AS g(model, i, prediction)",
    "smote": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 0)::INT AS two FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT two, count(*) AS n FROM e GROUP BY 1), few AS (SELECT two, n FROM c ORDER BY n, two LIMIT 1), many AS (SELECT max(n) AS n FROM c),
m AS (SELECT e.vec_id, e.v, row_number() OVER (ORDER BY e.vec_id) - 1 AS i FROM e JOIN few USING (two)),
near AS (SELECT * FROM (SELECT a.vec_id AS base, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM m a JOIN m b ON a.vec_id <> b.vec_id) WHERE r <= 5),
w AS (SELECT vec_id AS base, v, unnest(range(1, ((many.n - few.n) // few.n + (i < (many.n - few.n) % few.n)::INT + 1)::BIGINT)) AS n, few.n AS fn FROM m, few, many),
h AS (SELECT *, md5('42:' || base || ':' || n) AS d FROM w),
p AS (SELECT base, v, n, ('0x' || substr(d, 1, 8))::BIGINT % least(5, fn - 1) + 1 AS pick, ('0x' || substr(d, 9, 12))::BIGINT / 281474976710656.0 AS share FROM h),
j AS (SELECT p.base, near.neighbour, p.n, p.v, o.v AS w, p.share FROM p JOIN near ON near.base = p.base AND near.r = p.pick JOIN m o ON o.vec_id = near.neighbour)
SELECT base, neighbour, n::INT AS n, pos::INT AS pos, round(v[pos + 1] + share * (w[pos + 1] - v[pos + 1]), 4) + 0.0 AS x FROM (SELECT *, unnest(range(len(v))) AS pos FROM j)""",
    "knn_recall": "SELECT 10 * count(*) AS n, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "csv_round_trip": "SELECT * FROM customer",
    "mixed_directory": "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
    "dataset_bundle": """SELECT count(*) AS n_samples, 24 AS n_features,
'record_id,split,captured_at,loaded_at,src_ip,src_port,dst_port,protocol,duration,fwd_packets,bwd_packets,fwd_bytes,bwd_bytes,fwd_pkt_len_max,fwd_pkt_len_std,bwd_pkt_len_max,bwd_pkt_len_std,flow_iat_mean,flow_iat_std,flow_iat_max,fwd_iat_mean,bwd_iat_mean,init_fwd_win_bytes,active_mean' AS feature_names
FROM combined_dataset""",
}
