"""SQL twins of the exact learners: a tree is grown level by level in one chain of common table expressions.

Rows are (id, x, y, w) per tree, x being the list of features; a node's children are 2n and 2n + 1.
"""

from __future__ import annotations

from sentrymill.operators.trees import POISSON
from sentrymill.plans.views import MEASUREMENTS

_X = "[" + ", ".join(f"coalesce({m}, 0)::DOUBLE" for m in MEASUREMENTS) + "]"
CLASSES = {"label_family": range(5), "label_binary": range(2)}


def rows_of(split: str, label: str) -> str:
    return f"SELECT record_id AS id, {_X} AS x, {label}::DOUBLE AS y FROM combined_dataset WHERE split = '{split}' AND {label} IS NOT NULL"


def copies(tree: str) -> str:
    u = f"(('0x' || substr(md5('42:' || {tree} || ':' || id), 1, 12))::BIGINT / 281474976710656.0)"
    return "(" + " + ".join(f"({u} >= {b!r}::DOUBLE)::INT" for b in POISSON) + ")::DOUBLE"


def _impurity(n: str, sums: list[str], kind: str) -> str:
    if kind == "mse":
        return f"greatest(0, {sums[1]} / {n} - ({sums[0]} / {n}) ** 2)"
    return "1 - " + " - ".join(f"({s} / {n}) ** 2" for s in sums)


def grown(name: str, train: str, test: str, kind: str, classes: range, depth: int, min_leaf: int = 1) -> str:
    """CTEs from ``train`` (tree, id, x, y, w) and ``test`` (id, x): {name}_v (tree, node, value) and {name}_t{depth} (tree, id, node)."""
    parts = ["w * y", "w * y * y"] if kind == "mse" else [f"CASE WHEN y = {c} THEN w ELSE 0 END" for c in classes]
    names = [f"s{i}" for i in range(len(parts))]
    own, left, right = ", ".join(names), ", ".join(f"sum({n}) OVER c AS {n}" for n in names), [f"t{n} - {n}" for n in names]
    sums = ", ".join(f"sum({p}) AS {n}" for p, n in zip(parts, names))
    ctes = [
        f"{name}_n0 AS (SELECT tree, id, x, y, w, 1 AS node FROM {train} WHERE w > 0)",
        f"{name}_t0 AS (SELECT tree, t.id, t.x, 1 AS node FROM {test} t, (SELECT DISTINCT tree FROM {train}))",
    ]
    for d in range(depth):
        at = f"{name}_n{d}"
        score = f"round((n * ({_impurity('n', names, kind)}) + (tn - n) * ({_impurity('(tn - n)', [f'({r})' for r in right], kind)})) / tn, 12)"
        ctes += [
            f"{name}_k{d} AS (SELECT tree, node, sum(w) AS tn, {', '.join(f'sum({p}) AS t{n}' for p, n in zip(parts, names))} FROM {at} GROUP BY 1, 2)",
            f"{name}_l{d} AS (SELECT tree, node, f, v, sum(w) AS n, {sums} FROM (SELECT tree, node, y, w, unnest(range(len(x))) AS f, unnest(x) AS v FROM {at}) GROUP BY 1, 2, 3, 4)",
            f"{name}_u{d} AS (SELECT tree, node, f, v, sum(n) OVER c AS n, {left} FROM {name}_l{d} WINDOW c AS (PARTITION BY tree, node, f ORDER BY v ROWS UNBOUNDED PRECEDING))",
            f"""{name}_s{d} AS (SELECT u.*, tn, {', '.join(f't{n}' for n in names)}, {score} AS score FROM {name}_u{d} u JOIN {name}_k{d} k USING (tree, node)
  WHERE n >= {min_leaf} AND tn - n >= {min_leaf} AND tn >= 2 AND {_impurity('tn', [f't{n}' for n in names], kind)} >= 1e-7)""",
            f"{name}_b{d} AS (SELECT tree, node, f, v, n, tn, {own}, {', '.join(f't{n}' for n in names)} FROM {name}_s{d} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score, f, v) = 1)",
            f"{name}_n{d + 1} AS (SELECT tree, id, x, y, w, CASE WHEN b.f IS NULL THEN node * 2 WHEN x[b.f + 1] <= b.v THEN node * 2 ELSE node * 2 + 1 END AS node FROM {at} LEFT JOIN {name}_b{d} b USING (tree, node))",
            f"{name}_t{d + 1} AS (SELECT tree, id, x, CASE WHEN b.f IS NULL THEN node * 2 WHEN x[b.f + 1] <= b.v THEN node * 2 ELSE node * 2 + 1 END AS node FROM {name}_t{d} LEFT JOIN {name}_b{d} b USING (tree, node))",
        ]
    last = f"{name}_n{depth}"
    if kind == "mse":
        ctes.append(f"{name}_v AS (SELECT tree, node, sum(w * y) / sum(w) AS value FROM {last} GROUP BY 1, 2)")
    else:
        ctes.append(f"{name}_v AS (SELECT tree, node, y AS value FROM (SELECT tree, node, y, sum(w) AS c FROM {last} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY c DESC, y) = 1)")
    return ",\n".join(ctes)


def predicted(label: str, kind: str, depth: int) -> str:
    """Predictions of one tree for the test rows."""
    g = grown("g", "tr", "te", kind, CLASSES[label], depth)
    return f"""WITH tr AS (SELECT 0 AS tree, *, 1.0::DOUBLE AS w FROM ({rows_of('train', label)})), te AS ({rows_of('test', label)}),
{g}
SELECT te.id AS record_id, te.y AS label, value AS prediction FROM te JOIN g_t{depth} t ON t.id = te.id JOIN g_v USING (tree, node)"""


def forest(label: str, trees: int, depth: int) -> str:
    g = grown("g", "tr", "te", "gini", CLASSES[label], depth)
    return f"""WITH r AS ({rows_of('train', label)}), tr AS (SELECT tree, id, x, y, {copies('tree')} AS w FROM r, range({trees}) AS s(tree)), te AS ({rows_of('test', label)}),
{g},
votes AS (SELECT t.id, value, count(*) AS c FROM g_t{depth} t JOIN g_v USING (tree, node) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY c DESC, value) = 1)
SELECT te.id AS record_id, te.y AS label, value AS prediction FROM te JOIN votes ON votes.id = te.id"""


def voted(label: str, trees: int, depth: int, features: int) -> str:
    """Mean vote of the trees of a forest for every test row, with or without a label."""
    g = grown("g", "tr", "te", "gini", CLASSES[label], depth)
    return f"""WITH r AS ({rows_of('train', label)}), tr AS (SELECT tree, id, x, y, {copies('tree')} AS w FROM r, range({trees}) AS s(tree)),
te AS (SELECT record_id AS id, {_X} AS x FROM combined_dataset WHERE split = 'test'),
{g}
SELECT t.id AS record_id, {features} AS scaled, {features} AS features, {trees} AS models, round(avg(value), 4) AS vote FROM g_t{depth} t JOIN g_v USING (tree, node) GROUP BY 1"""


def f1_weighted(label: str, trees: int, depth: int) -> str:
    """Votes of a forest's trees, weighted by their F1 on the validation split, for every test row."""
    g = grown("g", "tr", "te", "gini", CLASSES[label], depth)
    return f"""WITH r AS ({rows_of('train', label)}), tr AS (SELECT tree, id, x, y, {copies('tree')} AS w FROM r, range({trees}) AS s(tree)),
te AS (SELECT record_id AS id, {_X} AS x, split, {label} AS label FROM combined_dataset WHERE split IN ('valid', 'test')),
{g},
p AS (SELECT t.id, tree, value, te.split, te.label FROM g_t{depth} t JOIN g_v USING (tree, node) JOIN te ON te.id = t.id),
c AS (SELECT tree, count(*) FILTER (label = 1 AND value = 1) AS tp, count(*) FILTER (label = 0 AND value = 1) AS fp, count(*) FILTER (label = 1 AND value = 0) AS fn FROM p WHERE split = 'valid' AND label IS NOT NULL GROUP BY 1),
f AS (SELECT tree, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
SELECT id AS record_id, round(sum(value * f1) / sum(f1), 6) AS score, round(sum(value * f1) / sum(f1), 6) > 0.5 AS malicious FROM p JOIN f USING (tree) WHERE split = 'test' GROUP BY 1"""


def importances(label: str, depth: int) -> str:
    """Impurity taken away by the splits of each feature, as shares."""
    names = [f"s{i}" for i in CLASSES[label]]
    g = grown("g", "tr", "tr", "gini", CLASSES[label], depth)
    gain = f"tn * ({_impurity('tn', [f't{n}' for n in names], 'gini')}) - n * ({_impurity('n', names, 'gini')}) - (tn - n) * ({_impurity('(tn - n)', [f'(t{n} - {n})' for n in names], 'gini')})"
    splits = " UNION ALL ".join(f"SELECT f, {gain} AS gain FROM g_b{d}" for d in range(depth))
    listed = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MEASUREMENTS))
    return f"""WITH tr AS (SELECT 0 AS tree, *, 1.0::DOUBLE AS w FROM ({rows_of('train', label)})),
{g},
gains AS ({splits})
SELECT feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains), 6) AS importance FROM (VALUES {listed}) AS m(i, feature) LEFT JOIN gains ON f = i GROUP BY 1"""


def boosted(label: str, rounds: int, depth: int, rate: float) -> str:
    ctes = [
        f"r AS ({rows_of('train', label)})", f"te AS ({rows_of('test', label)})",
        "start AS (SELECT ln(sum((y > 0.5)::INT) / (sum((y <= 0.5)::INT) + 1e-10)) AS s FROM r)",
        "f0 AS (SELECT id, x, (y > 0.5)::INT::DOUBLE AS label, s AS score FROM r, start)", "e0 AS (SELECT id, x, s AS score FROM te, start)",
    ]
    for i in range(rounds):
        ctes += [
            f"tr{i} AS (SELECT 0 AS tree, id, x, label - 1 / (1 + exp(-score)) AS y, 1.0::DOUBLE AS w FROM f{i})",
            grown(f"g{i}", f"tr{i}", f"e{i}", "mse", range(0), depth),
            f"f{i + 1} AS (SELECT f.id, f.x, f.label, f.score + {rate}::DOUBLE * value AS score FROM f{i} f JOIN g{i}_n{depth} n ON n.id = f.id JOIN g{i}_v USING (tree, node))",
            f"e{i + 1} AS (SELECT e.id, e.x, e.score + {rate}::DOUBLE * value AS score FROM e{i} e JOIN g{i}_t{depth} t ON t.id = e.id JOIN g{i}_v USING (tree, node))",
        ]
    return f"""WITH {", ".join(ctes)}
SELECT te.id AS record_id, te.y AS label, CASE WHEN 1 / (1 + exp(-score)) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM te JOIN e{rounds} e ON e.id = te.id"""


def searched(label: str, settings: list[dict], k: int) -> str:
    """Mean accuracy of each setting over k folds."""
    out = [f"r AS (SELECT *, ('0x' || substr(md5('42:' || id), 1, 8))::BIGINT % {k} AS fold FROM ({rows_of('train', label)}))"]
    out.append(f"tr AS (SELECT s.tree, id, x, y, (fold <> s.tree)::INT::DOUBLE AS w FROM r, range({k}) AS s(tree))")
    selects = []
    for i, own in enumerate(settings):
        depth = own["max_depth"]
        out.append(grown(f"g{i}", "tr", "r", "gini", CLASSES[label], depth, own["min_leaf"]))
        selects.append(
            f"SELECT {own['max_depth']} AS max_depth, {own['min_leaf']} AS min_leaf, round(avg(a), 6) AS accuracy FROM (SELECT avg((value = r.y)::INT) AS a FROM g{i}_t{depth} t JOIN g{i}_v USING (tree, node) JOIN r ON r.id = t.id AND r.fold = tree GROUP BY tree)"
        )
    return "WITH " + ",\n".join(out) + "\n" + " UNION ALL ".join(selects)
