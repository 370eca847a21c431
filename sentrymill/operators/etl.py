"""Harmonizing and labelling flow datasets: names, aliases, derived features, unions, taxonomies, checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

SYSTEM_COLUMNS = ("dataset_id", "dataset_name", "label_binary", "label_family", "label_fine")
# Parts of a name that mark a label column.
LABEL_NAMES = ("label", "attack", "class", "category")
# Substrings of the label taxonomies; families 1 DoS, 2 probe, 3 exploit, else 4; the first match wins.
BENIGN_V1 = ("benign", "normal")
FAMILIES_V1 = (("dos", "ddos"), ("scan", "probe", "reconnaissance", "brute"), ("exploit", "injection", "infiltr", "web"))
BENIGN_V2 = ("benign", "normal", "background")
FAMILIES_V2 = (
    ("dos", "ddos", "slowloris", "hulk", "goldeneye", "hoic"),
    ("scan", "probe", "reconnaissance", "brute", "ftp-", "ssh-"),
    ("exploit", "injection", "infiltr", "web", "xss", "sql"),
)
FAMILY_NAMES = ("Benign", "DoS", "Probe", "Exploit", "Generic")


def normalized_names(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames the columns that are there; absent ones are ignored."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def picked(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Adds each target that is missing as a copy of its first alias present."""
    found = {t: next((a for a in names if a in df.columns), None) for t, names in aliases.items() if t not in df.columns}
    return df.withColumns({t: F.col(a) for t, a in found.items() if a})


def derived(df: DataFrame) -> DataFrame:
    """Totals, ratios over (x + 1) and the average packet size, each where its inputs exist and it doesn't."""
    steps = (
        ("total_packets", ("fwd_packets", "bwd_packets"), lambda a, b: a + b),
        ("total_bytes", ("fwd_bytes", "bwd_bytes"), lambda a, b: a + b),
        ("fwd_bwd_packet_ratio", ("fwd_packets", "bwd_packets"), lambda a, b: a / (b + 1)),
        ("fwd_bwd_byte_ratio", ("fwd_bytes", "bwd_bytes"), lambda a, b: a / (b + 1)),
        ("avg_pkt_size", ("total_bytes", "total_packets"), lambda a, b: a / (b + 1)),
    )
    for name, (a, b), f in steps:
        if name not in df.columns and a in df.columns and b in df.columns:
            df = df.withColumn(name, f(F.col(a).cast("double"), F.col(b).cast("double")))
    return df


def training_ratios(df: DataFrame, fwd_packets: str, bwd_packets: str, fwd_bytes: str, bwd_bytes: str, duration: str) -> DataFrame:
    """Packet and byte ratios and the two forward rates of the training matrix."""
    v = lambda c: F.col(c).cast("double")
    return df.withColumns(
        {
            "fwd_bwd_packet_ratio": v(fwd_packets) / (v(bwd_packets) + 1),
            "fwd_bwd_bytes_ratio": v(fwd_bytes) / (v(bwd_bytes) + 1),
            "bytes_per_second": v(fwd_bytes) / (v(duration) + 1),
            "packets_per_second": v(fwd_packets) / (v(duration) + 1),
        }
    )


def with_provenance(df: DataFrame, dataset_id: int, dataset_name: str) -> DataFrame:
    return df.withColumns({"dataset_id": F.lit(dataset_id), "dataset_name": F.lit(dataset_name)})


def common_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of the columns that all parts have, in sorted order."""
    common = sorted(set.intersection(*[set(p.columns) for p in parts]))
    return reduce(DataFrame.unionByName, [p.select(*common) for p in parts])


def filled_union(parts: Sequence[DataFrame], system: Sequence[str] = SYSTEM_COLUMNS) -> DataFrame:
    """Union of all columns by name; missing and null numeric features become 0, system columns stay as they are."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    features = [f.name for f in whole.schema if isinstance(f.dataType, NumericType) and f.name not in system]
    return whole.fillna(0, subset=features) if features else whole


def label_column(names: Sequence[str]) -> str:
    """The first name that contains label, attack, class or category, else the last one."""
    return next((n for n in names if any(x in n.lower() for x in LABEL_NAMES)), names[-1])


def columns_by_kind(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, text) feature columns, without those named label* or dataset*."""
    own = [f for f in df.schema if not f.name.lower().startswith(("label", "dataset"))]
    return [f.name for f in own if isinstance(f.dataType, NumericType)], [f.name for f in own if isinstance(f.dataType, StringType)]


def taxonomy(label: Column, benign: Sequence[str] = BENIGN_V2, families: Sequence[Sequence[str]] = FAMILIES_V2) -> dict[str, Column]:
    """label_binary, label_family and label_fine of a label; a null label is the text ``nan``, as it is when read from files."""
    text = F.coalesce(label, F.lit("nan"))
    low = F.lower(F.trim(text))
    any_of = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    family = F.when(any_of(benign), F.lit(0))
    for n, words in enumerate(families, 1):
        family = family.when(any_of(words), F.lit(n))
    return {"label_binary": F.when(any_of(benign), 0).otherwise(1), "label_family": family.otherwise(F.lit(len(families) + 1)), "label_fine": F.trim(text)}


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value, nulls left out."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def family_distribution(df: DataFrame, column: str = "label_family") -> DataFrame:
    """Count and share of each family, 0 for families without rows."""
    names = df.sparkSession.createDataFrame(list(enumerate(FAMILY_NAMES)), "family int, name string")
    counted = distribution(df, column).withColumnRenamed(column, "family")
    return names.join(counted, "family", "left").select("family", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def kinds(df: DataFrame) -> DataFrame:
    """One row per column: its type, whether it is a numeric or text feature, and its values that aren't null."""
    numeric, text = columns_by_kind(df)
    kind = lambda c: "numeric" if c in numeric else "text" if c in text else "other"
    entry = lambda c, t: F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.lit(kind(c)).alias("kind"), F.count(c).alias("values"))
    return df.agg(F.array(*[entry(c, t) for c, t in df.dtypes]).alias("cs")).select(F.inline("cs"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: its type, nulls and about how many distinct values, from one aggregation."""
    kinds = dict(df.dtypes)
    plain = [c for c in df.columns if not kinds[c].startswith(("map", "variant"))]
    entry = lambda c: F.struct(
        F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("about_distinct")
    )
    return df.agg(F.array(*[entry(c) for c in plain]).alias("cs")).select(F.inline("cs"))


def null_counts(df: DataFrame) -> DataFrame:
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"))
    return df.agg(F.array(*[entry(c) for c in df.columns]).alias("cs")).select(F.inline("cs"))


def label_integrity(df: DataFrame) -> DataFrame:
    """One row: how many rows break each of the label rules, and whether all hold."""
    b, f = F.col("label_binary"), F.col("label_family")
    checks = {
        "benign_with_family": F.count_if((b == 0) & (f != 0)),
        "malicious_without_family": F.count_if((b == 1) & (f == 0)),
        "null_binary": F.count_if(b.isNull()),
        "null_family": F.count_if(f.isNull()),
        "null_fine": F.count_if(F.col("label_fine").isNull()),
        "out_of_range": F.count_if((b < 0) | (b > 1) | (f < 0) | (f > 4)),
    }
    counted = df.agg(*[c.alias(n) for n, c in checks.items()])
    return counted.withColumn("all_hold", reduce(lambda x, y: x & y, [F.col(n) == 0 for n in checks]))


def top_labels(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def one_hot(df: DataFrame, column: str, values: Sequence, prefix: str) -> DataFrame:
    """One 0/1 column per value; other values and nulls are 0 everywhere."""
    return df.withColumns({f"{prefix}{i}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for i, v in enumerate(values)})


def feature_matrix(df: DataFrame, names: Sequence[str]) -> Column:
    """The features as one array of floats, nulls as 0."""
    return F.array(*[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) for n in names])


def latest_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key as a partial maximum, not a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(newest).select(*keys, "r.*")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
