"""Weak labels, class counts and oversampling.

The labels cut scores at fixed shares of the table, and the scores are also
model features: a model trained on them learns the cut-offs.  They are kept
because models are trained on them, not because they are ground truth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.features import number
from packetloom.operators.selection import top_filter

# Share of rows per attack class, in order of assignment.
BUDGETS = (("SYNFlood", 0.08), ("DDoS", 0.20), ("BruteForce", 0.12), ("PortScan", 0.25))
MIN_PER_CLASS = 10
LABEL_AUTH_PORTS = (21, 22, 23, 25, 80, 110, 143, 389, 443, 445, 465, 587, 993, 995, 3306, 3389, 5432)
OVERSAMPLE_TARGET = 300


def label_scores(features: DataFrame, exact_text: bool = False) -> DataFrame:
    """Rows plus the four scores, each scaled to 0..1 over the table.

    SYN evidence is the rolling ratio, the SYN bit and once more the SYN flag.
    ``exact_text`` takes the last from the words ``SYN`` or ``0x002`` in the
    flag text after upper-casing, under which the hex form never matches.
    """
    text = F.col("tcp_flags")
    evidence = F.coalesce(F.upper(text).rlike("SYN|0x002"), F.lit(False)).cast("double") if exact_text \
        else F.col("flag_syn").cast("double")
    raw = features.withColumns({
        "_d": F.col("src_ip_frequency").cast("double"), "_p": F.col("dst_port_nunique_w30").cast("double"),
        "_s": F.col("syn_ack_ratio") + F.col("flag_syn") + evidence})

    def scaled(df: DataFrame, *columns: str) -> DataFrame:
        bounds = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
        return df.crossJoin(F.broadcast(bounds)).withColumns({
            c: F.when(F.col(f"{c}_hi") > F.col(f"{c}_lo"), F.try_divide(
                F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo"))).otherwise(F.col(c))
            for c in columns}).drop(*[f"{c}_{n}" for c in columns for n in ("lo", "hi")])

    first = scaled(raw, "_d", "_p", "_s")
    auth = number("dst_port").cast("int").isin(*LABEL_AUTH_PORTS).cast("double")
    second = scaled(first.withColumn("_b", auth * (F.col("_d") + 0.1)), "_b")
    return second.withColumnsRenamed({"_d": "ddos_score", "_p": "portscan_score", "_b": "bruteforce_score", "_s": "syn_score"})


def assign_labels(scored: DataFrame, order: str = "packet_number", total: int | None = None) -> DataFrame:
    """Rows plus ``attack_label``: each class takes its budget of the best rows still free.

    Equal scores go to the higher ``order`` first.  Every budget is turned into
    a cut-off value found by counting, so the label is a plain expression; no
    class is sorted and none is collected.  Give a ``scored`` table that is
    written or checkpointed: it is scanned some times.
    """
    n = scored.count() if total is None else total
    names = {"SYNFlood": "syn_score", "DDoS": "ddos_score", "BruteForce": "bruteforce_score", "PortScan": "portscan_score"}
    taken: Column = F.lit(False)
    label: Column | None = None
    for cls, share in BUDGETS:
        budget = max(MIN_PER_CLASS, int(round(share * n)))
        free = ~taken
        chosen = free & top_filter(scored.filter(free), [names[cls], order], budget)
        label = F.when(chosen, cls) if label is None else label.when(chosen, cls)
        taken = taken | chosen
    return scored.withColumn("attack_label", label.otherwise("BENIGN"))


def class_distribution(df: DataFrame, label: str = "attack_label") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))


def index_labels(df: DataFrame, label: str = "attack_label", name: str = "label_index") -> DataFrame:
    """Rows plus the position of their label in alphabetical order."""
    classes = sorted(r[0] for r in df.select(label).distinct().collect())
    table = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    return df.withColumn(name, F.element_at(table, F.col(label)))


def _small_classes(df: DataFrame, label: str, target: int) -> DataFrame:
    """(label, rows) of classes below the target: at most ``target`` rows each."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") < target)


def _ranked_small(df: DataFrame, label: str, order: str, target: int) -> DataFrame:
    small = F.broadcast(_small_classes(df, label, target))
    return df.join(small, label).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1)


def random_oversample(df: DataFrame, label: str = "attack_label", order: str = "packet_number",
                      target: int = OVERSAMPLE_TARGET, seed: int = 42) -> DataFrame:
    """Lift every class to ``target`` rows by repeatable draws with replacement.

    Only classes smaller than ``target`` are touched, so what is ranked and
    joined here is small whatever the size of the table.
    """
    ranked = _ranked_small(df, label, order, target)
    draws = _small_classes(df, label, target).select(
        label, "_rows", F.explode(F.sequence(F.lit(1), F.lit(target) - F.col("_rows").cast("int"))).alias("_draw"))
    draws = draws.withColumn("_rank", F.pmod(F.xxhash64(F.col(label), F.col("_draw"), F.lit(seed)), F.col("_rows")).cast("int"))
    extra = draws.select(label, "_rank", "_draw").join(ranked, [label, "_rank"]).select(*df.columns)
    return df.unionByName(extra)


def smote(df: DataFrame, features: list[str], label: str = "attack_label", order: str = "packet_number",
          target: int = OVERSAMPLE_TARGET, k: int = 5, seed: int = 42) -> DataFrame:
    """Lift every class to ``target`` rows with points between a row and one of its neighbours.

    Classes of ``target`` rows or more are left as they are.  The others hold
    fewer than ``target`` rows, so pairing rows within one of them is bounded
    by the target, not by the data.  With a class of a single row nothing is
    made, as there is no neighbour to move towards.
    """
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    near = min(k, smallest - 1)
    if near < 1:
        return df
    vector = F.array(*[F.col(f).cast("double") for f in features])
    points = _ranked_small(df, label, order, target).select(label, "_rank", "_rows", vector.alias("_x"))
    other = points.select(label, F.col("_rank").alias("_other"), F.col("_x").alias("_y"))
    distance = F.aggregate(F.zip_with("_x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    neighbours = (points.join(other, label).filter(F.col("_rank") != F.col("_other"))
                  .groupBy(label, "_rank", "_rows", "_x")
                  .agg(F.slice(F.array_sort(F.collect_list(F.struct(distance.alias("d"), "_other", "_y"))), 1, near).alias("_near")))
    draws = _small_classes(df, label, target).select(
        label, "_rows", F.explode(F.sequence(F.lit(1), F.lit(target) - F.col("_rows").cast("int"))).alias("_draw"))

    def draw(salt: int) -> Column:
        return F.xxhash64(F.col(label), F.col("_draw"), F.lit(seed), F.lit(salt))

    draws = draws.select(label, F.pmod(draw(1), F.col("_rows")).cast("int").alias("_rank"),
                         F.pmod(draw(2), F.lit(near)).cast("int").alias("_pick"),
                         (F.pmod(draw(3), F.lit(1_000_003)) / 1_000_003).alias("_u"))
    made = draws.join(neighbours, [label, "_rank"]).withColumn("_y", F.get("_near", F.col("_pick"))["_y"])
    mixed = F.zip_with("_x", "_y", lambda a, b: b - a)
    made = made.withColumn("_new", F.zip_with("_x", F.transform(mixed, lambda v: v * F.col("_u")), lambda a, v: a + v))
    values = [F.get("_new", F.lit(i)).alias(f) for i, f in enumerate(features)]
    columns = [c for c in df.columns if c in features or c == label]
    synthetic = made.select(label, *values)
    return df.select(*columns).unionByName(synthetic.select(*[F.col(c).cast(df.schema[c].dataType) for c in columns]))
