"""Queries over packet features, weak labels and preprocessing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import features as ft
from packetloom.operators import labels, prep
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_basic import _NUM, _PRIV, _SIZE_SQL
from packetloom.session import checkpoint_root
from packetloom.sources import fixtures

SMALL_BUCKETS = 1_000  # so that the halo is crossed on small test data


def engineered(spark, d) -> DataFrame:
    return ft.engineer(fixtures.packets(spark, d))


def _priv(column: str) -> str:
    return f"(SELECT coalesce({_PRIV}, false)::INT FROM (SELECT {_NUM} AS v FROM (SELECT {column} AS ip)))"


E_SQL = f"""e AS (SELECT p.*, (transport_layer IS NOT DISTINCT FROM 'TCP')::INT AS is_tcp, (transport_layer IS NOT DISTINCT FROM 'UDP')::INT AS is_udp,
    (coalesce(transport_layer, '') LIKE 'ICMP%')::INT AS is_icmp, {_SIZE_SQL} AS packet_size_category, count(*) OVER (PARTITION BY src_ip) AS src_ip_frequency,
    count(*) OVER (PARTITION BY dst_ip) AS dst_ip_frequency, CAST(hour(timestamp) AS INT) AS hour_of_day, {_priv('src_ip')} AS is_private_src, {_priv('dst_ip')} AS is_private_dst FROM p)"""

W_SQL = " WINDOW w5 AS (ORDER BY packet_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (ORDER BY packet_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), " \
        "w30 AS (ORDER BY packet_number ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_LEN, _SP, _DP, _TTL = ("packet_length::DOUBLE", "src_port::DOUBLE", "dst_port::DOUBLE", "ttl::DOUBLE")

BASE_SQL = {
    "packet_length_sq": f"{_LEN} * {_LEN}", "packet_length_log": f"ln(1 + {_LEN})", "port_ratio": f"{_DP} / greatest({_SP}, 1)",
    "dst_port_privileged": "(dst_port BETWEEN 0 AND 1023)::INT", "dst_port_ephemeral": "(dst_port BETWEEN 49152 AND 65535)::INT",
    "src_port_privileged": "(src_port BETWEEN 0 AND 1023)::INT",
    **{f"proto_{p.lower()}": f"(upper(protocol) LIKE '{p}%')::INT" for p in ("TCP", "UDP", "ICMP", "ARP", "DNS")},
    "src_ip_frequency_log": "ln(1 + src_ip_frequency::DOUBLE)", "dst_ip_frequency_log": "ln(1 + dst_ip_frequency::DOUBLE)",
    "hour_sin": "sin(2 * pi() * hour_of_day / 24)", "hour_cos": "cos(2 * pi() * hour_of_day / 24)",
}
_SYN, _ACK = "(coalesce(tcp_flags, '') IN ('0x2', '0x12'))::INT", "(coalesce(tcp_flags, '') IN ('0x12', '0x10', '0x18'))::INT"
FLAG_SQL = {"flag_syn": _SYN, "flag_ack": _ACK, "flag_rst": "0", "flag_fin": "0", "flag_psh": "(coalesce(tcp_flags, '') = '0x18')::INT"}
RATIO_SQL = {"syn_ack_ratio": f"sum({_SYN}) OVER w10 / (sum({_SYN}) OVER w10 + sum({_ACK}) OVER w10 + 1e-9::DOUBLE)"}
ROLL_SQL = {}
for _c in ("packet_length", "src_port", "dst_port", "ttl"):
    for _w in (5, 10, 30):
        _x = f"{_c}::DOUBLE"
        ROLL_SQL |= {f"{_c}_w{_w}_mean": f"avg({_x}) OVER w{_w}", f"{_c}_w{_w}_std": f"coalesce(stddev_samp({_x}) OVER w{_w}, 0)",
                     f"{_c}_w{_w}_min": f"min({_x}) OVER w{_w}", f"{_c}_w{_w}_max": f"max({_x}) OVER w{_w}",
                     f"{_c}_w{_w}_range": f"max({_x}) OVER w{_w} - min({_x}) OVER w{_w}"}
Z_SQL = {f"{c}_zscore": f"least(5, greatest(-5, ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()))" for c in ("packet_length", "src_port", "dst_port", "ttl")}
DIV_SQL = {"dst_port_nunique_w30": "count(DISTINCT dst_port) OVER w30", "src_port_nunique_w30": "count(DISTINCT src_port) OVER w30",
           "src_ip_concentration": "src_ip_frequency / (sum(src_ip_frequency) OVER w30 + 1e-9::DOUBLE)"}
_KINDS = ("TCP", "UDP", "DNS", "icmp", "_WS.MALFORMED")
_SHARE = "(count(*) FILTER (WHERE protocol = '{k}') OVER w30)::DOUBLE / count(*) OVER w30"
ENT_SQL = {"protocol_entropy_w30": "-(" + " + ".join(f"({_SHARE.format(k=k)}) * log2(({_SHARE.format(k=k)}) + 1e-9::DOUBLE)" for k in _KINDS) + ")"}
_MEAN30 = f"(CASE WHEN count(*) OVER w30 >= 2 THEN avg({_LEN}) OVER w30 ELSE 0 END)"
BURST_SQL = {
    "burstiness_index": f"coalesce(var_samp({_LEN}) OVER w30, 0) / ({_MEAN30} + 1e-9::DOUBLE)", "traffic_density": f"{_MEAN30} / ({_LEN} + 1e-9::DOUBLE)",
    "traffic_imbalance": "abs(src_ip_frequency - dst_ip_frequency) / (src_ip_frequency + dst_ip_frequency + 1e-9::DOUBLE)",
    "connection_freq_w10": "count(*) OVER w10", "is_malformed": "(upper(protocol) LIKE '%MALFORM%')::INT", "is_tiny_packet": "(packet_length < 20)::INT"}
RAW_SQL = {c: c for c in ft.RAW_FEATURES}


def select_sql(parts: dict[str, str], source: str = "e") -> str:
    return "SELECT packet_number, " + ", ".join(f"round(({x})::DOUBLE, 4) + 0.0::DOUBLE AS {n}" for n, x in parts.items()) + f" FROM {source}{W_SQL}"


def rounded(df: DataFrame, names) -> DataFrame:
    return df.select("packet_number", *[(F.round(F.col(n).cast("double"), 4) + F.lit(0.0)).alias(n) for n in names])


@register("m1_engineered_columns", over("p", f"""WITH {E_SQL} SELECT packet_number, is_tcp, is_udp, is_icmp, packet_size_category, src_ip_frequency, dst_ip_frequency, hour_of_day,
    is_private_src, is_private_dst FROM e"""))
def _(spark, d):
    return engineered(spark, d).select("packet_number", "is_tcp", "is_udp", "is_icmp", "packet_size_category", "src_ip_frequency",
                                       "dst_ip_frequency", "hour_of_day", "is_private_src", "is_private_dst")


@register("m2_base_features", over("p", f"WITH {E_SQL} {select_sql(BASE_SQL)}"))
def _(spark, d):
    return rounded(engineered(spark, d).withColumns(ft.base_features()), BASE_SQL)


@register("m3_flag_features", over("p", f"WITH {E_SQL} {select_sql({**FLAG_SQL, **RATIO_SQL})}"))
def _(spark, d):
    rows = fixtures.packets(spark, d).withColumns(ft.flag_features())
    return rounded(ft.rolling(rows, ft.syn_ratio, bucket_rows=SMALL_BUCKETS), {**FLAG_SQL, **RATIO_SQL})


@register("m4_rolling_statistics", over("p", f"WITH {E_SQL} {select_sql(ROLL_SQL)}"))
def _(spark, d):
    return rounded(ft.rolling(fixtures.packets(spark, d), ft.rolling_statistics, bucket_rows=SMALL_BUCKETS), ROLL_SQL)


@register("m4_rolling_over_gaps", over("p", f"WITH e AS (SELECT * REPLACE (packet_number * packet_number AS packet_number) FROM p) {select_sql(ROLL_SQL)}"))
def _(spark, d):
    rows = fixtures.packets(spark, d).withColumn("packet_number", F.expr("packet_number * packet_number"))
    return rounded(ft.rolling(rows, ft.rolling_statistics, bucket_rows=SMALL_BUCKETS), ROLL_SQL)


_SESSIONS = "SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY session_id ORDER BY packet_number) AS BIGINT) AS packet_number), packet_number AS capture_number FROM p"


@register("m4_many_sessions", over("p", f"WITH e AS ({_SESSIONS}) " + select_sql(ROLL_SQL).replace("(ORDER BY", "(PARTITION BY session_id ORDER BY").replace(
    "SELECT packet_number,", "SELECT capture_number AS packet_number,")))
def _(spark, d):
    # every session numbers its packets from 1, as separate exports do
    inside = F.row_number().over(Window.partitionBy("session_id").orderBy("packet_number")).cast("long")
    rows = fixtures.packets(spark, d).withColumns({"capture_number": F.col("packet_number"), "packet_number": inside})
    rows = ft.rolling(rows, ft.rolling_statistics, bucket_rows=200, session="session_id").withColumn("packet_number", F.col("capture_number"))
    return rounded(rows, ROLL_SQL)


@register("m5_zscores", over("p", f"WITH {E_SQL} {select_sql(Z_SQL)}"))
def _(spark, d):
    return rounded(ft.zscore_features(fixtures.packets(spark, d)), Z_SQL)


@register("m6_rolling_diversity", over("p", f"WITH {E_SQL} {select_sql(DIV_SQL)}"))
def _(spark, d):
    return rounded(ft.rolling(engineered(spark, d), ft.diversity, bucket_rows=SMALL_BUCKETS), DIV_SQL)


@register("m7_protocol_entropy", over("p", f"WITH {E_SQL} {select_sql(ENT_SQL)}"))
def _(spark, d):
    return rounded(ft.rolling(fixtures.packets(spark, d), ft.protocol_entropy, bucket_rows=SMALL_BUCKETS), ENT_SQL)


@register("m8_burstiness", over("p", f"WITH {E_SQL} {select_sql(BURST_SQL)}"))
def _(spark, d):
    return rounded(ft.rolling(engineered(spark, d), ft.burstiness, bucket_rows=SMALL_BUCKETS), BURST_SQL)


ALL_SQL = {**RAW_SQL, **BASE_SQL, **FLAG_SQL, **RATIO_SQL, **ROLL_SQL, **Z_SQL, **DIV_SQL, **ENT_SQL, **BURST_SQL}


@register("m9_feature_matrix", over("p", f"WITH {E_SQL} {select_sql(ALL_SQL)}"))
def _(spark, d):
    return rounded(ft.feature_matrix(engineered(spark, d)), ft.feature_names())


@register("m10_inference_features", over("p", f"""WITH x AS (SELECT * REPLACE (CASE WHEN packet_number % 3 = 0 THEN NULL ELSE ttl END AS ttl) FROM p),
    {E_SQL.replace('FROM p)', 'FROM x p)')}, e2 AS (SELECT * REPLACE (coalesce(ttl, 0) AS ttl) FROM e) {select_sql({k: v for k, v in ALL_SQL.items() if 'ttl' in k}, 'e2')}"""))
def _(spark, d):
    rows = ft.engineer(fixtures.packets(spark, d).withColumn("ttl", F.expr("CASE WHEN packet_number % 3 <> 0 THEN ttl END")))
    matrix = ft.feature_matrix(rows, contiguous=True)
    return rounded(matrix, [n for n in ft.feature_names() if "ttl" in n])


# ---- weak labels ------------------------------------------------------------------

def scored(spark, d) -> DataFrame:
    """Scored packets, written once to the shared checkpoint folder."""
    checkpoint_root(spark)
    rows = engineered(spark, d).withColumns(ft.flag_features())
    rows = ft.rolling(rows, ft.syn_ratio, ft.diversity)
    return labels.label_scores(rows).select("packet_number", "syn_score", "ddos_score", "bruteforce_score", "portscan_score",
                                            "packet_length", "src_port", "dst_port", "ttl", "syn_ack_ratio", "dst_port_nunique_w30").checkpoint()


def labelled(spark, d) -> DataFrame:
    return labels.assign_labels(scored(spark, d))


def _minmax(x: str) -> str:
    return f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())"


LABEL_SQL = f"""{E_SQL}, f AS (SELECT packet_number, packet_length, src_port, dst_port, ttl, src_ip_frequency::DOUBLE AS fd, (count(DISTINCT dst_port) OVER w30)::DOUBLE AS fp,
    sum({_SYN}) OVER w10 / (sum({_SYN}) OVER w10 + sum({_ACK}) OVER w10 + 1e-9::DOUBLE) AS ratio, ({_SYN})::DOUBLE AS syn FROM e{W_SQL}),
  g AS (SELECT *, {_minmax('fd')} AS ddos_score, {_minmax('fp')} AS portscan_score, {_minmax('(ratio + syn + syn)')} AS syn_score FROM f),
  h AS (SELECT *, (dst_port IN ({', '.join(map(str, labels.LABEL_AUTH_PORTS))}))::INT::DOUBLE * (ddos_score + 0.1::DOUBLE) AS bf FROM g),
  s0 AS (SELECT *, {_minmax('bf')} AS bruteforce_score, NULL::VARCHAR AS l FROM h)"""
_PREVIOUS = "s0"
for _i, (_cls, _share, _score) in enumerate((("SYNFlood", 0.08, "syn_score"), ("DDoS", 0.20, "ddos_score"), ("BruteForce", 0.12, "bruteforce_score"), ("PortScan", 0.25, "portscan_score")), 1):
    LABEL_SQL += (f", s{_i} AS (SELECT * REPLACE (CASE WHEN l IS NULL AND row_number() OVER (ORDER BY (l IS NULL) DESC, {_score} DESC, packet_number DESC) "
                  f"<= greatest(10, round_even({_share} * (SELECT count(*) FROM p), 0)) THEN '{_cls}' ELSE l END AS l) FROM s{_i - 1})")
LABEL_SQL += ", lab AS (SELECT * EXCLUDE (l), coalesce(l, 'BENIGN') AS attack_label FROM s4)"


@register("n1_weak_labels", over("p", f"WITH {LABEL_SQL} SELECT packet_number, attack_label FROM lab"))
def _(spark, d):
    return labelled(spark, d).select("packet_number", "attack_label")


@register("n2_class_distribution", over("p", f"WITH {LABEL_SQL} SELECT attack_label AS label, count(*) AS rows FROM lab GROUP BY 1"))
def _(spark, d):
    return labels.class_distribution(labelled(spark, d))


# a rare class next to four large ones, so that oversampling has work to do
_RARE = "CASE WHEN dst_ip = '10.0.0.7' AND src_ip IN ('192.168.1.3', '192.168.1.4') THEN 'rare' ELSE protocol END"
SMOTE_FEATURES = ["packet_length", "src_port", "ttl"]


def _rare(spark, d) -> DataFrame:
    return fixtures.packets(spark, d).select("packet_number", F.expr(_RARE).alias("attack_label"), *[F.col(c).cast("double").alias(c) for c in SMOTE_FEATURES])


@register("n3_random_oversample", over("p", f"SELECT attack_label, greatest(300, count(*)) AS rows, 0 AS foreign_rows FROM (SELECT {_RARE} AS attack_label FROM p) GROUP BY 1"))
def _(spark, d):
    rows = _rare(spark, d)
    lifted = labels.random_oversample(rows)
    counts = lifted.groupBy("attack_label").agg(F.count(F.lit(1)).alias("rows"))
    foreign = lifted.join(rows.withColumn("known", F.lit(1)), rows.columns, "left").groupBy("attack_label") \
        .agg(F.count_if(F.col("known").isNull()).cast("int").alias("foreign_rows"))
    return counts.join(foreign, "attack_label")


@register("n4_smote", over("p", f"SELECT attack_label, greatest(300, count(*)) AS rows, true AS in_range FROM (SELECT {_RARE} AS attack_label FROM p) GROUP BY 1"))
def _(spark, d):
    rows = _rare(spark, d)
    made = labels.smote(rows, SMOTE_FEATURES)
    bounds = rows.groupBy("attack_label").agg(F.min("packet_length").alias("lo"), F.max("packet_length").alias("hi"))
    return made.join(bounds, "attack_label").groupBy("attack_label").agg(
        F.count(F.lit(1)).alias("rows"), F.every(F.col("packet_length").between(F.col("lo"), F.col("hi"))).alias("in_range"))


@register("n5_build_dataset", over("p", f"""WITH {LABEL_SQL} SELECT attack_label, (row_number() OVER (ORDER BY attack_label) - 1)::DOUBLE AS label_index, greatest(300, count(*)) AS rows FROM lab GROUP BY 1"""))
def _(spark, d):
    rows = labels.random_oversample(labelled(spark, d))
    return labels.index_labels(rows).groupBy("attack_label", "label_index").agg(F.count(F.lit(1)).alias("rows"))


# ---- preprocessing ------------------------------------------------------------------

PREP = ["packet_length", "src_port", "dst_port", "ttl", "ip_version"]
_HOLES = "x AS (SELECT * REPLACE (CASE WHEN dst_ip = '10.0.0.3' THEN NULL ELSE packet_length END AS packet_length, CASE WHEN src_ip = '192.168.1.9' THEN NULL ELSE ttl END AS ttl) FROM p)"


def holes(spark, d) -> DataFrame:
    return fixtures.packets(spark, d).withColumns({
        "packet_length": F.expr("CASE WHEN dst_ip = '10.0.0.3' THEN NULL ELSE packet_length END"),
        "ttl": F.expr("CASE WHEN src_ip = '192.168.1.9' THEN NULL ELSE ttl END")}).select("packet_number", *PREP)


IMPUTE_SQL = _HOLES + ", im AS (SELECT packet_number, " + ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM x))::DOUBLE AS {c}" for c in PREP) + " FROM x)"
_Q = {c: tuple(f"(SELECT quantile_cont({c}, {q}) FROM im)" for q in (0.25, 0.75)) for c in PREP}
CLIP_SQL = IMPUTE_SQL + ", cl AS (SELECT packet_number, " + ", ".join(
    f"greatest({q1} - 3 * ({q3} - {q1}), least({q3} + 3 * ({q3} - {q1}), {c})) AS {c}" for c, (q1, q3) in _Q.items()) + " FROM im)"
SCALED = [c for c in PREP if c != "ip_version"]
SCALE_SQL = CLIP_SQL + ", sc AS (SELECT packet_number, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in SCALED) + " FROM cl)"


def _r(names, source: str) -> str:
    return "SELECT packet_number, " + ", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in names) + f" FROM {source}"


@register("n6_median_imputation", over("p", f"WITH {IMPUTE_SQL} {_r(PREP, 'im')}"))
def _(spark, d):
    rows = holes(spark, d)
    return rounded(prep.impute(rows, PREP, prep.fit_medians(rows, PREP)), PREP)


@register("n7_iqr_clipping", over("p", f"WITH {CLIP_SQL} {_r(PREP, 'cl')}"))
def _(spark, d):
    rows = holes(spark, d)
    filled = prep.impute(rows, PREP, prep.fit_medians(rows, PREP))
    return rounded(prep.clip(filled, PREP, *prep.fit_bounds(filled, PREP)), PREP)


@register("n8_zero_variance", over("p", "SELECT name, v > 0 AS kept FROM (UNPIVOT (SELECT " + ", ".join(f"var_pop({c}) AS {c}" for c in PREP) + " FROM p) ON COLUMNS(*) INTO NAME name VALUE v)"))
def _(spark, d):
    rows = fixtures.packets(spark, d)
    kept = prep.varying_columns(rows, PREP)
    return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in PREP])).alias("name")).withColumn("kept", F.col("name").isin(*kept))


@register("n9_standard_scaling", over("p", f"WITH {SCALE_SQL} {_r(SCALED, 'sc')}"))
def _(spark, d):
    rows = holes(spark, d)
    return rounded(prep.apply(rows, prep.fit(rows, PREP), ["packet_number"]), SCALED)


@register("n10_apply_fitted", over("p", f"""WITH {CLIP_SQL}, st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)} FROM cl)
    SELECT packet_number, {', '.join(f"round((greatest({q1} - 3 * ({q3} - {q1}), least({q3} + 3 * ({q3} - {q1}), y.{c})) - m_{c}) / s_{c}, 4) + 0.0::DOUBLE AS {c}" for c, (q1, q3) in _Q.items() if c in SCALED)}
    FROM (SELECT packet_number, packet_length * 20.0::DOUBLE AS packet_length, src_port, dst_port, 0 AS ttl FROM p) y, st"""))
def _(spark, d):
    rows = holes(spark, d)
    fitted = prep.fit(rows, PREP)
    other = fixtures.packets(spark, d).withColumn("packet_length", F.col("packet_length") * 20.0).drop("ttl")
    return rounded(prep.apply(other, fitted, ["packet_number"]), SCALED)


@register("n11_feature_alignment", over("p", "SELECT packet_number, coalesce(ttl, 0)::DOUBLE AS ttl, 0.0::DOUBLE AS missing, packet_length::DOUBLE AS packet_length FROM p"))
def _(spark, d):
    return prep.align(fixtures.packets(spark, d), ["ttl", "missing", "packet_length"], ["packet_number"])


@register("n12_stratified_split", over("p", "SELECT protocol, count(*) AS rows, CAST(round(count(*) * 0.2) AS BIGINT) AS test_rows FROM p GROUP BY 1"))
def _(spark, d):
    split = prep.stratified_split(fixtures.packets(spark, d), "protocol")
    return split.groupBy("protocol").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@register("n13_saved_preprocessing", over("p", f"WITH {SCALE_SQL} {_r(SCALED, 'sc')}"))
def _(spark, d):
    rows = holes(spark, d)
    path = f"{checkpoint_root(spark)}/preprocessing-{uuid.uuid4().hex}"
    prep.save(spark, prep.fit(rows, PREP), path)
    return rounded(prep.apply(rows, prep.load(spark, path), ["packet_number"]), SCALED)
