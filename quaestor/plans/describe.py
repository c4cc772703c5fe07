"""Frequencies, numbers, typing and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import exprs
from quaestor.operators import cleaning, frequency, numeric, profiling
from quaestor.plans.registry import query, table

FREQ = """WITH c AS (SELECT trim(o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS all_n FROM c)
SELECT value, n, round(100.0 * n / all_n, 1) AS pct, round(100.0 * n / all_n, 1) AS pct_all,
 round(100 * ((n::DOUBLE/all_n + 1.96*1.96/(2*all_n) - 1.96*sqrt((n::DOUBLE/all_n)*(1-n::DOUBLE/all_n)/all_n + 1.96*1.96/(4.0*all_n*all_n)))/(1+1.96*1.96/all_n)), 1) AS ci_low,
 round(100 * ((n::DOUBLE/all_n + 1.96*1.96/(2*all_n) + 1.96*sqrt((n::DOUBLE/all_n)*(1-n::DOUBLE/all_n)/all_n + 1.96*1.96/(4.0*all_n*all_n)))/(1+1.96*1.96/all_n)), 1) AS ci_high,
 round(sum(100.0 * n / all_n) OVER (ORDER BY n DESC, value), 4) AS cum_pct, round(least(100.0, sum(round(100.0 * n / all_n, 1)) OVER (ORDER BY n DESC, value)), 1) AS cum_rounded FROM c, t"""


@query(FREQ)
def freq_table(spark, d) -> DataFrame:
    return frequency.frequency(table(spark, d, "orders"), "o_orderpriority")


@query("""WITH c AS (SELECT c_nationkey AS district, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS k FROM customer GROUP BY 1)
SELECT district, CAST(k AS BIGINT) AS k, n, round(greatest(0.0, ((k/n::DOUBLE + 1.96*1.96/(2*n) - 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)))*100, 4) AS low, round(least(1.0, ((k/n::DOUBLE + 1.96*1.96/(2*n) + 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)))*100, 4) AS high FROM c""")
def wilson_ci(spark, d) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("district")).agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("k"), F.count("*").alias("n"))
    low, high = exprs.wilson(F.col("k"), F.col("n"))
    return c.select("district", "k", "n", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


CONC = """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS s FROM c), e AS (
SELECT count(*) AS k, round(sum(-(n/s)*log2(n/s + 1e-10)), 3) AS entropy, round(log2(count(*)), 3) AS entropy_max, round(sum((n/s)*(n/s)), 3) AS herfindahl, arg_min(value, (-n, value)) AS mode, round(100.0*max(n)/any_value(s), 1) AS mode_pct FROM c, t)
SELECT *, round(entropy/entropy_max, 3) AS entropy_norm FROM e"""


@query(CONC)
def entropy(spark, d) -> DataFrame:
    return frequency.concentration(table(spark, d, "part"), "p_brand")


@query("SELECT round(sum(p*p), 3) AS herfindahl FROM (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM customer GROUP BY c_mktsegment)")
def herfindahl(spark, d) -> DataFrame:
    return frequency.concentration(table(spark, d, "customer"), "c_mktsegment").select("herfindahl")


def _flags(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("Raison/Retour"), F.when(F.col("l_linenumber") != 7, (F.col("l_discount") > 0.05).cast("int")).alias("Raison/Remise"), (F.col("l_linestatus") == "O").cast("int").alias("Raison/Ouvert"))


@query("""WITH f AS (SELECT CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS a, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS b, CASE WHEN l_linestatus='O' THEN 1 ELSE 0 END AS c FROM lineitem),
l AS (SELECT 'Retour' AS label, CAST(sum(coalesce(a,0)) AS BIGINT) AS k, count(*) AS n FROM f UNION ALL SELECT 'Remise', CAST(sum(coalesce(b,0)) AS BIGINT), count(*) FROM f UNION ALL SELECT 'Ouvert', CAST(sum(coalesce(c,0)) AS BIGINT), count(*) FROM f)
SELECT label, k AS n_yes, round(100.0*k/n, 1) AS pct, round(100*((k/n::DOUBLE + 1.96*1.96/(2*n) - 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)), 1) AS ci_low, round(100*((k/n::DOUBLE + 1.96*1.96/(2*n) + 1.96*sqrt(k/n::DOUBLE*(1-k/n::DOUBLE)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)), 1) AS ci_high FROM l""")
def binary_group(spark, d) -> DataFrame:
    df = _flags(spark, d)
    return frequency.binary_group(df, df.columns)


@query("""WITH c AS (SELECT l_linestatus AS value, count(*) AS n FROM lineitem GROUP BY 1) SELECT value, n, round(100.0*n/sum(n) OVER (), 1) AS pct, row_number() OVER (ORDER BY n DESC, value) = 1 AS dominant FROM c""")
def binary_summary(spark, d) -> DataFrame:
    return frequency.binary_summary(table(spark, d, "lineitem"), "l_linestatus")


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT value, n, sum(n) OVER () AS s, row_number() OVER (ORDER BY n DESC, value) AS k FROM c)
SELECT value, n, round(100.0*n/s, 1) AS pct, round(least(100.0, sum(round(100.0*n/s, 1)) OVER (ORDER BY n DESC, value)), 1) AS cum_rounded FROM r WHERE k <= 15""")
def cat_summary(spark, d) -> DataFrame:
    return frequency.frequency(table(spark, d, "part"), "p_brand", most=15).select("value", "n", "pct", "cum_rounded")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d) -> DataFrame:
    return frequency.status_counts(table(spark, d, "orders"), "o_orderstatus")


def _num_sql(t: str, names: list[str]) -> str:
    one = """SELECT '{c}' AS variable, count(x) AS n, count(*) - count(x) AS missing, round(min(x),4) AS min, round(max(x),4) AS max, round(max(x)-min(x),4) AS range, round(avg(x),4) AS mean, round(quantile_cont(x,0.5),4) AS median, round(stddev_samp(x),4) AS std, round(100*stddev_samp(x)/avg(x),4) AS cv,
 round(quantile_cont(x,0.25),4) AS q1, round(quantile_cont(x,0.75),4) AS q3, round(quantile_cont(x,0.75)-quantile_cont(x,0.25),4) AS iqr, round(skewness(x),4) AS skew, round(kurtosis(x),4) AS kurt, round(avg(x)-1.96*stddev_samp(x)/sqrt(count(x)),4) AS ci_low, round(avg(x)+1.96*stddev_samp(x)/sqrt(count(x)),4) AS ci_high,
 CASE WHEN abs(skewness(x))<=0.5 AND abs(kurtosis(x))<=1 THEN 'Normale' WHEN skewness(x)>1 THEN 'Asymétrie positive forte' WHEN skewness(x)<-1 THEN 'Asymétrie négative forte' WHEN abs(skewness(x))<=1 THEN 'Légèrement asymétrique' ELSE 'Distribution non normale' END AS shape FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t})"""
    return " UNION ALL ".join(one.format(c=c, t=t) for c in names)


@query(_num_sql("lineitem", ["l_quantity"]))
def num_stats(spark, d) -> DataFrame:
    return numeric.summaries(table(spark, d, "lineitem"), ["l_quantity"])


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_num_sql("lineitem", NUMS))
def num_stats_all(spark, d) -> DataFrame:
    return numeric.summaries(table(spark, d, "lineitem"), NUMS)


@query("SELECT variable, shape FROM (" + _num_sql("orders", ["o_totalprice"]) + ")")
def normality_label(spark, d) -> DataFrame:
    return numeric.summaries(table(spark, d, "orders"), ["o_totalprice"]).select("variable", "shape")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice,0.25) AS a, quantile_cont(o_totalprice,0.75) AS b, count(o_totalprice) AS n FROM orders), f AS (SELECT n, a-1.5*(b-a) AS lower, b+1.5*(b-a) AS upper FROM q)
SELECT max(n) AS n, count(*) FILTER (o_totalprice<lower OR o_totalprice>upper) AS count, round(100.0*count(*) FILTER (o_totalprice<lower OR o_totalprice>upper)/max(n),1) AS pct, round(max(lower),3) AS lower, round(max(upper),3) AS upper, round(min(o_totalprice) FILTER (o_totalprice<lower),3) AS extreme_low, round(max(o_totalprice) FILTER (o_totalprice>upper),3) AS extreme_high FROM orders, f""")
def outliers_iqr(spark, d) -> DataFrame:
    return numeric.outliers(table(spark, d, "orders"), "o_totalprice")


@query("""WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n FROM lineitem), g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)), c AS (SELECT CAST(least(floor((l_quantity-lo)/((hi-lo)/20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT g.bin, round(lo+g.bin*((hi-lo)/20),4) AS low, round(lo+(g.bin+1)*((hi-lo)/20),4) AS high, coalesce(c.n,0) AS n, round(coalesce(c.n,0)/(b.n*((hi-lo)/20)),8) AS density FROM g LEFT JOIN c ON c.bin=g.bin, b""")
def histogram(spark, d) -> DataFrame:
    return numeric.histogram(table(spark, d, "lineitem"), "l_quantity", 20)


@query("""WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
SELECT CAST(range AS INTEGER) AS i, round(lo+range*((hi-lo)/49),4) AS x, round(exp(-0.5*pow((lo+range*((hi-lo)/49)-m)/s,2))/(s*2.5066282746310002),10) AS y FROM range(50), f""")
def normal_curve(spark, d) -> DataFrame:
    return numeric.normal_curve(table(spark, d, "orders"), "o_totalprice", 50)


@query()
def kde(spark, d) -> DataFrame:
    return numeric.density(table(spark, d, "lineitem"), "l_quantity")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),4) AS r FROM lineitem" for i, a in enumerate(NUMS) for b in NUMS[:i]))
def corr_matrix(spark, d) -> DataFrame:
    return numeric.correlations(table(spark, d, "lineitem"), NUMS, 4)


# Student's quantile by its expansion in the normal one; the terms left out are below 1e-8 from 200 degrees of freedom on.
@query("""WITH s AS (SELECT count(o_totalprice) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd, 1.959963984540054 AS z FROM orders), t AS (SELECT *, n - 1 AS v FROM s),
q AS (SELECT *, z + (z^3+z)/(4.0*v) + (5*z^5+16*z^3+3*z)/(96.0*v*v) + (3*z^7+19*z^5+17*z^3-15*z)/(384.0*v*v*v) AS t FROM t) SELECT n, round(m, 2) AS mean, round(m - t*sd/sqrt(n), 2) AS low, round(m + t*sd/sqrt(n), 2) AS high FROM q""")
def mean_ci(spark, d) -> DataFrame:
    return numeric.mean_interval(table(spark, d, "orders"), "o_totalprice").select("n", *[F.round(c, 2).alias(c) for c in ("mean", "low", "high")])


def _type_sql(t: str, cols: dict[str, str]) -> str:
    """cols: variable to kind."""
    parts = []
    for k, (c, kind) in enumerate(cols.items()):
        beyond = f"max(CASE WHEN {c} IN (0,1) THEN 0 ELSE 1 END)" if kind == "numeric" else "NULL"
        length = f"avg(length(CAST({c} AS VARCHAR)))" if kind == "other" else "NULL"
        parts.append(f"SELECT '{c}' AS variable, {k} AS position, count(*) AS total, count({c}) AS valid, count(DISTINCT {c}) AS distinct_n, '{kind}' AS kind, {beyond} AS beyond, {length} AS length FROM {t}")
    return f"""SELECT variable, position, total, valid, distinct_n, kind, CASE WHEN valid=0 THEN 'categorielle' WHEN kind='date' THEN 'date' WHEN kind='numeric' AND beyond=0 THEN 'binaire' WHEN kind='numeric' AND distinct_n<=15 THEN 'categorielle' WHEN kind='numeric' THEN 'continue' WHEN distinct_n<=20 THEN 'categorielle' WHEN length>50 THEN 'texte_libre' ELSE 'categorielle' END AS type FROM ({" UNION ALL ".join(parts)})"""


PART = {"p_partkey": "numeric", "p_name": "other", "p_brand": "other", "p_type": "other", "p_size": "numeric", "p_retailprice": "numeric"}
EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type='error' THEN NULL ELSE value END AS value, CASE WHEN event_type='click' THEN 1 ELSE 0 END AS clicked FROM events)"
EVENT_KINDS = {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "other", "value": "numeric", "clicked": "numeric"}


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), (F.col("event_type") == "click").cast("int").alias("clicked"))


@query(_type_sql("part", PART))
def var_types(spark, d) -> DataFrame:
    return profiling.profile(table(spark, d, "part")).withColumnRenamed("distinct", "distinct_n")


@query(f"""WITH v AS ({_type_sql(EVENTS, EVENT_KINDS)}) SELECT max(total) AS n_obs, count(*) AS n_vars, CAST(sum(CASE WHEN type='continue' THEN 1 ELSE 0 END) AS BIGINT) AS n_continue, CAST(sum(CASE WHEN type='categorielle' THEN 1 ELSE 0 END) AS BIGINT) AS n_categorielle, CAST(sum(CASE WHEN type='binaire' THEN 1 ELSE 0 END) AS BIGINT) AS n_binaire, CAST(sum(CASE WHEN type='date' THEN 1 ELSE 0 END) AS BIGINT) AS n_date, CAST(sum(total-valid) AS BIGINT) AS n_missing, round(100.0*sum(total-valid)/sum(total),1) AS missing_pct FROM v""")
def dataset_summary(spark, d) -> DataFrame:
    return profiling.summary(profiling.profile(events(spark, d)))


@query(f"""WITH v AS ({_type_sql(EVENTS, EVENT_KINDS)}) SELECT variable, total-valid AS missing, round(100.0*(total-valid)/total,1) AS missing_pct, CASE WHEN 100.0*(total-valid)/total>50 THEN 'high' WHEN 100.0*(total-valid)/total>20 THEN 'medium' ELSE 'low' END AS band FROM v WHERE valid<total""")
def missing_profile(spark, d) -> DataFrame:
    return profiling.missing_profile(profiling.profile(events(spark, d)))


@query(f"SELECT event_id, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS value_missing FROM {EVENTS}")
def missing_matrix(spark, d) -> DataFrame:
    df = events(spark, d)
    return df.select("event_id", F.col("value").isNull().cast("int").alias("value_missing"))


@query(f"""WITH v AS ({_type_sql(EVENTS, EVENT_KINDS)}) SELECT CAST(round(0.60*(100.0*sum(valid)/sum(total)) + 0.25*least(100.0, count(DISTINCT type)/4.0*100) + 0.15*least(100.0, max(total)/200.0*100), 0) AS BIGINT) AS score FROM v""")
def quality_score(spark, d) -> DataFrame:
    return profiling.quality_score(profiling.profile(events(spark, d)))


@query(f"""WITH v AS ({_type_sql("part", PART)}), m AS (SELECT 'p_brand' AS variable, arg_min(x,(-n,x)) AS mode FROM (SELECT p_brand AS x, count(*) AS n FROM part GROUP BY 1) UNION ALL SELECT 'p_type', arg_min(x,(-n,x)) FROM (SELECT p_type AS x, count(*) AS n FROM part GROUP BY 1) UNION ALL SELECT 'p_name', arg_min(x,(-n,x)) FROM (SELECT p_name AS x, count(*) AS n FROM part GROUP BY 1))
SELECT v.variable, type, valid, round(100.0*(total-valid)/total,1) AS missing_pct, CASE WHEN type IN ('categorielle','binaire') THEN distinct_n END AS cardinality, m.mode FROM v LEFT JOIN m ON m.variable=v.variable""")
def overview(spark, d) -> DataFrame:
    df = table(spark, d, "part")
    return profiling.overview(df, profiling.profile(df)).drop("low", "high")


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) AS k, count(*) OVER () AS n FROM c)
SELECT 'p_brand' AS variable, string_agg(value, ' ; ' ORDER BY k) FILTER (k <= 20) || CASE WHEN max(n) > 20 THEN ' (+' || (max(n)-20) || ' autres)' ELSE '' END AS modalities FROM r""")
def modalities(spark, d) -> DataFrame:
    return profiling.modalities(table(spark, d, "part"), ["p_brand"])


@query(f"""WITH v AS ({_type_sql("orders", {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "other", "o_totalprice": "numeric", "o_orderdate": "date", "o_orderpriority": "other"})}), m AS (SELECT 'o_orderstatus' AS variable, string_agg(x, ' ; ' ORDER BY n DESC, x) AS modalities FROM (SELECT o_orderstatus AS x, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'o_orderpriority', string_agg(x, ' ; ' ORDER BY n DESC, x) FROM (SELECT o_orderpriority AS x, count(*) AS n FROM orders GROUP BY 1))
SELECT position + 1 AS position, v.variable, replace(v.variable, '_', ' ') AS label, type, valid, total-valid AS missing, round(100.0*(total-valid)/total,1) AS missing_pct, m.modalities FROM v LEFT JOIN m ON m.variable=v.variable""")
def var_table(spark, d) -> DataFrame:
    df = table(spark, d, "orders")
    return profiling.variable_table(df, profiling.profile(df))


@query("""SELECT doc_id, trim(replace(CASE WHEN contains(b,'/') THEN regexp_extract(b,'([^/]*)$',1) ELSE b END,'_',' ')) AS label FROM (SELECT doc_id, split_part('grp/' || source || '_' || lang || '__X','__',1) AS b FROM documents)""")
def label_from_code(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", exprs.label_from_code(F.concat(F.lit("grp/"), "source", F.lit("_"), "lang", F.lit("__X"))).alias("label"))


@query("""WITH f AS (SELECT count(*) AS n, quantile_cont(value,0.25) AS a, quantile_cont(value,0.75) AS b, skewness(value) AS sk FROM events WHERE event_type != 'error'), o AS (SELECT 100.0*count(*) FILTER (value < a-1.5*(b-a) OR value > b+1.5*(b-a))/max(n) AS pct FROM events, f WHERE event_type != 'error')
SELECT 'Outliers nombreux' AS anomaly, 'value' AS variable, 'modéré' AS severity, round(pct,2) AS figure FROM o WHERE pct > 10 UNION ALL SELECT 'Forte asymétrie', 'value', 'faible', round(sk,2) FROM f WHERE abs(sk) > 2""")
def anomaly_rules(spark, d) -> DataFrame:
    df = table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_type")
    return profiling.anomalies(df, profiling.profile(df))


@query("""SELECT 'value' AS variable, 'continue' AS kind, format('{:.2f};{:.2f};{:.2f};{:.2f};{:.2f}', round(avg(value),2), round(quantile_cont(value,0.5),2), round(stddev_samp(value),2), round(min(value),2), round(max(value),2)) AS figures FROM events
UNION ALL SELECT 'event_type', 'categorielle', string_agg(x || '=' || n, ';' ORDER BY n DESC, x) FROM (SELECT event_type AS x, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, x LIMIT 5)""")
def context_summary(spark, d) -> DataFrame:
    df = table(spark, d, "events").select("value", "event_type")
    return profiling.context(df, profiling.profile(df))


@query("SELECT event_id, event_type FROM events")
def clean_columns(spark, d) -> DataFrame:
    df = table(spark, d, "events").select("event_id", "event_type", F.lit("x").alias("_uuid"), F.lit(1).alias("Altitude_m"), F.lit("y").alias("Si autre, préciser"), F.lit("0 0").alias("Géolocalisation"))
    return cleaning.cleaned(df)


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL")
def drop_all_null(spark, d) -> DataFrame:
    return cleaning.stripped(table(spark, d, "events").select("event_id", F.col("value").alias(" value "), F.lit(None).cast("string").alias("none")))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ', ') AS head FROM embeddings")
def flatten_array(spark, d) -> DataFrame:
    head = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    return cleaning.flattened(table(spark, d, "embeddings").select("vec_id", head.alias("head")))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F','P') AND CAST(o_custkey AS VARCHAR) IN ('1','2','3','5','8','13','21')")
def filter_in(spark, d) -> DataFrame:
    return cleaning.filtered(table(spark, d, "orders"), {"o_orderstatus": ["F", "P"], "o_custkey": ["1", "2", "3", "5", "8", "13", "21"], "unknown": ["x"], "o_orderpriority": []}).select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, CAST(substr(p_brand, 7) AS DOUBLE) AS brand FROM part WHERE try_cast(substr(p_brand, 7) AS DOUBLE) IS NOT NULL")
def coerce_numeric(spark, d) -> DataFrame:
    return cleaning.coerced(table(spark, d, "part").select("p_partkey", F.substr("p_brand", F.lit(7)).alias("brand")), "brand")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_topn(spark, d) -> DataFrame:
    return cleaning.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, "o_orderkey")


@query("SELECT DISTINCT p_type AS value FROM part ORDER BY 1 LIMIT 30")
def filter_options(spark, d) -> DataFrame:
    return profiling.distinct_options(table(spark, d, "part"), "p_type")
