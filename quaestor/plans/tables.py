"""Pivots, tests between groups, several surveys and dictionary-driven analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import exprs
from quaestor.operators import dictionary, inference, multivariate, pivot, surveys
from quaestor.plans.registry import query, table

ROW, COL = "l_returnflag", "l_linestatus"
AGG_SQL = {"count": "CAST(count(*) AS DOUBLE)", "sum": "round(sum(l_quantity), 4)", "mean": "round(avg(l_quantity), 4)", "median": "round(quantile_cont(l_quantity, 0.5), 4)", "min": "min(l_quantity)", "max": "max(l_quantity)", "std": "round(stddev_samp(l_quantity), 4)", "nunique": "CAST(count(DISTINCT l_quantity) AS DOUBLE)"}


def _pivot(agg: str):
    def run(spark, d) -> DataFrame:
        out = pivot.cells(table(spark, d, "lineitem"), [ROW], [COL], "l_quantity", agg)
        return out.withColumn("value", F.round("value", 4))

    return run


for _name, _sql in AGG_SQL.items():
    query(f"WITH g AS (SELECT {ROW}, {COL}, {_sql} AS value FROM lineitem GROUP BY 1, 2) SELECT a.{ROW}, b.{COL}, coalesce(g.value, 0) AS value FROM (SELECT DISTINCT {ROW} FROM lineitem) a CROSS JOIN (SELECT DISTINCT {COL} FROM lineitem) b LEFT JOIN g ON g.{ROW} = a.{ROW} AND g.{COL} = b.{COL}", f"pivot_{_name}")(_pivot(_name))


@query("SELECT o_orderstatus, o_orderpriority, yr, CAST(count(*) AS DOUBLE) AS value FROM (SELECT *, year(o_orderdate) AS yr FROM orders) WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2, 3")
def pivot_multi(spark, d) -> DataFrame:
    df = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    return pivot.cells(df, ["o_orderstatus"], ["o_orderpriority", "yr"], filters={"o_orderstatus": ["F", "O"]}, fill=None)


@query("""SELECT o_orderstatus, CAST(count(*) FILTER (o_orderpriority='1-URGENT') AS DOUBLE) AS "1-URGENT", CAST(count(*) FILTER (o_orderpriority='5-LOW') AS DOUBLE) AS "5-LOW" FROM orders GROUP BY 1""")
def pivot_wide(spark, d) -> DataFrame:
    return pivot.wide(pivot.cells(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"]), ["o_orderstatus"], ["o_orderpriority"], ["1-URGENT", "5-LOW"])


def _percent(mode: str):
    return lambda spark, d: pivot.percent(pivot.cells(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"]), mode, ["o_orderstatus"], ["o_orderpriority"])


for _mode, _over in {"row": "PARTITION BY o_orderstatus", "col": "PARTITION BY o_orderpriority", "total": ""}.items():
    query(f"SELECT o_orderstatus, o_orderpriority, round(100.0 * count(*) / sum(count(*)) OVER ({_over}), 1) AS value FROM orders GROUP BY 1, 2", f"pivot_pct_{_mode}")(_percent(_mode))


@query("""SELECT CASE WHEN grouping(o_orderstatus)=1 THEN 'Total' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority)=1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def pivot_totals(spark, d) -> DataFrame:
    return pivot.margins(pivot.cells(table(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"]), "o_orderstatus", "o_orderpriority")


CELLS = "WITH g AS (SELECT o_orderstatus AS r, o_orderpriority AS c, CAST(count(*) AS DOUBLE) AS o FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM g)"


@query(CELLS + " SELECT round(sum((o-e)*(o-e)/e), 4) AS statistic, CAST((count(DISTINCT r)-1)*(count(DISTINCT c)-1) AS INTEGER) AS dof, round(sqrt(sum((o-e)*(o-e)/e)/(sum(o)*(least(count(DISTINCT r),count(DISTINCT c))-1))), 3) AS cramers_v FROM e")
def crosstab_chi2(spark, d) -> DataFrame:
    return pivot.chi2(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("statistic", "dof", "cramers_v")


@query(CELLS + " SELECT r AS \"row\", c AS col, o AS observed, round(e, 4) AS expected, round((o-e)/sqrt(e), 2) AS residual FROM e")
def crosstab_residuals(spark, d) -> DataFrame:
    return pivot.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").drop("contribution")


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def melt(spark, d) -> DataFrame:
    return pivot.melted(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


# Several surveys


def _surveys(spark, d) -> dict[str, DataFrame]:
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    return {
        "A": o.select((F.col("o_custkey") % 50).alias("Age__1Y"), F.col("o_orderstatus").alias("Statut__X"), (F.col("o_totalprice") > 250000).cast("string").alias("Grand__B")),
        "B": p.select(F.col("p_size").cast("long").alias("Age__1Y"), F.col("p_type").alias("Genre__X"), (F.col("p_size") > 25).cast("string").alias("Grand__B")),
        "C": o.select(F.col("o_orderpriority").alias("Statut__X"), (F.col("o_orderkey") % 40).alias("Age__1Y")),
    }


A_SQL = "SELECT o_custkey % 50 AS Age__1Y, o_orderstatus AS Statut__X, CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END AS Grand__B, NULL::VARCHAR AS Genre__X, 'A' AS __survey__ FROM orders"
B_SQL = "SELECT CAST(p_size AS BIGINT), NULL, CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, p_type, 'B' FROM part"
C_SQL = "SELECT o_orderkey % 40, o_orderpriority, NULL, NULL, 'C' FROM orders"
UNION_SQL = f"({A_SQL} UNION ALL {B_SQL} UNION ALL {C_SQL})"


@query(f"SELECT * FROM {UNION_SQL}")
def merge_surveys(spark, d) -> DataFrame:
    return surveys.merged(_surveys(spark, d), "union")


@query(f"SELECT Age__1Y AS Age, Statut__X AS Statut, Grand__B AS Grand, Genre__X AS Genre, __survey__ FROM {UNION_SQL}")
def merge_surveys_coded(spark, d) -> DataFrame:
    return surveys.merged(_surveys(spark, d), "phakts")


@query("SELECT doc_id, 'Revenu_' || lang AS radical, 'X' AS kind FROM documents")
def radical(spark, d) -> DataFrame:
    name = F.concat(F.lit("Revenu_"), "lang", F.lit("__X!1*1L_"))
    return table(spark, d, "documents").select("doc_id", exprs.radical(name).alias("radical"), exprs.code_type(name).alias("kind"))


@query("SELECT * FROM (VALUES ('Age__1Y',1,1,1,3),('Grand__B',1,1,0,2),('Statut__X',1,0,1,2),('Genre__X',0,1,0,1)) t(variable, A, B, C, total)")
def coverage(spark, d) -> DataFrame:
    return surveys.coverage(spark, _surveys(spark, d))


@query("SELECT 'Age__1Y' AS variable")
def common_vars(spark, d) -> DataFrame:
    return surveys.common_variables(spark, _surveys(spark, d))


@query("SELECT * FROM (VALUES ('Age__1Y'),('Grand__B'),('Statut__X'),('Genre__X')) t(variable)")
def union_vars(spark, d) -> DataFrame:
    return surveys.all_variables(spark, _surveys(spark, d))


@query("SELECT * FROM (VALUES ('Age','1Y','period',3),('Grand','B','B',2),('Statut','X','X_one',2)) t(radical, suffix, key, n)")
def common_indicators(spark, d) -> DataFrame:
    return surveys.common_indicators(spark, _surveys(spark, d))


@query(f"WITH g AS (SELECT Grand__B AS value, __survey__ AS survey, count(*) AS n FROM {UNION_SQL} WHERE Grand__B IS NOT NULL GROUP BY 1, 2) SELECT value, survey, n, round(100.0*n/sum(n) OVER (PARTITION BY survey), 1) AS pct FROM g")
def compare_cat(spark, d) -> DataFrame:
    return surveys.compare_categories(surveys.merged(_surveys(spark, d)), "Grand__B")


NUM_GROUP = "round(avg(x), 2) AS mean, round(quantile_cont(x, 0.5), 2) AS median, round(stddev_samp(x), 2) AS std, min(x) AS min, max(x) AS max"


@query(f"SELECT __survey__ AS survey, count(x) AS n, {NUM_GROUP} FROM (SELECT CAST(Age__1Y AS DOUBLE) AS x, __survey__ FROM {UNION_SQL}) GROUP BY 1")
def compare_num(spark, d) -> DataFrame:
    return surveys.compare_numbers(surveys.merged(_surveys(spark, d)), "Age__1Y")


@query("SELECT * FROM (VALUES ('Age__1Y', true), ('Grand__B', false)) t(variable, continuous)")
def compare_dispatch(spark, d) -> DataFrame:
    df = surveys.merged(_surveys(spark, d))
    return spark.createDataFrame([(n, bool(surveys.continuous(df, n))) for n in ("Age__1Y", "Grand__B")], "variable string, continuous boolean")


@query("""WITH g AS (SELECT p_type AS g, count(*) AS n, avg(p_retailprice) AS m, var_samp(p_retailprice) AS v FROM part GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n*m)/sum(n) AS m FROM g)
SELECT round((sum(g.n*(g.m-t.m)*(g.m-t.m))/(max(t.k)-1))/(sum((g.n-1)*g.v)/(max(t.n)-max(t.k))), 4) AS statistic, CAST(max(t.k) AS INTEGER) AS groups, CAST(max(t.n) AS BIGINT) AS n FROM g, t""")
def anova_f(spark, d) -> DataFrame:
    return inference.anova(table(spark, d, "part"), "p_type", "p_retailprice").select("statistic", "groups", "n")


@query("""WITH r AS (SELECT p_type AS g, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1)/2.0 AS r, count(*) OVER (PARTITION BY p_size) AS t FROM part), n AS (SELECT count(*)::DOUBLE AS n, sum(t::DOUBLE*t-1) AS ties FROM r), s AS (SELECT g, count(*) AS k, sum(r) AS s FROM r GROUP BY 1)
SELECT round((12/(max(n)*(max(n)+1))*sum(s*s/k)-3*(max(n)+1))/(1-max(ties)/(max(n)*max(n)*max(n)-max(n))), 4) AS statistic, CAST(count(*) AS INTEGER) AS groups, CAST(max(n) AS BIGINT) AS n FROM s, n""")
def kruskal_h(spark, d) -> DataFrame:
    return inference.kruskal(table(spark, d, "part"), "p_type", "p_size").select("statistic", "groups", "n")


# Dictionary

QUESTIONS = [
    dictionary.Question("o_orderstatus", type="select_one s", role="stratification"), dictionary.Question("o_orderpriority", type="select_one p", domain="Urgence", in_score=True, favourable=("1-URGENT", "2-HIGH")),
    dictionary.Question("o_totalprice", type="decimal"), dictionary.Question("absent", type="text"),
]


@query("SELECT * FROM (VALUES ('o_orderstatus'),('o_orderpriority'),('o_totalprice')) t(variable)")
def dict_match(spark, d) -> DataFrame:
    return spark.createDataFrame([(k,) for k in dictionary.matched(QUESTIONS, table(spark, d, "orders").columns)[0]], "variable string")


@query("SELECT 'absent' AS variable")
def dict_missing(spark, d) -> DataFrame:
    return spark.createDataFrame([(k,) for k in dictionary.matched(QUESTIONS, table(spark, d, "orders").columns)[1]], "variable string")


@query("SELECT * FROM (VALUES ('o_orderkey'),('o_custkey'),('o_orderdate')) t(variable)")
def dict_extra(spark, d) -> DataFrame:
    return spark.createDataFrame([(k,) for k in dictionary.matched(QUESTIONS, table(spark, d, "orders").columns)[2]], "variable string")


Z = "1.959963984540054"


@query(f"""WITH g AS (SELECT o_orderpriority AS value, count(*) AS k FROM orders GROUP BY 1), t AS (SELECT *, CAST(sum(k) OVER () AS BIGINT) AS n, k/sum(k) OVER () AS p FROM g)
SELECT value, k, n, round(100.0*k/n, 4) AS pct, round(100*((p+{Z}*{Z}/(2*n)-{Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4.0*n*n)))/(1+{Z}*{Z}/n)), 4) AS ci_low, round(100*((p+{Z}*{Z}/(2*n)+{Z}*sqrt(p*(1-p)/n+{Z}*{Z}/(4.0*n*n)))/(1+{Z}*{Z}/n)), 4) AS ci_high FROM t""")
def uni_prop(spark, d) -> DataFrame:
    return dictionary.proportions(table(spark, d, "orders"), "o_orderpriority")


@query("WITH r AS (SELECT list_distinct(string_split(p_name, ' ')) AS t FROM part WHERE p_name IS NOT NULL), x AS (SELECT unnest(t) AS value FROM r) SELECT value, count(*) AS k, (SELECT count(*) FROM r) AS n, round(100.0*count(*)/(SELECT count(*) FROM r), 4) AS pct FROM x GROUP BY 1")
def uni_multi(spark, d) -> DataFrame:
    return dictionary.multiple(table(spark, d, "part"), "p_name")


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS centre FROM lineitem")
def uni_num(spark, d) -> DataFrame:
    return dictionary.numbers(table(spark, d, "lineitem"), "l_extendedprice").select("n", F.round("centre", 4).alias("centre"))


@query("SELECT p_partkey, CASE WHEN list_contains(string_split(p_name,' '),'red') OR list_contains(string_split(p_name,' '),'small') THEN 1 ELSE 0 END AS good, CASE WHEN p_type='ECONOMY' THEN 0 ELSE 1 END AS other FROM part")
def item_favorable(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", dictionary.favourable(F.col("p_name"), "select_multiple x", ("red", "small")).alias("good"), dictionary.favourable(F.col("p_type"), "select_one y", ("ECONOMY",), "negatif").alias("other"))


SCORED = [dictionary.Question("p_type", type="select_one a", domain="Gamme", in_score=True, favourable=("ECONOMY", "SMALL")), dictionary.Question("p_name", type="select_multiple b", domain="Gamme", in_score=True, favourable=("red", "blue")), dictionary.Question("size", type="select_one c", domain="Taille", in_score=True, favourable=("1", "2", "3"))]
SCORE_SQL = "SELECT p_partkey, round(100.0*(CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 1 ELSE 0 END + CASE WHEN list_has_any(string_split(p_name,' '),['red','blue']) THEN 1 ELSE 0 END)/2, 4) AS Score_Gamme, 2 AS N_items_Gamme, CASE WHEN p_size <= 40 THEN CASE WHEN p_size IN (1,2,3) THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END AS Score_Taille, CASE WHEN p_size <= 40 THEN 1 ELSE 0 END AS N_items_Taille, p_retailprice, p_brand FROM part"


def _scored(spark, d) -> DataFrame:
    df = table(spark, d, "part").withColumn("size", F.when(F.col("p_size") <= 40, F.col("p_size").cast("string")))
    return dictionary.scores(df, SCORED, {q.name: q.name for q in SCORED})


@query(f"SELECT p_partkey, Score_Gamme, N_items_Gamme, Score_Taille, N_items_Taille FROM ({SCORE_SQL})")
def composite_score(spark, d) -> DataFrame:
    return _scored(spark, d).select("p_partkey", "Score_Gamme", "N_items_Gamme", "Score_Taille", "N_items_Taille")


@query(" UNION ALL ".join(f"SELECT '{s}' AS score, count({s}) AS n, round(avg({s}), 4) AS mean, round(quantile_cont({s}, 0.5), 4) AS median FROM ({SCORE_SQL})" for s in ("Score_Gamme", "Score_Taille")))
def score_summary(spark, d) -> DataFrame:
    return dictionary.score_summary(_scored(spark, d), ["Score_Gamme", "Score_Taille"])


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1)/2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1)/2.0 AS b FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(r.a, r.b), 6) AS rho, count(*) AS n FROM r""")
def spearman(spark, d) -> DataFrame:
    return inference.spearman(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("a", "b", "rho", "n")


@query(f'SELECT p_brand AS "group", count(Score_Gamme) AS n, round(avg(Score_Gamme), 2) AS mean, round(quantile_cont(Score_Gamme, 0.5), 2) AS median FROM ({SCORE_SQL}) GROUP BY 1 HAVING count(Score_Gamme) >= 5')
def stratified(spark, d) -> DataFrame:
    return inference.group_figures(_scored(spark, d), "p_brand", "Score_Gamme", 5).select("group", "n", "mean", "median")


@query("""WITH e AS (SELECT event_type, CASE WHEN event_type='error' THEN NULL ELSE value END AS value FROM events), q AS (SELECT quantile_cont(value,0.25) AS a, quantile_cont(value,0.75) AS b FROM e)
SELECT 'value' AS variable, round(100.0*count(value)/count(*),1) AS completion, count(*)-count(value) AS missing, count(*) FILTER (value < a-1.5*(b-a) OR value > b+1.5*(b-a)) AS outliers, false AS absent FROM e, q
UNION ALL SELECT 'event_type', round(100.0*count(event_type)/count(*),1), count(*)-count(event_type), NULL, false FROM e UNION ALL SELECT 'gone', NULL, NULL, NULL, true""")
def quality_table(spark, d) -> DataFrame:
    df = table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return dictionary.quality(df, {"value": "value", "event_type": "event_type"}, ["value"], ["gone"])


@query("SELECT 'rare' AS variable, 'event_type' AS depends_on, round(100.0*count(*) FILTER (event_id % 50 = 0)/count(*),1) AS completion, 100.0::DOUBLE AS parent FROM events")
def skip_anomaly(spark, d) -> DataFrame:
    df = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 50 == 0, 1).alias("rare"))
    meta = spark.createDataFrame([("rare", "${event_type} = 'click'"), ("event_type", "")], "variable string, relevant string")
    return dictionary.skip_anomalies(dictionary.quality(df, {c: c for c in df.columns}), meta)


@query("SELECT p_type AS list_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1")
def choice_cardinality(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("list_name"), "p_brand").distinct().groupBy("list_name").agg(F.count("*").alias("n"))


# Reductions: eigenvectors and clusters are checked by invariants in the tests.

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query()
def pca_eigen(spark, d) -> DataFrame:
    return multivariate.pca(table(spark, d, "lineitem"), NUMS)[0]


@query()
def pca_loadings(spark, d) -> DataFrame:
    return multivariate.pca(table(spark, d, "lineitem"), NUMS)[1]


@query()
def mca_inertia(spark, d) -> DataFrame:
    return multivariate.mca(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])[0]


@query()
def ca_inertia(spark, d) -> DataFrame:
    return multivariate.ca(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")[0]


@query()
def kmeans_profile(spark, d) -> DataFrame:
    return multivariate.clustered(table(spark, d, "part"), ["p_size", "p_retailprice"])[1]


@query()
def kmeans_elbow(spark, d) -> DataFrame:
    return multivariate.elbow(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query()
def minmax_profile(spark, d) -> DataFrame:
    return multivariate.minmax_profile(multivariate.clustered(table(spark, d, "part"), ["p_size", "p_retailprice"])[1], ["p_size", "p_retailprice"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS o_orderstatus_F, CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END AS o_orderstatus_O, CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END AS o_orderstatus_P FROM orders")
def one_hot(spark, d) -> DataFrame:
    return multivariate.one_hot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@query("SELECT * FROM (VALUES ('user_id'),('value')) t(variable)")
def viable_vars(spark, d) -> DataFrame:
    df = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("event_id") < 3, 1).alias("few"))
    return spark.createDataFrame([(v,) for v in multivariate.viable(df, df.columns, numeric=True)], "variable string")
