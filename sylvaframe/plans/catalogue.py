"""Catalogue of the engine's queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import atexit
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, scalars
from ..operators import forest, levelwise, partition, stats, weights
from ..sources import datasets
from ..sources.shared import remove, shared_dir, stored
from . import experiments, planner, runner

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# class statistics


@query("select l_returnflag as class, count(*) as cnt from lineitem group by 1")
def class_frequency_abs(spark, d):
    return stats.class_frequency(_t(spark, d, "lineitem"), "l_returnflag").select("class", "cnt")


@query("select l_returnflag as class, round(count(*) / sum(count(*)) over (), 6) as share from lineitem group by 1")
def class_frequency_rel(spark, d):
    return _rounded(stats.class_frequency(_t(spark, d, "lineitem"), "l_returnflag").select("class", "share"), "share")


@query("""
with c as (select cast(o_orderkey % 4 as int) as rank, o_orderpriority as class, count(*) as cnt from orders group by 1, 2)
select r.rank, k.class, coalesce(c.cnt, 0)::bigint as cnt from (select unnest([0, 1, 2, 3, 4])::int as rank) r
cross join (select distinct o_orderpriority as class from orders) k left join c on c.rank = r.rank and c.class = k.class""")
def class_frequency_by_rank_dense(spark, d):
    return stats.class_frequency_by_rank(_t(spark, d, "orders").withColumn("r", F.col("o_orderkey") % 4), "o_orderpriority", "r", 5)


@query("""
with c as (select lang, count(*) as n from documents group by 1), s as (select n, n / sum(n) over () as share from c)
select count(*) as n_classes, round(max(share), 6) as max_share, round(min(share), 6) as min_share, round(max(n) / min(n), 6) as ratio from s""")
def class_imbalance_summary(spark, d):
    return _rounded(stats.class_imbalance(_t(spark, d, "documents"), "lang"), "max_share", "min_share", "ratio")


# partitioning

_POS = "row_number() over (partition by {by} order by md5(concat('{seed}', ':', cast({key} as varchar))), {key}) - 1"


def _assigned(table: str, label: str, key: str, values: str, seed: int = 0) -> str:
    """SQL: rank of each row by largest remainder, from VALUES (class, rank, w)."""
    pos = _POS.format(by=label, seed=seed, key=key)
    return f"""
with w(class, rank, w) as (values {values}),
n as (select {label} as class, count(*) as n from {table} group by 1),
e as (select w.class, w.rank, w.w / sum(w.w) over (partition by w.class) * n.n as exact, n.n from w join n using (class)),
f as (select class, rank, floor(exact)::bigint as base, exact - floor(exact) as rest, n from e),
q as (select class, rank, base, row_number() over (partition by class order by round(rest, 9) desc, rank desc) as nth, n - sum(base) over (partition by class) as more from f),
c as (select class, rank, base + case when nth <= more then 1 else 0 end as k from q),
b as (select class, rank, sum(k) over (partition by class order by rank) as hi, k from c),
p as (select *, {label} as class_, {pos} as pos from {table}),
a as (select p.*, b.rank::int as rank from p join b on p.class_ = b.class and p.pos >= b.hi - b.k and p.pos < b.hi)"""


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _values(classes, matrix) -> str:
    return ", ".join(f"('{c}', {r}, {float(w[i])!r}::double)" for r, w in enumerate(matrix) for i, c in enumerate(classes))


_EVEN = _values(_PRIORITIES, [[1.0] * 5] * 4)


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _EVEN) + " select o_orderkey, rank from a")
def balanced_partition_assign(spark, d):
    return partition.balanced_partition(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 4).select("o_orderkey", "rank")


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _EVEN) + " select rank, class_ as class, count(*) as cnt from a group by 1, 2")
def balanced_partition_counts(spark, d):
    ranked = partition.balanced_partition(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 4)
    return ranked.groupBy("rank", F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("cnt"))


_WEIGHTS = [[0.5, 0.1, 0.2, 0.3, 0.4], [0.25, 0.3, 0.3, 0.3, 0.35], [0.25, 0.6, 0.5, 0.4, 0.25]]


def _event_classes(spark, d) -> list[str]:
    return sorted(r[0] for r in _t(spark, d, "events").select("event_type").distinct().collect())


@query("""
with k as (select event_type as class, row_number() over (order by event_type) - 1 as i, count(*) as n from events group by 1),
w as (select k.class, r.rank, k.n, case r.rank when 0 then 0.5 when 1 then 0.3 else 0.2 end::double as w from k cross join (select unnest([0, 1, 2]) as rank) r),
e as (select class, rank, n, w / sum(w) over (partition by class) * n as exact from w),
q as (select class, rank, floor(exact)::bigint as base, row_number() over (partition by class order by round(exact - floor(exact), 9) desc, rank desc) as nth, n - sum(floor(exact)) over (partition by class) as more from e)
select class, rank::int as rank, (base + case when nth <= more then 1 else 0 end)::bigint as cnt from q""")
def weighted_partition_largest_remainder(spark, d):
    events = _t(spark, d, "events").select("event_id", "event_type")
    classes = _event_classes(spark, d)
    ranked = partition.assign_ranks(events, "event_type", "event_id", 3, [[w] * len(classes) for w in (0.5, 0.3, 0.2)], classes=classes)
    return ranked.groupBy(F.col("event_type").alias("class"), "rank").agg(F.count("*").alias("cnt"))


_SKELLAM = {str(mu): weights.skellam_rank_weights(4, 5, mu) for mu in (0.5, 2.0, math.inf)}


@query(" union all ".join(f"select * from ({_assigned('orders', 'o_orderpriority', 'o_orderkey', _values(_PRIORITIES, w))} select '{mu}' as mu, rank, class_ as class, count(*) as cnt from a group by 2, 3)" for mu, w in _SKELLAM.items()))
def skellam_partition_counts(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    parts = [
        partition.skellam_partition(orders, "o_orderpriority", "o_orderkey", 4, float(mu), classes=_PRIORITIES).groupBy(F.lit(mu).alias("mu"), "rank", F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("cnt"))
        for mu in _SKELLAM
    ]
    return experiments.union_runs(parts)


_SKEWED = _values(_PRIORITIES, weights.skellam_rank_weights(4, 5, 2.0))
#: Rows and columns scaled in turn to equal ranks and the table's class counts.
_FITTED = f"""with recursive w0(class, rank, w) as (values {_SKEWED}),
t as (select o_orderpriority as class, count(*) * 4.0::double / sum(count(*)) over () as c from orders group by 1),
fit as (select class, rank, w, 0 as nth from w0 union all
select class, rank, a * c / sum(a) over (partition by class) as w, nth + 1 from (select x.class, x.rank, x.nth, t.c, x.w / sum(x.w) over (partition by x.rank) as a from fit x join t using (class) where x.nth < 400)),
w as (select class, rank, w from fit where nth = 400)"""


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _SKEWED).replace(f"with w(class, rank, w) as (values {_SKEWED})", _FITTED) + " select rank, class_ as class, count(*) as cnt from a group by 1, 2")
def skellam_constant_size_partition(spark, d):
    """Weights fitted to equal rank sizes by the table's own class counts."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    ranked = partition.skellam_partition(orders, "o_orderpriority", "o_orderkey", 4, 2.0, True, classes=_PRIORITIES)
    return ranked.groupBy("rank", F.col("o_orderpriority").alias("class")).agg(F.count("*").alias("cnt"))


_U = "(('0x' || substr(md5(concat('0', ':', cast(event_id as varchar))), 1, 8))::bigint / 4294967296.0)"


@query(f"select event_type as class, least(3, floor({_U} * 4))::int as rank, count(*) as cnt from events group by 1, 2")
def sampling_partition_counts(spark, d):
    ranked = partition.sampled_partition(_t(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id", 4)
    return ranked.groupBy(F.col("event_type").alias("class"), "rank").agg(F.count("*").alias("cnt"))


def _drawn(u: str, keep: list[float], alias: list[int]) -> str:
    """SQL: the rank that a draw u in [0, 1) gets from an alias table."""
    n = len(keep)
    i, list_of = f"least({n - 1}, floor({u} * {n}))::int", lambda x: "[" + ", ".join(f"{v!r}" for v in x) + "]"
    return f"(case when {u} * {n} - {i} < ({list_of(keep)}::double[])[{i} + 1] then {i} else ({list_of(alias)})[{i} + 1] end)::int"


_ALIASES = {c: weights.alias_table([w[i] for w in _WEIGHTS]) for i, c in enumerate(_PRIORITIES)}
_V = _U.replace("event_id", "o_orderkey")


@query(f"select o_orderpriority as class, (case o_orderpriority {' '.join(f'when {c!r} then {_drawn(_V, *t)}' for c, t in _ALIASES.items())} end)::int as rank, count(*) as cnt from orders group by 1, 2")
def sampling_partition_weighted(spark, d):
    ranked = partition.sampled_partition(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 3, _WEIGHTS, classes=_PRIORITIES)
    return ranked.groupBy(F.col("o_orderpriority").alias("class"), "rank").agg(F.count("*").alias("cnt"))


_MANY = [1 + r % 7 for r in range(1024)]


@query(f"with u as (select {_U} as u from events) select {_drawn('u', *weights.alias_table(_MANY))} as rank, count(*) as cnt from u group by 1")
def sampling_partition_many_ranks(spark, d):
    """1024 ranks of seven weights: one draw and one lookup a row."""
    events = _t(spark, d, "events").select("event_id", F.lit("all").alias("class"))
    return partition.sampled_partition(events, "class", "event_id", len(_MANY), [[w] for w in _MANY], classes=["all"]).groupBy("rank").agg(F.count("*").alias("cnt"))


_NULLED = "(select o_orderkey, nullif(o_orderpriority, '5-LOW') as c from orders)"
_NULL_POS = _POS.format(by="c", seed=0, key="o_orderkey")


@query(f"""with p as (select c, {_NULL_POS} as pos, count(*) over (partition by c) as n from {_NULLED}), b as (select *, n // 4 as base, n % 4 as more from p)
select c, (case when pos < (4 - more) * base then pos // base else 4 - more + (pos - (4 - more) * base) // (base + 1) end)::int as rank, count(*) as cnt from b group by 1, 2""")
def null_class_partition(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("c"))
    return partition.balanced_partition(orders, "c", "o_orderkey", 4).groupBy("c", "rank").agg(F.count("*").alias("cnt"))


@query(f"""with c as (select c as class, count(*) as n from {_NULLED} group by 1),
e as (select class, n, ceil(round(sum(n) over () * 0.25, 9)) as total, n / sum(n) over () * ceil(round(sum(n) over () * 0.25, 9)) as exact from c),
q as (select class, floor(exact) as base, row_number() over (order by round(exact - floor(exact), 9) desc, class desc nulls last) as nth, total - sum(floor(exact)) over () as more from e),
k as (select class, base + case when nth <= more then 1 else 0 end as k from q), p as (select c as class, {_NULL_POS} as pos from {_NULLED})
select p.class, case when pos < k then 'test' else 'train' end as split, count(*) as cnt from p join k on p.class is not distinct from k.class group by 1, 2""")
def null_class_split(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("c"))
    return partition.train_test_split(orders, "o_orderkey", stratify="c").groupBy(F.col("c").alias("class"), "split").agg(F.count("*").alias("cnt"))


@query(f"with p as (select o_orderpriority as class, {_POS.format(by='o_orderpriority', seed=0, key='o_orderkey')} as pos from orders) select class, (pos % 3)::int as rank, count(*) as cnt from p group by 1, 2")
def custom_partitioner(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    ranked = partition.partition_class_wise(orders, "o_orderpriority", "o_orderkey", 3, lambda c, pos, n: pos % 3)
    return ranked.groupBy(F.col("o_orderpriority").alias("class"), "rank").agg(F.count("*").alias("cnt"))


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _EVEN) + " select rank, count(*) as n, min(o_orderkey) as lowest, sum(o_orderkey)::bigint as total from a group by 1")
def indices_by_rank(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    lists = partition.indices_by_rank(partition.balanced_partition(orders, "o_orderpriority", "o_orderkey", 4), "o_orderkey")
    return lists.select("rank", F.size("indices").cast("long").alias("n"), F.col("indices")[0].alias("lowest"), F.aggregate("indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_ALL = _POS.format(by="1", seed=0, key="o_orderkey")


@query(f"with p as (select *, {_ALL} as pos, count(*) over () as n from orders) select case when pos < ceil(round(n * 0.25, 9)) then 'test' else 'train' end as split, count(*) as cnt from p group by 1")
def train_test_split_counts(spark, d):
    return partition.train_test_split(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("split").agg(F.count("*").alias("cnt"))


@query(f"""
with c as (select o_orderpriority as class, count(*) as n from orders group by 1),
e as (select class, n, ceil(round(sum(n) over () * 0.25, 9)) as total, n / sum(n) over () * ceil(round(sum(n) over () * 0.25, 9)) as exact from c),
q as (select class, floor(exact) as base, row_number() over (order by round(exact - floor(exact), 9) desc, class desc) as nth, total - sum(floor(exact)) over () as more from e),
k as (select class, base + case when nth <= more then 1 else 0 end as k from q),
p as (select o_orderpriority as class, {_POS.format(by="o_orderpriority", seed=0, key="o_orderkey")} as pos from orders)
select class, case when pos < k then 'test' else 'train' end as split, count(*) as cnt from p join k using (class) group by 1, 2""")
def train_test_split_stratified(spark, d):
    split = partition.train_test_split(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", stratify="o_orderpriority")
    return split.groupBy(F.col("o_orderpriority").alias("class"), "split").agg(F.count("*").alias("cnt"))


@query("with o as materialized (select o_orderkey, o_orderpriority from (select *, " + _ALL + " as pos0, count(*) over () as n from orders) where pos0 >= ceil(round(n * 0.25, 9)))," + _assigned("o", "o_orderpriority", "o_orderkey", _EVEN).strip()[4:] + " select rank, count(*) as cnt from a group by 1")
def split_then_partition(spark, d):
    split = partition.train_test_split(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    ranked = partition.balanced_partition(split.where("split = 'train'"), "o_orderpriority", "o_orderkey", 4)
    return ranked.groupBy("rank").agg(F.count("*").alias("cnt"))


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _EVEN) + f", s as (select rank, {_POS.format(by='rank', seed=0, key='o_orderkey')} as p, count(*) over (partition by rank) as n from a) select rank, case when p < ceil(round(n * 0.25, 9)) then 'test' else 'train' end as split, count(*) as cnt from s group by 1, 2")
def partition_then_split(spark, d):
    ranked = partition.balanced_partition(_t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 4)
    return partition.train_test_split(ranked, "o_orderkey", within="rank").groupBy("rank", "split").agg(F.count("*").alias("cnt"))


@query("""
with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s, avg(l_extendedprice) as mp, stddev_pop(l_extendedprice) as sp from lineitem where l_orderkey % 4 <> 0)
select l_returnflag, round(avg((l_quantity - m) / s), 6) + 0.0 as q, round(avg((l_extendedprice - mp) / sp), 6) + 0.0 as p from lineitem, s group by 1""")
def normalize_features(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice")
    z = partition.normalize(lines, ["l_quantity", "l_extendedprice"], F.col("l_orderkey") % 4 != 0)
    return z.groupBy("l_returnflag").agg((F.round(F.avg("l_quantity"), 6) + 0.0).alias("q"), (F.round(F.avg("l_extendedprice"), 6) + 0.0).alias("p"))


@query("select p_partkey, r::int as rank, (p_size * 20 // 16 + case when r < p_size * 20 % 16 then 1 else 0 end)::bigint as n_trees from part cross join (select unnest(range(16)) as r)")
def tree_distribution(spark, d):
    """The trees of each part's model on each of 16 ranks."""
    ranks = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("rank")
    return _t(spark, d, "part").select("p_partkey", (F.col("p_size") * 20).alias("n"), ranks).select("p_partkey", "rank", scalars.tree_share(F.col("n"), F.lit(16), F.col("rank")).cast("long").alias("n_trees"))


# metrics

_LABELS = "select quality::int as label, toxic::int as prediction, count(*) as cnt from labels group by 1, 2"
_RULE = """select (substr(o_orderpriority, 1, 1)::int - 1)::int as label, (case when o_orderkey % 3 <> 0 then substr(o_orderpriority, 1, 1)::int - 1 else o_custkey % 5 end)::int as prediction, count(*) as cnt from orders group by 1, 2"""
_PER = """, m as (select class, sum(tp) as tp, sum(t) as t, sum(p) as p from (select label as class, case when label = prediction then cnt else 0 end as tp, cnt as t, 0 as p from c union all select prediction, 0, 0, cnt from c) group by 1)"""


def _labels(spark, d) -> DataFrame:
    return metrics.confusion(_t(spark, d, "labels"), "quality", "toxic")


def _rule(spark, d) -> DataFrame:
    truth = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return metrics.confusion(_t(spark, d, "orders").select(truth.alias("y"), F.when(F.col("o_orderkey") % 3 != 0, truth).otherwise(F.col("o_custkey") % 5).alias("p")), "y", "p")


@query(_LABELS)
def confusion_matrix(spark, d):
    return _labels(spark, d)


@query(f"with c as ({_RULE}), k as (select label as x from c union select prediction from c) select a.x as label, b.x as prediction, coalesce(c.cnt, 0)::bigint as cnt from k a cross join k b left join c on c.label = a.x and c.prediction = b.x")
def confusion_matrix_dense(spark, d):
    return metrics.confusion_dense(_rule(spark, d))


@query(f"with c as ({_RULE}) select round(sum(case when label = prediction then cnt else 0 end) / sum(cnt), 6) as accuracy from c")
def metric_accuracy(spark, d):
    return _rounded(metrics.accuracy(_rule(spark, d)), "accuracy")


@query(f"with c as ({_RULE}){_PER} select round(avg(tp / t), 6) as balanced_accuracy from m")
def metric_balanced_accuracy(spark, d):
    return _rounded(metrics.balanced_accuracy(_rule(spark, d)), "balanced_accuracy")


def _prf(average, beta=1.0) -> Query:
    def run(spark, d):
        return _rounded(metrics.precision_recall_fbeta(_rule(spark, d), beta, average), "precision", "recall", "fbeta")

    name = f"metric_precision_recall_f_{str(average).lower()}" if beta == 1.0 else "metric_fbeta_2"
    run.__name__ = name
    b2 = beta * beta
    f = f"(1 + {b2}) * tp / ({b2} * t + p)"
    columns = {
        None: f"class, round(tp / p, 6) as precision, round(tp / t, 6) as recall, round({f}, 6) as fbeta",
        "micro": "round(sum(tp) / sum(t), 6) as precision, round(sum(tp) / sum(t), 6) as recall, round(sum(tp) / sum(t), 6) as fbeta",
        "macro": f"round(avg(tp / p), 6) as precision, round(avg(tp / t), 6) as recall, round(avg({f}), 6) as fbeta",
        "weighted": f"round(sum(t * tp / p) / sum(t), 6) as precision, round(sum(t * tp / t) / sum(t), 6) as recall, round(sum(t * {f}) / sum(t), 6) as fbeta",
    }[average]
    return query(f"with c as ({_RULE}){_PER} select {columns} from m")(run)


for _average in metrics.AVERAGES:
    _prf(_average)
_prf("macro", 2.0)


def _agreement(of: str, table: str, make) -> None:
    def run(spark, d):
        return _rounded(metrics.agreement(make(spark, d)), "cohen_kappa", "matthews")

    run.__name__ = f"metric_kappa_mcc_{of}"
    query(f"""with c as ({table}){_PER}, x as (select sum(tp)::double as c, sum(t)::double as s, sum(t::double * p) as tp, sum(p::double * p) as pp, sum(t::double * t) as tt from m)
    select round((c / s - tp / s / s) / (1 - tp / s / s), 6) as cohen_kappa, round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) as matthews from x""")(run)


_agreement("labels", _LABELS, _labels)
_agreement("rule", _RULE, _rule)


@query("""
with s as (select l.quality, d.n_chars::double as score from labels l join documents d using (doc_id)),
g as (select score, sum(quality) as pos, sum(1 - quality) as neg from s group by 1),
b as (select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from g)
select round(sum(pos * (below + neg / 2)) / (sum(pos)::double * sum(neg)), 6) as auc from b""")
def roc_auc(spark, d):
    scored = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return _rounded(metrics.roc_auc(scored, "quality", "n_chars"), "auc")


# forests

#: A fixed forest of stumps over (l_quantity, l_discount, l_tax): rank, feature, threshold, class below, class above.
_STUMPS = [(0, 0, 20.0, 0, 1), (0, 1, 0.05, 1, 2), (0, 2, 0.03, 2, 0), (1, 0, 35.0, 1, 2), (1, 1, 0.02, 0, 1), (1, 2, 0.06, 0, 2)]
_X = ("l_quantity", "l_discount", "l_tax")


def _stumps(spark) -> DataFrame:
    leaf = lambda c: [float(i == c) for i in range(3)]
    rows = [x for t, (r, f, s, a, b) in enumerate(_STUMPS) for x in ((r, t, 0, f, s, 1, 2, leaf(0)), (r, t, 1, -1, 0.0, -1, -1, leaf(a)), (r, t, 2, -1, 0.0, -1, -1, leaf(b)))]
    return spark.createDataFrame(rows, forest.TREE_SCHEMA)


def _stump_input(spark, d) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return _t(spark, d, "lineitem").select(F.array(*_X).alias("features"), label.alias("label"))


def _votes_sql(ranks: tuple[int, ...] = (0, 1)) -> str:
    return ", ".join("(" + " + ".join(f"case when (case when {_X[f]} <= {s} then {a} else {b} end) = {c} then 1 else 0 end" for r, f, s, a, b in _STUMPS if r in ranks) + f") as v{c}" for c in range(3))


_PRED = "case when v0 >= v1 and v0 >= v2 then 0 when v1 >= v2 then 1 else 2 end"
_TRUTH = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label"


@query(f"with v as (select {_votes_sql()} from lineitem) select v0::int as v0, v1::int as v1, v2::int as v2, count(*) as cnt from v group by 1, 2, 3")
def forest_vote_histogram(spark, d):
    voted = forest.vote(_stump_input(spark, d), _stumps(spark), 3)
    return voted.groupBy(*[F.col("votes")[c].cast("int").alias(f"v{c}") for c in range(3)]).agg(F.count("*").alias("cnt"))


@query(f"with v as (select {_TRUTH}, {_votes_sql()} from lineitem) select label::int as label, ({_PRED})::int as prediction, count(*) as cnt from v group by 1, 2")
def forest_predict_global(spark, d):
    return metrics.confusion(forest.predict(_stump_input(spark, d), _stumps(spark), 3), "label", "prediction")


@query(" union all ".join(f"(with v as (select {_votes_sql((r,))} from lineitem) select {r}::int as rank, ({_PRED})::int as prediction, count(*) as cnt from v group by 1, 2)" for r in (0, 1)))
def forest_predict_local_by_rank(spark, d):
    voted = forest.vote(_stump_input(spark, d), _stumps(spark), 3, by_rank=True)
    return voted.select(F.posexplode("votes").alias("rank", "v")).groupBy("rank", forest.first_argmax(F.col("v")).alias("prediction")).agg(F.count("*").alias("cnt"))


@query(" union all ".join(f"(with v as (select {_TRUTH}, {_votes_sql(r)} from lineitem) select '{n}' as scope, round(avg(case when {_PRED} = label then 1.0 else 0.0 end), 6) as accuracy from v)" for n, r in (("global", (0, 1)), ("local0", (0,)), ("local1", (1,)))))
def forest_accuracy_local_global(spark, d):
    scores = forest.evaluate(_stump_input(spark, d), _stumps(spark), 3)["scores"]
    local = scores.select(F.concat(F.lit("local"), F.col("rank").cast("string")).alias("scope"), F.col("acc_local").alias("accuracy"))
    return _rounded(local.unionByName(scores.agg(F.first("acc_global").alias("accuracy")).withColumn("scope", F.lit("global"))), "accuracy")


def _private(spark, d) -> dict[str, DataFrame]:
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    own = _t(spark, d, "lineitem").select(F.array(*_X).alias("features"), label.alias("label"), (F.col("l_orderkey") % 2).cast("int").alias("rank"))
    return forest.evaluate(own, _stumps(spark), 3, private=True)


def _own(columns: str) -> str:
    """SQL: by rank over its own rows, with its own votes (l0, l1, l2) and those of all ranks (v0, v1, v2)."""
    parts = [f"select {r}::int as rank, {_TRUTH}, ({_PRED})::int as mine, whole from (select *, {_votes_sql((r,))} from (select *, ({_PRED})::int as whole from (select *, {_votes_sql()} from lineitem)) where l_orderkey % 2 = {r})" for r in (0, 1)]
    return f"with j as ({' union all '.join(p.replace('select *, ' + _votes_sql((i,)), 'select * exclude (v0, v1, v2), ' + _votes_sql((i,))) for i, p in enumerate(parts))}) {columns}"


@query(_own("select rank, count(*) as n, round(avg((mine = label)::int), 6) as acc_local, round(avg((whole = label)::int), 6) as acc_global_local, round((select avg((whole = label)::int) from j), 6) as acc_global from j group by 1"))
def forest_accuracy_private(spark, d):
    return _rounded(_private(spark, d)["scores"], "acc_local", "acc_global_local", "acc_global")


@query(_own("select 'local' as scope, rank, label::int as label, mine as prediction, count(*) as cnt from j group by all union all select 'global', null, label::int, whole, count(*) from j group by all"))
def forest_confusion_by_rank(spark, d):
    return _private(spark, d)["confusion"]


@query("select o_orderstatus, (case when v1 * 2 >= 3 then 1 else 0 end)::int as prediction, count(*) as cnt from (select o_orderstatus, (o_totalprice > 100000)::int + (o_custkey > 500)::int + (o_orderkey > 3000)::int as v1 from orders) group by 1, 2")
def forest_votes_in_parts(spark, d):
    """A model that is sent tree by tree votes like a whole one."""
    leaf = lambda c: [float(i == c) for i in range(2)]
    rows = [x for t, (f, s) in enumerate([(0, 100000.0), (1, 500.0), (2, 3000.0)]) for x in ((0, t, 0, f, s, 1, 2, leaf(0)), (0, t, 1, -1, 0.0, -1, -1, leaf(0)), (0, t, 2, -1, 0.0, -1, -1, leaf(1)))]
    data = _t(spark, d, "orders").select("o_orderstatus", F.array("o_totalprice", F.col("o_custkey").cast("double"), F.col("o_orderkey").cast("double")).alias("features"))
    judged = forest.predict(data, spark.createDataFrame(rows, forest.TREE_SCHEMA), 2, part_nodes=3)
    return judged.groupBy("o_orderstatus", "prediction").agg(F.count("*").alias("cnt"))


@query("select dense_rank() over (partition by p_size % 4 order by p_partkey) - 1 as place, (p_size % 4)::int as rank, p_partkey::int as tree_id from part")
def shared_model_order(spark, d):
    """The model of a tree for each part: the first tree of each rank, the second of each, and so on."""
    leaf = [F.lit(0).alias("node_id"), F.lit(-1).alias("feature"), F.lit(0.0).alias("threshold"), F.lit(-1).alias("left"), F.lit(-1).alias("right"), F.array(F.lit(1.0)).alias("votes")]
    trees = _t(spark, d, "part").select((F.col("p_size") % 4).cast("int").alias("rank"), F.col("p_partkey").cast("int").alias("tree_id"), *leaf)
    return forest.shared_model(trees).select(F.col("local_tree").alias("place"), "rank", "tree_id")


_DEEP = [(0, 0, 25.0, 1, 2, None), (1, 1, 0.04, 3, 4, None), (2, 2, 0.05, 5, 6, None), (3, 0, 10.0, 7, 8, None), *[(i, -1, 0.0, -1, -1, c) for i, c in ((4, 2), (5, 1), (6, 0), (7, 0), (8, 1))]]


@query("""
select case when l_quantity <= 25 then case when l_discount <= 0.04 then case when l_quantity <= 10 then 0 else 1 end else 2 end else case when l_tax <= 0.05 then 1 else 0 end end::int as prediction,
count(*) as cnt from lineitem group by 1""")
def tree_traversal(spark, d):
    nodes = [{"node_id": i, "feature": f, "threshold": s, "left": a, "right": b, "votes": None if c is None else [float(k == c) for k in range(3)]} for i, f, s, a, b, c in _DEEP]
    return _t(spark, d, "lineitem").groupBy(F.expr(forest.case_of(nodes, _X)).cast("int").alias("prediction")).agg(F.count("*").alias("cnt"))


_GINI = """
with v as (select floor(o_totalprice / 1000) as x, o_orderstatus as y, count(*) as n from orders group by 1, 2),
g as (select x, sum(n) filter (y = 'F') as f, sum(n) filter (y = 'O') as o, sum(n) filter (y not in ('F', 'O')) as p from v group by 1),
c as (select x, sum(coalesce(f, 0)) over w as f, sum(coalesce(o, 0)) over w as o, sum(coalesce(p, 0)) over w as p, sum(coalesce(f, 0)) over () as tf, sum(coalesce(o, 0)) over () as tos, sum(coalesce(p, 0)) over () as tp from g window w as (order by x rows unbounded preceding)),
s as (select x, (f*f + o*o + p*p) / (f + o + p) + ((tf-f)*(tf-f) + (tos-o)*(tos-o) + (tp-p)*(tp-p)) / (tf + tos + tp - f - o - p) as score from c where tf + tos + tp > f + o + p)
select x::bigint as threshold, round(score, 4) as score from s order by round(score, 6) desc, x limit 1"""


@query(_GINI)
def gini_best_split(spark, d):
    """Best cut of a binned numeric feature by the sum of squared class counts, from one histogram."""
    status = F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("P")
    hist = _t(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 1000).alias("x")).agg(*[F.sum((status == c).cast("double")).alias(c) for c in "FOP"])
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.select("x", *[F.sum(c).over(w).alias(c) for c in "FOP"], *[F.sum(c).over(Window.partitionBy()).alias(f"t{c}") for c in "FOP"])
    left, right = sum(F.col(c) for c in "FOP"), sum(F.col(f"t{c}") - F.col(c) for c in "FOP")
    score = F.try_divide(sum(F.col(c) * F.col(c) for c in "FOP"), left) + F.try_divide(sum((F.col(f"t{c}") - F.col(c)) * (F.col(f"t{c}") - F.col(c)) for c in "FOP"), right)
    best = run.withColumn("score", score).where(right > 0).orderBy(F.round("score", 6).desc(), "x").limit(1)
    return best.select(F.col("x").cast("long").alias("threshold"), F.round("score", 4).alias("score"))


#: Upper edges of the bins of _X.
_EDGES = [[10.0, 20.0, 30.0, 40.0], [0.02, 0.04, 0.06, 0.08], [0.02, 0.04, 0.06]]
_BINNED = ", ".join(" + ".join(f"({c} > {e})::int" for e in edges) + f" as x{f}" for f, (c, edges) in enumerate(zip(_X, _EDGES, strict=True)))


def _cuts_sql(node: str) -> str:
    """SQL: b, the best cut of each node by the score over both sides of squared class counts by count; r, the binned rows."""
    left, right = [f"l{c}" for c in range(3)], [f"(s{c} - l{c})" for c in range(3)]
    side = lambda x: f"({' + '.join(f'{v}::double * {v}' for v in x)}) / nullif({' + '.join(x)}, 0)"
    return f"""with r as (select {node} as node, {_TRUTH}, {_BINNED} from lineitem),
u as ({' union all '.join(f'select node, label, {f} as feature, x{f} as bin from r' for f in range(3))}),
h as (select node, feature, bin, {', '.join(f'count(*) filter (label = {c}) as c{c}' for c in range(3))} from u group by 1, 2, 3),
s as (select node, feature, bin, {', '.join(f'sum(c{c}) over (partition by node, feature order by bin) as l{c}, sum(c{c}) over (partition by node, feature) as s{c}' for c in range(3))} from h),
q as (select node, feature, bin, {side(left)} + {side(right)} as score from s),
b as (select * from q where score is not null qualify row_number() over (partition by node order by score desc, feature, bin) = 1)"""


def _level_rows(spark, d) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    return _t(spark, d, "lineitem").select(key.alias("sample_id"), F.array(*_X).alias("features"), label.alias("label"), (F.col("l_linenumber") % 4).cast("int").alias("rank"), (F.col("l_orderkey") % 5).cast("int").alias("node_id"))


@query(_cuts_sql("l_linenumber % 4 * 10 + l_orderkey % 5") + " select (node // 10)::int as rank, (node % 10)::int as node_id, feature::int as feature, bin::int as bin, round(score, 4) as score from b")
def level_best_splits(spark, d):
    """One level of training: the best split of all nodes of all ranks from one histogram."""
    rows = _level_rows(spark, d).select("rank", F.lit(0).alias("tree_id"), "node_id", F.lit(0).cast("long").alias("seed"), F.lit(1).cast("long").alias("w"), F.col("label").alias("y"), levelwise.binned(F.col("features"), _EDGES).alias("x"))
    return levelwise.best_splits(rows, 3, 3, 3).select("rank", "node_id", "feature", "bin", F.round("score", 4).alias("score"))


_AT_BIN = "case r2.feature " + " ".join(f"when {f} then x{f}" for f in range(3)) + " end"
_EDGE = "case feature " + " ".join(f"when {f} then {e}[bin + 1]" for f, e in enumerate(_EDGES)) + " end"
_SHARES = ", ".join(f"round((count(*) filter (label = {c}))::double / count(*), 6) as v{c}" for c in range(3))


@query(_cuts_sql("l_linenumber % 4") + f""", r2 as (select r.*, b.feature, b.bin from r join b using (node))
select node::int as rank, 0::int as node_id, any_value(feature)::int as feature, any_value({_EDGE})::double as threshold, 1::int as left_child, {_SHARES} from r2 group by node union all
select node::int, (case when {_AT_BIN} <= bin then 1 else 2 end)::int as node_id, -1::int, 0.0::double, -1::int, {_SHARES} from r2 group by 1, 2""")
def train_by_level_stumps(spark, d):
    """Trees of one level by ranks on their own rows, trained from histograms."""
    trees = levelwise.train_by_level(_level_rows(spark, d), 3, 4, _EDGES, 4, replicated=False, bootstrap=False, tried=3, max_depth=1)
    return trees.select("rank", "node_id", "feature", "threshold", F.col("left").alias("left_child"), *[F.round(F.col("votes")[c], 6).alias(f"v{c}") for c in range(3)])


_HEAP = """nodes as (select p_partkey - 1 as node, (p_partkey - 1) % 3 as feature, case (p_partkey - 1) % 3 when 0 then p_size::double when 1 then (p_partkey % 11)::double / 100 else (p_partkey % 9)::double / 100 end as threshold,
2 * p_partkey < count(*) over () as inner_node from part)"""


@query(f"""with recursive {_HEAP}, walk as (select l_quantity as q, l_discount as d, l_tax as t, 0::bigint as node from lineitem union all
select q, d, t, case when (case feature when 0 then q when 1 then d else t end) <= threshold then 2 * w.node + 1 else 2 * w.node + 2 end from walk w join nodes n on w.node = n.node where n.inner_node)
select w.node::int as node_id, count(*) as cnt from walk w join nodes n on w.node = n.node where not n.inner_node group by 1""")
def tree_traversal_recursive(spark, d):
    """Every line walks one tree of any depth, a node for each part, by joins; the leaves are counted."""
    part = _t(spark, d, "part").select((F.col("p_partkey") - 1).alias("node"), "p_partkey", "p_size")
    part = part.crossJoin(part.agg(F.count("*").alias("n")))  # one row
    feature = (F.col("node") % 3).cast("int")
    threshold = F.when(feature == 0, F.col("p_size").cast("double")).when(feature == 1, (F.col("p_partkey") % 11).cast("double") / 100).otherwise((F.col("p_partkey") % 9).cast("double") / 100)
    inner = 2 * F.col("p_partkey") < F.col("n")
    child = lambda k: F.when(inner, 2 * F.col("node") + k).otherwise(-1).cast("int")
    trees = stored(part.select(F.lit(0).alias("rank"), F.lit(0).alias("tree_id"), F.col("node").cast("int").alias("node_id"), feature.alias("feature"), threshold.alias("threshold"), child(1).alias("left"), child(2).alias("right"), F.array(F.lit(1.0)).alias("votes")))
    return levelwise.leaves(_level_rows(spark, d), trees).groupBy("node_id").agg(F.count("*").alias("cnt"))


def _embeddings(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("features"), F.col("label").cast("int").alias("label"))


@query()
def forest_train_evaluate(spark, d):
    from .runner import Experiment, run_experiment

    results = run_experiment(spark, _embeddings(spark, d), Experiment(10, 16, 4, "distributed", seed=3)).results
    return results.select("comm_rank", "scope", F.round("accuracy_global_test", 6).alias("accuracy_global_test"), F.round("accuracy_local_test", 6).alias("accuracy_local_test"))


@query("select count(*) as n, 6.0::double as votes from embeddings")
def forest_votes_total(spark, d):
    """Every sample of a trained forest gets a vote of each of its 6 trees."""
    data = _embeddings(spark, d)
    trees = stored(forest.train(partition.balanced_partition(data, "label", "sample_id", 3), 10, 6, 3, 1, replicated=False))
    voted = forest.vote(data, trees, 10).select(F.aggregate("votes", F.lit(0.0), lambda a, x: a + x).alias("votes"))
    return voted.groupBy("votes").agg(F.count("*").alias("n"))


@query("select 0::bigint as n_lost, 0::bigint as n_new, 4::bigint as n_trees")
def checkpoint_roundtrip(spark, d):
    """Vote differences between a model and its reloaded checkpoint, both ways: none."""
    data = _embeddings(spark, d)
    trees = stored(forest.train(data, 10, 4, 2, 1))
    folder, uid = f"{shared_dir(spark)}/models", uuid.uuid4().hex
    forest.save(trees, folder, uid)
    atexit.register(remove, spark, f"{folder}/run_uid={uid}")
    again = forest.load(spark, folder, uid, 2)
    a, b = (stored(forest.vote(data, t, 10).select("sample_id", "votes")) for t in (trees, again))
    lost, new = a.exceptAll(b).agg(F.count("*").alias("n_lost")), b.exceptAll(a).agg(F.count("*").alias("n_new"))
    return lost.crossJoin(new).crossJoin(again.agg(F.countDistinct("tree_id").alias("n_trees")))  # one row each


@query("""with g as (select rank, count(*) as n from (select vec_id % 4 as rank from embeddings) group by 1)
select rank::int as rank, (rank < 2)::boolean as kept, 2::bigint as n_trees, true as timed from g""")
def training_resumed(spark, d):
    """A run that broke after two of four ranks is resumed: their trees stay, the others are added, and the model is that of an unbroken run."""
    data = _embeddings(spark, d).withColumn("rank", (F.col("sample_id") % 4).cast("int"))
    folder, uid = f"{shared_dir(spark)}/models", uuid.uuid4().hex
    for path in (f"{folder}/run_uid={uid}", f"{folder}/manifest-{uid}"):
        atexit.register(remove, spark, path)
    settings = (data, 10, 8, folder, uid, 4, 1, False)
    forest.train_resumable(*settings, only=[0, 1], wave=1)
    before = stored(forest.manifest(spark, folder, uid).select("rank", F.col("seconds").alias("earlier")))
    again = forest.train_resumable(*settings, wave=2)
    whole = forest.train(data, 10, 8, 4, 1, replicated=False)
    different = whole.exceptAll(again).unionByName(again.exceptAll(whole)).select(F.col("rank").alias("d_rank")).distinct()
    now = forest.manifest(spark, folder, uid).join(before, "rank", "left").join(different, F.col("rank") == F.col("d_rank"), "left_anti")
    return now.select("rank", F.coalesce(F.col("earlier") == F.col("seconds"), F.lit(False)).alias("kept"), "n_trees", (F.col("seconds") > 0).alias("timed"))


def flagship(spark, d):
    return forest_train_evaluate(spark, d)


# experiment analytics

_RUNS = "(select o_orderpriority as dataset, o_custkey % 3 as model_seed, o_orderkey % 8 + 1 as n_nodes, o_totalprice / 100 as t from orders)"


def _runs(spark, d) -> DataFrame:
    runs = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 3).alias("model_seed"), (F.col("o_orderkey") % 8 + 1).alias("n_nodes"), (F.col("o_totalprice") / 100).alias("t"))
    return runs.groupBy("dataset", "model_seed", "n_nodes").agg(F.avg("t").alias("time_sec_training"))


_MEANS = f"with r as (select dataset, model_seed, n_nodes, avg(t) as time_sec_training from {_RUNS} group by 1, 2, 3)"


def _scaling(kind: str, weak: bool) -> None:
    def run(spark, d):
        runs = _runs(spark, d)
        scaled = experiments.speedup(runs, runs.where("n_nodes = 1"), ["dataset", "model_seed"], ["time_sec_training"], weak)
        return _rounded(scaled.select("dataset", "model_seed", "n_nodes", f"{kind}_training"), f"{kind}_training")

    run.__name__ = f"{kind}_{'weak' if weak else 'strong'}"
    query(f"{_MEANS} select r.dataset, r.model_seed, r.n_nodes, round(s.time_sec_training / r.time_sec_training, 6) as {kind}_training from r join r s on s.n_nodes = 1 and s.dataset = r.dataset and s.model_seed = r.model_seed")(run)


_scaling("speedup", False)
_scaling("efficiency", True)


@query("""
with x as (select event_id, nullif(event_type, 'click') as k, value as local_value from events), m as (select k, avg(local_value) as mean_local_value from x group by 1)
select x.event_id, x.k, round(m.mean_local_value, 6) as mean_local_value from x join m on x.k is not distinct from m.k""")
def null_safe_group_mean_join(spark, d):
    x = _t(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("k"), F.col("value").alias("local_value"))
    return _rounded(experiments.with_group_means(x, ["k"], ["local_value"]).select("event_id", "k", "mean_local_value"), "mean_local_value")


_T = ", ".join(repr(experiments.t_quantile_975(i)) for i in range(1, 200))


@query(f"""{_MEANS}, g as (select dataset, n_nodes, count(*) as n, avg(time_sec_training) as m, stddev_samp(time_sec_training) as s from r group by 1, 2)
select dataset, n_nodes, round(m, 6) as time_sec_training_mean, round(s, 6) as time_sec_training_std, round(case when n > 1 then s / sqrt(n) * ([{_T}])[n - 1] end, 6) as time_sec_training_ci95 from g""")
def mean_std_ci95_by_seed(spark, d):
    out = experiments.aggregate_by_seeds(_runs(spark, d), ["dataset", "n_nodes"], ["time_sec_training"])
    return _rounded(out, *out.columns[2:])


#: Parts of the texts that jobs leave, filled from orders; every third job leaves something else.
_ORDER = ("o_orderkey % 3", "o_custkey % 24", "o_orderkey % 60", "o_totalprice")
_LOG = "Job Wall-clock time: 2-%02d:%02d:04\nEnergy Consumed: 444240 Joule / %.2f Watthours\nAverage node power draw: 350.5 Watt\nMemory Utilized: %d TB"
_OUTPUT = "n_samples=%d n_features=10 n_trees=100\nTime for training is %.2f s.\nAccuracy is 0.93.\nEnergy Consumed: 5000 Joule\nJob ID: %d\nState: COMPLETED"

@query("""select o_orderkey, case when o_orderkey % 3 > 0 then (2 * 86400 + o_custkey % 24 * 3600 + o_orderkey % 60 * 60 + 4)::double end as wall_clock_sec, case when o_orderkey % 3 > 0 then round(o_totalprice, 2) end as energy_wh,
case when o_orderkey % 3 > 0 then 350.5::double end as power_w, case when o_orderkey % 3 > 0 then (o_custkey % 9 + 1) * 1024.0::double end as memory_gb from orders""")
def parse_job_log(spark, d):
    """A scheduler's log for each order, read back into its fields."""
    log = F.format_string(_LOG, F.col("o_custkey") % 24, F.col("o_orderkey") % 60, F.col("o_totalprice").cast("double"), F.col("o_custkey") % 9 + 1)
    logs = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, log).otherwise("nothing").alias("value"))
    return _rounded(experiments.parse_run_log(logs).drop("value"), "energy_wh", digits=2)


@query("""select o_orderkey, case when o_orderkey % 3 > 0 then 'COMPLETED' else 'OUT OF MEMORY' end as state, case when o_orderkey % 3 > 0 then o_custkey::bigint end as n_samples, case when o_orderkey % 3 > 0 then round(o_totalprice, 2) end as training_sec,
case when o_orderkey % 3 > 0 then 0.93::double end as accuracy, case when o_orderkey % 3 > 0 then o_orderkey::bigint end as job_id, case when o_orderkey % 3 > 0 then o_custkey::bigint * 10 end as data_entries from orders""")
def parse_job_output(spark, d):
    """A job's output for each order, read back into its fields."""
    text = F.format_string(_OUTPUT, F.col("o_custkey"), F.col("o_totalprice").cast("double"), F.col("o_orderkey"))
    outputs = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, text).otherwise("State: OUT_OF_MEMORY").alias("value"))
    return _rounded(experiments.parse_job_output(outputs).select("o_orderkey", "state", "n_samples", "training_sec", "accuracy", "job_id", "data_entries"), "training_sec", digits=2)


@query("""select o_orderkey, case o_orderkey % 3 when 0 then (o_custkey % 5 * 86400 + 3 * 3600 + o_orderkey % 60 * 60 + 4)::double when 1 then (o_custkey % 24 * 3600 + 601)::double end as seconds from orders""")
def wallclock_to_seconds(spark, d):
    long, short = F.format_string("%d-03:%02d:04", F.col("o_custkey") % 5, F.col("o_orderkey") % 60), F.format_string("%02d:10:01", F.col("o_custkey") % 24)
    text = F.when(F.col("o_orderkey") % 3 == 0, long).when(F.col("o_orderkey") % 3 == 1, short).otherwise("x")
    return _t(spark, d, "orders").select("o_orderkey", scalars.time_to_seconds(text).alias("seconds"))


@query("""select p_partkey, round(case p_size % 3 when 0 then p_retailprice * 1024 when 1 then p_retailprice / 1024 else p_retailprice end, 6) as gb from part""")
def memory_to_gb(spark, d):
    unit = F.element_at(F.array(F.lit("TB"), F.lit("MB"), F.lit("GB")), F.col("p_size") % 3 + 1)
    return _t(spark, d, "part").select("p_partkey", F.round(scalars.to_gigabytes(F.col("p_retailprice"), unit), 6).alias("gb"))


@query("select p_partkey, lpad(unnest(range(p_partkey % 9000, p_partkey % 9000 + p_size % 4 + 1))::varchar, 4, '0') as node from part union all select p_partkey, lpad(p_size::varchar, 4, '0') from part")
def expand_node_range(spark, d):
    at = F.col("p_partkey") % 9000
    ranges = F.format_string("node[%04d-%04d,%04d]", at, at + F.col("p_size") % 4, F.col("p_size"))
    return _t(spark, d, "part").select("p_partkey", F.explode(scalars.nodes_of(ranges)).alias("node"))


@query("select o_orderkey, (o_custkey % 64)::int as n_tasks, (o_orderkey % 7)::int as model_seed, unnest(['new', 'old']) as layout from orders")
def parse_run_path(spark, d):
    nodes, seed = F.col("o_custkey") % 64, F.col("o_orderkey") % 7
    orders = _t(spark, d, "orders")
    new = experiments.parse_run_path(orders.select("o_orderkey", F.format_string("/x/n_nodes_%d/0_%d_%d/slurm.out", nodes, seed, F.col("o_orderkey")).alias("path")))
    old = experiments.parse_run_path(orders.select("o_orderkey", F.format_string("/x/nodes_%d/%d_0_%d/slurm.out", nodes, F.col("o_orderkey"), seed).alias("path")), updated=False)
    return new.withColumn("layout", F.lit("new")).unionByName(old.withColumn("layout", F.lit("old"))).drop("path")


@query("""
with x as (select p_partkey, p_retailprice as serial, p_size as nodes from part)
select p_partkey, round(serial * ((1 - 0.25) / nodes + 0.25) + 1e-7, 4) as strong, round(serial * (1 + 0.01 * nodes), 6) as weak,
floor(round(least(2 * serial * ((1 - 0.25) / nodes + 0.25), 4320.0), 6) + 0.5)::bigint as limit_min from x""")
def runtime_estimate(spark, d):
    serial, nodes = F.col("p_retailprice"), F.col("p_size")
    strong = scalars.strong_runtime(serial, nodes)
    return _t(spark, d, "part").select("p_partkey", F.round(strong + 1e-7, 4).alias("strong"), F.round(scalars.weak_runtime(serial, nodes), 6).alias("weak"), planner.time_limit(strong).alias("limit_min"))


@query("""
with b(n_trees, minutes) as (values (10, 5.0), (320, 15.0), (640, 30.0), (1280, 60.0), (2560, 120.0), (5120, 240.0)), w as (select distinct p_size * 100 as wanted from part),
r as (select wanted, n_trees, minutes, row_number() over (partition by wanted order by abs(n_trees / wanted - 1), n_trees) as k from w cross join b)
select wanted, n_trees, round(minutes * wanted / n_trees, 6)::double as minutes from r where k = 1""")
def closest_baseline(spark, d):
    wanted = _t(spark, d, "part").select((F.col("p_size") * 100).alias("wanted")).distinct()
    return _rounded(planner.closest_baseline(wanted, planner.HIGGS_MINUTES), "minutes")


@query("select o_orderkey, round((o_orderkey + 2) * log2(o_orderkey + 2) * sqrt(o_custkey) * 10, 2) as size from orders")
def problem_size(spark, d):
    size = scalars.problem_size(F.col("o_orderkey") + 2, F.col("o_custkey"), F.lit(10))
    return _t(spark, d, "orders").select("o_orderkey", F.round(size, 2).alias("size"))


@query("select case when row_number() over (order by o_orderkey) > count(*) over () - 500 then 'test' else 'train' end as split, o_orderkey from orders")
def original_test_split(spark, d):
    return partition.tail_split(_t(spark, d, "orders").select("o_orderkey"), 500).select("split", "o_orderkey")


@query("select p_partkey, (1600 // p_size)::bigint as strong_local, (1600 // p_size * p_size)::bigint as strong_global, 800::bigint as weak_local, (800 * p_size)::bigint as weak_global from part")
def trees_by_scaling(spark, d):
    strong, weak = (scalars.scaled_trees(F.lit(n), F.col("p_size"), kind) for n, kind in ((1600, "strong"), (800, "weak")))
    names = ("strong_local", "strong_global", "weak_local", "weak_global")
    return _t(spark, d, "part").select("p_partkey", *[c.cast("long").alias(n) for n, c in zip(names, (*strong, *weak), strict=True)])


@query("select o_orderkey, (o_orderkey % 8)::int as rank, (17 + o_orderkey % 8)::bigint as seed from orders")
def rank_seeds_by_addition(spark, d):
    """The seed of each order's rank."""
    seeds = spark.createDataFrame(list(enumerate(weights.rank_seeds(17, 8, add_rank=True))), "rank int, seed long")  # eight rows
    return _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("int").alias("rank")).join(F.broadcast(seeds), "rank")


@query("select p_partkey, case when p_size * 100000 <= 239400 then 'standard' when p_size * 100000 <= 497500 then 'high' when p_size * 100000 <= 4120112 then 'large' end as node_class from part")
def memory_node_class(spark, d):
    return _t(spark, d, "part").select("p_partkey", planner.node_class(F.col("p_size") * 100000).alias("node_class"))


@query("select p_partkey, round(p_retailprice / ((p_size * 60) / 3600.0) / 4, 6) as power_w from part")
def power_per_task(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.round(scalars.mean_power(F.col("p_retailprice"), F.col("p_size") * 60, F.lit(4)), 6).alias("power_w"))


@query("select p_partkey, case when p_size % 10 > 0 then (p_size % 10)::varchar || 'E+0' || (p_partkey % 7)::varchar end as text from part")
def scientific_format(spark, d):
    n = (F.col("p_size") % 10) * F.pow(F.lit(10), F.col("p_partkey") % 7)
    return _t(spark, d, "part").select("p_partkey", scalars.scientific(F.when(F.col("p_size") % 10 > 0, n.cast("long"))).alias("text"))


@query("select event_type, round(sum(value), 2) as energy from events group by 1")
def energy_total(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("energy"))


@query("select 'run' || p_partkey as dir from part where p_size % 3 = 0 and (p_size % 2 = 0) <> (p_size % 5 = 0)")
def complete_run_dirs(spark, d):
    """A run is complete with one log and a result file; each part's folder holds those that divide its size."""
    part = _t(spark, d, "part").select(F.concat(F.lit("run"), "p_partkey").alias("dir"), "p_size")
    names = {2: "slurm.out", 3: "x_results.csv", 5: "2.out"}
    files = F.explode(F.filter(F.array(*[F.when(F.col("p_size") % k == 0, F.lit(f)) for k, f in names.items()]), lambda x: x.isNotNull()))
    return experiments.complete_runs(part.select("dir", files.alias("file")).select("dir", F.concat_ws("/", "dir", "file").alias("path")))


@query("select o_custkey, min(cast(o_orderkey as varchar)) as job_id, arg_min(o_totalprice, cast(o_orderkey as varchar)) as price from orders group by 1")
def checkpoint_smallest_job(spark, d):
    runs = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_totalprice").alias("price"))
    return experiments.smallest_job(runs, ["o_custkey"])


@query("""with w as (select o_orderpriority as dataset, o_custkey % 3 as model_seed, o_orderkey % 8 + 1 as n_nodes, o_totalprice / 100 as t from orders)
select dataset, n_nodes, round(avg(t), 6) as time_sec_training_mean from w group by 1, 2""")
def time_mean_over_ranks(spark, d):
    runs = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset"), (F.col("o_orderkey") % 8 + 1).alias("n_nodes"), (F.col("o_totalprice") / 100).alias("time_sec_training"))
    means = runner.mean_over_ranks(runs, ["dataset", "n_nodes"]).withColumnRenamed("time_sec_training", "time_sec_training_mean")
    return _rounded(means, "time_sec_training_mean")


@query("select (row_number() over (order by o_orderpriority) - 1)::int as label, count(*) as cnt from orders group by o_orderpriority")
def synthetic_class_counts(spark, d):
    """A synthetic twin of orders has its size and its class counts, which are exact without label noise."""
    counts = [r["cnt"] for r in stats.class_frequency(_t(spark, d, "orders"), "o_orderpriority").orderBy("class").collect()]  # five classes
    made = datasets.generate(spark, sum(counts), 12, len(counts), counts, seed=2, flip_y=0.0)
    return made.groupBy("label").agg(F.count("*").alias("cnt"))


@query("select count(distinct o_orderpriority) as n_classes from orders")
def n_classes(spark, d):
    return _t(spark, d, "orders").agg(F.countDistinct("o_orderpriority").alias("n_classes"))


@query(_assigned("orders", "o_orderpriority", "o_orderkey", _values(_PRIORITIES, _SKELLAM["2.0"])) + """, k4 as (select rank, class_ as class, count(*) as cnt from a group by 1, 2)
select r.rank, k.class, coalesce(c.cnt, 0)::bigint as cnt from (select unnest([0, 1, 2, 3])::int as rank) r cross join (select distinct o_orderpriority as class from orders) k left join k4 c on c.rank = r.rank and c.class = k.class""")
def non_iid_class_frequency(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return stats.class_frequency_by_rank(partition.skellam_partition(orders, "o_orderpriority", "o_orderkey", 4, 2.0, classes=_PRIORITIES), "o_orderpriority", "rank", 4)


@query("select r_name as workload, n::int as n_nodes, s::int as model_seed from region cross join (select unnest([2, 4, 8]) as n) cross join (select distinct n_regionkey as s from nation)")
def job_grid(spark, d):
    """Jobs for every region as a workload, three node counts and the seeds that nations name."""
    few = lambda table, column: sorted(r[0] for r in _t(spark, d, table).select(column).distinct().collect())  # noqa: E731  five values each
    return planner.job_grid(spark, few("region", "r_name"), [2, 4, 8], few("nation", "n_regionkey"))


_BASELINES = ", ".join(f"('{w}', {n}, {m}::double)" for w, by in planner.SERIAL_MINUTES.items() for n, m in by.items())


@query(f"""
with b(workload, n_trees, minutes) as (values {_BASELINES}), w as (select distinct b.workload, p_size * 50 as wanted from part, b),
r as (select w.workload, wanted, n_trees, minutes, row_number() over (partition by w.workload, wanted order by abs(n_trees / wanted - 1), n_trees) as k from w join b on b.workload = w.workload)
select workload, wanted, n_trees::bigint as n_trees, round(minutes * wanted / n_trees, 6)::double as minutes from r where k = 1""")
def closest_baselines_by_workload(spark, d):
    workloads = spark.createDataFrame([(w,) for w in planner.SERIAL_MINUTES], "workload string")
    wanted = _t(spark, d, "part").select((F.col("p_size") * 50).alias("wanted")).distinct().crossJoin(workloads)  # seven workloads
    return _rounded(planner.closest_baselines(wanted), "minutes")


@query("select o_orderkey, coalesce(case o_orderstatus when 'F' then 'green' when 'O' then 'blue' end, 'grey') as colour from orders")
def map_by_dictionary(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", scalars.mapped(F.col("o_orderstatus"), {"F": "green", "O": "blue"}, "grey").alias("colour"))


@query("select distinct o_orderstatus as n_samples, o_orderpriority as n_features from orders")
def distinct_sizes(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderstatus").alias("n_samples"), F.col("o_orderpriority").alias("n_features")).dropDuplicates(["n_samples", "n_features"])


@query("select o_orderkey, case when o_orderstatus = 'F' then 1.5::double else o_totalprice end as o_totalprice, case when o_orderstatus = 'F' then 'x' end as note from orders")
def conditional_update(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return experiments.set_where(orders, F.col("o_orderstatus") == "F", {"o_totalprice": F.lit(1.5), "note": F.lit("x")}).drop("o_orderstatus")


@query("select o_orderkey, o_orderpriority as dataset, o_custkey as comm_size from orders order by o_orderpriority, o_custkey desc, o_orderkey limit 25")
def sorted_results(spark, d):
    runs = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("comm_size"))
    return experiments.in_order(runs, "dataset", "-comm_size", "model_seed", "o_orderkey").limit(25)


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 8 = 0 and o_orderstatus = 'F'")
def completed_global_rows(spark, d):
    return _t(spark, d, "orders").where((F.col("o_orderkey") % 8 == 0) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query(f"""{_MEANS}, g as (select dataset, n_nodes, count(*) as n, avg(time_sec_training) as m, stddev_samp(time_sec_training) as s from r group by 1, 2), h as (select *, case when n > 1 then s / sqrt(n) * ([{_T}])[n - 1] end as half from g)
select dataset, n_nodes, round(m, 6) as mean, round(m - half, 6) as low, round(m + half, 6) as high from h""")
def plot_lines(spark, d):
    return _rounded(experiments.plot_lines(_runs(spark, d), "n_nodes", "time_sec_training", ["dataset"]), "mean", "low", "high")


@query("select p_size as n_samples, (p_partkey % 3) as n_features, max(p_partkey) as n_trees, arg_max(p_retailprice, p_partkey) as accuracy from part where p_retailprice is not null group by 1, 2")
def plot_capacity(spark, d):
    runs = _t(spark, d, "part").select(F.col("p_size").alias("n_samples"), (F.col("p_partkey") % 3).alias("n_features"), F.col("p_partkey").alias("n_trees"), F.col("p_retailprice").alias("accuracy"))
    return experiments.plot_capacity(runs, "accuracy")


def _folder(spark) -> str:
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@query("""with c as (select (o_orderkey % 3)::int as rank, (o_custkey % 4)::int as class, count(*) as cnt from orders group by 1, 2)
select 'local' as scope, rank, class, cnt from c union all select 'global', null, class, sum(cnt)::bigint from c group by class
union all select 'local', 3, class, 0 from (select distinct class from c)""")
def class_frequency_files(spark, d):
    """Class counts by rank and of all ranks, dense, written as CSV and read again; rank 3 is empty."""
    path = _folder(spark)
    orders = _t(spark, d, "orders").select((F.col("o_custkey") % 4).alias("y"), (F.col("o_orderkey") % 3).alias("r"))
    experiments.write_class_frequencies(stats.class_frequency_dense(orders, "y", "r", 4, 4), path)
    return spark.read.schema("class int, cnt long, scope string, rank int").csv(path, header=True).select("scope", "rank", "class", "cnt")


@query(f"with c as ({_RULE}) select label, coalesce(sum(cnt) filter (prediction = 0), 0)::bigint as p0, coalesce(sum(cnt) filter (prediction = 4), 0)::bigint as p4 from c group by 1")
def confusion_files(spark, d):
    """A confusion matrix written as CSV and read again."""
    path = _folder(spark)
    whole = _rule(spark, d).select(F.lit("global").alias("scope"), F.lit(None).cast("int").alias("rank"), "label", "prediction", "cnt")
    experiments.write_confusion(whole, path, 5)
    return spark.read.schema("label int, `0` long, `1` long, `2` long, `3` long, `4` long, scope string, rank int").csv(path, header=True).select("label", F.col("0").alias("p0"), F.col("4").alias("p4"))


@query("select o_orderpriority as dataset, count(*) as n_trees, round(avg(o_totalprice), 6) as accuracy_global_test, round(avg(o_totalprice), 6) as accuracy_local_test from orders group by 1")
def results_file(spark, d):
    """Serial results written as one CSV file and read again with the columns of parallel ones, typed."""
    path = _folder(spark)
    table = _t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("n_trees"), F.avg("o_totalprice").alias("accuracy_test"))
    written = experiments.write_results(table, f"{path}/serial_results")
    return _rounded(experiments.read_results(spark, written).drop("result_filename"), "accuracy_global_test", "accuracy_local_test")


_RUN_LOG = "Job Wall-clock time: 00:10:00\nEnergy Consumed: 1 Joule / {wh} Watthours\nAverage node power draw: 350.5 Watt\nMemory Utilized: 512 MB"


@query("""with o as (select (1 << (o_orderkey % 3)::int)::int as n_nodes, (o_custkey % 2)::int as r, o_custkey as k, (o_orderstatus = 'F')::int::double as f from orders),
runs as (select n_nodes, count(*)::double as wh, sum(k)::double as t from o where n_nodes <> 2 group by 1), ranks as (select n_nodes, r, avg(f) as a from o group by 1, 2),
local as (select n_nodes, avg(a) as a from ranks group by 1)
select 'd' as dataset, n_nodes, 7::int as model_seed, 8::int as n_trees, 8.0::double / n_nodes as trees_per_node, t as time_sec_training, round(a, 9) as accuracy_mean_local_test,
600.0::double as wall_clock_sec, round(wh * 6 / n_nodes, 6) as exp_node_power_draw, round((select t from runs where n_nodes = 1) / t, 9) as speedup_training from runs join local using (n_nodes)""")
def experiment_folder_to_scaling_table(spark, d):
    """Run folders with a log and a result file each become one scaling table; a folder without a log is left out. Times, energies and accuracies are sums, counts and shares of the orders."""
    root = _folder(spark)
    orders = _t(spark, d, "orders").select(F.pow(F.lit(2), F.col("o_orderkey") % 3).cast("int").alias("n_nodes"), (F.col("o_custkey") % 2).cast("string").alias("comm_rank"), "o_custkey", (F.col("o_orderstatus") == "F").cast("double").alias("f"))
    numbers = [F.lit("d").alias("dataset"), F.lit(8).alias("n_trees")]
    local = orders.groupBy("n_nodes", "comm_rank").agg(F.avg("f").alias("accuracy_local_test")).withColumn("time_sec_training", F.lit(None).cast("double"))
    whole = orders.groupBy("n_nodes").agg(F.sum("o_custkey").cast("double").alias("time_sec_training"), F.count("*").alias("n"))
    rows = local.unionByName(whole.withColumn("comm_rank", F.lit("global")).drop("n"), allowMissingColumns=True).select("*", *numbers)
    for n_nodes, wh in whole.select("n_nodes", F.col("n").cast("double")).collect():  # three runs
        run = f"{root}/n_nodes_{n_nodes}/0_7_12345"
        experiments.write_results(rows.where(F.col("n_nodes") == n_nodes).drop("n_nodes"), f"{run}/x_results")
        if n_nodes != 2:
            of, context = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext
            out = of(run).getFileSystem(context._jsc.hadoopConfiguration()).create(of(f"{run}/slurm-1.out"))
            out.write(bytearray(_RUN_LOG.format(wh=wh).encode()))
            out.close()
    table = experiments.scaling_table(experiments.run_results(spark, root), "strong")
    columns = ["dataset", "n_nodes", "model_seed", "n_trees", "trees_per_node", "time_sec_training", "accuracy_mean_local_test", "wall_clock_sec", "exp_node_power_draw", "speedup_training"]
    places = {"accuracy_mean_local_test": 9, "exp_node_power_draw": 6, "speedup_training": 9}
    return table.select(*[F.col(c).cast("int").alias(c) if c in ("n_nodes", "model_seed", "n_trees") else F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in columns])


_FEATURES = [f"((l_orderkey * {j + 3} + l_partkey) % 97)::double" for j in range(54)]


#: Rows of a compressed CSV file.
_CSV_ROWS = 500_000


def _csv_of(spark, d, columns: list) -> str:
    """Lines written as the data sets are published, in gzip files; a file cannot be split, so each holds a bounded number of rows."""
    path = _folder(spark)
    _t(spark, d, "lineitem").select(*columns).write.option("maxRecordsPerFile", _CSV_ROWS).csv(path, compression="gzip")
    return path


@query(f"select (l_orderkey % 2)::int as label, count(*) as n, sum({_FEATURES[0]}) as first, sum({_FEATURES[17]}) as last from lineitem group by 1")
def susy_file(spark, d):
    feature = lambda j: ((F.col("l_orderkey") * (j + 3) + F.col("l_partkey")) % 97).cast("double").alias(f"f{j}")
    path = _csv_of(spark, d, [(F.col("l_orderkey") % 2).alias("y"), *[feature(j) for j in range(18)]])
    return datasets.get_dataset("susy", spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("features")[0].cast("double")).alias("first"), F.sum(F.element_at("features", -1).cast("double")).alias("last"))


@query(f"select (l_orderkey % 7)::int as label, count(*) as n, sum({_FEATURES[0]}) as first, sum({_FEATURES[53]}) as last from lineitem group by 1")
def cover_type_file(spark, d):
    """CoverType by name; its features are whole numbers, as in the published file."""
    feature = lambda j: ((F.col("l_orderkey") * (j + 3) + F.col("l_partkey")) % 97).alias(f"f{j}")
    path = _csv_of(spark, d, [*[feature(j) for j in range(54)], (F.col("l_orderkey") % 7 + 1).alias("y")])
    return datasets.get_dataset("cover_type", spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("features")[0].cast("double")).alias("first"), F.sum(F.element_at("features", -1).cast("double")).alias("last"))


@query(f"select (l_orderkey % 2)::int as label, count(*) as n, sum({_FEATURES[0]}) as first, sum({_FEATURES[20]}) as last, sum({_FEATURES[27]}) as derived from lineitem group by 1")
def higgs_file(spark, d):
    """HIGGS by name, without and with its derived features."""
    feature = lambda j: ((F.col("l_orderkey") * (j + 3) + F.col("l_partkey")) % 97).cast("double").alias(f"f{j}")
    path = _csv_of(spark, d, [(F.col("l_orderkey") % 2).alias("y"), *[feature(j) for j in range(28)]])
    last = F.sum(F.element_at("features", -1).cast("double"))
    low = datasets.get_dataset("higgs", spark, path, high_level=False).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("features")[0].cast("double")).alias("first"), last.alias("last"))
    return low.join(datasets.get_dataset("higgs", spark, path).groupBy("label").agg(last.alias("derived")), "label")


@query(f"""with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as place, count(*) over () as n from orders)
select split, label, count(*) as n, sum(f0) as first, sum(f27) as last from (select case when place >= n - 1000 then 'test' else 'train' end as split, (o_orderkey % 2)::int as label, (o_orderkey % 89)::double as f0, ((o_orderkey + 27) % 89)::double as f27 from p
union all select 'first', (o_orderkey % 2)::int, (o_orderkey % 89)::double, ((o_orderkey + 27) % 89)::double from p where place < 777) group by 1, 2""")
def higgs_published_split_files(spark, d):
    """HIGGS in several files: the last rows of all are the published test rows, and a subset is the first rows of all."""
    path, orders = _folder(spark), _t(spark, d, "orders")
    feature = lambda j: ((F.col("o_orderkey") + j) % 89).cast("double").alias(f"f{j}")
    orders.repartitionByRange(7, "o_orderkey").sortWithinPartitions("o_orderkey").select((F.col("o_orderkey") % 2).alias("y"), *[feature(j) for j in range(28)]).write.csv(path)
    split = datasets.read_higgs_original_split(spark, path, n_test=1000).select("split", "label", "features")
    subset = datasets.get_dataset("higgs", spark, path, subset=777).select(F.lit("first").alias("split"), "label", "features")
    of = lambda i: F.sum(F.element_at("features", i).cast("double"))
    return split.unionByName(subset).groupBy("split", "label").agg(F.count("*").alias("n"), of(1).alias("first"), of(-1).alias("last"))


_MATRICES = [[[1.0, 0.5, -0.25], [0.0, 2.0, 1.0], [-1.0, 0.75, 0.5]], [[0.5, 0.0, 1.0], [1.5, -1.0, 0.0], [0.25, 0.5, -2.0]]]
_CROSS = "case l_linenumber % 2 " + " ".join(f"when {c} then [{', '.join(' + '.join(f'({m[i][j]}::double) * x{i}' for i in range(3)) for j in range(3))}]" for c, m in enumerate(_MATRICES)) + " end"


@query(f"""with x as (select l_linenumber, l_quantity as x0, l_discount * 100 as x1, l_tax * 100 as x2 from lineitem), y as (select (l_linenumber % 2)::int as cluster, {_CROSS} as v from x)
select cluster, {', '.join(f'round(covar_pop(v[{i + 1}], v[{j + 1}]), 4) as cov{i}{j}' for i in range(3) for j in range(i, 3))} from y group by 1""")
def cluster_transform_covariance(spark, d):
    """The covariance within clusters after each one's linear transform, as the generator applies it."""
    vector = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    rows = _t(spark, d, "lineitem").select((F.col("l_linenumber") % 2).cast("int").alias("cluster"), vector.alias("v"))
    made = datasets.transform_clusters(rows, "cluster", "v", _MATRICES)
    return made.groupBy("cluster").agg(*[F.round(F.covar_pop(F.col("v")[i], F.col("v")[j]), 4).alias(f"cov{i}{j}") for i in range(3) for j in range(i, 3)])


_PEAKED = ", ".join(f"({i}, {float(w)!r}::double)" for i, w in enumerate(weights.skellam_class_weights(2.0, 5, 1)))

@query(f"""with w(label, w) as (values {_PEAKED}), n as (select count(*) as n from orders), e as (select label, n, w / sum(w) over () * n as exact from w cross join n),
q as (select label, floor(exact)::bigint as base, row_number() over (order by round(exact - floor(exact), 9) desc, label desc) as nth, n - sum(floor(exact)) over () as more from e)
select label::int as label, (base + case when nth <= more then 1 else 0 end)::bigint as cnt from q""")
def synthetic_skellam_counts(spark, d):
    """As many samples as there are orders, with Skellam class weights."""
    made = datasets.generate_skellam(spark, _t(spark, d, "orders").count(), 12, 5, 2.0, 1, seed=2, flip_y=0.0, n_clusters_per_class=2, n_repeated=2, hypercube=False, shift=1.0, scale=2.0)
    return made.groupBy("label").agg(F.count("*").alias("cnt"))


@query("""with n as (select count(*) // 12 * 3 as k from orders) select unnest([0, 1, 2])::int as rank, 'train' as split, k::int as cnt from n union all select null, 'test', k::int from n""")
def generate_and_distribute(spark, d):
    """A shared test set is split off before the train rows are partitioned; a dozen samples for each dozen orders."""
    made = datasets.generate_and_distribute(spark, _t(spark, d, "orders").count() // 12 * 12, 12, 3, 3, seed=1, flip_y=0.0, stratified=True)
    return made.groupBy("rank", "split").agg(F.count("*").cast("int").alias("cnt"))


@query("""with j as (select min(o_orderkey::varchar) as job, substr(md5(o_orderstatus), 1, 8) as uid from orders group by o_orderstatus)
select uid, job || '_0_1_05_20' as folder from j order by job limit 1""")
def checkpoint_lookup(spark, d):
    """A run for each order status, its job the smallest order key as a string: the folder of the smallest job id, and the run's uid from its results file."""
    base = _folder(spark)
    jobs = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.min(F.col("o_orderkey").cast("string")).alias("job"), F.substring(F.md5("o_orderstatus"), 1, 8).alias("uid"))
    for _, job, uid in jobs.collect():  # a row a status
        run = f"{base}/breaking_iid/n4_m2/nodes_16/{job}_0_1_05_20"
        experiments.write_results(spark.range(1), f"{run}/2026-01-02--03-04-05-x-{uid}_results")
        forest.save(_stumps(spark), run, uid)
    folder, uid = experiments.find_checkpoint(spark, base, 4, 2, 0.5, "2.0", 0, 1)
    return spark.createDataFrame([(uid, folder.rsplit("/", 1)[-1])], "uid string, folder string")
