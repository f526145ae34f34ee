"""Queries over mergeable states and the models that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression, states
from ..sources.shared import cut, fresh
from .base import query, t
from .q_graph import R

_XS = ["l_quantity", "l_discount"]


def _gram(spark, d):
    """The only pass over the rows: Gram sums of price on quantity and discount by supplier."""
    return cut(states.gram(t(spark, d, "lineitem"), "l_extendedprice", _XS, ["l_suppkey"]), "gram")


S_Z = "z AS (SELECT l_suppkey AS g, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_extendedprice::DOUBLE AS y FROM lineitem)"
#: Slopes of a model of two regressors from sums of products of deviations.
S_B = "aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2"
S_WITHIN = f"""{S_Z}, c AS (SELECT g, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b, y - avg(y) OVER w AS y FROM z WINDOW w AS (PARTITION BY g)),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*)::DOUBLE AS n, count(DISTINCT g)::DOUBLE AS k FROM c), m AS (SELECT *, {S_B} FROM s)"""
S_LEFT = f"""{S_Z}, o AS (SELECT g, count(*)::DOUBLE AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM z GROUP BY g),
q AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(y) AS y, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay, sum(by_) AS by_ FROM o),
r AS (SELECT g, q.n - o.n AS n, q.a - o.a AS a, q.b - o.b AS b, q.y - o.y AS y, q.aa - o.aa AS aa, q.ab - o.ab AS ab, q.bb - o.bb AS bb, q.ay - o.ay AS ay, q.by_ - o.by_ AS by_ FROM o, q),
e AS (SELECT g, n, a / n AS ma, b / n AS mb, y / n AS my, aa - a * a / n AS aa, ab - a * b / n AS ab, bb - b * b / n AS bb, ay - a * y / n AS ay, by_ - b * y / n AS by_ FROM r), f AS (SELECT g, ma, mb, my, {S_B} FROM e)"""


@query(f"""WITH {S_WITHIN}, u AS (SELECT g, sum(c.a * (c.y - b1 * c.a - b2 * c.b)) AS u1, sum(c.b * (c.y - b1 * c.a - b2 * c.b)) AS u2 FROM c, m GROUP BY g), w AS (SELECT sum(u1 * u1) AS w11, sum(u1 * u2) AS w12, sum(u2 * u2) AS w22 FROM u),
i AS (SELECT *, bb / det AS i11, -ab / det AS i12, aa / det AS i22, k / (k - 1) * (n - 1) / (n - 2 - k) AS scale, 1 - (yy - b1 * ay - b2 * by_) / yy AS r2 FROM m, w),
x AS (SELECT 'l_quantity' AS term, b1 AS coef, sqrt(scale * (i11 * i11 * w11 + 2 * i11 * i12 * w12 + i12 * i12 * w22)) AS se, n, k, r2 FROM i UNION ALL SELECT 'l_discount', b2, sqrt(scale * (i12 * i12 * w11 + 2 * i12 * i22 * w12 + i22 * i22 * w22)), n, k, r2 FROM i)
SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 4) AS stat, n::BIGINT AS n, k::BIGINT AS groups, round(r2, 8) AS r2 FROM x""")
def clustered_regression(spark, d):
    """Two regressors, an effect for each supplier, errors robust inside suppliers."""
    fitted = regression.fit(_gram(spark, d), _XS, fixed=["l_suppkey"], cluster=["l_suppkey"])
    return fitted.select("term", R("coef", 4), R("se", 4), R("stat", 4), "n", "groups", R("r2", 8))


@query(f"""WITH {S_LEFT} SELECT z.g AS l_suppkey, count(*)::BIGINT AS n, round(1 - sum(pow(z.y - my - b1 * (z.a - ma) - b2 * (z.b - mb), 2)) / (sum(z.y * z.y) - sum(z.y) * sum(z.y) / count(*)), 6) AS r2_out FROM z JOIN f ON z.g = f.g GROUP BY 1""")
def left_out_suppliers(spark, d):
    """How a model of all other suppliers predicts each one."""
    return regression.left_out(_gram(spark, d), _XS, "l_suppkey").select("l_suppkey", "n", R("r2_out"))


@query(f"""WITH {S_LEFT}, v AS (SELECT g, 'l_quantity' AS term, sign(b1) AS s FROM f UNION ALL SELECT g, 'l_discount', sign(b2) FROM f), h AS (SELECT term, arg_min(s, g) AS first FROM v GROUP BY 1) SELECT term, avg((s = first)::INTEGER) AS same_sign, count(*)::BIGINT AS refits FROM v JOIN h USING (term) GROUP BY 1""")
def sign_stability(spark, d):
    """How often a slope keeps its sign when a supplier is left out."""
    return regression.sign_stability(regression.refits(_gram(spark, d), _XS, "l_suppkey"), "l_suppkey")


@query(f"""WITH {S_WITHIN}, p AS (SELECT regr_syy(y, a) AS syy, regr_syy(y, a) * (1 - regr_r2(y, a)) AS r1, covar_pop(a, a) * count(*) AS aa, covar_pop(a, b) * count(*) AS ab, covar_pop(b, b) * count(*) AS bb, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_ FROM z),
p2 AS (SELECT *, {S_B} FROM p), l AS (SELECT p2.syy, r1, p2.syy - p2.b1 * p2.ay - p2.b2 * p2.by_ AS r2, m.yy - m.b1 * m.ay - m.b2 * m.by_ AS r3, n, k FROM p2, m)
SELECT 'quantity' AS model, 2 AS params, round(1 - r1 / syy, 8) AS r2, NULL::DOUBLE AS f FROM l UNION ALL SELECT 'discount', 3, round(1 - r2 / syy, 8), round((r1 - r2) / (r2 / (n - 3)), 4) FROM l UNION ALL SELECT 'supplier', (2 + k)::INTEGER, round(1 - r3 / syy, 8), round((r2 - r3) / (k - 1) / (r3 / (n - 2 - k)), 4) FROM l""")
def nested_models(spark, d):
    """One state, three models: quantity, discount with it, an effect for each supplier with both."""
    models = {"quantity": (["l_quantity"], []), "discount": (_XS, []), "supplier": (_XS, ["l_suppkey"])}
    return regression.compare(_gram(spark, d), _XS, models).select("model", "params", R("r2", 8), R("f", 4))


def _chunks(spark, d, make):
    """Event states written chunk by chunk, a weekday a chunk, the last one twice."""
    path = fresh(spark, "chunks")
    day = t(spark, d, "events").withColumn("day", F.dayofweek("ts"))
    for k in [*range(1, 8), 7]:
        states.append(make(day.where(F.col("day") == k)), path, str(k))
    return states.read(spark, path)


@query("SELECT event_type, count(value)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd FROM events GROUP BY 1")
def merged_moments(spark, d):
    """Moments of seven chunks, merged, are those of one pass; a chunk that is written again counts once."""
    held = states.merge(_chunks(spark, d, lambda e: states.moments(e, ["event_type"], ["value"])), ["event_type"])
    return states.describe(held, ["value"]).select("event_type", F.col("n_value").alias("n"), F.round("s_value", 4).alias("total"), F.round("mean_value", 8).alias("mean"), F.round("sd_value", 8).alias("sd"))


@query("SELECT event_type, count(DISTINCT user_id)::BIGINT AS users, true AS near FROM events GROUP BY 1")
def merged_sketches(spark, d):
    """Distinct users by merged sketches lie within three percent of the exact number."""
    held = states.merge(_chunks(spark, d, lambda e: states.sketches(e, ["event_type"], ["user_id"])), ["event_type"])
    exact = t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("distinct_user_id") - F.col("users")) <= 0.03 * F.col("users") + 1
    return states.estimates(held, ["user_id"]).join(exact, "event_type").select("event_type", "users", near.alias("near"))


@query("WITH v AS (SELECT event_type, value::DOUBLE AS value FROM events WHERE value IS NOT NULL), a AS (SELECT count(*) AS n, sum(value) AS s FROM v) SELECT event_type, (any_value(a.n) - count(*))::BIGINT AS n, round((any_value(a.s) - sum(value)) / (any_value(a.n) - count(*)), 8) AS mean FROM v, a GROUP BY 1")
def moments_without(spark, d):
    """The mean of all events of other types, from sums of chosen groups."""
    rest = states.without(cut(states.moments(t(spark, d, "events"), ["event_type"], ["value"]), "moments"), [], "event_type")
    return states.describe(rest, ["value"]).select("event_type", F.col("n_value").alias("n"), F.round("mean_value", 8).alias("mean"))
