"""Validation queries over events; `test` is event_type, the unit and group follow from the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import knowledge as K
from tessera.operators import validation as V
from tessera.plans.registry import query, table

UNIT = "CASE WHEN event_type = 'signup' THEN 'v' WHEN event_id % 17 = 0 THEN 'x' ELSE 'u' END"
SEX = "CASE WHEN user_id % 3 = 0 THEN 'male' WHEN user_id % 3 = 1 THEN 'female' END"
#: Values as read by a poor scanner: now and then a decimal point is lost or moved.
RAW = "CASE WHEN event_id % 11 = 0 THEN value * 10 WHEN event_id % 13 = 0 THEN value / 10 ELSE value END"


def readings(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("test"), F.expr(RAW).alias("value"), F.expr(UNIT).alias("unit"), F.expr(SEX).alias("sex"), "ts")


R = f"""r AS (SELECT event_id, user_id, event_type AS test, {RAW} AS value, {UNIT} AS unit, {SEX} AS sex, ts FROM events),
    pl(test, min_ok, max_ok, unit_ok) AS (VALUES {K.values_sql(K.PLAUSIBLE)}), cr(test, crit_low, crit_high) AS (VALUES {K.values_sql(K.CRITICAL)}),
    rf(test, grp, low, high) AS (VALUES {K.values_sql(K.REFERENCE)}),
    x AS (SELECT r.*, min_ok, max_ok, unit_ok, crit_low, crit_high, coalesce(own.low, ad.low, ma.low) AS ref_low, coalesce(own.high, ad.high, ma.high) AS ref_high
          FROM r LEFT JOIN pl USING (test) LEFT JOIN cr USING (test)
          LEFT JOIN rf own ON own.test = r.test AND own.grp = coalesce(r.sex, 'adult') LEFT JOIN rf ad ON ad.test = r.test AND ad.grp = 'adult' LEFT JOIN rf ma ON ma.test = r.test AND ma.grp = 'male')"""
CRIT = "coalesce(value < coalesce(crit_low, -1e308) OR value > coalesce(crit_high, 1e308), false) AND (crit_low IS NOT NULL OR crit_high IS NOT NULL)"
FLAG = """CASE WHEN ref_low IS NULL THEN NULL WHEN value < ref_low THEN CASE WHEN value < crit_low THEN 'CRITICAL LOW' ELSE 'L' END
          WHEN value > ref_high THEN CASE WHEN value > crit_high THEN 'CRITICAL HIGH' ELSE 'H' END ELSE 'N' END"""
FIX = "CASE WHEN value > max_ok AND value / 10 BETWEEN min_ok AND max_ok THEN value / 10 WHEN value > max_ok AND value / 100 BETWEEN min_ok AND max_ok THEN value / 100 WHEN value < min_ok AND value * 10 BETWEEN min_ok AND max_ok THEN value * 10 END"
IN = "(min_ok IS NULL OR (value BETWEEN min_ok AND max_ok))"


@query("plausibility_flags", f"""WITH {R} SELECT event_id, CASE WHEN min_ok IS NULL THEN true ELSE value BETWEEN min_ok AND max_ok AND unit = unit_ok END AS plausible,
    CASE WHEN min_ok IS NULL THEN NULL WHEN unit <> unit_ok THEN 'unit ' || unit || ' is not ' || unit_ok WHEN value < min_ok THEN 'below range' WHEN value > max_ok THEN 'above range' END AS reason FROM x""")
def plausibility_flags(spark, sf):
    r = V.with_ranges(readings(spark, sf), K.plausible(spark))
    return r.select("event_id", V.is_plausible(F.col("value"), F.col("unit")).alias("plausible"), V.implausible_reason(F.col("value"), F.col("unit")).alias("reason"))


@query("plausibility_by_value_only", f"WITH {R} SELECT event_id, min_ok, max_ok, {IN} AS plausible FROM x")
def plausibility_by_value_only(spark, sf):
    r = V.with_ranges(readings(spark, sf), K.plausible(spark))
    return r.select("event_id", "min_ok", "max_ok", V.is_plausible(F.col("value"), F.col("unit"), check_unit=False).alias("plausible"))


@query("decimal_correction", f"WITH {R} SELECT event_id, round({FIX}, 6) AS corrected FROM x WHERE {FIX} IS NOT NULL")
def decimal_correction(spark, sf):
    r = V.with_ranges(readings(spark, sf), K.plausible(spark)).withColumn("c", V.decimal_correction(F.col("value")))
    return r.where("c is not null").select("event_id", F.round("c", 6).alias("corrected"))


@query("reference_flags", f"WITH {R} SELECT event_id, ref_low, ref_high, {FLAG} AS flag FROM x")
def reference_flags(spark, sf):
    r = V.with_critical(V.with_reference(readings(spark, sf), K.reference(spark)), K.critical(spark))
    return r.select("event_id", "ref_low", "ref_high", V.reference_flag(F.col("value")).alias("flag"))


@query("critical_flags", f"WITH {R} SELECT event_id, test, round(value, 6) AS value FROM x WHERE {CRIT}")
def critical_flags(spark, sf):
    r = V.with_critical(readings(spark, sf), K.critical(spark))
    return r.where(V.is_critical(F.col("value"))).select("event_id", "test", F.round("value", 6).alias("value"))


@query("unit_check", f"WITH {R} SELECT test, unit, count(*) AS n, count_if(coalesce(unit = unit_ok, true)) AS n_ok FROM x GROUP BY 1, 2")
def unit_check(spark, sf):
    r = V.with_ranges(readings(spark, sf), K.plausible(spark))
    return r.groupBy("test", "unit").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("unit") == F.col("unit_ok"), F.lit(True))).alias("n_ok"))


@query("rule_validate", f"""WITH {R}, y AS (SELECT *, {IN} AND coalesce(unit = unit_ok, true) AS ok, {FLAG} AS f, {CRIT} AS c, {FIX} AS fix FROM x)
    SELECT event_id, ok AS valid, CASE WHEN NOT ok THEN NULL WHEN c AND NOT coalesce(f LIKE 'CRITICAL%', false) THEN 'CRITICAL' ELSE f END AS flag,
           CASE WHEN ok THEN concat_ws(',', CASE WHEN f LIKE 'CRITICAL%' THEN 'critical flag' END, CASE WHEN c THEN 'critical value' END)
                ELSE concat_ws(',', 'implausible', CASE WHEN fix IS NOT NULL THEN 'correction' END) END AS warnings FROM y""")
def rule_validate(spark, sf):
    r = V.rule_validate(readings(spark, sf), K.plausible(spark), K.reference(spark), K.critical(spark))
    return r.select("event_id", "valid", "flag", F.array_join("warnings", ",").alias("warnings"))


WIDE = """w AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS "view",
    max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM events GROUP BY 1, 2)"""


def days_wide(spark, sf):
    return V.wide(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", "value", ["click", "view", "purchase"])


@query("cross_field", f'WITH {WIDE} SELECT user_id, day, round(abs(("view" - click * 1.5) / (click * 1.5)), 6) AS off FROM w WHERE click <> 0 AND abs(("view" - click * 1.5) / (click * 1.5)) > 0.15')
def cross_field(spark, sf):
    return V.cross_field(days_wide(spark, sf), "click", "view", 1.5).select("user_id", "day", F.round("off", 6).alias("off"))


@query("value_gap", f'WITH {WIDE} SELECT user_id, day, round("view" - purchase, 6) AS gap FROM w WHERE "view" <> 0 AND purchase <> 0 AND ("view" - purchase < -25 OR "view" - purchase > 45)')
def value_gap(spark, sf):
    return V.gap_outside(days_wide(spark, sf), "view", "purchase", -25, 45).select("user_id", "day", F.round("gap", 6).alias("gap"))


@query("impossible_combinations", f"""WITH {WIDE} SELECT user_id, day, CASE WHEN click > 60 AND "view" BETWEEN 35 AND 65 AND purchase BETWEEN 35 AND 65 THEN 'contaminated' WHEN purchase > 90 THEN 'diluted'
    WHEN click < 20 AND "view" > 60 THEN 'clotted' END AS issue FROM w WHERE (click > 60 AND "view" BETWEEN 35 AND 65 AND purchase BETWEEN 35 AND 65) OR purchase > 90 OR (click < 20 AND "view" > 60)""")
def impossible_combinations(spark, sf):
    c, v, p = F.col("click"), F.col("view"), F.col("purchase")
    hit = V.first_hit(("contaminated", (c > 60) & v.between(35, 65) & p.between(35, 65)), ("diluted", p > 90), ("clotted", (c < 20) & (v > 60)))
    return days_wide(spark, sf).withColumn("issue", hit).where("issue is not null").select("user_id", "day", "issue")


VERDICTS = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 1 END AS rule_ok, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END AS other_ok,
    (doc_id % 100) / 100.0 AS confidence, doc_id % 3 = 0 AS implausible FROM labels"""


@query("conflict_resolution", f"""WITH v AS ({VERDICTS}) SELECT doc_id, CASE WHEN rule_ok IS NOT DISTINCT FROM other_ok THEN CASE WHEN coalesce(rule_ok, false) THEN 'ACCEPT_BOTH' ELSE 'REJECT_BOTH' END
    WHEN confidence < 0.7 THEN 'HUMAN_REVIEW' WHEN rule_ok IS NOT DISTINCT FROM false AND implausible THEN 'ACCEPT_RULE' WHEN other_ok IS NOT DISTINCT FROM false AND confidence > 0.85 THEN 'ACCEPT_OTHER'
    WHEN rule_ok IS NOT DISTINCT FROM false AND other_ok IS NOT DISTINCT FROM true AND confidence > 0.85 THEN 'ACCEPT_OTHER' ELSE 'HUMAN_REVIEW' END AS resolution FROM v""")
def conflict_resolution(spark, sf):
    v = table(spark, sf, "labels").selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 1 END AS rule_ok", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END AS other_ok", "(doc_id % 100) / 100.0 AS confidence", "doc_id % 3 = 0 AS implausible")
    return v.select("doc_id", V.resolve_conflict(*map(F.col, ("rule_ok", "other_ok", "confidence", "implausible"))).alias("resolution"))


@query("conflict_summary", f"""WITH v AS ({VERDICTS}) SELECT count(*) AS total, count_if(rule_ok IS DISTINCT FROM other_ok) AS conflicts, count_if(rule_ok IS DISTINCT FROM other_ok AND confidence < 0.7) AS needs_review,
    count_if(rule_ok AND other_ok) AS accepted, count_if(rule_ok IS NOT DISTINCT FROM other_ok AND NOT coalesce(rule_ok, false)) AS rejected FROM v""")
def conflict_summary(spark, sf):
    v = table(spark, sf, "labels").selectExpr("CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality = 1 END AS r", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END AS o", "(doc_id % 100) / 100.0 AS c")
    differs = ~F.col("r").eqNullSafe(F.col("o"))
    return v.agg(F.count("*").alias("total"), F.count_if(differs).alias("conflicts"), F.count_if(differs & (F.col("c") < 0.7)).alias("needs_review"), F.count_if(F.col("r") & F.col("o")).alias("accepted"), F.count_if(~differs & ~F.coalesce("r", F.lit(False))).alias("rejected"))


@query("suspicious_extractions", f"""WITH {R} SELECT user_id, count(value) AS n, count_if(unit <> '') AS n_units, count(DISTINCT value) AS n_distinct,
    count(value) < 60 OR count_if(unit <> '') = 0 OR (count(value) > 5 AND count(DISTINCT value) < 3) AS suspicious FROM r GROUP BY 1""")
def suspicious_extractions(spark, sf):
    return V.suspicious(readings(spark, sf), ["user_id"], "value", "unit", least=60)


@query("validation_peers", """SELECT event_id, len(p) AS n_peers, round(list_sum(p), 6) AS peer_sum FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM events) WHERE len(p) > 0""")
def validation_peers(spark, sf):
    p = V.peers(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value")
    total = F.aggregate("peers", F.lit(0.0), lambda a, x: a + x)
    return p.where(F.size("peers") > 0).select("event_id", F.size("peers").cast("long").alias("n_peers"), F.round(total, 6).alias("peer_sum"))


@query("unit_convert", f"""WITH c(test, from_unit, to_unit, factor) AS (VALUES {K.values_sql(K.CONVERSIONS)})
    SELECT l_orderkey, l_linenumber, to_unit, round(l_quantity * factor, 6) AS converted FROM lineitem JOIN c ON test = l_returnflag AND from_unit = 'kg'""")
def unit_convert(spark, sf):
    c = K.conversions(spark).where("from_unit = 'kg'")
    j = table(spark, sf, "lineitem").join(F.broadcast(c), F.col("l_returnflag") == F.col("test"))
    return j.select("l_orderkey", "l_linenumber", "to_unit", F.round(F.col("l_quantity") * F.col("factor"), 6).alias("converted"))


@query("display_gate", "SELECT user_id, round(v, 6) AS v FROM (SELECT user_id, arg_max(value, {'a': ts, 'b': event_id}) AS v FROM events GROUP BY 1) WHERE v < 0.7 * 30 OR v > 1.3 * 60")
def display_gate(spark, sf):
    """Users whose latest value is far outside the range shown."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return g.where((F.col("v") < 0.7 * 30) | (F.col("v") > 1.3 * 60)).select("user_id", F.round("v", 6).alias("v"))


@query("completeness", """SELECT p_partkey, concat_ws(',', CASE WHEN p_name IS NULL OR p_name = '' THEN 'name' END, CASE WHEN p_size % 10 = 0 THEN 'strength' END, CASE WHEN p_brand = 'Brand#11' THEN 'route' END) AS missing
    FROM part WHERE p_name IS NULL OR p_name = '' OR p_size % 10 = 0 OR p_brand = 'Brand#11'""")
def completeness(spark, sf):
    """Required fields that are null or empty (here: derived from part)."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("string")).alias("strength"), F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("route"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) == ""), c) for c in ("name", "strength", "route")]))
    return p.select("p_partkey", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


@query("controlled_compliance", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_suppkey % 5 = 0 THEN 'no licence' END, CASE WHEN l_quantity > 40 THEN 'quantity' END,
    CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN 'refills' WHEN l_returnflag = 'A' AND l_linenumber > 5 THEN 'refills' END) AS warnings FROM lineitem WHERE l_returnflag IN ('R', 'A')
    AND (l_suppkey % 5 = 0 OR l_quantity > 40 OR (l_returnflag = 'R' AND l_linenumber > 2) OR (l_returnflag = 'A' AND l_linenumber > 5))""")
def controlled_compliance(spark, sf):
    """Warnings for controlled items: licence missing, large quantity, more refills than the schedule allows."""
    line = table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    refills = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 2), "refills").when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 5), "refills")
    w = F.array_compact(F.array(F.when(F.col("l_suppkey") % 5 == 0, "no licence"), F.when(F.col("l_quantity") > 40, "quantity"), refills))
    return line.select("l_orderkey", "l_linenumber", F.array_join(w, ",").alias("warnings")).where("warnings <> ''")


@query("reflex_protocols", f"""WITH {WIDE} SELECT user_id, day, CASE WHEN click > 70 AND ("view" < 40 OR purchase > 60) THEN 'repeat click' ELSE 'check purchase' END AS reflex FROM w
    WHERE (click > 70 AND ("view" < 40 OR purchase > 60)) OR (purchase < 20 AND click IS NOT NULL)""")
def reflex_protocols(spark, sf):
    """Condition trees (all / any / comparison) compiled to column expressions; the first that holds names the follow-up."""
    trees = [
        ("repeat click", {"all": [("click", ">", 70), {"any": [("view", "<", 40), ("purchase", ">", 60)]}]}),
        ("check purchase", {"all": [("purchase", "<", 20), ("click", "known", None)]}),
    ]
    return days_wide(spark, sf).withColumn("reflex", V.first_hit(*[(n, compile_condition(t)) for n, t in trees])).where("reflex is not null").select("user_id", "day", "reflex")


def compile_condition(tree):
    """A column expression of a condition tree."""
    if isinstance(tree, dict):
        (kind, parts), = tree.items()
        out = [compile_condition(p) for p in parts]
        joined = out[0]
        for c in out[1:]:
            joined = (joined & c) if kind == "all" else (joined | c)
        return joined
    name, op, bound = tree
    c = F.col(name)
    ops = {">": lambda: c > bound, "<": lambda: c < bound, ">=": lambda: c >= bound, "<=": lambda: c <= bound, "=": lambda: c == bound, "known": c.isNotNull}
    return F.coalesce(ops[op](), F.lit(False))


RULE, MODEL = "l_quantity BETWEEN 3 AND 40", "CASE WHEN l_tax < 0.07 THEN l_discount < 0.08 END"
_DUAL = f"""d AS (SELECT l_orderkey, l_linenumber, bool_and({RULE}) AS a, bool_and({MODEL}) AS b FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, l_linenumber, a AS rule_ok FROM d WHERE l_orderkey % 5 > 0), m AS (SELECT l_orderkey, l_linenumber, b AS model_ok FROM d WHERE l_linenumber % 4 > 0),
    j AS (SELECT *, coalesce(rule_ok <> model_ok, false) AS conflict, NOT coalesce(rule_ok, false) AND NOT coalesce(model_ok, false) AND (rule_ok IS NOT NULL OR model_ok IS NOT NULL) AS rejected FROM r FULL JOIN m USING (l_orderkey, l_linenumber))"""


def judged_lines(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.expr(f"bool_and({RULE})").alias("a"), F.expr(f"bool_and({MODEL})").alias("b"))
    key = ["l_orderkey", "l_linenumber"]
    return V.dual_validation(d.where("l_orderkey % 5 > 0").select(*key, F.col("a").alias("ok")), d.where("l_linenumber % 4 > 0").select(*key, F.col("b").alias("ok")), key)


@query("dual_validation", f"""WITH {_DUAL} SELECT l_orderkey, l_linenumber, rule_ok, model_ok, conflict, rejected, concat_ws('; ', CASE WHEN conflict THEN 'Validation conflict: rules=' || CASE WHEN rule_ok THEN 'True' ELSE 'False' END || ', AI=' || CASE WHEN model_ok THEN 'True' ELSE 'False' END END,
    CASE WHEN rejected THEN 'Failed validation - verify manually' END) AS warnings FROM j""")
def dual_validation(spark, sf):
    """Verdicts of rules and of a stand-in model on every line, where either, both or only one has judged."""
    return judged_lines(spark, sf).withColumn("warnings", F.array_join("warnings", "; "))


@query("dual_validation_summary", f"WITH {_DUAL} SELECT l_orderkey, count(*) AS n_values, count_if(conflict) AS n_conflicts, count_if(rejected) AS n_rejected, greatest(0, round(1 - count_if(conflict) * 0.1 - count_if(rejected) * 0.2, 9))::DOUBLE AS confidence FROM j GROUP BY 1")
def dual_validation_summary(spark, sf):
    return V.validation_summary(judged_lines(spark, sf), ["l_orderkey"])
