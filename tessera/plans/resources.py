"""Nested-record queries: each user's readings become a bundle; results are compared flattened."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import knowledge as K
from tessera.operators import resources as R
from tessera.operators import validation as V
from tessera.plans.registry import query, table
from tessera.plans.validation import FLAG, readings
from tessera.plans.validation import R as READINGS


def observed(spark, sf):
    r = V.with_critical(V.with_reference(readings(spark, sf), K.reference(spark)), K.critical(spark))
    o = R.observation(F.col("event_id"), F.col("test"), F.col("value"), F.col("unit"), F.col("ref_low"), F.col("ref_high"), V.reference_flag(F.col("value")), F.date_format("ts", "yyyy-MM-dd"))
    return r.select("user_id", "event_id", o.alias("o"))


@query("fhir_bundle", f"""WITH {READINGS} SELECT user_id, 'collection' AS type, count(*)::INTEGER AS entries, count_if(value <> 0)::INTEGER AS with_value, count_if(ref_low IS NOT NULL)::INTEGER AS with_range FROM x GROUP BY 1""")
def fhir_bundle(spark, sf):
    b = R.bundles(observed(spark, sf), ["user_id"], "o", "event_id")
    e = F.col("bundle.entry")
    has = lambda f: F.size(F.filter(e, lambda x: x["resource"][f].isNotNull()))
    return b.select("user_id", F.col("bundle.type").alias("type"), R.count_of(F.col("bundle"), "Observation").alias("entries"), has("valueQuantity").alias("with_value"), has("referenceRange").alias("with_range"))


@query("fhir_interpretation", f"""WITH {READINGS}, f AS (SELECT event_id, {FLAG} AS flag FROM x) SELECT event_id, CASE flag WHEN 'H' THEN 'H' WHEN 'L' THEN 'L' WHEN 'CRITICAL HIGH' THEN 'HH' WHEN 'CRITICAL LOW' THEN 'LL' ELSE 'N' END AS code FROM f""")
def fhir_interpretation(spark, sf):
    return observed(spark, sf).select("event_id", F.col("o.interpretation").alias("code"))


@query("fhir_validate", f"WITH {READINGS} SELECT event_id, 'no value' AS errors FROM x WHERE value IS NULL OR value = 0")
def fhir_validate(spark, sf):
    o = observed(spark, sf).select("event_id", F.array_join(R.observation_errors(F.col("o")), ",").alias("errors"))
    return o.where("errors <> ''")


@query("medication_requests", "SELECT l_orderkey, l_linenumber, 'MedicationRequest' AS kind, l_quantity::INT AS quantity FROM lineitem")
def medication_requests(spark, sf):
    line = table(spark, sf, "lineitem")
    m = R.medication_request(F.concat_ws("-", "l_orderkey", "l_linenumber"), F.col("l_returnflag"), F.lit("daily"), F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    return line.select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", F.col("m.resourceType").alias("kind"), F.col("m.dispenseRequest.quantity").alias("quantity"))


@query("reports_and_patients", "SELECT c_custkey, 'Patient' AS kind, CASE WHEN c_custkey % 3 = 0 THEN 'male' WHEN c_custkey % 3 = 1 THEN 'female' ELSE 'unknown' END AS gender FROM customer")
def reports_and_patients(spark, sf):
    sex = F.when(F.col("c_custkey") % 3 == 0, "male").when(F.col("c_custkey") % 3 == 1, "female")
    p = table(spark, sf, "customer").select("c_custkey", R.patient(F.col("c_custkey"), F.col("c_name"), sex).alias("p"))
    return p.select("c_custkey", F.col("p.resourceType").alias("kind"), F.col("p.gender").alias("gender"))


@query("range_text", f"WITH {READINGS} SELECT event_id, coalesce(ref_low::INT || ' - ' || ref_high::INT, '') AS range_text FROM x")
def range_text(spark, sf):
    r = V.with_reference(readings(spark, sf), K.reference(spark))
    return r.select("event_id", R.range_text(F.col("ref_low").cast("int"), F.col("ref_high").cast("int")).alias("range_text"))


@query("visible_fields", "SELECT event_id, 1 AS n FROM events")
def visible_fields(spark, sf):
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("_raw"), F.col("props"))
    return table(spark, sf, "events").select("event_id", F.size(R.visible(m)).alias("n"))


@query("export_csv", """SELECT strftime(ts, '%Y-%m-%d') || ',' || event_type || ',' || event_id || ',"' || props || '"' AS line FROM events""")
def export_csv(spark, sf):
    from tessera.sources import sinks

    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return sinks.export_lines(e, ["day", "event_type", "event_id"], "props")


@query("display_name", "SELECT doc_id, concat_ws(' ', upper(lang), source, CASE WHEN n_chars > 5000 THEN 'long' END) AS title FROM documents")
def display_name(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.upper("lang"), "source", F.when(F.col("n_chars") > 5000, "long")).alias("title"))


STATUS = ["final", "unknown", "partial", "appended", "corrected", "cancelled", "entered-in-error", "done", None]
STATUS_SQL = "['" + "', '".join(x for x in STATUS if x) + f"'][o_orderkey % {len(STATUS)} + 1]"


@query("status_vocabularies", f"""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'no status' WHEN s NOT IN ('registered', 'preliminary', 'final', 'amended', 'corrected', 'cancelled', 'entered-in-error') THEN 'bad status' ELSE '' END AS observation,
    CASE WHEN s IS NULL THEN 'no status' WHEN s NOT IN ('registered', 'partial', 'preliminary', 'final', 'amended', 'corrected', 'appended', 'cancelled', 'entered-in-error', 'unknown') THEN 'bad status' ELSE '' END AS report FROM (SELECT o_orderkey, {STATUS_SQL} AS s FROM orders)""")
def status_vocabularies(spark, sf):
    """What an observation's status may be, and what a report's."""
    s = F.get(F.array(*[F.lit(x).cast("string") for x in STATUS]), (F.col("o_orderkey") % len(STATUS)).cast("int"))
    code = R.concept(F.lit("local"), F.lit("c"), F.lit("c")).alias("code")
    o = F.struct(s.alias("status"), code, F.struct(F.lit(1.0).alias("value")).alias("valueQuantity"), F.array(F.struct(F.lit(0.0).alias("low"))).alias("referenceRange"))
    both = {"observation": R.observation_errors(o), "report": R.report_errors(o)}
    return table(spark, sf, "orders").select("o_orderkey", *[F.array_join(e, ",").alias(k) for k, e in both.items()])
