"""Queries of gates by fixed lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import gates as G
from tessera.plans.registry import query, table

quoted = lambda words: ", ".join(f"'{w}'" for w in words)
FIELD = "CASE p_partkey % 12 WHEN 0 THEN 'Patient Name' WHEN 1 THEN concat('order-', p_name) WHEN 2 THEN ' Rh-D type ' WHEN 3 THEN concat(p_name, ' ID') WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'AB' WHEN 7 THEN 'Out of range' WHEN 8 THEN 'homepage 2' ELSE p_name END"
_n = f"replace(replace(trim(lower({FIELD})), ' ', '_'), '-', '_')"


@query("metadata_fields", f"SELECT p_partkey, coalesce({FIELD} <> '' AND ({_n} IN ({quoted(G.METADATA)}) OR {' OR '.join(f'contains({_n}, ' + chr(39) + p + chr(39) + ')' for p in G.METADATA_PARTS)}), false) AS metadata FROM part")
def metadata_fields(spark, sf):
    """Which of the field names made of parts belong to a report's head."""
    return table(spark, sf, "part").select("p_partkey", G.is_metadata_field(F.expr(FIELD)).alias("metadata"))


NAME = "CASE o_orderkey % 5 WHEN 0 THEN 'human_review' WHEN 1 THEN 'template' WHEN 2 THEN 'classification' WHEN 3 THEN 'unknown' END"


@query("named_thresholds", f"""SELECT o_orderstatus, coalesce({NAME}, 'none') AS name, count(*) AS n, count_if((o_orderkey % 100) / 100.0 >= CASE {NAME} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in G.THRESHOLDS.items())} ELSE 0.85 END) AS met FROM orders GROUP BY 1, 2""")
def named_thresholds(spark, sf):
    """How many orders of a status reach each named threshold by a made-up confidence."""
    o = table(spark, sf, "orders").select("o_orderstatus", F.expr(NAME).alias("name"), (F.col("o_orderkey") % 100 / 100).alias("c"))
    return o.groupBy("o_orderstatus", F.coalesce("name", F.lit("none")).alias("name")).agg(F.count("*").alias("n"), F.count_if(G.meets_threshold(F.col("c"), F.col("name"))).alias("met"))


KIND = "CASE doc_id % 7 WHEN 0 THEN 'lab' WHEN 1 THEN 'radiology' WHEN 2 THEN 'pathology' WHEN 3 THEN 'prescription' WHEN 4 THEN 'discharge_summary' WHEN 5 THEN 'unknown' END"
SYSTEM = "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'http://loinc.org' ELSE 'http://example.org' END"


@query("processors_and_systems", f"SELECT doc_id, CASE {KIND} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in G.PROCESSORS.items())} ELSE 'fallback' END AS processor, coalesce({SYSTEM} IN ('http://loinc.org', 'http://snomed.info/sct'), false) AS known FROM documents")
def processors_and_systems(spark, sf):
    """The processor of every document's type, and whether its code system is expected."""
    return table(spark, sf, "documents").select("doc_id", G.processor_of(F.expr(KIND)).alias("processor"), G.known_system(F.expr(SYSTEM), ["http://loinc.org", "http://snomed.info/sct"]).alias("known"))
