"""Queries of typed records read from JSON answers about customers, and of their patches by verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import structuring as S
from tessera.plans.registry import query, table

# A model's answer about each customer, in words that both engines read: some fields are left out, some answers are cut off.
ANSWER = """concat('{"patient": ', CASE WHEN c_custkey % 11 = 0 THEN 'null' ELSE concat('{"name": "', CASE WHEN c_custkey % 2 = 0 THEN 'J ohn, S mith Septe mber ' ELSE '' END, c_name, '"',
    CASE WHEN c_custkey % 3 = 0 THEN concat(', "dob": "19', CAST(50 + c_custkey % 40 AS {text}), '-01-02"') ELSE ', "dob": null' END, CASE WHEN c_custkey % 5 < 3 THEN ', "gender": "F", "mrn": ""' ELSE ', "mrn": "7"' END,
    CASE WHEN c_custkey % 7 = 1 THEN ', "insurance_id": "X1", "phone": "5"' ELSE ', "address": "a street"' END, '}') END,
    ', "medications": [{"name": "', c_mktsegment, '", "strength": "5 mg", "frequency": ""}, {"name": " ', lower(c_mktsegment), '"}, {"name": ""}, {"name": "B', CAST(c_custkey % 4 AS {text}), '", "strength": "1", "frequency": "daily", "instructions": "x"}]',
    CASE WHEN c_custkey % 4 = 0 THEN ', "findings": [{"finding": "mass", "severity": "high"}, {"category": "c"}], "dates": [{"date_value": "Septe mber 5"}, {"date_type": "service", "date_value": ""}]' ELSE '' END,
    ', "providers": [{"name": "D r Who", "role": "md"}], "additional_fields": {"note": "n', CAST(c_nationkey AS {text}), '"}, "invoice": {"number": "', CAST(c_custkey AS {text}), '", "total": "", "invoice_date": "d"}',
    CASE WHEN c_custkey % 17 = 5 THEN '' ELSE '}' END)"""
SQL_J = f"j AS (SELECT c_custkey, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM (SELECT c_custkey, {ANSWER.replace('{text}', 'VARCHAR')} AS t FROM customer))"
VERDICT = [
    "o_custkey AS c_custkey", "CASE o_orderkey % 4 WHEN 0 THEN 'patient_dob' WHEN 1 THEN 'patient_name' WHEN 2 THEN 'invoice_number' ELSE 'total' END AS field",
    "o_orderkey % 3 <> 0 AS correct", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS reason",
]
_has = lambda f: f"(coalesce(json_extract_string(j, '$.patient.{f}'), '') <> '')::INT"
_join = lambda c: rf"regexp_replace(regexp_replace({c}, '([a-zA-Z])\s([a-z])', '\1\2', 'g'), '(^|[\s,])([A-Z])\s([a-z]{{2,}})', '\1\2\3', 'g')"
_RECORDS = f"""{SQL_J}, m AS (SELECT c_custkey, json_extract_string(x, '$.name') AS name, CAST(round(0.5 + 0.5 * ((coalesce(json_extract_string(x, '$.strength'), '') <> '')::INT + (coalesce(json_extract_string(x, '$.frequency'), '') <> '')::INT + (coalesce(json_extract_string(x, '$.instructions'), '') <> '')::INT) / 3, 2) AS DOUBLE) AS c, n FROM
        (SELECT c_custkey, unnest(json_extract(j, '$.medications[*]')) AS x, generate_subscripts(json_extract(j, '$.medications[*]'), 1) AS n FROM j) WHERE coalesce(json_extract_string(x, '$.name'), '') <> ''),
    d AS (SELECT c_custkey, string_agg(name || ':' || format('{{:.2f}}', c), ',' ORDER BY n) AS medications FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, lower(trim(name)) ORDER BY n) AS k FROM m) WHERE k = 1 GROUP BY 1),
    r AS (SELECT c_custkey, {_join("(json_extract_string(j, '$.patient.name'))")} AS name, json_extract_string(j, '$.patient.dob') AS dob, coalesce(nullif(json_extract_string(j, '$.patient.insurance'), ''), json_extract_string(j, '$.patient.insurance_id')) AS insurance, CASE WHEN json_type(j, '$.patient') = 'OBJECT' THEN
        CAST(round(({_has('name')} + {_has('dob')} + {_has('gender')} + {_has('mrn')}) / 4 * 0.8 + ({_has('address')} + {_has('phone')} + {_has('insurance')} + {_has('insurance_id')}) / 4 * 0.2, 2) AS DOUBLE) END AS confidence, coalesce(medications, '') AS medications,
        CASE WHEN json_extract(j, '$.findings') IS NULL THEN '' ELSE 'mass' END AS findings, CASE WHEN json_extract(j, '$.dates') IS NULL THEN '' ELSE 'September 5' END AS dates, CASE WHEN j IS NULL THEN '' ELSE 'Dr Who' END AS providers,
        json_extract_string(j, '$.additional_fields.note') AS note, json_extract_string(j, '$.invoice.number') AS invoice_number, CASE WHEN j IS NULL THEN 0 ELSE 3 END AS n_raw, CASE WHEN j IS NULL THEN 'LLM returned empty response' ELSE '' END AS warnings FROM j LEFT JOIN d USING (c_custkey))"""


def records(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(ANSWER.replace("{text}", "STRING")).alias("answer"))
    return S.structured(S.parsed(rows, "c_custkey", "answer"), "c_custkey")


def flat(r):
    listed = lambda items, f: F.array_join(F.transform(items, f), ",")
    return r.select(
        "c_custkey", *[F.col(f"patient.{c}").alias(c) for c in ("name", "dob", "insurance", "confidence")], listed("medications", lambda m: F.concat(m["name"], F.lit(":"), F.format_string("%.2f", m["confidence"]))).alias("medications"),
        listed("findings", lambda x: x["finding"]).alias("findings"), listed("dates", lambda x: x["date_value"]).alias("dates"), listed("providers", lambda x: x["name"]).alias("providers"), F.col("raw_fields")["note"].alias("note"),
        F.col("raw_fields")["invoice_number"].alias("invoice_number"), F.size("raw_fields").alias("n_raw"), F.array_join("warnings", "; ").alias("warnings"),
    )


@query("structured_records", f"WITH {_RECORDS} SELECT * FROM r")
def structured_records(spark, sf):
    """Patients, medications and other records of every customer's answer."""
    return flat(records(spark, sf))


@query("reconciled_records", f"""WITH {_RECORDS}, v AS (SELECT c_custkey, {", ".join(f"min(coalesce(reason, 'failed verification')) FILTER (field = '{f}') AS {f}" for f in S.SAID)} FROM (SELECT {', '.join(VERDICT)} FROM orders) WHERE NOT correct GROUP BY 1),
    h AS (SELECT r.*, v.patient_dob IS NOT NULL AND coalesce(dob, '') <> '' AS bad_dob, v.patient_name IS NOT NULL AND coalesce(name, '') <> '' AS bad_name, v.invoice_number IS NOT NULL AND r.invoice_number IS NOT NULL AS bad_number,
        v.patient_dob AS why_dob, v.patient_name AS why_name, v.invoice_number AS why_number FROM r LEFT JOIN v USING (c_custkey))
    SELECT c_custkey, name, CASE WHEN NOT bad_dob THEN dob END AS dob, insurance, CASE WHEN bad_name THEN greatest(0.1, round(confidence - 0.3, 2))::DOUBLE ELSE confidence END AS confidence, medications, findings, dates, providers, note,
    CASE WHEN NOT bad_number THEN invoice_number END AS invoice_number, n_raw - bad_number::INT AS n_raw, concat_ws('; ', nullif(warnings, ''), CASE WHEN bad_dob THEN 'DOB removed: ' || why_dob END, CASE WHEN bad_name THEN 'Patient name uncertain: ' || why_name END,
    CASE WHEN bad_number THEN 'Invoice number removed: ' || why_number END) AS warnings FROM h""")
def reconciled_records(spark, sf):
    """The same records after the verdicts that orders give on their customers' fields."""
    return flat(S.reconciled(records(spark, sf), table(spark, sf, "orders").selectExpr(*VERDICT), "c_custkey"))
