"""Structure and class queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import classify as C
from tessera.plans.registry import query, table

FP = """f AS (SELECT doc_id, text, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) >= 10 AND (contains(x, chr(9)) OR len(string_split_regex(trim(x, ' '), '\\s{2,}')) >= 3))) AS rows_, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS full_,
    len(regexp_extract_all(text, '(?m)^[A-Za-z][A-Za-z ]{3,}:')) AS sections, length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0) AS density, len(string_split_regex(trim(text), '\\s+')) AS words FROM documents)"""


@query("fingerprint", f"WITH {FP} SELECT doc_id, coalesce(rows_ / nullif(full_, 0) > 0.3, false) AS has_table, sections >= 2 AS has_sections, round(coalesce(density, 0), 6) AS density FROM f")
def fingerprint(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", C.has_table(t).alias("has_table"), (C.section_count(t) >= 2).alias("has_sections"), F.round(C.numeric_density(t), 6).alias("density"))


@query("layout_type", f"""WITH {FP}, g AS (SELECT coalesce(rows_ / nullif(full_, 0) > 0.3, false) AS t, sections >= 2 AS s, coalesce(density, 0) AS d FROM f)
    SELECT CASE WHEN t AND NOT s AND d > 0.15 THEN 'tabular' WHEN s AND NOT t AND d < 0.1 THEN 'narrative' WHEN t AND s THEN 'mixed' ELSE 'unknown' END AS layout, count(*) AS n FROM g GROUP BY 1""")
def layout_type(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").groupBy(C.layout(C.has_table(t), C.section_count(t) >= 2, C.numeric_density(t)).alias("layout")).agg(F.count("*").alias("n"))


@query("header_counts", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) BETWEEN 3 AND 50 AND upper(x) = x AND NOT contains(x, 'ß') AND regexp_matches(x, '[A-Z]')))::INTEGER AS n FROM documents")
def header_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.header_count(F.col("text")).alias("n"))


TYPES = {
    "prose": (["the", "and", "of", "that", "with"], ["the "], [r"\. [A-Z]"], ["|"]),
    "listing": (["|", "id", "no"], ["|"], [r"\|.*\|"], ["the"]),
    "shouting": (["!!"], ["!!"], [r"!! [A-Z]+!!"], []),
}


def _type_sql(kw, hd, pat, ag):
    q = lambda w: w.replace("'", "''")
    n = lambda words, t: "(" + " + ".join([f"contains(lower({t}), '{q(w)}')::INT" for w in words] or ["0"]) + ")"
    return f"greatest(0, least(1, {n(kw, 'text')} / 5) * 0.35 + CASE WHEN {n(hd, 'substr(text, 1, 500)')} > 0 THEN 0.25 ELSE 0 END + CASE WHEN regexp_matches(text, '{q(pat[0])}') THEN 0.40 ELSE 0 END - least(0.4, {n(ag, 'text')} * 0.1))::DOUBLE"


@query("classify_fingerprint", "WITH s AS (SELECT doc_id, " + ", ".join(f"round({_type_sql(*v)}, 9) AS {k}" for k, v in TYPES.items()) + """ FROM documents)
    SELECT doc_id, CASE WHEN prose >= listing AND prose >= shouting THEN 'prose' WHEN listing >= shouting THEN 'listing' ELSE 'shouting' END AS label, round(greatest(prose, listing, shouting), 6) AS score FROM s""")
def classify_fingerprint(spark, sf):
    b = C.best_label({k: C.type_score(F.col("text"), *v) for k, v in TYPES.items()})
    d = table(spark, sf, "documents").select("doc_id", b.alias("b"))
    return d.select("doc_id", F.col("b.label").alias("label"), F.round("b.score", 6).alias("score"))


@query("schema_detect", """WITH s AS (SELECT doc_id, lower(text) AS t FROM documents), c AS (SELECT doc_id, ((contains(t, 'the')::INT + contains(t, 'and')::INT) / 2.0 * 0.6 + contains(t, 'of')::INT * 0.3) / 0.9 AS en,
    ((contains(t, 'der')::INT + contains(t, 'und')::INT) / 2.0 * 0.6 + contains(t, 'ein')::INT * 0.3) / 0.9 AS de FROM s) SELECT doc_id, CASE WHEN round(en::DOUBLE, 9) >= round(de::DOUBLE, 9) THEN 'en' ELSE 'de' END AS label, round(greatest(en, de)::DOUBLE, 6) AS score FROM c""")
def schema_detect(spark, sf):
    t = F.col("text")
    b = C.best_label({"en": C.schema_score(t, ["the", "and"], ["of"]), "de": C.schema_score(t, ["der", "und"], ["ein"])})
    d = table(spark, sf, "documents").select("doc_id", b.alias("b"))
    return d.select("doc_id", F.col("b.label").alias("label"), F.round("b.score", 6).alias("score"))


@query("template_match", """WITH t(name, marker, field) AS (VALUES ('a', 'example.com', 'nav'), ('b', 'example.org', 'article'), ('c', 'example.net', 'footer')), s AS (SELECT page_id, name,
    CASE WHEN contains(url, marker) THEN 0.3 + 0.3 * contains(html, field)::INT + 0.25 ELSE least(0.5, 0.3 * contains(html, field)::INT) END::DOUBLE AS score FROM pages, t)
    SELECT page_id, name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, name) AS k FROM s) WHERE k = 1""")
def template_match(spark, sf):
    """Best of a fixed list of templates; without the vendor's marker a score stays at .5 or below."""
    u, h = F.col("url"), F.col("html")
    field = lambda f: F.when(h.contains(f), 0.3).otherwise(0.0)
    score = lambda m, f: F.when(u.contains(m), 0.55 + field(f)).otherwise(F.least(F.lit(0.5), field(f)))
    b = C.best_label({"a": score("example.com", "nav"), "b": score("example.org", "article"), "c": score("example.net", "footer")})
    p = table(spark, sf, "pages").select("page_id", b.alias("b"))
    return p.select("page_id", F.col("b.label").alias("name"), F.round("b.score", 6).alias("score"))


@query("merge_verdicts", """WITH v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'x' ELSE 'y' END AS m, (doc_id % 50 + 30) / 128.0 AS ms, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS r, (doc_id % 70 + 20) / 128.0 AS rs FROM labels)
    SELECT doc_id, CASE WHEN m IS NULL OR (m <> r AND rs - ms > 0.2) THEN r ELSE m END AS label, round((CASE WHEN m IS NULL THEN rs WHEN m = r THEN least(0.98, ms + least(0.15, rs * 0.2)) WHEN rs - ms > 0.2 THEN rs ELSE ms END)::DOUBLE, 6) AS confidence, coalesce(m <> r, false) AS review FROM v""")
def merge_verdicts(spark, sf):
    d = F.col("doc_id")
    model, rule = F.when(d % 10 == 0, F.lit(None).cast("string")).when(d % 3 == 0, "x").otherwise("y"), F.when(d % 2 == 0, "x").otherwise("y")
    ms, rs = (d % 50 + 30) / 128.0, (d % 70 + 20) / 128.0
    v = table(spark, sf, "labels").select("doc_id", model.alias("m"), ms.alias("ms"), rule.alias("r"), rs.alias("rs"))
    label, confidence, review = C.merge_verdicts(*map(F.col, ("m", "ms", "r", "rs")))
    return v.select("doc_id", label.alias("label"), F.round(confidence.cast("double"), 6).alias("confidence"), review.alias("review"))


@query("route_processor", "SELECT CASE event_type WHEN 'click' THEN 'lab' WHEN 'view' THEN 'radiology' WHEN 'purchase' THEN 'prescription' ELSE 'fallback' END AS processor, count(*) AS n FROM events GROUP BY 1")
def route_processor(spark, sf):
    routes = F.create_map(*[F.lit(x) for x in ("click", "lab", "view", "radiology", "purchase", "prescription")])
    return table(spark, sf, "events").groupBy(F.coalesce(F.element_at(routes, F.col("event_type")), F.lit("fallback")).alias("processor")).agg(F.count("*").alias("n"))


@query("garbage_text", "SELECT doc_id FROM documents WHERE length(text) < 5 OR regexp_matches(text, '^[01\\s]*$') OR len(string_split(text, ' ')) < 2")
def garbage_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where((F.length(t) < 5) | t.rlike(r"^[01\s]*$") | (F.size(F.split(t, " ")) < 2)).select("doc_id")


@query("content_gate", "SELECT doc_id, length(text) >= 50 AND regexp_matches(text, '(?i)token')::INT + regexp_matches(text, '@')::INT + regexp_matches(text, '\\d{3}')::INT >= 2 AS passes FROM documents")
def content_gate(spark, sf):
    t = F.col("text")
    signals = t.rlike("(?i)token").cast("int") + t.rlike("@").cast("int") + t.rlike(r"\d{3}").cast("int")
    return table(spark, sf, "documents").select("doc_id", ((F.length(t) >= 50) & (signals >= 2)).alias("passes"))


@query("metadata_exclusion", "SELECT doc_id FROM documents WHERE NOT regexp_matches(replace(replace(lower(source), ' ', '_'), '-', '_'), 'src1')")
def metadata_exclusion(spark, sf):
    key = F.replace(F.replace(F.lower("source"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return table(spark, sf, "documents").where(~key.rlike("src1")).select("doc_id")


@query("document_layout", "SELECT doc_id, contains(text, '|') OR contains(text, chr(9)) AS has_tables, regexp_matches(text, '(?m)^\\s*[-•*]\\s') AS has_lists, length(text) > 10000 AS many_pages FROM documents")
def document_layout(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", (t.contains("|") | t.contains("\t")).alias("has_tables"), t.rlike(r"(?m)^\s*[-•*]\s").alias("has_lists"), (F.length(t) > 10000).alias("many_pages"))


CPT = {"chest_xray": "71046", "chest_ct": "71250", "abdomen_ct": "74150", "head_ct": "70450", "mri_brain": "70551", "ultrasound_abdomen": "76700", "mammogram": "77067"}
HAS = lambda *words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


@query("procedure_type", f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), k AS (SELECT doc_id, CASE
    WHEN {HAS("ct", "computed tomography")} THEN CASE WHEN {HAS("chest")} THEN 'chest_ct' WHEN {HAS("abdomen")} THEN 'abdomen_ct' WHEN {HAS("head", "brain")} THEN 'head_ct' ELSE 'ct_unknown' END
    WHEN {HAS("mri", "magnetic resonance")} THEN CASE WHEN {HAS("brain", "head")} THEN 'mri_brain' ELSE 'mri_unknown' END
    WHEN {HAS("ultrasound", "sonogram")} THEN CASE WHEN {HAS("abdomen")} THEN 'ultrasound_abdomen' ELSE 'ultrasound_unknown' END WHEN {HAS("mammogram", "mammography")} THEN 'mammogram'
    WHEN {HAS("x-ray", "radiograph")} THEN CASE WHEN {HAS("chest")} THEN 'chest_xray' ELSE 'xray_unknown' END ELSE 'unknown' END AS kind FROM d)
    SELECT doc_id, kind, CASE kind {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CPT.items())} END AS cpt FROM k""")
def procedure_type(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", C.procedure(F.col("text")).alias("kind"))
    codes = F.create_map(*[F.lit(x) for pair in CPT.items() for x in pair])
    return d.select("doc_id", "kind", codes[F.col("kind")].alias("cpt"))


@query("fallback_sections")
def fallback_sections(spark, sf):
    """RE2 knows no look-ahead, so there is no SQL; tests compare with Python's own expressions."""
    return table(spark, sf, "documents").select("doc_id", C.fallback_impression(F.col("text")).alias("impression"), C.fallback_findings(F.col("text")).alias("findings"))
