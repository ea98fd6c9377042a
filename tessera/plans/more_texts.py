"""Table, line and rule queries over pages, documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import readings as R
from tessera.operators import tables as T
from tessera.plans.registry import query, table


def grids(spark, sf):
    """Each document's piped lines as rows of cells."""
    rows = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains("|")), lambda x: F.split(x, r"\|"))
    return table(spark, sf, "documents").select("doc_id", rows.alias("rows")).where(F.size("rows") > 0)


GRID = "g AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: string_split(x, '|')) AS rows_ FROM documents), h AS (SELECT * FROM g WHERE len(rows_) > 0)"


@query("clean_tables", f"WITH {GRID}, c AS (SELECT doc_id, list_filter(list_transform(rows_, lambda r: list_transform(r, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS t FROM h) SELECT doc_id, len(t)::INTEGER AS n_rows, len(flatten(t))::INTEGER AS n_cells FROM c")
def clean_tables(spark, sf):
    c = grids(spark, sf).select("doc_id", T.clean(F.col("rows")).alias("t"))
    return c.select("doc_id", F.size("t").alias("n_rows"), F.size(F.flatten("t")).alias("n_cells"))


@query("table_quality", f"""WITH {GRID} SELECT doc_id, round(least(1, 0.5 + CASE WHEN len(list_filter(rows_[1], lambda x: contains(lower(x), 'the'))) > 0 THEN 0.2 ELSE 0 END + 0.15 * len(list_filter(rows_, lambda r: len(r) = len(rows_[1]))) / len(rows_)
    + CASE WHEN len(list_filter(flatten(rows_), lambda c: regexp_matches(c, '\\d'))) > 0 THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS quality FROM h""")
def table_quality(spark, sf):
    return grids(spark, sf).select("doc_id", F.round(T.quality(F.get("rows", F.lit(0)), F.col("rows"), ["the"]), 6).alias("quality"))


@query("value_in_table", f"WITH {GRID} SELECT doc_id, list_filter(rows_, lambda r: contains(lower(r[1]), 'er') AND len(r) > 1)[1][2] AS value FROM h")
def value_in_table(spark, sf):
    return grids(spark, sf).select("doc_id", T.value_beside(F.col("rows"), "ER").alias("value"))


@query("column_roles", "SELECT p_type, CASE WHEN contains(lower(p_type), 'steel') THEN 'value' WHEN contains(lower(p_type), 'brushed') OR contains(lower(p_type), 'plated') THEN 'unit' WHEN contains(lower(p_type), 'large') THEN 'name' END AS role FROM (SELECT DISTINCT p_type FROM part)")
def column_roles(spark, sf):
    roles = [("name", ["large"]), ("unit", ["brushed", "plated"]), ("value", ["steel"])]
    return table(spark, sf, "part").select("p_type").distinct().select("p_type", T.column_role(F.col("p_type"), roles).alias("role"))


# Every order is a table of results: its lines are rows, its headers differ by the order; a method column stands before the result in some.
CELL_ROWS = """CASE l_orderkey % 4 WHEN 0 THEN {list}(l_returnflag, CAST(l_linenumber AS {text}), CASE WHEN l_tax > 0.04 THEN 'H' ELSE '' END, 'mg/dL', '1.5 - 20') WHEN 1 THEN {list}('a', 'method', CASE WHEN l_tax > 0.02 THEN concat('< ', CAST(l_suppkey AS {text}), '.5') ELSE 'none' END, ' low ', '5-7')
    WHEN 2 THEN {list}(CAST(l_linenumber AS {text}), 'n', CAST(l_partkey AS {text}), CASE WHEN l_linenumber < 3 THEN '%' ELSE 'x' END) ELSE {list}('only') END"""
HEADERS = """CASE l_orderkey % 5 WHEN 0 THEN {list}('Test Name', 'Result Value', 'Flag', 'Units', 'Normal Range') WHEN 1 THEN {list}('Analyte', 'Method', 'Abnormal', 'UOM') WHEN 2 THEN {list}('Reference Interval', 'Component', 'Finding') WHEN 3 THEN {list}('a', 'b', 'c', 'd', 'e') END"""
_pick = lambda k, extra="": f"(SELECT arg_max(i, (n_{k}, -i)) FROM p WHERE p.l_orderkey = t.l_orderkey{extra})"
_top = lambda k, extra="": f"(SELECT max(n_{k}) FROM p WHERE p.l_orderkey = t.l_orderkey{extra})"
_ROLE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(h, ' + chr(39) + w + chr(39) + ')' for w in words)} THEN '{k}'" for k, words in T.HEADER_WORDS.items()) + " END"


@query("column_places", f"""WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n, {CELL_ROWS.format(list='list_value', text='VARCHAR')} AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_tax, l_returnflag) AS d FROM lineitem) WHERE d = 1)),
    t AS (SELECT DISTINCT l_orderkey, {HEADERS.format(list='list_value')} AS headers FROM lineitem), c AS (SELECT l_orderkey, trim(unnest(r)) AS cell, generate_subscripts(r, 1) - 1 AS i FROM l WHERE n <= 10),
    p AS (SELECT l_orderkey, i, {", ".join(f"count_if(regexp_matches(cell, '{x}')) AS n_{k}" for k, x in T.CELL_KINDS.items())} FROM c WHERE cell <> '' GROUP BY 1, 2),
    d AS (SELECT l_orderkey, headers, CASE WHEN {_top('result', ' AND i > 0')} >= 2 THEN {_pick('result', ' AND i > 0')} END AS d_result, {", ".join(f"CASE WHEN {_top(k)} >= {T.LEAST[k]} THEN {_pick(k)} END AS d_{k}" for k in ("flag", "unit", "reference"))} FROM t),
    h AS (SELECT l_orderkey, {", ".join(f"max(i) FILTER (role = '{k}') AS h_{k}" for k in T.HEADER_WORDS)} FROM (SELECT l_orderkey, i, {_ROLE} AS role FROM (SELECT l_orderkey, lower(unnest(headers)) AS h, generate_subscripts(headers, 1) - 1 AS i FROM t)) GROUP BY 1)
    SELECT l_orderkey, CASE WHEN headers IS NULL THEN 0 ELSE coalesce(h_test, 0) END::INTEGER AS test, CASE WHEN headers IS NULL THEN d_result WHEN h_result IS NULL THEN coalesce(d_result, 1) ELSE h_result END::INTEGER AS result,
    {", ".join(f"CASE WHEN headers IS NULL THEN d_{k} WHEN h_result IS NULL THEN coalesce(h_{k}, d_{k}) ELSE h_{k} END::INTEGER AS {k}" for k in ("flag", "unit", "reference"))} FROM d LEFT JOIN h USING (l_orderkey)""")
def column_places(spark, sf):
    """Where the columns of every order's table of results stand, by headers and cells."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_returnflag").repartition("l_orderkey")  # noqa: E741
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_tax", "l_returnflag")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    rows = one.select("l_orderkey", "l_linenumber", F.expr(CELL_ROWS.format(list="array", text="STRING")).alias("r")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "r"))).alias("rows"))
    return T.column_places(rows.select("l_orderkey", F.expr(HEADERS.format(list="array")).alias("headers"), F.col("rows.r").alias("rows")), "l_orderkey")


@query("commentary_stripping", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), d AS (SELECT *, regexp_matches(line, '\\d') AS r FROM l WHERE trim(line, ' ') <> ''),
    p AS (SELECT *, lag(r) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM d) SELECT doc_id, count(*) AS kept FROM p WHERE r OR coalesce(p, true) GROUP BY 1""")
def commentary_stripping(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return T.without_commentary(lines, "doc_id", "n", F.col("line").rlike(r"\d")).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("first_match_findings", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'critical' WHEN regexp_matches(text, '(?i)\\bder\\b') THEN 'left' WHEN regexp_matches(text, '(?i)que') THEN 'right' END AS finding FROM conversations")
def first_match_findings(spark, sf):
    rules = [("critical", "tion"), ("left", r"\bder\b"), ("right", "que")]
    return table(spark, sf, "conversations").select("conv_id", "turn", T.first_match(F.col("text"), rules).alias("finding"))


@query("findings_by_location", """WITH f AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)tion') THEN 'left' WHEN regexp_matches(text, '(?i)que') THEN 'right' ELSE 'unspecified' END AS location FROM conversations)
    SELECT conv_id, location, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM f GROUP BY 1, 2""")
def findings_by_location(spark, sf):
    f = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(T.first_match(F.col("text"), [("left", "tion"), ("right", "que")]), F.lit("unspecified")).alias("location"))
    return f.groupBy("conv_id", "location").agg(F.array_join(F.array_sort(F.collect_list("turn")).cast("array<string>"), ",").alias("turns"))


@query("keyword_hits", "SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(lower(text), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'que') THEN 'que' END) AS hits FROM conversations")
def keyword_hits(spark, sf):
    low = F.lower("text")
    hits = F.filter(F.array(F.lit("the"), F.lit("que")), lambda k: low.contains(k))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(hits, ",").alias("hits"))


@query("specimen_reject", "SELECT doc_id, max(CASE WHEN regexp_matches(text, '(?i)token =') THEN 3 WHEN regexp_matches(text, '@') THEN 2 WHEN regexp_matches(text, '\\|') THEN 1 ELSE 0 END)::INTEGER AS severity FROM documents GROUP BY 1")
def specimen_reject(spark, sf):
    t = F.col("text")
    s = F.when(t.rlike("(?i)token ="), 3).when(t.rlike("@"), 2).when(t.rlike(r"\|"), 1).otherwise(0)
    return table(spark, sf, "documents").groupBy("doc_id").agg(F.max(s).alias("severity"))


@query("evidence_confidence", "SELECT doc_id, round(CASE WHEN n > 0 THEN least(0.95, 0.5 + 0.15 * n) END::DOUBLE, 6) AS confidence FROM (SELECT doc_id, regexp_matches(text, '@')::INT + regexp_matches(text, '\\d{3}')::INT + regexp_matches(text, 'token')::INT AS n FROM documents)")
def evidence_confidence(spark, sf):
    t = F.col("text")
    found = [F.when(t.rlike(p), p) for p in ("@", r"\d{3}", "token")]
    return table(spark, sf, "documents").select("doc_id", F.round(T.evidence(found), 6).alias("confidence"))


@query("class_inference", "SELECT p_partkey, CASE WHEN ends_with(lower(p_name), 'e') OR contains(lower(p_name), 'red') THEN 'one' WHEN ends_with(lower(p_name), 'n') THEN 'two' END AS class FROM part")
def class_inference(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.inferred_class(F.col("p_name"), [("one", ["e"], ["red"]), ("two", ["n"], [])]).alias("class"))


@query("json_schema_check", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS valid FROM events")
def json_schema_check(spark, sf):
    """Required keys are there and have their type."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].isNotNull().alias("valid"))


@query("strength_validation", """SELECT p_partkey, max(CASE WHEN p_size = l_quantity AND l_returnflag = 'N' THEN 0.18 WHEN p_size = l_quantity THEN 0.10 ELSE 0 END)::DOUBLE AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def strength_validation(spark, sf):
    j = table(spark, sf, "part").join(table(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    s = T.strength_score(F.lit(False), F.col("l_quantity"), F.col("p_size"), F.col("l_returnflag"), F.lit("N"))
    return j.groupBy("p_partkey").agg(F.max(s).alias("score"))


@query("text_similarity")
def text_similarity(spark, sf):
    """Similarity of each turn to the one before it; rows only."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.round(T.sequence_similarity("before", "text"), 6).alias("similarity"))


@query("footnotes_and_splits")
def footnotes_and_splits(spark, sf):
    """Labels without footnote marks and with split words joined; rows only."""
    from tessera.functions import text as X

    return table(spark, sf, "part").select("p_partkey", X.strip_footnotes(F.col("p_name")).alias("plain"), X.join_split_words(F.col("p_type")).alias("joined"))


@query("nested_sections", "SELECT doc_id, count(DISTINCT k)::BIGINT AS n FROM (SELECT doc_id, unnest(['lang', 'source']) AS k FROM documents) GROUP BY 1")
def nested_sections(spark, sf):
    """A map of sections whose values are cleaned in place."""
    from tessera.functions import text as X

    m = F.transform_values(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), lambda k, v: X.strip_footnotes(v))
    return table(spark, sf, "documents").select("doc_id", F.size(m).cast("long").alias("n"))


# Two readings of a conversation: its turns in order, and the same with turns left out, upside down, with wide spaces or other words.
OCR = "string_agg(text, chr(10) ORDER BY turn)"
VLM = "CASE conv_id % 6 WHEN 0 THEN string_agg(replace(text, ' ', '  '), chr(10) ORDER BY turn) WHEN 1 THEN string_agg(text, chr(10) ORDER BY turn) FILTER (turn % 3 <> 1) WHEN 2 THEN string_agg(text, chr(10) ORDER BY turn DESC) WHEN 3 THEN string_agg('x' || text, chr(10) ORDER BY turn) WHEN 4 THEN string_agg(text || chr(10) || ' more  words', chr(10) ORDER BY turn) END"
_lines = lambda side: f"(SELECT conv_id, line, count(*) AS n, min(pos) AS pos FROM (SELECT conv_id, pos, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS line FROM (SELECT conv_id, unnest(string_split({side}, chr(10))) AS line, generate_subscripts(string_split({side}, chr(10)), 1) AS pos FROM r)) WHERE line <> '' GROUP BY 1, 2)"
_tidy = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


@query("two_way_text_merge", f"""WITH r AS (SELECT conv_id, {OCR} AS ocr, {VLM} AS vlm, (conv_id % 10) / 10.0 AS co, (conv_id % 7) / 7.0 AS cv, conv_id % 4 AS no, conv_id % 5 AS nv FROM conversations GROUP BY conv_id), a AS {_lines('ocr')}, b AS {_lines('vlm')},
    s AS (SELECT conv_id, (SELECT sum(n * length(line)) FROM a WHERE a.conv_id = r.conv_id) AS sa, (SELECT sum(n * length(line)) FROM b WHERE b.conv_id = r.conv_id) AS sb FROM r),
    t AS (SELECT conv_id, list({{'p': b.pos, 'w': length(line)}} ORDER BY a.pos) AS l FROM a JOIN b USING (conv_id, line) WHERE a.n = 1 AND b.n = 1 GROUP BY 1),
    w AS (SELECT conv_id, list_max(list_transform(list_reduce(l, lambda acc, x: list_append(acc, {{'p': x.p, 'b': x.w + coalesce(list_max(list_transform(list_filter(acc, lambda y: y.p < x.p), lambda y: y.b)), 0)}}), CAST([] AS STRUCT(p BIGINT, b BIGINT)[])), lambda z: z.b)) AS shared FROM t),
    k AS (SELECT r.*, CASE WHEN {_tidy('ocr')} = {_tidy('vlm')} AND sa > 0 AND sb > 0 AND coalesce(shared, 0) > 0 THEN 1.0 WHEN sa > 0 AND sb > 0 THEN 2 * coalesce(shared, 0) / (sa + sb) ELSE 0 END::DOUBLE AS alike, length(trim(ocr)) AS m, length(trim(vlm)) AS n,
        length(ocr) AS lo, length(vlm) AS lv FROM r JOIN s USING (conv_id) LEFT JOIN w USING (conv_id)),
    c AS (SELECT *, CASE WHEN vlm IS NULL THEN 'ocr' WHEN alike > 0.7 THEN 'consensus' WHEN co < 0.5 OR nv > no * 1.5 OR cv > co + 0.2 THEN 'vlm2' WHEN (co > 0.8 AND m > n * 1.2) OR co > cv + 0.2 THEN 'ocr2' WHEN n > m * 1.1 THEN 'vlm3' WHEN m > n * 1.1 THEN 'ocr3' ELSE 'consensus' END AS how FROM k)
    SELECT conv_id, round(alike, 6)::DOUBLE AS alike, rtrim(how, '23') AS source, md5(CASE WHEN starts_with(how, 'ocr') THEN ocr WHEN starts_with(how, 'vlm') THEN vlm WHEN alike > 0.9 THEN CASE WHEN lv >= lo THEN vlm ELSE ocr END WHEN lv > lo * 0.9 THEN vlm ELSE ocr END) AS text,
    round(CASE WHEN starts_with(how, 'ocr') THEN co WHEN starts_with(how, 'vlm') THEN cv ELSE co * 0.4 + cv * 0.6 END, 6)::DOUBLE AS confidence, CASE how WHEN 'ocr' THEN 1 WHEN 'consensus' THEN 0.5 WHEN 'vlm2' THEN 0.2 WHEN 'ocr2' THEN 0.8 WHEN 'vlm3' THEN 0.3 ELSE 0.7 END::DOUBLE AS ocr_share,
    CASE WHEN vlm IS NULL THEN no ELSE greatest(no, nv) END AS n_fields, CASE WHEN vlm IS NULL THEN 1 ELSE (alike < 0.3)::INT + (co < 0.5)::INT + (cv < 0.5)::INT END::INTEGER AS n_warnings FROM c""")
def two_way_text_merge(spark, sf):
    """Which of two readings of every conversation is taken, by their likeness, confidence, fields and length."""
    c = table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = lambda t, f=lambda x: x["text"]: F.array_join(F.transform(t, f), "\n")
    part, k = F.filter("t", lambda x: x["turn"] % 3 != 1), F.col("conv_id") % 6
    vlm = F.when(k == 0, joined("t", lambda x: F.replace(x["text"], F.lit(" "), F.lit("  ")))).when(k == 1, joined(part)).when(k == 2, joined(F.reverse("t"))).when(k == 3, joined("t", lambda x: F.concat(F.lit("x"), x["text"]))).when(k == 4, joined("t", lambda x: F.concat(x["text"], F.lit("\n more  words"))))
    r = turns.select("conv_id", joined("t").alias("ocr"), vlm.alias("vlm"))
    fields = lambda n: F.map_from_arrays(*[F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("conv_id") % n), lambda i: F.concat(F.lit(p), i.cast("string"))) for p in ("k", "v")])
    both = r.join(R.likeness(r, "conv_id", "ocr", "vlm"), "conv_id")
    got = both.withColumn("m", R.merged_reading(F.col("ocr"), F.col("vlm"), fields(4), fields(5), F.col("conv_id") % 10 / 10, F.col("conv_id") % 7 / 7, F.col("likeness")))
    return got.select("conv_id", F.round("likeness", 6).alias("alike"), "m.source", F.md5("m.text").alias("text"), F.round("m.confidence", 6).alias("confidence"), "m.ocr_share", F.size("m.fields").cast("long").alias("n_fields"), F.size("m.warnings").alias("n_warnings"))


@query("threshold_gate", "SELECT event_type, count_if((event_id % 100) / 100.0 >= CASE event_type WHEN 'click' THEN 0.9 WHEN 'view' THEN 0.7 ELSE 0.5 END) AS n FROM events GROUP BY 1")
def threshold_gate(spark, sf):
    bar = F.when(F.col("event_type") == "click", 0.9).when(F.col("event_type") == "view", 0.7).otherwise(0.5)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_if((F.col("event_id") % 100) / 100.0 >= bar).alias("n"))


@query("terminology_system", "SELECT p_partkey, p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AS known FROM part")
def terminology_system(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13").alias("known"))
