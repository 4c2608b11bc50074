"""All queries of the library by name, with their SQL for comparison.

Tables of the star schema stand in for documents' inner tables (lines, cells, runs), so that the relational rules of the
converters can be compared row by row with SQL; `documents`, `pages` and `conversations` are read as what they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import markdown as md
from foliospark.operators import layout, library, plain_text, tables
from foliospark.plans import convert as convert_plan
from foliospark.plans import pages as pages_plan
from foliospark.session import table
from foliospark.sources import samples, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "page_markdown"


def query(sql: str | None = None):
    """Register a query under its function's name; its table names are the function's keyword defaults."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------ SQL text pieces

_ESC = r"regexp_replace({x}, '([\\`*_\[\]<>|])', '\\\1', 'g')"
_BLOCK = r"regexp_replace(" + _ESC + r", '^(\s*)([-+*>#]|[0-9]+[.)])(\s)', '\1\\\2\3')"
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_COUNT = r"len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '[#>*_`|-]', ' ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''’-]*'))"
_LIBRARY = r"len(regexp_extract_all(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'), '[#*_>`|-]', ' ', 'g'), '\S+'))"
_YAML = r"""CASE WHEN regexp_matches({x}, '^[\s>|@`&*!%#{{\[\]}}]|[:#]\s|["''\\]|^$|^(?i:true|false|null|yes|no|on|off|~)$|^-?[0-9]+(\.[0-9]+)?$|\n') THEN '"' || replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' ELSE {x} END"""
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(10)), lambda l: CASE WHEN rtrim(l, ' ' || chr(9)) || '  ' = l THEN l ELSE rtrim(l, ' ' || chr(9)) END), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+', ''), '\s+$', '') || chr(10)"


def _s(piece: str, x: str) -> str:
    return piece.replace("{x}", x).replace("{{", "{").replace("}}", "}")


# ------------------------------------------------------------- text functions


@query(f"SELECT doc_id, CAST({_s(_COUNT, 'text')} AS INTEGER) AS words FROM documents")
def doc_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.count_words("text").alias("words"))


@query(f"SELECT doc_id, CAST({_s(_LIBRARY, 'text')} AS INTEGER) AS words FROM documents")
def doc_library_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.library_words("text").alias("words"))


@query(f"SELECT doc_id, CAST(greatest(1, floor({_s(_LIBRARY, 'text')} / 200.0 + 0.5)) AS INTEGER) AS minutes FROM documents")
def doc_reading_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.reading_minutes(md.library_words("text")).alias("minutes"))


@query(f"SELECT doc_id, {_s(_ESC, 'text')} AS escaped FROM documents")
def doc_escape_inline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.escape_inline("text").alias("escaped"))


@query(f"SELECT doc_id, {_s(_BLOCK, 'text')} AS escaped FROM documents")
def doc_escape_block(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.escape_block("text").alias("escaped"))


@query(f"SELECT doc_id, {_s(_NORMAL, 'text')} AS markdown FROM documents")
def doc_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.normalize("text").alias("markdown"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS n, string_split(text, chr(10))[i + 1] AS line FROM documents, unnest(range(0, len(string_split(text, chr(10))))) x(i)")
def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return plain_text.split_lines(table(spark, sf, "documents"), "doc_id")


@query(
    r"""
WITH l AS (SELECT doc_id, i AS n, string_split(text, chr(10)) AS p FROM documents, unnest(range(0, len(string_split(text, chr(10))))) x(i)),
t AS (SELECT doc_id, n, trim(p[n + 1]) AS line, coalesce(p[n + 2], '') AS after FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM t
WHERE length(line) BETWEEN 3 AND 80 AND NOT regexp_matches(line, '[.,;]$') AND (
  (trim(after) = '' AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 3 AND regexp_replace(line, '[^A-Za-z]', '', 'g') = upper(regexp_replace(line, '[^A-Za-z]', '', 'g')))
  OR regexp_matches(line, '(?i)^(chapter|section|part|appendix)\s+[0-9ivx]+'))"""
)
def heading_like_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = plain_text.split_lines(table(spark, sf, "documents"), "doc_id")
    after = F.coalesce(F.lead("line").over(Window.partitionBy("doc_id").orderBy("n")), F.lit(""))
    lines = lines.withColumns({"after": after, "line": md.trim("line")})
    return lines.where(plain_text.heading_like(F.col("line"), md.is_blank("after"))).select("doc_id", "n", "line")


_PROSE = _s(_BLOCK, r"regexp_replace(trim(array_to_string(list(t ORDER BY n), ' ')), '\s+', ' ', 'g')")


@query(
    rf"""
WITH l AS (SELECT doc_id, i AS n, trim(string_split(text, chr(10))[i + 1]) AS t, coalesce(trim(string_split(text, chr(10))[i + 2]), '') AS after
           FROM documents, unnest(range(0, len(string_split(text, chr(10))))) x(i)),
u AS (SELECT *, regexp_replace(t, '[^A-Za-z]', '', 'g') AS a FROM l),
k AS (SELECT *, CASE WHEN t = '' THEN 'blank'
        WHEN length(t) BETWEEN 3 AND 80 AND NOT regexp_matches(t, '[.,;]$') AND ((after = '' AND length(a) >= 3 AND a = upper(a)) OR regexp_matches(t, '(?i)^(chapter|section|part|appendix)\s+[0-9ivx]+')) THEN 'heading'
        ELSE 'prose' END AS kind FROM u),
g AS (SELECT *, sum(CASE WHEN kind = 'prose' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY n) IS NOT DISTINCT FROM 'prose' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM
      (SELECT *, 1 AS one FROM k)),
b AS (SELECT doc_id, block, min(kind) AS kind, CASE WHEN min(kind) = 'heading' THEN (CASE WHEN length(min(t)) < 40 THEN '## ' ELSE '### ' END) || regexp_replace(min(t), ' {{2,}}', ' ', 'g') ELSE {_PROSE} END AS txt
      FROM g WHERE kind <> 'blank' GROUP BY doc_id, block)
SELECT d.doc_id, coalesce({_s(_NORMAL, "m.md")}, '') AS markdown
FROM documents d LEFT JOIN (SELECT doc_id, string_agg(txt, chr(10) || chr(10) ORDER BY block) AS md FROM b GROUP BY doc_id) m ON d.doc_id = m.doc_id""".replace(
        "sum(CASE WHEN kind = 'prose' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY n) IS NOT DISTINCT FROM 'prose' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM\n      (SELECT *, 1 AS one FROM k)",
        "sum(CASE WHEN kind = 'prose' AND before = 'prose' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM\n      (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') AS before FROM k)",
    )
)
def doc_plain_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return plain_text.to_markdown(table(spark, sf, "documents"))


@query(f"SELECT doc_id, {_s(_YAML, 'text')} AS scalar FROM documents")
def yaml_quote(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.yaml_scalar("text").alias("scalar"))


@query(f"SELECT p_partkey, '---' || chr(10) || 'title: ' || {_s(_YAML, 'p_name')} || chr(10) || 'brand: ' || {_s(_YAML, 'p_brand')} || chr(10) || 'size: ' || {_s(_YAML, 'CAST(p_size AS VARCHAR)')} || chr(10) || '---' AS front FROM part")
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (("title", "p_name"), ("brand", "p_brand"), ("size", "p_size"))), F.struct(F.lit("none").alias("k"), F.lit("").alias("v")))
    return table(spark, sf, "part").select("p_partkey", md.front_matter(entries).alias("front"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN NULL ELSE array_to_string(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda l: CASE WHEN l = '' THEN '>' ELSE '> ' || l END), chr(10)) END AS quoted FROM documents")
def doc_quote(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.quote("text").alias("quoted"))


@query("SELECT doc_id, '```txt' || chr(10) || regexp_replace(text, '\\n+$', '') || chr(10) || '```' AS code FROM documents")
def doc_code_block(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", md.code_block("text", F.lit("txt")).alias("code"))


# -------------------------------------------------------------------- names


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '\.[^.]+$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def title_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", md.title_from_name("url").alias("title"))


@query(r"SELECT page_id, CASE WHEN regexp_replace(url, '\.[^.]+$', '') = '' THEN 'document' ELSE regexp_replace(url, '\.[^.]+$', '') END || '.md' AS name FROM pages")
def output_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", md.output_name("url").alias("name"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(n, '(?i)\.(md|markdown|mdown|mkd|mdx)$') THEN n ELSE n || '.md' END AS name FROM
(SELECT page_id, CASE WHEN c = '' THEN 'Untitled' ELSE c END AS n FROM (SELECT page_id, left(trim(regexp_replace(trim(url), '[/\\<>:"|?*\x00-\x1F]', '', 'g')), 120) AS c FROM pages))""")
def normalise_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", md.library_name("url").alias("name"))


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY regexp_replace(c_name, '[0-9]+$', ''), CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) AS INTEGER) AS place FROM customer")
def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places by natural order; a range shuffle and partition offsets would replace the window where only the order is asked for."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", md.natural_key("c_name").alias("k"))
    return c.withColumn("place", F.row_number().over(Window.orderBy("k"))).select("c_custkey", "c_name", "place")


_NAMED = "SELECT p_partkey AS id, p_brand || '.md' AS name FROM part"


@query(f"SELECT id, name, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.md$', '') || ' ' || k || '.md' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS k FROM ({_NAMED}))")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".md")).alias("name"))
    return library.unique_names(named, "name", "id")


@query(f"SELECT id, name, CASE WHEN k = 1 THEN name ELSE regexp_replace(name, '\\.md$', '') || '-' || k || '.md' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM ({_NAMED}))")
def zip_names(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".md")).alias("name"))
    return library.unique_names(named, "name", "id", spaced=False)


@query("SELECT o_orderkey, CASE WHEN v < 1024 THEN printf('%d B', v) WHEN v < 1048576 THEN printf('%.1f KB', v / 1024.0) ELSE printf('%.1f MB', v / 1048576.0) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) * 2 + 1 AS v FROM orders)")
def size_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 40) * 2 + 1
    return table(spark, sf, "orders").select("o_orderkey", md.format_bytes(n).alias("size"))


@query("SELECT o_orderkey, CASE WHEN v >= 1000000 THEN printf('%.1f MB', v / 1000000.0) ELSE printf('%d KB', greatest(1, CAST(floor(v / 1000.0 + 0.5) AS BIGINT))) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) + 1 AS v FROM orders)")
def picture_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 40) + 1
    return table(spark, sf, "orders").select("o_orderkey", md.describe_size(n).alias("size"))


@query("SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS uri FROM pages")
def page_data_uri(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", md.data_uri(F.encode("html", "utf-8"), F.lit("text/html")).alias("uri"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(ts) AS newest, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def library_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of each document of a version log."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# -------------------------------------------------------------------- tables


def _table_sql(src: str, key: str, order: str, cols: list[tuple[str, bool]]) -> str:
    """Aligned tables in SQL: src's columns as text, right-aligned where the flag says so."""
    names = [c for c, _ in cols]
    esc = lambda c: _s(_ESC, f"trim(coalesce(CAST({c} AS VARCHAR), ''))")
    width = ", ".join(f"greatest(3, length('{md_escape(c)}'), max(length({esc(c)}))) AS w_{i}" for i, c in enumerate(names))
    head = " || ' | ' || ".join(f"rpad('{md_escape(c)}', CAST(w_{i} AS INTEGER), ' ')" for i, c in enumerate(names))
    rule = " || ' | ' || ".join(f"repeat('-', CAST(greatest(2, w_{i} - 1) AS INTEGER)) || ':'" if right else f"repeat('-', CAST(w_{i} AS INTEGER))" for i, (_, right) in enumerate(cols))
    row = " || ' | ' || ".join(f"rpad({esc(c)}, CAST(w_{i} AS INTEGER), ' ')" for i, c in enumerate(names))
    return f"""WITH s AS ({src}), w AS (SELECT {key}, {width} FROM s GROUP BY {key})
SELECT s.{key}, '| ' || min({head}) || ' |' || chr(10) || '| ' || min({rule}) || ' |' || chr(10) || string_agg('| ' || {row} || ' |', chr(10) ORDER BY {order}) AS markdown
FROM s JOIN w ON s.{key} = w.{key} GROUP BY s.{key}"""


def md_escape(s: str) -> str:
    return s.replace("_", "\\_")


@query(_table_sql("SELECT n_regionkey, n_nationkey, n_name FROM nation", "n_regionkey", "n_nationkey", [("n_nationkey", True), ("n_name", False)]))
def nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    cells = tables.to_cells(table(spark, sf, "nation"), ["n_regionkey"], ["n_nationkey"], ["n_nationkey", "n_name"])
    return tables.render_tables(cells, ["n_regionkey"], tables.infer_alignment(cells, ["n_regionkey"]))


@query(_table_sql("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders", "o_custkey", "o_orderkey", [("o_orderkey", True), ("o_orderstatus", False), ("o_orderpriority", False)]))
def order_tables(spark: SparkSession, sf: str) -> DataFrame:
    cells = tables.to_cells(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return tables.render_tables(cells, ["o_custkey"], tables.infer_alignment(cells, ["o_custkey"]))


@query("SELECT c_nationkey, col, CAST(min(CASE WHEN regexp_matches(trim(v), '^[-+]?[0-9.,]+%?$') AND regexp_matches(v, '[0-9]') THEN 1 ELSE 0 END) AS BOOLEAN) AS right FROM (SELECT c_nationkey, unnest([0, 1, 2]) AS col, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS v FROM customer) GROUP BY c_nationkey, col")
def csv_alignment(spark: SparkSession, sf: str) -> DataFrame:
    cells = tables.to_cells(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return tables.infer_alignment(cells, ["c_nationkey"])


_DELIMITER = """
WITH l AS (SELECT doc_id, i, string_split(left(text, 8192), chr(10))[i] AS line FROM documents, unnest(range(1, least(20, len(string_split(left(text, 8192), chr(10)))) + 1)) x(i)),
b AS (SELECT doc_id, regexp_replace(line, '"(?:[^"]|"")*("|$)', '', 'g') AS line FROM l),
c AS (SELECT doc_id, o, d, CAST(length(line) - length(replace(line, d, '')) AS DOUBLE) AS n FROM b, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) v(o, d)),
s AS (SELECT doc_id, o, d, avg(n) * count(*) - 2 * var_pop(n) AS score FROM c WHERE n > 0 GROUP BY doc_id, o, d),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, o) AS k FROM s WHERE score > -1)
SELECT documents.doc_id, coalesce(d, ',') AS delimiter FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id AND k = 1"""


@query(_DELIMITER)
def csv_delimiter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tables.sniff_delimiter("text").alias("delimiter"))


@query("SELECT l_returnflag, count(*) AS n_rows, max(row) AS last_row FROM (SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS row FROM lineitem) WHERE row < 5000 GROUP BY l_returnflag")
def csv_rowcap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("row", F.row_number().over(Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber")) - 1)
    cells = rows.select("l_returnflag", "row", F.lit(0).alias("col"), F.col("l_orderkey").cast("string").alias("value"))
    return tables.delimited_cells(cells, ["l_returnflag"]).groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.max("row").cast("long").alias("last_row"))


@query("SELECT event_type, k AS name, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY event_type, k")
def jsonl_table_columns(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.col("event_id").alias("row"), F.col("props").alias("json"))
    cells = tables.record_cells(e, ["event_type"])
    heads = cells.where("row = -1").select("event_type", "col", F.col("value").alias("name"))
    filled = cells.where("row >= 0").groupBy("event_type", "col").agg(F.count("*").alias("n_rows"))
    return heads.join(filled, ["event_type", "col"]).select("event_type", "name", "n_rows")


@query("SELECT event_id, k AS name, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def event_json_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.lit(0).alias("row"), F.col("props").alias("json"))
    cells = tables.record_cells(e, ["event_id"])
    heads = cells.where("row = -1").select("event_id", "col", F.col("value").alias("name"))
    return cells.where("row = 0").join(heads, ["event_id", "col"]).select("event_id", "name", "value")


@query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS INTEGER), '%Y-%m-%d') AS day, strftime(date_trunc('second', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 SECOND * ((o_orderkey % 86399) + 1)), '%Y-%m-%d %H:%M:%S') AS moment FROM orders")
def excel_serial_dates(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).cast("double")
    part = ((F.col("o_orderkey") % 86399) + 1) / F.lit(86400.0)
    return table(spark, sf, "orders").select("o_orderkey", md.excel_serial(days).alias("day"), md.excel_serial(days + part).alias("moment"))


# -------------------------------------------------------------------- layout

_LINES = "SELECT source AS doc, doc_id AS page, i AS n, string_split(text, chr(10))[i + 1] AS line FROM documents, unnest(range(0, len(string_split(text, chr(10))))) x(i)"
RUNNING_SHARE = 0.02


@query(
    f"""
WITH l AS ({_LINES}),
e AS (SELECT doc, page, n, CAST(CAST(floor(n * 12 / 6.0 + 0.5) AS BIGINT) AS VARCHAR) || '|' || left(regexp_replace(lower(line), '[0-9]+', '#', 'g'), 60) AS print,
  row_number() OVER (PARTITION BY doc, page ORDER BY n) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY n DESC) AS b FROM l),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM l GROUP BY doc),
c AS (SELECT doc, print, count(DISTINCT page) AS k FROM e WHERE a <= 2 OR b <= 2 GROUP BY doc, print)
SELECT e.doc, e.page, CAST(e.n AS INTEGER) AS n, e.print FROM e JOIN p ON e.doc = p.doc JOIN c ON e.doc = c.doc AND e.print = c.print
WHERE (a <= 2 OR b <= 2) AND pages >= 3 AND k >= greatest(3, ceil(pages * {RUNNING_SHARE}))"""
)
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A source as a document, its documents as pages; the share is low, as no source repeats a line on most of its pages."""
    lines = plain_text.split_lines(table(spark, sf, "documents").withColumnRenamed("doc_id", "page"), "page")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("doc"))
    lines = lines.join(docs, "page").select("doc", "page", "n", layout.fingerprint(F.col("n") * 12, F.col("line")).alias("print"))
    return layout.running_lines(lines, share=RUNNING_SHARE)


@query("SELECT doc, body FROM (SELECT l_orderkey AS doc, floor(l_quantity * 2 + 0.5) / 2 AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(length(l_returnflag) * l_linenumber) DESC, min(l_linenumber), floor(l_quantity * 2 + 0.5) / 2) AS k FROM lineitem GROUP BY l_orderkey, floor(l_quantity * 2 + 0.5) / 2) WHERE k = 1")
def weighted_body_size(spark: SparkSession, sf: str) -> DataFrame:
    return layout.body_sizes(_sized(spark, sf), "doc", "size", "weight", "n")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as lines of documents: quantity as size."""
    # Orders hold a line number more than once, so sizes break a tie between two sizes first seen at the same place.
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("n"), (F.length("l_returnflag") * F.col("l_linenumber")).alias("weight"))


@query(
    """WITH b AS (SELECT doc, body FROM (SELECT l_orderkey AS doc, floor(l_quantity * 2 + 0.5) / 2 AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY sum(length(l_returnflag) * l_linenumber) DESC, min(l_linenumber), floor(l_quantity * 2 + 0.5) / 2) AS k FROM lineitem GROUP BY l_orderkey, floor(l_quantity * 2 + 0.5) / 2) WHERE k = 1),
s AS (SELECT DISTINCT l_orderkey AS doc, floor(l_quantity * 2 + 0.5) / 2 AS size FROM lineitem)
SELECT doc, size, CAST(level AS INTEGER) AS level FROM (SELECT s.doc, size, row_number() OVER (PARTITION BY s.doc ORDER BY size DESC) AS level FROM s JOIN b ON s.doc = b.doc WHERE size > body * 1.08) WHERE level <= 6"""
)
def heading_levels(spark: SparkSession, sf: str) -> DataFrame:
    lines = _sized(spark, sf)
    return layout.heading_sizes(lines, layout.body_sizes(lines, "doc", "size", "weight", "n"), "doc", "size")


@query("SELECT doc, coalesce(median(CASE WHEN g > 0 THEN g END), CAST(12.0 AS DOUBLE) * CAST(1.2 AS DOUBLE)) AS gap FROM (SELECT l_orderkey AS doc, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_quantity AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem)) GROUP BY doc")
def median_gap(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("y"))
    return layout.median_gaps(lines, ["doc"], "y", "n", F.lit(12.0))


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND turn <> min(turn) OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, '' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role"""
)
def run_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as runs, the role as their format."""
    return layout.merge_runs(table(spark, sf, "conversations"), ["conv_id"], "turn", ["role"])


_LEVELS = "SELECT l_orderkey AS doc, l_linenumber AS n, min(CAST(l_quantity AS INTEGER) % 3) AS level, min(CAST(l_quantity AS INTEGER) % 7) <> 0 AS item FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(
    f"""WITH i AS ({_LEVELS}),
e AS (SELECT *, coalesce((SELECT max(j.n) FROM i j WHERE j.doc = i.doc AND j.n <= i.n AND (NOT j.item OR j.level < i.level)), -1) AS island FROM i)
SELECT doc, n, level, item, CASE WHEN item THEN CAST(row_number() OVER (PARTITION BY doc, item, level, island ORDER BY n) AS INTEGER) ELSE 0 END AS number FROM e"""
)
def list_numbering(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min(q % 3).alias("level"), (F.min(q % 7) != 0).alias("item"))
    return layout.list_numbers(items, ["doc"], "n", "level", "item")


# --------------------------------------------------------------------- pages


@query()
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return pages_plan.convert(table(spark, sf, "pages")).drop("meta")


@query()
def page_document(spark: SparkSession, sf: str) -> DataFrame:
    return pages_plan.with_front_matter(pages_plan.convert(table(spark, sf, "pages")))


@query()
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages_plan.links(pages_plan.convert(table(spark, sf, "pages")))


@query()
def page_contents(spark: SparkSession, sf: str) -> DataFrame:
    return library.contents(pages_plan.convert(table(spark, sf, "pages")), "page_id")


@query(r"SELECT page_id, replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), ' {2,}', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return pages_plan.convert(table(spark, sf, "pages")).select("page_id", "title")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, '| | |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || " + _s(_ESC, "replace(text, chr(10), ' ')") + " || ' |', chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def conversation_tables(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("| "), "role", F.lit(" | "), md.escape_inline(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit(" |")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.concat(F.lit("| | |\n| --- | --- |\n"), body).alias("markdown"))


# --------------------------------------------------------------------- files


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and texts as files of a folder would be read."""
    pages = table(spark, sf, "pages").select(F.format_string("page-%d.html", "page_id").alias("name"), F.encode("html", "utf-8").alias("content"))
    texts = table(spark, sf, "documents").select(F.format_string("text-%d.txt", "doc_id").alias("name"), F.encode("text", "utf-8").alias("content"))
    return pages.unionByName(texts).withColumn("length", F.octet_length("content").cast("long"))


@query(
    """SELECT name, CASE WHEN ext = 'html' OR starts_with(h, '<!doctype html') OR starts_with(h, '<html') OR contains(h, '<body') THEN 'html'
  WHEN starts_with(h, 'from:') OR starts_with(h, 'received:') OR starts_with(h, 'return-path:') OR starts_with(h, 'mime-version:') THEN 'eml' ELSE 'text' END AS format FROM
(SELECT 'page-' || page_id || '.html' AS name, 'html' AS ext, lower(ltrim(left(html, 1024))) AS h FROM pages UNION ALL SELECT 'text-' || doc_id || '.txt', 'txt', lower(ltrim(left(text, 1024))) FROM documents)"""
)
def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    return convert_plan.detected(_as_files(spark, sf))


@query()
def file_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Files to documents with front matter, whatever their format."""
    return convert_plan.convert_files(_as_files(spark, sf)).select("name", "format", "output_name", "word_count", "image_count", "document", "error")


@query()
def markdown_archives(spark: SparkSession, sf: str) -> DataFrame:
    """The converted pages as archives of at most a thousand files."""
    files = _as_files(spark, sf).where(F.col("name").startswith("page-"))
    return sinks.archives(convert_plan.convert_files(files)).select("archive", F.octet_length("content").alias("n_bytes"))


# -------------------------------------------------- containers, made and read back

_REGIONS = "SELECT r_regionkey AS k, " + _s(_ESC, "r_name") + " AS h, n_nationkey AS i, CAST(n_nationkey AS VARCHAR) AS c, " + _s(_ESC, "n_name") + " AS v, lower(" + _s(_ESC, "n_name") + ") AS low, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey"
_HEAD = r"'| ' || rpad('n\_nationkey', CAST(max(w0) AS INTEGER), ' ') || ' | ' || rpad('n\_name', CAST(max(w1) AS INTEGER), ' ') || ' |'"
_RULE = "'| ' || repeat('-', CAST(max(w0) AS INTEGER)) || ' | ' || repeat('-', CAST(max(w1) AS INTEGER)) || ' |'"
_BLANK = "'| ' || repeat(' ', CAST(max(w0) AS INTEGER)) || ' | ' || repeat(' ', CAST(max(w1) AS INTEGER)) || ' |'"
_ROWS = "string_agg('| ' || rpad(c, CAST(w0 AS INTEGER), ' ') || ' | ' || rpad(v, CAST(w1 AS INTEGER), ' ') || ' |', chr(10) ORDER BY i)"
_NL, _GAP = "chr(10)", "chr(10) || chr(10)"
_SENTENCE = "'Nation ' || v || ' has the key ' || c || '.'"
_NAMES = ("n_nationkey", "n_name")

# Format: how a region (its name, its nations) becomes a file, and its Markdown in SQL.
_CONTAINERS = {
    "docx": (lambda h, rows: samples.docx(h, [v for _, v in rows], [_NAMES, *rows]), f"'# ' || min(h) || {_GAP} || string_agg(n || '. ' || v, {_NL} ORDER BY i) || {_GAP} || {_HEAD} || {_NL} || {_RULE} || {_NL} || {_ROWS} || {_NL}"),
    "xlsx": (lambda h, rows: samples.xlsx(h, [_NAMES, *rows]), f"{_HEAD} || {_NL} || {_RULE} || {_NL} || {_ROWS} || {_NL}"),
    "pptx": (lambda h, rows: samples.pptx(h, [v for _, v in rows]), f"'## ' || min(h) || {_GAP} || string_agg(CASE WHEN n % 2 = 1 THEN '- ' ELSE '  - ' END || v, {_NL} ORDER BY i) || {_NL}"),
    "odt": (lambda h, rows: samples.odt(h, [v for _, v in rows], [_NAMES, *rows]), f"'## ' || min(h) || {_GAP} || string_agg('- ' || v, {_NL} ORDER BY i) || {_GAP} || {_BLANK} || {_NL} || {_RULE} || {_NL} || {_HEAD} || {_NL} || {_ROWS} || {_NL}"),
    "epub": (lambda h, rows: samples.epub(h, [v for _, v in rows]), f"string_agg('# ' || v || {_GAP} || 'About *' || low || '*', {_GAP} || '---' || {_GAP} ORDER BY i) || {_NL}"),
    "rtf": (lambda h, rows: samples.rtf(h, [f"Nation {v} has the key {c}." for c, v in rows]), f"'# ' || min(h) || {_GAP} || string_agg(replace({_SENTENCE}, 'Nation ', '**Nation** '), {_GAP} ORDER BY i) || {_NL}"),
    "eml": (lambda h, rows: samples.eml(h, "post@example.org", [v for _, v in rows]), f"'# ' || min(h) || {_GAP} || '| Field | Value            |' || {_NL} || '| ----- | ---------------- |' || {_NL} || '| From  | post@example.org |' || {_GAP} || string_agg('- ' || v, {_NL} ORDER BY i) || {_NL}"),
    "pdf": (lambda h, rows: samples.pdf(h, [f"Nation {v} has the key {c}." for c, v in rows]), f"'# ' || min(h) || {_GAP} || string_agg({_SENTENCE}, ' ' ORDER BY i) || {_NL}"),
}


def _container_query(kind: str, build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def files(batches):
        import pandas as pd

        for batch in batches:
            made = [build(h, [(str(x["n_nationkey"]), x["n_name"]) for x in rows]) for h, rows in zip(batch["r_name"], batch["rows"], strict=True)]
            yield pd.DataFrame({"name": [f"region-{k}.{kind}" for k in batch["r_regionkey"]], "content": made})

    def run(spark: SparkSession, sf: str) -> DataFrame:
        regions = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
        regions = regions.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
        made = regions.mapInPandas(files, "name string, content binary").withColumn("length", F.octet_length("content").cast("long"))
        found = convert_plan.convert_files(made)
        return found.select(F.regexp_extract("name", "([0-9]+)", 1).cast("int").alias("r_regionkey"), "format", "markdown")

    return run


for _kind, (_build, _markdown) in _CONTAINERS.items():
    QUERIES[f"{_kind}_regions"] = _container_query(_kind, _build)
    ORACLES[f"{_kind}_regions"] = f"""WITH s AS ({_REGIONS}),
t AS (SELECT *, greatest(12, max(length(c)) OVER (PARTITION BY k)) AS w0, greatest(7, max(length(v)) OVER (PARTITION BY k)) AS w1 FROM s)
SELECT k AS r_regionkey, '{'odf' if _kind == 'odt' else _kind}' AS format, {_markdown} AS markdown FROM t GROUP BY k"""
