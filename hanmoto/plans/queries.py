"""Registered queries of the engine and the same in SQL. The driver's tables hold no notation, so it is put together from their columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions import text as X
from ..operators import conformance, lookup, parse, pattern, render, stats, trace, wire
from ..sources import corpus, packed
from ..streaming import packing, watch
from .fixed_cases import FIXED_CASES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function by its name, with its SQL if there is one; ``@class-`` and ``@element_`` in it are the output's prefixes."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("@class-", V.CLASS_PREFIX).replace("@element_", V.ELEMENT_PREFIX)
        return f

    return of


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d, source="text") -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.expr(source).alias("source"))


def customers(spark, d) -> DataFrame:
    """``｜name《segment》`` after a letter."""
    return t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment", F.concat(F.lit("x｜"), "c_name", F.lit("《"), "c_mktsegment", F.lit("》")).alias("source"))


def parts_with(spark, d, source) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_size", source.alias("source"))


def _new_folder(spark, name) -> str:
    """A path that isn't there yet in the shared folder; in a temporary one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def lit(x):
    return F.lit(x)


# Tokens


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\n|[^\\n]+')) AS BIGINT) AS n_tokens, CAST(len(text) - len(replace(text, chr(10), '')) AS BIGINT) AS n_newlines, CAST(octet_length(encode(text)) AS BIGINT) AS last_end FROM documents WHERE text <> ''")
def document_tokens(spark, d):
    """Byte spans of all tokens of all documents."""
    found = parse.tokens(documents(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("token_kind") == "newline").alias("n_newlines"), F.max("end").cast("long").alias("last_end"))


@query("""WITH k AS (SELECT * FROM (VALUES ('text', NULL, 3), ('trigger', 'bar', 1), ('trigger', 'rubyOpen', 1), ('trigger', 'rubyClose', 1)) AS v(token_kind, trigger_kind, times))
SELECT token_kind, trigger_kind, CAST(times * (SELECT count(*) FROM customer) AS BIGINT) AS n FROM k""")
def token_kinds(spark, d):
    return parse.tokens(customers(spark, d).select("doc_id", "source")).groupBy("token_kind", "trigger_kind").agg(F.count("*").alias("n"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, i AS idx, k AS trigger_kind, CAST(s AS BIGINT) AS "start", CAST(s + w AS BIGINT) AS "end" FROM (
SELECT c_custkey, unnest([0, 1, 3, 4]) AS i, unnest(['doubleRubyOpen', 'rubyOpen', 'doubleRubyClose', 'rubyClose']) AS k, unnest([0, 6, 9 + strlen(c_name), 15 + strlen(c_name)]) AS s, unnest([6, 3, 6, 3]) AS w FROM customer)""")
def doubled_tokens(spark, d):
    """Three angle brackets are a doubled and a single one."""
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(lit("《《《"), "c_name", lit("》》》")).alias("source"))
    return parse.tokens(own).filter("token_kind = 'trigger'").select("doc_id", "idx", "trigger_kind", "start", "end")


# Pairs and diagnostics


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 0 AS seq, 'bracket' AS kind, CAST(3 + n AS INTEGER) AS open_start, CAST(6 + n AS INTEGER) AS open_end, CAST(6 + n + m AS INTEGER) AS close_start, CAST(9 + n + m AS INTEGER) AS close_end FROM (SELECT c_custkey, strlen(c_name) AS n, strlen(c_mktsegment) AS m FROM customer)
UNION ALL SELECT c_custkey, 1, 'quote', 0, 3, CAST(9 + n + m AS INTEGER), CAST(12 + n + m AS INTEGER) FROM (SELECT c_custkey, strlen(c_name) AS n, strlen(c_mktsegment) AS m FROM customer)""")
def pair_links(spark, d):
    own = customers(spark, d).select("doc_id", F.concat(lit("「"), "c_name", lit("［"), "c_mktsegment", lit("］」")).alias("source"))
    return parse.pair_links(own)


@query("""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 'unclosed_bracket' AS kind, 'ruby' AS pair_kind, CAST(3 + strlen(s_name) AS INTEGER) AS "start", CAST(6 + strlen(s_name) AS INTEGER) AS "end" FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, 'unmatched_close', 'quote', CAST(3 + strlen(s_name) + 3 + 2 + 3 AS INTEGER), CAST(3 + strlen(s_name) + 3 + 2 + 6 AS INTEGER) FROM supplier WHERE s_suppkey % 3 = 1""")
def pair_diagnostics(spark, d):
    tail = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, "》」").otherwise("》")
    own = t(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(lit("｜"), "s_name", lit("《ab"), tail).alias("source"))
    return parse.diagnostics(own).select("doc_id", "kind", "pair_kind", "start", "end")


# Pairs of three shapes: nested to the depth of the key's last digit, crossing (the inner closer finds another kind on top), and closers alone.
_SHAPES = """WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_custkey % 10 + 1 AS INTEGER) AS n, CAST(strlen(c_name) AS INTEGER) AS m, c_custkey % 3 AS shape FROM customer)"""


def _shapes(spark, d):
    n = (F.col("c_custkey") % 10 + 1).cast("int")
    nested = F.concat(F.repeat(lit("「［"), n), "c_name", F.repeat(lit("］」"), n))
    crossing = F.concat(F.repeat(lit("［"), n), lit("「"), "c_name", F.repeat(lit("］"), n), lit("」"))
    alone = F.concat(F.repeat(lit("」"), n), "c_name", lit("《《"), "c_name", lit("》》"))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, nested).when(F.col("c_custkey") % 3 == 1, crossing).otherwise(alone).alias("source"))


@query(_SHAPES + """ SELECT k AS doc_id, CAST(i AS INTEGER) AS seq, CASE WHEN i % 2 = 0 THEN 'bracket' ELSE 'quote' END AS kind, CAST(6 * n - 3 * i - 3 AS INTEGER) AS open_start, CAST(6 * n + m + 3 * i AS INTEGER) AS close_start FROM x, range(20) AS r(i) WHERE shape = 0 AND i < 2 * n
UNION ALL SELECT k, 0, 'quote', 3 * n, 3 * n + 3 + m + 3 * n FROM x WHERE shape = 1 UNION ALL SELECT k, 0, 'doubleRuby', 3 * n + m, 3 * n + m + 6 + m FROM x WHERE shape = 2""")
def pair_shapes(spark, d):
    return parse.pair_links(_shapes(spark, d)).select("doc_id", "seq", "kind", "open_start", "close_start")


@query(_SHAPES + """ SELECT k AS doc_id, 'unmatched_close' AS kind, 'bracket' AS pair_kind, CAST(i AS INTEGER) AS seq, CAST(3 * n + 3 + m + 3 * i AS INTEGER) AS "start" FROM x, range(10) AS r(i) WHERE shape = 1 AND i < n
UNION ALL SELECT k, 'unclosed_bracket', 'bracket', CAST(n + i AS INTEGER), CAST(3 * (n - 1 - i) AS INTEGER) FROM x, range(10) AS r(i) WHERE shape = 1 AND i < n UNION ALL SELECT k, 'unmatched_close', 'quote', CAST(i AS INTEGER), CAST(3 * i AS INTEGER) FROM x, range(10) AS r(i) WHERE shape = 2 AND i < n""")
def pair_shape_diagnostics(spark, d):
    return parse.diagnostics(_shapes(spark, d)).select("doc_id", "kind", "pair_kind", "seq", "start")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'source_contains_pua' AS kind, 'warning' AS severity, CAST(strlen(n_name) AS INTEGER) AS "start", CAST(strlen(n_name) + 3 AS INTEGER) AS "end", chr(57345 + n_nationkey % 4) AS codepoint FROM nation""")
def private_use_diagnostics(spark, d):
    mark = X.from_code(F.col("n_nationkey").cast("long") % 4 + 0xE001)
    own = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat("n_name", mark).alias("source"))
    return parse.diagnostics(own).select("doc_id", "kind", "severity", "start", "end", "codepoint")


@query("""WITH x AS (SELECT c_custkey, strlen(c_name) AS n, strlen(c_mktsegment) AS m FROM customer)
SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'plain' AS span_kind, 0 AS "start", 1 AS "end" FROM x UNION ALL SELECT c_custkey, 'node', 1, CAST(10 + n + m AS INTEGER) FROM x""")
def span_tiles(spark, d):
    return parse.spans(customers(spark, d).select("doc_id", "source")).select("doc_id", "span_kind", "start", "end")


# Nodes


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'ruby' AS kind, CAST(1 AS INTEGER) AS "start", CAST(10 + strlen(c_name) + strlen(c_mktsegment) AS INTEGER) AS "end", CAST(1 AS INTEGER) AS norm_pos, c_name AS base, c_mktsegment AS reading, true AS explicit FROM customer""")
def ruby_explicit_spans(spark, d):
    n = parse.nodes(customers(spark, d).select("doc_id", "source"))
    return n.select("doc_id", "kind", "start", "end", "norm_pos", n.attrs.base[0].text.alias("base"), n.attrs.reading[0].text.alias("reading"), n.attrs.explicit.alias("explicit"))


@query("""SELECT r_name, count(*) AS n_ruby, CAST(sum(strlen(r_name)) AS BIGINT) AS reading_bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def ruby_counts_by_region(spark, d):
    own = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = parse.parse(own.select("r_name", F.concat(lit("｜"), "n_name", lit("《"), "r_name", lit("》")).alias("source")), ["nodes"])
    each = found.select("r_name", F.explode("parsed.nodes").alias("n")).filter("n.kind = 'ruby'")
    return each.groupBy("r_name").agg(F.count("*").alias("n_ruby"), F.sum(F.octet_length(F.col("n.attrs.reading")[0]["text"])).alias("reading_bytes"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, '漢字' AS base, p_brand AS reading, false AS explicit, '｜漢字《' || p_brand || '》' AS serialized FROM part""")
def ruby_implicit(spark, d):
    """The trailing characters that may carry a reading; written back with an explicit bar."""
    own = parts_with(spark, d, F.concat(lit("漢字《"), "p_brand", lit("》")))
    p = parse.parse(own.select("doc_id", "source"), ["nodes", "serialized"])
    n = F.col("parsed.nodes")[0]["attrs"]
    return p.select("doc_id", n["base"][0]["text"].alias("base"), n["reading"][0]["text"].alias("reading"), n["explicit"].alias("explicit"), F.col("parsed.serialized").alias("serialized"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, p_brand AS content, '<p><span class="@class-double-ruby">≪' || p_brand || '≫</span></p>' || chr(10) AS html FROM part""")
def double_ruby(spark, d):
    own = parts_with(spark, d, F.concat(lit("《《"), "p_brand", lit("》》")))
    p = parse.parse(own.select("doc_id", "source"), ["nodes", "html"])
    return p.select("doc_id", F.col("parsed.nodes")[0]["attrs"]["content"][0]["text"].alias("content"), F.col("parsed.html").alias("html"))


def _forward(spark, d, suffix):
    head = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    own = parts_with(spark, d, F.concat(head, "p_name", lit("［＃「"), "p_brand", lit("」"), suffix, lit("］")))
    return parse.nodes(own.select("doc_id", "source"))


_KEYWORDS = list(V.BOUTEN)


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN contains(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_name, p_brand) THEN 'bouten' ELSE 'annotation' END AS kind,
CASE WHEN contains(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_name, p_brand) THEN (['goma', 'white-sesame', 'circle', 'white-circle', 'double-circle', 'janome', 'cross', 'white-triangle', 'wavy-line', 'under-line', 'double-under-line'])[1 + p_partkey % 11] END AS bouten_kind,
CASE WHEN contains(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_name, p_brand) THEN CASE WHEN p_partkey % 3 = 0 THEN 'left' ELSE 'right' END END AS position FROM part""")
def bouten_forward(spark, d):
    """Emphasis applies only if its target stands before it."""
    side = F.when(F.col("p_partkey") % 3 == 0, "の左に").otherwise("に")
    word = F.get(F.array(*map(lit, _KEYWORDS)), (F.col("p_partkey") % len(_KEYWORDS)).cast("int"))
    n = _forward(spark, d, F.concat(side, word))
    return n.select("doc_id", "kind", n.attrs.bouten_kind.alias("bouten_kind"), n.attrs.position.alias("position"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN contains(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_name, p_brand) THEN 'tateChuYoko' ELSE 'annotation' END AS kind FROM part""")
def tcy_forward(spark, d):
    return _forward(spark, d, lit("は縦中横")).select("doc_id", "kind")


@query("""WITH x AS (SELECT *, contains(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || p_name, p_brand) AS ok FROM part)
SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN ok THEN 'headingHint' ELSE 'annotation' END AS kind, CASE WHEN ok THEN CAST(1 + p_partkey % 3 AS SMALLINT) END AS level, CASE WHEN ok THEN p_brand END AS target FROM x""")
def heading_hints(spark, d):
    size = F.get(F.array(*map(lit, V.HEADINGS)), (F.col("p_partkey") % 3).cast("int"))
    n = _forward(spark, d, F.concat(lit("は"), size))
    return n.select("doc_id", "kind", n.attrs.level.alias("level"), n.attrs.target.alias("target"))


@query("""WITH x AS (SELECT p_partkey, (p_partkey * 7) % 300 AS n FROM part)
SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN n BETWEEN 1 AND 255 THEN 'indent' ELSE 'annotation' END AS kind, CASE WHEN n BETWEEN 1 AND 255 THEN CAST(n AS SMALLINT) END AS amount FROM x""")
def indent_amounts(spark, d):
    own = parts_with(spark, d, F.concat(lit("［＃"), (F.col("p_partkey") * 7 % 300).cast("string"), lit("字下げ］")))
    n = parse.nodes(own.select("doc_id", "source"))
    return n.select("doc_id", "kind", n.attrs.amount.alias("amount"))


@query("""WITH x AS (SELECT p_partkey, (p_partkey * 7) % 300 AS n FROM part)
SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN 'alignEnd' WHEN n BETWEEN 1 AND 255 THEN 'alignEnd' ELSE 'annotation' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN CAST(0 AS SMALLINT) WHEN n BETWEEN 1 AND 255 THEN CAST(n AS SMALLINT) END AS "offset" FROM x""")
def align_ends(spark, d):
    """Full-width digits count too."""
    digits = F.translate((F.col("p_partkey") * 7 % 300).cast("string"), "0123456789", "０１２３４５６７８９")
    own = parts_with(spark, d, F.when(F.col("p_partkey") % 4 == 0, "［＃地付き］").otherwise(F.concat(lit("［＃地から"), digits, lit("字上げ］"))))
    n = parse.nodes(own.select("doc_id", "source"))
    return n.select("doc_id", "kind", n.attrs.offset.alias("offset"))


@query("""SELECT kind, section, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'pageBreak' WHEN 4 THEN 'annotation' ELSE 'sectionBreak' END AS kind, CASE p_partkey % 5 WHEN 1 THEN 'choho' WHEN 2 THEN 'dan' WHEN 3 THEN 'spread' END AS section FROM part) GROUP BY ALL""")
def section_break_counts(spark, d):
    word = F.get(F.array(*map(lit, ["改ページ", "改丁", "改段", "改見開き", "改頁"])), (F.col("p_partkey") % 5).cast("int"))
    n = parse.nodes(parts_with(spark, d, F.concat("p_name", lit("［＃"), word, lit("］"))).select("doc_id", "source"))
    return n.groupBy("kind", n.attrs.section.alias("section")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'kaeriten' AS kind, (['一', '二', '三', '四', '上', '中', '下', '甲', '乙', '丙', '丁', 'レ', '一レ', '二レ', '三レ', '上レ', '中レ', '下レ'])[1 + p_partkey % 18] AS mark FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 7 + 1 <= 6 THEN 'kaeriten' ELSE 'annotation' END, CASE WHEN p_partkey % 7 + 1 <= 6 THEN '（' || repeat('カ', CAST(p_partkey % 7 + 1 AS INT)) || '）' END FROM part WHERE p_partkey % 3 = 0""")
def kaeriten_marks(spark, d):
    """Return marks, and added kana of one to six characters in brackets."""
    mark = F.get(F.array(*map(lit, V.KAERITEN)), (F.col("p_partkey") % len(V.KAERITEN)).cast("int"))
    kana = F.concat(lit("（"), F.repeat(lit("カ"), (F.col("p_partkey") % 7 + 1).cast("int")), lit("）"))
    n = parse.nodes(parts_with(spark, d, F.concat(lit("［＃"), F.when(F.col("p_partkey") % 3 == 0, kana).otherwise(mark), lit("］"))).select("doc_id", "source"))
    return n.select("doc_id", "kind", n.attrs.mark.alias("mark"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'sashie' AS kind, p_brand || '.png' AS file, '<!-- @element_sashie -->' AS html FROM part""")
def pictures(spark, d):
    own = parts_with(spark, d, F.concat(lit("［＃挿絵（"), "p_brand", lit(".png）入る］")))
    p = parse.parse(own.select("doc_id", "source"), ["nodes", "html"])
    n = F.col("parsed.nodes")[0]
    return p.select("doc_id", n["kind"].alias("kind"), n["attrs"]["file"].alias("file"), F.col("parsed.html").alias("html"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, '<p><span class="@class-warichu">' || p_brand || '</span></p>' || chr(10) AS html FROM part""")
def split_notes(spark, d):
    own = parts_with(spark, d, F.concat(lit("［＃割り注］"), "p_brand", lit("［＃割り注終わり］")))
    return parse.parse(own.select("doc_id", "source"), ["html"]).select("doc_id", F.col("parsed.html").alias("html"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, 'gaiji' AS kind, p_brand AS description, chr(CAST(19968 + p_partkey % 20000 AS INT)) AS ucs FROM part""")
def gaiji_u_plus(spark, d):
    own = parts_with(spark, d, F.concat(lit("※［＃「"), "p_brand", lit("」、U+"), F.hex(F.col("p_partkey") % 20000 + 19968), lit("］")))
    n = parse.nodes(own.select("doc_id", "source"))
    return n.select("doc_id", "kind", n.attrs.description.alias("description"), n.attrs.ucs.alias("ucs"))


@query("""WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, '［＃ここから' || (c_custkey % 9) || '字下げ］' AS o, c_name FROM customer)
SELECT doc_id, 0 AS seq, 'indent' AS kind, CAST(doc_id % 9 AS SMALLINT) AS amount, 2 AS open_norm, CAST(9 + strlen(c_name) AS INTEGER) AS close_norm FROM x""")
def container_pairs(spark, d):
    own = customers(spark, d).select("doc_id", F.concat(lit("［＃ここから"), (F.col("doc_id") % 9).cast("string"), lit("字下げ］"), "c_name", lit("［＃ここで字下げ終わり］")).alias("source"))
    return parse.container_pairs(own).drop("offset")


@query("""WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS k, CAST(strlen(c_name) AS INTEGER) AS n, c_custkey % 3 AS shape FROM customer)
SELECT k AS doc_id, 0 AS seq, CASE shape WHEN 0 THEN 'alignEnd' ELSE 'indent' END AS kind, CASE shape WHEN 1 THEN 2 WHEN 2 THEN 3 END AS amount, CASE shape WHEN 2 THEN 16 + n ELSE 9 END AS open_norm, CASE shape WHEN 2 THEN 24 + n ELSE 16 + n END AS close_norm FROM x
UNION ALL SELECT k, 1, 'keigakomi', NULL, 2, 23 + n FROM x WHERE shape < 2""")
def container_shapes(spark, d):
    """Nested containers, crossing ones (a closer ends the last open one of any kind), and a closer and an opener alone."""
    nested = F.concat(lit("［＃罫囲み］［＃ここから地付き］"), "c_name", lit("［＃ここで地付き終わり］［＃罫囲み終わり］"))
    crossing = F.concat(lit("［＃罫囲み］［＃ここから2字下げ］"), "c_name", lit("［＃罫囲み終わり］［＃ここで字下げ終わり］"))
    alone = F.concat(lit("［＃ここで字下げ終わり］［＃罫囲み］"), "c_name", lit("［＃ここから3字下げ］a［＃ここで字下げ終わり］"))
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 == 0, nested).when(F.col("c_custkey") % 3 == 1, crossing).otherwise(alone).alias("source"))
    return parse.container_pairs(own).drop("offset")


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' WHEN 2 THEN 'warichuOpen' ELSE NULL END AS annotation_kind, CASE c_custkey % 4 WHEN 0 THEN '［＃' || c_name || '］' WHEN 1 THEN '［＃］' WHEN 2 THEN '［＃割り注］' END AS raw, c_custkey % 4 <> 3 AS found FROM customer""")
def annotation_kinds(spark, d):
    """Unknown bodies, empty ones, a keyword, and a bracket without its mark, which is text."""
    k = F.col("c_custkey") % 4
    source = F.when(k == 0, F.concat(lit("a［＃"), "c_name", lit("］"))).when(k == 1, F.concat("c_name", lit("［＃］"))).when(k == 2, F.concat("c_name", lit("［＃　割り注 ］"))).otherwise(F.concat(lit("［"), "c_name", lit("］")))
    p = parse.parse(t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), source.alias("source")), ["nodes"])
    node = F.get("parsed.nodes", 0)
    return p.select("doc_id", node["attrs"]["annotation_kind"].alias("annotation_kind"), node["attrs"]["raw"].alias("raw"), node.isNotNull().alias("found"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'text:' || c_name || ' gaiji:x=' || chr(CAST(19968 + c_custkey % 9000 AS INTEGER)) || ' text:' || c_mktsegment || ' annotation:［＃' || c_custkey || '］' AS reading FROM customer""")
def nested_content(spark, d):
    """A reading that holds text, a character by its code point, and an annotation."""
    code = F.hex(F.col("c_custkey") % 9000 + 19968)
    source = F.concat(lit("｜字《"), "c_name", lit("※［＃「x」、U+"), code, lit("］"), "c_mktsegment", lit("［＃"), F.col("c_custkey").cast("string"), lit("］》"))
    p = parse.parse(t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), source.alias("source")), ["nodes"])
    shown = lambda x: F.concat(x["seg_kind"], lit(":"), x["text"], F.coalesce(F.concat(lit("="), x["ucs"]), lit("")))
    return p.select("doc_id", F.array_join(F.transform(F.get("parsed.nodes", 0)["attrs"]["reading"], shown), " ").alias("reading"))


@query("""SELECT node_ref, n FROM (VALUES ('blockClose', 1), ('blockOpen', 1), ('inline', 1)) AS v(node_ref, k), (SELECT count(*) AS n FROM customer)""")
def nodes_by_reference(spark, d):
    own = customers(spark, d).select("doc_id", F.concat(lit("［＃罫囲み］"), "source", lit("［＃罫囲み終わり］")).alias("source"))
    return lookup.count_by_ref(parse.nodes(own))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'ruby:' || c_name AS visited FROM customer""")
def visited_nodes(spark, d):
    n = parse.nodes(customers(spark, d).select("doc_id", "source"))
    return parse.visit(n, {"ruby": lambda df: F.concat(lit("ruby:"), df.attrs.base[0].text)}).select("doc_id", "visited")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 0 AS seq, 'ruby' AS kind, CAST(9 + strlen(n_name) + strlen(r_name) AS INTEGER) AS "end" FROM nation JOIN region ON n_regionkey = r_regionkey""")
def table_function(spark, d):
    parse.register(spark)
    own = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(lit("｜"), "n_name", lit("《"), "r_name", lit("》")).alias("source")).createOrReplaceTempView("_notation_sources")
    return spark.sql("SELECT doc_id, p.seq, p.kind, p.`end` FROM _notation_sources, LATERAL parse_notation(source) p")


# Sanitising and other text functions


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(chr(65279) || chr(65279) || replace(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END) || chr(65279), '^\x{FEFF}+', ''), '\r\n?', chr(10), 'g')) AS clean FROM documents""")
def line_ends_and_marks(spark, d):
    end = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    raw = F.concat(lit("﻿﻿"), F.replace("text", lit("\n"), end), lit("﻿"))
    return t(spark, d, "documents").select("doc_id", F.sha2(X.normalize_line_ends(X.strip_bom(raw)), 256).alias("clean"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || repeat('-', CAST(p_size AS INT)) || chr(10) || 'x' WHEN p_size >= 10 THEN p_name || chr(10) || chr(10) || repeat('=', CAST(p_size AS INT)) || chr(10) || 'x' ELSE p_name || chr(10) || repeat('=', CAST(p_size AS INT)) || chr(10) || 'x' END AS isolated FROM part WHERE p_size % 3 <> 0 OR p_size < 10
UNION ALL SELECT p_partkey, p_name || chr(10) || chr(10) || repeat('-', CAST(p_size AS INT)) || chr(10) || 'x' FROM part WHERE p_size % 3 = 0 AND p_size >= 10""")
def rule_isolation(spark, d):
    rule = F.repeat(F.when(F.col("p_size") % 3 == 0, "-").otherwise("="), F.col("p_size"))
    return parts_with(spark, d, F.concat("p_name", lit("\n"), rule, lit("\nx"))).select("doc_id", X.isolate_rules(F.col("source")).alias("isolated"))


@query("""WITH m AS (SELECT * FROM (VALUES ('`', 'aeinouAEINOU', 768), ('''', 'aceilmnorsuyzACEILMNORSUYZ', 769), ('^', 'aceghijosuACEGHIJOSU', 770), ('~', 'aeinouAEINOU', 771), (':', 'aeiouyAEIOU', 776), ('&', 'auAU', 778), ('_', 'aeiouAEIOU', 772), (',', 'cstCST', 807)) AS v(mark, letters, combining)),
a AS (SELECT base || mark AS digraph, nfc_normalize(base || chr(combining)) AS letter FROM (SELECT mark, combining, unnest(string_split(letters, '')) AS base FROM m)
UNION ALL SELECT * FROM (VALUES ('ae&', 'æ'), ('AE&', 'Æ'), ('oe&', 'œ'), ('OE&', 'Œ'), ('s&', 'ß'), ('d/', 'đ'), ('h/', 'ħ'), ('i/', 'ɨ'), ('l/', 'ł'), ('o/', 'ø'), ('D/', 'Đ'), ('L/', 'Ł'), ('O/', 'Ø')) AS v(digraph, letter))
SELECT digraph, letter AS native, '〔' || letter || n_name || '〕' || digraph AS clean FROM a, nation WHERE n_nationkey = 0""")
def accent_letters(spark, d):
    """Every digraph, inside brackets by the kernel and as a fragment natively; outside brackets it stays."""
    one = t(spark, d, "nation").filter("n_nationkey = 0").select("n_name")
    own = V.table(spark, "accents").join(F.broadcast(one))
    raw = F.concat(lit("〔"), "digraph", "n_name", lit("〕"), "digraph")
    return own.select("digraph", X.decompose(F.col("digraph")).alias("native"), X.sanitize(raw).alias("clean"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2(X.escape_html(F.col("html")), 256).alias("escaped"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\n\n+'), lambda x: trim(x, chr(10))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, sha256(coalesce(array_to_string(list_transform(l, lambda x: '<p>' || replace(x, chr(10), '<br />' || chr(10)) || '</p>' || chr(10)), ''), '')) AS html FROM p""")
def html_plain(spark, d):
    return render.render(t(spark, d, "documents").select("doc_id", F.col("text").alias("source"))).select("doc_id", F.sha2("html", 256).alias("html"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'bouten' AS anywhere, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'annotation' ELSE 'bouten' END AS quoted FROM customer""")
def quoted_targets(spark, d):
    """A name with emphasis after many or few quotes, itself quoted or not: by the plain rule, and by the one that asks for a quote where there are many."""
    many = F.array_join(F.transform(F.sequence(lit(1), F.when(F.col("c_custkey") % 2 == 0, 70).otherwise(10)), lambda i: F.concat(lit("「q"), i.cast("string"), lit("」"))), "")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(lit("「"), "c_name", lit("」"))).otherwise(F.col("c_name"))
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(many, name, lit("［＃「"), "c_name", lit("」に傍点］")).alias("source"))
    both = parse.parse(parse.parse(own, ["nodes"], out="_a"), ["nodes"], out="_b", quoted_from=lookup.QUOTED_FROM, dealt=True)
    return both.select("doc_id", F.element_at("_a.nodes.kind", -1).alias("anywhere"), F.element_at("_b.nodes.kind", -1).alias("quoted"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, true AS anywhere, c_custkey % 3 = 0 AS quoted FROM customer""")
def quoted_targets_precede(spark, d):
    """The same test on columns: names that stand as text or as a quote before a cutoff, among so many quotes that these decide."""
    many = F.array_join(F.transform(F.sequence(lit(1), lit(80)), lambda i: F.concat(lit("「q"), i.cast("string"), lit("」"))), "")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(lit("「"), "c_name", lit("」"))).otherwise(F.col("c_name"))
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(many, name).alias("before"), F.array("c_name").alias("targets"))
    own = own.select("doc_id", "targets", F.octet_length("before").alias("cut"), F.concat("before", lit("「"), F.col("targets")[0], lit("」")).alias("text"))
    both = lookup.targets_precede(lookup.targets_precede(own, "text", "cut", "targets", "anywhere"), "text", "cut", "targets", "quoted", quoted_from=lookup.QUOTED_FROM)
    return both.select("doc_id", "anywhere", "quoted")


@query(r"""SELECT doc_id, sha256(regexp_replace(replace(text, chr(10), repeat(chr(10), CAST(1 + doc_id % 4 AS INT))), '\n\n\n+', chr(10) || chr(10), 'g')) AS serialized FROM documents""")
def serialize_plain(spark, d):
    raw = F.replace("text", lit("\n"), F.repeat(lit("\n"), (F.col("doc_id") % 4 + 1).cast("int")))
    own = render.render(t(spark, d, "documents").select("doc_id", raw.alias("source")), ["serialized"])
    return own.select("doc_id", F.sha2("serialized", 256).alias("serialized"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN '<p><ruby>' || c_name || '<rp>(</rp><rt>x</rt><rp>)</rp></ruby></p>' || chr(10) ELSE '<p>' || c_name || '<br />' || chr(10) || c_mktsegment || '</p>' || chr(10) END AS html,
CASE WHEN c_custkey % 3 = 0 THEN '｜' || c_name || '《x》' ELSE c_name || chr(10) || c_mktsegment END AS serialized FROM customer""")
def render_mixed(spark, d):
    """Texts with and without notation in one table: the plan has both ways."""
    source = F.when(F.col("c_custkey") % 3 == 0, F.concat(lit("｜"), "c_name", lit("《x》"))).otherwise(F.concat("c_name", lit("\n"), "c_mktsegment"))
    return render.render(t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), source.alias("source")), ["html", "serialized"]).drop("source")


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE WHEN c_custkey % 2 = 1 THEN '漢《' || c_name || '》' ELSE '｜漢《' || c_name || '》' END AS source, '｜漢《' || c_name || '》' AS serialized, c_custkey % 2 = 1 AS changed FROM customer""")
def format_check(spark, d):
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(F.when(F.col("c_custkey") % 2 == 1, "").otherwise("｜"), lit("漢《"), "c_name", lit("》")).alias("source"))
    return corpus.format_check(own)


@query("""SELECT CAST(p_partkey AS BIGINT) AS doc_id, CASE WHEN CAST(2 AS INT) + p_size <= strlen(p_name) THEN left(p_name, 2) || p_brand || substr(p_name, CAST(3 + p_size AS INT)) END AS edited FROM part""")
def edits(spark, d):
    own = t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", lit(2).alias("s"), (F.col("p_size") + 2).alias("e"))
    return parse.edit(own, "s", "e", "p_brand", "p_name").select("doc_id", F.col("p_name").alias("edited"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN length(p_name) > 10 THEN left(p_name, 9) || '…' ELSE p_name END AS cut, repeat('█', CAST(round(CAST(p_size AS DOUBLE) / 50 * 20) AS INT)) AS bar, '第' || (p_partkey % 2 + 3) || '水準' || (p_partkey % 2 + 1) || '-' || (p_size) || '-5' AS mencode,
CASE WHEN p_partkey % 2 = 0 THEN '0x' || lower(to_hex(p_partkey)) ELSE p_name END AS label, CASE WHEN (p_partkey * 7) % 300 < 256 THEN CAST((p_partkey * 7) % 300 AS SMALLINT) END AS u8,
upper(printf('U+%04x', CAST(19968 + p_partkey % 20000 AS INT))) AS points, CASE WHEN strlen(p_name) < 51200 THEN 'small' END AS band FROM part""")
def text_functions(spark, d):
    k = F.col("p_partkey")
    return t(spark, d, "part").select(
        k.alias("k"), X.truncate(F.col("p_name"), 10).alias("cut"), X.bar(F.col("p_size"), lit(50), 20).alias("bar"), X.mencode(k % 2 + 1, F.col("p_size"), lit(5)).alias("mencode"),
        X.frame_label(F.when(k % 2 == 1, F.col("p_name")), k).alias("label"), X.parse_u8(F.concat((k * 7 % 300).cast("string"), lit("字"))).alias("u8"),
        X.code_points(X.from_code(k % 20000 + 19968)).alias("points"), X.size_band(F.octet_length("p_name")).alias("band"),
    )


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS seconds, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS day, CAST(epoch_us(o_orderdate) * 1000 AS BIGINT) AS ns FROM orders""")
def time_functions(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(text, lit("x"))).otherwise(text)
    at = F.col("o_orderdate")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), X.parse_rfc3339_z(raw).alias("seconds"), X.epoch_day(F.year(at), F.month(at), F.day(at)).alias("day"), X.mtime_ns(at.cast("timestamp")).alias("ns"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS k, CASE c_custkey % 4 WHEN 0 THEN 'あ' WHEN 1 THEN 'é' WHEN 2 THEN NULL ELSE c_name END AS source, CASE c_custkey % 4 WHEN 0 THEN 'あ' WHEN 3 THEN c_name END AS strict FROM customer""")
def decoded_bytes(spark, d):
    """Shift_JIS, else UTF-8, else nothing. (The bytes of é aren't Shift_JIS here because of the one that follows.)"""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.unhex(lit("82A0"))).when(k == 1, F.unhex(lit("C3A9FD"))).when(k == 2, F.unhex(lit("FFFE82"))).otherwise(F.encode("c_name", "UTF-8"))
    raw = F.when(k == 1, F.encode(lit("é"), "UTF-8")).otherwise(raw)
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), raw.alias("content"))
    return own.select("k", F.when(k1(own) == 1, corpus.decode(F.col("content"), "utf8")).otherwise(corpus.decode(F.col("content"))).alias("source"), F.when(k1(own) != 1, corpus.decode(F.col("content"), "sjis")).alias("strict"))


def k1(df):
    return df["k"] % 4


# Projections


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, '{"schema_version":1,"data":[{"kind":"ruby","span":{"start":1,"end":' || (10 + strlen(c_name) + strlen(c_mktsegment)) || '}}]}' AS nodes_json,
'{"schema_version":1,"data":[{"kind":"ruby","open":{"start":' || (4 + strlen(c_name)) || ',"end":' || (7 + strlen(c_name)) || '},"close":{"start":' || (7 + strlen(c_name) + strlen(c_mktsegment)) || ',"end":' || (10 + strlen(c_name) + strlen(c_mktsegment)) || '}}]}' AS pairs_json, '{"schema_version":1,"data":[]}' AS diagnostics_json, '{"schema_version":1,"data":[]}' AS container_pairs_json FROM customer""")
def wire_json(spark, d):
    return wire.wire(customers(spark, d))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, '{"blocks":[{"t":"Para","c":[{"t":"Str","c":"x"},{"t":"Span","c":[["",["@class-ruby"],[["delim","explicit"]]],[{"t":"Span","c":[["",["@class-ruby-base"],[]],[{"t":"Str","c":"' || c_name || '"}]]},{"t":"Span","c":[["",["@class-ruby-reading"],[]],[{"t":"Str","c":"' || c_mktsegment || '"}]]}]]}]}],"meta":{},"pandoc-api-version":[1,23]}' AS pandoc FROM customer""")
def pandoc_blocks(spark, d):
    return parse.parse(customers(spark, d).select("doc_id", "source"), ["pandoc"]).select("doc_id", F.col("parsed.pandoc").alias("pandoc"))


@query("""WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(10 + strlen(c_name) + strlen(c_mktsegment) AS INTEGER) AS e, '｜' || c_name || '《' || c_mktsegment || '》' AS s FROM customer)
SELECT doc_id, 0 AS ord, 0 AS depth, NULL AS parent_ord, 'Document' AS kind, NULL AS text, 0 AS "start", e AS "end" FROM x UNION ALL SELECT doc_id, 1, 1, 0, 'Plain', 'x', 0, 1 FROM x
UNION ALL SELECT doc_id, 2, 1, 0, 'Construct', NULL, 1, e FROM x UNION ALL SELECT doc_id, 3, 2, 2, 'ConstructText', s, 1, e FROM x""")
def tree_rows(spark, d):
    return parse.cst(customers(spark, d).select("doc_id", "source"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, o AS ord, c AS capture, p AS pattern_idx FROM customer, (VALUES (0, '', 1), (1, '', 1), (2, 'c', 0), (2, '', 1), (3, '', 1)) AS v(o, c, p)""")
def pattern_captures(spark, d):
    return pattern.captures(parse.cst(customers(spark, d).select("doc_id", "source")), "(Construct @c) (_)").select("doc_id", "ord", "capture", "pattern_idx")


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey % 40 AS INTEGER) AS "offset", CASE WHEN c_custkey % 40 >= 1 AND c_custkey % 40 < 10 + strlen(c_name) + strlen(c_mktsegment) THEN 'ruby' END AS node_kind FROM customer""")
def node_at_offset(spark, d):
    own = customers(spark, d)
    points = own.select("doc_id", (F.col("doc_id") % 40).cast("int").alias("offset"))
    return lookup.node_at(points, parse.nodes(own.select("doc_id", "source"))).select("doc_id", "offset", "node_kind")


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey % 3 AS INTEGER) AS "offset", CASE WHEN c_custkey % 3 = 1 THEN 'ruby' END AS node_kind FROM customer""")
def node_at_normalized(spark, d):
    own = customers(spark, d)
    points = own.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("offset"))
    return lookup.node_at_normalized(points, parse.nodes(own.select("doc_id", "source"))).select("doc_id", "offset", "node_kind")


# Spans from orders (0 to 100) and in them from their lines (from 10 times the line's number, one to nine long), and points from part keys.
_SPANS = """WITH n AS (SELECT o_orderkey AS k, 'order' AS kind, 0 AS s, 100 AS e FROM orders UNION ALL SELECT l_orderkey, 'line' || l_linenumber, 10 * l_linenumber, 10 * l_linenumber + 1 + CAST(min(l_quantity) AS INTEGER) % 9 FROM lineitem GROUP BY l_orderkey, l_linenumber),
p AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS INTEGER) AS line, CAST(l_partkey % 120 AS INTEGER) AS o FROM lineitem)"""


def _spans_and_points(spark, d):
    # dealt out by order first, or the tasks that read the file would each hold all its groups: as many rows as a row group has
    tasks = parse.TASKS * spark.sparkContext.defaultParallelism
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").repartition(tasks, "l_orderkey")
    each = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    own = each.select(F.col("l_orderkey").alias("doc_id"), F.concat(lit("line"), "l_linenumber").alias("kind"), (F.col("l_linenumber") * 10).cast("int").alias("start"), (F.col("l_linenumber") * 10 + 1 + F.col("q").cast("int") % 9).cast("int").alias("end"))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), lit("order").alias("kind"), lit(0).alias("start"), lit(100).alias("end"))
    return orders.unionByName(own), lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_partkey") % 120).cast("int").alias("offset")).distinct()


@query(_SPANS + """ SELECT p.k AS doc_id, line, o AS "offset", arg_max(kind, s) AS node_kind FROM p LEFT JOIN n ON n.k = p.k AND s <= o AND o < e GROUP BY ALL""")
def node_innermost(spark, d):
    spans, points = _spans_and_points(spark, d)
    return lookup.node_at(points, spans, nested=True).select("doc_id", "line", "offset", "node_kind")


@query(_SPANS + """ SELECT doc_id, line, "offset", CASE WHEN "offset" < e THEN kind END AS node_kind FROM (SELECT p.k AS doc_id, line, o AS "offset", arg_max(kind, s) AS kind, arg_max(e, s) AS e FROM p LEFT JOIN n ON n.k = p.k AND s <= o GROUP BY ALL)""")
def node_of_last_start(spark, d):
    spans, points = _spans_and_points(spark, d)
    return lookup.node_at(points, spans).select("doc_id", "line", "offset", "node_kind")


# Lookups


# frozen from the tables: they show a later change, not an error that was there before
_SLUGS = """('改ページ'), ('改丁'), ('改段'), ('改見開き'), ('ここから字下げ'), ('ここから{N}字下げ'), ('ここで字下げ終わり'), ('ここから地付き'),
('ここから地から{N}字上げ'), ('ここで地付き終わり'), ('罫囲み'), ('罫囲み終わり'), ('割り注'), ('割り注終わり'), ('地付き'), ('地から{N}字上げ'),
('{N}字下げ'), ('傍点'), ('白ゴマ傍点'), ('丸傍点'), ('白丸傍点'), ('二重丸傍点'), ('蛇の目傍点'), ('ばつ傍点'),
('白三角傍点'), ('波線'), ('傍線'), ('二重傍線'), ('挿絵（{path}）入る'), ('縦中横'), ('一'), ('二'),
('三'), ('四'), ('上'), ('中'), ('下'), ('甲'), ('乙'), ('丙'),
('丁'), ('レ'), ('一レ'), ('二レ'), ('三レ'), ('上レ'), ('中レ'), ('下レ')"""
_VARIANTS = """('ぼうてん', '傍点'), ('にぼうてん', '傍点'), ('しろぼうてん', '白ゴマ傍点'), ('しろごまぼうてん', '白ゴマ傍点'), ('まるぼうてん', '丸傍点'),
('にまるぼうてん', '丸傍点'), ('しろまるぼうてん', '白丸傍点'), ('にしろまるぼうてん', '白丸傍点'), ('にじゅうまるぼうてん', '二重丸傍点'), ('じゃのめぼうてん', '蛇の目傍点'),
('ばつぼうてん', 'ばつ傍点'), ('しろさんかくぼうてん', '白三角傍点'), ('はせん', '波線'), ('ぼうせん', '傍線'), ('にじゅうぼうせん', '二重傍線'),
('かいぺーじ', '改ページ'), ('ページかえ', '改ページ'), ('かいちょう', '改丁'), ('かいだん', '改段'), ('かいみひらき', '改見開き'),
('ここからじさげ', 'ここから字下げ'), ('ここでじさげおわり', 'ここで字下げ終わり'), ('ここからじつき', 'ここから地付き'), ('ここでじつきおわり', 'ここで地付き終わり'), ('じつき', '地付き'),
('たてちゅうよこ', '縦中横'), ('たて中横', '縦中横'), ('そうにゅうえ', '挿絵（{path}）入る'), ('けいがこみ', '罫囲み'), ('けいがこみおわり', '罫囲み終わり'),
('わりちゅう', '割り注'), ('わりちゅうおわり', '割り注終わり')"""


@query(f"""WITH s AS (SELECT * FROM (VALUES {_SLUGS}) AS v(slug)), v AS (SELECT * FROM (VALUES {_VARIANTS}) AS v(variant, canonical)),
i AS (SELECT slug FROM s UNION ALL SELECT variant FROM v UNION ALL SELECT n_name FROM nation)
SELECT i.slug, coalesce(s.slug, v.canonical) AS canonical FROM i LEFT JOIN s ON s.slug = i.slug LEFT JOIN v ON v.variant = i.slug""")
def slug_canonicalise(spark, d):
    own = V.table(spark, "slugs").select(F.col("canonical").alias("slug")).unionByName(V.table(spark, "variants").select(F.col("variant").alias("slug"))).unionByName(t(spark, d, "nation").select(F.col("n_name").alias("slug")))
    return lookup.canonical_slug(own, "slug")


@query("""WITH x AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey % 6 AS c, p_name FROM part)
SELECT k, CASE c WHEN 0 THEN 'A' WHEN 1 THEN '枘' WHEN 2 THEN chr(CAST(19968 + k % 20000 AS INT)) WHEN 3 THEN '〓' WHEN 4 THEN '字' END AS ucs FROM x""")
def gaiji_resolution(spark, d):
    """By priority: what is there, code table, code point, description, single character."""
    k, c = F.col("p_partkey"), F.col("p_partkey") % 6
    own = t(spark, d, "part").select(k.alias("k"), c.alias("c"), F.col("p_name"))
    k, c = F.col("k"), F.col("c")
    code = F.when(c == 1, "第3水準1-85-54").when(c == 2, F.concat(lit("U+"), F.hex(k % 20000 + 19968)))
    text = F.when(c == 3, "〓").when(c == 4, "字").otherwise(F.col("p_name"))
    return lookup.resolve_gaiji(own, F.when(c == 0, "A"), code, text).select("k", "ucs")


@query("""SELECT CAST(p_partkey AS BIGINT) AS k, contains(left(p_name, 6), left(p_brand, 1)) AND contains(left(p_name, 6), left(p_name, 2)) AS precede FROM part""")
def targets_precede(spark, d):
    own = t(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", lit(6).alias("cut"), F.array(F.left("p_brand", lit(1)), F.left("p_name", lit(2))).alias("targets"))
    return lookup.targets_precede(own, "p_name", "cut", "targets").select("k", "precede")


@query("""WITH a AS (SELECT n_name AS k, 1 AS v FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_name AS k, 2 AS v FROM nation WHERE n_nationkey % 3 = 0)
SELECT k, v FROM a UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM a)""")
def merge_preferring(spark, d):
    n = t(spark, d, "nation")
    return lookup.merge_preferring(n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("k"), lit(1).alias("v")), n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), lit(2).alias("v")), "k")


# Corpus statistics


def _sizes(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", "text", (F.octet_length("text") * 200).cast("long").alias("n_bytes"), F.octet_length("text").cast("long").alias("stored"))


_BAND = "CASE WHEN b < 51200 THEN 'small' WHEN b < 512000 THEN 'medium' WHEN b < 2097152 THEN 'large' ELSE 'pathological' END"


@query(f"""WITH x AS (SELECT {_BAND} AS band, * FROM (SELECT strlen(text) * 200 AS b, strlen(text) AS s FROM documents)), g AS (SELECT band, count(*) AS n, sum(b) AS decoded, sum(s) AS on_disk, max(b) AS largest, list_sort(list(b))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM x GROUP BY band)
SELECT band, coalesce(n, 0) AS n, CAST(coalesce(decoded, 0) AS BIGINT) AS decoded, CAST(coalesce(on_disk, 0) AS BIGINT) AS on_disk, decoded / n AS mean, median, largest, on_disk / decoded AS ratio FROM (VALUES ('small'), ('medium'), ('large'), ('pathological')) AS v(band) LEFT JOIN g USING (band)""")
def band_stats_upper_median(spark, d):
    return stats.band_statistics(_sizes(spark, d), "n_bytes", "stored")


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(v) FILTER (WHERE i = CAST(round((n - 1) * 0.5) AS INT) + 1) AS p50, max(v) FILTER (WHERE i = CAST(round((n - 1) * 0.9) AS INT) + 1) AS p90, max(v) FILTER (WHERE i = CAST(round((n - 1) * 0.99) AS INT) + 1) AS p99 FROM r GROUP BY l_returnflag""")
def nearest_rank_quantiles(spark, d):
    own = t(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return stats.nearest_ranks(own, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("""SELECT event_type AS job, CAST(user_id % 10 AS BIGINT) AS step, CAST(floor(median(CAST(floor(value * 100) AS BIGINT))) AS BIGINT) AS median, count(*) AS n FROM events GROUP BY ALL""")
def ci_median_steps(spark, d):
    own = t(spark, d, "events").select(F.col("event_type").alias("job"), (F.col("user_id") % 10).alias("step"), F.floor(F.col("value") * 100).alias("v"))
    return stats.midpoint_median(own, ["job", "step"], "v").join(own.groupBy("job", "step").agg(F.count("*").alias("n")), ["job", "step"])


@query("""WITH e AS (SELECT i, CAST(floor(exp(ln(1.0) + (ln(1000.0) - ln(1.0)) / 12 * i)) AS BIGINT) AS edge FROM range(13) AS r(i)),
c AS (SELECT CASE WHEN value <= 1 THEN 0 WHEN value >= (SELECT edge FROM e WHERE i = 12) THEN 11 ELSE least(11, CAST(floor(ln(value) / (ln(1000.0) / 12)) AS INT)) END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(a.i AS INTEGER) AS bucket, a.edge AS lo, b.edge AS hi, coalesce(n, 0) AS n FROM e a JOIN e b ON b.i = a.i + 1 LEFT JOIN c ON c.bucket = a.i""")
def log_histogram(spark, d):
    return stats.log_histogram(t(spark, d, "events"), "value", 12, 1.0, 1000.0)


@query("""WITH x AS (SELECT CASE WHEN k < 1 THEN '0' WHEN k < 6 THEN '1-5' WHEN k < 21 THEN '6-20' WHEN k < 101 THEN '21-100' ELSE '100+' END AS band FROM (SELECT len(text) - len(replace(text, chr(10), '')) AS k FROM documents)), g AS (SELECT band, count(*) AS n FROM x GROUP BY band)
SELECT band, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / (SELECT count(*) FROM x) AS pct FROM (VALUES ('0'), ('1-5'), ('6-20'), ('21-100'), ('100+')) AS v(band) LEFT JOIN g USING (band)""")
def count_histogram(spark, d):
    """Diagnostics per document: a stray closer for each line end."""
    own = t(spark, d, "documents").select("doc_id", F.replace("text", lit("\n"), lit("」")).alias("source"))
    return stats.labelled_histogram(parse.parse(own, ["diagnostics"]), F.size("parsed.diagnostics"), stats.DIAGNOSTIC_BANDS)


@query("""WITH x AS (SELECT l_extendedprice / l_quantity / 100 AS r FROM lineitem), g AS (SELECT CASE WHEN r < 1 THEN '0-1' WHEN r < 2 THEN '1-2' WHEN r < 4 THEN '2-4' WHEN r < 8 THEN '4-8' WHEN r < 16 THEN '8-16' ELSE '>16' END AS band, count(*) AS n FROM x GROUP BY 1)
SELECT band, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / (SELECT count(*) FROM x) AS pct FROM (VALUES ('0-1'), ('1-2'), ('2-4'), ('4-8'), ('8-16'), ('>16')) AS v(band) LEFT JOIN g USING (band)""")
def ratio_histogram(spark, d):
    own = t(spark, d, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("r"))
    return stats.labelled_histogram(own, F.col("r"), stats.RATIO_BANDS)


@query("""WITH x AS (SELECT CASE WHEN k < 1 THEN '0' WHEN k < 6 THEN '1-5' WHEN k < 21 THEN '6-20' WHEN k < 101 THEN '21-100' ELSE '100+' END AS band, ns FROM (SELECT len(text) - len(replace(text, chr(10), '')) AS k, strlen(text) * 7 AS ns FROM documents)), g AS (SELECT band, count(*) AS n, avg(ns) / 1000 AS m FROM x GROUP BY band)
SELECT band, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / (SELECT count(*) FROM x) AS pct, coalesce(m, 0) AS mean_us FROM (VALUES ('0'), ('1-5'), ('6-20'), ('21-100'), ('100+')) AS v(band) LEFT JOIN g USING (band)""")
def diagnostic_distribution(spark, d):
    """Diagnostics as in ``count_histogram``, with seven nanoseconds a byte as the time taken."""
    own = t(spark, d, "documents").select((F.octet_length("text") * 7).alias("ns"), F.replace("text", lit("\n"), lit("」")).alias("source"))
    found = parse.parse(own, ["diagnostics"]).select("ns", F.size("parsed.diagnostics").alias("n"))
    return stats.diagnostic_distribution(found, "n", "ns")


@query("""SELECT doc_id, CAST(len(text) - len(replace(text, chr(10), '')) AS INTEGER) AS n_diagnostics, CAST(strlen(text) * 7 AS BIGINT) AS ns FROM documents ORDER BY 2 DESC, doc_id LIMIT 5""")
def most_diagnostics(spark, d):
    own = t(spark, d, "documents").select("doc_id", (F.octet_length("text") * 7).cast("long").alias("ns"), F.replace("text", lit("\n"), lit("」")).alias("source"))
    found = parse.parse(own, ["diagnostics"]).select("doc_id", F.size("parsed.diagnostics").alias("n_diagnostics"), "ns")
    return stats.top(found, 5, F.desc("n_diagnostics"), F.asc("doc_id"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS doc_id, CASE s_suppkey % 3 WHEN 2 THEN 0 ELSE 1 END AS n_diagnostics, CASE s_suppkey % 3 WHEN 2 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS n_errors, s_suppkey % 3 = 2 AS passed FROM supplier""")
def strict_check(spark, d):
    """Clean, an open bracket (an error), a private-use mark (a warning)."""
    k = F.col("s_suppkey")
    tail = F.when(k % 3 == 0, "「").when(k % 3 == 1, "\ue001").otherwise("")
    return parse.check(t(spark, d, "supplier").select(k.alias("doc_id"), F.concat("s_name", tail).alias("source")), strict=True)


@query("""WITH r AS (SELECT l_extendedprice / l_quantity / 100 AS v FROM lineitem), i AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS c FROM r)
SELECT count(*) AS n, max(v) FILTER (WHERE i = CAST(round((c - 1) * 0.5) AS INT) + 1) AS p50, max(v) FILTER (WHERE i = CAST(round((c - 1) * 0.9) AS INT) + 1) AS p90, max(v) FILTER (WHERE i = CAST(round((c - 1) * 0.99) AS INT) + 1) AS p99, max(v) AS max, avg(v) AS mean FROM i""")
def ratio_statistics(spark, d):
    return stats.ratio_statistics(t(spark, d, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("r")), "r")


@query("""WITH x AS (SELECT p_size % 10 / (p_partkey % 10) AS r FROM part WHERE p_partkey % 10 > 0), y AS (SELECT least(r, 1.0) AS r FROM x), g AS (SELECT CASE WHEN r < 0.2 THEN '0.00-0.20' WHEN r < 0.4 THEN '0.20-0.40' WHEN r < 0.6 THEN '0.40-0.60' WHEN r < 0.8 THEN '0.60-0.80' WHEN r < 0.95 THEN '0.80-0.95' ELSE '0.95-1.00' END AS band, count(*) AS n FROM y GROUP BY 1)
SELECT band, coalesce(n, 0) AS n, 100.0 * coalesce(n, 0) / (SELECT count(*) FROM y) AS pct FROM (VALUES ('0.00-0.20'), ('0.20-0.40'), ('0.40-0.60'), ('0.60-0.80'), ('0.80-0.95'), ('0.95-1.00')) AS v(band) LEFT JOIN g USING (band)""")
def dedup_histogram(spark, d):
    calls = F.col("p_partkey") % 10
    return stats.dedup_histogram(t(spark, d, "part").select(calls.alias("calls"), F.least(F.col("p_size") % 10, calls).alias("reuses")), "reuses", "calls")


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(o_custkey * 10 AS BIGINT) AS a, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders), u AS (SELECT 'parse' AS phase, k, a AS ns, a + b AS total_ns, b AS n_bytes FROM x UNION ALL SELECT 'render', k, b, a + b, b FROM x)
SELECT phase, CAST(i AS INTEGER) AS rank, CAST(k AS BIGINT) AS doc_id, ns, total_ns, n_bytes FROM (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY ns DESC, k) AS i FROM u) WHERE i <= 5""")
def slowest_documents(spark, d):
    price = F.floor("o_totalprice")
    own = t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"), (F.col("o_custkey") * 10).cast("long").alias("parse"), price.alias("render"), price.alias("n"))
    return stats.slowest(own, ["parse", "render"], "doc_id", "n")


@query("""WITH x AS (SELECT c_custkey % 7 <> 0 AS ok, c_custkey AS calls, c_custkey % 5 AS cache_hits, c_custkey % 3 AS allocs FROM customer), g AS (SELECT count(*) FILTER (WHERE ok) AS documents, count(*) FILTER (WHERE NOT ok) AS decode_errors, CAST(sum(calls) FILTER (WHERE ok) AS BIGINT) AS calls, CAST(sum(cache_hits) FILTER (WHERE ok) AS BIGINT) AS cache_hits, CAST(sum(allocs) FILTER (WHERE ok) AS BIGINT) AS allocs FROM x)
SELECT *, 100.0 * cache_hits / calls AS cache_hits_pct, 100.0 * allocs / calls AS allocs_pct FROM g""")
def corpus_counters(spark, d):
    k = F.col("c_custkey")
    own = t(spark, d, "customer").select((k % 7 != 0).alias("ok"), k.alias("calls"), (k % 5).alias("cache_hits"), (k % 3).alias("allocs"))
    return stats.corpus_counters(own, F.col("ok"), ["calls", "cache_hits", "allocs"])


@query(r"""WITH x AS (SELECT CAST(contains(text, chr(10)) AS INT) + 2 * CAST(regexp_matches(text, '[0-9]') AS INT) + 4 * CAST(contains(text, '''') AS INT) AS mask, strlen(text) AS b, strlen(text) * (1 + doc_id % 7) AS ns FROM documents WHERE text <> ''),
g AS (SELECT mask, count(*) AS n, sum(b) AS bytes, sum(ns) AS ns, list_sort(list(ns / b))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM x GROUP BY mask)
SELECT v.mask, v.label, coalesce(n, 0) AS n, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(coalesce(ns, 0) AS BIGINT) AS ns, ns / bytes AS ns_per_byte, m AS median_ns_per_byte FROM (VALUES (0, 'none'), (1, 'newline'), (2, 'digit'), (3, 'newline+digit'), (4, 'quote'), (5, 'newline+quote'), (6, 'digit+quote'), (7, 'newline+digit+quote')) AS v(mask, label) LEFT JOIN g ON g.mask = v.mask""")
def bitmask_buckets(spark, d):
    own = t(spark, d, "documents").filter("text <> ''").select("text", F.octet_length("text").cast("long").alias("b"), (F.octet_length("text") * (F.col("doc_id") % 7 + 1)).cast("long").alias("ns"))
    return stats.flag_groups(own, {"newline": F.contains("text", lit("\n")), "digit": F.col("text").rlike("[0-9]"), "quote": F.contains("text", lit("'"))}, "b", "ns")


@query("""WITH x AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 1000 AS a, CAST(floor(l_extendedprice) AS BIGINT) AS b, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem), u AS (SELECT 'parse' AS phase, a AS ns, bytes FROM x UNION ALL SELECT 'render', b, bytes FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY ns) AS i, count(*) OVER (PARTITION BY phase) AS n FROM u)
SELECT phase, CAST(sum(ns) AS BIGINT) AS total_ns, 100.0 * sum(ns) / (SELECT sum(ns) FROM u) AS pct, sum(bytes) * 1000.0 / sum(ns) AS mb_s, max(ns) FILTER (WHERE i = CAST(round((n - 1) * 0.5) AS INT) + 1) AS p50, max(ns) FILTER (WHERE i = CAST(round((n - 1) * 0.9) AS INT) + 1) AS p90, max(ns) FILTER (WHERE i = CAST(round((n - 1) * 0.99) AS INT) + 1) AS p99 FROM r GROUP BY phase""")
def phase_totals(spark, d):
    own = t(spark, d, "lineitem").select((F.col("l_quantity").cast("long") * 1000).alias("parse"), F.floor("l_extendedprice").alias("render"), F.floor("l_extendedprice").alias("n"))
    return stats.phase_totals(own, ["parse", "render"], "n")


@query(f"""WITH x AS (SELECT {_BAND} AS band, * FROM (SELECT strlen(text) * 200 AS b, strlen(text) * 3 + doc_id % 50 AS u, strlen(text) * 2 + 1 AS v FROM documents))
SELECT band, count(*) AS n, 100.0 * (sum(u) - sum(v)) / sum(v) AS gap_pct, list_sort(list(100.0 * (u - v) / v))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_gap_pct FROM x GROUP BY band""")
def gap_by_band(spark, d):
    own = _sizes(spark, d).select("n_bytes", (F.col("stored") * 3 + F.col("doc_id") % 50).alias("u"), (F.col("stored") * 2 + 1).alias("v"))
    return stats.gap_by_band(own, "n_bytes", "u", "v")


@query("""SELECT count(*) AS entries, CAST(sum(strlen(text) * 200) AS BIGINT) AS decoded, CAST(sum(strlen(text)) AS BIGINT) AS stored, sum(strlen(text)) / sum(strlen(text) * 200) AS ratio FROM documents""")
def archive_totals(spark, d):
    return stats.archive_totals(_sizes(spark, d), "n_bytes", "stored")


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN repeat(p_brand, 10) ELSE p_brand END AS s FROM part), g AS (SELECT count(s) AS calls, count(DISTINCT s) FILTER (WHERE strlen(s) <= 64) AS allocs, count(*) FILTER (WHERE strlen(s) > 64) AS long_bypass FROM x) SELECT *, 1 - (allocs + long_bypass) / calls AS dedup_ratio FROM g""")
def interner_statistics(spark, d):
    own = t(spark, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.repeat("p_brand", lit(10))).otherwise(F.col("p_brand")).alias("s"))
    return stats.interner_statistics(own, "s")


@query(r"""WITH x AS (SELECT sum(strlen(text)) AS b, sum(strlen(text) - strlen(regexp_replace(text, '[0-9]', '', 'g'))) AS digit, sum(strlen(text) - strlen(regexp_replace(text, '[A-Z]', '', 'g'))) AS upper, sum(strlen(text) - strlen(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) AS wide FROM documents)
SELECT 'digit' AS class, CAST(digit AS BIGINT) AS n, 1000.0 * digit / b AS per_mille FROM x UNION ALL SELECT 'upper', CAST(upper AS BIGINT), 1000.0 * upper / b FROM x UNION ALL SELECT 'wide', CAST(wide AS BIGINT), 1000.0 * wide / b FROM x""")
def byte_density(spark, d):
    return stats.byte_density(t(spark, d, "documents"), "text", {"digit": "0-9", "upper": "A-Z", "wide": "^\\x00-\\x7F"})


@query("""SELECT count(*) FILTER (WHERE c_custkey % 7 = 0) AS decode_errors, count(*) FILTER (WHERE c_custkey % 11 = 0) AS io_errors, count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) AS parsed FROM customer""")
def outcome_counts(spark, d):
    k = F.col("c_custkey")
    return stats.outcome_counts(t(spark, d, "customer"), k % 7 == 0, k % 11 == 0)


@query("""SELECT level, coalesce(n, 0) AS total, coalesce(p, 0) AS passed, coalesce(n, 0) - coalesce(p, 0) AS failed FROM (VALUES ('must'), ('should'), ('may')) AS v(level) LEFT JOIN (SELECT CASE WHEN p_size % 2 = 0 THEN 'must' ELSE 'should' END AS level, count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 <> 0) AS p FROM part GROUP BY 1) USING (level)""")
def conformance_summary(spark, d):
    own = t(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "must").otherwise("should").alias("level"), (F.col("p_partkey") % 5 != 0).alias("ok"))
    return stats.conformance_summary(own, "level", "ok")


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1""")
def year_histogram(spark, d):
    return stats.year_histogram(t(spark, d, "orders").select(X.mtime_ns(F.col("o_orderdate").cast("timestamp")).alias("ns")), "ns")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS job, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_custkey AS BIGINT) END AS seconds FROM orders""")
def job_times(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    own = t(spark, d, "orders").select("o_orderkey", at.alias("a"), F.when(F.col("o_orderkey") % 9 != 0, F.timestamp_seconds(F.unix_timestamp(at) + F.col("o_custkey"))).alias("b"))
    return stats.job_times(own, "o_orderkey", "a", "b")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS job, CAST(l_linenumber AS VARCHAR) AS step, l_quantity AS seconds FROM lineitem WHERE l_quantity > 1 ORDER BY seconds DESC, job, step LIMIT 25""")
def top_steps(spark, d):
    own = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("name"), F.col("l_quantity").alias("seconds"))).alias("steps"))
    return stats.top_steps(own, 25)


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.h = a.h THEN 'reuse' ELSE 'encode' END AS action FROM a LEFT JOIN b USING (doc_id) UNION ALL SELECT 'removed' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) GROUP BY action""")
def incremental_pack(spark, d):
    own = t(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("label"), lit(1).cast("long").alias("mtime_ns"), "text")
    old = own.filter("doc_id % 7 <> 0").select("label", "mtime_ns", F.unhex(F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", lit("x"))).otherwise(F.col("text")), 256)).alias("source_hash"))
    new = own.filter("doc_id % 5 <> 0").select("label", "mtime_ns", F.unhex(F.sha2("text", 256)).alias("source_hash"))
    return corpus.pack_plan(new, old).groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) || '.txt' AS label, CAST(doc_id AS BIGINT) AS mtime_ns, CAST(strlen(text) AS BIGINT) AS decoded_len, sha256(text) AS payload FROM documents""")
def packed_archive(spark, d):
    """All documents written as packed files and read back in ranges of entries."""
    packed.register(spark)
    own = t(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), lit(".txt")).alias("label"), F.col("doc_id").alias("mtime_ns"), F.encode("text", "UTF-8").alias("content"))
    path = _new_folder(spark, "packed")
    corpus.archive_rows(own, utf8=False).write.format("packed_corpus").mode("append").save(path)
    return spark.read.format("packed_corpus").load(path).select("label", "mtime_ns", "decoded_len", F.sha2("payload", 256).alias("payload"))


@query("""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS label, doc_id AS i FROM documents), g AS (SELECT label, i, 24 + CASE WHEN i % 4 = 3 THEN 0 ELSE 1 END AS gone FROM e)
SELECT label, 'encode' AS action, CAST(0 AS BIGINT) AS "hour" FROM e UNION ALL SELECT label, CASE WHEN i % 3 = 0 THEN 'encode' ELSE 'reuse' END, 1 FROM e WHERE i % 4 <> 3 UNION ALL SELECT label, 'removed', gone FROM g UNION ALL SELECT label, 'encode', 48 FROM e WHERE i % 5 <> 0""")
def stream_pack(spark, d):
    """Documents delivered as a stream at hours 0, 1 (most, a third of them changed) and 48 (most): what to encode, what to reuse, what is gone after a day."""
    schema = t(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    i = F.col("doc_id")
    at = F.filter(F.array(lit(0), F.when(i % 4 != 3, 1), F.when(i % 5 != 0, 48)), lambda h: h.isNotNull())
    each = stream.select("doc_id", "text", F.explode(at).alias("h"))
    changed = F.when((F.col("h") == 1) & (i % 3 == 0), F.concat("text", lit("x"))).otherwise(F.col("text"))
    own = each.select(i.cast("string").alias("label"), F.timestamp_seconds(F.col("h") * 3600 + 1_704_067_200).alias("seen"), lit(1).cast("long").alias("mtime_ns"), F.unhex(F.sha2(changed, 256)).alias("source_hash"))
    return watch.run_once(packing.pack_stream(own), _new_folder(spark, "packing")).select("label", "action", F.floor((F.unix_seconds("seen") - 1_704_067_200) / 3600).alias("hour"))


@query("""SELECT event_type AS label, CASE WHEN user_id % 2 = 0 THEN 'lib' || (user_id % 4) END AS library, count(*) AS n, CAST(sum(user_id % 7 + 1) AS BIGINT) AS weight FROM events WHERE user_id IS NOT NULL GROUP BY ALL""")
def variant_profiles(spark, d):
    """Events as JSON profiles, one a user: those of odd users lack libraries and resources, all have a field that nobody knows."""
    user = F.col("user_id")
    e = t(spark, d, "events").filter(user.isNotNull()).groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    n = F.sequence(lit(0), F.size("types") - 1)
    one = lambda x: F.transform(n, lambda i: lit(x))
    thread = F.struct(
        user.alias("tid"), F.struct(n.alias("stack"), F.transform(n, lambda i: user % 7 + 1).alias("weight")).alias("samples"), F.struct(one(-1).alias("prefix"), n.alias("frame")).alias("stackTable"),
        F.struct(one(0).alias("address"), n.alias("func")).alias("frameTable"), F.struct(n.alias("name"), F.when(user % 2 == 0, one(0)).alias("resource")).alias("funcTable"),
        F.when(user % 2 == 0, F.struct(F.array(lit(0)).alias("lib"))).alias("resourceTable"), F.col("types").alias("stringArray"), lit("?").alias("unheardOf"),
    )
    libs = F.when(user % 2 == 0, F.array(F.struct(F.concat(lit("lib"), (user % 4).cast("string")).alias("name"))))
    profiles = e.select(F.to_json(F.struct(libs.alias("libs"), F.array(thread).alias("threads"))).alias("profile"))
    found = trace.from_threads(trace.threads_of(profiles))
    hot = found.samples.join(found.stacks, ["tid", "stack_idx"]).join(found.frames, ["tid", "frame_idx"])
    return hot.groupBy("label", "library").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("""SELECT l_orderkey AS k, l_suppkey * 100 + l_partkey % 100 AS address, CASE WHEN l_partkey % 100 < 60 THEN s_name END AS symbol, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def symbol_ranges(spark, d):
    """Suppliers as functions of 60 bytes in libraries by nation, lines as addresses in or after them."""
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("library"), (F.col("s_suppkey") * 100).alias("address"), F.col("s_name").alias("name"), lit(60).alias("size"))
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey", (F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).alias("address"))
    frames = lines.join(s.select("s_suppkey", "library"), F.col("l_suppkey") == F.col("s_suppkey")).select("k", "library", "address")
    return trace.symbolized(frames, s).groupBy("k", "address", "symbol").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, doc_id % 3 = 0 AS bom FROM documents""")
def bom_flags(spark, d):
    own = t(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, lit("\ufeff")).otherwise(""), "text").alias("text"))
    return own.select("doc_id", corpus.has_bom(F.encode("text", "UTF-8")).alias("bom"))


@query("""SELECT doc_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM documents ORDER BY strlen(text) DESC, doc_id LIMIT 20""")
def largest_entries(spark, d):
    """The feature is a report of the first 20; every document is compared."""
    return stats.top(t(spark, d, "documents").select("doc_id", F.octet_length("text").alias("n_bytes")), 20, F.desc("n_bytes"), F.asc("doc_id"))


@query("""SELECT p_partkey, regexp_matches(p_name, '[''`^:~&,/_]') AS marked FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '_' ELSE replace(p_name, ',', '') END AS p_name FROM part)""")
def accent_marks(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", lit("_"))).otherwise(F.replace("p_name", lit(","), lit("")))
    return t(spark, d, "part").select("p_partkey", X.has_accent_mark(name).alias("marked"))


@query("""SELECT l_orderkey AS tid, CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_partkey % 4 = 0 THEN '0x' || lower(to_hex(l_partkey * 16)) ELSE p_name END AS label, CASE WHEN l_partkey % 5 < 4 THEN r_name END AS library, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN region ON r_regionkey = l_partkey % 5 GROUP BY ALL""")
def star_lookup(spark, d):
    """Lines as frames of their order's thread, parts as functions with a name and a resource (every fifth has none), regions as libraries."""
    lines, k = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), F.col("l_partkey")
    own = lines.select(F.col("l_orderkey").alias("tid"), F.col("l_linenumber").cast("int").alias("line"), k.alias("func_idx"), (k * 16).alias("address"), F.when(k % 4 != 0, F.col("p_name")).alias("value"), F.when(k % 5 < 4, k % 5).alias("resource_idx"))
    frame = own.select("tid", F.struct("line", F.monotonically_increasing_id().alias("row")).alias("frame_idx"), "func_idx", "address")
    func = own.select("tid", "func_idx", F.col("func_idx").alias("name_idx"), "resource_idx").distinct()
    string = own.select("tid", F.col("func_idx").alias("name_idx"), "value").distinct()
    resource = own.select("tid", "resource_idx", F.col("resource_idx").alias("lib_idx")).filter("resource_idx is not null").distinct()
    libs = t(spark, d, "region").select(F.col("r_regionkey").alias("lib_idx"), F.col("r_name").alias("name"))
    found = trace.frames_of(frame, func, string, resource, libs)
    return found.select("tid", F.col("frame_idx.line").alias("line"), "label", "library").groupBy("tid", "line", "label", "library").agg(F.count("*").alias("n"))


# Traces, with events as samples: a frame for each type, every second one called from the one before


def _trace(spark, d, half=None) -> trace.Trace:
    events = t(spark, d, "events")
    if half is not None:
        events = events.filter(F.col("event_id") % 2 == half)
    # one row for each event type and thread
    kinds = t(spark, d, "events").select((F.col("user_id") % 4).alias("tid"), F.col("event_type").alias("label")).distinct()
    from pyspark.sql.window import Window

    frames = kinds.withColumn("frame_idx", F.row_number().over(Window.partitionBy("tid").orderBy("label")) - 1)
    frames = frames.withColumn("library", F.when(F.col("frame_idx") % 3 != 2, F.concat(lit("lib"), (F.col("frame_idx") % 3).cast("string"))))
    stacks = frames.select("tid", F.col("frame_idx").alias("stack_idx"), F.when(F.col("frame_idx") % 2 == 1, F.col("frame_idx") - 1).alias("prefix"), "frame_idx")
    own = events.select((F.col("user_id") % 4).alias("tid"), F.col("event_type").alias("label"), "event_id", (F.col("user_id") % 3 + 1).alias("weight"))
    samples = own.join(frames.select("tid", "label", "frame_idx"), ["tid", "label"]).select("tid", F.when(F.col("event_id") % 10 != 0, F.col("frame_idx")).alias("stack_idx"), "weight")
    return trace.Trace(samples, stacks, frames)


_TRACE = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY label) - 1 AS i FROM (SELECT DISTINCT user_id % 4 AS tid, event_type AS label FROM events)),
s AS (SELECT e.user_id % 4 AS tid, event_type AS label, f.i, CASE WHEN event_id % 10 <> 0 THEN f.i END AS stack, 1 + user_id % 3 AS w, event_id FROM events e JOIN f ON f.tid = e.user_id % 4 AND f.label = event_type),
tot AS (SELECT sum(w) AS total FROM s)"""


@query(_TRACE + """ SELECT label, CAST(sum(w) AS BIGINT) AS self_samples, 100.0 * sum(w) / (SELECT total FROM tot) AS self_pct, CAST(sum(w) AS BIGINT) AS incl_samples, 100.0 * sum(w) / (SELECT total FROM tot) AS incl_pct, 'LH' AS row_kind FROM s WHERE stack IS NOT NULL GROUP BY label""")
def hot_leaves(spark, d):
    return trace.hot_leaves(_trace(spark, d))


@query(_TRACE + """, u AS (SELECT label, w FROM s WHERE stack IS NOT NULL UNION ALL SELECT f.label, w FROM s JOIN f ON f.tid = s.tid AND f.i = s.stack - 1 WHERE s.stack % 2 = 1)
SELECT label, CAST(sum(w) AS BIGINT) AS incl_samples, 100.0 * sum(w) / (SELECT total FROM tot) AS incl_pct FROM u GROUP BY label""")
def hot_inclusive(spark, d):
    return trace.hot_inclusive(_trace(spark, d)).select("label", "incl_samples", "incl_pct")


@query(_TRACE + """ SELECT CASE WHEN stack IS NULL OR stack % 3 = 2 THEN '(unattributed)' ELSE 'lib' || (stack % 3) END AS library, CAST(sum(w) AS BIGINT) AS samples, 100.0 * sum(w) / (SELECT total FROM tot) AS pct FROM s GROUP BY 1""")
def library_distribution(spark, d):
    return trace.library_distribution(_trace(spark, d))


@query(_TRACE + """, c AS (SELECT CASE WHEN regexp_matches(label, 'c') THEN 'has-c' WHEN regexp_matches(label, '^p|w$') THEN 'edge' ELSE 'unknown' END AS category, label, w FROM s WHERE stack IS NOT NULL),
g AS (SELECT category, sum(w) AS n, count(DISTINCT label) AS k FROM c GROUP BY 1), l AS (SELECT * FROM (VALUES (0, 'has-c'), (1, 'edge'), (2, 'nothing')) AS v(ord, category))
SELECT CAST(coalesce(ord, 3) AS INTEGER) AS ord, category, CAST(coalesce(n, 0) AS BIGINT) AS samples, 100.0 * coalesce(n, 0) / (SELECT total FROM tot) AS pct, coalesce(k, 0) AS distinct_funcs FROM l FULL JOIN g USING (category)""")
def category_rollup(spark, d):
    return trace.category_rollup(_trace(spark, d), [("has-c", ["c"]), ("edge", ["^p", "w$"]), ("nothing", ["^$"])])


@query(_TRACE + """, p AS (SELECT s.w, CASE WHEN s.stack % 2 = 1 THEN g.label || ';' ELSE '' END || s.label AS folded FROM s LEFT JOIN f g ON g.tid = s.tid AND g.i = s.stack - 1 WHERE stack IS NOT NULL)
SELECT folded || ' ' || CAST(sum(w) AS BIGINT) AS folded, CAST(sum(w) AS BIGINT) AS samples FROM p GROUP BY p.folded""")
def folded_stacks(spark, d):
    return trace.folded_stacks(_trace(spark, d)).select("folded", "samples")


@query(_TRACE + """, p AS (SELECT s.w, s.label || CASE WHEN s.stack % 2 = 1 THEN ';' || g.label ELSE '' END AS frames FROM s LEFT JOIN f g ON g.tid = s.tid AND g.i = s.stack - 1 WHERE stack IS NOT NULL)
SELECT frames, CAST(sum(w) AS BIGINT) AS samples, 100.0 * sum(w) / (SELECT total FROM tot) AS pct FROM p WHERE regexp_matches(frames, 'c') GROUP BY frames""")
def matching_stacks(spark, d):
    return trace.matching_stacks(_trace(spark, d), "c").select(F.array_join("frames", ";").alias("frames"), "samples", "pct")


@query(_TRACE + """, a AS (SELECT label, 100.0 * sum(w) / (SELECT sum(w) FROM s WHERE event_id % 2 = 0) AS p FROM s WHERE event_id % 2 = 0 AND stack IS NOT NULL GROUP BY 1), b AS (SELECT label, 100.0 * sum(w) / (SELECT sum(w) FROM s WHERE event_id % 2 = 1) AS p FROM s WHERE event_id % 2 = 1 AND stack IS NOT NULL GROUP BY 1)
SELECT label, coalesce(a.p, 0) AS before_pct, coalesce(b.p, 0) AS after_pct, coalesce(b.p, 0) - coalesce(a.p, 0) AS delta_pct, CASE WHEN a.p > 0 AND b.p > 0 THEN 'shifted' WHEN b.p > 0 THEN 'appeared' ELSE 'disappeared' END AS status FROM a FULL JOIN b USING (label)""")
def trace_compare(spark, d):
    return trace.compare(_trace(spark, d, 0), _trace(spark, d, 1), 100)


# Vocabulary, conformance, streams


_KINDS = """('ruby', '@element_ruby'), ('bouten', '@element_bouten'), ('tateChuYoko', '@element_tcy'), ('gaiji', '@element_gaiji'),
('indent', '@element_indent'), ('alignEnd', '@element_align_end'), ('warichu', '@element_warichu'), ('keigakomi', '@element_keigakomi'),
('pageBreak', '@element_page_break'), ('sectionBreak', '@element_section_break'), ('heading', '@element_heading'), ('headingHint', '@element_heading_hint'),
('sashie', '@element_sashie'), ('kaeriten', '@element_kaeriten'), ('annotation', '@element_annotation'), ('doubleRuby', '@element_double_ruby'),
('container', '@element_container'), ('containerOpen', '@element_container'), ('containerClose', '@element_container')"""


def _picked(names: list[str], name: str) -> str:
    """SQL for each customer's one of some names."""
    return f"(SELECT CAST(c_custkey AS BIGINT) AS doc_id, ([{', '.join(map(repr, names))}])[1 + CAST(c_custkey % {len(names)} AS INTEGER)] AS {name} FROM customer)"


def _pick(spark, d, names: list[str], name: str) -> DataFrame:
    return t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.get(F.array(*map(lit, names)), (F.col("c_custkey") % len(names)).cast("int")).alias(name))


@query(f"SELECT doc_id, kind, element FROM {_picked(V.NODE_KINDS, 'kind')} JOIN (VALUES {_KINDS}) AS v(kind, element) USING (kind)")
def node_kinds(spark, d):
    """The element of each customer's kind."""
    return _pick(spark, d, V.NODE_KINDS, "kind").join(F.broadcast(V.table(spark, "kinds")), "kind").select("doc_id", "kind", "element")


@query(f"""SELECT doc_id, kind, kind IN ('indent', 'alignEnd', 'warichu', 'keigakomi', 'pageBreak', 'sectionBreak', 'heading', 'sashie', 'container') AS is_block, kind IN ('heading', 'alignEnd', 'warichu', 'keigakomi', 'indent') AS contains_inlines FROM {_picked(V.NODE_KINDS, 'kind')}""")
def block_kinds(spark, d):
    return _pick(spark, d, V.NODE_KINDS, "kind").select("doc_id", "kind", lookup.is_block(F.col("kind")).alias("is_block"), lookup.contains_inlines(F.col("kind")).alias("contains_inlines"))


@query("""SELECT CAST(c_custkey AS BIGINT) AS doc_id, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE '｜漢《' || c_name || '》' END AS source, c_custkey % 3 = 1 AS changed FROM customer""")
def formatted_corpus(spark, d):
    """A corpus written in canonical form to a new folder and read from there."""
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.when(F.col("c_custkey") % 3 == 1, "").otherwise("｜"), lit("漢《"), "c_name", lit("》"))).alias("source"))
    return corpus.write_formatted(own, _new_folder(spark, "formatted"))


_PARTNERS = """('ここから字下げ', 'ここで字下げ終わり', 'ここから字下げ'), ('ここから{N}字下げ', 'ここで字下げ終わり', 'ここから字下げ'), ('ここで字下げ終わり', 'ここから字下げ', 'ここで字下げ終わり'),
('ここから地付き', 'ここで地付き終わり', 'ここから地付き'), ('ここから地から{N}字上げ', 'ここで地付き終わり', 'ここから地付き'), ('ここで地付き終わり', 'ここから地付き', 'ここで地付き終わり'),
('罫囲み', '罫囲み終わり', '罫囲み'), ('罫囲み終わり', '罫囲み', '罫囲み終わり'), ('割り注', '割り注終わり', '割り注'),
('割り注終わり', '割り注', '割り注終わり')"""


@query(f"SELECT doc_id, slug, partner, back FROM {_picked([x[0] for x in V.SLUGS], 'slug')} JOIN (VALUES {_PARTNERS}) AS v(slug, partner, back) USING (slug)")
def slug_partners(spark, d):
    """The partner of each customer's slug, where it has one."""
    return _pick(spark, d, [x[0] for x in V.SLUGS], "slug").join(F.broadcast(lookup.slug_partners(V.table(spark, "slugs"))), "slug").select("doc_id", "slug", "partner", "back")


# (case, source, HTML, canonical source, diagnostics, container pairs); # stands for a name, ~ for a line end.
_GOLDEN = [
    ("reading with a bar", "港#の｜潮風《#》が吹く", "<p>港#の<ruby>潮風<rp>(</rp><rt>#</rt><rp>)</rp></ruby>が吹く</p>~", "港#の｜潮風《#》が吹く", 0, 0),
    ("reading without", "#夜汽車《よぎしゃ》", "<p>#<ruby>夜汽車<rp>(</rp><rt>よぎしゃ</rt><rp>)</rp></ruby></p>~", "#｜夜汽車《よぎしゃ》", 0, 0),
    ("doubled brackets", "《《#》》です", '<p><span class="@class-double-ruby">≪#≫</span>です</p>~', "《《#》》です", 0, 0),
    ("emphasis", "#灯台［＃「灯台」に傍点］", '<p>#灯台<em class="@class-bouten @class-bouten-goma @class-bouten-right">灯台</em></p>~', "#灯台［＃「灯台」に傍点］", 0, 0),
    ("emphasis on the left", "灯台#［＃「灯台」の左に二重傍線］", '<p>灯台#<em class="@class-bouten @class-bouten-double-under-line @class-bouten-left">灯台</em></p>~', "灯台#［＃「灯台」の左に二重傍線］", 0, 0),
    ("upright digits", "#12年［＃「12」は縦中横］", '<p>#12年<span class="@class-tcy">12</span></p>~', "#12年［＃「12」は縦中横］", 0, 0),
    ("character by code", "#※［＃「木＋吶のつくり」、第3水準1-85-54］", '<p>#<span class="@class-gaiji" data-codepoint="U+6798">枘</span></p>~', "#※［＃「木＋吶のつくり」、第3水準1-85-54］", 0, 0),
    ("page break", "前#~［＃改ページ］~後", '<p>前#</p>~<div class="@class-page-break"></div>~<p>後</p>~', "前#~~［＃改ページ］~~後", 0, 0),
    ("section break", "［＃改丁］#", '<div class="@class-section-break @class-section-break-choho"></div>~<p>#</p>~', "~~［＃改丁］~~#", 0, 0),
    ("indent", "［＃3字下げ］#", '<p><span class="@class-indent @class-indent-3" data-amount="3"></span>#</p>~', "［＃3字下げ］#", 0, 0),
    ("raised from the end", "［＃地から２字上げ］#", '<p><span class="@class-align-end @class-align-end-2" data-offset="2"></span>#</p>~', "［＃地から2字上げ］#", 0, 0),
    ("at the end", "［＃地付き］#", '<p><span class="@class-align-end" data-offset="0"></span>#</p>~', "［＃地付き］#", 0, 0),
    ("container", "［＃ここから2字下げ］~#~二行~［＃ここで字下げ終わり］", '<div class="@class-container @class-container-indent @class-container-indent-2" data-amount="2">~<p>#<br />~二行</p>~</div>', "~~［＃ここから字下げ］~~#~二行~~［＃ここで字下げ終わり］~~", 0, 1),
    ("nested containers", "［＃罫囲み］~［＃ここから地付き］~#~［＃ここで地付き終わり］~外~［＃罫囲み終わり］", '<div class="@class-container @class-container-keigakomi">~<div class="@class-container @class-container-align-end" data-offset="0">~<p>#</p>~</div>~<p>外</p>~</div>', "~~［＃罫囲み］~~［＃ここから地付き］~~#~~［＃ここで地付き終わり］~~外~~［＃罫囲み終わり］~~", 0, 2),
    ("heading", "第一章［＃「第一章」は大見出し］#", "<p>第一章<!-- @element_heading_hint -->#</p>~", "第一章［＃「第一章」は大見出し］#", 0, 0),
    ("return marks", "不［＃レ］帰［＃一レ］#", '<p>不<sup class="@class-kaeriten">レ</sup>帰<sup class="@class-kaeriten">一レ</sup>#</p>~', "不［＃レ］帰［＃一レ］#", 0, 0),
    ("picture", "［＃挿絵（#.png）入る］", "<!-- @element_sashie -->", "~~［＃挿絵（#.png）入る］~~", 0, 0),
    ("unknown", "［＃謎の#］", '<p><span class="@class-annotation" hidden>［＃謎の#］</span></p>~', "［＃謎の#］", 0, 0),
    ("split note", "本文［＃割り注］#［＃割り注終わり］", '<p>本文<span class="@class-warichu">#</span></p>~', "本文［＃割り注］#［＃割り注終わり］", 0, 0),
    ("paragraphs", "一~#~~三", "<p>一<br />~#</p>~<p>三</p>~", "一~#~~三", 0, 0),
    ("escapes", "<#&>", "<p>&lt;#&amp;&gt;</p>~", "<#&>", 0, 0),
    ("never closed", "開いた［＃ここから1字下げ］~#", '<p>開いた</p>~<div class="@class-container @class-container-indent @class-container-indent-1" data-amount="1">~<p>#</p>~', "開いた~~［＃ここから字下げ］~~#", 0, 0),
    ("dialogue", "「#台詞《せりふ》」", "<p>「#台詞《せりふ》」</p>~", "「#台詞《せりふ》」", 0, 0),
    ("open quote", "#「", "<p>#「</p>~", "#「", 1, 0),
    ("stray closer", "》#", "<p>》#</p>~", "》#", 1, 0),
]
_GOLDEN_SQL = ", ".join("({})".format(", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in (c[0], *c[2:]))) for c in _GOLDEN)


@query(f"""SELECT "case", CAST(n_nationkey AS BIGINT) AS k, replace(replace(html, '~', chr(10)), '#', n_name) AS html, replace(replace(source, '~', chr(10)), '#', n_name) AS serialized, diagnostics AS n_diagnostics, pairs AS n_container_pairs FROM nation, (VALUES {_GOLDEN_SQL}) AS v("case", html, source, diagnostics, pairs)""")
def golden_cases(spark, d):
    """Worked cases of most constructs, nested ones too, each with the names of all nations in it (a fixed list of cases is broadcast)."""
    cases = F.broadcast(spark.createDataFrame([c[:2] for c in _GOLDEN], "case string, source string"))
    source = F.replace(F.replace("source", lit("~"), lit("\n")), lit("#"), F.col("n_name"))
    own = t(spark, d, "nation").join(cases).select("case", F.col("n_nationkey").cast("long").alias("k"), source.alias("source"))
    p = parse.parse(own, ["html", "serialized", "diagnostics", "container_pairs"])
    return p.select("case", "k", "parsed.html", "parsed.serialized", F.size("parsed.diagnostics").alias("n_diagnostics"), F.size("parsed.container_pairs").alias("n_container_pairs"))


_CASE_COLUMNS = ["html", "serialized", "nodes_json", "pairs_json", "diagnostics_json", "container_pairs_json"]
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_CASES_SQL = ", ".join(f"({i}, {', '.join(map(_quoted, (c[0], *c[3:])))})" for i, c in enumerate(FIXED_CASES))


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS doc_id, "case", {", ".join(_CASE_COLUMNS)} FROM customer JOIN (VALUES {_CASES_SQL}) AS v(i, "case", {", ".join(_CASE_COLUMNS)}) ON c_custkey % {len(FIXED_CASES)} = i""")
def fixed_cases(spark, d):
    """Each customer's case (a fixed list, broadcast) through all six projections."""
    cases = F.broadcast(spark.createDataFrame([(i, c[0], c[2]) for i, c in enumerate(FIXED_CASES)], "i int, case string, source string"))
    own = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")).join(cases, F.col("doc_id") % len(FIXED_CASES) == F.col("i")).select("doc_id", "case", "source")
    p = parse.parse(own, ["html", "serialized", "nodes", "pair_links", "diagnostics", "container_pairs"])
    json = {"nodes": "nodes", "pairs": "pair_links", "diagnostics": "diagnostics", "container_pairs": "container_pairs"}
    return p.select("doc_id", "case", "parsed.html", "parsed.serialized", *[wire.wire_column(n, F.col(f"parsed.{k}")).alias(f"{n}_json") for n, k in json.items()])


@query(f"""SELECT level, coalesce(n, 0) AS total, coalesce(n, 0) AS passed, 0 AS failed FROM (VALUES ('must'), ('should'), ('may')) AS l(level) LEFT JOIN (SELECT level, count(*) AS n FROM customer JOIN (VALUES {", ".join(f"({i}, '{c[1]}')" for i, c in enumerate(FIXED_CASES))}) AS v(i, level) ON c_custkey % {len(FIXED_CASES)} = i GROUP BY level) USING (level)""")
def fixed_cases_summary(spark, d):
    """The same cases by level: all pass."""
    prefixed = lambda x: x.replace("@class-", V.CLASS_PREFIX).replace("@element_", V.ELEMENT_PREFIX)
    cases = F.broadcast(spark.createDataFrame([(i, c[0], c[1], c[2], prefixed(c[3]), c[4]) for i, c in enumerate(FIXED_CASES)], "i int, case string, level string, source string, html string, serialized string"))
    return conformance.summary(t(spark, d, "customer").select("c_custkey").join(cases, F.col("c_custkey") % len(FIXED_CASES) == F.col("i")).drop("c_custkey", "i"))


@query("""SELECT level, coalesce(n, 0) AS total, coalesce(p, 0) AS passed, coalesce(n, 0) - coalesce(p, 0) AS failed FROM (VALUES ('must'), ('should'), ('may')) AS v(level) LEFT JOIN (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'may' ELSE 'must' END AS level, count(*) AS n, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS p FROM customer GROUP BY 1) USING (level)""")
def conformance_run(spark, d):
    """Cases whose expected output is made by hand; every tenth is wrong."""
    wrong = F.when(F.col("c_custkey") % 10 == 0, "!").otherwise("")
    html = F.concat(lit("<p><ruby>字<rp>(</rp><rt>"), "c_name", lit("</rt><rp>)</rp></ruby></p>\n"), wrong)
    cases = t(spark, d, "customer").select(F.col("c_custkey").alias("case"), lit("ruby").alias("feature"), F.when(F.col("c_custkey") % 3 == 0, "may").otherwise("must").alias("level"), F.concat(lit("字《"), "c_name", lit("》")).alias("source"), html.alias("html"), F.concat(lit("｜字《"), "c_name", lit("》")).alias("serialized"))
    return conformance.summary(cases)


@query("""SELECT 'small' AS band, count(*) AS n, sum(strlen(c_name) + 8) / sum(strlen(c_name)) AS html_ratio, sum(strlen(c_name)) / sum(c_custkey) AS time_ratio FROM customer""")
def render_ratios(spark, d):
    p = parse.parse(t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("source")), ["html"])
    own = p.select("source", F.col("parsed.html").alias("html"), F.col("c_custkey").alias("a"), F.octet_length("source").alias("b"))
    return stats.render_ratio(own, "source", "html", "a", "b")


@query("""SELECT doc_id, CAST(len(text) - len(replace(text, chr(10), '')) AS INTEGER) AS n FROM documents""")
def stream_diagnostics(spark, d):
    """The documents as a stream, each line end a stray closer."""
    schema = t(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*").select("doc_id", F.replace("text", lit("\n"), lit("」")).alias("source"))
    found = watch.parse_stream(stream, ["diagnostics"]).select("doc_id", F.size("parsed.diagnostics").alias("n"))
    return watch.run_once(found, _new_folder(spark, "stream"))


# Throughput


def _book(spark, d) -> DataFrame:
    """The documents with notation in them: readings, emphasis, an out-of-set character, a container."""
    words = F.split("text", " ")
    head = F.concat(lit("［＃ここから2字下げ］\n｜"), F.get(words, lit(0)), lit("《よみ》漢字《かんじ》"))
    tail = F.concat(lit("「"), F.get(words, lit(1)), lit("」［＃「漢字」に傍点］※［＃「木＋吶のつくり」、第3水準1-85-54］\n［＃ここで字下げ終わり］\n［＃改ページ］"))
    own = F.concat(head, F.replace("text", lit(". "), lit("。《《強調》》［＃「強調」は縦中横］")), tail)
    return t(spark, d, "documents").select("doc_id", own.alias("source"))


@query()
def parse_corpus(spark, d):
    """Every table and projection of every document at once."""
    p = parse.parse(_book(spark, d), ["nodes", "pair_links", "container_pairs", "diagnostics", "html", "serialized"])
    return p.select("doc_id", *[F.size(f"parsed.{k}").alias(f"n_{k}") for k in ("nodes", "pair_links", "container_pairs", "diagnostics")], F.sha2("parsed.html", 256).alias("html"), F.sha2("parsed.serialized", 256).alias("serialized"))


@query()
def node_counts(spark, d):
    return parse.nodes(_book(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))
