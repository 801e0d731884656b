"""The kernel on DataFrames: one Python crossing in Arrow batches, no shuffle, since a document is a row.

``parse`` adds a struct with the parts asked for; the table functions explode one part each. All of it works on streams too.
Null sources give null parts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from . import pairs

_PART = "array<struct<seg_kind:string,text:string,ucs:string,mencode:string,annotation_kind:string>>"
_ATTRS = f"struct<base:{_PART},reading:{_PART},explicit:boolean,bouten_kind:string,position:string,content:{_PART},description:string,ucs:string,mencode:string,amount:smallint,offset:smallint,section:string,level:smallint,target:string,file:string,mark:string,raw:string,annotation_kind:string,container:string>"
#: Parts of a parsed document: type, and how to get it.
PARTS = {
    "text": ("string", lambda p: p.text),
    "sanitized_len": ("long", lambda p: p.at(len(p.text))),
    "normalized": ("string", lambda p: p.normalized),
    "pair_links": ("array<struct<kind:string,open_start:int,open_end:int,close_start:int,close_end:int>>", lambda p: p.pair_links()),
    "events": ("array<struct<event:string,kind:string,start:int,end:int,match_idx:int>>", lambda p: [{"event": e.what, "kind": e.kind, "start": p.at(e.start), "end": p.at(e.end), "match_idx": e.match if e.match >= 0 else None} for e in p.events]),
    "spans": ("array<struct<span_kind:string,start:int,end:int>>", lambda p: p.span_rows()),
    "nodes": (f"array<struct<node_ref:string,kind:string,start:int,end:int,norm_pos:int,attrs:{_ATTRS}>>", lambda p: p.node_rows()),
    "container_pairs": ("array<struct<kind:string,amount:smallint,offset:smallint,open_norm:int,close_norm:int>>", lambda p: p.container_pairs()),
    "diagnostics": ("array<struct<kind:string,severity:string,source:string,start:int,end:int,codepoint:string,pair_kind:string>>", lambda p: p.diagnostics()),
    "html": ("string", lambda p: p.html()),
    "serialized": ("string", lambda p: p.serialize()),
    "cst": ("array<struct<ord:int,depth:int,parent_ord:int,kind:string,text:string,start:int,end:int>>", lambda p: p.cst()),
    "pandoc": ("string", lambda p: p.pandoc()),
}
#: Rows of a batch parsed together, which bounds what a worker holds.
ROWS = 256
#: Partitions a core that texts are dealt out to before they are read.
TASKS = 4


def schema_of(parts: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(PARTS[k][0])) for k in parts])


def parse(df: DataFrame, parts: Sequence[str], source: str = "source", out: str = "parsed", quoted_from: int | None = None, dealt: bool = False) -> DataFrame:
    """Adds the struct ``out`` with the named parts. Rows are dealt out to all cores first (``spread``) unless ``dealt`` says that they are.

    With ``quoted_from``, targets of forward annotations must have been quoted before in texts with at least so many different quotes.
    """
    struct = schema_of(parts)
    schema = T.StructType([*df.schema.fields, T.StructField(out, struct)])
    arrow, at = to_arrow_type(struct), df.columns.index(source)
    makers = [(k, PARTS[k][1]) for k in parts]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernel import Parsed

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                rows = []
                for text in b.column(at).to_pylist():
                    p = None if text is None else Parsed(text, quoted_from)
                    rows.append({k: None if p is None else make(p) for k, make in makers})
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow)], [*b.schema.names, out])

    return (df if dealt else spread(df)).mapInArrow(f, schema)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out by their hash to four partitions a core. Streams stay as they are.

    Reading a row costs far more here than moving it, and a file of few row groups is read by as few tasks, however many splits it has. By hash and not in turns,
    since Spark sorts what it deals in turns; only rows that are equal in all plain columns go together.
    """
    if df.isStreaming:
        return df
    plain = (T.StringType, T.BinaryType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    keys = [F.col(f"`{f.name.replace('`', '``')}`") for f in df.schema.fields if isinstance(f.dataType, plain) and df.columns.count(f.name) == 1]
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *keys)


def _exploded(df: DataFrame, part: str, key: str, source: str, seq: str = "seq") -> DataFrame:
    found = parse(df.select(key, source), [part], source)
    return found.select(key, F.posexplode(f"parsed.{part}").alias(seq, "_x")).select(key, seq, "_x.*")


def pair_events(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    return _exploded(df, "events", key, source, "idx")


def pair_links(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Pairs in the order of their closers, without Python."""
    return pairs.exploded(spread(df.select(key, source)), pairs.links(X.sanitize(F.col(source))), key)


def spans(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    return _exploded(df, "spans", key, source)


def nodes(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    return _exploded(df, "nodes", key, source)


def container_pairs(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Containers by the order of their closers, matched in Column expressions over the nodes; documents without a bracket don't reach Python."""
    own = df.select(key, source).filter(F.col(source).contains("［＃"))
    return pairs.exploded(parse(own, ["nodes"], source).select(key, X.let(F.col("parsed.nodes"), pairs.containers).alias("_c")), F.col("_c"), key)


def diagnostics(df: DataFrame, key: str = "doc_id", source: str = "source", internal: bool = False) -> DataFrame:
    """Without those of internal origin unless asked for (there are none); no Python."""
    found = pairs.exploded(spread(df.select(key, source)), pairs.diagnostics(X.sanitize(F.col(source))), key)
    return found if internal else found.filter("source <> 'internal'")


def check(df: DataFrame, key: str = "doc_id", source: str = "source", strict: bool = False) -> DataFrame:
    """A row for each document: ``n_diagnostics, n_errors, passed``. Errors fail a document, with ``strict`` every diagnostic does; null sources have none."""
    found = spread(df.select(key, source)).select(key, X.let(pairs.diagnostics(X.sanitize(F.col(source))), lambda d: F.struct(F.size(d).alias("n"), F.size(F.filter(d, lambda x: x["severity"] == "error")).alias("e"))).alias("d"))
    counted = found.select(key, F.coalesce("d.n", F.lit(0)).alias("n_diagnostics"), F.coalesce("d.e", F.lit(0)).alias("n_errors"))
    return counted.withColumn("passed", F.col("n_diagnostics" if strict else "n_errors") == 0)


def cst(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The lossless tree, preorder."""
    return _exploded(df, "cst", key, source).drop("seq")


def tokens(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Tokens with byte spans, without Python or a shuffle: ``idx, token_kind, trigger_kind, start, end``."""
    starts = lambda t: X.let(F.transform(t, lambda x: F.octet_length(x).cast("long")), lambda n: X.running_sums(n))
    both = X.let(X.tokens(F.coalesce(F.col(source), F.lit(""))), lambda t: F.arrays_zip(t.alias("t"), starts(t).alias("s")))
    each = spread(df.select(key, source)).select(key, F.posexplode(both).alias("idx", "_x")).select(key, "idx", F.col("_x.t").alias("t"), F.col("_x.s").alias("start"))
    return each.select(key, "idx", X.token_kind(F.col("t")).alias("token_kind"), X.trigger_kind(F.col("t")).alias("trigger_kind"), "start", (F.col("start") + F.octet_length("t")).alias("end"))


def edit(df: DataFrame, start: str, end: str, replacement: str, source: str = "source") -> DataFrame:
    """Bytes from start to end replaced; a range out of the text or out of order gives null."""
    raw = F.encode(source, "UTF-8")
    ok = (F.col(start) >= 0) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.octet_length(source))
    whole = F.concat(F.substring(raw, F.lit(1), F.col(start)), F.encode(replacement, "UTF-8"), F.substring(raw, F.col(end) + 1, F.octet_length(source)))
    return df.withColumn(source, F.when(ok, F.try_validate_utf8(whole.cast("string"))))


def visit(nodes_df: DataFrame, visitors: dict[str, object], otherwise=None) -> DataFrame:
    """Adds ``visited``: for each node the Column that its kind's function makes of the row; others get ``otherwise`` or null."""
    out = None
    for kind, f in visitors.items():
        value = f(nodes_df)
        out = F.when(F.col("kind") == kind, value) if out is None else out.when(F.col("kind") == kind, value)
    last = F.lit(None) if otherwise is None else otherwise(nodes_df)
    return nodes_df.withColumn("visited", last if out is None else out.otherwise(last))


def register(spark: SparkSession) -> None:
    """SQL users get ``parse_notation(text)``, a table of nodes, and scalar functions for the text projections."""

    class ParseNotation:
        def eval(self, text: str):
            from .kernel import Parsed

            if text is not None:
                for i, n in enumerate(Parsed(text).node_rows()):
                    yield i, n["node_ref"], n["kind"], n["start"], n["end"], n["norm_pos"]

    spark.udtf.register("parse_notation", F.udtf(ParseNotation, returnType="seq int, node_ref string, kind string, start int, `end` int, norm_pos int"))

    def scalar(part: str):
        import pandas as pd

        def f(texts: pd.Series) -> pd.Series:
            from .kernel import Parsed

            return texts.map(lambda t: None if t is None else PARTS[part][1](Parsed(t)))

        f.__annotations__ = {"texts": pd.Series, "return": pd.Series}
        return F.pandas_udf(f, T.StringType())

    for name, part in (("notation_html", "html"), ("notation_source", "serialized"), ("notation_pandoc", "pandoc")):
        spark.udf.register(name, scalar(part))
