"""Redaction and anonymization.

The rewrite of a document needs its text and its confirmed spans.  Where the
spans come straight from detection, they are still in the document's row
(``detect.detect_arrays``) and nothing is shuffled.  Spans that went through a
review are grouped per document (one shuffle of spans) and joined to the
documents on doc_id.  Storing documents bucketed by doc_id
(``sources.io.write_bucketed``) makes that join co-located, so the document
text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import docspans as ds
from ..functions import spans as sp
from ..functions import tables as tb
from ..functions.batches import row_bytes, small
from ..session import cut_lineage
from .detect import matcher

CONFIRMED = ("redacted", "added")


def confirmed(dets: DataFrame) -> DataFrame:
    """only spans whose status is redacted or added are applied."""
    return dets.filter(F.col("status").isin(*CONFIRMED))


def _strip(c: Column) -> Column:
    """Without blanks at both ends; no-break, ideographic and the other Unicode blanks count, too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Every run of letters starts with a capital, whatever stands before it (``api-key`` -> ``Api-Key``)."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def anonymized_label(type_: Column) -> Column:
    """Fixed label for known types, else '[Title Case]' of the type without
    a country prefix."""
    clean = F.regexp_replace(F.regexp_replace(type_, tb.COUNTRY_PREFIX_PATTERN, ""), "_", " ")
    generic = F.concat(F.lit("["), title(clean), F.lit("]"))
    return F.coalesce(sp.safe_lookup(tb.ANONYMIZED_REPLACEMENTS, type_), generic)


def block(text: Column) -> Column:
    return F.repeat(F.lit(tb.BLOCK_CHAR), F.greatest(F.length(text), F.lit(tb.MIN_BLOCK)))


def effective_mode(action_mode: Column, global_mode: Column) -> Column:
    """Mode that decides the rewrite of one span."""
    return (F.when(action_mode == "highlight_red", F.lit("highlight_red"))
            .when(global_mode == "highlight", F.lit("highlight"))
            .when(action_mode.isin("redact", "anonymize"), action_mode)
            .otherwise(global_mode))


def replacement_text(text: Column, type_: Column, action_mode: Column, custom: Column,
                     global_mode: Column) -> Column:
    """custom replacement (trimmed, non-empty) first; highlight modes
    keep the text; anonymize uses the label; redact uses a block of
    max(len, 6) characters."""
    c = _strip(custom)
    mode = effective_mode(action_mode, global_mode)
    return (F.when(c.isNotNull() & (F.length(c) > 0), c)
            .when(mode.isin("highlight_red", "highlight"), text)
            .when(mode == "anonymize", anonymized_label(type_))
            .otherwise(block(text)))


def mask_by_rule(text: Column, rule: Column, keep_last: int = 4) -> Column:
    """F8 (opt-in): mask_partial keeps the last 4 characters of a longer text; a text of up to 4 characters
    and mask_full are blocked whole."""
    n = F.length(text)
    partial = F.concat(F.repeat(F.lit(tb.BLOCK_CHAR), F.greatest(n - keep_last, F.lit(0))),
                       F.substring(text, -keep_last, keep_last))
    return F.when((rule == "mask_partial") & (n > keep_last), partial).otherwise(block(text))


def span_arrays(spans: DataFrame, rep_col: str = "rep") -> DataFrame:
    """Per document: array<struct<s, e, rep>> sorted by start (one shuffle of spans)."""
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("char_start").cast("int").alias("s"), F.col("char_end").cast("int").alias("e"),
        F.col(rep_col).alias("rep")))).alias("_spans"))


def pack_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` as compressed bytes (its length, then zstd), for a shuffle of whole texts: they take about two thirds
    of what the shuffle's own compression makes of them.  ``apply_spans`` takes such a column for its texts."""
    names, at = df.columns, df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in small(batches):
            packed = pa.array([None if t is None else len(t).to_bytes(4, "big") + codec.compress(t, asbytes=True) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], names=names)
    raw = df.withColumn(text_col, F.col(text_col).cast("binary"))
    return raw.mapInArrow(run, raw.schema)


def _whole_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """``row_bytes`` with the packed texts at their whole lengths."""
    size = row_bytes(batch)
    for column in batch.columns:
        if pa.types.is_binary(column.type):
            size += np.array([int.from_bytes(t or b"", "big") for t in pc.binary_slice(column, 0, 4).to_pylist()], dtype=np.int64)
    return size


def _unpacked(column: pa.Array) -> pa.Array:
    """The texts, byte for byte as they were packed."""
    codec = pa.Codec("zstd")
    raw = [None if t is None else codec.decompress(t[4:], int.from_bytes(t[:4], "big"), asbytes=True) for t in column.to_pylist()]
    return pa.array(raw, pa.binary()).cast(pa.string(), safe=False)


def apply_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` (texts, or packed by ``pack_texts``) rewritten by its array column ``_spans`` (structs s, e, rep; null or empty:
    unchanged), which is dropped.  Spans may overlap: all they cover is replaced."""
    names = [c for c in df.columns if c != "_spans"]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, size=_whole_bytes):
            spans = batch.column(len(names)).to_pylist()
            text = _unpacked(batch.column(at)) if pa.types.is_binary(batch.column(at).type) else batch.column(at)
            if any(spans):
                text = pa.array([t if not x or t is None else ds.rewrite(t, ((i["s"], i["e"], i["rep"]) for i in x))
                                 for t, x in zip(text.to_pylist(), spans, strict=True)], text.type)
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns[:-1])], names=names)
    return df.select(*names, "_spans").mapInArrow(run, df.select(*names).withColumn(text_col, F.col(text_col).cast("string")).schema)


#: spans of at most so many documents are broadcast to the texts; of more, both are shuffled
MOST_TOUCHED = 200_000


def redact_documents(docs: DataFrame, spans: DataFrame, rep_col: str = "rep", text_col: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """Documents with every span rewritten; documents without spans pass unchanged.  The span table is
    written once and counted, so that with few touched documents no text is shuffled.

    With ``rows`` (doc_id and other columns) the texts are those of these rows, beside their columns (null where no document is).  They
    meet the spans first, then the texts, so a text is shuffled once (packed) and the spans are not sent to the driver."""
    arr = span_arrays(spans, rep_col)
    if rows is not None:
        texts = pack_texts(docs.select("doc_id", F.col(text_col).alias("text")))
        j = rows.join(arr, "doc_id", "left").join(texts, "doc_id", "left")
        return apply_spans(j.select(*rows.columns, "text", "_spans"))
    arr = cut_lineage(arr, "spans")
    if arr.limit(MOST_TOUCHED + 1).count() <= MOST_TOUCHED:
        arr = F.broadcast(arr)
    j = docs.join(arr, "doc_id", "left")
    return apply_spans(j.select("doc_id", F.col(text_col).alias("text"), "_spans"))


def redact_detected(detected: DataFrame, rep, text_col: str = "text") -> DataFrame:
    """Detection and rewrite in one row: ``detected`` (from ``detect.detect_arrays``) holds the detections in
    the array ``dets``; ``rep`` gives the replacement of one of them (a struct column)."""
    live = F.filter("dets", lambda x: x["status"].isin(*CONFIRMED))
    spans = F.transform(live, lambda x: F.struct(x["char_start"].cast("int").alias("s"), x["char_end"].cast("int").alias("e"), rep(x).alias("rep")))
    return apply_spans(detected.select("doc_id", F.col(text_col).alias("text"), spans.alias("_spans")))


def redact_cells(cells: DataFrame, text_col: str = "text", patterns=tb.HEURISTIC_PATTERNS) -> DataFrame:
    """``cells`` with the pattern matches of each cell blocked out; one narrow stage, every row comes back."""
    names, at = cells.columns, cells.columns.index(text_col)
    make = matcher(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        for batch in small(batches):
            out = []
            for text in batch.column(at).to_pylist():
                spans = [{"char_start": s, "char_end": e, "confidence": 0.0, "type": ""} for _, _, s, e, _ in found.find(text or "")]
                spans = ds.union(sorted(spans, key=lambda s: s["char_start"]), text) if spans else []
                out.append(ds.rewrite(text, ((s["char_start"], s["char_end"], tb.BLOCK_CHAR * max(len(s["text"]), tb.MIN_BLOCK)) for s in spans))
                           if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, c.type) if i == at else c for i, c in enumerate(batch.columns)], names=names)
    return cells.mapInArrow(run, cells.schema)


def redact_by_value(units: DataFrame, values: DataFrame, unit_keys=("doc_id",), text_col: str = "text") -> DataFrame:
    """replace every occurrence of each detected text, not the offset.

    ``values``: doc_id, text, rep, ord (replacement order = detection order).
    ``units``: the text units (documents or nodes/regions) keyed by doc_id.
    Replacements run in order, each over the output of the previous one; many values of a document are found in one
    pass over its text (``docspans.replace_values``).  A null text stays; a null replacement makes the text null.
    """
    vals = values.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(
        F.col("ord").alias("o"), F.col("text").alias("v"), F.col("rep").alias("r")))).alias("_vals"))
    names = units.columns
    at = names.index(text_col)
    j = units.join(vals, "doc_id", "left").select(*names, "_vals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            lists, texts = batch.column(len(names)), batch.column(at)
            out = []
            for text, pairs in zip(texts, lists, strict=True):
                if not text.is_valid or not pairs.is_valid:
                    out.append(text.as_py())
                    continue
                pairs = [(p["v"], p["r"]) for p in pairs.as_py() if p["v"]]
                out.append(None if any(r is None for _, r in pairs) else ds.replace_values(text.as_py(), pairs))
            yield pa.RecordBatch.from_arrays([pa.array(out, texts.type) if i == at else c for i, c in enumerate(batch.columns[:-1])], names=names)
    return j.mapInArrow(run, units.select(*names).schema)


def highlight_annotations(dets: DataFrame, global_mode: Column) -> DataFrame:
    """keep the text, attach a colour and the reason (highlight modes only)."""
    mode = effective_mode(F.col("action_mode"), global_mode)
    det_mode = F.when(F.col("action_mode").isin("redact", "anonymize"), F.col("action_mode")).otherwise(global_mode)
    colour = (F.when(mode == "highlight_red", F.lit("red"))
              .when(mode == "highlight", F.when(det_mode == "anonymize", F.lit("green")).otherwise(F.lit("yellow"))))
    return dets.select("doc_id", "det_id", "char_start", "char_end", colour.alias("colour"), "reason") \
        .filter(F.col("colour").isNotNull())


#: the metadata fields of a page and the names of <meta> elements that give them, first come first served
META_NAMES = {"author": ("author", "dc.creator", "article:author"), "creator": ("creator", "application-name"), "title": ("og:title", "dc.title"),
              "created": ("article:published_time", "dcterms.created", "date"), "modified": ("article:modified_time", "dcterms.modified", "last-modified"),
              "tool": ("generator",)}
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def extract_metadata(html: Column) -> Column:
    """F10 re-aimed to HTML: struct of author, creator, title, created, modified, tool; '' where the page does not give it (or is null).

    Values come from <meta> elements (any case and order of attributes, any quotes) by ``META_NAMES``; of several elements the
    first with a value counts.  The title is that of <title>, else of a <meta>; blanks around values go.
    """
    def attribute(tag: Column, names: str) -> Column:
        raw = F.regexp_extract(tag, rf"(?is)[\s\"']{names}{_VALUE}", 1)
        return F.trim(F.when(raw.rlike("^[\"']"), F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw))
    tags = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\s(?:[^>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(attribute(t, "(?:name|property|http-equiv)")).alias("name"), attribute(t, "content").alias("value")))

    def first(name: str) -> Column:
        return F.get(F.filter(pairs, lambda p: (p["name"] == name) & (p["value"] != "")), F.lit(0))["value"]

    def field(names) -> Column:
        return F.coalesce(*map(first, names), F.lit(""))
    title = F.trim(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>([^<]*)</title", 1))
    out = {k: field(names) for k, names in META_NAMES.items()}
    out["title"] = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(out["title"])
    return F.struct(*[v.alias(k) for k, v in out.items()])


def metadata_map(fields: Column) -> Column:
    """The struct of ``extract_metadata`` as the map that ``metadata_audit`` reads."""
    names = {"author": "author", "creator": "creator", "producer": "tool", "title": "title", "creationDate": "created", "modDate": "modified"}
    return F.create_map(*[x for k, f in names.items() for x in (F.lit(k), fields[f])])


def metadata_audit(meta: Column, kind: Column, engine: str = "Spanveil") -> Column:
    """audit strings for every non-empty metadata field, in field order.

    ``meta`` is map<string,string>; ``kind`` is 'pdf' or 'docx'.  The rewritten
    creator/producer name is the ``engine`` parameter.
    """
    def entries(spec):
        out = []
        for field, template in spec:
            v = F.element_at(meta, F.lit(field))
            msg = F.lit(template.replace("{engine}", engine))
            parts = template.replace("{engine}", engine).split("{v}")
            txt = F.concat(F.lit(parts[0]), v, F.lit(parts[1])) if len(parts) == 2 else msg
            out.append(F.when(F.coalesce(F.length(v), F.lit(0)) > 0, txt))
        return out

    pdf = F.filter(F.array(*entries(tb.PDF_METADATA_AUDIT)), lambda x: x.isNotNull())
    rev = F.element_at(meta, F.lit("revision")).cast("int")
    docx_items = entries(tb.DOCX_METADATA_AUDIT) + [
        F.when(rev > 1, F.lit(tb.DOCX_REVISION_AUDIT.replace("{v}", "\u0000")))]
    docx = F.transform(F.filter(F.array(*docx_items), lambda x: x.isNotNull()),
                       lambda x: F.replace(x, F.lit("\u0000"), rev.cast("string")))
    return F.when(kind == "pdf", pdf).when(kind == "docx", docx).otherwise(F.array().cast("array<string>"))


def clean_metadata(meta: Column, kind: Column, engine: str = "Spanveil") -> Column:
    """metadata after stripping (identifying fields emptied, title and tool rewritten)."""
    pdf = F.create_map(F.lit("author"), F.lit(""), F.lit("creator"), F.lit(f"{engine} Redaction Engine"),
                       F.lit("producer"), F.lit(engine), F.lit("title"), F.lit("Redacted Document"),
                       F.lit("subject"), F.lit(""), F.lit("keywords"), F.lit(""),
                       F.lit("creationDate"), F.lit(""), F.lit("modDate"), F.lit(""))
    listed = [f for f, _ in tb.DOCX_METADATA_AUDIT]
    emptied = F.transform_values(meta, lambda k, v: F.when(~k.isin(*listed, "revision") | (F.coalesce(F.length(v), F.lit(0)) == 0), v)
                                 .when(k == "title", F.lit("Redacted Document")).when(k == "revision", F.lit("1")).otherwise(F.lit("")))
    return F.when(kind == "pdf", pdf).otherwise(emptied)


#: an href attribute in any case, its value in either quotes or in none
_HREF = r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def detach_links(html: Column) -> tuple[Column, Column]:
    """F11 re-aimed to HTML: (list of detached URIs, html with every href removed)."""
    values = F.regexp_extract_all(html, F.lit(_HREF), F.lit(1))
    uris = F.transform(values, lambda v: F.when(v.rlike("^[\"']"), F.substring(v, 2, F.length(v) - 2)).otherwise(v))
    return uris, F.regexp_replace(html, r"(?i)\s*" + _HREF[4:], "")
