"""Chat formatting with typed content parts.

A message holds an array of parts (``PART``). ``PartVisitor`` flattens them into
one body: text parts are escaped, every other part leaves an ordered
placeholder, an attachment reference and the number of tokens it will expand to.
A turn becomes ``<turn ROLE>BODY</turn>`` and a line feed. In texts a backslash
becomes two and ``<`` becomes ``\\l`` (in roles also ``>`` becomes ``\\g``), so no
text can hold a control string and reading back is exact. An attachment keeps the
text that stood for it, if any, and reading puts it back in its place.

A formatted conversation is its segments in order, one row a turn with offsets
left to the reader; it is never gathered in one row, so a conversation of any
length stays bounded.

Defined results: null texts, roles and parts are empty; rows of equal turn go
by role, then text; repeated rows are turns of their own; a null conversation id
is a conversation; texts of any length are one segment; other columns, whatever
their names, are not read; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links to media in a text, and the kind of part that a file ending stands for.
MEDIA_LINK = r"!\[[^\]\n]*\]\([^()\s]+\)"
MEDIA_KINDS = {"image": "png|jpe?g|gif|webp", "audio": "mp3|wav|ogg|flac", "document": "pdf|docx?|txt|md"}
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
LOSS_ROLE = "assistant"


def escape(text: Column, in_role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if in_role else out


def unescape(text: Column) -> Column:
    """Pairs of backslashes split the text from the left; no piece between them holds an escaped backslash."""
    pieces = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))), "\\")


class PartVisitor:
    """Body, attachment and token count of each kind of part; override a method to change a kind."""

    tile, tile_tokens, image_tokens = 512, 170, 85
    tokens_a_second, tokens_a_page = 25, 800

    def placeholder(self, part: Column, at: Column) -> Column:
        return F.concat(F.lit("<part "), escape(part["type"], True), F.lit(" "), at.cast("string"), F.lit(">"))

    def image_count(self, part: Column) -> Column:
        tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / self.tile) * F.ceil(F.coalesce(part["height"], F.lit(1)) / self.tile)
        return F.lit(self.image_tokens) + tiles * self.tile_tokens

    def audio_count(self, part: Column) -> Column:
        return F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.tokens_a_second)

    def document_count(self, part: Column) -> Column:
        return F.coalesce(part["pages"], F.lit(1)) * self.tokens_a_page

    def visit(self, part: Column, at: Column) -> Column:
        is_text = F.coalesce(part["type"], F.lit("text")) == "text"
        count = F.when(is_text, 0).when(part["type"] == "image", self.image_count(part)).when(part["type"] == "audio", self.audio_count(part)).when(part["type"] == "document", self.document_count(part)).otherwise(0)
        return F.struct(
            F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(self.placeholder(part, at)).alias("body"),
            F.when(~is_text, F.struct(at.alias("position"), part["type"].alias("type"), part["uri"].alias("uri"), F.coalesce(part["text"], F.lit("")).alias("source"))).alias("attachment"),
            F.greatest(count, F.lit(0)).cast("long").alias("tokens"),
        )


def _part(kind: Column, text: Column, uri: Column) -> Column:
    rest = {n: F.lit(None).cast(t) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))}
    return F.struct(kind.alias("type"), text.alias("text"), uri.alias("uri"), *(c.alias(n) for n, c in rest.items()))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(_part(F.lit("text"), F.coalesce(text, F.lit("")), F.lit(None).cast("string")))


def linked_parts(text: Column) -> Column:
    """A message cut at its links to media: text parts, and between them parts of the kind that each link's ending tells."""
    text = F.coalesce(text, F.lit(""))
    links = F.regexp_extract_all(text, F.lit(MEDIA_LINK), F.lit(0))

    def link(x: Column) -> Column:
        uri = F.regexp_extract(x, r"\]\(([^()\s]+)\)$", 1)
        kind = F.lit("image")
        for name, endings in MEDIA_KINDS.items():
            kind = F.when(F.lower(uri).rlike(rf"\.({endings})$"), name).otherwise(kind)
        return _part(kind, x, uri)

    nothing = F.lit(None).cast("string")
    cut = F.flatten(F.transform(F.split(text, MEDIA_LINK, -1), lambda t, i: F.when(i < F.size(links), F.array(_part(F.lit("text"), t, nothing), link(F.get(links, i)))).otherwise(F.array(_part(F.lit("text"), t, nothing)))))
    return F.when(F.contains(text, F.lit("](")), cut).otherwise(text_parts(text))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None) -> DataFrame:
    """One segment a turn: ``(conv_id, turn, segment, loss_start, loss_chars, attachments, expanded_tokens)``.

    ``loss_start`` (from 0) and ``loss_chars`` are the code points of the
    segment under the loss mask: the body of assistant turns.
    """
    visitor = visitor or PartVisitor()
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.transform(F.col(parts_col), visitor.visit), F.array()).alias("seen"))
    rows = rows.select("conv_id", "turn", "role", F.array_join(F.col("seen.body"), "").alias("body"), F.filter(F.col("seen.attachment"), lambda a: a.isNotNull()).alias("attachments"), F.aggregate(F.col("seen.tokens"), F.lit(0).cast("long"), lambda a, b: a + b).alias("expanded_tokens"))
    head, masked = F.concat(F.lit("<turn "), escape(F.col("role"), True), F.lit(">")), F.col("role") == LOSS_ROLE
    return rows.select("conv_id", "turn", F.concat(head, F.col("body"), F.lit("</turn>\n")).alias("segment"), F.when(masked, F.length(head)).alias("loss_start"), F.when(masked, F.length("body")).otherwise(0).alias("loss_chars"), "attachments", "expanded_tokens")


def _read_body(body: Column) -> Column:
    """A body's text, with what stood for each attachment back in the place of its placeholder."""
    pieces = F.split(body, "<part [^>]*>", -1)
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(unescape(p), F.coalesce(F.get("attachments", i)["source"], F.lit("")))), "")
    return F.when(F.size("attachments") > 0, whole).otherwise(unescape(body))


def read_turns(segments: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, loss_text, chars, n_attachments, expanded_tokens)`` parsed from the segments and their attachments."""
    shape = r"(?s)^<turn ([^>]*)>(.*)</turn>\n$"
    masked = F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_chars"))
    return segments.select(
        "conv_id",
        "turn",
        unescape(F.regexp_extract("segment", shape, 1)).alias("role"),
        _read_body(F.regexp_extract("segment", shape, 2)).alias("text"),
        F.when(F.col("loss_start").isNotNull(), _read_body(masked)).alias("loss_text"),
        F.length("segment").alias("chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def conversation_digest(segments: DataFrame) -> DataFrame:
    """One row a conversation. Its turns pass in order through running digests, so even the longest needs constant memory."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    names = [c.split()[0] for c in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def end():
            rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]))

        for batch in batches:
            for conv, role, text, loss, *sums in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "chars", "n_attachments", "expanded_tokens")), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        end()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    now[3] += len(loss)
                    now[4].update(loss.encode())
                now[5:] = map(add, now[5:], sums)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_arrow(schema))
                rows.clear()
        if now:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _arrow(schema), strict=True)], schema=_arrow(schema))

    def _arrow(ddl):
        return pa.schema([(n, pa.string() if c.endswith("string") else pa.int64()) for n, c in zip(names, ddl.split(", "), strict=True)])

    turns = read_turns(segments).withColumn("conv_id", F.col("conv_id").cast("long"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(digest, schema)
