r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts. A visitor has one method for each kind of part: text is
escaped, an image, audio or document becomes a placeholder that holds its place in the
conversation, and is recorded as an attachment with its reference and the number of tokens that
the placeholder will expand to. A turn is written as

    <turn ROLE>\nBODY</turn>\n

Inside roles, texts and references ``\`` is written ``\\``, ``<`` is ``\l`` and ``>`` is ``\g``, so
no text can forge a mark, and reading undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,size:bigint>"
END = "</turn>\n"


def escape(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """Undoes ``escape``: pairs of backslashes are set apart first, from the left, then marks are replaced."""
    plain = lambda s: F.replace(F.replace(s, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


class Visitor:
    """What each kind of part becomes. Sizes: pixels of an image, milliseconds of audio, pages of a document."""

    #: Tokens: one for each patch of 28 x 28 pixels, one for 40 ms, 300 for a page.
    RATES = {"image": (28 * 28, 1), "audio": (40, 1), "document": (1, 300)}

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def attachment(self, part: Column, number: Column) -> Column:
        return F.concat(F.lit("<"), part["kind"], F.lit(" "), number.cast("string"), F.lit(">"))

    def tokens(self, part: Column) -> Column:
        size = F.coalesce(part["size"], F.lit(0)).cast("long")
        found = F.lit(0).cast("long")
        for kind, (per, each) in self.RATES.items():
            found = F.when(part["kind"] == kind, F.ceil(size / per).cast("long") * each).otherwise(found)
        return found

    def is_attachment(self, part: Column) -> Column:
        return F.coalesce(part["kind"].isin(*self.RATES), F.lit(False))


def formatted(rows: DataFrame, *, parts_col: str = "parts", visitor: Visitor | None = None) -> DataFrame:
    """One row for each conversation: conv_id, formatted, mask (start and length in code points, from 0, of
    what assistants say), attachments (number, kind, ref, tokens, place) and n_tokens_attached.

    ``rows`` has conv_id, turn, role and parts (array<PART>); turns are ordered by turn, then role, then
    their parts, so ties are settled and repeated rows are repeated turns. A null turn comes first,
    a null role is empty, a null text part is empty, null or empty parts are an empty text; unknown
    kinds count as text. A conversation becomes one row, so its own turns must fit a task.
    """
    v = visitor or Visitor()
    empty = F.array(F.struct(F.lit("text").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("size")))
    parts = F.coalesce(F.col(parts_col), empty).cast(f"array<{PART}>")
    parts = F.when(F.size(parts) > 0, parts).otherwise(empty)
    role = F.coalesce(F.col("role"), F.lit(""))
    talk = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_parts")
    turns = rows.select("conv_id", "turn", role.alias("role"), parts.alias("_parts")).withColumn("_at", F.row_number().over(talk))
    cells = turns.select("conv_id", "_at", "role", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_k", "part"))
    order = Window.partitionBy("conv_id").orderBy("_at", "_k")
    cells = cells.withColumn("_attached", v.is_attachment(F.col("part")))
    cells = cells.withColumn("_number", F.sum(F.col("_attached").cast("long")).over(order))
    head = F.when(F.col("_k") == 0, F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))).otherwise("")
    body = F.when(F.col("_attached"), v.attachment(F.col("part"), F.col("_number"))).otherwise(v.text(F.col("part")))
    tail = F.when(F.col("_k") == F.col("_n") - 1, F.lit(END)).otherwise("")
    cells = cells.withColumns({"_head": head, "_body": body, "_tail": tail})
    length = sum((F.char_length(c) for c in ("_head", "_body", "_tail")), F.lit(0).cast("long"))
    cells = cells.withColumn("_start", F.sum(length).over(order) - length + F.char_length("_head"))

    spoken = (F.col("role") == "assistant") & ~F.col("_attached")
    span = F.struct(F.col("_start").alias("start"), F.char_length("_body").cast("long").alias("length"))
    record = F.struct(F.col("_number").alias("number"), F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"), v.tokens(F.col("part")).alias("tokens"), F.col("_start").alias("place"))
    piece = F.struct("_at", "_k", F.concat("_head", "_body", "_tail").alias("piece"))
    out = cells.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(spoken, span))).alias("mask"),
        F.sort_array(F.collect_list(F.when(F.col("_attached"), record))).alias("attachments"),
    )
    tokens = F.aggregate(F.col("attachments"), F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    return out.withColumn("n_tokens_attached", tokens)


def turns_read(text: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, placeholders left out."""
    pieces = F.split(text, END, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        end = F.locate(">\n", piece)
        body = F.substring(piece, end + 2, F.char_length(piece))
        return F.struct(unescape(F.substring(piece, F.lit(7), end - 7)).alias("role"), unescape(F.regexp_replace(body, "<[^>]*>", "")).alias("text"))

    return F.transform(pieces, turn)


def masked_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
