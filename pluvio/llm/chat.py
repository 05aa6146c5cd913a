"""Chat formatting: typed content parts flattened into ordered placeholders, turns marked, texts escaped."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: A content part. ``text`` has ``text``; the others have ``ref`` and what their token count needs.
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<placeholder:string,type:string,ref:string,tokens:long>>"
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 1024


def escape(text: Column) -> Column:
    """One more backslash between each ``<`` and ``|`` that nothing but backslashes part, so that no text has a control string."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    """As texts, and in one line."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"%", "%25"), "\n", "%0A"))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to: patches of an image, frames of audio, pages of a document."""
    side = lambda x: F.greatest(F.lit(1), F.ceil(F.coalesce(part[x], F.lit(PATCH)) / PATCH))
    image = side("width") * side("height")
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_A_SECOND)
    pages = F.coalesce(part["pages"], F.lit(1)).cast("long") * TOKENS_A_PAGE
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(0).cast("long")


def _visit(part: Column, turn: Column, at: Column) -> Column:
    """What stands for a part: escaped text, or a placeholder with the turn and the part's place in it."""
    text = F.coalesce(escape(part["text"]), F.lit(""))
    mark = F.format_string("<|%s:%s.%s|>", part["type"], F.coalesce(turn.cast("string"), F.lit("")), (at + 1).cast("string"))
    return F.when(part["type"].isin("image", "audio", "document"), mark).otherwise(text)


def format_turns(turns: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn as a piece of its conversation's formatted text; pieces joined by turn are that text.

    ``turns`` has ``conv_id, turn, role`` and either ``text`` or ``parts`` (``PARTS``); parts, where
    not null, replace the text. Parts are visited in order: text is escaped, an image, audio or
    document becomes ``<|type:turn.place|>``, and its reference and token count are recorded. Parts
    of other types are taken as text. A piece is ``<|im_start|>role``, a line feed, the content,
    ``<|im_end|>`` and a line feed. ``loss_start`` and ``loss_end`` bound the content in code points
    of the piece where ``role`` is one to learn from, and are null elsewhere.

    Null texts, roles and parts count as empty. Every row gives one piece, whatever its keys, so
    that conversations of any length are formatted without being gathered; rows of equal
    conversation and turn are ordered by role and content. An empty table gives no rows; other
    columns are ignored.

    Returns ``conv_id, turn, role, piece, loss_start, loss_end, attachments, n_attachment_tokens``.
    """
    typed = F.col("parts").cast(PARTS) if "parts" in turns.columns else F.lit(None).cast(PARTS)
    plain = F.coalesce(F.col("text"), F.lit("")) if "text" in turns.columns else F.lit("")
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), plain.alias("text"), typed.alias("parts"))
    turn = F.col("turn")
    flat = F.array_join(F.transform("parts", lambda p, i: _visit(p, turn, i)), "")
    kept = F.filter(F.transform("parts", lambda p, i: F.struct(_visit(p, turn, i).alias("placeholder"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda x: x["type"].isin("image", "audio", "document"))
    content = F.coalesce(flat, escape(F.col("text")))
    head = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    out = turns.select("conv_id", "turn", "role", head.alias("head"), content.alias("content"), F.coalesce(kept, F.array().cast(ATTACHMENTS)).cast(ATTACHMENTS).alias("attachments"))
    learnt = F.col("role").isin(*learn_from)
    return out.select(
        "conv_id", "turn", "role", F.concat("head", "content", F.lit(END + "\n")).alias("piece"),
        F.when(learnt, F.length("head")).alias("loss_start"), F.when(learnt, F.length("head") + F.length("content")).alias("loss_end"),
        "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("n_attachment_tokens"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of the conversations that ``format_turns`` formatted, parsed from its pieces.

    Pieces are dealt by conversation and stream through in order; a task holds one turn at a time,
    so that a conversation may be of any length, though it takes one task, as its digests follow
    its order.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    shape = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names = None, [], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for conv, piece, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")), strict=True):
                if now is None or now[0] != conv:
                    held += [done()] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = shape.fullmatch(piece).groups()
                now[1] += 1
                now[2].update(f"{unescape_role(role)}\n{unescape(content)}\n".encode())
                now[5] += len(piece)
                if start is not None:
                    learnt = unescape(piece[start:stop])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
            if len(held) > 1000:
                yield batch_of(held)
                held = []
        held += [done()] if now else []
        if held:
            yield batch_of(held)

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select(F.col("conv_id").cast("long"), "turn", "role", "piece", "loss_start", "loss_end").repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
