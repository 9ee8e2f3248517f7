"""Chat formatting with typed content parts.

A turn's content is plain text or a JSON list of parts: {"type": "text", "text": ...}, {"type": "image", "ref": ...,
"width": w, "height": h}, {"type": "audio", "ref": ..., "seconds": s}, {"type": "document", "ref": ..., "chars": n}. A
visitor flattens them, in order, into text and placeholders, records each attachment's reference, place and source, and
counts the tokens a placeholder will be expanded to. A placeholder is the one character SLOT: attachments are recorded in
the order of their placeholders over the whole conversation, so the nth SLOT is the nth attachment.

The template marks turns with control characters. Inside texts all of them are escaped, SLOT included, so no text can
hold a control string or a placeholder, whatever it says, and parsing the output gives the texts back exactly:
  OPEN role TEXT text ... CLOSE
An attachment keeps the source of its part, so a typed content is read back as it was, JSON and all.
Rows are formatted one by one, in parallel; only then a conversation's own segments are put in order of turn.

Cases: null text and content are empty; a null role is the empty role; turns are ordered by (turn, role,
formatted text), nulls first, and repeated rows are kept; a text that is not valid JSON parts is plain text; very long
texts are formatted whole; an empty table gives no rows; rows of a null conv_id are one conversation; other
columns are ignored. A conversation of any length is a sorted stream of turns, of which one is held at a time.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ESCAPE, OPEN, CLOSE, TEXT, SLOT = "\x1b", "\x02", "\x03", "\x1f", "\x1a"
_CODES = {ESCAPE: "0", OPEN: "1", CLOSE: "2", TEXT: "3", SLOT: "4"}
_BACK = {v: k for k, v in _CODES.items()}


def escape(text: str) -> str:
    for c in (ESCAPE, OPEN, CLOSE, TEXT, SLOT):
        if c in text:
            text = text.replace(c, ESCAPE + _CODES[c])
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    head, *tail = text.split(ESCAPE)
    return head + "".join(_BACK[t[0]] + t[1:] for t in tail)


@dataclass
class Flattened:
    """shown: the escaped text with its placeholders; source: what the content was, if it was typed."""

    shown: str = ""
    attachments: list = field(default_factory=list)
    source: str | None = None


class PartVisitor:
    """visit_<type> for each type of part; a part of an unknown type, or without one, is shown as its JSON text."""

    def __init__(self, patch: int = 14, audio_rate: int = 25, chars_a_token: int = 4):
        self.patch, self.audio_rate, self.chars = patch, audio_rate, chars_a_token

    def flatten(self, parts: list) -> Flattened:
        shown, attachments = [], []
        for p in parts:
            kind = p.get("type") if isinstance(p, dict) else None
            text, attached = getattr(self, f"visit_{kind}", self.visit_other)(p) if isinstance(kind, str) else self.visit_other(p)
            shown.append(escape(text) if attached is None else SLOT)
            attachments += [attached] if attached is not None else []
        return Flattened("".join(shown), attachments)

    def visit_text(self, p):
        return str(p.get("text") or ""), None

    def visit_other(self, p):
        return p if isinstance(p, str) else json.dumps(p, ensure_ascii=False), None

    def _number(self, p, key):
        try:
            v = float(p.get(key) or 0)
        except (TypeError, ValueError):
            return 0.0
        return v if math.isfinite(v) and v > 0 else 0.0

    def _attached(self, p, kind, tokens):
        return "", {"kind": kind, "ref": str(p.get("ref") or ""), "tokens": min(tokens, 1 << 62)}

    def visit_image(self, p):
        return self._attached(p, "image", max(1, math.ceil(self._number(p, "width") / self.patch)) * max(1, math.ceil(self._number(p, "height") / self.patch)))

    def visit_audio(self, p):
        return self._attached(p, "audio", max(1, math.ceil(self._number(p, "seconds") * self.audio_rate)))

    def visit_document(self, p):
        return self._attached(p, "document", max(1, math.ceil(self._number(p, "chars") / self.chars)))


def content(text: str | None, typed: bool = True) -> Flattened:
    """Parts, if typed and the text is a JSON list of typed objects; else one text part."""
    text = text or ""
    parts = None
    if typed and text.startswith("[") and '"type"' in text:
        try:
            parts = json.loads(text)
        except (ValueError, RecursionError):
            parts = None
    if isinstance(parts, list) and parts and all(isinstance(p, dict) and isinstance(p.get("type"), str) for p in parts):
        out = PartVisitor().flatten(parts)
        out.source = text
        return out
    return PartVisitor().flatten([{"type": "text", "text": text}])


ATTACHMENT = "struct<kind: string, ref: string, tokens: long>"
SEGMENT = f"conv_id long, turn long, role string, segment string, body_at int, attachments array<{ATTACHMENT}>, source string"


def segments(conversations: DataFrame, typed: bool = True) -> DataFrame:
    """Each row formatted alone; body_at: where the escaped text begins in its segment."""
    part = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches):
        for b in batches:
            roles, bodies, at, attached, source = [], [], [], [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                flat = content(text, typed)
                head = OPEN + escape(role or "") + TEXT
                roles.append(role or "")
                bodies.append(head + flat.shown + CLOSE)
                at.append(len(head))
                attached.append(flat.attachments)
                source.append(flat.source)
            cols = [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array(bodies, pa.string()), pa.array(at, pa.int32()), pa.array(attached, part), pa.array(source, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role", "segment", "body_at", "attachments", "source"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, SEGMENT)


def turns(conversations: DataFrame, loss_role: str = "assistant", typed: bool = True) -> DataFrame:
    """(conv_id, i, at, segment, start, end, under_loss, attachments, first_attachment, expanded_tokens, source), one row a turn.

    at: where the segment begins in its conversation's formatted text; start, end: the escaped text's code points there;
    first_attachment: how many attachments the turns before have. No conversation is gathered in a row, whatever its length.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segment")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    out = segments(conversations, typed)
    out = out.withColumns({"i": F.row_number().over(order), "at": before(F.length("segment").cast("long")), "first_attachment": before(F.size("attachments").cast("long"))})
    return out.select(
        "conv_id", "i", "at", "segment", (F.col("at") + F.col("body_at")).alias("start"), (F.col("at") + F.length("segment") - 1).alias("end"), (F.col("role") == loss_role).alias("under_loss"),
        "attachments", "first_attachment", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"), "source",
    )


def format_conversations(conversations: DataFrame, loss_role: str = "assistant", typed: bool = True) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>, attachments, expanded_tokens), one row a conversation, as short ones are used.

    loss: code points of `formatted` under the loss mask, the escaped texts of loss_role's turns. Conversations too long
    for a row are to be taken from turns().
    """
    span = F.when(F.col("under_loss"), F.struct("start", "end"))
    out = turns(conversations, loss_role, typed).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "segment", span.alias("loss"), "attachments"))).alias("t"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return out.select("conv_id", F.array_join(F.col("t.segment"), "").alias("formatted"), F.filter("t.loss", lambda x: x.isNotNull()).alias("loss"), F.flatten("t.attachments").alias("attachments"), "expanded_tokens")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, its placeholders left as they are."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, text = part[1:].split(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long, placeholders long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Of turns(): digests of what each conversation's output says, read as a sorted stream that holds one turn at a time.

    A typed turn is read back as its source; placeholders counts the SLOTs met in the output.
    """
    by_conversation = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "i")
    names = [c.split()[0] for c in BACK.split(", ")]

    def run(batches):
        state, done = None, []

        def close():
            conv, n, said, chars, masked, size, attached, expanded, slots = state
            done.append((conv, n, said.hexdigest(), chars, masked.hexdigest(), size, attached, expanded, slots))

        for b in batches:
            for conv, segment, under, n_attached, expanded, source in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, sha256(), 0, sha256(), 0, 0, 0, 0]
                ((role, text),) = parse(segment)
                slots = segment.count(SLOT)
                text = source if source is not None else text
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if under:
                    state[3] += len(text)
                    state[4].update(text.encode())
                for k, v in ((5, len(segment)), (6, n_attached), (7, expanded), (8, slots)):
                    state[k] += v
            if len(done) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)
                done.clear()
        if state is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)

    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    rows = by_conversation.select("conv_id", "segment", "under_loss", F.size("attachments").cast("long").alias("n_attached"), "expanded_tokens", "source")
    return rows.mapInArrow(run, BACK)
