"""Chat formatting with typed content parts and a loss mask.

A turn is written as ``<|turn|>role<|body|>content<|end|>``. Content comes from typed parts: a visitor
turns text into escaped text and image, audio and document parts into ordered placeholders, recording
the attachment and the number of tokens it will expand to; parts of unknown types get placeholders of no
tokens, null parts none. Escaping breaks every control string (ours and those of common chat templates)
with a backslash after its first character and doubles backslashes, so the text can be read back exactly
and no control string, placeholders included, can be injected.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: First characters of control strings, where a rest follows that makes them one.
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\]|/?(?:SYSTEM|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)[\]_])|<(?=</?SYS>>|/?(?:start|end)_of_turn>|[｜])")
_ESCAPED = re.compile(r"\\(\\?)")
_MARK = re.compile(r"<\|(turn|body|end)\|>")
_PLACE = re.compile(r"<\|(?:image|audio|document|other):\d+\|>")
PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Expansion:
    """How many tokens an attachment becomes."""

    patch: int = 14
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 512


@dataclass
class PartVisitor:
    """Flattens the parts of one turn; one visit method for each type of part."""

    expansion: Expansion
    first: int = 0  # number of the next attachment of the conversation
    out: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # neighbouring texts are escaped as one: a control string may cross from part to part
    attachments: list[tuple] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        p = self.expansion.patch
        self._attach("image", part, math.prod(math.ceil(max(1, part.get(side) or p) / p) for side in ("width", "height")))

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach("audio", part, math.ceil(seconds * self.expansion.audio_tokens_per_second) if 0 < seconds < math.inf else 0)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.expansion.document_tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = self.first + len(self.attachments)
        self.flush()
        self.out.append(f"<|{kind}:{n}|>")
        self.attachments.append((n, kind, part.get("ref"), tokens))

    def flush(self) -> None:
        self.out.append(escape("".join(self.text)))
        self.text.clear()

    def content(self) -> str:
        self.flush()
        return "".join(self.out)


SEGMENT = "conv_id long, seq long, role string, segment string, mask_from long, mask_to long, attachments array<struct<n:int,kind:string,ref:string,tokens:long>>"
_ATTACHMENTS = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def typed(turns: DataFrame) -> bool:
    """Whether turns has typed content: a column parts, an array of structs with a text field type; others of that name are foreign."""
    found = next((f.dataType for f in turns.schema if f.name == "parts"), None)
    element = getattr(found, "elementType", None)
    if not isinstance(element, StructType):
        return False
    wanted = StructType.fromDDL("x " + PART_TYPE)["x"].dataType.elementType
    return [f.name for f in element] == [f.name for f in wanted] and element["type"].dataType.typeName() == "string"


def format_chat(turns: DataFrame, expansion: Expansion = Expansion(), parallelism: int | None = None) -> DataFrame:
    """One formatted segment per turn, in order within conv_id (seq from 0); a conversation's output is the
    concatenation of its segments.

    turns: conv_id, turn, role, text and optionally parts (typed content of PART_TYPE's fields; where not null it stands
    for text; a column parts of any other type is ignored).
    mask_from/mask_to: the range of the segment, in code points, that an assistant's loss covers (null in
    other turns). Rows of a conversation are sorted by turn, then role, text; null turns come first, null
    text and role are empty, repeated rows are repeated turns, null conv_id is a conversation of its own,
    an empty table gives an empty one. Rows stream through a task in order, so a conversation of any length
    needs the memory of one batch. A part of an unknown type is an attachment "other" of no tokens; null parts are
    nothing; sizes that are null, negative or no numbers count as least ones. Other columns are ignored, whatever
    their names.
    """
    small_batches(turns.sparkSession)
    parts = F.col("parts") if typed(turns) else F.lit(None)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.cast(PART_TYPE).alias("parts"))
    rows = (rows.repartition(parallelism, "conv_id") if parallelism else rows.repartition("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        at, seq, n = object(), 0, 0
        for batch in batches:
            cols = {k: [] for k in ("seq", "segment", "from", "to", "attachments")}
            for conv, role, text, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if conv != at:
                    at, seq, n = conv, 0, 0
                visitor = PartVisitor(expansion, n)
                for part in parts if parts is not None else [{"type": "text", "text": text}]:
                    visitor.visit(part)
                head, content = f"{TURN}{escape(role)}{BODY}", visitor.content()
                loss = role == "assistant"
                found = [dict(zip(("n", "kind", "ref", "tokens"), a)) for a in visitor.attachments]
                for k, v in zip(cols, (seq, head + content + END, len(head) if loss else None, len(head) + len(content) if loss else None, found)):
                    cols[k].append(v)
                seq, n = seq + 1, n + len(visitor.attachments)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols["seq"], pa.int64()), batch.column(2), pa.array(cols["segment"], pa.string()), pa.array(cols["from"], pa.int64()), pa.array(cols["to"], pa.int64()), pa.array(cols["attachments"], _ATTACHMENTS)], ["conv_id", "seq", "role", "segment", "mask_from", "mask_to", "attachments"])

    return rows.mapInArrow(run, SEGMENT)


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped and without placeholders."""
    marks = [(m[1], m.start(), m.end()) for m in _MARK.finditer(segment)]
    if [m[0] for m in marks] != ["turn", "body", "end"] or marks[0][1] or marks[2][2] != len(segment):
        raise ValueError("not one formatted turn")
    return read_text(segment[marks[0][2] : marks[1][1]]), read_text(segment[marks[1][2] : marks[2][1]])


def read_text(content: str) -> str:
    """The text of a turn's content: no text holds a placeholder, for its escape breaks them."""
    return unescape(_PLACE.sub("", content))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, attachment_tokens long, attachments_sha256 string"


def digest_chat(segments: DataFrame) -> DataFrame:
    """Reads format_chat's segments back, conversation by conversation, keeping running hashes only.

    attachments_sha256 is that of a line ``number:kind:reference:tokens`` for each attachment, in order. It follows
    format_chat's partitioning and order and so adds no shuffle."""

    def run(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        schema = pa.schema([(k, pa.string() if "sha256" in k else pa.int64()) for k in names])
        at, state = None, None

        def result():
            n, turns, chars, loss, size, many, tokens, held = state
            values = (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size, many, tokens, held.hexdigest())
            return pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=schema)

        for batch in batches:
            for conv, segment, lo, hi, attachments in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6))):
                if at is None or at[0] != conv:
                    if at is not None:
                        yield result()
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, hashlib.sha256()]
                role, text = read_turn(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    under = read_text(segment[lo:hi])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                for a in attachments or ():
                    state[5] += 1
                    state[6] += a["tokens"]
                    state[7].update(f"{a['n']}:{a['kind']}:{a['ref'] or ''}:{a['tokens']}\n".encode("utf-8", "surrogatepass"))
        if at is not None:
            yield result()

    return segments.mapInArrow(run, DIGEST)
