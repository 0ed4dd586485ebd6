"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn (text, image, audio, document) into one segment with ordered placeholders, and
records for each attachment its reference, its place in the segment and the tokens that it will expand to.
Turns are marked by control strings; control strings inside texts and roles are escaped by a backslash
after their first character (one more where backslashes stand there already), which is reversible.

The formatted form of a conversation is its segments in turn order, kept as one row per turn, so that no
conversation has to fit into a row or into memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetext.llm.common import batch, map_arrow, materialize, shuffle_partitions, table

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CONTROL = re.compile(r"([<\[])(\\*)(\|(?:turn|end|image|audio|document)\|>|/?s>|/?INST\]|/?SYS\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\|(?:turn|end|image|audio|document)\|>|/?s>|/?INST\]|/?SYS\])")
_SEGMENT = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.DOTALL)

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SCHEMA = "conv_id bigint, turn bigint, role string, segment string, loss_start bigint, loss_end bigint, n_tokens_media bigint, attachments array<struct<kind:string,ref:string,position:bigint,tokens:bigint>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits parts in order; ``patch``, ``rate`` and ``page`` give the tokens per image patch, audio second and document page."""

    def __init__(self, patch: int = 28, rate: float = 25.0, page: int = 512):
        self.patch, self.rate, self.page = patch, rate, page
        self.out: list[str] = []
        self.size = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, -(-(part["width"] or 1) // self.patch) * -(-(part["height"] or 1) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, round((part["seconds"] or 0.0) * self.rate)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part["pages"] or 1) * self.page)

    def visit_unknown(self, part: dict) -> None:
        self.visit_text(part)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part["ref"], "position": self.size, "tokens": tokens})
        self.put(PLACEHOLDERS[kind])

    def put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


_OUT = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_tokens_media", pa.int64()),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int64()), ("tokens", pa.int64())]))),
])


def render(parts: list[dict | None] | None, role: str | None, patch: int = 28, rate: float = 25.0, page: int = 512) -> dict:
    role = role or ""
    head = f"{TURN}{escape_role(role)}\n"
    flat = Flattener(patch, rate, page)
    for part in parts or []:
        if part is not None:
            flat.visit(part)
    body = "".join(flat.out)
    for a in flat.attachments:
        a["position"] += len(head)
    loss = role == "assistant"
    return {
        "segment": f"{head}{body}{END}\n", "loss_start": len(head) if loss else None, "loss_end": len(head) + len(body) if loss else None,
        "attachments": flat.attachments, "n_tokens_media": sum(a["tokens"] for a in flat.attachments),
    }


def format_turns(turns: DataFrame, patch: int = 28, rate: float = 25.0, page: int = 512) -> DataFrame:
    """One formatted segment per row of ``turns`` (conv_id, turn, role, and parts or text).

    A table without ``parts`` gets one text part per row. Null text, role or parts: empty; parts of unknown
    type count as text; null conv_id and turn stay null; repeated rows give repeated segments; other columns are dropped
    first; an empty table gives no rows. ``loss_start`` and ``loss_end`` bound the assistant's text in the segment.
    """
    if "parts" not in turns.columns:
        turns = turns.withColumn("parts", F.array(F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                roles = part.column(2).to_pylist()
                rows = [render(p, r, patch, rate, page) for p, r in zip(part.column(3).to_pylist(), roles, strict=True)]
                yield batch(_OUT, conv_id=part.column(0), turn=part.column(1), role=[r or "" for r in roles], **{k: [x[k] for x in rows] for k in ("segment", "loss_start", "loss_end", "n_tokens_media", "attachments")})

    return map_arrow(turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(PARTS).alias("parts")), run, SCHEMA)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text (placeholders included) of a segment, unescaped."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a formatted segment")
    return unescape_role(m[1]), unescape(m[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its segments in turn order (ties: by role, then segment).

    Sorted and read as a stream: a conversation of any length takes one batch of memory.
    """
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None
        for b in batches:
            for conv, segment, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_segment(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    said = unescape(segment[start:end])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(segment)
            if done:
                yield batch(out, **dict(zip(out.names, map(list, zip(*done, strict=True)), strict=True)))
                done = []
        if state is not None:
            last = (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
            yield batch(out, **dict(zip(out.names, [[x] for x in last], strict=True)))

    dealt = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return map_arrow(dealt.select("conv_id", "segment", "loss_start", "loss_end"), run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(materialize(format_turns(turns), "chat"))
