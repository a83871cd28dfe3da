"""Chat formatting with typed content parts.

A visitor flattens a turn's parts into text with ordered placeholders: text stands as it is, and an image,
audio or document part becomes one placeholder, numbered through the conversation, while its reference,
what stood for it in a text and the tokens it will expand to are recorded. A plain text has such parts where
it holds a Markdown link to a file of a known kind. Control strings inside texts and roles are escaped by one
character that the template does not use, so the output can be read back exactly; texts that stand side by
side are escaped as one, so that none is put together from two of them.

Turns are shuffled by conversation and sorted inside the partition, then streamed: a task holds one turn
at a time, however long its conversation is. A conversation's digest is one sequential hash, so one task
reads one conversation, but nothing of it is collected.

Defined results: rows are ordered by turn (null first), then role, then text; repeated rows stay as turns
of their own; a null text or role is empty; a null part is nothing, and one whose type is null or unknown stands
as its text; rows without a conversation id form one conversation; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
HOLD = "<|{}:{:04}|>"
#: What a text must not hold raw: this template's strings and those of templates in common use.
CONTROL = (OPEN, SAYS, CLOSE, "<|image:", "<|audio:", "<|document:", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Escaped by a letter each; the escape character itself by "0".
MARKS = {ESCAPE + chr(ord("a") + i): c for i, c in enumerate(CONTROL)} | {ESCAPE + "0": ESCAPE}
LEARNED = "assistant"

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Endings of files by the kind of part that a link to one is.
FILES = {"image": "png|jpe?g|gif|webp|bmp", "audio": "wav|mp3|ogg|flac", "document": "pdf|docx"}
LINK = r"!?\[[^\[\]\n]*\]\([^()\s]+[.](?i:{})\)"
#: What parts texts from links; a text that holds it itself has no links.
PARTING = "\u0001"

#: Tokens of an image tile of so many pixels a side, of a second of audio, and of a page.
TILE, PER_TILE, PER_SECOND, PER_PAGE = 448, 256, 25, 512


def escaped(text: str) -> str:
    for mark, control in reversed(MARKS.items()):  # the escape character first
        text = text.replace(control, mark)
    return text


def unescaped(text: str) -> str:
    return re.sub(ESCAPE + "[0a-z]", lambda m: MARKS[m[0]], text)


def escaped_column(text: Column) -> Column:
    for mark, control in reversed(MARKS.items()):
        text = F.replace(text, F.lit(control), F.lit(mark))
    return text


class Visitor:
    """Flattens the parts of one conversation's turns. A visit gives the tokens that a part will expand to."""

    def __init__(self):
        self.visits = {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        self.numbers = dict.fromkeys(self.visits, 0)

    def turn(self, parts: list[dict] | None) -> tuple[str, list[dict]]:
        """The body, and the attachments: kind, number, ref, source, tokens, offset in the body."""
        body, found, said, at = [], [], [], 0
        for part in [*(p for p in parts or [] if p is not None), None]:
            visit = self.visits.get(part["type"]) if part else None
            if part and visit is None:
                said.append(part["text"] or "")
                continue
            text = escaped("".join(said))
            said, at = [], at + len(text)
            body.append(text)
            if part:
                kind = part["type"]
                hold = HOLD.format(kind, self.numbers[kind])
                found.append({"kind": kind, "number": self.numbers[kind], "ref": part["ref"], "source": part["text"], "tokens": visit(part), "at": at})
                self.numbers[kind] += 1
                body.append(hold)
                at += len(hold)
        return "".join(body), found

    def visit_image(self, part) -> int:
        tiles = -(-(part["width"] or TILE) // TILE) * -(-(part["height"] or TILE) // TILE)
        return tiles * PER_TILE

    def visit_audio(self, part) -> int:
        return max(1, int(-(-(part["seconds"] or 0) * PER_SECOND // 1)))

    def visit_document(self, part) -> int:
        return max(1, part["pages"] or 0) * PER_PAGE


FORMATTED = "conv_id long, turn_no long, formatted string, mask_start long, mask_end long, attachments array<struct<kind: string, number: int, ref: string, source: string, tokens: long, at: long>>"


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, parts: array of ``PART``), in order and whole in a partition.

    mask_start, mask_end: the body of an assistant's turn in ``formatted``; equal where nothing is learned.
    """
    ordered = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
    said = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", said, "parts").select("conv_id", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, visitor, number = object(), None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows = []
                for row in batch.slice(at, 128).to_pylist():
                    if row["conv_id"] != now:
                        now, visitor, number = row["conv_id"], Visitor(), 0
                    body, found = visitor.turn(row["parts"])
                    head = OPEN + escaped(row["role"]) + SAYS
                    end = len(head) + len(body) * (row["role"] == LEARNED)
                    rows.append((now, number, head + body + CLOSE, len(head), end, [f | {"at": f["at"] + len(head)} for f in found]))
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return ordered.mapInArrow(run, FORMATTED)


_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("source", pa.string()), ("tokens", pa.int64()), ("at", pa.int64())]))
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64()), ("attachments", _ATTACHED)])

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long"


def restored(line: str, start: int, end: int, attachments: list[dict]) -> str:
    """The text that a stretch of a formatted turn stands for: unescaped, with what stood for each attachment, else its placeholder."""
    out, at = [], start
    for a in attachments:
        if start <= a["at"] < end:
            hold = HOLD.format(a["kind"], a["number"])
            out += [unescaped(line[at : a["at"]]), hold if a["source"] is None else a["source"]]
            at = a["at"] + len(hold)
    return "".join([*out, unescaped(line[at:end])])


def read_back(df: DataFrame) -> DataFrame:
    """A row per conversation, from the output of :func:`formatted` alone: its strings are parsed and unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, done = object(), 0, []

        def close():
            if n:
                done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("conv_id", "formatted", "mask_start", "mask_end", "attachments")}
                if row["conv_id"] != now:
                    close()
                    now, n, turns, loss, loss_chars, chars, tokens = row["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                line = row["formatted"]
                role, _ = line.removeprefix(OPEN).removesuffix(CLOSE).split(SAYS)
                body = restored(line, len(OPEN) + len(role) + len(SAYS), len(line) - len(CLOSE), row["attachments"])
                turns.update(f"{unescaped(role)}\n{body}\n".encode())
                learned = restored(line, row["mask_start"], row["mask_end"], row["attachments"])
                loss.update(learned.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(learned), chars + len(line)
                tokens += sum(a["tokens"] for a in row["attachments"])
            if len(done) >= 1024:
                yield _digests(done)
                done.clear()
        close()
        if done:
            yield _digests(done)

    return df.mapInArrow(run, DIGEST)


def _digests(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in DIGEST.split(", ")])


def text_parts(text: Column) -> Column:
    """A turn's parts if it has only a text: its links to files of a known kind, and the texts between them."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    text = F.coalesce(text, F.lit(""))

    def part(kind, x, ref):
        return F.struct(kind.alias("type"), x.alias("text"), ref.alias("ref"), *nothing)

    def piece(x, i):
        kind = F.lit("text")
        for name, endings in FILES.items():
            kind = F.when(x.rlike(f"(?i)[.](?:{endings})\\)$"), name).otherwise(kind)
        ref = F.regexp_extract(x, "\\(([^()\\s]+)\\)$", 1)
        return F.when(i % 2 == 1, part(kind, x, ref)).otherwise(part(F.lit("text"), x, F.lit(None).cast("string")))

    links = F.regexp_replace(text, f"({LINK.format('|'.join(FILES.values()))})", f"{PARTING}$1{PARTING}")
    pieces = F.filter(F.transform(F.split(links, PARTING), piece), lambda p: (p["type"] != "text") | (p["text"] != ""))
    plain = F.array(part(F.lit("text"), text, F.lit(None).cast("string")))
    return F.when(text.contains(PARTING) | (links == text), plain).otherwise(pieces)
