"""Chat formatting with a grammar round trip.

A conversation is rendered as `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. The rendered text is parsed again by
a deterministic parser that takes every control string for one, so a role or text that holds one is no part of the
grammar; where the recovered turns differ from the source, the texts in conflict are escaped and rendered anew until
they are identical. The escape puts one more backslash behind the `<` of every `<|`, `<\\|`,
`<\\\\|`, ...; the parser takes one away, so the map is one to one and a text without such strings stays as it is.

Conversations are streams of sorted turns: a partition holds whole conversations (one conversation is one task,
however long), and a long one is written in parts of at most `part_chars` characters (or one turn), so no conversation
is collected. Each part is a row with its text
and the spans of assistant texts in it (the loss mask), counted in code points.

Edge cases: null texts and roles are empty; turns with equal numbers follow by role and text, null numbers come first;
repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives an empty
result; very long texts are taken whole; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(f"{re.escape(START)}|{re.escape(END)}")
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """Role, text, and the span of the escaped text of each turn; None where the grammar doesn't hold."""
    turns, at, controls = [], 0, _CONTROL.finditer(rendered)
    for opening in controls:
        closing = next(controls, None)
        if closing is None or opening[0] != START or closing[0] != END or opening.start() != at:
            return None
        line = rendered.find("\n", opening.end(), closing.start())
        if line < 0 or not rendered.startswith("\n", closing.end()):
            return None
        role, text = rendered[opening.end() : line], rendered[line + 1 : closing.start()]
        turns.append((unescape_role(role), unescape(text), line + 1, closing.start()))
        at = closing.end() + 1
    return turns if at == len(rendered) else None


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Text that parses back to `turns`, and what it parses to. Texts are escaped only where they conflict."""
    shown = list(turns)
    for attempt in range(3):
        rendered = "".join(f"{START}{role}\n{text}{END}\n" for role, text in shown)
        read = parse(rendered)
        if read is not None and [(role, text) for role, text, _, _ in read] == turns:
            return rendered, read
        # first the turns that don't come back alone, then all
        for i, (role, text) in enumerate(turns):
            alone = parse(f"{START}{role}\n{text}{END}\n")
            if attempt or alone is None or [x[:2] for x in alone] != [(role, text)]:
                shown[i] = (escape_role(role), escape(text))
    raise ValueError("the escape isn't reversible")  # not reached: escaped turns hold no control string


def _ids(column: pd.Series) -> list[int | None]:
    """Ids from their strings: as numbers they would become floats beside a null, and large ones would meet."""
    return [None if pd.isna(x) else int(x) for x in column.tolist()]


def _with_ids(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """A frame whose first column holds ids that may be null, without a float between."""
    out = pd.DataFrame(rows, columns=columns)
    out[columns[0]] = pd.array([r[0] for r in rows], dtype="Int64")
    return out


def _parts(batches: Iterable[pd.DataFrame], part_chars: int) -> Iterator[pd.DataFrame]:
    """Rendered parts of conversations whose turns come in order; one part is in memory at a time."""
    key, number, size, turns, rows = None, 0, 0, [], []

    def close() -> None:
        text, read = render(turns)
        spans = [{"start": a, "stop": b} for role, _, a, b in read if role == "assistant"]
        rows.append((key, number, len(turns), text, spans))

    columns = ["conv_id", "part", "n_turns", "formatted", "loss_spans"]
    for batch in batches:
        for conv, role, text in zip(_ids(batch["conv_id"]), batch["role"].tolist(), batch["text"].tolist(), strict=True):
            if turns and (conv != key or size + len(text) > part_chars):
                close()
                number = number + 1 if conv == key else 0
                size, turns = 0, []
            key = conv
            size += len(text)
            turns.append((role, text))
        if rows:
            yield _with_ids(rows, columns)
            rows = []
    if turns:
        close()
        yield _with_ids(rows, columns)


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Rows of conv_id, part, n_turns, formatted, loss_spans; the parts of a conversation follow each other."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, part long, n_turns long, formatted string, loss_spans array<struct<start: long, stop: long>>"
    return rows.select(F.col("conv_id").cast("string"), "role", "text").mapInPandas(lambda it: _parts(it, part_chars), schema)


def _digests(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, any_, sums = None, False, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row() -> tuple:
        n, turns, chars, loss, formatted = sums
        return (key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

    for batch in batches:
        rows = []
        for conv, text, spans in zip(_ids(batch["conv_id"]), batch["formatted"].tolist(), batch["loss_spans"].tolist(), strict=True):
            if any_ and conv != key:
                rows.append(row())
            if not any_ or conv != key:
                key, any_, sums = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(text):
                sums[0] += 1
                sums[1].update(f"{role}\n{said}\n".encode())
            for span in spans:
                under = unescape(text[span["start"] : span["stop"]])
                sums[2] += len(under)
                sums[3].update(under.encode())
            sums[4] += len(text)
        if rows:
            yield _with_ids(rows, names)
    if any_:
        yield _with_ids([row()], names)


def read_back(parts: DataFrame) -> DataFrame:
    """Per conversation, from the formatted parts as `format_conversations` returns them (no shuffle between)."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.select(F.col("conv_id").cast("string"), "formatted", "loss_spans").mapInPandas(_digests, schema)
