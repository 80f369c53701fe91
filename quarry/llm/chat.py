"""Chat formatting with a template as a black box: spans are found by rendering ever longer prefixes.

A renderer maps a list of (role, text) turns to a string.  ``spans`` renders every prefix of a conversation and compares
consecutive outputs: what the longer one adds is the turn's span, and an output that does not begin with the one
before shows that the template rewrites history.  Such conversations are marked and get no spans and no loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

Turns = list[tuple[str, str]]
Renderer = Callable[[Turns], str]

OPEN, TEXT, CLOSE, ESCAPE = "<|turn|>", "<|text|>", "<|end|>", "<|esc|>"
#: The strings that mean something to the template or to others in common use; inside texts each is escaped.
CONTROLS = (OPEN, TEXT, CLOSE, ESCAPE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(re.escape(ESCAPE) + r"([0-9]+);")


def escape(text: str) -> str:
    """Each control string becomes the escape mark, its number and a semicolon; ``unescape`` is the inverse."""
    return _CONTROL.sub(lambda m: f"{ESCAPE}{CONTROLS.index(m[0])};", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: CONTROLS[int(m[1])], text)


def render(turns: Turns) -> str:
    """The production template: open mark, role, text mark, text, end mark and a line break for each turn."""
    return "".join(f"{OPEN}{escape(role)}{TEXT}{escape(text)}{CLOSE}\n" for role, text in turns)


def parse(out: str) -> Turns:
    """The turns again, read from the rendered string alone."""
    turns, at = [], 0
    while at < len(out):
        if not out.startswith(OPEN, at):
            raise ValueError("no turn starts here")
        mid, end = out.index(TEXT, at), out.index(CLOSE, at)
        turns.append((unescape(out[at + len(OPEN) : mid]), unescape(out[mid + len(TEXT) : end])))
        at = end + len(CLOSE) + 1
    return turns


def spans(turns: Turns, renderer: Renderer = render) -> tuple[str, list[tuple[int, int]] | None]:
    """The whole output and each turn's span in it, or None for the spans if a longer prefix rewrites a shorter one."""
    before, found = renderer([]), []
    for k in range(1, len(turns) + 1):
        now = renderer(turns[:k])
        if not now.startswith(before):
            return renderer(turns), None
        found.append((len(before), len(now)))
        before = now
    return before, found


def loss_mask(turns: Turns, renderer: Renderer = render, role: str = "assistant") -> tuple[str, list[tuple[int, int]], bool]:
    """The output, the spans under the loss (the role's texts without marks) and whether the template rewrites history or a text.

    Within a turn's span the text is found by rendering the prefix once more with an empty text and comparing: what
    both begin and end with is the template's own.
    """
    out, found = spans(turns, renderer)
    if found is None:
        return out, [], True
    mask = []
    for k, (a, b) in enumerate(found):
        if turns[k][0] != role or not turns[k][1]:
            continue
        bare = renderer([*turns[:k], (role, "")])[a:]
        full, head, tail = out[a:b], 0, 0
        # the empty turn is head + tail; of all ways to cut it the one whose middle stands for the text is right
        escaped = [i for i in range(len(bare) + 1) if full.startswith(bare[:i]) and full.endswith(bare[i:])]
        shown = [(i, unescape(full[i : len(full) - (len(bare) - i)])) for i in escaped]
        # a template may strip a text; then what it shows of it is under the loss
        right = [i for i, x in shown if x == turns[k][1]] or [i for i, x in shown if x.strip() == turns[k][1].strip()]
        if not right:
            return out, [], True
        head, tail = right[0], len(bare) - right[0]
        mask.append((a + head, b - tail))
    return out, mask, False


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", renderer: Renderer = render
) -> DataFrame:
    """(conv_id, formatted, mask, rewrites): each conversation rendered, the spans under the loss, and the verdict.

    Turns go by turn number; null numbers first, equal ones by role and text.  Null roles and texts count as empty.
    Repeated rows are turns of their own.  An empty table gives an empty result.  Extra columns are ignored.
    """
    turns = (
        df.select(
            column(df, conv_col).cast("long").alias("conv_id"),
            F.struct(
                column(df, turn_col).cast("long").alias("turn"),
                F.coalesce(column(df, role_col).cast("string"), F.lit("")).alias("role"),
                F.coalesce(column(df, text_col).cast("string"), F.lit("")).alias("text"),
            ).alias("t"),
        )
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.expr("transform(t, x -> x.role)").alias("roles"), F.expr("transform(t, x -> x.text)").alias("texts"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, masks, bad = [], [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                o, m, r = loss_mask(list(zip(roles, texts, strict=True)), renderer)
                out.append(o)
                masks.append([{"start": a, "end": b} for a, b in m])
                bad.append(r)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(masks, kind), pa.array(bad, pa.bool_())], names=["conv_id", "formatted", "mask", "rewrites"])

    return turns.mapInArrow(run, "conv_id long, formatted string, mask array<struct<start:int,end:int>>, rewrites boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings say, read back from them: turns, loss text and their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, out, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = parse(out)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(out[m["start"] : m["end"]]) for m in mask)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(out)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(run, schema)
