"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text; nothing is assumed about how it works.
Successive prefixes of a conversation are rendered and each output is compared with the
one before: where it only grew, the growth is the new turn's span; where earlier output
changed, the template rewrites history, which is reported, and the span starts where
the outputs part.  Inside its span the turn's text is located by rendering the prefix
once more with a one-character probe in place of the text: what stands before and after
the probe is the template's.  Where history was rewritten, every text is probed once more
in the whole conversation, so that spans are places in the final output.  A text that the
template changes or leaves out cannot be found so; its span is empty and it is counted
as unlocated.  The spans of assistant texts are the loss mask.

Conversations are dealt by conv_id and sorted by turn; a task holds one conversation at
a time and keeps only its current output.

Defined results: a null text or role is empty.  Turns with equal (or null: first)
numbers are in the order of role, then text; repeated rows are turns of their own.  A
null conv_id is a conversation of its own.  Texts of any length are rendered whole.  Extra
columns are ignored; an empty table gives no rows.  A conversation of n turns costs 2 n
renderings (3 n if rewritten) in one task, which is the method's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Every control string starts with one of these; in texts they and the sign itself are followed by a sign.
SIGN, STARTS = "\\", "<["
PROBE = "\ue000"
_ESCAPE, _UNESCAPE = re.compile(r"[<\[\\]"), re.compile(r"([<\[\\])\\")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    """Reversible: no control string of a template is left in the result."""
    return _ESCAPE.sub(lambda m: m[0] + SIGN, text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The default template."""
    return "".join([f"<s>[ROLE]{escape(role)}[/ROLE]{escape(text)}</s>" for role, text in turns])


def read_back(output: str) -> list[Turn]:
    """The turns in an output of marked_turns."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


@dataclass
class Rendered:
    """output of the whole conversation; per turn its span and its text's span; texts that were not found."""

    output: str = ""
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewrites: bool = False
    unlocated: int = 0


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _located(turns: list[Turn], n: int, shown: str, template: Template) -> tuple[int, int] | None:
    """Where the text of turn n stands in shown, the output of turns; None if the template does not show it as it does a probe."""
    probe = PROBE
    while probe in shown:  # a text may hold the probe's character
        probe = chr(ord(probe) + 1)
    probed = template([*turns[:n], (turns[n][0], probe), *turns[n + 1 :]])
    at = probed.find(probe)
    after = len(probed) - at - 1
    if at < 0 or at + after > len(shown) or shown[:at] != probed[:at] or shown[len(shown) - after :] != probed[at + 1 :]:
        return None
    return at, len(shown) - after


def render_incrementally(turns: list[Turn], template: Template = marked_turns) -> Rendered:
    r = Rendered()
    found: list[tuple[int, int] | None] = []
    for n in range(len(turns)):
        now = template(turns[: n + 1])
        if now.startswith(r.output):
            start = len(r.output)
        else:
            start, r.rewrites = _common(r.output, now), True
        found.append(None if r.rewrites else _located(turns[: n + 1], n, now, template))
        r.turns.append((start, len(now)))
        r.output = now
    if r.rewrites:  # places in the outputs of prefixes do not hold in the last one
        found = [_located(turns, n, r.output, template) for n in range(len(turns))]
        r.turns = [(min(a, len(r.output)), min(b, len(r.output))) for a, b in r.turns]
    r.texts = [x or (len(r.output), len(r.output)) for x in found]
    r.unlocated = found.count(None)
    return r


def formatted(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row per conversation: conv_id, output, rewrites, unlocated texts, turns and loss [(start, end)] in code points of output.

    Of a conversation whose history is rewritten, a turn's span begins where the outputs
    before and after it part.
    """
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("conv_id", pa.int64()), ("output", pa.string()), ("rewrites", pa.bool_()), ("unlocated", pa.int64()), ("turns", spans), ("loss", spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: list[Turn] = []
        conv, begun, done, held = None, False, [], 0

        def close() -> int:
            r = render_incrementally(turns, template)
            loss = [x for x, (role, _) in zip(r.texts, turns, strict=True) if role == "assistant"]
            shown = [[{"start": a, "end": b} for a, b in s] for s in (r.turns, loss)]
            done.append((conv, r.output, r.rewrites, r.unlocated, *shown))
            return len(r.output)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and c != conv:
                    held += close()
                    turns = []
                    if held > 2_000_000:
                        yield flush()
                        done, held = [], 0
                conv, begun = c, True
                turns.append((role or "", text or ""))
        if begun:
            close()
            yield flush()

    skinny = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = skinny.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    shape = "conv_id long, output string, rewrites boolean, unlocated long, turns array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>"
    return ordered.select("conv_id", "role", "text").mapInArrow(run, shape)


def digests(rendered: DataFrame) -> DataFrame:
    """Read back from the outputs: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, unlocated."""
    shape = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean, unlocated long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, output, loss, *noted in zip(*(b.column(k).to_pylist() for k in ("conv_id", "output", "loss", "rewrites", "unlocated")), strict=True):
                turns = read_back(output)
                said = "".join([unescape(output[x["start"] : x["end"]]) for x in loss])
                whole = "".join([f"{role}\n{text}\n" for role, text in turns])
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(output), *noted))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites", "unlocated"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return rendered.select("conv_id", "output", "loss", "rewrites", "unlocated").mapInArrow(run, shape)
