"""Chat formatting by incremental black-box rendering.

The template is a function from turns to text and nothing is known about it. The first 1, 2, ... n turns of a
conversation are rendered and neighbouring outputs compared: what an output adds to the one before is the span of its
last turn. Inside the span, two renderings with different probe texts tell where the turn's text begins and how much
the template puts behind it. If an output does not begin with the one before, the template rewrites history; the
conversation is then flagged, and its spans are found in the whole output with all other turns in place.

Turns of a conversation are put in order of ``turn`` (NULL first; ties by role and text). NULL text or role counts as
empty. Turns equal in everything are kept. Rows of one conversation meet in one task, as its formatted text is one
value; a conversation without rows does not exist. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
#: The strings that mark turns, and the escapes that keep them out of texts.
START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escape(text: str, pairs: Sequence[tuple[str, str]] = ESCAPES) -> str:
    for plain, safe in pairs:
        text = text.replace(plain, safe)
    return text


def unescape(text: str, pairs: Sequence[tuple[str, str]] = ESCAPES) -> str:
    for plain, safe in reversed(pairs):
        text = text.replace(safe, plain)
    return text


def marked_turns(turns: Sequence[Turn]) -> str:
    """The default template."""
    return "".join(f"{START}{escape(role, ROLE_ESCAPES)}\n{escape(text)}{END}" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a text that ``marked_turns`` made."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece.removesuffix(END).partition("\n")
        turns.append((unescape(role, ROLE_ESCAPES), unescape(text)))
    return turns


def _first_difference(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _text_span(render: Template, turns: Sequence[Turn], at: int, whole: str) -> tuple[int, int]:
    """Where the text of turn ``at`` lies in ``whole``, the rendering of ``turns``."""
    probes = [render([*turns[:at], (turns[at][0], probe), *turns[at + 1 :]]) for probe in ("A", "B")]
    begin = _first_difference(*probes)
    return begin, len(whole) - (len(probes[0]) - begin - 1)


def locate(render: Template, turns: Sequence[Turn]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The rendering of all turns, each turn's span, each text's span, and whether the template rewrites history."""
    last, edges, inner = render(turns[:0]), [], []
    edges.append(len(last))
    for i in range(len(turns)):
        now = render(turns[: i + 1])
        if not now.startswith(last):
            break
        edges.append(len(now))
        inner.append(_text_span(render, turns[: i + 1], i, now))
        last = now
    else:
        return last, list(zip(edges[:-1], edges[1:], strict=True)), inner, False
    whole = render(turns)
    inner = [_text_span(render, turns, i, whole) for i in range(len(turns))]
    return whole, inner, inner, True


def format_conversations(df: DataFrame, render: Template = marked_turns, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted``, ``spans`` of turns, ``loss_spans`` of the texts of ``learn`` roles, ``rewrites_history``.

    Offsets are code points, ends are exclusive.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.assign(role=group["role"].fillna(""), text=group["text"].fillna(""))
        rows = rows.sort_values(["turn", "role", "text"], na_position="first", kind="stable")
        turns = list(zip(rows["role"], rows["text"], strict=True))
        formatted, spans, inner, rewrites = locate(render, turns)
        pack = lambda found: [{"start": a, "end": b} for a, b in found]
        loss = [span for span, (role, _) in zip(inner, turns, strict=True) if role in learn]
        return pd.DataFrame({
            "conv_id": group["conv_id"].iloc[:1].to_numpy(), "formatted": [formatted], "spans": [pack(spans)], "loss_spans": [pack(loss)],
            "rewrites_history": [rewrites],
        })

    kind = df.schema["conv_id"].dataType.simpleString()
    places = "array<struct<start:long,end:long>>"
    schema = f"conv_id {kind}, formatted string, spans {places}, loss_spans {places}, rewrites_history boolean"
    return df.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(run, schema)


def loss_text(formatted: str, spans: Sequence) -> str:
    """The unescaped text under a loss mask."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the output: turns and masked text, as counts and SHA-256."""

    @F.pandas_udf("struct<n_turns:long,turns:string,loss:string>")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        turns = [read_turns(t) for t in texts]
        return pd.DataFrame({
            "n_turns": [len(t) for t in turns],
            "turns": ["".join(f"{role}\n{text}\n" for role, text in t) for t in turns],
            "loss": [loss_text(t, s) for t, s in zip(texts, spans, strict=True)],
        })

    return formatted.withColumn("_r", read("formatted", "loss_spans")).select(
        "conv_id", F.col("_r.n_turns").alias("n_turns"), F.sha2(F.col("_r.turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_r.loss").cast("long").alias("loss_chars"), F.sha2(F.col("_r.loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "rewrites_history",
    )
