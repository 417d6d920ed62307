"""Quotation linking: replies joined to the messages they quote, and conversations in reply order.

Cost at scale: messages are parsed in one narrow scan; what is joined are hashes of passages, each
to the one earliest message that has it, so a passage that very many quote gives a row a quote and
no pairs. Order is by global prefix counts over ranges, not by a task a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, ship_code, signed

MIN_WORDS = 3  # of a passage that tells where it comes from
ROWS = 256  # messages parsed at once

_LEVEL = re.compile(r"(?:[ \t]*>)+")
#: How a line ends that says whom the next lines quote.
_ATTRIBUTION = re.compile(r"(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
#: How the line before begins if that was too long for one.
_ATTRIBUTION_START = re.compile(r"\s*(?:On|Am|Le|El)\s")


def split_levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, content) of each line; the level is the number of > before the content."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        mark = _LEVEL.match(line)
        out.append((mark[0].count(">"), line[mark.end() :].strip()) if mark else (0, line.rstrip()))
    return out


def passage_hash(passage: str) -> int | None:
    """A hash of the passage's words, without case, punctuation at the ends and white space; None if too short."""
    words = [w for w in (w.strip(".,;:!?\"'()[]…") for w in passage.lower().split()) if w]
    if len(words) < MIN_WORDS:
        return None
    return signed(int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))


def _units(lines: list[str]) -> set[int]:
    """Hashes of a passage as a whole, of its paragraphs and of its lines."""
    paragraphs, now = [], []
    for line in [*lines, ""]:
        if line.strip():
            now.append(line)
        elif now:
            paragraphs.append(" ".join(now))
            now = []
    return {h for p in {" ".join(lines), *paragraphs, *lines} if (h := passage_hash(p)) is not None}


def _without_attribution(run: list[str]) -> list[str]:
    """The lines before a quote without those that say whose it is, on one line or two; blank ones may follow."""
    last = len(run) - 1
    while last > 0 and not run[last].strip():
        last -= 1
    if not _ATTRIBUTION.search(run[last]):
        return run
    wrapped = last > 0 and not _ATTRIBUTION_START.match(run[last]) and _ATTRIBUTION_START.match(run[last - 1]) and run[last - 1].rstrip()[-1] not in ".!?:;"
    return run[: last - 1 if wrapped else last]


def parse_message(text: str | None) -> tuple[str, list[int], list[tuple[int, int]], int]:
    """A message without quotes, its passages, the (level, passage) pairs it quotes, and its deepest level.

    A run of lines of one level is a passage; lines deeper in are a passage of their own. What only
    says who wrote what comes next, a level deeper, goes with the quote, at any level. A passage of
    fewer than three words links nothing.
    """
    lines = split_levels(text)
    own, quotes, at = [], set(), 0
    while at < len(lines):
        level, end = lines[at][0], at
        while end < len(lines) and lines[end][0] == level:
            end += 1
        run = [content for _, content in lines[at:end]]
        if end < len(lines) and lines[end][0] > level:
            run = _without_attribution(run)
        if level == 0:
            own += run
        else:
            quotes |= {(level, unit) for unit in _units(run)}
        at = end
    return "\n".join(own).strip(), sorted(_units(own)), sorted(quotes), max(level for level, _ in lines)


_PARSED = "conv_id bigint, turn bigint, role string, text string, units array<bigint>, quotes array<struct<level:int,unit:bigint>>, quote_depth int"


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.struct([("level", pa.int32()), ("unit", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            own, units, quotes, depth = zip(*map(parse_message, part.column(3).to_pylist()), strict=True)
            quotes = [[{"level": level, "unit": unit} for level, unit in q] for q in quotes]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(own, pa.string()), pa.array(units, pa.list_(pa.int64())), pa.array(quotes, pa.list_(quote)), pa.array(depth, pa.int32())],
                ["conv_id", "turn", "role", "text", "units", "quotes", "quote_depth"],
            )


def _roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, reply_to) -> the same with root, the first message of the chain, by pointer jumping."""
    known = cut(links.withColumn("root", F.col("reply_to")))
    for _ in range(max_rounds):
        jump = known.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"))
        known = cut(known.join(jump, ["conv_id", "root"], "left").withColumn("moved", F.col("further").isNotNull()))
        if known.where("moved").limit(1).count() == 0:
            return known.drop("further", "moved")
        known = known.withColumn("root", F.coalesce("further", "root")).drop("further", "moved")
    raise RuntimeError("reply chains did not end")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, the message it replies to, and its place in reply order.

    Returns conv_id, turn, role, text, quote_depth, n_linked (passages found in earlier messages),
    reply_to, thread and position. A passage belongs to the earliest message of the conversation
    that has it as its own words. A message replies to the one that most of its passages of the
    lowest found level belong to, of equals the latest; only earlier turns count. Threads, which
    begin with a message that replies to none, follow by their first turn, and messages in a thread
    by turn; position counts from 0. A null text counts as empty, a null conv_id or turn is kept,
    links to nothing and comes first. Repeated rows are kept, parsed alike and ordered at will; rows
    of the same conversation and turn with different texts are one message for links: what any of
    them quotes or says counts for all, and each keeps its own text. An empty table gives no rows; other columns are ignored.
    """
    ship_code(messages.sparkSession)
    kept = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    parsed = cut(kept.mapInArrow(_parse_batches, _PARSED))
    # The quotes are few, and so are the passages that they can be from: those of conversations that have quotes.
    quoted = parsed.where(F.size("quotes") > 0).select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.unit").distinct()
    wanted = quoted.select("conv_id", "unit").distinct()
    origins = (
        parsed.select("conv_id", F.col("turn").alias("origin"), F.explode("units").alias("unit"))
        .join(wanted, ["conv_id", "unit"], "left_semi")
        .groupBy("conv_id", "unit")
        .agg(F.min("origin").alias("origin"))
    )
    found = quoted.join(origins, ["conv_id", "unit"]).where("origin < turn")
    votes = found.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("votes"))
    links = votes.groupBy("conv_id", "turn").agg(
        F.max_by("origin", F.struct(-F.col("level"), F.col("votes"), F.col("origin"))).alias("reply_to"),
        F.sum("votes").alias("n_linked"),
    )
    threads = _roots(links).select("conv_id", "turn", "reply_to", "n_linked", "root")
    joined = parsed.drop("units", "quotes").join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "quote_depth",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", F.coalesce("root", "turn").alias("thread"),
    )
    placed = cut(in_order(joined, ["conv_id", "thread", "turn", "role"]))
    firsts = placed.groupBy("conv_id").agg(F.min("row").alias("first_row")).withColumnRenamed("conv_id", "__conv")
    return placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(
        "conv_id", "turn", "role", "text", "quote_depth", "n_linked", "reply_to", "thread", (F.col("row") - F.col("first_row")).alias("position")
    )
