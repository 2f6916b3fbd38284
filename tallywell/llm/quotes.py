"""Quotation linking: conversations in reply order, without the quotes that repeat earlier messages.

A message is lines; `>` at the start of a line, repeated and with or without spaces, is its quote level. Lines of one
level that follow each other form a passage, and blank lines divide a passage into paragraphs. Each quoted paragraph is
normalised (blanks collapsed) and hashed, and joined to the earliest message of its conversation that says the paragraph
itself. The message that most words quoted at level 1 come from is the parent; deeper levels give links to ancestors.

Originals are grouped by (conversation, hash) before the join, so a paragraph that thousands of messages repeat is one
row there, and quoting rows meet it in a join that may be split. Depth and root of a message come from pointer doubling,
which takes as many rounds as the logarithm of the longest chain; a conversation is never gathered in one place. Sorting
by (conversation, root_position, depth, position) gives the conversation in reply order.

Defined results: a null text is an empty message; a message without quotes, or whose quotes are found nowhere, is a root;
a message is never its own parent and a parent is always earlier; attribution lines directly before a quote that end in
"wrote:" are dropped with it. Messages that repeat a (conversation, position) are one message for links, and each keeps
its row. A message with a null conversation or position is linked with nothing and counts no quotes. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import per_batch
from tallywell.session import materialise

_MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+")
_ATTRIBUTION = re.compile(r"wrote:[ \t]*$", re.IGNORECASE)


def levels(text: str) -> list[tuple[int, list[str]]]:
    """(quote level, lines) of the passages of a message. Attribution lines before a deeper passage are left out."""
    passages: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        level = mark[0].count(">") if mark else 0
        rest = line[mark.end() :] if mark else line
        if passages and passages[-1][0] == level:
            passages[-1][1].append(rest)
            continue
        if passages and passages[-1][0] < level:
            before = passages[-1][1]
            while before and not before[-1].strip():
                before.pop()
            if before and _ATTRIBUTION.search(before[-1]):
                before.pop()
        passages.append((level, [rest]))
    return passages


def paragraphs(lines: list[str]) -> list[str]:
    """Normalised paragraphs: blank lines divide, blanks are one space."""
    return [" ".join(part.split()) for part in re.split(r"\n[ \t]*\n", "\n".join(lines)) if part.strip()]


def unquoted(text: str) -> str:
    """The message's own words: passages of level 0, without blank lines at their ends."""
    own = ["\n".join(lines).strip("\n") for level, lines in levels(text) if level == 0]
    return "\n".join(part for part in own if part.strip())


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def parse(messages: DataFrame) -> DataFrame:
    """Per paragraph of a message: conversation, position, level, digest, n_words."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        owners, depth, names, sizes = [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for level, lines in levels(text or ""):
                for paragraph in paragraphs(lines):
                    owners.append(i)
                    depth.append(level)
                    names.append(_digest(paragraph))
                    sizes.append(paragraph.count(" ") + 1)
        at = pa.array(owners, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conversation").take(at), batch.column("position").take(at), pa.array(depth, pa.int32()),
             pa.array(names, pa.int64()), pa.array(sizes, pa.int64())],
            ["conversation", "position", "level", "digest", "n_words"])

    return per_batch(messages.select("conversation", "position", "text"), work,
                     "conversation long, position long, level int, digest long, n_words long")


def clean(messages: DataFrame) -> DataFrame:
    """Per message: conversation, position, clean_text."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [batch.column("conversation"), batch.column("position"),
             pa.array([unquoted(text or "") for text in batch.column("text").to_pylist()], pa.string())],
            ["conversation", "position", "clean_text"])

    return per_batch(messages.select("conversation", "position", "text"), work, "conversation long, position long, clean_text string")


def links(parsed: DataFrame) -> DataFrame:
    """Per message with quotes: conversation, position, n_quotes, n_linked (paragraphs), parent (null if none is found)."""
    key = ["conversation", "digest"]
    originals = parsed.where("level = 0").groupBy(*key).agg(F.min("position").alias("origin"))
    quoted = (parsed.where("level > 0").groupBy(*key, "position")
              .agg(F.min("level").alias("level"), F.sum("n_words").alias("n_words"), F.count("*").alias("n")))
    found = (quoted.join(originals, key, "left")
             .withColumn("origin", F.when(F.col("origin") < F.col("position"), F.col("origin"))))
    sources = found.groupBy("conversation", "position", "origin").agg(
        F.sum(F.when(F.col("level") == 1, F.col("n_words")).otherwise(0)).alias("words"), F.sum("n").alias("n"))
    most = F.max(F.when(F.col("origin").isNotNull() & (F.col("words") > 0), F.struct("words", F.col("origin").alias("parent"))))
    return sources.groupBy("conversation", "position").agg(
        F.sum("n").alias("n_quotes"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"),
        most["parent"].alias("parent"))


def chains(parents: DataFrame) -> DataFrame:
    """Per (conversation, position, parent): root_position and depth, by doubling the distance to a known ancestor.

    A message that has reached its root takes part in no further round.
    """
    active = materialise(parents.where("parent IS NOT NULL")
                         .select("conversation", "position", F.col("parent").alias("above"), F.lit(1).cast("long").alias("depth")), "chains")
    done = active.where("false")
    while True:
        beyond = done.unionAll(active).select("conversation", F.col("position").alias("above"), F.col("above").alias("further"),
                                              F.col("depth").alias("more"))
        stepped = materialise(
            active.join(beyond, ["conversation", "above"], "left")
            .select("conversation", "position", F.coalesce("further", "above").alias("above"),
                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), "chains")
        done = done.unionAll(stepped.where("NOT moved").drop("moved"))
        active = stepped.where("moved").drop("moved")
        if active.isEmpty():
            return done.withColumnRenamed("above", "root_position")


def reply_order(messages: DataFrame) -> DataFrame:
    """Per message: conversation, position, parent, root_position, depth, n_quotes, n_linked, clean_text.

    messages: conversation, position (long; a later message has a larger one), text.
    """
    key = ["conversation", "position"]
    linked = materialise(links(parse(messages)), "links")
    return (clean(messages).join(linked, key, "left").join(chains(linked), key, "left")
            .select(*key, "parent", F.coalesce("root_position", "position").alias("root_position"),
                    F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
                    F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "clean_text"))


def with_quotes(turns: DataFrame) -> DataFrame:
    """Messages as a mail program would send them: each turn below the quoted turn before it, and that one's own quote.

    turns: conversation, position, text. A turn without the one before it quotes nothing. Of turns that repeat a
    position, the smallest text is quoted.
    """
    said = turns.groupBy("conversation", "position").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))

    def before(steps: int, name: str) -> DataFrame:
        return said.select("conversation", (F.col("position") + steps).alias("position"), F.col("said").alias(name))

    def quote(name: str, mark: str):
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(mark), F.regexp_replace(name, "\n", "\n" + mark), F.lit("\n")))

    whole = turns.join(before(1, "one"), ["conversation", "position"], "left").join(before(2, "two"), ["conversation", "position"], "left")
    header = F.when(F.col("one").isNotNull(), F.lit("Someone wrote:\n"))
    text = F.concat_ws("", quote("two", ">> "), header, quote("one", "> "), F.coalesce("text", F.lit("")))
    return whole.select("conversation", "position", text.alias("text"))
