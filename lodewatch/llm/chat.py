"""Chat formatting of reply trees, with DataFrame functions only.

Self-joins enumerate the paths: in each round every message learns the ancestor
twice as far away, with the number and the total score of the messages between,
so rounds grow with the logarithm of the depth.  Leaves are ranked by the mean
score of their branch, and the messages of the chosen branches are found by the
same jumps, the longest first.  Each chosen path becomes one conversation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.llm.common import NO_VALUE, written


@dataclass(frozen=True)
class Template:
    """A turn is ``start role \\n text end``.

    Inside roles and texts each backslash is doubled, and each control string
    gets a backslash after its first character, so that none is left; a line
    feed in a role gets a backslash before it.  To read back, a backslash is
    dropped and the character after it kept.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.control:
            text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return text

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.start), F.replace(self.escaped(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def turns(self, formatted: Column) -> Column:
        """Roles and texts, read back."""
        parts = F.split(formatted, re.sub(r"([|<>\[\]/])", r"\\\1", self.end))
        parts = F.slice(parts, 1, F.size(parts) - 1)
        role = r"(?s)^((?:[^\\\n]++|\\.)*+)\n"
        body = F.transform(parts, lambda p: F.substr(p, F.lit(len(self.start) + 1)))
        return F.transform(body, lambda b: F.struct(self.unescaped(F.regexp_extract(b, role, 1)).alias("role"), self.unescaped(F.substr(b, F.length(F.regexp_extract(b, role, 0)) + 1)).alias("text")))

    def loss_text(self, formatted: Column, loss: Column) -> Column:
        """All text under the loss mask, read back."""
        return F.array_join(F.transform(loss, lambda s: self.unescaped(F.substr(formatted, s["start"] + 1, s["length"]))), "")


TEMPLATE = Template()


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Messages of the ``top`` best branches of each tree set ``c``: ``c``, ``rank``, ``node``, ``depth``.

    nodes: ``c`` and ``node`` (together unique, not null), ``parent`` and
    ``score`` (null: 0).  A reply to a message that isn't there starts a tree.
    Messages on a cycle have no root, so they and replies to them are on no path.
    """
    known = nodes.select("c", F.col("node").alias("parent"), F.lit(True).alias("there"))
    # Ancestor `far` steps up (null: none), steps to it or to above the root, and the score of the messages on the way.
    jump = nodes.select("c", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")).join(known, ["c", "parent"], "left")
    jump = written(jump.select("c", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), "total"), "jumps")
    jumps, reach, n = [jump], 1, nodes.count()
    while reach <= n and not jump.where("up is not null").isEmpty():
        other = jump.select("c", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2"))
        far = jump.where("up is not null").join(other, ["c", "up"]).select("c", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("total") + F.col("total2")).alias("total"))
        jump = written(far.unionByName(jump.where("up is null")), "jumps")
        jumps.append(jump)
        reach *= 2
    rooted = jump.where("up is null").select("c", "node", F.col("steps").alias("depth"), (F.col("total") / F.col("steps")).alias("mean"))
    leaves = rooted.join(jumps[0].select("c", F.col("up").alias("node")), ["c", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("mean"), F.desc("depth"), "node"))
    found = written(leaves.withColumn("rank", rank).where(F.col("rank") <= top).select("c", "rank", "node", "depth"), "paths")
    # An ancestor's distance is a sum of powers of two in one way, so each is found once.
    for k in range(len(jumps) - 2, -1, -1):
        further = found.join(jumps[k].where("up is not null").select("c", "node", "up"), ["c", "node"]).select("c", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        found = written(found.unionByName(further), "paths")
    return found


def format_trees(messages: DataFrame, top: int = 1, template: Template = TEMPLATE, learn: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path.

    messages: ``conv_id``, ``node``, ``parent``, ``role``, ``text``, ``score``;
    nodes are unique within a conversation.  Returns ``conv_id``, ``rank``,
    ``formatted`` and ``loss``: start and length, in code points, of the texts
    of role ``learn``.  Null roles and texts are empty; a null conv_id is a
    conversation of its own; an empty table gives an empty table; other columns
    are ignored.
    """
    own = messages.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_VALUE)).alias("c"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    own = written(own, "messages")
    turns = best_paths(own.select("c", "node", "parent", "score"), top).join(own.select("c", "node", "conv_id", "role", "text"), ["c", "node"])
    turns = turns.withColumns({"head": template.head(F.col("role")), "body": template.escaped(F.col("text"))})
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(template.end)))
    before = Window.partitionBy("c", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == learn, F.struct(start.cast("int").alias("start"), F.length("body").alias("length")))
    parts = turns.withColumn("span", span).groupBy("c", "rank").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("parts"))
    loss = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return parts.select("conv_id", "rank", F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("formatted"), loss.alias("loss"))


def as_tree(turns: DataFrame) -> DataFrame:
    """A table of turns as trees of one branch: each turn replies to the one before it.

    Turns of one number follow each other by role and text, nulls first, so
    repeated rows stay as many turns; a null turn comes first.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    numbered = turns.select("conv_id", place.cast("long").alias("node"), "role", "text")
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of what the formatted conversations say, from ``formatted`` and ``loss`` alone."""
    turns, lost = template.turns(F.col("formatted")), template.loss_text(F.col("formatted"), F.col("loss"))
    out = formatted.withColumns({"turns": turns, "lost": lost})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
