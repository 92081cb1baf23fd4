r"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins on that pointer, each
doubling the distance to the ancestor looked at, give every message its depth
and the score of its path, in a number of rounds that grows with the logarithm
of the longest path. The leaves of each tree are ranked by the score of
their root-to-leaf path; the paths chosen are laid out message by message,
again by self-joins over the same pointers, and each is formatted as one
conversation.

Template of a turn: ``<|turn|>role<|says|>text<|end|>`` and a line feed. In roles and texts
a backslash is written twice and ``<|`` as ``<\|``, so ``<|`` occurs in the
output only where the template put it, and ``plain`` restores every text, however long. The
loss mask is a list of spans (start, length, in code points of the output):
one for the text of each assistant turn.

A message whose parent is null or missing is a root. A null role or text is
empty. A message id must be unique in its conversation and pointers must not
run in a circle; both raise. A null conversation id is a conversation of its
own. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowsmith.llm.common import stored, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth (1 at the root) and path score of every message, and the pointer tables: the k-th leads 2^k messages up.

    Only messages whose pointer has not passed the root take part in a round; the others are settled.
    """
    n = nodes.count()
    state = nodes.select("conv", "id", "parent", F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    settled, pointers, reach = [], [], 1
    while True:
        settled.append(state.where(F.col("parent").isNull()))
        live = state.where(F.col("parent").isNotNull())
        if live.isEmpty():
            return _union(settled).select("conv", "id", "depth", "total"), pointers
        if reach > n:
            raise ValueError("replies run in a circle")
        pointers.append(live.select("conv", "id", "parent"))
        up = _union([*settled, live]).select(
            F.col("conv").alias("up_conv"), F.col("id").alias("up_id"), F.col("parent").alias("up_parent"),
            F.col("depth").alias("up_depth"), F.col("total").alias("up_total"))
        state = stored(live.join(up, F.col("conv").eqNullSafe(F.col("up_conv")) & (F.col("parent") == F.col("up_id")))
                       .select("conv", "id", F.col("up_parent").alias("parent"),
                               (F.col("depth") + F.col("up_depth")).alias("depth"),
                               (F.col("total") + F.col("up_total")).alias("total")), "reply_state")
        reach *= 2


def _with_roots(nodes: DataFrame) -> DataFrame:
    """Pointers to messages that are not there become null; ids must be unique."""
    known = nodes.groupBy("conv", "id").agg(F.count("*").alias("n"))
    if not known.where("n > 1").isEmpty():
        raise ValueError("a message id occurs twice in a conversation")
    known = known.select(F.col("conv").alias("p_conv"), F.col("id").alias("p_id"))
    return (nodes.join(known, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("parent") == F.col("p_id")), "left")
            .drop("parent", "p_conv").withColumnRenamed("p_id", "parent"))


def chosen_paths(nodes: DataFrame, n_paths: int | None) -> DataFrame:
    """Messages of the chosen paths: conv, leaf, id, pos (1 at the root). ``n_paths`` a conversation, null for all."""
    nodes = _with_roots(nodes)
    nodes = stored(nodes, "reply_nodes")
    depth, pointers = _jumps(nodes)
    parents = nodes.where(F.col("parent").isNotNull()).select(F.col("conv").alias("p_conv"), F.col("parent").alias("p_id")).distinct()
    leaves = depth.join(parents, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("id") == F.col("p_id")), "left_anti")
    if n_paths is not None:
        best = Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "id")
        leaves = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_paths)
    leaves = stored(leaves.select("conv", "id", "depth"), "reply_leaves")
    # from the longest pointers to the shortest: each round adds the messages 2^k above those known, each once
    parts = [leaves.select("conv", F.col("id").alias("leaf"), "id", "depth", F.lit(0).cast("long").alias("steps"))]
    for k in reversed(range(len(pointers))):
        to = pointers[k].select(F.col("conv").alias("p_conv"), F.col("id").alias("p_id"), F.col("parent").alias("to"))
        below = _union(parts).where(F.col("steps") + (1 << k) < F.col("depth"))
        parts.append(stored(
            below.join(to, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("id") == F.col("p_id")))
            .select("conv", "leaf", F.col("to").alias("id"), "depth", (F.col("steps") + (1 << k)).alias("steps")), "reply_paths"))
    return _union(parts).select("conv", "leaf", "id", (F.col("depth") - F.col("steps")).alias("pos"))


def format_paths(messages: DataFrame, conv_col: str, id_col: str, parent_col: str, role_col: str, text_col: str,
                 score_col: str, n_paths: int | None = 1) -> DataFrame:
    """One row for each chosen path: conv, leaf, formatted, loss (array of start, length)."""
    nodes = stored(messages.select(
        F.col(conv_col).alias("conv"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(text_col).alias("text"),
        F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score")), "reply_messages")
    paths = chosen_paths(nodes.select("conv", "id", "parent", "score"), n_paths)
    said = nodes.select(F.col("conv").alias("m_conv"), F.col("id").alias("m_id"), "role",
                        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS)).alias("head"), escaped(F.col("text")).alias("said"))
    rows = (paths.join(said, F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("id") == F.col("m_id")))
            .withColumn("piece", F.concat("head", "said", F.lit(END))))
    before = Window.partitionBy("conv", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + F.char_length("head"))
    one = F.struct("pos", "piece", (F.col("role") == LOSS_ROLE).alias("is_loss"),
                   F.struct(F.col("start").cast("long").alias("start"), F.char_length("said").cast("long").alias("length")).alias("span"))
    return (rows.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(one)).alias("turns"))
            .select("conv", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                    F.transform(F.filter("turns", lambda t: t["is_loss"]), lambda t: t["span"]).alias("loss")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the output alone: turns, texts under the loss mask, length."""
    turns = F.slice(F.split("formatted", r"<\|turn\|>"), 2, 1 << 30)
    role_of = lambda t: plain(F.substring_index(t, SAYS, 1))
    text_of = lambda t: plain(F.substring_index(F.substring_index(t, SAYS, -1), END, 1))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(role_of(t), F.lit("\n"), text_of(t), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: plain(F.substring(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv", "leaf", F.size(turns).cast("long").alias("n_turns"),
                            F.sha2(whole, 256).alias("turns_sha256"), loss.alias("loss_text"),
                            F.char_length("formatted").cast("long").alias("formatted_chars"))


def op6_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, each a chain of replies by turn, plus conversation -7, and read them back."""
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = (rows.withColumn("id", F.row_number().over(by_turn))
            .withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(0.0)))
    back = read_back(format_paths(rows, "conv_id", "id", "parent", "role", "text", "score"))
    return back.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256",
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, length(role) + length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '<|', ''))) // 2
    + length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2
    + {len(TURN + SAYS + END)} AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
