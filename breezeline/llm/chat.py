"""Reply trees as training conversations: root-to-leaf paths by iterative self-joins, ranked, and each chosen path
formatted as one text with a loss mask. Only DataFrame functions are used.

The template writes a turn as ``### role: text</turn>`` and a line break. Inside roles and texts a backslash, ``###``
and ``</turn>`` are written as a backslash and one letter (as is the colon of a role), so the control strings occur
nowhere but where a turn begins or ends, and unescaping gives the very text back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeline.llm.common import id_in, id_out
from breezeline.session import materialise

START, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
# The backslash comes first: after it every backslash of the text begins an escape.
ESCAPES = {"\\": "\\b", "###": "\\h", "</turn>": "\\e"}
ROLE_ESCAPES = ESCAPES | {":": "\\c"}


def escape(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for plain, written in escapes.items():
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for plain, written in reversed(escapes.items()):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def as_reply_trees(conversations: DataFrame) -> DataFrame:
    """Plain conversations as messages of trees without branches: each turn replies to the one before it.

    Rows go by turn, nulls first, ties by role, then text; rows without a conv_id are one conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").alias("tree_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("tree_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    numbered = rows.withColumn("message_id", place.cast("long"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return numbered.select("tree_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def named_messages(messages: DataFrame, unique_ids: bool = False) -> DataFrame:
    """(tree_id, node, parent, score, role, text): a message is known by its id and the number of its copy, since
    messages may share an id; replies belong to the first copy (by parent, role, text, score)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = messages.select(
        id_in("tree_id").alias("tree_id"), id_in("message_id").alias("id"), F.col("parent_id").cast("long").alias("parent_id"),
        score.alias("score"), role.alias("role"), text.alias("text"),
    )
    order = Window.partitionBy("tree_id", "id").orderBy(F.asc_nulls_first("parent_id"), "role", "text", "score")
    copy = F.lit(1) if unique_ids else F.row_number().over(order)
    key = lambda at, number: F.struct(at.alias("id"), number.alias("copy"))
    parent = F.when(F.col("parent_id").isNotNull(), key(F.col("parent_id"), F.lit(1)))
    return rows.select("tree_id", key(F.col("id"), copy).alias("node"), parent.alias("parent"), "score", "role", "text")


def ancestry(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and path score of every node, and jump tables: the k-th names each node's ancestor 2^k messages up.

    Each self-join doubles the stretch of path that a node knows, so a tree of depth d takes log2(d) of them; nodes
    that reached their root leave. A parent that is not there makes a root. Nodes on a cycle, and below one, never
    reach a root; they are in no path, as the joins end once none arrives."""
    there = nodes.select("tree_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    known = nodes.join(there, ["tree_id", "parent"], "left")
    up = F.when(F.col("there"), F.col("parent"))
    state = materialise(known.select("tree_id", "node", up.alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    rooted, jumps = state.filter("up IS NULL"), []
    while True:
        open_ = state.filter("up IS NOT NULL")
        if open_.isEmpty():
            return rooted, jumps
        jumps.append(open_.select("tree_id", "node", "up"))
        ahead = rooted.unionByName(open_).select(
            "tree_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("add")
        )
        state = materialise(open_.join(ahead, ["tree_id", "up"]).select(
            "tree_id", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("total") + F.col("add")).alias("total"),
        ))
        arrived = state.filter("up IS NULL")
        if arrived.isEmpty():
            return rooted, jumps
        rooted = rooted.unionByName(arrived)


def ranked_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """(tree_id, leaf, branch, place, node): the members of each tree's ``branches`` best root-to-leaf paths, place 1
    being the root. A path's score is the mean of its messages' scores; ties go to the smaller leaf id."""
    if branches < 1:
        raise ValueError("branches must be 1 at least")
    rooted, jumps = ancestry(nodes)
    answered = nodes.filter("parent IS NOT NULL").select("tree_id", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, ["tree_id", "node"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches)
    paths = chosen.select("tree_id", F.col("node").alias("leaf"), "branch", F.col("depth").alias("place"), "node")
    # high jumps first: an ancestor at any distance is met once, by the binary digits of the distance
    for k in reversed(range(len(jumps))):
        here, above = F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))
        met = paths.join(jumps[k], ["tree_id", "node"], "left")
        paths = met.select("tree_id", "leaf", "branch", F.explode(both).alias("at")).select(
            "tree_id", "leaf", "branch", F.col("at.place").alias("place"), F.col("at.node").alias("node")
        )
    return paths


def format_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant", unique_ids: bool = False) -> DataFrame:
    """One row per chosen path: tree_id, branch (its rank), leaf_id, n_turns, formatted, loss_spans (start, chars,
    start_byte, bytes of each text of ``loss_role`` in the formatted text, counted from 0).

    ``messages`` has tree_id, message_id, parent_id, role, text, score. Null role and text are empty, a null score (or
    NaN) is 0. Rows without tree_id are one tree. Messages of one id are told apart as copies, of which the first gets
    the replies; set ``unique_ids`` where ids are known to be unique. A message whose parent is null or not in
    the tree is a root, and one on or below a cycle is in no path. An empty table gives no rows.

    Joins are by message, so a tree of any size is spread; only a path itself, which becomes one value, meets in one
    task, and must stay below Spark's 2 GB for a value."""
    whole = materialise(named_messages(messages, unique_ids))
    paths = ranked_paths(whole.select("tree_id", "node", "parent", "score"), branches)
    head = F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit(AFTER_ROLE))
    turns = paths.join(whole.select("tree_id", "node", "role", "text"), ["tree_id", "node"]).select(
        "tree_id", "leaf", "branch", "place", head.alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == loss_role).alias("loss"),
    )
    before = Window.partitionBy("tree_id", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)

    def start(measure) -> Column:
        done = F.sum(measure("head") + measure("body") + len(END)).over(before)
        return F.coalesce(done, F.lit(0)).cast("long") + measure("head")

    spans = F.struct(
        start(F.char_length).alias("start"), F.char_length("body").cast("long").alias("chars"),
        start(F.octet_length).alias("start_byte"), F.octet_length("body").cast("long").alias("bytes"),
    )
    placed = turns.withColumn("span", F.when(F.col("loss"), spans))
    piece = F.struct("place", F.concat("head", "body", F.lit(END)).alias("piece"))
    made = placed.groupBy("tree_id", "leaf").agg(
        F.first("branch").alias("branch"),
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        F.sort_array(F.collect_list("span")).alias("loss_spans"),
    )
    return made.select(
        id_out("tree_id").alias("tree_id"), "branch", id_out("leaf.id").alias("leaf_id"), "n_turns",
        F.array_join("pieces.piece", "").alias("formatted"), "loss_spans",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, array of (role, text)."""
    parts = F.split(formatted, END, -1)

    def turn(part: Column) -> Column:
        role = F.substring(part, F.lit(len(START) + 1), F.instr(part, ":") - len(START) - 1)
        text = F.substring(part, F.instr(part, ":") + len(AFTER_ROLE), F.char_length(part))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    data = formatted.cast("binary")
    cut = lambda s: F.substring(data, (s["start_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s))), "")
