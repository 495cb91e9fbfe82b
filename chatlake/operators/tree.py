"""Project roll-up, tree rows and fork lineage (AGG13, TREE1-5, WIN6,
JN7, FLT15).

Row order is carried by a ``sort_key`` string instead of a global row
number (a global ``row_number()`` would run in one task).  Keys are built
from fixed-width numbers and ids joined by ``\\x01`` (below every printable
character), so plain string order is the display order: projects by last
activity, headers before their sessions, and - for lineage - trees by their root,
sessions of a tree by their preorder number.

Lineage ranks an **Euler tour** by pointer jumping.  Every session of a tree stands in
a list twice, where a walk around the tree enters and where it leaves it.  Each
entry knows the one before it; a round joins every unfinished entry with the one its
pointer names, adds that one's sums and takes over its pointer, so a tour of length
``n`` ends after ``ceil(log2 n) + 1`` rounds.  The sums are the sessions entered
before (the preorder number) and those still open (the depth); the list's head
names the root.  State is two narrow rows a session however deep the tree; a
finished entry is not joined or rewritten again.  Each round is checkpointed to the
shared folder (lineage cut, survives executor loss).

Tours of sessions on a parent cycle, and of what hangs on one, have no head and
never finish: these sessions are dropped (S40) and told by ``cycles``.  The loop stops
when nothing is left or a round finishes nothing (distances from the head are
contiguous, so nothing farther can follow).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.functions import text as TX
from chatlake.operators.ranking import previous_within
from chatlake.session import checkpointed

SEP = "\u0001"
KEY_WIDTH = 20
BIG = 10 ** 18          # newest-first keys are BIG - ms, so string order = time desc


def _num(x: Column, missing: int = 0) -> Column:
    return F.lpad(F.coalesce(x, F.lit(missing)).cast("string"), KEY_WIDTH, "0")


def newest_first_key(ms: str, tie: str) -> Column:
    """A missing time sorts last, as in the flat list (``BIG + 1``)."""
    return F.concat(_num(F.lit(BIG) - F.col(ms), BIG + 1), F.col(tie))


def project_rollup(sessions: DataFrame) -> DataFrame:
    """AGG13: per directory - name, newest non-empty branch, count, last activity."""
    return sessions.groupBy("directory").agg(
        F.expr("max_by(branch, struct(last_at, id)) FILTER (WHERE branch IS NOT NULL AND branch <> '')")
         .alias("branch"),
        F.count(F.lit(1)).alias("session_count"),
        F.max("last_at").alias("project_last")).select(
        "directory", TX.project_name("directory").alias("name"), "branch", "session_count", "project_last")


def _one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    # ``one`` is a global aggregate: exactly one row, broadcast by size bound
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def tree_rows(sessions: DataFrame) -> DataFrame:
    """TREE1: project header rows and their sessions, newest first."""
    p = project_rollup(sessions).withColumn("project_key", newest_first_key("project_last", "directory"))
    last_project = p.agg(F.max("project_key").alias("_last_project"))
    s = sessions.select("id", "directory", "branch", TX.title_or_default("title").alias("title"),
                        "last_at", newest_first_key("last_at", "id").alias("session_key"))
    last_session = s.groupBy("directory").agg(F.max("session_key").alias("_last_session"))
    header = _one_row_join(p, last_project).select(
        F.lit("project").alias("kind"), "directory", "name", "branch",
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("title"),
        F.col("project_last").alias("last_at"), "session_count",
        F.lit(False).alias("is_last"),
        (F.col("project_key") == F.col("_last_project")).alias("is_last_project"),
        F.concat("project_key", F.lit(SEP + "0")).alias("sort_key"))
    rows = (s.join(p.select("directory", "name", "project_key"), "directory")
            .join(last_session, "directory"))
    rows = _one_row_join(rows, last_project).select(
        F.lit("session").alias("kind"), "directory", "name", "branch",
        F.col("id").alias("session_id"), "title", "last_at",
        F.lit(None).cast("bigint").alias("session_count"),
        (F.col("session_key") == F.col("_last_session")).alias("is_last"),
        (F.col("project_key") == F.col("_last_project")).alias("is_last_project"),
        F.concat("project_key", F.lit(SEP + "1"), "session_key").alias("sort_key"))
    return header.unionByName(rows).orderBy("sort_key")


def flat_rows(sessions: DataFrame) -> DataFrame:
    """TREE2: sessions only, newest first, with the project name."""
    return sessions.select(
        F.col("id").alias("session_id"), "directory", TX.project_name("directory").alias("project"),
        TX.title_or_default("title").alias("title"), "branch", "last_at", "message_count"
    ).orderBy(F.col("last_at").desc_nulls_last(), "session_id")


def project_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """FLT15: the sessions of every project whose name or directory, or any of
    whose session titles, contains ``query`` (case-insensitive).  The tree is
    built and ordered from these, once."""
    hit = (TX.contains_ci(TX.title_or_default("title"), query) | TX.contains_ci("directory", query)
           | TX.contains_ci(TX.project_name("directory"), query))
    dirs = sessions.where(hit).select("directory").distinct()
    return sessions.join(dirs, "directory", "left_semi")


# ---- lineage ---------------------------------------------------------------


def link_parents(sessions: DataFrame) -> DataFrame:
    """JN7: ``link`` = parent id when the parent is a session of the same
    directory, else NULL (the session is a root)."""
    parents = sessions.select(F.col("id").alias("parent_id"), "directory", F.lit(True).alias("_p"))
    return (sessions.join(parents, ["parent_id", "directory"], "left")
            .withColumn("link", F.when(F.col("_p"), F.col("parent_id")))
            .drop("_p"))


ENTER, LEAVE = 0, 1


def _elem(is_root: Column) -> Column:
    k = F.when(is_root, _num(F.lit(BIG) - F.col("last_at"), BIG + 1)).otherwise(_num(F.col("started_at"), BIG + 1))
    return F.concat(k, F.col("id"), F.lit(SEP))


def _tour(nodes: DataFrame) -> DataFrame:
    """Entries (id, side) of the Euler tours with the entry before each (pv, pv_side),
    and the sums of the entry before: 1 entered, 1 open, or 0 and -1 for one left.
    ``nodes``: (id, link, elem), elem ordering siblings."""
    children = nodes.where(F.col("link").isNotNull()).select("id", "link", "elem")
    day = F.substring("elem", 1, KEY_WIDTH - 8)          # siblings by some 28 hours of their start
    children, last = previous_within(children, "link", day, ["elem"], "id")
    enter = children.select("id", F.coalesce("previous", "link").alias("pv"),
                            F.when(F.col("previous").isNull(), ENTER).otherwise(LEAVE).alias("pv_side"), F.lit(None).cast("string").alias("root_key"))
    heads = nodes.where(F.col("link").isNull()).select("id", F.lit(None).cast("string").alias("pv"), F.lit(None).cast("int").alias("pv_side"),
                                                       F.col("elem").alias("root_key"))
    leave = nodes.select("id").join(last.select(F.col("link").alias("of"), "last"), F.col("id") == F.col("of"), "left").select(
        "id", F.coalesce("last", "id").alias("pv"), F.when(F.col("last").isNull(), ENTER).otherwise(LEAVE).alias("pv_side"),
        F.lit(None).cast("string").alias("root_key"))
    rows = enter.unionByName(heads).withColumn("side", F.lit(ENTER)).unionByName(leave.withColumn("side", F.lit(LEAVE)))
    return rows.select("id", "side", "pv", "pv_side", "root_key",
                       F.when(F.col("pv_side") == ENTER, 1).otherwise(0).cast("bigint").alias("rank"),
                       F.when(F.col("pv_side") == ENTER, 1).when(F.col("pv_side") == LEAVE, -1).otherwise(0).cast("bigint").alias("open"))


def _ranked(tour: DataFrame, max_rounds: int) -> DataFrame:
    """The finished entries (id, side, root_key, rank, open)."""
    state = checkpointed(tour)
    settled, moving = [state.where(F.col("pv").isNull())], state.where(F.col("pv").isNotNull())
    active, rounds = moving.count(), 0
    while active:
        if rounds == max_rounds:
            raise RuntimeError(f"lineage unresolved after {max_rounds} rounds")
        t = state.select(F.col("id").alias("_id"), F.col("side").alias("_side"), F.col("pv").alias("_pv"), F.col("pv_side").alias("_pv_side"),
                         F.col("root_key").alias("_root"), F.col("rank").alias("_rank"), F.col("open").alias("_open"))
        moving = checkpointed(moving.join(t, (F.col("pv") == F.col("_id")) & (F.col("pv_side") == F.col("_side"))).select(
            "id", "side", F.col("_pv").alias("pv"), F.col("_pv_side").alias("pv_side"), F.col("_root").alias("root_key"),
            (F.col("rank") + F.col("_rank")).alias("rank"), (F.col("open") + F.col("_open")).alias("open")))
        rounds += 1
        settled.append(moving.where(F.col("pv").isNull()))
        moving = moving.where(F.col("pv").isNotNull())
        left = moving.count()
        if left == active:
            break       # only cycles (and what hangs on them) remain
        active = left
        # targets of the next round: what has finished so far, and what moved
        state = reduce(DataFrame.unionAll, [*settled, moving])
    return reduce(DataFrame.unionAll, settled)


def _nodes(sessions: DataFrame, max_rounds: int) -> DataFrame:
    linked = link_parents(sessions.select("id", "directory", "parent_id", "started_at", "last_at"))
    is_root = F.col("link").isNull()
    linked = checkpointed(linked.select("id", "directory", "link", _elem(is_root).alias("elem")))
    kids = linked.where(F.col("link").isNotNull()).groupBy("link").agg(F.count(F.lit(1)).alias("child_count"))
    nodes = linked.join(kids.withColumnRenamed("link", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    # a root without children is a tree of its own
    in_tree = F.col("link").isNotNull() | F.col("child_count").isNotNull()
    ranked = _ranked(_tour(nodes.where(in_tree).select("id", "link", "elem")), max_rounds).where(F.col("side") == ENTER)
    single = nodes.where(~in_tree).select("id", F.col("elem").alias("root_key"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("open"))
    places = ranked.select("id", "root_key", "rank", "open").unionByName(single).withColumnRenamed("id", "_at")
    nodes = nodes.join(places, F.col("id") == F.col("_at"))
    sib = F.coalesce(F.col("link"), F.lit(""))
    last_sib = nodes.groupBy(F.col("directory").alias("_dir"), sib.alias("_sib")).agg(F.max("elem").alias("_last_elem"))
    nodes = nodes.join(last_sib, (F.col("directory") == F.col("_dir")) & (sib == F.col("_sib")))
    return nodes.select(
        "id", "directory", F.col("link").alias("tree_parent"), F.expr(f"substring(root_key, {KEY_WIDTH + 1}, length(root_key) - {KEY_WIDTH + 1})").alias("root_id"),
        F.col("open").cast("int").alias("depth"), F.col("rank").cast("int").alias("preorder"),
        F.coalesce("child_count", F.lit(0).cast("bigint")).alias("child_count"),
        ((F.col("elem") == F.col("_last_elem")) & F.col("child_count").isNull()).alias("is_last"), "root_key")


def lineage(sessions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """TREE3-5: ``(id, directory, tree_parent, root_id, depth, preorder, child_count,
    is_last)`` for every session not on a parent cycle; preorder counts from 0 within
    the root's tree."""
    return _nodes(sessions, max_rounds).drop("root_key")


def cycles(sessions: DataFrame) -> DataFrame:
    """``(id, directory, cycle, on_cycle, cycle_size)`` of every session that has no
    root: ``cycle`` is the smallest id of the parent cycle that it is on or hangs on.

    Smallest-label doubling on the parent function: after k rounds ``to`` is the parent
    2**k steps up and ``low`` the smallest id on the way.  Once 2**k is no less than
    the number of these sessions, every ``to`` is on a cycle, every cycle's sessions are
    someone's ``to``, and the ``low`` of such a session is its cycle's.
    """
    linked = checkpointed(link_parents(sessions.select("id", "directory", "parent_id", "started_at", "last_at")).select("id", "directory", "link"))
    rooted = _nodes(sessions, 64).select("id")
    state = checkpointed(linked.join(rooted, "id", "left_anti").select("id", "directory", F.col("link").alias("to"), F.col("id").alias("low")))
    n = state.count()
    for _ in range(max(n - 1, 0).bit_length()):
        t = state.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        state = checkpointed(state.join(t, F.col("to") == F.col("_id")).select(
            "id", "directory", F.col("_to").alias("to"), F.least("low", "_low").alias("low")))
    on = state.select(F.col("to").alias("_on")).distinct()
    members = state.join(on, F.col("id") == F.col("_on"), "left_semi").select(F.col("id").alias("_member"), F.col("low").alias("cycle"))
    sizes = members.groupBy(F.col("cycle").alias("_cycle")).agg(F.count(F.lit(1)).alias("cycle_size"))
    reached = state.join(members, F.col("to") == F.col("_member")).select("id", "directory", "cycle")
    return (reached.join(members.select("_member"), F.col("id") == F.col("_member"), "left")
            .join(sizes, F.col("cycle") == F.col("_cycle"))
            .select("id", "directory", "cycle", F.col("_member").isNotNull().alias("on_cycle"), "cycle_size"))


def lineage_rows(sessions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """TREE1 in lineage mode: project headers, then each project's sessions
    in preorder (roots newest first, children oldest first).  Projects are
    ordered by the newest *root* (S41)."""
    lin = _nodes(sessions, max_rounds)
    info = sessions.select("id", "branch", TX.title_or_default("title").alias("title"), "last_at")
    nodes = lin.join(info, "id")
    roots = nodes.where(F.col("depth") == 0)
    proj = (roots.groupBy("directory").agg(F.max("last_at").alias("project_last"))
            .withColumn("project_key", newest_first_key("project_last", "directory")))
    rollup = project_rollup(sessions).drop("project_last")
    proj = proj.join(rollup, "directory")
    last_project = proj.agg(F.max("project_key").alias("_last_project"))
    header = _one_row_join(proj, last_project).select(
        F.lit("project").alias("kind"), "directory", "name", "branch",
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("depth"), F.col("project_last").alias("last_at"),
        F.lit(False).alias("is_last"),
        (F.col("project_key") == F.col("_last_project")).alias("is_last_project"),
        F.concat("project_key", F.lit(SEP + "0")).alias("sort_key"))
    rows = nodes.join(proj.select("directory", "name", "project_key"), "directory")
    rows = _one_row_join(rows, last_project).select(
        F.lit("session").alias("kind"), "directory", "name", "branch",
        F.col("id").alias("session_id"), "title", "depth", "last_at", "is_last",
        (F.col("project_key") == F.col("_last_project")).alias("is_last_project"),
        F.concat("project_key", F.lit(SEP + "1"), "root_key", _num(F.col("preorder"))).alias("sort_key"))
    return header.unionByName(rows).orderBy("sort_key")
