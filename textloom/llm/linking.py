"""Connected groups over candidate buckets, in DataFrame operations only.

A bucket holds things that may be alike. All pairs of a bucket are never emitted: each round picks a few leaders,
compares the other members with them, and merges what is linked. A leader has then met every member outside its own
group and leaves the bucket; a bucket whose members all lie in one group is done. Rounds go on until every bucket is
done, or until a last step that finds the pairs which are left without comparing all: each pair of a bucket is compared,
ruled out or lies in one group. No link that matters is lost, whatever a bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, release, small_side, stored

#: Buckets with several members that are broadcast at most, in all and at a time: the driver holds a broadcast several times
#: over, as rows, as a table and in pieces.
SHARED_BROADCAST_ROWS, SHARED_PART_ROWS = 3_000_000, 750_000
#: Linked things that are broadcast at most, so that the members need not be shuffled to meet them.
ROOTS_BROADCAST_ROWS = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every v in edges (a, b: long), as a stored table; root is the least id of its component.

    Each round points a vertex to the least of itself and its neighbours, shortens those paths, and contracts the
    edges, of which few rounds leave none. Null ends are ignored. No group is collected: only minima and joins.
    """
    links = stored(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    roots = None
    while not links.isEmpty():
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = near.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        near = stored(near)
        to = stored(near.join(near.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")))
        if roots is None:
            after = stored(to.select("v", F.col("p").alias("root")))
        else:
            step = to.select(F.col("v").alias("root"), "p")
            after = stored(roots.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        a, b = to.select(F.col("v").alias("a"), F.col("p").alias("pa")), to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        rest = links.join(a, "a").join(b, "b").where("pa <> pb")
        rest = stored(rest.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        discard(roots, links, near, to)
        roots, links = after, rest
    return links.select(F.col("a").alias("v"), F.col("b").alias("root")) if roots is None else roots


def joined_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (v, root) after edges (a, b) are added, as a stored table: only the groups that the edges meet are gone through
    again. A root is the least id of its group, before and after."""
    known = small_side(roots, ROOTS_BROADCAST_ROWS)
    ends = edges
    for x in "ab":
        ends = ends.join(known.withColumnsRenamed({"v": x, "root": f"root_{x}"}), x, "left")
    step = connected_components(ends.select(*[F.coalesce(f"root_{x}", x).alias(x) for x in "ab"]))
    to = small_side(step.select(F.col("v").alias("root"), F.col("root").alias("to")), ROOTS_BROADCAST_ROWS)
    before = roots.join(to, "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    out = stored(before, step.join(roots.select("v"), "v", "left_anti").select("v", "root"))
    discard(step)
    return out


def shared_buckets(members: DataFrame) -> DataFrame:
    """The members (bucket, id, ...; distinct) of buckets with two of them at least, as a stored table."""
    many = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    n = many.limit(SHARED_BROADCAST_ROWS + 1).count()
    if n > SHARED_BROADCAST_ROWS:
        out = stored(members.join(many, "bucket"))
    else:
        parts = -(-n // SHARED_PART_ROWS) or 1
        own = lambda df, i: df if parts == 1 else df.where(F.pmod(F.xxhash64("bucket"), F.lit(parts)) == i)
        out = stored(*(own(members, i).join(F.broadcast(own(many, i)), "bucket") for i in range(parts)))
    discard(many)
    return out


def central_members(members: DataFrame) -> DataFrame:
    """(bucket, lead): the member of each bucket whose buckets are largest in sum. Among copies of a text that were changed
    in different ways this is the text itself, or what is closest to it, which most of the others are linked to."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = members.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("weight"))
    weighted = members.join(weight, "id")
    most = weighted.groupBy("bucket").agg(F.max("weight").alias("most"))
    return weighted.join(most, "bucket").where("weight = most").groupBy("bucket").agg(F.min("id").alias("lead"))


def least_members(members: DataFrame) -> DataFrame:
    """(bucket, lead): the least member of each bucket. The buckets that a group shares have few different ones."""
    return members.groupBy("bucket").agg(F.min("id").alias("lead"))


def _led(members: DataFrame, leads: DataFrame, alike: Column | None, other: Column) -> DataFrame:
    """Distinct pairs (a, b) of members with a leader of their bucket that meet ``other`` and ``alike``. What members have
    besides bucket and id is there for the leader too, with lead_ before its name; pairs that fail don't leave the join. The
    pairs are stored, and what the leaders' join has shuffled goes before the members' join."""
    own = {c: f"lead_{c}" for c in members.columns if c not in ("bucket", "id")}
    if own:
        leads = stored(leads.join(members.withColumnsRenamed({"id": "lead", **own}), ["bucket", "lead"]))
        release(leads.sparkSession)
    pairs = members.join(leads, "bucket").where(other if alike is None else other & alike)
    pairs = stored(pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    if own:
        discard(leads)
    release(pairs.sparkSession)
    return pairs


def _met(members: DataFrame, alike: Column | None, other: Column) -> DataFrame:
    """As _led, but of each member with all others of its bucket: a pair's lesser id is the member, the other the leader.
    Both sides of the join are one shuffle."""
    own = [c for c in members.columns if c not in ("bucket", "id")]
    sides = members.alias("x").join(members.alias("y"), F.col("x.bucket") == F.col("y.bucket"))
    sides = sides.select("x.id", F.col("y.id").alias("lead"), *[F.col(f"x.{c}").alias(c) for c in own], *[F.col(f"y.{c}").alias(f"lead_{c}") for c in own])
    pairs = sides.where((F.col("id") < F.col("lead")) & (other if alike is None else other & alike))
    pairs = stored(pairs.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct())
    release(pairs.sparkSession)
    return pairs


def link_buckets(
    members: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    alike: Column | None = None,
    refine: Callable[[DataFrame], tuple[DataFrame, Column]] | None = None,
    leaders: int = 16,
    finish: Callable[[DataFrame], DataFrame] | None = None,
    first: Callable[[DataFrame], DataFrame] = central_members,
    closer: tuple[Callable[[DataFrame], DataFrame], Column] | None = None,
    whole: bool = False,
) -> DataFrame:
    """(v, root) of everything that is linked to something else.

    members: (bucket, id: long), distinct rows of buckets with two ids at least, and what ``alike`` needs: a condition on
    a member's columns and its leader's (lead_...), for pairs that are worth a closer look. confirm: gets distinct pairs
    (a, b), a < b, and returns those that are links. refine: gets the ids (id) of the buckets that the first round leaves
    with several groups, and returns members of finer buckets and their condition for the rounds that follow. leaders:
    how many a bucket has in the second round; later rounds have that many times as many each. finish: gets the members
    (with root: their group so far) that the second round leaves in buckets of several groups, and returns distinct pairs
    (a, b) among which are all links that are left between groups; without it rounds go on.
    first: makes (bucket, lead) of the first round from (bucket, id).
    closer: gets the members (bucket, id, ...) that the first round leaves and returns (id, ...), stored, with more columns of some of
    them; and a further condition on them and the leader's for the rounds after the first; it may not be null.
    whole: after the first round, buckets of at most ``leaders`` members are compared whole, and done; the conditions must
    then be the same from either side.
    """
    used = stored(first(members.select("bucket", "id")))
    pairs = _led(members, used, alike, F.col("id") != F.col("lead"))
    links = stored(confirm(pairs))
    discard(pairs)
    roots = connected_components(links)
    discard(links)
    table, rest, many = members, members, leaders
    while True:
        # A leader that has met all others leaves its bucket; so do buckets of one group.
        named = rest.join(small_side(roots.withColumnRenamed("v", "id"), ROOTS_BROADCAST_ROWS), "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = named.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("size")).where("least < most")
        named = named.join(open_.select("bucket", *["size"] * whole), "bucket")
        if refine is not None:
            rest, alike = refine(stored(named.select("id").distinct()))
            refine = None
            used = used.limit(0)
            continue
        left = named.join(used.select("bucket", F.col("lead").alias("id")), ["bucket", "id"], "left_anti")
        if closer is not None:
            bare = stored(left)
            release(bare.sparkSession)
            more = closer[0](bare)
            left, alike = stored(bare.join(more, "id", "left")), closer[1] if alike is None else alike & closer[1]
            closer = None
            discard(bare, more)
        rest = left if hasattr(left, "stored_at") else stored(left)
        discard(table, used)
        table = rest
        release(rest.sparkSession)
        if rest.isEmpty():
            return roots
        if finish is not None and many > leaders:
            return joined_components(roots, stored(confirm(finish(rest))))
        other, met = F.col("root") != F.col("lead_root"), None
        if whole:
            met = _met(table.where(F.col("size") <= leaders).drop("size"), alike, other)
            rest = table.where(F.col("size") > leaders).drop("size")
        used = stored(rest.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(many)).alias("part")).agg(F.min("id").alias("lead")).select("bucket", "lead"))
        pairs = _led(rest, used, alike, other)
        found = stored(confirm(pairs if met is None else pairs.union(met).distinct()))
        discard(pairs, met)
        if not found.isEmpty():
            was, roots = roots, joined_components(roots, found)
            discard(was)
        discard(found)
        rest, many = rest.drop("root"), many * leaders
