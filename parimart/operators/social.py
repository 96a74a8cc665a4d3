"""Read models over users, edges, tickets and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import top_k


def mutual_friends(edges: DataFrame) -> DataFrame:
    """Pairs accepted in both directions, each listed from both ends."""
    e = edges.where("state = 'accepted'").select("source_id", "target_id").distinct()
    back = e.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return e.join(back, ["source_id", "target_id"], "left_semi")


def friendship_state(edges: DataFrame) -> DataFrame:
    """State of each pair as its first user sees it: friends, pending in, pending out, or one-sided."""
    out = edges.groupBy("source_id", "target_id").agg(F.max(F.col("state") == "accepted").alias("out"))
    back = out.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("out").alias("back"))
    both = out.join(back, ["source_id", "target_id"], "full")
    code = F.when(F.col("out") & F.col("back"), "friends").when(F.col("out").isNull(), "pending_in").when(F.col("back").isNull(), "pending_out").otherwise("one_sided")
    return both.select("source_id", "target_id", code.alias("relation"))


def share_feed(tickets: DataFrame, friends: DataFrame, blocks: DataFrame, viewers: DataFrame, k: int = 100) -> DataFrame:
    """Newest ``k`` tickets a viewer may see: their own and mutual friends', without those of blocked users."""
    own = viewers.select(F.col("user_id").alias("viewer"), F.col("user_id").alias("owner"))
    seen = own.unionByName(friends.select(F.col("source_id").alias("viewer"), F.col("target_id").alias("owner"))).distinct()
    seen = seen.join(viewers.select(F.col("user_id").alias("viewer")), "viewer", "left_semi")
    seen = seen.join(blocks.select(F.col("source_id").alias("viewer"), F.col("target_id").alias("owner")), ["viewer", "owner"], "left_anti")
    # A viewer's newest k are among the newest k of each owner, so long histories don't multiply.
    newest = top_k(tickets, ["user_id"], [F.desc("created_at"), F.desc("ticket_id")], k).withColumnRenamed("user_id", "owner")
    rows = seen.join(newest, "owner").withColumn("mine", F.col("viewer") == F.col("owner"))
    return top_k(rows, ["viewer"], [F.desc("created_at"), F.desc("ticket_id")], k, "place")


def friends_on(items: DataFrame, friends: DataFrame, key: str, avatars: int = 8) -> DataFrame:
    """Distinct friends of each viewer per ``key``, and the first few of them."""
    seen = friends.select(F.col("source_id").alias("viewer"), F.col("target_id").alias("user_id")).join(items.select("user_id", key).distinct(), "user_id")
    ranked = top_k(seen, ["viewer", key], ["user_id"], avatars)
    first = ranked.groupBy("viewer", key).agg(F.array_sort(F.collect_list("user_id")).alias("first"))
    return seen.groupBy("viewer", key).agg(F.count(F.lit(1)).alias("friends")).join(first, ["viewer", key])


def user_search(users: DataFrame, name: str, prefix: str, blocked: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Names with a prefix whatever their case, an exact match first, without blocked users."""
    low = F.lower(F.col(name))
    rows = users.where(low.startswith(prefix.lower())).join(blocked, key, "left_anti")
    return rows.orderBy((low != prefix.lower()), low, key).limit(k)


def notification_list(rows: DataFrame, actors: DataFrame, user: str, actor: str, k: int = 50) -> DataFrame:
    """Each user's newest ``k`` with the actor's name and the user's number of unread ones."""
    unread = rows.groupBy(user).agg(F.count_if(~F.col("read")).alias("unread"))
    newest = top_k(rows, [user], [F.desc("created_at"), F.desc("event_id")], k)
    return newest.join(actors, actor, "left").join(unread, user)


def promote_wins(tickets: DataFrame, friends: DataFrame, notified: DataFrame) -> DataFrame:
    """``(ticket_id, recipient)`` of settled wins for mutual friends who weren't told before."""
    wins = tickets.where("state = 'won'").select("ticket_id", F.col("user_id").alias("source_id"))
    told = notified.select("ticket_id", "recipient")
    out = wins.join(friends.select("source_id", F.col("target_id").alias("recipient")), "source_id").select("ticket_id", "recipient")
    return out.join(told, ["ticket_id", "recipient"], "left_anti")


def rate_count(events: DataFrame, user: str, action: str, time: str, seconds: int, limit: int) -> DataFrame:
    """Events per user, action and window, and whether they pass the limit."""
    by = events.groupBy(user, action, F.window(F.col(time).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(user, action, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", (F.col("n") > limit).alias("limited"))
