"""The investigation tools as functions with parameters, over one set of tables.

Every tool gives DataFrames, a dictionary of them where it answers several questions.
``collect`` runs the tools that an entry point asks for, ``enrichments`` tells which more
are worth it, and ``suggestions`` what to scrape next; each is plain table work, so that an
agent or a notebook may stand behind it.

Tables: accounts(account_id, username, display_name, platform, platform_id, is_suspicious),
posts(post_id, account_id, platform, published_at, narrative_id, campaign_id, hashtag, prediction,
final_score, is_duplicate_of, community_id, likes), media(media_id, post_ids, source_user,
status, final_score), ranks(account_id, score).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockscope.operators import investigation as V
from flockscope.operators.nodes import media_of_account


@dataclass(frozen=True)
class Limits:
    """Thresholds of the enrichment and suggestion rules."""

    deepfake: float = 0.65
    duplicates: int = 3
    community: int = 5
    calls: int = 4
    copies_high: int = 5
    tags_high: int = 10
    tags_watch: int = 3
    silence_days: int = 20
    robotic_days: int = 20
    robotic_rate: float = 0.8


@dataclass(frozen=True)
class Tools:
    accounts: DataFrame
    posts: DataFrame
    media: DataFrame
    ranks: DataFrame
    limits: Limits = Limits()

    # accounts

    def find_account(self, platform: str, name: str) -> DataFrame:
        """The account of this name or id on a platform; a display name counts in any case of its letters."""
        wanted = name.lstrip("@")
        rank = (F.when((F.col("username") == wanted) | (F.col("platform_id") == wanted) | (F.col("display_name") == wanted), 0).when(F.lower("display_name") == wanted.lower(), 1))
        return self.accounts.filter(F.col("platform") == platform).withColumn("_r", rank).filter("_r is not null").orderBy("_r", "account_id").limit(1).drop("_r")

    def get_account_info(self, platform: str, name: str) -> DataFrame:
        """The account with the summary of its scored posts; no row if it is unknown."""
        found = self.find_account(platform, name)
        own = self.posts.join(F.broadcast(found.select("account_id")), "account_id", "left_semi")
        return found.join(V.deepfake_summary(own), "account_id", "left")

    def get_account_posts(self, account_id: int, limit: int = 20) -> DataFrame:
        """The latest posts, 50 at most."""
        own = self.posts.filter(F.col("account_id") == account_id)
        return own.orderBy(F.desc("published_at"), "post_id").limit(max(1, min(limit, 50))).select("post_id", "published_at", "prediction", "final_score", "narrative_id")

    def get_media_scores(self, account_id: int) -> DataFrame:
        """The scored media of an account, found by its posts or its names, whichever finds more."""
        own = self.accounts.filter(F.col("account_id") == account_id)
        names = own.select(F.explode(F.array_compact(F.array("username", "display_name"))).alias("name")).filter("name <> ''")
        return media_of_account(self.media, self.posts.filter(F.col("account_id") == account_id).select("post_id"), names)

    # the graph around an account

    def get_graph_neighbors(self, account_id: int) -> dict[str, DataFrame]:
        mine = F.col("account_id") == account_id
        own = self.posts.filter(mine)
        member = self.posts.filter("community_id <> 0").select("account_id", "community_id").distinct()
        peers = member.join(F.broadcast(member.filter(mine).select("community_id")), "community_id", "left_semi").filter(~mine).select("account_id").distinct()
        peers = peers.join(self.ranks, "account_id", "left").join(self.accounts.select("account_id", "is_suspicious"), "account_id", "left")
        tags = self.posts.filter(~mine).join(own.select("hashtag").distinct(), "hashtag", "left_semi")
        users = self.media.filter("size(post_ids) > 0").select("media_id", F.explode("post_ids").alias("post_id")).join(self.posts.select("post_id", "account_id"), "post_id")
        shared = users.filter(~mine).join(users.filter(mine).select("media_id").distinct(), "media_id", "left_semi")
        copies = V.copy_pairs(V.duplicate_edges(self.posts))
        return {
            "community_accounts": peers.orderBy(F.desc("score"), "account_id").limit(20),
            "shared_hashtags": tags.groupBy("account_id").agg(F.count_distinct("hashtag").alias("tags")).orderBy(F.desc("tags"), "account_id").limit(15),
            "shared_media": shared.groupBy("account_id").agg(F.count_distinct("media_id").alias("media")).orderBy(F.desc("media"), "account_id").limit(15),
            "duplicated_from": copies.filter(F.col("copier") == account_id).select(F.col("author").alias("account_id"), "copies").orderBy(F.desc("copies"), "account_id").limit(10),
            "copied_by": copies.filter(F.col("author") == account_id).select(F.col("copier").alias("account_id"), "copies").orderBy(F.desc("copies"), "account_id").limit(10),
            "narratives": own.filter("narrative_id is not null").groupBy("narrative_id").agg(F.count(F.lit(1)).alias("posts")).orderBy(F.desc("posts"), "narrative_id").limit(10),
            "campaigns": own.filter("campaign_id is not null").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("posts")).orderBy(F.desc("posts"), "campaign_id").limit(5),
        }

    # narratives and campaigns

    def get_narrative(self, narrative_id: str) -> dict[str, DataFrame]:
        own = self.posts.filter(F.col("narrative_id") == narrative_id)
        stats = own.agg(F.count(F.lit(1)).alias("posts"), F.count_distinct("account_id").alias("accounts"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"),
                        V.avg6("final_score").alias("avg_score"), F.count_if(V.is_synthetic()).alias("synthetic"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
        return {"stats": stats, "accounts": V.top_accounts(own, self.accounts, 10)}

    def search_accounts_by_narrative(self, narrative_id: str, limit: int = 20) -> DataFrame:
        return V.top_accounts(self.posts.filter(F.col("narrative_id") == narrative_id), self.accounts, limit, "inner")

    def get_campaign_signals(self, campaign_id: str) -> dict[str, DataFrame]:
        """The campaign's first 20 accounts and its narratives."""
        own = self.posts.filter(F.col("campaign_id") == campaign_id)
        members = own.select("account_id").distinct().orderBy("account_id").limit(20)
        return {"accounts": members.join(self.accounts.select("account_id", "username", "platform"), "account_id"),
                "narratives": own.groupBy("narrative_id").agg(F.count(F.lit(1)).alias("posts"), V.avg6("final_score").alias("avg_score")),
                "signals": own.agg((F.count("is_duplicate_of") / F.count(F.lit(1))).alias("duplicate_ratio"), (F.count_distinct("platform") > 1).alias("cross_platform"),
                                   (F.count_if(V.is_synthetic()) / F.count(F.lit(1))).alias("synthetic_ratio"))}

    def get_campaign_graph(self, campaign_id: str) -> dict[str, DataFrame]:
        """Accounts, hashtags, communities and copies of a campaign, and a summary over the lists as they are cut."""
        own = self.posts.filter(F.col("campaign_id") == campaign_id)
        accounts = own.groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), V.avg6("final_score").alias("avg_score"), F.count_if(V.is_synthetic()).alias("synthetic"),
                                                 F.count("is_duplicate_of").alias("duplicates"), F.min("platform").alias("platform")).orderBy(F.desc("posts"), "account_id").limit(20)
        copies = V.copy_pairs(V.duplicate_edges(self.posts).join(own.select(F.col("post_id").alias("copy_id")), "copy_id", "left_semi")).orderBy(F.desc("copies"), "copier", "author").limit(15)
        scored = F.when(F.col("avg_score") != 0, F.col("avg_score"))
        summary = accounts.agg(F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"), F.count(F.lit(1)).alias("accounts"), F.sum("posts").alias("posts"),
                               F.sum("duplicates").alias("copies"), F.round(F.avg(scored), 5).alias("avg_score"), (F.count_distinct("platform") > 1).alias("has_cross_platform"), (F.sum("duplicates") > 0).alias("has_duplicates"))
        return {"accounts": accounts, "hashtags": own.groupBy("hashtag").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "hashtag").limit(20),
                "communities": own.groupBy("community_id").agg(F.count_distinct("account_id").alias("accounts")).orderBy(F.desc("accounts"), "community_id").limit(10),
                "duplicates": copies, "summary": summary}

    # time

    def entry_posts(self, entry: str | int, kind: str) -> DataFrame:
        column = {"account": "account_id", "narrative": "narrative_id", "campaign": "campaign_id"}[kind]
        return self.posts.filter(F.col(column) == entry)

    def get_temporal_analysis(self, entry: str | int, kind: str = "campaign") -> dict[str, DataFrame]:
        own = self.entry_posts(entry, kind)
        out = {"timeline": V.timeline(own), "cooccurrence": V.cooccurrence(own), "cadence": V.cadence(own).orderBy(F.desc("posts"), "account_id").limit(15), "monthly": V.monthly(own),
               "propagation": V.propagation(own).orderBy("first_post", "account_id").limit(20), "silences": V.silence_gaps(own, 14, 5)}
        out["seed_account"] = own.agg(F.min(F.struct("published_at", "post_id", "account_id")).alias("f")).filter("f is not null").select("f.account_id", F.col("f.published_at").alias("first_post"))
        if kind == "campaign":
            others = self.posts.filter((F.col("campaign_id") != entry)).join(own.select("account_id").distinct(), "account_id", "left_semi")
            out["cross_campaign"] = (others.groupBy("account_id").agg(F.count_distinct("campaign_id").alias("campaigns"), F.count(F.lit(1)).alias("posts"))
                                     .orderBy(F.desc("campaigns"), F.desc("posts"), "account_id").limit(15))
        robotic = out["cadence"].filter((F.col("active_days") > self.limits.robotic_days) & (F.col("avg_per_day") >= self.limits.robotic_rate))
        out["robotic_accounts"] = robotic.select("account_id", "active_days", "avg_per_day")
        return out

    # what an agent does with them

    def collect(self, kind: str, entry: str | int, platform: str | None = None) -> dict[str, DataFrame]:
        """All tables of an entry point by tool and part: an account (by name) with up to three narratives and two campaigns, a
        narrative or campaign with its two most active accounts, a post's account."""
        tag = lambda name, got: {f"{name}.{k}": v for k, v in got.items()} if isinstance(got, dict) else {name: got}
        first = lambda df, column, n: [r[0] for r in df.select(column).limit(n).collect()]
        if kind == "post":
            author = first(self.posts.filter(F.col("post_id") == entry), "account_id", 1)
            who = self.accounts.filter(F.col("account_id") == author[0]).select("platform", "username").first() if author else None
            return self.collect("account", who.username, who.platform) if who else {}
        if kind == "account":
            info = self.get_account_info(platform or "", str(entry))
            out = {"account": info}
            for account_id in first(info, "account_id", 1):
                graph = self.get_graph_neighbors(account_id)
                out |= tag("posts", self.get_account_posts(account_id)) | tag("media", self.get_media_scores(account_id)) | tag("graph", graph)
                for i, n in enumerate(first(graph["narratives"], "narrative_id", 3)):
                    out |= tag(f"narrative{i}", self.get_narrative(n))
                for i, c in enumerate(first(graph["campaigns"], "campaign_id", 2)):
                    out |= tag(f"campaign{i}", self.get_campaign_signals(c))
                out |= tag("temporal", self.get_temporal_analysis(account_id, "account"))
            return out
        if kind == "narrative":
            found = self.search_accounts_by_narrative(str(entry))
            out = tag("narrative", self.get_narrative(str(entry))) | {"accounts": found} | tag("temporal", self.get_temporal_analysis(entry, kind))
            active = found.orderBy(F.desc("posts"), "account_id")
        else:
            graph = self.get_campaign_graph(str(entry))
            out = tag("campaign", self.get_campaign_signals(str(entry))) | tag("campaign_graph", graph) | tag("temporal", self.get_temporal_analysis(entry, kind))
            active = graph["accounts"].orderBy(F.desc("posts"), "account_id")
        for i, account_id in enumerate(first(active, "account_id", 2)):
            out[f"detail{i}.media"] = self.get_media_scores(account_id)
            out[f"detail{i}.summary"] = V.deepfake_summary(self.posts.filter(F.col("account_id") == account_id))
        return out

    def enrichments(self, account_id: int, campaign_id: str | None = None) -> DataFrame:
        """(call, target) in the order of the rules, ``calls`` at most: the two main narratives if the media score high on average, sources
        copied more than ``duplicates`` times, the suspicious of a community of ``community`` or more, and a campaign's main cross-campaign account."""
        graph, lim = self.get_graph_neighbors(account_id), self.limits
        call = lambda df, rule, name, target, order: df.select(F.lit(rule).alias("rule"), order.alias("place"), F.lit(name).alias("call"), target.cast("string").alias("target"))
        high = self.get_media_scores(account_id).agg(F.avg(F.coalesce("final_score", F.lit(0.0))).alias("m")).filter(F.col("m") > lim.deepfake)
        told = graph["narratives"].orderBy(F.desc("posts"), "narrative_id").limit(2).join(F.broadcast(high))  # one row or none
        peers = graph["community_accounts"]
        many = peers.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_suspicious").alias("s")).filter((F.col("n") >= lim.community) & (F.col("s") > 0))
        rules = [call(told, 1, "search_accounts_by_narrative", F.col("narrative_id"), -F.col("posts")),
                 call(graph["duplicated_from"].filter(F.col("copies") > lim.duplicates), 2, "get_temporal_analysis", F.col("account_id"), -F.col("copies")),
                 call(many, 3, "suspicious_community", F.lit(account_id), F.lit(0))]
        if campaign_id is not None:
            top = self.get_temporal_analysis(campaign_id, "campaign")["cross_campaign"].orderBy(F.desc("campaigns"), F.desc("posts"), "account_id").limit(1)
            rules.append(call(top, 4, "get_account_info", F.col("account_id"), F.lit(0)))
        return reduce(DataFrame.unionByName, rules).orderBy("rule", "place", "target").limit(lim.calls).select("call", "target")

    def suggestions(self, campaign_id: str) -> DataFrame:
        """(target, priority, reason) of a campaign: its seed account, robotic accounts, copiers, accounts of other campaigns too, its hashtags, its platforms if
        several, and accounts silent for more than ``silence_days`` days.  A target keeps its highest priority."""
        lim = self.limits
        time, graph = self.get_temporal_analysis(campaign_id, "campaign"), self.get_campaign_graph(campaign_id)
        account = lambda c: F.concat(F.lit("account:"), F.col(c).cast("string"))
        row = lambda df, target, priority, reason: df.select(target.alias("target"), priority.alias("priority"), F.lit(reason).alias("reason"))
        copies = graph["duplicates"].groupBy("copier").agg(F.sum("copies").alias("copies"))
        tags = graph["hashtags"].limit(5).filter(F.col("uses") >= lim.tags_watch)
        level: Callable[[Column, str], Column] = lambda high, low: F.when(high, F.lit("high")).otherwise(F.lit(low))
        rows = [row(time["seed_account"], account("account_id"), F.lit("high"), "seed"), row(time["robotic_accounts"], account("account_id"), F.lit("medium"), "robotic"),
                row(copies, account("copier"), level(F.col("copies") >= lim.copies_high, "medium"), "copier"), row(time["cross_campaign"].limit(3), account("account_id"), F.lit("medium"), "cross_campaign"),
                row(tags, F.concat(F.lit("tag:"), "hashtag"), level(F.col("uses") >= lim.tags_high, "watch"), "hashtag"),
                row(graph["summary"].filter("has_cross_platform"), F.concat(F.lit("platforms:"), "platforms"), F.lit("watch"), "cross_platform"),
                row(time["silences"].filter(F.col("gap") > lim.silence_days).select("account_id").distinct(), account("account_id"), F.lit("watch"), "silence")]
        rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
        best = F.min(F.struct(rank.alias("r"), "reason", "priority"))
        return reduce(DataFrame.unionByName, rows).groupBy("target").agg(best.alias("b")).select("target", F.col("b.priority").alias("priority"), F.col("b.reason").alias("reason"))

    def synthesis(self, campaigns: list[str]) -> DataFrame:
        """One row a campaign of a batch: what its summary says and how many accounts it shares with the others."""
        rows = [self.get_campaign_graph(c)["summary"].select(F.lit(c).alias("campaign_id"), "accounts", "posts", "copies", "avg_score", "platforms") for c in campaigns]
        pairs = self.posts.filter(F.col("campaign_id").isin(campaigns)).select("campaign_id", "account_id").distinct()
        shared = pairs.join(pairs.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("account_id"), "account_id", "left_semi").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("shared_accounts"))
        return reduce(DataFrame.unionByName, rows).join(shared, "campaign_id", "left").withColumn("shared_accounts", F.coalesce("shared_accounts", F.lit(0)))
