"""Crawl frontier: robots rules, admission, schedule, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import fixed, urls as U
from gleaner.functions.common import col, first_of, let
from gleaner.operators.skew import salted_join


# --- robots --------------------------------------------------------------------------------
def _robots_groups(text: Column | str) -> Column:
    """Groups of a robots file in order: array of (grp, lines), lines with seq, kind and value.

    A group is a run of user-agent lines and the rules after it. A blank line, or a user-agent line
    after a rule, ends it; rules outside any group are ignored. Each line is looked at a fixed number of times:
    groups are slices between the places where one begins or ends.
    """
    lines = F.transform(
        F.split(col(text), r"\r\n|[\n\r]"),
        lambda l, i: F.struct(
            i.alias("seq"),
            F.when(F.regexp_replace(l, r"#.*$", "").rlike(r"^\s*$"), F.when(~l.rlike(r"^\s*#"), "blank"))
            .otherwise(F.lower(F.trim(F.regexp_extract(l, r"^\s*([A-Za-z-]+)\s*:", 1)))).alias("kind"),
            F.trim(F.regexp_replace(F.regexp_extract(l, r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"#.*$", "")).alias("value"),
        ),
    )
    told = F.filter(lines, lambda l: l["kind"].isin("blank", "user-agent", "allow", "disallow"))

    def cut(told: Column) -> Column:
        def begins(l: Column, i: Column) -> Column:
            return (l["kind"] == "user-agent") & ((i == 0) | (F.get(told, i - 1)["kind"] != "user-agent"))

        edges = F.filter(
            F.transform(told, lambda l, i: F.struct(i.alias("at"), begins(l, i).alias("begins"), (l["kind"] == "blank").alias("blank"))),
            lambda e: e["begins"] | e["blank"],
        )

        def spans(edges: Column) -> Column:
            ends = F.transform(
                edges, lambda e, k: F.struct(e["begins"].alias("begins"), e["at"].alias("at"), F.coalesce(F.get(edges, k + 1)["at"], F.size(told)).alias("to"))
            )
            return F.transform(
                F.filter(ends, lambda e: e["begins"]),
                lambda e, k: F.struct((k + 1).alias("grp"), F.slice(told, e["at"] + 1, e["to"] - e["at"]).alias("lines")),
            )

        return let(edges, spans)

    return let(told, cut)


def _is_rule(line: Column) -> Column:
    return line["kind"] != "user-agent"


def _rule(line: Column) -> Column:
    # an empty Disallow allows everything
    allow = (line["kind"] == "allow") | (line["value"] == "")
    return F.named_struct(F.lit("seq"), line["seq"], F.lit("path"), line["value"], F.lit("allow"), allow)


def _decoded(path: Column) -> Column:
    """A path without percent escapes; one with broken escapes stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def parse_robots(robots: DataFrame) -> DataFrame:
    """Rule table (domain, agent, grp, seq, path, allow) from (domain, robots_txt)."""
    groups = robots.select("domain", F.explode(_robots_groups("robots_txt")).alias("g"))
    agents = groups.select(
        "domain", F.col("g.grp").alias("grp"), F.transform(F.filter("g.lines", _is_rule), _rule).alias("rules"),
        F.explode(F.filter("g.lines", lambda l: ~_is_rule(l))).alias("a"),
    )
    return agents.select("domain", F.lower("a.value").alias("agent"), "grp", F.explode("rules").alias("r")).select(
        "domain", "agent", "grp", "r.seq", "r.path", "r.allow"
    )


def rules_for_agent(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, rules) that hold for one crawler: its own group, else the first group for all."""
    name = agent.split("/")[0].lower()

    def choose(groups: Column) -> Column:
        def group(match) -> Column:
            """The first group with rules and a matching agent."""
            return first_of(F.filter(groups, lambda g: F.exists(g["lines"], _is_rule) & F.exists(
                g["lines"], lambda l: ~_is_rule(l) & match(F.lower(l["value"]))
            )))

        everyone = group(lambda a: a == "*")
        own = everyone if name == "*" else F.coalesce(
            group(lambda a: (a != "*") & (a != "") & F.lit(name).contains(a)), everyone
        )
        return F.coalesce(
            F.transform(F.filter(own["lines"], _is_rule), lambda l: _rule(l).withField("path", _decoded(l["value"]))),
            F.array().cast("array<struct<seq:int,path:string,allow:boolean>>"),
        )

    return robots.select("domain", let(_robots_groups("robots_txt"), choose).alias("rules"))


def rule_index(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(domain, index): the paths that hold for one crawler, sorted, each with the rules whose paths it begins with.

    ``*`` stands for every path. A path is met with those of its beginnings that have the length of a rule, by a
    join, so the work grows with the rules and not with their pairs.
    """
    every = rules_for_agent(robots, agent).select("domain", F.explode("rules").alias("r"))
    path = F.when(F.col("r.path") == "*", "").otherwise(F.col("r.path"))
    rules = every.select("domain", path.alias("path"), F.struct("r.seq", "r.allow").alias("r")).groupBy("domain", "path").agg(F.min("r").alias("r"))
    lengths = rules.groupBy("domain").agg(F.collect_set(F.length("path")).alias("lengths"))
    cut = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    begun = rules.select("domain", "path").join(lengths, "domain").select("domain", "path", cut.alias("n"))
    begun = begun.select("domain", F.col("path").alias("_path"), "n", F.expr("substring(path, 1, n)").alias("path"))
    chains = begun.join(rules, ["domain", "path"]).groupBy("domain", "_path").agg(F.collect_list(F.struct("n", "r")).alias("chain"))
    return chains.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct(F.col("_path").alias("path"), "chain"))).alias("index"))


def robots_gate(urls: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """URLs with ``allowed``: the first rule whose path the URL starts with decides, both without percent
    escapes; no rule, no robots file or an unknown domain allows.

    The rules of a domain travel as one sorted array, so a URL meets one row, not one per rule, and no
    aggregation follows. The last path that is not after the URL begins with every path that the URL begins with; it
    is found by bisection. One domain may hold a third of all URLs: hot domains are salted.
    """
    keyed = urls.withColumn("domain", U.domain(url))
    joined = salted_join(keyed, rule_index(robots, agent), "domain", "left")
    index = F.col("index")

    def decided(target: Column) -> Column:
        def halved(at: Column, _: Column) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            before = F.coalesce(F.get(index, mid)["path"] <= target, F.lit(False))
            return F.struct(F.when(before, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(before, at["hi"]).otherwise(mid).alias("hi"))

        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(index) + 2)).cast("int"))
        last = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(index).alias("hi")), halved, lambda at: F.get(index, at["lo"] - 1))
        return let(last, lambda p: F.array_min(F.transform(
            F.filter(p["chain"], lambda c: target.startswith(F.substr(p["path"], F.lit(1), c["n"]))), lambda c: c["r"]
        )))

    hit = F.when(index.isNotNull(), let(_decoded(U.path_and_query(url)), decided))
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("index")


# --- admission and schedule ----------------------------------------------------------------
def admit(candidates: DataFrame, visited: DataFrame, in_progress: DataFrame | None = None) -> DataFrame:
    """New URLs at their best priority, each once. Candidates are reduced to one row per URL on the
    map side before they meet the much larger visited table."""
    fresh = candidates.groupBy("url").agg(F.min("priority").alias("priority"))
    fresh = fresh.join(visited.select("url"), "url", "left_anti")
    if in_progress is not None:
        fresh = fresh.join(in_progress.select("url"), "url", "left_anti")
    return fresh


def schedule(
    frontier: DataFrame,
    budget: int = fixed.CRAWL_BUDGET,
    delay: float = fixed.CRAWL_DELAY_SECONDS,
    done: DataFrame | None = None,
    keep_skipped: bool = True,
) -> DataFrame:
    """(url, domain, priority, status, position, wait_seconds) of a frontier with one row per URL.

    Inside a domain URLs run by (priority, url) until the budget, less what is already ``done``
    (domain, n_done), is used up; each waits for the politeness delay. A column ``allowed`` (see
    :func:`robots_gate`) marks URLs that robots rules skip.

    The ranking keeps ``budget`` rows per domain and is planned as a group limit before the shuffle,
    so no task sorts a whole hot domain. URLs over the budget need no rank; they are what is left
    after an anti join on the URL, which no key skews.
    """
    rows = frontier.withColumn("domain", U.domain("url")) if "domain" not in frontier.columns else frontier
    gated = "allowed" in rows.columns
    ready = rows.filter("allowed") if gated else rows
    ready = ready.select("url", "domain", "priority")
    rn = F.row_number().over(W.partitionBy("domain").orderBy("priority", "url"))
    ranked = ready.withColumn("position", rn).filter(F.col("position") <= budget)
    if done is not None:
        left = F.lit(budget) - F.coalesce("n_done", F.lit(0))
        ranked = ranked.join(done, "domain", "left").filter(F.col("position") <= left).drop("n_done")
    planned = ranked.select(
        "url", "domain", "priority", F.lit("scheduled").alias("status"), "position",
        ((F.col("position") - 1) * F.lit(float(delay))).alias("wait_seconds"),
    )
    if not keep_skipped:
        return planned

    def skipped(part: DataFrame, status: str) -> DataFrame:
        return part.select(
            "url", "domain", "priority", F.lit(status).alias("status"),
            F.lit(None).cast("int").alias("position"), F.lit(None).cast("double").alias("wait_seconds"),
        )

    out = planned.union(skipped(ready.join(planned.select("url"), "url", "left_anti"), "skipped"))
    if gated:
        out = out.union(skipped(rows.filter("not allowed"), "skipped_robots"))
    return out


# --- status --------------------------------------------------------------------------------
def crawl_status(attempts: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """(url, status, n_failures): done after any success, failed after more than ``max_retries``
    failures, else retrying. Works on streams as well."""
    folded = attempts.groupBy("url").agg(
        F.max("ok").alias("_done"), F.count_if(~F.col("ok")).alias("n_failures")
    )
    status = F.when(F.col("_done"), "done").when(F.col("n_failures") > max_retries, "failed").otherwise("retrying")
    return folded.select("url", status.alias("status"), "n_failures")


def latest_status(log: DataFrame) -> DataFrame:
    """(url, status): the newest status of each URL; a tie goes to the greater status text."""
    return log.groupBy("url").agg(F.max(F.struct("ts", "status")).alias("s")).select("url", "s.status")


def lookup_status(asked: DataFrame, statuses: DataFrame) -> DataFrame:
    """Status of the asked URLs, 'unknown' where there is none."""
    return asked.join(statuses.select("url", "status"), "url", "left").withColumn(
        "status", F.coalesce("status", F.lit("unknown"))
    )


def urls_with_status(statuses: DataFrame, status: str) -> DataFrame:
    return statuses.filter(F.col("status") == status).select("url")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("n_urls"))
