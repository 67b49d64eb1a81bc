"""The prefix index of robots rules against looking at every rule."""

import random
import time

from gleaner.operators import frontier as Q


def urls(spark, paths, domain="h"):
    return spark.createDataFrame([(f"http://{domain}{p}",) for p in paths], "url string")


def test_first_rule_decides_whatever_the_index(spark):
    draw = random.Random(9)
    rules, asked = {}, {}
    for d in range(6):
        made = ["/" + "".join(draw.choice("ab/") for _ in range(draw.randint(0, 6))) for _ in range(draw.choice([0, 1, 5, 60]))]
        made += draw.choice([[], ["*"], [""]])
        draw.shuffle(made)
        rules[f"h{d}"] = [(p, draw.random() < 0.5) for p in made]
        asked[f"h{d}"] = ["/" + "".join(draw.choice("ab/é") for _ in range(draw.randint(0, 9))) for _ in range(120)] + [""]
    lines = {d: "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for p, a in own) for d, own in rules.items()}
    robots = spark.createDataFrame(list(lines.items()), "domain string, robots_txt string")
    rows = spark.createDataFrame([(f"http://{d}{p}",) for d, own in asked.items() for p in own] + [("http://elsewhere/a",), (None,)], "url string")
    for r in Q.robots_gate(rows, robots).collect():
        wanted = True
        if r.domain in rules:
            path = r.url.removeprefix(f"http://{r.domain}") or "/"
            fits = [a or p == "" for p, a in rules[r.domain] if p == "*" or path.startswith(p)]
            wanted = fits[0] if fits else True
        assert r.allowed == wanted, r


def test_many_rules_and_many_urls(spark):
    """Ten thousand rules: 5,000 URLs cost little more than 50, and nothing but rows of the result comes out of a join."""
    robots = spark.createDataFrame([("h", "User-agent: *\n" + "".join(f"Disallow: /d{i}/x\nAllow: /d{i}/\n" for i in range(5_000)))], "domain string, robots_txt string")

    def seconds(n):
        gate = Q.robots_gate(urls(spark, [f"/d{i % 5_000}/{'xy'[i % 2]}{i}" for i in range(n)]), robots)
        start = time.monotonic()
        got = gate.groupBy("allowed").count().collect()
        assert {r["allowed"]: r["count"] for r in got} == {True: n // 2, False: n // 2}
        return time.monotonic() - start

    seconds(10)
    assert seconds(5_000) < 10 * max(1.0, seconds(50))


def test_groups_of_a_file(spark):
    text = "Disallow: /none\nUser-agent: a # x\n# comment\nUser-Agent: B\nDisallow: /1 # y\nfoo: bar\nAllow: /2\n\nDisallow: /lost\nUser-agent: c\nUser-agent: *\r\nDisallow:\nUser-agent: d\n"
    robots = spark.createDataFrame([("h", text), ("e", ""), ("n", None)], "domain string, robots_txt string")
    got = sorted((r.domain, r.agent, r.grp, r.seq, r.path, r.allow) for r in Q.parse_robots(robots).collect())
    assert got == [
        ("h", "*", 2, 11, "", True), ("h", "a", 1, 4, "/1", False), ("h", "a", 1, 6, "/2", True),
        ("h", "b", 1, 4, "/1", False), ("h", "b", 1, 6, "/2", True), ("h", "c", 2, 11, "", True),
    ]
    assert [(r.domain, len(r.rules)) for r in Q.rules_for_agent(robots, "B/2").orderBy("domain").collect()] == [("e", 0), ("h", 2), ("n", 0)]
