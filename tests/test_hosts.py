"""Hosts by public-suffix rules, against the rules as they are worded."""

import random

from adsentry.operators import hosts as H

RULES = ["// a list", "", "com", "uk", "co.uk  remark", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "kawasaki.jp", "io", "github.io"]


def parted(host):
    rules = [r.split()[0].lower() for r in RULES if r and not r.startswith("//")]
    labels = host.lower().split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return "", host, ""
    size = 1
    free = [r[1:].split(".") for r in rules if r[0] == "!" and labels[-len(r.split(".")) :] == r[1:].split(".")]
    if free:
        size = len(free[0]) - 1
    else:
        for r in rules:
            own = r.split(".")
            if r[0] != "!" and len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own, labels[-len(own) :])):
                size = max(size, len(own))
    if size >= len(labels):
        return "", host.lower(), ""
    return ".".join(labels[: -size - 1]), labels[-size - 1], ".".join(labels[-size:])


def test_longest_rule_counts(spark):
    rng = random.Random(8)
    words = ["www", "city", "kawasaki", "jp", "ck", "co", "uk", "com", "github", "io", "a", "B", "xn--x"]
    hosts = {".".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(400)} | {"10.0.0.1", "localhost", "shop.example.co.uk", "x.www.ck"}
    rules = H.suffix_rules(spark.createDataFrame([(r,) for r in RULES], "rule string"))
    frame = spark.createDataFrame([(h,) for h in hosts] + [(None,), ("",), ("a.com",), ("a.com",)], "host string")
    got = {r.host: (r["sub"], r.domain, r.suffix) for r in H.parted_hosts(frame, rules).collect()}
    assert got == {h: parted(h) for h in hosts | {"a.com"}}
