import math
import random

from pyspark.sql import functions as F

from quillspark.llm import url_filter as uf

ORDINARY = "garden river stone market school music letter winter bridge harbor forest cloud paper kitchen museum travel science island village history".split()
PUSHED = "casino bets win free spam farm cheap pills loan click bonus poker jackpot adult replica deal prize forex slots cash".split()


def made_urls(spark, n, seed):
    """(url, verdict) of ``n`` made URLs. Allowed: ordinary words, sometimes a hyphen, short paths. Blocked: pushed words joined by
    hyphens or padded with digits, addresses as hosts, random hosts, deep paths and long queries. Top-level names, schemes,
    languages and endings are dealt alike, so that none of these tells the two apart."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n // 2):
        for bad in (False, True):
            words = rng.sample(PUSHED if bad else ORDINARY, 2)
            kind = rng.random()
            if not bad:
                host = ("-" if kind < 0.05 else "").join(words[: rng.choice((1, 1, 2))]) + (str(rng.randrange(100)) if kind > 0.97 else "")
            elif kind < 0.6:
                host = "-".join(words)
            elif kind < 0.8:
                host = "-".join(words) + str(rng.randrange(10, 9999))
            elif kind < 0.9:
                host = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randrange(14, 28)))
            else:
                host = ".".join(str(rng.randrange(256)) for _ in range(4))
            host = rng.choice(("", "", "www.", "blog.", "m.")) + host + rng.choice((".com", ".net", ".org", ".example.com", ".example.net", ".example.org"))
            path = f"/{rng.choice(('en', 'de', 'fr', 'es'))}/{rng.randrange(50_000)}"
            if bad and rng.random() < 0.2:
                path += "".join(f"/{rng.choice(PUSHED)}{rng.randrange(999)}" for _ in range(rng.randrange(2, 6)))
            end = rng.choice(("", "/", ".html", "?page=2&ref=x", "?utm_source=feed", "#top"))
            if bad and rng.random() < 0.2:
                end = "?" + "&".join(f"{rng.choice('abcdefgh')}{k}={rng.getrandbits(48):x}" for k in range(rng.randrange(4, 9)))
            rows.append((f"{rng.choice(('http', 'https'))}://{host}{path}{end}", "block" if bad else "allow"))
    return spark.createDataFrame(rows, "url string, verdict string")

URLS = [
    None, "", "no scheme.com/en/", "http://", "https://Example.COM/en/", "http://a.example.com/en/1?x=1", "http://www.example.com/en/2", "http://wwwexample.com/en/", "http://x.net/es/", "http://x.net/es",
    "http://net/fr/1#a", "ftp://com/", "http://com", "http://com?a/", "http://x.org/a://b", "http://é.COM/É?q", "http://x.example.com/EN/", "http://b.www.example.com/en/#", "http://x.com/en\n/1", "://com/a",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    best = (0, None, None)
    for verdict, rule in uf.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(rule) > best[0]:
            best = (len(rule), rule, verdict)
    return best[1:]


def test_hosts_paths_and_rules(spark, sf):
    odd = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, host string, length double")
    for df in (odd, spark.read.parquet(f"{sf}/pages.parquet")):
        urls = {r["page_id"]: r["url"] for r in df.collect()}
        got = uf.judge_urls(df).collect()
        assert sorted(r["page_id"] for r in got) == sorted(urls)
        for r in got:
            host, path = parse(urls[r["page_id"]])
            rule, verdict = rule_of(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
            assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
            assert host or r["verdict"] == "allow"


def test_held_out_accuracy(spark):
    made = made_urls(spark, 3000, 1)
    held = made_urls(spark, 1000, 2).withColumn("page_id", F.monotonically_increasing_id())
    got = uf.judge_urls(held, rules=(), labelled=made).alias("g").join(held.alias("h"), "page_id").select(F.col("g.verdict").alias("got"), F.col("h.verdict").alias("want")).collect()
    right = sum(r["got"] == r["want"] for r in got) / len(got)
    wrong = sum(r["got"] == "block" and r["want"] == "allow" for r in got) / len(got)
    assert right > 0.93 and wrong < 0.04


def test_entropy(spark):
    got = spark.createDataFrame([("",), ("aaaa",), ("ab",), ("abcd",)], "s string").select("s", uf.entropy(F.col("s")).alias("e")).collect()
    assert {r["s"]: round(r["e"], 6) for r in got if r["s"]} == {"aaaa": 0.0, "ab": 1.0, "abcd": 2.0}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    none = spark.createDataFrame([], "url string, verdict string")
    assert {r["verdict"] for r in uf.judge_urls(df, rules=(), labelled=none).collect()} == {"allow"}
    assert {r["verdict"] for r in uf.judge_urls(df, rules=(("allow", "com/"),)).collect()} == {"allow"}
    assert uf.judge_urls(df.where("false")).count() == 0


def test_trees_learn_from_rules_what_rules_do_not_say(spark):
    """Hosts of pushed words are blocked by place under one ending; under another, where no rule holds, the trees find them."""
    made = made_urls(spark, 2000, 3).select(F.regexp_replace("url", r"\.(com|net|org)/", F.when(F.col("verdict") == "block", ".bad/").otherwise(".good/")).alias("url"))
    held = made_urls(spark, 600, 4).select(F.regexp_replace("url", r"\.(com|net|org)/", ".new/").alias("url"), "verdict")
    rows = made.unionByName(held.select("url")).withColumn("page_id", F.monotonically_increasing_id())
    got = uf.judge_urls(rows, rules=(("block", "bad/"), ("allow", "good/"))).where("rule IS NULL").select("host", "path", "verdict").distinct()
    want = held.select(uf.host_of(F.col("url")).alias("host"), uf.path_of(F.col("url")).alias("path"), F.col("verdict").alias("want")).distinct()
    both = got.join(want, ["host", "path"]).collect()
    assert len(both) > 500 and sum(r["verdict"] == r["want"] for r in both) > 0.9 * len(both)


def test_features_leave_out_what_rules_speak_of(spark):
    df = spark.createDataFrame([(1, "http://a.b.example.com/en/1?x=1"), (2, "http://a.b.www.net/fr/1?x=1")], "page_id long, url string")
    got = uf.featured(df, uf.RULES, None, "page_id", "url").collect()
    assert all(got[0][c] == got[1][c] for c in uf.FEATURES if not c.endswith("_blocked"))


def test_suffixes_are_those_of_the_host(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.blog.{x}/p") for i, x in enumerate(["co.uk", "co.uk", "ac.uk", "example.com"])], "page_id long, url string")
    got = {r["id"]: (round(r["suffix1_rows"], 4), round(r["suffix2_rows"], 4)) for r in uf.featured(df, uf.RULES, None, "page_id", "url").collect()}
    log = lambda n: round(math.log1p(n), 4)
    # of example.com the labels that rules name go: its suffixes are those of its own part
    assert got == {0: (log(3), log(2)), 1: (log(3), log(2)), 2: (log(3), log(1)), 3: (log(1), log(1))}


def test_trees_find_a_planted_suffix(spark):
    """Hosts differ by their suffix alone: those under two of eight are blocked, but for some noise; others are judged by it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    ends = ["zip", "loan", "one", "two", "six", "ten", "day", "sea"]
    made = lambda n: [(f"https://{word()}.{end}/{word()}", end) for end in rng.choices(ends, k=n)]
    labelled = spark.createDataFrame([(u, "block" if (e in ("zip", "loan")) != (rng.random() < 0.004) else "allow") for u, e in made(2500)], "url string, verdict string")
    held = made(800)
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in uf.judge_urls(df, rules=(), labelled=labelled).collect()}
    want = {i: "block" if e in ("zip", "loan") else "allow" for i, (_, e) in enumerate(held)}
    assert sum(got[i] == want[i] for i in got) > 0.98 * len(held)


def test_nothing_is_blocked_without_a_cutoff(spark):
    """Labels that nothing in a URL tells: only a cutoff by which wrong blocks are few may count, so few are made."""
    rng = random.Random(10)
    made = lambda n: [f"https://{''.join(rng.choices('abcdefgh', k=8))}.org/" for _ in range(n)]
    labelled = spark.createDataFrame([(u, rng.choice(["block", "allow"])) for u in made(1500)], "url string, verdict string")
    df = spark.createDataFrame(list(enumerate(made(400))), "page_id long, url string")
    got = uf.judge_urls(df, rules=(), labelled=labelled).groupBy("verdict").count().collect()
    assert sum(r["count"] for r in got if r["verdict"] == "block") <= 24


def test_held_out_errors_by_host(spark, sf):
    got = uf.held_out_errors(spark.read.parquet(f"{sf}/pages.parquet"), folds=(0, 3)).collect()
    assert len(got) == 2 and all(0 <= r["wrong_blocks"] + r["missed"] <= r["n"] for r in got)
