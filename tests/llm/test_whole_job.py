"""Operators that have to work on all of their input, against brute force."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
from quarry.llm import url_filters
from quarry.llm.components import Sets


def one_per_group(texts, n, percent):
    """Smallest number of every group of texts whose sets of n-word shingles link."""
    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} for w in words]
    links = Sets()
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links.join(i, j)
    return sorted({links.root(i) for i in range(len(sets))})


def test_near_duplicates_are_five_words_at_four_fifths(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(3000)]
    texts = ["two words", "two words", "two other", "just four words here"]
    for edits in (0, 1, 2, 3, 4, 5, 6, 7, 8):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(200)]
            copy = list(base)
            for k in rng.sample(range(200), edits):
                copy[k] = "edited"
            texts += [" ".join(base), " ".join(copy)]
    want = one_per_group(texts, 5, 80)
    assert want != one_per_group(texts, 3, 90)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def tokens(segmenter, host, path, rule):
    """Words of a URL without what its rule names, as often as they stand there."""
    if rule:
        top, rest = rule.split("/", 1)
        host, path = host.removesuffix(top), path.removeprefix("/" + rest)
    out = []
    for kind, names in (("h:", re.findall(r"[^\W_]+", host)), ("p:", re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", path).lower()))):
        for name in names:
            out += [kind + w for w in (("#",) if name.isdigit() else segmenter.split(name))]
    return out


def test_every_row_trains(spark):
    """Log odds against naive Bayes written out over the rows themselves: class priors, every token as often as it stands, smoothing of all tokens."""
    urls = [f"http://bad{k}.net/p/{k}" for k in range(3)] + [f"http://good.org/p/{k}" for k in range(40)] + ["http://x.com/p/7", "http://good.com/q", None] + [f"http://casinobad.com/p/{k}" for k in range(9)]
    urls += ["http://bad.bad.com/good/good/good/7/8", "http://goodgood.com/bad/casino/casino", "x://casino.casino.com/", "http://good.org/bad/bad/bad"]
    pages = spark.createDataFrame([(k, u, "<p>good bad casino</p>") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(3)
    rules = [("net/", "block"), ("org/", "allow")]
    made = {r["page_id"]: r for r in url_filters.url_filter(pages, rules).collect()}
    segmenter = url_filters.Segmenter({"good": len(urls), "bad": len(urls), "casino": len(urls)})
    parts = [("", "") if u is None else (lambda h, _, p: (h, "/" + p))(*u.split("://", 1)[1].partition("/")) for u in urls]
    counts, rows = {True: Counter(), False: Counter()}, Counter()
    rule_of = lambda host: "net/" if host.endswith("net") else "org/" if host.endswith("org") else None
    for host, path in parts:
        rule = rule_of(host)
        found = tokens(segmenter, host, path, rule)
        block = rule == "net/" if rule else "h:casino" in found
        counts[block].update(found)
        rows[block] += 1
    assert counts[False]["p:good"] == 3 and counts[True]["h:casino"] > 10
    vocabulary = len(set(counts[True]) | set(counts[False])) + 1
    rate = lambda c, t: (counts[c][t] + 1) / (sum(counts[c].values()) + vocabulary)
    for k, (host, path) in enumerate(parts):
        if rule_of(host):
            assert made[k]["log_odds"] is None and made[k]["verdict"] == dict(rules)[rule_of(host)]
            continue
        want = math.log((rows[True] + 1) / (rows[False] + 1)) + sum(math.log(rate(True, t) / rate(False, t)) for t in tokens(segmenter, host, path, None))
        assert abs(made[k]["log_odds"] - want) < 1e-9
        assert made[k]["verdict"] == ("block" if want > math.log(9) else "allow")
    assert made[47]["verdict"] == "block" and made[44]["verdict"] == made[45]["verdict"] == "allow"


def test_names_meet_every_word_that_stands_in_them(spark):
    """More words than a table that is sent to all tasks should hold, equally rare ones, and one of over 24 letters."""
    long = "pneumonoultramicroscopicsilico"
    letters = "abcdefghijklmnopqrstuvwxyz"
    spell = lambda k: "".join(letters[k // 26**i % 26] for i in range(4))
    fill = [spell(k) for k in range(60_000)]
    html = ["<p>" + " ".join(fill[k : k + 6000]) + "</p>" for k in range(0, 60_000, 6000)] + [f"<b>zebraZ</b> quokka {long}<script>quokka quokka</script>"]
    pages = spark.createDataFrame([(h,) for h in html], "html string")
    words = url_filters.page_words(pages["html"], pages)
    counted = Counter(fill + ["zebraz", "quokka", long])
    assert {r["word"]: r["n"] for r in words.collect()} == counted
    names = [f"{long}quokka", "zebraz", "quokkazebraz", "abc123quokka", "nothing", "größe", "x" * 30_000, "#"]
    made = {r["name"]: tuple(r["parts"]) for r in url_filters.splits(spark.createDataFrame([(n,) for n in names], "name string"), words).collect()}
    whole = url_filters.Segmenter(counted)
    assert set(made) == set(names) and made[f"{long}quokka"] == (long, "quokka") and made["#"] == ("#",)
    assert all(made[n] == whole.split(n) for n in names[:-1])


def test_a_hot_host(spark):
    """One host fills half of the table; repeated rows count each."""
    urls = ["http://www.hot.com/a/1"] * 300 + [f"http://site{k}.org/b/{k}" for k in range(150)] + ["http://casino.com/"] * 50
    pages = spark.createDataFrame([(k, u, "<p>casino site hot www</p>") for k, u in enumerate(urls)], "page_id long, url string, html string").repartition(4)
    made = url_filters.url_filter(pages, []).collect()
    assert sorted(r["page_id"] for r in made) == list(range(500))
    assert len({r["log_odds"] for r in made if "hot" in r["host"]}) == 1 and all((r["verdict"] == "block") == ("casino" in r["host"]) for r in made)
