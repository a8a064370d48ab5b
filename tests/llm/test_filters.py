"""URL filter, licence notices and quality rules: defined cases, brute force, and no Python where none may be."""

import math
import re
from collections import Counter

import pytest

from rateweave.llm import licences, quality, url_filter

URLS = [
    "https://a.example.org/es/x", "https://example.org/en/100?q", "http://EXAMPLE.org/en/2#x", "http://x.com/fr/1", "http://x.com/de/1",
    "http://x.com/fr", "http://a.net/", "http://a.net", "http://notorg/", "ftp://org/a", "no scheme", "", None, "http://b.net/é?x", "http://b.net/é?x",
    "http://a.org", "http://h.net/a://b/c", "http://x.com:80/fr/1",
] + [f"http://w{k}.org/good/page{k}" for k in range(60)] + [f"http://w{k}.com/de/bad{k}" for k in range(60)] + ["http://w.net/good/page7", "http://w.net/bad/bad9"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rule_by_hand(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


def test_url_rules_and_models_by_hand(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(None, "http://n.net/a", "", "")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, text string")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    texts = {}
    for i, u in enumerate(URLS):
        host, path, best = rule_by_hand(u)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        if best:
            assert r.verdict == best.verdict
        texts[host + path] = best and best.verdict
    texts["n.net/a"] = None
    scores, held = brute_scores(texts)
    for r in got:
        assert abs(r.score - scores[r.host + r.path]) < 1e-5
    limit = brute_limit(scores, {t: texts[t] for t in held})
    for r in got:
        if r.rule is None:
            assert r.verdict == ("allow" if math.floor(r.score * 1e6 / 1e4 + 1e-9) >= limit else "block")
    assert {by_id[len(URLS) - 2].verdict, by_id[len(URLS) - 1].verdict} == {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_scores(texts):
    import hashlib

    k, held = url_filter.ORDER, [t for t in texts if hashlib.md5(t.encode()).hexdigest()[0] in url_filter.HELD_OUT]
    counts = {c: Counter() for c in ("allow", "block")}
    for t, label in texts.items():
        if label and t not in held:
            padded = url_filter.START * k + t + url_filter.END
            for i in range(k, len(padded)):
                for n in range(k + 1):
                    counts[label][padded[i - n : i + 1]] += 1

    def p(c, context, char):
        shorter = p(c, context[1:], char) if context else 1 / url_filter.ALPHABET
        followers = [n for g, n in counts[c].items() if len(g) == len(context) + 1 and g.startswith(context)]
        if not followers:
            return shorter
        return (counts[c][context + char] + len(followers) * shorter) / (sum(followers) + len(followers))

    known, out = {}, {}
    for t in texts:
        padded, total = url_filter.START * k + t + url_filter.END, 0.0
        for i in range(k, len(padded)):
            gram = padded[i - k : i + 1]
            if gram not in known:
                known[gram] = math.log(p("allow", gram[:-1], gram[-1]) / p("block", gram[:-1], gram[-1]))
            total += known[gram]
        out[t] = total / (len(t) + 1)
    return out, held


def brute_limit(scores, labels):
    bins = {"allow": [], "block": []}
    for t, label in labels.items():
        if label:
            bins[label].append(math.floor(int(scores[t] * 1e6) / 1e4))
    if not bins["allow"] or not bins["block"]:
        return 0
    tried = sorted(set(bins["allow"] + bins["block"]))

    def right(b):
        return sum(x >= b for x in bins["allow"]) * len(bins["block"]) + sum(x < b for x in bins["block"]) * len(bins["allow"])

    return min(tried, key=lambda b: (-right(b), abs(b), b))


def test_too_many_rules(spark):
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([(1, "x")], "page_id long, url string"), url_filter.RULES * 300)


def test_native_plans(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for df in (url_filter.judge(pages), licences.scan(docs)):
        assert not re.search("Python|Pandas|Arrow", plan(df))
    assert "Exchange" not in plan(licences.scan(docs))


def test_licences(spark):
    texts = [
        "Intro line\nReleased under the MIT License.\nmore text here", "RELEASED under the, mit license", "released under the", None, "", "licensed",
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.\n" * 2, "This text is not under any licence at all.",
        licences.TEMPLATES[2][1], "x " * 30000 + "released under the mit license", "Permission is\nhereby granted, free of charge, to any person",
    ]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[0], "", ""), (0, texts[0], "", "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string, own string, line_no string")).collect()
    wanted = Counter()
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        for no, unit in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
            own = set(licences.template_bigrams(unit))
            for k, (name, body) in enumerate(licences.TEMPLATES):
                other = set(licences.template_bigrams(body))
                dice = 2 * len(own & other) / (len(own) + len(other))
                if dice >= licences.THRESHOLD_PERCENT / 100 - 1e-12:
                    wanted[i, no, name, k, round(dice, 9)] += 1
    assert Counter((r.doc_id, r.line_no, r.licence, r.template, round(r.dice, 9)) for r in got) == wanted
    assert {(0, 1), (1, 0), (6, 0), (7, 0), (7, -1), (9, 0)} <= {(r.doc_id, r.line_no) for r in got}
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def prose_line(k):
    return " ".join(f"word{k}{c}" for c in "abcdefghijklm") + f", and so ends{k} line {k}."


def test_quality_lines_and_documents(spark):
    prose = [prose_line(k) for k in range(8)]
    bad = ["home | about | contact | help | more", "Click here to read more", "Buy$$$ it%%% now*** cheap### good&&& stuff", "spam spam spam spam spam spam spam",
           "WOW!! BUY!! NOW!! OR!! NEVER!!", prose[0]]
    texts = {
        1: "\n".join(prose), 2: "\n".join(prose + bad), 3: "\n".join(prose[:2] + bad), 4: "\n".join([f"home{k} | about{k} | contact{k} | help{k} | more{k}" for k in range(30)] + prose[:1]),
        5: None, 6: "", 7: " \n\t\n", 8: "a b c " * 100, 9: "word\u00a0joined " * 3, 10: "\n".join(prose) * 40, 11: "x" * 100_000,
    }
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()] + [(1, texts[1], "twice"), (None, texts[1], "")], "doc_id long, text string, kept string")
    got = quality.clean(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        three = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) for j in range(3) if three[tuple(w[k : k + 3])] > 1}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].kept and by_id[1].clean_text == texts[1]
    assert by_id[2].kept and by_id[2].clean_text == "\n".join(prose)
    assert not by_id[4].base_failed and not by_id[4].kept
    assert not any(by_id[i].kept for i in (5, 6, 7, 8))
    assert quality.clean(docs.limit(0)).count() == 0


@pytest.mark.parametrize("line, found", [
    ("The design in this paper stands.", None), ("The catalog in this paper stands.", None), ("It spread more, and back to topics.", None),
    ("Please log in here.", "boilerplate"), ("LOG IN", "boilerplate"), ("Read more!", "boilerplate"),
])
def test_stock_phrases_are_whole_words(line, found):
    assert (quality.STOCK.search(line) is not None) == (found is not None)
    kept = quality.judge("\n".join([line, *(f"A sentence number {k} with enough words of its own to stay." for k in range(12))]), quality.Rules())[0]
    assert (line in kept) == (found is None)
