"""Licence notices that no single line and no whole document shows: wrapped, within longer lines, and whole licence files."""

import random
import re
import textwrap
from collections import Counter

from rateweave.llm import catalog, licence_texts, licences

CODE = "\n".join(f"int value{k} = compute{k}(input{k}, {k}); // step number {k}" for k in range(40))
PROSE = " ".join(f"word{k}" for k in range(35))
FULL = dict(licences.FULL_TEXTS)


def wrapped(text, width=70, prefix=" * "):
    return "\n".join(prefix + line for line in textwrap.wrap(text, width))


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def by_hand(text):
    """(line, template, dice) of the passages of a document."""
    every = licences.TEMPLATES + licences.FULL_TEXTS
    words = re.findall("[a-z0-9]+", text.lower())
    lines = text.split("\n")
    line_of = [k for k, line in enumerate(lines) for _ in re.findall("[a-z0-9]+", line.lower())]
    sets = [set(licences.template_bigrams(body)) for _, body in every]
    limit, out = licences.THRESHOLD_PERCENT / 100 - 1e-12, []
    for no, (name, body) in enumerate(every):
        long, runs = len(re.findall("[a-z0-9]+", body.lower())), []
        for at in range(len(words) - 1):
            run = words[at : at + long]
            own = {f"{a} {b}" for a, b in zip(run, run[1:])}
            if f"{run[0]} {run[1]}" in sets[no] and dice(own, sets[no]) >= limit:
                runs.append((-dice(own, sets[no]), at))
        taken = []
        for lack, at in sorted(runs):
            if all(abs(at - k) >= long for _, k in taken):
                taken.append((lack, at))
        for lack, at in taken:
            first, last = line_of[at], line_of[min(at + long, len(words)) - 1]
            units = [set(licences.template_bigrams(line)) for line in lines[first : last + 1]]
            near = [k for k, (n, _) in enumerate(licences.TEMPLATES) if k == no or (first == last and n == name)]
            known = any(u and dice(u, sets[k]) >= limit for u in units for k in near)
            if not known and not (no < len(licences.TEMPLATES) and dice(set(licences.template_bigrams(text)), sets[no]) >= limit):
                out.append((first, no, round(-lack, 9)))
    return out


def texts():
    notices, random_state = licences.TEMPLATES, random.Random(3)
    yield wrapped(notices[6][1]) + "\n" + CODE
    yield f"{PROSE} {notices[0][1]} {PROSE}"
    yield "Copyright (c) 2020 A. Author\n\n" + textwrap.fill(FULL["MIT"], 78)
    for name, body in licences.FULL_TEXTS:
        yield f"Copyright 1999 {name}\n" + wrapped(body, 60, "# ") + "\n" + CODE
    yield "\n".join([PROSE, notices[0][1], PROSE])
    yield (PROSE + " " + notices[10][1] + " ") * 3 + "\n" + notices[10][1] + "\n\n" + notices[3][1]
    yield f"{PROSE} released under the mit"
    yield " ".join([notices[5][1]] * 5) + "\n" + PROSE
    yield PROSE + " " + FULL["ISC"][: len(FULL["ISC"]) // 2]
    yield from ("", "\n\n", "licensed", "é\nunder the\n\nMIT\tlicense")
    vocabulary = " ".join(body for _, body in notices).split()
    for _ in range(20):
        words = [random_state.choice(vocabulary) for _ in range(60)] + random_state.choice(notices)[1].split()
        yield "".join(w + random_state.choice("    \n") for w in words + words[:10] + words[50:75])


def test_passages_by_hand(spark):
    rows = [(k, text, "clash") for k, text in enumerate(texts())]
    docs = spark.createDataFrame(rows + [(None, rows[1][1], ""), (1, rows[1][1], ""), (1000, None, "")], "doc_id long, text string, words string")
    got = Counter((r.doc_id, r.line_no, r.template, round(r.dice, 9)) for r in licences.passages(docs).collect())
    wanted = Counter((k, *found) for k, text, _ in rows for found in by_hand(text))
    wanted.update((k, *found) for k in (None, 1) for found in by_hand(rows[1][1]))
    assert got == wanted
    assert licences.passages(docs.limit(0)).count() == 0


def test_the_query_finds_wrapped_embedded_and_whole_notices(spark, tmp_path):
    rows = list(enumerate(texts()))[: 3 + len(licences.FULL_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.licence) for r in catalog.op8_licences(spark, str(tmp_path)).collect()}
    wanted = ["GPL-3.0", "MIT", "MIT", *(name for name, _ in licences.FULL_TEXTS)]
    assert set(enumerate(wanted)) <= found


def test_notices_that_lines_show_are_not_given_twice(spark):
    docs = spark.createDataFrame([(k, f"{PROSE}\n{body}\n{PROSE}") for k, (_, body) in enumerate(licences.TEMPLATES)], "doc_id long, text string")
    assert licences.passages(docs, full=()).count() == 0
    plan = licences.notices(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_any_part_of_a_long_licence_file_is_found(spark):
    for name in licence_texts.LONG_TEXTS:
        sections = [body for n, body in licences.SECTIONS if n == name]
        assert re.sub(r"\s", "", "".join(sections)) == re.sub(r"\s", "", licence_texts.long_text(name))
    rows = [(k, f"{CODE}\n{body}\n{CODE}") for k, (_, body) in enumerate(licences.SECTIONS)]
    found = {(r.doc_id, r.licence) for r in licences.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, name) for k, (name, _) in enumerate(licences.SECTIONS)} <= found


def test_many_notices_in_one_long_document(spark):
    """As many copies as there are, each found once and in its line; a file of nothing but notices stays feasible."""
    own = textwrap.fill(FULL["MIT"], 78) + "\n\n"
    step = own.count("\n")
    docs = spark.createDataFrame([(1, own * 150)], "doc_id long, text string")
    by_template = {}
    for r in licences.passages(docs).where("licence = 'MIT'").collect():
        by_template.setdefault(r.template, []).append((r.line_no, r.dice))
    whole = len(licences.TEMPLATES) + [name for name, _ in licences.FULL_TEXTS].index("MIT")
    assert sorted(by_template[whole]) == [(k * step, 1.0) for k in range(150)]
