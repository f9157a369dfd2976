import random
import re

from pyspark.sql import functions as F

from tessera.operators import skills


def test_skills_that_fit_a_file_and_a_context(spark):
    held = [("p", "all", None, None), ("p", "src", ["src/**/*.py", "lib/*.py"], ["debug"]), ("p", "any", ["**/*.md"], []), ("p", "root", ["*.py"], ["plan", "debug"]), ("q", "other", [], [])]
    asked = [(1, "p", "src/a/b.py", "debug"), (2, "p", "src/b.py", "plan"), (3, "p", "a.py", "general"), (4, "p", None, None), (5, "p", "docs/x.md", ""), (6, "p", "lib/a/b.py", "debug"), (7, "p", "", "plan"), (8, None, "a.py", None)]
    got = skills.applicable(spark.createDataFrame(held, "product string, name string, globs array<string>, contexts array<string>"), spark.createDataFrame(asked, "query_id int, product string, file string, context string"))
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r["name"])
    assert found == {1: {"all", "src"}, 2: {"all"}, 3: {"all", "root"}, 4: {"all", "src", "any", "root"}, 5: {"all", "any"}, 6: {"all"}, 7: {"all"}}


def test_prompts_and_their_failures(spark):
    held = spark.createDataFrame([("swap-fees", "Explains how swap fees accrue daily there"), ("time-zones", "what time is it anywhere"), ("bare", None)], "name string, description string")
    prompts = {}
    for r in skills.trigger_prompts(held).orderBy("place").collect():
        prompts.setdefault(r["name"], []).append(r.prompt)
    assert prompts["swap-fees"] == ["I need help with explains swap fees accrue", "how do I handle fees accrue daily there", "explain swap fees"]
    assert prompts["time-zones"] == ["I need help with what time anywhere", "how do I use time zones", "explain time zones"] and prompts["bare"] == ["explain bare"]
    plan = spark.createDataFrame([(0, "swap-fees", "swap fees accrue daily explains there"), (1, "time-zones", "time zones what is it anywhere"), (2, "twin", "swap fees"), (3, "bare", None)], "place int, name string, text string")
    got = {(r["name"], r.place): (r.first, r.problem) for r in skills.trigger_failures(held, plan).collect()}
    assert got == {("time-zones", 3): (None, "unrelated"), ("bare", 0): (None, "missed")}
    assert skills.trigger_failures(held, plan.limit(0)).isEmpty()
    moved = plan.withColumn("place", -F.col("place"))
    assert ("swap-fees", 2) in {(r["name"], r.place) for r in skills.trigger_failures(held, moved).collect()}


def test_fills_replace_the_last_section_and_add_the_rest(spark):
    docs = [("a", "# T\n\n## One\nx\n\n## Two\ny\n\n## one\nz\n\n## Three\nw\n"), ("b", "text"), ("c", "# C\nx\n"), ("d", "# D\n"), ("e", None), ("f", "## Only\nq")]
    fills = [("a", "## ONE\nnew\n\n## Four\nadded\n## Five\nmore\n"), ("b", "# B\n\n## New\nn"), ("c", "loose"), ("d", "  \n"), ("e", "# E\nwords"), ("f", "## only\n1\n## Only\n2"), ("gone", "## x\ny")]
    got = {r["name"]: r for r in skills.filled(spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame(fills, "name string, fill string")).collect()}
    assert got["a"].body == "# T\n\n## One\nx\n\n## Two\ny\n\n## ONE\nnew\n\n## Three\nw\n\n## Four\nadded\n\n## Five\nmore\n" and (got["a"].n_replaced, got["a"].n_added) == (1, 2)
    assert got["b"].body == "# B\n\ntext\n\n## New\nn\n" and got["c"].body == "# C\nx\n\nloose\n" and got["d"].body == "# D\n"
    assert got["e"].body == "# E\n" and got["f"].body == "## Only\n2\n" and len(got) == 6


def test_confidence(spark):
    rows = spark.createDataFrame([(3, 2, 0), (1, 3, 0), (1, 2, 2), (1, 0, 0), (None, 2, 0)], "c int, p int, r int")
    assert [r[0] for r in rows.select(skills.confidence(F.col("c"), F.col("p"), F.col("r"))).collect()] == [1.0, 0.3333, 0.35, 0.0, 0.0]


def test_quality_counts_the_newest_and_asks_for_another_try(spark):
    results = [("p", "a", k, "failed" if k < 5 else "passed", f"2024-01-{k + 1:02d}") for k in range(25)] + [("p", "b", 1, "failed", "2024-01-01"), ("p", "b", 2, "passed", "2024-01-01")]
    held = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a")], "product string, name string")
    got = skills.quality(held, spark.createDataFrame(results, "product string, name string, result_id int, status string, at string"), spark.createDataFrame([("p", "c", 1, "2024-01-01")], "product string, name string, signal_id int, at string"))
    found = {(r.product, r["name"]): (r.latest_status, r.n_results, r.n_failed, r.n_signals, r.regenerate) for r in got.collect()}
    assert found == {("p", "a"): ("passed", 20, 0, 0, False), ("p", "b"): ("passed", 2, 1, 0, True), ("p", "c"): (None, 0, 0, 1, True), ("q", "a"): (None, 0, 0, 0, False)}


def test_runs_and_who_may_see_them(spark):
    results = [("r1", "a", 1, "failed", "2024-01-01"), ("r1", "a", 2, "passed", "2024-01-02"), ("r1", "b", 3, "failed", "2024-01-02"), ("r2", "a", 4, "failed", "2024-01-03"), ("r3", "a", 5, None, "2024-01-03")]
    ran = skills.runs(spark.createDataFrame(results, "run_id string, name string, result_id int, status string, at string"))
    assert {r.run_id: (r.status, r.summary) for r in ran.collect()} == {"r1": ("partial", "1/2 skill eval(s) passed."), "r2": ("failed", "0/1 skill eval(s) passed."), "r3": ("passed", "1/1 skill eval(s) passed.")}
    at = spark.createDataFrame([("r1", "2024-01-02"), ("r2", "2024-01-03 10:00"), ("r3", "2024-01-03 09:00"), ("r4", None)], "run_id string, at string")
    products = spark.createDataFrame([("r1", "p"), ("r2", "p"), ("r2", "secret"), ("r3", "p")], "run_id string, product string")
    seen = skills.visible_runs(at, products, spark.createDataFrame([("p",)], "product string"))
    assert [(r.place, r.run_id) for r in seen.orderBy("place").collect()] == [(1, "r3"), (2, "r1"), (3, "r4")]


def test_prompts_meet_kinds_of_rows_and_no_pair_of_a_prompt_and_a_row_is_kept(spark, monkeypatch):
    monkeypatch.setattr(skills, "FEW", 3, raising=False)
    draw, sizes, cut = random.Random(6), [], skills.cut
    vocabulary = ["alpha", "bravo", "delta", "gamma", "time", "help", "with", "omega"]
    held = [(f"s{i}", " ".join(draw.sample(vocabulary, draw.randint(1, 6))) if i % 9 else None) for i in range(90)]
    plan = [(draw.randint(-20, 20), name, f"{name if i % 4 else ''} {text or ''} {draw.choice(vocabulary)} own{i % 40}") for i, (name, text) in enumerate(held)] + [(1, "s1", "alpha alpha s1"), (1, "s1", "alpha bravo"), (None, "odd", "omega")]

    def counted(df):
        df = cut(df)
        sizes.append(df.count())
        return df

    monkeypatch.setattr(skills, "cut", counted)
    asked, told = spark.createDataFrame(held, "name string, description string"), spark.createDataFrame(plan, "place int, name string, text string")
    got = {(r["name"], r.place, r.prompt, r["first"], r.problem) for r in skills.trigger_failures(asked, told).collect()}
    prompts = skills.trigger_prompts(asked).collect()
    words, rows = (lambda text: set(re.findall("[a-z0-9]+", text.lower()))), {}
    for place, name, text in plan:
        rows.setdefault((place, name), []).extend(words(text))
    wanted, pairs = set(), 0
    for name in {name for name, _ in held}:
        faults = []
        for r in (r for r in prompts if r["name"] == name):
            scores = [(-sum(w in words(r.prompt) for w in has), place is not None, place or 0, first) for (place, first), has in rows.items() if words(r.prompt) & set(has)]
            pairs += len(scores)
            best = min(scores)[3] if scores else None
            if best != name:
                faults.append((name, r.place, r.prompt, best, "missed"))
        faults += [(name, i, x, None, "unrelated") for i, x in enumerate(skills.UNRELATED, 3) if any(words(x) & words(text) for _, n, text in plan if n == name)]
        wanted |= set(sorted(faults, key=lambda f: f[1])[:4])
    assert got == wanted and pairs > 4000 and max(sizes) < 400
