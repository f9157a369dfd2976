"""Skill documents: their names, sections, rules and checks. Documents are rows (name, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.lineage import by_key, cut, small, spread
from tessera.functions.scalars import glob_form
from tessera.operators.evidence import holding
from tessera.operators.facts import decoded
from tessera.operators.retrieval import reachable, top

# Forms of citations and list items, what sections must have, and what names files, routes or commands.
CITATION = r"\[file:\s*[^\]\s:]+:\d+\]"
ITEM = r"(?m)^\s*(?:\d+\.|[-*])\s"
LEAST_RULES = 3
RULES = r"(?ms)^##\s+Rules[^\n]*\n(.*?)(?=^##\s|\z)"
CONCRETE = r"(?i)`[^`]*(?:\.(?:py|ts|tsx|js|jsx|rs|go|toml|ya?ml|json|md)|/[\w{}.-]+)[^`]*`|\b(?:uv run|pytest|ruff|mypy|npm|pnpm|yarn|make|docker)\b|[\w./-]+\.(?:py|ts|tsx|js|jsx|rs|go|toml|ya?ml|json|md)\b|/\w[\w/{}.-]*"


def normal_name(raw: Column) -> Column:
    """Lower-case words joined by single hyphens, 60 characters at most."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(dashed, 1, 60), F.lit("")), F.lit("untitled-skill"))


def sections(documents: DataFrame) -> DataFrame:
    """(name, place, title, content) of the second-level sections of each document."""
    parts = documents.select("name", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("body")), r"\n##[ \t]+(?=\S)")).alias("place", "part")).filter("place > 0")
    return parts.select("name", "place", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("content"))


def _items(content: Column) -> Column:
    return F.size(F.regexp_extract_all(content, F.lit(ITEM), F.lit(0)))


def problems(documents: DataFrame, required: list[str], cited: list[str], optional: list[str], procedural: list[str]) -> DataFrame:
    """(name, section, problem): title and required sections that are missing, empty or, of rules, fewer than LEAST_RULES
    with a citation each; sections that aren't asked for or come twice; and sections that must cite and don't, as do
    optional ones always and procedural ones when they name a file, a route or a command."""
    found = sections(documents)
    none = F.lit(None).cast("string")

    def among(some: list[str]) -> Column:
        return F.col("title").isin(some)

    empty, has = F.trim(F.regexp_replace("content", r"\s+", " ")) == "", F.col("content").rlike(CITATION)
    rules = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(ITEM) & x.rlike(CITATION)))
    each = F.array_compact(F.array(
        F.when(among(required + optional) & empty, "empty"), F.when((F.col("title") == "Rules") & (_items(F.col("content")) < LEAST_RULES), "few rules"), F.when((F.col("title") == "Rules") & (rules < LEAST_RULES), "few cited rules"),
        F.when(~among(required + optional), "unexpected"), F.when(among(cited) & ~empty & ~has, "needs citation"), F.when(among(optional) & ~empty & ~has, "optional needs evidence"),
        F.when(among(procedural) & ~empty & ~has & F.col("content").rlike(CONCRETE), "concrete claim needs citation")))
    by_section = found.select("name", F.col("title").alias("section"), F.explode(each).alias("problem")).distinct()
    twice = found.groupBy("name", F.col("title").alias("section")).count().filter("count > 1").select("name", "section", F.lit("duplicate").alias("problem"))
    wanted = documents.select("name", F.explode(F.array(*map(F.lit, required))).alias("title"))
    missing = wanted.join(found.select("name", "title"), ["name", "title"], "left_anti").select("name", F.col("title").alias("section"), F.lit("missing").alias("problem"))
    untitled = documents.filter(~F.col("body").rlike(r"(?m)^#\s+\S")).select("name", none.alias("section"), F.lit("no title").alias("problem"))
    return by_section.unionByName(twice).unionByName(missing).unionByName(untitled)


def without_uncited_rules(documents: DataFrame) -> DataFrame:
    """(name, body, n_dropped): list items of the rules that cite nothing are dropped."""
    block = F.regexp_extract("body", RULES, 1)
    rows = F.split(block, "\n")
    kept = F.filter(rows, lambda x: ~x.rlike(ITEM) | x.rlike(CITATION))
    n = F.when(block == "", 0).otherwise(F.size(rows) - F.size(kept))
    return documents.select("name", F.when(n > 0, F.replace(F.col("body"), block, F.array_join(kept, "\n"))).otherwise(F.col("body")).alias("body"), n.cast("long").alias("n_dropped"))


def evaluation(documents: DataFrame, found: DataFrame, evidence: DataFrame, planned: DataFrame) -> DataFrame:
    """(name, passed, quality, status) by five checks: the name's form, the sections (no problem found), a title that
    gives the name, citations that evidence (file, line) covers, and a place in the plan (name)."""
    title = normal_name(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1))
    cited = documents.select("name", F.explode(F.regexp_extract_all("body", F.lit(r"\[file:\s*([^\]\s:]+:\d+)\]"), F.lit(1))).alias("place")).distinct()
    shown = evidence.select(F.concat_ws(":", "file", "line").alias("place")).distinct()
    invented = cited.join(shown, "place", "left_anti").select("name").distinct().withColumn("invented", F.lit(True))
    rows = (
        documents.join(found.select("name").distinct().withColumn("faulty", F.lit(True)), "name", "left").join(invented, "name", "left")
        .join(planned.select("name").distinct().withColumn("planned", F.lit(True)), "name", "left")
    )
    checks = [F.col("name").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$") & (F.length("name") <= 64), F.col("faulty").isNull(), title == F.col("name"), F.col("invented").isNull(), F.col("planned").isNotNull()]
    n = sum((c.cast("int") for c in checks), F.lit(0))
    return rows.select("name", n.cast("long").alias("passed"), F.round(n / 5, 4).alias("quality"), F.when(n == 5, "passed").otherwise("failed").alias("status"))


def facts(replies: DataFrame, least: float, most: int) -> DataFrame:
    """(reply_id, place, subject, predicate, object, confidence) of the facts in replies (reply_id, text) of a model.

    Text around the list is passed over, and of a list that is cut off the whole facts count. Facts without a subject,
    predicate or object, below the least confidence or with lines in the wrong order are left out; the first `most` stay.
    """
    kept = decoded(replies).filter((F.col("confidence") >= least) & (F.col("end_line") >= F.col("start_line")))
    ordered = kept.groupBy("reply_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "subject", "predicate", "object", "confidence"))), 1, most).alias("some"))
    return ordered.select("reply_id", F.posexplode("some").alias("place", "x")).select("reply_id", (F.col("place") + 1).alias("place"), "x.subject", "x.predicate", "x.object", "x.confidence")


MARK = r"(?i)\[file:\s*[^\]]+?:\d+\]"
CLAIM = "[a-z0-9_./:-]+"


def miscited(documents: DataFrame, evidence: DataFrame, cited: list[str]) -> DataFrame:
    """(name, place, problem) of the sections among `cited` that cite nothing, and of all that cite what evidence (file, line) doesn't
    hold; without any evidence nothing can be told."""
    found = sections(documents)
    bare = found.filter(F.col("title").isin(cited) & ~F.col("content").rlike(MARK)).select("name", "place", F.lit("missing").alias("problem"))
    marks = found.select("name", "place", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)\[file:\s*([^\]]+?:\d+)\]"), F.lit(1))).alias("at"))
    shown = evidence.select(F.concat_ws(":", "file", "line").alias("at")).distinct()
    wrong = marks.join(shown, "at", "left_anti").select("name", "place").distinct().withColumn("problem", F.lit("wrong"))
    return bare.unionByName(wrong).join(F.broadcast(evidence.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_semi")


def repaired(documents: DataFrame, evidence: DataFrame, problems: DataFrame) -> DataFrame:
    """(name, body, n_repaired): documents whose sections with problems (name, place, problem) cite the evidence that fits them best.

    evidence: file, line, excerpt, score. What fits is told by how many different words of four characters or more of a
    section its file and excerpt hold, then by score, file and line. A wrong section loses its citations first. The new
    one stands at the end of the first list item, else of the first line of text, else on a line of its own.
    """
    parts = documents.select("name", F.posexplode(F.split(F.concat(F.lit("\n"), F.col("body")), r"\n(?=##[ \t]+\S)")).alias("place", "part"))
    asked = parts.join(problems.select("name", "place").distinct(), ["name", "place"], "left_semi")
    asked = asked.select(F.struct("name", "place").alias("query_id"), F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.regexp_replace("part", MARK, "")), F.lit(CLAIM), F.lit(0)), lambda t: F.length(t) >= 4))).alias("term"))
    held = evidence.select("file", "line", "score", F.concat_ws(" ", "file", "excerpt").alias("_text"))
    fits = holding(held, ["file", "line"], "_text", asked, "[a-z0-9_./:-]{3,}").select("query_id.name", "query_id.place", "file", "line", "n")
    fits = fits.join(held.select("file", "line", "score"), ["file", "line"])
    best = fits.groupBy("name", "place").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.coalesce("score", F.lit(0.0))).alias("s"), "file", "line")).alias("b"))
    least = held.agg(F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "file", "line")).alias("d"))  # one row, for sections that no evidence speaks of
    todo = problems.groupBy("name", "place").agg(F.bool_or(F.col("problem") == "wrong").alias("wrong")).join(best, ["name", "place"], "left").crossJoin(F.broadcast(least))
    todo = todo.select("name", "place", "wrong", F.concat(F.lit("[file: "), F.coalesce("b.file", "d.file"), F.lit(":"), F.coalesce("b.line", "d.line").cast("string"), F.lit("]")).alias("mark")).filter("mark is not null")
    both = parts.join(todo, ["name", "place"], "left")
    split = F.split(F.when(F.col("wrong"), F.regexp_replace("part", r"[ \t]*" + MARK, "")).otherwise(F.col("part")), "\n")
    both = both.withColumn("rows", split)

    both = both.withColumn("_item", F.try_element_at(F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("i"), (x.rlike(r"^\s*(?:[-*]|\d+[.)])") & (i > 0)).alias("ok"))), lambda x: x["ok"]), F.lit(1))["i"])
    both = both.withColumn("_text", F.try_element_at(F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("i"), (x.rlike(r"\S") & ~x.rlike(r"^\s*```") & (i > 0)).alias("ok"))), lambda x: x["ok"]), F.lit(1))["i"])
    at = F.coalesce("_item", "_text")
    marked = F.transform("rows", lambda x, i: F.when(i == F.coalesce("_item", "_text"), F.concat(F.rtrim(x), F.lit(" "), F.col("mark"))).otherwise(x))
    added = F.concat(F.filter("rows", lambda x, i: (i == 0) | (x != "")), F.array(F.concat(F.lit("- See indexed evidence "), F.col("mark"), F.lit("."))))
    new = F.when(F.col("mark").isNull(), F.col("part")).otherwise(F.array_join(F.when(at.isNotNull(), marked).otherwise(added), "\n"))
    whole = both.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", new.alias("part")))), lambda x: x["part"]), "\n").alias("body"), F.count("mark").alias("n_repaired"))
    return whole.select("name", F.expr("substring(body, 2)").alias("body"), "n_repaired")


# How much a skill counts once it had to be revised, how many records its quality shows, and prompts that no
# skill is meant for.
REVISED, SHOWN, MOST_FAILURES = 0.7, 20, 4
FEW = 100  # prompts and texts that may be paired for a word they share
UNRELATED = ("what time is it", "summarize this unrelated PDF")
WORD = "[a-z0-9]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def confidence(citations: Column, paragraphs: Column, revisions: Column) -> Column:
    """Citations a paragraph, one at most, and less for documents that were revised; 0 without paragraphs."""
    dense = F.least(F.coalesce(citations, F.lit(0)) / F.nullif(paragraphs, F.lit(0)), F.lit(1.0))
    return F.coalesce(F.when(paragraphs > 0, F.round(dense * F.when(revisions == 0, 1.0).otherwise(REVISED), 4)), F.lit(0.0))


def applicable(skills: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, name) of the skills (product, name, globs, contexts) that fit what is asked (query_id, product, file, context).

    A skill without globs fits all files, and one without contexts all contexts; where no file, or no context or `general`, is
    asked for, all fit. A file that fits a glob lies below the folders that the glob begins with, so files meet globs on their
    folders, and the form is compared after. Skills that fit the same things are one until then, and each is told once.
    """
    globs, contexts = F.coalesce("globs", F.array().cast("array<string>")), F.coalesce("contexts", F.array().cast("array<string>"))
    like = skills.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("product", globs.alias("globs"), contexts.alias("contexts")))).alias("kind"))
    like = cut(like)
    held = cut(like.select("kind").distinct().select("kind", F.explode("kind").alias("k")).select("kind", "k.product", "k.globs", "k.contexts"))
    bare, formed = held.filter(F.size("globs") == 0), held.filter(F.size("globs") > 0)
    each = formed.select("product", "kind", "contexts", F.explode("globs").alias("glob")).withColumn("folder", F.regexp_extract("glob", r"^((?:[^*?/]*/)*)", 1))
    anywhere = asked.filter("file is null").join(small(cut(formed.drop("globs"))), "product").unionByName(asked.join(small(cut(bare.drop("globs"))), "product"))
    parts = F.split("file", "/", -1)
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    placed = asked.filter("file is not null").withColumn("folder", F.explode(folders)).join(small(cut(each)), ["product", "folder"]).filter(F.rlike("file", glob_form(F.col("glob")))).drop("folder", "glob")
    fits = (F.size("contexts") == 0) | F.coalesce(F.col("context"), F.lit("")).isin("", "general") | F.array_contains("contexts", F.col("context"))
    return anywhere.unionByName(placed).filter(F.coalesce(fits, F.lit(False))).select("query_id", "kind").distinct().join(by_key(like), "kind").select("query_id", "name")


def trigger_prompts(skills: DataFrame) -> DataFrame:
    """(name, place, prompt): up to three different prompts that skills (name, description) are meant for, of their descriptions' longer words and names."""
    long = F.filter(_words(F.coalesce("description", F.lit(""))), lambda w: F.length(w) >= 4)
    called = F.replace(F.col("name"), F.lit("-"), F.lit(" "))
    first = F.when(F.size("_w") > 0, F.concat(F.lit("I need help with "), F.array_join(F.slice("_w", 1, 4), " ")))
    second = F.when(F.size("_w") >= 5, F.concat(F.lit("how do I handle "), F.array_join(F.slice("_w", 3, 4), " "))).when(F.size("_w") > 0, F.concat(F.lit("how do I use "), called))
    prompts = F.array_distinct(F.array_compact(F.array(first, second, F.concat(F.lit("explain "), called))))
    return skills.withColumn("_w", long).select("name", F.posexplode(prompts).alias("place", "prompt"))


def _firsts(prompts: DataFrame, plan: DataFrame) -> DataFrame:
    """(prompt, first): the name of the row of plan (place, name, text) that holds most different words of a prompt (prompt), then of the
    least place; a prompt that shares no word with a row has none.

    Words that at most FEW prompts and FEW rows hold make pairs of them, which are few. Of other words only which a prompt or a
    row holds is kept: prompts that hold the same ones are one, rows that do are the one of the least place, and these meet as
    `retrieval.reachable` tells. A pair counts both kinds of words; the least a row of the other way can be told is too little,
    and then it is a pair as well. So no word that many hold makes a row for each prompt and row that do.
    """
    told = cut(prompts.select("prompt").distinct().withColumn("p", F.monotonically_increasing_id()))
    words = F.array_distinct(_words(F.coalesce("text", F.lit(""))))
    held = cut(plan.groupBy(F.col("place").alias("at"), F.col("name").alias("first")).agg(F.flatten(F.collect_list(words)).alias("w")).withColumn("r", F.monotonically_increasing_id()))
    asks, has = told.select("p", F.explode(F.array_distinct(_words(F.col("prompt")))).alias("term")), held.select("r", F.explode("w").alias("term"))
    each = asks.select("term", F.lit(1).alias("a"), F.lit(0).alias("h")).unionByName(has.select("term", F.lit(0).alias("a"), F.lit(1).alias("h")))
    many = cut(each.groupBy("term").agg(F.sum("a").alias("a"), F.sum("h").alias("h")).filter((F.col("a") > FEW) | (F.col("h") > FEW)))
    others, shared = small(many.select("term")), small(many.filter("a > 0 and h > 0").select("term"))

    def kinds(of: DataFrame, key: str) -> DataFrame:
        return cut(of.join(shared, "term").groupBy(key).agg(F.array_sort(F.collect_list("term")).alias(f"{key}_kind")))

    p_kinds, r_kinds = kinds(asks, "p"), kinds(has, "r")
    like = r_kinds.join(by_key(held.select("r", "at", "first")), "r").groupBy(F.array_join("r_kind", " ").alias("kind")).agg(F.min(F.struct("at", "first")).alias("b"))
    like = cut(like)
    weights = like.select("kind", F.explode(F.split("kind", " ")).alias("term")).groupBy("kind", "term").agg(F.count("*").cast("double").alias("w"))
    wanted = p_kinds.select(F.array_join("p_kind", " ").alias("query_id")).distinct()
    met = reachable(wanted.select("query_id", F.explode(F.split("query_id", " ")).alias("term")), weights, 1, "kind")
    met = met.join(by_key(like), "kind").groupBy("query_id").agg(F.min(F.struct((-F.round("total")).cast("long").alias("less"), "b.at", "b.first")).alias("b"))
    by_kind = p_kinds.select("p", F.array_join("p_kind", " ").alias("query_id")).join(small(cut(met)), "query_id").select("p", "b")

    pairs = asks.join(others, "term", "left_anti").join(by_key(has.join(others, "term", "left_anti")), "term").groupBy("p", "r").agg(F.count("*").alias("n"))
    both = F.coalesce(F.size(F.filter("r_kind", lambda t: F.array_contains("p_kind", t))), F.lit(0))
    pairs = pairs.join(by_key(p_kinds), "p", "left").join(by_key(r_kinds), "r", "left").select("p", "r", F.when(F.col("p_kind").isNull() | F.col("r_kind").isNull(), 0).otherwise(both).alias("m"), "n")
    by_pair = pairs.join(by_key(held.select("r", "at", "first")), "r").select("p", F.struct((-(F.col("n") + F.col("m"))).cast("long").alias("less"), "at", "first").alias("b"))
    best = by_kind.unionByName(by_pair).groupBy("p").agg(F.min("b").alias("b"))
    return best.join(by_key(told), "p").select("prompt", F.col("b.first").alias("first"))


def trigger_failures(skills: DataFrame, plan: DataFrame) -> DataFrame:
    """(name, place, prompt, first, problem) of the prompts that a skill is meant for and doesn't come first on (missed), or isn't and shares
    words with (unrelated): the first MOST_FAILURES of each skill.

    plan: place, name, text, all that tells a skill; prompts rank its rows by the share of their different words that text
    holds, then by place, as `_firsts` tells; a prompt that nothing shares a word with has no first. Without a plan nothing can fail.
    """
    skills, plan = spread(skills, "name"), spread(plan, "name")
    own = trigger_prompts(skills)
    strange = skills.select("name", F.posexplode(F.array(*map(F.lit, UNRELATED))).alias("place", "prompt")).withColumn("place", F.col("place") + 3)
    missed = own.join(_firsts(own, plan), "prompt", "left").filter(~F.col("first").eqNullSafe(F.col("name"))).select("name", "place", "prompt", "first", F.lit("missed").alias("problem"))
    words = _words(F.coalesce("text", F.lit("")))
    met = plan.select("name", F.explode(F.array_compact(F.array(*(F.when(F.arrays_overlap(words, _words(F.lit(x))), F.lit(x)) for x in UNRELATED)))).alias("prompt")).distinct()
    over = strange.join(met, ["prompt", "name"], "left_semi").select("name", "place", "prompt", F.lit(None).cast("string").alias("first"), F.lit("unrelated").alias("problem"))
    every = missed.unionByName(over).join(F.broadcast(plan.limit(1).select(F.lit(1).alias("_any"))), F.lit(True), "left_semi")
    return top(every, ["name"], [F.col("place")], MOST_FAILURES, "_r").drop("_r")


def _blocks(text: Column) -> Column:
    """A text's second-level sections, with their headings, and before them what stands above the first."""
    return F.split(F.concat(F.lit("\n"), text), r"\n(?=##[ \t]+\S)")


def _heading(block: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(block, r"^##[ \t]+([^\n]*)", 1)))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(documents: DataFrame, fills: DataFrame) -> DataFrame:
    """(name, body, n_replaced, n_added): documents with what fills (name, fill) say of their sections.

    The last section of the same heading, in any case, is replaced, others are added at the end in order; of a fill's sections
    of one heading the last replaces. A title stands first where the document has none; of a fill without sections nothing else is taken then. Else such a fill is added as it
    is, an empty one changes nothing, and so does one for a document that isn't there. A document has one fill; of several
    the greatest counts.
    """
    one = fills.groupBy("name").agg(F.max("fill").alias("_fill")).filter(_trimmed(F.col("_fill")) != "")
    rows = documents.join(one, "name", "left").withColumn("_fill", _trimmed(F.col("_fill")))
    title = F.nullif(F.regexp_extract("_fill", r"(?m)^# [^\n]*", 0), F.lit(""))
    rows = rows.withColumn("_title", F.when(~F.ltrim(F.coalesce("body", F.lit(""))).startswith("# "), title))
    rows = rows.withColumn("_body", F.regexp_replace(F.when(F.col("_title").isNotNull(), F.concat(F.rtrim("_title"), F.lit("\n\n"), _trimmed(F.coalesce("body", F.lit(""))))).otherwise(F.coalesce("body", F.lit(""))), r"\s+$", ""))
    rows = rows.withColumn("_old", _blocks(F.col("_body"))).withColumn("_new", F.transform(F.slice(_blocks(F.col("_fill")), 2, F.greatest(F.size(_blocks(F.col("_fill"))), F.lit(1))), lambda b: F.regexp_replace(b, r"\s+$", "")))
    rows = rows.withColumn("_had", F.transform("_old", _heading)).withColumn("_has", F.transform("_new", _heading))

    def last_of(block: Column, place: Column) -> Column:
        """What stands for a document's block at a place: itself, or the last of the fill with its heading if it is the last of the document with it."""
        heading = _heading(block)
        later = F.array_contains(F.slice("_had", place + 2, F.size("_had")), heading)
        fitting = F.filter("_new", lambda b: _heading(b) == heading)
        return F.when((place == 0) | later | (F.size(fitting) == 0), block).otherwise(F.concat(F.element_at(fitting, -1), F.when(place + 1 < F.size("_old"), F.lit("\n")).otherwise(F.lit(""))))

    kept = F.transform("_old", last_of)
    had = F.slice("_had", 2, F.greatest(F.size("_had"), F.lit(1)))
    added = F.filter("_new", lambda b: ~F.array_contains(had, _heading(b)))
    whole = F.regexp_replace(F.expr("substring(_whole, 2)"), r"\s+$", "")
    bare = F.size("_new") == 0
    rows = rows.withColumn("_whole", F.array_join(kept, "\n")).withColumn("_added", added)
    text = F.when(bare & F.col("_title").isNotNull(), F.col("_body")).when(bare, F.concat(F.col("_body"), F.lit("\n\n"), F.col("_fill"))).otherwise(F.array_join(F.concat(F.array(whole), F.col("_added")), "\n\n"))
    n = F.size(F.array_distinct(F.array_intersect("_has", had)))
    none = F.col("_fill").isNull()
    return rows.select("name", F.when(none, F.col("body")).otherwise(F.concat(_trimmed(text), F.lit("\n"))).alias("body"), F.when(none, 0).otherwise(n).alias("n_replaced"), F.when(none, 0).otherwise(F.size("_added")).alias("n_added"))


def quality(skills: DataFrame, results: DataFrame, signals: DataFrame) -> DataFrame:
    """(product, name, latest_status, latest_at, n_results, n_failed, n_signals, regenerate) of each skill (product, name).

    The newest SHOWN results (product, name, result_id, status, at) and signals (product, name, signal_id, at) count; a failed result or any
    signal asks for the skill to be made again.
    """
    key = ["product", "name"]
    told = top(results, key, [F.desc("at"), F.desc("result_id")], SHOWN, "_r").groupBy(*key).agg(
        F.max(F.when(F.col("_r") == 1, F.col("status"))).alias("latest_status"), F.max("at").alias("latest_at"), F.count("*").alias("n_results"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    said = top(signals, key, [F.desc("at"), F.desc("signal_id")], SHOWN, "_r").groupBy(*key).agg(F.count("*").alias("n_signals"))
    rows = skills.select(*key).distinct().join(told, key, "left").join(said, key, "left")
    for name in ("n_results", "n_failed", "n_signals"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.withColumn("regenerate", (F.col("n_failed") > 0) | (F.col("n_signals") > 0)).select(*key, "latest_status", "latest_at", "n_results", "n_failed", "n_signals", "regenerate")


def runs(results: DataFrame) -> DataFrame:
    """(run_id, n, n_failed, status, summary) of results (run_id, name, result_id, status, at): of each skill the last one counts, and a run has
    failed if all have, passed if none has, and else is partial."""
    last = top(results, ["run_id", "name"], [F.desc("at"), F.desc("result_id")], 1, "_r")
    of = last.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    status = F.when(F.col("n_failed") == F.col("n"), "failed").when(F.col("n_failed") > 0, "partial").otherwise("passed")
    return of.withColumn("status", status).withColumn("summary", F.concat((F.col("n") - F.col("n_failed")).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" skill eval(s) passed.")))


def visible_runs(ran: DataFrame, products: DataFrame, allowed: DataFrame) -> DataFrame:
    """ran (run_id, at, ...) with place, newest first, without runs that have a product (run_id, product) which isn't allowed (product)."""
    barred = products.join(allowed.select("product").distinct(), "product", "left_anti").select("run_id").distinct()
    seen = ran.join(barred, "run_id", "left_anti")
    day = F.to_date("at")  # days are ranked each by itself, and start after those that are newer
    within = seen.withColumn("_day", day).withColumn("_in", F.row_number().over(Window.partitionBy("_day").orderBy(F.desc("at"), "run_id")))
    sizes = within.groupBy("_day").agg(F.count("*").alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return within.join(start, within["_day"].eqNullSafe(start["_day"])).withColumn("place", F.col("_in") + F.col("_start")).drop("_day", "_in", "_start")
