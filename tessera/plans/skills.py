"""Skill documents and replies made of the driver's tables: their checks, rules and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import facts, graph, skills, tickets
from tessera.plans.tables import table

REQUIRED, CITED, OPTIONAL, PROCEDURAL = ["Use This Skill When", "Rules", "Steps"], ["Rules"], ["Testing Strategy"], ["Steps"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill for each supplier; by its key some lack a title, a section, citations or a place, or have one twice."""
    k = F.col("s_suppkey")

    def when(divisor: int, a: str, b: str = "") -> F.Column:
        return F.when(k % divisor == 0, a).otherwise(b)

    cite = F.concat(F.lit(" [file: src/a"), (k % 9).cast("string"), F.lit(".py:"), (k % 4 + 1).cast("string"), F.lit("]"))
    rules = F.concat(F.lit("## Rules\n1. First"), cite, F.lit("\n2. Second"), cite, F.lit("\n3. Third"), F.when(k % 5 == 0, "").otherwise(cite), F.lit("\n"))
    body = F.concat(
        when(7, "", "# "), F.lit("Skill "), k.cast("string"), F.lit("\n"), when(6, "", "## Use This Skill When\n- always\n"), rules, F.lit("## Steps\n"), when(4, "Run pytest.\n", "Think.\n"),
        when(10, "## Steps\nAgain.\n"), when(9, "## Extra\nMore.\n"), when(8, "## Testing Strategy\nSome.\n"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("skill-"), k).alias("name"), body.alias("body"))


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.problems(_documents(spark, sf_dir), REQUIRED, CITED, OPTIONAL, PROCEDURAL)


def skill_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _problems(spark, sf_dir)


def skill_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = skills.without_uncited_rules(_documents(spark, sf_dir))
    return found.select("name", "n_dropped", F.length("body").alias("n_chars"))


def skill_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    evidence = supplier.filter("s_suppkey % 9 <> 3").select(F.concat(F.lit("src/a"), F.col("s_suppkey") % 9, F.lit(".py")).alias("file"), (F.col("s_suppkey") % 4 + 1).alias("line"))
    planned = supplier.filter("s_suppkey % 11 <> 0").select(F.concat(F.lit("skill-"), "s_suppkey").alias("name"))
    return skills.evaluation(_documents(spark, sf_dir), _problems(spark, sf_dir), evidence, planned)


def skill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", skills.normal_name(F.concat_ws("__", "p_name", "p_type")).alias("name"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply for each order: its lines as facts, fenced, and for every third order cut off within the last."""
    items = table(spark, sf_dir, "lineitem")
    fact = F.to_json(F.struct(
        F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.lit("SUPPLIED_BY").alias("predicate"), F.concat(F.lit("supplier:"), "l_suppkey").alias("object"),
        (F.col("l_linenumber") / 8).alias("confidence"), F.lit(3).alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line")))
    told = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", fact.alias("j")))), lambda x: x["j"]), ", ").alias("facts"))
    whole = F.concat(F.lit('```json\n{"facts": ['), "facts", F.lit("]}\n```"))
    return told.select(F.col("l_orderkey").alias("reply_id"), F.when(F.col("l_orderkey") % 3 == 0, F.expr('substring(concat(\'{"facts": [\', facts), 1, length(facts) + 5)')).otherwise(whole).alias("text"))


def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.facts(_replies(spark, sf_dir), 0.3, 3)


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts and suppliers of returned lines, made distinct as numbers and dealt before."""
    return table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").repartition("l_partkey", "l_suppkey").distinct()


def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of parts and suppliers that orders returned name already, and facts say again: how sure each edge is."""
    known = _returned(spark, sf_dir).select(
        F.lit("SUPPLIED_BY").alias("edge_type"), F.concat(F.lit("part:"), "l_partkey").alias("from_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to_id"), F.lit(0.5).alias("confidence"))
    found = parsed_facts(spark, sf_dir).select(F.col("predicate").alias("edge_type"), F.col("subject").alias("from_id"), F.col("object").alias("to_id"), "confidence")
    return graph.merge_facts(known, found)


def resolved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies' facts among parts and suppliers: parts of even keys and all suppliers are known, other parts become nodes of their order."""
    even = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("node_id"))
    nodes = even.unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("node_id"))).select("node_id", F.array(F.upper("node_id")).alias("names"), F.lit(None).cast("string").alias("uri"))
    told = facts.valid(facts.decoded(_replies(spark, sf_dir)).withColumn("predicate", F.lit("depends_on")), 0.3, 3).withColumn("uri", F.concat(F.lit("order/"), "reply_id"))
    ends = facts.resolved(told, nodes, "shop")
    known = _returned(spark, sf_dir).select(
        F.lit("DEPENDS_ON").alias("edge_type"), F.concat(F.lit("part:"), "l_partkey").alias("from_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("to_id"), F.lit(0.5).alias("confidence"), F.lit("known").alias("anchor"))
    return facts.merge(known, told, ends).drop("evidence")


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for each customer below that of half its key, and for each supplier, in pairs that are each other's parents."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    meta = F.to_json(F.struct(F.struct(
        F.concat(F.lit("CUS-"), c).alias("key"), F.when(c == 0, "Epic").otherwise("Task").alias("issue_type"), F.col("c_name").alias("summary"), F.when(c > 0, F.concat(F.lit("CUS-"), F.floor(c / 2))).alias("parent"),
        F.concat(F.lit("Nation "), "c_nationkey").alias("assignee"), F.col("c_mktsegment").alias("labels"), F.array(F.concat(F.lit("SUP-"), c % 10), F.concat(F.lit("CUS-"), c)).alias("linked_keys"), F.struct(F.lit(1).alias("deep")).alias("extra")).alias("jira")))
    own = F.to_json(F.struct(F.struct(F.concat(F.lit("SUP-"), s).alias("key"), F.concat(F.lit("SUP-"), s.bitwiseXOR(F.lit(1))).alias("parent")).alias("jira")))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("jira:shop:CUS-"), c).alias("uri"), F.concat(meta, F.lit("\n# Ticket {"), c, F.lit("\n")).alias("content")).unionByName(
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("jira:shop:SUP-"), s).alias("uri"), F.concat(F.lit("Seen.\n"), own).alias("content")))


def ticket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.edges(tickets.tickets(_tickets(spark, sf_dir)), "p").select("edge_type", "from_id", "to_id", "relationship", "uri")


def ticket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.rolled_up(tickets.tickets(_tickets(spark, sf_dir)))


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents of suppliers whose rules cite nothing (every third), what isn't there, or what is, and evidence for nations."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    mark = F.when(k % 3 == 1, " [file: src/none.py:7]").when(k % 3 == 2, " [file: src/n0.py:1]").otherwise("")
    body = F.concat(F.lit("# Doc "), k, F.lit("\n## Rules\nFirst the "), F.lit("nation"), n, F.lit(" ledger.\n- Keep nation"), n, F.lit(" apart."), mark, F.lit("\n## Notes\nplain\n"))
    documents = table(spark, sf_dir, "supplier").select(F.concat(F.lit("doc-"), k).alias("name"), body.alias("body"))
    nation = table(spark, sf_dir, "nation")
    evidence = nation.select(F.concat(F.lit("src/n"), "n_nationkey", F.lit(".py")).alias("file"), F.lit(1).alias("line"), F.concat(F.lit("def of_nation"), "n_nationkey", F.lit("x(): ledger")).alias("excerpt"), (F.col("n_nationkey") / 100).alias("score"))
    return documents, evidence


def repaired_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, evidence = _claims(spark, sf_dir)
    return skills.repaired(documents, evidence, skills.miscited(documents, evidence, ["Rules"]))


def skill_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as skills of their nation's product, for files and contexts that customers of the nation ask about."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    globs = F.when(k % 4 == 1, F.array(F.lit("src/b1/*.py"), F.lit("docs/**"))).when(k % 4 == 2, F.array(F.lit("**/*1.py"))).when(k % 4 == 3, F.array(F.lit("src/**/part?5*.py"))).otherwise(F.array().cast("array<string>"))
    contexts = F.when(k % 3 == 1, F.array(F.lit("debug"))).when(k % 3 == 2, F.array(F.lit("plan"), F.lit("debug")))
    held = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("product"), k.alias("name"), globs.alias("globs"), contexts.alias("contexts"))
    file = F.when(c % 7 > 0, F.concat(F.when(c % 11 == 0, "docs/x").otherwise(F.concat(F.lit("src/b"), c % 10)), F.lit("/part"), c, F.lit(".py")))
    context = F.when(c % 4 == 1, "general").when(c % 4 == 2, "debug").when(c % 4 == 3, "plan")
    asked = table(spark, sf_dir, "customer").select(c.alias("query_id"), F.col("c_nationkey").alias("product"), file.alias("file"), context.alias("context"))
    return skills.applicable(held, asked)


def skill_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills that their names describe, in a plan that names and types tell."""
    part = table(spark, sf_dir, "part").withColumn("name", F.concat(F.lit("p"), "p_partkey"))
    plan = part.select(F.col("p_partkey").alias("place"), "name", F.concat_ws(" ", "name", "p_name", "p_type").alias("text"))
    return skills.trigger_failures(part.select("name", F.col("p_name").alias("description")), plan)


def skill_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    fill = F.when(k % 3 == 0, F.concat(F.lit("## notes\nnew "), k, F.lit("\n\n## Extra\nmore\n"))).when(k % 3 == 1, F.concat(F.lit("just text "), k)).otherwise(" ")
    return skills.filled(_claims(spark, sf_dir)[0], table(spark, sf_dir, "supplier").select(F.concat(F.lit("doc-"), k).alias("name"), fill.alias("fill")))


def skill_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as results of their supplier, failed if returned, and those of one discount as signals."""
    supplier, items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("product"), F.col("s_suppkey").alias("name")), table(spark, sf_dir, "lineitem")
    at, mark = F.col("l_shipdate").cast("date").cast("string").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    held = items.join(supplier, F.col("l_suppkey") == F.col("name"))
    results = held.select("product", "name", mark.alias("result_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed").alias("status"), at)
    return skills.quality(supplier, results, held.filter("l_linenumber = 7 and l_quantity > 45").select("product", "name", mark.alias("signal_id"), at))


def eval_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs over suppliers, those that have only allowed suppliers, newest first."""
    items = table(spark, sf_dir, "lineitem")
    results = items.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("name"), F.col("l_linenumber").alias("result_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed").alias("status"), F.col("l_shipdate").cast("date").cast("string").alias("at"))
    ran = skills.runs(results).join(results.groupBy("run_id").agg(F.max("at").alias("at")), "run_id")
    return skills.visible_runs(ran, results.select("run_id", F.col("name").alias("product")), table(spark, sf_dir, "supplier").filter("s_suppkey % 20 <> 1").select(F.col("s_suppkey").alias("product")))


QUERIES = {f.__name__: f for f in (skill_applicable, skill_triggers, skill_fills, skill_quality, eval_runs, resolved_facts, ticket_edges, ticket_rollup, repaired_citations, skill_problems, skill_rules, skill_evaluation, skill_names, parsed_facts, merged_facts)}

_PROBLEMS = """problems AS (SELECT 'skill-' || k AS name, section, problem FROM (SELECT s_suppkey AS k FROM supplier) s CROSS JOIN (VALUES
 (NULL, 'no title'), ('Use This Skill When', 'missing'), ('Rules', 'few cited rules'), ('Steps', 'concrete claim needs citation'), ('Steps', 'duplicate'), ('Extra', 'unexpected'), ('Testing Strategy', 'optional needs evidence')) p(section, problem)
 WHERE CASE problem WHEN 'no title' THEN k % 7 = 0 WHEN 'missing' THEN k % 6 = 0 WHEN 'few cited rules' THEN k % 5 = 0 WHEN 'concrete claim needs citation' THEN k % 4 = 0
   WHEN 'duplicate' THEN k % 10 = 0 WHEN 'unexpected' THEN k % 9 = 0 ELSE k % 8 = 0 END)"""
_CITE = "length(' [file: src/a' || (k % 9) || '.py:' || (k % 4 + 1) || ']')"
_FACTS = """facts AS (SELECT l_orderkey AS reply_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY back DESC) AS INTEGER) AS place, 'part:' || l_partkey AS subject, 'SUPPLIED_BY' AS predicate, 'supplier:' || l_suppkey AS object, l_linenumber / 8.0::DOUBLE AS confidence
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, 'part:' || l_partkey || '"' DESC, 'supplier:' || l_suppkey || '"' DESC) AS back FROM lineitem)
 WHERE l_linenumber / 8.0 >= 0.3 AND l_linenumber + 1 >= 3 AND (l_orderkey % 3 <> 0 OR back > 1)),
 parsed AS (SELECT * FROM facts WHERE place <= 3)"""
ORACLE_SQL = {
    "skill_problems": f"WITH {_PROBLEMS} SELECT * FROM problems",
    "skill_rules": f"""SELECT 'skill-' || k AS name, CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_dropped, CAST(
      CASE WHEN k % 7 = 0 THEN 0 ELSE 2 END + length('Skill ' || k) + 1 + CASE WHEN k % 6 = 0 THEN 0 ELSE 32 END + length('## Rules') + 1 + 2 * {_CITE} + length('1. First') + 1 + length('2. Second') + 1
      + CASE WHEN k % 5 = 0 THEN 0 ELSE length('3. Third') + 1 + {_CITE} END + 9 + CASE WHEN k % 4 = 0 THEN 12 ELSE 7 END + CASE WHEN k % 10 = 0 THEN 16 ELSE 0 END + CASE WHEN k % 9 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 8 = 0 THEN 26 ELSE 0 END AS INTEGER) AS n_chars
      FROM (SELECT s_suppkey AS k FROM supplier)""",
    "skill_evaluation": f"""WITH {_PROBLEMS}, rated AS (SELECT 'skill-' || k AS name, 1 + CASE WHEN 'skill-' || k IN (SELECT name FROM problems) THEN 0 ELSE 1 END + CASE WHEN k % 7 = 0 THEN 0 ELSE 1 END
        + CASE WHEN EXISTS (SELECT 1 FROM supplier e WHERE e.s_suppkey % 9 <> 3 AND e.s_suppkey % 9 = k % 9 AND e.s_suppkey % 4 = k % 4) THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END AS passed FROM (SELECT s_suppkey AS k FROM supplier))
      SELECT name, CAST(passed AS BIGINT) AS passed, round(passed / 5.0::DOUBLE, 4) AS quality, CASE WHEN passed = 5 THEN 'passed' ELSE 'failed' END AS status FROM rated""",
    "skill_names": r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim(concat_ws('__', p_name, p_type))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS name FROM part",
    "parsed_facts": f"WITH {_FACTS} SELECT * FROM parsed",
    "merged_facts": f"""WITH {_FACTS}, both_ AS (SELECT DISTINCT 'SUPPLIED_BY' AS edge_type, 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id, 0.5::DOUBLE AS confidence, 0 AS o FROM lineitem WHERE l_returnflag = 'R'
      UNION ALL SELECT predicate, subject, object, confidence, 1 FROM parsed) SELECT edge_type, from_id, to_id, max(confidence) AS confidence, count(*) AS n_sources FROM both_ GROUP BY ALL""",
    "resolved_facts": f"""WITH {_FACTS}, told AS (SELECT 'DEPENDS_ON' AS edge_type, CASE WHEN CAST(split_part(subject, ':', 2) AS BIGINT) % 2 = 0 AND CAST(split_part(subject, ':', 2) AS BIGINT) IN (SELECT p_partkey FROM part) THEN subject ELSE 'function:shop:order/' || reply_id || ':' || subject END AS from_id,
      CASE WHEN CAST(split_part(object, ':', 2) AS BIGINT) IN (SELECT s_suppkey FROM supplier) THEN object ELSE 'function:shop:order/' || reply_id || ':' || object END AS to_id, confidence, 'order/' || reply_id || ':3' AS anchor FROM parsed),
      known AS (SELECT DISTINCT 'DEPENDS_ON', 'part:' || l_partkey, 'supplier:' || l_suppkey, 0.5::DOUBLE, 'known' FROM lineitem WHERE l_returnflag = 'R')
      SELECT edge_type, from_id, to_id, max(confidence) AS confidence, count(DISTINCT anchor) AS n_sources, array_to_string(list_sort(list_distinct(list(anchor))), ',') AS anchors FROM (SELECT * FROM told UNION ALL SELECT * FROM known) GROUP BY ALL""",
    "ticket_edges": """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'jira:p:shop:CUS-' || c_custkey AS id, 'jira:shop:CUS-' || c_custkey AS uri FROM customer)
      SELECT 'PART_OF_FLOW' AS edge_type, id AS from_id, 'jira:p:shop:CUS-' || (k // 2) AS to_id, 'parent' AS relationship, uri FROM c WHERE k > 0 UNION ALL SELECT 'ASSIGNED_TO', id, 'actor:p:nation ' || n, 'assignee', uri FROM c
      UNION ALL SELECT 'RELATED_TO', id, 'jira:p:shop:SUP-' || (k % 10), 'mentions', uri FROM c UNION ALL SELECT 'PART_OF_FLOW', 'jira:p:shop:SUP-' || s_suppkey, 'jira:p:shop:SUP-' || xor(s_suppkey, 1), 'parent', 'jira:shop:SUP-' || s_suppkey FROM supplier""",
    "ticket_rollup": """SELECT 'shop' AS site, 'CUS-' || c_custkey AS key, 'CUS-0' AS root, CASE WHEN c_custkey = 0 THEN 0 ELSE CAST(floor(log2(c_custkey)) AS BIGINT) + 1 END AS depth, false AS in_cycle FROM customer
      UNION ALL SELECT 'shop', 'SUP-' || s_suppkey, least('SUP-' || s_suppkey, 'SUP-' || xor(s_suppkey, 1)), NULL, true FROM supplier""",
    "repaired_citations": """SELECT 'doc-' || k AS name, '# Doc ' || k || chr(10) || '## Rules' || chr(10) || 'First the nation' || n || ' ledger.' || chr(10) || '- Keep nation' || n || ' apart.' || CASE WHEN k % 3 = 2 THEN ' [file: src/n0.py:1]' ELSE ' [file: src/n' || best || '.py:1]' END
      || chr(10) || '## Notes' || chr(10) || 'plain' || chr(10) AS body, CAST(CASE WHEN k % 3 = 2 THEN 0 ELSE 1 END AS BIGINT) AS n_repaired FROM (SELECT s_suppkey AS k, s_nationkey AS n, (SELECT max(n_nationkey) FROM nation WHERE contains('nation' || n_nationkey, 'nation' || s_nationkey)) AS best FROM supplier)""",
    "skill_applicable": """WITH s AS (SELECT s_nationkey AS product, s_suppkey AS k, CASE s_suppkey % 4 WHEN 1 THEN '^(src/b1/[^/]*[.]py|docs/.*)$' WHEN 2 THEN '^(.*/)?[^/]*1[.]py$' WHEN 3 THEN '^src/(.*/)?part[^/]5[^/]*[.]py$' END AS form FROM supplier),
      a AS (SELECT c_custkey AS c, c_nationkey AS product, CASE WHEN c_custkey % 7 > 0 THEN CASE WHEN c_custkey % 11 = 0 THEN 'docs/x' ELSE 'src/b' || (c_custkey % 10) END || '/part' || c_custkey || '.py' END AS file FROM customer)
      SELECT c AS query_id, k AS name FROM s JOIN a USING (product) WHERE (form IS NULL OR file IS NULL OR regexp_matches(file, form)) AND (k % 3 = 0 OR c % 4 < 2 OR c % 4 = 2 OR k % 3 = 2)""",
    "skill_triggers": f"""WITH p AS (SELECT p_partkey AS k, 'p' || p_partkey AS name, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: length(w) >= 4) AS w, list_distinct(regexp_extract_all(lower(concat_ws(' ', 'p' || p_partkey, p_name, p_type)), '[a-z0-9]+')) AS held FROM part),
      posed AS (SELECT name, list_filter([CASE WHEN len(w) > 0 THEN 'I need help with ' || array_to_string(w[1:4], ' ') END, CASE WHEN len(w) >= 5 THEN 'how do I handle ' || array_to_string(w[3:6], ' ') WHEN len(w) > 0 THEN 'how do I use ' || name END, 'explain ' || name], lambda x: x IS NOT NULL) AS l FROM p),
      own AS MATERIALIZED (SELECT name, unnest(l) AS prompt, CAST(unnest(range(0, len(l))) AS INTEGER) AS place FROM posed),
      strange AS (SELECT name, unnest({list(skills.UNRELATED)}) AS prompt, unnest([3, 4]) AS place FROM p),
      terms AS (SELECT prompt, len(w) AS n, unnest(w) AS term FROM (SELECT prompt, list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9]+')) AS w FROM (SELECT prompt FROM own UNION SELECT prompt FROM strange))),
      words AS (SELECT k, name, unnest(held) AS term FROM p), scored AS MATERIALIZED (SELECT prompt, k, name, count(*) / n::DOUBLE AS score FROM terms JOIN words USING (term) GROUP BY prompt, n, k, name),
      best AS (SELECT prompt, arg_min(name, {{'s': -score, 'k': k}}) AS first FROM scored GROUP BY prompt),
      faults AS (SELECT name, place, prompt, first, 'missed' AS problem FROM own LEFT JOIN best USING (prompt) WHERE first IS DISTINCT FROM name UNION ALL SELECT name, place, prompt, NULL, 'unrelated' FROM strange JOIN (SELECT DISTINCT prompt, name FROM scored) USING (prompt, name))
      SELECT name, CAST(place AS INTEGER) AS place, prompt, first, problem FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place) AS r FROM faults) WHERE r <= 4""",
    "skill_fills": """SELECT 'doc-' || k AS name, '# Doc ' || k || chr(10) || '## Rules' || chr(10) || 'First the nation' || n || ' ledger.' || chr(10) || '- Keep nation' || n || ' apart.' || CASE k % 3 WHEN 1 THEN ' [file: src/none.py:7]' WHEN 2 THEN ' [file: src/n0.py:1]' ELSE '' END || chr(10)
      || CASE k % 3 WHEN 0 THEN '## notes' || chr(10) || 'new ' || k || chr(10) || chr(10) || '## Extra' || chr(10) || 'more' WHEN 1 THEN '## Notes' || chr(10) || 'plain' || chr(10) || chr(10) || 'just text ' || k ELSE '## Notes' || chr(10) || 'plain' END || chr(10) AS body,
      CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_replaced, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n_added FROM (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)""",
    "skill_quality": """WITH r AS (SELECT l_suppkey AS name, l_returnflag = 'R' AS failed, CAST(l_shipdate::DATE AS VARCHAR) AS at_, l_orderkey * 10 + l_linenumber AS mark, l_linenumber = 7 AND l_quantity > 45 AS told FROM lineitem),
      last_ AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY at_ DESC, mark DESC) AS i FROM r), of AS (SELECT name, max(CASE WHEN i = 1 THEN CASE WHEN failed THEN 'failed' ELSE 'passed' END END) AS s, max(at_) AS a, count(*) AS n, count(*) FILTER (WHERE failed) AS f FROM last_ WHERE i <= 20 GROUP BY name),
      g AS (SELECT name, least(count(*), 20) AS n FROM r WHERE told GROUP BY name)
      SELECT s_nationkey AS product, s_suppkey AS name, s AS latest_status, a AS latest_at, coalesce(of.n, 0) AS n_results, coalesce(f, 0) AS n_failed, coalesce(g.n, 0) AS n_signals, coalesce(f, 0) > 0 OR coalesce(g.n, 0) > 0 AS regenerate FROM supplier LEFT JOIN of ON of.name = s_suppkey LEFT JOIN g ON g.name = s_suppkey""",
    "eval_runs": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate::DATE DESC, l_linenumber DESC) AS i FROM lineitem),
      r AS (SELECT l_orderkey AS run_id, count(*) FILTER (WHERE i = 1) AS n, count(*) FILTER (WHERE i = 1 AND l_returnflag = 'R') AS n_failed, CAST(max(l_shipdate::DATE) AS VARCHAR) AS at_, bool_or(l_suppkey % 20 = 1) AS barred FROM l GROUP BY l_orderkey)
      SELECT run_id, n, n_failed, CASE WHEN n_failed = n THEN 'failed' WHEN n_failed > 0 THEN 'partial' ELSE 'passed' END AS status, (n - n_failed) || '/' || n || ' skill eval(s) passed.' AS summary, at_ AS "at", row_number() OVER (ORDER BY at_ DESC, run_id) AS place FROM r WHERE NOT barred""",
}
