"""Rules, combined outcomes, discards, answers and checks of integrity over order lines as cells of an evaluation.

An order line is a cell (bid: the order, requirement: the line number); its facts follow from the line's numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import latest as L
from ..operators import rules as R
from .registry import Tables, query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: The facts of a cell, as SQL that both engines read.
FACTS = {
    "outcome": "CASE l_partkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'undetermined' ELSE 'missing' END",
    "doubt": "CASE WHEN l_partkey % 4 <> 2 THEN '' WHEN l_suppkey % 6 = 0 THEN 'doubt' WHEN l_suppkey % 6 = 1 THEN 'no_data' WHEN l_suppkey % 6 = 2 THEN 'external' WHEN l_suppkey % 6 = 3 THEN 'contradiction' ELSE '' END",
    "category": "CASE l_linenumber % 4 WHEN 0 THEN 'technical' WHEN 1 THEN 'formal' ELSE 'economic' END",
    "complete": "l_returnflag <> 'R'",
    "cited": "l_linestatus = 'F' AND l_partkey % 3 = 0",
    "option": "CASE WHEN l_partkey % 7 = 0 THEN 'variant' END",
    "located": "l_suppkey % 2 = 0",
    "option_shown": "l_suppkey % 5 = 0",
    "option_use": "CASE l_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END",
    "option_unsure": "l_suppkey % 4 = 0",
    "concluded": "l_suppkey % 3 = 0",
    "physical": "l_partkey % 11 = 0",
    "touched": "l_suppkey % 7 = 0",
    "marked": "l_suppkey % 7 = 1",
    "form_applies": "CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 = 1 END",
    "external": "l_partkey % 13 = 0",
    "has_sheet": "l_suppkey % 9 = 0",
    "ok_verdict": "CASE l_suppkey % 8 WHEN 0 THEN 'fit' WHEN 1 THEN 'unfit' END",
    "has_document": "l_suppkey % 2 = 1",
    "quoted": "l_discount > 0.05",
    "nothing_found": "l_tax < 0.02",
    "unreadable": "l_partkey % 17 = 0",
    "kind": "CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 6 END",
    "asked": "l_partkey % 5 = 0",
    "offered": "l_suppkey % 3 < 2",
    "matching": "l_suppkey % 3 = 0",
    "compared": "CASE l_partkey % 6 WHEN 0 THEN 'equal' WHEN 1 THEN 'different' WHEN 2 THEN 'partial' WHEN 3 THEN 'not_comparable' WHEN 4 THEN 'not_asked' ELSE 'equal' END",
    "conditions": "l_suppkey % 4",
    "pending": "CASE WHEN l_suppkey % 4 > 0 THEN l_linenumber % 2 ELSE 0 END",
    "asks_more": "l_suppkey % 10 = 0",
    "by_absence": "l_partkey % 2 = 1",
    "evidence": "l_linenumber % 3",
    "exigence": "CASE WHEN l_suppkey % 5 < 4 THEN 'condition' ELSE 'document' END",
}
#: Forms of guarantee that a requirement names and that a bid chose.
REQUIRED = "CASE l_partkey % 5 WHEN 0 THEN array('policy') WHEN 1 THEN array('check', 'policy') ELSE array() END"
CHOSEN = "CASE l_suppkey % 4 WHEN 0 THEN array('policy') WHEN 1 THEN array('note') WHEN 2 THEN array('check') ELSE array() END"
CELLS = "cells AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{v} AS {k}" for k, v in FACTS.items()) + """,
CASE l_partkey % 5 WHEN 0 THEN ['policy'] WHEN 1 THEN ['check', 'policy'] ELSE [] END AS required_forms,
CASE l_suppkey % 4 WHEN 0 THEN ['policy'] WHEN 1 THEN ['note'] WHEN 2 THEN ['check'] ELSE [] END AS chosen_forms FROM lineitem),
pages AS (SELECT DISTINCT l_orderkey, kind, true AS r FROM cells WHERE unreadable AND kind IS NOT NULL),
facts AS (SELECT c.*, coalesce(r, false) AS reached FROM cells c LEFT JOIN pages p ON c.l_orderkey = p.l_orderkey AND c.kind = p.kind)"""


def _cells(t: Tables):
    kind = lambda x: f"CAST({x} AS ARRAY<STRING>)"
    cells = t.lineitem.selectExpr(*KEYS, *[f"{v} AS {k}" for k, v in FACTS.items()], f"{kind(REQUIRED)} AS required_forms", f"{kind(CHOSEN)} AS chosen_forms")
    return R.reach_of_unreadable(cells, "l_orderkey", "kind")


#: Each rule as SQL: conditions with what they leave (outcome, doubt, rule).
STANDS = "option IS NOT NULL AND complete AND located AND NOT option_shown AND option_use <> 'yes'"
PAPER = "physical AND NOT cited AND complete"
LOOSE = "outcome IN ('undetermined', 'missing') AND doubt IN ('', 'no_data')"
RULES = {
    "G19_guarantee_form": [("len(required_forms) > 0 AND len(chosen_forms) > 0 AND NOT list_has_any(required_forms, chosen_forms)", "'pass'", "''", "guarantee_form")],
    "G20_option": [(f"{STANDS} AND option_unsure", "'undetermined'", "'no_data'", "option_unsure"), (STANDS, "'pass'", "''", "option")],
    "G21_presentation": [
        (f"{PAPER} AND touched", "'undetermined'", "'no_data'", "presentation_circular"),
        (f"{PAPER} AND marked", "'undetermined'", "'no_data'", "presentation_mark"),
        (f"{PAPER} AND coalesce(form_applies, false)", "'fail'", "''", "presentation_missing"),
    ],
    "G22_external": [("(external OR doubt = 'external') AND NOT has_sheet", "'undetermined'", "'external'", "external")],
    "G23_technical": [
        ("category = 'technical' AND ok_verdict = 'fit'", "'pass'", "''", "technical_ok"),
        ("category = 'technical' AND ok_verdict IS NOT NULL", "'fail'", "''", "technical_ok"),
        ("category = 'technical' AND NOT has_document AND outcome = 'missing'", "'missing'", "''", "technical"),
        ("category = 'technical'", "'undetermined'", "'pending'", "technical"),
    ],
    "G24_unreadable": [("outcome NOT IN ('pass', 'fail') AND doubt <> 'contradiction' AND (unreadable OR reached)", "'undetermined'", "'unreadable'", "unreadable")],
    "G25_portal_value": [
        ("asked AND offered AND NOT matching", "'undetermined'", "'mismatch'", "portal_mismatch"),
        ("asked AND compared = 'not_comparable' AND (outcome IN ('pass', 'fail') OR (outcome = 'undetermined' AND (doubt NOT IN ('', 'no_data') OR (conditions > 0 AND pending = 0))))", "outcome", "doubt", "portal_both"),
        ("asked AND compared = 'not_comparable' AND conditions > 0", "'undetermined'", "'no_data'", "portal_partial"),
        ("asked AND compared IN ('not_comparable', 'partial')", "'undetermined'", "'mismatch'", "portal_mismatch"),
        ("asked AND compared = 'equal' AND outcome = 'fail'", "'undetermined'", "'mismatch'", "portal_mismatch"),
        ("asked AND compared = 'equal' AND asks_more AND outcome = 'pass'", "outcome", "doubt", "portal_both"),
        ("asked AND compared = 'equal' AND (asks_more OR pending > 0)", "'undetermined'", "'no_data'", "portal_partial"),
        ("asked AND compared = 'equal'", "'pass'", "''", "portal_pass"),
        ("asked AND compared = 'different' AND outcome = 'pass' AND NOT matching", "'undetermined'", "'mismatch'", "portal_mismatch"),
        ("asked AND compared = 'different'", "'fail'", "''", "portal_fail"),
    ],
    "G26_absence": [(f"{LOOSE} AND by_absence AND complete AND NOT cited AND conditions > 0 AND evidence = 0 AND exigence = 'condition'", "'pass'", "''", "absence")],
    "G20_marked_option": [(f"option IS NULL AND option_use = 'no' AND category <> 'technical' AND {LOOSE} AND NOT option_shown AND NOT concluded", "'undetermined'", "'no_data'", "option_marked")],
}
COLUMNS = dict(zip(RULES, R.RULES[:2] + R.RULES[2:8] + (R.marked_option,), strict=True))


def _case(rows: list[tuple[str, str, str, str]], place: int, other: str) -> str:
    quoted = lambda r: f"'{r[3]}'" if place == 3 else r[place]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {quoted(r)}" for r in rows) + f" ELSE {other} END"


def _register(name: str) -> None:
    rows = RULES[name]
    keys = ", ".join(KEYS)

    @query(name, f"WITH {CELLS} SELECT * FROM (SELECT {keys}, {_case(rows, 1, 'NULL')} AS outcome, {_case(rows, 2, 'NULL')} AS doubt, {_case(rows, 3, 'NULL')} AS rule FROM facts) WHERE rule IS NOT NULL")
    def one(t: Tables):
        return _cells(t).select(*KEYS, COLUMNS[name]().alias("v")).where("v IS NOT NULL").select(*KEYS, "v.outcome", "v.doubt", "v.rule")


for _name in RULES:
    _register(_name)

ALL = [row for rows in RULES.values() for row in rows]


@query("P13_first_rule", f"WITH {CELLS} SELECT {', '.join(KEYS)}, {_case(ALL, 1, 'outcome')} AS outcome, {_case(ALL, 2, 'doubt')} AS doubt, {_case(ALL, 3, 'NULL')} AS rule FROM facts")
def p13(t: Tables):
    """All nine rules: the first that fires decides."""
    return R.applied(_cells(t)).select(*KEYS, "outcome", "doubt", "rule")


@query("K7_rule_counts", f"WITH {CELLS} SELECT {_case(ALL, 3, 'NULL')} AS rule, count(*) AS n FROM facts GROUP BY 1")
def k7(t: Tables):
    """How often each rule of the register decides."""
    return R.applied(_cells(t)).groupBy("rule").agg(F.count("*").alias("n"))


@query("G23_line_quoted", f"WITH {CELLS} SELECT {', '.join(KEYS)}, CASE WHEN quoted OR cited THEN 'yes' WHEN complete AND nothing_found THEN 'no' ELSE 'unknown' END AS state FROM facts WHERE category = 'technical'")
def g23_line(t: Tables):
    return _cells(t).where("category = 'technical'").select(*KEYS, R.line_quoted().alias("state"))


GROUPS = """g AS (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS i, CASE l_partkey % 7 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'undetermined' ELSE 'silent' END AS result,
CASE l_suppkey % 3 WHEN 0 THEN 'no_data' WHEN 1 THEN 'no_citation' ELSE 'doubt' END AS doubt, CASE WHEN l_suppkey % 4 > 0 THEN 'document' ELSE 'condition' END AS exigence,
CASE WHEN l_partkey % 9 = 0 THEN 'no' ELSE 'unknown' END AS option_use, l_partkey % 10 = 0 AS found, l_partkey % 50 = 0 AS external, l_suppkey % 10 > 0 AS complete,
CASE WHEN l_linestatus = 'F' THEN concat('part ', l_partkey) END AS explanation FROM lineitem)"""


@query(
    "A19_combined",
    f"""WITH {GROUPS}, s AS (SELECT l_orderkey, bool_or(result = 'pass') AS p, bool_or(result = 'fail') AS f, bool_or(result = 'undetermined') AS u, bool_or(external) AS x, bool_and(complete) AS a,
bool_or(result = 'undetermined' AND doubt = 'no_data') AS nd, bool_and(doubt = 'no_citation') FILTER (result = 'undetermined') AS nc, bool_and(exigence = 'document') AS d, bool_or(option_use = 'no') AS o, bool_or(found) AS seen,
arg_min(explanation, i) FILTER (explanation IS NOT NULL) AS explanation, count(*) AS groups FROM g GROUP BY 1),
v AS (SELECT *, CASE WHEN x THEN 'external' WHEN p AND f THEN 'contradiction' WHEN (p OR f) AND u THEN CASE WHEN a THEN 'doubt' ELSE 'incomplete' END WHEN p OR f THEN '' WHEN u AND nd THEN 'no_data' WHEN u AND nc THEN 'no_citation'
WHEN u THEN CASE WHEN a THEN 'doubt' ELSE 'incomplete' END WHEN a AND d AND NOT o AND NOT seen THEN '' WHEN NOT a THEN 'incomplete' ELSE 'no_data' END AS doubt FROM s)
SELECT l_orderkey, CASE WHEN doubt <> '' THEN 'undetermined' WHEN p THEN 'pass' WHEN f THEN 'fail' ELSE 'missing' END AS outcome, doubt, explanation, groups FROM v""",
)
def a19(t: Tables):
    groups = t.lineitem.selectExpr(*[x.strip() for x in _fields(GROUPS)])
    # numbers of part and line may meet in one i; the row that is read first goes first then
    return R.combined(groups.withColumn("i", F.struct("i", F.monotonically_increasing_id().alias("at"))), ["l_orderkey"], "i")


def _fields(cte: str) -> list[str]:
    """The select list of a one-table CTE."""
    inner = cte[cte.index("SELECT") + 6 : cte.rindex("FROM")]
    out, depth, at = [], 0, 0
    for i, ch in enumerate(inner):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(inner[at:i])
            at = i + 1
    return [*out, inner[at:]]


VOTES = """v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'discard' WHEN 2 THEN 'doubt' WHEN 3 THEN 'discard' END AS a,
CASE l_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'doubt' END AS b, l_returnflag <> 'R' AS supported, l_discount > 0.04 AS motive_optional, l_tax > 0.03 AS of_option FROM lineitem)"""


@query(
    "G11_two_votes",
    f"""WITH {VOTES}, d AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'kept no_opinion' WHEN (a IS NULL OR b IS NULL) AND coalesce(a, b) IN ('keep', 'yes') THEN 'kept one_opinion' WHEN a IS NULL OR b IS NULL THEN 'suggested one_opinion'
WHEN a = 'doubt' THEN 'suggested doubt' WHEN a = 'keep' AND b = 'yes' THEN 'kept ' WHEN a = 'keep' THEN CASE WHEN b = 'no' THEN 'suggested disagree' ELSE 'suggested doubt' END WHEN NOT supported THEN 'suggested unsupported'
WHEN motive_optional AND of_option THEN 'suggested disagree' WHEN b = 'no' THEN 'discarded motive' WHEN b = 'yes' THEN 'suggested disagree' ELSE 'suggested doubt' END AS x FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, split_part(x, ' ', 1) AS destination, split_part(x, ' ', 2) AS why FROM d""",
)
def g11(t: Tables):
    return t.lineitem.selectExpr(*_fields(VOTES)).select(*KEYS, R.two_votes().alias("v")).select(*KEYS, "v.destination", "v.why")


DISCARDS = """c AS (SELECT o_custkey AS offer, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber END AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_linenumber % 4 < 3)"""


def _discards(t: Tables):
    """Failed cells of the categories that discard: the bid, and the line of a technical row."""
    lines = t.lineitem.where("l_returnflag = 'R' AND l_linenumber % 4 < 3")
    both = lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("offer")), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("offer", F.expr("CASE WHEN l_linenumber % 4 = 0 THEN l_linenumber END").alias("item"))


@query(
    "G4_discard_scope",
    f"""WITH {DISCARDS}, w AS (SELECT offer, bool_or(item IS NULL) AS whole FROM c GROUP BY 1)
SELECT offer, CASE WHEN whole THEN NULL ELSE item END AS line, whole, count(*) AS grounds FROM c JOIN w USING (offer) WHERE NOT whole OR item IS NULL GROUP BY 1, 2, 3""",
)
def g4(t: Tables):
    """A bid with a ground that isn't a line's is proposed whole, with those grounds; any other bid line by line."""
    return L.discard_units(_discards(t), "offer", "item")


@query(
    "G5_discard_decisions",
    f"""WITH {DISCARDS}, w AS (SELECT offer, bool_or(item IS NULL) AS whole FROM c GROUP BY 1), u AS (SELECT DISTINCT offer, CASE WHEN whole THEN NULL ELSE item END AS line FROM c JOIN w USING (offer) WHERE NOT whole OR item IS NULL),
q AS (SELECT o_custkey AS offer, max(o_orderkey) AS request FROM orders GROUP BY 1),
d AS (SELECT user_id AS offer, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 4 END AS line, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT *, row_number() OVER (PARTITION BY offer, line ORDER BY ts DESC, event_id DESC) AS rn FROM d)
SELECT u.offer, u.line, request, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'proposed' END AS state
FROM u LEFT JOIN q ON q.offer = u.offer LEFT JOIN l ON l.offer = u.offer AND l.line IS NOT DISTINCT FROM u.line AND rn = 1""",
)
def g5(t: Tables):
    """Each unit of discard with the latest decision on it, bound to the bid's current request."""
    units = L.discard_units(_discards(t), "offer", "item").select("offer", "line")
    request = t.orders.groupBy(F.col("o_custkey").alias("offer")).agg(F.max("o_orderkey").alias("request"))
    events = t.events.where("event_type IN ('click', 'error')")
    decisions = events.selectExpr("user_id AS offer", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 4 END AS line", "event_type", "ts", "event_id")
    last = L.latest(decisions, ["offer", "line"], ["ts", "event_id"]).select(F.col("offer").alias("o"), F.col("line").alias("l"), "event_type")
    out = units.join(request, "offer", "left").join(last, (F.col("offer") == F.col("o")) & F.col("line").eqNullSafe(F.col("l")), "left")
    return out.select("offer", "line", "request", F.expr("CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'error' THEN 'rejected' ELSE 'proposed' END").alias("state"))


@query(
    "G7_observations",
    """SELECT l_orderkey, concat_ws('; ', CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'missing ' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'A') END,
CASE WHEN count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') > 0 THEN 'remedy asked ' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') END,
CASE WHEN count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O' AND l_suppkey % 2 = 0) > 0 THEN 'remedy to decide ' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O' AND l_suppkey % 2 = 0) END) AS notes FROM lineitem GROUP BY 1""",
)
def g7(t: Tables):
    """What keeps a bid from being without observations: missing documents, remedies asked, remedies still to decide."""
    remediable = F.col("l_returnflag") != "R"
    asked = F.col("l_linestatus") == "F"

    def note(label: str, keep) -> F.Column:
        numbers = F.sort_array(F.collect_list(F.when(keep, F.struct("l_linenumber", "l_partkey"))))["l_linenumber"]
        return F.when(F.size(numbers) > 0, F.concat(F.lit(label + " "), F.array_join(numbers.cast("array<string>"), ",")))

    notes = [note("missing", F.col("l_returnflag") == "A"), note("remedy asked", remediable & asked), note("remedy to decide", remediable & (F.col("l_linestatus") == "O") & (F.col("l_suppkey") % 2 == 0))]
    return t.lineitem.groupBy("l_orderkey").agg(F.concat_ws("; ", *notes).alias("notes"))


@query(
    "G9_three_outputs",
    """WITH q AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'O'), x AS (SELECT l.l_orderkey, CASE l_returnflag WHEN 'A' THEN 'missing' WHEN 'R' THEN 'undetermined' ELSE 'pass' END AS outcome, q.o_orderkey IS NOT NULL AS asked, l_linestatus = 'F' AS cited, l_suppkey % 5 > 0 AS named FROM lineitem l LEFT JOIN q ON l_orderkey = o_orderkey)
SELECT l_orderkey, count(*) AS cells, count(*) FILTER (outcome = 'missing' AND NOT asked) AS no_question, count(*) FILTER (outcome = 'undetermined' AND NOT asked AND NOT named) AS unnamed, count(*) FILTER (outcome = 'pass' AND NOT cited) AS no_ground FROM x GROUP BY 1""",
)
def g9(t: Tables):
    """Cells that break the form of the three outputs: missing without a question, undetermined without question or name, pass without a quote."""
    asked = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")).distinct().withColumn("asked", F.lit(True))
    rows = t.lineitem.join(asked, "l_orderkey", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    count = lambda e: F.count_if(F.expr(e))
    return rows.groupBy("l_orderkey").agg(
        F.count("*").alias("cells"), count("l_returnflag = 'A' AND NOT asked").alias("no_question"),
        count("l_returnflag = 'R' AND NOT asked AND l_suppkey % 5 = 0").alias("unnamed"), count("l_returnflag = 'N' AND l_linestatus <> 'F'").alias("no_ground"),
    )


@query("G27_technical_decisions", "SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, p_brand, l_returnflag AS action, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 4 = 0")
def g27(t: Tables):
    """Decisions on technical rows with their procedure, bid, requirement and who took them, in that order."""
    rows = t.lineitem.where("l_linenumber % 4 = 0").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    out = rows.select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "p_brand", F.col("l_returnflag").alias("action"), "s_name")
    return out.orderBy("o_custkey", "o_orderkey", "l_linenumber", "l_partkey")


ANSWERS = """a AS (SELECT user_id AS procedure_id, event_id, ts, event_id // 7 AS question, CASE event_type WHEN 'view' THEN 'pair' WHEN 'click' THEN 'requirement' WHEN 'purchase' THEN 'procedure' ELSE 'pair' END AS scope, CAST(value AS INTEGER) % 5 AS requirement, event_id % 3 AS offer, value FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_id, question ORDER BY ts DESC, event_id DESC) AS rn FROM a) WHERE rn = 1)"""


def _answers(t: Tables):
    scope = "CASE event_type WHEN 'view' THEN 'pair' WHEN 'click' THEN 'requirement' WHEN 'purchase' THEN 'procedure' ELSE 'pair' END AS scope"
    rows = t.events.selectExpr("user_id AS procedure_id", "event_id", "ts", "event_id div 7 AS question", scope, "CAST(round(value) AS INT) % 5 AS requirement", "event_id % 3 AS offer", "value")
    return L.latest(rows, ["procedure_id", "question"], ["ts", "event_id"])


@query(
    "G28_applicable_answers",
    f"""WITH {ANSWERS.replace("CAST(value AS INTEGER)", "CAST(round(value) AS INTEGER)")}, r AS (SELECT DISTINCT l_suppkey AS procedure_id, l_linenumber % 3 AS offer, l_partkey % 5 AS requirement FROM lineitem),
f AS (SELECT procedure_id, r.offer, r.requirement, event_id, ts, value FROM r JOIN l USING (procedure_id) WHERE scope = 'procedure' OR (l.requirement = r.requirement AND (scope = 'requirement' OR (scope = 'pair' AND l.offer = r.offer)))),
b AS (SELECT *, row_number() OVER (PARTITION BY procedure_id, offer, requirement ORDER BY value DESC, ts, event_id) AS k FROM f)
SELECT procedure_id, offer, requirement, event_id, CAST(row_number() OVER (PARTITION BY procedure_id, offer, requirement ORDER BY ts, event_id) AS INTEGER) AS place FROM b WHERE k <= 20""",
)
def g28(t: Tables):
    """The committee's standing answers that apply to each pair of an offer and a requirement; beyond twenty, the best scored, in order of time."""
    asked = t.lineitem.selectExpr("l_suppkey AS procedure_id", "l_linenumber % 3 AS offer", "l_partkey % 5 AS requirement").distinct()
    own = _answers(t).withColumnsRenamed({"offer": "its_offer", "requirement": "its_requirement"})
    applies = "scope = 'procedure' OR (its_requirement = requirement AND (scope = 'requirement' OR (scope = 'pair' AND its_offer = offer)))"
    pair = ["procedure_id", "offer", "requirement"]
    out = L.best_in_time(asked.join(own, "procedure_id").where(applies), pair, [F.desc("value"), "ts", "event_id"], ["ts", "event_id"], 20)
    return out.select(*pair, "event_id", "place")


@query(
    "J22_answer_scope",
    f"""WITH {ANSWERS.replace("CAST(value AS INTEGER)", "CAST(round(value) AS INTEGER)")}, r AS (SELECT DISTINCT l_suppkey AS procedure_id, l_linenumber % 3 AS offer, l_partkey % 5 AS requirement, l_returnflag = 'R' AS undetermined, l_linestatus = 'F' AND l_discount > 0.05 AS decided FROM lineitem),
c AS (SELECT procedure_id, offer, requirement, bool_or(undetermined) AS undetermined, bool_and(decided) AS decided FROM r GROUP BY 1, 2, 3)
SELECT DISTINCT l.event_id, c.offer, c.requirement FROM l JOIN c USING (procedure_id) WHERE NOT decided AND ((scope = 'pair' AND c.offer = l.offer AND c.requirement = l.requirement) OR (scope = 'requirement' AND c.requirement = l.requirement) OR (scope = 'procedure' AND undetermined))""",
)
def j22(t: Tables):
    """The undecided pairs that an answer reaches: its own, those of its requirement, or all undetermined ones of its procedure."""
    cells = t.lineitem.selectExpr("l_suppkey AS procedure_id", "l_linenumber % 3 AS offer", "l_partkey % 5 AS requirement", "l_returnflag = 'R' AS u", "l_linestatus = 'F' AND l_discount > 0.05 AS d")
    cells = cells.groupBy("procedure_id", "offer", "requirement").agg(F.bool_or("u").alias("undetermined"), F.bool_and("d").alias("decided")).where("NOT decided")
    answers = _answers(t).select("event_id", "procedure_id", "scope", "offer", "requirement")
    of = lambda s, *drop: answers.where(F.col("scope") == s).drop("scope", *drop)
    pair = of("pair").join(cells, ["procedure_id", "offer", "requirement"])
    requirement = of("requirement", "offer").join(cells, ["procedure_id", "requirement"])
    procedure = of("procedure", "offer", "requirement").join(cells.where("undetermined"), ["procedure_id"])
    out = pair.select("event_id", "offer", "requirement")
    for part in (requirement, procedure):
        out = out.unionByName(part.select("event_id", "offer", "requirement"))
    return out.distinct()


SKIP = "CASE WHEN outcome NOT IN ('pass', 'fail') THEN 'outcome' WHEN l_partkey % 9 = 0 THEN 'rule' WHEN by_absence AND l_partkey % 9 = 1 THEN 'criterion' WHEN NOT cited THEN 'no_citation' WHEN external THEN 'external' WHEN {} THEN 'reserved' END"


@query("P14_skip_reason", f"WITH {CELLS}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) SELECT {', '.join(KEYS)}, {SKIP.format('s_suppkey IS NOT NULL')} AS reason FROM facts LEFT JOIN s ON s_suppkey = l_suppkey")
def p14(t: Tables):
    """Why a cell isn't sent out for checking, null if it is; the last reason is that it rests on a reserved document."""
    reserved = t.supplier.where("s_acctbal < 2000").select(F.col("s_suppkey").alias("r"))
    rows = _cells(t).join(reserved, F.col("l_suppkey") == F.col("r"), "left")
    return rows.select(*KEYS, F.expr(SKIP.format("r IS NOT NULL")).alias("reason"))


CHECKS = {
    "document_named": "event_type <> 'view' OR json_k IS NOT NULL",
    "target_named": "event_type NOT IN ('click', 'purchase') OR value > 1",
    "procedure_named": "user_id > 10 OR event_type IN ('error', 'signup')",
    "times_in_order": "ts >= TIMESTAMP '2024-01-02 00:00:00'",
}


@query("P11_broken_checks", "WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS json_k FROM events) SELECT event_id, broken FROM (SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in CHECKS.items()) + ") AS broken FROM e) WHERE broken <> ''")
def p11(t: Tables):
    """Rows that break a rule of integrity, with the names of the rules."""
    rows = t.events.withColumn("json_k", F.get_json_object("props", "$.k").cast("int"))
    return rows.select("event_id", F.array_join(R.failing({k: F.expr(v) for k, v in CHECKS.items()}), ",").alias("broken")).where("broken <> ''")


@query("R7_first_item", "SELECT event_id, TRY_CAST(string_split(concat(event_type, ',', CAST(value AS INTEGER)), ',')[CAST(1 + event_id % 3 AS INTEGER)] AS INTEGER) AS item FROM events".replace("CAST(value AS INTEGER)", "CAST(floor(value) AS INTEGER)"))
def r7(t: Tables):
    """One element of a list as a number: null if it isn't there or is no number."""
    items = F.array("event_type", F.floor("value").cast("int").cast("string"))
    return t.events.select("event_id", F.try_element_at(items, (1 + F.col("event_id") % 3).cast("int")).try_cast("int").alias("item"))


@query(
    "R5_result_signature",
    """SELECT l_orderkey, md5(concat(o_orderstatus, '|', o_orderpriority, '|', string_agg(concat(l_partkey, ':', l_linenumber), ',' ORDER BY l_linenumber, l_partkey))) AS signature FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderstatus, o_orderpriority""",
)
def r5(t: Tables):
    """A digest of a result: its status, its reason and the units it cites, in order."""
    cited = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(x["l_partkey"], F.lit(":"), x["l_linenumber"])), ",")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "o_orderstatus", "o_orderpriority").agg(cited.alias("c")).select("l_orderkey", F.md5(F.concat("o_orderstatus", F.lit("|"), "o_orderpriority", F.lit("|"), "c")).alias("signature"))


@query(
    "G2_reading_states",
    "SELECT user_id, event_type, event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN rn = 1 THEN 'in use' ELSE 'superseded' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)",
)
def g2(t: Tables):
    """A document's readings: the last validated one is in use, those before are superseded, rejected ones stay so."""
    from pyspark.sql.window import Window

    rn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    state = F.when(F.col("event_type") == "error", "rejected").when(rn == 1, "in use").otherwise("superseded")
    return t.events.select("user_id", "event_type", "event_id", state.alias("state"))


@query(
    "P8_latest_readings",
    "SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE ts = last AND event_type <> 'error'",
)
def p8(t: Tables):
    """Rows of each document's latest reading; one of an excluded kind leaves none, as the latest is found first."""
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return t.events.join(last, ["user_id", "ts"]).where("event_type <> 'error'").select("event_id", "user_id")
